"""Quality scores from a small convolutional network over bytes, in numpy.

Filters of six bytes slide over the whole document. They are pooled by maximum within
chunks of 256 bytes that overlap by 32; a hidden layer turns each chunk into a logit, and the
document's probability combines the mean and the extremes of its chunks' logits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, give_back, materialize, parts

#: Bytes of a filter (three pairs), of the grid on which chunks lie, of a chunk and between chunks.
WIDTH, GRID, CHUNK, STRIDE = 6, 32, 256, 224
FILTERS, HIDDEN = 16, 16
#: Bytes over which a task slides the filters at once.
AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray  # (HIDDEN,)
    out_bias: float
    combine: np.ndarray  # weights of mean, minimum and maximum of the chunks' logits, and a constant

    def pairs(self) -> list[np.ndarray]:
        """Tables of the sums of two neighbouring bytes' weights, (65536, FILTERS)."""
        return [(self.filters[i][None, :, :] + self.filters[i + 1][:, None, :]).reshape(65536, -1).astype(np.float32) for i in range(0, WIDTH, 2)]


def padded(text: bytes) -> bytes:
    """The text, zeros for its last filters, and zeros up to the grid; at least one chunk."""
    n = max(len(text) + WIDTH - 1, CHUNK)
    return text.ljust(-(-n // GRID) * GRID, b"\0")


def chunk_starts(size: int) -> list[int]:
    """Starts, on the grid, of chunks that cover size bytes."""
    return list(range(0, max(1, size - CHUNK + STRIDE), STRIDE))


def pooled(texts: list[bytes], net: Network, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter in each chunk of all texts, and the number of chunks of each text."""
    long = [padded(t) for t in texts]
    gap = bytes(GRID)  # keeps texts apart
    x = np.frombuffer(gap.join([*long, gap]), np.uint8).astype(np.int32)
    pair = x[:-1] + (x[1:] << 8)  # the later byte is the high one
    n = len(x) - GRID
    blocks = np.empty((n // GRID, FILTERS), np.float32)
    step = 1 << 15
    for i in range(0, n, step):
        j = min(i + step, n)
        sums = np.take(tables[0], pair[i:j], axis=0)
        for k in range(1, len(tables)):
            sums += np.take(tables[k], pair[i + 2 * k : j + 2 * k], axis=0)
        blocks[i // GRID : j // GRID] = sums.reshape(-1, GRID, FILTERS).max(axis=1)
    base, starts, ends, many = 0, [], [], []
    for t in long:
        s = chunk_starts(len(t))
        starts += [(base + a) // GRID for a in s]
        ends += [(base + min(a + CHUNK, len(t))) // GRID for a in s]
        many.append(len(s))
        base += len(t) + GRID
    edges = np.column_stack((starts, ends)).ravel()
    most = np.maximum.reduceat(np.concatenate((blocks, np.zeros((1, FILTERS), np.float32))), edges, axis=0)[::2]
    return np.maximum(most + net.bias, 0), np.array(many)


def chunk_logits(p: np.ndarray, net: Network) -> np.ndarray:
    return np.maximum(p @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias


def summary(z: np.ndarray, many: np.ndarray) -> np.ndarray:
    at = np.cumsum(many) - many
    return np.column_stack((np.add.reduceat(z, at) / many, np.minimum.reduceat(z, at), np.maximum.reduceat(z, at), np.ones(len(many))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summarised(texts: list[bytes], net: Network, tables: list[np.ndarray]) -> np.ndarray:
    p, many = pooled(texts, net, tables)
    return summary(np.clip(chunk_logits(p, net), -20, 20), many)


def scores(texts: list[bytes], net: Network, tables: list[np.ndarray]) -> np.ndarray:
    return sigmoid(summarised(texts, net, tables) @ net.combine)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7, rounds: int = 10, chunks_each: int = 6, rate: float = 0.01) -> Network:
    """Fit by Adam on chunks, which take their document's label; then fit the combination on whole documents.

    chunks_each chunks of each training document are drawn anew each round, and three in ten of them cut short, so
    that shortness alone tells nothing. Both labels weigh the same.
    """
    rng = np.random.default_rng(seed)
    net = {
        "filters": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)),
        "bias": np.zeros(FILTERS),
        "hidden": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
        "hidden_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "out_bias": np.zeros(1),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    m, v, t = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    long = [np.frombuffer(padded(x) + bytes(WIDTH), np.uint8) for x in texts]
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    for _ in range(rounds):
        picks = [(d, s) for d, x in enumerate(long) for s in rng.permutation(chunk_starts(len(x) - WIDTH))[:chunks_each]]
        rng.shuffle(picks)
        for i in range(0, len(picks), 64):
            some = picks[i : i + 64]
            x, cut = np.zeros((len(some), CHUNK + WIDTH - 1), np.uint8), rng.random(len(some))
            for r, (d, s) in enumerate(some):
                part = long[d][s : s + (CHUNK + WIDTH - 1 if cut[r] > 0.3 else int(16 + 800 * cut[r]))]
                x[r, : len(part)] = part
            y, w = np.array([labels[d] for d, _ in some], np.float32), np.array([share[d] for d, _ in some], np.float32)
            sums = net["filters"][0][x[:, :CHUNK]]
            for k in range(1, WIDTH):
                sums += net["filters"][k][x[:, k : k + CHUNK]]
            at = sums.argmax(axis=1)  # (n, FILTERS)
            raw = np.take_along_axis(sums, at[:, None, :], axis=1)[:, 0] + net["bias"]
            p = np.maximum(raw, 0)
            h_raw = p @ net["hidden"] + net["hidden_bias"]
            h = np.maximum(h_raw, 0)
            z = h @ net["out"] + net["out_bias"]
            dz = (sigmoid(z) - y) * w / len(some)
            dh = dz[:, None] * net["out"] * (h_raw > 0)
            dp = dh @ net["hidden"].T * (raw > 0)
            g = {"out": h.T @ dz, "out_bias": dz.sum(keepdims=True), "hidden": p.T @ dh, "hidden_bias": dh.sum(axis=0), "bias": dp.sum(axis=0), "filters": np.zeros_like(net["filters"])}
            rows, which = np.arange(len(some))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(g["filters"][k], (x[rows, at + k], np.broadcast_to(which, at.shape)), dp)
            t += 1
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net[k] = net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    made = Network(*[net[k].astype(np.float32) for k in ("filters", "bias", "hidden", "hidden_bias", "out")], float(net["out_bias"][0]), np.array([1.0, 0, 0, 0]))
    tables = made.pairs()
    rows = np.concatenate([summarised([x], made, tables) for x in texts])
    c = np.array([0.5, 0.25, 0.25, 0.0])
    for _ in range(60):  # Newton steps of a logistic regression with a little shrinkage
        q = sigmoid(rows @ c)
        s = share * q * (1 - q)
        c = c - np.linalg.solve(rows.T @ (rows * s[:, None]) + 0.05 * np.eye(4), rows.T @ (share * (q - labels)) + 0.05 * c)
    return replace(made, combine=c)


def sample(docs: DataFrame, labels: DataFrame, usable: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 800, windows: int = 64) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels (0 or 1) of a bounded sample of labelled rows whose id is usable, by id.

    The sample has per_label ids of each label, those of the least hash, at every size of the table. A document takes part whatever
    its length: of one of over windows * CHUNK characters, so many evenly spaced windows from its start to its end are taken. Both bounds are for
    training only. A label above 0 is 1; of several labels of an id the highest counts, of several texts of an id the
    least. Empty if there is no labelled row with a text.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.max(label) > 0).cast("int").alias("_y"))
    marked = marked.where(usable("_id")).withColumn("_h", F.xxhash64("_id"))
    picked = materialize(marked.where("_y = 1").orderBy("_h", "_id").limit(per_label).union(marked.where("_y = 0").orderBy("_h", "_id").limit(per_label)))  # bounded: may be broadcast
    most = windows * CHUNK
    spread = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring("_text", F.floor(i * (F.char_length("_text") - CHUNK) / (windows - 1)).cast("int") + 1, F.lit(CHUNK))))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(picked), "_id")
    texts = texts.select("_id", "_y", F.when(F.char_length("_text") > most, spread).otherwise(F.col("_text")).alias("_text"))
    got = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()  # 2 * per_label rows of a bounded length
    got = sorted((r["_id"], r["_text"], r["_y"]) for r in got)
    return [x.encode() for _, x, _ in got], np.array([y for _, _, y in got], float)


def fit(docs: DataFrame, labels: DataFrame, usable: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 800, windows: int = 64) -> Network | None:
    """Train on the sample. None if it is empty."""
    texts, y = sample(docs, labels, usable, doc_id, text, label, per_label, windows)
    return train(texts, y) if texts else None


def least_score(texts: list[bytes], labels: np.ndarray, lose: float = 0.005, floor: float = 0.2) -> float:
    """The score below which a stage rejects: such that good texts stay, 0.5 at most and floor at least.

    A network trained on every other text of the sample scores the rest. Of their good texts, a share of `lose` at most lies below
    the result. 0.5 if either half lacks a label.
    """
    half = np.arange(len(texts)) % 2 == 0
    if len({(h, y) for h, y in zip(half.tolist(), labels.tolist(), strict=True)}) < 4:
        return 0.5
    net = train([t for t, h in zip(texts, half, strict=True) if h], labels[half])
    tables = net.pairs()
    good = np.sort([scores([texts[i]], net, tables)[0] for i in np.flatnonzero(~half & (labels == 1))])
    return float(np.clip(good[int(lose * len(good))], floor, 0.5))


def score_rows(docs: DataFrame, net: Network | None, carry: list[Column], text: str = "text") -> DataFrame:
    """The carried columns and score. Without a network all scores are 0.5. A null text is empty."""
    kept = docs.select(*carry).schema
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs() if net else []
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(0))]
            for a, b in parts(texts, AT_ONCE):
                s = np.full(b - a, 0.5) if net is None else scores(texts[a:b], net, tables)
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in batch.columns[1:]], pa.array(s)], names=[*names, "score"])
        del tables
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(F.col(text), *carry).mapInArrow(run, f"{schema}, score double")


def quality(docs: DataFrame, labels: DataFrame, usable: Callable[[str], Column], held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of each row.

    Without labels all scores are 0.5. Empty and null texts are scored like any other. Repeated rows get equal scores. Other
    columns are neither read nor returned. An empty table gives no rows.
    """
    net = fit(docs, labels, usable, doc_id, text)
    rows = score_rows(docs, net, [F.col(doc_id).alias("doc_id"), held_out.alias("held_out")], text)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, usable: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", least: float | None = None) -> DataFrame:
    """The rows of docs with a score of at least `least` (None: least_score of the sample), with all their columns. Without labels nothing is rejected."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    where = {c: f"_{i}" for i, c in enumerate(columns)}
    texts, y = sample(docs, labels, usable, doc_id, text)
    net = train(texts, y) if texts else None
    if least is None:
        least = least_score(texts, y)
    rows = score_rows(named, net, [F.col(c) for c in named.columns], where[text]).where(F.col("score") >= least)
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
