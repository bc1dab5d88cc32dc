"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams of its letters, weighted by TF-IDF and scaled to
length one. Each language has a few centroids, found by spherical k-means on a bounded
sample of its rows. A text gets the language of the centroid with the largest cosine;
beyond a distance that nearly all sample rows keep, it is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.common import as_bytes, map_columns, materialize, parts, small, text_of

LETTER = regex.compile(r"\p{L}")
#: Number of hashed n-grams, of 1 to 3 bytes.
DIM, ORDERS = 1 << 12, (1, 2, 3)
#: Texts are turned into vectors in runs of so many bytes.
AT_ONCE = 1 << 20
#: Bytes that are no letters count as one blank; A-Z as a-z.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIM), of length one
    owners: np.ndarray  # index of each centroid's language
    least: np.ndarray  # by language: a smaller cosine is rejected


def counts(text: bytes) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    x = FOLD[np.frombuffer(text, np.uint8)].astype(np.uint32)
    blank = np.array([32], np.uint32)
    x = np.concatenate((blank, x, blank))
    x = np.concatenate((blank, x[1:][(x[1:] != 32) | (x[:-1] != 32)]))  # of blanks in a row one
    total = np.zeros(DIM, np.int64)
    for n in ORDERS:
        code = x[: len(x) - n + 1].copy()
        for i in range(1, n):
            code = (code << 8) | x[i : len(x) - n + 1 + i]
        total += np.bincount(((code + n) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    return total


def count_rows(texts: list[bytes | None]) -> np.ndarray:
    return np.array([counts(t or b"") for t in texts]).reshape(-1, DIM)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: begins with the row nearest to the mean, then the rows farthest from those taken."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        if near.min() > 1 - 1e-6:
            break
        chosen.append(int(near.argmin()))
    c = x[chosen]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.array([x[at == i].sum(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(docs: DataFrame, usable: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, clusters: int = 4, keep: float = 0.995) -> Model:
    """Learn from the rows whose id is usable and whose lang is not null.

    The n-grams' document frequencies count all these rows. The centroids are fitted on at most per_language
    different texts of each language (the documented bound of the sample), those of the least hash; so each language has a centroid, however many copies
    one text has. A text is turned into n-gram counts before the texts of a language meet, so that a language's task holds
    per_language vectors whatever the lengths.
    """
    rows = docs.where(usable(doc_id) & F.col(lang).isNotNull()).select(text_of(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text_of(text)).alias("h"))

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, many = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                n += counts(t) > 0
            many += batch.num_rows
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1]), pa.array([*n[some].tolist(), many])], names=["k", "n"])

    df, total = np.zeros(DIM, np.int64), 0
    for r in rows.select("text").mapInArrow(documents_with, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows at most
        if r["k"] < 0:
            total = r["n"]
        else:
            df[r["k"]] = r["n"]
    if not total:
        return Model([], np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.05)

    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # Spark keeps per_language rows of a language in each task before it shuffles
    picked = materialize(rows.select("lang", "h").distinct().withColumn("_k", place).where(F.col("_k") <= per_language).drop("_k"))
    sample = rows.join(small(picked, picked.count()), ["lang", "h"], "left_semi")

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [counts(t).astype("<i8").tobytes() for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], names=["lang", "h", "tf"])

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        x = vectors(np.array([np.frombuffer(t, "<i8") for t in rows["tf"]]), idf)
        c = cluster(x, clusters)
        least = float(np.quantile((x @ c.T).max(axis=1), 1 - keep))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "least": least, "centroid": [v.tobytes() for v in c]})

    one = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = one.mapInArrow(vectorise, "lang string, h long, tf binary").groupBy("lang").applyInPandas(fit_one, "lang string, least double, centroid binary").collect()  # clusters rows for each language
    got.sort(key=lambda r: (r["lang"], r["centroid"]))
    names = sorted({r["lang"] for r in got})
    least = {r["lang"]: r["least"] for r in got}
    return Model(names, idf, np.array([np.frombuffer(r["centroid"], np.float32) for r in got]).reshape(-1, DIM), np.array([names.index(r["lang"]) for r in got], int), np.array([least[x] for x in names]))


def classify(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine from 0 to 1, and whether it is rejected, of each text. Of equal cosines the language that is first by code point wins."""
    lettered = np.array([t is not None and LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    near = vectors(count_rows(texts), model.idf) @ model.centroids.T
    at = near.argmax(axis=1)
    owner = model.owners[at]
    score = np.where(lettered, np.clip(near[np.arange(len(texts)), at].astype(float), 0, 1), 0.0)
    rejected = ~lettered | (score < model.least[owner] - 1e-6)  # a sample row at the bound isn't rejected by rounding
    return [model.languages[i] if ok else "und" for i, ok in zip(owner, lettered, strict=True)], score, rejected


def predict(docs: DataFrame, model: Model, carry: list[Column], text: str = "text", strict: bool = False) -> DataFrame:
    """The carried columns, lang_pred, score and rejected.

    A text that is null or has no letter is `und` with score 0. Others get the nearest
    language; if strict, those that are rejected as too far from it are `und` too.
    """
    kept = docs.select(*carry).schema
    names = [f.name for f in kept]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = as_bytes(batch.column(0))
        for a, b in parts(texts, AT_ONCE):
            for i in range(a, b, 256):
                j = min(i + 256, b)
                lang, score, rejected = classify(texts[i:j], model)
                lang = ["und" if strict and far else x for x, far in zip(lang, rejected, strict=True)]
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in batch.columns[1:]], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_columns(docs, [F.col(text), *carry], f"{schema}, lang_pred string, score double, rejected boolean", step)


def identify(docs: DataFrame, usable: Callable[[str], Column], held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row; fitted on rows whose id is usable.

    Repeated rows get the same values; without any labelled row all are `und`. Other
    columns are neither read nor returned. An empty table gives no rows.
    """
    model = fit(docs, usable, doc_id, text, lang)
    return predict(docs, model, [F.col(doc_id).alias("doc_id"), held_out.alias("held_out")], text)
