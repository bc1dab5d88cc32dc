"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A row of tokens is the encoding of a word exactly if each two neighbours, merged on their own, stay apart. So the encoder
reads a word from the left, takes the longest token that stands at the place (an Aho-Corasick automaton finds all tokens of
the word in one pass), and asks a table whether it may follow the token before it; else it tries the next shorter prefix that
is a token. Where none fits, the place is closed for good and the last token is taken back. Each place is closed once at most,
so the time is linear in the word.

Whether two tokens stay apart is found by undoing merges at their border, the latest first, and remembered. Words between
white space encode on their own and are remembered by each Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, map_columns, parts

#: Words and pairs that a Python worker remembers; longer words are encoded each time.
REMEMBERED, PAIRS, LONGEST = 300_000, 300_000, 64
#: Bytes of text that a task encodes, and tokens that it decodes, at once.
AT_ONCE, TOKENS = 1 << 22, 1 << 20
#: Stands for the end of a word in vocabularies that mark it.
END = "Ā"
NEVER = 1 << 62
#: Characters whose classes, cases and compositions are the same in all versions of Unicode that the libraries know; texts with others go through the library's own normaliser and splitter.
SETTLED = r"\x00-ԯ - ‐-  - ぁ-ゖゝ-ヾ一-龥가-힣"
UNSETTLED = re.compile(f"[^{SETTLED}]")
#: What str.split takes for white space and the tokenizers' patterns don't.
SEPARATORS = re.compile(r"[\x1C-\x1F]")


def byte_letters() -> dict[str, str]:
    """The character of byte-level vocabularies for each byte (as a Latin-1 character): itself if it prints, else the next free one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): chr(b) for b in prints} | {chr(b): chr(256 + i) for i, b in enumerate(rest)}


class Backtracker:
    """Encodes words (bytes as Latin-1 characters, END last where the vocabulary marks it) into token numbers."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """tokens: number by spelling; merges in the order in which they are made."""
        self.base = max(tokens.values(), default=0) + 1
        self.size = [0] * self.base
        for spelling, i in tokens.items():
            self.size[i] = len(spelling)
        self.birth, self.halves, self.rank = [-1] * self.base, [(i, i) for i in range(self.base)], {}
        for k, (a, b) in enumerate(merges):
            left, right, both = tokens[a], tokens[b], tokens[a + b]
            if self.birth[both] >= 0:
                raise ValueError("two merges make one token")
            self.birth[both], self.halves[both], self.rank[left * self.base + right] = k, (left, right), k
        if any(max(self.birth[left], self.birth[right]) >= self.birth[i] for i, (left, right) in enumerate(self.halves) if self.birth[i] >= 0):
            raise ValueError("a merge comes before its parts")
        self.apart: dict[int, bool] = {}
        own = {s: i for s, i in tokens.items() if (self.whole(i) if self.birth[i] >= 0 else len(s.removesuffix(END)) == 1)}  # those that an encoding can hold
        self.shorter = [-1] * self.base  # the longest prefix of each token that is a token
        self.found = ahocorasick.Automaton()
        for s, i in own.items():
            self.found.add_word(s, i)
            self.shorter[i] = next((own[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in own), -1)
        self.found.make_automaton()

    def whole(self, token: int) -> bool:
        """Whether a merged token's own spelling is merged to it: no earlier merge joins its halves."""
        left, right = self.halves[token]
        return self.stays_apart(left, right, self.birth[token])

    def stays_apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge made before the given one joins a and b, or what they were made of, across their border.

        The border's two tokens are undone in the order of their births, the latest first. Of merges of one rank the left one
        comes first: a left token is gone before a merge of its maker's rank, a right token isn't.
        """
        rank, birth, base = self.rank, self.birth, self.base
        limit = before  # merges below it find the two side by side
        while True:
            if rank.get(a * base + b, NEVER) < limit:
                return False
            if birth[a] > birth[b]:
                limit, a = birth[a], self.halves[a][1]
            elif birth[b] >= 0:
                limit, b = birth[b] + 1, self.halves[b][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        n = len(word)
        size, shorter, base, apart = self.size, self.shorter, self.base, self.apart
        longest = [-1] * (n + 1)
        for end, token in self.found.iter(word):
            longest[end + 1 - size[token]] = token  # of one place the longer ones come later
        closed = bytearray(n + 1)
        if n and word[-1] == END:
            closed[n - 1] = 1
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                if not closed[at + size[token]]:
                    if last < 0:
                        break
                    if (ok := apart.get(pair := last * base + token)) is None:
                        if len(apart) >= PAIRS:
                            apart.clear()
                        ok = apart[pair] = self.stays_apart(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = at + size[token], token
                token = longest[at]
            else:
                if not out:
                    raise ValueError("a word has no encoding")
                closed[at] = 1
                token = out.pop()  # its end is closed now: a shorter one is tried
                at, last = at - size[token], out[-1] if out else -1
        return out


class _Numbers(dict):
    """Numbers words as they come; `make` gives the tokens of a new one."""

    def __init__(self, make: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.make, self.flat, self.sizes, self.uses = make, array("i"), array("i"), np.zeros(0, np.int64)

    def add(self, made: list[int]) -> int:
        self.flat.extend(made)
        self.sizes.append(len(made))
        return len(self.sizes) - 1

    def __missing__(self, word: str) -> int:
        n = self.add(self.make(word))
        if len(word) <= LONGEST:
            self[word] = n
        return n

    def tokens(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the numbered words in a row, and how many each has."""
        sizes, flat = np.array(self.sizes, np.int64), np.array(self.flat, np.int32)
        self.uses = np.bincount(w, minlength=len(sizes)) + np.pad(self.uses, (0, len(sizes) - len(self.uses)))
        n, begin = sizes[w], (np.cumsum(sizes) - sizes)[w]
        return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def trim(self, most: int) -> None:
        """Keep the words used most, half of `most`, and halve what their uses count."""
        if len(self.sizes) <= most:
            return
        words, at = list(self), np.fromiter(self.values(), np.int64, len(self))
        kept = np.sort(np.argsort(-self.uses[at], kind="stable")[: most // 2])
        words, at = [words[i] for i in kept.tolist()], at[kept]
        uses = self.uses[at]
        flat, n = self.tokens(at)
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self.flat, self.sizes, self.uses = array("i", flat.tolist()), array("i", n.tolist()), uses // 2


class Tokenizer:
    """A byte-level BPE of a tokenizers file: one without normaliser, or one that composes, folds cases, drops white space and marks word ends."""

    def __init__(self, path: str, specials: bool = True) -> None:
        """specials: whether the strings of special tokens in a text are these tokens, else plain text."""
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, norm, pre = held["model"], held["normalizer"], held["pre_tokenizer"]
        kinds = [x["type"] for x in (norm or {"normalizers": []})["normalizers"]]
        self.folds = kinds == ["NFC", "Replace", "Lowercase"]
        splits = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        self.ends = model.get("end_of_word_suffix") or ""
        odd = model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or splits[-1]["type"] != "ByteLevel" or splits[-1]["add_prefix_space"]
        if odd or kinds and not self.folds or self.folds != (splits[0]["type"] == "Split") or self.folds and (splits[0]["behavior"] != "Removed" or not splits[0]["invert"]):
            raise ValueError("another kind of tokenizer than those that this encoder knows")
        self.path, self.model = path, model
        # the pattern of byte-level splitting is fixed in the format
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"] if self.folds else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.units = regex.compile(r"\s*\S+|\s+")
        letters = byte_letters()
        self.back = {ord(v): k for k, v in letters.items()}
        special = {x["content"]: x["id"] for x in held["added_tokens"] if specials}
        self.special, self.finds = special, re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in held["added_tokens"]}
        self.names = [names.get(i, "").encode() for i in range(max(names, default=-1) + 1)]
        self.raw = [names.get(i, "").translate(self.back).encode("latin-1", "ignore") for i in range(len(self.names))] if not self.ends else None
        self.forget()

    @cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    @cached_property
    def core(self) -> Backtracker:
        spelled = lambda t: t[: -len(self.ends)].translate(self.back) + END if self.ends and t.endswith(self.ends) else t.translate(self.back)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in self.model["merges"]]
        return Backtracker({spelled(t): i for t, i in self.model["vocab"].items()}, [(spelled(a), spelled(b)) for a, b in pairs])

    def forget(self) -> None:
        self.words = _Numbers(self.encode_unit)

    def encode_unit(self, unit: str) -> list[int]:
        """Tokens of a word with the white space before it, or of a special token."""
        if unit in self.special:
            return [self.special[unit]]
        out: list[int] = []
        for word in self.pattern.findall(unit):
            out += self.core.encode(word.encode().decode("latin-1") + (END if self.ends else ""))
        return out

    def split(self, text: str) -> list[str]:
        """Units that encode on their own. No pattern takes white space behind other characters."""
        if self.folds:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sigma at the end of a word is one like others
            text = text.lower()
            return self.units.findall(text) if SEPARATORS.search(text) else text.split()
        if " " not in text or text.isspace():
            return [text] if text else []
        words = text.split(" ")
        if "" in words[1:] or regex.search(r"[^\S ]", text):
            return self.units.findall(text)
        return [" " + w for w in words[1:]] if not words[0] else [words[0], *[" " + w for w in words[1:]]]

    def by_library(self, text: str) -> list[int]:
        """The same encoding, of a text with characters that versions of Unicode differ on: the library normalises and splits it."""
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        end = END if self.ends else ""
        return [i for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text) for i in self.core.encode(word.translate(self.back) + end)]

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of a text's units among the words that are known."""
        rows, at = [], 0
        for m in [*(self.finds.finditer(text) if self.finds else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part and UNSETTLED.search(part):
                rows.append(np.array([self.words.add(self.by_library(part))]))
            elif part:
                units = self.split(part)
                rows.append(np.fromiter(map(self.words.__getitem__, units), np.int64, len(units)))
            if m:
                rows.append(np.array([self.words[m.group()]]))
                at = m.end()
        return np.concatenate(rows) if len(rows) != 1 else rows[0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts in a row, and how many each has."""
        self.words.trim(REMEMBERED)
        rows = [self.numbers(t) if t else np.zeros(0, np.int64) for t in texts]
        ids, n = self.words.tokens(np.concatenate([np.zeros(0, np.int64), *rows]))
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(ends[np.cumsum([0, *map(len, rows)])])

    @property
    def table(self) -> Offsets:
        """Names of tokens with a blank behind each, by which ids are decoded."""
        if not hasattr(self, "_table"):
            self._table = Offsets([t + b" " for t in self.names])
        return self._table

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The texts of rows of ids as the library gives them for a tokenizer that has no decoder: names with blanks between them."""
        return [t[:-1] for t in self.table.texts(ids, n)]


class Offsets:
    """Byte strings in one buffer, with the offsets where they begin."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        many = self.size[ids]
        return self.pool[np.repeat(self.start[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes()

    def texts(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The joined strings of each row of ids; n: how many ids a row has."""
        data = b"".join(self.joined(ids[i : i + TOKENS]) for i in range(0, len(ids), TOKENS))
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))[np.concatenate(([0], np.cumsum(n)))].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@cache
def tokenizer(path: str, specials: bool = True) -> Tokenizer:
    """This process's tokenizer of the file."""
    return Tokenizer(path, specials)


def encode(docs: DataFrame, path: str, carry: list[Column], text: str = "text", specials: bool = True, with_decoded: bool = False) -> DataFrame:
    """The carried columns and ids (array<int>); with_decoded also the text that these ids decode to, from the same Python worker.

    path: the tokenizer's file, at the same place on every executor. A null or empty text has no ids.
    """
    kept = docs.select(*carry).schema
    names = [f.name for f in kept]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, specials)
        texts = as_bytes(batch.column(0))
        for a, b in parts(texts, AT_ONCE):
            ids, n = t.encode([x.decode() if x else None for x in texts[a:b]])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
            more = [pa.array(t.decode(ids, n), pa.binary()).cast(pa.string())] if with_decoded else []
            yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[1:]], lists, *more], names=[*names, "ids", *["decoded"] * with_decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_columns(docs, [F.col(text), *carry], f"{schema}, ids array<int>" + ", decoded string" * with_decoded, step)


def decode(encoded: DataFrame, path: str, carry: list[Column], ids: str = "ids") -> DataFrame:
    """The carried columns and decoded (string); null ids give null."""
    kept = encoded.select(*carry).schema
    names = [f.name for f in kept]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(0)
        n = np.array([len(x) if x is not None else 0 for x in lists], np.int64)
        made = tokenizer(path).decode(lists.flatten().to_numpy(zero_copy_only=False), n)
        texts = [m if ok else None for m, ok in zip(made, lists.is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_columns(encoded, [F.col(ids), *carry], f"{schema}, decoded string", step)


def encode_and_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and decoded of each row, as the tokenizers library gives them without adding special tokens.

    A null or empty text has no ids and decodes to the empty text. Rows may repeat; other columns are neither read nor
    returned. An empty table gives no rows.
    """
    return encode(docs, path, [F.col(doc_id).alias("doc_id")], text, with_decoded=True)


def ids_sha256(ids: pa.Array) -> list[str]:
    """Lowercase hex of the SHA-256 of each list of ids as little-endian 32-bit integers."""
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
    data, ends = memoryview(flat).cast("B"), 4 * (ends - ends[0])
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def digests(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, ids, decoded): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    kind = rows.select("doc_id").schema[0].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(1)
        texts = as_bytes(batch.column(2))
        columns = [batch.column(0), pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), pa.array(ids_sha256(ids)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_columns(rows, [F.col("doc_id"), F.col("ids"), F.col("decoded")], f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", step)
