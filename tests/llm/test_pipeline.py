from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from emberline.llm import mixing, quality, queries
from test_similar import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    texts, y = quality.sample(docs, queries.table(spark, SF, "labels"), queries.learnable)
    net, least = quality.train(texts, y), quality.least_score(texts, y)
    rows = {r["doc_id"]: r for r in docs.collect()}
    scored = dict(zip(rows, quality.scores([r["text"].encode() for r in rows.values()], net, net.pairs()), strict=True))
    good = {i: r for i, r in rows.items() if scored[i] >= least}
    groups: dict[str, list[int]] = {}
    for i, r in good.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(i)
    single = sorted(min(g, key=lambda i: (-len(good[i]["text"]), i)) for g in groups.values())
    apart = sorted(kept_by_brute_force({i: good[i]["text"] for i in single}))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs.where(F.col("doc_id").isin(apart))).collect() if r["size"]}
    want = Counter({i: n for i, n in taken.items() if n})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == want
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    for r in got:
        text = rows[r["doc_id"]]["text"]
        assert r["n_ids"] == len(library.encode(text)) and r["round_trip"]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_no_query_lacks_a_test_of_its_rows(spark):
    for name, run in queries.QUERIES.items():
        assert run(spark, SF).count() > 0, name
