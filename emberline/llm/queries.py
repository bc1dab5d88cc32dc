"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import alignment, archives, audio, bpe, chats, exact_dedup, language, licenses, mixing, pieces, quality, repair, simhash
from emberline.llm.common import is_held_out

#: The model file of the queries' SentencePiece vocabulary.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The files of the queries' BPE vocabularies: with word ends, and byte-level.
WORD_BPE, BYTE_BPE = "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(doc_id: str):
    """Rows from which the classifiers may learn."""
    return ~is_held_out(doc_id)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), learnable, is_held_out())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids_hash, decoded_sha256, round_trip of each row, from real ids and their decoded text."""
    rows = pieces.encode_and_decode(docs, path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "round_trip")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.page_records(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable, is_held_out())


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chats.derived_calls(table(spark, sf_dir, "conversations"))
    return chats.link_calls(calls, results, chats.DERIVED)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_features(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), WORD_BPE))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.correspondence(table(spark, sf_dir, "documents"), BYTE_BPE, MODEL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_simhash, op3_mixing, op4_licenses, op5_sentencepiece, op6_warc, op7_quality, op8_chats, op9_exact_dedup, op10_media, op11_bpe, op12_repair, op13_alignment)}

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * g + 1}, 5))::int >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_licenses": licenses.oracle(),
    "op6_warc": f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as x from pages),
g as (select *, min(page_id) over (partition by html) as least from p)
select page_id, strlen(html)::bigint as payload_bytes, {_BASE32} as payload_digest,
       case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to
from g
""",
    "op8_chats": chats.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
