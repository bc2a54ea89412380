"""The driver's queries for the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, crosstok, langid, minhash, mixing, packed, rlz, search, secrets, toxicity, whitening
from .common import read_table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return rlz.remove_duplicates(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").alias("n_factors"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, folds=3, held_out=1).select("doc_id", "held_out", "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.round_trip(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), vocabulary=50_257, end_id=0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), keep=["doc_id", "source", "text"])


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(least(9223372036854775807::HUGEINT, greatest(-9223372036854775808::HUGEINT,
    list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, read_table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op11_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(read_table(spark, sf_dir, "documents"), folds=5, held_out=1)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language": op2_language,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_minhash": op5_minhash,
    "op6_packed_ids": op6_packed_ids,
    "op7_mixing": op7_mixing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_cross_polytope": op9_cross_polytope,
    "op10_toxicity": op10_toxicity,
    "op11_brown": op11_brown,
    "op12_whitening": op12_whitening,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

SQL: dict[str, str] = {"op7_mixing": mixing.mix_sql(), "op8_exact_top_k": OP8_SQL}
