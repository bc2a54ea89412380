"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output divided by its share of the input.
A document's count is the Poisson quantile of a uniform number that a hash of (seed, doc_id)
gives, so the same seed gives the same corpus at any parallelism; a rate above ``STEP`` is dealt
evenly to several such counts, which are added up. Copies are then ordered by a hash of (seed,
doc_id, copy), which shuffles the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough

BROADCAST_SOURCES = 10_000  # more sources than that are joined by a shuffle, salted
SALT = 64
STEP = 8.0  # the largest rate of one Poisson count; a larger rate is the sum of several
TAIL = 1e-15  # counts are tabulated until less than this probability is left


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_table(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... until the tail is negligible."""
    terms, p, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += p
        terms.append(total)
        if 1 - total < TAIL or k > rate and p < TAIL:
            return terms
        k += 1
        p *= rate / k


def poisson_count(u: Column, rate: Column, most: int) -> Column:
    """The Poisson quantile of ``u``: how many cumulative probabilities are at most ``u``.

    The running sum stops at ``most`` terms, far in the tail for every rate in use."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("total"), F.lit(0).alias("k"))
    step = lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"),
        (s["total"] + s["p"] * rate / k).alias("total"),
        (s["k"] + F.when(s["total"] <= u, 1).otherwise(0)).alias("k"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["k"])


def copies_of(seed: int, doc_id: Column, rate: Column) -> Column:
    """The Poisson count of a document, whatever its rate: that of hash (seed, doc_id) up to
    ``STEP``, else the sum of ceil(rate / STEP) counts of hashes (seed, doc_id, 0), (seed, doc_id, 1), ..."""
    most = len(poisson_table(STEP))
    parts = F.ceil(rate / STEP).cast("int")
    add = lambda s, j: s + poisson_count(uniform(seed, doc_id, j), rate / parts, most)
    several = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), add)
    return F.when(rate <= STEP, poisson_count(uniform(seed, doc_id), rate, most)).otherwise(several)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temperature: float = 0.5) -> DataFrame:
    """source, n, rate: one row a source (a null source is a source of its own).

    Without ``weights``, a source's target weight is its document count to the power
    ``temperature``, so that large sources are thinned and small ones repeated. ``total`` is the
    target size of the output (default: that of the input). No rate is capped.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        counts = counts.withColumn("weight", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0))
    sums = counts.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    weight_sum, size = sums["w"] or 0.0, float(total if total is not None else sums["n"] or 0)
    share = F.col("weight") / F.lit(weight_sum) if weight_sum else F.lit(0.0)
    rate = share * F.lit(size) / F.col("n")
    return counts.select("source", "n", rate.cast("double").alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17, temperature: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Replicate documents so that sources meet their target weights, shuffled globally.

    Returns the columns of ``docs`` (or ``keep``) with ``copy`` (from 1) and ``shuffle_key``; the
    partitions hold ascending ranges of ``shuffle_key`` and are sorted by it. A rate of 0 or no
    documents give no rows; repeated rows with one doc_id get the same count; null texts, ids and
    sources are kept like others. Columns named copy or shuffle_key are replaced.
    """
    rates = source_rates(docs, weights, total, temperature)
    columns = [c for c in (keep or docs.columns) if c not in ("copy", "shuffle_key")]
    if small_enough(rates, BROADCAST_SOURCES):
        # one row a source, and the number of sources has just been checked
        joined = docs.alias("d").join(F.broadcast(rates.select(F.col("source").alias("__fg_s"), F.col("rate").alias("__fg_rate"))), F.col("d.source").eqNullSafe(F.col("__fg_s")))
    else:
        salted = rates.select(F.col("source").alias("__fg_s"), F.col("rate").alias("__fg_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__fg_salt"))
        here = docs.withColumn("__fg_part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).alias("d")
        joined = here.join(salted, F.col("d.source").eqNullSafe(F.col("__fg_s")) & (F.col("__fg_part") == F.col("__fg_salt")))
    counted = joined.withColumn("__fg_count", copies_of(seed, F.col("doc_id"), F.col("__fg_rate"))).where(F.col("__fg_count") > 0)
    copies = counted.select(*[F.col(f"d.{c}") for c in columns], F.explode(F.sequence(F.lit(1), F.col("__fg_count"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    shuffled = copies.withColumn("shuffle_key", key)
    # md5 is uniform: its first 28 bits deal out even ranges, without a sample of what is dealt
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 7), 16, 10).cast("long") * parts / float(1 << 28)).cast("int")
    return shuffled.repartitionById(parts, part).sortWithinPartitions("shuffle_key")


def mix_sql(seed: int = 17, temperature: float = 0.5) -> str:
    """The same, in DuckDB SQL over ``documents``."""
    most = len(poisson_table(STEP))
    u = f"('0x' || md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || %s)[1:12])::BIGINT::DOUBLE / {float(1 << 48)}"
    return f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (
  SELECT source, power(n::DOUBLE, {float(temperature)}) / (SELECT sum(power(n::DOUBLE, {float(temperature)})) FROM c) * (SELECT sum(n)::DOUBLE FROM c) / n AS rate
  FROM c),
r AS (SELECT source, CAST(ceil(rate / {STEP}) AS INTEGER) AS parts, rate / ceil(rate / {STEP}) AS rate FROM w),
p AS (
  SELECT source, parts, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM r
  UNION ALL
  SELECT source, parts, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM p WHERE k + 1 < {most}),
t AS (SELECT source, any_value(parts) AS parts, list(total ORDER BY k) AS totals FROM p GROUP BY source),
d AS (
  SELECT d.doc_id, d.source, d.text, CASE WHEN t.parts = 1 THEN len(list_filter(t.totals, lambda x: x <= {u % "''"}))
    ELSE list_sum(list_transform(range(t.parts), lambda j: len(list_filter(t.totals, lambda x: x <= {u % "':' || j"})))) END AS n
  FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, source, text, unnest(generate_series(1, CAST(n AS BIGINT))) AS copy FROM d)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key FROM e
"""
