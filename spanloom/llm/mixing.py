"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to this many are broadcast (some hundred bytes each); more are joined on a salted key.
BROADCAST_SOURCES = 10_000
#: Parts that each source is dealt into where the join is salted.
SALTS = 64
#: One draw inverts a Poisson of this mean at most; a greater mean is a sum of draws.
MEAN_OF_DRAW = 256.0


def uniform(*parts: Column | str) -> Column:
    """A double in (0, 1) from the md5 of the parts, of 52 bits, the same in any engine."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """The distribution function at 0, 1, ... as an array, so far that what remains is below the draw's grain."""
    last = F.ceil(mean + F.sqrt(mean) * 12 + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["sums"])


def source_rates(docs: DataFrame, source: str, weights: DataFrame | None, exponent: float, budget: float) -> DataFrame:
    """One row for each source: its rows, and how often each of its rows is to be repeated in the mean.

    Without ``weights`` (columns ``source`` and ``weight``) a source weighs the ``exponent``-th power of its
    row count. A source without a weight, or of a negative one, weighs nothing. The rates make the expected
    number of rows ``budget`` times that of the input.
    """
    sizes = docs.groupBy(F.col(source).alias("_mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = weights.groupBy(F.col("source").alias("given_source")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, F.col("_mix_source").eqNullSafe(F.col("given_source")), "left").drop("given_source")
    weighed = weighed.withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return weighed.select("_mix_source", F.lit(0.0).alias("_mix_rate"))
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(budget) * F.lit(total["n"]) / F.col("n")
    return weighed.select("_mix_source", rate.alias("_mix_rate"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, exponent: float = 0.5, budget: float = 1.0, seed: str = "mix", out: tuple[str, str] = ("copy", "shuffle_key")) -> DataFrame:
    """Repeat every row a Poisson number of times, so that sources reach their target weights, and shuffle all.

    The number is drawn by inverting the distribution at a uniform hashed from seed and key, so it is the same
    in every run; rows with equal keys get equal numbers, a null key counts as the text ``null``, and a null
    source is a source. The result has all columns of ``docs`` and those named by ``out``, the number of the copy
    (1, 2, ...) and a shuffle key, and lies in order of that key within tasks that are dealt by it. Columns that have
    these names already are replaced. Texts are never looked at, so any will do. An empty table gives an empty one. No source needs to fit a task: rates are joined by
    broadcast where sources are few, else on a salted key.
    """
    names = docs.columns
    kept = [c for c in names if c not in out]
    rates = source_rates(docs, source, weights, exponent, budget)
    draws = F.greatest(F.lit(1), F.ceil(F.col("_mix_rate") / MEAN_OF_DRAW)).cast("int")
    rates = rates.where(F.col("_mix_rate") > 0).withColumn("_mix_draws", draws)
    rates = rates.select("_mix_source", "_mix_draws", poisson_cdf(F.col("_mix_rate") / F.col("_mix_draws")).alias("_mix_cdf"))
    row_key = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    same = F.col(source).eqNullSafe(F.col("_mix_source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.select(*kept).join(F.broadcast(rates), same)
    else:
        dealt = docs.select(*kept, F.pmod(F.xxhash64(row_key), F.lit(SALTS)).cast("int").alias("_mix_salt"))
        salted = rates.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(salted, same & (dealt["_mix_salt"] == salted["_mix_salt"]))
    times = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_draws")),
        F.lit(0),
        lambda total, i: total + F.size(F.filter("_mix_cdf", lambda c: c < uniform(seed, row_key, i.cast("string")))),
    )
    copies = joined.withColumn("_mix_times", times).where(F.col("_mix_times") > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    shuffle_key = F.md5(F.concat_ws("|", F.lit(seed), row_key, F.col("_mix_copy").cast("string"), F.lit("place")).cast("binary"))
    return copies.select(*kept, F.col("_mix_copy").alias(out[0]), shuffle_key.alias(out[1])).repartition(F.col(f"`{out[1]}`")).sortWithinPartitions(F.col(f"`{out[1]}`"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix the sources of ``documents`` by the square root of their sizes; whole rows come out."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf
  WHERE k + 1 <= ceil(rate + sqrt(rate) * 12 + 24)),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('mix|' || d.doc_id || '|1'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents d),
counted AS (
  SELECT doc_id, count(*) AS times FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source AND cdf.total < u GROUP BY doc_id)
SELECT d.*, CAST(copy AS INTEGER) AS copy, md5('mix|' || d.doc_id || '|' || copy || '|place') AS shuffle_key
FROM documents d JOIN counted USING (doc_id), LATERAL (SELECT unnest(range(1, times + 1)) AS copy)
"""
