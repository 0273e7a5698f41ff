"""Precision, recall and F1 of predictions against gold: pooled, by segment and by category.

Predictions and gold are tables with the same key columns; a row is one item. Keys are compared with nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    """The harmonic mean, 0 where both are."""
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def outcome(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct item with ``outcome``: TP, FP or FN. One shuffle and no join."""
    sides = predicted.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("g")))
    seen = sides.groupBy(*keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return seen.select(*keys, F.when(F.col("p") + F.col("g") == 2, "TP").when(F.col("p") == 1, "FP").otherwise("FN").alias("outcome"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "FN")]


def micro(outcomes: DataFrame, *by: str) -> DataFrame:
    """Scores of all items together, or of each group."""
    counted = (outcomes.groupBy(*by) if by else outcomes).agg(*_counts())
    return counted.select(*by, "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(outcomes: DataFrame, segments: DataFrame, segment: str = "doc_id") -> DataFrame:
    """The mean of the segments' scores; a segment without any item counts 0."""
    each = segments.select(segment).join(micro(outcomes, segment), segment, "left").fillna(0.0, ["precision", "recall", "f1"])
    return each.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def categorized(outcomes: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(category, value, ...) micro scores for each value of each category column, and over all, in one pass.

    ``categories`` maps a name to a column. Every item is expanded once into its categories, like grouping sets.
    """
    sets = [F.struct(F.lit("all").alias("category"), F.lit(None).cast("string").alias("value"))]
    sets += [F.struct(F.lit(name).alias("category"), F.col(column).cast("string").alias("value")) for name, column in categories.items()]
    rows = outcomes.select("outcome", F.explode(F.array(*sets)).alias("c")).select("outcome", "c.category", "c.value")
    return micro(rows, "category", "value")


def binary(df: DataFrame, predicted: str, gold: str, *by: str) -> DataFrame:
    """Scores and accuracy of two boolean columns, over all rows or by group."""
    p, g = F.col(predicted), F.col(gold)
    marked = df.withColumn("outcome", F.when(p & g, "TP").when(p, "FP").when(g, "FN").otherwise("TN"))
    counted = (marked.groupBy(*by) if by else marked).agg(*_counts(), F.count_if(F.col("outcome") == "TN").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(*by, *_scores(tp, fp, fn), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def binary_macro(df: DataFrame, predicted: str, gold: str, segment: str) -> DataFrame:
    return binary(df, predicted, gold, segment).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def mean_scores(runs: DataFrame) -> DataFrame:
    """(path, value): the mean of each score over runs of nested scores flattened to (run, path, value)."""
    return runs.groupBy("path").agg(F.avg("value").alias("value"))


def best_run(runs: DataFrame) -> DataFrame:
    """The run of the highest score, the first among equals; ``runs`` are (run, score)."""
    return runs.orderBy(F.desc("score"), "run").limit(1)


def b_cubed(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """B-cubed scores of chains (doc_id, ent_id, chain_id), by the published definition: the mean over mentions of
    the share of a mention's chain that is right, and of its gold chain that is found."""
    p = predicted.select("doc_id", "ent_id", F.col("chain_id").alias("p"))
    g = gold.select("doc_id", "ent_id", F.col("chain_id").alias("g"))
    both = p.join(g, ["doc_id", "ent_id"]).groupBy("doc_id", "p", "g").agg(F.count("*").alias("n"))
    ps, gs = p.groupBy("doc_id", "p").agg(F.count("*").alias("np")), g.groupBy("doc_id", "g").agg(F.count("*").alias("ng"))
    total = both.join(ps, ["doc_id", "p"]).join(gs, ["doc_id", "g"]).agg(F.sum(F.col("n") ** 2 / F.col("np")).alias("a"), F.sum(F.col("n") ** 2 / F.col("ng")).alias("b"))
    sizes = ps.agg(F.sum("np").alias("np")).join(gs.agg(F.sum("ng").alias("ng")))
    scores = total.join(sizes).select(_ratio(F.col("a"), F.col("np")).alias("precision"), _ratio(F.col("b"), F.col("ng")).alias("recall"))
    return scores.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def muc(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """MUC scores of chains (doc_id, ent_id, chain_id), by the published definition: the share of a chain's links that
    remain when the other side cuts it up. A mention that the other side lacks is a part of its own."""
    p = predicted.select("doc_id", "ent_id", F.col("chain_id").alias("p"))
    g = gold.select("doc_id", "ent_id", F.col("chain_id").alias("g"))

    def links(own: DataFrame, other: DataFrame, chain: str, cut: str) -> DataFrame:
        joined = own.join(other, ["doc_id", "ent_id"], "left")
        parts = joined.groupBy("doc_id", chain).agg(F.count("*").alias("size"), (F.count_distinct(cut) + F.count_if(F.col(cut).isNull())).alias("parts"))
        return parts.agg(F.sum(F.col("size") - F.col("parts")).alias("kept"), F.sum(F.col("size") - 1).alias("all"))

    right = links(p, g, "p", "g").select(_ratio(F.col("kept"), F.col("all")).alias("precision"))
    found = links(g, p, "g", "p").select(_ratio(F.col("kept"), F.col("all")).alias("recall"))
    return right.join(found).withColumn("f1", f1(F.col("precision"), F.col("recall")))
