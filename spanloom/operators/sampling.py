"""Folds, samples, batches and padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import product

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.store import materialise


def folds(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Add ``fold`` (0 to k-1): contiguous blocks in order, the first ones larger by one where k doesn't divide.

    Places come from counts of sorted partitions, so that no task holds all rows.
    """
    return with_place(df, order).withColumn("fold", _block(F.col("place"), F.col("rows"), k)).drop("place", "rows")


def _block(place: Column, rows: Column, k: int) -> Column:
    size, rest = F.floor(rows / k), rows % k
    long = rest * (size + 1)
    return F.when(place < long, F.floor(place / (size + 1))).otherwise(rest + F.floor((place - long) / F.greatest(size, F.lit(1)))).cast("int")


def with_place(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (0, 1, ...) in order and ``rows``, by a range partitioning and a prefix sum over partitions.

    The partitions are written as a table, since places within them and their sizes must come from the same ones.
    """
    columns = df.columns
    dealt = materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # one row a partition
    before, total = {}, 0
    for part, n in sizes:
        before[part], total = total, total + n
    if not before:
        return dealt.withColumns({"place": F.lit(0).cast("long"), "rows": F.lit(0).cast("long")}).select(*columns, "place", "rows")
    bases = F.broadcast(df.sparkSession.createDataFrame(sorted(before.items()), "part int, base long"))  # two numbers for each partition
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.join(bases, "part").withColumns({"place": place.cast("long"), "rows": F.lit(total).cast("long")}).select(*columns, "place", "rows")


def place_within(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``place`` (0, 1, ...) in order within each group, however many rows a group has."""
    placed = with_place(df, [group, *order]).drop("rows")
    begins = placed.groupBy(F.col(group).alias("_group")).agg(F.min("place").alias("_begin"))
    joined = placed.join(begins, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("place") - F.col("_begin")).drop("_group", "_begin")


def top(df: DataFrame, score: str, order: str, k: int = 5) -> DataFrame:
    """The k rows of highest score; ties stay in order."""
    return df.orderBy(F.desc(score), order).limit(k)


def page(df: DataFrame, newest: str, number: int, size: int = 10) -> DataFrame:
    """A page of rows, newest first, numbered from 1."""
    return df.orderBy(F.desc(newest)).offset((number - 1) * size).limit(size)


def drop_negatives(df: DataFrame, label: str, probability: float, key: list[str], seed: int = 0) -> DataFrame:
    """Leave out unlabelled rows with a probability, decided by a hash of their key."""
    chance = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(F.col(label).isNotNull() | (chance >= probability))


def grid(choices: dict) -> list[dict]:
    """All combinations of nested dictionaries whose leaves are lists, keys and values in order."""
    flat: dict[tuple, list] = {}

    def walk(at: tuple, node: dict) -> None:
        for k in sorted(node):
            if isinstance(node[k], dict):
                walk((*at, k), node[k])
            else:
                flat[(*at, k)] = sorted(node[k])

    walk((), choices)
    out = []
    for values in product(*flat.values()):
        made: dict = {}
        for path, value in zip(flat, values, strict=True):
            node = made
            for k in path[:-1]:
                node = node.setdefault(k, {})
            node[path[-1]] = value
        out.append(made)
    return out


def batches(samples: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Add ``batch`` (0, 1, ...) of ``size`` rows each, the last one shorter."""
    return with_place(samples, order).withColumn("batch", F.floor(F.col("place") / size)).drop("place", "rows")


def bucketed_batches(samples: DataFrame, size: int, length: str, bucket_length: int, order: list[str]) -> DataFrame:
    """Add ``bucket`` (by length) and ``batch`` within it, so that a batch pads little."""
    bucketed = samples.withColumn("bucket", F.floor(F.col(length) / bucket_length))
    return place_within(bucketed, "bucket", order).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def segment_batches(samples: DataFrame, size: int, segment: str, order: list[str]) -> DataFrame:
    """Add ``batch`` within each segment."""
    return place_within(samples, segment, order).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def pad(values: Column, length: Column, value: Column) -> Column:
    """An array filled up at its end."""
    return F.concat(values, F.array_repeat(value, F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def padded(samples: DataFrame, group: list[str], column: str, value: Column) -> DataFrame:
    """Pad an array column to the longest of its group."""
    longest = F.max(F.size(column)).over(Window.partitionBy(*group))
    return samples.withColumn(column, pad(F.col(column), longest, value))


def padded_2d(samples: DataFrame, group: list[str], column: str, value: Column) -> DataFrame:
    """Pad an array of arrays to the group's longest in both ranks."""
    w = Window.partitionBy(*group)
    inner = F.max(F.array_max(F.transform(column, F.size))).over(w)
    outer = F.max(F.size(column)).over(w)
    sized = samples.withColumn("_inner", inner).withColumn("_outer", outer)
    rows = F.transform(column, lambda x: pad(x, F.col("_inner"), value))
    return sized.withColumn(column, pad(rows, F.col("_outer"), F.array_repeat(value, F.col("_inner")))).drop("_inner", "_outer")


def padded_nd(samples: DataFrame, group: list[str], column: str, value: Column, rank: int) -> DataFrame:
    """Pad an array nested ``rank`` deep to the group's longest in every rank, from the outermost inwards."""
    w = Window.partitionBy(*group)

    def longest(values: Column, depth: int) -> Column:
        return F.size(values) if depth == 0 else F.coalesce(F.array_max(F.transform(values, lambda x: longest(x, depth - 1))), F.lit(0))

    sized = samples.withColumns({f"_size{k}": F.max(longest(F.col(column), k)).over(w) for k in range(rank)})

    def empty(k: int) -> Column:
        return value if k == rank else F.array_repeat(empty(k + 1), F.col(f"_size{k}"))

    def filled(values: Column, k: int) -> Column:
        inner = values if k == rank - 1 else F.transform(values, lambda x: filled(x, k + 1))
        return pad(inner, F.col(f"_size{k}"), empty(k + 1))

    return sized.withColumn(column, filled(F.col(column), 0)).drop(*(f"_size{k}" for k in range(rank)))


def cross_validated(samples: DataFrame, k: int, order: list[str], run: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(fold, ...): for each of ``k`` folds the rows that ``run`` gives for its training and its held-out samples."""
    dealt = folds(samples, k, order)
    parts = [run(dealt.where(F.col("fold") != i).drop("fold"), dealt.where(F.col("fold") == i).drop("fold")).select(F.lit(i).alias("fold"), "*") for i in range(k)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@contextmanager
def kept_on_disk(df: DataFrame) -> Iterator[DataFrame]:
    """A table that can be gone over many times without being made again; it is let go at the end of the block."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()


def stopped(improved: DataFrame, history: int, order: list[str] = ("epoch",)) -> DataFrame:
    """For epochs (epoch or other columns of order, improved) whether training has stopped: ``history`` epochs in a row without improvement.

    Each epoch's run without improvement is as long as it lies behind the last place that improved; both come from places
    in the whole order and from windows over its parts, so the number of epochs isn't bounded by a task.
    """
    placed = with_place(improved, list(order)).drop("rows").withColumn("_part", F.floor(F.col("place") / EPOCHS))
    seen = F.max(F.when(F.col("improved"), F.col("place")))
    parts = placed.groupBy("_part").agg(seen.alias("_last")).withColumn("_last", F.max("_last").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for many epochs
    inside = Window.partitionBy("_part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(seen.over(inside), F.col("_last"), F.lit(-1))
    runs = placed.join(parts, "_part").withColumn("_bad", F.col("place") - last >= history)
    first = runs.where("_bad").agg(F.min("place").alias("_first"))
    out = runs.crossJoin(F.broadcast(first))  # one row
    return out.withColumn("stopped", F.coalesce(F.col("place") >= F.col("_first"), F.lit(False))).drop("place", "_part", "_last", "_bad", "_first")


#: Epochs whose places are looked at by one task.
EPOCHS = 1 << 20
