"""Near duplicates among vectors by a pivot-permutation index.

A vector is described by the pivots nearest to it, a prefix of its permutation of reference points. Vectors
that share at least three of their six nearest pivots are candidates; they meet in the inverted list of each
such triple of pivots, within their label. Candidates are verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.blocks import BLOCKS, deal, pairs_in_groups, tally, whole_groups
from spanloom.llm.components import components
from spanloom.llm.store import materialise

#: Reference points for up to PIVOT_ROWS vectors. They grow with the cube root of the vectors beyond, so that the lists,
#: of which there are as many as triples of pivots, stay as long as they are.
PIVOTS, PIVOT_ROWS = 64, 100_000
#: Nearest pivots that describe a vector, and how many of them a candidate must share.
PREFIX, SHARED = 6, 3
#: Vectors among which pivots are chosen, those of smallest hash: so many, or so many for each pivot if that is more.
PIVOT_SAMPLE, SAMPLE_EACH = 2048, 4
#: Bits of a pivot's number in a list's key.
BITS = 16
KEYS = ["label", "triple"]
TASK = [*KEYS, *BLOCKS]


def pivots_for(rows: int) -> int:
    """How many pivots an index of so many vectors has."""
    return min(int(PIVOTS * max(1.0, rows / PIVOT_ROWS) ** (1 / 3)), (1 << BITS) - 1)


def choose_pivots(sample: list[list[float]], dims: int, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors far from each other: each next one is the sample's vector farthest from those chosen."""
    rng = np.random.default_rng(dims)
    fill = rng.normal(size=(count, dims))
    found = np.array([v for v in sample if len(v) == dims] or fill, float)
    found = np.unique(found / np.linalg.norm(found, axis=1, keepdims=True), axis=0)
    chosen = [int(rng.integers(len(found)))]
    near = found @ found[chosen[0]]
    while len(chosen) < min(count, len(found)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, found @ found[chosen[-1]])
    pivots = np.concatenate([found[chosen], fill])[:count]
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True)


def prefixes(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, ascending."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.sort(np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :PREFIX], axis=1)


def usable(vector: str, label: str) -> str:
    """SQL that holds for rows that can be linked: a label, and a vector of finite components that isn't zero."""
    fine = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    return f"{label} IS NOT NULL AND {vector} IS NOT NULL AND {fine} AND exists({vector}, x -> x <> 0)"


def matrix(column: pa.ChunkedArray | pa.Array, rows: np.ndarray) -> np.ndarray:
    """The vectors of these rows, which are equally long, in double precision."""
    lists = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).take(pa.array(rows))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def index(rows: DataFrame, pivots: dict[int, np.ndarray], count: int) -> DataFrame:
    """(label, triple, node) for each triple of each vector's nearest pivots; a triple also holds the length."""
    triples = list(combinations(range(PREFIX), SHARED))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.array(batch.column(2).value_lengths())
            for dims in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dims)
                near = prefixes(matrix(batch.column(2), at), pivots[dims] if dims in pivots else choose_pivots([], dims, count))
                keys = np.stack([(near[:, t] << (BITS * np.arange(SHARED)[::-1])).sum(1) for t in triples], 1) | dims << BITS * SHARED
                of = np.repeat(at, len(triples))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(of)), pa.array(keys.ravel().astype(np.int64)), batch.column(0).take(pa.array(of))], ["label", "triple", "node"])

    return rows.mapInArrow(described, "label long, triple long, node long")


def join(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Two vectors of one (not null) label are linked if their cosine is at least ``least``. Vectors that are null
    or zero, or hold a null or a component that isn't finite, are linked to nothing, nor are vectors of
    different length. ``n_links`` counts other vectors linked directly; ``component_id`` is the smallest vec_id
    that links lead to. Rows that share a vec_id but not vector and label are vectors of their own; rows equal in all
    of these count as one and come out as often as they are; rows without a vec_id come out with nulls, and kept. An
    empty table gives an empty one. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("row", F.xxhash64("label", "vector"))
    good = rows.where("vec_id IS NOT NULL").where(usable("vector", "label"))
    repeats = good.groupBy("vec_id").count().where("count > 1").limit(1).count() > 0
    if repeats:
        once = good.groupBy("vec_id", "row").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
        good = materialise(once.withColumn("node", F.monotonically_increasing_id()), "vectors")
    else:
        good = good.withColumn("node", F.col("vec_id"))
    count = pivots_for(good.count())
    most = max(PIVOT_SAMPLE, SAMPLE_EACH * count)
    sample = [r[0] for r in good.select("vec_id", "row", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(most).select("vector").collect()]
    pivots = {dims: choose_pivots(sample, dims, count) for dims in {len(v) for v in sample}}
    members = deal(index(good.select("node", "label", "vector"), pivots, count), KEYS)
    members = members.join(good.select("node", "vector"), "node").select(*TASK, "block", "node", "vector")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, TASK):
            node, block, triple = (table[k].to_numpy() for k in ("node", "block", "triple"))
            across = table["lo"].to_numpy() != table["hi"].to_numpy()
            dims = triple >> BITS * SHARED
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = matrix(table["vector"], at)
                near = prefixes(x, pivots[d] if d in pivots else choose_pivots([], d, count))
                norm = np.linalg.norm(x, axis=1)
                own = np.stack([triple[at] >> BITS * k & (1 << BITS) - 1 for k in range(SHARED)[::-1]], 1)
                for i, j in pairs_in_groups(number[at]):
                    for k in range(0, len(i), 20_000):
                        a, b = i[k : k + 20_000], j[k : k + 20_000]
                        keep = (~across[at[a]] | (block[at[a]] != block[at[b]])) & (node[at[a]] != node[at[b]])
                        a, b = a[keep], b[keep]
                        # A pair belongs to the triple of the smallest pivots that it shares.
                        shared = (near[a][:, :, None] == near[b][:, None, :]).any(2)
                        nth = np.cumsum(shared, 1)
                        first = np.stack([near[a][np.arange(len(a)), (nth > t).argmax(1)] for t in range(SHARED)], 1)
                        mine = (first == own[a]).all(1)
                        a, b = a[mine], b[mine]
                        near_enough = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= least
                        left.append(at[a[near_enough]])
                        right.append(at[b[near_enough]])
            i, j = np.concatenate(left), np.concatenate(right)
            if i.size:
                yield tally(node, np.ones(len(node), np.int64), i, j)

    found = materialise(members.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(linked, "a long, b long, n long"), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    of_node = components(found.where("b IS NOT NULL").select("a", "b")).join(links, "node")
    if repeats:
        named = of_node.join(good.select("node", "vec_id", "row"), "node")
        heads = named.groupBy("component").agg(F.min("vec_id").alias("head"))
        of_row = named.join(heads, "component").select("vec_id", "row", F.col("head").alias("component"), "n_links")
        joined = rows.select("vec_id", "row").join(of_row, ["vec_id", "row"], "left")
    else:
        joined = rows.select("vec_id").join(of_node.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    own = F.col("vec_id")
    return joined.select(
        "vec_id",
        F.when(own.isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.coalesce("component", own).alias("component_id"),
        F.coalesce(F.coalesce("component", own) == own, F.lit(True)).alias("kept"),
    )


def op7_pivot_index(spark, sf_dir: str) -> DataFrame:
    """Contract query: links of cosine 0.98 or more within labels, over all of ``embeddings``."""
    return join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
