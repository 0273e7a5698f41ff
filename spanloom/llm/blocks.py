"""Pairs within buckets of any size: buckets are dealt into blocks, and each task compares two blocks.

Pairs are made in numpy and come out as counts of links and a spanning forest, never as a row each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block in the mean. A task sees two.
BLOCK = 256
BLOCKS = ["lo", "hi"]
#: Bytes of text that are handed on at once, but for a single group that is larger.
TEXT_BYTES = 8_000_000


def deal(members: DataFrame, keys: list[str], size: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """From members (``keys`` of a bucket, ``node``) those of tasks: keys, lo, hi, the node's own block, node.

    A bucket with one member makes no task. A bucket is dealt into blocks by a hash of the node, and every two
    blocks, and each with itself, make a task, so that no task grows with a bucket.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / size).cast("int")
    found = members.join(sizes, keys).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return found.select(*keys, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", *carry)


def pairs_in_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of equal group, where equal ones stand together, by growing distance."""
    at, d = np.arange(len(group)), 1
    while True:
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not at.size:
            return
        yield at, at + d
        d += 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], sized: str | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, sorted rows of equal keys, with a number for each row's group.

    A batch's last group waits for the batches to come, which are put together once, when another group begins.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = _numbers(batch, keys)
        cut = int(np.searchsorted(number, number[-1]))
        goes_on = bool(waiting) and all(batch[k][0] == waiting[-1][k][-1] for k in keys)
        if waiting and (cut or not goes_on):
            table = pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks()
            yield from _bounded(table, _numbers(table, keys), sized)
            waiting = []
        elif cut:
            yield from _bounded(pa.Table.from_batches([batch.slice(0, cut)]), number[:cut], sized)
        rest = batch.slice(cut)
        waiting.append(rest.take(pa.array(np.arange(rest.num_rows))) if cut else rest)  # a copy, so that the batch can go
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield from _bounded(table, _numbers(table, keys), sized)


def _numbers(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table[k].to_numpy() if isinstance(table, pa.Table) else table[k].to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _bounded(table: pa.Table, number: np.ndarray, sized: str | None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    if sized is None:
        yield table, number
        return
    ends = np.cumsum(pc.binary_length(table[sized]).to_numpy().astype(np.int64))
    at = 0
    while at < len(number):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, side="right"))
        stop = len(number) if stop >= len(number) else int(np.searchsorted(number, number[stop]))  # a group's begin
        if stop <= at:
            stop = int(np.searchsorted(number, number[at], side="right"))
        yield table.slice(at, stop - at), number[at:stop]
        at = stop


class Forest:
    """Pairs that connect what others have not connected yet."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = self.parent[x]
        return x

    def apart(self, a: int, b: int) -> bool:
        return self.root(a) != self.root(b)

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.pairs.append((a, b))


def tally(node: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Of linked pairs of rows: each node's links (a, null, n), a partner counted with its copies, and a forest (a, b, 0)."""
    ends, partners = np.concatenate([node[i], node[j]]), np.concatenate([copies[j], copies[i]])
    nodes, at = np.unique(ends, return_inverse=True)
    links = np.bincount(at, partners).astype(np.int64)
    tree = Forest()
    for a, b in zip(node[i].tolist(), node[j].tolist(), strict=True):
        tree.link(a, b)
    first, second = np.array(tree.pairs, np.int64).reshape(-1, 2).T
    a, b = np.concatenate([nodes, first]), np.concatenate([nodes, second])
    n = np.concatenate([links, np.zeros(len(first), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(nodes)), pa.array(n)], ["a", "b", "n"])
