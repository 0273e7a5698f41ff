"""Rows dealt by document, and whole documents in Arrow batches of rows that are sorted by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of files that the rows of one partition come from, about, so that a task's share doesn't grow with the input.
SHARE = 8 << 20
#: Shares up to which partitions follow from the keys and are put together by their size, as many small tasks would take longer.
FEW = 32


def shares(*tables: DataFrame) -> int | None:
    """Partitions for rows of some tables that go by document: one for each SHARE of the files that they come from; none for few shares.

    A file counts once, however often it is read, so that all rows of one input get one number. It is no less than the session's,
    as a join wouldn't take the rows as they are dealt then.
    """
    sizes = {}
    for rows in tables:
        leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes |= {leaf.semanticHash(): leaf.stats().sizeInBytes() for leaf in map(leaves.apply, range(leaves.size()))}
    size = sum(sizes.values())
    if not FEW * SHARE < size < 1 << 50:  # what has no size on disk is taken for huge
        return None
    return min(max(size // SHARE, int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many partitions as their files ask for, so that a task's share doesn't grow with the input.

    The number is given outright. Partitions that follow from keys alone are put together again where their rows are few bytes in a
    shuffle, and these bytes are many times as many in the sorts and windows that follow.
    """
    n = shares(rows)
    return rows.repartition(*keys) if n is None else rows.repartition(n, *keys)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join of two tables by the document and more, both dealt as ``dealt`` does; a plain join where files are small."""
    n = shares(left, right)
    return left.join(right, keys, how) if n is None else left.repartition(n, *keys).join(right.repartition(n, *keys), keys, how)


def sorted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join of tables that grow with the input, by a shuffle and a sort at every size.

    Spark judges a table by its packed bytes, and mentions pack to a tenth: what it takes for small enough to be sent to all would
    fill the driver first.
    """
    return left.join(right.hint("merge"), keys, how)


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys ahead of a window or an aggregate, where files are large; else as they are."""
    n = shares(rows)
    return rows if n is None else rows.repartition(n, *keys)


def whole_documents(batches: Iterator[pa.RecordBatch], key: str = "doc_id") -> Iterator[pa.Table]:
    """Tables of one document or several, none of them cut; a batch's last document waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if waiting and cut == 0 and waiting[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if cut:
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield pa.Table.from_batches(waiting)
