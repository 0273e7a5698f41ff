"""Looking rows up in a table with one row a key, where some keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than this share of the rows have it, so there are at most as many hot keys as its inverse.
HOT_KEYS = 1024


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key; ``counts`` (keys, n) says how many rows have a key.

    The table's rows of hot keys, never more than ``HOT_KEYS``, are broadcast, so that no key's rows meet in one task;
    the other keys are shuffled. Rows with a null key find nothing.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("n") * HOT_KEYS > F.col("total")).select(*keys)  # one row aside
    hot = hot.sparkSession.createDataFrame(hot.collect(), hot.schema)  # at most HOT_KEYS keys
    if hot.isEmpty():
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    spread = rows.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how)
    return spread.unionByName(rows.join(hot, keys, "left_anti").join(table, keys, how))
