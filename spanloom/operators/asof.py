"""Look-ups by place: how many places of a document lie before another, in one shuffle and without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.grouped import dealt


def counts_before(requests: DataFrame, places: DataFrame, inclusive: bool = False, name: str = "n", weight: str | None = None) -> DataFrame:
    """(doc_id, pos, n) for each distinct request (doc_id, pos): places (doc_id, pos) before it, or with ``inclusive`` up to it.

    With ``weight``, a column of the places, its sum instead of their number.
    """
    return with_counts(requests.select("doc_id", "pos").distinct(), F.col("pos"), places, name, inclusive, weight)


def with_counts(rows: DataFrame, at: Column, places: DataFrame, name: str, inclusive: bool = False, weight: str | None = None) -> DataFrame:
    """Rows with ``name``: the number (or summed weight) of places (doc_id, pos) of their document before ``at``, or up to it.

    Rows and places stand in one order, in which a running sum passes over both, so neither is made twice or joined. The
    count is null where the document or ``at`` is.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    asked = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col("doc_id").alias("doc"), at.cast("long").alias("pos"), F.lit(0).alias("one"), F.lit(1 if inclusive else 0).alias("later"))
    known = places.select(F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.col("doc_id").alias("doc"), F.col("pos").cast("long").alias("pos"), one.alias("one"), F.lit(0 if inclusive else 1).alias("later"))
    order = Window.partitionBy("doc").orderBy("pos", "later").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    real = F.col("doc").isNotNull() & F.col("pos").isNotNull()
    # A place that is null is before no other one, but would come first in order.
    counted = dealt(known.where(real).unionByName(asked), "doc").withColumn(name, F.when(real, F.sum("one").over(order))).where("row IS NOT NULL")
    # The document is the column that rows were dealt by, so what follows by document finds them dealt.
    return counted.select(*(F.col("doc").alias(c) if c == "doc_id" else F.col(f"row.`{c}`") for c in rows.columns), name)
