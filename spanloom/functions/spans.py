"""Span algebra on half-open token ranges, as Column functions.

A span is a struct column with ``start_token`` and ``end_token``; mentions also have ``ent_id`` and ``type``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(start: Column | str, end: Column | str) -> Column:
    return F.struct(F.col(start).alias("start_token") if isinstance(start, str) else start.alias("start_token"), F.col(end).alias("end_token") if isinstance(end, str) else end.alias("end_token"))


def contains(a: Column, b: Column) -> Column:
    """Whether ``a`` covers ``b``; equal spans cover each other."""
    return (a["start_token"] <= b["start_token"]) & (a["end_token"] >= b["end_token"])


def token_distance(a: Column, b: Column) -> Column:
    """0 for spans that intersect, 1 for adjacent ones, one more for each token between."""
    gap = F.greatest(a["start_token"], b["start_token"]) - F.least(a["end_token"], b["end_token"])
    return F.greatest(F.lit(0), gap + 1)


def intersects(a: Column, b: Column) -> Column:
    return (a["start_token"] < b["end_token"]) & (b["start_token"] < a["end_token"])


def coincides(a: Column, b: Column) -> Column:
    return (a["start_token"] == b["start_token"]) & (a["end_token"] == b["end_token"])


def length(a: Column) -> Column:
    return a["end_token"] - a["start_token"]


def relocated(a: Column, start: Column, end: Column) -> Column:
    return a.withField("start_token", start).withField("end_token", end)


def with_type(a: Column, kind: Column | str) -> Column:
    return a.withField("type", F.lit(kind) if isinstance(kind, str) else kind)


def interrelation(a: Column, b: Column) -> Column:
    """CONTAINS, CONTAINED, INTERSECTS or SEPARATED, the first that holds; equal spans are CONTAINS."""
    return F.when(contains(a, b), "CONTAINS").when(contains(b, a), "CONTAINED").when(intersects(a, b), "INTERSECTS").otherwise("SEPARATED")


def direction(a: Column, b: Column) -> Column:
    """How two arguments lie: one in the other, or which comes first."""
    return F.when(contains(a, b), "e2_in_e1").when(contains(b, a), "e1_in_e2").when(a["start_token"] < b["start_token"], "e1_e2").otherwise("e2_e1")


def valid(a: Column) -> Column:
    """Spans must not be empty or begin below zero."""
    return (a["start_token"] >= 0) & (a["start_token"] < a["end_token"])


def same(a: Column, b: Column) -> Column:
    """Equality of all fields, nulls included."""
    return a.eqNullSafe(b)
