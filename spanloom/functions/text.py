"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as quotation marks, by code point.
QUOTE_CODE_POINTS = [
    0x0022, 0x0027, 0x00AB, 0x00BB, 0x2018, 0x2019, 0x201A, 0x201B, 0x201C, 0x201D, 0x201E, 0x201F, 0x2039, 0x203A, 0x300C,
    0x300D, 0x300E, 0x300F, 0x301D, 0x301E, 0x301F, 0xFE41, 0xFE42, 0xFE43, 0xFE44, 0xFF02, 0xFF07, 0xFF62, 0xFF63,
]
QUOTES = "".join(map(chr, QUOTE_CODE_POINTS))


def replace_quotes(token: Column) -> Column:
    """Every quotation mark becomes the plain double one."""
    return F.regexp_replace(token, f"[{QUOTES}]", '"')


def replace_digits(token: Column) -> Column:
    """Every run of ASCII digits becomes one 0."""
    return F.regexp_replace(token, "[0-9]+", "0")


def normalize(token: Column, lower: bool = False, digits: bool = False, quotes: bool = False) -> Column:
    """The chosen steps in fixed order: quotes, then digits, then lower case."""
    token = replace_quotes(token) if quotes else token
    token = replace_digits(token) if digits else token
    return F.lower(token) if lower else token


def bit_log(x: Column) -> Column:
    """The number of bits of the magnitude, with the sign: 0, 1, 2, 2, 3, ... for 0, 1, 2, 3, 4, ..."""
    return F.when(x == 0, 0).otherwise(F.signum(x).cast("int") * F.length(F.bin(F.abs(x).cast("long"))))


def clip_signed(x: Column, left: int, right: int) -> Column:
    """Values beyond a border become the one just outside it."""
    return F.least(F.greatest(x, F.lit(left - 1)), F.lit(right + 1))


def clip_unsigned(x: Column, right: int) -> Column:
    """As ``clip_signed`` above; a value below zero is an error."""
    return F.when(F.assert_true(x >= 0, F.lit("a value below zero has no code")).isNull(), F.least(x, F.lit(right + 1)))


def log_distance(x: Column) -> Column:
    """The category of a distance: the rounded binary logarithm of one more."""
    return F.round(F.log2(x + 1)).cast("int")


def edits_within(a: Column, b: Column, most: int = 1) -> Column:
    """Whether at most ``most`` edits lie between two strings."""
    return F.levenshtein(a, b, most) >= 0


def any_of(*tests: Column) -> Column:
    return reduce(lambda x, y: x | y, tests)


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether ``a``'s elements occur in ``b`` in this order."""
    return F.aggregate(b, F.lit(0), lambda i, x: F.when((i < F.size(a)) & (F.get(a, i) == x), i + 1).otherwise(i)) == F.size(a)


def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def string_match(a: Column, b: Column, heads: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """The family of matches between two mentions' words: exact and partial, as sets and in order; with the lemmas of their
    heads, whether these are equal."""
    return ({"head_match": heads[0].eqNullSafe(heads[1])} if heads else {}) | {
        "exact_match": as_set(a) == as_set(b),
        "partial_match": F.arrays_overlap(a, b),
        "ordered_exact_match": a == b,
        "ordered_partial_match": is_subsequence(a, b) | is_subsequence(b, a),
    }


def agreement(a: Column, b: Column) -> Column:
    """Whether two grammemes agree; unknown if either is null."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "agreement").otherwise("disagreement")


def pad_characters(token: Column, size: int, pad: str = "$PADDING$") -> Column:
    """The characters with ``size`` paddings on both sides."""
    edge = F.array_repeat(F.lit(pad), size)
    return F.concat(edge, F.filter(F.split(token, ""), lambda c: c != ""), edge)


def greedy_match(a: Column, b: Column, same) -> Column:
    """Whether each element of the shorter array matches another one of the longer, taken in order.

    An element takes the first free one that ``same`` accepts, and nothing is taken back. Of equally long
    arrays the second counts as the shorter.
    """
    long, short = F.when(F.size(b) > F.size(a), b).otherwise(a), F.when(F.size(b) > F.size(a), a).otherwise(b)
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(long) - 1), lambda i: ~F.array_contains(state["taken"], i) & same(F.get(long, i), x))
        got = F.get(free, F.lit(0))
        return F.struct((state["ok"] & got.isNotNull()).alias("ok"), F.when(got.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(got))).alias("taken"))

    return F.aggregate(short, start, step, lambda s: s["ok"])
