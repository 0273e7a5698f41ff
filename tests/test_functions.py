"""Spans, text functions, codecs and trees on small vectors."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions import text as T
from spanloom.operators import labels as L
from spanloom.operators import trees as D


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def sp(a, b):
    return F.struct(F.lit(a).alias("start_token"), F.lit(b).alias("end_token"))


def test_span_algebra(spark):
    pairs = [((0, 3), (1, 2)), ((0, 3), (3, 4)), ((0, 3), (5, 6)), ((1, 4), (0, 2)), ((2, 3), (2, 3))]
    got = [one(spark, S.contains(sp(*a), sp(*b)), S.token_distance(sp(*a), sp(*b)), S.intersects(sp(*a), sp(*b)), S.interrelation(sp(*a), sp(*b)), S.direction(sp(*a), sp(*b))) for a, b in pairs]
    assert got == [(True, 0, True, "CONTAINS", "e2_in_e1"), (False, 1, False, "SEPARATED", "e1_e2"), (False, 3, False, "SEPARATED", "e1_e2"), (False, 0, True, "INTERSECTS", "e2_e1"), (True, 0, True, "CONTAINS", "e2_in_e1")]
    assert one(spark, S.valid(sp(0, 1)), S.valid(sp(2, 2)), S.valid(sp(-1, 2)), S.coincides(sp(1, 2), sp(1, 2)), S.length(sp(2, 5))) == (True, False, False, True, 3)


def test_numbers(spark):
    values = [-9, -4, -1, 0, 1, 2, 3, 4, 7, 8]
    assert one(spark, *(T.bit_log(F.lit(v)) for v in values)) == (-4, -3, -1, 0, 1, 2, 2, 3, 3, 4)
    assert one(spark, *(T.clip_signed(F.lit(v), -2, 3) for v in (-9, -3, 0, 4, 9))) == (-3, -3, 0, 4, 4)
    assert one(spark, T.clip_unsigned(F.lit(9), 3), T.log_distance(F.lit(0)), T.log_distance(F.lit(7))) == (4, 0, 3)
    with pytest.raises(Exception, match="below zero"):
        one(spark, T.clip_unsigned(F.lit(-1), 3))


def test_words(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, T.normalize(F.lit("«AB12»x3"), True, True, True)) == ('"ab0"x0',)
    assert one(spark, T.is_subsequence(a("x", "z"), a("x", "y", "z")), T.is_subsequence(a("z", "x"), a("x", "y", "z"))) == (True, False)
    equal = lambda x, y: x == y
    assert one(spark, T.greedy_match(a("a", "b"), a("b", "c", "a"), equal), T.greedy_match(a("a", "a"), a("a", "b"), equal), T.greedy_match(a("x"), a("a"), equal)) == (True, False, False)
    assert one(spark, T.edits_within(F.lit("abc"), F.lit("abd")), T.edits_within(F.lit("abc"), F.lit("xyd")), T.agreement(F.lit("m"), F.lit("f")), T.agreement(F.lit(None), F.lit("f"))) == (True, False, "disagreement", "unknown")
    assert one(spark, T.pad_characters(F.lit("ab"), 1, "_")) == (["_", "a", "b", "_"],)


TAGS = {
    "io": ("I-T1 I-T1 I-T2 O I-T3 I-T3 I-T3 I-T3 O I-T1", [(0, 2, "T1"), (2, 3, "T2"), (4, 8, "T3"), (9, 10, "T1")]),
    "bio2": ("I-T1 B-T1 B-T2 O I-T3 B-T3 I-T3 I-T3 O I-T1 O B-T1 B-T1 I-T1", [(0, 1, "T1"), (1, 2, "T1"), (2, 3, "T2"), (4, 5, "T3"), (5, 8, "T3"), (9, 10, "T1"), (11, 12, "T1"), (12, 14, "T1")]),
    "bio": ("B-T1 I-T1 I-T2 O B-T3 B-T3 I-T3 I-T3 O B-T1 O I-T3 O", [(0, 2, "T1"), (2, 3, "T2"), (4, 5, "T3"), (5, 8, "T3"), (9, 10, "T1"), (11, 12, "T3")]),
    "bilou": (
        "B-T1 I-T1 U-T1 O I-T3 B-T3 L-T3 L-T3 O U-T1 L-T1 U-T1 I-T1 U-T1 B-T1",
        [(0, 2, "T1"), (2, 3, "T1"), (4, 5, "T3"), (5, 7, "T3"), (7, 8, "T3"), (9, 10, "T1"), (10, 11, "T1"), (11, 12, "T1"), (12, 13, "T1"), (13, 14, "T1"), (14, 15, "T1")],
    ),
}


@pytest.mark.parametrize("scheme", TAGS)
def test_decode(spark, scheme):
    tags, expected = TAGS[scheme]
    rows = [(1, i + 110, 0, t) for i, t in enumerate(tags.split())]
    got = L.decode(spark.createDataFrame(rows, "doc_id long, tok_idx int, sent_idx int, tag string"), scheme).orderBy("start_token").collect()
    assert [(r.start_token - 110, r.end_token - 110, r.type) for r in got] == expected


@pytest.mark.parametrize(("scheme", "expected"), [("io", "I-T1 I-T1 I-T2 O I-T3 I-T3 I-T3 I-T3 O I-T1"), ("bio2", "I-T1 I-T1 I-T2 O I-T3 B-T3 I-T3 I-T3 O I-T1"), ("bio", "B-T1 I-T1 B-T2 O B-T3 B-T3 I-T3 I-T3 O B-T1"), ("bilou", "B-T1 L-T1 U-T2 O U-T3 B-T3 I-T3 L-T3 O U-T1")])
def test_encode(spark, scheme, expected):
    tokens = spark.createDataFrame([(1, i, 0) for i in range(110, 120)], "doc_id long, tok_idx int, sent_idx int")
    spans = spark.createDataFrame([(1, 110, 112, "T1"), (1, 112, 113, "T2"), (1, 114, 115, "T3"), (1, 115, 118, "T3"), (1, 119, 120, "T1")], "doc_id long, start_token int, end_token int, type string")
    assert " ".join(r.tag for r in L.encode(tokens, spans, scheme).orderBy("tok_idx").collect()) == expected
    with pytest.raises(Exception, match="overlap"):
        L.encode(tokens, spans.unionByName(spans.limit(1).withColumn("type", F.lit("X"))), scheme).collect()


def test_trees(spark):
    #    0 <- 1 <- 2, 2 -> 3, root 2; 4 <-> 5 is a cycle; 6 has its head outside
    heads = [1, 1, 0, -1, 1, -1, 5]
    tokens = spark.createDataFrame([(1, i, 0, h, "N", "d") for i, h in enumerate(heads)], "doc_id long, tok_idx int, sent_idx int, head_dist int, pos string, dt_label string")
    assert [r.depth for r in D.depths(tokens).orderBy("tok_idx").collect()] == [2, 1, 0, 1, None, None, None]
    pairs = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 1), (1, 0, 0, 6)], "doc_id long, sent_idx int, source int, target int")
    assert {(r.source, r.target): r.found for r in D.shortest_paths(pairs, tokens).collect()} == {(0, 3): [0, 1, 2, 3], (1, 1): [1], (0, 6): None}
    labels = D.path_labels(pairs.where("source = 1"), tokens, subtree=True).first().found
    assert labels == [2, 1, 0, 0, 0, 0, 0]
    spans = spark.createDataFrame([(1, 0, 2), (1, 1, 4), (1, 4, 6)], "doc_id long, start_token int, end_token int")
    assert [r.head for r in D.span_heads(spans, tokens).orderBy("start_token").collect()] == [1, 2, None]
