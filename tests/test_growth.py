"""Steps whose cost must not grow faster than the input: nothing made twice, no lists of a sentence's length for each token."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom import plans
from spanloom.operators import asof, grouped, rewrite, trees
from spanloom.operators import crf as CR
from spanloom.operators import punkt as PK
from spanloom.operators import segment as G


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_counts_pass_over_rows_once(spark):
    places = spark.createDataFrame([(1, 3), (1, 5), (1, None), (2, 0), (None, 1)], "doc_id long, pos int")
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (3, 4, "d"), (None, 9, "e")], "doc_id long, at int, x string")
    found = asof.with_counts(rows, F.col("at"), places, "n", inclusive=True)
    assert {r.x: r.n for r in found.collect()} == {"a": 2, "b": 2, "c": None, "d": 0, "e": None}
    assert "Join" not in plan(found)


def test_annotations_are_aligned_in_one_pass(spark):
    tokens = G.tokens(spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string"))
    rows = [(1, 4, 6, "x"), (1, 4, 7, "y"), (1, 5, 9, "too long"), (1, 3, 3, "empty, in the space"), (2, 9, 9, "behind")]
    found = G.align_annotations(tokens, spark.createDataFrame(rows, "doc_id long, ann_start int, ann_end int, value string"), "O")
    assert sorted((r.doc_id, r.token, r.value) for r in found.collect()) == [(1, "one", "empty, in the space"), (1, "three", "O"), (1, "two", "x"), (2, "four", "O")]
    assert "Join" not in plan(found)


def test_large_files_are_dealt_into_more_partitions(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id")
    monkeypatch.setattr(grouped, "SHARE", 1 << 10)
    assert grouped.dealt(docs, "doc_id").rdd.getNumPartitions() > 4
    assert grouped.dealt(spark.range(3), "id").count() == 3


def forest(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(1, s, s * n + k, int(rng.integers(0, n)) - k if k % 9 else 0, "AB"[int(rng.integers(0, 2))]) for s in range(4) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, sent_idx int, tok_idx int, head_dist int, pos string").cache(), rows, n


def test_paths_without_labels_of_whole_sentences(spark):
    tokens, rows, n = forest(spark)  # with cycles
    pairs = tokens.select("doc_id", "sent_idx", F.col("tok_idx").alias("source"), (F.col("tok_idx") - F.col("tok_idx") % n + (F.col("tok_idx") * 7 + 3) % n).alias("target"))
    whole = {(r.source, r.target): r.found for r in trees.path_labels(pairs, tokens, subtree=True).collect()}
    few = {(r.source, r.target): r.found for r in trees.path_places(pairs, tokens).collect()}
    assert few.keys() == whole.keys() and any(x.below for x in few.values())
    for key, labels in whole.items():
        assert few[key].on_path == [k for k, x in enumerate(labels) if x == 1] and few[key].below == labels.count(2)
    starts = pairs.select("doc_id", "sent_idx", "source")
    up = {r.source: r.found for r in trees.root_places(starts, tokens).collect()}
    for r in trees.root_path(starts, tokens).collect():
        assert up[r.source] == [k for _, k in sorted((step, k) for k, step in enumerate(r.found) if step >= 0)]


def test_paths_of_a_long_sentence(spark):
    n = 30_000  # labels would be 900 million
    tokens = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("sent_idx"), F.col("id").cast("int").alias("tok_idx"), F.when(F.col("id") == 0, 0).otherwise(F.floor((F.col("id") - 1) / 2) - F.col("id")).cast("int").alias("head_dist"))
    pairs = tokens.select("doc_id", "sent_idx", F.col("tok_idx").alias("source"), F.lit(0).alias("target"))
    assert trees.path_places(pairs, tokens).agg(F.sum(F.col("found.below") + F.size("found.on_path"))).collect()[0][0] == n * n
    assert trees.root_places(pairs.select("doc_id", "sent_idx", "source"), tokens).agg(F.max(F.size("found"))).collect()[0][0] == 15


def test_contrasted_arcs_without_pairs(spark):
    tokens, rows, n = forest(spark, seed=2)
    for most in (None, 5):
        want = set()
        for _, s, t, d, pos in rows:
            if d:
                others = [(abs(t - o), o) for _, s2, o, _, p in rows if s2 == s and p == pos and o not in (t, t + d) and (most is None or abs(t - o) <= most)]
                if others:
                    want |= {(s, t + d, t, True, t), (s, t + d, min(others)[1], False, t)}
        found = trees.contrasted_arcs(tokens, ["C"], most)
        assert sorted((r.sent_idx, r.head, r.child, r.label) for r in found.collect()) == sorted(x[:4] for x in want)
        assert "Join" not in plan(found)


def test_sentence_rules_look_at_distinct_tokens(spark):
    tokens = PK.kept(G.tokens(spark.createDataFrame([(k, "Ask Dr. No at 3 p.m. today. He said so.\nYes?") for k in range(50)], "doc_id long, text string")))
    words = {r.token: r.n for r in PK.vocabulary(tokens).collect()}
    assert len(words) == 11 and set(words.values()) == {50}
    cuts = PK.first_cuts(tokens, PK.vocabulary(tokens), spark.createDataFrame([("dr",), ("p.m",)], "type string"))
    got = {(r.type, r.context, r.previous, r.starts): r.n for r in cuts.collect()}
    assert len(got) == 11 and got["no", "unknown", "dr", True] == 50 and got["he", "begin", "today", True] == 50 and got["ask", "begin", None, False] == 50
    ends = spark.createDataFrame([(1, 1), (1, 1), (1, 7)], "doc_id long, tok_idx int")
    cut = PK.sentenced(tokens.where("doc_id = 1"), ends)
    assert [(r.sent_idx, r["last"]) for r in cut.orderBy("tok_idx").collect()] == [(0, False), (0, True), *[(1, False)] * 5, (1, True), (2, False), (2, False), (2, True)]
    assert "Join" not in plan(cut)


def test_names_are_expanded_from_a_table(spark):
    tokens = G.tokens(spark.createDataFrame([(1, "Escherichia coli and Elegans coli and E. coli or E. lata E. coli"), (2, "E. coli")], "doc_id long, text string"))
    found = G.expand_names(tokens).orderBy("doc_id", "tok_idx")
    assert " ".join(r.token for r in found.collect()) == "Escherichia coli and Elegans coli and Elegans coli or E. lata Elegans coli E. coli"
    assert "MapInArrow" not in plan(found)


def test_tagger_works_on_long_sentences_together(spark):
    rows = [(1, s, k, [k % 5], k % 2) for s, n in enumerate((3, 40, 1, 40, 7)) for k in range(n)]
    tokens = spark.createDataFrame(rows, "doc_id long, sent_idx int, tok_idx int, feats array<int>, tag int").coalesce(1)
    assert [len(r.tags) for r in CR.samples(tokens, "tag").coalesce(1).collect()] == [1, 3, 7, 40, 40]
    batch = CR.Batch(pa.array([[[k % 5] for k in range(n)] for n in (3, 0, 2000)], pa.list_(pa.list_(pa.int32()))), pa.array([[k % 2 for k in range(n)] for n in (3, 0, 2000)]))
    order, n = batch.by_step()
    assert n[:3].tolist() == [2, 2, 2] and n.sum() == 2003 and batch.nth[order].tolist() == sorted(batch.nth)
    loss, change = CR.likelihoods(batch, CR.Model(np.zeros((5, 2)), np.zeros((2, 2))))
    assert np.allclose(loss, np.log(2) * np.array([2000, 3, 0])) and np.isfinite(change).all() and abs(change.sum()) < 1e-6
    strong = CR.Model(np.full((5, 2), 900.0), np.array([[-800.0, 0], [0, -800.0]]))  # beyond what exp can hold
    assert np.allclose(CR.likelihoods(batch, strong, gradient=False)[0], [np.log(2), np.log(2), 0])


def test_collapse_takes_tokens_once(spark):
    tokens = G.tokens(spark.createDataFrame([(1, "a bb ccc d e f"), (2, "g")], "doc_id long, text string"))
    spans = spark.createDataFrame([(1, "T1", 1, 3, "X", 0, 0), (1, "T2", 2, 4, "Y", 0, 1), (1, "T3", 5, 9, "X", 0, 2)], "doc_id long, ent_id string, start_token int, end_token int, type string, sent_idx int, ord int")
    made = rewrite.collapse({"tokens": tokens, "mentions": spans}, ["X", "Y"])["tokens"]
    got = [(r.doc_id, r.tok_idx, r.token, r.char_start, r.char_end) for r in made.orderBy("doc_id", "tok_idx").collect()]
    assert got == [(1, 0, "a", 0, 1), (1, 1, "$Y$", 2, 10), (1, 2, "e", 11, 12), (1, 3, "$X$", 13, 14), (2, 0, "g", 0, 1)]
    assert "Join" not in plan(made) and plan(made).count("MapInArrow") == 1


#: Queries whose tasks once held what all of a small shuffle was put together to.
BY_DOCUMENT = ["nearest_left", "pronoun_pairs", "outcomes", "evaluated_mentions", "chain_groups", "chain_steps", "chains", "noun_chains", "noun_links", "coreference_lines", "coref_training_pairs", "pronoun_votes", "pair_context", "merged_documents"]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_shares_of_large_files_are_not_put_together(spark, small, monkeypatch, name):
    query = plans.queries()[name]
    want = sorted(map(str, query(spark, small).collect()))
    monkeypatch.setattr(grouped, "SHARE", 1 << 15)  # so that these files are several shares, as large ones are
    monkeypatch.setattr(grouped, "FEW", 1, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")  # and the session's number is more than these
    try:
        found = query(spark, small)
        assert sorted(map(str, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ran = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    rows = [x for x in re.findall(r"Exchange (\w+\([^\n]*), (\w+), \[plan_id", ran) if x[0].startswith("hashpartitioning")]
    assert any(kind == "REPARTITION_BY_NUM" for _, kind in rows)
    # What is left to be put together are the few counts of an evaluation.
    assert ran.count("coalesced") <= (1 if name == "evaluated_mentions" else 0)


def test_sentences_are_adjusted_in_one_pass(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        ends = np.cumsum(rng.integers(1, 5, 12))
        cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        spans = [(int(s), int(s) + int(n)) for s, n in zip(rng.integers(0, ends[-1] + 3, 6), rng.integers(1, 8, 6))]
        want, reach = [], 0
        for s, e in cuts:
            if want and reach > s:
                want[-1] = (want[-1][0], e)
            else:
                want.append((s, e))
            reach = max([reach, e, *(b for a, b in spans if s <= a < e)])
        made = rewrite.adjust_sentences(
            spark.createDataFrame([(1, k, s, e) for k, (s, e) in enumerate(cuts)], "doc_id long, sent_idx int, start_token int, end_token int"),
            spark.createDataFrame([(1, s, e) for s, e in spans], "doc_id long, start_token int, end_token int"),
        )
        assert [(r.sent_idx, r.start_token, r.end_token) for r in made.orderBy("sent_idx").collect()] == [(k, s, e) for k, (s, e) in enumerate(want)]
        assert "Join" not in plan(made)


def test_relation_reports_send_no_mentions_to_all(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # which the mentions of a tenth of a gigabyte of texts pack into
    try:
        found = plans.queries()["relation_reports"](spark, small)
        assert found.count() > 0
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_learned_tokens_are_cut_without_shuffling_tokens(spark):
    texts = ["Ask Dr. No at 3 p.m. today. He's 'late'. (See Fig. 2) E. coli grew.\nYes? Escherichia coli and E.coli-like rows.", "", "One.", "  \n ", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    rough = PK.kept(G.tokens(docs))
    assert sorted(map(str, rough.select("*").collect())) == sorted(map(str, G.tokens(docs, neighbours=True).select(rough.columns).collect()))
    rules = PK.learn(rough)
    want = PK.words(PK.sentenced(rough, PK.sentence_ends(rough, rules)))
    found = PK.tokens(docs, rules)
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert "Window" not in plan(found) and plan(found).count("MapInArrow") == 2
    long = G.in_order(G.tokens(docs.limit(1)).withColumn("pieces", F.split("token", "")), F.col("pieces"), following=True).orderBy("tok_idx").collect()
    assert [r.following for r in long[:-1]] == [r.token for r in long[1:]] and long[-1].following is None
    with pytest.raises(Exception, match="don't stand in the order"):
        G.in_order(G.tokens(docs).where("tok_idx <> 1"), F.array("token")).count()


def test_pairs_of_neighbours_are_few(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(words[(k * i) % 199] for i in range(1, 199)) + " Mr. Fox") for k in range(1, 40)], "doc_id long, text string")
    tokens = G.tokens(docs, neighbours=True)
    cuts = PK.first_cuts(tokens, PK.vocabulary(tokens), spark.createDataFrame([("mr",)], "type string"))
    assert cuts.count() < 2 * 210
    assert {(r.previous, r.context, r.opens, r.starts) for r in cuts.where("type = 'fox'").collect()} == {("mr", "unknown", True, True)}
