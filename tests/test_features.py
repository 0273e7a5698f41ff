"""Coreference choices, document models, look-ups, losses and pipelines on small vectors and against plain versions."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import asof, chains, coref, encode, features, grouped, labels, mentions, models, pairs, rewrite, sampling, segment
from spanloom.plans import pipeline
from spanloom.sources import readers, writers

MENTIONS = "doc_id long, ent_id string, start_token int, end_token int, type string, sent_idx int, ord int"


def table(spark, spans):
    """Mentions of one document from (start, end, type) in order, named by their place."""
    return spark.createDataFrame([(1, f"e{i}", s, e, t, 0, i) for i, (s, e, t) in enumerate(spans)], MENTIONS)


def entity_distance(spans, a, b):
    """Counted one by one: mentions between the two until the first that ends after the later start."""
    low, high, n = min(a[1], b[1]), max(a[0], b[0]), 0
    for s, e, _ in spans:
        if e > high:
            break
        n += s >= low
    return n


def random_spans(rng, n, width=40):
    made = sorted({(s, s + rng.randrange(1, 6), rng.choice(["noun", "pron"])) for s in (rng.randrange(width) for _ in range(n))})
    return [x for i, x in enumerate(made) if not i or made[i - 1][:2] != x[:2]]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_pronouns_against_plain_choice(spark, seed):
    rng = random.Random(seed)
    spans = random_spans(rng, 16)
    of_chain = {i: rng.randrange(3) for i in range(len(spans))}
    m = table(spark, spans)
    c = spark.createDataFrame([(1, f"e{i}", k) for i, k in of_chain.items()], "doc_id long, ent_id string, chain_id int")
    is_noun, is_pron = F.col("type") == "noun", F.col("type") != "noun"
    gap = lambda a, b: max(0, max(a[0], b[0]) - min(a[1], b[1]) + 1)
    for most, strict in ((1, False), (3, True), (3, False)):
        every, nearest = set(), set()
        for p, k in itertools.product([i for i, s in enumerate(spans) if s[2] != "noun"], range(3)):
            members = [i for i, s in enumerate(spans) if s[2] == "noun" and of_chain[i] == k]
            left = [i for i in members if spans[i][0] <= spans[p][0]]
            near = lambda i: entity_distance(spans, spans[i], spans[p]) <= most  # noqa: B023, E731
            every |= {(min(i, p), max(i, p)) for i in left if near(i)}
            first = lambda some: min(some, key=lambda i: (gap(spans[i], spans[p]), i), default=None)  # noqa: B023, E731
            chosen = first(left)
            if (chosen is None or not near(chosen)) and not strict:
                chosen = first(members)
            if chosen is not None and near(chosen):
                nearest.add((min(chosen, p), max(chosen, p)))
        got = lambda df: {(int(r.e1.ent_id[1:]), int(r.e2.ent_id[1:])) for r in df.collect()}
        assert got(pairs.pronoun_pairs(m, c, is_pron, is_noun, most)) == every
        assert got(pairs.nearest_in_chain(m, c, is_pron, is_noun, most, strict)) == nearest


def test_distances_and_ranges_against_plain_counts(spark):
    rng = random.Random(9)
    spans = random_spans(rng, 25, 200)
    m = table(spark, spans)
    both = pairs.preceding(m, 6)
    got = {(r.e1.ord, r.e2.ord): r.entity_distance for r in pairs.with_entity_distance(both, m).collect()}
    assert got == {(i, j): entity_distance(spans, spans[i], spans[j]) for i, j in got} and got
    held = {(r.container.ord, r.mention.ord) for r in mentions.contained_in(m, m).collect()}
    assert held == {(i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if a[0] <= b[0] and b[1] <= a[1]}
    close = {(r.e1.ord, r.e2.ord) for r in pairs.candidates(m, near=5).collect()}
    assert close == {(i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if max(0, max(a[0], b[0]) - min(a[1], b[1]) + 1) <= 5}
    c = spark.createDataFrame([(1, f"e{i}", i % 4) for i in range(len(spans))], "doc_id long, ent_id string, chain_id int")
    steps = {(i, min((j for j in range(i + 1, len(spans)) if j % 4 == i % 4), default=None)) for i in range(len(spans))}
    steps = {s for s in steps if s[1] is not None}
    between = {(k, j) for i, j in steps for k, x in enumerate(spans) if k not in (i, j) and x[0] >= spans[i][0] and x[1] <= spans[j][1]}
    assert {(r.e1.ord, r.e2.ord) for r in pairs.training_pairs(m, c).collect()} == steps | between


def test_counts_before(spark):
    asked = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (2, 3), (3, 1)], "doc_id long, pos int")
    places = spark.createDataFrame([(1, 5), (1, 2), (1, 5), (2, 9)], "doc_id long, pos int")
    got = lambda **k: {(r.doc_id, r.pos): r.n for r in asof.counts_before(asked, places, **k).collect()}
    assert got() == {(1, 0): 0, (1, 5): 1, (2, 3): 0, (3, 1): 0} and got(inclusive=True) == {(1, 0): 0, (1, 5): 3, (2, 3): 0, (3, 1): 0}


def test_heuristics_and_noun_chains(spark):
    spans = [(0, 2, "noun"), (1, 3, "noun"), (4, 6, "noun"), (6, 7, "pron"), (8, 10, "noun")]
    m = table(spark, spans)
    words = ["a", "b", "c", "x", "b", "a", "it", "y", "a", "b"]
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id long, tok_idx int, lemma string")
    matched = coref.exact_matches(m, t, "lemma")
    key = lambda df: sorted((r.e1.ent_id, r.e2.ent_id, r.label) for r in df.collect())
    assert key(matched) == [("e0", "e2", "COREF"), ("e0", "e4", "COREF"), ("e2", "e4", "COREF")]
    assert key(coref.intersecting(m)) == [("e0", "e1", None)]
    assert {r.score for r in coref.first_of(coref.intersecting(m), matched).collect()} == {1.0}
    links = spark.createDataFrame([(1, "e0", "e3"), (1, "e3", "e4")], "doc_id long, first string, second string")
    kept, relations = coref.nouns_only(m, chains.chains(m, links))
    assert kept.count() == 4 and [(r.first, r.second) for r in relations.collect()] == [("e0", "e4")]
    assert coref.collecting_strategy("rank") is chains.rank
    with pytest.raises(KeyError):
        coref.collecting_strategy("none such")


def test_components_of_documents_against_union(spark):
    rng = random.Random(1)
    rows, links, expected = [], [], {}
    for doc in range(30):
        n = rng.randrange(1, 40)
        rows += [(doc, f"m{i}", i) for i in range(n)]
        own = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(n))]
        links += [(doc, f"m{a}", f"m{b}") for a, b in own] + [(doc, "m0", "unknown")]
        parent = list(range(n))
        for _ in range(n):
            for a, b in own:
                parent[a] = parent[b] = min(parent[a], parent[b])
        heads = sorted(set(parent))
        expected |= {(doc, f"m{i}"): heads.index(p) for i, p in enumerate(parent)}
    m = spark.createDataFrame(rows, "doc_id long, ent_id string, ord int")
    r = spark.createDataFrame(links, "doc_id long, first string, second string")
    assert {(x.doc_id, x.ent_id): x.chain_id for x in chains.chains(m, r).collect()} == expected
    assert chains.chains(m.limit(0), r).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5])
def test_whole_documents(size):
    import pyarrow as pa

    rows = pa.table({"doc_id": [1, 1, 1, 2, 3, 3, 3, 3, 4]})
    got = [t["doc_id"].to_pylist() for t in grouped.whole_documents(iter(rows.to_batches(max_chunksize=size)))]
    assert sum(got, []) == rows["doc_id"].to_pylist() and all(not set(a) & set(b) for a, b in zip(got, got[1:], strict=False))


def test_long_lines_are_cut_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "word " * 1_000_000), (2, "x\n" * 200_000)], "doc_id long, text string").cache()
    docs.count()
    segment.tokens(docs.limit(0)).count()
    began = time.time()
    assert {r.doc_id: (r.n, r.e) for r in segment.tokens(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("char_end").alias("e")).collect()} == {1: (1_000_000, 4_999_999), 2: (200_000, 399_999)}
    assert segment.sentences(docs).count() == 200_001 and time.time() - began < 20


def test_post_processing_chain(spark):
    text = "Escherichia coli grows (Smith et al. 2001) in E.coli-rich media of B. subtilis sp .\nIt grows ."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = segment.post_processed(docs)
    rows = made["tokens"].orderBy("tok_idx").collect()
    assert [r.token for r in rows] == ["Escherichia", "coli", "grows", "in", "Escherichia", "coli", "-", "rich", "media", "of", "B.", "subtilis", "sp", ".", "It", "grows", "."]
    assert [text[r.char_start : r.char_end] for r in rows if r.tok_idx not in (4, 5)] == [r.token for r in rows if r.tok_idx not in (4, 5)]
    assert [(r.start_token, r.end_token) for r in made["sentences"].collect()] == [(0, 17)]


def plain_paragraphs(sentence_ends, raw_ends):
    out, start, k = [], 0, 0
    for i, ends in enumerate(sentence_ends):
        for e in ends:
            last = i == len(sentence_ends) - 1 and e == ends[-1]
            if start != i + 1 and (last or (k < len(raw_ends) and raw_ends[k] <= e)):
                out.append((start, i + 1))
                start, k = i + 1, k + 1
    return out


def test_paragraphs_and_merge_against_plain_steps(spark):
    rng = random.Random(5)
    for _ in range(6):
        sizes = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))]
        tokens, sents, at = [], [], 0
        for i, n in enumerate(sizes):
            sents.append((1, i, at, at + n))
            tokens += [(1, at + j, i, "t", 3 * (at + j), 3 * (at + j) + 2) for j in range(n)]
            at += n
        ends = sorted(rng.sample(range(1, 3 * at + 6), rng.randrange(0, 6)))
        t = spark.createDataFrame(tokens, "doc_id long, tok_idx int, sent_idx int, token string, char_start int, char_end int")
        s = spark.createDataFrame(sents, "doc_id long, sent_idx int, start_token int, end_token int")
        raw = spark.createDataFrame([(1, a, b) for a, b in zip([0, *ends], ends, strict=False)], "doc_id long, start int, end int")
        got = [(r.start_sentence, r.end_sentence) for r in rewrite.paragraphs_of(s, t, raw).orderBy("par_idx").collect()]
        assert got == plain_paragraphs([[x[5] for x in tokens if x[2] == i] for i in range(len(sizes))], ends)
    entities = spark.createDataFrame([(1, "T1", "X", 0, 2), (1, "T2", "Y", 3 * at - 3, 3 * at), (1, "T3", "Z", 900, 901)], "doc_id long, id string, type string, start int, end int")
    relations = spark.createDataFrame([(1, "T1", "T2", "S"), (1, "T2", "T1", "R")], "doc_id long, first string, second string, rel_type string")
    made = rewrite.merged(t, s, raw, entities, relations, ["S"])
    assert sorted(r.ent_id for r in made["mentions"].collect()) == ["T1", "T2"]
    assert sorted((r.e1.ent_id, r.e2.ent_id, r.rel_type) for r in made["relations"].collect()) == [("T1", "T2", "S"), ("T2", "T1", "R"), ("T2", "T1", "S")]


def test_collapse_carries_every_kind_of_feature(spark):
    rows = [(1, i, i // 4, w, 2 * i, 2 * i + 1, i, {"k": w}, [1.0, 2.0], i % 2 == 0) for i, w in enumerate("abcdefgh")]
    t = spark.createDataFrame(rows, "doc_id long, tok_idx int, sent_idx int, token string, char_start int, char_end int, n int, feats map<string,string>, v array<double>, even boolean")
    m = table(spark, [(1, 3, "X"), (1, 4, "Y"), (5, 6, "X"), (6, 8, "Z")])
    s = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 8)], "doc_id long, sent_idx int, start_token int, end_token int")
    made = rewrite.collapse({"tokens": t, "sentences": s, "mentions": m, "ne": m, "relations": "kept"}, ["X", "Y"])
    got = [(r.tok_idx, r.token, r.char_start, r.char_end, r.n, r.feats, r.v, r.even) for r in made["tokens"].orderBy("tok_idx").collect()]
    assert got[1] == (1, "$Y$", 2, 7, 0, {}, [0.0, 0.0], False) and got[3] == (3, "$X$", 10, 11, 0, {}, [0.0, 0.0], False)
    assert [g[1] for g in got] == ["a", "$Y$", "e", "$X$", "g", "h"] and got[4] == (4, "g", 12, 13, 6, {"k": "g"}, [1.0, 2.0], True)
    assert [(r.start_token, r.end_token) for r in made["sentences"].orderBy("sent_idx").collect()] == [(0, 2), (2, 6)]
    assert {r.ent_id: (r.start_token, r.end_token) for r in made["ne"].collect()} == {"e0": (1, 2), "e1": (1, 2), "e2": (3, 4), "e3": (4, 6)} and made["relations"] == "kept"


def plain_decode(tags, opening, closing):
    out, start, kind = [], None, None
    for i, tag in enumerate([*tags, "O"]):
        symbol, _, own = tag.partition("-")
        if start is not None and (tag == "O" or own != kind or symbol in opening):
            out.append((start, i, kind))
            start = None
            if tag == "O":
                continue
            start, kind = i, own
        elif start is not None and symbol in closing:
            out.append((start, i + 1, kind))
            start = None
        elif start is None and tag != "O":
            if symbol in closing:
                out.append((i, i + 1, own))
            else:
                start, kind = i, own
    return out


@pytest.mark.parametrize("scheme", ["io", "bio", "bilou"])
def test_decoding_against_plain_steps(spark, scheme):
    rng = random.Random(3)
    symbols = {"io": "I", "bio": "BI", "bilou": "BILU"}[scheme]
    lists = [[rng.choice(["O", *(f"{s}-{k}" for s in symbols for k in "XY")]) for _ in range(rng.randrange(1, 14))] for _ in range(120)]
    rows = [(1, 100 * i + j, i, tag) for i, tags in enumerate(lists) for j, tag in enumerate(tags)]
    got = labels.decode(spark.createDataFrame(rows, "doc_id long, tok_idx int, sent_idx int, tag string"), scheme)
    found = sorted((r.sent_idx, r.start_token - 100 * r.sent_idx, r.end_token - 100 * r.sent_idx, r.type) for r in got.collect())
    assert found == sorted((i, *s) for i, tags in enumerate(lists) for s in plain_decode(tags, *labels.SYMBOLS[scheme]))


def test_losses_against_enumeration(spark):
    rng = np.random.default_rng(0)
    emissions, transitions, tags = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), np.array([0, 2, 1, 1])
    score = lambda p: sum(emissions[i, k] for i, k in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:], strict=False))
    total = np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=4)))
    assert models.crf_loss(emissions, transitions, tags) == pytest.approx(total - score(tags))
    assert models.distance_loss(np.array([[1.0, 0.0]]), np.array([0]), np.array([[2.0, 0.0], [0.0, 1.0]])) == pytest.approx(1 - np.sqrt(2))
    row = spark.createDataFrame([([3.0, 4.0],)], "w array<double>").select(models.l2_loss(F.col("w"), 0.1).alias("l")).first()
    assert row.l == pytest.approx(1.25)


def test_pipelines_of_properties(spark):
    assert pipeline.difference({"a": 1, "b": {"c": 1, "d": 2}, "e": 5}, {"a": 1, "b": {"c": 2, "d": 2}, "f": 3}) == {"b": {"c": 2}, "f": 3}
    assert pipeline.without_paths({"a": {"b": 1, "c": 2}, "d": 3}, [["a", "b"], ["d"]]) == {"a": {"c": 2}}
    m = table(spark, [(0, 1, "A"), (1, 2, "B"), (2, 3, "C")])
    made = pipeline.preprocessor_for("net", {"ent_types_to_filter": ["C"], "ent_types_merge_pattern": {"X": ["A"]}, "ne_types_merge_pattern": {"Y": ["B"]}})({"mentions": m, "relations": None})
    assert [r.type for r in made["mentions"].orderBy("ord").collect()] == ["X", "B"] and [r.type for r in made["ne"].orderBy("ord").collect()] == ["A", "Y"] and "relations" not in made
    with pytest.raises(KeyError):
        pipeline.preprocessor_for("none such", {})
    with sampling.kept_on_disk(m) as held:
        assert held.count() == held.count() == 3 and held.is_cached
    assert not held.is_cached


def test_small_helpers(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(400)], "id int, label string")
    left = sampling.drop_negatives(df, "label", 0.5, ["id"])
    assert left.where("label IS NOT NULL").count() == 200 and 60 < left.where("label IS NULL").count() < 140
    assert encode.feature_config({"b": 0, "a": 5, "c": -1}) == {"a": "embedded", "b": "one_hot"}
    (tmp_path / "a.txt").write_text("one two\n\nthree")
    assert [r.text for r in readers.raw_text(spark, str(tmp_path)).collect()] == ["one two\n\nthree"]
    parts = readers.split_text(spark, str(tmp_path))
    assert sorted((r.name, r.text) for r in parts.collect()) == [("a_0", "one two"), ("a_1", "three")]
    assert readers.segmented(parts)["tokens"].count() == 3
    steps = models.compose(lambda d: d.where("id < 10"), lambda d: d.select("id"))
    assert steps(df).count() == 10
    from spanloom.functions import text as T

    assert df.where(T.any_of(F.col("id") == 3, F.col("id") == 5)).count() == 2
    named = features.with_namespace(df, "ns", ["label"])
    assert named.columns == ["id", "ns_label"] and features.with_namespace(df, "", ["label"]).columns == df.columns
    odd = writers.task_lines(table(spark, [(0, 1, "Ship")]), spark.createDataFrame([(1, 0, 0, 4)], "doc_id long, tok_idx int, char_start int, char_end int"))
    assert [r.line for r in odd.collect()] == ["ship 0 4"]
