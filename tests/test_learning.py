"""Learned sentence ends, the sequence tagger, attention, cluster merging, similar mentions, samples and keyed state against plain versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import chains as C
from spanloom.operators import crf as CR
from spanloom.operators import models as ML
from spanloom.operators import pairs as P
from spanloom.operators import punkt as PK
from spanloom.operators import segment as G
from spanloom.operators import trees as D
from spanloom.plans import tagger_queries
from spanloom.streaming import incremental


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def corpus(rng):
    """Texts with an abbreviation, titles before names, initials and numbers."""
    words = [f"{a}{b}{c}" for a in "blmnst" for b in ("ea", "o", "i") for c in ("rn", "ft", "nk", "")]
    out = []
    for _ in range(300):
        made = []
        for _ in range(rng.randrange(3, 8)):
            some = [rng.choice(words) for _ in range(rng.randrange(4, 9))]
            some[0] = rng.choice(["The", "This", some[0].title(), some[0].title()])
            if rng.random() < 0.4:
                some.insert(2, "approx.")
            if rng.random() < 0.3:
                some[3:3] = ["Dr.", rng.choice(["Zorkin", "Quamby", "Teark"])]
            made.append(" ".join(some) + rng.choice([".", ".", ".", "?", '."']))
        out.append(" ".join(made))
    return out


def test_learned_sentences(spark):
    texts = corpus(random.Random(1)) + ["The teark costs approx. 5 cents. This is Dr. Teark! Yes.", "No end", "", None]
    tokens = PK.kept(G.tokens(docs(spark, *texts)))
    rules = PK.learn(tokens)
    assert {r.type for r in rules["abbreviations"].collect()} == {"approx", "dr"}
    found = PK.sentenced(tokens, PK.sentence_ends(tokens, rules)).where("doc_id = 300").orderBy("tok_idx").collect()
    cut = ["".join(f"{r.token} " for r in rows).strip() for _, rows in itertools.groupby(found, lambda r: r.sent_idx)]
    assert cut == ["The teark costs approx. 5 cents.", "This is Dr. Teark!", "Yes."]
    right = wrong = 0
    for doc, text in enumerate(texts[:300]):
        ends = {i for i, w in enumerate(text.split()) if w.strip('"')[-1] in ".?" and w not in ("approx.", "Dr.")}
        got = {r.tok_idx for r in PK.sentence_ends(tokens.where(F.col("doc_id") == doc), rules).collect()} if doc < 3 else None
        if got is not None:
            right, wrong = right + len(got & ends), wrong + len(got ^ ends)
    assert right > 5 and wrong <= 1


def test_word_cuts(spark):
    text = "He said, \"don't pay $3,000.50 (or John's share): it'll end...\" They can't -- approx. at 10:30! Fine."
    rules = PK.learn(PK.kept(G.tokens(docs(spark, *corpus(random.Random(2))))))
    rows = PK.tokens(docs(spark, text), rules).orderBy("tok_idx").collect()
    assert all(text[r.char_start : r.char_end] == r.token for r in rows)
    assert [r.token for r in rows] == ["He", "said", ",", '"', "do", "n't", "pay", "$", "3,000.50", "(", "or", "John", "'s", "share", ")", ":", "it", "'ll", "end", "...", '"',
        "They", "ca", "n't", "--", "approx.", "at", "10:30", "!", "Fine", "."]
    assert [r.tok_idx for r in rows] == list(range(len(rows)))


def test_citations_take_linear_time(spark):
    import time

    hard = "(et al " * 100_000 + "(x)" + "(" * 100_000
    began = time.perf_counter()
    assert G.cited_ranges(hard) == []
    assert time.perf_counter() - began < 5
    assert [hard[:0] + t for t in ("(A et al. x)",) if G.cited_ranges(t) == [(0, len(t))]]


def test_restored_offsets_equal_the_fold(spark):
    texts = ["See (Smith et al. 2001) and (Fig. 2) or (1, 2-3) and (12%) here (a).", "(1)x(2) y(3)", "plain text", "(1)(2)(3)"]
    cut = G.eliminate_citations(docs(spark, *texts))
    tokens = G.tokens(cut)
    start, end = G.restore_offsets(F.col("char_start"), F.col("char_end"), F.col("cuts"))
    want = {(r.doc_id, r.tok_idx): (r.s, r.e) for r in tokens.join(cut.select("doc_id", "cuts"), "doc_id").select("doc_id", "tok_idx", start.alias("s"), end.alias("e")).collect()}
    assert {(r.doc_id, r.tok_idx): (r.char_start, r.char_end) for r in G.restored(tokens, cut).collect()} == want


def random_samples(rng, lens, size, n_tags, width):
    feats = [[rng.integers(0, size, width).tolist() for _ in range(n)] for n in lens]
    tags = [rng.integers(0, n_tags, n).tolist() for n in lens]
    return feats, tags


def plain_likelihood(model, feats, tags):
    e = model.weights[np.array(feats)].sum(1)
    value = lambda s: sum(e[i, t] for i, t in enumerate(s)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(s))
    every = {s: value(s) for s in itertools.product(range(e.shape[1]), repeat=len(e))}
    return np.log(sum(np.exp(v) for v in every.values())) - value(tuple(tags)), max(every, key=every.get)


def test_gradient_and_decoding_equal_enumeration():
    rng = np.random.default_rng(1)
    size, n_tags = 9, 3
    lens = [3, 0, 1, 5, 2]
    feats, tags = random_samples(rng, lens, size, n_tags, 4)
    batch = CR.Batch(pa.array(feats, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32())))
    x = rng.normal(size=size * n_tags + n_tags**2)
    of = lambda v: CR.Model.of(v, size, n_tags)
    loss, change = CR.likelihoods(batch, of(x))
    in_order = np.empty(len(lens))
    in_order[batch.order] = loss
    best = np.split(CR.best_tags(batch, of(x)), np.cumsum(lens)[:-1])
    for k, n in enumerate(lens):
        want, path = plain_likelihood(of(x), feats[k], tags[k]) if n else (0, ())
        assert in_order[k] == pytest.approx(want) and tuple(best[k].tolist()) == path
    step = 1e-6
    slope = [(CR.likelihoods(batch, of(x + step * d), False)[0].sum() - CR.likelihoods(batch, of(x - step * d), False)[0].sum()) / (2 * step) for d in np.eye(len(x))]
    assert np.allclose(slope, change, atol=1e-6)


def test_sums_over_partitions_equal_one_batch(spark):
    rng = np.random.default_rng(2)
    lens = rng.integers(0, 9, 40).tolist()
    feats, tags = random_samples(rng, lens, 20, 3, 4)
    rows = [(i, 0, 0, f, t) for i, (f, t) in enumerate(zip(feats, tags, strict=True))]
    made = spark.createDataFrame(rows, "doc_id long, sent_idx int, base int, feats array<array<int>>, tags array<int>").repartition(7)
    model = CR.Model.of(rng.normal(size=69), 20, 3)
    loss, change, n = CR.gradient(made, model)
    whole = CR.Batch(pa.array(feats, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32())))
    each, want = CR.likelihoods(whole, model)
    assert n == 40 and loss == pytest.approx(each.sum()) and np.allclose(change, want)
    got = {r.doc_id: r.loss for r in CR.losses(made, model).collect()}
    assert all(got[int(whole.order[k])] == pytest.approx(each[k]) for k in range(40))
    tags_of = {(r.doc_id, r.tok_idx): r.tag for r in CR.decode(made, model).collect()}
    assert len(tags_of) == sum(lens)
    better = CR.train(made, 3, 20, rounds=15)
    loss, change, n = CR.gradient(made, better)
    assert loss < CR.gradient(made, CR.Model.of(np.zeros(69), 20, 3))[0]
    assert np.abs(change / n + 1e-3 * better.vector()).max() < 0.02  # where the slope ends


def test_tagger_finds_held_out_mentions(spark, small):
    n = {r.outcome: r["count"] for r in tagger_queries.tagger_outcomes(spark, small).groupBy("outcome").count().collect()}
    assert 2 * n["TP"] / (2 * n["TP"] + n.get("FP", 0) + n.get("FN", 0)) > 0.95


def test_attention_equals_matrices(spark):
    rng = np.random.default_rng(3)
    states, query = [rng.normal(size=(n, 3)) for n in (1, 4, 2)], rng.normal(size=(3, 3))
    score, w, u, v = rng.normal(size=(3, 3)), rng.normal(size=(2, 3)), rng.normal(size=(2, 3)), rng.normal(size=2)
    rows = [(i, s.tolist(), q.tolist()) for i, (s, q) in enumerate(zip(states, query, strict=True))] + [(9, [], [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id int, states array<array<double>>, query array<double>")
    times = ML.attend(F.col("states"), F.col("query"), {"score": score.tolist()})
    plus = ML.attend(F.col("states"), F.col("query"), {"state": w.tolist(), "query": u.tolist(), "score": v.tolist()})
    for r in frame.select("id", times.alias("times"), plus.alias("plus")).collect():
        if r.id == 9:
            assert r.times is None and r.plus is None
            continue
        s, q = states[r.id], query[r.id]
        for energy, got in ((s @ score @ q, r.times), (np.tanh(s @ w.T + u @ q) @ v, r.plus)):
            share = np.exp(energy - energy.max())
            assert np.allclose(share @ s / share.sum(), got)


def plain_easy_first(rows):
    out = {}
    for doc in {r[0] for r in rows}:
        cluster, apart = {}, set()
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: (-r[3], r[1], r[2]))
        for _, a, b, _, label in own:
            a, b = cluster.setdefault(a, a), cluster.setdefault(b, b)
            if a == b or frozenset((a, b)) in apart:
                continue
            if label is None:
                apart.add(frozenset((a, b)))
            else:
                cluster = {k: a if v == b else v for k, v in cluster.items()}
                apart = {frozenset(a if x == b else x for x in pair) for pair in apart}
        number = {}
        out |= {(doc, x): number.setdefault(cluster[x], len(number)) for x in sorted(cluster)}
    return out


def test_easy_first_equals_one_by_one(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(30):
        n = rng.randrange(2, 12)
        for a, b in itertools.combinations([f"T{i}" for i in range(n)], 2):
            if rng.random() < 0.7:
                rows.append((doc, *rng.sample([a, b], 2), rng.randrange(8) / 8, rng.choice(["C", "C", None])))
    frame = spark.createDataFrame(rows, "doc_id long, e1 string, e2 string, score double, label string")
    assert {(r.doc_id, r.ent_id): r.chain_id for r in C.easy_first(frame).collect()} == plain_easy_first(rows)


MENTION = "doc_id long, ent_id string, start_token int, end_token int, type string, sent_idx int, ord int"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    return any(a[:p] == b[:p] and (a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]) for p in range(min(len(a), len(b)) + 1))


def words_match(a, b):
    long, short = (b, a) if len(b) > len(a) else (a, b)
    taken = set()
    for x in short:
        free = [i for i, y in enumerate(long) if i not in taken and (x[0] == y[0] or within_one(x[1], y[1]))]
        if not free:
            return False
        taken.add(free[0])
    return True


def test_similar_mentions_equal_all_pairs(spark):
    rng = random.Random(5)
    lemmas = ["ab", "abc", "abd", "xbc", "b", "", "abcd", "zzzz"]
    rows = [(doc, i, [(rng.choice(["T", "U", "V"]) + str(rng.randrange(9)), rng.choice(lemmas)) for _ in range(rng.randrange(1, 4))]) for doc in range(4) for i in range(25)]
    rows += [(9, i, [("Same", "same"), (f"t{i % 3}", "other")]) for i in range(12)]
    worded = spark.createDataFrame([(d, f"T{i}", i, [{"token": t, "lemma": m} for t, m in w]) for d, i, w in rows], "doc_id long, ent_id string, ord int, words array<struct<token: string, lemma: string>>")
    want = {(d, f"T{j}", f"T{i}") for d, i, a in rows for e, j, b in rows if d == e and j > i and words_match(b, a)}
    got = [tuple(r) for r in C.similar_pairs(worded).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    mentions = spark.createDataFrame([(d, f"T{i}", i, i + 1, "X", 0, i) for d, i, _ in rows], MENTION)
    links = spark.createDataFrame(sorted(want), "doc_id long, first string, second string")
    assert sorted(map(tuple, C.similar_chains(mentions, worded).collect())) == sorted(map(tuple, C.chains(mentions, links).collect()))


def test_votes_equal_plain_choice(spark):
    rng = random.Random(6)
    gap = lambda a, b: max(0, max(a[0], b[0]) - min(a[1], b[1]) + 1)
    for seed in range(4):
        spans = sorted({(s, s + rng.randrange(1, 6)) for s in (rng.randrange(40) for _ in range(16))})
        kind = [rng.choice(["noun", "noun", "pron"]) for _ in spans]
        chain = [rng.randrange(4) for _ in spans]
        m = spark.createDataFrame([(1, f"e{i}", *s, kind[i], 0, i) for i, s in enumerate(spans)], MENTION)
        c = spark.createDataFrame([(1, f"e{i}", k) for i, k in enumerate(chain)], "doc_id long, ent_id string, chain_id int")
        nouns, prons = ([i for i, k in enumerate(kind) if k == x] for x in ("noun", "pron"))
        scored = {(n, p): rng.choice([-0.5, 0.0, 0.5, 0.25] if seed else [-0.5, 0.0]) for n in nouns for p in prons if rng.random() < 0.4}
        rows = [(1, *(f"e{x}" for x in rng.sample(pair, 2)), s) for pair, s in scored.items()]
        want = set()
        for p in {p for _, p in scored}:
            votes = {k: [scored[n, p] for n in nouns if chain[n] == k and (n, p) in scored] for k in {chain[n] for n in nouns}}
            best = min(votes, key=lambda k: (-(sum(votes[k]) / len(votes[k]) if votes[k] else 0.0), k))
            want.add((f"e{min((n for n in nouns if chain[n] == best), key=lambda n: (gap(spans[n], spans[p]), n))}", f"e{p}"))
        got = C.pronoun_votes(spark.createDataFrame(rows, "doc_id long, e1 string, e2 string, coref double"), m, c).collect()
        assert {(r.candidate, r.mention) for r in got} == want and len(got) == len(want)


def test_smallest_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_BITS", 2)
    rows = spark.range(500).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7).alias("v"))
    for hashed in (F.xxhash64("key"), F.xxhash64("v"), F.lit(5).cast("long")):
        every = [r.key for r in rows.orderBy(hashed, "key").collect()]
        for most in (0, 1, 77, 250, 499, 500, 900):
            assert sorted(r.key for r in P.smallest(rows, most, hashed, ["key"]).collect()) == sorted(every[:most])


def test_paths_of_odd_trees(spark):
    heads = [(1, 0, i, h) for i, h in enumerate([0, -1, -1, 9, -1, 1, -1])] + [(2, 0, 0, 0)]  # two roots, a head outside, a cycle of 5 and 6
    tokens = spark.createDataFrame(heads, "doc_id long, sent_idx int, tok_idx int, head_dist int")
    every = spark.createDataFrame([(1, 0, i, j) for i in range(7) for j in range(7)] + [(2, 0, 0, 0)], "doc_id long, sent_idx int, source int, target int")
    got = {(r.doc_id, r.source, r.target): r.found for r in D.shortest_paths(every, tokens).collect()}
    assert got[1, 2, 0] == [2, 1, 0] and got[1, 0, 2] == [0, 1, 2] and got[1, 4, 3] == [4, 3] and got[2, 0, 0] == [0]
    assert got[1, 0, 3] is None and got[1, 5, 6] is None and got[1, 5, 5] is None and len(got) == 50
    labels = {(r.doc_id, r.source, r.target): r.found for r in D.path_labels(every, tokens, subtree=True).collect()}
    assert labels[1, 1, 1] == [0, 1, 2, 0, 0, 0, 0] and labels[1, 5, 6] == [0] * 7
    up = {(r.doc_id, r.source): r.found for r in D.root_path(every.select("doc_id", "sent_idx", "source").distinct(), tokens).collect()}
    assert up[1, 2] == [2, 1, 0, -1, -1, -1, -1] and up[1, 5] == [-1, -1, -1, -1, -1, 0, -1]


def test_new_items_need_no_look_at_old_ones(spark, tmp_path):
    """Keys are remembered over restarts, late files are found, and what was appended may even be gone."""
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen = []

    def work(batch):
        seen.append(sorted(r.id for r in batch.collect()))
        return batch

    for batch, rows in enumerate([[(i, "a") for i in range(50)], [(7, "again"), (60, "new"), (60, "new")], [], [(49, "late"), (61, "new")]]):
        if rows:
            spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(source)
        if batch == 3:
            import shutil

            shutil.rmtree(target)  # nothing of it is read
        incremental.process_new(spark, source, target, mark, "id long, text string", work)
    assert [s for s in seen if s] == [list(range(50)), [60], [61]]


def test_keys_are_forgotten_in_time(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows in ([(1, "2024-01-01"), (2, "2024-01-01")], [(1, "2024-01-02")], [(9, "2024-03-01")], [(1, "2024-03-01")], [(1, "2024-03-02")]):
        frame = spark.createDataFrame(rows, "id long, day string").withColumn("at", F.to_timestamp("day"))
        frame.coalesce(1).write.mode("append").parquet(source)
        incremental.process_new(spark, source, target, mark, "id long, day string, at timestamp", lambda df: df, within=("at", "7 days"))
    assert sorted((r.id, r.day) for r in incremental.written(spark, target).collect()) == [(1, "2024-01-01"), (1, "2024-03-01"), (2, "2024-01-01"), (9, "2024-03-01")]


def test_labels_that_nothing_can_be_learned_from(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", None)], "type string, label string")
    with pytest.raises(ValueError):
        P.learnable_labels(rows)
    some = P.learnable_labels(rows.unionByName(spark.createDataFrame([("A", None)], "type string, label string")))
    assert {(r.type, tuple(r.labels), r.single) for r in some.collect()} == {("A", ("None", "x"), False), ("B", ("None",), True)}


def test_samples_of_relations(spark):
    """Codes go up in order of text, so distance 4 among 0 to 51 is the thirty-fifth; unknown types of pairs make no sample."""
    from spanloom.operators import samples as SA
    from spanloom.operators.mentions import as_struct

    spans = [(1, "a", 5, 6, "Bacteria", 1, 0), (1, "b", 9, 14, "Habitat", 1, 1), (1, "c", 20, 24, "Habitat", 2, 2), (1, "d", 22, 23, "Bacteria", 2, 3), (1, "e", 24, 25, "Odd", 2, 4)]
    m = spark.createDataFrame(spans, MENTION)
    one = lambda ids, name: m.where(F.col("ent_id").isin(ids)).select("doc_id", F.col("ent_id").alias(f"{name}_id"), as_struct().alias(name))
    relations = one(["a", "d"], "e1").join(one(["b", "c"], "e2"), "doc_id").where("(e1_id = 'a' AND e2_id = 'b') OR (e1_id = 'd' AND e2_id = 'c')").select("doc_id", "e1", "e2", F.lit("Lives_In").alias("rel_type"))
    sentences = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 18), (1, 2, 18, 30)], "doc_id long, sent_idx int, start_token int, end_token int")
    tokens = spark.createDataFrame([(1, i, 0 if i < 4 else 1 if i < 18 else 2, f"w{i % 3}", i % 5) for i in range(30)], "doc_id long, tok_idx int, sent_idx int, token string, code int")
    props = {"max_candidate_distance": 20, "max_token_entities_distance": 50, "max_sent_entities_distance": 8} | {f"{x}_in_classifier_size": 20 for x in ("rel_args", "entities_types", "entities_token_distance", "entities_sent_distance")}
    learned = SA.learn(m, relations, props)
    made = SA.relation_samples(m, sentences, learned, props, relations, tokens, ["code"])
    got = {(r.e1.ent_id, r.e2.ent_id): r.asDict() for r in made.collect()}
    assert got.keys() == {("a", "b"), ("d", "c")}
    for pair, distance in ((("a", "b"), 35), (("d", "c"), 1)):
        r = got[pair]
        assert (r["labels"], r["labels_mask"], r["rel_args_in_classifier"], r["entities_types_in_classifier_0"], r["entities_types_in_classifier_1"]) == (0, [1, 1], 1, 1, 2)
        assert (r["entities_token_distance_in_classifier"], r["entities_sent_distance_in_classifier"]) == (distance, 1)
    assert got["a", "b"]["indices"] == [[1, 2], [5, 10]] and got["a", "b"]["seq_len"] == 14 == len(got["a", "b"]["code"])
    batch = SA.padded_batches(made.select("doc_id", F.col("e1.ent_id").alias("id1"), "code"), 2, ["doc_id", "id1"], {"code": 0}).collect()
    assert {len(r.code) for r in batch} == {14} and {r.batch for r in batch} == {0}


def test_models_beside_each_other_meet_words_without_a_shuffle(spark, tmp_path):
    from spanloom.operators import word_vectors as WV

    sources = []
    for k, words in enumerate((["a", "b", "c"], ["b", "d"])):
        name = f"test_vectors_{k}_{tmp_path.name.replace('-', '_')}"
        WV.keep(spark.createDataFrame([(w, [float(k), float(i)]) for i, w in enumerate(words)], "token string, vector array<double>"), name, 4, str(tmp_path / f"v{k}"))
        sources.append(WV.Source(name, 2, trainable=k == 1, flags={"lower": True}))
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate(["A", "b", "x", "d"])], "doc_id long, tok_idx int, token string")
    found = WV.looked_up(tokens, sources)
    assert {r.token: (r.vector_0, r.vector_1) for r in found.collect()} == {"A": (None, None), "b": ([0.0, 1.0], [1.0, 0.0]), "x": (None, None), "d": (None, [1.0, 1.0])}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning(token") == 1  # that of the words
    matrices = [WV.matrix(tokens, s, spark) for s in sources]
    codes = [{r.token: r.code for r in x.collect()} for x in matrices]
    assert codes == [{"$PADDING$": 0, "a": 1, "b": 2, "c": 3, "$OOV$": 4}, {"$PADDING$": 0, "a": 1, "b": 2, "d": 3, "x": 4, "$OOV$": 5}]
    assert [(r.words_0, r.words_1) for r in WV.coded(tokens, sources, matrices).orderBy("tok_idx").collect()] == [(1, 1), (2, 2), (4, 4), (4, 3)]
    assert all(abs(x) < 1.3 for r in matrices[1].collect() for x in r.vector)
