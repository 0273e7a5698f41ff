"""The n-gram join, line dedup, vectors and components against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import blocks, components, line_dedup, ngram_join, pivots


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_join_matches_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            other = list(base)
            for _ in range(rng.randrange(0, 5)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    roots = groups_of(range(len(texts)), linked)
    assert len(linked) > 20
    for i in range(len(texts)):
        assert got[i].n_links == sum(i in p for p in linked)
        assert got[i].component_id == roots[i]
        assert got[i].kept == (roots[i] == i)


def test_join_deals_large_groups_into_blocks(spark, monkeypatch):
    base = [f"x{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:150], f"y{i}", *base[150:]])) for i in range(60)]
    real = blocks.deal
    monkeypatch.setattr(ngram_join, "deal", lambda members, keys: real(members, keys, 7))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_join_edges(spark, messy, corpus, nothing, clashing):
    got = ngram_join.join(messy).collect()
    assert len(got) == len(corpus)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    # 0, 1 and 3 have the same words, row 0 stands twice; 2 differs in one word.
    assert [by_id[i].class_id for i in (0, 1, 2, 3)] == [0, 0, 2, 0]
    assert {by_id[i].component_id for i in (0, 1, 2, 3)} == {0} or by_id[2].component_id == 2
    assert by_id[10].component_id == by_id[11].component_id == 10  # "one" twice
    for i in (7, 8, 9):  # empty, null, blank
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert [r.n_links for r in got if r.doc_id is None] == [None, None]
    assert ngram_join.join(nothing).count() == 0
    kept = ngram_join.deduplicate(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 3 not in ids and ids.count(None) == 2 and {7, 8, 9} <= set(ids)
    assert ngram_join.deduplicate(nothing).count() == 0


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    a, x, y = (" ".join(f"{k}{i}" for i in range(80)) for k in "axy")
    near = a.replace("a7 ", "b ")
    rows = [(1, a, 1), (2, a, 2), (2, "unique words here", 3), (3, x, 4), (3, y, 5), (3, x, 6), (4, near, 7), (4, near.upper(), 8), (5, "", 9), (5, "", 10), (None, a, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.deduplicate(docs).collect())
    assert kept == sorted([(1, a), (2, "unique words here"), (3, x), (3, y), (5, ""), (5, ""), (0, a)])
    found = ngram_join.join(docs).where("doc_id IN (1, 2, 4)").collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.component_id, r.kept) for r in found) == [(1, 1, 3, 1, True), (2, 1, 3, 1, False), (2, 2, 0, 2, True), (4, 4, 3, 1, False), (4, 4, 3, 1, False)]


def test_pruning_keeps_what_reaches_the_threshold():
    fewest = ngram_join.fewest_matches()
    assert len(fewest) == ngram_join.VALUES // ngram_join.STEP and fewest == sorted(fewest)
    rng = np.random.default_rng(0)
    matches = np.cumsum(rng.random((100_000, ngram_join.VALUES)) < 0.8, axis=1)[:, ngram_join.STEP - 1 :: ngram_join.STEP]
    assert (matches < fewest).any(1).mean() < 1e-4


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == groups_of({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def random_edits(rng, text, n, letters="abcd"):
    out = list(text)
    for _ in range(n):
        kind, at = rng.random(), rng.randrange(len(out) + 1)
        if kind < 0.4:
            out.insert(at, rng.choice(letters))
        elif out and kind < 0.7:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def test_banded_distance_and_segments():
    rng = random.Random(1)
    for n in range(2000):
        edits = rng.randrange(0, 5)
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 90 if n % 3 else 12)))
        b = random_edits(rng, a, rng.randrange(0, edits + 3))
        real = edit_distance(a, b)
        assert line_dedup.banded_distance(a, b, edits) == min(real, edits + 1)
        if real <= edits < min(len(a), len(b)):
            long, short = sorted((a, b), key=len, reverse=True)
            own = {(k, short[at : at + m]) for k, (at, m) in enumerate(line_dedup.segments(len(short), edits))}
            assert own & {(k, long[at : at + m]) for k, at, m in line_dedup.probe_starts(len(long), len(short), edits)}


def removed_lines(docs):
    places = {}
    for doc_id, text in sorted((d, t) for d, t in docs if d is not None and t is not None):
        for pos, line in enumerate(text.split("\n")):
            line = line.strip(line_dedup.WHITE)
            if line and (doc_id, pos) not in places.setdefault(line, []):
                places[line].append((doc_id, pos))
    lines = sorted(places)
    roots = groups_of(lines, [(a, b) for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) < 30 and edit_distance(a, b) <= max(min(2, min(len(a), len(b)) // 10), min(len(a), len(b)) // 20)])
    gone = {}
    for root in set(roots.values()):
        members = [m for m in lines if roots[m] == root]
        doc = min(d for m in members for d, _ in places[m])
        head = min(m for m in members if any(d == doc for d, _ in places[m]))
        stays = doc, min(p for d, p in places[head] if d == doc)
        for m in members:
            for d, p in places[m]:
                if (d, p) != stays:
                    gone.setdefault(d, set()).add(p)
    return {d: sorted(p) for d, p in gone.items()}


def test_lines_against_all_pairs(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(18, 40))).strip() for _ in range(25)]
    docs = [(i, "\n".join(random_edits(rng, rng.choice(lines), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    got = {r.doc_id: r.removed for r in line_dedup.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == removed_lines(docs) and len(got) > 10


def test_long_lines_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() for n in (58, 62, 79, 81, 119, 160, 300)]
    lines = sorted({random_edits(rng, x, rng.randrange(0, len(x) // 14)).strip() for x in base for _ in range(8)} | {"ab" * 70, "ab" * 72, "-" * 90, "-" * 99})
    near = lambda a, b: edit_distance(a, b) <= max(2, min(len(a), len(b)) // 20)
    roots = groups_of(range(len(lines)), [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) < 20 and near(lines[i], lines[j])])
    got = {r.doc_id for r in line_dedup.repeated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), edits=line_dedup.edits_by_length).collect()}
    assert got == {i for i in roots if roots[i] != i} and len(got) > 20
    a = "".join(rng.choice("abcd") for _ in range(900))
    b = random_edits(rng, a, 40)
    assert line_dedup.banded_distance(a, b, 45) == edit_distance(a, b) > 31


def test_long_lines_meet_by_few_rows(spark, monkeypatch):
    # Of lines without near copies almost nothing is written; with them, each pair meets, whatever the range of lengths or the length of lists.
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() for n in rng.choices(range(70, 700), k=150)]
    copies = [random_edits(rng, x, rng.randrange(1, len(x) // 20 + 1)).strip() for x in base[:40]]
    whole = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(base)], "node long, line string, length int")
    written = []
    monkeypatch.setattr(line_dedup, "materialise", lambda rows, name, real=line_dedup.materialise: (written.append((name, real(rows, name))), written[-1][1])[1])
    monkeypatch.setattr(line_dedup, "remove", lambda *_: None)
    line_dedup.long_lines_met(whole, line_dedup.edits_by_length)
    assert sum(rows.count() for name, rows in written if name == "stretches") < len(base)
    near = {(i, 150 + j) for i, x in enumerate(base) for j, y in enumerate(copies) if abs(len(x) - len(y)) < 40 and edit_distance(x, y) <= min(len(x), len(y)) // 20}
    both = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(base + copies)], "node long, line string, length int")
    monkeypatch.setattr(line_dedup, "FILTER_SEGMENTS", 1000)
    pairs, _ = line_dedup.long_lines_met(both, line_dedup.edits_by_length)
    assert len(near) > 30 and near <= {(r.node, r.partner) for r in pairs.collect()}
    monkeypatch.setattr(line_dedup, "PAIR_ROWS", 1)
    _, members = line_dedup.long_lines_met(both, line_dedup.edits_by_length)
    lists = {}
    for k, part in enumerate(members):
        for r in part.collect():
            lists.setdefault((k, r.bucket), set()).add(r.node)
    assert len(members) > 1 and all(any({a, b} <= found for found in lists.values()) for a, b in near)


@pytest.mark.parametrize("list_rows", [1024, 8])
def test_families_meet_once_in_long_lists(spark, monkeypatch, list_rows):
    # Copies of one line share most segments: their texts aren't sent out for each list again once they are connected; what isn't still is.
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)).strip() for _ in range(2)]
    base.append(base[0][:60] + "".join(rng.choice("ijkl") for _ in range(320)))  # meets the first family, near none of it
    lines = sorted({random_edits(rng, x, rng.randrange(0, 4)).strip() for x in base for _ in range(14)})
    written = []
    monkeypatch.setattr(line_dedup, "materialise", lambda rows, name, real=line_dedup.materialise: (written.append((name, real(rows, name))), written[-1][1])[1])
    monkeypatch.setattr(line_dedup, "PAIR_ROWS", 4)
    monkeypatch.setattr(line_dedup, "LIST_ROWS", list_rows)
    found = line_dedup.groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert len(found) == len(lines) and len({r.first_doc for r in found}) == 3
    rows = [df for name, df in written if name == "segments"]
    assert len(rows) == 1 and rows[0].count() < 3 * len(lines) and (list_rows < 1024 or rows[0].count() == 0)


def test_counters_keep_all_near_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (60, 200, 500, 511, 512, 515, 530, 900)]
    lines = [y for x in base for y in (x, random_edits(rng, x, len(x) // 22), "".join(rng.choice("efgh") for _ in x))]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string").mapInArrow(line_dedup.sketched, "node long, line string, length int, sketch binary")
    pairs = spark.createDataFrame([(i, i + k, 1) for i in range(0, len(lines), 3) for k in (1, 2)], "node long, partner long, n long")
    got = {(r.node, r.partner) for r in line_dedup.alike(pairs, texts, line_dedup.edits_by_length).collect()}
    assert got == {(i, i + 1) for i in range(0, len(lines), 3)}


def test_lanes_agree_with_the_banded_distance():
    rng = random.Random(7)
    first = ["".join(rng.choice("abcd") for _ in range(rng.choice([60, 81, 200, 639, 640, 900]))) for _ in range(120)]
    second = [random_edits(rng, x, rng.randrange(0, len(x) // 14)) for x in first]
    most = [line_dedup.edits_by_length(min(len(a), len(b))) for a, b in zip(first, second)]
    want = [line_dedup.banded_distance(a, b, n) <= n for a, b, n in zip(first, second, most)]
    assert line_dedup.within(first, second, line_dedup.edits_by_length).tolist() == want and 20 < sum(want) < 120


def test_op9_links_a_replaced_word_in_a_long_line(spark, tmp_path):
    line = "the committee met again on tuesday to discuss the budget for the coming year and agreed that nothing should be decided before the auditors had reported to everyone"
    spark.createDataFrame([(1, line), (2, line.replace("tuesday", "friday"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_op9_takes_short_lines(spark, tmp_path):
    # Exact repeats at any length; near copies from 10 characters on; empty lines stay.
    texts = ["Les.\n\nx\nOf, edti oner.", "Lea.\n\nLes.\nx", "Of, edti onar.\nOf, ebti onar, so", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (4, ""), 1: (4, "2,3"), 2: (2, "0"), 3: (1, "0")}


def test_lines_of_rows_that_share_an_id(spark):
    same, other = "a line that is repeated here", "precious unique line of the other row"
    docs = spark.createDataFrame([(1, f"{same}\nfirst", 0), (5, f"{same}\nsecond", 0), (5, f"{other}\n{same}", 0), (5, f"{other}\n{same}", 1), (6, "seventh\nLes.", 0), (7, "Les.", 0), (8, "x\n\nx\n\n", 0)], "doc_id long, text string, _gone int")
    got = sorted((r.doc_id, r.text, r._gone) for r in line_dedup.clean(docs).collect())
    assert got == [(1, f"{same}\nfirst", 0), (5, other, 0), (5, other, 1), (5, "second", 0), (6, "seventh\nLes.", 0), (7, "", 0), (8, "x\n\n\n", 0)]
    # Of two texts of the smallest doc_id one keeps the line.
    twice = spark.createDataFrame([(1, f"{same}\none"), (1, f"two\n{same}"), (2, same)], "doc_id long, text string")
    left = "\n".join(r.text for r in line_dedup.clean(twice).collect())
    assert left.count(same) == 1 and "one" in left and "two" in left


def test_very_common_lines_are_salted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the very common line\nown {i * 7919 % 1000:04d} of this row {i}") for i in range(60)], "doc_id long, text string")
    known = {(r.doc_id, tuple(r.removed)) for r in line_dedup.repeated(docs).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, tuple(r.removed)) for r in line_dedup.repeated(docs).collect()} == known and len(known) == 59


def test_line_edges(spark, messy, corpus, nothing, clashing):
    got = {r.doc_id: r.removed for r in line_dedup.repeated(messy).collect()}
    assert got == removed_lines([(r[0], r[1]) for r in corpus])
    cleaned = line_dedup.clean(clashing)
    assert cleaned.columns == clashing.columns and cleaned.count() == len(corpus)
    assert {r.text.split("\n")[0] for r in cleaned.where("doc_id = 14").collect()} == {"line one is here and lang"}
    assert line_dedup.clean(nothing).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base * 3, base + rng.normal(size=base.shape) * 0.12])
    label = rng.integers(0, 3, len(x))
    rows = [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    got = {r.vec_id: r for r in pivots.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    y = np.array([r[1] for r in rows], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = [(i, j) for i in range(len(y)) for j in range(i) if label[i] == label[j] and y[i] @ y[j] >= 0.98]
    found = sum(got[i].n_links for i in got) / 2
    assert len(linked) > 40 and found <= len(linked) and found >= 0.9 * len(linked)
    if found == len(linked):
        assert {i: r.component_id for i, r in got.items()} == groups_of(range(len(y)), linked)


@pytest.mark.parametrize("rows", [10_000, 10**7, 4 * 10**8])
def test_pivots_grow_and_keep_recall(spark, rows, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    near = 0.9805 * base + np.sqrt(1 - 0.9805**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    far = 0.975 * base + np.sqrt(1 - 0.975**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    vectors = np.concatenate([base, near, -far])
    count = pivots.pivots_for(rows)
    assert count == {10_000: 64, 10**7: 297, 4 * 10**8: 1015}[rows]
    monkeypatch.setattr(pivots, "pivots_for", lambda _: count)
    table = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in pivots.join(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    linked = sum(got[i].n_links == 1 and got[i + 400].component_id == i for i in range(400))
    assert linked >= 0.98 * 400 and all(got[i].n_links == 0 for i in range(800, 1200))


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 1), (2, b, 1), (2, a, 1), (3, b, 1), (3, b, 1), (4, c, 1), (4, c, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (3, 1, 2, False), (4, 0, 4, True), (4, 0, 4, True)]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    one, other = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(0, one, 1), (1, other, 1), (2, one, 2), (3, one, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [nan, 2.0, 3.0], 1), (7, [inf, 2.0, 3.0], 1), (8, [None, 2.0, 3.0], 1), (9, [], 1), (10, [1.0, 2.0], 1), (0, one, 1), (None, one, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit(1), "triple": F.lit(2)})
    got = pivots.join(frame).collect()
    assert len(got) == len(rows)
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert links[0] == (1, 0, True) and links[1] == (1, 0, False) and links[None] == (None, None, True)
    assert all(links[i] == (0, i, True) for i in range(2, 11))
    assert pivots.join(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 10])
def test_whole_groups_over_batches(size):
    import pyarrow as pa

    table = pa.table({"k": sorted([1, 1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]), "t": ["x"] * 12})
    got = [t["k"].to_pylist() for t, _ in blocks.whole_groups(iter(table.to_batches(max_chunksize=size)), ["k"])]
    assert sum(got, []) == table["k"].to_pylist()
    for a, b in zip(got, got[1:], strict=False):
        assert not set(a) & set(b)
