"""Ranked search, substring dedup and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import prefix_trie, queries, ranked_search, substring_dedup

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con(small):
    made = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_substring_dedup", "op13_prefix_trie"])
def test_queries_give_the_rows_of_their_sql(spark, con, small, name):
    frame = queries.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r)) for r in frame.select(*columns).collect())
    found = con.sql(queries.ORACLES[name])
    at = [list(found.columns).index(c) for c in columns]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def plain_search(docs, items, top):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df, tfs = Counter(t for ts in terms for t in set(ts)), list(map(Counter, terms))
    out = []
    for item_id, text in items:
        scores = []
        wanted = set(TERM.findall((text or "").translate(LOWER)))
        for (doc_id, _), ts, tf in zip(docs, terms, tfs, strict=True):
            m = 100 - 50 + (50 * len(ts) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if t in tf)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top])]
    return sorted(map(str, out))


def test_search_over_many_shards(spark, messy, corpus, nothing, clashing, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "x9", "NBSP "]
    docs = [(i, " -.".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(0, 80)))) for i in range(300)] + [r[:2] for r in corpus]
    items = [(k, " ".join(rng.sample(words, rng.randrange(1, 25)))) for k in range(30)] + [(3, "w1 W1 w2"), (None, "w5"), (31, None), (32, "--"), (33, "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items, 7)
    assert sorted(str(tuple(r)) for r in ranked_search.search(ranked_search.index(frame), asked, top=7).collect()) == want
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 600)  # several passes
    assert sorted(str(tuple(r)) for r in ranked_search.search(ranked_search.index(frame), asked, top=7).collect()) == want
    got = ranked_search.search(ranked_search.index(clashing), asked).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_search([r[:2] for r in corpus], items, 50)
    empty = ranked_search.search(ranked_search.index(nothing), asked)
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0
    assert ranked_search.search(ranked_search.index(messy), asked.limit(0)).count() == 0


def test_shards_and_pruning_lose_nothing():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for i in range(400)]
    items = [(k, " ".join(rng.sample(words, rng.randrange(1, 12)))) for k in range(40)]
    block = ranked_search.Queries([i for i, _ in items], [t for _, t in items])
    names = [c.split()[0] for c in ranked_search.SHARD.split(", ")]
    rows = [dict(zip(names, ranked_search.shard(pa.array([i for i, _ in some]), pa.array([t for _, t in some])), strict=True)) for some in (docs[:30], docs[30:31], docs[31:250], docs[250:])]
    df = np.zeros(len(block.terms), np.int64)
    for row in rows:
        terms, dfs = ranked_search.unpacked(row["terms"]), ranked_search.unpacked(row["dfs"])
        for t, n in zip(terms, dfs, strict=True):
            df[block.terms == t] += n
    n_docs, n_terms = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    task = ranked_search.Search(block.terms, block.own, ranked_search.weights(len(df), n_docs, df), n_docs, n_terms, 5)
    for row in rows:
        task.add(row)
    found = task.results()
    ranks = Counter()
    got = []
    for q, doc_id, score in zip(*(c.to_pylist() for c in found.columns), strict=True):
        ranks[q] += 1
        got.append(str((items[q][0], ranks[q], doc_id, score)))
    assert sorted(got) == plain_search(docs, items, 5)


def test_maxscore_probes_only_what_may_qualify():
    lists = [(np.array([0, 1, 2, 3]), np.array([1, 2, 1, 2])), (np.array([1, 5]), np.array([3, 3])), (np.array([2, 7]), np.array([10, 9]))]
    at, score = ranked_search.maxscore(lists, 11, 8)
    assert (at.tolist(), score.tolist()) == ([2], [11])
    at, score = ranked_search.maxscore(lists, 1, 8)
    assert dict(zip(at.tolist(), score.tolist(), strict=True)) == {0: 1, 1: 5, 2: 11, 3: 2, 5: 3, 7: 9}


def plain_removal(texts):
    docs = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    seen = Counter(tuple(d[i : i + 35]) for d in docs for i in range(len(d) - 34))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - 34):
            if seen[tuple(d[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = [w for k, w in enumerate(d) if k not in gone]
        out.append((len(d), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeating():
    """Shared passages around the least length, near copies, a text that repeats itself, periods, a phrase in many texts."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(500)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [some(n) for n in (33, 34, 35, 36, 80)]
    texts = []
    for k in range(40):
        passage = shared[k % 5]
        texts.append(" ".join([*some(rng.randrange(0, 60)), *passage, *some(rng.randrange(0, 60))]))
    base = some(300)
    for _ in range(12):
        other = list(base)
        for _ in range(rng.randrange(0, 4)):
            other[rng.randrange(300)] = rng.choice(words)
        texts.append("  \n".join(other))
    once = some(50)
    texts += [" ".join([*once, *some(10), *once]), "a " * 200, "b " * 35, "c " * 36, "d e " * 60, " ".join(some(34)), "non breaking " * 20, "x\x1cy " * 40, "", None, " \t "]
    phrase = some(12)
    texts += [" ".join([*some(30), *phrase, *some(30)]) for _ in range(60)]
    tail = some(34)
    texts += [" ".join([f"head{k % 20}", *tail]) for k in range(30)]
    return texts


@pytest.mark.parametrize("most, shard", [(1_000, 100_000), (3, 200)])
def test_removal_matches_counting_all_windows(spark, repeating, monkeypatch, most, shard):
    monkeypatch.setattr(substring_dedup, "MOST_PASSAGES", most)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "BROADCAST_RUNS", 0 if most == 3 else 1000)
    want = plain_removal(repeating)
    frame = spark.createDataFrame(list(enumerate(repeating)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.remove(frame).collect()}
    for k, (n_words, n_removed, sha) in enumerate(want):
        assert (got[k].n_words, got[k].n_removed, hashlib.sha256(got[k].kept.encode()).hexdigest()) == (n_words, n_removed, sha), k
        assert sum(b - a for a, b in zip(got[k].firsts or [], got[k].lasts or [], strict=True)) == n_removed
    assert sum(n > 0 for _, n, _ in want) > 50


def test_removal_edges(spark, messy, corpus, nothing, clashing):
    want = sorted(zip([str(r[0]) for r in corpus], plain_removal([r[1] for r in corpus]), strict=True))
    for frame in (messy, clashing):
        got = [(str(r.doc_id), (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest())) for r in substring_dedup.remove(frame).collect()]
        assert sorted(got) == want
    assert substring_dedup.remove(nothing).count() == 0


def test_automaton_counts_every_string():
    rng = random.Random(8)
    for _ in range(60):
        passages = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 6))]
        copies = [rng.randrange(1, 3) for _ in passages]
        seen = Counter()
        for p, n in zip(passages, copies, strict=True):
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    seen[tuple(p[i:j])] += n
        for p, found in zip(passages, substring_dedup.statistics(passages, copies), strict=True):
            assert found.tolist() == [max((k for k in range(1, j + 1) if seen[tuple(p[j - k : j])] > 1), default=0) for j in range(1, len(p) + 1)]


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, name, (role, text)))
    convs = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children.update(n[:-1] for n in members if n)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in members[node] if len(rebuilt[c]) == len(node)).encode()).hexdigest()
    return sorted(str((of[0], len(n), members[n[:-1]][0] if n else None, len(of), children[n], leaves[n], saved[n], sha(n))) for n, of in members.items())


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_rows(frame):
    return sorted(str(tuple(r)) for r in prefix_trie.trie(*prefix_trie.rebuilt(frame)).select(*COLUMNS).collect())


def test_trie_matches_plain_prefixes(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 12), 100, 101, 205, 206, 300, -5, -130, 10**15]:
        n = rng.choice([0, 1, 2, 5, 9]) if c != 100 else 150
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello é日", "so"])) for t in range(n + 1)]
    long = [("user", f"t{k % 7}") for k in range(150)]
    for c, cut in ((500, 150), (501, 140), (502, 64), (503, 65), (504, 128)):  # long ones that share their beginnings
        rows += [(c, t, *long[t]) for t in range(cut)]
    rows += [(7, 1, "user", "hi"), (7, 1, "user", "hi"), (8, None, None, None), (8, None, "user", ""), (8, 1, "a", "b"), (None, 1, "user", "lost"), (9, 3, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain_trie(rows)
    assert trie_rows(frame) == want
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PACK", 2)
    assert trie_rows(frame) == want


def test_trie_edges(spark):
    from pyspark.sql import functions as F

    schema = "conv_id long, turn long, role string, text string"
    assert trie_rows(spark.createDataFrame([], schema)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b")], schema)) == []
    rows = [(c, 0, "user", "same") for c in range(1, 40)]  # all begin and end alike; conversation 0 isn't there
    clashing = spark.createDataFrame(rows, schema).withColumns({k: F.lit(1) for k in "conv pos dig part n depth parent chars up h total".split()})
    assert trie_rows(clashing) == plain_trie(rows)
