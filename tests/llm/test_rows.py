"""Operators on single rows and files: token counts, mixing, shards, language, quality, WARC, decontamination."""

import random
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam, html_pass, langid, mixing, quality, sstable, store, token_counts, warc, words

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_piece_counts_equal_the_library(spark, messy, corpus, nothing, clashing):
    from tokenizers import models

    initial, inner = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    automaton = token_counts.PieceAutomaton(initial, inner)
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys([*initial, *("\x01" + p for p in inner), "[UNK]"]))}
    model = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6, continuing_subword_prefix="\x01")
    rng = random.Random(1)
    some = ["hello", "unbelievable", "xqzjk", "日本", "é", "##a", "a" * 300, "12.5%"] + ["".join(rng.choice("abcdehilnorst.,'-") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for word in some:
        pieces = [t.value for t in model.tokenize(word)]
        assert automaton.count(word) == (-1 if pieces == ["[UNK]"] else len(pieces)), word
    got = token_counts.count_tokens(clashing, automaton).select("text", "n_words", "n_tokens", "n_unknown").collect()
    assert len(got) == len(corpus)
    for r in got:
        each = [automaton.count(w) for w in pa.compute.utf8_split_whitespace(pa.scalar(r.text or "")).as_py() if w]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(1 if x < 0 else x for x in each), sum(x < 0 for x in each))
    assert token_counts.count_tokens(nothing, automaton).count() == 0


def test_small_automaton_by_hand():
    automaton = token_counts.PieceAutomaton(["a", "abcdx"], ["b", "c", "cdy", "dz"])
    assert [automaton.count(w) for w in ("abcdz", "abcdx", "abcdy", "abcd", "a", "x", "")] == [4, 1, 3, -1, 1, -1, -1]


def test_words_behind_a_bare_mark_are_not_unknown(small):
    import pyarrow.parquet as pq
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    every = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    most = max(map(len, every))

    def greedy(word):
        rest, n = "▁" + word, 0
        while rest:
            k = next((k for k in range(min(most, len(rest)), 0, -1) if rest[:k] in every), None)
            if k is None:
                return -1
            rest, n = rest[k:], n + 1
        return n

    automaton = token_counts.PieceAutomaton(*token_counts.sentencepiece_vocabulary(path), token_counts.has_bare_mark(path))
    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"]).column(0).to_pylist()
    words = {w for t in texts if t for w in t.split() if "▁" not in w} | {"日本", "éé", "日", "x日y", "\U000f0000", "a\U000f0000"}
    assert {w: automaton.count(w) for w in words} == {w: greedy(w) for w in words}
    assert automaton.count("日") == 2 and automaton.count("\U000f0000") == -1


def test_mixing_equals_sql_and_handles_edges(spark, small, messy, corpus, nothing, clashing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted((r.doc_id, r.copy, r.shuffle_key) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert got == sorted((r[0], r[1], r[2]) for r in con.sql(f"SELECT doc_id, copy, shuffle_key FROM ({mixing.ORACLE})").fetchall())
    whole = mixing.mix(clashing, budget=3.0)
    assert whole.columns == [*(c for c in clashing.columns if c not in ("copy", "shuffle_key")), "copy", "shuffle_key"]
    assert mixing.mix(nothing).count() == 0
    none = spark.createDataFrame([("a", -1.0), ("zz", 5.0)], "source string, weight double")
    assert mixing.mix(messy, weights=none).count() == 0
    only = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(messy, weights=only, budget=5.0).collect()} == {"a", None}


def test_mixing_reaches_weights_and_salts(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix(rows, weights=weights).groupBy("source").count().collect()}
    assert abs(counts["small"] - 15_000) < 600 and abs(counts["big"] - 5_000) < 400
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert {r.source: r["count"] for r in mixing.mix(rows, weights=weights).groupBy("source").count().collect()} == counts
    many = mixing.mix(rows.limit(50), weights=weights, budget=900.0)  # means beyond one draw
    assert abs(many.count() - 45_000) < 1_200


def test_encoder_equals_the_library(corpus):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTE_BPE), sstable.Encoder(BYTE_BPE)
    rng = random.Random(5)
    odd = ["", None, " a", "a ", "  a  b", "a \n b", "x\n\ny z", "it's  don't 12 34\t5", "a<|endoftext|> b <|endoftext|>", "é à  ", "日本 語 x", "a\x1c b \x1cc", "\n", " ", "foo   bar", "a b", "a   b", "a\x85b c"]
    odd += ["".join(rng.choice(" \n\tab.,'1é") for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    texts = [*odd, *(r[1] for r in corpus)]
    ids, starts = own.encode(pa.array(texts, pa.large_string()).fill_null(""))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:60]


def test_shards_round_trip(spark, messy, corpus, nothing, clashing, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(sstable, "SHARD_BYTES", 2000)
    library = Tokenizer.from_file(BYTE_BPE)
    path = store.scratch_path(spark, "test-shards")
    sstable.write(clashing, path, BYTE_BPE, end_id=2)
    rows = sorted(((r[0], r[1] or "") for r in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in sstable.digest(spark, path).orderBy("start").collect()]
    assert got == expected
    back = sstable.read(spark, path).orderBy("part", "shard", "row").collect()
    assert [r.doc_id for r in back] == [r[0] for r in rows]
    assert back[-1].ids == [*library.encode(rows[-1][1], add_special_tokens=False).ids, 2]
    empty = store.scratch_path(spark, "test-none")
    sstable.write(nothing, empty, BYTE_BPE, end_id=2)
    assert sstable.digest(spark, empty).count() == 0


def test_shard_lookup_and_damage():
    writer = sstable.ShardWriter(2)
    ids = [None, -5, 0, 3, 3, *range(10, 40_000, 7)]
    seen = {}
    for doc_id in ids:
        seen[doc_id] = seen.get(doc_id, -1) + 1
        writer.add(doc_id, seen[doc_id], np.arange(abs(doc_id or 0) % 50, dtype="<u2").tobytes())
    data = writer.finish() + b"\n"
    shard = sstable.Shard(data)
    assert [d for d, _ in shard] == ids and len(shard.blocks) > 2
    assert len(shard.get(3)) == 2 and len(shard.get(None)) == 1 and shard.get(11) == [] and shard.get(10**9) == []
    assert shard.get(24)[0].tolist() == list(range(24))
    false = sum(shard.may_hold(x) for x in range(11, 40_000, 7)) / 5713
    assert false < 0.03
    for at in (10, len(data) // 2, len(data) - 30):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(Exception):  # noqa: B017
            list(sstable.Shard(broken))


def test_language(spark, messy, corpus, nothing, clashing, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    assert sorted(profiles) == ["de", "en", "es", "fr"] and all(len(p) == len(set(p)) <= langid.PROFILE_SIZE for p in profiles.values())
    scored = langid.identify(docs.where(langid.held_out()), profiles)
    assert scored.where("lang = lang_pred").count() >= 0.97 * scored.count()
    got = langid.identify(clashing, profiles)
    assert got.columns == [*(c for c in clashing.columns if c != "lang_pred"), "lang_pred", "lang_score"]
    by_text = {r.text: (r.lang_pred, r.lang_score) for r in got.collect()}
    assert all(by_text[t] == ("und", 0.0) for t in (None, "", "   \n ", "123 $$$ 456"))
    assert all(0 <= s <= 1 for _, s in by_text.values())
    assert langid.learn_profiles(nothing) == {} and {r.lang_pred for r in langid.identify(messy, {}).collect()} == {"und"}
    assert langid.identify(nothing, profiles).count() == 0


def test_profile_against_counter(spark):
    from collections import Counter

    texts = ["Abc, ab! ÄB a", "abc abc x1y"]
    got = langid.learn_profiles(spark.createDataFrame([(t, "l") for t in texts], "text string, lang string"), size=12)["l"]
    grams = Counter()
    for t in texts:
        padded = "\x01".join(["", *"".join(c if c.isalpha() else " " for c in t.lower()).split(), ""])
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != "\x01" and "\x01" not in g[1:-1]:
                    grams[g] += 1
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert got == [key(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))[:12]]


def test_quality(spark, messy, corpus, nothing, clashing):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(*quality.training_rows(docs, labels.where(~quality.held_out()), "quality", "doc_id", "text", 1500))
    held = quality.score(docs.join(labels.where(quality.held_out()), "doc_id"), model)
    assert held.where((F.col("score") >= 0.3) == (F.col("quality") == 1)).count() >= 0.97 * held.count()
    got = quality.score(clashing, model).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0
    one_class = quality.fit([np.array([1, 2])] * 5, np.ones(5, bool))
    assert 0.5 < one_class.score(np.array([1])) < 1 and 0 <= quality.fit([], np.zeros(0, bool)).score(np.array([3])) <= 1
    assert quality.training_rows(nothing, labels, "quality", "doc_id", "text", 10)[0] == []


def test_quality_parts_equal_plain_versions(monkeypatch):
    """Ratios by counting, the hinge loss's optimum by projected gradient steps on the dual, the curve by its own derivative."""
    rng = np.random.default_rng(12)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 9))) for _ in range(50)]
    good = rng.random(50) < 0.5
    ratios = quality.log_count_ratios(rows, good)
    share = lambda side: [1 + sum(c in r for r, g in zip(rows, good, strict=True) if g == side) for c in range(30)]
    totals = [sum(share(side)) + quality.COLUMNS - 30 for side in (True, False)]
    for c in range(30):
        assert ratios[c] == pytest.approx(np.log((share(True)[c] / totals[0]) / (share(False)[c] / totals[1])))

    monkeypatch.setattr(quality, "PASSES", 3000)
    values = [rng.normal(size=len(r)) for r in rows]
    signs, costs = np.where(good, 1.0, -1.0), rng.uniform(0.2, 2, 50)
    weights, offset = quality.dual_coordinate_descent(rows, values, signs, costs)
    dense = np.zeros((50, 31))
    dense[:, 30] = 1  # the offset is a weight like the others
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        dense[k, r] = v
    loss = lambda w: w @ w / 2 + costs @ np.maximum(0, 1 - signs * (dense @ w))
    gram = (dense @ dense.T) * np.outer(signs, signs)
    alpha, step = np.zeros(50), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(50_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, costs)
    best = loss(dense.T @ (alpha * signs))
    assert loss(np.append(weights[:30], offset)) == pytest.approx(best, rel=2e-3) and not weights[30:].any()

    margins = rng.normal(size=200) + np.where(np.arange(200) < 90, 1.0, -0.5)
    yes = np.arange(200) < 90
    target = np.where(yes, 91 / 92, 1 / 112)
    cross = lambda a, b: -np.sum(target * np.log(1 / (1 + np.exp(-(a * margins + b)))) + (1 - target) * np.log(1 / (1 + np.exp(a * margins + b))))
    a, b = quality.calibrate(margins, yes)
    assert all(cross(a, b) <= cross(a + i, b + j) + 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_plain_search(spark, messy, corpus, nothing, clashing):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 9, 10, 15, 23, 40, 59, 80)]
    docs = []
    for _ in range(250):
        item = rng.choice(items).split()
        for _ in range(rng.randrange(0, len(item) // 5 + 3)):
            kind, at = rng.random(), rng.randrange(len(item))
            if kind < 0.33:
                item.insert(at, rng.choice(vocabulary))
            elif kind < 0.66 and len(item) > 1:
                del item[at]
            else:
                item[at] = rng.choice(vocabulary)
        docs.append(" ".join([*(rng.choice(vocabulary) for _ in range(rng.randrange(40))), *item, *(rng.choice(vocabulary) for _ in range(rng.randrange(40)))]))
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "a b c d"), (None, "a b c d e f")], "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(frame, benchmark).collect()}
    expected = {(i, k): d for i, t in enumerate(docs) for k, item in enumerate(items) if (d := plain_distance(item.split(), t.split())) <= len(item.split()) // 5}
    assert got == expected and len(got) > 100
    clean = {r.doc_id for r in decontam.decontaminate(frame, benchmark).collect()}
    assert clean == set(range(len(docs))) - {i for i, _ in expected}
    leak = spark.createDataFrame([(1, corpus[0][1])], "item_id long, text string")
    left = decontam.decontaminate(clashing, leak)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()}.isdisjoint({0, 1, 2, 3})
    assert left.where("doc_id IS NULL").count() == 1 and left.where("doc_id IN (7, 8, 9)").count() == 3
    assert decontam.decontaminate(messy, leak.limit(0)).count() == len(corpus) and decontam.matches(messy, leak.limit(0)).count() == 0
    assert decontam.matches(nothing, leak).count() == 0


@pytest.mark.parametrize("n", [5, 10, 25, 60, 150])
def test_walks_reach_recall_and_leave_unrelated_windows(n):
    rng = np.random.default_rng(n)
    count = decontam.walks_for(decontam.length_class(n))
    assert 0 < count <= decontam.MOST_WALKS
    found = passed = 0
    for _ in range(20):
        words = rng.integers(1, 2**63, n).astype(np.uint64)
        walks = decontam.Walks(words, count)
        near = np.concatenate([decontam.edited(words, int(n * decontam.TOLERANCE), rng) for _ in range(50)])
        far = rng.choice(np.append(words, rng.integers(1, 2**63, 49 * n).astype(np.uint64)), 50 * n)  # of fifty words, one is the item's
        first = np.arange(50) * n
        found += walks.agree(near, first, first, first + n).sum()
        passed += walks.agree(far, first, first, first + n).sum()
        assert walks.agree(words, np.zeros(1, int), np.zeros(1, int), np.full(1, n)).all()
    assert found >= 0.99 * 1000 and passed < 0.05 * 1000, (count, found, passed)


def test_items_beyond_the_walks_are_verified(monkeypatch):
    rng = np.random.default_rng(0)
    words = rng.integers(1, 2**63, 90).astype(np.uint64)
    items = [decontam.Item(1, words[:30]), decontam.Item(2, words[30:60])]
    texts = np.concatenate([words[60:75], decontam.edited(words[:30], 6, rng), words[75:], words[30:60]])
    starts = np.array([0, 50, len(texts)])
    n_walks = decontam.walks_for(decontam.length_class(30))
    assert decontam.walks_for(decontam.MOST_WORDS + 1) == 0
    got = [decontam.Matcher(items, {decontam.length_class(30): n}).find(texts, starts) for n in (n_walks, 0)]
    assert got[0] == got[1] and {r[1] for r in got[0]} == {1, 2}
    monkeypatch.setattr(decontam, "WALKS_AT_ONCE", 1)
    assert decontam.Matcher(items, {decontam.length_class(30): n_walks}).find(texts, starts) == got[0]


def test_items_come_in_blocks_of_bounded_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d e f{i} g h i j") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"c d e f{i} g h") for i in range(20)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.matches(docs, items).collect()))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 60)
    assert sorted(map(tuple, decontam.matches(docs, items).collect())) == whole and len(whole) == 600


def test_words_and_shingles():
    texts = pa.array(["A b  c\nd e f", "", "x", "  ", "a b c d e f"], pa.large_string())
    hashes, starts = words.word_hashes(texts)
    assert np.diff(starts).tolist() == [6, 0, 1, 0, 6] and (hashes[:6] == hashes[7:]).all()
    grams, at = words.shingles(hashes, starts)
    assert np.diff(at).tolist() == [2, 0, 1, 0, 2] and (grams[:2] == grams[3:]).all() and len(set(grams.tolist())) == 3


def test_warc_round_trip(spark):
    html = '<!DOCTYPE html><html><head><title>A &amp; b</title><style>x{}</style></head><body><nav><a href="/x">link</a></nav><p>One<br>two &lt;3</p><script>var t="</p>";</script><!-- no --><p>three</body></html>'
    rows = [(1, "http://a/é", html), (2, None, html), (3, "http://b", None), (4, "http://c", ""), (None, None, None), (5, "http://d\r\nX: y", "<p>\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "x" * 300_000), (1, "http://a/é", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    source, derived = store.scratch_path(spark, "test-warc"), store.scratch_path(spark, "test-derived")
    warc.write(warc.responses(pages), source)
    back = warc.read(spark, source).collect()
    assert len(back) == len(rows) and {r.type for r in back} == {"response"}
    for r in back:
        payload = warc.http_parts(r.block)[2]
        assert r.block_digest == warc.digest(r.block) and r.headers["WARC-Payload-Digest"] == warc.digest(payload)
    by_id = {r.record_id: r for r in back}
    warc.write(warc.derivatives(spark, source), derived)
    got = warc.read(spark, derived).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        origin = by_id[r.refers_to]
        assert r.target_uri == origin.target_uri and r.headers["X-Source-Payload-Digest"] == origin.headers["WARC-Payload-Digest"]
        assert r.block_digest == warc.digest(r.block) and r.headers.get("WARC-Date") == origin.headers["WARC-Date"]
    text = next(r.block.decode() for r in got if r.type == "conversion" and r.target_uri == "http://a/é")
    assert text == "link\nOne\ntwo <3\nthree"
    assert html_pass.read_page(html)[1:] == ("A & b", [{"path": "A@/href", "url": "/x"}])
    one_by_one = spark.read.format("binaryFile").load(source).where("length > 0").select("content").collect()
    for file in one_by_one:  # each record is a member of its own, between members of nothing
        member, rest, seen = zlib.decompressobj(31), bytes(file.content), []
        while rest:
            seen.append(member.decompress(rest))
            member, rest = zlib.decompressobj(31), member.unused_data
        assert seen[-1] == b"" and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in seen[:-1])
    empty = store.scratch_path(spark, "test-nowarc")
    warc.write(warc.responses(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


class PlainReader(HTMLParser):
    """Text, title and links by the standard library's parser, for pages whose elements are closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.open = [], [], None, []

    def handle_starttag(self, tag, attrs):
        names = dict(reversed(attrs))
        self.links += [{"path": f"{tag.upper()}@/{k}", "url": v.strip()} for k, v in dict.fromkeys((k, names[k]) for k, _ in attrs) if tag in html_pass.LINKING and k in ("href", "src") and v is not None]
        if tag in ("head", "script", "style", "title", "noscript", "template", "svg"):
            self.open.append(tag)
        if tag in html_pass.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.open:
            self.open.remove(tag)
        if tag in html_pass.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if "title" in self.open and "svg" not in self.open and self.title is None:
            self.title = " ".join(data.split())
        if not self.open:
            self.out.append(data)

    def read(self, html):
        self.feed(html)
        self.close()
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        return "\n".join(line for line in lines if line), self.title, self.links


def test_page_pass_equals_the_standard_parser(small):
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table(f"{small}/pages.parquet", columns=["html"]).column(0).to_pylist() if p]
    pages += ['<a title="a>b" href="/x">link</a>', "<p>don't <i x='1>2' src=a>stay</i><br/>x", "<svg><title>t</title>in</svg>out<noscript><p>no</p></noscript>", "<img src=a.png alt='<a href=no>'> 1 < 2 <3"]
    for page in pages:
        assert html_pass.read_page(page) == PlainReader().read(page), page


@pytest.mark.parametrize("unit", ["<a ", "<script>", "<!--", "<a title='", "<title>", "</", "<svg>", "<a href=", "<", "&", "<svg></head>", "a=<b c= "])
def test_page_pass_is_linear(unit):
    began = time.process_time()
    html_pass.read_page(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 1


def test_repeated_headers_and_damage():
    assert warc.by_name(warc.http_parts(b"HTTP/1.1 200 OK\r\nA: 1\r\nB: 2\r\nA: 3\r\n\r\nx")[1]) == {"A": ["1", "3"], "B": "2"}
    whole = warc.record([("X", "1"), ("X", "2")], b"abc") + warc.END.encode()
    assert list(warc.parse_records([whole[:7], whole[7:], whole])) == [({"X": "1, 2", "Content-Length": "3"}, b"abc")] * 2
    for cut in (9, len(whole) - 6):
        with pytest.raises(ValueError):
            list(warc.parse_records([whole[:cut]]))
    import gzip

    assert list(warc.parse_records(warc.inflated(gzip.compress(whole * 3)))) == list(warc.parse_records([whole])) * 3


def test_lookup_by_bloom_and_index(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 5)) for i in range(300)] + [(7, "other"), (None, "x")], "doc_id long, text string").repartition(3)
    path = store.scratch_path(spark, "test-lookup")
    sstable.write(docs, path, BYTE_BPE, end_id=2)
    every = sorted((r.doc_id is not None, r.doc_id, r.ids) for r in sstable.read(spark, path).collect())
    got = sorted((r.doc_id is not None, r.doc_id, r.ids) for r in sstable.lookup(spark, path, [7, None, 299, 1000]).collect())
    assert got == [x for x in every if x[1] in (7, None, 299)] and len(got) == 4
