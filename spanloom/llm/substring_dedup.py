"""Removal of passages that occur more than once, by suffix automata of reference shards and matching statistics.

A window of 35 words goes if its words also begin anywhere else in the corpus. Every document is reference and stream at
once, so sending an automaton of each shard to all documents would grow with the square of the corpus. Instead each
stretch of a document goes to the one shard that can hold its windows: a window's anchor is its first run of eight words of
least hash, equal windows have equal anchors, and consecutive windows around one form a passage of at most 62 words.
Passages whose anchor occurs once anywhere can't repeat. Of the others equal ones are folded, with their number, and
what remains is the reference, cut by anchors into shards of bounded size. A shard's generalised suffix automaton knows for
each of its states how often it occurs in the corpus; the matching statistic of a place is the length of the longest
match that ends there and occurs more than once. Where it reaches 35, the window repeats. Decisions go back to all places
of a folded passage, and the words that they cover are removed.

An anchor with more distinct passages than a shard takes is dealt on by whole windows, so no shard grows with a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.skew import look_up
from spanloom.llm.store import materialise
from spanloom.llm.words import mix, pieces

#: Words of a window, and of the run in it that decides its shard.
WINDOW, ANCHOR = 35, 8
#: Windows of a passage at most: the places that an anchor has in a window.
MOST = WINDOW - ANCHOR + 1
#: Words of a shard's automaton, and distinct passages of an anchor beyond which its windows are dealt by themselves.
SHARD_WORDS, MOST_PASSAGES = 100_000, 1_000
#: Runs of words that go, of two numbers each, up to which their table is broadcast.
BROADCAST_RUNS = 400_000
#: Bytes of text that are worked on at once, and bytes of a word's hash that are shuffled.
PIECE_BYTES, WORD_BYTES = 4_000_000, 6
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEYS = ["k1", "k2"]


class SuffixAutomaton:
    """Of several strings of words, each with the number of its copies."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings of ``q`` that are no longer than those of ``p`` and a word."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        after, link = self.next, self.link
        while p >= 0 and after[p].get(word) == q:
            after[p][word] = new
            p = link[p]
        return new

    def add(self, words: list[int], copies: int) -> list[int]:
        """Take in a string; the state of each of its beginnings, as long as nothing more is added."""
        after, link, length, count = self.next, self.link, self.length, self.count
        last, states = 0, []
        for word in words:
            p, q = last, after[last].get(word)
            if q is not None:
                last = self._split(p, word, q)
            else:
                last = self._state(length[p] + 1, 0, {})
                while p >= 0 and (q := after[p].get(word)) is None:
                    after[p][word] = last
                    p = link[p]
                if p >= 0:
                    link[last] = self._split(p, word, q)
            count[last] += copies
            states.append(last)
        return states

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all states: link, length, and how often their strings occur."""
        link, length, count = (np.array(x, np.int64) for x in (self.link, self.length, self.count))
        order = np.argsort(length, kind="stable")
        ends = np.searchsorted(length[order], np.arange(int(length.max()) + 2))
        for k in range(len(ends) - 2, 0, -1):
            some = order[ends[k] : ends[k + 1]]
            np.add.at(count, link[some], count[some])
        return link, length, count


def statistics(passages: list[list[int]], copies: list[int]) -> list[np.ndarray]:
    """For each place of each passage the length of the longest match that ends there and occurs more than once."""
    automaton = SuffixAutomaton()
    states = [automaton.add(p, n) for p, n in zip(passages, copies, strict=True)]
    link, length, count = automaton.closed()
    count[0] = 2  # the empty match
    at = np.fromiter((s for some in states for s in some), np.int64, sum(map(len, states)))
    within = np.concatenate([np.arange(1, len(p) + 1) for p in passages])
    while (rare := count[at] < 2).any():
        at[rare] = link[at[rare]]
    return np.split(np.minimum(length[at], within), np.cumsum([len(p) for p in passages])[:-1])


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts with what tells rows apart: k1 and k2 are equal for rows that repeat both doc_id and text."""
    key = F.col(f"`{doc_id}`").cast("long")
    own: Column = F.col(f"`{text}`")
    return docs.select(F.coalesce(key, F.lit(0)).alias("k1"), F.xxhash64(own, key).alias("k2"), own.alias("text"))


#: The bytes that part words, none of which stands inside a longer UTF-8 sequence, and what cuts eight bytes down to fewer.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """The words of a row of texts, found in their bytes: first byte and one behind the last of each, and where each text's words begin."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        solid = ~WHITE[self.data]
        edge = np.zeros(len(solid) + 1, bool)  # a text's first byte begins a word, whatever stood before it
        edge[offsets - offsets[0]] = True
        before, after = np.append(True, ~solid), np.append(~solid, True)
        self.first = np.flatnonzero(solid & (before[:-1] | edge[:-1]))
        self.last = np.flatnonzero(solid & (after[1:] | edge[1:])) + 1
        self.starts = np.searchsorted(self.first, offsets - offsets[0])

    def prints(self) -> np.ndarray:
        """A 64-bit hash of each word, from its length and eight of its bytes at a time."""
        size = self.last - self.first
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        out = mix(size.astype(np.uint64) * BASE)
        some, at = np.arange(len(size)), self.first
        while some.size:
            part = eight[at] & BYTE_MASKS[np.minimum(size, 8)]
            out[some] = mix((out[some] ^ part) * BASE + np.uint64(1))
            longer = size > 8
            some, at, size = some[longer], at[longer] + 8, size[longer] - 8
        return out

    def joined(self, stay: np.ndarray) -> pa.Array:
        """Each text's words that stay, with one space between."""
        text = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[stay]
        first, size = self.first[stay], (self.last - self.first)[stay] + 1  # with a space behind
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        out = self.data[np.minimum(at, max(0, len(self.data) - 1))] if len(ends) else np.zeros(0, np.uint8)
        out[ends - 1] = ord(" ")
        final = np.append(text[1:] != text[:-1], True)[: len(text)]  # a text's last word has no space behind
        keep = np.ones(len(out), bool)
        keep[ends[final] - 1] = False
        sizes = np.bincount(text, size, minlength=len(self.starts) - 1).astype(np.int64)
        sizes -= sizes > 0
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out[keep])])


class Prints:
    """Hashes of any runs of a row of numbers, from sums up to each place."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + np.uint64(1)) * np.cumprod(np.full(len(words), BASE)), out=self.sums[1:])
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(words), INVERSE))])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``width`` values in a row, and its first place."""
    out, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left = out[:-step] <= out[step:]
        out, at = np.where(left, out[:-step], out[step:]), np.where(left, at[:-step], at[step:])
        span += step
    return out, at


def cut(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The passages of all texts in a row: text, place of the first word, windows, anchor and hash of each."""
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, none, none
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    prints = Prints(words)
    at = np.arange(len(words) - ANCHOR + 1)
    anchor, place = sliding_least(prints(at, at + ANCHOR), MOST)
    windows = np.flatnonzero(doc[: len(anchor)] == doc[WINDOW - 1 :])  # those of one text
    new = np.append(True, (np.diff(place[windows]) != 0) | (np.diff(windows) != 1))[: len(windows)]
    begin = windows[new]
    size = np.diff(np.append(np.flatnonzero(new), len(windows)))
    return doc[begin], begin - starts[doc[begin]], size, anchor[begin].view(np.int64), prints(begin, begin + size + WINDOW - 1).view(np.int64)


def passages(rows: DataFrame) -> DataFrame:
    """(k1, k2, first, size, anchor, print) of all passages of whole texts; texts under 35 words have none."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", PIECE_BYTES):
                found = Words(texts)
                doc, first, size, anchor, name = cut(found.prints(), found.starts)
                keys = [part.column(k).take(pa.array(doc)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor), pa.array(name)], ["k1", "k2", "first", "size", "anchor", "print"])

    return rows.mapInArrow(cut_up, "k1 long, k2 long, first int, size int, anchor long, print long")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with places of passages in them: (anchor, print, n, several, words)."""
    for batch in batches:
        for part, texts in pieces(batch, "text", PIECE_BYTES):
            found = Words(texts)
            words, starts = found.prints(), found.starts
            lists = part.column(part.schema.get_field_index("places"))
            wanted = lists.flatten()
            doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
            get = {k: wanted.field(k) for k in ("first", "size", "anchor", "print", "n", "several")}
            size = get["size"].to_numpy().astype(np.int64) + WINDOW - 1
            first = starts[doc] + get["first"].to_numpy()
            for k in range(0, len(size), 20_000):
                begin, length = first[k : k + 20_000], size[k : k + 20_000]
                ends = np.cumsum(length)
                at = np.repeat(begin - (ends - length), length) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays([*(get[c].slice(k, 20_000) for c in ("anchor", "print", "n", "several")), binary(words[at], ends)], ["anchor", "print", "n", "several", "words"])


def binary(words: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of word hashes, cut to ``WORD_BYTES`` each; ``ends`` says where each row's end."""
    parts = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
    offsets = np.concatenate([[0], ends * WORD_BYTES]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts))])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a binary column, and where each row's begin."""
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    parts = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]].reshape(-1, WORD_BYTES)
    whole = np.zeros((len(parts), 8), np.uint8)
    whole[:, :WORD_BYTES] = parts
    return whole.view("<u8").ravel(), (starts - starts[0]) // WORD_BYTES


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From distinct passages (anchor, print, n, words), sorted: (anchor, print, hits), bit k set if window k repeats.

    A shard takes whole anchors, as many as come to ``SHARD_WORDS``; one row may come twice.
    """
    names: list[tuple[int, int]] = []
    copies: list[int] = []
    held: list[np.ndarray] = []
    size = 0

    def finished() -> pa.RecordBatch:
        lens = [len(h) for h in held]
        _, codes = np.unique(np.concatenate(held), return_inverse=True)
        found = statistics([c.tolist() for c in np.split(codes, np.cumsum(lens)[:-1])], copies)
        hits = [int(((f[WINDOW - 1 :] >= WINDOW).astype(np.int64) << np.arange(len(f) - WINDOW + 1)).sum()) for f in found]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.int64()), pa.array([p for _, p in names], pa.int64()), pa.array(hits, pa.int32())], ["anchor", "print", "hits"])

    for batch in batches:
        words, starts = words_of(batch.column(3))
        for k, (anchor, name, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if names and names[-1] == (anchor, name):
                continue
            if size >= SHARD_WORDS and names[-1][0] != anchor:
                yield finished()
                names, copies, held, size = [], [], [], 0
            names.append((anchor, name))
            copies.append(n)
            held.append(words[starts[k] : starts[k + 1]])
            size += len(held[-1])
    if names:
        yield finished()


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of passages: (anchor, print, nth, n, window, words)."""
    for batch in batches:
        words, starts = words_of(batch.column(3))
        size = np.diff(starts) - WINDOW + 1
        row = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        first = starts[row] + nth
        names = Prints(words)(first, first + WINDOW).view(np.int64)
        keep = [batch.column(c).take(pa.array(row)) for c in range(3)]
        held = binary(words[(first[:, None] + np.arange(WINDOW)).ravel()], np.arange(1, len(first) + 1) * WINDOW)
        yield pa.RecordBatch.from_arrays([keep[0], keep[1], pa.array(nth.astype(np.int32)), keep[2], pa.array(names), held], ["anchor", "print", "nth", "n", "window", "words"])


def decide(distinct: DataFrame) -> DataFrame:
    """(anchor, print, hits) of passages (anchor, print, n, words), all of one anchor in one task."""
    rows = distinct.select("anchor", "print", "n", "words")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "print").mapInArrow(matched, "anchor long, print long, hits int")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, firsts, lasts): for each text with repeated windows the runs of words, last excluded, that they cover."""
    rows = rows_of(docs, doc_id, text).where("text IS NOT NULL")
    found = materialise(passages(rows), "passages")
    anchors = materialise(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    found = materialise(look_up(found, anchors.select("anchor"), ["anchor"], anchors), "repeated")
    folded = materialise(found.groupBy("anchor", "print").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "size")).alias("place")), "folded")
    several = folded.groupBy("anchor").agg(F.count("*").alias("several"))
    known = look_up(folded, several, ["anchor"], several.withColumnRenamed("several", "n"))
    known = known.select("place.*", F.struct("place.first", "place.size", "anchor", "print", "n", "several").alias("at"))
    places = materialise(known.groupBy(*KEYS).agg(F.collect_list("at").alias("places")), "places")
    kinds = "anchor long, print long, n long, several long, words binary"
    distinct = materialise(rows.join(places, KEYS).mapInArrow(gathered, kinds), "reference")  # rows that repeat a text give its passages again
    many = distinct.where(F.col("several") > MOST_PASSAGES).dropDuplicates(["anchor", "print"])
    decided = decide(distinct.where(F.col("several") <= MOST_PASSAGES))
    if not many.isEmpty():
        single = materialise(many.select("anchor", "print", "n", "words").mapInArrow(windows, "anchor long, print long, nth int, n long, window long, words binary"), "windows")
        each = single.groupBy("window").agg(F.sum("n").alias("n"), F.any_value("words").alias("words"))
        yes = decide(each.select(F.col("window").alias("anchor"), F.col("window").alias("print"), "n", "words")).where("hits > 0").select(F.col("anchor").alias("window"))
        places_of = single.select("anchor", "print", "nth", "window")
        hit = look_up(places_of, materialise(yes, "hits"), ["window"], places_of.groupBy("window").agg(F.count("*").alias("n")))
        decided = decided.unionByName(hit.groupBy("anchor", "print").agg(F.bit_or(F.expr("shiftleft(1, nth)")).alias("hits")))
    decided = materialise(decided.where("hits <> 0"), "decided")
    counts = folded.select("anchor", "print", "n")
    covered = look_up(found.select(*KEYS, "first", "anchor", "print"), decided, ["anchor", "print"], counts)
    lists = covered.groupBy(*KEYS).agg(F.collect_set(F.struct("first", "hits")).alias("hits"))
    return materialise(lists.mapInArrow(merged, "k1 long, k2 long, firsts array<int>, lasts array<int>"), "covered")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From places and bits of repeated windows of each text the runs of words that they cover."""
    for batch in batches:
        lists = batch.column(2)
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        each = lists.flatten()
        first, hits = each.field("first").to_numpy().astype(np.int64), each.field("hits").to_numpy()
        row, bit = np.nonzero(hits[:, None] >> np.arange(MOST) & 1)
        begin = first[row] + bit
        far = int(begin.max()) + 2 * WINDOW if len(begin) else 1
        begin = np.unique(doc[row] * far + begin)
        new = np.append(True, np.diff(begin) > WINDOW)
        at = begin[new]
        stop = np.append(begin[:-1][new[1:]], begin[-1]) + WINDOW
        where = np.searchsorted(at // far, np.arange(len(lists) + 1)).astype(np.int32)
        spans = [pa.ListArray.from_arrays(where, (x % far).astype(np.int32)) for x in (at, stop)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *spans], ["k1", "k2", "firsts", "lasts"])


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept, firsts, lasts.

    Words are runs of characters other than ASCII white space, unchanged. Each word goes that is covered by a window of 35
    words of one text whose words also begin anywhere else in the corpus as it stands, the same text included;
    ``kept`` has the others, joined by one space, ``firsts`` and ``lasts`` the runs of words that go, last excluded.

    Rows that repeat doc_id and text are texts of their own, so all their windows repeat. Null, empty and blank texts
    have no word, those under 35 words no window; texts of any length are worked on whole. A null doc_id is no
    reason to pass a text over. An empty table gives an empty one. Other columns are not looked at.
    """
    spans = repeats(docs, doc_id, text)
    n = spans.agg(F.coalesce(F.sum(F.size("firsts")), F.lit(0))).first()[0]
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keyed = given.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    joined = keyed.join(F.broadcast(spans) if n <= BROADCAST_RUNS else spans, KEYS, "left").select("doc_id", "text", "firsts", "lasts")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", PIECE_BYTES):
                found = Words(texts)
                starts = found.starts
                lists = [part.column(k) for k in (2, 3)]
                doc = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy())
                edge = np.zeros(len(found.first) + 1, np.int64)
                for values, step in zip(lists, (1, -1), strict=True):
                    np.add.at(edge, starts[doc] + values.flatten().to_numpy(), step)
                gone = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                n_words, n_removed = np.diff(starts), np.diff(gone[starts])
                out = [part.column(0), pa.array(n_words), pa.array(n_removed), found.joined(np.diff(gone) == 0).cast(pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept", "firsts", "lasts"])

    return joined.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string, firsts array<int>, lasts array<int>")


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated windows removed from all ``documents``."""
    found = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as lists of words; a window repeats if there is another with equal words.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS name FROM w),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY name) AS n FROM h) WHERE n > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM rep),
gone AS (SELECT r, list(k) AS ks FROM cov GROUP BY r),
each AS (SELECT d.r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
stay AS (SELECT each.r, string_agg(word, ' ' ORDER BY k) AS kept FROM each LEFT JOIN cov USING (r, k) WHERE cov.k IS NULL GROUP BY each.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN stay USING (r)
"""
