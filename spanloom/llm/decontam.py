"""Benchmark decontamination: documents that hold a passage close to a benchmark item, by edit distance in words.

An item of n words is held by a document if some run of the document's words is within floor(n * tolerance)
insertions, deletions and replacements of words. Case and white space don't count.

How runs are found. An item within k edits has at least one of its k + 1 segments unchanged in the document
(pigeonhole), so only windows around an unchanged segment can qualify; the others are left out without loss.
Each such window, as long as the item, is embedded by CGK random walks, which turn few edits into a small
Hamming distance, and compared with the item's own embedding at a few sampled positions, none of them behind the
end of either walk. A walk whose sampled positions all agree makes the window a candidate. Walks are repeated as
often as the target recall needs, measured for each length of items. Candidates are verified by an exact
bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.words import mix, pieces, word_hashes

#: Edits allowed, as a share of the item's words: similarity of 0.8 or more.
TOLERANCE = 0.2
#: Share of windows at the very tolerance that the repeated walks must find.
TARGET_RECALL = 0.9999
#: Positions of the embedding that one walk samples, one from each equal part of it.
SAMPLED = 2
#: Bytes of items' texts that are shipped and matched at once; more are taken in further passes over the documents.
ITEM_BYTES = 32 << 20
#: Items that would need more walks, or have more words, aren't embedded: all their windows are verified.
MOST_WALKS, MOST_WORDS = 400, 1_000
#: Walks of windows that are taken at once.
WALKS_AT_ONCE = 1 << 20


class Item:
    """A benchmark item as word hashes, with its segments."""

    def __init__(self, item_id: int, words: np.ndarray):
        self.item_id, self.words, self.n = item_id, words, len(words)
        self.edits = int(self.n * TOLERANCE)
        bounds = np.linspace(0, self.n, self.edits + 2).astype(int)
        self.q = int(np.diff(bounds).min())
        self.seeds = bounds[:-1].tolist()


class Walks:
    """An item's CGK walks: for each of them the positions that it samples, and the item's words there.

    A walk reads the word at its place and then stays or moves on by one, as a random function of the walk, the step
    and the word says, so it is over after about twice as many steps as there are words. Positions are drawn before
    the end of the item's own walk.
    """

    def __init__(self, words: np.ndarray, count: int):
        self.n, self.count, self.first = len(words), count, 1
        each, at, read = np.arange(count), np.zeros(count, np.int64), []
        ends = np.full(count, -1)
        padded = np.append(words, np.uint64(0))
        while (ends < 0).any():
            here = padded[at]
            read.append(here)
            at = np.minimum(at + self.moves(here, len(read) - 1), self.n)
            ends[(at == self.n) & (ends < 0)] = len(read)
        share = np.random.default_rng([count, self.n]).random((count, SAMPLED))
        self.positions = ((np.arange(SAMPLED) + share) / SAMPLED * ends[:, None]).astype(np.int64)
        self.words = np.array(read)[self.positions, each[:, None]]
        order = np.argsort(self.positions, axis=None, kind="stable")
        due = self.positions.ravel()[order]
        self.due = [(t, *np.divmod(order[due == t], SAMPLED)) for t in np.unique(due).tolist()]

    def only(self, walk: int) -> Walks:
        """One of the walks by itself."""
        one = Walks.__new__(Walks)
        one.n, one.count, one.words, one.first = self.n, 1, self.words[[walk]], self.first + walk
        one.positions = self.positions[[walk]]
        one.due = [(t, np.zeros(1, int), np.array([j])) for t, j in sorted((int(t), j) for j, t in enumerate(one.positions[0]))]
        return one

    def moves(self, here: np.ndarray, step: int) -> np.ndarray:
        """Whether each walk (the last axis) moves on after it has read these words."""
        salts = mix(np.arange(self.first, self.first + self.count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
        return (mix(here ^ salts) & np.uint64(1)).astype(np.int64)

    def agree(self, words: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether some walk's samples agree, for the windows that begin at ``first`` of ``words``. What stands before
        ``lo`` or from ``hi`` on belongs to other texts, and agrees with nothing, like all behind a window's end."""
        out, size = [np.zeros(0, bool)], max(1, WALKS_AT_ONCE // self.count)
        for k in range(0, len(first), size):
            f, low, high = (x[k : k + size, None] for x in (first, lo, hi))
            at = np.zeros((len(f), self.count), np.int64)
            same = np.ones(at.shape, bool)
            step = 0
            for t, walk, sample in self.due:
                while True:
                    place = f + at
                    inside = (at < self.n) & (place >= low) & (place < high)
                    here = np.where(inside, words[np.clip(place, 0, len(words) - 1)], np.uint64(0))
                    if step == t:
                        break
                    at = np.minimum(at + self.moves(here, step), self.n)
                    step += 1
                for w, j in zip(walk.tolist(), sample.tolist(), strict=True):
                    same[:, w] &= inside[:, w] & (here[:, w] == self.words[w, j])
            out.append(same.any(1))
        return np.concatenate(out)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The words after random edits, cut or filled up to their old length; for calibration."""
    out = words.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(0, max(1, len(out)))), int(rng.integers(0, 3))
        new = int(rng.integers(1, 2**63))
        if kind == 0:
            out.insert(at, new)
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out[at] = new
    out = out[: len(words)] + [int(x) for x in rng.integers(1, 2**63, max(0, len(words) - len(out)))]
    return np.array(out, np.uint64)


@lru_cache(maxsize=4096)
def walks_for(n: int, recall: float = TARGET_RECALL, trials: int = 40, probes: int = 128) -> int:
    """How many walks find a window at the very tolerance of an item of ``n`` words with probability ``recall``, or
    0 if these are too many and windows are to be verified without them.

    Measured on randomly edited copies of random words: the share of single walks whose samples agree. The twentieth
    of the copies that agrees least sets the number.
    """
    if int(n * TOLERANCE) == 0:
        return 1  # equal windows agree in every walk
    if n > MOST_WORDS:
        return 0
    rng = np.random.default_rng([5, n])
    words = rng.integers(1, 2**63, n).astype(np.uint64)
    copies = np.concatenate([edited(words, int(n * TOLERANCE), rng) for _ in range(trials)])
    first = np.arange(trials) * n
    walks = Walks(words, probes)
    hits = np.zeros(trials)
    for w in range(probes):
        one = walks.only(w)
        hits += one.agree(copies, first, first, first + n)
    p = float(np.quantile(hits / probes, 0.05))
    needed = int(np.ceil(np.log(1 - recall) / np.log(1 - min(p, 0.999)))) if p > 0 else MOST_WALKS + 1
    return needed if needed <= MOST_WALKS else 0


def length_class(n: int) -> int:
    """Items of similar length share a calibration: that of the longest in their class, classes growing by an eighth."""
    size = 16
    if n <= size:
        return n
    while size < n:
        size += size // 8
    return size


def infix_distance(masks: dict[int, int], n: int, text: list[int]) -> int:
    """The least edit distance of a pattern of n words to any run of ``text``, by bit-parallel columns.

    ``masks`` has for each word of the pattern the bits of its positions.
    """
    ones = (1 << n) - 1
    plus, minus, distance, best, last = ones, 0, n, n, 1 << (n - 1)
    for word in text:
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & ones
        down = plus & xh
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up = up << 1 & ones  # no carry in: a run may begin anywhere
        down = down << 1 & ones
        plus = down | ~(xv | up) & ones
        minus = up & xv
        best = min(best, distance)
    return best


def pattern_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


class Matcher:
    """Finds the items of one block in runs of documents."""

    BITS = 22

    def __init__(self, items: list[Item], n_walks: dict[int, int]):
        """``n_walks`` has the number of walks for each ``length_class``."""
        self.items, self.n_walks = items, n_walks
        self.by_q: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in sorted({i.q for i in items}):
            rows = [(self.gram(i.words, q)[p], k, p) for k, i in enumerate(items) if i.q == q for p in i.seeds]
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            quick = np.zeros(1 << self.BITS, bool)
            quick[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.by_q[q] = keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), quick
        self.masks: dict[int, dict[int, int]] = {}
        self.walks: dict[int, Walks] = {}

    @staticmethod
    def gram(words: np.ndarray, q: int) -> np.ndarray:
        h = np.zeros(max(0, len(words) - q + 1), np.uint64)
        for i in range(q if len(h) else 0):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += words[i : i + len(h)]
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def seeds(self, words: np.ndarray, starts: np.ndarray) -> dict[int, np.ndarray]:
        """For each item with an unchanged segment: (text, first word) of windows to look at, as rows."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (keys, of, offset, quick) in self.by_q.items():
            h = self.gram(words, q)
            hit = np.flatnonzero(quick[(h >> np.uint64(64 - self.BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, h[hit]), np.searchsorted(keys, h[hit], side="right")
            n = hi - lo
            hit, lo = hit[n > 0], lo[n > 0]
            n = n[n > 0]
            at = np.repeat(hit, n)
            row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.searchsorted(starts, at, side="right") - 1
            inside = at + q <= starts[text + 1]
            at, row, text = at[inside], row[inside], text[inside]
            first = at - offset[row]
            for k in np.unique(of[row]).tolist():
                mine = of[row] == k
                found.setdefault(k, []).append(np.stack([text[mine], first[mine]], 1))
        return {k: np.unique(np.concatenate(v), axis=0) for k, v in found.items()}

    def candidates(self, k: int, words: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Those (text, first word) of windows near the seeds that some walk finds alike."""
        item = self.items[k]
        if k not in self.walks:
            self.walks[k] = Walks(item.words, self.n_walks[length_class(item.n)])
        kept, size = [seeds[:0]], max(1, WALKS_AT_ONCE // (2 * item.edits + 1))
        for at in range(0, len(seeds), size):
            some = seeds[at : at + size]
            near = (some[:, 1:] + np.arange(-item.edits, item.edits + 1)).ravel()
            spots = np.unique(np.stack([np.repeat(some[:, 0], 2 * item.edits + 1), near], 1), axis=0)
            lo, hi = starts[spots[:, 0]], starts[spots[:, 0] + 1]
            there = (spots[:, 1] > lo - item.n) & (spots[:, 1] < hi)
            spots, lo, hi = spots[there], lo[there], hi[there]
            kept.append(spots[self.walks[k].agree(words, spots[:, 1], lo, hi)])
        return np.concatenate(kept)

    def run_distance(self, k: int, words: np.ndarray, starts: np.ndarray, text: int, first: int, slack: int) -> int:
        """The item's least distance to any run of words about a window of a text."""
        n = self.items[k].n
        return self.distance(k, words[max(starts[text], first - slack) : min(starts[text + 1], first + n + slack)])

    def distance(self, k: int, words: np.ndarray) -> int:
        """The item's least distance to any run of these words."""
        if k not in self.masks:
            self.masks[k] = pattern_masks(self.items[k].words.tolist())
        return infix_distance(self.masks[k], self.items[k].n, words.tolist())

    def find(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item_id, distance, item's words) for each text that holds an item."""
        out = []
        for k, seeds in self.seeds(words, starts).items():
            item = self.items[k]
            embedded = self.n_walks[length_class(item.n)] > 0
            looked = self.candidates(k, words, starts, seeds) if embedded else seeds
            held: set[int] = set()
            for text, first in looked.tolist():
                if text not in held and self.run_distance(k, words, starts, text, first, (1 if embedded else 2) * item.edits) <= item.edits:
                    held.add(text)
            for text in sorted(held):  # the closest run has an unchanged segment too, so it lies about a seed
                spots = seeds[seeds[:, 0] == text, 1].tolist()
                out.append((text, item.item_id, min(self.run_distance(k, words, starts, text, first, 2 * item.edits) for first in spots), item.n))
        return out


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[Item]]:
    """The items in blocks of bounded size, as shipped to executors. Items without a word are left out."""
    batch: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, text).orderBy(item_id, text)

    def finished(some: list[tuple[int, str]]) -> list[Item]:
        words, starts = word_hashes(pa.array([t for _, t in some], pa.large_string()))
        items = [Item(i, words[starts[n] : starts[n + 1]]) for n, (i, _) in enumerate(some) if starts[n] < starts[n + 1]]
        return items

    for row in rows.toLocalIterator():
        batch.append((row[0], row[1]))
        size += len(row[1])
        if size >= ITEM_BYTES:
            yield finished(batch)
            batch, size = [], 0
    yield finished(batch)


def _shipped(docs: DataFrame, items: list[Item]):
    """A function that makes the matcher of a block of items on an executor."""
    n_walks = {size: walks_for(size) for size in {length_class(i.n) for i in items}}
    shipped = docs.sparkSession.sparkContext.broadcast([(i.item_id, i.words) for i in items])  # at most as large as ITEM_BYTES and a few bytes for each word
    return lambda: Matcher([Item(*x) for x in shipped.value], n_walks)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, distance (in words), item_words.

    Whole texts are searched, in one pass and without a shuffle for each block of items. Items of one to four words
    are held where they stand word for word. Null and empty texts hold nothing, nor do empty tables; items that are
    null or without a word are held by nothing; repeated rows of documents give repeated rows, equal items each
    their own. Other columns are not looked at.
    """
    found = None
    for items in item_blocks(benchmark):
        if not items:
            continue

        def search(batches: Iterator[pa.RecordBatch], made=_shipped(docs, items)) -> Iterator[pa.RecordBatch]:
            matcher = made()
            for batch in batches:
                for part, texts in pieces(batch):
                    rows = matcher.find(*word_hashes(texts))
                    ids = part.column(0).to_pylist()
                    cols = [[ids[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "item_words"])

        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, "doc_id long, item_id long, distance long, item_words long")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, item_words long")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item of the benchmark. See ``matches``."""
    at, schema = docs.columns.index(text), docs.schema
    for items in item_blocks(benchmark):
        if not items:
            continue

        def keep(batches: Iterator[pa.RecordBatch], made=_shipped(docs, items)) -> Iterator[pa.RecordBatch]:
            matcher = made()
            for batch in batches:
                for part, texts in pieces(batch, batch.schema.names[at]):
                    clean = np.ones(len(texts), bool)
                    clean[[r[0] for r in matcher.find(*word_hashes(texts))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which of ``documents`` hold which item of ``benchmark``."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
