"""Jaccard join of documents on shingles of five words, with Bayesian pruning of MinHash candidates.

Copies, texts of equal words, are first folded into one class. A class's MinHash values are cut into bands;
classes that agree in a band are candidates. A candidate pair is compared a few values at a time and dropped
as soon as the posterior probability that its similarity reaches the threshold falls below a tolerance. What
is left is verified on whole shingle sets.

Pairs are never rows. A band's bucket is dealt into blocks, and each task sees two blocks of bounded size,
compares their members inside numpy, and gives counts of links and a spanning forest of them. A pair belongs
to the first band in which it agrees, so each is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.blocks import BLOCKS, deal, pairs_in_groups, tally, whole_groups
from spanloom.llm.components import components
from spanloom.llm.store import materialise
from spanloom.llm.words import mix, pieces, shingles, word_hashes

SHINGLE_WORDS = 5
#: The threshold is NUMERATOR / DENOMINATOR, so that verification is exact in integers.
NUMERATOR, DENOMINATOR = 4, 5
#: Bands of this many MinHash values. At similarity 0.8 all bands disagree with probability 3e-6.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: Values compared between two prunings, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Rows, of three numbers each, up to which a table is broadcast.
BROADCAST_ROWS = 500_000
KEYS = ["band", "bucket"]
TASK = [*KEYS, *BLOCKS]


def minhash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of 16 bits, a row for each text; rows of texts without shingles are zero."""
    rows = np.flatnonzero(np.diff(starts) > 0)
    out = np.zeros((len(starts) - 1, VALUES), np.uint16)
    if rows.size:
        multipliers = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
        for i, a in enumerate(multipliers):
            least = np.minimum.reduceat((hashes * a) >> np.uint64(32), starts[rows])
            out[rows, i] = mix(least) >> np.uint64(48)
    return out


def fewest_matches() -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior, m matches of n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = NUMERATOR / DENOMINATOR, []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def candidates(group: np.ndarray, block: np.ndarray, band: np.ndarray, across: np.ndarray, node: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that belong to their group's band and survive pruning.

    ``across`` marks rows of tasks with two blocks, where pairs within a block belong to another task.
    """
    least = fewest_matches()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in pairs_in_groups(group):
        keep = (~across[i] | (block[i] != block[j])) & (node[i] != node[j])
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            matches = np.zeros(len(a), np.int64)
            for n, fewest in enumerate(least):
                part = slice(n * STEP, (n + 1) * STEP)
                matches += (values[a, part] == values[b, part]).sum(1)
                alive = matches >= fewest
                a, b, matches = a[alive], b[alive], matches[alive]
            same = (values[a] == values[b]).reshape(len(a), BANDS, ROWS).all(2)
            first = same.argmax(1) == band[a]
            left.append(a[first])
            right.append(b[first])
    return np.concatenate(left), np.concatenate(right)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, fa, fb, sig): what tells rows of one doc_id apart, a 128-bit hash of each text's words, null
    without words, and its MinHash values."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                words, starts = word_hashes(texts)
                sig = minhash(*shingles(words, starts, SHINGLE_WORDS))
                prints = [xxhash.xxh3_128_intdigest(words[starts[i] : starts[i + 1]].tobytes()) if starts[i] < starts[i + 1] else None for i in range(len(texts))]
                halves = [pa.array([None if p is None else (p >> s & (1 << 64) - 1) - (1 << 63) for p in prints], pa.int64()) for s in (64, 0)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *halves, pa.array([r.tobytes() for r in sig.astype("<u2")], pa.binary())], ["doc_id", "row", "fa", "fb", "sig"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(signed, "doc_id long, row long, fa long, fb long, sig binary")


def row_key(text: str) -> Column:
    """With the doc_id, what tells rows apart: rows of one doc_id and equal texts are copies in any case."""
    return F.xxhash64(F.col(text))


def buckets(reps: DataFrame) -> DataFrame:
    """Members of each task: its key (band, bucket and two blocks), the member's own block, and the member."""
    key = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> named_struct('band', b, 'bucket', xxhash64(b, substring(sig, b * {2 * ROWS} + 1, {2 * ROWS}))))")
    return deal(reps.select("node", F.explode(key).alias("k")).select("node", "k.band", "k.bucket"), KEYS)


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    named = {k: table[k].to_numpy() for k in ("block", "band", "node")}
    values = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(table.num_rows, VALUES)
    return named | {"across": table["lo"].to_numpy() != table["hi"].to_numpy(), "values": values}


def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted task members, those with a candidate left after pruning."""
    for table, number in whole_groups(batches, TASK):
        i, j = candidates(number, **_arrays(table))
        some = np.unique(np.concatenate([i, j]))
        if some.size:
            yield from table.take(pa.array(some)).combine_chunks().to_batches()


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of common elements of pairs of (sorted, distinct) sets."""
    if len(i) < 24:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, n = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    row, column = row[shared], np.cumsum(n > 1)[column[shared]] - 1
    total = np.zeros((len(used), len(used)), np.float32)  # exact below 2**24 elements
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        some = slice(*np.searchsorted(column, [first, first + 4096]))
        there = np.zeros((len(used), 4096), np.float32)
        there[row[some], column[some] - first] = 1
        total += there @ there.T
    return total[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted task members with their texts: counts of verified links (a, null, n) and edges of a forest (a, b, 0)."""
    for table, number in whole_groups(batches, TASK, "text"):
        arrays = _arrays(table)
        i, j = candidates(number, **arrays)
        if not i.size:
            continue
        hashes, starts = shingles(*word_hashes(table["text"].combine_chunks().cast(pa.large_string())), SHINGLE_WORDS)
        sets = [np.unique(hashes[starts[k] : starts[k + 1]]) for k in range(table.num_rows)]
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(number[i], kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.diff(number[i])) + 1
        common = np.concatenate([intersections(sets, a, b) for a, b in zip(np.split(i, cuts), np.split(j, cuts), strict=True)])
        linked = DENOMINATOR * common >= NUMERATOR * (sizes[i] + sizes[j] - common)
        i, j = i[linked], j[linked]
        if not i.size:
            continue
        yield tally(arrays["node"], table["copies"].to_numpy(), i, j)


def text_of(docs: DataFrame, heads: DataFrame, doc_id: str, text: str, repeats: bool) -> DataFrame:
    """(node, text) for the given classes (node, doc_id, row), each from the row that stands for it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text).alias("row"), F.col(text).alias("text"))
    if heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # three numbers a row, so other texts aren't shuffled
        heads = F.broadcast(heads)
    found = rows.join(heads, ["doc_id", "row"]).select("node", "text")
    return found.groupBy("node").agg(F.min("text").alias("text")) if repeats else found


def classified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, row, worded, class_id, n_links, component_id, kept. See ``join``."""
    rows = materialise(signatures(docs, doc_id, text), "signatures")
    known = rows.where("doc_id IS NOT NULL AND fa IS NOT NULL")
    classes = known.groupBy("fa", "fb").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    repeats = known.groupBy("doc_id", "row").count().where("count > 1").limit(1).count() > 0
    reps = classes.select("node", "copies", "sig")
    members = buckets(reps).join(reps, "node").select(*TASK, "block", "node", "copies", "sig")
    schema = "band int, bucket long, lo int, hi int, block int, node long, copies long, sig binary"
    left = materialise(members.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(surviving, schema), "candidates")
    heads = materialise(left.select("node").distinct().join(classes.select("node", "head.*"), "node"), "heads")
    with_text = left.join(text_of(docs, heads, doc_id, text, repeats), "node").select(*TASK, "block", "node", "copies", "sig", "text")
    found = materialise(with_text.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(verified, "a long, b long, n long"), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = materialise(components(found.where("b IS NOT NULL").select("a", "b")), "groups")
    firsts = groups.join(classes.select("node", "head"), "node").groupBy("component").agg(F.min("head").alias("first"))
    firsts = groups.join(firsts, "component").select("node", "first")
    of_class = classes.select("fa", "fb", "node", "head", "copies").join(links, "node", "left").join(firsts, "node", "left")
    of_class = of_class.select("fa", "fb", "head", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("first", "head").alias("first"))
    own = F.col("doc_id")
    return rows.select("doc_id", "row", "fa", "fb").join(of_class, ["fa", "fb"], "left").select(
        "doc_id",
        "row",
        F.col("fa").isNotNull().alias("worded"),
        F.when(own.isNotNull(), F.coalesce("head.doc_id", own)).alias("class_id"),
        F.when(own.isNotNull(), F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(own.isNotNull(), F.coalesce("first.doc_id", own)).alias("component_id"),
        (own.isNull() | F.col("first").isNull() | ((own == F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))).alias("kept"),
    )


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, component_id, kept.

    Two documents are linked if the Jaccard similarity of their shingles is 0.8 or more. ``class_id`` is the
    smallest doc_id of texts with the same words (case and white space don't count), ``n_links`` the number of
    other documents that are linked directly, copies included, ``component_id`` the smallest doc_id that
    links lead to, ``kept`` whether the row is the one of its component that stays: that of the smallest doc_id,
    and among texts that share it, of the smallest ``row_key``.

    A text of one to four words has one shingle, of all its words. A null text, an empty one or one without
    words is linked to nothing, and kept. Rows with a null doc_id come out with nulls, and kept. Rows that share a
    doc_id but not a text are documents of their own; rows equal in both are copies of each other, and all of them
    are marked as kept if one is. An empty table gives an empty one. Other columns are not looked at.
    """
    return classified(docs, doc_id, text).drop("row", "worded")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each linked group, that marked as kept by ``join``; all columns stay.

    Of rows equal in doc_id and text (with a word in it) the one whose other columns have the smallest hash
    stays. Rows without a doc_id or without a word all stay. No text that is unlike all others is lost, whatever
    doc_ids repeat.
    """
    found = materialise(classified(docs, doc_id, text).where("doc_id IS NOT NULL AND worded").select("doc_id", "row", "kept"), "kept")
    keys = lambda side: (F.col(f"docs.`{doc_id}`").cast("long") == F.col(f"{side}.doc_id")) & (row_key(f"docs.`{text}`") == F.col(f"{side}.row"))
    gone = found.where("NOT kept").select("doc_id", "row").distinct()
    left = docs.alias("docs").join(gone.alias("gone"), keys("gone"), "left_anti")
    again = found.where("kept").groupBy("doc_id", "row").count().where("count > 1").select("doc_id", "row")
    if not again.limit(1).count():
        return left
    again = materialise(again, "repeated").alias("again")
    once, many = left.alias("docs").join(again, keys("again"), "left_anti"), left.alias("docs").join(again, keys("again"), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    others = F.xxhash64(F.to_json(whole))
    one = many.groupBy(F.col(f"`{doc_id}`"), row_key(f"`{text}`")).agg(F.min_by(whole, others).alias("chosen"))
    return once.unionByName(one.select("chosen.*"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The Jaccard join of all ``documents`` with themselves."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
