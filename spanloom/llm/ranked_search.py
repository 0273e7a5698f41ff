"""Ranked lexical search: an inverted index in shards, each searched by MaxScore.

A shard holds the postings of a bounded run of whole documents: for each term, known by its 64-bit hash, the documents
that hold it and how often. The index is a table with one row a shard, so Spark deals shards to tasks and needs no shuffle to
search them. A query's terms are ordered by the most that they can add to a score in the shard. Those that together stay
below the score to beat are non-essential: documents that hold nothing else can't qualify, so only the other lists are
read whole, and the non-essential ones are probed, from the greatest bound down, for documents that may still qualify.
The score to beat rises from shard to shard of a task; what tasks found is ranked in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import materialise
from spanloom.llm.words import ascii_words, hash_strings, pieces

#: Results for each query.
TOP = 50
#: Bytes of text of a shard. One longer text forms a shard alone.
SHARD_BYTES = 12_000_000
#: Bytes of queries that are shipped and searched at once; more take further passes over the index.
QUERY_BYTES = 32 << 20
#: Groups in which each query's results are ranked before they meet.
GROUPS = 64
SHARD = "n_docs long, n_terms long, doc_ids binary, sizes binary, terms binary, dfs binary, docs binary, tfs binary"

#: Bytes as they stand in terms: separators become spaces, A-Z lower case.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[[b for b in range(128) if not chr(b).isalnum()]] = ord(" ")
FOLDED[ord("A") : ord("Z") + 1] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of each text, as ``ascii_words``: runs of ASCII letters, digits and all characters beyond ASCII."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    folded = FOLDED[np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]]
    return ascii_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(folded)]))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the greatest needs."""
    width = next(w for w in (1, 2, 4, 8) if not values.size or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{width}").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}")


def shard(doc_ids: pa.Array, texts: pa.Array) -> list:
    """The values of a shard's row."""
    codes, starts, distinct = terms_of(texts)
    hashes = hash_strings(distinct)
    order = np.argsort(hashes, kind="stable")
    sizes = np.diff(starts)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pairs, tfs = np.unique(rank[codes] * max(1, len(sizes)) + doc, return_counts=True)
    term, doc = np.divmod(pairs, max(1, len(sizes)))
    used, dfs = np.unique(term, return_counts=True)
    ids = pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64())], ["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as out:
        out.write_batch(ids)
    return [int((sizes > 0).sum()), int(sizes.sum()), sink.getvalue().to_pybytes(), packed(sizes), packed(hashes[order][used]), packed(dfs), packed(doc), packed(tfs)]


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table with one row a shard, whole texts of all rows. Null and empty texts have no term; other columns aren't looked at."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        for batch in batches:
            for part, texts in pieces(batch, "text", SHARD_BYTES):
                row = shard(part.column(0), texts)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    names = [c.split()[0] for c in SHARD.split(", ")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(shards, SHARD), "postings")


class Queries:
    """A block of queries: their distinct terms' hashes in order, and for each query the places of its own among them."""

    def __init__(self, ids: list, texts: list[str | None]):
        codes, starts, distinct = terms_of(pa.array([t or "" for t in texts], pa.large_string()))
        hashes = hash_strings(distinct)
        self.terms = np.unique(hashes)
        at = np.searchsorted(self.terms, hashes)[codes] if len(hashes) else np.zeros(0, np.int64)
        self.ids, self.own = ids, [np.unique(at[starts[i] : starts[i + 1]]) for i in range(len(ids))]


def blocks(queries: DataFrame, query_id: str, text: str) -> Iterator[Queries]:
    """The queries in blocks of bounded size, as shipped to tasks."""
    ids, texts, size = [], [], 0
    for row in queries.select(F.col(query_id), F.col(text)).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += 100 + len(row[1] or "")
        if size >= QUERY_BYTES:
            yield Queries(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts)


def weights(terms: int, n_docs: int, df: np.ndarray) -> np.ndarray:
    """Whole weights of ``terms`` terms by the number of documents that hold them."""
    return np.fromiter((math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df), np.int64, terms)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def maxscore(lists: list[tuple[np.ndarray, np.ndarray]], beat: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of at least ``beat`` (1 or more) and their scores, from each term's documents in order and what they get for it; ``n`` documents in all."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(added.max()) for _, added in lists], dtype=np.int64)
    first = int(np.searchsorted(bounds, beat))  # terms before it can't reach the score to beat together
    total = np.zeros(n, np.int64)
    for at, added in lists[first:]:
        total[at] += added
    found = np.flatnonzero(total)
    for k in range(first - 1, -1, -1):
        found = found[total[found] + bounds[k] >= beat]
        if not found.size:
            break
        at, added = lists[k]
        place = np.minimum(np.searchsorted(at, found), len(at) - 1)
        held = at[place] == found
        total[found[held]] += added[place[held]]
    found = found[total[found] >= beat]
    return found, total[found]


class Search:
    """Ranks documents of one shard after the other for a block of queries."""

    def __init__(self, terms: np.ndarray, own: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.terms, self.own, self.weight, self.n_docs, self.n_terms, self.top = terms, own, weight, n_docs, n_terms, top
        self.best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(own)

    def add(self, row: dict) -> None:
        sizes, terms, dfs = (unpacked(row[k]) for k in ("sizes", "terms", "dfs"))
        starts = np.concatenate([[0], np.cumsum(dfs, dtype=np.int64)])
        place = np.searchsorted(terms, self.terms)
        there = np.flatnonzero((place < len(terms)) & (self.weight > 0))
        there = there[terms[place[there]] == self.terms[there]]
        if not there.size:
            return
        docs, tfs = unpacked(row["docs"]), unpacked(row["tfs"])
        m = 100 - 50 + (50 * sizes.astype(np.int64) * self.n_docs) // self.n_terms
        lists = {}
        for t, p in zip(there.tolist(), place[there].tolist(), strict=True):
            at = docs[starts[p] : starts[p + 1]].astype(np.int64)
            lists[t] = at, self.weight[t] * impacts(tfs[starts[p] : starts[p + 1]].astype(np.int64), m[at])
        ids = pa.ipc.open_stream(row["doc_ids"]).read_all()["doc_id"]
        missing, ids = pc.is_null(ids).to_numpy(), pc.fill_null(ids, 0).to_numpy()
        for q, own in enumerate(self.own):
            score, gone, doc = self.best[q]
            beat = int(score[-1]) if len(score) == self.top else 1
            at, gained = maxscore([lists[t] for t in own.tolist() if t in lists], beat, len(sizes))
            if at.size:
                score, gone, doc = np.concatenate([score, gained]), np.concatenate([gone, missing[at]]), np.concatenate([doc, ids[at]])
                order = np.lexsort((doc, gone, -score))[: self.top]
                self.best[q] = score[order], gone[order], doc[order]

    def results(self) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        score, gone, doc = (np.concatenate([b[k] for b in self.best]) for k in range(3))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, mask=gone), pa.array(score)], ["query", "doc_id", "score"])


def ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def search(postings: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """The best ``top`` documents of an ``index`` for each row of ``queries``: query_id, rank, doc_id, score.

    Scores follow the rule of the query ``op11_ranked_search``, terms known by 64-bit hashes. Equal scores are in order
    of doc_id, null last; rows that repeat a document are ranked each by itself, and repeated queries are answered each.
    A query without a term, or with terms that no document holds, has no row, as has any in an empty index.
    """
    spark = postings.sparkSession
    n_docs, n_terms = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    kind = queries.schema[query_id].dataType
    out = []
    for block in blocks(queries, query_id, text):
        if not n_docs or not len(block.terms):
            continue
        wanted = spark.sparkContext.broadcast(block.terms)  # at most as many as QUERY_BYTES has words

        def held(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(wanted.value), np.int64)
            for batch in batches:
                for terms, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms, dfs = unpacked(terms), unpacked(dfs)
                    place = np.searchsorted(terms, wanted.value)
                    there = np.flatnonzero(place < len(terms))
                    there = there[terms[place[there]] == wanted.value[there]]
                    total[there] += dfs[place[there]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

        df = np.zeros(len(block.terms), np.int64)
        for term, n in postings.select("terms", "dfs").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row a query term
            df[term] = n
        shipped = spark.sparkContext.broadcast((block.terms, block.own, weights(len(df), n_docs, df)))

        def found(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            task = Search(*shipped.value, n_docs, n_terms, top)
            for batch in batches:
                for row in range(batch.num_rows):
                    task.add({c: batch.column(k)[row].as_py() for k, c in enumerate(batch.schema.names)})
            yield task.results()

        rows = postings.select("doc_ids", "sizes", "terms", "dfs", "docs", "tfs").mapInArrow(found, "query long, doc_id long, score long")
        first = ranked(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))), ["query", "part"], top)
        best = ranked(first.drop("rank", "part"), ["query"], top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"query long, {query_id} {kind.simpleString()}")
        out.append(best.join(F.broadcast(names), "query").select(query_id, "rank", "doc_id", "score"))  # an id a query of the block
    if not out:
        return spark.createDataFrame([], f"{query_id} {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``."""
    return search(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS size FROM d WHERE len(terms) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT q, item_id, unnest(list_distinct({TERMS})) AS term FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark WHERE text IS NOT NULL)),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
x AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // size)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= {TOP}
"""
