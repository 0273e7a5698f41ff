"""Token ids of documents in sorted-string-table shards.

A shard is one file: data blocks, a Bloom filter over its keys, a sparse index with the last key of each
block, and a footer of fixed size. Keys are documents' identifiers in an order-preserving encoding; within a
block each key is written as the length it shares with the one before it and what follows. Values are token
ids. Files end in one line feed, which Spark's text writer appends.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import scratch_path
from spanloom.llm.words import pieces

MAGIC = b"SSTSHRD1"
#: magic, entries, token ids, blocks, bytes per id; offset and length of filter and index; crc32 of both.
FOOTER = "<8sQQIIQIQII"
FOOTER_BYTES = struct.calcsize(FOOTER)
#: Bytes of values, before compression, at which a block or a shard is closed. A longer document stays whole.
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
BLOOM_BITS_PER_KEY = 10
#: Bytes of text that are encoded at once. More would repeat fewer words and take more memory.
PIECE_BYTES = 6_000_000
BLOOM_PROBES = 7
#: How byte-level vocabularies write a space.
BYTE_SPACE = "Ġ"
#: Writing tasks whose totals are summed up in one task; the totals of such runs are summed up in another.
RUN_PARTS = 4096


def encode_key(doc_id: int | None, nth: int) -> bytes:
    """Bytes that sort as (doc_id, nth), null first. ``nth`` tells repeated identifiers apart."""
    return struct.pack(">BQI", doc_id is not None, 0 if doc_id is None else doc_id + (1 << 63), nth)


def decode_key(key: bytes) -> tuple[int | None, int]:
    there, doc_id, nth = struct.unpack(">BQI", key)
    return (doc_id - (1 << 63) if there else None), nth


def put_varint(out: bytearray, n: int) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def bloom_bits(doc_id: int | None, size: int) -> list[int]:
    """The bits of an identifier in a filter of ``size`` bits, by double hashing."""
    h = xxhash.xxh3_128_intdigest(encode_key(doc_id, 0))
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [(a + i * b) % size for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Collects documents in key order and gives the finished file's bytes."""

    def __init__(self, id_bytes: int):
        self.id_bytes, self.out, self.index = id_bytes, bytearray(), []
        self.block, self.last, self.entries, self.ids, self.raw = bytearray(), b"", 0, 0, 0
        self.doc_ids: set[int | None] = set()
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, nth: int, value: bytes) -> None:
        key = encode_key(doc_id, nth)
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(value))
        self.block += key[shared:]
        self.block += value
        self.last, self.entries, self.ids, self.raw = key, self.entries + 1, self.ids + len(value) // self.id_bytes, self.raw + len(value)
        self.doc_ids.add(doc_id)
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.index.append((self.last, len(self.out), len(data), zlib.crc32(data)))
            self.out += data
            self.block = bytearray()

    def finish(self) -> bytes:
        self.close_block()
        size = max(64, len(self.doc_ids) * BLOOM_BITS_PER_KEY + 7 & ~7)
        bloom = bytearray(size // 8)
        for doc_id in self.doc_ids:
            for bit in bloom_bits(doc_id, size):
                bloom[bit >> 3] |= 1 << (bit & 7)
        index = bytearray()
        for key, at, length, crc in self.index:
            index += key + struct.pack("<QII", at, length, crc)
        bloom_at = len(self.out)
        index_at = bloom_at + len(bloom)
        footer = struct.pack(FOOTER, MAGIC, self.entries, self.ids, len(self.index), self.id_bytes, bloom_at, len(bloom), index_at, len(index), zlib.crc32(bytes(bloom + index)))
        return bytes(self.out + bloom + index) + footer


class Shard:
    """Reads one file's bytes: by identifier through filter and index, or all in order."""

    KEY_BYTES = 13

    def __init__(self, data: bytes):
        self.data = data
        at = len(data) - 1 - FOOTER_BYTES
        if at < 0 or data[-1:] != b"\n":
            raise ValueError("not a whole shard")
        magic, self.entries, self.ids, n_blocks, self.id_bytes, bloom_at, bloom_len, index_at, index_len, crc = struct.unpack_from(FOOTER, data, at)
        self.bloom, index = data[bloom_at : bloom_at + bloom_len], data[index_at : index_at + index_len]
        if magic != MAGIC or crc != zlib.crc32(self.bloom + index):
            raise ValueError("a shard's footer, filter or index is damaged")
        row = self.KEY_BYTES + 16
        self.last_keys = [index[i * row : i * row + self.KEY_BYTES] for i in range(n_blocks)]
        self.blocks = [struct.unpack_from("<QII", index, i * row + self.KEY_BYTES) for i in range(n_blocks)]
        self.unpack = zstandard.ZstdDecompressor()

    def entries_of(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, length, crc = self.blocks[block]
        packed = self.data[at : at + length]
        if zlib.crc32(packed) != crc:
            raise ValueError("a shard's block is damaged")
        data, at, key = self.unpack.decompress(packed), 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            length, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        kind = np.dtype(f"<u{self.id_bytes}")
        for block in range(len(self.blocks)):
            for key, value in self.entries_of(block):
                yield decode_key(key)[0], np.frombuffer(value, kind)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[bit >> 3] >> (bit & 7) & 1 for bit in bloom_bits(doc_id, len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of each document with this identifier."""
        found: list[np.ndarray] = []
        if not self.may_hold(doc_id):
            return found
        prefix, kind = encode_key(doc_id, 0)[:9], np.dtype(f"<u{self.id_bytes}")
        for block in range(bisect.bisect_left(self.last_keys, prefix), len(self.blocks)):
            for key, value in self.entries_of(block):
                if key[:9] == prefix:
                    found.append(np.frombuffer(value, kind))
                elif key[:9] > prefix:
                    return found
        return found


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct run between single spaces once.

    Where one space stands between two other characters that aren't white space, the byte-level
    pre-tokenizer always cuts before it, and it makes a lone line feed a piece of its own, so that the ids of
    the runs, joined, are the ids of the text. Texts with other white space are cut by a pattern instead.
    Nothing is remembered from one piece of text to the next, so memory is bounded by a piece.
    """

    BATCH = 20_000
    JOINED = 100

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        getattr(self.tokenizer.model, "_resize_cache", int)(0)  # no cache of words: what comes is distinct already
        self.cut = regex.compile(r"(?<=\S)(?= \S)")
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(BYTE_SPACE)]] = True

    def ids_of_spaced(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids_of``, for strings with one space each, at their begin: many are encoded as one, and ids that begin with a space part them."""
        joined = ["".join(strings[k : k + self.JOINED]) for k in range(0, len(strings), self.JOINED)]
        ids, _ = self.ids_of(joined, self.BATCH // self.JOINED)
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(strings):  # a vocabulary whose tokens hold spaces elsewhere
            return self.ids_of(strings)
        return ids, np.diff(begins, append=len(ids))

    def ids_of(self, strings: list[str], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and how many each has; ``batch`` strings are encoded at once."""
        ids, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(strings), batch):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(strings[k : k + batch], add_special_tokens=False)]
            lens.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(lens[-1].sum())))
        return np.concatenate(ids), np.concatenate(lens)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more than texts)."""
        space = r"[\s\x1c-\x1f\x{85}\x{a0}\p{Z}]"
        loose = pc.match_substring_regex(texts, f"{space}{{2}}|^{space}|{space}$")
        loose = loose.to_numpy(zero_copy_only=False)
        spaced = pc.replace_substring(pc.if_else(loose, "", texts), "\n", " \n ")
        lists = pc.split_pattern(spaced, " ")
        starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.values.slice(starts[0], starts[-1] - starts[0])
        starts = starts - starts[0]
        coded = pc.dictionary_encode(flat)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs = coded.dictionary.to_pylist()
        bare = np.zeros(len(flat) + 1, bool)  # runs without a space before them: a text's or a line's first, and line feeds
        bare[starts[:-1]] = True
        if "\n" in runs:
            feeds = at == runs.index("\n")
            bare[:-1] |= feeds
            bare[1:] |= feeds
        bare = bare[:-1]
        at = np.where(bare, len(runs) + at, at)
        used = np.zeros(2 * len(runs), bool)  # each run after a space, then each without
        used[at] = True
        spaced_runs = [" " + runs[i] for i in np.flatnonzero(used[: len(runs)]).tolist()]
        bare_runs = [runs[i] for i in np.flatnonzero(used[len(runs) :]).tolist()]
        at = (np.cumsum(used) - 1)[at]
        extra: dict[str, int] = {}
        slow: dict[int, list[int]] = {}
        for i in np.flatnonzero(loose):
            slow[int(i)] = [extra.setdefault(r, len(extra)) for r in self.cut.split(texts[int(i)].as_py())]
        base = len(spaced_runs) + len(bare_runs)
        ids, lens = map(np.concatenate, zip(self.ids_of_spaced(spaced_runs), self.ids_of([*bare_runs, *extra]), strict=True))
        offsets = np.concatenate([[0], np.cumsum(lens)])
        if slow:
            rows = [np.array(slow[i], np.int64) + base if i in slow else at[starts[i] : starts[i + 1]] for i in range(len(texts))]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            at = np.concatenate(rows)
        n = lens[at]
        total = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(total[-1], offsets[-1]) < 2**31 else np.int64
        where = np.repeat((offsets[at] - total[:-1]).astype(kind), n)
        where += np.arange(total[-1], dtype=kind)
        return ids[where], total[starts]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> None:
    """Encode every row's whole text, a null one as an empty one, append ``end_id``, and write shards.

    Files come out in ascending order of (null first) ``key``, rows of one key in order of a hash of their
    texts, so that neither a repeated key nor a null one need fit a task. Equal rows give equal entries; a text
    of any length is one entry; an empty table gives no shard; other columns are not looked at. Files go through
    Spark's own writer, so any store works, and a task that is run again replaces its files.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    most = 1 << 8 * id_bytes

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, last, nth = Encoder(tokenizer), ShardWriter(id_bytes), (), 0
        give = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], ["shard"])
        for batch in batches:
            for part, texts in pieces(batch, "text", PIECE_BYTES):
                ids, starts = encoder.encode(texts)
                if ids.size and int(ids.max()) >= most:
                    raise ValueError(f"an id doesn't fit {id_bytes} bytes")
                packed = ids.astype(f"<u{id_bytes}").tobytes()
                end = end_id.to_bytes(id_bytes, "little")
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    nth = nth + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    writer.add(doc_id, nth, packed[starts[i] * id_bytes : starts[i + 1] * id_bytes] + end)
                    if writer.raw >= SHARD_BYTES:
                        yield give(writer)
                        writer = ShardWriter(id_bytes)
        if writer.entries:
            yield give(writer)

    made = dealt.mapInArrow(shards, "shard binary")
    # The text writer copies a string's bytes as they are; one row a file gives one shard a file.
    made.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _shards(spark, path: str) -> DataFrame:
    """The files of a folder of shards in the order they were written: (part, shard, content)."""
    name = r"part-(\d+)-[^/]*-c(\d+)[^/]*$"
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 1)
    return files.select(F.regexp_extract("path", name, 1).cast("int").alias("part"), F.regexp_extract("path", name, 2).cast("int").alias("shard"), "content")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, int | None, np.ndarray]]]]:
    """For each shard part, number and its documents: (ids before it in the shard, doc_id, ids)."""
    for batch in batches:
        for part, shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found, at = [], 0
            for doc_id, ids in Shard(content.as_py()):
                found.append((at, doc_id, ids))
                at += len(ids)
            yield part, shard, found


def _rows(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def read(spark, path: str) -> DataFrame:
    """One row per document of a folder of shards: place (``part``, ``shard``, ``row``), doc_id and ids.

    ``row`` counts ids before the document in its shard. Files are read whole by Spark, each by one task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"part": pa.int32(), "shard": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "ids": pa.list_(pa.int32())}
        for part, shard, found in _entries(batches):
            for k in range(0, len(found), 500):
                yield _rows(kinds, [(part, shard, at, doc_id, ids.astype(np.int32)) for at, doc_id, ids in found[k : k + 500]])

    return _shards(spark, path).mapInArrow(rows, "part int, shard int, row long, doc_id long, ids array<int>")


def digest(spark, path_of_shards: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in a folder of shards."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"part": pa.int32(), "shard": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
        for part, shard, found in _entries(batches):
            yield _rows(kinds, [(part, shard, at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for at, doc_id, ids in found])

    path = scratch_path(spark, "digest")
    kind = "part int, shard int, row long, doc_id long, n_tokens long, ids_crc32 long"
    _shards(spark, path_of_shards).mapInArrow(rows, kind).write.parquet(path)  # so that shards are decoded once for totals and rows
    docs = spark.read.schema(kind).parquet(path)
    shards = docs.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("part_n"))  # one row for each task that wrote
    runs = parts.groupBy(F.floor(F.col("part") / RUN_PARTS).alias("run")).agg(F.sum("part_n").alias("run_n"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("run", before("run_n", Window.orderBy("run")).alias("run_base"))
    parts = parts.withColumn("run", F.floor(F.col("part") / RUN_PARTS)).join(runs, "run")
    parts = parts.select("part", (F.col("run_base") + before("part_n", Window.partitionBy("run").orderBy("part"))).alias("part_base"))
    base = F.col("part_base") + before("n", Window.partitionBy("part").orderBy("shard"))
    bases = shards.join(parts, "part").select("part", "shard", base.alias("base"))
    return docs.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("row")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of the documents with these identifiers, each as often as it was written.

    Every shard is asked through its Bloom filter and index, and only blocks that can hold an identifier are
    unpacked. The identifiers are shipped with the task, so their number must be small; join ``read`` with a
    table of them otherwise. Identifiers that no shard holds give no row.
    """
    wanted = sorted(set(doc_ids), key=lambda x: (x is not None, x))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(2):
                shard = Shard(content.as_py())
                found = [(doc_id, ids.astype(np.int32)) for doc_id in wanted for ids in shard.get(doc_id)]
                if found:
                    yield _rows({"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}, found)

    return _shards(spark, path).mapInArrow(rows, "doc_id long, ids array<int>")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    """Contract query: write all of ``documents`` as shards and read them back."""
    return documents_round_trip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def documents_round_trip(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "shards")
    write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return digest(spark, path)
