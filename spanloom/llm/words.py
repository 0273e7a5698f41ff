"""Vectorised words and word shingles of Arrow text columns.

A word is a maximal run of characters that are not white space. Everything here works on whole
Arrow arrays, so that no Python code runs for each word but once for each distinct word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once, which bounds a worker's memory. One longer text forms a piece alone.
PIECE_BYTES = 12_000_000


def give_back() -> None:
    """Return free memory to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; nulls become empty texts.

    What Arrow and the C library hold of a run is given back before the next, so that a worker at rest is small.
    """
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at), text.slice(at, stop - at)
        at = stop
        give_back()


def hash_strings(values: pa.Array) -> np.ndarray:
    """xxh3 of each string."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.to_pylist()), np.uint64, len(values))


def word_hashes(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts in a row, and where each text begins (one more than texts)."""
    if lower:
        text = pc.utf8_lower(text)
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text))
    starts = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    coded = pc.dictionary_encode(flat)
    hashes = hash_strings(coded.dictionary)
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64)
    empty = hashes.size and pc.any(pc.equal(coded.dictionary, "")).as_py()
    if empty:  # only texts without any word have an empty piece
        keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        kept = np.concatenate([[0], np.cumsum(keep)])
        return words[keep], kept[starts]
    return words, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(words: np.ndarray, starts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside each text, and where each text's begin.

    A text of 1 to n-1 words has one shingle, made of all its words; a text without words has none.
    """
    lens = np.diff(starts)
    if not words.size:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    short = (lens > 0) & (lens < n)
    counts = np.where(lens >= n, lens - n + 1, short)
    out_starts = np.concatenate([[0], np.cumsum(counts)])
    mult = np.uint64(0x9E3779B97F4A7C15)
    full = max(0, words.size - n + 1)
    roll = np.zeros(full, np.uint64)
    for i in range(n if full else 0):
        roll *= mult
        roll += words[i : i + full]
    text_of = np.repeat(np.arange(len(lens)), counts)
    first = starts[:-1][text_of] + np.arange(out_starts[-1]) - out_starts[:-1][text_of]
    out = np.zeros(out_starts[-1], np.uint64)
    whole = ~short[text_of]
    out[whole] = roll[first[whole]]
    for t in np.flatnonzero(short):
        h = 0
        for w in words[starts[t] : starts[t + 1]].tolist():
            h = (h * int(mult) + w + 1) & 0xFFFFFFFFFFFFFFFF
        out[out_starts[t]] = h
    return mix(out), out_starts


def ascii_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of characters other than ASCII white space: each one's place in the array of distinct ones, where each text's begin, and that array."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    starts = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.values.slice(starts[0], starts[-1] - starts[0])
    starts = starts - starts[0]
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:  # of texts without a word
        keep = codes != empty
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return codes, starts, coded.dictionary
