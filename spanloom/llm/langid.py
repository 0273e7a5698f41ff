"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.store import wider
from spanloom.llm.words import pieces

#: What a text without a letter, or without text, is called.
UNKNOWN = "und"
#: Stands for any run of characters that are not letters; no letter has this code point.
BORDER = 1
#: N-grams in a profile of a language and of a document.
PROFILE_SIZE = 300
#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE_BYTES = 4_000_000


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else the word border."""
    table = np.zeros(0x110000, np.uint32)
    for block in range(0, 0x110000, 0x1000):
        run = "".join(map(chr, range(block, block + 0x1000)))
        table[[block + i for i, c in enumerate(run) if c.isalpha()]] = 1
    return np.where(table, np.arange(0x110000, dtype=np.uint32), np.uint32(BORDER))


def text_codes(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters as one border, a border at both ends."""
    codes = letters[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[BORDER], codes, [BORDER]]).astype(np.int64)
    return codes[(codes != BORDER) | np.concatenate([[True], codes[:-1] != BORDER])]


def ngram_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of 1 to 3 characters; a border stands only first or last, and never alone.

    The key is the code points in base 2**21, so keys of different lengths differ and sort the same everywhere.
    """
    shift = np.int64(21)
    pairs = (codes[:-1] << shift) | codes[1:]
    triples = (pairs[:-1] << shift) | codes[2:]
    return np.concatenate([codes[codes != BORDER], pairs, triples[codes[1:-1] != BORDER]])


def ranked(keys: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent keys, most frequent first; ties by key."""
    keys = np.sort(keys)
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([heads, [len(keys)]]))
    if len(heads) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        chosen = np.flatnonzero(counts >= least)
    else:
        chosen = np.arange(len(heads))
    order = np.argsort(-counts[chosen], kind="stable")[:size]
    return keys[heads[chosen[order]]]


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams over all given rows, most frequent first.

    Rows whose text or language is null teach nothing; an empty table, or one without a label, gives no profile. Counts are summed in each batch before they are
    shuffled; what comes to the driver is ``size`` keys for each language.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for part, texts in pieces(batch, text, PIECE_BYTES):
                langs = np.array(part.column(1).to_pylist(), object)
                values = texts.to_pylist()
                for one in dict.fromkeys(langs.tolist()):
                    keys = [ngram_keys(text_codes(values[i], letters)) for i in np.flatnonzero(langs == one)]
                    found, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(found)), pa.array(found), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias(text), F.col(lang).alias("lang"))
    summed = known.mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The first cut is by salt, so that no language's n-grams meet in one task before they are few.
    order = [F.desc("n"), F.asc("gram")]
    salted = summed.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(32)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= size)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.select("lang", "gram", "rank").orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def out_of_place(profile: np.ndarray, keys: np.ndarray, ranks: np.ndarray, n_langs: int, size: int) -> np.ndarray:
    """The document's distance to each language, divided by the greatest possible one.

    ``keys`` are all profile keys sorted, ``ranks`` their rank in each language (``size`` where absent). A key
    that is absent from a profile counts ``size``, the greatest displacement.
    """
    at = np.minimum(np.searchsorted(keys, profile), len(keys) - 1)
    there = keys[at] == profile
    own = np.arange(len(profile))[:, None]
    found = ranks[at]
    moved = np.where(there[:, None] & (found < size), np.abs(found - own), size)
    return moved.sum(0) / (size * len(profile)) if len(profile) else np.ones(n_langs)


def scorer(profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> Callable[[str], tuple[str, float]]:
    """The function from a text to (language, score) for these profiles."""
    langs = sorted(profiles)
    keys = np.unique(np.array([k for v in profiles.values() for k in v], np.int64)) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(keys), len(langs)), size, np.int64)
    for j, one in enumerate(langs):
        ranks[np.searchsorted(keys, np.array(profiles[one], np.int64)), j] = np.arange(len(profiles[one]))
    letters = letter_table()

    def score(text: str) -> tuple[str, float]:
        codes = text_codes(text, letters)
        if not langs or len(codes) < 2:
            return UNKNOWN, 0.0
        distance = out_of_place(ranked(ngram_keys(codes), size), keys, ranks, len(langs), size)
        best = int(np.argmin(distance))
        return langs[best], float(1.0 - distance[best])

    return score


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """Add the predicted language and a score, 1 less the normalised out-of-place distance, to every row.

    Whole texts are read, however long. A null text, an empty one, or one without a letter gives (``und``, 0).
    Ties between languages go to the first by name. Without any profile every row is ``und``. Equal rows get equal
    predictions and all come out. All columns of ``docs`` are kept; one that has an output name already is
    replaced. Empty tables give empty results.
    """
    for name in out:
        docs = docs.drop(name)
    schema = wider(docs, f"`{out[0]}` string, `{out[1]}` double")
    at = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(profiles)
        for batch in batches:
            for part, texts in pieces(batch, batch.schema.names[at], PIECE_BYTES):
                got = [score(t) for t in texts.to_pylist()]
                arrays = [*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *out])

    return docs.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The contract's fold: rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: learn from the other folds of ``documents`` and predict all of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out()))
    scored = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles, out=("lang_pred", "score"))
    return scored.select("doc_id", "held_out", "lang_pred", "score")
