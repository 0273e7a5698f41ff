"""From documents to token ids: identify languages, fold near duplicates, decontaminate, mix sources, write ids.

Each stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, mixing, ngram_join, sstable, store
from spanloom.llm.store import free_name

#: Documents less like their nearest language than this go, as do those without a letter.
LEAST_LANGUAGE_SCORE = 0.2

#: Language profiles, Bayesian pruning and edit verification are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that resemble some language learned from the labelled ones; the others go.

    Null and empty texts and those without a letter go. Equal rows share their fate; texts of any length are read
    whole; ties between languages don't matter here. Without any label in the table no language is known, so nothing
    can be told and all rows stay; an empty table gives an empty one. A null doc_id or source is no reason to go. All
    columns stay as they are.
    """
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    if not profiles:
        return docs
    names = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "lang_score")
    scored = langid.identify(docs, profiles, out=names)
    return scored.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE)).drop(*names)


def fold_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that Jaccard links of 0.8 or more connect.

    That of the smallest doc_id stays; rows of one doc_id and different texts are documents of their own, of rows
    equal in both one stays. Rows with a null doc_id, and null, empty and blank texts, all stay. Texts of any length
    are compared whole. An empty table gives an empty one. All columns stay as they are.
    """
    return ngram_join.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no passage of ``benchmark``.

    Null and empty texts hold none and stay, as do all rows where ``benchmark`` is empty; its null texts are passed
    over. Equal rows share their fate, texts of any length are searched whole, and of several passages one is enough.
    An empty table gives an empty one. All columns stay as they are.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources weigh the square root of their sizes, and shuffle.

    A null source is a source; a null doc_id draws as the text ``null``; rows of equal doc_ids draw alike; texts,
    null, empty or long, aren't looked at. An empty table gives an empty one. All columns stay as they are, also those
    named like what mixing adds.
    """
    names = free_name(docs.columns, "copy"), free_name(docs.columns, "shuffle_key")
    return mixing.mix(docs, out=names).drop(*names)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write shards of token ids; what comes back is each document's place and digest, read from them.

    A null or empty text is the end id alone; a long one is one entry. Rows come in order of doc_id, null first;
    those that repeat one are entries of their own. An empty table gives no shard and no row. Only doc_id and text
    are written, whatever other columns there are.
    """
    return sstable.documents_round_trip(spark, docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", fold_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with store.tables_of_run() as written:
        for name, stage in STAGES:
            docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            store.release(spark, written[:-1])  # what this stage read and wrote on its way
    return docs
