"""Choices of coreference: noun mentions and their chains, heuristics on pairs, and ways from scored pairs to chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import chains as C
from spanloom.operators import pairs as P
from spanloom.operators.grouped import joined
from spanloom.operators.mentions import as_struct

NOUN, LABEL = "noun", "COREF"


def noun_chains(mentions: DataFrame, chains: DataFrame, noun: str = NOUN) -> DataFrame:
    """(doc_id, ent_id, chain_id) of the noun members of chains; chains are made first, so nouns that only a pronoun connects stay together."""
    nouns = mentions.where(F.col("type") == noun).select("doc_id", "ent_id")
    return joined(chains, nouns, ["doc_id", "ent_id"], "left_semi")


def nouns_only(mentions: DataFrame, chains: DataFrame, noun: str = NOUN) -> tuple[DataFrame, DataFrame]:
    """Noun mentions, and the relations (doc_id, first, second) that connect each chain's noun members in order."""
    kept = mentions.where(F.col("type") == noun)
    return kept, C.chain_relations(kept, noun_chains(mentions, chains, noun))


def with_words(mentions: DataFrame, tokens: DataFrame, word: str) -> DataFrame:
    """Mentions with the sorted set of their tokens' words."""
    spread = mentions.select("doc_id", "ent_id", F.explode(F.sequence("start_token", F.col("end_token") - 1)).alias("tok_idx"))
    words = spread.join(tokens.select("doc_id", "tok_idx", F.col(word).alias("word")), ["doc_id", "tok_idx"])
    sets = words.groupBy("doc_id", "ent_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    return mentions.join(sets, ["doc_id", "ent_id"], "left")


def exact_matches(mentions: DataFrame, tokens: DataFrame, word: str, noun: str = NOUN) -> DataFrame:
    """(doc_id, e1, e2, label): pairs of nouns, in order of place, whose sets of words are equal.

    Joined on the set, so only mentions that match meet.
    """
    worded = with_words(mentions.where(F.col("type") == noun), tokens, word).where("words IS NOT NULL")
    a = worded.select("doc_id", "words", as_struct().alias("e1"))
    b = worded.select("doc_id", "words", as_struct().alias("e2"))
    return a.join(b, ["doc_id", "words"]).where("e1.ord < e2.ord").select("doc_id", "e1", "e2", F.lit(LABEL).alias("label"))


def intersecting(mentions: DataFrame) -> DataFrame:
    """(doc_id, e1, e2, label): pairs in order of place that overlap; the label is null, as they are no coreference.

    They meet at the tokens that both cover.
    """
    covered = mentions.select("doc_id", as_struct().alias("m"), F.explode(F.sequence("start_token", F.col("end_token") - 1)).alias("tok_idx"))
    a, b = covered.withColumnRenamed("m", "e1"), covered.withColumnRenamed("m", "e2")
    # At the later start both stand for the first time, so each pair comes out once.
    met = a.join(b, ["doc_id", "tok_idx"]).where("e1.ord < e2.ord AND tok_idx = greatest(e1.start_token, e2.start_token)")
    return met.select("doc_id", "e1", "e2", F.lit(None).cast("string").alias("label"))


def first_of(*classified: DataFrame) -> DataFrame:
    """(doc_id, e1, e2, label, score): of several heuristics' pairs each pair with the label of the first that has it, at a score of 1."""
    ranked = [c.select("doc_id", "e1", "e2", "label", F.lit(i).alias("rank")) for i, c in enumerate(classified)]
    rows = ranked[0]
    for other in ranked[1:]:
        rows = rows.unionByName(other)
    best = rows.groupBy("doc_id", "e1", "e2").agg(F.min_by(F.struct("label"), "rank").alias("b"))
    return best.select("doc_id", "e1", "e2", F.col("b.label").alias("label"), F.lit(1.0).alias("score"))


def is_intersecting(a: Column, b: Column) -> Column:
    return S.intersects(a, b)


def candidate_pairs(mentions: DataFrame, most: int, relations: DataFrame | None = None, keep: P.Filter | None = None) -> DataFrame:
    """(doc_id, e1, e2, label): pairs that a model of coreference is asked about, or is trained on if relations are given.

    Without relations (doc_id, first, second) each mention is paired with the ``most`` before it in order. With them pairs are
    those of neighbours in a chain, and the later one's with what lies between; those related in either direction have the
    label. ``keep`` leaves pairs out before they are labelled.
    """
    if relations is None:
        pairs = P.preceding(mentions, most)
    else:
        pairs = P.training_pairs(mentions, C.chains(mentions, relations))
    if keep is not None:
        pairs = pairs.where(keep(F.col("e1"), F.col("e2")))
    if relations is None:
        return pairs.select("doc_id", "e1", "e2", F.lit(None).cast("string").alias("label"))
    known = relations.select("doc_id", "first", "second").withColumn("rel_type", F.lit(LABEL))
    return P.labelled(pairs, P.resolve(known, mentions, [LABEL])).select("doc_id", "e1", "e2", "label")


#: Ways from scored pairs to chains or links, by name.
COLLECTING: dict[str, Callable[..., DataFrame]] = {"easy_first": C.easy_first, "rank": C.rank, "pron_rank": C.pronoun_rank, "pron_vote_rank": C.pronoun_votes, "default": C.chains}


def collecting_strategy(name: str) -> Callable[..., DataFrame]:
    if name not in COLLECTING:
        raise KeyError(f"no way to collect chains is called {name}")
    return COLLECTING[name]
