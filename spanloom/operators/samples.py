"""Samples for models of relations: from mentions, sentences and relations, by properties, to coded features and padded batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions import text as T
from spanloom.operators import encode as E
from spanloom.operators import models as ML
from spanloom.operators import pairs as P
from spanloom.operators import sampling as O

#: Places that features of a pair are read at, by the names of their properties.
PLACES = ["attention", "classifier"]
DIRECTIONS = ["e1_e2", "e2_e1", "e1_in_e2", "e2_in_e1"]
#: What stands between two types in the key of a pair of types.
JOINT = "\x1f"


@dataclass
class Learned:
    """Dictionaries of a training set, each as small as the number of its types: of entity types, their pairs, relations, and what relations a pair may have."""

    types: dict[str, int]
    arguments: dict[str, int]
    labels: dict[str, int]
    valid: dict[str, list[str]]


def _codes(coded: DataFrame) -> dict[str, int]:
    return {r["value"]: r["code"] for r in coded.collect()}  # a row a type


def _filters(props: dict) -> P.Filter:
    parts = [P.different(), P.same_sentence(), P.within_tokens(props["max_candidate_distance"])]
    return P.all_of(*parts, *([P.not_intersecting()] if props.get("filter_intersecting", False) else []))


def _joint(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(JOINT), b)


def learn(mentions: DataFrame, relations: DataFrame, props: dict) -> Learned:
    """Dictionaries from a training set's mentions and its relations (doc_id, e1, e2, rel_type); relations that no candidate pair could have teach nothing."""
    kept = relations.where(_filters(props)(F.col("e1"), F.col("e2")))
    pairs = P.argument_types(kept).withColumn("key", _joint(F.col("t1"), F.col("t2")))
    labels = kept.select("rel_type").unionByName(kept.sparkSession.createDataFrame([(None,)], "rel_type string"))
    return Learned(
        types=_codes(E.dictionary(mentions.select("type"))),
        arguments=_codes(E.dictionary(pairs.select("key"))),
        labels=_codes(E.dictionary(labels, padding=False)),
        valid={r["key"]: r["rel_types"] for r in pairs.select("key", "rel_types").collect()},  # a row a pair of types
    )


def _coded(value: Column, codes: dict[str, int]) -> Column:
    """A category's code, null for one that training didn't have."""
    if not codes:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.coalesce(value.cast("string"), F.lit("None")))


def _clipped(spark, value: Column, most: int, log: bool = False) -> Column:
    """A distance's code in the dictionary of whole numbers up to ``most`` and one beyond, or of their numbers of bits."""
    codes = _codes(E.integer_dictionary(spark, 1, most, log=log))
    clipped = T.clip_unsigned(value, most)
    return _coded(T.bit_log(clipped) if log else clipped, codes)


def pair_features(spark, learned: Learned, props: dict) -> dict[str, Column]:
    """The features of a pair (e1, e2) that the properties ask for by a size of zero or more, by name."""
    e1, e2 = F.col("e1"), F.col("e2")
    tokens, sentences = S.token_distance(e1, e2), F.abs(e1["sent_idx"] - e2["sent_idx"])
    made: dict[str, Column] = {}
    for place in PLACES:
        wanted = lambda name: props.get(f"{name}_in_{place}_size", -1) >= 0  # noqa: B023, E731
        if wanted("rel_args"):
            made[f"rel_args_in_{place}"] = _coded(_joint(e1["type"], e2["type"]), learned.arguments)
        if wanted("entities_types"):
            made |= {f"entities_types_in_{place}_{k}": _coded(e["type"], learned.types) for k, e in enumerate((e1, e2))}
        if wanted("entities_token_distance"):
            made[f"entities_token_distance_in_{place}"] = _clipped(spark, tokens, props["max_token_entities_distance"])
        if wanted("entities_token_log_distance"):
            made[f"entities_token_log_distance_in_{place}"] = _clipped(spark, tokens, props["max_token_entities_distance"], log=True)
        if wanted("entities_sent_distance"):
            made[f"entities_sent_distance_in_{place}"] = _clipped(spark, sentences, props["max_sent_entities_distance"])
        if wanted("rel_dir"):
            made[f"rel_dir_in_{place}"] = _coded(S.direction(e1, e2), {d: k + 1 for k, d in enumerate(sorted(DIRECTIONS))})
    return made


def _mask(learned: Learned) -> Column:
    """For each label of the dictionary 1 if it is none, or one that a training pair of these types had, else 0."""
    names = sorted(learned.labels, key=learned.labels.get)
    masks = {key: [int(n == "None" or n in valid) for n in names] for key, valid in learned.valid.items()}
    if not masks:
        return F.array(*(F.lit(int(n == "None")) for n in names))
    table = F.create_map(*(x for key, mask in masks.items() for x in (F.lit(key), F.array(*map(F.lit, mask)))))
    return F.try_element_at(table, _joint(F.col("e1.type"), F.col("e2.type")))


def relation_samples(mentions: DataFrame, sentences: DataFrame, learned: Learned, props: dict, relations: DataFrame | None = None, tokens: DataFrame | None = None, token_features: list[str] = ()) -> DataFrame:
    """A sample for each candidate pair of types that training related: doc_id, e1, e2, ``labels_mask``, the pair's features, ``indices``, ``seq_len``.

    With ``relations`` samples have ``labels`` too, and of unrelated pairs only as many as ``negative_samples_ratio`` times
    the others stay. With ``tokens`` the named features of all tokens of the pair's sentence come along as arrays. Pairs
    meet in bins of tokens, so their number grows with what lies within the greatest distance of a mention.
    """
    spark = mentions.sparkSession
    pairs = P.candidates(mentions, _filters(props), in_sentence=True, near=props["max_candidate_distance"])
    known = list(learned.valid)
    pairs = pairs.where(_joint(F.col("e1.type"), F.col("e2.type")).isin(known) if known else F.lit(False))
    if relations is not None:
        pairs = P.labelled(pairs, relations.where(_filters(props)(F.col("e1"), F.col("e2"))))
        pairs = P.down_sampled(pairs.withColumns({"id1": F.col("e1.ent_id"), "id2": F.col("e2.ent_id")}), ["doc_id", "id1", "id2"], props.get("negative_samples_ratio", float("inf"))).drop("id1", "id2")
        pairs = pairs.withColumn("labels", _coded(F.col("label"), learned.labels))
    pairs = pairs.withColumns(pair_features(spark, learned, props)).withColumn("labels_mask", _mask(learned))
    bounds = sentences.select("doc_id", "sent_idx", F.col("start_token").alias("w_start"), F.col("end_token").alias("w_end"))
    placed = pairs.withColumn("sent_idx", F.col("e1.sent_idx")).join(bounds, ["doc_id", "sent_idx"])
    at = lambda e: F.array(*((F.col(f"{e}.{b}_token") - F.col("w_start")) for b in ("start", "end")))
    placed = placed.withColumns({"indices": F.array(at("e1"), at("e2")), "seq_len": F.col("w_end") - F.col("w_start")})
    if tokens is not None and token_features:
        rows = ML.sentence_samples(tokens, list(token_features)).drop("seq_len")
        placed = placed.join(rows, ["doc_id", "sent_idx"])
    return placed.drop("sent_idx", "w_start", "w_end", "label")


def padded_batches(samples: DataFrame, size: int, order: list[str], sequences: dict[str, object]) -> DataFrame:
    """Samples with ``batch``, and arrays of each batch filled up to its longest one with their padding values."""
    out = O.batches(samples, size, order)
    for name, padding in sequences.items():
        out = O.padded(out, ["batch"], name, F.lit(padding))
    return out


def gazetteer_flags(tokens: DataFrame, terms: DataFrame, out: str, column: str = "token", **flags: bool) -> DataFrame:
    """Tokens with the code of whether ``terms`` (term) has them, both normalised alike: 1 for no, 2 for yes, 0 is left to padding.

    The terms may be any number: tokens are looked up by their distinct words, so that a frequent word is looked up once.
    """
    word = T.normalize(F.col(column), **flags)
    known = terms.select(T.normalize(F.col("term"), **flags).alias("_word")).distinct()
    marked = tokens.withColumn("_word", word)
    held = marked.select("_word").distinct().join(known, "_word", "left_semi").withColumn("_held", F.lit(True))
    return marked.join(held, "_word", "left").withColumn(out, F.when(F.col("_held"), 2).otherwise(1)).drop("_word", "_held")
