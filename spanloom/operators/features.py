"""Features of tokens, mentions and pairs that models read, and the samples made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions.text import log_distance
from spanloom.operators import encode as E
from spanloom.operators import labels as L
from spanloom.operators import trees as D
from spanloom.operators.grouped import gathered, joined
from spanloom.operators.mentions import at_tokens, within

def positions_to_span(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each token of a mention's sentence its token distance to the mention, which has no sign, and by how many sentences it comes before."""
    near = tokens.select("doc_id", "sent_idx", "tok_idx")
    joined = mentions.select("doc_id", "ent_id", "sent_idx", S.span("start_token", "end_token").alias("span")).join(near, ["doc_id", "sent_idx"])
    here = S.span(F.col("tok_idx"), F.col("tok_idx") + 1)
    return joined.select("doc_id", "ent_id", "tok_idx", S.token_distance(F.col("span"), here).alias("token_position"))


def sentence_positions(mentions: DataFrame, sentences: DataFrame, around: int) -> DataFrame:
    """(doc_id, ent_id, other_sent, sentence_position): the mention's sentence number less that of each sentence at most ``around`` away."""
    spread = mentions.select("doc_id", "ent_id", "sent_idx", F.explode(F.sequence(F.col("sent_idx") - around, F.col("sent_idx") + around)).alias("other_sent"))
    known = sentences.select("doc_id", F.col("sent_idx").alias("other_sent"))
    return spread.join(known, ["doc_id", "other_sent"]).select("doc_id", "ent_id", "other_sent", (F.col("sent_idx") - F.col("other_sent")).alias("sentence_position"))


def from_map(features: Column, names: list[str]) -> list[Column]:
    """A column for each named entry of a map of features, null where a token has none."""
    return [F.try_element_at(features, F.lit(n)).alias(n) for n in names]


def with_namespace(df: DataFrame, namespace: str, columns: list[str]) -> DataFrame:
    """Columns with the namespace and an underscore before their names."""
    return df.withColumnsRenamed({c: f"{namespace}_{c}" for c in columns}) if namespace else df


def entity_type_at(spots: DataFrame, entities: DataFrame, at: str, out: str, outside: str = L.OUTSIDE) -> DataFrame:
    """Rows (doc_id, ``at``, ...) with the type of the first entity in order over that token, or the outside mark."""
    types = at_tokens(entities.select("doc_id", "start_token", "end_token", "type", "ord")).groupBy("doc_id", F.col("tok_idx").alias(at)).agg(F.min_by("type", "ord").alias(out))
    return spots.join(types, ["doc_id", at], "left").withColumn(out, F.coalesce(out, F.lit(outside)))


def any_marked(mentions: DataFrame, tokens: DataFrame, mark: str, out: str, outside: str = L.OUTSIDE) -> DataFrame:
    """Mentions with whether some token of theirs has a mark that isn't the outside one."""
    marked = tokens.where(F.col(mark) != outside).select("doc_id", "tok_idx").distinct()
    held = at_tokens(mentions.select("doc_id", "ent_id", "start_token", "end_token")).join(marked, ["doc_id", "tok_idx"], "left_semi").select("doc_id", "ent_id").distinct()
    return mentions.join(held.withColumn(out, F.lit(True)), ["doc_id", "ent_id"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def valid_labels_mask(mentions: DataFrame, mapping: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Mentions with ``labels_mask``: for each label of the vocabulary 1 if the mapping (type, labels) has it for their type, else 0."""
    valid = mapping.select("type", F.col("labels").alias("valid"))
    mask = F.array(*(F.coalesce(F.array_contains("valid", v).cast("int"), F.lit(0)) for v in vocabulary))
    return mentions.join(valid, "type", "left").withColumn("labels_mask", mask).drop("valid")


def layer_tags(tokens: DataFrame, layer: DataFrame, scheme: str) -> tuple[DataFrame, DataFrame]:
    """Tokens with the tag of a second layer of mentions and its code, and the dictionary of all tags that the layer's types can have."""
    tagged = L.encode(tokens, layer, scheme)
    coded = E.dictionary(L.possible_tags(layer.select("type").distinct(), scheme).select("tag"), padding=True)
    return E.encode(tagged, "tag", coded, "tag_code"), coded


def with_context(pairs: DataFrame, mentions: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs with ``context``: ids of mentions that begin no earlier than the first and end no later than the second, in order of head.

    Ties go by order of place.
    """
    m = joined(mentions, heads.select("doc_id", "ent_id", "head"), ["doc_id", "ent_id"])
    ids = ["doc_id", "e1", "e2"]
    inside = within(pairs.select(*ids).distinct(), F.col("e1.start_token"), F.col("e2.end_token"), m)
    found = gathered(inside, *ids).groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("m.head", "m.ord", "m.ent_id"))), lambda x: x["ent_id"]).alias("context"))
    return joined(pairs, found, ids, "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))


def empty_features(tokens: DataFrame, features: list[str]) -> DataFrame:
    """(doc_id, feature, state) of features that are null in all of a document's tokens, and so none of it (``empty``), or in some (``partial``)."""
    counted = tokens.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.count(f).alias(f) for f in features))
    states = counted.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.when(F.col(f) == 0, "empty").when(F.col(f) < F.col("n"), "partial").alias("state")) for f in features))).alias("s"))
    return states.select("doc_id", "s.*").where("state IS NOT NULL")


#: Parts of speech, in either order, between which paths are samples by default. Fixed values.
PATH_POS = [("NN", "NN"), ("NNS", "NNS"), ("NN", "NNS"), ("FW", "NN"), ("FW", "NNS"), ("FW", "FW")]


def path_pairs(tokens: DataFrame, pos: list[tuple[str, str]] = PATH_POS) -> DataFrame:
    """(doc_id, sent_idx, source, target): pairs of a sentence's tokens in order whose parts of speech, in either order, are among those given."""
    spark = tokens.sparkSession
    both = sorted({p for a, b in pos for p in ((a, b), (b, a))})
    kinds = F.broadcast(spark.createDataFrame(both, "p1 string, p2 string"))  # as many rows as given
    t = tokens.where(F.col("pos").isin(sorted({p for pair in both for p in pair}))).select("doc_id", "sent_idx", "tok_idx", "pos")
    first = t.select("doc_id", "sent_idx", F.col("tok_idx").alias("source"), F.col("pos").alias("p1")).join(kinds, "p1")
    second = t.select("doc_id", "sent_idx", F.col("tok_idx").alias("target"), F.col("pos").alias("p2"))
    return first.join(second, ["doc_id", "sent_idx", "p2"]).where("source < target").select("doc_id", "sent_idx", "source", "target")


def path_samples(tokens: DataFrame, pos: list[tuple[str, str]] = PATH_POS, subtree: bool = False) -> DataFrame:
    """``path_pairs`` with a label for each token of the sentence: whether it is on the path, and with ``subtree`` below it."""
    return D.path_labels(path_pairs(tokens, pos), tokens, subtree)


def streams(*parts: DataFrame) -> DataFrame:
    """All rows of several tables, one behind the other; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def relation_dictionary(relations: DataFrame) -> DataFrame:
    """Codes of relation types, no relation among them, without padding."""
    types = relations.select("rel_type").distinct()
    return E.dictionary(types.unionByName(types.sparkSession.createDataFrame([(None,)], "rel_type string")), padding=False)


def relation_categories(relations: DataFrame) -> DataFrame:
    """Relations (doc_id, e1, e2, rel_type) with what they are evaluated by: type, types of both arguments, rounded logarithm of token distance, sentence distance."""
    return relations.withColumns(
        {
            "args_types": F.concat_ws(",", "e1.type", "e2.type"),
            "args_token_log_dists": log_distance(S.token_distance(F.col("e1"), F.col("e2"))),
            "args_sent_dists": F.abs(F.col("e1.sent_idx") - F.col("e2.sent_idx")),
        }
    )
