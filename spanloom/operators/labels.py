"""Codecs between mentions and a tag for each token of a sentence.

Schemes: ``io`` (I only), ``bio2`` (B where a mention of the same type ends right before), ``bio`` (B first),
``bilou`` (U for one token, else B, I, L). A tag's type is what follows its last hyphen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For each scheme the symbols that open a mention and those that close one.
SYMBOLS = {"io": ([], []), "bio2": (["B"], []), "bio": (["B"], []), "bilou": (["B", "U"], ["U", "L"])}
OUTSIDE = "O"


def possible_tags(types: DataFrame, scheme: str) -> DataFrame:
    """(tag) for all types of a (type) table, and the outside tag."""
    symbols = {"io": "I", "bio2": "BI", "bio": "BI", "bilou": "BILU"}[scheme]
    tags = types.select(F.explode(F.array(*(F.concat(F.lit(f"{s}-"), "type") for s in symbols))).alias("tag")).distinct()
    return tags.unionByName(types.sparkSession.createDataFrame([(OUTSIDE,)], "tag string"))


def encode(tokens: DataFrame, mentions: DataFrame, scheme: str) -> DataFrame:
    """(doc_id, tok_idx, sent_idx, tag). Mentions that overlap in a token are an error."""
    if scheme not in SYMBOLS:
        raise KeyError(scheme)
    order = Window.partitionBy("doc_id", "type").orderBy("start_token")
    follows = F.coalesce(F.lag("end_token").over(order) == F.col("start_token"), F.lit(False))
    covered = mentions.withColumn("follows", follows).withColumn("tok_idx", F.explode(F.sequence("start_token", F.col("end_token") - 1)))
    first, last = F.col("tok_idx") == F.col("start_token"), F.col("tok_idx") == F.col("end_token") - 1
    symbol = {
        "io": F.lit("I"),
        "bio2": F.when(first & F.col("follows"), "B").otherwise("I"),
        "bio": F.when(first, "B").otherwise("I"),
        "bilou": F.when(first & last, "U").when(first, "B").when(last, "L").otherwise("I"),
    }[scheme]
    tags = covered.groupBy("doc_id", "tok_idx").agg(F.first(F.concat_ws("-", symbol, "type")).alias("tag"), F.count("*").alias("n"))
    tags = tags.select("doc_id", "tok_idx", F.when(F.assert_true(F.col("n") == 1, F.lit("mentions overlap")).isNull(), F.col("tag")).alias("tag"))
    return tokens.select("doc_id", "tok_idx", "sent_idx").join(tags, ["doc_id", "tok_idx"], "left").withColumn("tag", F.coalesce("tag", F.lit(OUTSIDE)))


def _parts(tag: Column) -> tuple[Column, Column]:
    return F.substring_index(tag, "-", 1), F.substring_index(tag, "-", -1)


def decode(tagged: DataFrame, scheme: str) -> DataFrame:
    """(doc_id, sent_idx, start_token, end_token, type) from (doc_id, tok_idx, sent_idx, tag), within sentences.

    With nothing open, a closing symbol is a span of one token and any other symbol opens one. With a span open, the
    outside tag ends it before, another type or an opening symbol ends it before and opens a new one, and a closing
    symbol ends it here. So a tag either opens for sure, or leaves nothing open, or leaves things as they were (a
    closing symbol that would open anew), and what is open after a tag is what the last sure one said.
    """
    opening, closing = SYMBOLS[scheme]
    order = Window.partitionBy("doc_id", "sent_idx").orderBy("tok_idx")
    symbol, kind = _parts(F.col("tag"))
    split = tagged.select("doc_id", "sent_idx", "tok_idx", (F.col("tag") == OUTSIDE).alias("outside"), symbol.alias("symbol"), kind.alias("kind"))
    anew = F.col("symbol").isin(opening) | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    marked = split.withColumn("anew", anew)
    sure = F.when(F.col("outside"), False).when(~F.col("symbol").isin(closing), True).when(~F.col("anew"), False)
    after = marked.withColumn("open_after", F.coalesce(F.last(sure, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    was_open = F.coalesce(F.lag("open_after").over(order), F.lit(False))
    begun = after.withColumn("begins", (~F.col("outside") & (~was_open | F.col("anew"))).cast("int"))
    islands = begun.withColumn("island", F.sum("begins").over(order)).where(~F.col("outside"))
    grouped = islands.groupBy("doc_id", "sent_idx", "island").agg(F.min("tok_idx").alias("start_token"), (F.max("tok_idx") + 1).alias("end_token"), F.min_by("kind", "tok_idx").alias("type"))
    return grouped.drop("island")
