"""Mentions: typed spans over a document's tokens, made by rules, and what is read off them.

Mentions are (doc_id, ent_id, start_token, end_token, type, sent_idx); ``ord`` is their place in a document in
order of (start, end, id, type).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators.grouped import dealt, joined

#: Patterns of the rule annotator, tried in order on whole tokens; marks at a token's edges don't count.
EDGE = "[^A-Za-z0-9]*+"
RULES = {"NUM": f"^{EDGE}[0-9]++{EDGE}$", "CAP": f"^{EDGE}[A-Z][a-z]++{EDGE}$"}
MAIL = r"^[^@]+@[^@]+$"


def rule_tag() -> F.Column:
    """The rule annotator's type of a token, null if it has none."""
    tag = F.when(F.contains("token", F.lit("@")) & F.col("token").rlike(MAIL), "MAIL")
    for kind, pattern in RULES.items():
        tag = tag.when(F.col("token").rlike(pattern), kind)
    return tag


def annotate(tokens: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, sent_idx, tag): the rule annotator's type of each token that has one."""
    tagged = tokens.select("doc_id", "tok_idx", "sent_idx", rule_tag().alias("tag"))
    return tagged.where("tag IS NOT NULL")


def runs(tagged: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, start_token, end_token, type): neighbouring tokens of one tag within a sentence.

    Rows are dealt by document, which serves the window, the aggregate, and what numbers mentions later.
    """
    tagged = dealt(tagged, "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id", "sent_idx", "tag").orderBy("tok_idx"))
    islands = tagged.withColumn("island", F.col("tok_idx") - place).groupBy("doc_id", "sent_idx", F.col("tag").alias("type"), "island")
    return islands.agg(F.min("tok_idx").alias("start_token"), (F.max("tok_idx") + 1).alias("end_token")).drop("island")


def numbered(spans: DataFrame) -> DataFrame:
    """Mentions with ``ord`` and an ``ent_id`` made from it, in order of (start, end, type)."""
    order = Window.partitionBy("doc_id").orderBy("start_token", "end_token", "type")
    placed = spans.withColumn("ord", F.row_number().over(order) - 1)
    return placed.select("doc_id", F.concat(F.lit("T"), F.col("ord") + 1).alias("ent_id"), "start_token", "end_token", "type", "sent_idx", "ord")


def rule_mentions(tokens: DataFrame) -> DataFrame:
    """Runs of equal tags, and around runs that begin at an even token a context mention of two more tokens.

    The contexts make mentions that are nested, overlap, and reach over the end of a sentence.
    """
    found = runs(annotate(tokens))
    span = lambda kind, end: F.struct(kind.alias("type"), end.alias("end_token"))
    context = F.when(F.col("start_token") % 2 == 0, span(F.lit("CTX"), F.col("end_token") + 2))
    both = F.filter(F.array(span(F.col("type"), F.col("end_token")), context), lambda x: x.isNotNull())
    return numbered(found.select("doc_id", "sent_idx", "start_token", F.inline(both)))


def as_struct(prefix: str = "") -> F.Column:
    names = ["ent_id", "start_token", "end_token", "type", "sent_idx", "ord"]
    return F.struct(*(F.col(prefix + n).alias(n) for n in names))


def distinct_spans(spans: DataFrame) -> DataFrame:
    """A sorted set of spans: duplicates out, and their ordinals in a document."""
    once = spans.dropDuplicates(["doc_id", "start_token", "end_token"])
    return once.withColumn("span_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_token", "end_token")) - 1)


def at_tokens(mentions: DataFrame) -> DataFrame:
    """The inverted index: one row for each token that a mention covers."""
    return mentions.withColumn("tok_idx", F.explode(F.sequence("start_token", F.col("end_token") - 1)))


#: Tokens of a bin in which mentions and the ranges that may hold them meet.
BIN = 32


def within(ranges: DataFrame, start: F.Column, end: F.Column, mentions: DataFrame, mention: str = "m") -> DataFrame:
    """Rows of ranges (doc_id, ...) with each mention, as a struct, that begins at ``start`` or later and ends at ``end`` or before.

    They meet in bins of tokens, each mention in the one that it begins in, so that a document's mentions and ranges
    don't all meet.
    """
    names = ranges.columns
    begun = mentions.select("doc_id", F.floor(F.col("start_token") / BIN).alias("bin"), F.struct(*(c for c in mentions.columns if c != "doc_id")).alias(mention))
    spread = ranges.withColumn("bin", F.explode(F.sequence(F.floor(start / BIN), F.floor(F.greatest(start, end) / BIN))))
    met = joined(spread, begun, ["doc_id", "bin"])
    return met.where((F.col(f"{mention}.start_token") >= start) & (F.col(f"{mention}.end_token") <= end)).select(*names, mention)


def contained_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (doc_id, container, mention) where the container covers the mention."""
    a = outer.select("doc_id", as_struct().alias("container"))
    found = within(a, F.col("container.start_token"), F.col("container.end_token"), inner)
    return found.select("doc_id", "container", as_struct("m.").alias("mention"))


def sentence_of(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mentions with the sentence of their first token, also if they reach into the next one."""
    at = tokens.select("doc_id", F.col("tok_idx").alias("start_token"), F.col("sent_idx").alias("own_sent"))
    return mentions.join(at, ["doc_id", "start_token"]).withColumn("sent_idx", F.col("own_sent")).drop("own_sent")


def paragraph_of(mentions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Mentions with the paragraph that their sentence is in, looked up by sentence."""
    spread = paragraphs.where("start_sentence < end_sentence").withColumn("sent_idx", F.explode(F.sequence("start_sentence", F.col("end_sentence") - 1)))
    return mentions.join(spread.drop("start_sentence", "end_sentence"), ["doc_id", "sent_idx"])


def longest_paragraph(paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row: the most tokens and the most sentences of any paragraph, 1 at least."""
    first = sentences.select("doc_id", F.col("sent_idx").alias("start_sentence"), F.col("start_token").alias("from_token"))
    last = sentences.select("doc_id", (F.col("sent_idx") + 1).alias("end_sentence"), F.col("end_token").alias("to_token"))
    sized = paragraphs.join(first, ["doc_id", "start_sentence"]).join(last, ["doc_id", "end_sentence"])
    return sized.agg(F.greatest(F.lit(1), F.max(F.col("to_token") - F.col("from_token"))).cast("long").alias("tokens"), F.greatest(F.lit(1), F.max(F.col("end_sentence") - F.col("start_sentence"))).cast("long").alias("sentences"))


def most_nested(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """For each token the type of the shortest mention over it (the first in order among equals) and how many cover it."""
    over = at_tokens(mentions).groupBy("doc_id", "tok_idx")
    inner = over.agg(F.min_by("type", F.struct(F.col("end_token") - F.col("start_token"), F.col("ord"))).alias("entity_type"), F.count("*").alias("entity_depth"))
    return tokens.select("doc_id", "tok_idx").join(inner, ["doc_id", "tok_idx"], "left").withColumn("entity_depth", F.coalesce("entity_depth", F.lit(0)).cast("long"))


def align_raw(raw: DataFrame, tokens: DataFrame) -> DataFrame:
    """Character spans (doc_id, id, type, start, end) to token spans.

    The first token is the one that holds the start, else the first after it; the last token is the one whose
    end the span reaches into, else the last before it. Spans that no token meets come out with nulls.
    """
    # Tokens and the ends of spans in one order of places. From the right, the last token seen is the first that
    # ends behind a place (for a start) or at it or behind it (for an end); from the left, the last that ends before.
    key = ["doc_id", "id", "type", "start", "end"]
    nothing = {c: F.lit(None).cast(t).alias(c) for c, t in raw.dtypes if c in key}
    known = tokens.select("doc_id", F.col("char_end").alias("pos"), F.lit("token").alias("kind"), F.struct("tok_idx", "char_start").alias("tok"), *(nothing[c] for c in key[1:]))
    spot = F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit("start").alias("kind")), F.struct(F.col("end").alias("pos"), F.lit("end").alias("kind"))))
    asked = raw.select(*key).select("*", spot).withColumn("tok", F.lit(None).cast(known.schema["tok"].dataType))
    both = dealt(known.unionByName(asked), "doc_id")
    from_right = Window.partitionBy("doc_id").orderBy(F.desc("pos"), F.when(F.col("kind") == "start", 0).when(F.col("kind") == "token", 1).otherwise(2)).rowsBetween(Window.unboundedPreceding, 0)
    from_left = Window.partitionBy("doc_id").orderBy("pos", (F.col("kind") == "token").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"after": F.last("tok", ignorenulls=True).over(from_right), "before": F.last("tok.tok_idx", ignorenulls=True).over(from_left)}).where("kind <> 'token'")
    reached = F.when(F.col("after.char_start") < F.col("pos"), F.col("after.tok_idx")).otherwise(F.col("before"))
    found = seen.groupBy(*key).agg(F.max(F.when(F.col("kind") == "start", F.col("after.tok_idx"))).alias("start_token"), (F.max(F.when(F.col("kind") == "end", reached)) + 1).alias("end_token"))
    ok = F.col("start_token") < F.col("end_token")
    return found.withColumns({"start_token": F.when(ok, F.col("start_token")), "end_token": F.when(ok, F.col("end_token"))})


def borders(sentences: DataFrame) -> DataFrame:
    """For each token start, in or end of its sentence; a sentence of one token has a start only."""
    tokens = sentences.withColumn("tok_idx", F.explode(F.sequence("start_token", F.col("end_token") - 1)))
    tag = F.when(F.col("tok_idx") == F.col("start_token"), "start").when(F.col("tok_idx") == F.col("end_token") - 1, "end").otherwise("in")
    return tokens.select("doc_id", "tok_idx", tag.alias("border"))


def type_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def filter_types(mentions: DataFrame, dropped: list[str], merged: dict[str, str]) -> DataFrame:
    """Leave out types, then rename; see ``merge_pattern`` for the renaming."""
    kept = mentions.where(~F.col("type").isin(dropped)) if dropped else mentions
    if not merged:
        return kept
    renamed = F.create_map(*(F.lit(x) for pair in merged.items() for x in pair))
    return kept.withColumn("type", F.coalesce(F.element_at(renamed, F.col("type")), F.col("type")))


def merge_pattern(groups: dict[str, list[str]]) -> dict[str, str]:
    """From a new type's old ones to a renaming; an old type in two groups is an error."""
    out: dict[str, str] = {}
    for new, olds in groups.items():
        for old in olds:
            if old in out:
                raise ValueError(f"{old} is merged twice")
            out[old] = new
    return out


def strip_quotes(mentions: DataFrame, tokens: DataFrame, quotes: str) -> DataFrame:
    """Mentions of more than two tokens that stand in quotation marks lose these."""
    is_quote = tokens.select("doc_id", "tok_idx", (F.instr(F.lit(quotes), F.col("token")) > 0).alias("quote"))
    first = is_quote.select("doc_id", F.col("tok_idx").alias("start_token"), F.col("quote").alias("q1"))
    last = is_quote.select("doc_id", (F.col("tok_idx") + 1).alias("end_token"), F.col("quote").alias("q2"))
    joined = mentions.join(first, ["doc_id", "start_token"]).join(last, ["doc_id", "end_token"])
    quoted = (F.col("end_token") - F.col("start_token") > 2) & F.col("q1") & F.col("q2")
    return joined.withColumns({"start_token": F.when(quoted, F.col("start_token") + 1).otherwise(F.col("start_token")), "end_token": F.when(quoted, F.col("end_token") - 1).otherwise(F.col("end_token"))}).drop("q1", "q2")


def rendered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, piece_idx, text, type): a text cut at spans (doc_id, start, end, type) of characters, which don't overlap; type is null between them.

    A document's spans come to its text as one row, and the text is cut there.
    """
    ranges = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("spans"))
    joined = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(ranges, "doc_id", "left").select("doc_id", "text", "spans.start", "spans.end", "spans.type")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, starts, ends, types in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                text = text.as_py()
                pieces, at = [], 0
                for start, end, kind in zip(starts or [], ends or [], types or [], strict=True):
                    pieces += [(text[at:start], None), (text[start:end], kind)]
                    at = end
                pieces.append((text[at:], None))
                pieces = [x for x in pieces if x[0]]
                if pieces:
                    columns = [pa.array([doc_id] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array([t for t, _ in pieces], pa.string()), pa.array([k for _, k in pieces], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece_idx", "text", "type"])

    return joined.mapInArrow(cut, "doc_id long, piece_idx int, text string, type string")
