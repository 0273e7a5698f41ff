"""Readers of annotation formats. Each gives tables keyed by ``doc_id``, a hash of the document's ``name``.

Files are read by Spark, whole where a document is a file, so that any store and any number of files will do.
Raw entities are (doc_id, id, type, start, end) in characters, raw relations (doc_id, first, second, rel_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import labels, rewrite, segment
from spanloom.operators.chains import chain_relations
from spanloom.operators.sampling import with_place
from spanloom.operators.trees import span_heads


def doc_key(name: Column) -> Column:
    return F.xxhash64(name)


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(doc_id, name, text): whole files of a suffix below a folder, named without folder and suffix."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return read.select(name.alias("name"), F.col("value").alias("text")).withColumn("doc_id", doc_key(F.col("name"))).select("doc_id", "name", "text")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n, line) of whole files; a line end at the very end begins no further line."""
    text = F.regexp_replace("text", "\r\n", "\n")
    return docs.select("doc_id", "name", F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("n", "line"))


def raw_text(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """A document for each file."""
    return files(spark, path, suffix)


def split_text(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """A document for each part of a file between blank lines, named by file and number."""
    parts = files(spark, path, suffix).select("name", F.posexplode(F.split("text", "\n\n")).alias("i", "text"))
    return parts.select(F.concat_ws("_", "name", "i").alias("name"), "text").withColumn("doc_id", doc_key(F.col("name"))).select("doc_id", "name", "text")


def parse_standoff(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw entities, with an array of fragments, and raw relations of standoff annotations.

    An argument that is in a group of equal ones stands for the others too, one argument at a time.
    """
    rows = numbered_lines(docs).where("line <> ''").select("doc_id", F.get(F.split("line", "\t"), F.lit(0)).alias("id"), F.get(F.split("line", "\t"), F.lit(1)).alias("info"))
    kind, words = F.substring("id", 1, 1), F.split("info", " ")
    fragments = F.transform(F.split(F.regexp_replace("info", r"^\S+ ", ""), ";"), lambda x: F.struct(F.get(F.split(x, " "), F.lit(0)).cast("int").alias("start"), F.get(F.split(x, " "), F.lit(1)).cast("int").alias("end")))
    entities = rows.where(kind == "T").select("doc_id", "id", F.get(words, F.lit(0)).alias("type"), fragments.alias("fragments"))
    argument = lambda i: F.get(F.split(F.get(words, F.lit(i)), ":"), F.lit(1))
    relations = rows.where(kind.isin("R", "E")).select("doc_id", F.get(words, F.lit(0)).alias("rel_type"), argument(1).alias("first"), argument(2).alias("second"))
    groups = rows.where(kind == "*").select("doc_id", F.slice(words, 2, 1_000_000).alias("group"))
    pairs = groups.select("doc_id", F.explode("group").alias("member"), "group").select("doc_id", "member", F.explode("group").alias("other")).where("member <> other")
    first = relations.join(pairs, (relations["doc_id"] == pairs["doc_id"]) & (F.col("first") == F.col("member"))).select(relations["doc_id"], "rel_type", F.col("other").alias("first"), "second")
    second = relations.join(pairs, (relations["doc_id"] == pairs["doc_id"]) & (F.col("second") == F.col("member"))).select(relations["doc_id"], "rel_type", "first", F.col("other").alias("second"))
    return entities, relations.unionByName(first).unionByName(second)


def merge_fragments(entities: DataFrame) -> DataFrame:
    """Entities of several fragments reach from the first start to the last end."""
    start, end = F.array_min(F.transform("fragments", lambda x: x["start"])), F.array_max(F.transform("fragments", lambda x: x["end"]))
    return entities.select("doc_id", "id", "type", start.alias("start"), end.alias("end"))


def brat(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Texts that have annotations; ``skipped`` are those that have none."""
    texts, notes = files(spark, path, ".txt"), files(spark, path, ".ann")
    entities, relations = parse_standoff(notes)
    return {"documents": texts.join(notes, "doc_id", "left_semi"), "entities": merge_fragments(entities), "relations": relations, "skipped": texts.join(notes, "doc_id", "left_anti")}


#: Relation types that hold both ways. Fixed values.
SYMMETRIC = ["Is_Linked_To", "Has_Sequence_Identical_To", "Is_Functionally_Equivalent_To"]


def bionlp(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Texts with entities from ``.a1`` (paragraphs and titles among them apart) and relations from ``.a2``, if there."""
    entities = merge_fragments(parse_standoff(files(spark, path, ".a1"))[0])
    relations = parse_standoff(files(spark, path, ".a2"))[1]
    back = relations.where(F.col("rel_type").isin(SYMMETRIC)).select("doc_id", "rel_type", F.col("second").alias("first"), F.col("first").alias("second"))
    is_paragraph = F.col("type").isin("Paragraph", "Title")
    return {"documents": files(spark, path, ".txt"), "entities": entities.where(~is_paragraph), "paragraphs": entities.where(is_paragraph).select("doc_id", "start", "end"), "relations": relations.unionByName(back).distinct()}


def chemprot(spark: SparkSession, path: str, base: str, read_negative: bool = False, fine_types: bool = True, one_gene_type: bool = True) -> dict[str, DataFrame]:
    """Abstracts, entities and relations from three tab-separated files; title and body are paragraphs."""
    read = lambda part, schema: spark.read.option("sep", "\t").option("quote", "").schema(schema).csv(f"{path}/{base}_{part}.tsv")
    abstracts = read("abstracts", "name string, title string, body string").withColumn("doc_id", doc_key(F.col("name")))
    documents = abstracts.select("doc_id", "name", F.concat_ws("\t", "title", "body").alias("text"))
    n, m = F.length("title"), F.length("body")
    paragraphs = abstracts.select("doc_id", F.inline(F.array(F.struct(F.lit(0).alias("start"), n.alias("end")), F.struct((n + 1).alias("start"), (n + 1 + m).alias("end")))))
    kind = F.when(F.col("type").isin("GENE-N", "GENE-Y"), "GENE").otherwise(F.col("type")) if one_gene_type else F.col("type")
    entities = read("entities", "name string, id string, type string, start int, end int, text string").select(doc_key(F.col("name")).alias("doc_id"), "id", kind.alias("type"), "start", "end")
    relations = read("relations", "name string, cpr string, ev_type string, fine string, arg1 string, arg2 string")
    kept = relations if read_negative else relations.where(~F.col("ev_type").contains("N"))
    after = lambda c: F.split_part(c, F.lit(":"), F.lit(2))
    made = kept.select(doc_key(F.col("name")).alias("doc_id"), after(F.col("arg1")).alias("first"), after(F.col("arg2")).alias("second"), F.col("fine" if fine_types else "cpr").alias("rel_type"))
    return {"documents": documents, "paragraphs": paragraphs, "entities": entities, "relations": made}


def _fields(docs: DataFrame) -> DataFrame:
    """Lines cut at ``#`` and split at white space; blank ones have no field."""
    bare = F.trim(F.split_part("line", F.lit("#"), F.lit(1)))
    return numbered_lines(docs).select("doc_id", "name", "n", F.filter(F.split(bare, r"\s+"), lambda x: x != "").alias("f"))


def factrueval(spark: SparkSession, path: str, blacklist: list[str] = (), keep_locorg: bool = True, collapse: bool = True) -> dict[str, DataFrame]:
    """Tokens, with sentences between blank lines, and mentions that reach over all spans of an object.

    Mentions that overlap become one, unless told not to ``collapse`` them; see ``rewrite.merge_intersecting``.
    """
    f = lambda i: F.get("f", F.lit(i))
    rows = _fields(files(spark, path, ".tokens"))
    order = Window.partitionBy("doc_id").orderBy("n")
    rows = rows.withColumn("sent_idx", F.coalesce(F.sum((F.size("f") <= 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).where(F.size("f") > 1)
    tokens = rows.select("doc_id", (F.row_number().over(order) - 1).alias("tok_idx"), "sent_idx", F.element_at("f", -1).alias("token"), f(1).cast("int").alias("char_start"), (f(1).cast("int") + f(2).cast("int")).alias("char_end"), f(0).alias("own_id"))
    spans = _fields(files(spark, path, ".spans")).where(F.size("f") > 5).select("doc_id", f(0).alias("span_id"), f(4).alias("own_id"), f(5).cast("int").alias("len"))
    spans = spans.join(tokens.select("doc_id", "own_id", "tok_idx"), ["doc_id", "own_id"]).select("doc_id", "span_id", F.col("tok_idx").alias("s"), (F.col("tok_idx") + F.col("len")).alias("e"))
    objects = _fields(files(spark, path, ".objects")).where(F.size("f") > 2).where(~f(1).isin(["Project", "Facility", *blacklist]))
    objects = objects.select("doc_id", f(0).alias("ent_id"), f(1).alias("type"), F.explode(F.slice("f", 3, 1_000_000)).alias("span_id"))
    kind = F.col("type") if keep_locorg else F.when(F.col("type") == "LocOrg", "Location").otherwise(F.col("type"))
    mentions = objects.join(spans, ["doc_id", "span_id"]).groupBy("doc_id", "ent_id", kind.alias("type")).agg(F.min("s").alias("start_token"), F.max_by("e", "s").alias("end_token"))
    if collapse:
        order = Window.partitionBy("doc_id").orderBy("start_token", "end_token", "ent_id")
        merged = rewrite.merge_intersecting(mentions.withColumn("ord", F.row_number().over(order) - 1))
        mentions = merged.select("doc_id", F.col("new_id").alias("ent_id"), "type", "start_token", "end_token").distinct()
    return {"tokens": tokens.drop("own_id"), "mentions": mentions}


def _numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, n, line) of a file's lines or those of all files below a folder, each numbered by itself."""
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return numbered_lines(read.select(doc_key(F.col("_metadata.file_path")).alias("doc_id"), name.alias("name"), F.col("value").alias("text")))


def _part_key() -> list[Column]:
    """The key and the name of a document that is part of a file (doc_id, name), by its number ``part`` in it."""
    return [F.xxhash64("doc_id", "part").alias("doc_id"), F.concat_ws("_", "name", "part").alias("name")]


def conll(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Four columns a token, blank lines between sentences, ``-DOCSTART-`` before documents; tags in bio2.

    Documents are named by file and number in it, so that any number of files can be read.
    """
    rows = _numbered_files(spark, path)
    order = Window.partitionBy("doc_id").orderBy("n")
    starts, blank = F.col("line").startswith("-DOCSTART-"), F.trim("line") == ""
    marked = rows.withColumn("d", F.sum(starts.cast("int")).over(order)).withColumn("s", F.sum((starts | blank).cast("int")).over(order)).where(~starts & ~blank)
    w = F.split(F.trim("line"), r"\s+")
    parted = marked.withColumn("part", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("d")) - 1)
    dense = parted.select(*_part_key(), "s", "n", F.get(w, F.lit(0)).alias("token"), F.get(w, F.lit(1)).alias("pos"), F.get(w, F.lit(3)).alias("tag"))
    own = Window.partitionBy("doc_id")
    tokens = dense.select("doc_id", "name", (F.row_number().over(own.orderBy("n")) - 1).alias("tok_idx"), (F.dense_rank().over(own.orderBy("s")) - 1).alias("sent_idx"), "token", "pos", "tag")
    return {"tokens": tokens, "mentions": labels.decode(tokens, "bio2")}


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of CoNLL-U files, a document for each sentence, named by file and number in it: token, lemma, pos, feats as a map, head distance, label."""
    blank = (F.trim("line") == "").cast("int")
    own = Window.partitionBy("doc_id")
    rows = _numbered_files(spark, path).withColumn("s", F.sum(blank).over(own.orderBy("n"))).where("line RLIKE '^[0-9]+\t'")
    rows = rows.withColumn("part", F.dense_rank().over(own.orderBy("s")) - 1)
    c = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    feats = F.when(c(5) == "_", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(c(5), F.lit("[|]"), F.lit("=")))
    head = F.when(c(6) == "0", 0).otherwise(c(6).cast("int") - c(0).cast("int"))
    return rows.select(*_part_key(), (c(0).cast("int") - 1).alias("tok_idx"), F.lit(0).alias("sent_idx"), c(1).alias("token"), c(2).alias("lemma"), c(3).alias("pos"), feats.alias("feats"), head.alias("head_dist"), c(7).alias("dt_label"))


#: Kinds of mentions that count as pronouns, and those that count as nouns; others keep their kind. Fixed values.
PRONOUN_KINDS = ["refl", "poss", "rel", "dem", "pron"]
NOUN_KINDS = ["noun", "appo"]


def rucor(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tokens, sentences (they end at the grammeme SENT, and never inside a mention), mentions, chains and all relations of chains.

    Where ``TokensSpeech.txt`` is there too, tokens have its marks, and those that it lacks are left out. A mention
    reaches from its first listed token to its last; one without attributes or kind is a noun.
    """
    read = lambda name, columns: spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("pathGlobFilter", name).schema(", ".join(f"{c} string" for c in columns)).csv(path)
    raw = read("Tokens.txt", ["doc", "shift", "length", "token", "lemma", "gram"])
    key = doc_key(F.col("doc")).alias("doc_id")
    tokens = raw.select(key, F.col("doc").alias("name"), F.col("shift").cast("int").alias("shift"), "token", "lemma", "gram")
    marks = ["speech", "said", "author_comment", "speech_verb"]
    speech = read("TokensSpeech.txt", ["doc", "shift", "length", "token", *marks]).select(key, F.col("shift").cast("int").alias("shift"), *marks)
    if speech.limit(1).count():
        tokens = tokens.join(speech, ["doc_id", "shift"])
    order = Window.partitionBy("doc_id").orderBy("shift")
    ended = F.coalesce(F.sum((F.col("gram") == "SENT").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    tokens = tokens.withColumns({"tok_idx": F.row_number().over(order) - 1, "sent_idx": ended})
    groups = read("Groups.txt", ["doc", "variant", "group_id", "chain_id", "link", "c5", "c6", "c7", "tk_shifts", "attributes"])
    kind = F.coalesce(F.try_element_at(F.str_to_map(F.coalesce("attributes", F.lit("str:noun")), F.lit("[|]"), F.lit(":")), F.lit("str")), F.lit(""))
    kind = F.when(kind.isin("", *NOUN_KINDS), "noun").when(kind.isin(PRONOUN_KINDS), "pron").otherwise(kind)
    shifts = F.split("tk_shifts", ",")
    ends = groups.select(key, F.col("group_id").alias("ent_id"), "chain_id", kind.alias("type"), F.element_at(shifts, 1).cast("int").alias("first"), F.element_at(shifts, -1).cast("int").alias("last"))
    at = lambda shift, place: tokens.select("doc_id", F.col("shift").alias(shift), F.col("tok_idx").alias(place))
    placed = ends.join(at("first", "start_token"), ["doc_id", "first"]).join(at("last", "last_token"), ["doc_id", "last"]).withColumn("end_token", F.col("last_token") + 1)
    number = Window.partitionBy("doc_id").orderBy("start_token", "end_token", "ent_id")
    mentions = placed.select("doc_id", "ent_id", "chain_id", "type", "start_token", "end_token", (F.row_number().over(number) - 1).alias("ord"))
    chains = mentions.select("doc_id", "ent_id", "chain_id")
    relations = chain_relations(mentions.drop("chain_id"), chains, every=True).withColumn("rel_type", F.lit("COREF"))
    sentences = rewrite.adjust_sentences(segment.sentences_of(tokens), mentions)
    return {"tokens": tokens.drop("shift"), "sentences": sentences, "mentions": mentions.drop("chain_id"), "chains": chains, "relations": relations}


def retyped_by_head(mentions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Mentions typed anew: pronouns are those whose head is one by its part of speech, the rest are nouns."""
    pos = tokens.select("doc_id", F.col("tok_idx").alias("head"), "pos")
    headed = span_heads(mentions, tokens).join(pos, ["doc_id", "head"], "left")
    return headed.withColumn("type", F.when(F.col("pos") == "PRON", "pron").otherwise("noun")).drop("head", "pos")


def vectors(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(token, vector) from word2vec text (each file with a header line, whose count bounds its rows) or GloVe text. Of equal words the first.

    Files are read line by line, in splits; lines are in order of file and place in it.
    """
    spot = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select(spot.alias("spot"), "value")
    if header:
        heads = rows.where("spot.block = 0").groupBy(F.col("spot.file").alias("file")).agg(F.min("spot").alias("head"), F.min_by("value", "spot").alias("line"))
        heads = heads.select("file", "head", F.get(F.split("line", " "), F.lit(0)).cast("long").alias("most"))
        rows = rows.withColumn("file", F.col("spot.file")).join(F.broadcast(heads), "file").where(F.col("spot") != F.col("head"))  # a row a file, which the driver lists anyway
        if not rows.groupBy("file", "most").count().where(F.col("count") > F.col("most")).isEmpty():
            placed = with_place(rows.select("file", "most", "spot", "value"), ["spot"])
            begins = placed.groupBy("file").agg(F.min("place").alias("begin"))
            rows = placed.join(F.broadcast(begins), "file").where(F.col("place") - F.col("begin") < F.col("most"))
    w = F.split(F.trim("value"), " ")
    made = rows.select(F.get(w, F.lit(0)).alias("token"), F.transform(F.slice(w, 2, 1_000_000), lambda x: x.cast("double")).alias("vector"), "spot")
    return made.groupBy("token").agg(F.min_by("vector", "spot").alias("vector"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(term): the distinct stripped lines."""
    return spark.read.text(path).select(F.trim("value").alias("term")).distinct()


#: Elements inside a paragraph that are left out. Fixed value.
SKIPPED_ELEMENTS = ["inline-formula"]


def abstracts(spark: SparkSession, path: str, bad_titles: list[str], bad_words: list[str], suffix: str = ".nxml") -> DataFrame:
    """(doc_id, name, text): paragraphs of the first plain abstract of each XML file, without sections of a bad title."""
    import re
    import xml.etree.ElementTree as ET
    from collections.abc import Iterator

    import pandas as pd

    def bad(section) -> bool:
        title = section.find("title")
        text = (title.text or "").lower() if title is not None else ""
        return text in bad_titles or any(w in text for w in bad_words)

    def text_of(p) -> str:
        parts = [p.text or ""]
        for child in p:
            if child.tag not in SKIPPED_ELEMENTS and not len(child):
                parts.append(child.text or "")
            parts.append(child.tail or "")
        return "".join(x.strip("\n") for x in parts).replace("­", "")

    def abstract(xml: str) -> str | None:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml))
        found = next((a for a in root.iter("abstract") if "abstract-type" not in a.attrib), None)
        if found is None:
            return None
        sections = list(found.iter("sec"))
        if sections:
            paragraphs = [p for s in sections if not bad(s) for p in s.findall("p")] + found.findall("p")
        else:
            paragraphs = list(found.iter("p"))
        return "\n\n".join(map(text_of, paragraphs)) if paragraphs else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[abstract(x) for x in frame["text"]])

    return files(spark, path, suffix).mapInPandas(run, "doc_id long, name string, text string").where("text IS NOT NULL AND text <> ''")


def json_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Documents of the JSON test format: tokens, sentences, entities [id, start, end, type], relations [id, id, type]."""
    schema = "tokens array<string>, sentences array<array<int>>, paragraphs array<array<int>>, entities array<array<string>>, relations array<array<string>>, dt_head_distances array<int>, dt_labels array<string>, pos array<string>"
    read = spark.read.option("multiLine", "true").schema(schema).json(path).withColumn("name", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))
    docs = read.withColumn("doc_id", doc_key(F.col("name")))
    docs = docs.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in docs.dtypes if t.startswith("array")})
    at = lambda c, i: F.get(c, F.lit(i))
    sentences = docs.select("doc_id", F.posexplode("sentences").alias("sent_idx", "s")).select("doc_id", "sent_idx", at("s", 0).alias("start_token"), at("s", 1).alias("end_token"))
    tokens = docs.select("doc_id", F.posexplode(F.arrays_zip("tokens", "pos", "dt_head_distances", "dt_labels")).alias("tok_idx", "t")).select("doc_id", "tok_idx", F.col("t.tokens").alias("token"), "t.pos", F.col("t.dt_head_distances").alias("head_dist"), F.col("t.dt_labels").alias("dt_label"))
    entities = docs.select("doc_id", F.explode("entities").alias("e")).select("doc_id", at("e", 0).alias("ent_id"), at("e", 1).cast("int").alias("start_token"), at("e", 2).cast("int").alias("end_token"), at("e", 3).alias("type"))
    relations = docs.select("doc_id", F.explode("relations").alias("r")).select("doc_id", at("r", 0).alias("first"), at("r", 1).alias("second"), at("r", 2).alias("rel_type"))
    return {"documents": docs.select("doc_id", "name"), "tokens": tokens, "sentences": sentences, "mentions": entities, "relations": relations}


def segmented(docs: DataFrame) -> dict[str, DataFrame]:
    """Tokens and sentences of read documents by the white-space segmenter."""
    return {"tokens": segment.tokens(docs), "sentences": segment.sentences(docs)}
