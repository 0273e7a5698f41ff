"""Queries over tokens and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import QUOTE_CODE_POINTS
from spanloom.operators import segment as G
from spanloom.plans import base
from spanloom.plans.base import TOKENS, oracle

DELIMITERS = "-/,"
GAZETTEER = ["the", "of", "and", "die", "der", "que", "de", "la"]
GAZETTEER_SQL = ", ".join(f"'{g}'" for g in GAZETTEER)


def tok_ws_segment(spark, sf):
    return base.tokens(spark, sf)


def sentences(spark, sf):
    return base.sentences(spark, sf)


def paragraphs(spark, sf):
    return G.paragraphs(base.documents(spark, sf))


def tok_normalize(spark, sf):
    made = G.normalized(base.tokens(spark, sf), lower=True, digits=True, quotes=True)
    return made.groupBy("token").agg(F.count("*").alias("n"))


def split_joined(spark, sf):
    return G.split_joined(base.tokens(spark, sf), DELIMITERS)


def split_names(spark, sf):
    tokens = base.tokens(spark, sf).withColumn("token", F.regexp_replace("token", r"^([A-Z])[a-z]([a-z]{4,})$", r"$1.$2"))
    return G.split_names(tokens).select("doc_id", "tok_idx", "sent_idx", "token")


def expand_names(spark, sf):
    short = F.when((F.col("tok_idx") % 7 == 0) & F.col("token").rlike("^[A-Z][a-z]+$"), F.concat(F.substring("token", 1, 1), F.lit("."))).otherwise(F.col("token"))
    return G.expand_names(base.tokens(spark, sf).withColumn("token", short)).select("doc_id", "tok_idx", "token")


def eliminate_citations(spark, sf):
    return G.eliminate_citations(base.documents(spark, sf)).select("doc_id", "text", F.size("cuts").alias("n_cuts"))


def restored_offsets(spark, sf):
    """Tokens of texts without digits in brackets, in offsets of the whole text."""
    cut = G.eliminate_citations(base.documents(spark, sf))
    return G.restored(G.tokens(cut), cut).select("doc_id", "tok_idx", "char_start", "char_end")


def fix_sentence_ends(spark, sf):
    tokens = G.split_joined(base.tokens(spark, sf), ".").withColumn("token", F.when(F.col("token").isin("of", "is"), "sp").otherwise(F.col("token")))
    return G.fix_sentence_ends(tokens)


def space_joined(spark, sf):
    return G.space_joined(base.tokens(spark, sf))


def space_joined_offsets(spark, sf):
    return G.space_joined_offsets(base.tokens(spark, sf))


def align_annotations(spark, sf):
    tokens = base.tokens(spark, sf)
    # Annotations of the first longer run of small letters in a token, which is a part of it as a rule.
    found = tokens.select("doc_id", "char_start", "token", F.regexp_extract("token", "[a-z]{4,}", 0).alias("value")).where("value <> ''")
    annotations = found.withColumn("ann_start", F.col("char_start") + F.instr("token", F.col("value")) - 1)
    annotations = annotations.select("doc_id", "ann_start", (F.col("ann_start") + F.length("value")).alias("ann_end"), "value")
    return G.align_annotations(tokens, annotations, "O").select("doc_id", "tok_idx", "value")


def gazetteer_flag(spark, sf):
    tokens = G.normalized(base.tokens(spark, sf), lower=True)
    return tokens.select("doc_id", "tok_idx", F.col("token").isin(GAZETTEER).alias("in_gazetteer"))


def gazetteer_report(spark, sf):
    """Which terms occur, how often and in how many documents, for each language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = G.normalized(base.tokens(spark, sf), lower=True).where(F.col("token").isin(GAZETTEER)).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return found.join(docs, "doc_id").groupBy("lang", F.col("token").alias("term")).agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (tok_ws_segment, sentences, paragraphs, tok_normalize, split_joined, split_names, expand_names, eliminate_citations, restored_offsets, fix_sentence_ends, space_joined, space_joined_offsets, align_annotations, gazetteer_flag, gazetteer_report)}

QUOTE_CLASS = "[" + "".join(f"\\x{{{c:04X}}}" for c in QUOTE_CODE_POINTS) + "]"

SPLIT = r"""
pz AS (SELECT doc_id, tok_idx, sent_idx, char_start, unnest(regexp_extract_all(token, '{pattern}')) AS piece, unnest(range(1, len(regexp_extract_all(token, '{pattern}')) + 1)) AS part FROM {source}),
pw AS (SELECT *, char_start + sum(length(piece)) OVER (PARTITION BY doc_id, tok_idx ORDER BY part) AS piece_end FROM pz),
cut AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx, part) - 1 AS INTEGER) AS tok_idx, sent_idx, piece AS token, CAST(piece_end - length(piece) AS INTEGER) AS char_start, CAST(piece_end AS INTEGER) AS char_end FROM pw)"""

#: A text as its closed brackets, the runs between them, and lone brackets; and which brackets are cited.
PARTS = r"regexp_extract_all(text, '\([^()]*\)|[^(]+|\(')"
_RANGE = r"(\d+|\d+[-–―‐−—‒‑─]\d+)"
IS_CITED = rf"""(starts_with(x, '(') AND length(x) > 1 AND (regexp_matches(x, '(?i)et(\s|\.|\.\s)al') OR regexp_matches(x, 'Fig\.|Figure\s|Figs\.|Table\s|Tables\s') OR regexp_full_match(x, '\({_RANGE}(,\s*{_RANGE})*\)')
  OR regexp_full_match(x, '\([A-Z][a-z]+ and [A-Z][a-z]+, \d{{4}}\)') OR regexp_full_match(x, '\(\d+%?\)')))"""
CUT = f"""src AS (SELECT doc_id, unnest({PARTS}) AS x, unnest(range(1, len({PARTS}) + 1)) AS k FROM documents WHERE text IS NOT NULL),
ct AS (SELECT doc_id, k, length(x) AS size, {IS_CITED} AS cited, coalesce(sum(CASE WHEN NOT {IS_CITED} THEN length(x) END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM src),
documents AS (SELECT doc_id, array_to_string(list_filter({PARTS}, lambda x: NOT {IS_CITED}), '') AS text FROM documents WHERE text IS NOT NULL)"""

ORACLES = {
    "eliminate_citations": f"SELECT doc_id, array_to_string(list_filter({PARTS}, lambda x: NOT {IS_CITED}), '') AS text, len(list_filter({PARTS}, lambda x: {IS_CITED}))::INTEGER AS n_cuts FROM documents WHERE text IS NOT NULL",
    "restored_offsets": oracle(
        "SELECT t.doc_id, t.tok_idx, CAST(char_start + coalesce(sum(size) FILTER (pos <= char_start), 0) AS INTEGER) AS char_start, CAST(char_end + coalesce(sum(size) FILTER (pos < char_end), 0) AS INTEGER) AS char_end FROM tok t LEFT JOIN (SELECT * FROM ct WHERE cited) c ON c.doc_id = t.doc_id GROUP BY t.doc_id, t.tok_idx, char_start, char_end",
        CUT + ", " + TOKENS.strip(),
    ),
    "tok_ws_segment": oracle("SELECT * FROM tok"),
    "sentences": oracle("SELECT * FROM sent"),
    "paragraphs": oracle("SELECT doc_id, 0 AS par_idx, 0 AS start_sentence, CAST(count(*) AS INTEGER) AS end_sentence FROM sent GROUP BY doc_id"),
    "tok_normalize": oracle(f"SELECT lower(regexp_replace(regexp_replace(token, '{QUOTE_CLASS}', '\"', 'g'), '[0-9]+', '0', 'g')) AS token, count(*) AS n FROM tok GROUP BY 1"),
    "split_joined": oracle(SPLIT.format(pattern=r"[\-/,]|[^\-/,]+", source="tok") + " SELECT * FROM cut"),
    "split_names": oracle(
        r"""named AS (SELECT doc_id, tok_idx, sent_idx, regexp_replace(token, '^([A-Z])[a-z]([a-z]{4,})$', '\1.\2') AS token FROM tok),
        two AS (SELECT *, unnest(CASE WHEN regexp_matches(token, '^[A-Z]\.[a-z]{4,}$') THEN [token[1:2], token[3:]] ELSE [token] END) AS piece, unnest(CASE WHEN regexp_matches(token, '^[A-Z]\.[a-z]{4,}$') THEN [1, 2] ELSE [1] END) AS part FROM named)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tok_idx, part) - 1 AS INTEGER) AS tok_idx, sent_idx, piece AS token FROM two"""
    ),
    "expand_names": oracle(
        r"""sh AS (SELECT doc_id, tok_idx, CASE WHEN tok_idx % 7 = 0 AND regexp_matches(token, '^[A-Z][a-z]+$') THEN token[1:1] || '.' ELSE token END AS token FROM tok),
        sq AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS nxt FROM sh),
        pr AS (SELECT doc_id, token, nxt, min(tok_idx) AS first FROM sq WHERE regexp_matches(token, '^[A-Z]\.$') AND regexp_matches(nxt, '^[a-z]{4,}$') GROUP BY ALL),
        fd AS (SELECT pr.doc_id, pr.token, pr.nxt, max_by(c.token, c.tok_idx) AS name FROM pr JOIN sq c ON c.doc_id = pr.doc_id AND c.nxt = pr.nxt AND c.tok_idx <= pr.first - 2 AND c.token[1:1] = pr.token[1:1] GROUP BY ALL)
        SELECT sq.doc_id, tok_idx, coalesce(name, sq.token) AS token FROM sq LEFT JOIN fd ON fd.doc_id = sq.doc_id AND fd.token = sq.token AND fd.nxt = sq.nxt"""
    ),
    "fix_sentence_ends": oracle(
        SPLIT.format(pattern=r"[.]|[^.]+", source="tok")
        + r""", sp AS (SELECT doc_id, sent_idx, tok_idx, CASE WHEN token IN ('of', 'is') THEN 'sp' ELSE token END AS token FROM cut),
        en AS (SELECT *, lag(token) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) AS before FROM sp),
        bo AS (SELECT doc_id, sent_idx, min(tok_idx) AS s, max(tok_idx) + 1 AS e, max_by(token, tok_idx) AS last, arg_max_null(before, tok_idx) AS before FROM en GROUP BY ALL),
        gr AS (SELECT *, sent_idx - coalesce(sum(CASE WHEN last = '.' AND before IN ('sp', 'spp', 'subsp', 'approx', 'i.e', 'e.g', 'b.i.d') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM bo)
        SELECT doc_id, CAST(grp AS INTEGER) AS sent_idx, min(s) AS start_token, max(e) AS end_token FROM gr GROUP BY doc_id, grp"""
    ),
    "space_joined": oracle("SELECT doc_id, sent_idx, string_agg(token, ' ' ORDER BY tok_idx) AS text FROM tok GROUP BY doc_id, sent_idx"),
    "space_joined_offsets": oracle(
        "so AS (SELECT doc_id, tok_idx, sent_idx, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tok) "
        "SELECT doc_id, tok_idx, sent_idx, CAST(s AS INTEGER) AS char_start, CAST(s + length(token) AS INTEGER) AS char_end FROM so"
    ),
    "align_annotations": oracle("SELECT doc_id, tok_idx, CASE WHEN regexp_matches(token, '[a-z]{4,}') THEN regexp_extract(token, '[a-z]{4,}') ELSE 'O' END AS value FROM tok"),
    "gazetteer_flag": oracle(f"SELECT doc_id, tok_idx, lower(token) IN ({GAZETTEER_SQL}) AS in_gazetteer FROM tok"),
    "gazetteer_report": oracle(f"SELECT lang, lower(token) AS term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok JOIN documents USING (doc_id) WHERE lower(token) IN ({GAZETTEER_SQL}) GROUP BY ALL"),
}
