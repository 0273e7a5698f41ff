"""Queries over mentions and pairs of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions import text as T
from spanloom.operators import mentions as M
from spanloom.operators import pairs as P
from spanloom.operators import segment as G
from spanloom.operators.grouped import sorted_join
from spanloom.plans import base
from spanloom.plans.base import MENTIONS, oracle

#: Pairs of the queries: of one sentence, different, within so many tokens.
MOST_TOKENS = 12


def _pairs(spark, sf):
    return P.candidates(base.mentions(spark, sf), P.different(), in_sentence=True, near=MOST_TOKENS)


def _ids(pairs, *more):
    return pairs.select("doc_id", F.col("e1.ent_id").alias("id1"), F.col("e2.ent_id").alias("id2"), *more)


def rule_mentions(spark, sf):
    return base.mentions(spark, sf).drop("ord")


def span_relations(spark, sf):
    a, b = F.col("e1"), F.col("e2")
    return _ids(_pairs(spark, sf), S.contains(a, b).alias("contains"), S.intersects(a, b).alias("intersects"), S.coincides(a, b).alias("coincides"), S.token_distance(a, b).alias("distance"), S.length(a).alias("length"), S.interrelation(a, b).alias("interrelation"), S.direction(a, b).alias("direction"))


def distinct_spans(spark, sf):
    return M.distinct_spans(base.mentions(spark, sf)).select("doc_id", "start_token", "end_token", "span_idx")


def spans_at_tokens(spark, sf):
    return M.at_tokens(base.mentions(spark, sf)).select("doc_id", "tok_idx", "ent_id")


def span_contains_join(spark, sf):
    m = base.mentions(spark, sf)
    wide = m.where("type = 'CTX'")
    return M.contained_in(m, wide).select("doc_id", F.col("container.ent_id").alias("container"), F.col("mention.ent_id").alias("mention"))


def sentence_of_mention(spark, sf):
    return M.sentence_of(base.mentions(spark, sf).drop("sent_idx"), base.tokens(spark, sf)).select("doc_id", "ent_id", "sent_idx")


def paragraph_of_mention(spark, sf):
    """Paragraphs of three sentences each."""
    thirds = base.sentences(spark, sf).groupBy("doc_id", F.floor(F.col("sent_idx") / 3).cast("int").alias("par_idx"))
    paragraphs = thirds.agg(F.min("sent_idx").alias("start_sentence"), (F.max("sent_idx") + 1).alias("end_sentence"))
    return M.paragraph_of(base.mentions(spark, sf), paragraphs).select("doc_id", "ent_id", "par_idx")


def longest_paragraph(spark, sf):
    docs = base.documents(spark, sf)
    return M.longest_paragraph(G.paragraphs(docs), G.sentences(docs))


def most_nested(spark, sf):
    return M.most_nested(base.tokens(spark, sf), base.mentions(spark, sf))


def borders(spark, sf):
    return M.borders(base.sentences(spark, sf))


def align_raw(spark, sf):
    tokens = base.tokens(spark, sf)
    raw = tokens.where("tok_idx % 5 = 0").select("doc_id", F.concat(F.lit("R"), "tok_idx").alias("id"), F.lit("X").alias("type"), (F.col("char_start") + F.col("tok_idx") % 2).alias("start"), (F.col("char_end") + F.col("tok_idx") % 4).alias("end"))
    return M.align_raw(raw, tokens).select("doc_id", "id", "start_token", "end_token")


def type_counts(spark, sf):
    return M.type_counts(base.mentions(spark, sf))


def filtered_types(spark, sf):
    merged = M.merge_pattern({"NAME": ["CAP"], "OTHER": ["CTX", "MAIL"]})
    return M.filter_types(base.mentions(spark, sf), ["NUM"], merged).select("doc_id", "ent_id", "type")


def candidate_pairs(spark, sf):
    keep = P.all_of(P.different(), P.same_sentence(), P.not_intersecting())
    types = spark.createDataFrame([("CAP", "CAP"), ("CAP", "NUM"), ("NUM", "CTX")], "t1 string, t2 string")
    return _ids(P.of_argument_types(P.candidates(base.mentions(spark, sf), keep, in_sentence=True, near=MOST_TOKENS), types))


def _relations(spark, sf, mentions=None):
    """Each mention is related to the next in order, by whether both have a type."""
    m = base.mentions(spark, sf) if mentions is None else mentions
    nxt = m.select("doc_id", (F.col("ord") - 1).alias("ord"), F.col("ent_id").alias("second"), F.col("type").alias("t2"))
    raw = sorted_join(m, nxt, ["doc_id", "ord"]).where("ord % 3 <> 1")
    return raw.select("doc_id", F.col("ent_id").alias("first"), "second", F.when(F.col("type") == F.col("t2"), "LIKE").otherwise("NEXT").alias("rel_type"))


def resolved_relations(spark, sf):
    return _ids(P.resolve(_relations(spark, sf), base.mentions(spark, sf), ["LIKE"]), "rel_type")


def sentence_relations(spark, sf):
    found = P.resolve(_relations(spark, sf), base.mentions(spark, sf), ["LIKE"])
    return _ids(P.in_sentence_relations(found, base.sentences(spark, sf)), "rel_type", F.col("in_sent").alias("sent_idx"))


def labelled_pairs(spark, sf):
    relations = P.resolve(_relations(spark, sf), base.mentions(spark, sf), ["LIKE"])
    return _ids(P.labelled(_pairs(spark, sf), relations), "label")


def argument_types(spark, sf):
    found = P.argument_types(P.resolve(_relations(spark, sf), base.mentions(spark, sf), ["LIKE"]))
    return found.select("t1", "t2", F.array_join("rel_types", ",").alias("rel_types"))


def label_masks(spark, sf):
    valid = P.argument_types(P.resolve(_relations(spark, sf), base.mentions(spark, sf), ["LIKE"]))
    mask = P.label_mask([None, "LIKE", "NEXT", "OTHER"], F.col("rel_types"))
    return valid.select("t1", "t2", F.array_join(mask.cast("array<string>"), ",").alias("mask"))


def band_pairs(spark, sf):
    return _ids(P.preceding(base.mentions(spark, sf), 3))


def _chains(spark, sf):
    """Chains by the rule that mentions of one first letter of their type and one ordinal class belong together."""
    return base.mentions(spark, sf).where("ord % 5 < 3").select("doc_id", "ent_id", (F.col("ord") % 5).alias("chain_id"))


def nearest_left(spark, sf):
    m = base.mentions(spark, sf)
    return _ids(P.nearest_in_chain(m, _chains(spark, sf), F.col("type") == "NUM", F.col("type") == "CAP", 3), "chain_id", "distance")


def pronoun_pairs(spark, sf):
    m = base.mentions(spark, sf)
    return _ids(P.pronoun_pairs(m, _chains(spark, sf), F.col("type") == "MAIL", F.col("type") == "CAP", 5), "chain_id", "entity_distance")


def chain_labels(spark, sf):
    return _ids(P.chain_labelled(P.preceding(base.mentions(spark, sf), 3), _chains(spark, sf)), "label")


def entity_distance(spark, sf):
    pairs = P.preceding(base.mentions(spark, sf), 3)
    return _ids(P.with_entity_distance(pairs, base.mentions(spark, sf)), "entity_distance", F.abs(F.col("e1.sent_idx") - F.col("e2.sent_idx")).alias("sentence_distance"))


def mention_distance(spark, sf):
    pairs = P.preceding(base.mentions(spark, sf), 3)
    return _ids(P.with_mention_distance(pairs, base.mentions(spark, sf)), "mention_distance")


def layer_labels(spark, sf):
    m = base.mentions(spark, sf)
    layer, entities = m.where("type IN ('CTX', 'NUM')"), m.where("type IN ('CAP', 'NUM')")
    return P.layer_labels(layer, entities).select("doc_id", "ent_id", "label")


def labels_by_type(spark, sf):
    m = base.mentions(spark, sf)
    found = P.labels_by_type(P.layer_labels(m.where("type <> 'CAP'"), m.where("type IN ('CAP', 'NUM')")))
    return found.select("type", F.array_join("labels", ",").alias("labels"), "single")


def log_distance_pairs(spark, sf):
    d = S.token_distance(F.col("e1"), F.col("e2"))
    return _pairs(spark, sf).groupBy(T.log_distance(d).alias("log_distance")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rule_mentions, span_relations, distinct_spans, spans_at_tokens, span_contains_join, sentence_of_mention, paragraph_of_mention, longest_paragraph, most_nested, borders, align_raw, type_counts, filtered_types, candidate_pairs, resolved_relations, sentence_relations, labelled_pairs, argument_types, label_masks, band_pairs, nearest_left, pronoun_pairs, chain_labels, entity_distance, mention_distance, layer_labels, labels_by_type, log_distance_pairs)}

DIST = "greatest(0, greatest(a.start_token, b.start_token) - least(a.end_token, b.end_token) + 1)"
COVERS = "({0}.start_token <= {1}.start_token AND {0}.end_token >= {1}.end_token)"
AB, BA = COVERS.format("a", "b"), COVERS.format("b", "a")
CROSS = "(a.start_token < b.end_token AND b.start_token < a.end_token)"
PAIRS = f"SELECT a.doc_id, a.ent_id AS id1, b.ent_id AS id2{{more}} FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.ord <> b.ord AND {DIST} <= {MOST_TOKENS}"
BAND = "SELECT a.doc_id, a.ent_id AS id1, b.ent_id AS id2{more} FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.ord BETWEEN b.ord - 3 AND b.ord - 1"
RELATIONS = """raw AS (SELECT a.doc_id, a.ent_id AS first, b.ent_id AS second, CASE WHEN a.type = b.type THEN 'LIKE' ELSE 'NEXT' END AS rel_type FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 WHERE a.ord % 3 <> 1),
rel AS (SELECT * FROM raw UNION SELECT doc_id, second, first, rel_type FROM raw WHERE rel_type = 'LIKE')"""
CHAINS = "ch AS (SELECT doc_id, ent_id, ord % 5 AS chain_id FROM ment WHERE ord % 5 < 3)"
ARG = RELATIONS + ", args AS (SELECT a.type AS t1, b.type AS t2, list_sort(list(DISTINCT rel_type)) AS l FROM rel JOIN ment a ON a.doc_id = rel.doc_id AND a.ent_id = first JOIN ment b ON b.doc_id = rel.doc_id AND b.ent_id = second GROUP BY ALL)"
BETWEEN = "m.start_token >= least(a.end_token, b.end_token)"


def _m(select: str) -> str:
    return oracle(select, MENTIONS)


ORACLES = {
    "rule_mentions": _m("SELECT doc_id, ent_id, start_token, end_token, type, sent_idx FROM ment"),
    "span_relations": _m(
        PAIRS.format(
            more=f", {AB} AS contains, {CROSS} AS intersects, a.start_token = b.start_token AND a.end_token = b.end_token AS coincides, {DIST} AS distance, a.end_token - a.start_token AS length, "
            f"CASE WHEN {AB} THEN 'CONTAINS' WHEN {BA} THEN 'CONTAINED' WHEN {CROSS} THEN 'INTERSECTS' ELSE 'SEPARATED' END AS interrelation, "
            f"CASE WHEN {AB} THEN 'e2_in_e1' WHEN {BA} THEN 'e1_in_e2' WHEN a.start_token < b.start_token THEN 'e1_e2' ELSE 'e2_e1' END AS direction"
        )
    ),
    "distinct_spans": _m("SELECT doc_id, start_token, end_token, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_token, end_token) - 1 AS INTEGER) AS span_idx FROM (SELECT DISTINCT doc_id, start_token, end_token FROM ment)"),
    "spans_at_tokens": _m("SELECT doc_id, CAST(unnest(range(start_token, end_token)) AS INTEGER) AS tok_idx, ent_id FROM ment"),
    "span_contains_join": _m(f"SELECT a.doc_id, a.ent_id AS container, b.ent_id AS mention FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND {AB} WHERE a.type = 'CTX'"),
    "sentence_of_mention": _m("SELECT m.doc_id, ent_id, t.sent_idx FROM ment m JOIN tok t ON t.doc_id = m.doc_id AND t.tok_idx = m.start_token"),
    "paragraph_of_mention": _m("SELECT doc_id, ent_id, CAST(sent_idx // 3 AS INTEGER) AS par_idx FROM ment"),
    "longest_paragraph": oracle("SELECT greatest(1, max(t)) AS tokens, greatest(1, max(s)) AS sentences FROM (SELECT CAST(max(end_token) AS BIGINT) AS t, count(*) AS s FROM sent GROUP BY doc_id)"),
    "most_nested": _m("ov AS (SELECT doc_id, unnest(range(start_token, end_token)) AS tok_idx, type, end_token - start_token AS len, ord FROM ment), ag AS (SELECT doc_id, tok_idx, min_by(type, (len, ord)) AS entity_type, count(*) AS n FROM ov GROUP BY ALL) SELECT tok.doc_id, tok.tok_idx, entity_type, coalesce(n, 0) AS entity_depth FROM tok LEFT JOIN ag ON ag.doc_id = tok.doc_id AND ag.tok_idx = tok.tok_idx"),
    "borders": oracle("SELECT t.doc_id, tok_idx, CASE WHEN tok_idx = start_token THEN 'start' WHEN tok_idx = end_token - 1 THEN 'end' ELSE 'in' END AS border FROM tok t JOIN sent s ON s.doc_id = t.doc_id AND s.sent_idx = t.sent_idx"),
    "align_raw": oracle(
        """raw AS (SELECT doc_id, 'R' || tok_idx AS id, char_start + tok_idx % 2 AS s, char_end + tok_idx % 4 AS e FROM tok WHERE tok_idx % 5 = 0),
        f1 AS (SELECT raw.*, t.tok_idx AS st FROM raw ASOF LEFT JOIN tok t ON raw.doc_id = t.doc_id AND raw.s < t.char_end),
        f2 AS (SELECT f1.*, t.tok_idx AS over_idx, t.char_start AS over_start FROM f1 ASOF LEFT JOIN tok t ON f1.doc_id = t.doc_id AND f1.e <= t.char_end),
        f3 AS (SELECT f2.*, t.tok_idx AS under_idx FROM f2 ASOF LEFT JOIN tok t ON f2.doc_id = t.doc_id AND f2.e > t.char_end),
        al AS (SELECT doc_id, id, st, CASE WHEN over_start < e THEN over_idx ELSE under_idx END + 1 AS en FROM f3)
        SELECT doc_id, id, CASE WHEN st < en THEN st END AS start_token, CASE WHEN st < en THEN en END AS end_token FROM al"""
    ),
    "type_counts": _m("SELECT doc_id, type, count(*) AS n FROM ment GROUP BY ALL"),
    "filtered_types": _m("SELECT doc_id, ent_id, CASE type WHEN 'CAP' THEN 'NAME' ELSE 'OTHER' END AS type FROM ment WHERE type <> 'NUM'"),
    "candidate_pairs": _m(PAIRS.format(more="") + f" WHERE NOT {CROSS} AND (a.type, b.type) IN (('CAP', 'CAP'), ('CAP', 'NUM'), ('NUM', 'CTX'))"),
    "resolved_relations": _m(RELATIONS + " SELECT doc_id, first AS id1, second AS id2, rel_type FROM rel"),
    "sentence_relations": _m(RELATIONS + " SELECT rel.doc_id, first AS id1, second AS id2, rel_type, s.sent_idx FROM rel JOIN ment a ON a.doc_id = rel.doc_id AND a.ent_id = first JOIN ment b ON b.doc_id = rel.doc_id AND b.ent_id = second JOIN sent s ON s.doc_id = rel.doc_id AND s.start_token <= least(a.start_token, b.start_token) AND s.end_token >= greatest(a.end_token, b.end_token)"),
    "labelled_pairs": _m(RELATIONS + f", pr AS ({PAIRS.format(more='')}) SELECT pr.doc_id, id1, id2, max(rel_type) AS label FROM pr LEFT JOIN rel ON rel.doc_id = pr.doc_id AND first = id1 AND second = id2 GROUP BY ALL"),
    "argument_types": _m(ARG + " SELECT t1, t2, array_to_string(l, ',') AS rel_types FROM args"),
    "label_masks": _m(ARG + " SELECT t1, t2, '1,' || CAST(list_contains(l, 'LIKE') AS INTEGER) || ',' || CAST(list_contains(l, 'NEXT') AS INTEGER) || ',0' AS mask FROM args"),
    "band_pairs": _m(BAND.format(more="")),
    "nearest_left": _m(
        CHAINS
        + f""", rch AS (SELECT doc_id, ord, start_token, max(end_token) OVER (PARTITION BY doc_id ORDER BY ord) AS reach FROM ment),
        cand AS (SELECT a.doc_id, a.ord AS o1, b.ord AS o2, chain_id, {DIST} AS distance, b.start_token <= a.start_token AS lft, least(a.end_token, b.end_token) AS lo, greatest(a.start_token, b.start_token) AS hi
          FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.ord <> b.ord JOIN ch ON ch.doc_id = b.doc_id AND ch.ent_id = b.ent_id WHERE a.type = 'NUM' AND b.type = 'CAP'),
        two AS (SELECT *, 0 AS try FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, o1, chain_id ORDER BY distance, o2) AS r FROM cand WHERE lft) WHERE r = 1
          UNION ALL SELECT *, 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, o1, chain_id ORDER BY distance, o2) AS r FROM cand) WHERE r = 1),
        dst AS (SELECT two.doc_id, o1, o2, chain_id, distance, try, count(m.ord) AS ed FROM two LEFT JOIN rch m ON m.doc_id = two.doc_id AND m.reach <= hi AND m.start_token >= lo GROUP BY ALL),
        one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o1, chain_id ORDER BY try) AS r FROM dst WHERE ed <= 3)
        SELECT one.doc_id, x.ent_id AS id1, y.ent_id AS id2, chain_id, distance FROM one JOIN ment x ON x.doc_id = one.doc_id AND x.ord = least(o1, o2) JOIN ment y ON y.doc_id = one.doc_id AND y.ord = greatest(o1, o2) WHERE r = 1"""
    ),
    "pronoun_pairs": _m(
        CHAINS
        + f""", rch AS (SELECT doc_id, ord, start_token, max(end_token) OVER (PARTITION BY doc_id ORDER BY ord) AS reach FROM ment),
        cand AS (SELECT a.doc_id, a.ord AS o1, b.ord AS o2, chain_id, least(a.end_token, b.end_token) AS lo, greatest(a.start_token, b.start_token) AS hi
          FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.ord <> b.ord AND b.start_token <= a.start_token JOIN ch ON ch.doc_id = b.doc_id AND ch.ent_id = b.ent_id WHERE a.type = 'MAIL' AND b.type = 'CAP'),
        dst AS (SELECT cand.doc_id, o1, o2, chain_id, count(m.ord) AS ed FROM cand LEFT JOIN rch m ON m.doc_id = cand.doc_id AND m.reach <= hi AND m.start_token >= lo GROUP BY ALL)
        SELECT dst.doc_id, x.ent_id AS id1, y.ent_id AS id2, chain_id, ed AS entity_distance FROM dst JOIN ment x ON x.doc_id = dst.doc_id AND x.ord = least(o1, o2) JOIN ment y ON y.doc_id = dst.doc_id AND y.ord = greatest(o1, o2) WHERE ed <= 5"""
    ),
    "chain_labels": _m(CHAINS + f", pr AS ({BAND.format(more='')}) SELECT pr.doc_id, id1, id2, CASE WHEN c1.chain_id = c2.chain_id THEN 'COREF' END AS label FROM pr LEFT JOIN ch c1 ON c1.doc_id = pr.doc_id AND c1.ent_id = id1 LEFT JOIN ch c2 ON c2.doc_id = pr.doc_id AND c2.ent_id = id2"),
    "entity_distance": _m(
        BAND.format(more=f", (SELECT count(*) FROM (SELECT start_token, max(end_token) OVER (ORDER BY ord) AS reach FROM ment m WHERE m.doc_id = a.doc_id) m WHERE reach <= greatest(a.start_token, b.start_token) AND {BETWEEN}) AS entity_distance, abs(a.sent_idx - b.sent_idx) AS sentence_distance")
    ),
    "mention_distance": _m(BAND.format(more=f", (SELECT count(*) FROM ment m WHERE m.doc_id = a.doc_id AND m.end_token <= greatest(a.start_token, b.start_token) AND {BETWEEN}) AS mention_distance")),
    "layer_labels": _m("SELECT a.doc_id, a.ent_id, min_by(b.type, b.ord) AS label FROM ment a LEFT JOIN ment b ON a.doc_id = b.doc_id AND a.start_token = b.start_token AND a.end_token = b.end_token AND b.type IN ('CAP', 'NUM') WHERE a.type IN ('CTX', 'NUM') GROUP BY ALL"),
    "labels_by_type": _m("lab AS (SELECT a.doc_id, a.ent_id, a.type, coalesce(min_by(b.type, b.ord), 'None') AS label FROM ment a LEFT JOIN ment b ON a.doc_id = b.doc_id AND a.start_token = b.start_token AND a.end_token = b.end_token AND b.type IN ('CAP', 'NUM') WHERE a.type <> 'CAP' GROUP BY ALL) SELECT type, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, count(DISTINCT label) = 1 AS single FROM lab GROUP BY type"),
    "log_distance_pairs": _m(f"pr AS ({PAIRS.format(more=f', {DIST} AS d')}) SELECT CAST(round(log2(d + 1)) AS INTEGER) AS log_distance, count(*) AS n FROM pr GROUP BY 1"),
}
