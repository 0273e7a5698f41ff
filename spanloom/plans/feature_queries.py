"""Queries over features, samples and coreference choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import coref as R
from spanloom.operators import encode as E
from spanloom.operators import features as X
from spanloom.operators import pairs as P
from spanloom.operators import rewrite as W
from spanloom.plans import base, pipeline
from spanloom.plans.base import MENTIONS, oracle
from spanloom.plans.graph_queries import CHAINED, SCORED, TREE, _scored, _tree
from spanloom.plans.graph_queries import chains as chain_table
from spanloom.plans.span_queries import CROSS, DIST, RELATIONS, _relations


def _nouns(spark, sf):
    """Mentions of which names are nouns and the rest pronouns."""
    return base.mentions(spark, sf).withColumn("type", F.when(F.col("type") == "CAP", "noun").otherwise("pron"))


def _ids(pairs, *more):
    return pairs.select("doc_id", F.col("e1.ent_id").alias("id1"), F.col("e2.ent_id").alias("id2"), *more)


def token_positions(spark, sf):
    found = X.positions_to_span(base.mentions(spark, sf).where("type = 'MAIL' OR type = 'NUM'"), base.tokens(spark, sf))
    return found.select("doc_id", "ent_id", "tok_idx", F.col("token_position").cast("long"))


def sentence_positions(spark, sf):
    return X.sentence_positions(base.mentions(spark, sf), base.sentences(spark, sf), 2)


def head_entity_types(spark, sf):
    m = base.mentions(spark, sf)
    spots = m.where("type = 'CTX'").select("doc_id", "ent_id", (F.col("end_token") - 1).alias("head"))
    return X.entity_type_at(spots, m.where("type <> 'CTX'"), "head", "ne").select("doc_id", "ent_id", "ne")


def marked_mentions(spark, sf):
    tokens = base.tokens(spark, sf).withColumn("speech", F.when(F.length("token") % 5 == 0, "S").otherwise("O"))
    return X.any_marked(base.mentions(spark, sf), tokens, "speech", "in_speech").select("doc_id", "ent_id", "in_speech")


def morph_features(spark, sf):
    feats = F.map_filter(F.create_map(F.lit("Len"), F.length("token").cast("string"), F.lit("Cap"), F.when(F.col("token").rlike("^[A-Z]"), "Yes")), lambda _, v: v.isNotNull())
    made = base.tokens(spark, sf).select("doc_id", "tok_idx", *X.from_map(feats, ["Len", "Cap", "Case"]))
    return X.with_namespace(made, "morph", ["Len", "Cap", "Case"])


def label_masks_of_mentions(spark, sf):
    m = base.mentions(spark, sf)
    mapping = P.labels_by_type(P.layer_labels(m.where("type <> 'CAP'"), m.where("type IN ('CAP', 'NUM')")))
    return X.valid_labels_mask(m, mapping, ["CAP", "NUM", "None"]).select("doc_id", "ent_id", F.array_join(F.col("labels_mask").cast("array<string>"), ",").alias("mask"))


def layer_codes(spark, sf):
    tagged, _ = X.layer_tags(base.tokens(spark, sf), base.mentions(spark, sf).where("type <> 'CTX'"), "bio")
    return tagged.select("doc_id", "tok_idx", "tag", "tag_code")


def pair_context(spark, sf):
    m = base.mentions(spark, sf)
    heads = m.select("doc_id", "ent_id", (F.col("end_token") - 1).alias("head"))
    found = X.with_context(P.preceding(m, 2), m, heads)
    return _ids(found, F.array_join("context", " ").alias("context"))


def empty_features(spark, sf):
    made = base.tokens(spark, sf).select("doc_id", F.when(F.length("token") > 12, 1).alias("long"), F.when(F.col("doc_id") % 3 > 0, 1).alias("third"), F.lit(1).alias("always"))
    return X.empty_features(made, ["long", "third", "always"])


def _rare_pos(spark, sf):
    """Parts of speech by the length of tokens, of which long ones are rare."""
    return _tree(spark, sf).withColumn("pos", F.concat(F.lit("L"), F.length("token")))


def path_samples(spark, sf):
    found = X.path_samples(_rare_pos(spark, sf), [("L15", "L15"), ("L15", "L16")])
    on_path = F.filter(F.transform("found", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return found.select("doc_id", "source", "target", F.array_join(on_path.cast("array<string>"), " ").alias("on_path"))


def path_pairs(spark, sf):
    return X.path_pairs(_rare_pos(spark, sf), [("L13", "L14"), ("L14", "L14")])


def streams(spark, sf):
    a = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    b = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return X.streams(a, b)


def relation_codes(spark, sf):
    return X.relation_dictionary(_relations(spark, sf))


def training_relations(spark, sf):
    """Relations that a filter of candidate pairs would let pass."""
    found = P.resolve(_relations(spark, sf), base.mentions(spark, sf), ["LIKE"])
    keep = P.all_of(P.none_of(R.is_intersecting), P.within_tokens(9))
    return _ids(found.where(keep(F.col("e1"), F.col("e2"))), "rel_type")


def relation_scores(spark, sf):
    """Predicted relations are those of every other first mention, and all that are alike are called next."""
    gold = P.resolve(_relations(spark, sf), base.mentions(spark, sf), [])
    predicted = gold.where("e1.ord % 4 <> 2").withColumn("rel_type", F.when(F.col("e1.ord") % 5 == 0, "NEXT").otherwise(F.col("rel_type")))
    return pipeline.evaluator_for("rel_ext")(predicted, gold, base.documents(spark, sf))["categories"]


def noun_chains(spark, sf):
    return R.noun_chains(_nouns(spark, sf), chain_table(spark, sf)).select("doc_id", "ent_id", "chain_id")


def noun_links(spark, sf):
    return R.nouns_only(_nouns(spark, sf), chain_table(spark, sf))[1]


def exact_matches(spark, sf):
    m = _nouns(spark, sf)
    return _ids(R.exact_matches(m, base.tokens(spark, sf).withColumn("lemma", F.lower("token")), "lemma"), "label")


def heuristic_scores(spark, sf):
    m = _nouns(spark, sf)
    matched = R.exact_matches(m, base.tokens(spark, sf).withColumn("lemma", F.lower("token")), "lemma")
    return _ids(R.first_of(R.intersecting(m), matched), "label", "score")


def pronoun_ranks(spark, sf):
    m = base.mentions(spark, sf).withColumn("type", F.when(F.col("type") == "CTX", "pron").otherwise(F.col("type")))
    return R.collecting_strategy("pron_rank")(_scored(spark, sf), m)


def coref_training_pairs(spark, sf):
    return _ids(P.training_pairs(base.mentions(spark, sf), chain_table(spark, sf)))


def paragraph_ranges(spark, sf):
    """Raw paragraphs end where every seventieth token does, inside sentences or with them."""
    tokens, sentences = base.tokens(spark, sf), base.sentences(spark, sf)
    raw = tokens.where("tok_idx % 70 = 69").select("doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    return W.paragraphs_of(sentences, tokens, raw)


def merged_documents(spark, sf):
    tokens = base.tokens(spark, sf)
    raw = tokens.where("tok_idx % 6 = 1").select("doc_id", F.concat(F.lit("R"), "tok_idx").alias("id"), F.lit("X").alias("type"), F.col("char_start").alias("start"), (F.col("char_end") + 3).alias("end"))
    nothing = tokens.limit(0)
    made = W.merged(tokens, base.sentences(spark, sf), nothing.select("doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")), raw, nothing.select("doc_id", F.col("token").alias("first"), F.col("token").alias("second"), F.col("token").alias("rel_type")))
    return made["mentions"].select("doc_id", "ent_id", "start_token", "end_token", "ord", "sent_idx")


def moved_spans(spark, sf):
    m = base.mentions(spark, sf).withColumn("me", F.struct("start_token", "end_token", "type"))
    moved = S.with_type(S.relocated(F.col("me"), F.col("start_token") + 5, F.col("end_token") + 5), "MOVED")
    return m.select("doc_id", "ent_id", moved["start_token"].alias("start_token"), moved["end_token"].alias("end_token"), moved["type"].alias("type"))


def signed_codes(spark, sf):
    """Clipped distances coded by the dictionary of integers."""
    coded = E.integer_dictionary(spark, -3, 3, ["$START$"])
    d = F.least(F.greatest(F.col("tok_idx") % 21 - 10, F.lit(-4)), F.lit(4))
    return E.encode(base.tokens(spark, sf).select("doc_id", "tok_idx", d.alias("d")), "d", coded, "code").select("doc_id", "tok_idx", "code")


QUERIES = {
    f.__name__: f
    for f in (token_positions, sentence_positions, head_entity_types, marked_mentions, morph_features, label_masks_of_mentions, layer_codes, pair_context, empty_features, path_samples, path_pairs, streams, relation_codes, training_relations, relation_scores, noun_chains, noun_links, exact_matches, heuristic_scores, pronoun_ranks, coref_training_pairs, paragraph_ranges, merged_documents, moved_spans, signed_codes)
}

SCORES = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1"""
WORDS = "wd AS (SELECT m.doc_id, m.ord, m.ent_id, list_sort(list(DISTINCT lower(token))) AS w FROM (SELECT *, unnest(range(start_token, end_token)) AS tok_idx FROM ment WHERE type = 'CAP') m JOIN tok t ON t.doc_id = m.doc_id AND t.tok_idx = m.tok_idx GROUP BY ALL)"
MATCHED = "SELECT a.doc_id, a.ent_id AS id1, b.ent_id AS id2, 'COREF' AS label FROM wd a JOIN wd b ON a.doc_id = b.doc_id AND a.w = b.w AND a.ord < b.ord"


def _m(select: str) -> str:
    return oracle(select, MENTIONS)


ORACLES = {
    "token_positions": _m("SELECT a.doc_id, a.ent_id, t.tok_idx, CAST(greatest(0, greatest(a.start_token, t.tok_idx) - least(a.end_token, t.tok_idx + 1) + 1) AS BIGINT) AS token_position FROM ment a JOIN tok t ON t.doc_id = a.doc_id AND t.sent_idx = a.sent_idx WHERE a.type IN ('MAIL', 'NUM')"),
    "sentence_positions": _m("SELECT a.doc_id, a.ent_id, s.sent_idx AS other_sent, a.sent_idx - s.sent_idx AS sentence_position FROM ment a JOIN sent s ON s.doc_id = a.doc_id AND abs(s.sent_idx - a.sent_idx) <= 2"),
    "head_entity_types": _m("ov AS (SELECT doc_id, unnest(range(start_token, end_token)) AS tok_idx, type, ord FROM ment WHERE type <> 'CTX'), ag AS (SELECT doc_id, tok_idx, min_by(type, ord) AS type FROM ov GROUP BY ALL) SELECT m.doc_id, m.ent_id, coalesce(ag.type, 'O') AS ne FROM ment m LEFT JOIN ag ON ag.doc_id = m.doc_id AND ag.tok_idx = m.end_token - 1 WHERE m.type = 'CTX'"),
    "marked_mentions": _m("SELECT m.doc_id, m.ent_id, coalesce(bool_or(length(token) % 5 = 0), false) AS in_speech FROM (SELECT *, unnest(range(start_token, end_token)) AS tok_idx FROM ment) m LEFT JOIN tok t ON t.doc_id = m.doc_id AND t.tok_idx = m.tok_idx GROUP BY m.doc_id, m.ent_id"),
    "morph_features": oracle("SELECT doc_id, tok_idx, CAST(length(token) AS VARCHAR) AS morph_Len, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'Yes' END AS morph_Cap, CAST(NULL AS VARCHAR) AS morph_Case FROM tok"),
    "label_masks_of_mentions": _m("lab AS (SELECT a.doc_id, a.ent_id, a.type, coalesce(min_by(b.type, b.ord), 'None') AS label FROM ment a LEFT JOIN ment b ON a.doc_id = b.doc_id AND a.start_token = b.start_token AND a.end_token = b.end_token AND b.type IN ('CAP', 'NUM') WHERE a.type <> 'CAP' GROUP BY ALL), mp AS (SELECT type, list(DISTINCT label) AS l FROM lab GROUP BY type) SELECT m.doc_id, m.ent_id, array_to_string(list_transform(['CAP', 'NUM', 'None'], lambda x: CASE WHEN list_contains(l, x) THEN 1 ELSE 0 END), ',') AS mask FROM ment m LEFT JOIN mp ON mp.type = m.type"),
    "layer_codes": _m("cov AS (SELECT *, unnest(range(start_token, end_token)) AS tok_idx FROM ment WHERE type <> 'CTX'), tg AS (SELECT t.doc_id, t.tok_idx, CASE WHEN c.type IS NULL THEN 'O' ELSE (CASE WHEN c.tok_idx = c.start_token THEN 'B' ELSE 'I' END) || '-' || c.type END AS tag FROM tok t LEFT JOIN cov c ON c.doc_id = t.doc_id AND c.tok_idx = t.tok_idx), cd AS (SELECT tag, CAST(row_number() OVER (ORDER BY tag) AS INTEGER) AS tag_code FROM (SELECT DISTINCT s || '-' || type AS tag FROM ment, (SELECT unnest(['B', 'I']) AS s) WHERE type <> 'CTX' UNION SELECT 'O')) SELECT doc_id, tok_idx, tg.tag, tag_code FROM tg JOIN cd USING (tag)"),
    "pair_context": _m("pr AS (SELECT a.doc_id, a.ent_id AS id1, b.ent_id AS id2, a.start_token AS s, b.end_token AS e FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.ord BETWEEN b.ord - 2 AND b.ord - 1) SELECT pr.doc_id, id1, id2, coalesce(string_agg(m.ent_id, ' ' ORDER BY m.end_token, m.ord), '') AS context FROM pr LEFT JOIN ment m ON m.doc_id = pr.doc_id AND m.start_token >= s AND m.end_token <= e GROUP BY pr.doc_id, id1, id2"),
    "empty_features": oracle("ct AS (SELECT doc_id, count(*) AS n, count(*) FILTER (length(token) > 12) AS long, count(*) FILTER (doc_id % 3 > 0) AS third FROM tok GROUP BY doc_id) SELECT doc_id, 'long' AS feature, CASE WHEN long = 0 THEN 'empty' ELSE 'partial' END AS state FROM ct WHERE long < n UNION ALL SELECT doc_id, 'third', 'empty' FROM ct WHERE third = 0"),
    "path_pairs": oracle(TREE + " SELECT a.doc_id, a.sent_idx, a.tok_idx AS source, b.tok_idx AS target FROM tr a JOIN tr b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.tok_idx < b.tok_idx WHERE (length(a.token), length(b.token)) IN ((13, 14), (14, 13), (14, 14))"),
    "path_samples": "WITH RECURSIVE "
    + oracle(
        TREE
        + """, pr AS (SELECT a.doc_id, a.tok_idx AS source, b.tok_idx AS target, a.k AS k1, b.k AS k2 FROM tr a JOIN tr b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.tok_idx < b.tok_idx WHERE (length(a.token), length(b.token)) IN ((15, 15), (15, 16), (16, 15))),
        up AS (SELECT doc_id, source, target, 1 AS side, k1 AS node FROM pr UNION ALL SELECT doc_id, source, target, 2, k2 FROM pr UNION ALL SELECT doc_id, source, target, side, (node - 1) // 2 FROM up WHERE node > 0),
        tp AS (SELECT doc_id, source, target, node, count(DISTINCT side) AS sides FROM up GROUP BY ALL),
        top AS (SELECT doc_id, source, target, max(node) FILTER (sides = 2) AS top FROM tp GROUP BY ALL)
        SELECT doc_id, source, target, string_agg(node, ' ' ORDER BY node) AS on_path FROM tp JOIN top USING (doc_id, source, target) WHERE sides = 1 OR node = top GROUP BY ALL"""
    ).removeprefix("WITH "),
    "streams": "SELECT doc_id, lang, CAST(NULL AS BIGINT) AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels",
    "relation_codes": _m(RELATIONS + " SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT rel_type AS value FROM raw UNION SELECT 'None')"),
    "training_relations": _m(RELATIONS + f" SELECT rel.doc_id, first AS id1, second AS id2, rel_type FROM rel JOIN ment a ON a.doc_id = rel.doc_id AND a.ent_id = first JOIN ment b ON b.doc_id = rel.doc_id AND b.ent_id = second WHERE NOT {CROSS} AND {DIST} <= 9"),
    "relation_scores": _m(
        RELATIONS
        + f""", gd AS (SELECT raw.doc_id, a.ord AS o, rel_type, a.type || ',' || b.type AS args, {DIST} AS d, abs(a.sent_idx - b.sent_idx) AS sd FROM raw JOIN ment a ON a.doc_id = raw.doc_id AND a.ent_id = first JOIN ment b ON b.doc_id = raw.doc_id AND b.ent_id = second),
        pd AS (SELECT * REPLACE (CASE WHEN o % 5 = 0 THEN 'NEXT' ELSE rel_type END AS rel_type) FROM gd WHERE o % 4 <> 2),
        oc AS (SELECT *, 'TP' AS outcome FROM (SELECT * FROM gd INTERSECT SELECT * FROM pd) UNION ALL SELECT *, 'FN' FROM (SELECT * FROM gd EXCEPT SELECT * FROM pd) UNION ALL SELECT *, 'FP' FROM (SELECT * FROM pd EXCEPT SELECT * FROM gd)),
        cg AS (SELECT outcome, 'all' AS category, NULL AS value FROM oc UNION ALL SELECT outcome, 'type', rel_type FROM oc UNION ALL SELECT outcome, 'args_types', args FROM oc UNION ALL SELECT outcome, 'args_token_log_dists', CAST(CAST(round(log2(d + 1)) AS INTEGER) AS VARCHAR) FROM oc UNION ALL SELECT outcome, 'args_sent_dists', CAST(sd AS VARCHAR) FROM oc),
        ct AS (SELECT category, value, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM cg GROUP BY ALL) SELECT category, value, tp, fp, fn, {SCORES} FROM ct"""
    ),
    "noun_chains": _m(CHAINED + " SELECT doc_id, ent_id, chain_id FROM chn WHERE type = 'CAP'"),
    "noun_links": _m(CHAINED + " SELECT * FROM (SELECT doc_id, ent_id AS first, lead(ent_id) OVER (PARTITION BY doc_id, chain_id ORDER BY ord) AS second FROM chn WHERE type = 'CAP') WHERE second IS NOT NULL"),
    "exact_matches": _m(f"{WORDS} {MATCHED}"),
    "heuristic_scores": _m(
        f"{WORDS}, xm AS ({MATCHED}), it AS (SELECT a.doc_id, a.ent_id AS id1, b.ent_id AS id2 FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.ord < b.ord AND b.start_token < a.end_token AND a.start_token < b.end_token)"
        " SELECT doc_id, id1, id2, CAST(NULL AS VARCHAR) AS label, 1.0::DOUBLE AS score FROM it UNION ALL SELECT xm.*, 1.0::DOUBLE FROM xm ANTI JOIN it USING (doc_id, id1, id2)"
    ),
    "pronoun_ranks": _m(SCORED + " SELECT doc_id, e2 AS mention, e1 AS candidate, label FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.doc_id, e2 ORDER BY score DESC, e1) AS r FROM sc JOIN ment m ON m.doc_id = sc.doc_id AND m.ent_id = e2 AND m.type = 'CTX' WHERE label IS NOT NULL AND score > 0) WHERE r = 1"),
    "coref_training_pairs": _m(
        CHAINED
        + """, st AS (SELECT * FROM (SELECT doc_id, ord AS o1, ent_id AS id1, start_token AS s1, lead(ord) OVER w AS o2, lead(ent_id) OVER w AS id2, lead(end_token) OVER w AS e2 FROM chn WINDOW w AS (PARTITION BY doc_id, chain_id ORDER BY ord)) WHERE o2 IS NOT NULL)
        SELECT doc_id, id1, id2 FROM st UNION SELECT st.doc_id, m.ent_id, id2 FROM st JOIN ment m ON m.doc_id = st.doc_id AND m.ord <> o1 AND m.ord <> o2 AND m.start_token >= s1 AND m.end_token <= e2"""
    ),
    "paragraph_ranges": oracle(
        """tl AS (SELECT s.doc_id, s.sent_idx, t.char_end AS e, count(*) OVER (PARTITION BY s.doc_id) AS size FROM sent s JOIN tok t ON t.doc_id = s.doc_id AND t.tok_idx = s.end_token - 1),
        rp AS (SELECT doc_id, char_end AS e, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS k FROM tok WHERE tok_idx % 70 = 69),
        step AS (SELECT doc_id, 0::BIGINT AS k, -1::BIGINT AS last FROM tl GROUP BY doc_id UNION ALL
          SELECT step.doc_id, rp.k, (SELECT min(sent_idx) FROM tl WHERE tl.doc_id = step.doc_id AND tl.sent_idx > step.last AND tl.e >= rp.e) FROM step JOIN rp ON rp.doc_id = step.doc_id AND rp.k = step.k + 1 WHERE step.last IS NOT NULL),
        en AS (SELECT doc_id, last + 1 AS e FROM step WHERE last >= 0 UNION SELECT doc_id, max(size) FROM tl GROUP BY doc_id)
        SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS par_idx, CAST(coalesce(lag(e) OVER w, 0) AS INTEGER) AS start_sentence, CAST(e AS INTEGER) AS end_sentence FROM en WINDOW w AS (PARTITION BY doc_id ORDER BY e)"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "moved_spans": _m("SELECT doc_id, ent_id, start_token + 5 AS start_token, end_token + 5 AS end_token, 'MOVED' AS type FROM ment"),
    "signed_codes": oracle("cd AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS code FROM (SELECT CAST(unnest(range(-4, 5)) AS VARCHAR) AS v UNION ALL SELECT '$START$')) SELECT doc_id, tok_idx, code FROM tok JOIN cd ON v = CAST(least(greatest(tok_idx % 21 - 10, -4), 4) AS VARCHAR)"),
}
