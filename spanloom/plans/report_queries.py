"""Queries over samples of pairs, classifiers' answers, reports and whole document models."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import encode as E
from spanloom.operators import labels as L
from spanloom.operators import mentions as M
from spanloom.operators import metrics as ME
from spanloom.operators import models as ML
from spanloom.operators import pairs as P
from spanloom.operators import rewrite as W
from spanloom.operators import sampling as O
from spanloom.plans import base, pipeline
from spanloom.plans.base import MENTIONS, oracle
from spanloom.plans.model_queries import OUTCOMES, SCORES, _gold_and_predicted
from spanloom.plans.rewrite_queries import MAPPED
from spanloom.plans.span_queries import RELATIONS, _relations
from spanloom.sources import writers
from spanloom.store import materialise


def _collapsed(spark, sf):
    tokens = base.tokens(spark, sf).withColumns({"size": F.length("token"), "pos": F.when(F.length("token") > 4, "LONG").otherwise("SHORT")})
    m = base.mentions(spark, sf)
    return W.collapse({"tokens": tokens, "sentences": W.adjust_sentences(base.sentences(spark, sf), m), "mentions": m}, ["CTX", "NUM"])


def collapsed_features(spark, sf):
    return _collapsed(spark, sf)["tokens"].select("doc_id", "tok_idx", "token", "size", "pos", "char_start", "char_end")


def collapsed_sentences(spark, sf):
    return _collapsed(spark, sf)["sentences"]


def bad_entities(spark, sf):
    """Entities by character, some of which reach over the end of their text."""
    raw = base.tokens(spark, sf).where("tok_idx % 3 = 0").select("doc_id", "tok_idx", F.col("char_start").alias("start"), (F.col("char_end") + 2).alias("end"))
    return pipeline.checked_entities(raw, base.documents(spark, sf)).select("doc_id", "tok_idx")


def unresolved_relations(spark, sf):
    m = base.mentions(spark, sf)
    return P.unresolved(_relations(spark, sf), m.where("ord % 10 > 0")).select("doc_id", "known", "rel_type")


def evaluated_mentions(spark, sf):
    gold, predicted = _gold_and_predicted(spark, sf)
    found = pipeline.evaluator_for("ner")(predicted, gold, base.documents(spark, sf))
    return found["categories"]


def stripped_mentions(spark, sf):
    """Mentions that stand in marks, where every eleventh token and the second after it are marks."""
    tokens = base.tokens(spark, sf).withColumn("token", F.when(F.col("tok_idx") % 11 == 0, "«").when(F.col("tok_idx") % 11 == 2, "»").otherwise(F.col("token")))
    return M.strip_quotes(base.mentions(spark, sf), tokens, "«»").select("doc_id", "ent_id", "start_token", "end_token")


def answers(spark, sf):
    """Types of a single label get it; the others the label that a model, here a rule, gives."""
    m = base.mentions(spark, sf).select("doc_id", "ent_id", "ord", "type")
    single = spark.createDataFrame([("NUM", "number"), ("MAIL", "address")], "type string, only string")
    made = ML.with_constant_answers(m, single, lambda df: df.withColumn("label", F.when(F.col("ord") % 2 == 0, "even").otherwise("odd")))
    return made.select("doc_id", "ent_id", "label")


def plugged_in(spark, sf):
    """An external model's answers by batch: the word in lower case."""
    return ML.plug_in(base.tokens(spark, sf).select("doc_id", "tok_idx", "token"), lambda: lambda frame: frame.assign(token=frame["token"].str.lower()), "doc_id long, tok_idx int, token string")


def retyped_mentions(spark, sf):
    m = base.mentions(spark, sf)
    return ML.retyped(m, m.where("ord % 2 = 0").select("doc_id", "ent_id", F.lit("NEW").alias("type"))).select("doc_id", "ent_id", "type")


def pair_samples(spark, sf):
    """Samples of neighbouring mentions: the sizes of all tokens of their sentences, and where the two stand in them."""
    pairs = P.preceding(base.mentions(spark, sf).where("type IN ('NUM', 'MAIL')").withColumn("ord", F.col("ord")), 1)
    tokens, sentences = base.tokens(spark, sf).withColumn("size", F.length("token")), base.sentences(spark, sf)
    made = ML.pair_samples(pairs, tokens, sentences, ["size"])
    return made.select("doc_id", F.col("e1.ent_id").alias("id1"), F.col("e2.ent_id").alias("id2"), F.array_join(F.flatten("indices").cast("array<string>"), ",").alias("indices"), F.array_join(F.col("size").cast("array<string>"), ",").alias("size"), "seq_len")


def group_samples(spark, sf):
    m = base.mentions(spark, sf).select("doc_id", "type", F.col("doc_id").alias("shared"), "ord")
    made = ML.group_samples(m, ["doc_id", "type"], ["shared"], ["ord"])
    return made.select("doc_id", "type", "shared", "chain_len", F.array_join(F.array_sort("ord").cast("array<string>"), ",").alias("ord"))


def character_codes(spark, sf):
    """Codes of a word's first letter class and the rest, by a small dictionary."""
    kinds = F.transform(F.split("token", ""), lambda c: F.when(c.rlike("[A-Z]"), "U").when(c.rlike("[a-z]"), "L").otherwise("X"))
    coded = E.encode_sequence(kinds, {"U": 1, "L": 2, "X": 3})
    return base.tokens(spark, sf).select("doc_id", "tok_idx", F.array_join(coded.cast("array<string>"), "").alias("codes"))


def token_reports(spark, sf):
    """Gold tags are those of the runs, predicted ones those of runs that aren't numbers."""
    tokens, m = base.tokens(spark, sf), base.mentions(spark, sf).where("type <> 'CTX'")
    return writers.token_report(tokens, L.encode(tokens, m.where("type <> 'NUM'"), "io"), L.encode(tokens, m, "io"))


def relation_reports(spark, sf):
    m = materialise(base.mentions(spark, sf), "mentions")
    gold = P.resolve(_relations(spark, sf, m), m, [])
    rows = gold.select("doc_id", F.col("e1.sent_idx").alias("sent_idx"), F.col("e1.ent_id").alias("first"), F.col("e2.ent_id").alias("second"), "rel_type", F.col("e1.ord").alias("o"))
    keys = ["doc_id", "sent_idx", "first", "second", "rel_type"]
    outcomes = ME.outcome(rows.where("o % 4 <> 0").withColumn("rel_type", F.when(F.col("o") % 5 == 0, "NEXT").otherwise(F.col("rel_type"))), rows, keys)
    made = writers.relation_report(outcomes, base.tokens(spark, sf), m)
    return made.select("doc_id", "sent_idx", "tokens", *(F.array_join(c, ";").alias(c) for c in ("entities", "false_positives", "false_negatives", "true_positives")))


def json_mentions(spark, sf):
    return writers.json_rows(base.mentions(spark, sf).select("doc_id", "ent_id", "start_token"))


def result_files(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("score"))
    return writers.result_rows(ME.best_run(runs), runs.agg(F.sum("score").alias("total")), runs)


def fitting_vectors(spark, sf):
    """Hashed vectors of distinct short words, and two vectorizers side by side: their lengths and whether equal words agree."""
    words = base.tokens(spark, sf).where("length(token) = 3").select("token").distinct()
    both = ML.concat_vectors(ML.hashed_vector(F.col("token"), 4), ML.hashed_vector(F.lower("token"), 4))
    made = words.withColumn("v", both)
    return made.select("token", F.size("v").cast("long").alias("size"), (F.slice("v", 1, 4) == F.slice("v", 5, 4)).alias("same"), F.forall("v", lambda x: F.abs(x) <= 1).alias("bounded"))


def typed_layers(spark, sf):
    """Mentions for typing with their types in both layers."""
    run = pipeline.preprocessor_for("net", {"ent_types_to_filter": ["MAIL"], "ent_types_merge_pattern": {"NAME": ["CAP"]}, "ne_types_merge_pattern": {"OTHER": ["NUM", "CTX"]}})
    made = run({"mentions": base.mentions(spark, sf)})
    ne = made["ne"].select("doc_id", "ent_id", F.col("type").alias("ne_type"))
    return made["mentions"].select("doc_id", "ent_id", "type").join(ne, ["doc_id", "ent_id"])


def pad3d(spark, sf):
    """Lengths of runs of letters, in words, in sentences of turns, padded in all three ranks."""
    runs = lambda w: F.transform(F.split(w, "e"), F.length)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.transform(F.split("text", "[.]"), lambda s: F.transform(F.split(s, " "), runs)).alias("deep"))
    made = O.padded_nd(turns, ["conv_id"], "deep", F.lit(-1), 3)
    flat = F.array_join(F.transform("deep", lambda s: F.array_join(F.transform(s, lambda w: F.array_join(w.cast("array<string>"), ",")), ";")), "|")
    return made.select("conv_id", "turn", F.md5(flat.cast("binary")).alias("deep"))


def cross_validated(spark, sf):
    """For each of five folds of labelled documents how often the held-out label is the one most frequent in training."""
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")

    def run(train, rest):
        most = train.groupBy("quality").count().orderBy(F.desc("count"), "quality").limit(1).select(F.col("quality").alias("guess"))
        return rest.join(F.broadcast(most)).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("guess")).alias("hits"))  # one row

    return O.cross_validated(rows, 5, ["doc_id"], run)


def chain_muc(spark, sf):
    m = base.mentions(spark, sf)
    return ME.muc(m.where("ord % 7 > 0").withColumn("chain_id", F.col("ord") % 5), m.withColumn("chain_id", F.col("ord") % 4))


def rendered_texts(spark, sf):
    """Texts cut at the runs of tokens that are mentions."""
    m, t = base.mentions(spark, sf).where("type <> 'CTX'"), base.tokens(spark, sf)
    first = t.select("doc_id", F.col("tok_idx").alias("start_token"), F.col("char_start").alias("start"))
    last = t.select("doc_id", (F.col("tok_idx") + 1).alias("end_token"), F.col("char_end").alias("end"))
    spans = m.join(first, ["doc_id", "start_token"]).join(last, ["doc_id", "end_token"]).select("doc_id", "start", "end", "type")
    return M.rendered(base.documents(spark, sf), spans)


QUERIES = {
    f.__name__: f
    for f in (collapsed_features, collapsed_sentences, bad_entities, unresolved_relations, evaluated_mentions, stripped_mentions, answers, plugged_in, retyped_mentions, pair_samples, group_samples, character_codes, token_reports, relation_reports, json_mentions, result_files, fitting_vectors, typed_layers, pad3d, cross_validated, chain_muc, rendered_texts)
}


def _m(select: str) -> str:
    return oracle(select, MENTIONS)


ADJUSTED = """cx AS (SELECT s.doc_id, s.sent_idx, s.start_token, s.end_token, coalesce(bool_or(m.start_token < s.start_token AND m.end_token > s.start_token), false) AS crossed FROM sent s LEFT JOIN ment m ON m.doc_id = s.doc_id GROUP BY ALL),
cg AS (SELECT *, sum(CASE WHEN crossed THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS g FROM cx),
adj AS (SELECT doc_id, CAST(g AS INTEGER) AS sent_idx, min(start_token) AS start_token, max(end_token) AS end_token FROM cg GROUP BY doc_id, g)"""

ORACLES = {
    "collapsed_features": _m(
        MAPPED
        + """, ce AS (SELECT mp.doc_id, new_idx, max(char_end) AS char_end FROM mp JOIN tok ON tok.doc_id = mp.doc_id AND tok.tok_idx = mp.tok_idx GROUP BY ALL)
        SELECT mp.doc_id, mp.new_idx AS tok_idx, CASE WHEN kind IS NULL THEN mp.token ELSE '$' || kind || '$' END AS token, CASE WHEN kind IS NULL THEN length(mp.token) ELSE 0 END AS size, CASE WHEN kind IS NOT NULL THEN '$' || kind || '$' WHEN length(mp.token) > 4 THEN 'LONG' ELSE 'SHORT' END AS pos, tok.char_start, ce.char_end
        FROM mp JOIN tok ON tok.doc_id = mp.doc_id AND tok.tok_idx = mp.tok_idx JOIN ce ON ce.doc_id = mp.doc_id AND ce.new_idx = mp.new_idx WHERE stays"""
    ),
    "collapsed_sentences": _m(MAPPED + ", " + ADJUSTED + " SELECT adj.doc_id, sent_idx, a.new_idx AS start_token, b.new_idx + 1 AS end_token FROM adj JOIN mp a ON a.doc_id = adj.doc_id AND a.tok_idx = start_token JOIN mp b ON b.doc_id = adj.doc_id AND b.tok_idx = end_token - 1"),
    "bad_entities": oracle("SELECT t.doc_id, t.tok_idx FROM tok t JOIN documents d ON d.doc_id = t.doc_id WHERE t.tok_idx % 3 = 0 AND t.char_end + 2 > length(d.text)"),
    "unresolved_relations": _m(RELATIONS + ", en AS (SELECT doc_id, first AS known, rel_type FROM raw UNION ALL SELECT doc_id, second, rel_type FROM raw) SELECT en.* FROM en JOIN ment m ON m.doc_id = en.doc_id AND m.ent_id = known WHERE m.ord % 10 = 0"),
    "evaluated_mentions": _m(OUTCOMES + f", cg AS (SELECT outcome, 'all' AS category, NULL AS value FROM oc UNION ALL SELECT outcome, 'type', type FROM oc), ct AS (SELECT category, value, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM cg GROUP BY ALL) SELECT category, value, tp, fp, fn, {SCORES} FROM ct"),
    "stripped_mentions": _m("q AS (SELECT m.*, end_token - start_token > 2 AND start_token % 11 IN (0, 2) AND (end_token - 1) % 11 IN (0, 2) AS quoted FROM ment m JOIN tok t ON t.doc_id = m.doc_id AND t.tok_idx = m.end_token - 1) SELECT doc_id, ent_id, start_token + CAST(quoted AS INTEGER) AS start_token, end_token - CAST(quoted AS INTEGER) AS end_token FROM q"),
    "answers": _m("SELECT doc_id, ent_id, CASE WHEN type = 'NUM' THEN 'number' WHEN type = 'MAIL' THEN 'address' WHEN ord % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM ment"),
    "plugged_in": oracle("SELECT doc_id, tok_idx, lower(token) AS token FROM tok"),
    "retyped_mentions": _m("SELECT doc_id, ent_id, CASE WHEN ord % 2 = 0 THEN 'NEW' ELSE type END AS type FROM ment"),
    "pair_samples": _m(
        """few AS (SELECT *, lag(ent_id) OVER w AS id1, lag(start_token) OVER w AS s1, lag(end_token) OVER w AS e1, lag(sent_idx) OVER w AS x1 FROM ment WHERE type IN ('NUM', 'MAIL') WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
        wn AS (SELECT f.*, a.start_token AS ws, b.end_token AS we FROM few f JOIN sent a ON a.doc_id = f.doc_id AND a.sent_idx = least(x1, f.sent_idx) JOIN sent b ON b.doc_id = f.doc_id AND b.sent_idx = greatest(x1, f.sent_idx) WHERE id1 IS NOT NULL)
        SELECT wn.doc_id, id1, ent_id AS id2, concat_ws(',', s1 - ws, e1 - ws, start_token - ws, end_token - ws) AS indices, string_agg(length(token), ',' ORDER BY tok_idx) AS size, CAST(count(*) AS INTEGER) AS seq_len FROM wn JOIN tok ON tok.doc_id = wn.doc_id AND tok_idx >= ws AND tok_idx < we GROUP BY ALL"""
    ),
    "group_samples": _m("SELECT doc_id, type, doc_id AS shared, count(*) AS chain_len, string_agg(ord, ',' ORDER BY ord) AS ord FROM ment GROUP BY doc_id, type"),
    "character_codes": oracle("SELECT doc_id, tok_idx, regexp_replace(regexp_replace(regexp_replace(token, '[^A-Za-z]', '3', 'g'), '[A-Z]', '1', 'g'), '[a-z]', '2', 'g') AS codes FROM tok"),
    "token_reports": _m(
        """cov AS (SELECT doc_id, type, unnest(range(start_token, end_token)) AS tok_idx FROM ment WHERE type <> 'CTX'),
        tl AS (SELECT t.doc_id, t.sent_idx, t.tok_idx, token || chr(9) || CASE WHEN c.type IS NULL OR c.type = 'NUM' THEN 'O' ELSE 'I-' || c.type END || chr(9) || coalesce('I-' || c.type, 'O') AS line FROM tok t LEFT JOIN cov c ON c.doc_id = t.doc_id AND c.tok_idx = t.tok_idx),
        bl AS (SELECT doc_id, sent_idx, string_agg(line, chr(10) ORDER BY tok_idx) AS block FROM tl GROUP BY ALL)
        SELECT doc_id, 'Token' || chr(9) || 'Predicted Label' || chr(9) || 'Gold Label' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY sent_idx) AS report FROM bl GROUP BY doc_id"""
    ),
    "relation_reports": _m(
        RELATIONS
        + """, gd AS (SELECT raw.doc_id, a.sent_idx, first, second, rel_type, a.ord AS o FROM raw JOIN ment a ON a.doc_id = raw.doc_id AND a.ent_id = first),
        pd AS (SELECT * REPLACE (CASE WHEN o % 5 = 0 THEN 'NEXT' ELSE rel_type END AS rel_type) FROM gd WHERE o % 4 <> 0),
        oc AS (SELECT *, 'TP' AS outcome FROM (SELECT * FROM gd INTERSECT SELECT * FROM pd) UNION ALL SELECT *, 'FN' FROM (SELECT * FROM gd EXCEPT SELECT * FROM pd) UNION ALL SELECT *, 'FP' FROM (SELECT * FROM pd EXCEPT SELECT * FROM gd)),
        wt AS (SELECT doc_id, sent_idx, string_agg(token, ' ' ORDER BY tok_idx) AS tokens FROM tok GROUP BY ALL),
        we AS (SELECT doc_id, sent_idx, string_agg(concat_ws(' ', ent_id, start_token, end_token, type), ';' ORDER BY ord) AS entities FROM ment GROUP BY ALL),
        li AS (SELECT doc_id, sent_idx, outcome, first || ' ' || second || ' ' || rel_type AS l FROM oc)
        SELECT doc_id, sent_idx, any_value(tokens) AS tokens, any_value(entities) AS entities, coalesce(string_agg(l, ';' ORDER BY l) FILTER (outcome = 'FP'), '') AS false_positives, coalesce(string_agg(l, ';' ORDER BY l) FILTER (outcome = 'FN'), '') AS false_negatives, coalesce(string_agg(l, ';' ORDER BY l) FILTER (outcome = 'TP'), '') AS true_positives FROM li LEFT JOIN wt USING (doc_id, sent_idx) LEFT JOIN we USING (doc_id, sent_idx) GROUP BY doc_id, sent_idx"""
    ),
    "json_mentions": _m("""SELECT '{"doc_id":' || doc_id || ',"ent_id":"' || ent_id || '","start_token":' || start_token || '}' AS json FROM ment"""),
    "result_files": """WITH r AS (SELECT event_type AS run, count(*) AS score FROM events GROUP BY 1), j AS (SELECT *, '{"run":"' || run || '","score":' || score || '}' AS js FROM r)
    SELECT 'experiments_report.json' AS file, string_agg(js, chr(10) ORDER BY js) AS json FROM j UNION ALL SELECT 'mean_results.json', '{"total":' || sum(score) || '}' FROM r UNION ALL SELECT 'best_results.json', js FROM (SELECT * FROM j ORDER BY score DESC, run LIMIT 1)""",
    "typed_layers": _m("SELECT doc_id, ent_id, CASE type WHEN 'CAP' THEN 'NAME' ELSE type END AS type, CASE WHEN type IN ('NUM', 'CTX') THEN 'OTHER' ELSE type END AS ne_type FROM ment WHERE type <> 'MAIL'"),
    "pad3d": """WITH ds AS (SELECT conv_id, turn, list_transform(string_split(text, '.'), lambda s: list_transform(string_split(s, ' '), lambda w: list_transform(string_split(w, 'e'), lambda x: length(x)))) AS d FROM conversations),
    mx AS (SELECT *, max(len(d)) OVER w AS a, max(list_max(list_transform(d, lambda s: len(s)))) OVER w AS b, max(list_max(list_transform(d, lambda s: list_max(list_transform(s, lambda x: len(x)))))) OVER w AS c FROM ds WINDOW w AS (PARTITION BY conv_id))
    SELECT conv_id, turn, md5(array_to_string(list_transform(range(1, a + 1), lambda i: array_to_string(list_transform(range(1, b + 1), lambda j: array_to_string(list_transform(range(1, c + 1), lambda k: coalesce(d[i][j][k], -1)), ',')), ';')), '|')) AS deep FROM mx""",
    "cross_validated": """WITH f AS (SELECT quality, CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels), g AS (SELECT a.fold, b.quality, count(*) AS n FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY ALL),
    t AS (SELECT fold, quality AS guess, row_number() OVER (PARTITION BY fold ORDER BY n DESC, quality) AS r FROM g) SELECT f.fold, count(*) AS n, count(*) FILTER (quality = guess) AS hits FROM f JOIN t ON t.fold = f.fold AND r = 1 GROUP BY f.fold""",
    "chain_muc": _m(
        """pd AS (SELECT doc_id, ent_id, ord % 5 AS p, ord % 4 AS g FROM ment WHERE ord % 7 > 0), gd AS (SELECT doc_id, ent_id, ord % 4 AS g, CASE WHEN ord % 7 > 0 THEN ord % 5 END AS p FROM ment),
        pr AS (SELECT sum(n - k)::DOUBLE / sum(n - 1) AS precision FROM (SELECT count(*) AS n, count(DISTINCT g) AS k FROM pd GROUP BY doc_id, p)),
        rc AS (SELECT sum(n - k)::DOUBLE / sum(n - 1) AS recall FROM (SELECT count(*) AS n, count(DISTINCT p) + count(*) FILTER (p IS NULL) AS k FROM gd GROUP BY doc_id, g))
        SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM pr, rc"""
    ),
    "rendered_texts": _m(
        """sp AS (SELECT m.doc_id, a.char_start AS s, b.char_end AS e, type FROM ment m JOIN tok a ON a.doc_id = m.doc_id AND a.tok_idx = start_token JOIN tok b ON b.doc_id = m.doc_id AND b.tok_idx = end_token - 1 WHERE type <> 'CTX'),
        cut AS (SELECT * FROM sp UNION ALL SELECT doc_id, coalesce(lag(e) OVER w, 0), s, NULL FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY s) UNION ALL SELECT d.doc_id, coalesce(max(e), 0), length(any_value(text)), NULL FROM documents d LEFT JOIN sp ON sp.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id)
        SELECT cut.doc_id, CAST(row_number() OVER (PARTITION BY cut.doc_id ORDER BY s) - 1 AS INTEGER) AS piece_idx, substr(text, s + 1, e - s) AS text, type FROM cut JOIN documents d ON d.doc_id = cut.doc_id WHERE e > s"""
    ),
    "fitting_vectors": oracle("SELECT DISTINCT token, CAST(8 AS BIGINT) AS size, token = lower(token) AS same, true AS bounded FROM tok WHERE length(token) = 3"),
}
