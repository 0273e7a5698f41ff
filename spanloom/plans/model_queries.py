"""Queries over dictionaries, metrics, sampling and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import encode as E
from spanloom.operators import mentions as M
from spanloom.operators import metrics as X
from spanloom.operators import sampling as O
from spanloom.plans import base
from spanloom.plans.base import MENTIONS, oracle

MENTION_KEY = ["doc_id", "start_token", "end_token", "type"]


def char_vocab(spark, sf):
    return E.characters(base.tokens(spark, sf))


def vocabulary(spark, sf):
    model = spark.createDataFrame([("the",), ("unseen",)], "token string")
    return E.vocabulary(base.tokens(spark, sf), model, lower=True, digits=True)


def feature_labels(spark, sf):
    """Distinct values of a feature that is null on every third token."""
    made = base.tokens(spark, sf).select(F.when(F.col("tok_idx") % 3 > 0, F.length("token")).alias("feature"))
    return made.distinct()


def entity_types(spark, sf):
    return base.mentions(spark, sf).select("type").distinct()


def dict_encode(spark, sf):
    lengths = base.tokens(spark, sf).select(F.when(F.col("tok_idx") % 3 > 0, F.length("token") - 4).alias("v"))
    return E.dictionary(lengths, padding=True, oov=True)


def dict_reverse(spark, sf):
    return E.reverse(E.dictionary(base.mentions(spark, sf).select("type"), padding=False))


def dict_lookup(spark, sf):
    coded = E.dictionary(spark.createDataFrame([(x,) for x in ("the", "of", "and")], "v string"), oov=True)
    found = E.encode(base.tokens(spark, sf), "token", coded, "code", oov=True)
    return found.select("doc_id", "tok_idx", "code")


def clip_signed(spark, sf):
    d = F.col("tok_idx") % 41 - 20
    return base.tokens(spark, sf).select("doc_id", "tok_idx", T.clip_signed(d, -7, 9).alias("clipped"), T.clip_unsigned(F.abs(d), 5).alias("unsigned"))


def bit_log(spark, sf):
    return base.tokens(spark, sf).select("doc_id", "tok_idx", T.bit_log(F.col("tok_idx") % 41 - 20).alias("bits"))


def initial_vectors(spark, sf):
    words = E.vocabulary(base.tokens(spark, sf), None, lower=True)
    model = spark.createDataFrame([("the", [1.0, 2.0]), ("of", [3.0, 4.0])], "token string, vector array<double>")
    made = E.initial_vectors(words, model, 2, trainable=False)
    return made.select("token", F.get("vector", F.lit(0)).alias("v0"), F.get("vector", F.lit(1)).alias("v1"))


def padded_characters(spark, sf):
    return base.tokens(spark, sf).select("doc_id", "tok_idx", F.array_join(T.pad_characters(F.col("token"), 2, "_"), "").alias("chars"))


def _gold_and_predicted(spark, sf):
    """Gold are the runs; predictions miss numbers, and take the first token of longer runs alone."""
    gold = base.mentions(spark, sf).where("type <> 'CTX'")
    short = F.when(F.col("start_token") % 3 == 0, F.col("start_token") + 1).otherwise(F.col("end_token"))
    predicted = gold.where("type <> 'NUM' OR start_token % 2 = 0").withColumn("end_token", short)
    return gold, predicted


def _outcomes(spark, sf):
    gold, predicted = _gold_and_predicted(spark, sf)
    return X.outcome(predicted, gold, MENTION_KEY)


def outcomes(spark, sf):
    return _outcomes(spark, sf)


def prf_micro(spark, sf):
    return X.micro(_outcomes(spark, sf))


def prf_macro(spark, sf):
    return X.macro(_outcomes(spark, sf), base.documents(spark, sf))


def prf_by_category(spark, sf):
    made = _outcomes(spark, sf).withColumn("log_length", T.log_distance(F.col("end_token") - F.col("start_token")))
    return X.categorized(made, {"type": "type", "log_length": "log_length"})


def binary_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("p"), (F.col("toxic") == 1).alias("g"))
    return X.binary(df, "p", "g")


def binary_macro_scores(spark, sf):
    df = spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") % 7).alias("segment"), (F.col("quality") == 1).alias("p"), (F.col("toxic") == 1).alias("g"))
    return X.binary_macro(df, "p", "g", "segment")


def chain_b_cubed(spark, sf):
    m = base.mentions(spark, sf)
    return X.b_cubed(m.withColumn("chain_id", F.col("ord") % 5), m.withColumn("chain_id", F.col("ord") % 4))


def best_run(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("run")).agg(F.round(F.max("value"), 1).alias("score"))
    return X.best_run(runs)


def mean_scores(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_type").alias("path"), "value")
    return X.mean_scores(runs)


def fold_split(spark, sf):
    return O.folds(base.documents(spark, sf).select("doc_id"), 7, ["doc_id"])


def standard_batches(spark, sf):
    return O.batches(base.documents(spark, sf).select("doc_id"), 32, ["doc_id"])


def bucketed_batches(spark, sf):
    docs = base.documents(spark, sf).select("doc_id", F.length("text").alias("n"))
    return O.bucketed_batches(docs, 8, "n", 500, ["n", "doc_id"])


def segment_batches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    return O.segment_batches(docs, 16, "source", ["doc_id"])


def pad2d(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.transform(F.split("text", " "), F.length).alias("lens"), F.transform(F.split("text", "[.]"), lambda s: F.transform(F.split(s, " "), F.length)).alias("deep"))
    once = O.padded(turns, ["conv_id"], "lens", F.lit(0))
    made = O.padded_2d(once, ["conv_id"], "deep", F.lit(-1))
    return made.select("conv_id", "turn", F.array_join(F.col("lens").cast("array<string>"), ",").alias("lens"), F.array_join(F.transform("deep", lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("deep"))


def top_documents(spark, sf):
    return O.top(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"), "n_chars", "doc_id", 5)


def paged_events(spark, sf):
    return O.page(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id"), "event_id", 3, 10)


def neighbours_in_time(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_id").over(w).alias("next"))


def unprocessed(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    done = events.where("event_id % 3 = 0").select("event_id")
    return events.join(done, "event_id", "left_anti")


def down_sampled(spark, sf):
    from spanloom.operators import pairs as P

    m = M.numbered(M.runs(M.annotate(base.tokens(spark, sf))))
    made = m.select("doc_id", "ent_id", F.when(F.col("type") == "NUM", "NUM").alias("label"))
    return P.down_sampled(made, ["doc_id", "ent_id"], 2.0).groupBy("label").agg(F.count("*").alias("n"))


def early_stopping(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", (F.length("text") % 3 == 0).alias("improved"))
    return O.stopped(turns, 4, ["conv_id", "turn"])


QUERIES = {f.__name__: f for f in (char_vocab, vocabulary, feature_labels, entity_types, dict_encode, dict_reverse, dict_lookup, clip_signed, bit_log, initial_vectors, padded_characters, outcomes, prf_micro, prf_macro, prf_by_category, binary_scores, binary_macro_scores, chain_b_cubed, best_run, mean_scores, fold_split, standard_batches, bucketed_batches, segment_batches, pad2d, top_documents, paged_events, neighbours_in_time, unprocessed, down_sampled, early_stopping)}

SCORES = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1"""
OUTCOMES = """gd AS (SELECT doc_id, start_token, end_token, type FROM ment WHERE type <> 'CTX'),
pd AS (SELECT doc_id, start_token, CASE WHEN start_token % 3 = 0 THEN start_token + 1 ELSE end_token END AS end_token, type FROM gd WHERE type <> 'NUM' OR start_token % 2 = 0),
oc AS (SELECT coalesce(gd.doc_id, pd.doc_id) AS doc_id, coalesce(gd.start_token, pd.start_token) AS start_token, coalesce(gd.end_token, pd.end_token) AS end_token, coalesce(gd.type, pd.type) AS type,
  CASE WHEN gd.doc_id IS NULL THEN 'FP' WHEN pd.doc_id IS NULL THEN 'FN' ELSE 'TP' END AS outcome
  FROM gd FULL JOIN (SELECT DISTINCT * FROM pd) pd ON gd.doc_id = pd.doc_id AND gd.start_token = pd.start_token AND gd.end_token = pd.end_token AND gd.type = pd.type)"""
COUNTS = "count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn"
DICT = "vs AS (SELECT DISTINCT CASE WHEN tok_idx % 3 > 0 THEN length(token) - 4 END AS v FROM tok), cd AS (SELECT coalesce(CAST(v AS VARCHAR), 'None') AS value, CAST(row_number() OVER (ORDER BY coalesce(CAST(v AS VARCHAR), 'None')) AS INTEGER) AS code FROM vs)"
BINARY = "SELECT {seg} count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels"
ACCURACY = "(tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy"

ORACLES = {
    "char_vocab": oracle("SELECT DISTINCT unnest(string_split(token, '')) AS char FROM tok"),
    "vocabulary": oracle("SELECT DISTINCT lower(regexp_replace(token, '[0-9]+', '0', 'g')) AS token FROM tok UNION SELECT 'the' UNION SELECT 'unseen'"),
    "feature_labels": oracle("SELECT DISTINCT CASE WHEN tok_idx % 3 > 0 THEN CAST(length(token) AS INTEGER) END AS feature FROM tok"),
    "entity_types": oracle("SELECT DISTINCT type FROM ment", MENTIONS),
    "dict_encode": oracle(DICT + " SELECT value, code FROM cd UNION ALL SELECT '$PADDING$', 0 UNION ALL SELECT '$OOV$', max(code) + 1 FROM cd"),
    "dict_reverse": oracle("SELECT type AS value, CAST(row_number() OVER (ORDER BY type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT type FROM ment)", MENTIONS),
    "dict_lookup": oracle("SELECT doc_id, tok_idx, CASE token WHEN 'and' THEN 1 WHEN 'of' THEN 2 WHEN 'the' THEN 3 ELSE 4 END AS code FROM tok"),
    "clip_signed": oracle("SELECT doc_id, tok_idx, least(greatest(tok_idx % 41 - 20, -8), 10) AS clipped, least(abs(tok_idx % 41 - 20), 6) AS unsigned FROM tok"),
    "bit_log": oracle("SELECT doc_id, tok_idx, CASE WHEN d = 0 THEN 0 ELSE CAST(sign(d) * (floor(log2(abs(d))) + 1) AS INTEGER) END AS bits FROM (SELECT *, tok_idx % 41 - 20 AS d FROM tok)"),
    "initial_vectors": oracle("SELECT DISTINCT lower(token) AS token, CASE lower(token) WHEN 'the' THEN 1.0 WHEN 'of' THEN 3.0 ELSE 0.0 END::DOUBLE AS v0, CASE lower(token) WHEN 'the' THEN 2.0 WHEN 'of' THEN 4.0 ELSE 0.0 END::DOUBLE AS v1 FROM tok"),
    "padded_characters": oracle("SELECT doc_id, tok_idx, '__' || token || '__' AS chars FROM tok"),
    "outcomes": oracle(OUTCOMES + " SELECT * FROM oc", MENTIONS),
    "prf_micro": oracle(OUTCOMES + f", ct AS (SELECT {COUNTS} FROM oc) SELECT tp, fp, fn, {SCORES} FROM ct", MENTIONS),
    "prf_macro": oracle(OUTCOMES + f", ct AS (SELECT doc_id, {COUNTS} FROM oc GROUP BY doc_id), sc AS (SELECT doc_id, {SCORES} FROM ct) SELECT avg(coalesce(precision, 0)) AS precision, avg(coalesce(recall, 0)) AS recall, avg(coalesce(f1, 0)) AS f1 FROM documents LEFT JOIN sc USING (doc_id)", MENTIONS),
    "prf_by_category": oracle(
        OUTCOMES
        + f""", cg AS (SELECT outcome, 'all' AS category, NULL AS value FROM oc UNION ALL SELECT outcome, 'type', type FROM oc UNION ALL SELECT outcome, 'log_length', CAST(CAST(round(log2(end_token - start_token + 1)) AS INTEGER) AS VARCHAR) FROM oc),
        ct AS (SELECT category, value, {COUNTS} FROM cg GROUP BY ALL) SELECT category, value, tp, fp, fn, {SCORES} FROM ct""",
        MENTIONS,
    ),
    "binary_scores": f"WITH ct AS ({BINARY.format(seg='')}) SELECT {SCORES}, {ACCURACY} FROM ct",
    "binary_macro_scores": f"WITH ct AS ({BINARY.format(seg='doc_id % 7 AS segment,')} GROUP BY 1), sc AS (SELECT {SCORES}, {ACCURACY} FROM ct) SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(accuracy) AS accuracy FROM sc",
    "chain_b_cubed": oracle(
        """bs AS (SELECT count(*) OVER (PARTITION BY doc_id, ord % 5) AS np, count(*) OVER (PARTITION BY doc_id, ord % 4) AS ng, count(*) OVER (PARTITION BY doc_id, ord % 5, ord % 4) AS n FROM ment),
        pr AS (SELECT avg(n::DOUBLE / np) AS precision, avg(n::DOUBLE / ng) AS recall FROM bs) SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM pr""",
        MENTIONS,
    ),
    "best_run": "SELECT user_id AS run, round(max(value), 1) AS score FROM events GROUP BY 1 ORDER BY score DESC, run LIMIT 1",
    "mean_scores": "SELECT event_type AS path, avg(value) AS value FROM events GROUP BY 1",
    "fold_split": "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM documents",
    "standard_batches": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents",
    "bucketed_batches": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, length(text) // 500 AS bucket, (row_number() OVER (PARTITION BY length(text) // 500 ORDER BY length(text), doc_id) - 1) // 8 AS batch FROM documents",
    "segment_batches": "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS batch FROM documents",
    "top_documents": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5",
    "paged_events": "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 10 OFFSET 20",
    "neighbours_in_time": "SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "unprocessed": "SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0",
    "down_sampled": oracle("nm AS (SELECT count(*) FILTER (type = 'NUM') AS p, count(*) FILTER (type <> 'NUM') AS n FROM runs) SELECT 'NUM' AS label, p AS n FROM nm WHERE p > 0 UNION ALL SELECT NULL, least(n, 2 * p) FROM nm", MENTIONS),
    "early_stopping": "WITH ep AS (SELECT conv_id, turn, length(text) % 3 = 0 AS improved FROM conversations), rn AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (ORDER BY conv_id, turn) AS run FROM ep), bd AS (SELECT *, sum(CASE WHEN improved THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY conv_id, turn) AS bad FROM rn) SELECT conv_id, turn, improved, max(bad) OVER (ORDER BY conv_id, turn) >= 4 AS stopped FROM bd",
    "pad2d": """WITH ls AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS l, list_transform(string_split(text, '.'), lambda s: list_transform(string_split(s, ' '), lambda x: length(x))) AS d FROM conversations),
    mx AS (SELECT *, max(len(l)) OVER w AS ml, max(len(d)) OVER w AS outer_n, max(list_max(list_transform(d, lambda x: len(x)))) OVER w AS inner_n FROM ls WINDOW w AS (PARTITION BY conv_id))
    SELECT conv_id, turn, array_to_string(list_transform(range(1, ml + 1), lambda i: coalesce(l[i], 0)), ',') AS lens, array_to_string(list_transform(range(1, outer_n + 1), lambda i: array_to_string(list_transform(range(1, inner_n + 1), lambda j: coalesce(d[i][j], -1)), ',')), ';') AS deep FROM mx""",
}
