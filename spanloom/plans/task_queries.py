"""Queries over pooling, losses, classifiers, writers and whole predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import models as ML
from spanloom.plans import base, pipeline
from spanloom.plans.base import MENTIONS, oracle
from spanloom.plans.graph_queries import CHAINED
from spanloom.plans.graph_queries import chains as chain_table
from spanloom.plans.rewrite_queries import MAPPED
from spanloom.sources import writers as W


def pooled_vectors(spark, sf):
    """All components of the pooled vectors, a row each."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") % 50).alias("g"), F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("v"))
    grouped = v.groupBy("g").agg(F.collect_list("v").alias("vs"))
    both = grouped.select("g", F.posexplode(F.arrays_zip(ML.pool(F.col("vs"), "max").alias("top"), ML.pool(F.col("vs"), "mean").alias("mean"))).alias("i", "p"))
    return both.select("g", F.col("i").cast("long").alias("i"), F.round("p.top", 6).alias("top"), F.round("p.mean", 6).alias("mean"))


def masked_losses(spark, sf):
    """Losses over all components, the last one masked."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 3).cast("int").alias("y"))
    mask = F.transform("x", lambda _, i: (i < F.size("x") - 1).cast("int"))
    gold = F.transform("x", lambda _, i: ((F.col("vec_id") + i) % 2).cast("double"))
    return v.select("vec_id", F.round(ML.cross_entropy(F.col("x"), mask, F.col("y")), 6).alias("softmax"), F.round(ML.sigmoid_cross_entropy(F.col("x"), gold), 6).alias("sigmoid"), F.round(ML.margin_loss(F.col("x"), F.col("y")), 6).alias("margin"))


def sentence_samples(spark, sf):
    made = ML.sentence_samples(base.tokens(spark, sf).withColumn("len", F.length("token")), ["len"])
    return made.select("doc_id", "sent_idx", "seq_len", F.array_join(F.col("len").cast("array<string>"), ",").alias("len"))


def coreference_lines(spark, sf):
    m = base.mentions(spark, sf)
    return W.coreference_lines(base.tokens(spark, sf), m, chain_table(spark, sf)).select("doc_id", "tok_idx", "line")


def task_lines(spark, sf):
    m = base.mentions(spark, sf).where("type <> 'CTX'")
    return W.task_lines(m, base.tokens(spark, sf), {"CAP": "org", "NUM": "num", "MAIL": "loc"})


def segmented_text(spark, sf):
    return W.segmented_text(base.tokens(spark, sf), sentence_lines=True)


def predicted_entities(spark, sf):
    return pipeline.predict(base.documents(spark, sf))["entities"]


def pipeline_collapse(spark, sf):
    run = pipeline.from_properties({"ner": {"rules": {}}, "ne_collapser": {"types": {"types": ["CTX", "NUM"]}}})
    made = run({"tokens": base.tokens(spark, sf).withColumn("size", F.length("token"))})["tokens"]
    return made.select("doc_id", "tok_idx", "sent_idx", "token", "size")


def predicted_relations(spark, sf):
    """Relations that a rule finds between mentions of one type that lie near each other in a sentence, from raw texts."""
    alike = lambda pairs: pairs.withColumn("label", F.when(F.col("e1.type") == F.col("e2.type"), "LIKE"))
    return pipeline.predict(base.documents(spark, sf), relate=alike, near=5)["relations"]


def quality_classifier(spark, sf):
    """A linear model of ``labels.quality`` on a few features of the texts, fitted on four fifths of the labelled rows; its accuracy on the rest."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = docs.select("doc_id", F.col("quality").cast("string").alias("quality"), "lang", (F.length("text") / 1000).alias("n"), (F.length(F.regexp_replace("text", "[^|*%$&#]", "")) / F.length("text")).alias("marks"))
    model = ML.trainer(["lang", "n", "marks"], "quality").fit(made.where(~rest))
    return ML.predict(model, made.where(rest)).agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("prediction_label")).cast("double")).alias("accuracy"))


QUERIES = {f.__name__: f for f in (pooled_vectors, masked_losses, sentence_samples, coreference_lines, task_lines, segmented_text, predicted_entities, predicted_relations, pipeline_collapse, quality_classifier)}

ORACLES = {
    "pooled_vectors": "WITH v AS (SELECT vec_id % 50 AS g, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT g, i, round(max(round(x::DOUBLE, 4)), 6) AS top, round(avg(round(x::DOUBLE, 4)), 6) AS mean FROM v GROUP BY ALL",
    "masked_losses": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, CAST(vec_id % 3 AS INTEGER) AS y FROM embeddings),
    w AS (SELECT *, list_max(list_transform(range(len(x)), lambda i: CASE WHEN i = y THEN -1e300 ELSE x[i + 1] END)) AS wrong FROM v)
    SELECT vec_id, round(-ln(exp(x[y + 1]) / list_sum(list_transform(x[1:len(x) - 1], lambda e: exp(e)))), 6) AS softmax,
    round(list_sum(list_transform(range(len(x)), lambda k: greatest(x[k + 1], 0) - x[k + 1] * ((vec_id + k) % 2) + ln(1 + exp(-abs(x[k + 1]))))) / len(x), 6) AS sigmoid,
    round(ln(1 + exp(2 * (2.5 - x[y + 1]))) + ln(1 + exp(2 * (0.5 + wrong))), 6) AS margin FROM w""",
    "sentence_samples": oracle("SELECT doc_id, sent_idx, CAST(count(*) AS INTEGER) AS seq_len, string_agg(length(token), ',' ORDER BY tok_idx) AS len FROM tok GROUP BY ALL"),
    "coreference_lines": oracle(
        CHAINED
        + """, mk AS (SELECT doc_id, start_token AS tok_idx, 1 AS kind, chain_id, ord, '(' || chain_id || ')' AS mark FROM chn WHERE end_token - start_token = 1
          UNION ALL SELECT doc_id, end_token - 1, 0, chain_id, ord, chain_id || ')' FROM chn WHERE end_token - start_token > 1 UNION ALL SELECT doc_id, start_token, 2, chain_id, ord, '(' || chain_id FROM chn WHERE end_token - start_token > 1),
        ag AS (SELECT doc_id, tok_idx, string_agg(mark, '' ORDER BY kind, chain_id, ord) AS marks FROM mk GROUP BY ALL),
        pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) - 1 AS place FROM tok)
        SELECT pl.doc_id, pl.tok_idx, concat_ws(chr(9), pl.doc_id, pl.tok_idx, place, token, coalesce(marks, '_')) AS line FROM pl LEFT JOIN ag ON ag.doc_id = pl.doc_id AND ag.tok_idx = pl.tok_idx""",
        MENTIONS,
    ),
    "task_lines": oracle("SELECT m.doc_id, m.ord AS n, (CASE type WHEN 'CAP' THEN 'org' WHEN 'NUM' THEN 'num' ELSE 'loc' END) || ' ' || a.char_start || ' ' || (b.char_end - a.char_start) AS line FROM ment m JOIN tok a ON a.doc_id = m.doc_id AND a.tok_idx = start_token JOIN tok b ON b.doc_id = m.doc_id AND b.tok_idx = end_token - 1 WHERE type <> 'CTX'", MENTIONS),
    "segmented_text": oracle("ss AS (SELECT doc_id, sent_idx, string_agg(token, ' ' ORDER BY tok_idx) AS s FROM tok GROUP BY ALL) SELECT doc_id, string_agg(s, chr(10) ORDER BY sent_idx) AS text FROM ss GROUP BY doc_id"),
    "predicted_entities": oracle("SELECT m.doc_id, m.ent_id AS id, a.char_start AS start, b.char_end AS \"end\", type FROM ment m JOIN tok a ON a.doc_id = m.doc_id AND a.tok_idx = start_token JOIN tok b ON b.doc_id = m.doc_id AND b.tok_idx = end_token - 1", MENTIONS),
    "pipeline_collapse": oracle(MAPPED + " SELECT mp.doc_id, new_idx AS tok_idx, tok.sent_idx, CASE WHEN kind IS NULL THEN tok.token ELSE '$' || kind || '$' END AS token, CASE WHEN kind IS NULL THEN length(tok.token) ELSE 0 END::INTEGER AS size FROM mp JOIN tok ON tok.doc_id = mp.doc_id AND tok.tok_idx = mp.tok_idx WHERE stays", MENTIONS),
    "predicted_relations": oracle("SELECT a.doc_id, a.ent_id AS first, b.ent_id AS second, 'LIKE' AS type FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.ord <> b.ord AND a.type = b.type AND greatest(0, greatest(a.start_token, b.start_token) - least(a.end_token, b.end_token) + 1) <= 5", MENTIONS),
}
