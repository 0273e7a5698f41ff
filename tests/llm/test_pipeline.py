import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, mixing, queries


def test_stages_on_odd_rows(spark, messy, nothing, clashing, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0, name
        made = stage(spark, clashing, small)
        assert made.count() > 0, name
        if name != "token-ID output":
            assert made.columns == clashing.columns and made.schema.simpleString() == clashing.schema.simpleString(), name


def test_stages_leave_columns_of_their_own_names_alone(spark, messy, small):
    mine = {c: F.concat(F.lit(f"mine {c} "), F.coalesce("doc_id", F.lit(-1))) for c in ("copy", "shuffle_key", "lang_pred", "lang_score", "_gone_id", "row", "node", "kept")}
    docs = messy.withColumns(mine)
    before = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = [tuple(r) for r in stage(spark, docs, small).collect()]
        assert after and set(after) <= before, name


def test_language_stage_keeps_letters_alone(spark, messy, corpus, small):
    kept = corpus_pipeline.identify_language(spark, messy, small).collect()
    assert {r.doc_id for r in kept}.isdisjoint({7, 8, 9, 12}) and {0, 1, 2, 3, 13} <= {r.doc_id for r in kept}


def test_leaks_and_copies_go_and_clean_rows_stay(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    words = [f"w{i}" for i in range(60)]
    rows = [(1, f"some words before {item} and after"), (2, " ".join(words)), (2, "other"), (3, " ".join(words[:59])), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, small).collect()) == sorted((i, t or "") for i, t in rows[1:])
    assert sorted((r.doc_id, r.text or "") for r in corpus_pipeline.fold_near_duplicates(spark, docs, small).collect()) == sorted((i, t or "") for i, t in [*rows[:3], *rows[4:]])


def test_run_against_plain_stages(spark, small):
    from tests_plain import kept_of_groups, plain_leaks

    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    scored = langid.identify(spark.read.parquet(f"{small}/documents.parquet"), langid.learn_profiles(spark.read.parquet(f"{small}/documents.parquet").where(~langid.held_out())))
    assert scored.where("lang_score < 0.2 OR lang_pred = 'und'").count() == 0  # nothing clean goes
    kept = kept_of_groups({i: r.text for i, r in docs.items()})
    leaks = plain_leaks({i: docs[i].text for i in kept}, [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()], decontam.TOLERANCE)
    left = [docs[i] for i in sorted(kept - leaks)]
    mixed = mixing.mix(spark.createDataFrame(left, spark.read.parquet(f"{small}/documents.parquet").schema)).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, start = [], 0
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, small).orderBy("start").collect()] == expected and expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0




def test_language_stage_without_labels_keeps_all(spark, messy, corpus, nothing, small):
    bare = messy.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, bare, small).count() == len(corpus)
    assert corpus_pipeline.identify_language(spark, nothing, small).count() == 0
