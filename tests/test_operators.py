"""Segmentation, rewriting, chains, sampling, readers, writers, streaming and models on small vectors."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import chains as C
from spanloom.operators import encode as E
from spanloom.operators import mentions as M
from spanloom.operators import models as ML
from spanloom.operators import rewrite as R
from spanloom.operators import sampling as O
from spanloom.operators import segment as G
from spanloom.plans import pipeline
from spanloom.sources import readers, writers
from spanloom.streaming import incremental

MENTION = "doc_id long, ent_id string, start_token int, end_token int, type string, sent_idx int, ord int"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def tokens_of(spark, words):
    return spark.createDataFrame([(1, i, 0, w, 10 * i, 10 * i + len(w)) for i, w in enumerate(words)], "doc_id long, tok_idx int, sent_idx int, token string, char_start int, char_end int")


def test_tokens_of_odd_texts(spark):
    got = [tuple(r) for r in G.tokens(docs(spark, " a  bb\n\n  \nc", "", None)).orderBy("tok_idx").collect()]
    assert got == [(0, 0, 0, "a", 1, 2), (0, 1, 0, "bb", 4, 6), (0, 2, 1, "c", 11, 12)]


def test_token_rewriting(spark):
    joined = G.split_joined(tokens_of(spark, ["a-b/", "c", "--"]), "-/").orderBy("tok_idx").collect()
    assert [(r.token, r.char_start, r.char_end) for r in joined] == [("a", 0, 1), ("-", 1, 2), ("b", 2, 3), ("/", 3, 4), ("c", 10, 11), ("-", 20, 21), ("-", 21, 22)]
    assert [r.token for r in G.split_names(tokens_of(spark, ["E.coli", "E.co", "x"])).orderBy("tok_idx").collect()] == ["E.", "coli", "E.co", "x"]
    named = G.expand_names(tokens_of(spark, ["Escherichia", "coli", "and", "E.", "coli", "E.", "coli", "B.", "coli"]))
    assert [r.token for r in named.orderBy("tok_idx").collect()] == ["Escherichia", "coli", "and", "Escherichia", "coli", "Escherichia", "coli", "B.", "coli"]


def test_citations(spark):
    text = "See (Smith et al. 2001) and (Fig. 2) or (1, 2-3) and (12%) here (a)."
    cut = G.eliminate_citations(docs(spark, text, "plain"))
    row = cut.orderBy("doc_id").first()
    assert row.text == "See  and  or  and  here (a)."
    assert [text[c.start : c.end] for c in row.cuts] == ["(Smith et al. 2001)", "(Fig. 2)", "(1, 2-3)", "(12%)"]
    start, end = G.restore_offsets(F.col("char_start"), F.col("char_end"), F.col("cuts"))
    back = G.tokens(cut).join(cut.select("doc_id", "cuts"), "doc_id").where("doc_id = 0").select("token", start.alias("s"), end.alias("e")).collect()
    assert all(text[r.s : r.e] == r.token for r in back)


def test_sentence_ends(spark):
    rows = [(1, i, s, w) for i, (s, w) in enumerate([(0, "x"), (0, "sp"), (0, "."), (1, "y"), (1, "."), (2, "e.g"), (2, ".")])]
    got = G.fix_sentence_ends(spark.createDataFrame(rows, "doc_id long, tok_idx int, sent_idx int, token string")).orderBy("sent_idx").collect()
    assert [(r.start_token, r.end_token) for r in got] == [(0, 5), (5, 7)]


def test_adjust_and_merge(spark):
    sentences = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 8), (1, 2, 8, 12)], "doc_id long, sent_idx int, start_token int, end_token int")
    spans = spark.createDataFrame([(1, "T1", 1, 5, "A", 0, 0), (1, "T2", 2, 3, "A", 0, 1)], MENTION)
    assert [(r.start_token, r.end_token) for r in R.adjust_sentences(sentences, spans).orderBy("sent_idx").collect()] == [(0, 8), (8, 12)]
    nested = spark.createDataFrame([(1, "T1", 0, 2, "A", 0, 0), (1, "T2", 1, 4, "A", 0, 1), (1, "T3", 3, 5, "A", 0, 2), (1, "T4", 6, 7, "B", 0, 3)], MENTION)
    assert {r.ent_id: (r.new_id, r.start_token, r.end_token) for r in R.merge_intersecting(nested).collect()} == {"T1": ("T1", 0, 5), "T2": ("T1", 0, 5), "T3": ("T1", 0, 5), "T4": ("T4", 6, 7)}


def test_map_equals_one_by_one_shifts(spark):
    tokens = tokens_of(spark, [f"w{i}" for i in range(12)])
    spans = spark.createDataFrame([(1, "T1", 2, 5, "A", 0, 0), (1, "T2", 7, 9, "B", 0, 1)], MENTION)
    every = [(a, b) for a in range(12) for b in range(a + 1, 13)]
    probes = spark.createDataFrame([(1, f"{a}-{b}", a, b) for a, b in every], "doc_id long, ent_id string, start_token int, end_token int")
    got = {r.ent_id: (r.start_token, r.end_token) for r in R.remapped(probes, R.token_map(tokens, spans)).collect()}
    one = R.shift_after_collapse(F.col("start_token"), F.col("end_token"), F.lit(2), F.lit(5))
    two = R.shift_after_collapse(F.col("s.start_token"), F.col("s.end_token"), F.lit(5), F.lit(7))  # the second span after the first
    assert got == {r.ent_id: tuple(r.t) for r in probes.withColumn("s", one).withColumn("t", two).collect()}
    words = [r.token for r in R.collapse_tokens(tokens, R.token_map(tokens, spans)).orderBy("tok_idx").collect()]
    assert words == ["w0", "w1", "$A$", "w5", "w6", "$B$", "w9", "w10", "w11"]


def test_unquote(spark):
    tokens = tokens_of(spark, ['"', "a", "b", "»", "c"])
    spans = spark.createDataFrame([(1, "T1", 1, 3, "A", 0, 0), (1, "T2", 4, 5, "A", 0, 1)], MENTION)
    left, moved = R.unquote(tokens, spans, spans, ["A"])
    assert [(r.tok_idx, r.token) for r in left.orderBy("tok_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert {r.ent_id: (r.start_token, r.end_token) for r in moved.collect()} == {"T1": (0, 2), "T2": (2, 3)}
    assert R.unquote(tokens, spans, spans, ["A"], 0.0)[0].count() == 5


def test_align(spark):
    tokens = tokens_of(spark, ["abcd", "efgh", "ijkl"])
    raw = spark.createDataFrame([(1, "x", "T", 1, 13), (1, "y", "T", 5, 19), (1, "z", "T", 90, 95)], "doc_id long, id string, type string, start int, end int")
    assert {r.id: (r.start_token, r.end_token) for r in M.align_raw(raw, tokens).collect()} == {"x": (0, 2), "y": (1, 2), "z": (None, None)}


def test_chains(spark):
    m = spark.createDataFrame([(1, f"T{i}", i, i + 1, "A" if i % 2 else "B", 0, i) for i in range(6)], MENTION)
    links = spark.createDataFrame([(1, "T0", "T3"), (1, "T3", "T5"), (1, "T1", "T2")], "doc_id long, first string, second string")
    of_chain = C.chains(m, links)
    assert {r.ent_id: r.chain_id for r in of_chain.collect()} == {"T0": 0, "T3": 0, "T5": 0, "T1": 1, "T2": 1, "T4": 2}
    assert {(r.first, r.second) for r in C.chain_relations(m, of_chain, every=True).collect()} == {("T0", "T3"), ("T0", "T5"), ("T3", "T5"), ("T1", "T2")}
    assert {r.ent_id: r.type for r in C.majority_types(m, of_chain).collect()} == {"T0": "A", "T3": "A", "T5": "A", "T1": "A", "T2": "A", "T4": "B"}
    pairs = spark.createDataFrame([(1, "a", "b", 0.9, "C"), (1, "b", "c", 0.8, None), (1, "a", "c", 0.7, "C"), (1, "c", "d", 0.6, "C"), (1, "b", "d", 0.5, "C")], "doc_id long, e1 string, e2 string, score double, label string")
    got = {r.ent_id: r.chain_id for r in C.easy_first(pairs).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]
    assert {(r.mention, r.candidate) for r in C.rank(pairs).collect()} == {("b", "a"), ("c", "a"), ("d", "c")}


def test_dictionary_order(spark):
    values = spark.createDataFrame([(v,) for v in (10, 2, -1, 0, 1, -2, None)], "v int")
    got = {r.value: r.code for r in E.dictionary(values, padding=True, oov=True).collect()}
    assert got == {"$PADDING$": 0, "-1": 1, "-2": 2, "0": 3, "1": 4, "10": 5, "2": 6, "None": 7, "$OOV$": 8}
    flags = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert {r.value: r.code for r in E.dictionary(flags, padding=False).collect()} == {"False": 0, "True": 1}
    with pytest.raises(Exception, match="dictionary"):
        E.encode(values, "v", E.dictionary(flags), "code").collect()


def test_sampling(spark):
    sizes = [r["count"] for r in O.folds(spark.range(8).withColumnRenamed("id", "i"), 3, ["i"]).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 2]
    assert O.grid({"b": [2, 1], "a": {"x": [0], "w": ["q"]}}) == [{"a": {"w": "q", "x": 0}, "b": 1}, {"a": {"w": "q", "x": 0}, "b": 2}]
    epochs = spark.createDataFrame(list(enumerate([True, False, False, True, False, False, False])), "epoch int, improved boolean")
    assert [r.stopped for r in O.stopped(epochs, 3).orderBy("epoch").collect()] == [False] * 6 + [True]


def write_files(folder, **texts):
    for name, text in texts.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def test_standoff(spark, tmp_path):
    path = write_files(tmp_path, a__txt="Aa bb cc dd", a__ann="T1\tX 0 2;6 8\tAa cc\nT2\tY 3 5\tbb\nT3\tY 9 11\tdd\nR1\tRel Arg1:T1 Arg2:T2\n*\tEquiv T2 T3\n", b__txt="none")
    got = readers.brat(spark, path)
    assert {(r.id, r.start, r.end) for r in got["entities"].collect()} == {("T1", 0, 8), ("T2", 3, 5), ("T3", 9, 11)}
    assert {(r.first, r.second) for r in got["relations"].collect()} == {("T1", "T2"), ("T1", "T3")}
    assert [r.name for r in got["documents"].collect()] == ["a"] and [r.name for r in got["skipped"].collect()] == ["b"]
    path = write_files(tmp_path, c__txt="x y", c__a1="T1\tTitle 0 1\tx\nT2\tG 2 3\ty\n", c__a2="R1\tIs_Linked_To A:T1 B:T2\n")
    more = readers.bionlp(spark, path)
    assert more["paragraphs"].count() == 1 and more["relations"].count() == 2 and [r.id for r in more["entities"].collect()] == ["T2"]


def test_tabular_readers(spark, tmp_path):
    path = write_files(tmp_path, p_abstracts__tsv="1\tA title\tThe body\n", p_entities__tsv="1\tT1\tGENE-N\t0\t1\tA\n1\tT2\tCHEM\t2\t7\ttitle\n", p_relations__tsv="1\tCPR:3\tY \tACT\tArg1:T1\tArg2:T2\n1\tCPR:4\tN \tINH\tArg1:T1\tArg2:T2\n")
    got = readers.chemprot(spark, path, "p")
    assert got["documents"].first().text == "A title\tThe body" and [(r.start, r.end) for r in got["paragraphs"].orderBy("start").collect()] == [(0, 7), (8, 16)]
    assert {r.type for r in got["entities"].collect()} == {"GENE", "CHEM"} and [(r.first, r.second, r.rel_type) for r in got["relations"].collect()] == [("T1", "T2", "ACT")]
    f = write_files(tmp_path, d__tokens="10 0 2 Aa\n11 3 2 bb\n\n12 6 2 cc\n\n", d__spans="1 n 0 2 10 2 # x\n2 n 6 2 12 1\n", d__objects="7 LocOrg 1 2 # y\n8 Project 1\n")
    ev = readers.factrueval(spark, f, keep_locorg=False)
    assert [(r.token, r.sent_idx, r.char_end) for r in ev["tokens"].orderBy("tok_idx").collect()] == [("Aa", 0, 2), ("bb", 0, 5), ("cc", 1, 8)]
    assert [(r.ent_id, r.type, r.start_token, r.end_token) for r in ev["mentions"].collect()] == [("7", "Location", 0, 3)]
    c = write_files(tmp_path, e__conll="-DOCSTART- -X- O O\n\nEU NNP I-NP I-ORG\nsays VB O O\n\nUN NNP I-NP I-ORG\n\n-DOCSTART- -X- O O\n\nx y z O\n")
    con = readers.conll(spark, c + "/e.conll")
    assert [tuple(r) for r in con["tokens"].select("name", "tok_idx", "sent_idx", "token").orderBy("name", "tok_idx").collect()] == [("e_0", 0, 0, "EU"), ("e_0", 1, 0, "says"), ("e_0", 2, 1, "UN"), ("e_1", 0, 0, "x")]
    assert con["mentions"].count() == 2
    u = write_files(tmp_path, f__conllu="# c\n1\tA\ta\tN\t_\tCase=Nom|Num=S\t2\tsubj\t_\t_\n2\tb\tb\tV\t_\t_\t0\troot\t_\t_\n\n1\tc\tc\tX\t_\t_\t0\troot\t_\t_\n")
    rows = readers.conllu(spark, u + "/f.conllu").orderBy("name", "tok_idx").collect()
    assert [(r.name, r.token, r.head_dist, r.feats) for r in rows] == [("f_0", "A", 1, {"Case": "Nom", "Num": "S"}), ("f_0", "b", 0, {}), ("f_1", "c", 0, {})]


def test_folders_of_corpora_are_read_file_by_file(spark, tmp_path):
    one = "-DOCSTART- -X- O O\n\na A x B-X\nb A x I-X\n\nc A x O\n"
    path = write_files(tmp_path, one__conll=one, two__conll=one.replace("a A", "z A") + "\n-DOCSTART- -X- O O\n\ny A x I-Y\n")
    got = readers.conll(spark, path)
    assert [tuple(r) for r in got["tokens"].select("name", "tok_idx", "sent_idx", "token").orderBy("name", "tok_idx").collect()] == [("one_0", 0, 0, "a"), ("one_0", 1, 0, "b"), ("one_0", 2, 1, "c"), ("two_0", 0, 0, "z"), ("two_0", 1, 0, "b"), ("two_0", 2, 1, "c"), ("two_1", 0, 0, "y")]
    assert sorted((r.start_token, r.end_token, r.type) for r in got["mentions"].collect()) == [(0, 1, "Y"), (0, 2, "X"), (0, 2, "X")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "w.txt").write_text("3 1\na 1\nb 2\na 3\nc 4\n")
    assert {r.token: r.vector for r in readers.vectors(spark, str(tmp_path / "v" / "w.txt"), True).collect()} == {"a": [1.0], "b": [2.0]}


def test_overlapping_mentions_of_a_corpus_become_one(spark, tmp_path):
    f = write_files(tmp_path, d__tokens="10 0 2 Aa\n11 3 2 bb\n12 6 2 cc\n\n", d__spans="1 n 0 2 10 2\n2 n 6 2 11 2\n3 n 0 2 10 3\n", d__objects="7 Org 1\n8 Org 2\n9 Org 3\n")
    kept = readers.factrueval(spark, f, collapse=False)["mentions"]
    assert sorted((r.ent_id, r.start_token, r.end_token) for r in kept.collect()) == [("7", 0, 2), ("8", 1, 3), ("9", 0, 3)]
    assert [(r.ent_id, r.type, r.start_token, r.end_token) for r in readers.factrueval(spark, f)["mentions"].collect()] == [("7", "Org", 0, 3)]


def test_coreference_corpus(spark, tmp_path):
    tokens = ["1\t0\t2\tHe\the\tP", "1\t3\t2\tand\tand\tC", "1\t7\t1\t.\t.\tSENT", "1\t9\t3\tMan\tman\tN", "1\t13\t1\t.\t.\tSENT"]
    groups = ["1\t1\t10\t5\t0\t0\t0\t0\t0\tstr:refl|x:y", "1\t1\t11\t5\t10\t0\t0\t0\t9\t", "1\t1\t12\t6\t0\t0\t0\t0\t3,7,9\tstr:appo", "1\t1\t13\t5\t0\t0\t0\t0\t13\tstr:coll"]
    path = write_files(tmp_path, Tokens__txt="\n".join(["doc_id\tshift\tlength\ttoken\tlemma\tgram", *tokens]) + "\n", Groups__txt="\n".join(["doc_id\tvariant\tgroup_id\tchain_id\tlink\tshift\tlength\tcontent\ttk_shifts\tattributes", *groups]) + "\n")
    got = readers.rucor(spark, path)
    assert sorted((r.ent_id, r.type, r.start_token, r.end_token) for r in got["mentions"].collect()) == [("10", "pron", 0, 1), ("11", "noun", 3, 4), ("12", "noun", 1, 4), ("13", "coll", 4, 5)]
    assert [(r.start_token, r.end_token) for r in got["sentences"].collect()] == [(0, 5)]  # a mention reaches over the first end
    assert sorted((r.first, r.second) for r in got["relations"].collect()) == [("10", "11"), ("10", "13"), ("11", "13")]
    heads = spark.createDataFrame([(r.doc_id, r.tok_idx, 0, "PRON" if r.token == "Man" else "NOUN") for r in got["tokens"].collect()], "doc_id long, tok_idx int, head_dist int, pos string")
    assert {r.ent_id: r.type for r in readers.retyped_by_head(got["mentions"], heads).collect()} == {"10": "noun", "11": "pron", "12": "noun", "13": "noun"}
    (tmp_path / "TokensSpeech.txt").write_text("doc_id\tshift\tlength\ttoken\tspeech\tsaid\tauthor_comment\tspeech_verb\n1\t0\t2\tHe\tS\tO\tO\tO\n1\t9\t3\tMan\tO\tO\tO\tV\n")
    marked = readers.rucor(spark, path)["tokens"].orderBy("tok_idx").collect()
    assert [(r.token, r.speech, r.speech_verb, r.tok_idx) for r in marked] == [("He", "S", "O", 0), ("Man", "O", "V", 1)]


def test_vectors_and_lists(spark, tmp_path):
    path = write_files(tmp_path, w2v__txt="2 2\na 1 2\na 3 4\nb 5 6\n", glove__txt="a 1 2\nb 3 4\n", g__txt=" x \ny\nx\n")
    assert {r.token: r.vector for r in readers.vectors(spark, path + "/w2v.txt", True).collect()} == {"a": [1.0, 2.0]}
    assert {r.token: r.vector for r in readers.vectors(spark, path + "/glove.txt", False).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    assert {r.term for r in readers.gazetteer(spark, path + "/g.txt").collect()} == {"x", "y"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "d.json").write_text(json.dumps({"tokens": ["a", "b"], "sentences": [[0, 2]], "entities": [["T1", 0, 1, "X"]], "relations": [["T1", "T1", "R"]]}))
    got = readers.json_documents(spark, str(tmp_path / "j"))
    assert got["tokens"].count() == 2 and tuple(got["mentions"].first())[1:] == ("T1", 0, 1, "X") and got["relations"].first().rel_type == "R"
    (tmp_path / "x.nxml").write_text("<a><abstract abstract-type='s'><p>no</p></abstract><abstract><sec><title>Funding</title><p>bad</p></sec><sec><title>Aim</title><p>One <inline-formula>f</inline-formula>two</p></sec><p>end</p></abstract></a>")
    assert readers.abstracts(spark, str(tmp_path), ["funding"], []).first().text == "One two\n\nend"


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([(1, "T1", 0, 2, "Bacteria", 0, 0), (1, "T2", 2, 3, "Tissue", 0, 1)], MENTION)
    relations = m.where("ent_id = 'T1'").select("doc_id", M.as_struct().alias("e1")).join(m.where("ent_id = 'T2'").select("doc_id", M.as_struct().alias("e2")), "doc_id").withColumn("rel_type", F.lit("Lives_In"))
    lines = writers.submission_lines(relations)
    assert lines.first().line == "R1\tLives_In Bacteria:T1 Location:T2"
    writers.by_document(lines.withColumn("name", F.lit("d")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == lines.first().line
    chains = spark.createDataFrame([(1, "T1", 0), (1, "T2", 1)], "doc_id long, ent_id string, chain_id int")
    got = writers.coreference_lines(tokens_of(spark, ["a", "b", "c", "d"]), m, chains).orderBy("tok_idx").collect()
    assert [r.line.split("\t")[-1] for r in got] == ["(0", "0)", "(1)", "_"]


def test_incremental(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    work = lambda df: df.withColumn("n", F.length("text"))
    for rows in ([(1, "a"), (2, "bb"), (2, "bb")], [(2, "bb"), (3, "ccc")], []):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(source)
        incremental.process_new(spark, source, target, mark, "id long, text string", work)
    assert sorted((r.id, r.n) for r in incremental.written(spark, target).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_models(spark):
    emissions, transitions = np.array([[1.0, 0.0], [0.0, 0.4], [1.0, 0.0]]), np.array([[0.5, -1.0], [-1.0, 0.5]])
    assert ML.viterbi(emissions, transitions) == [0, 0, 0]
    states = np.arange(8.0).reshape(2, 4)
    frame = spark.createDataFrame([(states.tolist(), [1.0] * 4)], "states array<array<double>>, query array<double>")
    pooled = frame.select(ML.attend(F.col("states"), F.col("query"), {"score": [[0.0] * 4] * 4}).alias("p")).first().p
    assert np.allclose(pooled, states.mean(0))
    assert ML.schedule({"a": 2, "b": 1}) == ["a", "b", "a"] and ML.learning_rate(1.0, 0.5, 3) == 0.5
    train = spark.createDataFrame([("x", 0.1, "p"), ("y", 0.2, "q")] * 10, "w string, v double, label string")
    assert ML.predict(ML.trainer(["w", "v"], "label").fit(train), train).where("label <> prediction_label").count() == 0


def test_prediction_is_the_same_one_by_one(spark, small):
    some = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 4").cache()
    whole = sorted(tuple(r) for r in pipeline.predict(some)["entities"].collect())
    single = sorted(tuple(r) for i in range(4) for r in pipeline.predict(some.where(F.col("doc_id") == i))["entities"].collect())
    assert whole == single and whole


def test_properties():
    with pytest.raises(ValueError):
        pipeline.from_properties({"ner": {}})
    with pytest.raises(KeyError):
        pipeline.from_properties({"nothing": {}})
    with pytest.raises(ValueError):
        M.merge_pattern({"A": ["x"], "B": ["x"]})
