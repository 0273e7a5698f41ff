"""Chains of mentions: components of relations, and ways to choose links from scored pairs.

Scored pairs are (doc_id, e1, e2, score, label): mention ids, the best score and the label that has it, null
for no relation. Everything of one document is small, so a document's chains are built in one group; documents
are the parallel unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions import text as T
from spanloom.operators.asof import with_counts
from spanloom.operators.grouped import dealt, gathered, joined, whole_documents
from spanloom.operators.mentions import as_struct


def components(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that links lead to, for each node; whole arrays at a time, in rounds that halve what is left."""
    least = np.arange(nodes)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while not np.array_equal(least, shorter := least[least]):
            least = shorter
        if np.array_equal(before, least):
            return least


def chains(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, ent_id, chain_id): components of relations (doc_id, first, second); mentions alone are chains too.

    Chains are numbered by their first mention in ``ord``. Documents are dealt whole, and each batch's are worked on
    together; relations that name an unknown mention are passed over.
    """
    members = mentions.select("doc_id", "ord", "ent_id", F.lit(None).cast("string").alias("other"))
    links = relations.select("doc_id", F.lit(None).cast("int").alias("ord"), F.col("first").alias("ent_id"), F.col("second").alias("other"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches):
            frame = table.to_pandas()
            known = frame["other"].isna()
            own = frame[known].sort_values(["doc_id", "ord"])
            places = pd.Series(np.arange(len(own)), pd.MultiIndex.from_frame(own[["doc_id", "ent_id"]]))
            places = places[~places.index.duplicated()]
            edges = frame[~known]
            a, b = (places.reindex(pd.MultiIndex.from_arrays([edges["doc_id"], edges[c]])).to_numpy(float) for c in ("ent_id", "other"))
            real = ~(np.isnan(a) | np.isnan(b))
            heads = components(len(own), a[real].astype(np.int64), b[real].astype(np.int64))
            docs = own["doc_id"].to_numpy()
            first = heads == np.arange(len(own))
            number = np.cumsum(first) - 1
            begins = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])[: len(docs)])
            base = np.repeat(number[begins], np.diff(np.append(begins, len(docs)))) if len(docs) else number
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(own["ent_id"], pa.string()), pa.array((number[heads] - base).astype(np.int32))], ["doc_id", "ent_id", "chain_id"])

    both = dealt(members.unionByName(links), "doc_id").sortWithinPartitions("doc_id")
    return both.mapInArrow(build, "doc_id long, ent_id string, chain_id int")


def chain_relations(mentions: DataFrame, of_chain: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, first, second): neighbours in a chain, or with ``every`` all i < j of it."""
    m = joined(mentions, of_chain, ["doc_id", "ent_id"]).select("doc_id", "chain_id", "ord", "ent_id")
    if not every:
        m = gathered(m, "doc_id", "chain_id")
        following = F.lead("ent_id").over(Window.partitionBy("doc_id", "chain_id").orderBy("ord"))
        return m.select("doc_id", F.col("ent_id").alias("first"), following.alias("second")).where("second IS NOT NULL")
    other = m.select("doc_id", "chain_id", F.col("ord").alias("o2"), F.col("ent_id").alias("second"))
    return m.join(other, ["doc_id", "chain_id"]).where("ord < o2").select("doc_id", F.col("ent_id").alias("first"), "second")


def _merged(nodes: int, a: np.ndarray, b: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A node's cluster after pairs were taken one by one in order: positive ones merge clusters, others keep them apart.

    A pair that is the first left for both of its clusters can be taken at once, since no earlier one can change either; all
    such pairs are taken together, in rounds.
    """
    root, apart = np.arange(nodes), np.zeros(0, np.int64)
    rank = np.arange(len(a))
    while rank.size:
        low, high = np.minimum(root[a[rank]], root[b[rank]]), np.maximum(root[a[rank]], root[b[rank]])
        keep = (low != high) & ~np.isin(low * nodes + high, apart)
        rank, low, high = rank[keep], low[keep], high[keep]
        first = np.full(nodes, len(a))
        np.minimum.at(first, low, rank)
        np.minimum.at(first, high, rank)
        now = (first[low] == rank) & (first[high] == rank)
        yes = now & positive[rank]
        apart = np.concatenate([apart, (low * nodes + high)[now & ~yes]])
        into = np.arange(nodes)
        into[high[yes]] = low[yes]
        root = into[root]
        x, y = into[apart // nodes], into[apart % nodes]
        apart = np.unique(np.minimum(x, y) * nodes + np.maximum(x, y))
        rank = rank[~now]
    return root


def easy_first(pairs: DataFrame) -> DataFrame:
    """(doc_id, ent_id, chain_id) by merging pairs of falling score; ties by (e1, e2).

    A pair whose label is null keeps its two clusters apart from then on; a merged cluster inherits what either
    was kept apart from. Chains are numbered by their first mention in order of ids. The engine puts each document's pairs
    in order; whole batches of documents are then worked on together.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches):
            table = table.combine_chunks()
            docs, doc = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
            names = pa.chunked_array([*table["e1"].chunks, *table["e2"].chunks]).combine_chunks()
            order = pc.rank(names, tiebreaker="dense").to_numpy().astype(np.int64)  # names by their order
            keys, at = np.unique(np.concatenate([doc, doc]) * (len(order) + 2) + order, return_inverse=True)
            place = np.zeros(len(keys), np.int64)
            place[at] = np.arange(len(at))
            n = len(doc)
            root = _merged(len(keys), at[:n], at[n:], table["label"].is_valid().to_numpy())
            of = keys // (len(order) + 2)
            heads, first = np.unique(root, return_index=True)  # a cluster's first mention in order
            number = np.empty(len(heads), np.int64)
            number[np.argsort(first, kind="stable")] = np.arange(len(heads))
            begins = np.searchsorted(of[np.sort(first)], np.arange(len(docs)))
            chain = number[np.searchsorted(heads, root)] - begins[of]
            yield pa.RecordBatch.from_arrays([pa.array(docs[of], pa.int64()), names.take(pa.array(place)).cast(pa.string()), pa.array(chain.astype(np.int32))], ["doc_id", "ent_id", "chain_id"])

    ordered = pairs.select("doc_id", "e1", "e2", "score", "label")
    ordered = dealt(ordered, "doc_id").sortWithinPartitions("doc_id", F.desc("score"), "e1", "e2")
    return ordered.select("doc_id", "e1", "e2", "label").mapInArrow(build, "doc_id long, ent_id string, chain_id int")


def rank(pairs: DataFrame) -> DataFrame:
    """(doc_id, mention, candidate, label): for each second mention the first one of highest score, if labelled and above 0."""
    order = Window.partitionBy("doc_id", "e2").orderBy(F.desc("score"), "e1")
    best = pairs.where("label IS NOT NULL AND score > 0").withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("doc_id", F.col("e2").alias("mention"), F.col("e1").alias("candidate"), "label")


def pronoun_rank(pairs: DataFrame, mentions: DataFrame, pronoun: str = "pron") -> DataFrame:
    """``rank`` for pronouns alone."""
    ids = mentions.where(F.col("type") == pronoun).select("doc_id", F.col("ent_id").alias("e2"))
    return rank(pairs.join(ids, ["doc_id", "e2"], "left_semi"))


def pronoun_votes(scores: DataFrame, mentions: DataFrame, of_chain: DataFrame, pronoun: str = "pron") -> DataFrame:
    """(doc_id, candidate, mention): each pronoun with the nearest member of the chain of highest mean score.

    ``scores`` are (doc_id, e1, e2, coref) in either direction. A chain without a score counts 0; ties go to the
    chain that comes first. Only scored pairs vote; a pronoun without a score above 0 takes the first chain of those that
    have none, if that is better. The nearest member is looked up in the one chain that won, by places in its order.
    """
    both = scores.unionByName(scores.select("doc_id", F.col("e2").alias("e1"), F.col("e1").alias("e2"), "coref"))
    both = both.withColumnsRenamed({"e1": "noun_id", "e2": "pron_id"})
    prons = mentions.where(F.col("type") == pronoun).select("doc_id", F.col("ent_id").alias("pron_id"), as_struct().alias("p"))
    prons = joined(prons, both.select("doc_id", "pron_id"), ["doc_id", "pron_id"], "left_semi")
    nouns = joined(mentions.where(F.col("type") != pronoun), of_chain, ["doc_id", "ent_id"]).select("doc_id", "chain_id", as_struct().alias("n"))
    ranks = gathered(nouns.select("doc_id", "chain_id"), "doc_id").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("chain_id")) - 1)
    of_noun = joined(nouns.select("doc_id", F.col("n.ent_id").alias("noun_id"), "chain_id"), ranks, ["doc_id", "chain_id"])
    voted = joined(joined(both, of_noun, ["doc_id", "noun_id"]), prons.select("doc_id", "pron_id"), ["doc_id", "pron_id"])
    voted = voted.groupBy("doc_id", "pron_id", "chain_id", "nth").agg(F.coalesce(F.avg("coref"), F.lit(0.0)).alias("vote"))
    # The first chain without a vote is where the chains with one, in order, leave their first gap.
    place = F.row_number().over(Window.partitionBy("doc_id", "pron_id").orderBy("nth")) - 1
    best = voted.withColumn("run", (F.col("nth") == place).cast("int")).groupBy("doc_id", "pron_id").agg(F.max(F.struct("vote", (-F.col("nth")).alias("back"))).alias("b"), F.sum("run").alias("gap"))
    every = joined(prons, best, ["doc_id", "pron_id"], "left").withColumn("gap", F.coalesce("gap", F.lit(0)))
    silent = ranks.select("doc_id", F.col("nth").alias("gap"), F.col("nth").alias("free"))
    every = joined(every, silent, ["doc_id", "gap"], "left")
    none = F.col("b").isNull() | ((F.col("free").isNotNull()) & ((F.col("b.vote") < 0) | ((F.col("b.vote") == 0) & (F.col("free") < -F.col("b.back")))))
    won = joined(every.withColumn("nth", F.when(none, F.col("free")).otherwise(-F.col("b.back"))), ranks, ["doc_id", "nth"]).select("doc_id", "chain_id", "p")
    return nearest_members(won, nouns).select("doc_id", F.col("n.ent_id").alias("candidate"), F.col("p.ent_id").alias("mention"))


def nearest_members(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (doc_id, chain_id, p) with ``n``, the member of the chain (doc_id, chain_id, n) nearest to ``p`` by tokens, the first of equals.

    Three places in the order of a chain can hold it: the first member that ends behind p's begin, if it begins no later than p
    does, else the first of those with the greatest end, or the first that begins later.
    """
    keys = ["doc_id", "chain_id"]
    order = Window.partitionBy(*keys).orderBy("n.ord")
    lined = gathered(members, *keys).withColumn("reach", F.max("n.end_token").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.withColumns({"at": F.row_number().over(order) - 1, "rises": F.coalesce(F.col("reach") > F.lag("reach").over(order), F.lit(True))})
    lined = lined.withColumn("top", F.max(F.when(F.col("rises"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    code = lambda: F.struct(*keys)
    requests = asked.withColumn("doc", code())
    timed = lined.withColumn("doc", code())
    counted = with_counts(requests.withColumnRenamed("doc_id", "own").withColumnRenamed("doc", "doc_id"), F.col("p.start_token"), timed.select(F.col("doc").alias("doc_id"), F.col("n.start_token").alias("pos")), "begun", inclusive=True)
    counted = with_counts(counted, F.col("p.start_token"), timed.select(F.col("doc").alias("doc_id"), F.col("reach").alias("pos")), "over", inclusive=True)
    counted = counted.withColumns({"begun": F.coalesce("begun", F.lit(0)), "over": F.coalesce("over", F.lit(0))})
    # The members at these places; ``top`` leads on from the last that has begun to the first with the same reach.
    tops = lined.select(*keys, (F.col("at") + 1).alias("begun"), F.col("top"))
    placed = joined(counted.drop("doc_id").withColumnRenamed("own", "doc_id"), tops, [*keys, "begun"], "left")
    spots = F.array(F.when(F.col("over") < F.col("begun"), F.col("over")), F.col("top"), F.col("begun"))
    tried = joined(placed.select(*keys, "p", F.explode(F.array_distinct(F.array_compact(spots))).alias("at")), lined.select(*keys, "at", "n"), [*keys, "at"])
    near = F.struct(S.token_distance(F.col("n"), F.col("p")), F.col("n.ord"))
    return gathered(tried, *keys).groupBy(*keys, "p").agg(F.min_by("n", near).alias("n"))


def words_of(mentions: DataFrame, tokens: DataFrame, lemma: str = "token") -> DataFrame:
    """Mentions with ``words``: their tokens and lemmas in order."""
    covered = mentions.withColumn("tok_idx", F.explode(F.sequence("start_token", F.col("end_token") - 1)))
    rows = covered.join(tokens.select("doc_id", "tok_idx", "token", F.col(lemma).alias("lemma")), ["doc_id", "tok_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("tok_idx", "token", "lemma")))
    return rows.groupBy("doc_id", "ent_id").agg(F.transform(ordered, lambda x: F.struct(x["token"].alias("token"), x["lemma"].alias("lemma"))).alias("words")).join(mentions, ["doc_id", "ent_id"])


def _keys(word: Column) -> Column:
    """What words that are equal or whose lemmas are one edit apart have in common: the token, or the lemma with at most one character left out."""
    lemma = word["lemma"]
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(lemma), F.lit(1))), lambda i: F.concat(F.substring(lemma, F.lit(1), i - 1), F.substring(lemma, i + 1, F.length(lemma))))
    return F.array_union(F.array(F.xxhash64(F.lit("token"), word["token"]), F.xxhash64(lemma)), F.transform(less, lambda x: F.xxhash64(x)))


def _same(a: Column, b: Column) -> Column:
    return (a["token"] == b["token"]) | T.edits_within(a["lemma"], b["lemma"], 1)


def _folded(worded: DataFrame) -> DataFrame:
    """Each document's distinct lists of words, with their first mention and the place of the last."""
    return worded.groupBy("doc_id", "words").agg(F.min(F.struct("ord", "ent_id")).alias("head"), F.max("ord").alias("last")).select("doc_id", F.col("head.ent_id").alias("head"), F.col("head.ord").alias("first"), "last", "words")


def matching_lists(lists: DataFrame) -> DataFrame:
    """(doc_id, a, b, a_later, b_later): pairs of lists that match if a mention of ``a`` stands behind one of ``b``, or the other way round.

    Of two lists that match, each word of the shorter has a partner in the other, so only lists are compared where the longest
    word of one shares a key with some word of another that is no shorter.
    """
    probe = F.array_max(F.transform("words", lambda w: F.struct(F.length(w["lemma"]).alias("n"), w["token"].alias("token"), w["lemma"].alias("lemma"))))
    sized = lists.withColumns({"size": F.size("words"), "probe": probe})
    short = sized.select("doc_id", F.col("head").alias("x"), F.col("size").alias("nx"), F.explode(_keys(F.col("probe"))).alias("key"))
    long = sized.select("doc_id", F.col("head").alias("y"), F.col("size").alias("ny"), F.explode("words").alias("w")).select("doc_id", "y", "ny", F.explode(_keys(F.col("w"))).alias("key")).distinct()
    met = short.join(long, ["doc_id", "key"]).where("nx <= ny AND x <> y").select("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda k: lists.select("doc_id", F.col("head").alias(k), F.col("words").alias(f"w{k}"))
    pairs = met.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"])
    pairs = pairs.withColumns({"a_later": T.greedy_match(F.col("wa"), F.col("wb"), _same), "b_later": T.greedy_match(F.col("wb"), F.col("wa"), _same)})
    return pairs.where("a_later OR b_later").select("doc_id", "a", "b", "a_later", "b_later")


def similar_links(worded: DataFrame) -> DataFrame:
    """(doc_id, first, second): links that join all mentions whose words match, directly or through others.

    Mentions of equal words match and are folded first, so links are those between distinct lists of words, each stood for by
    its first mention, and from each later mention of a list to that one.
    """
    lists = _folded(worded)
    again = worded.join(lists.select("doc_id", "words", "head"), ["doc_id", "words"]).where("ent_id <> head").select("doc_id", F.col("ent_id").alias("first"), F.col("head").alias("second"))
    place = lambda k: lists.select("doc_id", F.col("head").alias(k), F.col("first").alias(f"{k}_first"), F.col("last").alias(f"{k}_last"))
    met = matching_lists(lists).join(place("a"), ["doc_id", "a"]).join(place("b"), ["doc_id", "b"])
    met = met.where("(a_later AND a_last > b_first) OR (b_later AND b_last > a_first)")
    return met.select("doc_id", F.col("a").alias("first"), F.col("b").alias("second")).unionByName(again)


def similar_pairs(worded: DataFrame) -> DataFrame:
    """(doc_id, first, second) of all mentions whose words match, the later one first: each word of the shorter one is another one of the longer's.

    Words match if they are equal or their lemmas are within one edit. Lists of words are matched once, and spelled out here
    for every mention of them, which may be many; ``similar_links`` has what chains need.
    """
    lists = _folded(worded)
    own = lists.select("doc_id", F.col("head").alias("a"), F.col("head").alias("b"), F.lit(True).alias("a_later"), F.lit(False).alias("b_later"))
    member = worded.join(lists.select("doc_id", "words", "head"), ["doc_id", "words"])
    side = lambda k: member.select("doc_id", F.col("head").alias(k), F.col("ord").alias(f"o{k}"), F.col("ent_id").alias(f"id{k}"))
    spelled = matching_lists(lists).unionByName(own).join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"])
    spelled = spelled.where("(a_later AND oa > ob) OR (b_later AND ob > oa)")
    later = F.col("oa") > F.col("ob")
    return spelled.select("doc_id", F.when(later, F.col("ida")).otherwise(F.col("idb")).alias("first"), F.when(later, F.col("idb")).otherwise(F.col("ida")).alias("second"))


def similar_chains(mentions: DataFrame, worded: DataFrame) -> DataFrame:
    """Chains of mentions whose words match, directly or through others."""
    return chains(mentions, similar_links(worded))


def majority_types(mentions: DataFrame, of_chain: DataFrame) -> DataFrame:
    """Mentions with the type that more than half of their chain has, else that of its first mention."""
    m = mentions.join(of_chain, ["doc_id", "ent_id"])
    counts = m.groupBy("doc_id", "chain_id", "type").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    voted = counts.groupBy("doc_id", "chain_id").agg(F.sum("n").alias("size"), F.max_by("type", "n").alias("most"), F.max("n").alias("n"), F.min_by("type", "o").alias("head"))
    chosen = voted.select("doc_id", "chain_id", F.when(F.col("n") > F.floor(F.col("size") / 2), F.col("most")).otherwise(F.col("head")).alias("new_type"))
    return m.join(chosen, ["doc_id", "chain_id"]).withColumn("type", F.col("new_type")).drop("new_type", "chain_id")


def by_chain_and_type(mentions: DataFrame, of_chain: DataFrame) -> DataFrame:
    """(doc_id, chain_id, type, members): chains split by type, members in order."""
    m = gathered(joined(mentions, of_chain, ["doc_id", "ent_id"]), "doc_id", "chain_id")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "ent_id")))
    return m.groupBy("doc_id", "chain_id", "type").agg(F.transform(ordered, lambda x: x["ent_id"]).alias("members"))
