"""Candidate pairs of mentions: their making, filters, labels and distances.

A pair is (doc_id, e1, e2) with two mention structs. Where pairs lie within a sentence, the sentence is part of
the join key, so that a document's pairs don't grow with the square of its mentions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators.asof import with_counts
from spanloom.operators.grouped import gathered, joined, sorted_join
from spanloom.operators.mentions import as_struct, within
from spanloom.store import materialise

Filter = Callable[[Column, Column], Column]


def different() -> Filter:
    return lambda a, b: ~S.same(a, b)


def same_sentence() -> Filter:
    return lambda a, b: a["sent_idx"] == b["sent_idx"]


def within_tokens(most: int) -> Filter:
    return lambda a, b: S.token_distance(a, b) <= most


def not_intersecting() -> Filter:
    return lambda a, b: ~S.intersects(a, b)


def all_of(*filters: Filter) -> Filter:
    return lambda a, b: reduce(lambda x, y: x & y, (f(a, b) for f in filters))


def none_of(*heuristics: Filter) -> Filter:
    """Leaves out a pair for which any heuristic fires."""
    return lambda a, b: ~reduce(lambda x, y: x | y, (F.coalesce(h(a, b), F.lit(False)) for h in heuristics))


def candidates(mentions: DataFrame, keep: Filter | None = None, in_sentence: bool = False, near: int | None = None) -> DataFrame:
    """All ordered pairs of a document's mentions that a filter keeps, a mention with itself included.

    With ``near`` only those within so many tokens, and then only mentions meet that cover or neighbour one bin of
    tokens, so that pairs don't grow with the square of a document's or a sentence's mentions. Each pair comes from
    the first bin that both reach.
    """
    if near is not None:
        size = max(near, 1)
        reached = lambda: F.sequence(F.floor(F.col("start_token") / size), F.floor((F.col("end_token") + near) / size))
        spread = mentions.select("doc_id", "sent_idx", as_struct().alias("m"), F.explode(reached()).alias("bin"), F.floor(F.col("start_token") / size).alias("first_bin"))
        sides = [spread.select("doc_id", "bin", *(["sent_idx"] if in_sentence else []), F.col("m").alias(e), F.col("first_bin").alias(f"{e}_bin")) for e in ("e1", "e2")]
        met = sides[0].join(sides[1], ["doc_id", "bin", *(["sent_idx"] if in_sentence else [])]).where(F.col("bin") == F.greatest("e1_bin", "e2_bin"))
        found = met.select("doc_id", "e1", "e2").where(S.token_distance(F.col("e1"), F.col("e2")) <= near)
        return found.where(keep(F.col("e1"), F.col("e2"))) if keep else found
    a = mentions.select("doc_id", F.col("sent_idx").alias("pair_sent"), as_struct().alias("e1"))
    b = mentions.select("doc_id", F.col("sent_idx").alias("pair_sent"), as_struct().alias("e2"))
    joined = a.join(b, ["doc_id", "pair_sent"]) if in_sentence else a.drop("pair_sent").join(b.drop("pair_sent"), "doc_id")
    made = joined.select("doc_id", "e1", "e2")
    return made.where(keep(F.col("e1"), F.col("e2"))) if keep else made


def of_argument_types(pairs: DataFrame, types: DataFrame) -> DataFrame:
    """Pairs whose types occur in (t1, t2) rows."""
    return pairs.join(types.select("t1", "t2").distinct(), (F.col("e1.type") == F.col("t1")) & (F.col("e2.type") == F.col("t2")), "left_semi")


def argument_types(relations: DataFrame) -> DataFrame:
    """The type pairs of relations (e1, e2, rel_type), each with its relation types in order."""
    return relations.groupBy(F.col("e1.type").alias("t1"), F.col("e2.type").alias("t2")).agg(F.array_sort(F.collect_set("rel_type")).alias("rel_types"))


def labelled(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs with their relation's type, null without one; of several types the greatest."""
    known = relations.groupBy("doc_id", F.col("e1.ent_id").alias("id1"), F.col("e2.ent_id").alias("id2")).agg(F.max("rel_type").alias("label"))
    made = pairs.withColumns({"id1": F.col("e1.ent_id"), "id2": F.col("e2.ent_id")})
    return made.join(known, ["doc_id", "id1", "id2"], "left").drop("id1", "id2")


def in_sentence_relations(relations: DataFrame, sentences: DataFrame) -> DataFrame:
    """Relations both of whose arguments lie in one sentence."""
    begun = with_counts(relations, F.least("e1.start_token", "e2.start_token"), sentences.select("doc_id", F.col("start_token").alias("pos")), "place", inclusive=True)
    placed = sentences.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_token")).alias("place"), F.struct("start_token", "end_token").alias("sentence"), F.col("sent_idx").alias("in_sent"))
    inside = S.contains(F.col("sentence"), F.col("e1")) & S.contains(F.col("sentence"), F.col("e2"))
    return begun.join(placed, ["doc_id", "place"]).where(inside).drop("sentence", "place")


def resolve(raw: DataFrame, mentions: DataFrame, symmetric: list[str]) -> DataFrame:
    """Relations (doc_id, first, second, rel_type) by id to pairs; of symmetric types both ways; duplicates out."""
    back = raw.where(F.col("rel_type").isin(symmetric)).select("doc_id", F.col("second").alias("first"), F.col("first").alias("second"), "rel_type")
    both = raw.select("doc_id", "first", "second", "rel_type").unionByName(back).distinct()
    a = mentions.select("doc_id", F.col("ent_id").alias("first"), as_struct().alias("e1"))
    b = mentions.select("doc_id", F.col("ent_id").alias("second"), as_struct().alias("e2"))
    return sorted_join(sorted_join(both, a, ["doc_id", "first"]), b, ["doc_id", "second"]).select("doc_id", "e1", "e2", "rel_type")


def unresolved(raw: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations that name an unknown mention."""
    ids = mentions.select("doc_id", F.col("ent_id").alias("known"))
    ends = raw.select("doc_id", "rel_type", F.explode(F.array("first", "second")).alias("known"))
    return ends.join(ids, ["doc_id", "known"], "left_anti")


def preceding(mentions: DataFrame, k: int) -> DataFrame:
    """Each mention with the ``k`` before it in order: a band join, by a window of that width."""
    before = F.collect_list(as_struct()).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-k, -1))
    return mentions.select("doc_id", as_struct().alias("e2"), before.alias("earlier")).select("doc_id", F.explode("earlier").alias("e1"), "e2")


def training_pairs(mentions: DataFrame, chains: DataFrame) -> DataFrame:
    """Neighbours in a chain, and with the later one every other mention that begins no earlier than the first and ends no later than the later."""
    order = Window.partitionBy("doc_id", "chain_id").orderBy("ord")
    linked = gathered(joined(mentions, chains.select("doc_id", "ent_id", "chain_id"), ["doc_id", "ent_id"]), "doc_id", "chain_id").withColumn("me", as_struct())
    steps = linked.select("doc_id", F.col("me").alias("e1"), F.lead("me").over(order).alias("e2")).where("e2 IS NOT NULL")
    between = within(steps, F.col("e1.start_token"), F.col("e2.end_token"), mentions).where("m.ord <> e1.ord AND m.ord <> e2.ord")
    return gathered(steps.unionByName(between.select("doc_id", as_struct("m.").alias("e1"), "e2")), "doc_id").distinct()


def with_entity_distance(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs with ``entity_distance``: mentions between the two, counted in order until one ends too late.

    Counting stops at the first mention that ends after the later start, so one that ends in time but comes
    after it isn't counted; this is less than a plain count.
    """
    m = mentions.select("doc_id", "ord", "start_token", "end_token")
    # Mentions are in order of their starts. The first that ends after a place is where the running maximum of ends
    # first passes it, so both bounds are places in this order, and what lies between is a difference of two counts.
    reach = F.max("end_token").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    counted = with_counts(pairs, F.least("e1.end_token", "e2.end_token"), m.select("doc_id", F.col("start_token").alias("pos")), "n_from")
    counted = with_counts(counted, F.greatest("e1.start_token", "e2.start_token"), m.select("doc_id", reach.alias("pos")), "n_upto", inclusive=True)
    return counted.withColumn("entity_distance", F.greatest(F.col("n_upto") - F.col("n_from"), F.lit(0))).drop("n_from", "n_upto")


def with_mention_distance(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs with ``mention_distance``: mentions that lie wholly between the two."""
    keyed = pairs.withColumns({"from_end": F.least("e1.end_token", "e2.end_token"), "to_start": F.greatest("e1.start_token", "e2.start_token")})
    gaps = keyed.select("doc_id", "from_end", "to_start").distinct()
    inside = within(gaps, F.col("from_end"), F.col("to_start"), mentions.select("doc_id", "start_token", "end_token"))
    between = inside.groupBy("doc_id", "from_end", "to_start").agg(F.count("*").alias("mention_distance"))
    joined = keyed.join(between, ["doc_id", "from_end", "to_start"], "left").drop("from_end", "to_start")
    return joined.withColumn("mention_distance", F.coalesce("mention_distance", F.lit(0)))


def _reaches(mentions: DataFrame) -> DataFrame:
    """Mentions (doc_id, m, up, down): how many mentions are over before one begins, and how many begin before it ends.

    Over are those of the running maximum of ends, as ``with_entity_distance`` counts; the entity distance of two mentions is
    the greater ``up`` less the smaller ``down``, if that is above 0.
    """
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    over = mentions.select("doc_id", F.max("end_token").over(order).alias("pos"))
    made = mentions.select("doc_id", as_struct().alias("m"))
    made = with_counts(made, F.col("m.start_token"), over, "up", inclusive=True)
    return with_counts(made, F.col("m.end_token"), mentions.select("doc_id", F.col("start_token").alias("pos")), "down")


def in_reach(mentions: DataFrame, chains: DataFrame, seekers: Column, targets: Column, most: int) -> DataFrame:
    """(doc_id, chain_id, s, t, entity_distance): seeking mentions and members of chains within ``most`` by entity distance.

    The limit is an overlap of two ranges of counts, so mentions meet in bins of counts, each pair in the first bin that
    both reach, and no pair is made only to be dropped for its distance but for those of one bin.
    """
    reach = _reaches(mentions)
    size = most + 4
    bins = F.sequence(F.floor(F.col("up") / size), F.floor((F.col("down") + most) / size))
    spread = reach.withColumns({"first_bin": F.floor(F.col("up") / size), "bin": F.explode(bins)}).select("doc_id", "m.*", F.col("m").alias("me"), "up", "down", "first_bin", "bin")
    seek = spread.where(seekers).select("doc_id", "bin", F.col("me").alias("s"), F.struct("up", "down", "first_bin").alias("sr"))
    aim = joined(spread.where(targets), chains.select("doc_id", "ent_id", "chain_id"), ["doc_id", "ent_id"]).where("chain_id IS NOT NULL")
    aim = aim.select("doc_id", "bin", "chain_id", F.col("me").alias("t"), F.struct("up", "down", "first_bin").alias("tr"))
    met = joined(seek, aim, ["doc_id", "bin"]).where((F.col("bin") == F.greatest("sr.first_bin", "tr.first_bin")) & (F.col("s.ord") != F.col("t.ord")))
    distance = F.greatest(F.greatest("sr.up", "tr.up") - F.least("sr.down", "tr.down"), F.lit(0))
    return met.select("doc_id", "chain_id", "s", "t", distance.alias("entity_distance")).where(F.col("entity_distance") <= most)


def _in_order(s: str, t: str) -> list[Column]:
    first = F.col(f"{s}.ord") < F.col(f"{t}.ord")
    return [F.when(first, F.col(s)).otherwise(F.col(t)).alias("e1"), F.when(first, F.col(t)).otherwise(F.col(s)).alias("e2")]


def nearest_in_chain(mentions: DataFrame, chains: DataFrame, seekers: Column, targets: Column, most: int, strict: bool = False) -> DataFrame:
    """For each seeking mention and each chain one member within ``most`` by entity distance, or none.

    That is the nearest by token distance of those that begin no later, or if there is none or it is too far (and
    not ``strict``) the nearest of all, if that isn't too far. Of equally near ones the first in order. Members are
    mentions that ``targets`` holds for; pairs are in order of place. ``distance`` is the token distance.

    Both distances grow alike on one side, so the nearest within reach is the nearest there is, and members out of reach are
    never paired. Where all within reach begin later, the last end of the chain's earlier members says whether one of
    those is as near.
    """
    near = F.struct(S.token_distance(F.col("s"), F.col("t")).alias("distance"), F.col("t.ord").alias("ord"), F.col("t").alias("t"))
    left = F.col("t.start_token") <= F.col("s.start_token")
    met = in_reach(mentions, chains, seekers, targets, most)
    best = gathered(met, "doc_id", "chain_id").groupBy("doc_id", "chain_id", F.col("s.ord").alias("seeker")).agg(F.any_value("s").alias("s"), F.min(F.when(left, near)).alias("on_left"), F.min(near).alias("anywhere"))
    chosen = best.where("on_left IS NOT NULL").select("doc_id", "chain_id", "s", F.col("on_left").alias("n"))
    if not strict:
        later = best.where("on_left IS NULL").select("doc_id", "chain_id", "seeker", "s", F.col("anywhere").alias("n"))
        members = joined(mentions.where(targets), chains.select("doc_id", "ent_id", "chain_id"), ["doc_id", "ent_id"])
        members = members.select("doc_id", "chain_id", F.col("ord").alias("at"), F.lit(1).alias("member"), "end_token")
        asked = later.select("doc_id", "chain_id", F.col("seeker").alias("at"), F.lit(0).alias("member"), F.lit(None).cast("int").alias("end_token"))
        order = Window.partitionBy("doc_id", "chain_id").orderBy("at", "member").rowsBetween(Window.unboundedPreceding, 0)
        ends = gathered(members.unionByName(asked), "doc_id", "chain_id").withColumn("last_end", F.max("end_token").over(order)).where("member = 0")
        told = joined(later, ends.select("doc_id", "chain_id", F.col("at").alias("seeker"), "last_end"), ["doc_id", "chain_id", "seeker"])
        as_near = F.col("s.start_token") - F.col("last_end") + 1 <= F.col("n.distance")
        chosen = chosen.unionByName(told.where(~F.coalesce(as_near, F.lit(False))).select(*chosen.columns))
    return chosen.withColumn("t", F.col("n.t")).select("doc_id", "chain_id", *_in_order("s", "t"), F.col("n.distance").alias("distance"))


def pronoun_pairs(mentions: DataFrame, chains: DataFrame, seekers: Column, targets: Column, most: int) -> DataFrame:
    """Every seeking mention with each member of a chain that begins no later and is within ``most`` by entity distance.

    Members are mentions that ``targets`` holds for; pairs are in order of place.
    """
    met = in_reach(mentions, chains, seekers, targets, most).where("t.start_token <= s.start_token")
    return met.select("doc_id", "chain_id", *_in_order("s", "t"), "entity_distance")


def chain_labelled(pairs: DataFrame, chains: DataFrame, label: str = "COREF") -> DataFrame:
    """Pairs with the label where both mentions are in one chain, else null."""
    a = chains.select("doc_id", F.col("ent_id").alias("id1"), F.col("chain_id").alias("c1"))
    b = chains.select("doc_id", F.col("ent_id").alias("id2"), F.col("chain_id").alias("c2"))
    keyed = pairs.withColumns({"id1": F.col("e1.ent_id"), "id2": F.col("e2.ent_id")})
    joined = keyed.join(a, ["doc_id", "id1"], "left").join(b, ["doc_id", "id2"], "left")
    return joined.withColumn("label", F.when(F.col("c1") == F.col("c2"), label)).drop("id1", "id2", "c1", "c2")


def layer_labels(layer: DataFrame, entities: DataFrame) -> DataFrame:
    """For each mention of a second layer the type of the first entity on the same tokens, else null."""
    found = entities.groupBy("doc_id", "start_token", "end_token").agg(F.min_by("type", "ord").alias("label"))
    return layer.join(found, ["doc_id", "start_token", "end_token"], "left")


def labels_by_type(labelled: DataFrame, restricted: list[str] = ()) -> DataFrame:
    """Each layer type's labels in order (null as the text ``None``) and whether it is always the same."""
    kept = labelled.where(~F.col("type").isin(list(restricted))) if restricted else labelled
    grouped = kept.groupBy("type").agg(F.array_sort(F.collect_set(F.coalesce("label", F.lit("None")))).alias("labels"))
    return grouped.withColumn("single", F.size("labels") == 1)


def learnable_labels(labelled: DataFrame, restricted: list[str] = ()) -> DataFrame:
    """``labels_by_type`` as a table; an error if every type has one label alone, as there is nothing to learn then."""
    found = materialise(labels_by_type(labelled, restricted), "labels")
    if not found.isEmpty() and found.where("NOT single").isEmpty():
        raise ValueError("every type has one label alone")
    return found


def label_mask(vocabulary: list[str | None], valid: Column) -> Column:
    """For each label of a dictionary 1 if it is null (no relation) or valid here, else 0."""
    return F.array(*(F.lit(1) if v is None else F.coalesce(F.array_contains(valid, v).cast("int"), F.lit(0)) for v in vocabulary))


#: Bits of a hash that one histogram looks at, and so the most rows that are put in order in the end.
CELL_BITS = 12


def smallest(rows: DataFrame, most: int, hashed: Column, key: list[str]) -> DataFrame:
    """The ``most`` rows of smallest (hash, key), exactly, without putting all in order.

    A histogram of the hashes' first bits says in which cell the last of them lies; that cell is looked at by its next bits until
    it holds few. Rows before the cell are a filter, and only those of the cell are put in order.
    """
    if most <= 0:
        return rows.limit(0)
    marked = rows.withColumn("_hash", hashed.bitwiseXOR(F.lit(-(1 << 63))))  # in order as an unsigned number
    head = lambda bits: F.shiftrightunsigned("_hash", 64 - bits)
    inside, found, left = marked, None, most
    for bits in range(CELL_BITS, 61, CELL_BITS):
        counts = sorted((r["cell"], r["n"]) for r in inside.groupBy(head(bits).alias("cell")).agg(F.count("*").alias("n")).collect())  # at most 4,096
        for cell, n in counts:
            if n >= left:
                break
            left -= n
        else:
            return rows if bits == CELL_BITS else marked.drop("_hash")
        found, inside = cell, marked.where(head(bits) == cell)
        if n <= 1 << CELL_BITS:
            break
    before, last = marked.where(head(bits) < found), inside.withColumn("_hash", inside["_hash"].bitwiseXOR(F.lit(-(1 << 63)))).orderBy("_hash", *key).limit(left)
    return before.drop("_hash").unionByName(last.drop("_hash"))


def down_sampled(pairs: DataFrame, key: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """All labelled pairs, and of the others as many as ``ratio`` times those, those of smallest hash."""
    if not ratio >= 0:
        raise ValueError("the ratio must not be negative")
    if ratio == float("inf"):
        return pairs
    positive = pairs.where("label IS NOT NULL")
    most = int(positive.count() * ratio)
    return positive.unionByName(smallest(pairs.where("label IS NULL"), most, F.xxhash64(F.lit(seed), *key), key))
