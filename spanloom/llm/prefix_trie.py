"""Prefix trie of conversations: what a cache of shared beginnings would save, rolled up by pointer jumping.

A node is a distinct sequence of a conversation's first turns, known by a digest of them. Digests need no walk through
a conversation: turns are gathered in blocks of bounded length, blocks are digested and combined by doubling, and only
within a block is a digest made from the one before it. Counts then climb the tree by pointer jumping: in round k every
node gives what it has summed up to its ancestor 2^k above, and takes that ancestor's ancestor for the next round, so
that a trie of depth d takes log2(d) rounds, whatever its shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.skew import look_up
from spanloom.llm.store import materialise

#: Turns that are digested one after the other.
BLOCK = 64
#: Identifiers that are written out at once.
PACK = 65_536
#: Most turns that a rebuilt conversation takes from the first of its hundred.
BORROWED = 5


def root() -> Column:
    """The digest of the root, which has no turn."""
    return F.expr("X''")


def digest(*parts: Column) -> Column:
    """md5 in 16 bytes; the parts but the first have a fixed length."""
    return F.unhex(F.md5(F.concat(*parts)))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (part, conv, pos, dig, chars), and (part, conv, n) where a conversation's turns lie; ``pos`` counts from 0.

    Turns are in order of ``turn``, null first, and of a digest of role and text where turns are equal; equal rows
    follow each other. Null roles and texts are empty ones. Rows without a conv_id belong to no conversation.
    Places come from a range partitioning and counts of its parts, so a conversation of any length is spread.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv, turn = F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(conv, turn, digest(F.md5(role), F.md5(text)).alias("dig"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.col("turn").asc_nulls_first(), "dig", "row"]
    dealt = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    parts = materialise(dealt.groupBy("part", "conv").agg(F.count("*").alias("n")), "parts")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("part", "conv", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order[1:])) - 1
    return materialise(dealt.join(bases, ["part", "conv"]).select("part", "conv", place.alias("pos"), "dig", "chars"), "places"), parts


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv, at, dig, chars, total) and their conversations (conv, total), by the rule of the query.

    Conversation c begins with the first h turns of conversation c - c % 100 and goes on with its own turns behind
    its first h, where h is the crc32 of c's decimals modulo 6.
    """
    turns, parts = numbered(conversations)
    firsts = turns.where(F.col("pos") < BORROWED).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "dig", "chars"))).alias("first"))
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % (BORROWED + 1)).cast("int"))
    convs = convs.withColumn("lender", F.col("conv") - F.col("conv") % 100).join(firsts.withColumnRenamed("conv", "lender"), "lender", "left")
    head = F.when(F.col("first").isNotNull() & (F.col("h") > 0), F.slice("first", 1, F.greatest("h", F.lit(1))))
    convs = convs.withColumn("head", head).withColumn("k", F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))).withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv", "h", "k", "total", "head"), "conversations")
    where = parts.select("part", "conv").join(convs.drop("head"), "conv")
    own = turns.join(where, ["part", "conv"]).where("pos >= h").select("conv", (F.col("k") + F.col("pos") - F.col("h")).alias("at"), "dig", "chars", "total")
    lent = convs.where("k > 0").select("conv", "total", F.posexplode("head").alias("at", "t")).select("conv", F.col("at").cast("long").alias("at"), "t.dig", "t.chars", "total")
    return own.unionByName(lent), convs.select("conv", "total")


def paths(sequences: DataFrame) -> DataFrame:
    """(conv, depth, dig, parent, chars, ends) for each turn of the sequences: the node it leads to and the one before."""
    block = F.floor(F.col("at") / BLOCK).alias("block")
    blocks = sequences.groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct("at", "dig", "chars"))).alias("turns"), F.max("total").alias("total"))
    blocks = materialise(blocks, "blocks")
    long = blocks.where(F.col("total") > BLOCK)
    most = long.agg(F.max("block")).first()[0]
    chained = lambda start: F.aggregate("turns", F.array(start), lambda made, t: F.concat(made, F.array(digest(F.element_at(made, -1), t["dig"]))))
    short = blocks.where(F.col("total") <= BLOCK).select("conv", "total", "turns", chained(root()).alias("nodes"), root().alias("parent"))
    if most is not None:
        now = materialise(long.select("conv", "block", F.element_at(chained(root()), -1).alias("d")), "scan")
        span = 1
        while span <= most:
            earlier = now.select("conv", (F.col("block") + span).alias("block"), F.col("d").alias("before"))
            joined = F.when(F.col("before").isNull(), F.col("d")).otherwise(digest(F.col("before"), F.col("d")))
            now = materialise(now.join(earlier, ["conv", "block"], "left").select("conv", "block", joined.alias("d")), "scan")
            span *= 2
        starts = now.select("conv", (F.col("block") + 1).alias("block"), F.col("d").alias("start"))
        made = long.join(starts, ["conv", "block"], "left").select("conv", "block", "total", "turns", chained(F.coalesce("start", root())).alias("nodes"))
        made = materialise(made, "chains")
        last = made.select("conv", (F.col("block") + 1).alias("block"), F.element_at("nodes", -1).alias("last"))
        made = made.join(last, ["conv", "block"], "left").withColumn("parent", F.coalesce("last", root()))
        short = short.unionByName(made.select(*short.columns))
    each = short.select("conv", "total", "turns", "nodes", "parent", F.posexplode("turns").alias("j", "t"))
    parent = F.when(F.col("j") == 0, F.col("parent")).otherwise(F.element_at("nodes", F.col("j") + 1))
    depth = F.col("t.at") + 1
    return each.select("conv", depth.alias("depth"), F.element_at("nodes", F.col("j") + 2).alias("dig"), parent.alias("parent"), "t.chars", (depth == F.col("total")).alias("ends"))


def summed(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(dig, values) summed over each node's subtree, from nodes (dig, parent, depth, values); the root has no parent."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now, span = nodes.select("dig", "depth", F.col("parent").alias("up"), *values), 1
    while span <= deepest:
        given = materialise(now.where("up IS NOT NULL").groupBy(F.col("up").alias("dig")).agg(F.count("*").alias("n"), *(F.sum(v).alias(f"more_{v}") for v in values)), "given")
        after = now.join(given.drop("n"), "dig", "left").select("dig", "depth", "up", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        still = after.where(F.col("depth") >= 2 * span)  # the others have no ancestor so far above
        table = now.where(F.col("up").isNotNull()).select(F.col("dig").alias("up"), F.col("up").alias("further"))
        counts = given.select(F.col("dig").alias("up"), "n")
        still = look_up(still, table, ["up"], counts, "left").select("dig", "depth", F.col("further").alias("up"), *values)
        done = after.where(F.col("depth") < 2 * span).withColumn("up", F.lit(None).cast("binary"))
        now = materialise(still.unionByName(done), "jumps")
        span *= 2
    return now.select("dig", *values)


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (dig, conv) runs of at most ``PACK`` identifiers as text: (dig, part, nth, ids)."""
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        digs, convs, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        rows = []
        for stop in range(1, len(digs) + 1):
            if stop == len(digs) or digs[stop] != digs[at] or stop - at == PACK:
                rows.append((digs[at], part, nth, ",".join(map(str, convs[at:stop]))))
                at, nth = stop, nth + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["dig", "part", "nth", "ids"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs sorted by node, part and number: (dig, sha) of each node's identifiers. Packs pass by one at a time."""
    last, state = None, None
    for batch in batches:
        rows = []
        for dig, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if dig != last:
                if state is not None:
                    rows.append((last, state.hexdigest()))
                last, state = dig, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], ["dig", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["dig", "sha"])


def trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the sequences (conv, at, dig, chars, total) of conversations (conv, total).

    ``at`` counts turns from 0, ``dig`` is a turn's digest, ``chars`` its length; ``total`` is the number of a
    conversation's turns, and may be 0. Out come conv_id (the smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens (what members beyond the first repeat, in the whole subtree),
    and ends_sha256 over the members that end here, in ascending order. Without any conversation there is no node.

    A digest over many members is the one thing that is sequential by definition: members are sorted and packed by
    many tasks, and packs of up to 65,536 then pass through one task for each node, which holds one at a time.
    """
    steps = materialise(paths(sequences), "paths")
    nodes = steps.groupBy("dig").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    top = top.select(root().alias("dig"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = materialise(nodes.unionByName(top), "nodes")
    children = materialise(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("dig")).agg(F.count("*").alias("n")), "children")
    nodes = materialise(nodes.join(children, "dig", "left").withColumn("n", F.coalesce("n", F.lit(0))), "nodes")
    own = nodes.select("dig", "parent", "depth", (F.col("n") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = summed(own, ["n_leaves", "saved_tokens"])
    ends = steps.where("ends").select("dig", "conv").unionByName(convs.where("total = 0").select(root().alias("dig"), "conv"))
    packed = ends.repartitionByRange("dig", "conv").sortWithinPartitions("dig", "conv").mapInArrow(packs, "dig binary, part int, nth long, ids string")
    shas = packed.repartition("dig").sortWithinPartitions("dig", "part", "nth").select("dig", "ids").mapInArrow(hashed, "dig binary, sha string")
    over = nodes.select(F.col("dig").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = look_up(nodes, over, ["parent"], children.select(F.col("dig").alias("parent"), "n"), "left")
    nothing = F.sha2(root(), 256)
    return found.join(sums, "dig").join(shas, "dig", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", nothing).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``."""
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Places by windows, paths as lists of digests, and ancestors as their beginnings.
ORACLE = """
WITH t AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(md5(coalesce(role, '')) || md5(coalesce(text, '')))) - 1 AS pos,
    md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS dig, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT i, (WITH RECURSIVE r(k, c) AS (SELECT 0, i::BIGINT UNION ALL SELECT k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM r WHERE k < 8) SELECT c FROM r WHERE k = 8) AS v FROM range(256) g(i)),
names AS (SELECT DISTINCT conv, conv::VARCHAR AS s FROM t),
crc AS (
  WITH RECURSIVE r(conv, s, k, c) AS (SELECT conv, s, 0, 4294967295::BIGINT FROM names
    UNION ALL SELECT r.conv, r.s, r.k + 1, xor(bits.v, r.c // 256) FROM r JOIN bits ON bits.i = xor(r.c & 255, ascii(s[k + 1])::BIGINT) WHERE r.k < length(r.s))
  SELECT conv, xor(c, 4294967295) % 6 AS h FROM r WHERE k = length(s)),
lent AS (SELECT crc.conv, t.pos AS place, t.dig, t.chars FROM crc JOIN t ON t.conv = crc.conv - crc.conv % 100 AND t.pos < crc.h),
seq AS (SELECT * FROM lent UNION ALL SELECT t.conv, (SELECT count(*) FROM lent WHERE lent.conv = t.conv) + t.pos - crc.h, t.dig, t.chars FROM t JOIN crc USING (conv) WHERE t.pos >= crc.h),
whole AS (SELECT crc.conv, coalesce(list(dig ORDER BY place) FILTER (WHERE dig IS NOT NULL), []) AS digs, coalesce(list(chars ORDER BY place) FILTER (WHERE dig IS NOT NULL), []) AS lens FROM crc LEFT JOIN seq USING (conv) GROUP BY crc.conv),
steps AS (SELECT conv, len(digs) AS total, unnest(range(0, len(digs) + 1)) AS depth, digs, lens FROM whole),
paths AS (SELECT conv, depth, total, array_to_string(digs[1:depth], ',') AS node, CASE WHEN depth > 0 THEN array_to_string(digs[1:depth - 1], ',') END AS parent, CASE WHEN depth > 0 THEN lens[depth] ELSE 0 END AS chars FROM steps),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE depth = total), '')) AS ends_sha256 FROM paths GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT paths.node, p.node AS up FROM paths JOIN paths p ON p.conv = paths.conv AND p.depth <= paths.depth),
sums AS (SELECT above.up AS node, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((nodes.n_convs - 1) * nodes.chars) AS saved_tokens FROM above JOIN nodes ON nodes.node = above.node LEFT JOIN kids ON kids.node = above.node GROUP BY above.up)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sums.n_leaves::BIGINT AS n_leaves, sums.saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON p.node = nodes.parent
"""
