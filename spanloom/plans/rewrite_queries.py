"""Queries over label codecs and document rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import labels as L
from spanloom.operators import rewrite as R
from spanloom.plans import base
from spanloom.plans.base import MENTIONS, TOKENS, oracle
from spanloom.plans.span_queries import RELATIONS, _relations


def _plain(spark, sf):
    """Mentions that don't overlap: the runs alone."""
    return base.mentions(spark, sf).where("type <> 'CTX'")


def _encode(scheme):
    def query(spark, sf):
        return L.encode(base.tokens(spark, sf), _plain(spark, sf), scheme)

    return query


def _decode(scheme):
    def query(spark, sf):
        """Tags made from characters, so that every order of symbols occurs."""
        symbols = {"io": "I", "bio": "BI", "bilou": "BILU"}[scheme]
        core = F.ascii("token")
        symbol = F.substring(F.lit(symbols), F.pmod(core, F.lit(len(symbols))) + 1, F.lit(1))
        kind = F.when(F.length("token") % 2 == 0, "X").otherwise("Y")
        tag = F.when(F.length("token") % 3 == 0, "O").otherwise(F.concat_ws("-", symbol, kind))
        return L.decode(base.tokens(spark, sf).withColumn("tag", tag), scheme)

    return query


def possible_tags(spark, sf):
    return L.possible_tags(base.mentions(spark, sf).select("type").distinct(), "bilou")


def adjust_sentences(spark, sf):
    return R.adjust_sentences(base.sentences(spark, sf), base.mentions(spark, sf))


def merge_intersecting(spark, sf):
    return R.merge_intersecting(base.mentions(spark, sf))


def illegal_overlaps(spark, sf):
    return R.illegal_overlaps(base.mentions(spark, sf))


def merged_relations(spark, sf):
    return R.merged_relations(_relations(spark, sf), R.merge_intersecting(base.mentions(spark, sf)))


def _map(spark, sf):
    tokens = base.tokens(spark, sf)
    return R.token_map(tokens, R.to_collapse(base.mentions(spark, sf), ["CTX", "NUM"]))


def collapsed_tokens(spark, sf):
    return R.collapse_tokens(base.tokens(spark, sf), _map(spark, sf))


def collapsed_mentions(spark, sf):
    found = R.remapped(base.mentions(spark, sf).select("doc_id", "ent_id", "start_token", "end_token"), _map(spark, sf))
    return found


def _quote_marks(spark, sf):
    """Tokens where every eleventh is a quotation mark, so that marks surround mentions."""
    return base.tokens(spark, sf).select("doc_id", "tok_idx", F.when(F.col("tok_idx") % 11 == 0, '"').when(F.col("tok_idx") % 11 == 2, "»").otherwise(F.col("token")).alias("token"))


def unquoted_tokens(spark, sf):
    tokens, _ = R.unquote(_quote_marks(spark, sf), _plain(spark, sf), _plain(spark, sf), ["CAP", "NUM"])
    return tokens


def unquoted_mentions(spark, sf):
    _, spans = R.unquote(_quote_marks(spark, sf), _plain(spark, sf).select("doc_id", "ent_id", "start_token", "end_token"), _plain(spark, sf), ["CAP", "NUM"])
    return spans


QUERIES = {f"{s}_encode": _encode(s) for s in L.SYMBOLS} | {f"{s}_decode": _decode(s) for s in ("io", "bio", "bilou")}
QUERIES |= {f.__name__: f for f in (possible_tags, adjust_sentences, merge_intersecting, illegal_overlaps, merged_relations, collapsed_tokens, collapsed_mentions, unquoted_tokens, unquoted_mentions)}

ENCODE = """pl AS (SELECT *, coalesce(lag(end_token) OVER (PARTITION BY doc_id, type ORDER BY start_token) = start_token, false) AS follows FROM ment WHERE type <> 'CTX'),
cov AS (SELECT *, unnest(range(start_token, end_token)) AS tok_idx FROM pl)
SELECT t.doc_id, t.tok_idx, t.sent_idx, CASE WHEN pl.type IS NULL THEN 'O' ELSE {symbol} || '-' || pl.type END AS tag FROM tok t LEFT JOIN cov pl ON pl.doc_id = t.doc_id AND pl.tok_idx = t.tok_idx"""
ENCODED = {
    "io": "'I'",
    "bio2": "CASE WHEN t.tok_idx = pl.start_token AND follows THEN 'B' ELSE 'I' END",
    "bio": "CASE WHEN t.tok_idx = pl.start_token THEN 'B' ELSE 'I' END",
    "bilou": "CASE WHEN end_token - start_token = 1 THEN 'U' WHEN t.tok_idx = pl.start_token THEN 'B' WHEN t.tok_idx = end_token - 1 THEN 'L' ELSE 'I' END",
}
DECODE = """tg AS (SELECT doc_id, sent_idx, tok_idx, length(token) % 3 = 0 AS outside, substr('{symbols}', CAST(ord(token) % {n} + 1 AS INTEGER), 1) AS sym, CASE WHEN length(token) % 2 = 0 THEN 'X' ELSE 'Y' END AS kind FROM tok),
pv AS (SELECT *, coalesce(lag(outside) OVER w, true) AS p_out, lag(kind) OVER w AS p_kind FROM tg WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY tok_idx)),
bg AS (SELECT *, sum(CASE WHEN NOT outside AND (p_out OR p_kind <> kind OR sym = 'B') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) AS island FROM pv)
SELECT doc_id, sent_idx, min(tok_idx) AS start_token, max(tok_idx) + 1 AS end_token, first(kind) AS type FROM bg WHERE NOT outside GROUP BY doc_id, sent_idx, island"""
MERGED = """g0 AS (SELECT *, CASE WHEN start_token >= max(end_token) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM ment),
g1 AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM g0),
hd AS (SELECT doc_id, grp, min_by(ent_id, ord) AS new_id, min_by(type, ord) AS ht, min_by(end_token - start_token, ord) AS hl, min(start_token) AS s, max(end_token) AS e FROM g1 GROUP BY ALL),
lg AS (SELECT g1.doc_id, g1.grp, max_by(type, ord) AS lt FROM g1 JOIN hd USING (doc_id, grp) WHERE end_token - start_token > hl GROUP BY ALL),
mrg AS (SELECT g1.doc_id, ent_id, new_id, s AS start_token, e AS end_token, coalesce(lt, ht) AS type FROM g1 JOIN hd USING (doc_id, grp) LEFT JOIN lg USING (doc_id, grp))"""
MAPPED = """ch0 AS (SELECT * FROM ment m WHERE type IN ('CTX', 'NUM')),
mx AS (SELECT * FROM ch0 a WHERE NOT EXISTS (SELECT 1 FROM ch0 b WHERE b.doc_id = a.doc_id AND b.start_token <= a.start_token AND b.end_token >= a.end_token AND ((b.start_token, b.end_token) <> (a.start_token, a.end_token) OR b.type < a.type))),
i0 AS (SELECT *, CASE WHEN start_token >= max(end_token) OVER (PARTITION BY doc_id ORDER BY start_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM mx),
i1 AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY start_token) AS g FROM i0),
i2 AS (SELECT doc_id, g, min(start_token) AS s, max(end_token) AS e, max_by(type, ord) AS kind FROM i1 GROUP BY ALL),
mp AS (SELECT t.doc_id, t.tok_idx, t.token, kind, s IS NULL OR s = t.tok_idx AS stays, CAST(sum(CASE WHEN s IS NULL OR s = t.tok_idx THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY t.tok_idx) - 1 AS INTEGER) AS new_idx FROM tok t LEFT JOIN i2 ON i2.doc_id = t.doc_id AND t.tok_idx >= s AND t.tok_idx < e)"""
UNQUOTED = """qt AS (SELECT doc_id, tok_idx, CASE tok_idx % 11 WHEN 0 THEN '"' WHEN 2 THEN '»' ELSE token END AS token FROM tok),
mk AS (SELECT doc_id, tok_idx FROM qt WHERE length(token) = 1 AND token IN ('"', '''', '»', '«', '“', '”', '’', '‘')),
qm AS (SELECT m.* FROM ment m WHERE type IN ('CAP', 'NUM') AND EXISTS (SELECT 1 FROM mk WHERE mk.doc_id = m.doc_id AND mk.tok_idx = m.start_token - 1) AND EXISTS (SELECT 1 FROM mk WHERE mk.doc_id = m.doc_id AND mk.tok_idx = m.end_token)),
ct AS (SELECT DISTINCT doc_id, tok_idx FROM (SELECT doc_id, start_token - 1 AS tok_idx FROM qm UNION ALL SELECT doc_id, end_token FROM qm)),
up AS (SELECT qt.*, ct.tok_idx IS NULL AS kept, CAST(sum(CASE WHEN ct.tok_idx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY qt.doc_id ORDER BY qt.tok_idx) AS INTEGER) AS upto FROM qt LEFT JOIN ct ON ct.doc_id = qt.doc_id AND ct.tok_idx = qt.tok_idx)"""

ORACLES = {f"{s}_encode": oracle(ENCODE.format(symbol=x), MENTIONS) for s, x in ENCODED.items()}
ORACLES |= {f"{s}_decode": oracle(DECODE.format(symbols=x, n=len(x)), TOKENS) for s, x in (("io", "I"), ("bio", "BI"))}
ORACLES |= {
    "bilou_decode": oracle(
        """tg AS (SELECT doc_id, sent_idx, tok_idx, length(token) % 3 = 0 AS outside, substr('BILU', CAST(ord(token) % 4 + 1 AS INTEGER), 1) AS sym, CASE WHEN length(token) % 2 = 0 THEN 'X' ELSE 'Y' END AS kind FROM tok),
        pv AS (SELECT *, CASE WHEN lag(outside) OVER w THEN 'O' ELSE lag(kind) OVER w END AS pk FROM tg WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY tok_idx)),
        st AS (SELECT *, coalesce(last_value(CASE WHEN outside THEN 0 WHEN sym IN ('B', 'I') THEN 1 WHEN sym = 'L' AND kind = pk THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS open_after FROM pv),
        bg AS (SELECT *, NOT outside AND (coalesce(lag(open_after) OVER w, 0) = 0 OR kind <> pk OR sym IN ('B', 'U')) AS b FROM st WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY tok_idx)),
        sp AS (SELECT *, sum(CAST(b AS INTEGER)) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) AS island FROM bg)
        SELECT doc_id, sent_idx, min(tok_idx) AS start_token, max(tok_idx) + 1 AS end_token, min_by(kind, tok_idx) AS type FROM sp WHERE NOT outside GROUP BY doc_id, sent_idx, island""",
        TOKENS,
    ),
    "possible_tags": oracle("SELECT DISTINCT s || '-' || type AS tag FROM ment, (SELECT unnest(['B', 'I', 'L', 'U']) AS s) UNION SELECT 'O'", MENTIONS),
    "adjust_sentences": oracle(
        """cr AS (SELECT s.doc_id, s.sent_idx, EXISTS (SELECT 1 FROM ment m WHERE m.doc_id = s.doc_id AND m.start_token < s.start_token AND m.end_token > s.start_token) AS crossed FROM sent s),
        gp AS (SELECT *, sum(CASE WHEN crossed THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS g FROM cr)
        SELECT gp.doc_id, CAST(g AS INTEGER) AS sent_idx, min(start_token) AS start_token, max(end_token) AS end_token FROM gp JOIN sent USING (doc_id, sent_idx) GROUP BY gp.doc_id, g""",
        MENTIONS,
    ),
    "merge_intersecting": oracle(MERGED + " SELECT * FROM mrg", MENTIONS),
    "illegal_overlaps": oracle(
        """SELECT a.doc_id, a.ent_id AS id1, b.ent_id AS id2 FROM ment a JOIN ment b ON a.doc_id = b.doc_id AND a.ord < b.ord AND a.type <> b.type AND a.start_token < b.end_token AND b.start_token < a.end_token
        WHERE NOT (a.start_token < b.start_token AND a.end_token >= b.end_token OR a.start_token <= b.start_token AND a.end_token > b.end_token OR b.start_token < a.start_token AND b.end_token >= a.end_token OR b.start_token <= a.start_token AND b.end_token > a.end_token)""",
        MENTIONS,
    ),
    "merged_relations": oracle(MERGED + ", " + RELATIONS + " SELECT DISTINCT raw.doc_id, f.new_id AS first, s.new_id AS second, rel_type FROM raw JOIN mrg f ON f.doc_id = raw.doc_id AND f.ent_id = first JOIN mrg s ON s.doc_id = raw.doc_id AND s.ent_id = second", MENTIONS),
    "collapsed_tokens": oracle(MAPPED + " SELECT doc_id, new_idx AS tok_idx, CASE WHEN kind IS NULL THEN token ELSE '$' || kind || '$' END AS token FROM mp WHERE stays", MENTIONS),
    "collapsed_mentions": oracle(MAPPED + " SELECT m.doc_id, m.ent_id, a.new_idx AS start_token, b.new_idx + 1 AS end_token FROM ment m JOIN mp a ON a.doc_id = m.doc_id AND a.tok_idx = m.start_token JOIN mp b ON b.doc_id = m.doc_id AND b.tok_idx = m.end_token - 1", MENTIONS),
    "unquoted_tokens": oracle(UNQUOTED + " SELECT doc_id, upto - 1 AS tok_idx, token FROM up WHERE kept", MENTIONS),
    "unquoted_mentions": oracle(UNQUOTED + " SELECT m.doc_id, m.ent_id, a.upto - CAST(a.kept AS INTEGER) AS start_token, b.upto AS end_token FROM ment m JOIN up a ON a.doc_id = m.doc_id AND a.tok_idx = m.start_token JOIN up b ON b.doc_id = m.doc_id AND b.tok_idx = m.end_token - 1 WHERE m.type <> 'CTX'", MENTIONS),
}
