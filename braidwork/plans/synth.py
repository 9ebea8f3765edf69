"""Sequence graphs made from the driver's tables, by SQL that gives the same in Spark and in DuckDB.

* J: parts and suppliers that share a junction tile, linked where a line item
  joins them: branching and bipartite.
* V: J with reverse-complemented nodes, substituted and deleted bases.
* T: a chain of orders whose neighbours share one tile; T3: nodes of three tiles
  that share two, so overlaps from both ends cross.
* B: a chain of bubbles over orders and their line items, without overlaps.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.shared import table
from braidwork.sources.gfa import Graph


def tile(key: str) -> str:
    """32 bases for a string."""
    return f"translate(md5({key}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def rc(sequence: str) -> str:
    return f"reverse(translate({sequence}, 'ACGTacgt', 'TGCAtgca'))"


def text(number: str) -> str:
    return f"CAST({number} AS VARCHAR(20))"


#: Half the suppliers: how many junctions there are.
M = "(SELECT CAST(floor(count(*) / 2.0) AS BIGINT) FROM supplier)"

J_SEGMENTS = f"""
SELECT 2 * p_partkey + 2 AS node_id, 'p' || {text("p_partkey")} AS name, {tile("'p' || " + text("p_partkey"))} || {tile("'j' || " + text(f"p_partkey % {M}"))} AS sequence FROM part
UNION ALL
SELECT 2 * s_suppkey + 3 AS node_id, 's' || {text("s_suppkey")} AS name, {tile("'j' || " + text(f"s_suppkey % {M}"))} || {tile("'s' || " + text("s_suppkey"))} AS sequence FROM supplier"""
J_LINKS = f"""
SELECT DISTINCT CAST(l_partkey * 1000000 + l_suppkey AS BIGINT) AS link_id, CAST(2 * l_partkey + 2 AS BIGINT) AS src, false AS src_rev, CAST(2 * l_suppkey + 3 AS BIGINT) AS dst, false AS dst_rev,
       '32M' AS cigar, CAST(32 AS BIGINT) AS src_len, CAST(32 AS BIGINT) AS dst_len
FROM lineitem WHERE l_partkey % {M} = l_suppkey % {M}"""

#: Parts: every third is stored reversed, every seventh has its junction's 17th base changed, every eleventh has it missing.
_CHANGED = f"({tile("'p' || " + text('p_partkey'))} || substr(j, 1, 16) || CASE WHEN substr(j, 17, 1) = 'A' THEN 'C' ELSE 'A' END || substr(j, 18, 15))"
_SHORT = f"({tile("'p' || " + text('p_partkey'))} || substr(j, 1, 16) || substr(j, 18, 15))"
V_SEGMENTS = f"""
SELECT node_id, name, CASE WHEN k % 3 = 0 THEN {rc("s")} ELSE s END AS sequence FROM (
  SELECT 2 * p_partkey + 2 AS node_id, 'p' || {text("p_partkey")} AS name, p_partkey AS k,
         CASE WHEN p_partkey % 11 = 0 THEN {_SHORT} WHEN p_partkey % 7 = 0 THEN {_CHANGED} ELSE {tile("'p' || " + text("p_partkey"))} || j END AS s
  FROM (SELECT p_partkey, {tile("'j' || " + text(f"p_partkey % {M}"))} AS j FROM part) AS a) AS b
UNION ALL
SELECT 2 * s_suppkey + 3 AS node_id, 's' || {text("s_suppkey")} AS name, {tile("'j' || " + text(f"s_suppkey % {M}"))} || {tile("'s' || " + text("s_suppkey"))} AS sequence FROM supplier"""
V_LINKS = f"""
SELECT DISTINCT CAST(l_partkey * 1000000 + l_suppkey AS BIGINT) AS link_id, CAST(2 * l_partkey + 2 AS BIGINT) AS src, l_partkey % 3 = 0 AS src_rev, CAST(2 * l_suppkey + 3 AS BIGINT) AS dst, false AS dst_rev,
       CASE WHEN l_partkey % 11 = 0 THEN '16M1I15M' ELSE '32M' END AS cigar, CAST(CASE WHEN l_partkey % 11 = 0 THEN 31 ELSE 32 END AS BIGINT) AS src_len, CAST(32 AS BIGINT) AS dst_len
FROM lineitem WHERE l_partkey % {M} = l_suppkey % {M}"""

T_SEGMENTS = f"SELECT o_orderkey + 1 AS node_id, 'o' || {text('o_orderkey')} AS name, {tile(text('o_orderkey'))} || {tile(text('o_orderkey + 1'))} AS sequence FROM orders"
T_LINKS = "SELECT o_orderkey AS link_id, o_orderkey AS src, false AS src_rev, o_orderkey + 1 AS dst, false AS dst_rev, '32M' AS cigar, CAST(32 AS BIGINT) AS src_len, CAST(32 AS BIGINT) AS dst_len FROM orders WHERE o_orderkey > 0"
T3_SEGMENTS = f"SELECT o_orderkey + 1 AS node_id, 'o' || {text('o_orderkey')} AS name, {tile(text('o_orderkey'))} || {tile(text('o_orderkey + 1'))} || {tile(text('o_orderkey + 2'))} AS sequence FROM orders"
T3_LINKS = T_LINKS.replace("'32M'", "'64M'").replace("CAST(32", "CAST(64")

#: Orders in a row, with a way over each line item between an order and the next; every third order is stored turned.
_ORDER = "(SELECT a.k, b.k AS following FROM (SELECT o_orderkey AS k FROM orders) AS a LEFT JOIN (SELECT o_orderkey AS k FROM orders) AS b ON b.k = a.k + 1)"
_ITEM = "(SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7)"
B_SEGMENTS = f"""
SELECT CAST(8 * (o_orderkey + 1) AS BIGINT) AS node_id, 'o' || {text("o_orderkey")} AS name, {tile(text("o_orderkey"))} AS sequence FROM orders
UNION ALL SELECT CAST(8 * (k + 1) + n AS BIGINT) AS node_id, 'l' || {text("k")} || '.' || {text("n")} AS name, {tile(text("k") + " || '.' || " + text("n"))} AS sequence FROM {_ITEM} AS i"""
B_LINKS = f"""
SELECT CAST(0 AS BIGINT) AS link_id, CAST(8 * (k + 1) AS BIGINT) AS src, k % 3 = 0 AS src_rev, CAST(8 * (following + 1) AS BIGINT) AS dst, following % 3 = 0 AS dst_rev FROM {_ORDER} AS o WHERE following IS NOT NULL
UNION ALL SELECT CAST(1 AS BIGINT) AS link_id, CAST(8 * (o.k + 1) AS BIGINT) AS src, o.k % 3 = 0 AS src_rev, CAST(8 * (o.k + 1) + n AS BIGINT) AS dst, false AS dst_rev FROM {_ORDER} AS o JOIN {_ITEM} AS i ON o.k = i.k
UNION ALL SELECT CAST(2 AS BIGINT) AS link_id, CAST(8 * (o.k + 1) + n AS BIGINT) AS src, false AS src_rev, CAST(8 * (following + 1) AS BIGINT) AS dst, following % 3 = 0 AS dst_rev FROM {_ORDER} AS o JOIN {_ITEM} AS i ON o.k = i.k WHERE following IS NOT NULL"""


def _tiles(name: str, key: str, n: int) -> str:
    return f"translate({' || '.join(f"md5('{name}{i}' || {text(key)})" for i in range(n))}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


#: Overlaps of medium length: the parts of a junction read its 1,000 to 3,800 bases with 1 missing, 1 changed or 12 more.
MEDIUM_READS = f"""
SELECT j, side, CASE WHEN side % 11 = 0 THEN left(x, 700) || substr(x, 702) WHEN side % 7 = 0 THEN left(x, 500) || CASE WHEN substr(x, 501, 1) = 'A' THEN 'C' ELSE 'A' END || substr(x, 502)
       WHEN side % 5 = 0 THEN left(x, 300) || left({tile("'i' || " + text("j"))}, 12) || substr(x, 301) ELSE x END AS read
FROM (SELECT j, side, left({_tiles("m", "j", 120)}, CAST(1000 + (j * 389) % 2800 AS INT)) AS x FROM (SELECT p_partkey % {M} AS j, p_partkey AS side FROM part) AS a) AS b"""
#: Long overlaps: 12,288 bases with 25 missing, 60 more, or 40 more and perhaps one changed.
_SPUN = " || ".join(f"translate(s, 'ACGT', '{''.join(p)}')" for p in permutations("ACGT"))
LONG_READS = f"""
SELECT j, side, CASE WHEN side % 11 = 0 THEN left(x, 6000) || substr(x, 6026) WHEN side % 7 = 0 THEN left(x, 8000) || left({_tiles("b", "j", 2)}, 60) || substr(x, 8001)
       WHEN side % 5 = 0 THEN left(x, 3000) || left({_tiles("a", "j", 2)}, 40) || substr(x, 3001, 6000) || CASE WHEN side % 3 > 0 THEN substr(x, 9001, 1) WHEN substr(x, 9001, 1) = 'A' THEN 'C' ELSE 'A' END || substr(x, 9002) ELSE x END AS read
FROM (SELECT j, side, {_SPUN} AS x FROM (SELECT p_partkey % {M} AS j, p_partkey AS side, {_tiles("l", f"p_partkey % {M}", 16)} AS s FROM part) AS a) AS b"""

SQL = {"J": (J_SEGMENTS, J_LINKS), "V": (V_SEGMENTS, V_LINKS), "T": (T_SEGMENTS, T_LINKS), "T3": (T3_SEGMENTS, T3_LINKS), "B": (B_SEGMENTS, B_LINKS)}
TABLES = ("part", "supplier", "lineitem", "orders")


def sql(spark: SparkSession, sf_dir: str, query: str, **given: DataFrame) -> DataFrame:
    """A query over the driver's tables, some of which may be given."""
    used = [t for t in TABLES if t in query]
    for t in used:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(query, **{t: given[t] if t in given else table(spark, sf_dir, t) for t in used})


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    """One of the graphs above; links whose SQL says nothing of overlaps have none, and no cigar."""
    segments, links = (sql(spark, sf_dir, q) for q in SQL[name])
    if "src_len" not in links.columns:
        links = links.withColumns({"cigar": F.lit(None).cast("string"), "src_len": F.lit(0).cast("long"), "dst_len": F.lit(0).cast("long")})
    return Graph(segments, links, None)


def views(name: str) -> str:
    """WITH items `segments` and `links` of a graph, for a query in DuckDB."""
    segments, links = SQL[name]
    return f"segments AS ({segments}), links AS ({links})"
