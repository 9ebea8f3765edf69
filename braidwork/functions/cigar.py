"""CIGAR strings as columns.

An alignment is ``array<struct<len:int, op:string>>``.  The source node of a
link is the reference, its sink the query.  Everything here is a composition of
built-in functions, so it stays inside the JVM and next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.sequence import column

#: The operations, and which of them use up reference and query.
OPS = "MIDNSHP=X"
REF_OPS = ("M", "D", "N", "=", "X")
QUERY_OPS = ("M", "I", "S", "=", "X")
BOTH_OPS = ("M", "=", "X")


def is_valid(cigar: Column | str) -> Column:
    """Whether a string is a non-empty run of counted operations."""
    return F.coalesce(column(cigar).rlike(f"^([0-9]+[{OPS}])+$"), F.lit(False))


def parse(cigar: Column | str) -> Column:
    """Operations of a CIGAR; null for a malformed one."""
    found = F.regexp_extract_all(column(cigar), F.lit(f"[0-9]+[{OPS}]"), F.lit(0))
    ops = F.transform(found, lambda o: F.struct(F.substring(o, F.lit(1), F.length(o) - 1).cast("int").alias("len"), F.right(o, F.lit(1)).alias("op")))
    return F.when(is_valid(cigar), ops)


def render(ops: Column | str) -> Column:
    """The string of an alignment."""
    return F.array_join(F.transform(column(ops), lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def _used(ops: Column | str, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(column(ops), F.lit(0).cast("long"), lambda a, o: a + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def ref_length(ops: Column | str) -> Column:
    return _used(ops, REF_OPS)


def query_length(ops: Column | str) -> Column:
    return _used(ops, QUERY_OPS)


def common_length(ops: Column | str) -> Column:
    """Bases of operations that use up both sides."""
    return _used(ops, BOTH_OPS)


def is_exact(ops: Column | str) -> Column:
    """One operation only, and that one M or =."""
    ops = column(ops)
    return F.coalesce((F.size(ops) == 1) & F.get(ops, F.lit(0))["op"].isin("M", "="), F.lit(False))


def swap(cigar: Column | str) -> Column:
    """Insertions for deletions and the other way about; the order stays."""
    return F.translate(column(cigar), "ID", "DI")


def flip(ops: Column | str) -> Column:
    """The alignment seen from the other strand: reversed, with I and D swapped."""
    swapped = lambda o: F.struct(o["len"].alias("len"), F.translate(o["op"], "ID", "DI").alias("op"))
    return F.reverse(F.transform(column(ops), swapped))


def steps(df: DataFrame, ops: str = "ops", keys: tuple[str, ...] = ("link_id",)) -> DataFrame:
    """One row (*keys, col, op, ref_idx, query_idx) for each column of an alignment.

    An index is null where the operation doesn't use up its side.
    """
    spread = df.select(*keys, F.posexplode(ops).alias("k", "o")).select(*keys, "k", F.col("o.op").alias("op"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("o.len"), F.lit(1)))).alias("j"), F.col("o.len").alias("n"))
    spread = spread.where("n > 0")
    order = Window.partitionBy(*keys).orderBy("k", "j")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    ref, query = F.col("op").isin(*REF_OPS), F.col("op").isin(*QUERY_OPS)
    before = lambda used: F.coalesce(F.sum(F.when(used, 1).otherwise(0)).over(so_far), F.lit(0))
    return spread.select(*keys, (F.row_number().over(order) - 1).cast("long").alias("col"), "op", F.when(ref, before(ref)).cast("long").alias("ref_idx"), F.when(query, before(query)).cast("long").alias("query_idx"))


def aligned(df: DataFrame, ops: str = "ops", ref: str = "ref", query: str = "query", keys: tuple[str, ...] = ("link_id",)) -> DataFrame:
    """steps() with the bases ref_base and query_base; ref and query are the overlapping sequences."""
    rows = steps(df, ops, keys).join(df.select(*keys, ref, query), list(keys))
    base = lambda s, i: F.substring(F.col(s), (F.col(i) + 1).cast("int"), F.lit(1))
    return rows.select(*keys, "col", "op", "ref_idx", "query_idx", base(ref, "ref_idx").alias("ref_base"), base(query, "query_idx").alias("query_base"))


def explicit(df: DataFrame, ops: str = "ops", ref: str = "ref", query: str = "query", keys: tuple[str, ...] = ("link_id",)) -> DataFrame:
    """(*keys, cigar) with every M, = and X turned into runs of = and X by the bases themselves."""
    rows = aligned(df, ops, ref, query, keys)
    kind = F.when(F.col("op").isin(*BOTH_OPS), F.when(F.col("ref_base") == F.col("query_base"), "=").otherwise("X")).otherwise(F.col("op"))
    order = Window.partitionBy(*keys).orderBy("col")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("new", F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy(*keys, "run", "kind").agg(F.count("*").alias("n"))
    pieces = F.array_sort(F.collect_list(F.struct("run", F.concat(F.col("n").cast("string"), "kind").alias("s"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias("cigar"))


def drawn(df: DataFrame, ops: str = "ops", ref: str = "ref", query: str = "query", keys: tuple[str, ...] = ("link_id",)) -> DataFrame:
    """(*keys, ref_line, mid_line, query_line): | for a match, * for a mismatch, a space for a gap."""
    rows = aligned(df, ops, ref, query, keys)
    mid = F.when(~F.col("op").isin(*BOTH_OPS), " ").when(F.col("ref_base") == F.col("query_base"), "|").otherwise("*")
    letters = F.struct("col", F.coalesce("ref_base", F.lit("-")).alias("r"), mid.alias("m"), F.coalesce("query_base", F.lit("-")).alias("q"))
    columns = F.array_sort(F.collect_list(letters))
    line = lambda name: F.array_join(F.transform(F.col("columns"), lambda c: c[name]), "")
    return rows.groupBy(*keys).agg(columns.alias("columns")).select(*keys, line("r").alias("ref_line"), line("m").alias("mid_line"), line("q").alias("query_line"))
