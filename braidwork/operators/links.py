"""Links of a bidirected graph: canonical form, lookups, sides, degrees, tips, overlays.

A handle is ``2 * node + rev``.  A link a -> b is the same as flip(b) ->
flip(a); its canonical form is the smaller pair.  A side is a handle read as
the right end of that orientation, so a link joins the sides a and flip(b).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import cigar
from braidwork.shared import Written


def handle(node: Column | str, rev: Column | str) -> Column:
    node = F.col(node) if isinstance(node, str) else node
    rev = F.col(rev) if isinstance(rev, str) else rev
    return (2 * node + rev.cast("int")).cast("long")


def flipped(h: Column | str) -> Column:
    return (F.col(h) if isinstance(h, str) else h).bitwiseXOR(F.lit(1))


def canonical(src: str, src_rev: str, dst: str, dst_rev: str) -> tuple[Column, Column]:
    """(first, second) handle of the canonical form."""
    a, b = handle(src, src_rev), handle(dst, dst_rev)
    turned = (flipped(b) < a) | ((flipped(b) == a) & (flipped(a) < b))
    return F.when(turned, flipped(b)).otherwise(a), F.when(turned, flipped(a)).otherwise(b)


def with_handles(links: DataFrame) -> DataFrame:
    """links with a, b (handles) and lo, hi (canonical handles)."""
    lo, hi = canonical("src", "src_rev", "dst", "dst_rev")
    return links.withColumns({"a": handle("src", "src_rev"), "b": handle("dst", "dst_rev"), "lo": lo, "hi": hi})


def canonical_links(links: DataFrame) -> DataFrame:
    """Links in canonical orientation; the cigar is turned with them."""
    rows = with_handles(links).withColumn("turned", F.col("a") != F.col("lo"))
    rows = rows.withColumn("turned", F.col("turned") | (F.col("b") != F.col("hi")))
    ops = F.when(F.col("turned"), cigar.render(cigar.flip(cigar.parse("cigar")))).otherwise(F.col("cigar"))
    return rows.select("link_id", F.col("lo").alias("a"), F.col("hi").alias("b"), ops.alias("cigar"))


def find_links(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """wanted (src, src_rev, dst, dst_rev, ...) with link_id, cigar and lengths of the link, in either form; null where there is none."""
    known = with_handles(links).select("lo", "hi", "link_id", "cigar", "src_len", "dst_len")
    lo, hi = canonical("src", "src_rev", "dst", "dst_rev")
    return wanted.withColumns({"lo": lo, "hi": hi}).join(known, ["lo", "hi"], "left").drop("lo", "hi")


def side_edges(links: DataFrame) -> DataFrame:
    """(link_id, x, y): the sides that a link joins."""
    return links.select("link_id", handle("src", "src_rev").alias("x"), flipped(handle("dst", "dst_rev")).alias("y"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(side, other) in both directions; a loop on one side once."""
    return edges.select(F.col("x").alias("side"), F.col("y").alias("other")).union(edges.where("x <> y").select("y", "x"))


def degrees(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(side, degree) of every side."""
    sides = all_sides(segments)
    counts = both_ways(side_edges(links)).groupBy("side").agg(F.count("*").alias("n"))
    return sides.join(counts, "side", "left").select("side", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def all_sides(segments: DataFrame) -> DataFrame:
    return segments.select(F.explode(F.array(2 * F.col("node_id"), 2 * F.col("node_id") + 1)).alias("side"))


def tips(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, end): ends without a link; end 0 is the left one (a head), 1 the right one (a tail)."""
    used = both_ways(side_edges(links)).select("side").distinct()
    free = all_sides(segments).join(used, "side", "left_anti")
    return free.select(F.expr("side div 2").alias("node_id"), (1 - F.col("side") % 2).cast("int").alias("end"))


def is_single_stranded(links: DataFrame) -> DataFrame:
    """One row, one boolean: no link joins opposite orientations."""
    return links.agg(F.coalesce(F.bool_and(F.col("src_rev") == F.col("dst_rev")), F.lit(True)).alias("single_stranded"))


def without_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The overlay of links that hides those of `gone` (src, src_rev, dst, dst_rev), in either form."""
    lo, hi = canonical("src", "src_rev", "dst", "dst_rev")
    hidden = gone.select(lo.alias("lo"), hi.alias("hi")).distinct()
    return with_handles(links).join(hidden, ["lo", "hi"], "left_anti").select(*links.columns)


#: Positions of a node that one task orders.
STRETCH_BITS = 16


def carried(rows: DataFrame, by: list[str], at: str, tie: str, value: str, once: bool = False) -> DataFrame:
    """Rows without a `value`, with `carried`: the last value up to each, in the order of (at, tie) within `by`; places are whole numbers.

    once: of such rows with the same (by, at, tie) one.  A long node is ordered in
    stretches of its places; what a stretch begins with comes from the last value
    of the stretches before.  Rows are sorted once and written, so a task holds
    one sort; then a row for each stretch is looked at, and only the stretches
    into which something is carried are joined back.
    """
    order = Window.partitionBy(*by, "_stretch").orderBy(at, tie)
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    found = {"carried": F.last(value, ignorenulls=True).over(inside), "_final": F.lead(F.lit(False), 1, True).over(order)}
    again = F.lag(F.lit(True), 1, False).over(order) & F.lag(at).over(order).eqNullSafe(F.col(at)) & (F.lag(tie).over(order) == F.col(tie))
    rows = rows.withColumn("_stretch", F.shiftright(F.col(at), STRETCH_BITS)).withColumns(found | {"_again": again if once else F.lit(False)})
    unknown = F.col(value).isNull() & ~F.col("_again")
    rows = Written(rows.withColumn("_asked", unknown).where("_asked or _final").drop("_again"), "ordered").df
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.where("_final").select(*by, "_stretch", F.last("carried", ignorenulls=True).over(earlier).alias("_begin"))
    begins = Written(begins.where("_begin is not null"), "begins").df
    rows = rows.where("_asked")
    if not begins.isEmpty():
        rows = rows.join(begins, [*by, "_stretch"], "left").withColumn("carried", F.coalesce("carried", "_begin")).drop("_begin")
    return rows.drop("_stretch", "_final", "_asked")


def neighbours_at(positions: DataFrame, others: DataFrame, how: str = "le") -> DataFrame:
    """Range lookup: for each (node, pos) the nearest other_pos of others (node, other_pos).

    how: lt, le (the largest below), gt, ge (the smallest above).  Null where
    there is none.  Both sides are put in one order and the last position is
    carried on, so no pairs are made; looking up, the order is turned round.
    """
    if how not in ("lt", "le", "gt", "ge"):
        raise ValueError(how)
    sign = 1 if how[0] == "l" else -1
    first = 0 if how[1] == "e" else 1  # whether an equal position counts, so comes before
    asked = positions.select("node", (F.col("pos") * sign).cast("long").alias("p"), F.lit(1 - first).alias("tie"), F.lit(None).cast("long").alias("other"))
    known = others.where("other_pos is not null").select("node", (F.col("other_pos") * sign).cast("long").alias("p"), F.lit(first).alias("tie"), F.col("other_pos").cast("long").alias("other"))
    rows = carried(asked.union(known), ["node"], "p", "tie", "other", once=True)
    return rows.select("node", (F.col("p") * sign).alias("pos"), F.col("carried").alias("other_pos"))


def splice_sites(links: DataFrame, group: str = "biclique_id") -> DataFrame:
    """(node, group, link_id) of every link at its nodes; a self-link once."""
    return links.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), group, "link_id")


def overlap_sequences(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(link_id, ops, ref, query): a link's alignment and the two stretches it joins."""
    from braidwork.functions.sequence import oriented

    at = lambda which: segments.select(F.col("node_id").alias(which), F.col("sequence").alias(f"{which}_seq"))
    rows = links.join(at("src"), "src").join(at("dst"), "dst")
    ref = F.expr("right(s, cast(src_len as int))")
    query = F.expr("left(d, cast(dst_len as int))")
    rows = rows.select("link_id", cigar.parse("cigar").alias("ops"), "src_len", "dst_len", oriented("src_seq", "src_rev").alias("s"), oriented("dst_seq", "dst_rev").alias("d"))
    return rows.select("link_id", "ops", ref.alias("ref"), query.alias("query"))
