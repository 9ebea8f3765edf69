"""Which stretch of which node end takes part in which group.

A group (biclique) has left members, whose sides are read out of their node,
and right members, read into it; the longest overlap of a side in a group says
how much of the end takes part.  End 0 is the left one of the forward node: a
left terminus covers [0, s), a right one [x, size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import cigar
from braidwork.functions.sequence import revcomp
from braidwork.operators.links import flipped, handle

SHORT, MEDIUM = 250, 10_000


def group_links(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """(biclique_id, link_id, l_side, r_side, l_len, r_len, ops): links turned as their group reads them."""
    pairs = assigned.withColumns({"p": F.least("l_side", "r_side"), "q": F.greatest("l_side", "r_side")})
    return turned(pairs.join(by_sides(links), ["p", "q"]))


def by_sides(links: DataFrame) -> DataFrame:
    """(link_id, x, y, src_len, dst_len, cigar, p, q): the sides that a link with overlaps joins, and the smaller and the larger of them."""
    rows = links.select("link_id", handle("src", "src_rev").alias("x"), flipped(handle("dst", "dst_rev")).alias("y"), "src_len", "dst_len", "cigar")
    return rows.withColumns({"p": F.least("x", "y"), "q": F.greatest("x", "y")})


def turned(dealt: DataFrame) -> DataFrame:
    """group_links() of by_sides() with the group, its left and its right side."""
    rows = dealt.withColumn("ops", cigar.parse("cigar"))
    same = F.col("l_side") == F.col("x")
    return rows.select(
        "biclique_id", "link_id", "l_side", "r_side", F.when(same, F.col("src_len")).otherwise(F.col("dst_len")).alias("l_len"), F.when(same, F.col("dst_len")).otherwise(F.col("src_len")).alias("r_len"),
        F.when(same, F.col("ops")).otherwise(cigar.flip("ops")).alias("ops"),
    )


def factored(grouped: DataFrame) -> DataFrame:
    """(biclique_id, side, is_left, link_id, len): overlaps by side and group."""
    left = grouped.select("biclique_id", F.col("l_side").alias("side"), F.lit(True).alias("is_left"), "link_id", F.col("l_len").alias("len"))
    return left.union(grouped.select("biclique_id", "r_side", F.lit(False), "link_id", "r_len"))


def sorted_overlaps(grouped: DataFrame) -> DataFrame:
    """factored() with rank: longest first within a side and group."""
    w = Window.partitionBy("biclique_id", "side").orderBy(F.desc("len"), "link_id")
    return factored(grouped).withColumn("rank", F.row_number().over(w))


def extents(grouped: DataFrame) -> DataFrame:
    """(node, end, biclique_id, side, is_left, len, rank): longest overlap of each side in each group, ranked within an end."""
    most = factored(grouped).groupBy("biclique_id", "side", "is_left").agg(F.max("len").alias("len"))
    rows = most.select(F.expr("side div 2").alias("node"), (1 - F.col("side") % 2).cast("int").alias("end"), "biclique_id", "side", "is_left", "len")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("node", "end").orderBy(F.desc("len"), "biclique_id")))


def termini(extents: DataFrame, segments: DataFrame) -> DataFrame:
    """extents() with size, start, stop, pos (where the rest of the node begins or ends), rev (whether the group reads it backwards) and its sequence as read."""
    return placed(extents.join(segments.select(F.col("node_id").alias("node"), "sequence"), "node").withColumn("size", F.length("sequence").cast("long")))


def placed(rows: DataFrame) -> DataFrame:
    """termini() of extents with size and sequence of their node."""
    at_left = F.col("end") == 0
    rows = rows.withColumn("start", F.when(at_left, F.lit(0).cast("long")).otherwise(F.col("size") - F.col("len")))
    rows = rows.withColumn("stop", F.when(at_left, F.col("len")).otherwise(F.col("size")))
    rows = rows.withColumn("pos", F.when(at_left, F.col("stop")).otherwise(F.col("start")))
    rows = rows.withColumn("rev", F.when(F.col("is_left"), F.col("side") % 2 == 1).otherwise(F.col("side") % 2 == 0))
    cut = F.expr("substring(sequence, cast(start as int) + 1, cast(len as int))")
    return rows.withColumn("read", F.when(F.col("rev"), revcomp(cut)).otherwise(cut)).drop("sequence")


def nodes_with_ends(segments: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """(node, size, sequence, ends): each node with its extents; plain and longest tell what group_classes asks of the links behind one.

    The overlaps are dealt by node before they are put together, so they are
    shuffled once, and whatever looks at one node alone needs no shuffle after.
    """
    nodes = segments.select(F.col("node_id").alias("node"), F.length("sequence").cast("long").alias("size"), "sequence")
    none = F.array().cast("array<struct<end:int,biclique_id:string,side:bigint,is_left:boolean,len:bigint,plain:boolean,longest:bigint>>")
    if grouped is None:
        return nodes.withColumn("ends", none)
    links = grouped.select("biclique_id", "l_side", "r_side", "l_len", "r_len", cigar.is_exact("ops").alias("plain"))
    member = lambda side, is_left, own: F.struct(F.col(side).alias("side"), F.lit(is_left).alias("is_left"), F.col(own).alias("len"))
    rows = links.select("biclique_id", "plain", F.greatest("l_len", "r_len").alias("longest"), F.explode(F.array(member("l_side", True, "l_len"), member("r_side", False, "r_len"))).alias("m"))
    rows = rows.select(F.expr("m.side div 2").alias("node"), "biclique_id", "m.side", "m.is_left", "m.len", "plain", "longest").repartition("node")
    most = rows.groupBy("node", "biclique_id", "side", "is_left").agg(F.max("len").alias("len"), F.bool_and("plain").alias("plain"), F.max("longest").alias("longest"))
    most = most.withColumn("end", (1 - F.col("side") % 2).cast("int"))
    ends = most.groupBy("node").agg(F.collect_list(F.struct("end", "biclique_id", "side", "is_left", "len", "plain", "longest")).alias("ends"))
    return nodes.join(ends, "node", "left").withColumn("ends", F.coalesce("ends", none))


def members(nodes: DataFrame) -> DataFrame:
    """The members of all groups: placed() extents of nodes_with_ends() with exact and tier as in group_classes, first (of its group), crossed (where ends from the node's other side cut it) and cuts (where the group's nodes are cut, along the path of a group that is exact).

    An exact group's reads are kept with its first member only.
    """
    at = lambda end, pos: F.array_distinct(F.transform(F.filter("ends", lambda e: e["end"] == end), pos))
    rows = nodes.select("node", "size", "sequence", at(0, lambda e: e["len"]).alias("s"), at(1, lambda e: F.col("size") - e["len"]).alias("x"), F.explode("ends").alias("e")).select("node", "size", "sequence", "s", "x", "e.*")
    rows = placed(rows)
    at_left = F.filter("x", lambda p: (p > 0) & (p < F.col("pos")))
    at_right = F.filter("s", lambda p: (p > F.col("pos")) & (p < F.col("size")))
    rows = rows.withColumn("crossed", F.when(F.col("end") == 0, at_left).otherwise(at_right)).drop("s", "x")
    along = F.transform("crossed", lambda p: F.when(F.col("rev"), F.col("stop") - p).otherwise(p - F.col("start")))
    rows = rows.withColumn("along", along)
    group = Window.partitionBy("biclique_id")
    longest = F.max("longest").over(group)
    rows = rows.withColumns({
        "exact": F.bool_and("plain").over(group) & (F.min("read").over(group) == F.max("read").over(group)),
        "tier": F.when(longest <= SHORT, "short").when(longest <= MEDIUM, "medium").otherwise("long"),
        "cuts": F.array_sort(F.array_distinct(F.flatten(F.collect_list("along").over(group)))),
        "first": F.col("side") == F.min("side").over(group),
    })
    return rows.withColumn("read", F.when(F.col("first") | ~F.col("exact"), F.col("read"))).drop("plain", "longest")


def overlapping_nodes(termini: DataFrame) -> DataFrame:
    """(node, left_max, right_max) of nodes whose longest left and right overlaps cross."""
    rows = termini.groupBy("node", "size").agg(F.max(F.when(F.col("end") == 0, F.col("len"))).alias("left_max"), F.max(F.when(F.col("end") == 1, F.col("len"))).alias("right_max"))
    return rows.where(F.col("left_max") + F.col("right_max") > F.col("size")).select("node", "left_max", "right_max")


def backbone(segments: DataFrame, termini: DataFrame) -> DataFrame:
    """(node, start, stop, sequence): what lies between the shortest left and the shortest right terminus, cut where any terminus begins or ends.

    A node without termini is one piece.
    """
    ends = termini.groupBy("node").agg(F.collect_set(F.when(F.col("end") == 0, F.col("pos"))).alias("s"), F.collect_set(F.when(F.col("end") == 1, F.col("pos"))).alias("x"))
    rows = segments.select(F.col("node_id").alias("node"), "sequence", F.length("sequence").cast("long").alias("size")).join(ends, "node", "left")
    none = F.array().cast("array<bigint>")
    return spines(rows.withColumns({"s": F.coalesce("s", none), "x": F.coalesce("x", none)})).select("node", "start", "stop", "sequence")


def spines(rows: DataFrame) -> DataFrame:
    """(node, start, stop, sequence, size): backbone() of nodes (node, size, sequence) with the places s of their left termini and x of their right ones."""
    rows = rows.withColumn("low", F.coalesce(F.array_min("s"), F.lit(0))).withColumn("high", F.coalesce(F.array_max("x"), F.col("size")))
    points = F.array_sort(F.array_distinct(F.filter(F.concat("s", "x", F.array("low", "high")), lambda p: (p >= F.col("low")) & (p <= F.col("high")))))
    rows = rows.where("low < high or size = 0").withColumn("points", points)
    spans = F.transform(F.slice(F.col("points"), F.lit(1), F.greatest(F.size("points") - 1, F.lit(1))), lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get("points", i + 1), p).alias("b")))
    cut = rows.select("node", "sequence", "size", F.explode(spans).alias("p"))
    return cut.select("node", F.col("p.a").alias("start"), F.col("p.b").alias("stop"), F.expr("substring(sequence, cast(p.a as int) + 1, cast(p.b - p.a as int))").alias("sequence"), "size")


def group_classes(grouped: DataFrame, termini: DataFrame) -> DataFrame:
    """(biclique_id, exact, tier): whether all members read the same by plain matches, and how long their overlaps are."""
    plain = grouped.groupBy("biclique_id").agg(F.bool_and(cigar.is_exact("ops")).alias("plain"), F.max(F.greatest("l_len", "r_len")).alias("longest"))
    alike = termini.groupBy("biclique_id").agg((F.min("read") == F.max("read")).alias("alike"))
    tier = F.when(F.col("longest") <= SHORT, "short").when(F.col("longest") <= MEDIUM, "medium").otherwise("long")
    return plain.join(alike, "biclique_id").select("biclique_id", (F.col("plain") & F.col("alike")).alias("exact"), tier.alias("tier"))
