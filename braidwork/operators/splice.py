"""From termini and aligned groups to blunt pieces and their links.

Pieces are joined by position: a piece of a node that ends at p is followed by
one that starts at p.  Nothing is changed in place and no order among groups
matters, so each rule is one equi-join.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators import progressive
from braidwork.operators.links import canonical
from braidwork.operators.poa import align_group
from braidwork.operators.progressive import spread_out
from braidwork.operators.traversal import path_offsets


def exact_steps(termini: DataFrame, classes: DataFrame) -> DataFrame:
    """(biclique_id, side, ord, poa, seq): one shared node for groups whose members read the same."""
    mine = termini.join(classes.where("exact").select("biclique_id"), "biclique_id")
    return mine.select("biclique_id", "side", F.lit(0).alias("ord"), F.lit(0).alias("poa"), F.col("read").alias("seq"))


def aligned_steps(termini: DataFrame, classes: DataFrame) -> DataFrame:
    """(biclique_id, side, ord, poa, seq): paths of the members of all other groups, aligned as their tier says; a short or medium group is one task's.

    Members of medium and long groups that read the same are aligned once.
    """

    def solve_medium(rows: pa.Table) -> pa.Table:
        data = sorted(zip(*rows.select(["read", "biclique_id", "rid", "members"]).to_pydict().values(), strict=True))
        nodes, paths = align_group([d[0] for d in data], "medium", [d[3] for d in data])
        flat = [(b, r, k, v, nodes[v]) for (_, b, r, _), p in zip(data, paths, strict=True) for k, v in enumerate(p)]
        kinds = (("biclique_id", pa.string()), ("rid", pa.int64()), ("ord", pa.int32()), ("poa", pa.int32()), ("seq", pa.string()))
        return pa.table({n: pa.array([r[i] for r in flat], kind) for i, (n, kind) in enumerate(kinds)})

    def solve(rows: pa.Table) -> pa.Table:
        data = sorted(zip(*rows.select(["biclique_id", "side", "read"]).to_pydict().values(), strict=True))
        nodes, paths = align_group([r for _, _, r in data], rows.column("tier")[0].as_py())
        flat = [(b, s, k, v, nodes[v]) for (b, s, _), p in zip(data, paths, strict=True) for k, v in enumerate(p)]
        kinds = (("biclique_id", pa.string()), ("side", pa.int64()), ("ord", pa.int32()), ("poa", pa.int32()), ("seq", pa.string()))
        return pa.table({n: pa.array([r[i] for r in flat], kind) for i, (n, kind) in enumerate(kinds)})

    mine = termini.join(classes.where("not exact").select("biclique_id", "tier"), "biclique_id").select("biclique_id", "side", "read", "tier")
    tiers = {r.tier for r in classes.where("not exact").select("tier").distinct().collect()}
    found = []
    if tiers - {"medium", "long"} or not tiers:
        found.append(mine.where("tier not in ('medium', 'long')").groupBy("biclique_id").applyInArrow(solve, "biclique_id string, side bigint, ord int, poa int, seq string"))
    if "medium" in tiers:
        members = mine.where("tier = 'medium'").drop("tier")
        distinct = progressive.distinct_reads(members)
        found.append(progressive.of_members(spread_out(distinct).groupBy("biclique_id").applyInArrow(solve_medium, "biclique_id string, rid bigint, ord int, poa int, seq string"), members, distinct))
    if "long" in tiers:
        found.append(progressive.steps(mine.where("tier = 'long'").drop("tier")))
    return reduce(DataFrame.union, found)


def msa_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, arcs) of aligned rows (grp, name, row) with gaps as "-": a node for each column and base of a group."""
    cells = rows.select("grp", "name", F.posexplode(F.split("row", "")).alias("col", "base")).where("base not in ('-', '')")
    following = F.lead(F.struct("col", "base")).over(Window.partitionBy("grp", "name").orderBy("col"))
    arcs = cells.withColumn("to", following).where("to is not null")
    arcs = arcs.select("grp", "col", "base", F.col("to.col").alias("to_col"), F.col("to.base").alias("to_base")).distinct()
    return cells.select("grp", "col", "base").distinct(), arcs


def crossing(termini: DataFrame) -> DataFrame:
    """(node, size, l_biclique, l_side, s, r_biclique, r_side, x): left and right termini of a node that meet or cross."""
    left = termini.where("end = 0").select("node", "size", F.col("biclique_id").alias("l_biclique"), F.col("side").alias("l_side"), F.col("pos").alias("s"))
    right = termini.where("end = 1").select("node", F.col("biclique_id").alias("r_biclique"), F.col("side").alias("r_side"), F.col("pos").alias("x"))
    return left.join(right, "node").where("s >= x")


def fine_steps(steps: DataFrame, cuts: DataFrame) -> DataFrame:
    """(biclique_id, side, ord, piece, begin, end, seq): steps whose nodes are cut for all paths through them.

    piece names a part of a node; begin and end count along the path.
    """
    placed = path_offsets(steps.withColumns({"path": F.struct("biclique_id", "side"), "size": F.length("seq").cast("long")}))
    hit = placed.join(cuts, ["biclique_id", "side"]).where((F.col("at") > F.col("begin")) & (F.col("at") < F.col("end")))
    offsets = hit.groupBy("biclique_id", "poa").agg(F.collect_set(F.col("at") - F.col("begin")).alias("offsets"))
    rows = placed.join(offsets, ["biclique_id", "poa"], "left")
    points = F.array_sort(F.concat(F.array(F.lit(0).cast("long"), "size"), F.coalesce("offsets", F.array().cast("array<bigint>"))))
    rows = rows.withColumn("points", points)
    parts = F.transform(F.slice(F.col("points"), F.lit(1), F.size("points") - 1), lambda p, i: F.struct(p.alias("a"), F.get("points", i + 1).alias("b")))
    rows = rows.select("biclique_id", "side", "ord", "poa", "begin", "seq", F.posexplode(parts).alias("k", "p"))
    return rows.select(
        "biclique_id", "side", F.struct("ord", "k").alias("ord"), F.concat_ws(":", "biclique_id", "poa", "k").alias("piece"), (F.col("begin") + F.col("p.a")).alias("begin"), (F.col("begin") + F.col("p.b")).alias("end"),
        F.expr("substring(seq, cast(p.a as int) + 1, cast(p.b - p.a as int))").alias("seq"),
    )


def path_links(fine: DataFrame) -> DataFrame:
    """Links within the members' paths."""
    following = F.lead("piece").over(Window.partitionBy("biclique_id", "side").orderBy("ord"))
    rows = fine.select("piece", following.alias("to")).where("to is not null").distinct()
    return rows.select(F.col("piece").alias("src"), F.lit(False).alias("src_rev"), F.col("to").alias("dst"), F.lit(False).alias("dst_rev"))


def shared_steps(members: DataFrame) -> DataFrame:
    """node_steps() of the members of exact groups, with sizes, pos, meets (whether a step may lead to or from its node's other end), to (the path's next piece), first, and seq where first.

    Their members go through one node, cut at the same places, so each step follows from its member.
    """
    inner = F.filter("cuts", lambda p: (p > 0) & (p < F.col("len")))
    rows = members.where("exact").withColumn("points", F.concat(F.array(F.lit(0).cast("long")), inner, F.array("len")))
    parts = F.transform(F.slice(F.col("points"), F.lit(1), F.size("points") - 1), lambda p, i: F.struct(p.alias("begin"), F.get("points", i + 1).alias("end")))
    rows = rows.withColumn("n", F.size("points") - 1).select("node", "size", "start", "stop", "pos", "rev", F.col("end").alias("e"), "biclique_id", "side", "first", "read", "crossed", "n", F.posexplode(parts).alias("k", "p"))
    name = lambda k: F.concat_ws(":", "biclique_id", F.lit(0), k)
    rows = rows.withColumns({"begin": F.col("p.begin"), "end": F.col("p.end"), "piece": name(F.col("k")), "to": F.when(F.col("k") + 1 < F.col("n"), name(F.col("k") + 1))})
    return _on_nodes(rows, "to", "first", F.expr("substring(read, cast(begin as int) + 1, cast(end - begin as int))").alias("seq"))


def aligned_node_steps(fine: DataFrame, members: DataFrame) -> DataFrame:
    """node_steps() of fine_steps(), with sizes, pos and meets as in shared_steps()."""
    at = members.select("biclique_id", "side", "node", "size", "start", "stop", "pos", "rev", F.col("end").alias("e"), "crossed")
    return _on_nodes(fine.select("biclique_id", "side", "piece", "begin", "end").join(at, ["biclique_id", "side"]))


def _on_nodes(rows: DataFrame, *more) -> DataFrame:
    lo = F.when(F.col("rev"), F.col("stop") - F.col("end")).otherwise(F.col("start") + F.col("begin"))
    hi = F.when(F.col("rev"), F.col("stop") - F.col("begin")).otherwise(F.col("start") + F.col("end"))
    at = F.when(F.col("e") == 0, hi).otherwise(lo)
    meets = (at == F.col("pos")) | F.array_contains("crossed", at)
    return rows.select("node", lo.alias("lo"), hi.alias("hi"), "piece", "rev", F.when(F.col("e") == 0, "L").otherwise("R").alias("kind"), "biclique_id", "side", "size", "pos", meets.alias("meets"), *more)


def spine_steps(spine: DataFrame) -> DataFrame:
    """node_steps() of a backbone, with size and pos."""
    return spine.select(
        "node", F.col("start").alias("lo"), F.col("stop").alias("hi"), spine_name().alias("piece"), F.lit(False).alias("rev"), F.lit("B").alias("kind"), F.lit(None).cast("string").alias("biclique_id"), F.lit(None).cast("bigint").alias("side"),
        "size", F.lit(None).cast("bigint").alias("pos"), F.lit(True).alias("meets"),
    )


#: Columns of every step: the piece that stands for an interval of a node's forward strand.  kind: B backbone, L left terminus, R right terminus.  This is the provenance.
STEP = ["node", "lo", "hi", "piece", "rev", "kind", "biclique_id", "side"]


def spine_name(start: str = "start"):
    return F.concat_ws(":", F.lit("n"), "node", start)


def node_links(steps: DataFrame) -> DataFrame:
    """Links between a node's backbone and termini, and between termini that meet or cross; steps with size, pos and meets.

    Steps that end at a place are joined once to those that start there, and only steps that can have such a neighbour.
    """
    a = steps.where("meets and (kind = 'L' or kind = 'B' and lo < hi and hi < size)").select("node", F.col("hi").alias("p"), F.col("piece").alias("src"), F.col("rev").alias("src_rev"), F.when(F.col("kind") == "L", F.col("pos")).alias("s"))
    b = steps.where("meets and (kind = 'R' or kind = 'B' and lo < hi and lo > 0)").select("node", F.col("lo").alias("p"), F.col("piece").alias("dst"), F.col("rev").alias("dst_rev"), F.when(F.col("kind") == "R", F.col("pos")).alias("x"))
    # a null place is the backbone's
    led = F.when(F.col("s").isNull() & F.col("x").isNull(), True).when(F.col("x").isNull(), F.col("p") == F.col("s")).when(F.col("s").isNull(), F.col("p") == F.col("x")).otherwise((F.col("s") >= F.col("x")) & ((F.col("p") == F.col("s")) | (F.col("p") == F.col("x"))))
    return a.join(b, ["node", "p"]).where(led).select("src", "src_rev", "dst", "dst_rev")


def both_strands(links: DataFrame) -> DataFrame:
    """Every link and its other form."""
    turned = links.select(F.col("dst").alias("src"), (~F.col("dst_rev")).alias("src_rev"), F.col("src").alias("dst"), (~F.col("src_rev")).alias("dst_rev"))
    return links.union(turned).distinct()


def full_nodes(crossed: DataFrame) -> DataFrame:
    """(node, size, l_biclique, l_side, r_biclique, r_side): pairs of overlaps, a left and a right one, that both cover their node wholly."""
    return crossed.where("s = size and x = 0").select("node", "size", "l_biclique", "l_side", "r_biclique", "r_side")


def full_node_links(links: DataFrame, steps: DataFrame, crossed: DataFrame) -> DataFrame:
    """Links past nodes that one left and one right overlap cover wholly: what comes before the left path also leads to the right one, and the left path leads to what follows the right one."""
    full = full_nodes(crossed)
    of = lambda which, kind: steps.where(F.col("kind") == kind).select(F.col("biclique_id").alias(f"{which}_biclique"), F.col("side").alias(f"{which}_side"), "lo", "hi", F.col("piece").alias(f"{which}_piece"), F.col("rev").alias(f"{which}_rev"))
    arcs = both_strands(links)
    firsts = full.join(of("l", "L").where("lo = 0").drop("lo", "hi"), ["l_biclique", "l_side"]).join(of("r", "R").where("lo = 0").drop("lo", "hi"), ["r_biclique", "r_side"])
    into = arcs.join(firsts, (F.col("dst") == F.col("l_piece")) & (F.col("dst_rev") == F.col("l_rev"))).select("src", "src_rev", F.col("r_piece").alias("dst"), F.col("r_rev").alias("dst_rev"))
    lasts = full.join(of("l", "L").drop("lo"), ["l_biclique", "l_side"]).where("hi = size").drop("hi").join(of("r", "R").drop("lo"), ["r_biclique", "r_side"]).where("hi = size")
    out = arcs.join(lasts, (F.col("src") == F.col("r_piece")) & (F.col("src_rev") == F.col("r_rev"))).select(F.col("l_piece").alias("src"), F.col("l_rev").alias("src_rev"), "dst", "dst_rev")
    return into.union(out)


def untouched_links(blunt: DataFrame) -> DataFrame:
    """Links of the input that have no overlap, between nodes without termini: these are one piece each, so only numbers are compared."""
    lo, hi = canonical("src", "src_rev", "dst", "dst_rev")
    rows = blunt.select(lo.alias("a"), hi.alias("b")).distinct()
    piece = lambda c: F.concat_ws(":", F.lit("n"), F.shiftright(c, 1), F.lit(0))
    return piece_form(rows.select(piece("a").alias("src"), (F.col("a") % 2 == 1).alias("src_rev"), piece("b").alias("dst"), (F.col("b") % 2 == 1).alias("dst_rev")))


def bypass_links(steps: DataFrame, segments: DataFrame, blunt: DataFrame) -> DataFrame:
    """Links of the input that have no overlap, between the pieces at the ends they join."""
    sized = steps.join(segments.select(F.col("node_id").alias("node"), F.length("sequence").cast("long").alias("size")), "node")
    # A handle leaves its node at the right end, turned at the left one.
    leaving = sized.where("hi = size").select("node", F.lit(False).alias("turn"), "piece", "rev").union(sized.where("lo = 0").select("node", F.lit(True), "piece", ~F.col("rev"))).distinct()
    entering = sized.where("lo = 0").select("node", F.lit(False).alias("turn"), "piece", "rev").union(sized.where("hi = size").select("node", F.lit(True), "piece", ~F.col("rev"))).distinct()
    a = leaving.select(F.col("node").alias("s"), F.col("turn").alias("s_rev"), F.col("piece").alias("src"), F.col("rev").alias("src_rev"))
    b = entering.select(F.col("node").alias("d"), F.col("turn").alias("d_rev"), F.col("piece").alias("dst"), F.col("rev").alias("dst_rev"))
    wanted = blunt.select(F.col("src").alias("s"), F.col("src_rev").alias("s_rev"), F.col("dst").alias("d"), F.col("dst_rev").alias("d_rev"))
    return wanted.join(a, ["s", "s_rev"]).join(b, ["d", "d_rev"]).select("src", "src_rev", "dst", "dst_rev")


def canonical_pieces(links: DataFrame) -> DataFrame:
    """Distinct links, each in one of its two forms."""
    return piece_form(links).distinct()


def piece_form(links: DataFrame, *more: str) -> DataFrame:
    """links (src, src_rev, dst, dst_rev) and more columns, each in one of its two forms."""
    here, there = F.struct("src", "src_rev"), F.struct(F.col("dst").alias("src"), (~F.col("dst_rev")).alias("src_rev"))
    turned = (there < here) | ((there == here) & (F.struct("dst", "dst_rev") > F.struct("src", (~F.col("src_rev")).alias("r"))))
    pick = lambda a, b: F.when(turned, b).otherwise(a)
    return links.select(
        pick(F.col("src"), F.col("dst")).alias("src"), pick(F.col("src_rev"), ~F.col("dst_rev")).alias("src_rev"), pick(F.col("dst"), F.col("src")).alias("dst"), pick(F.col("dst_rev"), ~F.col("src_rev")).alias("dst_rev"), *more
    )
