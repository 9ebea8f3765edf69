"""Walks over bidirected graphs: components, neighbourhoods, orders, orientations, chopping and merging.

Loops over rounds run on the driver; each round is a join over narrow tables
written to the shared folder, never a collected frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.sequence import revcomp
from braidwork.operators.components import connected_components
from braidwork.operators.links import all_sides, both_ways, carried, flipped, handle, side_edges
from braidwork.operators.orders import Cyclic, order
from braidwork.shared import Written, fresh_path


def adjacency_components(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(side, component) of every side; component is its smallest side, an unlinked side its own."""
    found = connected_components(side_edges(links), "x", "y")
    return all_sides(segments).join(found, F.col("side") == F.col("node"), "left").select("side", F.coalesce("component", "side").alias("component"))


def node_components(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, component): nodes joined by links of any strand; component is the smallest node."""
    found = connected_components(links, "src", "dst")
    return segments.select("node_id").join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def neighbourhood(links: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """(node, distance) of nodes within `radius` links of the start nodes (column node)."""
    pairs = links.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    pairs = Written(pairs.union(pairs.select("next", "node")).where("node <> next").distinct(), "pairs").df
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    for k in range(1, radius + 1):
        rim = seen.where(F.col("distance") == k - 1).join(pairs, "node").select(F.col("next").alias("node")).distinct()
        fresh = rim.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(k))
        seen = Written(seen.union(fresh), "reached").df
        if not seen.where(F.col("distance") == k).limit(1).count():
            break
    return seen


def extract_subgraph(segments: DataFrame, links: DataFrame, name: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Segments within the radius of a named one, and the links among them that the walk crosses.

    A link between two rim nodes belongs to it only if walking on from inside
    would cross it, so only links with an end nearer than the radius, and links
    between reached nodes of the rim, are given: all links of reached nodes.
    """
    start = segments.where(F.col("name") == name).select(F.col("node_id").alias("node"))
    if not start.limit(1).count():
        raise KeyError(f"no segment {name}")
    near = neighbourhood(links, start, radius).select("node")
    inside = segments.join(near, F.col("node_id") == F.col("node"), "left_semi")
    found = links.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside, found.select(*links.columns)


def subgraph_name(path: str, start: str, radius: int) -> str:
    """Name of the file that a subgraph is written to."""
    return f"{path.removesuffix('.gfa')}.subgraph_{start}_{radius}.gfa"


def orientations(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(node_id, component, flip, orientable): how to turn nodes so that no link joins opposite strands.

    Nodes are doubled into their two strands and a link joins the strands that
    agree; a component is contradictory if it holds both strands of a node.
    The smallest node of a component keeps its strand.
    """
    same = links.select(handle("src", "src_rev").alias("p"), handle("dst", "dst_rev").alias("q"))
    doubled = same.union(same.select(flipped("p"), flipped("q")))
    found = connected_components(doubled, "p", "q")
    strands = all_sides(segments).join(found, F.col("side") == F.col("node"), "left").select("side", F.coalesce("component", "side").alias("root"))
    of_node = strands.select(F.expr("side div 2").alias("node_id"), (F.col("side") % 2).alias("strand"), "root")
    pair = of_node.groupBy("node_id").agg(F.min("root").alias("root"), (F.min("root") != F.max("root")).alias("orientable"), F.min_by("strand", "root").alias("strand"))
    # The two copies of a component have the roots 2r and 2r + 1; the strand in the copy of 2r is the one to keep.
    return pair.select("node_id", F.expr("root div 2").alias("component"), F.when(F.col("orientable"), F.col("strand") == 1).alias("flip"), "orientable")


def apply_orientations(segments: DataFrame, links: DataFrame, flips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the nodes of `flips` (node_id) turned."""
    turned = flips.select("node_id").distinct().withColumn("_t", F.lit(True))
    s = segments.join(turned, "node_id", "left")
    s = s.withColumn("sequence", F.when(F.col("_t"), revcomp("sequence")).otherwise(F.col("sequence"))).select(*segments.columns)
    at = lambda which: turned.select(F.col("node_id").alias(which), F.col("_t").alias(f"_{which}"))
    moved = links.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    toggled = lambda which: F.col(f"{which}_rev") != F.coalesce(F.col(f"_{which}"), F.lit(False))
    return s, moved.withColumns({"src_rev": toggled("src"), "dst_rev": toggled("dst")}).select(*links.columns)


def make_single_stranded(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with every orientable component on one strand."""
    return apply_orientations(segments, links, orientations(segments, links).where("flip"))


def topological_order(segments: DataFrame, links: DataFrame, strict: bool = False) -> DataFrame:
    """(node_id, rev, level): an order of oriented nodes in which links go forward wherever the graph allows it.

    Nodes are oriented by orientations(); `level`, which has gaps, and then
    `node_id` order the nodes, see orders.order.  Of a cycle, arcs into one node
    go backward; strict raises orders.Cyclic instead, and for nodes that can't be
    oriented and loops too.
    """
    turns = Written(orientations(segments, links), "turns").df
    if strict and not turns.where("not orientable").isEmpty():
        raise Cyclic("the graph can't be oriented")
    flips = turns.select("node_id", F.coalesce("flip", F.lit(False)).alias("rev"))
    turn = lambda which: flips.select(F.col("node_id").alias(which), F.col("rev").alias(f"{which}_turn"))
    rows = links.join(turn("src"), "src").join(turn("dst"), "dst")
    forward = F.col("src_rev") == F.col("src_turn")
    arcs = rows.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))
    found = order(segments.select(F.col("node_id").alias("v")), arcs, strict)
    return flips.join(found, F.col("node_id") == F.col("v")).select("node_id", "rev", "level")


def source_sink_paths(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(path): "1+,2-" for every walk from a head to a tail that repeats no oriented node, however long.

    No walk repeats a node, so the rounds end; each takes one step of all walks.
    """
    arcs = links.select(handle("src", "src_rev").alias("h"), handle("dst", "dst_rev").alias("n"))
    arcs = Written(arcs.union(arcs.select(flipped("n"), flipped("h"))).distinct(), "arcs").df
    handles = all_sides(segments).withColumnRenamed("side", "h")
    heads = handles.join(arcs.select(F.col("n").alias("h")), "h", "left_anti").where("h % 2 = 0")
    tails = Written(handles.join(arcs.select("h"), "h", "left_anti"), "tails").df
    walks = Written(heads.select(F.array("h").alias("steps")), "walks")
    ends = fresh_path(segments.sparkSession, "ends")
    while True:
        now = walks.df.withColumn("h", F.element_at("steps", -1))
        now.join(tails, "h", "left_semi").select("steps").write.mode("append").parquet(ends)
        on = now.join(arcs, "h").where(~F.array_contains("steps", F.col("n")))
        was, walks = walks, Written(on.select(F.concat("steps", F.array("n")).alias("steps")), "walks")
        was.drop()
        if walks.df.isEmpty():
            break
    found = segments.sparkSession.read.schema(walks.df.schema).parquet(ends)
    step = lambda h: F.concat(F.floor(h / 2).cast("long").cast("string"), F.when(h % 2 == 1, "-").otherwise("+"))
    return found.select(F.array_join(F.transform("steps", step), ",").alias("path"))


def append(segments: DataFrame, links: DataFrame, more_segments: DataFrame, more_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of both; the second one's node and link ids are shifted past the first one's."""
    segments, links, _ = append_with_paths(segments, links, None, more_segments, more_links, None)
    return segments, links


def _renamed(more: DataFrame, taken: DataFrame, name: str, tag: Column) -> DataFrame:
    """more, whose names that `taken` has too go on with "/" and the tag, or if that is taken with the next number that makes them new."""
    mine = more.select(F.col(name).alias("_old"), tag.cast("string").alias("_tag")).distinct()
    used = Written(taken.select(F.col(name).alias("_used")).distinct(), "names").df
    wanted = Written(mine.join(used, F.col("_old") == F.col("_used"), "left_semi").withColumn("_wanted", F.concat_ws("/", "_old", "_tag")), "wanted").df
    used = used.union(mine.select("_old")).distinct()
    stem, number = F.regexp_extract("_used", "^(.*)/([0-9]{1,9})$", 1), F.regexp_extract("_used", "^(.*)/([0-9]{1,9})$", 2)
    highest = used.where(number != "").groupBy(stem.alias("_stem")).agg(F.max(number.cast("long")).alias("_n"))
    rows = wanted.join(used.withColumn("_hit", F.lit(True)), F.col("_wanted") == F.col("_used"), "left").join(highest, F.col("_old") == F.col("_stem"), "left")
    new = Written(rows.select("_old", F.when(F.col("_hit"), F.concat_ws("/", "_old", (F.col("_n") + 1).cast("string"))).otherwise(F.col("_wanted")).alias("_new")), "renamed").df
    return more.join(new, F.col(name) == F.col("_old"), "left").withColumn(name, F.coalesce("_new", name)).drop("_old", "_new")


def append_with_paths(segments: DataFrame, links: DataFrame, paths: DataFrame | None, more_segments: DataFrame, more_links: DataFrame, more_paths: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One graph of both with the paths of both; see append.

    A segment's name that the first graph has too goes on with "/" and its new id,
    a path's with "/2"; if that is taken, with the next number that neither has.
    """
    top = lambda df, c: df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0]
    shift, link_shift = top(segments, "node_id"), top(links, "link_id") if "link_id" in links.columns else 0
    moved = more_segments.withColumn("node_id", F.col("node_id") + shift)
    if "name" in segments.columns and "name" in moved.columns:
        moved = _renamed(moved, segments, "name", F.col("node_id"))
    moved_links = more_links.withColumns({"src": F.col("src") + shift, "dst": F.col("dst") + shift})
    if "link_id" in more_links.columns:
        moved_links = moved_links.withColumn("link_id", F.col("link_id") + link_shift)
    if more_paths is not None:
        more_paths = more_paths.withColumn("node_id", F.col("node_id") + shift)
        if paths is not None:
            more_paths = _renamed(more_paths, paths, "path", F.lit(2))
            more_paths = paths.unionByName(more_paths, allowMissingColumns=True)
    return segments.unionByName(moved, allowMissingColumns=True), links.unionByName(moved_links, allowMissingColumns=True), paths if more_paths is None else more_paths


def chop(segments: DataFrame, most: int) -> DataFrame:
    """(node_id, part, sequence): nodes cut at multiples of `most`; consecutive parts are linked."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("sequence") - 1, F.lit(0)), F.lit(most)))
    rows = segments.select("node_id", "sequence", starts.alias("at"))
    return rows.select("node_id", (F.col("at") / most).cast("long").alias("part"), F.expr(f"substring(sequence, at + 1, {int(most)})").alias("sequence"))


def chop_graph(segments: DataFrame, links: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(segments, links) named "<node_id>:<part>"; outer links join the first and last parts."""
    parts = chop(segments, most)
    name = lambda node, part: F.concat(node.cast("string"), F.lit(":"), part.cast("string"))
    last = segments.select("node_id", F.expr(f"greatest(length(sequence) - 1, 0) div {int(most)}").alias("last"))
    inner = parts.where("part > 0").select(name(F.col("node_id"), F.col("part") - 1).alias("src_name"), F.lit(False).alias("src_rev"), name(F.col("node_id"), F.col("part")).alias("dst_name"), F.lit(False).alias("dst_rev"))
    ends = lambda which: last.select(F.col("node_id").alias(which), F.col("last").alias(f"{which}_last"))
    outer = links.join(ends("src"), "src").join(ends("dst"), "dst")
    zero = F.lit(0).cast("long")
    outer = outer.select(
        name(F.col("src"), F.when(F.col("src_rev"), zero).otherwise(F.col("src_last"))).alias("src_name"), "src_rev", name(F.col("dst"), F.when(F.col("dst_rev"), F.col("dst_last")).otherwise(zero)).alias("dst_name"), "dst_rev"
    )
    return parts.select(name(F.col("node_id"), F.col("part")).alias("name"), "sequence"), inner.union(outer)


def chop_paths(parts: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, ord, name, rev): paths (path, ord, node_id, rev) over the parts (node_id, part) that chop() cut; ord is a struct."""
    last = parts.groupBy("node_id").agg(F.max("part").alias("last"))
    rows = paths.join(last, "node_id").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    part = F.when(F.col("rev"), F.col("last") - F.col("k")).otherwise(F.col("k"))
    return rows.select("path", F.struct("ord", "k").alias("ord"), F.concat(F.col("node_id").cast("string"), F.lit(":"), part.cast("string")).alias("name"), "rev")


def passes(paths: DataFrame) -> DataFrame:
    """(node, l, r): for each step of paths (path, ord, node_id, rev) the sides that the node's left and right ones are passed to, a side itself where the path begins or ends."""
    order = Window.partitionBy("path").orderBy("ord")
    h = handle("node_id", "rev")
    steps = paths.select(F.col("node_id").alias("node"), "rev", F.lag(h).over(order).alias("was"), flipped(F.lead(h).over(order)).alias("next"))
    right, left = 2 * F.col("node"), 2 * F.col("node") + 1
    to = lambda forward, backward, own: F.coalesce(F.when(F.col("rev"), F.col(backward)).otherwise(F.col(forward)), own)
    return steps.select("node", to("was", "next", left).alias("l"), to("next", "was", right).alias("r"))


def unchop_paths(segments: DataFrame, links: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains, links, paths): runs that every path goes through as a whole, links between them, and paths (path, ord, chain, rev) over them that spell what they did."""
    chains, left = unchop_graph(segments, links, passes(paths))
    # a path enters a run at its first node, or turned at its last one
    enters = chains.select(F.element_at("nodes", 1).alias("h"), "chain", F.lit(False).alias("rev")).union(chains.select(flipped(F.element_at("nodes", -1)), "chain", F.lit(True)))
    steps = paths.select("path", "ord", handle("node_id", "rev").alias("h")).join(enters, "h")
    order = F.row_number().over(Window.partitionBy("path").orderBy("ord")) - 1
    return chains, left, steps.select("path", order.alias("ord"), "chain", "rev")


#: Nodes whose ids differ in so many last bits only are merged where they lie; and how many nodes a task gets.
NEAR_BITS, NODES_A_TASK = 12, 1 << 19


def _pieces(segments: DataFrame, links: DataFrame, passed: DataFrame | None) -> DataFrame:
    """(id, last, l, r, nodes, sequence): runs of nodes with ascending near ids, from node id to node last, and the only sides that their ends lead to, if any.

    A side leads on if it has one link and no path in `passed` (node, l, r) goes
    or ends elsewhere.  Links, steps and sequences are dealt by stretches of ids
    in one shuffle; sides are kept as differences, which compress.
    """
    node, own = F.shiftright("side", 1), F.col("side").bitwiseAND(F.lit(1))
    away = F.col("other") - 2 * node
    rows = both_ways(side_edges(links)).select(node.alias("node"), F.when(own == 1, away).alias("l"), F.when(own == 0, away).alias("r"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("s"))
    nothing = F.lit(None).cast("long")
    rows = rows.union(segments.select(F.col("node_id").cast("long"), nothing, nothing, F.lit(2), "sequence"))
    if passed is not None:
        rows = rows.union(passed.select("node", F.col("l") - 2 * F.col("node"), F.col("r") - 2 * F.col("node"), F.lit(0), F.lit(None).cast("string")))
    rows = rows.withColumn("near", F.shiftright("node", NEAR_BITS))
    tasks = segments.count() // NODES_A_TASK
    rows = rows.repartition(tasks, "near") if tasks > int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("near")

    def leads(c: str, itself: int) -> Column:
        once = F.count(F.when(F.col("kind") == 1, F.col(c))) == 1
        return F.when(once & (F.min(c) == F.max(c)) & (F.min(c) != itself), F.min(c)).alias(c)

    nodes = rows.groupBy("near", "node").agg(leads("l", 1), leads("r", 0), F.max("s").alias("s"), F.max("kind").alias("kind")).where("kind = 2")
    order = Window.partitionBy("near").orderBy("node")
    step = 2 * (F.col("node") - F.lag("node").over(order))
    goes_on = F.coalesce((F.lag("r").over(order) == step + 1) & (F.col("l") == -step), F.lit(False))
    nodes = nodes.withColumn("goes_on", goes_on).withColumn("id", F.last(F.when(~F.col("goes_on"), F.col("node")), ignorenulls=True).over(order))
    found = nodes.groupBy("near", "id").agg(
        F.max("node").alias("last"), F.min_by(2 * F.col("node") + F.col("l"), "node").alias("l"), F.max_by(2 * F.col("node") + F.col("r"), "node").alias("r"), F.array_sort(F.collect_list(F.struct("node", "s"))).alias("x")
    )
    return found.select("id", "last", "l", "r", F.transform("x", lambda x: 2 * x["node"]).alias("nodes"), F.array_join(F.transform("x", lambda x: x["s"]), "").alias("sequence"))


def _ranked(arcs: DataFrame) -> DataFrame:
    """(first, h, d): the first handle of each handle's run and its place there, by pointer doubling over arcs (h, n), one at most from and to each handle.

    A run with handles that don't know their first yet has one that learns it in
    the next round; if none does and no smallest handle changes any more, what is
    left are circles, which know their smallest.  They are cut before it, their
    mirror images, whose smallest is odd, at the same link.
    """
    starts = arcs.select("h").join(arcs.select(F.col("n").alias("h")), "h", "left_anti")
    zero = F.lit(0).cast("long")
    state = starts.select("h", F.col("h").alias("to"), zero.alias("d"), F.col("h").alias("low"), F.lit(True).alias("done"), F.lit(False).alias("moved"))
    state = Written(state.union(arcs.select("n", "h", zero + 1, "n", F.lit(False), F.lit(True))), "chain").df
    while not state.where("moved").isEmpty():
        ahead = state.select(F.col("h").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        on = state.where("not done").join(ahead, "to")
        on = on.select("h", F.col("to2").alias("to"), F.col("d") + F.col("d2"), F.least("low", "low2"), "done2", F.col("done2") | (F.col("low2") < F.col("low")))
        state = Written(state.where("done").withColumn("moved", F.lit(False)).union(on), "chain").df
    runs = state.where("done").select(F.col("to").alias("first"), "h", "d")
    circles = state.where("not done")
    if circles.isEmpty():
        return runs
    begin = Written(circles.where("low % 2 = 0").select("low").distinct(), "begin").df
    left = arcs.join(circles.select("h"), "h", "left_semi").select("h", "n")
    left = left.join(begin.select(F.col("low").alias("n")), "n", "left_anti").join(begin.select(flipped("low").alias("h")), "h", "left_anti")
    return runs.union(_ranked(Written(left.select("h", "n"), "arcs").df))


def unchop(segments: DataFrame, links: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """(chain, sequence, nodes): maximal runs of nodes without a branch, spelled out; other nodes by themselves.

    A link is inside a run if it is the only one at both of its sides and every
    path that visits one of them, as passes() gives it, goes through it.  Nodes
    that follow each other in the order of near ids are merged where they lie;
    only the pieces that lead on from there are labelled by pointer doubling from
    their first handle, so the rounds are the logarithm of the longest run.
    Circular runs start at their smallest node.  A run is given in the direction
    in which its first node's id is below its last one's, a single node forwards.
    """
    pieces = Written(_pieces(segments, links, passed), "pieces").df
    at_end = lambda h, first, last, other: F.struct(h.alias("h"), first.alias("first"), last.alias("last"), F.col(other).alias("other"))
    forward, back = 2 * F.col("id"), 2 * F.col("last") + 1
    ends = pieces.select(F.explode(F.array(at_end(forward, forward, 2 * F.col("last"), "r"), at_end(forward + 1, back, forward + 1, "l"))).alias("e")).select("e.*").where("other is not null")
    a = ends.select("h", F.col("first").alias("h_first"), F.col("last").alias("x"), F.col("other").alias("y"))
    b = ends.select(flipped("h").alias("n"), flipped("first").alias("n_last"), F.col("last").alias("y"), F.col("other").alias("x"))
    arcs = Written(a.join(b, ["x", "y"]).where("h <> n").select("h", "h_first", "n", "n_last"), "arcs").df
    chain = lambda some: some.select(forward.alias("chain"), "sequence", "nodes")
    if arcs.isEmpty():
        return chain(pieces)
    runs = Written(_ranked(arcs), "runs").df
    # Each run is there twice, once in each direction.
    tips = runs.groupBy("first").agg(F.max_by("h", "d").alias("end"))
    tips = tips.join(arcs.select(F.col("h").alias("first"), F.col("h_first").alias("chain")), "first").join(arcs.select(F.col("n").alias("end"), flipped("n_last").alias("mirror")), "end")
    kept = tips.where((F.col("chain") < F.col("mirror")) | ((F.col("chain") == F.col("mirror")) & (F.col("chain") % 2 == 0))).select("first", "chain")
    placed = runs.join(kept, "first").select(F.shiftright("h", 1).alias("id"), "chain", "d", (F.col("h").bitwiseAND(F.lit(1)) == 1).alias("turned"))
    leading = F.col("l").isNotNull() | F.col("r").isNotNull()
    rows = pieces.where(leading).join(placed, "id", "left").select(
        F.coalesce("chain", forward).alias("chain"),
        F.struct("d", F.when(F.col("turned"), revcomp("sequence")).otherwise(F.col("sequence")).alias("s"), F.when(F.col("turned"), F.reverse(F.transform("nodes", flipped))).otherwise(F.col("nodes")).alias("nodes")).alias("x"),
    )
    whole = rows.groupBy("chain").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = whole.select("chain", F.array_join(F.transform("x", lambda x: x["s"]), "").alias("sequence"), F.flatten(F.transform("x", lambda x: x["nodes"])).alias("nodes"))
    return chain(pieces.where(~leading)).union(Written(whole, "chains").df)


def unchop_graph(segments: DataFrame, links: DataFrame, passed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chains, links): runs as unchop gives them, and the links between runs, (src, src_rev, dst, dst_rev) with chains as ends."""
    chains = unchop(segments, links, passed)
    first, last = F.element_at("nodes", 1), F.element_at("nodes", -1)
    begin = chains.select(first.alias("n"), F.col("chain").alias("dst"), F.lit(False).alias("dst_rev")).union(chains.select(flipped(last), "chain", F.lit(True)))
    end = chains.select(last.alias("h"), F.col("chain").alias("src"), F.lit(False).alias("src_rev")).union(chains.select(flipped(first), "chain", F.lit(True)))
    arcs = links.select(handle("src", "src_rev").alias("h"), handle("dst", "dst_rev").alias("n"))
    return chains, arcs.join(end, "h").join(begin, "n").select("src", "src_rev", "dst", "dst_rev").distinct()


def path_offsets(steps: DataFrame) -> DataFrame:
    """steps (path, ord, size, ...) with begin and end of each step on its path."""
    order = Window.partitionBy("path").orderBy("ord")
    end = F.sum("size").over(order)
    return steps.withColumns({"begin": end - F.col("size"), "end": end})


def seek(positions: DataFrame, steps: DataFrame, backward: bool = False) -> DataFrame:
    """(path, pos, ord, offset): the step that holds each position (path, pos) of a path (steps: path, ord, size).

    backward: positions and offsets count from the end of the path, 0 is its last
    base.  A position beyond the path is left out; a step without bases holds none.
    """
    placed = path_offsets(steps).where("size > 0").select("path", "ord", F.col("begin").cast("long"), "size")
    if backward:
        total = F.max(F.col("begin") + F.col("size")).over(Window.partitionBy("path"))
        placed = placed.withColumn("begin", total - F.col("begin") - F.col("size"))
    asked = positions.select("path", F.col("pos").cast("long").alias("p"), F.lit(1).alias("tie"), F.lit(None).cast("struct<ord:bigint,begin:bigint,size:bigint>").alias("step"))
    known = placed.select("path", F.col("begin").alias("p"), F.lit(0).alias("tie"), F.struct(F.col("ord").cast("long").alias("ord"), F.col("begin").alias("begin"), F.col("size").cast("long").alias("size")).alias("step"))
    rows = carried(asked.union(known), ["path"], "p", "tie", "step")
    offset = F.col("p") - F.col("carried.begin")
    found = rows.where((F.col("p") >= 0) & (offset < F.col("carried.size")))
    return found.select("path", F.col("p").alias("pos"), F.col("carried.ord").cast(steps.schema["ord"].dataType).alias("ord"), offset.alias("offset"))
