"""What must hold between a graph and its blunted form; each check gives the rows that break it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import cigar
from braidwork.functions.sequence import oriented
from braidwork.operators.splice import both_strands, piece_form
from braidwork.shared import PACKED, Written


def not_blunt(links: DataFrame) -> DataFrame:
    """Links with an overlap or with a cigar that can't be read."""
    ops = cigar.parse("cigar")
    return links.where(F.coalesce((cigar.ref_length(ops) > 0) | (cigar.query_length(ops) > 0), F.lit(True)))


def inconsistent(pieces: DataFrame, provenance: DataFrame, parents: DataFrame) -> DataFrame:
    """(out_id, reason): provenance entries whose piece doesn't read as the parent's interval, and pieces or entries without a counterpart."""
    whole = parents.select(F.col("name").alias("parent"), F.col("sequence").alias("whole"))
    return _unlike(provenance.join(whole, "parent", "left"), pieces)


def inconsistent_steps(pieces: DataFrame, steps: DataFrame, parents: DataFrame) -> DataFrame:
    """inconsistent() of a graph's steps, whose parents are looked up by number while the steps lie by node."""
    rows = steps.select("node", F.col("piece").alias("out_id"), F.col("lo").alias("begin"), F.col("hi").alias("end"), "rev").repartition("node").distinct()
    whole = parents.select(F.col("node_id").alias("node"), F.col("name").alias("parent"), F.col("sequence").alias("whole"))
    return _unlike(rows.join(whole, "node", "left").withColumn("parent", F.coalesce("parent", F.lit("?"))), pieces)


def _unlike(entries: DataFrame, pieces: DataFrame) -> DataFrame:
    """inconsistent() of entries with their parent's bases (whole), of which only the interval's go on."""
    want = F.expr("substring(whole, cast(begin as int) + 1, cast(end - begin as int))")
    cut = entries.select("out_id", "rev", F.when(F.col("parent").isNotNull(), True).alias("is_entry"), F.col("whole").isNotNull().alias("is_parent"), want.alias("want"))
    rows = cut.join(pieces.select(F.col("name").alias("out_id"), "sequence", F.lit(True).alias("is_piece")), "out_id", "full")
    reason = F.when(F.col("is_piece").isNull(), "no piece").when(F.col("is_entry").isNull(), "no provenance").when(~F.col("is_parent"), "no parent").when(oriented("sequence", "rev") != F.col("want"), "other bases")
    return rows.select("out_id", reason.alias("reason")).where("reason is not null")


def not_covered(provenance: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, at): bases of a parent, the first of each stretch, that no piece stands for."""
    sized = parents.select(F.col("name").alias("parent"), F.length("sequence").cast("long").alias("size"))
    rows = sized.join(provenance.select("parent", "begin", "end"), "parent", "left")
    order = Window.partitionBy("parent").orderBy("begin", "end")
    so_far = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.select("parent", "size", "begin", so_far.alias("at"), F.greatest(so_far, "end").alias("reached"), F.lead(F.lit(False), 1, True).over(order).alias("final"))
    gap, tail = F.when(F.col("begin") > F.col("at"), F.col("at")), F.when(F.col("final") & (F.col("reached") < F.col("size")), F.col("reached"))
    return rows.select("parent", F.explode(F.array_compact(F.array(gap, tail))).alias("at"))


def merged_intervals(provenance: DataFrame) -> DataFrame:
    """(parent, start, stop): intervals of each parent that pieces stand for, merged."""
    order = Window.partitionBy("parent").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = provenance.withColumn("fresh", F.when(reached.isNull() | (F.col("begin") > reached), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(order))
    return rows.groupBy("parent", "run").agg(F.min("begin").alias("start"), F.max("end").alias("stop")).select("parent", "start", "stop")


def node_arcs(steps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, a, b): consecutive steps of a node that the graph links; a and b are (piece, rev, lo, hi)."""
    arcs = both_strands(links)
    at = F.struct("piece", "rev", "lo", "hi")
    one = steps.select("node", at.alias("a"), F.col("piece").alias("src"), F.col("rev").alias("src_rev"), F.col("hi").alias("p")).distinct()
    two = steps.select(F.col("node").alias("n2"), at.alias("b"), F.col("piece").alias("dst"), F.col("rev").alias("dst_rev"), F.col("lo").alias("p2")).distinct()
    joined = one.join(two, (F.col("node") == F.col("n2")) & (F.col("p") == F.col("p2"))).where("a <> b")
    return joined.join(arcs, ["src", "src_rev", "dst", "dst_rev"], "left_semi").select("node", "a", "b")


def chosen_walks(states: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, at, d): for each node a walk over arcs (node, a, b) from a state (node, at) at its first base to the smallest state at its last one (`last`), d its places counted from the end; no row if there is none.

    Every state points at its smallest predecessor and pointers are doubled, so
    rounds are the logarithm of the longest walk.  Where pointers lead to no
    first base or round a circle, but another predecessor comes from one, they
    are turned to it and doubled again; all that points there follows.  The walk
    is then taken from the end by the doubled pointers, longest first.
    """
    most = states.groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    first = F.col("at.lo") == 0
    back = arcs.groupBy("node", F.col("b").alias("at")).agg(F.min("a").alias("to"))
    now = Written(states.join(back, ["node", "at"], "left").select("node", "at", F.when(first, F.col("at")).otherwise(F.coalesce("to", "at")).alias("to")), "pointers").df
    while True:
        tables = [now]
        for _ in range(max(most - 1, 0).bit_length()):
            ahead = tables[-1].select("node", F.col("at").alias("to"), F.col("to").alias("further"))
            tables.append(Written(tables[-1].join(ahead, ["node", "to"]).select("node", "at", F.col("further").alias("to")), "pointers").df)
        good = tables[-1].where("to.lo = 0").select("node", "at")
        bad = tables[-1].select("node", "at").join(good, ["node", "at"], "left_anti")
        if bad.isEmpty():
            break
        better = arcs.join(good.withColumnRenamed("at", "a"), ["node", "a"]).groupBy("node", F.col("b").alias("at")).agg(F.min("a").alias("better"))
        turned = Written(bad.join(better, ["node", "at"]), "turned").df
        if turned.isEmpty():
            break
        now = Written(now.join(turned, ["node", "at"], "left").select("node", "at", F.coalesce("better", "to").alias("to")), "pointers").df
    walk = good.join(states.where("last"), ["node", "at"]).groupBy("node").agg(F.min("at").alias("at")).withColumn("d", F.lit(0))
    for k in reversed(range(len(tables))):
        walk = walk.union(walk.join(tables[k], ["node", "at"]).where("at <> to").select("node", F.col("to").alias("at"), F.col("d") + (1 << k)))
        walk = Written(walk.groupBy("node", "at").agg(F.max("d").alias("d")), "walk").df
    return walk


#: Steps of a node up to which its walk is found within a row.
FEW = 64


def node_states(steps: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, name, size, states, few): each parent with its steps (lo, hi, piece, rev) in order, null if none; few: whether a walk over them, which then go up, may be found within the row."""
    sized = parents.select(F.col("node_id").alias("node"), "name", F.length("sequence").cast("long").alias("size"))
    return sized.join(_states(steps), "node", "left").withColumn("few", F.coalesce("few", F.lit(True)))


def _states(steps: DataFrame) -> DataFrame:
    """(node, states, few) of node_states()."""
    rows = steps.select("node", F.struct("lo", "hi", "piece", "rev").alias("at")).repartition("node").groupBy("node").agg(F.array_sort(F.collect_set("at")).alias("states"))
    short = (F.size("states") <= FEW) & ((F.size("states") == 1) | ~F.exists("states", lambda x: x["lo"] == x["hi"]))
    return rows.withColumn("few", short)


def state_arcs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(node, i, j): places of consecutive steps that the graph links, of node_states() with few; the pairs are looked up among the links in one form, so neither is doubled."""
    numbered = F.transform("states", lambda x, j: F.struct(x.alias("x"), j.alias("j")))
    pairs = F.flatten(F.transform("numbered", lambda a: F.transform(F.filter("numbered", lambda b: (b["x"]["lo"] == a["x"]["hi"]) & (b["j"] != a["j"])), lambda b: F.struct(
        a["j"].alias("i"), b["j"].alias("j"), a["x"]["piece"].alias("src"), a["x"]["rev"].alias("src_rev"), b["x"]["piece"].alias("dst"), b["x"]["rev"].alias("dst_rev")))))
    found = rows.where("few and size(states) > 1").withColumn("numbered", numbered).select("node", F.explode(pairs).alias("e")).select("node", "e.*")
    known = piece_form(links.select("src", "src_rev", "dst", "dst_rev"))
    return piece_form(found, "node", "i", "j").join(known, ["src", "src_rev", "dst", "dst_rev"], "left_semi").select("node", "i", "j")


def short_walks(rows: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, name, walk): for each row with few steps those of a walk over arcs (node, i, j) from its first base to its last one; null if there is none."""
    given = arcs.repartition("node").groupBy("node").agg(F.collect_list(F.struct("i", "j")).alias("arcs"))
    single = rows.where("few and (states is null or size(states) = 1)")
    spans = (F.get("states", F.lit(0))["lo"] == 0) & (F.get("states", F.lit(0))["hi"] == F.col("size"))
    several = rows.where("few and size(states) > 1").join(given, "node", "left").withColumn("arcs", F.coalesce("arcs", F.array().cast("array<struct<i:int,j:int>>")))
    places = several.withColumn("places", F.sequence(F.lit(0), F.size("states") - 1))
    # steps are in order, so what leads to a step has been looked at before it: -1 if no first base does
    before = lambda acc, j: F.array_min(F.transform(F.filter("arcs", lambda e: (e["j"] == j) & (F.get(acc, e["i"]) >= 0)), lambda e: e["i"]))
    came = F.aggregate("places", F.array().cast("array<int>"), lambda acc, j: F.concat(acc, F.array(F.when(F.get("states", j)["lo"] == 0, j).otherwise(F.coalesce(before(acc, j), F.lit(-1))))))
    ended = places.withColumn("came", came).withColumn("last", F.array_min(F.filter("places", lambda j: (F.get("came", j) >= 0) & (F.get("states", j)["hi"] == F.col("size")))))
    back = F.aggregate("places", F.array("last"), lambda w, _: F.when(F.get("came", F.get(w, F.lit(0))) == F.get(w, F.lit(0)), w).otherwise(F.concat(F.array(F.get("came", F.get(w, F.lit(0)))), w)))
    walk = F.when(F.col("last").isNotNull(), F.transform(back, lambda j: F.get("states", j)))
    return single.select("node", "name", F.when(spans, F.col("states")).alias("walk")).union(ended.select("node", "name", walk.alias("walk")))


def spelled(steps: DataFrame, links: DataFrame, pieces: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, sequence): what a walk of linked pieces from each parent's first base to its last one spells; null if there is none.

    Where a node has few steps its walk is found within its row; the others' by doubled pointers.
    """
    rows = Written(node_states(steps, parents), "states", **PACKED).df
    walks = short_walks(rows, state_arcs(rows, links))
    parts = walks.select("node", "name", F.posexplode_outer("walk").alias("d", "at")).select("node", F.when(F.coalesce("d", F.lit(0)) == 0, F.col("name")).alias("name"), "d", "at.piece", "at.rev")
    many = rows.where("not few")
    if not many.isEmpty():
        at = F.struct("piece", "rev", "lo", "hi").alias("at")
        states = Written(many.select("node", "size", F.inline("states")).select("node", at, (F.col("hi") == F.col("size")).alias("last")), "states").df
        walk = chosen_walks(states, Written(node_arcs(states.select("node", "at.*"), links), "arcs").df)
        parts = parts.union(walk.select("node", F.lit(None).cast("string"), -F.col("d"), "at.piece", "at.rev")).union(many.select("node", "name", F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    seqs = pieces.select(F.col("name").alias("piece"), "sequence")
    known = parts.join(seqs, "piece", "left").select("node", "name", F.when(F.col("d").isNotNull(), F.struct("d", oriented("sequence", "rev").alias("s"))).alias("x"))
    texts = known.groupBy("node").agg(F.max("name").alias("name"), F.array_sort(F.collect_list("x")).alias("x"))
    return texts.select("name", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda x: x["s"]), "")).alias("sequence"))


def shared_pieces(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """(link_id, piece): pieces that both members of a link's overlap go through, some perhaps more than once."""
    on = steps.where("biclique_id is not null").select("biclique_id", "side", "piece")
    left = groups.select("biclique_id", "link_id", "l_side", "r_side").join(on.withColumnRenamed("side", "l_side"), ["biclique_id", "l_side"])
    return left.join(on.withColumnRenamed("side", "r_side"), ["biclique_id", "r_side", "piece"]).select("link_id", "piece")


def lost_links(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """(link_id): overlaps whose two members share no piece."""
    return groups.select("link_id").distinct().join(shared_pieces(steps, groups), "link_id", "left_anti")


def new_adjacencies(steps: DataFrame, groups: DataFrame) -> DataFrame:
    """(l_side, r_side): a left and a right member of one group that share a piece though nothing links them."""
    on = steps.where("biclique_id is not null").select("biclique_id", "side", "piece")
    roles = groups.select("biclique_id", F.col("l_side").alias("side"), F.lit("l").alias("role")).union(groups.select("biclique_id", "r_side", F.lit("r"))).repartition("biclique_id", "side").distinct()
    by = on.join(roles, ["biclique_id", "side"])
    left = by.where("role = 'l'").select("biclique_id", "piece", F.col("side").alias("l_side"))
    right = by.where("role = 'r'").select("biclique_id", "piece", F.col("side").alias("r_side"))
    met = left.join(right, ["biclique_id", "piece"]).select(F.least("l_side", "r_side").alias("p"), F.greatest("l_side", "r_side").alias("q"), "l_side", "r_side")
    known = groups.select(F.least("l_side", "r_side").alias("p"), F.greatest("l_side", "r_side").alias("q"))
    return met.join(known, ["p", "q"], "left_anti").select("l_side", "r_side").distinct()


#: Places of a node's links up to which walks between them are looked for within a row.
FEW_MET = 1_024


def two_hops(steps: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, first, second): pairs of overlap links that enter and leave a node by different ends and whose walk the blunted graph has.

    The walk goes from a piece shared over the one link along the node's steps
    to a piece shared over the other; where a node has few steps and links it is
    looked for within a row.
    """
    on = steps.where("biclique_id is not null")
    of = lambda which: on.select("biclique_id", F.col("side").alias(f"{which}_side"), "piece", F.struct("node", "kind", "lo", "hi", "rev").alias(which))
    shared = groups.select("biclique_id", "link_id", "l_side", "r_side").join(of("l"), ["biclique_id", "l_side"]).join(of("r"), ["biclique_id", "r_side", "piece"])
    met = shared.select("link_id", "piece", F.explode(F.array("l", "r")).alias("m")).select("m.node", "m.kind", "link_id", F.struct("m.lo", "m.hi", "piece", "m.rev").alias("at"))
    met = Written(met, "met", **PACKED)
    by = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("link_id", "at")))
    ends = met.df.repartition("node").groupBy("node").agg(by("L").alias("firsts"), by("R").alias("seconds")).where("size(firsts) > 0 and size(seconds) > 0")
    # both sides lie by node, so the steps of nodes without a way are not kept
    rows = Written(_states(steps).join(ends, "node").withColumn("few", F.col("few") & (F.size("firsts") + F.size("seconds") <= FEW_MET)), "hops", **PACKED).df
    found = _short_hops(rows.where("few"), state_arcs(rows, links))
    many = rows.where("not few").select("node")
    if many.isEmpty():
        return found
    return found.union(_far_hops(steps.join(many, "node", "left_semi"), links, met.df.join(many, "node", "left_semi")))


def _short_hops(rows: DataFrame, arcs: DataFrame) -> DataFrame:
    """two_hops() of rows (node, states, firsts, seconds) with arcs (node, i, j)."""
    given = arcs.repartition("node").groupBy("node").agg(F.collect_list(F.struct("i", "j")).alias("arcs"))
    placed = lambda c: F.array_distinct(F.transform(c, lambda x: F.struct(x["link_id"].alias("link_id"), (F.array_position("states", x["at"]) - 1).cast("int").alias("j"))))
    rows = rows.join(given, "node", "left").select("node", F.size("states").alias("n"), placed("firsts").alias("firsts"), placed("seconds").alias("seconds"), F.coalesce("arcs", F.array().cast("array<struct<i:int,j:int>>")).alias("arcs"))
    # from the last step backwards, so what a step leads to has been looked at before it; the last step's comes first
    at = lambda acc, j: F.get(acc, F.col("n") - 1 - j)
    further = lambda acc, j: F.flatten(F.transform(F.filter("arcs", lambda e: e["i"] == j), lambda e: at(acc, e["j"])))
    reach = F.aggregate(F.sequence(F.col("n") - 1, F.lit(0), F.lit(-1)), F.array().cast("array<array<int>>"), lambda acc, j: F.concat(acc, F.array(F.array_distinct(F.concat(F.array(j), further(acc, j))))))
    rows = rows.withColumn("reach", reach)
    pairs = F.flatten(F.transform("firsts", lambda f: F.transform(F.filter("seconds", lambda s: F.array_contains(at(F.col("reach"), f["j"]), s["j"])), lambda s: F.struct(f["link_id"].alias("first"), s["link_id"].alias("second")))))
    return rows.select("node", F.explode(F.array_distinct(pairs)).alias("p")).select("node", "p.first", "p.second")


def _far_hops(steps: DataFrame, links: DataFrame, met: DataFrame) -> DataFrame:
    """two_hops() from met (node, kind, link_id, at), all walks a step a round."""
    order = F.struct("at.piece", "at.rev", "at.lo", "at.hi").alias("at")
    met = Written(met.select("node", "kind", "link_id", order), "met").df
    arcs = Written(node_arcs(steps, links), "arcs").df
    seen = Written(met.where("kind = 'L'").select("node", F.col("link_id").alias("first"), "at").distinct().withColumn("k", F.lit(0)), "reach").df
    for k in count(1):  # ends, as no (node, link, step) is reached twice
        on_ = seen.where(F.col("k") == k - 1).join(arcs.withColumnRenamed("a", "at"), ["node", "at"]).select("node", "first", F.col("b").alias("at")).distinct()
        fresh = Written(on_.join(seen.select("node", "first", "at"), ["node", "first", "at"], "left_anti").withColumn("k", F.lit(k)), "reach").df
        if not fresh.limit(1).count():
            break
        seen = seen.union(fresh)
    ends = met.where("kind = 'R'").select("node", F.col("link_id").alias("second"), "at")
    return seen.select("node", "first", "at").join(ends, ["node", "at"]).select("node", "first", "second").distinct()
