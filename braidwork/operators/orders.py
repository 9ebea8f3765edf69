"""Orders of oriented nodes in which links go forward, found by contracting instead of walking level by level.

A node with a single predecessor can stand right behind it, one with a single
successor right before it.  So all trees of such nodes are folded into their
roots at once, by pointer doubling, and arcs that have become parallel are
merged, which makes new nodes with a single neighbour: a chain of bubbles of any
length goes in two rounds.  Nodes without predecessors are taken to the front and
those without successors to the back of what is left.  Where nothing of this is
possible, arcs into the smallest node of strongly connected components are given
up.  Rounds follow how deeply the graph is nested, not how long it is; nodes with
several predecessors and successors each, in a lattice, still go a level a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.shared import Written

#: Beyond any number of rounds; sinks taken in round r have the place LAST - r.
LAST = 1 << 40


class Cyclic(ValueError):
    """The graph has a cycle, so not all links can go forward."""


def _doubled(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, lost) of pointers (h, to), where to = h is a root: found (h, root, d) with the number of steps to the root; lost (h, least) for what ends in a circle, with the smallest node of the steps from there.

    The number of rounds is the logarithm of the longest way.  It ends when
    nothing more arrives and no smallest node changes, so that each circle has
    been gone round.
    """
    root = F.col("h") == F.col("to")
    now = Written(pointers.select("h", "to", F.when(root, 0).otherwise(1).cast("long").alias("d"), F.col("to").alias("least"), root.alias("there")), "pointers")
    seen = None
    while True:
        ahead = now.df.select(F.col("h").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"), F.col("least").alias("least2"), F.col("there").alias("there2"))
        on = now.df.where("not there").join(ahead, "to").select("h", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), F.least("least", "least2").alias("least"), F.col("there2").alias("there"))
        was, now = now, Written(now.df.where("there").union(on), "pointers")
        was.drop()
        lost = now.df.where("not there")
        state = tuple(lost.agg(F.count("*"), F.expr("bit_xor(xxhash64(h, least))")).first())
        if not state[0] or state == seen:
            return now.df.where("there").select("h", F.col("to").alias("root"), "d"), lost.select("h", "least")
        seen = state


def fold(pointers: DataFrame, strict: bool = False) -> DataFrame:
    """(h, root, d): the root that each node's pointers (h, to) end at, and in how many steps; a root points at itself, and the smallest node of a circle becomes one, or raises Cyclic if strict."""
    found, lost = _doubled(pointers)
    if lost.isEmpty():
        return found
    if strict:
        raise Cyclic("the graph has a cycle")
    # what is lost only points at what is lost
    again = pointers.join(lost, "h").select("h", F.when(F.col("h") == F.col("least"), F.col("h")).otherwise(F.col("to")).alias("to"))
    return found.union(_doubled(again)[0])


def least_reaching(arcs: DataFrame) -> DataFrame:
    """(v, least): the smallest node from which arcs (u, v) lead to v, itself included."""
    now = Written(arcs.select(F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("least", F.col("v")), "least")
    seen = None
    while True:
        given = arcs.join(now.df.withColumnRenamed("v", "u"), "u").select("v", "least")
        lower = now.df.union(given).groupBy("v").agg(F.min("least").alias("least"))
        # what reaches the node that reaches this one reaches this one
        further = now.df.select(F.col("v").alias("least"), F.col("least").alias("less"))
        was, now = now, Written(lower.join(further, "least").select("v", F.least("least", "less").alias("least")), "least")
        was.drop()
        state = now.df.agg(F.expr("bit_xor(xxhash64(v, least))")).first()[0]
        if state == seen:
            return now.df
        seen = state


def circling(arcs: DataFrame) -> DataFrame:
    """(u, v): arcs into the smallest nodes of strongly connected components from within them, of one component at least if there is any cycle.

    Nodes of one component are reached by the same nodes and reach the same; so
    colours by the smallest of both sort out arcs between components, and where
    both are the same node, its component is the colour's.
    """
    inner = arcs
    while True:
        before, behind = least_reaching(inner), least_reaching(inner.select(F.col("v").alias("u"), F.col("u").alias("v")))
        colours = Written(before.join(behind.withColumnRenamed("least", "last"), "v"), "colours").df
        at = colours.withColumnRenamed("v", "u").withColumnsRenamed({"least": "u_least", "last": "u_last"})
        inner = Written(inner.join(colours, "v").join(at, "u").where("least = u_least and last = u_last").select("u", "v", "least", "last"), "inner").df
        found = inner.where("v = least and v = last").select("u", "v")
        inner = inner.select("u", "v")
        if not found.isEmpty() or inner.isEmpty():
            return found


def order(nodes: DataFrame, arcs: DataFrame, strict: bool = False) -> DataFrame:
    """(v, level) of nodes (v): numbers by which arcs (u, v) go up wherever they can; nodes with the same number aren't linked.

    Numbers have gaps.  strict: an arc that can't go up, a loop too, raises Cyclic.
    Every node is given a number; arcs must be between nodes of `nodes`.
    """
    arcs = Written(arcs.select("u", "v").distinct(), "order-arcs").df
    if strict and not arcs.where("u = v").isEmpty():
        raise Cyclic("the graph has a loop")
    arcs = arcs.where("u <> v")
    left = Written(nodes.select("v").distinct(), "order-nodes").df
    rounds: list[tuple[DataFrame, DataFrame]] = []
    idle = 0
    while not left.isEmpty():
        r = len(rounds)
        heads = left.join(arcs.select("v"), "v", "left_anti")
        tails = left.join(arcs.select(F.col("u").alias("v")), "v", "left_anti").join(heads, "v", "left_anti")
        ends = Written(heads.withColumn("place", F.lit(r).cast("long")).union(tails.withColumn("place", F.lit(LAST - r))), "order-ends").df
        gone = ends.select("v")
        left = Written(left.join(gone, "v", "left_anti"), "order-nodes").df
        arcs = arcs.join(gone, "v", "left_anti").join(gone.withColumnRenamed("v", "u"), "u", "left_anti").select("u", "v")
        # rounds fold by turns towards single predecessors and single successors
        here, there, sign = ("v", "u", 1) if r % 2 == 0 else ("u", "v", -1)
        single = arcs.groupBy(F.col(here).alias("h")).agg(F.min(there).alias("to"), F.count("*").alias("n")).where("n = 1").select("h", "to")
        pointers = Written(left.select(F.col("v").alias("h")).join(single, "h", "left").select("h", F.coalesce("to", "h").alias("to")), "order-pointers").df
        folded = fold(pointers, strict) if not pointers.where("h <> to").isEmpty() else pointers.select("h", F.col("to").alias("root"), F.lit(0).cast("long").alias("d"))
        folded = Written(folded.select("h", "root", (F.col("d") * sign).alias("d")), "order-folded").df
        rounds.append((ends, folded))
        at = lambda c: folded.select(F.col("h").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        moved = Written(arcs.join(at("u"), "u").join(at("v"), "v").select("u", "v", "u_root", "v_root").distinct(), "order-moved").df
        # an arc within a tree that comes back to the root closes a cycle
        if strict and not moved.where(f"u_root = v_root and {here} = {here}_root").isEmpty():
            raise Cyclic("the graph has a cycle")
        arcs = Written(moved.where("u_root <> v_root").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct(), "order-arcs").df
        before = left
        left = Written(folded.select(F.col("root").alias("v")).distinct(), "order-nodes").df
        idle = idle + 1 if ends.isEmpty() and before.count() == left.count() else 0
        if idle == 2:
            if strict:
                raise Cyclic("the graph has a cycle")
            arcs = Written(arcs.join(circling(arcs), ["u", "v"], "left_anti"), "order-arcs").df
            idle = 0
    keys = left.select("v", F.array().cast("array<bigint>").alias("key"))
    for ends, folded in reversed(rounds):
        inside = folded.join(keys.withColumnRenamed("v", "root"), "root").select(F.col("h").alias("v"), F.concat("key", F.array("d")).alias("key"))
        keys = Written(inside.union(ends.select("v", F.array("place").alias("key"))), "order-keys").df
    levels = Written(keys.select("key").distinct().orderBy("key").withColumn("level", F.monotonically_increasing_id()), "order-levels").df
    return keys.join(levels, "key").select("v", "level")
