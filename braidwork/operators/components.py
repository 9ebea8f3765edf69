"""Connected components by contraction.

In a round every node takes the first, in an order that is dealt anew each
round, of itself and its neighbours as its label; labels are the nodes of the
next round and links between different labels its edges.  A path halves, so do
trees and denser graphs at least nearly: all rounds together move about as many
rows as the first two, and there are logarithmically many.  Roots are then handed
back through the rounds, smallest table first.  A label is the least of scrambled
ids, so a round is a min aggregation (combined map-side) and two equi-joins and no
node's neighbours are ever gathered; a hub's rows are only joined to one number,
and adaptive execution splits such a join.  Each round's tables are written to the
shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.shared import Written

_LOW = 0xFFFFFFFF
#: Rounds whose roots are handed back by one job.
TOGETHER = 4


def _scrambled(x: Column, seed: int) -> Column:
    """Another number for each 64-bit number, no two alike: three Feistel rounds over its halves."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for k in range(3):
        high, low = low, high.bitwiseXOR(F.xxhash64(low, F.lit(3 * seed + k)).bitwiseAND(F.lit(_LOW)))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v) with u > v, once each."""
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its smallest node.

    Edges may repeat and may be loops; rows with a null end are ignored.
    Nodes that only have loops are not in the result: each is its own component.
    """
    now = Written(_ordered(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "a", "b"), "components")
    labels: list[Written] = []
    while not now.df.isEmpty() or not labels:
        seed = len(labels)
        here, there = _scrambled(F.col("u"), seed), _scrambled(F.col("v"), seed)
        first = F.least(here, there)
        seen = now.df.select(F.col("u").alias("x"), first.alias("r")).union(now.df.select("v", first))
        labels.append(Written(seen.groupBy("x").agg(F.min("r").alias("r")), "labels"))
        at = lambda c: labels[-1].df.select(F.col("x").alias(c), F.col("r").alias(f"{c}_r"))
        then, now = now, Written(_ordered(now.df.join(at("u"), "u").join(at("v"), "v"), "u_r", "v_r"), "components")
        then.drop()
    now.drop()
    roots: DataFrame | None = None
    used = []
    for k in reversed(range(len(labels))):
        roots = _handed(labels[k].df, roots)
        used.append(labels[k])
        if k % TOGETHER == 0:
            found = Written(roots, "roots")
            for w in used:
                w.drop()
            roots, used = found.df, [found]
    return roots.join(roots.groupBy("root").agg(F.min("x").alias("component")), "root").select(F.col("x").alias("node"), "component")


def _handed(labels: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(x, root): the roots of the labels, where a label without one is a root."""
    if roots is None:
        return labels.select("x", F.col("r").alias("root"))
    return labels.join(roots.withColumnRenamed("x", "r"), "r", "left").select("x", F.coalesce("root", "r").alias("root"))
