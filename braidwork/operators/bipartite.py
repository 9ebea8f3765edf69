"""Cutting components into bipartite blocks.

Sides doubled by parity tell which pieces of the graph are bipartite, and which of
their sides go left; such pieces never leave the JVM.  Of the others, small ones
are cut by kernels, each a task's group.  Large ones are cut where they lie: from
a dealt start, sides that would gain by changing over and come first among such
neighbours do so together, for ROUNDS rounds.  The edges that don't cross then are
dealt to further cuts at once, each edge to the first bit in which the hashes of
its two sides differ; as many bits are taken as leave pieces for the kernels.  No
task ever holds a large piece.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.components import connected_components
from braidwork.shared import Written

#: Edges of an odd piece that a kernel cuts.
SMALL_PIECE = 4_000
#: Up to so many sides the best cut is found by going through all.
EXHAUSTIVE = 8
#: Rounds that better a cut of large pieces: sparse ones need few, in dense ones few sides move at once.
ROUNDS = 6
#: Cuts that one turn deals large pieces to, and one more than their number at most.
CUTS, STRIDE = 40, 64

Edge = tuple[int, int]


def adjacency(edges: list[Edge]) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for x, y in edges:
        out.setdefault(x, set()).add(y)
        out.setdefault(y, set()).add(x)
    return out


def pieces(adj: dict[int, set[int]]) -> list[list[int]]:
    """Connected pieces, each from its smallest vertex in breadth-first order."""
    out, seen = [], set()
    for s in sorted(adj):
        if s in seen:
            continue
        seen.add(s)
        piece, queue = [], deque([s])
        while queue:
            piece.append(x := queue.popleft())
            fresh = sorted(adj[x] - seen)
            seen.update(fresh)
            queue.extend(fresh)
        out.append(piece)
    return out


def two_colours(adj: dict[int, set[int]]) -> dict[int, int] | None:
    """0 or 1 for every vertex so that edges join different ones, 0 for the smallest of each piece; None if an odd cycle forbids it."""
    colour: dict[int, int] = {}
    for piece in pieces(adj):
        colour[piece[0]] = 0
        for x in piece:
            for y in adj[x]:
                if colour.setdefault(y, 1 - colour[x]) == colour[x]:
                    return None
    return colour


def cut_size(edges: list[Edge], left: set[int]) -> int:
    return sum((x in left) != (y in left) for x, y in edges)


def best_cut(vertices: list[int], edges: list[Edge]) -> set[int]:
    """A side of a largest cut, by flipping one vertex at a time in Gray-code order."""
    adj = adjacency(edges)
    now: set[int] = set()
    best, size, most = set(), 0, 0
    for step in range(1, 1 << max(0, len(vertices) - 1)):
        v = vertices[(step & -step).bit_length() - 1]
        across = sum((y in now) != (v in now) for y in adj.get(v, ()))
        size += len(adj.get(v, ())) - 2 * across
        now ^= {v}
        if size > most:
            best, most = set(now), size
    return best


def dealt_cut(vertices: list[int], edges: list[Edge], seed: int = 1) -> set[int]:
    """A seeded random cut, neither side empty; at least half of all edges on average."""
    state, left = seed, set()
    for v in vertices:
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        if state >> 63:
            left.add(v)
    if len(vertices) > 1 and not left:
        left.add(vertices[0])
    if len(vertices) > 1 and len(left) == len(vertices):
        left.discard(vertices[0])
    return left


def refined_cut(vertices: list[int], edges: list[Edge], left: set[int]) -> set[int]:
    """Local search: moves of one vertex, then exchanges along an edge, while the cut grows; at least half of all edges in the end."""
    adj, left = adjacency(edges), set(left)
    gain = {v: sum(1 if (y in left) == (v in left) else -1 for y in adj[v]) for v in adj}

    def move(v: int) -> None:
        left.symmetric_difference_update({v})
        gain[v] = -gain[v]
        for y in adj[v]:
            gain[y] += 2 if (y in left) == (v in left) else -2

    while adj:
        v = max(gain, key=lambda v: (gain[v], -v))
        if gain[v] > 0:
            move(v)
            continue
        swap = next(((x, y) for x, y in edges if (x in left) != (y in left) and gain[x] + gain[y] + 2 > 0), None)
        if swap is None:
            break
        for v in swap:
            move(v)
    return left


def max_cut(vertices: list[int], edges: list[Edge]) -> set[int]:
    if len(vertices) < EXHAUSTIVE:
        return best_cut(vertices, edges)
    return refined_cut(vertices, edges, dealt_cut(vertices, edges))


def blocks(edges: list[Edge]) -> list[list[Edge]]:
    """Bipartite connected blocks that hold each edge once, as (left, right) pairs; a block's smallest side is on the left."""
    out: list[list[Edge]] = []
    todo = [sorted({(min(e), max(e)) for e in edges})]
    while todo:
        mine = todo.pop()
        if not mine:
            continue
        adj = adjacency(mine)
        colour = two_colours(adj)
        if colour is None:
            left = max_cut(sorted(adj), mine)
            todo.append([e for e in mine if (e[0] in left) == (e[1] in left)])
            todo.append([e for e in mine if (e[0] in left) != (e[1] in left)])
            continue
        home = {x: k for k, piece in enumerate(pieces(adj)) for x in piece}
        parts: dict[int, list[Edge]] = {}
        for x, y in mine:
            parts.setdefault(home[x], []).append((x, y) if colour[x] == 0 else (y, x))
        out += parts.values()
    return sorted(out)


def coloured(edges: DataFrame) -> DataFrame:
    """(side, piece, colour, odd): the smallest side of each side's piece, the side's colour (0 for the smallest), whether an odd cycle forbids colours."""
    doubled = edges.select((2 * F.col("x")).alias("p"), (2 * F.col("y") + 1).alias("q")).union(edges.select(2 * F.col("x") + 1, 2 * F.col("y")))
    found = connected_components(doubled, "p", "q")  # a bipartite piece gives two, an odd one gives one
    rows = found.groupBy(F.expr("node div 2").alias("side")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("own"))
    return rows.select("side", F.expr("low div 2").alias("piece"), (F.col("own") % 2).cast("int").alias("colour"), (F.col("low") == F.col("high")).alias("odd"))


def large_cut(edges: DataFrame, seed: int = 1, rounds: int | None = None) -> DataFrame:
    """(side, flag): a cut of edges (x, y) that no side gains by leaving, so at least half of them cross; with rounds, the cut after so many."""
    both = Written(edges.select(F.col("x").alias("v"), F.col("y").alias("u")).union(edges.select("y", "x")), "both")
    now = Written(both.df.select(F.col("v").alias("side")).distinct().withColumn("flag", F.pmod(F.xxhash64("side", F.lit(seed)), F.lit(2)).cast("int")), "flags")
    at = lambda df, c: df.select(F.col("side").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in df.columns[1:]))
    turn = 0
    while True:
        turn += 1
        rows = both.df.join(at(now.df, "v"), "v").join(at(now.df, "u"), "u")
        gains = rows.groupBy(F.col("v").alias("side")).agg(F.sum(F.when(F.col("v_flag") == F.col("u_flag"), 1).otherwise(-1)).alias("gain")).where("gain > 0")
        movers = Written(gains.select("side", F.struct("gain", F.xxhash64("side", F.lit(turn)).alias("deal"), "side").alias("first")), "movers")
        if turn - 1 == rounds or not movers.df.head(1):
            movers.drop()
            both.drop()
            return now.df
        beaten = both.df.join(at(movers.df, "v"), "v").join(at(movers.df, "u"), "u").where("u_first > v_first").select(F.col("v").alias("side")).distinct()
        moving = movers.df.join(beaten, "side", "left_anti").select("side", F.lit(1).alias("moves"))
        then, now = now, Written(now.df.join(moving, "side", "left").select("side", ((F.col("flag") + F.coalesce("moves", F.lit(0))) % 2).alias("flag")), "flags")
        then.drop()
        movers.drop()


def _oriented(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges (x, y) whose sides have (piece, colour), as (piece, l_side, r_side)."""
    rows = edges.join(of.select(F.col("side").alias("x"), "piece", "colour"), "x")
    first = F.col("colour") == 0
    return rows.select("component", "piece", F.when(first, F.col("x")).otherwise(F.col("y")).alias("l_side"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("r_side"))


def block_edges(edges: DataFrame) -> DataFrame:
    """(component, block, l_side, r_side): side edges (x, y) dealt to bipartite connected blocks, each edge once; a block's smallest side is on the left.

    component is the smallest side of the piece; a loop on one side can be in no
    block and is left out.
    """

    def solve(rows: pa.Table) -> pa.Table:
        data = rows.to_pydict()
        found = blocks(list(zip(data["x"], data["y"], strict=True)))
        flat = [(data["component"][0], f"k{data['turn'][0]}.{data['piece'][0]}.{k}", a, b) for k, block in enumerate(found) for a, b in block]
        return pa.table({n: pa.array([r[i] for r in flat], kind) for i, (n, kind) in enumerate((("component", pa.int64()), ("block", pa.string()), ("l_side", pa.int64()), ("r_side", pa.int64())))})

    rest = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()
    out: list[DataFrame] = []
    turn = 0
    while True:
        of = Written(coloured(rest), "coloured").df
        placed = rest.join(of.select(F.col("side").alias("x"), "piece", "odd"), "x")
        if turn == 0:
            placed = placed.withColumn("component", F.col("piece"))
        placed = Written(placed, "placed").df
        fine = _oriented(placed.where("not odd").drop("piece"), of)
        out.append(fine.select("component", F.concat(F.lit(f"{turn}."), F.col("piece").cast("string")).alias("block"), "l_side", "r_side"))
        odd = placed.where("odd")
        sizes = Written(odd.groupBy("piece").agg(F.count("*").alias("n")), "sizes").df
        small, large = (odd.join(sizes.where(w), "piece", "left_semi") for w in (f"n <= {SMALL_PIECE}", f"n > {SMALL_PIECE}"))
        if not sizes.head(1):
            return reduce(DataFrame.union, out)
        kept = small.select("component", "piece", F.lit(turn).alias("turn"), "x", "y").groupBy("piece").applyInArrow(solve, "component bigint, block string, l_side bigint, r_side bigint")
        out.append(Written(kept, "odd-blocks").df)
        most = sizes.agg(F.max("n")).first()[0]
        if most <= SMALL_PIECE:
            return reduce(DataFrame.union, out)
        flags = large_cut(large, turn + 1, ROUNDS)
        at = lambda c: flags.select(F.col("side").alias(c), F.col("flag").alias(f"{c}_flag"))
        # of cut k all edges join two values of one bit, so its pieces are bipartite
        hashed = lambda c: F.xxhash64(c, F.lit(turn), F.lit("cuts")).bitwiseAND((1 << min(CUTS, (most // SMALL_PIECE).bit_length())) - 1)  # noqa: E731, B023
        differ = hashed("x").bitwiseXOR(hashed("y"))
        cut = F.when(F.col("x_flag") != F.col("y_flag"), 0).when(differ != 0, F.bit_count(differ.bitwiseXOR(differ - 1))).cast("long")
        dealt = Written(large.join(at("x"), "x").join(at("y"), "y").select("component", "x", "y", cut.alias("cut")), "dealt").df
        crossing = dealt.where("cut is not null").select("component", *((F.col(c) * STRIDE + F.col("cut")).alias(c) for c in ("x", "y")))
        crossing = _oriented(crossing, Written(coloured(crossing), "coloured").df)
        name = F.concat_ws(".", F.lit(f"c{turn}"), F.pmod("piece", F.lit(STRIDE)), F.shiftright("piece", STRIDE.bit_length() - 1))
        out.append(crossing.select("component", name.alias("block"), *(F.shiftright(c, STRIDE.bit_length() - 1).alias(c) for c in ("l_side", "r_side"))))
        rest = dealt.where("cut is null").select("component", "x", "y")
        turn += 1


def bipartite_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, is_bipartite) without gathering a component."""
    odd = coloured(edges).select("side", "odd")
    joined = components.join(odd, "side", "left")
    return joined.groupBy("component").agg((~F.coalesce(F.bool_or("odd"), F.lit(False))).alias("is_bipartite"))
