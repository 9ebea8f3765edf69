"""Covering bipartite blocks with few complete bipartite groups.

Only the members of a complete group may be merged without inventing an
adjacency, so every group's left and right sides are all linked.  A block is
first simplified; if its lattice of maximal groups has a chain for every edge
(no dominoes), a least cover is a least vertex cut of the lattice, else the dual
graph is coloured; where that isn't exact a heuristic is tried too and the
smaller cover is kept.

Vertices of a block are numbered, sets are bits of whole numbers, a group is a
pair (left, right) of sets.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.colouring import EXACT, bits, colours
from braidwork.shared import Written

Group = tuple[int, int]
#: Beyond so many edges the dual graph, or concepts the lattice, isn't built.
DUAL_EDGES, LATTICE_CONCEPTS = 400, 600
#: Edges of a block that one task covers.
LARGE_BLOCK = 20_000


def transpose(rows: list[int], n: int) -> list[int]:
    out = [0] * n
    for u, row in enumerate(rows):
        for v in bits(row):
            out[v] |= 1 << u
    return out


def common(rows: list[int], chosen: int, full: int) -> int:
    """What all chosen rows share."""
    for u in bits(chosen):
        full &= rows[u]
    return full


def simplify(rows: list[int], n_right: int) -> tuple[list[int], list[tuple[bool, int, int]]]:
    """(rows, steps): if u's neighbours are all w's too, w needs no edge to them, as w can join every group of u."""
    rows, steps = list(rows), []
    changed = True
    while changed:
        changed = False
        for on_left in (True, False):
            side = rows if on_left else transpose(rows, n_right)
            for u in range(len(side)):
                for w in range(len(side)):
                    if u != w and side[u] and side[u] & ~side[w] == 0 and (side[u] != side[w] or u < w):
                        side[w] &= ~side[u]
                        steps.append((on_left, u, w))
                        changed = True
            if not on_left:
                rows = transpose(side, len(rows))
    return rows, steps


def unsimplify(cover: list[Group], steps: list[tuple[bool, int, int]]) -> list[Group]:
    """A cover of the block as it was before simplify()."""
    for on_left, u, w in reversed(steps):
        k = 0 if on_left else 1
        cover = [tuple(s | (1 << w) if i == k and s >> u & 1 else s for i, s in enumerate(g)) for g in cover]
    return cover


def concepts(rows: list[int], n_right: int, most: int = LATTICE_CONCEPTS) -> list[Group] | None:
    """All maximal groups with both sides filled, smaller left sides first; None if there are too many."""
    full_right, full_left = (1 << n_right) - 1, (1 << len(rows)) - 1
    columns = transpose(rows, n_right)
    rights = {r for r in rows if r}
    todo = list(rights)
    while todo:
        a = todo.pop()
        for b in rows:
            if (c := a & b) and c not in rights:
                rights.add(c)
                todo.append(c)
                if len(rights) > most:
                    return None
    found = [(common(columns, r, full_left), r) for r in rights]
    return sorted(((a, common(rows, a, full_right)) for a, _ in found), key=lambda g: (g[0].bit_count(), g))


def hasse(lattice: list[Group]) -> list[list[int]]:
    """For each concept those next above it (larger left side)."""
    out = []
    for i, (a, _) in enumerate(lattice):
        above = [j for j, (b, _) in enumerate(lattice) if j != i and a & ~b == 0]
        out.append([j for j in above if not any(k != j and lattice[k][0] & ~lattice[j][0] == 0 for k in above)])
    return out


def has_domino(rows: list[int], lattice: list[Group]) -> bool:
    """Whether some edge's concepts aren't a chain, so that the lattice cut wouldn't be exact."""
    for u, row in enumerate(rows):
        for v in bits(row):
            mine = [g[0] for g in lattice if g[0] >> u & 1 and g[1] >> v & 1]
            if any(a & ~b for a, b in zip(mine, mine[1:], strict=False)):
                return True
    return False


def least_cut(lattice: list[Group], above: list[list[int]], sources: set[int], sinks: set[int]) -> list[int]:
    """A least set of concepts that meets every way up from a source to a sink (nodes split in two, level graphs)."""
    n = len(lattice)
    s, t = 2 * n, 2 * n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(2 * n + 2)]

    def arc(a: int, b: int, c: int) -> None:
        for x, y, r in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)

    for i in range(n):
        arc(2 * i, 2 * i + 1, 1)
        for j in above[i]:
            arc(2 * i + 1, 2 * j, n + 1)
        if i in sources:
            arc(s, 2 * i, n + 1)
        if i in sinks:
            arc(2 * i + 1, t, n + 1)

    def levels() -> list[int]:
        level = [-1] * (2 * n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[t] >= 0:
        at = [0] * (2 * n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                for e in path:
                    room[e] -= 1
                    room[e ^ 1] += 1
                path, x = [], s
                continue
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    break
                at[x] += 1
            if at[x] < len(out[x]):
                path.append(e := out[x][at[x]])
                x = to[e]
            elif x == s:
                break
            else:
                x = to[path.pop() ^ 1]
                at[x] += 1
    reached = levels()
    return [i for i in range(n) if reached[2 * i] >= 0 > reached[2 * i + 1]]


def lattice_cover(rows: list[int], n_right: int) -> list[Group] | None:
    """A least cover of a block without dominoes; None for others."""
    lattice = concepts(rows, n_right)
    if lattice is None or has_domino(rows, lattice):
        return None
    low = lambda u: min((i for i, g in enumerate(lattice) if g[0] >> u & 1), key=lambda i: lattice[i][0].bit_count())
    high = lambda v: max((i for i, g in enumerate(lattice) if g[1] >> v & 1), key=lambda i: lattice[i][0].bit_count())
    sources = {low(u) for u, row in enumerate(rows) if row}
    used = 0
    for row in rows:
        used |= row
    return [lattice[i] for i in least_cut(lattice, hasse(lattice), sources, {high(v) for v in bits(used)})]


def dual_cover(rows: list[int], n_right: int) -> tuple[list[Group], bool]:
    """(cover, whether it is a least one) by colouring the pairs of edges that can't share a group."""
    edges = [(u, v) for u, row in enumerate(rows) for v in bits(row)]
    n = len(edges)
    joined = [0] * n
    for i, (u, v) in enumerate(edges):
        for j in range(i):
            x, y = edges[j]
            if rows[u] >> y & 1 and rows[x] >> v & 1:
                joined[i] |= 1 << j
                joined[j] |= 1 << i
    left = (1 << n) - 1
    follows: list[tuple[int, int]] = []
    changed = True
    while changed:  # an edge that can share a group with whatever another can, shares that one's
        changed = False
        for i in bits(left):
            for j in bits(joined[i] & left):
                if left >> i & 1 and (joined[i] | 1 << i) & left & ~(joined[j] | 1 << j) == 0:
                    left &= ~(1 << j)
                    follows.append((j, i))
                    changed = True
    kept = list(bits(left))
    apart = [sum(1 << b for b, j in enumerate(kept) if j != i and not joined[i] >> j & 1) for i in kept]
    colour = dict(zip(kept, colours(apart), strict=True))
    for j, i in reversed(follows):
        colour[j] = colour[i]
    groups: dict[int, list[int]] = {}
    for i, k in colour.items():
        g = groups.setdefault(k, [0, 0])
        g[0] |= 1 << edges[i][0]
        g[1] |= 1 << edges[i][1]
    return [tuple(g) for _, g in sorted(groups.items())], len(kept) <= EXACT


def heuristic_cover(rows: list[int], n_right: int) -> list[Group]:
    """The vertex with the fewest uncovered edges, again and again: the group of its uncovered neighbours and all that share them."""
    columns = transpose(rows, n_right)
    open_rows, out = list(rows), []
    while any(open_rows):
        open_columns = transpose(open_rows, n_right)
        choices = [(r.bit_count(), 0, u) for u, r in enumerate(open_rows) if r] + [(c.bit_count(), 1, v) for v, c in enumerate(open_columns) if c]
        _, side, x = min(choices)
        if side == 0:
            right = open_rows[x]
            left = common(columns, right, (1 << len(rows)) - 1)
        else:
            left = open_columns[x]
            right = common(rows, left, (1 << n_right) - 1)
        for u in bits(left):
            open_rows[u] &= ~right
        out.append((left, right))
    return out


def polish(cover: list[Group]) -> list[Group]:
    """Drop groups one of whose sides others, inside it, make up: these take over its other side."""
    cover = list(cover)
    changed = True
    while changed:
        changed = False
        for i, g in enumerate(cover):
            for k in (0, 1):
                inside = [j for j, h in enumerate(cover) if j != i and h[k] & ~g[k] == 0]
                union = 0
                for j in inside:
                    union |= cover[j][k]
                if union == g[k]:
                    for j in inside:
                        h = list(cover[j])
                        h[1 - k] |= g[1 - k]
                        cover[j] = tuple(h)
                    del cover[i]
                    changed = True
                    break
            if changed:
                break
    return cover


def cover(rows: list[int], n_right: int) -> list[Group]:
    """Groups whose edges are exactly those of the block (row u: bits of its right neighbours)."""
    simple, steps = simplify(rows, n_right)
    found = lattice_cover(simple, n_right)
    if found is None:
        choices = [polish(heuristic_cover(simple, n_right))]
        if sum(r.bit_count() for r in simple) <= DUAL_EDGES:
            dual, exact = dual_cover(simple, n_right)
            choices = [dual] if exact else [dual, *choices]
        found = min(choices, key=len)
    return unsimplify(found, steps)


def cover_edges(edges: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """The groups of a block of (left, right) sides, each as its left and its right sides, larger groups first."""
    lefts, rights = sorted({a for a, _ in edges}), sorted({b for _, b in edges})
    at_l, at_r = {a: k for k, a in enumerate(lefts)}, {b: k for k, b in enumerate(rights)}
    rows = [0] * len(lefts)
    for a, b in edges:
        rows[at_l[a]] |= 1 << at_r[b]
    groups = sorted({g for g in cover(rows, len(rights)) if g[0] and g[1]}, key=lambda g: (-g[0].bit_count() * g[1].bit_count(), g))
    return [([lefts[u] for u in bits(g[0])], [rights[v] for v in bits(g[1])]) for g in groups]


def twin_cover(pairs: DataFrame) -> DataFrame:
    """(component, block, biclique, side, is_left): left sides with the same neighbours and these, without gathering a block.

    Sides are alike if they have as many neighbours and the sums of two hashes of
    these agree.  Groups are numbered by their smallest left side.
    """
    total = lambda seed: F.sum(F.xxhash64("r_side", F.lit(seed)).cast("decimal(38,0)"))
    seen = pairs.groupBy("component", "block", "l_side").agg(F.struct(F.count("*"), total(1), total(2)).alias("near"))
    twins = seen.groupBy("component", "block", "near").agg(F.min("l_side").alias("biclique"))
    lefts = seen.join(twins, ["component", "block", "near"]).select("component", "block", "biclique", F.col("l_side").alias("side"), F.lit(True).alias("is_left"))
    rights = pairs.join(twins.select("component", "block", F.col("biclique").alias("l_side"), "biclique"), ["component", "block", "l_side"])
    return lefts.union(rights.select("component", "block", "biclique", "r_side", F.lit(False)))


def biclique_cover(block_edges: DataFrame) -> DataFrame:
    """(component, block, biclique, side, is_left): the members of every group; all left ones of a group are linked to all right ones.

    A block whose sides are all linked is one group.  Of the others those of up to
    LARGE_BLOCK edges go to Python, each as one task's group; larger ones are
    covered by twins.
    """

    def solve(rows: pa.Table) -> pa.Table:
        data = rows.to_pydict()
        groups = cover_edges(list(zip(data["l_side"], data["r_side"], strict=True)))
        flat = [(data["component"][0], data["block"][0], k, side, left) for k, sides in enumerate(groups) for left, some in zip((True, False), sides, strict=True) for side in some]
        kinds = (("component", pa.int64()), ("block", pa.string()), ("biclique", pa.int64()), ("side", pa.int64()), ("is_left", pa.bool_()))
        return pa.table({n: pa.array([r[i] for r in flat], kind) for i, (n, kind) in enumerate(kinds)})

    pairs = block_edges.distinct()
    members = pairs.select("component", "block", F.explode(F.array(F.struct(F.lit(True).alias("is_left"), F.col("l_side").alias("side")), F.struct(F.lit(False).alias("is_left"), F.col("r_side").alias("side")))).alias("m")).select("component", "block", "m.*").distinct()
    sizes = members.groupBy("component", "block").agg(F.count_if("is_left").alias("l"), F.count_if(~F.col("is_left")).alias("r"))
    counts = pairs.groupBy("component", "block").agg(F.count("*").alias("n")).join(sizes, ["component", "block"])
    counts = Written(counts.select("component", "block", F.when(F.col("n") == F.col("l") * F.col("r"), "full").when(F.col("n") <= LARGE_BLOCK, "some").otherwise("large").alias("kind")), "kinds").df
    full = members.join(counts.where("kind = 'full'"), ["component", "block"]).select("component", "block", F.lit(0).cast("long").alias("biclique"), "side", "is_left")
    some = pairs.join(counts.where("kind = 'some'"), ["component", "block"]).drop("kind")
    found = full.union(some.groupBy("component", "block").applyInArrow(solve, "component bigint, block string, biclique bigint, side bigint, is_left boolean"))
    large = counts.where("kind = 'large'")
    return found.union(twin_cover(pairs.join(large, ["component", "block"]).drop("kind"))) if large.head(1) else found


def assigned(cover: DataFrame, block_edges: DataFrame) -> DataFrame:
    """(biclique_id, l_side, r_side): each edge in the first, largest group that has both its sides; groups without an edge go."""
    at = lambda left, name: cover.where(F.col("is_left") == left).select("component", "block", "biclique", F.col("side").alias(name))
    rows = block_edges.distinct().join(at(True, "l_side"), ["component", "block", "l_side"]).join(at(False, "r_side"), ["component", "block", "biclique", "r_side"])
    mine = rows.groupBy("component", "block", "l_side", "r_side").agg(F.min("biclique").alias("biclique"))
    return mine.select(F.concat_ws(".", "component", "block", "biclique").alias("biclique_id"), "l_side", "r_side")
