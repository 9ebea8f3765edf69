"""Orders of deep, nested and cyclic graphs."""

import random

import pytest
from braidwork.operators import orders, traversal


def arcs_of(spark, pairs):
    return spark.createDataFrame(pairs, "u long, v long")


def nodes_of(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "v long")


def backward(levels, pairs):
    return [(u, v) for u, v in pairs if levels[u] >= levels[v]]


def levels_of(spark, nodes, pairs, strict=False):
    rows = orders.order(nodes_of(spark, nodes), arcs_of(spark, pairs), strict).collect()
    assert len(rows) == len(nodes)
    return {r.v: r.level for r in rows}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = orders.Written
    monkeypatch.setattr(orders, "Written", lambda df, name: written.append(name) or real(df, name))
    n = 100_000
    links = spark.range(n - 1).selectExpr("(id * 7919) % 100003 as u", "((id + 1) * 7919) % 100003 as v")
    nodes = spark.range(n).selectExpr("(id * 7919) % 100003 as v")
    found = {r.v: r.level for r in orders.order(nodes, links, strict=True).collect()}
    in_order = [found[(k * 7919) % 100003] for k in range(n)]
    assert all(a < b for a, b in zip(in_order, in_order[1:])) and len(written) < 60


def test_random_graphs_without_cycles(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (6, 5), (14, 20), (25, 70)):
        names = rng.sample(range(1000), n)
        pairs = [(names[a], names[b]) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(m))] if n > 1 else []
        assert not backward(levels_of(spark, names, pairs, strict=True), pairs)


def test_cycles_lose_only_arcs_of_theirs(spark):
    """Two cores in which every node has two ways in and out, one leading to the other over nodes that don't lie on cycles."""
    core = lambda base: [(base + a, base + b) for a in range(4) for b in range(4) if a != b]
    bridge = [(1, 50), (2, 50), (1, 51), (2, 51), (50, 52), (51, 52), (50, 101), (51, 101), (52, 102)]
    pairs = core(0) + bridge + core(100)
    levels = levels_of(spark, {x for p in pairs for x in p}, pairs)
    assert not set(backward(levels, pairs)) & set(bridge)
    # four nodes that are all linked both ways can have half of their arcs forward
    assert len(backward(levels, pairs)) == 12


@pytest.mark.parametrize("pairs, lost", [([(1, 2), (2, 3), (3, 1)], 1), ([(1, 2), (2, 3), (3, 2), (3, 4)], 1), ([(5, 5), (5, 6)], 1), ([(1, 2), (2, 1), (3, 1), (2, 4), (5, 6), (6, 5)], 2)])
def test_cycles_are_broken_once_or_refused(spark, pairs, lost):
    nodes = {x for p in pairs for x in p}
    assert len(backward(levels_of(spark, nodes, pairs), pairs)) == lost
    with pytest.raises(orders.Cyclic):
        levels_of(spark, nodes, pairs, strict=True)


def test_no_nodes_and_nodes_without_links(spark):
    assert levels_of(spark, [], []) == {}
    assert set(levels_of(spark, [3, 9], [])) == {3, 9}


def test_a_node_that_turns_on_itself_has_no_strict_order(spark):
    segments = spark.createDataFrame([(1, "a", "AC"), (2, "b", "GT")], "node_id long, name string, sequence string")
    twisted = spark.createDataFrame([(1, 1, False, 2, False), (2, 1, True, 2, False)], "link_id long, src long, src_rev boolean, dst long, dst_rev boolean")
    assert traversal.topological_order(segments, twisted).count() == 2
    with pytest.raises(orders.Cyclic):
        traversal.topological_order(segments, twisted, strict=True)


def test_walks_find_their_way_past_dead_ends_and_circles(spark):
    """Random places, some of them without bases so that arcs can go round, against a search."""
    from braidwork.operators import validate

    rng = random.Random(11)
    states, arcs, ends = [], [], {}
    for node in range(30):
        size = rng.randrange(1, 8)
        mine = sorted({(f"x{rng.randrange(4)}", False, lo, min(size, lo + rng.choice((0, 1, 1, 2)))) for lo in [rng.randrange(size + 1) for _ in range(14)]})
        links = [(a, b) for a in mine for b in mine if a != b and a[3] == b[2] and rng.random() < 0.4]
        seen = {a for a in mine if a[2] == 0}
        while more := {b for a, b in links if a in seen} - seen:
            seen |= more
        ends[node] = (size, mine, set(links), any(a[3] == size for a in seen))
        states += [(node, a, a[3] == size) for a in mine]
        arcs += [(node, a, b) for a, b in links]
    at = "struct<piece:string,rev:boolean,lo:bigint,hi:bigint>"
    found: dict = {}
    for r in validate.chosen_walks(spark.createDataFrame(states, f"node long, at {at}, last boolean"), spark.createDataFrame(arcs, f"node long, a {at}, b {at}")).collect():
        found.setdefault(r.node, []).append((-r.d, tuple(r["at"])))
    assert set(found) == {n for n, e in ends.items() if e[3]} and 5 < len(found) < 30
    for node, places in found.items():
        size, _, links, _ = ends[node]
        walk = [a for _, a in sorted(places)]
        assert walk[0][2] == 0 and walk[-1][3] == size and all(p in links for p in zip(walk, walk[1:]))
