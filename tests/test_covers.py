import random
from itertools import combinations

from braidwork.operators import biclique, bipartite, colouring


def random_rows(rng, n, m, p):
    return [sum(1 << v for v in range(m) if rng.random() < p) for _ in range(n)]


def edges_of(rows):
    return {(u, v) for u, row in enumerate(rows) for v in colouring.bits(row)}


def covered(groups):
    return {(u, v) for a, b in groups for u in colouring.bits(a) for v in colouring.bits(b)}


def least_size(rows, m):
    edges = edges_of(rows)
    groups = biclique.concepts(rows, m)
    return next(k for k in range(len(edges) + 1) if any(covered(c) == edges for c in combinations(groups, k)))


def test_covers_are_exact_unions():
    rng = random.Random(0)
    for k in range(150):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        rows = random_rows(rng, n, m, (0.3, 0.6, 0.85)[k % 3])
        for method in (biclique.cover, biclique.heuristic_cover, lambda r, m: biclique.dual_cover(r, m)[0], lambda r, m: biclique.polish(biclique.heuristic_cover(r, m))):
            assert covered(method(rows, m)) == edges_of(rows)
        found = biclique.lattice_cover(rows, m)
        assert found is None or covered(found) == edges_of(rows)


def test_lattice_and_small_duals_are_least():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, 4, 4, 0.5)
        least = least_size(rows, 4)
        found = biclique.lattice_cover(rows, 4)
        assert found is None or len(found) == least
        dual, exact = biclique.dual_cover(rows, 4)
        assert not exact or len(dual) == least


def test_a_domino_is_seen():
    domino = [0b011, 0b111, 0b110]  # a 3 x 3 block of 7 edges
    assert biclique.has_domino(domino, biclique.concepts(domino, 3))
    free = [0b011, 0b010, 0b110]
    assert not biclique.has_domino(free, biclique.concepts(free, 3))


def test_polish_drops_a_group():
    cover = [(0b0011, 0b01), (0b1100, 0b10), (0b1111, 0b100)]
    assert len(biclique.polish(cover)) == 2 and covered(biclique.polish(cover)) == covered(cover)


def test_blocks_hold_each_edge_once():
    rng = random.Random(2)
    for _ in range(80):
        n = rng.randrange(2, 14)
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(1, 30))})
        found = bipartite.blocks(edges)
        assert sorted(tuple(sorted(e)) for b in found for e in b) == edges
        for b in found:
            assert not {x for x, _ in b} & {y for _, y in b}
            assert len(bipartite.pieces(bipartite.adjacency(b))) == 1 and min(map(min, b)) in {x for x, _ in b}


def test_cuts():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randrange(3, 8)
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(12)})
        vertices = sorted({x for e in edges for x in e})
        best = max(bipartite.cut_size(edges, {v for i, v in enumerate(vertices) if m >> i & 1}) for m in range(1 << len(vertices)))
        assert bipartite.cut_size(edges, bipartite.best_cut(vertices, edges)) == best
        refined = bipartite.refined_cut(vertices, edges, bipartite.dealt_cut(vertices, edges))
        assert 2 * bipartite.cut_size(edges, refined) >= len(edges)
    assert bipartite.two_colours(bipartite.adjacency([(0, 1), (1, 2), (0, 2)])) is None


def test_colourings():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randrange(1, 10)
        adj = [0] * n
        for a, b in combinations(range(n), 2):
            if rng.random() < 0.5:
                adj[a] |= 1 << b
                adj[b] |= 1 << a
        exact = colouring.exact_colours(adj)
        for order in (colouring.by_degree(adj), colouring.least_first(adj), colouring.shuffled(adj, 5), colouring.walked(adj, True), colouring.walked(adj, False)):
            assert sorted(order) == list(range(n))
            for method in (colouring.greedy_colours, colouring.interchange_colours):
                found = method(adj, order)
                assert all(found[a] != found[b] for a in range(n) for b in colouring.bits(adj[a]))
                assert max(found) >= max(exact)
    prism = [0] * 8
    for a, b in [*combinations(range(4), 2), *combinations(range(4, 8), 2), *((k, k + 4) for k in range(4))]:
        prism[a] |= 1 << b
        prism[b] |= 1 << a
    assert max(colouring.colours(prism)) + 1 == 4


def dealt(spark, edges):
    return spark.createDataFrame(edges, "x long, y long").repartition(4)


def check_blocks(found, edges):
    by = {}
    for r in found:
        by.setdefault((r.component, r.block), []).append((r.l_side, r.r_side))
    assert sorted(tuple(sorted(e)) for b in by.values() for e in b) == sorted(edges)
    for b in by.values():
        assert not {x for x, _ in b} & {y for _, y in b}
        assert len(bipartite.pieces(bipartite.adjacency(b))) == 1 and min(map(min, b)) in {x for x, _ in b}


def test_large_odd_pieces_are_cut_where_they_lie(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(bipartite, "SMALL_PIECE", 40)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(400)} | {(100, 101), (101, 102), (100, 102)} | {(200 + a, 300 + b) for a in range(5) for b in range(4)})
    found = bipartite.block_edges(dealt(spark, edges + edges[:3] + [(7, 7)])).collect()
    check_blocks(found, edges)
    assert {r.component for r in found if r.l_side >= 200} == {200} and {r.component for r in found if 100 <= r.l_side < 200} == {100}
    assert len([r for r in found if r.block.startswith("c0.")]) >= 200 - 40


def test_a_cut_that_no_side_gains_by_leaving(spark):
    rng = random.Random(13)
    edges = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(300)})
    flag = {r.side: r.flag for r in bipartite.large_cut(dealt(spark, edges)).collect()}
    adj = bipartite.adjacency(edges)
    assert all(2 * sum(flag[y] != flag[v] for y in adj[v]) >= len(adj[v]) for v in adj)


def test_bipartite_pieces_stay_out_of_python(spark):
    found = bipartite.block_edges(dealt(spark, [(2 * k, 2 * k + 1) for k in range(50)] + [(2 * k + 1, 2 * k + 2) for k in range(49)]))
    assert found.count() == 99 and "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_cover_members_and_twins(spark, monkeypatch):
    rng = random.Random(14)
    edges = sorted({(a, 1_000 + b) for a in range(30) for b in range(20) if (a * b) % 3 == 0} | {(a, 1_000 + rng.randrange(20)) for a in range(30)})
    for most in (20_000, 10):
        monkeypatch.setattr(biclique, "LARGE_BLOCK", most)
        blocks = bipartite.block_edges(dealt(spark, edges))
        groups = {}
        for r in biclique.biclique_cover(blocks).collect():
            groups.setdefault((r.component, r.block, r.biclique), ([], []))[0 if r.is_left else 1].append(r.side)
        assert {(a, b) for lefts, rights in groups.values() for a in lefts for b in rights} == set(edges)
        given = biclique.assigned(biclique.biclique_cover(blocks), blocks).collect()
        assert sorted((r.l_side, r.r_side) for r in given) == edges


def test_dense_pieces_are_dealt_in_few_turns(spark, monkeypatch):
    """However dense a large piece, the number of rounds that better its cut is bounded and all its edges are dealt in a turn or two."""
    monkeypatch.setattr(bipartite, "SMALL_PIECE", 40)
    bounds, cut = [], bipartite.large_cut
    monkeypatch.setattr(bipartite, "large_cut", lambda edges, seed=1, rounds=None: bounds.append(rounds) or cut(edges, seed, rounds))
    edges = [(a, b) for a in range(40) for b in range(a)]
    found = bipartite.block_edges(dealt(spark, edges)).collect()
    assert sorted((min(r.l_side, r.r_side), max(r.l_side, r.r_side)) for r in found) == sorted((b, a) for a, b in edges)
    blocks = {}
    for r in found:
        lefts, rights = blocks.setdefault((r.component, r.block), (set(), set()))
        lefts.add(r.l_side)
        rights.add(r.r_side)
    assert all(not lefts & rights and min(lefts) < min(rights) for lefts, rights in blocks.values())
    assert len(bounds) <= 2 and None not in bounds
