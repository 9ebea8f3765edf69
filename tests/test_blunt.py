"""Invariants of blunting on small graphs of many shapes."""

import random

import pytest
from braidwork.operators import poa, progressive, traversal, validate
from braidwork.plans import blunt
from braidwork.sources import gfa, provenance


def graph(spark, text):
    lines = spark.createDataFrame(list(enumerate(text.strip().split("\n"))), "line_no bigint, value string")
    return gfa.parse_gfa(lines, with_paths=True)


def of(segments, links):
    return "\n".join([f"S\t{n}\t{s}" for n, s in segments] + ["\t".join(("L", *r)) for r in links])


SHAPES = {
    "one inexact link": of([("a", "ACGTACGGTT"), ("b", "ACGCTTGACAT")], [("a", "+", "b", "+", "7M")]),
    "incomplete block": of([("a", "TTTACGTACG"), ("b", "GGGACGTACG"), ("c", "ACGTACGAAA"), ("d", "ACGTACGCCC")], [("a", "+", "c", "+", "7M"), ("a", "+", "d", "+", "7M"), ("b", "+", "c", "+", "7M")]),
    "cycle of two": of([("a", "ACGTTTG"), ("b", "TTTGACG")], [("a", "+", "b", "+", "4M"), ("b", "+", "a", "+", "3M")]),
    "loop": of([("a", "ACGTTTACG"), ("b", "TTTACGCCA"), ("c", "GGGACG")], [("a", "+", "a", "+", "3M"), ("a", "+", "b", "+", "6M"), ("c", "+", "a", "+", "3M")]),
    "switching strands": of([("a", "ACGTTTG"), ("b", "TCGCAAA")], [("a", "+", "b", "-", "4M"), ("a", "-", "b", "+", "1M")]),
    "whole node": of([("a", "GGACGTAC"), ("b", "ACGTAC"), ("c", "ACGTACTT")], [("a", "+", "b", "+", "6M"), ("b", "+", "c", "+", "6M")]),
    "crossing": of([("a", "CCCACGTTGCA"), ("b", "ACGTTGCAGGT"), ("c", "TGCAGGTAAA"), ("d", "GCAGGTCCC")], [("a", "+", "b", "+", "8M"), ("b", "+", "c", "+", "7M"), ("b", "+", "d", "+", "6M")]),
    "indels": of([("a", "TTACGTACGT"), ("b", "ACGACGTGG"), ("c", "CAGGTT")], [("a", "+", "b", "+", "3M1D4M"), ("b", "-", "c", "-", "3M"), ("a", "-", "c", "+", "0M")]),
    "bare": of([("a", "ACG"), ("b", "TTT"), ("c", "GG")], [("a", "+", "b", "+", "0M"), ("b", "+", "c", "-", "0M")]),
}


def check(spark, g):
    segments, links = g.segments.drop("tags").cache(), g.links.cache()
    b = blunt.blunt(segments, links)
    p = b.provenance()
    assert validate.inconsistent(b.segments, p, segments).count() == 0
    assert validate.not_covered(p, segments).count() == 0
    assert validate.lost_links(b.steps, b.groups).count() == 0
    assert validate.new_adjacencies(b.steps, b.groups).count() == 0
    assert "cigar" not in b.links.columns
    got = {r.name: r.sequence for r in validate.spelled(b.steps, b.links, b.segments, segments).collect()}
    assert got == {r.name: r.sequence for r in segments.collect()}
    return b, segments, links


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    check(spark, graph(spark, SHAPES[shape]))


def test_random_graphs(spark):
    rng = random.Random(11)
    rc = str.maketrans("ACGT", "TGCA")
    reference = "".join(rng.choice("ACGT") for _ in range(160))
    reads, links = [], []
    for k in range(14):
        start = rng.randrange(0, 120)
        reads.append([start, start + rng.randrange(18, 40)])
    reads.sort()
    text = {}
    for k, (a, z) in enumerate(reads):
        s = "".join(c if rng.random() > 0.04 else rng.choice("ACGT") for c in reference[a : min(z, 160)])
        text[k] = (s, rng.random() < 0.4)
    for i in text:
        for j in text:
            size = min(reads[i][1], 160) - reads[j][0]
            if i < j and 0 < size <= min(len(text[i][0]), len(text[j][0])) and min(reads[j][1], 160) >= min(reads[i][1], 160):
                links.append((f"n{i}", "-" if text[i][1] else "+", f"n{j}", "-" if text[j][1] else "+", f"{size}M"))
    segments = [(f"n{k}", s[::-1].translate(rc) if flip else s) for k, (s, flip) in text.items()]
    check(spark, graph(spark, of(segments, links)))


def test_provenance_round_trip(spark, tmp_path):
    b, _, _ = check(spark, graph(spark, SHAPES["crossing"]))
    p = b.provenance()
    provenance.write_provenance(p, f"{tmp_path}/table")
    read = provenance.read_provenance(spark, f"{tmp_path}/table")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, p.select("out_id", "parent", "begin", "end", "rev").collect()))


def test_files(spark, tmp_path):
    path = tmp_path / "in.gfa"
    path.write_text("# a comment\n\nL\tb\t+\tc\t+\t3M\nH\tVN:Z:1.0\nS\ta\tACGTTT\tLN:i:6\nS\tb\tTTTCTGG\nS\tc\tTGGAA\nS\ta\tACGTTT\nL\ta\t+\tb\t+\t3M\nP\tw\ta+,b+,c+\t3M,3M")
    g = gfa.read_gfa(spark, str(path), with_paths=True)
    assert [(r.node_id, r.name) for r in g.segments.orderBy("node_id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert g.segments.where("name = 'a'").first().tags == {"LN": "6"}
    assert g.rejects.count() == 0 and g.links.count() == 2
    assert [(r.ord, r.node_id) for r in g.paths.orderBy("ord").collect()] == [(0, 1), (1, 2), (2, 3)]
    b = blunt.blunt_file(spark, str(path), f"{tmp_path}/out", f"{tmp_path}/table")
    again = gfa.read_gfa(spark, f"{tmp_path}/out")
    assert again.segments.count() == b.segments.count() and again.links.count() == b.links.count()
    merged = traversal.unchop(again.segments, again.links).collect()
    assert {r.sequence for r in merged} & {"ACGTTTCTGGAA", "TTCCAGAAACGT"}
    near, _ = traversal.extract_subgraph(g.segments, g.links, "a", 1)
    assert sorted(r.name for r in near.collect()) == ["a", "b"]
    with pytest.raises(KeyError):
        traversal.extract_subgraph(g.segments, g.links, "z", 1)


def test_alignment_kernels():
    rng = random.Random(3)
    for _ in range(40):
        base = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 50)))
        seqs = ["".join(c for c in base if rng.random() > 0.1) or "A" for _ in range(rng.randrange(1, 6))]
        for nodes, paths in (poa.align_group(seqs), poa.align_group(seqs, "medium")):
            assert ["".join(nodes[v] for v in p) for p in paths] == seqs
    long = "".join(rng.choice("ACGT") for _ in range(30_000))
    other = long[:9_000] + "T" + long[9_050:20_000] + "ACGTACGT" + long[20_000:]
    x, y = progressive.profile(long), progressive.profile(other)
    found = [(i, j) for i, j in progressive.together(x, y, long, other, 1) if long[i] == other[j]]
    assert len(found) > 29_900
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))


def test_empty_graph(spark):
    empty = gfa.parse_gfa(spark.createDataFrame([], "line_no bigint, value string"))
    b = blunt.blunt(empty.segments.drop("tags"), empty.links)
    assert b.segments.count() == b.links.count() == b.provenance().count() == 0


def test_stream(spark, tmp_path):
    from braidwork.streaming.gfa_stream import stream_links

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gfa").write_text("S\ta\tACG\nL\ta\t+\tb\t-\t2M1I\n")
    q = stream_links(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("links_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("links_seen").collect()] == [("a", False, "b", True, "2M1I", 2, 3, None)]


def test_orders_and_orientations(spark):
    g = graph(spark, of([("a", "AC"), ("b", "CG"), ("c", "GT"), ("d", "TT")], [("a", "+", "b", "-", "1M"), ("b", "-", "c", "+", "1M"), ("c", "+", "c", "+", "1M")]))
    found = {r.node_id: r for r in traversal.orientations(g.segments, g.links).collect()}
    assert all(r.orientable for r in found.values()) and found[2].flip != found[1].flip
    order = {r.node_id: r.level for r in traversal.topological_order(g.segments, g.links).collect()}
    assert len(order) == 4 and len({order[1], order[2], order[3]}) == 3
    twisted = graph(spark, of([("a", "AC"), ("b", "CG")], [("a", "+", "b", "+", "1M"), ("a", "-", "b", "+", "1M")]))
    assert not any(r.orientable for r in traversal.orientations(twisted.segments, twisted.links).collect())
    assert {r.path for r in traversal.source_sink_paths(g.segments, g.links).collect()} >= {"4+"}


def test_range_lookups(spark):
    from braidwork.operators.links import neighbours_at

    at = spark.createDataFrame([(1, 5), (1, 0), (2, 3)], "node long, pos long")
    others = spark.createDataFrame([(1, 2), (1, 5), (1, 9)], "node long, other_pos long")
    want = {"lt": {(1, 5): 2, (1, 0): None}, "le": {(1, 5): 5, (1, 0): None}, "gt": {(1, 5): 9, (1, 0): 2}, "ge": {(1, 5): 5, (1, 0): 2}}
    for how, pairs in want.items():
        got = {(r.node, r.pos): r.other_pos for r in neighbours_at(at, others, how).collect()}
        assert got == pairs | {(2, 3): None}


def test_range_lookups_over_long_nodes(spark):
    """Positions in several stretches of a node, some repeated, against a scan; and every task holds one sort."""
    from braidwork.operators import links as L

    rng = random.Random(6)
    far = 5 << L.STRETCH_BITS
    at = [(n, rng.randrange(far)) for n in range(4) for _ in range(40)]
    at += at[:30]
    known = [(n, rng.randrange(far)) for n in range(3) for _ in range(6)] + [(3, None)] + [(0, at[0][1])] * 2
    positions, others = spark.createDataFrame(at, "node long, pos long"), spark.createDataFrame(known, "node long, other_pos long")
    fits = {"lt": (max, lambda o, p: o < p), "le": (max, lambda o, p: o <= p), "gt": (min, lambda o, p: o > p), "ge": (min, lambda o, p: o >= p)}
    for how, (best, good) in fits.items():
        want = {(n, p): best((o for m, o in known if m == n and o is not None and good(o, p)), default=None) for n, p in at}
        found = L.neighbours_at(positions, others, how)
        rows = found.collect()
        assert {(r.node, r.pos): r.other_pos for r in rows} == want and len(rows) == len(want)
    plan = L.neighbours_at(positions, spark.createDataFrame([(9, 1)], "node long, other_pos long"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Aggregate", "Join", "Window"))


def test_lonely_links_skip_the_cover(spark, monkeypatch):
    """Links whose sides have no other are groups without blocks or covers; with others beside them they are named and dealt as blocks would be."""
    from braidwork.operators import biclique, bipartite
    from braidwork.plans.blunt import covered_groups

    rows = [(1, 1, False, 2, False), (2, 2, False, 3, True), (3, 2, False, 3, True), (4, 4, True, 4, False), (5, 5, True, 6, False)]
    more = [(6, 7, False, 8, False), (7, 7, False, 9, False), (8, 10, False, 8, False)]
    links = lambda some: spark.createDataFrame(some, "link_id bigint, src bigint, src_rev boolean, dst bigint, dst_rev boolean")
    of = lambda df: sorted(map(tuple, df.select("biclique_id", "l_side", "r_side").collect()))

    def through_blocks(some):
        edges = spark.createDataFrame([(2 * s + r, (2 * d + e) ^ 1) for _, s, r, d, e in some], "x bigint, y bigint")
        blocks = bipartite.block_edges(edges)
        return of(biclique.assigned(biclique.biclique_cover(blocks), blocks))

    assert of(covered_groups(links(rows + more))) == through_blocks(rows + more)
    expected = through_blocks(rows)
    monkeypatch.setattr(bipartite, "block_edges", None)
    assert of(covered_groups(links(rows))) == expected
