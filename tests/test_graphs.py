"""Appending, merging and checking graphs on small ones of known form."""

import random

import pytest
from braidwork.operators import traversal, validate
from braidwork.sources import gfa
from braidwork.streaming.gfa_stream import stream_links


def lines(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line_no long, value string")


def small(spark, paths=True):
    return gfa.parse_gfa(lines(spark, "S\ta\tAC", "S\tb\tGG\tLN:i:2", "S\tc\tTTA", "L\ta\t+\tb\t+\t0M", "L\tb\t+\tc\t-\t1M", "P\tp\ta+,b+,c-\t0M,1M", "P\tq\ta+,z+\t*", "P\tr\tb+\t*"), paths)


def test_paths_keep_overlaps_and_unknown_segments_are_told(spark):
    g = small(spark)
    assert sorted((r.path, r.ord, r.rev, r.overlap) for r in g.paths.collect()) == [("p", 0, False, "0M"), ("p", 1, False, "1M"), ("p", 2, True, None), ("r", 0, False, None)]
    assert [(r.line_no, r.reason) for r in g.rejects.collect()] == [(6, "path with unknown segment")]


def test_tags_of_any_number(spark):
    g = gfa.parse_gfa(lines(spark, "S\ta\tAC\t" + "\t".join(f"x{chr(97 + k // 26 % 26)}:Z:{k}" for k in range(1500)) + "\tzz:Z:last"))
    assert g.segments.first().tags["zz"] == "last" and g.segments.first().tags["xa"] == "0"


def test_append_shifts_ids_and_keeps_names_apart(spark):
    g = small(spark)
    segments, links, paths = traversal.append_with_paths(g.segments, g.links, g.paths, g.segments, g.links, g.paths)
    assert sorted((r.node_id, r.name) for r in segments.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "a/4"), (5, "b/5"), (6, "c/6")]
    rows = links.collect()
    assert len({r.link_id for r in rows}) == 4 and {(r.src, r.dst) for r in rows} == {(1, 2), (2, 3), (4, 5), (5, 6)}
    assert sorted({(r.path, r.node_id) for r in paths.collect()}) == [("p", 1), ("p", 2), ("p", 3), ("p/2", 4), ("p/2", 5), ("p/2", 6), ("r", 2), ("r/2", 5)]


def test_links_between_merged_runs(spark):
    """1 > 2 > 3, 3 > 4, 3 > 5 and a circle 6 > 7 > 6."""
    segments = spark.createDataFrame([(k, f"n{k}", "ACGTTGCA"[k : k + 2]) for k in range(1, 8)], "node_id long, name string, sequence string")
    arcs = [(1, False, 2, False), (2, False, 3, False), (3, False, 4, True), (3, False, 5, False), (6, False, 7, False), (7, False, 6, False)]
    links = spark.createDataFrame([(k, *a) for k, a in enumerate(arcs)], "link_id long, src long, src_rev boolean, dst long, dst_rev boolean")
    chains, left = traversal.unchop_graph(segments, links)
    runs = {r.chain: tuple(r.nodes) for r in chains.collect()}
    assert sorted(sorted(h // 2 for h in nodes) for nodes in runs.values()) == [[1, 2, 3], [4], [5], [6, 7]]
    found = set()
    for r in left.collect():
        a, b = runs[r.src], runs[r.dst]
        x, y = (a[0] ^ 1 if r.src_rev else a[-1]), (b[-1] ^ 1 if r.dst_rev else b[0])
        found.add(min((x, y), (y ^ 1, x ^ 1)))
    want = {min((2 * s + r, 2 * d + q), (2 * d + (not q), 2 * s + (not r))) for s, r, d, q in arcs[2:4]}
    assert want <= found and len(found) == 3
    (circle,) = found - want
    assert {circle[0] // 2, circle[1] // 2} == {6, 7}


def test_links_with_overlaps_are_not_blunt(spark):
    links = spark.createDataFrame([(1, "0M"), (2, "3M"), (3, "2I"), (4, "x"), (5, None)], "link_id long, cigar string")
    assert sorted(r.link_id for r in validate.not_blunt(links).collect()) == [2, 3, 4, 5]


def test_walks_are_spelled_whatever_their_length(spark):
    n = 30
    pieces = spark.createDataFrame([(f"x{k}", "ACGT"[k % 4]) for k in range(n)], "name string, sequence string")
    steps = spark.createDataFrame([(1, k, k + 1, f"x{k}", False) for k in range(n)], "node long, lo long, hi long, piece string, rev boolean")
    links = spark.createDataFrame([(f"x{k}", False, f"x{k + 1}", False) for k in range(n - 1)], "src string, src_rev boolean, dst string, dst_rev boolean")
    parents = spark.createDataFrame([(1, "whole", "ACGT" * 7 + "AC")], "node_id long, name string, sequence string")
    assert [tuple(r) for r in validate.spelled(steps, links, pieces, parents).collect()] == [("whole", "ACGT" * 7 + "AC")]


@pytest.mark.parametrize("record, reason", [("L\ta\t+\tb\t-\t2M", None), ("L\ta\t+\tb\t-\t2Q", "malformed cigar"), ("L\ta\t?\tb\t-\t2M", "malformed strand"), ("L\t\t+\tb\t-\t2M", "empty name"), ("L\ta\t+\ta\t-\t2M", "reversing self-overlap")])
def test_arriving_links_tell_why_they_are_none(spark, tmp_path, record, reason):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gfa").write_text(record + "\n")
    query = stream_links(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName(f"arrived{abs(hash(record))}").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.reason for r in spark.table(query.name).collect()] == [reason]


def test_names_stay_apart_however_often_graphs_are_appended(spark):
    g = small(spark)
    segments, links, paths = g.segments, g.links, g.paths
    for _ in range(2):
        segments, links, paths = traversal.append_with_paths(segments, links, paths, g.segments, g.links, g.paths)
    names = [r.name for r in segments.collect()]
    assert len(names) == len(set(names)) == 9
    steps = [(r.path, r.ord) for r in paths.collect()]
    assert len(steps) == len(set(steps)) and {p for p, _ in steps} == {"p", "p/2", "p/3", "r", "r/2", "r/3"}


def test_a_new_name_that_is_taken(spark):
    one = spark.createDataFrame([(1, "a/6", "AC"), (2, "x", "A"), (3, "a", "AC")], "node_id long, name string, sequence string")
    links = spark.createDataFrame([], "link_id long, src long, src_rev boolean, dst long, dst_rev boolean")
    more, _ = traversal.append(one, links, one, links)
    assert sorted(r.name for r in more.collect()) == ["a", "a/6", "a/6/4", "a/7", "x", "x/5"]


def test_strands_must_be_signs(spark):
    g = gfa.parse_gfa(lines(spark, "S\ta\tACGT", "S\tb\tACGT", "L\ta\tx\tb\t+\t2M", "L\ta\t+\tb\t?\t2M", "L\ta\t+\tb\t+\t2M", "P\tp\ta+,b\t*", "P\tq\ta+,b-\t*"), with_paths=True)
    assert [(r.src_rev, r.dst_rev) for r in g.links.collect()] == [(False, False)]
    assert sorted(r.reason for r in g.rejects.collect()) == ["malformed strand", "malformed strand", "path step without strand"]
    assert {r.path for r in g.paths.collect()} == {"q"}


def test_command_line(spark, tmp_path, monkeypatch, caplog):
    import io
    import sys
    from types import SimpleNamespace

    from braidwork import cli

    text = "S\ta\tTTTTACGT\nS\tb\tACGTGGGG\nS\tc\tCCCC\nL\ta\t+\tb\t+\t4M\nL\tb\t+\tc\t+\t0M\nL\ta\t+\tnobody\t+\t1M\n"
    (tmp_path / "g.gfa").write_text(text)
    read = lambda p: sorted(r.value for r in spark.read.text(f"file://{tmp_path}/{p}").collect())
    cli.main(["blunt", "-i", f"file://{tmp_path}/g.gfa", "-o", f"file://{tmp_path}/out", "-p", f"file://{tmp_path}/table", "-V"])
    assert sorted(r.split("\t")[2] for r in read("out") if r.startswith("S")) == ["ACGT", "CCCC", "GGGG", "TTTT"]
    assert "1 records left out: unknown segment" in caplog.text and len([r for r in read("table") if not r.startswith("#")]) == 4
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(text.encode())))
    cli.main(["blunt", "-i", "-", "-o", f"file://{tmp_path}/piped"])
    assert [r for r in read("piped") if r[0] == "S"] == [r for r in read("out") if r[0] == "S"]
    cli.main(["extract", "-i", f"file://{tmp_path}/g.gfa", "-s", "a", "-r", "1", "-o", f"file://{tmp_path}/near"])
    assert [r for r in read("near") if r[0] == "S"] == ["S\ta\tTTTTACGT", "S\tb\tACGTGGGG"]


def test_seeking_both_ways_and_hot_nodes(spark, monkeypatch):
    from braidwork.operators import links

    monkeypatch.setattr(links, "STRETCH_BITS", 2)
    rng = random.Random(4)
    sizes = {p: [rng.randrange(0, 5) for _ in range(rng.randrange(1, 15))] for p in range(6)}
    steps = spark.createDataFrame([(p, k, n) for p, s in sizes.items() for k, n in enumerate(s)], "path long, ord int, size long")
    asked = [(p, x) for p, s in sizes.items() for x in range(-1, sum(s) + 2)]
    positions = spark.createDataFrame(asked, "path long, pos long")
    for backward in (False, True):
        want = set()
        for p, s in sizes.items():
            flat = [(k, i) for k, n in enumerate(s) for i in range(n)]
            ends = [(k, n - 1 - i) for k, n in reversed(list(enumerate(s))) for i in reversed(range(n))]
            want |= {(p, x, *(ends if backward else flat)[x]) for x in range(sum(s))}
        assert {tuple(r) for r in traversal.seek(positions, steps, backward).collect()} == want


def test_runs_end_where_a_path_does(spark):
    """1 > 2 > 3 > 4 > 5 on one strand; p goes over all, q turned over 3 and 2, r only to 4."""
    segments = spark.createDataFrame([(k, f"n{k}", s) for k, s in enumerate(["AC", "GG", "TA", "CC", "A"], 1)], "node_id long, name string, sequence string")
    links = spark.createDataFrame([(k, k, False, k + 1, False) for k in range(1, 5)], "link_id long, src long, src_rev boolean, dst long, dst_rev boolean")
    walks = {"p": [(k, False) for k in range(1, 6)], "q": [(3, True), (2, True)], "r": [(2, False), (3, False), (4, False)]}
    paths = spark.createDataFrame([(p, k, n, r) for p, w in walks.items() for k, (n, r) in enumerate(w)], "path string, ord int, node_id long, rev boolean")
    chains, left, merged = traversal.unchop_paths(segments, links, paths)
    runs = {r.chain: (r.sequence, [h // 2 for h in r.nodes]) for r in chains.collect()}
    assert sorted(sorted(n) for _, n in runs.values()) == [[1], [2, 3], [4], [5]] and left.count() == 3
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    spelled: dict = {}
    for r in sorted(merged.collect(), key=lambda r: (r.path, r.ord)):
        s = runs[r.chain][0]
        spelled[r.path] = spelled.get(r.path, "") + (turned(s) if r.rev else s)
    assert spelled == {"p": "ACGGTACCA", "q": turned("GGTA"), "r": "GGTACC"}


def test_components_move_few_rows(spark, monkeypatch):
    """All rounds over a path write a few times its rows, not its rows in each of a logarithmic number of rounds."""
    from braidwork.operators import components

    rows = []

    class Counted(components.Written):
        def __init__(self, df, name):
            super().__init__(df, name)
            rows.append(self.df.count())

    monkeypatch.setattr(components, "Written", Counted)
    n = 4096
    path = spark.range(1, n).selectExpr("id AS a", "id + 1 AS b")
    assert components.connected_components(path).selectExpr("count(*)", "max(component)").first()[:] == (n, 1)
    assert sum(rows) < 8 * n


def test_components_of_wide_and_repeated_ids(spark):
    from braidwork.operators.components import connected_components

    edges = [(-7, 1 << 62), (1 << 62, -7), (1 << 62, 5), (9, 9), (None, 3), (11, None), (12, 13)]
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == [(-7, -7), (5, -7), (12, 12), (13, 12), (1 << 62, -7)]


def runs_by_hand(nodes, links, paths):
    """Node handles of unchop's runs, by walking; nodes: id to sequence."""
    at = {}
    for s, r, d, q in links:
        x, y = 2 * s + r, (2 * d + q) ^ 1
        for a, b in {(x, y), (y, x)}:
            at.setdefault(a, []).append(b)
    passed = {}
    for walk in paths.values():
        hs = [2 * n + r for n, r in walk]
        for k, h in enumerate(hs):
            passed.setdefault(h, set()).add(hs[k + 1] ^ 1 if k + 1 < len(hs) else None)
            passed.setdefault(h ^ 1, set()).add(hs[k - 1] if k else None)
    leads = lambda a, b: at.get(a) == [b] and a != b and passed.get(a, {b}) == {b}
    after = {a: b ^ 1 for a, (b, *_) in at.items() if leads(a, b) and leads(b, a)}
    before = {n: h for h, n in after.items()}
    runs, seen = set(), set()
    for n in sorted(nodes):
        if n in seen:
            continue
        h = 2 * n
        while h in before and before[h] != 2 * n:
            h = before[h]
        if h in before:  # a circle starts at its smallest node
            h = 2 * n
        run = [h]
        while run[-1] in after and after[run[-1]] != run[0]:
            run.append(after[run[-1]])
        seen |= {x >> 1 for x in run}
        turned = [x ^ 1 for x in reversed(run)]
        runs.add(tuple(min(run, turned)))
    return runs


@pytest.mark.parametrize("spread", [1, 4099, 2731])
def test_runs_of_random_graphs(spark, spread):
    """Ids in a row, one to a stretch, and two to a stretch; turned nodes, branches, circles, loops, repeated links and paths."""
    rng = random.Random(spread)
    n = 240
    ids = [spread * (k + 1) for k in range(n)]
    links, k = [], 0
    rev = {i: rng.random() < 0.15 for i in ids}
    while k < n:
        size = min(rng.choice([1, 1, 2, 3, 5, 9, 30]), n - k)
        some = ids[k : k + size]
        if rng.random() < 0.4:
            rng.shuffle(some)
        links += [(a, rev[a], b, rev[b]) for a, b in zip(some, some[1:])]
        if rng.random() < 0.3:
            links.append((some[-1], rev[some[-1]], some[0], rev[some[0]]))
        k += size
    links = [(b, not q, a, not p) if rng.random() < 0.3 else (a, p, b, q) for a, p, b, q in links]
    links += [(rng.choice(ids), rng.random() < 0.5, rng.choice(ids), rng.random() < 0.5) for _ in range(12)] + [links[5], (ids[7], False, ids[7], True)]
    ahead = {}
    for a, p, b, q in links:
        ahead.setdefault(2 * a + p, []).append(2 * b + q)
        ahead.setdefault((2 * b + q) ^ 1, []).append((2 * a + p) ^ 1)
    paths = {}
    for w in range(12):
        walk = [2 * rng.choice(ids) + rng.randrange(2)]
        while walk[-1] in ahead and rng.random() < 0.85:
            walk.append(rng.choice(ahead[walk[-1]]))
        paths[f"w{w}"] = [(h >> 1, bool(h & 1)) for h in walk]
    sequence = {i: "".join(rng.choice("ACGT") for _ in range(rng.randrange(4))) for i in ids}
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    spell = lambda hs: "".join(turned(sequence[h >> 1]) if h & 1 else sequence[h >> 1] for h in hs)
    segments = spark.createDataFrame(list(sequence.items()), "node_id long, sequence string")
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(links)], "link_id long, src long, src_rev boolean, dst long, dst_rev boolean")
    steps = spark.createDataFrame([(p, k, *x) for p, w in paths.items() for k, x in enumerate(w)], "path string, ord int, node_id long, rev boolean")
    for walks, (chains, merged) in (({}, (traversal.unchop(segments, table), None)), (paths, traversal.unchop_paths(segments, table, steps)[::2])):
        rows = chains.collect()
        assert {tuple(r.nodes) for r in rows} == runs_by_hand(sequence, links, walks) and len(rows) == len({r.chain for r in rows})
        assert all(r.sequence == spell(r.nodes) and r.chain == r.nodes[0] for r in rows)
    found = {r.chain: r.sequence for r in rows}
    spelled = {}
    for r in sorted(merged.collect(), key=lambda r: (r.path, r.ord)):
        spelled[r.path] = spelled.get(r.path, "") + (turned(found[r.chain]) if r.rev else found[r.chain])
    assert {p: spelled.get(p, "") for p in paths} == {p: spell([2 * n + r for n, r in w]) for p, w in paths.items()}


def test_merging_near_nodes_moves_few_rows(spark, monkeypatch):
    """Chopped nodes, numbered in a row, are merged where they lie: no round writes a row for each of their handles."""
    rows = []

    class Counted(traversal.Written):
        def __init__(self, df, name):
            super().__init__(df, name)
            rows.append(self.df.count())

    monkeypatch.setattr(traversal, "Written", Counted)
    n = 4000
    segments = spark.range(n).selectExpr("id AS node_id", "'AC' AS sequence")
    links = spark.range(n - 1).where("id % 4 < 3").selectExpr("id AS link_id", "id AS src", "false AS src_rev", "id + 1 AS dst", "false AS dst_rev")
    assert traversal.unchop(segments, links).count() == n / 4
    assert sum(rows) < n
