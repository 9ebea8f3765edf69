"""The three tiers of alignment, against plain dynamic programs and constructed variants."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.operators import poa, progressive, splice
from braidwork.plans import blunt
from braidwork.operators import validate


def plain(a, b, by, local=False):
    """Score of a best affine alignment, cell by cell."""
    low = -(10**9)
    best, up, left = ([[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(3))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                up[i][j] = max(best[i - 1][j] + by.first, up[i - 1][j] + by.more)
            if j:
                left[i][j] = max(best[i][j - 1] + by.first, left[i][j - 1] + by.more)
            through = best[i - 1][j - 1] + (by.match if a[i - 1] == b[j - 1] else by.mismatch) if i and j else low
            best[i][j] = max(through, up[i][j], left[i][j], 0 if local or i == j == 0 else low)
    return max(map(max, best)) if local else best[-1][-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = rng.choice("ACGT")
        elif kind < 0.7 and len(out) > 1:
            del out[k]
        else:
            out[k:k] = [rng.choice("ACGT") for _ in range(rng.randrange(1, 6))]
    return "".join(out)


def score_of(pairs, a, b, by):
    total, gap = 0, None
    for i, j in pairs:
        kind = "up" if j is None else "left" if i is None else None
        total += (by.more if kind == gap else by.first) if kind else by.match if a[i] == b[j] else by.mismatch
        gap = kind
    return total


@pytest.mark.parametrize("by", [poa.SHORT, poa.MEDIUM, poa.LONG])
def test_scores_are_those_of_plain_affine_alignment(by):
    rng = random.Random(3)
    for _ in range(120):
        a = "".join(rng.choice("ACGT"[: rng.randrange(2, 5)]) for _ in range(rng.randrange(1, 30)))
        b = changed(rng, a, rng.randrange(6))
        g = poa.BaseGraph()
        g.thread(a)
        for band in (None, 1, poa.BAND):
            score, pairs = g.align(b, by, False, band)
            assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
            assert score_of(pairs, a, b, by) == score <= plain(a, b, by)
            assert score == plain(a, b, by) or band == 1
        score, pairs = g.align(b, by, True)
        assert score == plain(a, b, by, True) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_alignment_to_a_graph_is_the_best_over_its_paths():
    rng = random.Random(4)
    for _ in range(40):
        a = "".join(rng.choice("ACGT") for _ in range(14))
        g = poa.BaseGraph()
        for s in (a, changed(rng, a, 3), changed(rng, a, 3)):
            g.thread(s)
        ways, stack = set(), [[v] for v in range(len(g.base)) if not g.before[v]]
        while stack:
            p = stack.pop()
            stack += [[*p, w] for w in g.after[p[-1]]]
            if not g.after[p[-1]]:
                ways.add("".join(g.base[v] for v in p))
        b = changed(rng, a, 3)
        assert g.align(b, poa.MEDIUM)[0] == max(plain(w, b, poa.MEDIUM) for w in ways)


def test_band_follows_and_memory_is_bounded():
    rng = random.Random(5)
    a = "".join(rng.choice("ACGT") for _ in range(3_000))
    b = a[:900] + a[1_100:2_000] + "ACGTTGCA" * 4 + a[2_000:]
    g = poa.BaseGraph()
    g.thread(a)
    table = poa._Table(g, b, poa.MEDIUM, False, 40)
    assert sum(map(len, table.best_of)) < 3_001 * 400
    whole, _ = g.align(b, poa.MEDIUM)
    assert g.align(b, poa.MEDIUM, False, 40)[0] == whole
    nodes, paths = poa.align_group([a, b, changed(rng, b, 3)], "medium")
    assert ["".join(nodes[v] for v in p) for p in paths][:2] == [a, b] and sum(map(len, nodes)) < 3_050


def shared(paths, order):
    places: dict = {}
    for i, p in zip(order, paths, strict=True):
        for k, v in enumerate(p):
            places.setdefault(v, set()).add((i, k))
    return frozenset(map(frozenset, places.values()))


def test_second_pass_forgets_the_order_of_the_first():
    seqs = ["TAGAAGGCACAGAAGACCAAATA", "TAGAAGGCACATCAGATATTATTA", "TAGAAGGCACATCAGATCATATGA", "TGAAGGCACATAAAGATACATATTA"]
    first, second = set(), set()
    for order in permutations(range(4)):
        mine = [seqs[k] for k in order]
        g, paths = poa.in_turn(mine, [1] * 4, poa.SHORT, True)
        first.add(shared(paths, order))
        again = poa.in_turn(mine, [1] * 4, poa.SHORT, True, seed=g.consensus())[1]
        second.add(shared(again, order))
        assert poa.agreement(poa.short_group(mine, [1] * 4)[1]) >= poa.agreement(paths)
    assert len(first) == 12 and len(second) == 1


def test_consensus_follows_weights():
    g, _ = poa.in_turn(["ACGTACGT", "ACCTACGT"], [1, 5], poa.SHORT, True)
    assert g.consensus() == "ACCTACGT"


def test_groups_spell_their_sequences():
    rng = random.Random(8)
    for tier in ("short", "medium"):
        for _ in range(25):
            a = "".join(rng.choice("ACGTN") for _ in range(40))
            seqs = [changed(rng, a, rng.randrange(8)) for _ in range(rng.randrange(1, 7))]
            nodes, paths = poa.align_group(seqs + seqs[:1], tier)
            assert ["".join(nodes[v] for v in p) for p in paths] == seqs + seqs[:1]


def test_profiles_join_by_best_affine_alignment():
    rng = random.Random(9)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 25)))
        b = changed(rng, a, rng.randrange(5))
        found = progressive.affine(progressive.profile(a), progressive.profile(b), 1)
        pairs, i, j = [], 0, 0
        for p, q in [*found, (len(a), len(b))]:
            pairs += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)] + ([(p, q)] if p < len(a) else [])
            i, j = p + 1, q + 1
        assert plain(a, b, poa.LONG) >= score_of(pairs, a, b, poa.LONG)
        assert score_of(pairs, a, b, poa.LONG) == plain(a, b, poa.LONG)


def test_long_repeats_are_cut_in_halves(monkeypatch):
    rng = random.Random(5)
    a = "ACGGT" * 600
    b = list(a)
    for at in [0, len(b) - 1, *rng.sample(range(len(b)), 40)]:
        b[at] = "T" if b[at] != "T" else "C"
    b = "".join(b)
    monkeypatch.setattr(progressive, "CELLS", 100_000)
    assert not poa.anchors(a, b, 16) and not poa.anchors(a, b, 8)
    whole, x, y = progressive.joined(progressive.profile(a), progressive.profile(b), (1, 1))
    assert len(whole) <= 3_010 and (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and whole.sum() == 6_000


def test_members_share_what_the_longest_lacks(spark):
    rng = random.Random(10)
    base = "".join(rng.choice("ACGT") for _ in range(11_000))
    a, b = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 500))
    reads = {1: base[:4_000] + a + base[4_000:], 2: base[:4_000] + a + base[4_000:9_000] + base[9_010:], 3: base[:7_000] + b + base[7_000:], 4: base, 5: base}
    members = spark.createDataFrame([(g, s, r) for g in ("x", "y") for s, r in reads.items()] + [("z", 1, "ACGT" * 5)], "biclique_id string, side long, read string")
    steps = progressive.steps(members).collect()
    for g in ("x", "y"):
        mine = [r for r in steps if r.biclique_id == g]
        paths = {s: [(r.poa, r.seq) for r in sorted(mine, key=lambda r: r.ord) if r.side == s] for s in reads}
        assert {s: "".join(q for _, q in p) for s, p in paths.items()} == reads
        assert paths[4] == paths[5]
        nodes = {r.poa: r.seq for r in mine}
        assert sum(map(len, nodes.values())) == 11_000 + 300 + 500
        assert {v for v, q in paths[1] if v in dict(paths[2]) and len(q) in (299, 300, 301)} and not {v for v, q in paths[3] if q == a}
    assert [r.seq for r in steps if r.biclique_id == "z"] == ["ACGT" * 5]


def test_tier_decides_and_medium_overlaps_are_blunted(spark):
    rng = random.Random(11)
    tile = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    join = tile(600)
    lefts = [tile(50) + join, tile(40) + join[:200] + join[201:], tile(30) + join[:300] + "ACGTACGGT" + join[300:]]
    rights = [join + tile(50), join + tile(20)]
    segments = spark.createDataFrame([(k + 1, f"n{k}", s) for k, s in enumerate(lefts + rights)], "node_id long, name string, sequence string")
    shapes = [("600M", 600), ("200M1I399M", 599), ("300M9D300M", 609)]
    rows = [(10 * i + j, i + 1, False, j + 4, False, shapes[i][0], shapes[i][1], 600) for i in range(3) for j in range(2)]
    links = spark.createDataFrame(rows, "link_id long, src long, src_rev boolean, dst long, dst_rev boolean, cigar string, src_len long, dst_len long")
    b = blunt.blunt(segments, links)
    spelled = validate.spelled(b.steps, b.links, b.segments, b.parents).collect()
    assert sorted(map(tuple, spelled)) == sorted((f"n{k}", s) for k, s in enumerate(lefts + rights))
    assert b.segments.agg(F.sum(F.length("sequence"))).first()[0] == 600 + 9 + 50 + 40 + 30 + 50 + 20
    assert validate.lost_links(b.steps, b.groups).count() == 0 and validate.new_adjacencies(b.steps, b.groups).count() == 0


def test_no_open_groups(spark):
    ends = spark.createDataFrame([], "biclique_id string, side long, read string")
    classes = spark.createDataFrame([], "biclique_id string, exact boolean, tier string")
    assert splice.aligned_steps(ends, classes).count() == 0


def test_what_ends_alike_is_not_aligned_again(monkeypatch):
    rng = random.Random(12)
    for _ in range(150):
        a = "".join(rng.choice("ACG") for _ in range(rng.randrange(1, 30)))
        g = poa.BaseGraph()
        for _ in range(rng.randrange(1, 4)):
            g.thread(changed(rng, a, rng.randrange(4)), poa.MEDIUM)
        seq = changed(rng, a, rng.randrange(4))
        assert g.align(seq, poa.MEDIUM)[0] == poa._Table(g, seq, poa.MEDIUM, False, None).best()[0]
    rows = []
    table = poa._Table
    monkeypatch.setattr(poa, "_Table", lambda *a: (rows.append(len((t := table(*a)).nodes)), t)[1])
    a = "".join(rng.choice("ACGT") for _ in range(3_000))
    nodes, _ = poa.align_group([a, a[:700] + a[702:], a[:600] + "ACGTACGTACGT" + a[600:]], "medium")
    assert sum(map(len, nodes)) == 3_012 and max(rows) < 150


def test_runs_are_those_of_plain_merging():
    rng = random.Random(13)
    for _ in range(60):
        base = "".join(rng.choice("ACGT") for _ in range(20))
        paths = [sorted(rng.sample(range(20), rng.randrange(20))) for _ in range(rng.randrange(5))]
        nodes, runs = poa.merged(base, paths)
        assert ["".join(nodes[v] for v in r) for r in runs] == ["".join(base[v] for v in p) for p in paths]
        after, before = {}, {}
        for p in paths:
            for u, v in zip([-1, *p], [*p, -1], strict=True):
                after.setdefault(u, set()).add(v)
                before.setdefault(v, set()).add(u)
        cuts = [sum(k == 0 or after[p[k - 1]] != {v} or before[v] != {p[k - 1]} for k, v in enumerate(p)) for p in paths]
        assert [len(r) for r in runs] == cuts


def test_columns_and_profiles_travel_small():
    rng = random.Random(14)
    a = "".join(rng.choice("ACGT") for _ in range(12_000))
    _, x, y = progressive.joined(progressive.profile(a), progressive.profile(a[:6_000] + a[6_025:]), (1, 1))
    for c in (x, y, np.array([0, 2, 3, 9]), np.array([], int)):
        assert progressive.spread(progressive.stretched(c)).tolist() == c.tolist()
    assert len(progressive.stretched(y)) == 4 * 5 and len(progressive.sketch_of(a)) == progressive.SKETCH
    stored = progressive.stored(progressive.profile(a))
    assert len(stored) < 12_000 and (progressive.restored(stored) == progressive.profile(a)).all()
    assert progressive.sketch_of("ACG") and progressive.sketch_of("")
