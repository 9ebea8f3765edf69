"""Blunting and its checks move little: what is written is deleted, what is known is not joined, short nodes are walked within their row."""

import os

from braidwork.operators import termini, validate
from braidwork.plans import blunt, registry
from braidwork.shared import Written, shared_dir
from braidwork.sources import gfa

SF = "/root/testdata/sf0.001"
MIXED = "\n".join([
    "S\ta\tCCCACGTTGCA", "S\tb\tACGTTGCAGGT", "S\tc\tTGCAGGTAAA", "S\td\tGCAGGTCCC", "S\te\tTT", "S\tf\tGGA", "S\tg\tTTACGAACGT", "S\th\tACGACGTGG",
    "L\ta\t+\tb\t+\t8M", "L\tb\t+\tc\t+\t7M", "L\tb\t+\td\t+\t6M", "L\te\t+\tf\t-\t0M", "L\te\t+\ta\t+\t0M", "L\tf\t+\te\t+\t0M", "L\tg\t+\th\t+\t3M1D4M",
])


def mixed(spark):
    g = gfa.parse_gfa(spark.createDataFrame(list(enumerate(MIXED.split("\n"))), "line_no bigint, value string"))
    return g.segments.drop("tags").cache(), g.links.cache()


def size(spark):
    at = shared_dir(spark).removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(f"{at}/braidwork") for f in names if f.endswith(".parquet") and any(n in d for n in ("groups-", "nodes-", "members-", "segments-", "/links-", "steps-", "pieces-"))}


def test_checks_of_all_graphs_keep_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(registry.synth, "SQL", {n: registry.synth.SQL[n] for n in ("T", "B")})
    before = size(spark)
    rows = registry.QUERIES["validate_covered"](spark, SF)
    assert size(spark) <= before
    assert sorted(map(tuple, rows.collect())) == [(n, 0) for n in sorted(registry.synth.SQL)]


def test_lonely_links_are_dealt_as_by_join(spark):
    segments, links = mixed(spark)
    lapped = links.where("src_len > 0")
    of = lambda df: sorted(map(str, df.collect()))
    assert of(blunt.dealt(lapped)) == of(termini.group_links(blunt.covered_groups(lapped), lapped))
    alone = Written(lapped.where("cigar = '3M1D4M'"), "alone").df
    assert of(blunt.dealt(alone)) == of(termini.group_links(blunt.covered_groups(alone), alone))
    plan = blunt.dealt(alone)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_walks_within_a_row_and_by_pointers(spark, monkeypatch):
    """Both ways spell the parents; without its links a node of several steps has no walk, one of one step does."""
    segments, links = mixed(spark)
    b = blunt.blunt(segments, links)
    want = {r.name: r.sequence for r in segments.collect()}
    spell = lambda links: {r.name: r.sequence for r in validate.spelled(b.steps, links, b.segments, segments).collect()}
    assert spell(b.links) == want
    none = b.links.limit(0)
    assert spell(none) == {n: s if n in "ef" else None for n, s in want.items()}
    monkeypatch.setattr(validate, "FEW", 1)
    assert spell(b.links) == want
    assert spell(none) == {n: s if n in "ef" else None for n, s in want.items()}
    assert b.links.count() == b.links.distinct().count()
    assert validate.inconsistent_steps(b.segments, b.steps, segments).isEmpty()
    wrong = b.segments.withColumn("sequence", validate.F.lit("A"))
    reasons = lambda df: sorted(map(tuple, df.distinct().collect()))
    few = b.steps.where("kind <> 'L'")
    renamed = few.select(*[c for c in few.columns if c != "node"], validate.F.col("node"))
    assert reasons(validate.inconsistent_steps(wrong, few, segments)) == reasons(validate.inconsistent(wrong, b._replace(steps=renamed).provenance(), segments))


def test_gaps_and_tails(spark):
    parents = spark.createDataFrame([("a", "ACGTACGT"), ("b", "ACG"), ("c", "")], "name string, sequence string")
    p = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 5, 6), ("c", 0, 0)], "parent string, begin long, end long")
    assert sorted(map(tuple, validate.not_covered(p, parents).collect())) == [("a", 0), ("a", 3), ("a", 6), ("b", 0)]


def test_hops_within_a_row_and_by_rounds(spark, monkeypatch):
    segments, links = mixed(spark)
    b = blunt.blunt(segments, links)
    hops = lambda links: sorted(map(tuple, validate.two_hops(b.steps, links, b.groups).collect()))
    name = {r.name: r.node_id for r in segments.collect()}
    found = hops(b.links)
    assert {n for n, _, _ in found} == {name["b"]} and len(found) == 2
    alone = hops(b.links.limit(0))
    assert set(alone) <= set(found)
    for bound in ("FEW", "FEW_MET"):
        with monkeypatch.context() as m:
            m.setattr(validate, bound, 1)
            assert hops(b.links) == found and hops(b.links.limit(0)) == alone


def test_lost_links_and_new_adjacencies_of_steps_told_twice(spark):
    """Steps that are told twice change nothing; steps that are taken away lose their links; sides put together are new."""
    segments, links = mixed(spark)
    b = blunt.blunt(segments, links)
    twice = b.steps.union(b.steps)
    assert validate.lost_links(twice, b.groups).isEmpty() and validate.new_adjacencies(twice, b.groups).isEmpty()
    at = b.groups.orderBy("link_id").first()
    gone = b.steps.where(f"not (biclique_id = '{at.biclique_id}' and side = {at.l_side}) or biclique_id is null")
    assert at.link_id in {r.link_id for r in validate.lost_links(gone, b.groups).collect()}
    s, g = "biclique_id string, side bigint, piece string", "biclique_id string, link_id bigint, l_side bigint, r_side bigint"
    steps = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("g", 3, "y"), ("g", 4, "y"), ("g", 4, "x")], s)
    groups = spark.createDataFrame([("g", 7, 1, 2), ("g", 8, 3, 4)], g)
    found = validate.new_adjacencies(steps.union(steps), groups)
    assert sorted(map(tuple, found.collect())) == [(1, 4)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3
