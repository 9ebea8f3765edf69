"""Walks from heads to tails, whole and of any length."""

from braidwork.operators import traversal, validate
from braidwork.plans import blunt, registry, synth


def test_walks_of_any_length(spark):
    n = 67
    segments = spark.createDataFrame([(k, f"n{k}", "A") for k in range(1, n + 1)], "node_id long, name string, sequence string")
    links = spark.createDataFrame([(k, k, False, k + 1, False) for k in range(1, n)], "link_id long, src long, src_rev boolean, dst long, dst_rev boolean")
    assert [r.path for r in traversal.source_sink_paths(segments, links).collect()] == [",".join(f"{k}+" for k in range(1, n + 1))]


def test_walks_of_the_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.path for r in registry.QUERIES["source_sink_paths"](spark, sf).collect()}
    g = synth.graph(spark, sf, "J")
    links = {(r.src, r.dst) for r in g.links.collect()}
    linked = {v for e in links for v in e}
    assert got == {f"{a}+,{b}+" for a, b in links} | {f"{r.node_id}+" for r in g.segments.collect() if r.node_id not in linked}


def test_chain_without_overlaps(spark, tmp_path):
    """Links of B, which have neither overlap nor cigar, are passed on by blunting."""
    spark.range(6).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(12).selectExpr("id div 2 as l_orderkey", "cast(id % 2 + 1 as int) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = synth.graph(spark, str(tmp_path), "B")
    n = g.links.count()
    assert validate.not_blunt(g.links).count() == n == 5 + 12 + 10
    b = blunt.blunt(g.segments, g.links)
    assert b.links.count() == n and b.segments.count() == g.segments.count() == 18
    assert validate.not_blunt(registry._written_links(b)).isEmpty()
    assert sorted(map(tuple, validate.spelled(b.steps, b.links, b.segments, b.parents).collect())) == sorted(map(tuple, g.segments.select("name", "sequence").collect()))
