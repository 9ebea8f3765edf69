"""Blunting: a graph whose links carry overlaps becomes one whose links carry none, with the same walks."""

from __future__ import annotations

import logging
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import biclique, bipartite, splice, termini
from braidwork.operators.links import both_ways, side_edges
from braidwork.shared import PACKED, Written
from braidwork.sources import gfa, provenance

log = logging.getLogger(__name__)


class Blunted(NamedTuple):
    #: name, sequence
    segments: DataFrame
    #: src, src_rev, dst, dst_rev: names; without overlaps, so without a cigar until they are written
    links: DataFrame
    #: node, lo, hi, piece, rev, kind, biclique_id, side
    steps: DataFrame
    #: (biclique_id, link_id, l_side, r_side, ...) of the overlaps
    groups: DataFrame
    #: input segments, for names and validation
    parents: DataFrame
    #: the tables that the others are read from
    files: tuple[Written, ...] = ()

    def drop(self) -> None:
        """Delete the tables; nothing above can be read afterwards."""
        for f in self.files:
            f.drop()

    def provenance(self) -> DataFrame:
        """(out_id, parent, begin, end, rev)."""
        names = self.parents.select(F.col("node_id").alias("node"), "name")
        rows = self.steps.select("node", "lo", "hi", "piece", "rev").repartition("node").distinct().join(names, "node")
        return rows.select(F.col("piece").alias("out_id"), F.col("name").alias("parent"), F.col("lo").alias("begin"), F.col("hi").alias("end"), "rev")


def _branching(edges: DataFrame) -> Written:
    """(side) of sides with more than one other."""
    ends = both_ways(edges).groupBy("side").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    return Written(ends.where("lo <> hi").select("side"), "branching")


def _lonely(c: str) -> Column:
    """The name of a link's own group, as its block and cover would give it."""
    return F.concat_ws(".", c, F.lit("0"), c, F.lit("0"))


def _blocks(edges: DataFrame, many: DataFrame) -> DataFrame:
    """covered_groups() of edges (x, y) with a side among `many`."""
    at = lambda c: many.withColumnRenamed("side", c)
    rest = edges.join(at("x"), "x", "left_semi").select("x", "y").union(edges.join(at("y"), "y", "left_semi").select("x", "y"))
    blocks = Written(bipartite.block_edges(Written(rest.distinct(), "edges").df), "block-edges").df
    return biclique.assigned(biclique.biclique_cover(blocks), blocks)


def covered_groups(links: DataFrame) -> DataFrame:
    """(biclique_id, l_side, r_side): links dealt to complete bipartite groups.

    A link whose two sides have no other is a group by itself, named as its block
    and cover would be; only the rest is looked through for blocks.
    """
    edges = side_edges(links).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y")
    many = _branching(edges).df
    at = lambda c: many.withColumnRenamed("side", c)
    alone = edges.join(at("x"), "x", "left_anti").join(at("y"), "y", "left_anti").select("x", "y").distinct()
    found = alone.select(_lonely("x").alias("biclique_id"), F.col("x").alias("l_side"), F.col("y").alias("r_side"))
    return found if many.isEmpty() else found.union(_blocks(edges, many))


def dealt(links: DataFrame) -> DataFrame:
    """termini.group_links() of covered_groups(): a link that is a group by itself is told its group as it stands, without a join."""
    rows = termini.by_sides(links)
    many = _branching(rows.select(F.col("p").alias("x"), F.col("q").alias("y")).where("x <> y")).df
    at = lambda c: many.withColumnRenamed("side", c)
    branching = not many.isEmpty()
    alone = rows.where("p <> q")
    if branching:
        alone = alone.join(at("p"), "p", "left_anti").join(at("q"), "q", "left_anti")
    found = termini.turned(alone.withColumns({"biclique_id": _lonely("p"), "l_side": F.col("p"), "r_side": F.col("q")}))
    if not branching:
        return found
    edges = rows.select(F.col("p").alias("x"), F.col("q").alias("y")).where("x <> y")
    return found.union(termini.group_links(_blocks(edges, many), links))


def blunt(segments: DataFrame, links: DataFrame) -> Blunted:
    """Blunt a graph; links: as read by sources.gfa.

    Nodes with their ends and the members of groups are each dealt once, by node
    and by group, and written.  Of groups that read the same, steps, pieces and the
    links of paths then follow row by row.
    """
    overlap = links.where("src_len > 0 and dst_len > 0")
    bare = links.where("src_len = 0 or dst_len = 0")
    log.info("grouping links")
    lapped = not overlap.isEmpty()
    groups = Written(dealt(overlap) if lapped else termini.turned(termini.by_sides(overlap).withColumns({"biclique_id": F.lit(""), "l_side": F.col("p"), "r_side": F.col("q")})), "groups", **PACKED)
    nodes = Written(termini.nodes_with_ends(segments, groups.df if lapped else None), "nodes", **PACKED)
    files = [groups, nodes]
    place = lambda end, pos: F.array_distinct(F.transform(F.filter("ends", lambda e: e["end"] == end), pos))
    spine = termini.spines(nodes.df.select("node", "size", "sequence", place(0, lambda e: e["len"]).alias("s"), place(1, lambda e: F.col("size") - e["len"]).alias("x")))
    steps, pieces, paths = splice.spine_steps(spine), spine.select(splice.spine_name().alias("name"), "sequence"), None
    if lapped:
        log.info("aligning groups")
        members = Written(termini.members(nodes.df), "members", **PACKED)
        files.append(members)
        shared = splice.shared_steps(members.df)
        steps = steps.union(shared.select(steps.columns))
        pieces = pieces.union(shared.where("first").select("piece", "seq"))
        paths = shared.where("first and to is not null").select(F.col("piece").alias("src"), F.lit(False).alias("src_rev"), F.col("to").alias("dst"), F.lit(False).alias("dst_rev"))
        rest = members.df.where("not exact")
        if not rest.isEmpty():
            classes = rest.select("biclique_id", "exact", "tier").distinct()
            cuts = rest.select("biclique_id", "side", F.explode("along").alias("at"))
            fine = Written(splice.fine_steps(splice.aligned_steps(rest.drop("exact", "tier"), classes), cuts), "fine", **PACKED)
            aligned = Written(splice.aligned_node_steps(fine.df, rest).select(steps.columns), "aligned", **PACKED)
            own = Written(fine.df.select(F.col("piece").alias("name"), F.col("seq").alias("sequence")).dropDuplicates(["name"]), "pieces", **PACKED)
            files += [fine, aligned, own]
            steps, pieces, paths = steps.union(aligned.df), pieces.union(own.df), paths.union(splice.path_links(fine.df))
    log.info("splicing")
    plain = steps.select(splice.STEP)
    inner = splice.node_links(steps)
    found = Written(splice.canonical_pieces(paths.union(inner) if paths is not None else inner), "links", **PACKED)
    files.append(found)
    # most graphs have no such nodes or no such links, and looking for them moves all steps
    whole = lambda end, which: F.filter("ends", lambda e: (e["end"] == end) & (e["len"] == F.col("size")))
    full = nodes.df.select("node", "size", F.explode(whole(0, "l")).alias("l"), F.col("ends")).select("node", "size", "l", F.explode(whole(1, "r")).alias("r"))
    full = full.select("node", "size", F.col("l.biclique_id").alias("l_biclique"), F.col("l.side").alias("l_side"), F.col("size").alias("s"), F.col("r.biclique_id").alias("r_biclique"), F.col("r.side").alias("r_side"), F.lit(0).cast("long").alias("x"))
    more = [] if not lapped or full.isEmpty() else [splice.full_node_links(found.df, plain, full)]
    direct = bare
    if lapped and not bare.isEmpty():
        touched = nodes.df.where(F.size("ends") > 0).select("node")
        at = lambda c: touched.withColumnRenamed("node", c)
        direct = bare.join(at("src"), "src", "left_anti").join(at("dst"), "dst", "left_anti")
        beside = bare.join(at("src"), "src", "left_semi").select(bare.columns).union(bare.join(at("src"), "src", "left_anti").join(at("dst"), "dst", "left_semi").select(bare.columns))
        more.append(splice.bypass_links(plain, segments, beside))
    if more or not bare.isEmpty():
        rows = splice.canonical_pieces(reduce(DataFrame.union, more, found.df)) if more else found.df
        files.append(Written(rows.union(splice.untouched_links(direct)), "links", **PACKED))
        found.drop()
    return Blunted(pieces, files[-1].df, plain, groups.df, segments, tuple(files))


def blunt_file(spark: SparkSession, path: str, out: str, table: str | None = None) -> Blunted:
    """Read a GFA file, write the blunted graph and perhaps the provenance table."""
    graph = gfa.read_gfa(spark, path)
    segments, links = Written(graph.segments.drop("tags"), "segments").df, Written(graph.links, "links").df
    for r in graph.rejects.groupBy("reason").count().collect():
        log.warning("%s records left out: %s", r["count"], r.reason)
    result = blunt(segments, links)
    named = result.links.select(F.col("src").alias("src_name"), "src_rev", F.col("dst").alias("dst_name"), "dst_rev")
    gfa.write_gfa(result.segments, named, out)
    if table:
        provenance.write_provenance(result.provenance(), table)
    return result
