"""Sequence graphs as GFA 1 text.

``read_gfa`` gives typed tables and one table of rejected records with reasons.
The order of records doesn't matter; a name's id is its place among the
segments, 1 first.  Line numbers are taken from the file's bytes by Spark's text
reader, so any file system that Spark reads can hold the file.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.functions import cigar
from braidwork.operators.links import canonical
from braidwork.shared import fresh_path, spool

REJECTS = "line_no bigint, record string, reason string"


class Graph(NamedTuple):
    #: node_id, name, sequence
    segments: DataFrame
    #: link_id, src, src_rev, dst, dst_rev, cigar; src_len and dst_len: how much of either end overlaps
    links: DataFrame
    #: line_no, record, reason
    rejects: DataFrame
    #: path, ord, node_id, rev, overlap: the cigar given for the step to the next node, if any
    paths: DataFrame | None = None


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file or folder, in the order of files and lines.

    Lines are numbered within the reader's partitions; the partitions' sizes,
    one row each, give where each begins.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    sizes = raw.groupBy("file", "block", F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n"), F.min("m").alias("first"))
    begin = Window.orderBy("file", "block", "first").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("file").alias("f"), F.col("block").alias("b"), "part", "first", F.coalesce(F.sum("n").over(begin), F.lit(0)).alias("at"))
    on = (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.shiftright("m", 33) == F.col("part"))
    return raw.join(F.broadcast(sizes), on).select((F.col("at") + F.col("m") - F.col("first")).alias("line_no"), "value")


def strand(sign: Column) -> Column:
    """Whether a strand is the reverse one; null if the sign is neither + nor -."""
    return F.when(sign == "-", True).when(sign == "+", False)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segment records, link records, path records) of (line_no, value)."""
    fields = F.split(F.regexp_replace("value", "\\r$", ""), "\t")
    rows = lines.select("line_no", F.col("value").alias("record"), fields.alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    name = lambda k: F.regexp_replace(F.coalesce(at(k), F.lit("")), "\\s", "")
    entries = F.transform(F.filter(F.slice("f", F.lit(4), F.size("f")), lambda t: t.rlike("^[A-Za-z0-9]{2}:[A-Za-z]:")), lambda t: F.struct(F.left(t, F.lit(2)).alias("k"), F.regexp_replace(t, "^..:.:", "").alias("v")))
    tags = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))  # of equal tags the first
    segments = rows.where(at(0) == "S").select("line_no", "record", name(1).alias("name"), F.coalesce(at(2), F.lit("")).alias("sequence"), tags.alias("tags"))
    links = rows.where(at(0) == "L").select("line_no", "record", name(1).alias("src_name"), strand(at(2)).alias("src_rev"), name(3).alias("dst_name"), strand(at(4)).alias("dst_rev"), at(5).alias("cigar"))
    paths = rows.where(at(0) == "P").select("line_no", "record", name(1).alias("path"), at(2).alias("steps"), at(3).alias("overlaps"))
    return segments, links, paths


def named_segments(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects): ids by first appearance; equal repeats go silently, other repeats are rejected."""
    w = Window.partitionBy("name").orderBy("line_no")
    rows = records.withColumn("nth", F.row_number().over(w)).withColumn("kept", F.first("sequence").over(w))
    first = rows.where("nth = 1 and name <> ''")
    rejects = rows.where("nth > 1 and sequence <> kept").select("line_no", "record", F.lit("conflicting segment").alias("reason"))
    rejects = rejects.union(rows.where("name = ''").select("line_no", "record", F.lit("empty name")))
    return dense_ids(first, "line_no").select("node_id", "name", "sequence", "tags"), rejects


def dense_ids(rows: DataFrame, order: str) -> DataFrame:
    """rows with node_id: 1, 2, ... in ascending order of a unique column.

    Ranges of the order are numbered each by itself and shifted by the sizes of
    those before, so no task sees all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(order, [(k + 1) / parts for k in range(parts - 1)], 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<bigint>")
    placed = rows.withColumn("_range", F.size(F.filter(cuts, lambda b: b < F.col(order))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return placed.withColumn("_rank", rank).join(F.broadcast(starts), "_range").withColumn("node_id", (F.col("_start") + F.col("_rank")).cast("long")).drop("_range", "_rank", "_start")


def checked_links(records: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, rejects): names looked up, overlaps measured, bad records set aside, one record of each edge."""
    known = segments.select("name", F.col("node_id").alias("id"), F.length("sequence").alias("size"))
    side = lambda which: known.select(F.col("name").alias(f"{which}_name"), F.col("id").alias(which), F.col("size").alias(f"{which}_size"))
    rows = records.join(side("src"), "src_name", "left").join(side("dst"), "dst_name", "left")
    rows = rows.withColumn("ops", cigar.parse("cigar")).withColumn("src_len", cigar.ref_length("ops")).withColumn("dst_len", cigar.query_length("ops"))
    reason = reject_reason()
    rows = rows.withColumn("reason", reason)
    lo, hi = canonical("src", "src_rev", "dst", "dst_rev")
    good = rows.where("reason is null").withColumn("lo", lo).withColumn("hi", hi)
    nth = F.row_number().over(Window.partitionBy("lo", "hi").orderBy("line_no"))
    good = good.withColumn("nth", nth)
    rejects = rows.where("reason is not null").select("line_no", "record", "reason").union(good.where("nth > 1").select("line_no", "record", F.lit("repeated link")))
    links = good.where("nth = 1").select(F.col("line_no").alias("link_id"), "src", "src_rev", "dst", "dst_rev", "cigar", "src_len", "dst_len")
    return links, rejects


def reject_reason() -> Column:
    """Why a joined link record is no good, or null."""
    empty = (F.col("src_name") == "") | (F.col("dst_name") == "")
    return (
        F.when(empty, "empty name")
        .when(F.col("src_rev").isNull() | F.col("dst_rev").isNull(), "malformed strand")
        .when(F.col("src").isNull() | F.col("dst").isNull(), "unknown segment")
        .when(F.col("ops").isNull(), "malformed cigar")
        .when((F.col("src_len") > F.col("src_size")) | (F.col("dst_len") > F.col("dst_size")), "overlap longer than segment")
        .when((F.col("src") == F.col("dst")) & (F.col("src_rev") != F.col("dst_rev")), "reversing self-overlap")
    )


def parse_gfa(lines: DataFrame, with_paths: bool = False) -> Graph:
    """The graph of numbered lines (line_no, value)."""
    segment_rows, link_rows, path_rows = parse_lines(lines)
    segments, bad_segments = named_segments(segment_rows)
    links, bad_links = checked_links(link_rows, segments)
    paths = None
    if with_paths:
        paths, bad_paths = checked_paths(path_rows, segments)
        bad_links = bad_links.union(bad_paths)
    return Graph(segments, links, bad_segments.union(bad_links), paths)


def checked_paths(records: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, rejects): a path with a step that has no strand or whose segment isn't there is set aside as a whole."""
    steps = records.select("line_no", "path", "overlaps", F.posexplode(F.split(F.coalesce("steps", F.lit("")), ",")).alias("ord", "step"))
    steps = steps.withColumn("name", F.regexp_replace(F.regexp_replace("step", "[+-]\\s*$", ""), "\\s", "")).withColumn("rev", F.col("step").rlike("-\\s*$"))
    steps = steps.join(segments.select("name", "node_id"), "name", "left")
    unsigned = ~F.col("step").rlike("[+-]\\s*$") & (F.col("step") != "")
    bad = steps.where(unsigned | F.col("node_id").isNull()).groupBy("line_no").agg(F.when(F.bool_or(unsigned), "path step without strand").otherwise("path with unknown segment").alias("reason"))
    overlap = F.get(F.split("overlaps", ","), F.col("ord"))
    good = steps.join(bad, "line_no", "left_anti").select("path", "ord", "node_id", "rev", F.when(overlap != "*", overlap).alias("overlap"))
    return good, records.join(bad, "line_no").select("line_no", "record", "reason")


def read_gfa(spark: SparkSession, path: str, with_paths: bool = False) -> Graph:
    """The graph of a GFA file (plain or compressed, on any file system); "-": of standard input, which is copied to the shared folder first."""
    if path == "-":
        spool(spark, sys.stdin.buffer, path := fresh_path(spark, "stdin"))
    return parse_gfa(numbered_lines(spark, path), with_paths)


def sign(rev: Column | str) -> Column:
    return F.when(F.col(rev) if isinstance(rev, str) else rev, "-").otherwise("+")


def gfa_lines(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(class, key, value): header, segments by name, links; links without a cigar are blunt.

    segments: name, sequence; links: src_name, src_rev, dst_name, dst_rev and perhaps cigar.
    """
    spark = segments.sparkSession
    head = spark.range(1).select(F.lit(0).alias("class"), F.lit("").alias("key"), F.lit("H\tVN:Z:1.0").alias("value"))
    s = segments.select(F.lit(1), F.col("name").cast("string"), F.concat_ws("\t", F.lit("S"), F.col("name").cast("string"), "sequence"))
    overlap = F.col("cigar") if "cigar" in links.columns else F.lit("0M")
    row = F.concat_ws("\t", F.lit("L"), F.col("src_name").cast("string"), sign("src_rev"), F.col("dst_name").cast("string"), sign("dst_rev"), overlap)
    return head.union(s).union(links.select(F.lit(2), row, row))


def named_links(segments: DataFrame, links: DataFrame) -> DataFrame:
    """links with src_name and dst_name."""
    names = segments.select("node_id", "name")
    src = names.select(F.col("node_id").alias("src"), F.col("name").alias("src_name"))
    dst = names.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"))
    return links.join(src, "src").join(dst, "dst")


def write_gfa(segments: DataFrame, links: DataFrame, path: str, ordered: bool = True) -> None:
    """Write a GFA folder; ordered: header, segments, links."""
    lines = gfa_lines(segments, links)
    if ordered:
        lines = lines.orderBy("class", "key")
    lines.select("value").write.text(path)
