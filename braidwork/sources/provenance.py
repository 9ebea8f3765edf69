"""Provenance tables: which interval of which input each output piece stands for.

A line is ``name<TAB>parent[begin:end)sign,...``; intervals are half-open, on
the parent's forward strand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.sources.gfa import sign

HEADER = "#output\tinputs"


def provenance_lines(provenance: DataFrame) -> DataFrame:
    """(out_id, value) of rows (out_id, parent, begin, end, rev)."""
    entry = F.concat("parent", F.lit("["), F.col("begin").cast("string"), F.lit(":"), F.col("end").cast("string"), F.lit(")"), sign("rev"))
    listed = F.array_join(F.array_sort(F.collect_set(entry)), ",")
    return provenance.groupBy("out_id").agg(listed.alias("l")).select("out_id", F.concat_ws("\t", F.col("out_id").cast("string"), "l").alias("value"))


def write_provenance(provenance: DataFrame, path: str) -> None:
    spark = provenance.sparkSession
    head = spark.range(1).select(F.lit(None).cast("string").alias("out_id"), F.lit(HEADER).alias("value"))
    rows = provenance_lines(provenance)
    head.union(rows.select(F.col("out_id").cast("string"), "value")).orderBy(F.asc_nulls_first("out_id")).select("value").write.text(path)


def parse_provenance(lines: DataFrame) -> DataFrame:
    """(out_id, parent, begin, end, rev) of text lines (value); comments are left out."""
    rows = lines.where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    entries = rows.select(F.substring_index("value", "\t", 1).alias("out_id"), F.explode(F.split(F.substring_index("value", "\t", -1), ",")).alias("e"))
    part = lambda k: F.regexp_extract("e", r"^(.*)\[(\d+):(\d+)[\])]([+-])$", k)
    return entries.select("out_id", part(1).alias("parent"), part(2).cast("long").alias("begin"), part(3).cast("long").alias("end"), (part(4) == "-").alias("rev"))


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return parse_provenance(spark.read.text(path))
