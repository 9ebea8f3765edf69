"""Records of graph files as they arrive in a folder; parsing needs no state, checks across records do and are left to a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import cigar


def stream_links(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (src_name, src_rev, dst_name, dst_rev, cigar, src_len, dst_len, reason) of link records in text files that arrive in a folder; reason: why a record can be no link."""
    fields = F.split("value", "\t")
    rows = spark.readStream.text(folder).where(F.col("value").startswith("L\t")).select(fields.alias("f"))
    at = lambda k: F.get("f", F.lit(k))
    ops = cigar.parse(at(5))
    empty = (F.coalesce(at(1), F.lit("")) == "") | (F.coalesce(at(3), F.lit("")) == "")
    signs = F.coalesce(at(2).isin("+", "-") & at(4).isin("+", "-"), F.lit(False))
    reason = F.when(empty, "empty name").when(~signs, "malformed strand").when(ops.isNull(), "malformed cigar").when((at(1) == at(3)) & (at(2) != at(4)), "reversing self-overlap")
    return rows.select(at(1).alias("src_name"), (at(2) == "-").alias("src_rev"), at(3).alias("dst_name"), (at(4) == "-").alias("dst_rev"), at(5).alias("cigar"), cigar.ref_length(ops).alias("src_len"), cigar.query_length(ops).alias("dst_len"), reason.alias("reason"))
