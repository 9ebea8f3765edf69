"""From raw documents to token ids, in five stages.

A document table goes through a quality filter, near-duplicate removal,
repeated-passage removal, source mixing and tokenisation.  Every stage is
written as Parquet to the shared folder and read again, so a lost executor costs
at most the stage that it worked on.

Defined results: a null or empty text is scored by the classifier like any other,
all of them are one group of copies, repeat nothing, and have no tokens.  A null
id stays if its document does, and is the last choice of a group.  Equal rows are
one document.  Columns beyond those of documents travel to the mixture, whatever
their names, and end there.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import mixing, nearcopies, quality, sentencepiece, substring
from braidwork.shared import Written, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return scored.where("score >= 0.5").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are at least 0.8 alike the one with the smallest id (SimHash)."""
    return nearcopies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too; texts that lose nothing stay as they are."""
    found = substring.remove_repeats(docs.select(F.struct(*docs.columns).alias("doc"), "text"))
    text = F.when(F.col("n_removed") == 0, F.col("row.doc.text")).otherwise(F.col("kept"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    left = found.where("n_removed = 0 or n_removed < n_words")
    return left.select(*(made.get(c, F.col("row.doc").getField(c)).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, smaller sources up to four times."""
    return mixing.mix(docs).select("row.*")


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    read = sentencepiece.encode_and_read(docs)
    same = F.col("text") == F.coalesce("row.text", F.lit(""))
    return read.select("row.doc_id", "row.lang", "row.source", "row.n_chars", F.size("ids").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [("quality", good_documents), ("simhash", one_of_each_group), ("substring", without_repeats), ("mixing", mixed), ("sentencepiece", tokenised)]
#: Classifier and hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
