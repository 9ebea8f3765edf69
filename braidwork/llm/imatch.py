"""Document fingerprints by I-Match, natively in SQL.

The lexicon holds the terms whose document frequency lies in a band: neither
so rare that one edit is sure to touch them nor so common that they tell
nothing.  32 randomised subsets of it, of four rates, are fixed by a hash of the
term.  A document's distinct terms of a subset are sorted and hashed; the 32
hashes are its fingerprint.  A dense subset tells small edits, a sparse one
still agrees after large ones, so the share of agreeing subsets grades the
likeness of two texts.

The band bounds the lexicon whatever the corpus: frequencies add up to the mean
number of distinct terms of a document times the number of documents, so at
most that mean divided by ``least`` terms can reach the band.  The lexicon
therefore travels as a constant hash table inside the projection: no join, no
shuffle and no Python touch a document's terms.

``edited_fingerprints`` also needs each document's successor in descending
key order.  Keys are cut into ranges by approximate percentiles; a window per
range looks one row ahead, and each range also receives the first row of the
next one.  The text is shuffled once and no range grows with a source.

Defined results: a null text is empty.  A text none of whose terms is in a
subset has one hash of all its terms instead, so two such texts are alike (1.0)
only if they have the same ones; an empty text is one of them.  The band's upper
edge is never under three documents.  Keys may be of any type that has an order.
Equal keys are ordered by the hash of their texts, null keys come last (dealt by
that hash).  The last document's successor is the first.  Only the key and the
text are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.license import normal_form

#: Subsets: codes in ascending order, and the chance 1 in 16, 32, 64, 256 of a term to be in each.
CODES = "0123456789abcdefghijklmnopqrstuv"
RATES = (4, 5, 6, 8)
MARK = "\x01"
#: Keys sampled for a range where the key is no number.
RANGE_SAMPLE = 50


def terms(text: Column) -> Column:
    """Distinct words of the normal form."""
    return F.array_distinct(F.filter(F.split(normal_form(text), " "), lambda w: w != ""))


def _codes(term: Column) -> Column:
    """Codes of the subsets that a term belongs to."""
    per = len(CODES) // len(RATES)
    inside = lambda k: F.pmod(F.xxhash64(F.lit(k), term), F.lit(2 ** RATES[k // per])) == 0
    return F.concat_ws("", *(F.when(inside(k), F.lit(c)) for k, c in enumerate(CODES)))


def lexicon(texts: DataFrame, least: float, most: float) -> list[str]:
    """Hash table of the band's terms: in a term's slot stands " term=codes "; texts: one string column."""
    n = texts.count()
    df = texts.select(F.explode(terms(F.col(texts.columns[0]))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= least * n) & (F.col("df") <= max(most * n, 3))).withColumn("m", _codes(F.col("t"))).where("m <> ''")
    rows = band.select("t", "m", F.xxhash64("t").alias("h")).collect()  # bounded by the band
    slots = 1
    while slots < 2 * len(rows):
        slots *= 2
    table = [" "] * slots
    for r in sorted(rows, key=lambda r: r.t):
        table[r.h % slots] += f"{r.t}={r.m} "
    return table


def fingerprint(text: Column, table: list[str]) -> Column:
    """Array of one hash (or null) for each subset."""
    listed = F.split(F.lit("\n".join(table)), "\n")  # folded into one constant when the query is planned
    slot = lambda w: F.get(listed, F.pmod(F.xxhash64(w), F.lit(len(table))).cast("int"))
    codes = lambda w: F.substring_index(F.call_function("substring_index", slot(w), F.concat(F.lit(" "), w, F.lit("=")), F.lit(-1)), " ", 1)  # noqa: E731  empty for other words
    known = F.filter(F.transform(terms(text), lambda w: F.struct(w.alias("w"), codes(w).alias("m"))), lambda x: x["m"] != "")
    coded = F.flatten(F.transform(known, lambda x: F.transform(F.split(x["m"], ""), lambda k: F.concat(k, x["w"]))))
    marks = F.array(*(F.lit(c + MARK) for c in CODES))  # each sorts before its subset's terms
    joined = F.array_join(F.sort_array(F.concat(marks, F.filter(coded, lambda x: x != ""))), " ")
    pieces = F.slice(F.split(joined, MARK), 2, len(CODES))  # " 0term 0term 1" or, empty, " 1"
    hashes = F.transform(pieces, lambda p: F.when(F.length(p) > 2, F.xxhash64(p)))
    every = F.xxhash64(F.concat(F.lit("* "), F.array_join(F.sort_array(terms(text)), " ")))
    alone = F.concat(F.array(every), F.array_repeat(F.lit(None).cast("long"), len(CODES) - 1))
    # as an argument the hashes are made once; named in the condition and in the result they would be made twice
    return F.get(F.transform(F.array(hashes), lambda hs: F.when(F.exists(hs, lambda h: h.isNotNull()), hs).otherwise(alone)), 0)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.when(h.isNull(), F.lit("-")).otherwise(F.lower(F.lpad(F.hex(h), 16, "0")))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets that either text has terms of, the share with equal hashes."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    seen = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(seen > 0, same / seen).otherwise(F.lit(1.0))


def _ranges(docs: DataFrame, parts: int) -> Column:
    """Number of the range of (key, h): descending keys have descending numbers."""
    if isinstance(docs.schema["key"].dataType, T.NumericType):
        bounds = sorted(set(docs.agg(F.percentile_approx("key", [(k + 1) / parts for k in range(parts - 1)], 10_000)).first()[0] or []))
    else:
        share = max(1, docs.count() // (RANGE_SAMPLE * parts))
        some = docs.where(F.col("key").isNotNull() & (F.pmod("h", F.lit(share)) == 0)).select("key").distinct().orderBy("key")
        some = [json.loads(r[0])["key"] for r in some.select(F.to_json(F.struct("key"))).limit(4 * RANGE_SAMPLE * parts).collect()]
        bounds = [some[k * len(some) // parts] for k in range(1, parts) if len(some) >= parts]
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)] or [[]]
    kind = f"array<{docs.schema['key'].dataType.simpleString()}>"
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups if g])), kind)
    tables = F.from_json(F.lit(json.dumps(groups)), f"array<{kind}>")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    coarse = F.greatest(below(heads) - 1, F.lit(0))
    return F.when(F.col("key").isNull(), (F.shiftright("h", 56) - 128).cast("int")).otherwise(coarse * step + below(F.get(tables, coarse)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (key, h, ...) with next_<column> of the successor in descending (key, h)."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.withColumn("r", _ranges(docs.select("key", "h"), parts))
    tops = ranged.groupBy("r").agg(F.max(F.struct("key", "h")).alias("top"))  # one row for each range
    order = Window.orderBy(F.desc("r"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("top", F.coalesce(F.lag("r").over(order), F.min("r").over(everything)).alias("to"))
    same = F.col("key").eqNullSafe(F.col("top.key")) & (F.col("h") == F.col("top.h"))
    placed = ranged.join(F.broadcast(tops), same, "left")
    both = F.when(F.col("to").isNull(), F.array(F.struct("r", F.lit(0).alias("guest")))).otherwise(F.array(F.struct("r", F.lit(0).alias("guest")), F.struct(F.col("to").alias("r"), F.lit(1).alias("guest"))))
    rows = placed.select("key", "h", *columns, F.explode(both).alias("at"))
    ahead = Window.partitionBy("at.r").orderBy("at.guest", F.desc_nulls_last("key"), F.desc("h"))
    found = rows.select("key", "h", *columns, "at", *(F.lead(c).over(ahead).alias(f"next_{c}") for c in columns))
    return found.where("at.guest = 0")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.005, most: float = 0.05) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last third replaced by the beginning of the next document.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = lexicon(texts.select("text"), least, most)
    rows = texts.select("key", F.xxhash64("text").alias("h"), "text", fingerprint(F.col("text"), table).alias("fp"))
    found = with_next(rows, ["text", "fp"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 3) as int))"), F.left(F.col("next_text"), third))
    found = found.select("key", "fp", "next_fp", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    found = found.select("key", "n_chars", "fp", "next_fp", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited"), table).alias("edited_fp"))
    return found.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
