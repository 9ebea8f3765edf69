"""Overlaps among sequences: a suffix of one aligned to a prefix of another.

An overlap of `least` bases or more covers the whole of the other's first `least`
bases, so it is enough to look up the minimisers of those (least hashes of WINDOW
neighbouring words of WORD letters) among all minimisers of all sequences.  Any
exact overlap is found; an inexact one is if it has a window without an error
there.  A minimiser of many sequences is dealt to several tasks, not dropped.

A pair whose longest candidate overlap reads the same on both sides is settled by
comparing strings; other pairs are aligned with a score for the letters and one
for gaps, a pair a row, in a band round their candidates once the whole table would
be larger than CELLS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.shared import Written, bounded_batches

WORD, WINDOW = 15, 10
#: Scores of equal and of different letters, and of a letter in a gap.
EQUAL, DIFFERENT, GAP = 1, -1, -4
CELLS = 4_000_000
#: Sequences of one minimiser that a task pairs with others of it.
AT_ONCE = 1_000


def minimisers(seq: str) -> list[tuple[int, int]]:
    """(hash, place) of the least word of every window; of equal ones the first."""
    letters = np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(letters) < WORD + WINDOW - 1:
        return []
    powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORD)], np.uint64)
    with np.errstate(over="ignore"):
        hashed = (np.lib.stride_tricks.sliding_window_view(letters, WORD) * powers).sum(axis=1, dtype=np.uint64)
        hashed = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(hashed, WINDOW).argmin(axis=1) + np.arange(len(hashed) - WINDOW + 1))
    return list(zip(hashed.view(np.int64)[at].tolist(), at.tolist(), strict=True))


def aligned(a: str, b: str, ends: list[int]) -> tuple[int, int, int, str]:
    """(score, bases of a, bases of b, cigar) of a best alignment of a suffix of a to a prefix of b; of equal ones the shortest prefix.

    ends: lengths of candidate overlaps, which a band has to hold.
    """
    n, m = len(a), len(b)
    low, high = -n, m  # of the diagonals (place in b less place in a)
    if (n + 1) * (m + 1) > CELLS:
        slack = max(50, max(ends) // 20)
        low, high = min(e - n for e in ends) - slack, max(e - n for e in ends) + slack
    first = max(0, -high)  # rows before it have no cell right of column 0
    letters = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    begins, rows = [], []
    for i in range(first, n + 1):
        s, e = max(0, i + low), min(m, i + high) + 1
        here = np.full(max(0, e - s), -(1 << 29), np.int64)
        if s == 0 and e > s:
            here[0] = 0
        if rows and e > s:
            was, at = rows[-1], begins[-1]
            x, y = max(s, at), min(e, at + len(was))
            if x < y:
                here[x - s : y - s] = np.maximum(here[x - s : y - s], was[x - at : y - at] + GAP * (np.arange(x, y) > 0))
            x, y = max(s, at + 1), min(e, at + len(was) + 1)
            if x < y:
                gain = np.where(letters[x - 1 : y - 1] == ord(a[i - 1]), EQUAL, DIFFERENT)
                here[x - s : y - s] = np.maximum(here[x - s : y - s], was[x - 1 - at : y - 1 - at] + gain)
        ramp = GAP * np.arange(len(here))
        if len(here):
            here = np.maximum.accumulate(here - ramp) + ramp
            if s == 0:
                here[0] = 0
        begins.append(s)
        rows.append(here)
    cell = lambda i, j: int(rows[i - first][j - begins[i - first]]) if i >= first and 0 <= j - begins[i - first] < len(rows[i - first]) else -(1 << 30)
    i, j = n, begins[-1] + int(rows[-1].argmax())
    score, ops = cell(i, j), []
    whole = j
    while j > 0:
        here = cell(i, j)
        if i and here == cell(i - 1, j - 1) + (EQUAL if a[i - 1] == b[j - 1] else DIFFERENT):
            i, j, op = i - 1, j - 1, "M"
        elif i and here == cell(i - 1, j) + GAP:
            i, op = i - 1, "D"
        else:
            j, op = j - 1, "I"
        if ops and ops[-1][1] == op:
            ops[-1][0] += 1
        else:
            ops.append([1, op])
    return score, n - i, whole, "".join(f"{k}{op}" for k, op in reversed(ops))


def _placed(sequences: DataFrame, least: int) -> DataFrame:
    """(id, size, hash, at, begins): minimisers, and whether they lie within the first `least` bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, h, p) for k, s in enumerate(batch.column(1).to_pylist()) for h, p in minimisers(s or "")]
            take = pa.array([r[0] for r in rows], pa.int64())
            size = [len(s or "") for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([size[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["id", "size", "hash", "at"])

    rows = bounded_batches(sequences.select("id", "sequence")).mapInArrow(run, "id bigint, size bigint, hash bigint, at bigint")
    return rows.withColumn("begins", F.col("at") + WORD <= least)


def overlaps(sequences: DataFrame, least: int, least_score: int | None = None, exact: bool = False) -> DataFrame:
    """(a, b, score, a_len, b_len, cigar): for each ordered pair of different sequences (id, sequence) its best overlap, if it has `least` bases of b or more.

    least: WORD + WINDOW - 1 or more.  least_score: default half of least.  An
    overlap that takes in the whole of either sequence counts like any other.
    exact: a pair's best overlap is its longest one without any difference.
    """
    if least < WORD + WINDOW - 1:
        raise ValueError(f"overlaps under {WORD + WINDOW - 1} bases may share no minimiser")
    placed = Written(_placed(sequences, least), "minimisers").df
    begin = placed.where("begins").select("hash", F.col("id").alias("b"), F.col("at").alias("b_at"), F.col("size").alias("b_size"))
    parts = begin.groupBy("hash").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("parts"))
    begin = begin.join(parts, "hash").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    whole = placed.select("hash", F.col("id").alias("a"), F.col("at").alias("a_at"), F.col("size").alias("a_size")).join(parts, "hash")
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n = F.col("a_size") - F.col("a_at") + F.col("b_at")
    met = begin.join(whole, ["hash", "part"]).where("a <> b and a_at >= b_at").select("a", "b", n.alias("n")).where(f"n >= {least}").distinct()
    pairs = met.groupBy("a", "b").agg(F.array_sort(F.collect_set("n")).alias("ends"))
    at = lambda c: sequences.select(F.col("id").alias(c), F.col("sequence").alias(f"{c}_seq"))
    rows = pairs.join(at("a"), "a").join(at("b"), "b")
    if exact:
        rows = rows.withColumn("ends", F.filter("ends", lambda n: (F.right(F.col("a_seq"), n.cast("int")) == F.left(F.col("b_seq"), n.cast("int"))) & (F.length("b_seq") >= n))).where("size(ends) > 0")
    rows = rows.withColumn("n", F.element_at("ends", -1))
    same = (F.length("b_seq") >= F.col("n")) & (F.expr("right(a_seq, cast(n as int))") == F.expr("left(b_seq, cast(n as int))"))
    rows = Written(rows.withColumn("same", same), "candidates").df
    plain = rows.where("same").select("a", "b", (F.col("n") * EQUAL).alias("score"), F.col("n").alias("a_len"), F.col("n").alias("b_len"), F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [aligned(a, b, ends) for ends, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["a", "b", "score", "a_len", "b_len", "cigar"])

    other = bounded_batches(rows.where("not same").select("a", "b", "ends", "a_seq", "b_seq")).mapInArrow(run, "a bigint, b bigint, score bigint, a_len bigint, b_len bigint, cigar string")
    return plain.union(other).where((F.col("b_len") >= least) & (F.col("score") >= (least // 2 if least_score is None else least_score)))
