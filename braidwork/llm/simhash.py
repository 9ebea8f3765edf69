"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints are 64 bits.  For a radius r every bit position gets a code of
r + 1 bits, and each of the 2^(r+1) - 1 non-zero vectors v gives one table,
whose mask holds the positions with an odd inner product of code and v.  The
codes of at most r differing positions span at most r dimensions, so some v is
orthogonal to all of them: its mask misses every difference and the pair meets
in that table.  No pair within the radius is lost.

Equal fingerprints are one row before anything is shuffled, so a group of exact
copies costs one row however large it is.  Buckets are then counted with
map-side combining:

* one fingerprint: nothing to do;
* two: compared in the JVM;
* up to ``bucket_limit``: a breadth-first walk by blocks of XOR and popcount,
  which emits a spanning forest, never all pairs;
* more: exact by midpoints.  Two fingerprints within r share a point within
  ceil(r/2) of both, and any two that share such a point are within the next
  even number.  For an even r the rows of one midpoint are linked to their
  smallest, which is linear in the bucket and split by midpoint.

Components of the links are found by ``connected_components``.

Defined results: null and empty texts have no word and the fingerprint zero,
linked like any other.  Rows with a null doc_id keep their row; they count for
links but never as the smallest id unless a group has no other.  Repeated rows
stay repeated.  An empty table gives an empty result.  Other columns are not
read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.operators.components import connected_components
from braidwork.shared import Written, bounded_batches

BITS = 64
SHINGLES_AT_ONCE = 1 << 15
#: Spreads the positions' codes over all vectors, so that every mask holds about half the positions.
_STEP = 103


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of these 64-bit hashes set each bit."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingle_hashes(text: bytes | None, width: int = 4) -> np.ndarray:
    """Hashes of the shingles of a UTF-8 text in order, A-Z lower-cased; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []  # bytes: only A-Z, and only \x20 and \x09-\x0D
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - width + 1)


def bits_of(hashes: np.ndarray) -> int:
    """The fingerprint: bits that over half the hashes set."""
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        sums += bit_sums(hashes[at : at + SHINGLES_AT_ONCE])
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the shingles of a UTF-8 text, A-Z lower-cased; zero for a text without words."""
    return bits_of(shingle_hashes(text, width)) if text and not text.isspace() else 0


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long; key may be a struct of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    rows = bounded_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("fp", T.LongType())]))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks of all tables over so many bits, as unsigned numbers."""
    n = radius + 1
    codes = [1 + p * _STEP % (2**n - 1) for p in range(bits)]
    return [sum(1 << p for p in range(bits) if (codes[p] & v).bit_count() % 2) for v in range(1, 2**n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of distinct fingerprints within the radius."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            now, frontier = frontier[:block], frontier[block:]
            near = np.bitwise_count(now[:, None] ^ rest[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                left.append(now[near[:, hit].argmax(axis=0)])
                right.append(rest[hit])
                frontier = np.concatenate([frontier, rest[hit]])
                rest = rest[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _bucket_links(radius: int):
    """Links within each run of equal (t, k) of sorted batches; a run may cross batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        key = None

        def solve(parts: list[np.ndarray]) -> pa.RecordBatch | None:
            a, b = forest(np.unique(np.concatenate(parts)).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]) if len(a) else None

        for batch in batches:
            t, k, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(t)], strict=True):
                if e > s:
                    if key is not None and key != (t[s], k[s]):
                        if (out := solve(kept)) is not None:
                            yield out
                        kept = []
                    key = (t[s], k[s])
                    kept.append(fp[s:e])
        if kept and (out := solve(kept)) is not None:
            yield out

    return run


def links(fps: DataFrame, radius: int = 4, bucket_limit: int = 16384) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column fp) whose components are those of all pairs within the radius.

    bucket_limit: fingerprints of a bucket that one task compares; larger buckets take the midpoints.
    """
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    tables = F.explode(F.array(*(F.struct(F.lit(t).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(covering_masks(radius)))))
    rows = fps.select("fp", tables.alias("x")).select("x.t", "x.k", "fp")
    shared = Written(rows.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    pairs = shared.df.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    some = rows.join(shared.df.where(F.col("n").between(3, bucket_limit)).select("t", "k"), ["t", "k"])
    grouped = some.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_bucket_links(radius), "a bigint, b bigint")
    out = pairs.union(grouped)
    if shared.df.where(F.col("n") > bucket_limit).limit(1).count():
        flips = [sum(1 << p for p in x) for r in range(radius // 2 + 1) for x in combinations(range(BITS), r)]
        flips = F.array(*(F.lit(_signed(x)) for x in flips))
        many = rows.join(shared.df.where(F.col("n") > bucket_limit).select("t", "k"), ["t", "k"]).select("fp").distinct()
        points = many.select("fp", F.explode(flips).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("at"), "fp")
        stars = points.join(points.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z"), "at")
        out = out.union(stars.where("fp > a").select("a", F.col("fp").alias("b")))
    return out.distinct()


def groups(fps: DataFrame, radius: int = 4, bucket_limit: int = 16384) -> DataFrame:
    """(fp, root) of every distinct fingerprint of a column fp; root: one fingerprint of its component."""
    distinct = fps.select("fp").distinct()
    roots = connected_components(links(distinct, radius, bucket_limit))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, bucket_limit: int = 16384) -> DataFrame:
    """(key, fingerprint, component_id) of every row of docs."""
    found = Written(fingerprints(docs, key, text, width), "fingerprints").df
    first = found.groupBy("fp").agg(F.min("key").alias("first"))
    member = first.join(groups(found, radius, bucket_limit), "fp")
    named = member.join(member.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return found.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
