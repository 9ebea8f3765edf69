"""Progressive alignment of long overlaps: profiles are joined up a guide tree, one level of all groups a round.

A profile says how often each letter stands in each column.  The guide tree pairs
members that stand next to each other in the order of their sketches (least
hashes of their words), so members that share words meet early; pairs of one
level are independent tasks, and a group of g members takes about log2(g) rounds.
Joining two profiles aligns their columns; what travels on is the joined profile
and, for each of the two, the map of its columns, as the few stretches in which
columns follow each other.  Members' places are taken
through these maps in the end of every round, a member a row, so no task holds a
group's sequences.

Two profiles are aligned between anchors (words of their consensus that occur once
in both); what lies between is aligned by a dynamic program over columns with sums
of pairs and affine gaps in a table of at most CELLS, or cut in halves first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.poa import ANCHOR, CELLS, LONG, Scoring, anchors, merged, scores
from braidwork.shared import Written, bounded_batches

#: Letters that a profile tells apart; all others count as the last.
LETTERS = "ACGTN"
#: Least hashes in a sketch.
SKETCH = 4
_HEAD = ("biclique_id", "cluster", "h", "members", "sketch")
Map = list[tuple[int, int]]
Stretches = list[tuple[int, int, int]]


_CODES = np.array([LETTERS.find(c) if c in LETTERS else len(LETTERS) - 1 for c in map(chr, range(128))])


def letters(seq: str) -> np.ndarray:
    """Its code points."""
    return np.frombuffer(seq.encode("utf-32-le"), np.uint32)


def profile(seq: str) -> np.ndarray:
    """Counts (columns x letters) of one sequence."""
    return np.eye(len(LETTERS), dtype=np.int64)[_CODES[np.minimum(letters(seq), 127)]]


def consensus(counts: np.ndarray) -> str:
    return np.frombuffer(LETTERS.encode(), np.uint8)[counts.argmax(axis=1)].tobytes().decode()


def stored(counts: np.ndarray) -> bytes:
    """A profile as bytes: the width of its numbers, and these compressed."""
    form = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([form.itemsize]) + zlib.compress(counts.astype(form).tobytes(), 1)


def restored(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").reshape(-1, len(LETTERS)).astype(np.int64)


def stretched(columns: np.ndarray) -> bytes:
    """Ascending columns as their number, and the place and the column at which each stretch of following ones begins."""
    begins = np.flatnonzero(np.diff(columns, prepend=-2) != 1)
    out = np.empty(1 + 2 * len(begins), "<i4")
    out[0], out[1::2], out[2::2] = len(columns), begins, columns[begins]
    return out.tobytes()


def spread(data: bytes) -> np.ndarray:
    """The columns that stretched() took."""
    v = np.frombuffer(data, "<i4").astype(np.int64)
    return np.arange(v[0]) + np.repeat(v[2::2] - v[1::2], np.diff(np.append(v[1::2], v[0])))


def sketch_of(seq: str) -> list[int]:
    """The least hashes of its words."""
    at = letters(seq).astype(np.uint64)
    n = max(1, len(at) - ANCHOR + 1)
    hashes = np.zeros(n, np.uint64)
    for k in range(min(ANCHOR, len(at))):
        hashes = (hashes ^ at[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes.view(np.int64))[:SKETCH].tolist()


def affine(x: np.ndarray, y: np.ndarray, pairs: int, by: Scoring = LONG) -> Map:
    """Columns that a best alignment of two profiles puts together, in one table; a gap counts for all `pairs` of members."""
    n, m = len(x), len(y)
    low = -(1 << 60)
    gain = np.where(np.eye(len(LETTERS), dtype=bool), by.match, by.mismatch)
    worth = (y @ gain).T
    first, more = by.first * pairs, by.more * pairs
    ramp = more * np.arange(m + 1)
    best, up, left = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    best[0, 0] = 0
    best[0, 1:] = left[0, 1:] = first + more * np.arange(m)
    for i in range(1, n + 1):
        up[i] = np.maximum(best[i - 1] + first, up[i - 1] + more)
        here = up[i].copy()
        here[1:] = np.maximum(here[1:], best[i - 1, :-1] + x[i - 1] @ worth)
        left[i, 1:] = np.maximum.accumulate(here - ramp)[:-1] + (first - more) + ramp[1:]
        best[i] = np.maximum(here, left[i])
    out, i, j, state = [], n, m, best
    while i and j:
        if state is best:
            if best[i, j] == best[i - 1, j - 1] + x[i - 1] @ worth[:, j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            else:
                state = up if best[i, j] == up[i, j] else left
        elif state is up:
            state = best if up[i, j] == best[i - 1, j] + first else up
            i -= 1
        else:
            state = best if left[i, j] == best[i, j - 1] + first else left
            j -= 1
    return out[::-1]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many letters both begin with."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


def stretches(x: np.ndarray, y: np.ndarray, a: str, b: str, pairs: int, k: int = ANCHOR) -> Stretches:
    """(column of x, column of y, how many) put together of profiles x and y, whose consensus is a and b."""
    p, q = letters(a), letters(b)
    head = _alike(p, q)
    tail = _alike(p[head:][::-1], q[head:][::-1])
    out = [(0, 0, head)]
    i, j, p, q = head, head, len(a) - tail, len(b) - tail
    if i < p and j < q:
        u, w = a[i:p], b[j:q]
        if (p - i + 1) * (q - j + 1) <= CELLS:
            inner = [(c, d, 1) for c, d in affine(x[i:p], y[j:q], pairs)]
        elif found := anchors(u, w, k):
            inner, s, t = [], 0, 0
            for e, f in [*found, (len(u), len(w))]:
                inner += [(s + c, t + d, n) for c, d, n in stretches(x[i + s : i + e], y[j + t : j + f], u[s:e], w[t:f], pairs, k)]
                inner += [(e, f, k)] if e < len(u) else []
                s, t = e + k, f + k
        elif k >= 16:
            inner = stretches(x[i:p], y[j:q], u, w, pairs, k // 2)
        else:
            s = len(u) // 2
            t = int(np.argmax(scores(u[:s], w) + scores(u[s:][::-1], w[::-1])[::-1]))
            inner = stretches(x[i : i + s], y[j : j + t], u[:s], w[:t], pairs, k)
            inner += [(s + c, t + d, n) for c, d, n in stretches(x[i + s : p], y[j + t : q], u[s:], w[t:], pairs, k)]
        out += [(i + c, j + d, n) for c, d, n in inner]
    return [*out, (p, q, tail)]


def together(x: np.ndarray, y: np.ndarray, a: str, b: str, pairs: int, k: int = ANCHOR) -> Map:
    """Columns put together of profiles x and y, whose consensus is a and b."""
    return [(i + c, j + c) for i, j, n in stretches(x, y, a, b, pairs, k) for c in range(n)]


def joined(x: np.ndarray, y: np.ndarray, members: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(profile, columns of x in it, columns of y in it)."""
    a, b = consensus(x), consensus(y)
    to_x, to_y = np.empty(len(x), np.int32), np.empty(len(y), np.int32)
    i = j = n = 0
    for p, q, size in [*stretches(x, y, a, b, members[0] * members[1]), (len(x), len(y), 0)]:
        to_x[i:p] = np.arange(n, n + p - i)
        n += p - i
        to_y[j:q] = np.arange(n, n + q - j)
        n += q - j
        to_x[p : p + size] = to_y[q : q + size] = np.arange(n, n + size)
        n += size
        i, j = p + size, q + size
    out = np.zeros((n, len(LETTERS)), np.int64)
    out[to_x] += x
    out[to_y] += y
    return out, to_x, to_y


def _profiles(reads: DataFrame) -> DataFrame:
    """(biclique_id, cluster, h, members, sketch, counts) of single sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("read").to_pylist()
            made = [pa.array([sketch_of(s) for s in seqs], pa.list_(pa.int64())), pa.array([stored(profile(s)) for s in seqs], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _HEAD[:-1]), *made], names=[*_HEAD, "counts"])

    return bounded_batches(spread_out(reads).select(*_HEAD[:-1], "read")).mapInArrow(run, "biclique_id string, cluster bigint, h bigint, members bigint, sketch array<bigint>, counts binary")


def _level(profiles: DataFrame) -> DataFrame:
    """(biclique_id, cluster, parent, h, members, sketch, counts, columns): neighbours joined; the first of two carries the joined profile."""

    def run(rows: pa.Table) -> pa.Table:
        data = sorted(rows.to_pylist(), key=lambda r: r["rn"])
        own = [restored(r["counts"]) for r in data]
        if len(own) == 2:
            whole, *columns = joined(*own, (data[0]["members"], data[1]["members"]))
        else:
            whole, columns = own[0], [np.arange(len(own[0]), dtype=np.int32)]
        sketch = sorted({h for r in data for h in r["sketch"]})[:SKETCH]
        first = [True, False][: len(data)]
        out = {
            "biclique_id": [r["biclique_id"] for r in data], "cluster": [r["cluster"] for r in data], "parent": [r["pair"] for r in data], "h": [min(r["h"] for r in data)] * len(data),
            "members": [sum(r["members"] for r in data) if f else None for f in first], "sketch": [sketch if f else None for f in first], "counts": [stored(whole) if f else None for f in first], "columns": [stretched(c) for c in columns],
        }
        kinds = (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table({n: pa.array(v, kind) for (n, v), kind in zip(out.items(), kinds, strict=True)})

    rank = F.row_number().over(Window.partitionBy("biclique_id").orderBy("sketch", "h", "cluster")).cast("long")
    order = profiles.select("biclique_id", "cluster", "h", "sketch").withColumn("rn", rank).withColumn("pair", F.expr("(rn + 1) div 2")).drop("h", "sketch")
    rows = profiles.join(order, ["biclique_id", "cluster"])
    return rows.groupBy("biclique_id", "pair").applyInArrow(run, "biclique_id string, cluster bigint, parent bigint, h bigint, members bigint, sketch array<bigint>, counts binary, columns binary")


def _moved(places: DataFrame) -> DataFrame:
    """(biclique_id, rid, cluster, at) of rows (biclique_id, rid, cluster, at, columns): the columns that the columns `at`, or if null all, became."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = [c if at is None else stretched(spread(c)[spread(at)]) for at, c in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(now, pa.binary())], names=["biclique_id", "rid", "cluster", "at"])

    return places.select("biclique_id", "rid", "cluster", "at", "columns").mapInArrow(run, "biclique_id string, rid bigint, cluster bigint, at binary")


def placed(distinct: DataFrame) -> DataFrame:
    """(biclique_id, rid, at): the column of each base, as stretched() gives it, of sequences (biclique_id, rid, read, members); null for those alone in their group."""
    every = distinct.select("biclique_id", "rid", F.col("rid").alias("cluster"), F.lit(None).cast("binary").alias("at"))
    now, used = Written(_profiles(distinct.withColumns({"cluster": F.col("rid"), "h": F.xxhash64("read")})), "profiles"), []
    while now.df.groupBy("biclique_id").count().where("count > 1").head(1):
        level = Written(_level(now.df), "level")
        moves = level.df.select("biclique_id", "cluster", "parent", "columns")
        moved = Written(_moved(every.join(moves, ["biclique_id", "cluster"]).drop("cluster").withColumnRenamed("parent", "cluster")), "places")
        for w in (now, *used):
            w.drop()
        now = Written(level.df.where("counts is not null").select("biclique_id", F.col("parent").alias("cluster"), "h", "members", "sketch", "counts"), "profiles")
        level.drop()
        used, every = [moved], moved.df
    now.drop()
    return every.select("biclique_id", "rid", "at")


#: Bases that one task aligns.
BASES_PER_TASK = 500_000


def spread_out(reads: DataFrame) -> DataFrame:
    """reads (biclique_id, read, ...), written, dealt by group to as many tasks as their bases are work for; by their bytes alone they would be few."""
    bases = reads.agg(F.coalesce(F.sum(F.length("read")), F.lit(0))).first()[0]
    return reads.repartition(1 + bases // BASES_PER_TASK, "biclique_id")


def distinct_reads(members: DataFrame) -> DataFrame:
    """(biclique_id, rid, read, members, digest): the different sequences of members (biclique_id, side, read), written once."""
    found = members.groupBy("biclique_id", "read").agg(F.count("*").alias("members"))
    return Written(found.select("biclique_id", F.monotonically_increasing_id().alias("rid"), "read", "members", F.sha2("read", 256).alias("digest")), "reads").df


def of_members(steps: DataFrame, members: DataFrame, distinct: DataFrame) -> DataFrame:
    """(biclique_id, side, ord, poa, seq) of members, from the steps (biclique_id, rid, ord, poa, seq) of their different sequences; sequences meet by digest."""
    of = members.select("biclique_id", "side", F.sha2("read", 256).alias("digest")).join(distinct.select("biclique_id", "rid", "digest"), ["biclique_id", "digest"])
    return of.join(steps, ["biclique_id", "rid"]).select("biclique_id", "side", "ord", "poa", "seq")


def steps(members: DataFrame) -> DataFrame:
    """(biclique_id, side, ord, poa, seq): paths of the members (biclique_id, side, read) of long groups."""
    distinct = distinct_reads(members)
    return of_members(distinct_steps(distinct), members, distinct)


def distinct_steps(distinct: DataFrame) -> DataFrame:
    """(biclique_id, rid, ord, poa, seq): paths of the different sequences (biclique_id, rid, read, members) of long groups.

    A node is a column and a letter; runs that all members go through alike are
    one.  A task gets a group's columns, once for each distinct sequence.
    """

    def run(rows: pa.Table) -> pa.Table:
        data = rows.sort_by("read").to_pydict()
        own = [letters(r).astype(np.int64) for r in data["read"]]
        at = [np.arange(len(r)) if a is None else spread(a) for a, r in zip(data["at"], own, strict=True)]
        number, paths = np.unique(np.concatenate([a << 21 | r for a, r in zip(at, own, strict=True)]), return_inverse=True)
        base = (number & (1 << 21) - 1).astype("<u4").tobytes().decode("utf-32-le")
        nodes, paths = merged(base, np.split(paths, np.cumsum([len(r) for r in own])[:-1]))
        flat = [(b, r, k, v, nodes[v]) for b, r, p in zip(data["biclique_id"], data["rid"], paths, strict=True) for k, v in enumerate(p)]
        kinds = (("biclique_id", pa.string()), ("rid", pa.int64()), ("ord", pa.int32()), ("poa", pa.int32()), ("seq", pa.string()))
        return pa.table({n: pa.array([f[i] for f in flat], kind) for i, (n, kind) in enumerate(kinds)})

    rows = placed(distinct).join(distinct.select("biclique_id", "rid", "read"), ["biclique_id", "rid"])
    return rows.groupBy("biclique_id").applyInArrow(run, "biclique_id string, rid bigint, ord int, poa int, seq string")
