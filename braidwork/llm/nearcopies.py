"""SimHash near-dedup for word shingles that are at least 4/5 alike, by covering hashing of 128-bit fingerprints.

Texts whose sets of five-word shingles have a Jaccard similarity of 4/5 differ
in about 15 % of their fingerprint bits, too many for the tables of one covering
code.  So a fingerprint of 128 bits is cut in five stretches: of a pair within 24
bits one stretch differs in at most 4, and a covering code of radius 4 on each
stretch (31 masks, see ``simhash.covering_masks``) guarantees that such a pair
meets in some table.  Pairs further apart meet if any mask leaves out all their
differences: at a similarity of 0.8 over 99 of 100 pairs meet.  Pairs that meet are
then held to the exact similarity.

* Texts with equal sets are one node.  Alike sets differ in size by a quarter at
  most, so the class of its size is part of a node's key; a node near the end of
  its class has the keys of the next one too.
* A first pass counts each node's company, the most nodes that are near it in one
  bucket.  It moves a fingerprint, an id and a rough size with each two keys: tables
  are taken in twos, and what both keep decides where both keys go.  So what it
  moves is in proportion to the nodes.  Later passes see nodes with company alone:
  there a task packs a block for each part of the keys, every node once, then the
  keys and the nodes they belong to.  In the second one a node of little company meets all of it; two nodes
  of much company meet only if one is the other's nearest or its greatest in
  company, in some table.  So a large group of near copies is first joined by its
  hubs.  Beyond LEADERS nodes a bucket is here compared with its first LEADERS
  and with the node's own stretch, in an order that differs from table to table.
* Nodes without company are done with.  Of the others the sets are made and
  each shingle that only one of them has is counted: it can be in no
  intersection, which bounds every pair's similarity exactly.  In a large group
  of copies with edits of their own this leaves those that can be alike, and
  only these meet again.  They carry how many of their other shingles fall in
  each of SLOTS slots: no intersection is larger than the sum of the lesser
  counts, so pairs with edits in different places need not be tried.
* In each of ROUNDS rounds every node is held against the nearest node that it
  met in another component, so what is linked already needs no more pairs and
  the links found stay few.  Pairs whose nodes are apart afterwards come last, all.
* What the hubs leave apart meets once more, now in all pairs of different
  components and in buckets of any size.  So the components are those of all
  pairs that meet; a group that its hubs have joined costs nothing here.

Whole rows are moved only for texts that have a copy or a near copy.

Defined results: words are split and A-Z lower-cased as by SimHash; a text of
fewer words than a shingle is one shingle, null and wordless texts are alike.
Of a group the row with the smallest key stays, a null key last.  Repeated rows
are one group.  Other columns are not read, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm import bitmap
from braidwork.llm.simhash import BITS, as_bytes, bits_of, covering_masks, shingle_hashes
from braidwork.llm.substring import mix
from braidwork.operators.components import connected_components
from braidwork.shared import Written, bounded_batches, released

#: Alike: NEAR[1] times the shared shingles are at least NEAR[0] times all of both.
NEAR = (4, 5)
#: Stretches of a fingerprint of two words, and the radius of each one's code: pairs within STRETCHES * (REACH + 1) - 1 bits surely meet.
STRETCHES, REACH = 5, 4
#: Pairs further apart are chance: at a similarity of 4/5 it is 19 bits, give or take 4.
WITHIN = 34
#: Nodes that a map task packs at once, and keys that one group compares.
BLOCK_NODES, KEYS_PER_PART = 4_000, 200_000
#: Company up to which a node meets all of it, and size of buckets that are compared by lags; beyond LEADERS see above.
SMALL, LEADERS = 16, 4_096
#: Pairs of nodes that are looked at at once.
AT_ONCE = 1 << 14
#: Rounds in which a node tries one pair; what they leave apart is tried in full.
ROUNDS = 3

#: Sizes are classed by powers of CLASS; the next class begins where the size ratio of alike sets, 5/4, still reaches.
CLASS = 4
#: A node of the first pass; q: eighths of the size's binary logarithm, which differ by at most NEAR_Q between alike sets.
_FIRST, NEAR_Q = np.dtype([("fp", "<u8", 2), ("sid", "<i8"), ("q", "u1")]), 3
#: n: size of the set; c: how many of its shingles another set may have; deg: its company; root: its component so far.
_NODE = np.dtype([("fp", "<u8", 2), ("sid", "<i8"), ("n", "<u4"), ("c", "<u4"), ("deg", "<u4"), ("root", "<i8")])
#: Slots of a node's shingles, and the form of nodes that carry them: counts, rounded up to 1 << shift.
SLOTS = 64
_LIVE = np.dtype([*_NODE.descr, ("slots", "u1", SLOTS), ("shift", "u1")])


def masks() -> list[tuple[int, int]]:
    """Masks of the two words of a fingerprint, for all tables: a covering code of each stretch."""
    cuts = [2 * BITS * k // STRETCHES for k in range(STRETCHES + 1)]
    wide = [m << begin for begin, end in zip(cuts, cuts[1:], strict=False) for m in covering_masks(REACH, end - begin)]
    return [(m & (1 << BITS) - 1, m >> BITS) for m in wide]


def described(text: bytes | None, width: int) -> tuple[list[int], int, np.ndarray]:
    """(fingerprint, identity of the set, the set of shingles ascending) of a UTF-8 text."""
    hashes = shingle_hashes(text, width)
    found = np.unique(hashes)
    return [bits_of(hashes), bits_of(mix(hashes))], xxhash.xxh64_intdigest(found.tobytes()), found


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def marks(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, tid, sid, fp, fp2, n) of every row: ids of its text and of its set, fingerprint, size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(*fp, sid, len(s)) for fp, sid, s in (described(t, width) for t in as_bytes(batch.column(2)))]
            fp, fp2, sid = (_longs([g[k] for g in got]) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sid, fp, fp2, pa.array(np.array([g[3] for g in got], np.int32))], names=["key", "tid", "sid", "fp", "fp2", "n"])

    rows = bounded_batches(docs.select(F.col(key).alias("key"), tid_of(text).alias("tid"), F.col(text).alias("text")))
    return rows.mapInArrow(released(run), T.StructType([rows.schema["key"], *T.StructType.fromDDL("tid bigint, sid bigint, fp bigint, fp2 bigint, n int").fields]))


def tid_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slots_of(shingles: np.ndarray, own: np.ndarray) -> bytes:
    """Counts by slot of the shingles that are not of this set alone, rounded up to fit into a byte, and their shift."""
    n = np.bincount(shingles & (SLOTS - 1), minlength=SLOTS) - np.bincount(own & (SLOTS - 1), minlength=SLOTS)
    shift = 0
    while int(n.max()) + (1 << shift) - 1 >> shift > 255:
        shift += 1
    return bytes([*(n + (1 << shift) - 1 >> shift).tolist(), shift])


def _slots_allow(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b, by the lesser counts of their slots, can be alike."""
    ok = np.ones(len(a), bool)
    if "slots" in nodes.dtype.names:
        for at in range(0, len(a), AT_ONCE):
            x, y = nodes[a[at : at + AT_ONCE]], nodes[b[at : at + AT_ONCE]]
            most = np.minimum(*(v["slots"].astype(np.int64) << v["shift"][:, None].astype(np.int64) for v in (x, y))).sum(axis=1)
            ok[at : at + AT_ONCE] = (NEAR[0] + NEAR[1]) * most >= NEAR[0] * (x["n"].astype(np.int64) + y["n"])
    return ok


def together() -> list[tuple[int, int]]:
    """For each table the bits of the two words that its neighbour in the code keeps too, whole masks where there is none; neighbours stand next to each other."""
    tables = masks()
    of = len(tables) // STRETCHES
    pair = lambda k: min(k ^ 1, of - 1)
    return [tuple(a & b for a, b in zip(tables[t], tables[t - t % of + pair(t % of)], strict=True)) for t in range(len(tables))]


def _hashed(fp: np.ndarray, n: np.ndarray, tables: list[tuple[int, int]], also_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of what tables keep and of the class, and of numbers, by row and table; the rows)."""
    kept_by = np.array(tables, np.uint64)
    kept = (fp[:, :1] & kept_by[:, 0]) * np.uint64(0xBF58476D1CE4E5B9) + (fp[:, 1:] & kept_by[:, 1]) * np.uint64(0x94D049BB133111EB) + also_by
    bounds = CLASS ** np.arange(1, 17, dtype=np.int64)
    own = np.searchsorted(bounds, n, side="right")
    also = np.flatnonzero(n.astype(np.int64) * NEAR[1] >= bounds[own] * NEAR[0])
    rows, classes = np.concatenate([np.arange(len(n)), also]), np.concatenate([own, own[also] + 1]).astype(np.uint64)
    return (kept[rows] ^ kept[rows] >> np.uint64(32) ^ (classes * np.uint64(0xD6E8FEB86659FD93))[:, None]) * np.uint64(0x9E3779B97F4A7C15), rows


def parts_of(fp: np.ndarray, n: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key of keys_of().  What keys of neighbouring tables share decides, so both of a node are in one part and it travels once for them."""
    shared = together()
    first, at = np.unique([shared.index(s) for s in shared], return_inverse=True)
    hashed, _ = _hashed(fp, n, [shared[t] for t in first.tolist()], first.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return ((hashed >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)[:, at].ravel()


def keys_of(fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, the rows they belong to) of fingerprints of sets of these sizes: a table in 8 bits, what it keeps and the class in 24."""
    tables = masks()
    hashed, rows = _hashed(fp, n, tables, np.zeros(len(tables), np.uint64))
    key = ((np.arange(len(tables), dtype=np.uint64) << np.uint64(24)) | (hashed >> np.uint64(40))).astype(np.uint32)
    return key.ravel(), np.repeat(rows, len(tables)).astype(np.uint16)


def _pack(parts: int, form: np.dtype):
    """Blocks (part, nodes, keys, at) of the nodes of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_NODES):
                rows = batch.slice(begin, BLOCK_NODES)
                nodes, size = np.empty(rows.num_rows, form), rows.column(3).to_numpy()
                nodes["sid"] = rows.column(0).to_numpy()
                for k in range(2):
                    nodes["fp"][:, k] = rows.column(1 + k).to_numpy().view(np.uint64)
                if form is _FIRST:
                    nodes["q"] = 8 * np.log2(size + 1.0)
                else:
                    nodes["n"], nodes["c"], nodes["deg"], nodes["root"] = size, *(rows.column(c).to_numpy() for c in (4, 5, 6))
                    counts = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(-1, SLOTS + 1)
                    nodes["slots"], nodes["shift"] = counts[:, :SLOTS], counts[:, SLOTS]
                key, at = keys_of(nodes["fp"], size)
                part = parts_of(nodes["fp"], size, parts)
                order = np.argsort(part, kind="stable")
                key, at, part = key[order], at[order], part[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
                out: list[list] = [[], [], [], []]
                for s, e in zip(cuts.tolist(), [*cuts.tolist()[1:], len(part)], strict=True):
                    used, mine = np.unique(at[s:e], return_inverse=True)
                    for column, value in zip(out, (int(part[s]), nodes[used].tobytes(), key[s:e].tobytes(), mine.astype("<u2").tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["part", "nodes", "keys", "at"])

    return run


def _can_be_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if "q" in x.dtype.names:
        return np.abs(x["q"].astype(np.int16) - y["q"]) <= NEAR_Q
    most = np.minimum(x["c"], y["c"]).astype(np.int64)
    return (NEAR[0] + NEAR[1]) * most >= NEAR[0] * (x["n"].astype(np.int64) + y["n"])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1])


def _buckets(key: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by key, begin and size of each bucket)."""
    salt = (nodes["sid"].view(np.uint64) ^ (key.astype(np.uint64) >> np.uint64(24)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort((key.astype(np.uint64) << np.uint64(32)) | (salt >> np.uint64(32)))
    return order, *_runs(key[order])


def _runs(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the runs of rows that agree in all columns `by`."""
    rows = len(by[0])
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in by])]) if rows else np.empty(0, bool)
    begin = np.flatnonzero(new)
    return begin, np.diff(np.concatenate([begin, [rows]]))


def _near(nodes: np.ndarray, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of rows and other rows, 255 where they are the same row or not near."""
    bits = _apart(nodes["fp"][mine][:, None], nodes["fp"][others][None, :])
    bits[(bits > WITHIN) | (others[None, :] == mine[:, None])] = 255
    at = np.flatnonzero(bits < 255)
    for k in range(0, len(at), AT_ONCE):
        some = at[k : k + AT_ONCE]
        a, b = mine[some // len(others)], others[some % len(others)]
        bits.ravel()[some[~(_can_be_alike(nodes[a], nodes[b]) & _slots_allow(nodes, a, b))]] = 255
    return bits


def _small(nodes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bits): all near pairs of rows of small buckets."""
    left = np.where(size <= SMALL, size, 0).repeat(size) - (np.arange(len(nodes)) - begin.repeat(size))
    rows, out = np.flatnonzero(left > 1), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))]
    for lag in range(1, SMALL):
        rows = rows[left[rows] > lag]
        if not len(rows):
            break
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            bits = _apart(nodes["fp"][some], nodes["fp"][some + lag])
            hit = np.flatnonzero(bits <= WITHIN)
            hit = hit[_can_be_alike(nodes[some[hit]], nodes[some[hit] + lag])]
            hit = hit[_slots_allow(nodes, some[hit], some[hit] + lag)]
            out.append((some[hit], some[hit] + lag, bits[hit]))
    a, b, bits = (np.concatenate([x[k] for x in out]) for k in range(3))
    return a, b, bits


def _large(nodes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, others, bits or 255 where they are not near), by blocks of rows of large buckets."""
    for s, e in zip(begin[size > SMALL].tolist(), (begin + size)[size > SMALL].tolist(), strict=True):
        for at in range(s, e, 256):
            stretch = s + (at - s) // LEADERS * LEADERS
            mine = np.arange(at, min(at + 256, e, stretch + LEADERS))
            others = np.concatenate([np.arange(s, min(s + LEADERS, stretch)), np.arange(stretch, min(stretch + LEADERS, e))])
            yield mine, others, _near(nodes, mine, others)


def company(key: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row of `nodes`, how many others are near it in its bucket."""
    order, begin, size = _buckets(key, nodes)
    nodes = nodes[order]
    a, b, _ = _small(nodes, begin, size)
    n = np.bincount(np.concatenate([a, b]), minlength=len(nodes))
    for mine, _, bits in _large(nodes, begin, size):
        n[mine] += (bits < 255).sum(axis=1)
    for s, e in zip(begin[size > LEADERS].tolist(), (begin + size)[size > LEADERS].tolist(), strict=True):
        alone = s + np.flatnonzero(n[s:e] == 0)  # their company may be in a stretch that _large leaves out
        for at, c in product(range(0, len(alone), 256), range(s, e, LEADERS)):
            mine = alone[at : at + 256]
            n[mine] += (_near(nodes, mine, np.arange(c, min(c + LEADERS, e))) < 255).sum(axis=1)
    out = np.empty(len(nodes), np.int64)
    out[order] = n
    return out


def met(key: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits) of rows of `nodes` that meet under a key and may be alike; see the module's text."""
    order, begin, size = _buckets(key, nodes)
    nodes = nodes[order]
    many = nodes["deg"] > SMALL
    a, b, bits = _small(nodes, begin, size)
    much = many[a] & many[b]
    out = [(a[~much], b[~much], bits[~much])]
    x, y, both = np.concatenate([a[much], b[much]]), np.concatenate([b[much], a[much]]), np.concatenate([bits[much]] * 2)
    for by in ((both, x), (y, -nodes["deg"][y].astype(np.int64), x)):
        chosen = np.lexsort(by)
        chosen = chosen[np.concatenate([[True], x[chosen][1:] != x[chosen][:-1]])] if len(x) else chosen
        out.append((x[chosen], y[chosen], both[chosen]))
    for mine, others, near in _large(nodes, begin, size):
        r, c = np.nonzero((near < 255) & ~(many[mine][:, None] & many[others][None, :]))
        out.append((mine[r], others[c], near[r, c]))
        near[~(many[mine][:, None] & many[others][None, :])] = 255
        greatest = np.where(near < 255, nodes["deg"][others].astype(np.int64)[None, :], -1)  # the first of equal ones, for all the same
        for c in (near.argmin(axis=1), greatest.argmax(axis=1)):
            found = near[np.arange(len(mine)), c]
            out.append((mine[found < 255], others[c[found < 255]], found[found < 255]))
    a, b, bits = (np.concatenate([x[k] for x in out]) for k in range(3))
    return order[a], order[b], bits


def across(key: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits) of all near rows of `nodes` that share a key and have different roots."""
    order = np.lexsort((nodes["root"], key))
    key, nodes = key[order], nodes[order]
    root = nodes["root"]
    begin, size = _runs(key)
    a, b, bits = _small(nodes, begin, size)
    other = root[a] != root[b]
    out = [(a[other], b[other], bits[other])]
    at, rows = _runs(key, root)
    until = (at + rows).repeat(rows)  # where the rows of the same root end
    for s, e in zip(begin[size > SMALL].tolist(), (begin + size)[size > SMALL].tolist(), strict=True):
        for at in range(s, e, 256):
            mine = np.arange(at, min(at + 256, e))
            for c in range(int(until[at]), e, LEADERS):
                others = np.arange(c, min(c + LEADERS, e))
                near = _near(nodes, mine, others)
                x, y = np.nonzero((near < 255) & (others[None, :] > mine[:, None]) & (root[others][None, :] != root[mine][:, None]))
                out.append((mine[x], others[y], near[x, y]))
    a, b, bits = (np.concatenate([x[k] for x in out]) for k in range(3))
    return order[a], order[b], bits


def _unpacked(blocks: pa.Table, form: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes) of a part."""
    own, at, keys = ([x.as_buffer() for x in blocks.column(c)] for c in ("nodes", "at", "keys"))
    ends = np.cumsum([0, *(x.size // 2 for x in at)]).tolist()
    key, nodes = np.empty(ends[-1], np.uint32), np.empty(ends[-1], form)
    for k, (s, e) in enumerate(zip(ends, ends[1:], strict=False)):
        nodes[s:e] = np.frombuffer(own[k], form)[np.frombuffer(at[k], "<u2")]
        key[s:e] = np.frombuffer(keys[k], "<u4")
    return key, nodes


def _meet(blocks: pa.Table) -> pa.Table:
    """(a, b, bits): pairs of sets, each once, that meet in a part of the keys."""
    key, nodes = _unpacked(blocks, _LIVE)
    return _once(nodes, *met(key, nodes))


def _meet_across(blocks: pa.Table) -> pa.Table:
    """(a, b, bits): all pairs of sets of different components, each once, that share a key of a part and are near."""
    key, nodes = _unpacked(blocks, _LIVE)
    return _once(nodes, *across(key, nodes))


def _once(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> pa.Table:
    a, b = nodes["sid"][a], nodes["sid"][b]
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, bits = low[order], high[order], bits[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) & (low != high) if len(low) else np.empty(0, bool)
    return pa.table([pa.array(low[new]), pa.array(high[new]), pa.array(bits[new].astype(np.int8))], names=["a", "b", "bits"])


def _company(blocks: pa.Table) -> pa.Table:
    """(sid, deg): sets with company in a part of the keys, and the most of it."""
    key, nodes = _unpacked(blocks, _FIRST)
    n = company(key, nodes)
    order = np.lexsort((-n, nodes["sid"]))
    sid, n = nodes["sid"][order], n[order]
    first = np.concatenate([[True], sid[1:] != sid[:-1]]) & (n > 0)
    return pa.table([pa.array(sid[first]), pa.array(n[first].astype(np.int32))], names=["sid", "deg"])


def packed(nodes: DataFrame):
    """Blocks of nodes (sid, fp, fp2, n; of later passes also c, deg, root, slots), grouped by part of the keys."""
    columns, form = ["sid", "fp", "fp2", "n"], _FIRST
    if "slots" in nodes.columns:
        columns, form = [*columns, "c", "deg", "root", "slots"], _LIVE
    parts = max(1, nodes.count() * len(masks()) // KEYS_PER_PART)
    return nodes.select(*columns).mapInArrow(released(_pack(parts, form)), "part int, nodes binary, keys binary, at binary").groupBy("part")


def sets_of(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(sid, s) of nodes (sid, tid): the shingles, from texts (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [described(t, width) for t in as_bytes(batch.column(0))]
            ends = np.cumsum([0, *(len(g[2]) for g in got)], dtype=np.int32)
            flat = np.concatenate([g[2] for g in got]).view(np.int64) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([_longs([g[1] for g in got]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["sid", "s"])

    some = bitmap.marked(texts, F.col("tid"), nodes, F.col("tid")).where("hit").join(nodes.select("tid"), "tid", "left_semi").dropDuplicates(["tid"]).select("text")
    return bounded_batches(some).mapInArrow(released(run), "sid bigint, s array<bigint>")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of sets (sid, s) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(NEAR[1] * both >= NEAR[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    tried = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    some = bitmap.marked(sets, F.col("sid"), tried, F.col("sid")).where("hit")  # sets travel only if they are tried
    at = lambda c: some.select(F.col("sid").alias(c), F.col("s").alias(f"s_{c}"))
    rows = pairs.select("a", "b").join(at("a"), "a").join(at("b"), "b").select("a", "b", "s_a", "s_b")
    return Written(bounded_batches(rows).mapInArrow(released(run), "a bigint, b bigint"), "alike").df


def with_slots(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes (sid, fp, fp2, n, c, deg, own) with their slots, from sets (sid, s); each its own root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [[x.values.to_numpy() for x in batch.column(k)] for k in (6, 7)]
            slots = pa.array([slots_of(s, own) for own, s in zip(*values, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(0), slots], names=["sid", "fp", "fp2", "n", "c", "deg", "root", "slots"])

    rows = nodes.join(sets, "sid").select("sid", "fp", "fp2", "n", "c", "deg", "own", "s")
    return bounded_batches(rows).mapInArrow(released(run), "sid bigint, fp bigint, fp2 bigint, n int, c int, deg int, root bigint, slots binary")


def links(nodes: DataFrame, texts: DataFrame, width: int = 5) -> DataFrame:
    """(a, b): pairs of nodes (sid, fp, fp2, n, tid) that are alike; their components are those of all pairs that met."""
    of = lambda groups, c: groups.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    kept: list[Written] = []  # until all pairs are tried

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept.append(Written(df, name))
        return kept[-1].df

    found = packed(nodes).applyInArrow(_company, "sid bigint, deg int")
    some = Written(nodes.join(found.groupBy("sid").agg(F.max("deg").alias("deg")), "sid"), "company")
    sets = Written(sets_of(some.df, texts, width), "sets")
    only = sets.df.select("sid", F.explode("s").alias("k")).groupBy("k").agg(F.min("sid").alias("sid"), F.max("sid").alias("z")).where("sid = z").groupBy("sid").agg(F.collect_list("k").alias("own"))
    live = some.df.join(only, "sid", "left").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>"))).withColumn("c", F.expr("n - size(own)"))
    live = keep(with_slots(live.where(F.col("c") * NEAR[1] >= F.col("n") * NEAR[0]), sets.df), "live")
    some.drop()
    pool, tried, found = keep(packed(live).applyInArrow(_meet, "a bigint, b bigint, bits tinyint").distinct(), "pairs"), [], []
    for _ in range(ROUNDS):
        ends = pool.select(F.col("a").alias("x"), F.col("b").alias("y"), "bits").union(pool.select("b", "a", "bits"))
        nearest = ends.groupBy("x").agg(F.min(F.struct("bits", "y")).alias("p")).select(F.least("x", "p.y").alias("a"), F.greatest("x", "p.y").alias("b")).distinct()
        tried.append(keep(nearest, "nearest"))
        found.append(alike(tried[-1], sets.df))
        groups = Written(connected_components(reduce(DataFrame.union, found)), "groups")
        apart = pool.join(of(groups.df, "a"), "a", "left").join(of(groups.df, "b"), "b", "left").where("coalesce(c_a, a) <> coalesce(c_b, b)")
        pool = keep(apart.select("a", "b", "bits").join(tried[-1], ["a", "b"], "left_anti"), "pool")
        groups.drop()
    tried.append(pool.select("a", "b"))
    found.append(alike(tried[-1], sets.df))
    groups = keep(connected_components(reduce(DataFrame.union, found)), "groups")
    rooted = live.drop("root").join(of(groups, "sid"), "sid", "left").withColumn("root", F.coalesce("c_sid", "sid"))
    left = packed(rooted).applyInArrow(_meet_across, "a bigint, b bigint, bits tinyint").select("a", "b").distinct()
    untried = keep(left.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti"), "across")
    found.append(alike(untried, sets.df))
    for w in (sets, *kept):
        w.drop()
    return reduce(DataFrame.union, found)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The row of docs with the smallest key of each group of near copies; of rows that tie, one."""
    marked = Written(marks(docs, key, text, width), "marks")
    nodes = Written(marked.df.groupBy("sid").agg(F.min(F.struct("tid", "fp", "fp2", "n")).alias("m")).select("sid", "m.*"), "nodes")
    texts = docs.select(tid_of(text).alias("tid"), F.col(text).alias("text"))
    groups = Written(connected_components(links(nodes.df, texts, width)), "groups")
    nodes.drop()
    rooted = marked.df.join(groups.df.withColumnRenamed("node", "sid"), "sid", "left").select("key", "tid", F.coalesce("component", "sid").alias("root"))
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("tid"))
    several = rooted.groupBy("root").agg(F.count("*").alias("rows"), F.min(order).alias("first")).where("rows > 1")
    several = Written(several, "several")  # so that a root with many rows can be split among tasks
    member = rooted.join(several.df, "root").select("key", "tid", (F.col("key").eqNullSafe(F.col("first.key")) & (F.col("tid") == F.col("first.tid"))).alias("stays"))
    member = Written(member.distinct(), "members").df
    for w in (marked, groups, several):
        w.drop()
    own, tid = docs.columns, tid_of(text)
    rows = docs.select(F.struct(*own).alias("row"), F.col(key).alias("key"), tid.alias("tid"))
    rows = bitmap.marked(rows, F.col("tid"), member.select("tid").distinct(), F.col("tid"))
    some = rows.where("hit").alias("r").join(member.alias("m"), F.col("r.key").eqNullSafe(F.col("m.key")) & (F.col("r.tid") == F.col("m.tid")), "left")
    some = some.where("m.stays is null or m.stays").select("r.row", "r.key", "r.tid", F.col("m.tid").isNull().alias("alone"))
    first = some.where("not alone").groupBy("key", "tid").agg(F.first("row").alias("row")).select("row")
    return rows.where("not hit").select("row").union(some.where("alone").select("row")).union(first).select("row.*")
