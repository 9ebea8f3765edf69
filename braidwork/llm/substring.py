"""Exact repeated-passage removal by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Its minimiser is the
first place of the least mixed hash among its runs of ``minimiser`` words, so
equal windows have it at the same offset wherever they stand.  Consecutive
windows that share the place of their minimiser are a super-k-mer.

* Of a window either the left or the right half of what surrounds the minimiser
  is whole, by its offset.  So a super-k-mer is cut in two pieces at most, and a
  piece's signature is the hash of that half and the minimiser, which stand in
  every window of it: equal windows are in different pieces of one signature.
* Signatures are counted over the whole corpus first.  Those that occur once
  hold no repeated window, and their pieces stay where they are; the others mark
  a bit of a map that grows with their number up to MOST_BITS.  A bit that is
  marked by chance only moves a piece in vain.
* The other pieces travel as one packed string each to the bucket of their
  signature.  There the windows are sorted and counted, and runs of equal hashes
  are confirmed on the words themselves.
* A map task packs its strings into one compressed block for each bucket.
  Equal strings of a block are one string with a count, so copies of a document
  cost a few bytes each.
* Signatures of more than ``hot_units`` pieces mark a bit of a map of one
  megabyte; windows whose signature has its bit marked travel one by one, as 16
  bytes of SHA-256, dealt by that digest: a frequent signature is spread over all
  buckets.  A bit that is marked by chance moves its windows in the same way in
  every task.
* The number of buckets follows the number of repeated pieces, and no signature
  of the others has more than ``hot_units``, so no bucket outgrows its share at
  any size.
* What a bucket finds goes back packed, one row for each bucket and origin, a
  block's task and flush.  There a text's spans that meet or overlap become one,
  so rows are made for passages of a text, not for each of their windows.
* Texts without a repeated window stay where they are; only the others meet
  their spans, which are gathered by text beforehand.

Defined results: a null text has no words.  Texts of fewer than ``width`` words
lose nothing.  Results depend on a row's text alone, so repeated rows, repeated
or null keys and further columns do no harm.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm import bitmap
from braidwork.shared import Written, bounded_batches, released, ship_bytes

KEY_BYTES = 12
#: Memory of what a task has gathered; what a string and a place cost as Python objects.
FLUSH_BYTES, STRING_BYTES, REF_BYTES = 64 << 20, 200, 220
UNITS_PER_BUCKET = 10_000
#: Bits of the map of repeated signatures: for each of them, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Words that are worked on at once; more only in one text.
WORDS_AT_ONCE = 1 << 16
#: Blocks under so many bytes are not worth compressing.
SMALL_BLOCK = 512

_REF = np.dtype([("string", "<u4"), ("key", f"S{KEY_BYTES}"), ("start", "<u4")])
_SPAN = np.dtype([("key", f"S{KEY_BYTES}"), ("lo", "<i4"), ("hi", "<i4")])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose order looks random (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_FACTOR = 0x9E3779B97F4A7C15


def minimiser_places(hashes: np.ndarray, width: int, m: int) -> np.ndarray:
    """Where the minimiser of every window stands, in order."""
    grams = np.zeros(len(hashes) - m + 1, np.uint64)
    for k in range(m):
        grams = grams * np.uint64(_FACTOR) + hashes[k : len(hashes) - m + 1 + k]
    least, at, span, need = mix(grams), np.arange(len(grams), dtype=np.int32), 1, width - m + 1
    while span < need:
        step = min(span, need - span)
        at = np.where(least[step:] < least[:-step], at[step:], at[:-step])
        least = np.minimum(least[:-step], least[step:])
        span += step
    return at


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def pieces(texts: list[list[bytes]], width: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, signature) of every piece of the texts' words; each text has a window."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = word_hashes([w for t in texts for w in t])
    windows = sizes - width + 1
    text = np.repeat(np.arange(len(texts)), windows)
    begin = np.cumsum(sizes) - sizes
    no = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    window = begin[text] + no
    at = minimiser_places(hashes, width, m)[window]
    half = (width - m) // 2
    left = at - window >= half
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([first, [len(text)]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_FACTOR, len(hashes)), dtype=np.uint64)])
    left, start = left[first], at[first] - np.where(left[first], half, 0)
    value = (sums[start + half + m] - sums[start]) * _powers(pow(_FACTOR, -1, 2**64), len(hashes))[start]
    return text[first], no[first], n, mix(value + left.astype(np.uint64))


def text_key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:KEY_BYTES]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column(0).cast(pa.large_binary()):
        yield x.as_py() or b""


def _long_texts(batch: pa.RecordBatch, width: int) -> Iterator[list[tuple[bytes, list[bytes]]]]:
    """(text, words) of the texts that have a window, a few at a time."""
    some, held = [], 0
    for text in _texts(batch):
        if len(words := text.split()) >= width:
            if some and held + len(words) > WORDS_AT_ONCE:
                yield some
                some, held = [], 0
            some.append((text, words))
            held += len(words)
    if some:
        yield some


def _count(width: int, m: int):
    """(signature, n) of a batch's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces([words for _, words in some], width, m)[3] for some in _long_texts(batch, width)]
            if not found:
                continue
            signature, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(n.astype(np.int64))], names=["signature", "n"])

    return run


def _marked(signature: np.ndarray, bits: np.ndarray) -> np.ndarray:
    bit = signature % np.uint64(8 * len(bits))
    return (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _squeezed(data: bytes) -> bytes:
    return b"0" + data if len(data) < SMALL_BLOCK else b"1" + zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueezed(data: bytes) -> bytes:
    return data[1:] if data[:1] == b"0" else zstandard.ZstdDecompressor().decompress(data[1:])


def _columns(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _rows(data: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(data) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for c in dtype.names:
        out[c] = np.frombuffer(data, dtype[c], n, at)
        at += n * dtype[c].itemsize
    return out


class _Block:
    """What a task has gathered for one bucket: strings, their counts, and where they stand."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.count: list[int] = []
        self.marks: list[int] = []
        self.refs: set[tuple[int, bytes, int]] = set()

    def add(self, string: bytes, key: bytes, start: int, mark: int = 0) -> int:
        """Bytes that are held more; equal strings have equal marks."""
        if (k := self.index.setdefault(string, len(self.index))) == len(self.count):
            self.count.append(0)
            self.marks.append(mark)
        self.count[k] += 1
        size = len(self.refs)
        self.refs.add((k, key, start))
        return (len(string) + STRING_BYTES if self.count[k] == 1 else 0) + REF_BYTES * (len(self.refs) - size)

    def packed(self, whole: bool) -> dict:
        refs = np.array(sorted(self.refs), _REF)
        z = _squeezed
        strings = list(self.index)
        return {
            "strings": z((b"\n" if whole else b"").join(strings)),
            "counts": z(np.array(self.count, "<u4").tobytes()),
            "marks": z(np.array(self.marks if whole else [], "<u4").tobytes()),
            "refs": z(_columns(refs)),
            "whole": whole,
        }


BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("origin", T.LongType()), T.StructField("strings", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("marks", T.BinaryType()), T.StructField("refs", T.BinaryType()), T.StructField("whole", T.BooleanType())])
_BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("origin", pa.int64()), ("strings", pa.binary()), ("counts", pa.binary()), ("marks", pa.binary()), ("refs", pa.binary()), ("whole", pa.bool_())])


def _deal(width: int, minimiser: int, again_map: str, hot_map: str, buckets: int):
    """Blocks of pieces of repeated signatures by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = (np.memmap(SparkFiles.get(x), np.uint8, "r") for x in (again_map, hot_map))  # workers of a machine share the pages
        blocks: dict[tuple[int, bool], _Block] = {}
        held, origin = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            for (bucket, whole), block in blocks.items():
                rows.append({"bucket": bucket, "origin": origin} | block.packed(whole))
                if len(rows) == 64:
                    yield pa.RecordBatch.from_pylist(rows, _BLOCK_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _BLOCK_ARROW)

        for long in (some for batch in batches for some in _long_texts(batch, width)):
            found = pieces([words for _, words in long], width, minimiser)
            moved = _marked(found[3], again)
            text, start, n, signature = (x[moved] for x in found)
            bucket, mark = (mix(signature) % np.uint64(buckets)).tolist(), (signature >> np.uint64(32)).tolist()
            at, key, words = None, b"", []
            for x, s, k, b, m, single in zip(text.tolist(), start.tolist(), n.tolist(), bucket, mark, _marked(signature, hot).tolist(), strict=True):
                if x != at:
                    at, key, words = x, text_key(long[x][0]), long[x][1]
                if single:
                    for w in range(s, s + k):
                        digest = hashlib.sha256(b" ".join(words[w : w + width])).digest()[:16]
                        held += blocks.setdefault((int.from_bytes(digest[:8], "little") % buckets, False), _Block()).add(digest, key, w)
                else:
                    held += blocks.setdefault((b, True), _Block()).add(b" ".join(words[s : s + k + width - 1]), key, s, m)
                if held > FLUSH_BYTES:
                    yield from flush()
                    blocks, held, origin = {}, 0, origin + 1
        yield from flush()

    return run


def _equal_runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order and the run that each sorted place belongs to."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    return order, np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.int64)


def repeated_windows(strings: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, first window's word) of every window that occurs twice or more among strings taken counts times."""
    split = [s.split(b" ") for s in strings]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for s in split for w in s]
    hashes = word_hashes(words)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = sizes - width + 1
    string = np.repeat(np.arange(len(split)), n)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    at = first[string] + offset
    value, span = hashes, 1  # doubling: value[i] stands for span words from i on
    powers = {1: np.uint64(0x9E3779B97F4A7C15)}
    while span < width:
        step = min(span, width - span)
        value = mix(value[:-step] * powers[1] + value[step:])
        span += step
    order, run = _equal_runs(value[at])
    weight = np.bincount(run, counts[string[order]]).astype(np.int64)
    length = np.bincount(run)
    begin = np.cumsum(length) - length
    repeated = np.zeros(len(order), bool)
    repeated[order[(weight[run] > 1) & (length[run] == 1)]] = True
    for r in np.flatnonzero(length > 1):  # equal hashes: the words decide
        members = order[begin[r] : begin[r] + length[r]]
        groups: dict[tuple[bytes, ...], list[int]] = {}
        for k in members.tolist():
            groups.setdefault(tuple(words[at[k] : at[k] + width]), []).append(k)
        for same in groups.values():
            if len(same) > 1 or counts[string[same[0]]] > 1:
                repeated[same] = True
    return string[repeated], offset[repeated]


def _spans(string: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a string as (string, first word, word after the last)."""
    if not len(string):
        return string, offset, offset
    cut = np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)])
    end = np.concatenate([np.flatnonzero(cut)[1:], [len(string)]]) - 1
    return string[cut], offset[cut], offset[end] + width


def repeated_in(strings: list[bytes], counts: np.ndarray, marks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first word, word after the last) of runs of repeated windows.

    Windows of strings with different marks differ, and so do those of one string:
    a string that is alone with its mark repeats as a whole or not at all.
    """
    _, group, size = np.unique(marks, return_inverse=True, return_counts=True)
    alone = size[group] == 1
    whole = np.flatnonzero(alone & (counts > 1))
    rest = np.flatnonzero(~alone)
    string, lo, hi = _spans(*repeated_windows([strings[k] for k in rest.tolist()], counts[rest], width), width) if len(rest) else (rest, rest, rest)
    ends = np.fromiter((strings[k].count(b" ") + 1 for k in whole.tolist()), np.int64, len(whole))
    return np.concatenate([whole, rest[string]]), np.concatenate([np.zeros(len(whole), np.int64), lo]), np.concatenate([ends, hi])


def covered(spans: np.ndarray) -> np.ndarray:
    """Spans by text; those of a text that meet or overlap are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["key"]))]
    shift = np.cumsum(np.concatenate([[0], spans["key"][1:] != spans["key"][:-1]])) * (int(spans["hi"].max()) + 1)  # keeps texts apart
    reach = np.maximum.accumulate(spans["hi"] + shift)
    first = np.flatnonzero(np.concatenate([[True], spans["lo"][1:] + shift[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(spans)]]) - 1
    out = spans[first]
    out["hi"] = (reach - shift)[last]
    return out


FOUND_SCHEMA = pa.schema([("origin", pa.int64()), ("spans", pa.binary())])
SPAN_SCHEMA = pa.schema([("key", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])


def _solve(width: int):
    """Repeated spans of one bucket's blocks, packed for each origin."""

    def run(blocks: pa.Table) -> pa.Table:
        raw = _unsqueezed
        found: dict[int, list[np.ndarray]] = {}
        for whole in (True, False):
            index: dict[bytes, int] = {}
            total: list[int] = []
            marks: list[int] = []
            refs = []
            for b in blocks.to_pylist():
                if b["whole"] != whole:
                    continue
                data = raw(b["strings"])
                strings = data.split(b"\n") if whole else [data[k : k + 16] for k in range(0, len(data), 16)]
                counts = np.frombuffer(raw(b["counts"]), "<u4").tolist()
                mark = np.frombuffer(raw(b["marks"]), "<u4").tolist()
                renamed = np.empty(len(strings), np.int64)
                for k, s in enumerate(strings):
                    if (at := index.setdefault(s, len(index))) == len(total):
                        total.append(0)
                        marks += mark[k : k + 1]
                    total[at] += counts[k]
                    renamed[k] = at
                mine = _rows(raw(b["refs"]), _REF)
                refs.append((b["origin"], renamed[mine["string"]], mine))
            if not index:
                continue
            counts = np.array(total, np.int64)
            if whole:
                string, lo, hi = repeated_in(list(index), counts, np.array(marks, np.uint32), width)
                order = np.argsort(string, kind="stable")
                string, lo, hi = string[order], lo[order], hi[order]
            else:
                string = np.flatnonzero(counts > 1)
                lo, hi = np.zeros(len(string), np.int64), np.full(len(string), width)
            for origin, at, mine in refs:
                begin = np.searchsorted(string, at, "left")
                times = np.searchsorted(string, at, "right") - begin
                if not (n := int(times.sum())):
                    continue
                span = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(n)
                ref = np.repeat(np.arange(len(mine)), times)
                out = np.empty(n, _SPAN)
                out["key"], out["lo"], out["hi"] = mine["key"][ref], mine["start"][ref] + lo[span], mine["start"][ref] + hi[span]
                found.setdefault(origin, []).append(out)
        packed = [_squeezed(_columns(np.concatenate(x))) for x in found.values()]
        return pa.table([pa.array(list(found), pa.int64()), pa.array(packed, pa.binary())], schema=FOUND_SCHEMA)

    return run


def _gather(found: pa.Table) -> pa.Table:
    """(key, lo, hi) of the passages that one origin's buckets have found."""
    spans = covered(np.concatenate([_rows(_unsqueezed(x.as_py()), _SPAN) for x in found.column("spans")]))
    keys = pa.Array.from_buffers(pa.binary(KEY_BYTES), len(spans), [None, pa.py_buffer(np.ascontiguousarray(spans["key"]).tobytes())]).cast(pa.binary())
    return pa.table([keys, pa.array(spans["lo"]), pa.array(spans["hi"])], schema=SPAN_SCHEMA)


def repeated_spans(texts: DataFrame, width: int = 35, minimiser: int = 3, hot_units: int = 5_000, buckets: int | None = None) -> DataFrame:
    """(key, lo, hi): word spans of a text (key: SHA-256 of its UTF-8, cut) that repeated windows cover, the longest of each origin.

    texts: one string column.  hot_units: pieces of a signature from which its windows travel one by one.
    """
    spark = texts.sparkSession
    counted = bounded_batches(texts).mapInArrow(released(_count(width, minimiser)), "signature bigint, n bigint").groupBy("signature").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = Written(counted, "signatures")
    found = repeated.df.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("units")).first()
    bits = bitmap.MAP_BITS
    while bits < min(BITS_EACH * found.kinds, MOST_BITS):
        bits *= 2
    again, _ = bitmap.collected(repeated.df, F.col("signature"), bits=bits)
    hot, _ = bitmap.collected(repeated.df.where(F.col("n") > hot_units), F.col("signature"))
    repeated.drop()
    n = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), found.units // UNITS_PER_BUCKET)
    blocks = texts.mapInArrow(released(_deal(width, minimiser, ship_bytes(spark, again), ship_bytes(spark, hot), n)), BLOCK)
    found = blocks.groupBy("bucket").applyInArrow(_solve(width), "origin bigint, spans binary")
    return found.groupBy("origin").applyInArrow(_gather, "key binary, lo int, hi int")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(1)
        kept, n_words, n_removed = [], [], []
        for k, text in enumerate(_texts(batch)):
            words = text.split()
            found = spans[k].as_py()
            if found:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["lo"] for s in found], 1)
                np.add.at(edge, [s["hi"] for s in found], -1)
                stay = np.cumsum(edge[:-1]) == 0
                left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                left = words
            kept.append(b" ".join(left))
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 35, **how) -> DataFrame:
    """(row, n_words, n_removed, kept): row holds all columns of docs but the text, kept the words that stay."""
    key = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, KEY_BYTES)
    spans = Written(repeated_spans(docs.select(F.col(text).alias("text")), width, **how), "spans").df
    by_text = Written(spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans-by-text").df
    others = [F.col(c) for c in docs.columns if c != text]
    rows = docs.select(F.col(text).alias("text"), key.alias("key"), F.struct(*others, F.lit(0).alias("_")).alias("row"))
    rows = bitmap.marked(rows, F.xxhash64("key"), by_text, F.xxhash64("key"))
    moved = rows.where("hit").join(by_text, "key", "left").select("text", "spans", "row")
    joined = rows.where("not hit").select("text", F.lit(None).cast(by_text.schema["spans"].dataType).alias("spans"), "row").union(moved)
    return joined.mapInArrow(released(_strip), T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
