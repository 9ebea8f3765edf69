"""SentencePiece encoding and decoding by a max-plus parallel scan.

Of all ways to cut a text into pieces of a public vocabulary the best-scoring
one is taken, as a unigram model does.  The vocabulary at hand lists pieces by
rank and has no probabilities, so a piece's score is Zipf's law for its rank, in
whole numbers: sums are exact, and every bracketing gives the same result.  A
character outside the vocabulary becomes its UTF-8 bytes.  Among equal scores
the longest last piece wins, at every cut from the end backwards.  (The
library's own encoder of this vocabulary merges pairs instead; its ids differ,
its decoder reads ours.)

A space starts a piece or is part of a run of spaces, so there is a cut before
every space that follows another character.  Texts of up to ``chunk_chars`` are
cut there and each distinct unit is solved once.

Longer texts are dealt in chunks to all tasks:

1. a chunk gives its transfer matrix: entry [i, j] is the best score from i
   characters after its start, where a piece of an earlier chunk ends, to j
   characters after its end;
2. max-plus products are associative: the matrices of FAN neighbours are
   combined into one, level by level, until a text has FAN or fewer; coming
   down again, each block's entry scores give those of its members;
3. with these a chunk gives a map from the state it is left in to the state in
   which the best path enters it; maps are composed level by level in the same
   way, which settles every chunk's last state;
4. every chunk is traced back by itself, wherever it lies.  The ids between its
   first and last cut, nearly all, wait for nothing: they lie compressed in the
   chunk's record and travel once, to the text's row, where the few ids before and
   behind them are put on and the whole is spelled.

Costs are negated scores, so "max-plus" is min-plus in the code.

Defined results: null and empty texts have no ids and decode to the empty text.
The literal U+2581, by which the vocabulary writes a space, is encoded as bytes,
so decoding is exact for every text.  Results depend on the text alone, so
repeated rows and null keys do no harm.  Columns travel in one struct, so names
do not clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.shared import Written, bounded_batches, released, ship_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_CHARS = 16_384
CACHED_UNITS = 200_000
LONGEST_UNIT = 40
NEVER = 1 << 60
#: Neighbouring chunks that one task combines at a level.
FAN = 8
#: Where no piece holds a line feed, it is a unit by itself.
UNIT, LINE_UNIT = re.compile(r" *[^ ]+| +"), re.compile(r"\n| *[^ \n]+| +")
#: Scores per nat, and the cost of a byte in nats.
SCALE, BYTE_NATS = 1024, 14


class Prefixes:
    """All prefixes of the pieces in one hash table, to solve many units of one length at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, cost: dict[str, int], ids: dict[str, int]):
        prefixes = sorted({p[:k] for p in cost for k in range(1, len(p) + 1)})
        self.longest = max(map(len, prefixes))
        hashes = np.array([self._hash(p) for p in prefixes], np.uint64)
        if len(set(hashes.tolist())) != len(prefixes):
            raise ValueError("two prefixes have one hash")  # never met; the table would not be exact
        self.bits = max(8, int(len(prefixes) * 4).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.cost = np.full(1 << self.bits, NEVER, np.int64)
        self.id = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for p, h in zip(prefixes, hashes.tolist(), strict=True):
            at, n = self._slot(h), 1
            while self.key[at]:
                at, n = (at + 1) % len(self.key), n + 1
            self.probes = max(self.probes, n)
            self.key[at], self.cost[at], self.id[at] = h, cost.get(p, NEVER), ids.get(p, -1)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ ord(c)) * int(self.FACTOR) + 1) % 2**64
        return h

    def _slot(self, h: int) -> int:
        return ((h ^ h >> 29) * int(self.FACTOR) % 2**64) >> (64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 for those that no prefix has."""
        at = (((h ^ (h >> np.uint64(29))) * self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.key[at] == h, at, -1)
        open_ = np.flatnonzero((out < 0) & (self.key[at] != 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.key)
            now = self.key[at[open_]]
            out[open_[now == h[open_]]] = at[open_[now == h[open_]]]
            open_ = open_[(now != h[open_]) & (now != 0)]
        return out

    def solve(self, units: list[str], size: int) -> tuple[list[int], list[bytes | None]]:
        """(costs, ids) of the best paths; None for a unit that needs bytes.

        A substring is known by its 64-bit hash; what is put together from units
        is spelled and compared, so that a chance collision can't pass.
        """
        n = len(units)
        letters = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64).T
        best = np.full((size + 1, n), NEVER, np.int64)
        best[0] = 0
        start_of = np.zeros((size + 1, n), np.int16)
        id_of = np.full((size + 1, n), -1, np.int32)
        for start in range(size):
            rows = np.arange(n)
            h = np.zeros(n, np.uint64)
            single = np.zeros(n, bool)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                h = (h ^ letters[end - 1, rows]) * self.FACTOR + np.uint64(1)
                slot = self.find(h)
                alive = slot >= 0
                rows, h, slot = rows[alive], h[alive], slot[alive]
                if not len(rows):
                    break
                total = best[start, rows] + self.cost[slot]
                better = total < best[end, rows]
                who = rows[better]
                best[end, who] = total[better]
                start_of[end, who] = start
                id_of[end, who] = self.id[slot[better]]
                if end == start + 1:
                    single[rows[self.cost[slot] < NEVER]] = True
            c = letters[start]
            bytes_ = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
            total = np.where(single, NEVER, best[start] + SCALE * BYTE_NATS * bytes_)
            better = total < best[start + 1]
            best[start + 1, better] = total[better]
            start_of[start + 1, better] = start
            id_of[start + 1, better] = -1
        tokens = np.empty((n, size), np.int32)
        count = np.zeros(n, np.int64)
        at = np.full(n, size)
        rows = np.arange(n)
        plain = np.ones(n, bool)
        while len(rows):
            found = id_of[at[rows], rows]
            plain[rows[found < 0]] = False
            count[rows] += 1
            tokens[rows, size - count[rows]] = found
            at[rows] = start_of[at[rows], rows]
            rows = rows[at[rows] > 0]
        flat = tokens.astype("<i4").tobytes()
        return best[size].tolist(), [flat[4 * (k * size + size - c) : 4 * (k + 1) * size] if ok else None for k, (c, ok) in enumerate(zip(count.tolist(), plain.tolist(), strict=True))]


class Vocabulary(dict):
    """Pieces with their costs and ids; as a dict, solved units: unit -> ids as little-endian 32-bit numbers."""

    def __init__(self, pieces: Iterable[str], first_id: int, byte_ids: list[int]):
        super().__init__()
        self.cost = {p: round(SCALE * math.log(rank + 32)) for rank, p in enumerate(pieces)}
        self.ids = {p: first_id + rank for rank, p in enumerate(self.cost)}
        self.byte_ids = byte_ids
        self.longest = max(map(len, self.cost))
        self.unit_cost: dict[str, int] = {}
        self.bytes_of = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        if any(" " in p.lstrip(" ") for p in self.cost):
            raise ValueError("a piece goes on past a space")
        self.unit = UNIT if any("\n" in p for p in self.cost) else LINE_UNIT
        self.table = Prefixes(self.cost, self.ids)

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kinds = [(sp.is_byte(i), sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(sp.get_piece_size())]
        first = next(i for i, k in enumerate(kinds) if not any(k))
        if any(any(k) for k in kinds[first:]):
            raise ValueError("pieces do not come last")
        return Vocabulary((sp.id_to_piece(i).replace("▁", " ") for i in range(first, len(kinds))), first, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def of(self, piece: str) -> int:
        """Cost of one piece or character."""
        found = self.cost.get(piece)
        if found is None:
            found = SCALE * BYTE_NATS * len(piece.encode()) if len(piece) == 1 else NEVER
        return found

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]

    def best(self, text: str, entry: list[int], stop: int, before: int | None = None) -> list[int]:
        """Least cost of reaching each of the positions 0 to stop by pieces that start before `before`; entry: costs to begin with."""
        before = stop if before is None else before
        cost, longest = self.cost, self.longest
        out = [NEVER] * (stop + 1)
        out[: len(entry)] = entry[: stop + 1]
        for end in range(1, stop + 1):
            least = out[end]
            for start in range(max(0, end - longest), min(end, before)):
                if (c := cost.get(text[start:end])) is not None and out[start] + c < least:
                    least = out[start] + c
            if end <= before and text[end - 1] not in cost:
                least = min(least, out[end - 1] + self.of(text[end - 1]))
            out[end] = least
        return out

    def trace(self, text: str, entry: list[int], reached: list[int], at: int, before: int | None = None) -> tuple[int, list[str]]:
        """(where the best path to position `at` enters, its pieces)."""
        pieces: list[str] = []
        while at >= len(entry) or entry[at] != reached[at]:
            for start in range(max(0, at - self.longest), min(at, at if before is None else before)):
                if reached[start] < NEVER and reached[start] + self.of(text[start:at]) == reached[at]:
                    break
            else:
                raise AssertionError("no path")
            pieces.append(text[start:at])
            at = start
        return at, pieces[::-1]

    def __missing__(self, unit: str) -> bytes:
        self.learn([unit])
        return self[unit]

    def learn(self, units: Iterable[str]) -> None:
        """Solve the units that aren't known yet, all short ones at once."""
        wanted = set(units)
        fresh = [u for u in wanted if u not in self]
        if len(self) + len(fresh) > CACHED_UNITS and self:
            fresh = list(wanted)
            self.forget()
        by_size: dict[int, list[str]] = {}
        for u in fresh:
            by_size.setdefault(len(u), []).append(u)
        for size, some in by_size.items():
            if size > LONGEST_UNIT:
                for u in some:
                    self._solve(u)
            else:
                costs, ids = self.table.solve(some, size)
                self.unit_cost.update(zip(some, costs, strict=True))
                self.update(zip(some, ids, strict=True))
                for u, i in zip(some, ids, strict=True):
                    if i is None:
                        self._solve(u)

    def forget(self) -> None:
        """Drop the solved units; an idle worker needs no memory for them."""
        self.clear()
        self.unit_cost.clear()

    def _solve(self, unit: str) -> None:
        reached = self.best(unit, [0], len(unit))
        _, pieces = self.trace(unit, [0], reached, len(unit))
        self.unit_cost[unit] = reached[-1]
        self[unit] = self.packed(pieces)

    def packed(self, pieces: list[str]) -> bytes:
        return np.array([i for p in pieces for i in self.ids_of(p)], "<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [ids for ids, _ in self.encode_and_read(texts)]

    def encode_and_read(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids of each text, and the text that they spell."""
        units = [self.unit.findall(" " + t) if t else [] for t in texts]
        self.learn(chain.from_iterable(units))
        return [(found[0], found[1].decode()[1:]) if t and (found := self.joined(u, " " + t)) else (b"", "") for u, t in zip(units, texts, strict=True)]

    def joined(self, units: list[str], whole: str) -> tuple[bytes, bytes]:
        """Ids of a text's units, which have to spell it, and what they spell."""
        found = b"".join(map(self.__getitem__, units))
        if (read := self.spell(np.frombuffer(found, "<i4").tolist())) != whole.encode():
            reached = self.best(whole, [0], len(whole))
            found = self.packed(self.trace(whole, [0], reached, len(whole))[1])
            read = self.spell(np.frombuffer(found, "<i4").tolist())
        return found, read

    def decode(self, ids: Iterable[int]) -> str:
        return self.spell(ids).decode()[1:]

    def spell(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Chunk:
    """n characters of a text, and enough of what follows to end any piece that starts among them.

    Between its first and its last cut a chunk's path depends on nothing else,
    and behind the last cut only on the state in which it is left; both are
    settled at once.  What is before the first cut waits for the costs with
    which the chunk is entered; a chunk without a cut waits as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, text: str, n: int):
        self.v, self.text, self.n = vocabulary, text, n
        cuts = [m.start() for m in re.finditer(r"(?<=[^ ]) ", text[: n + 1])]
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)
        self.middle = self.v.unit.findall(text[self.first : self.last]) if cuts else []

    def _exits(self, reached: list[int], begin: int) -> list[int]:
        out = reached[self.n - begin : self.n - begin + self.v.longest]
        return out + [NEVER] * (self.v.longest - len(out))

    def _tail(self, begin: int, entry: list[int]) -> list[int]:
        """Costs from `begin` to every position that a piece of this chunk can reach."""
        return self.v.best(self.text[begin:], entry, len(self.text) - begin, self.n - begin)

    def record(self) -> dict:
        """text and n: what waits; costs: the transfer matrix, or left and right costs that add up to it; head: ids of the middle; tails: ids behind the last cut by state."""
        v, states = self.v, self.v.longest
        if self.first is None:
            rows = [self._exits(self._tail(0, [NEVER] * i + [0]), 0) if i <= self.n else [NEVER] * states for i in range(states)]
            return {"text": self.text, "n": self.n, "cut": False, "costs": np.array(rows, "<i8").tobytes(), "head": b"", "tails": []}
        left = [v.best(self.text, [NEVER] * i + [0], self.first)[self.first] if i <= self.first else NEVER for i in range(states)]
        v.learn(self.middle)
        middle = sum(v.unit_cost[u] for u in self.middle)
        rest = self.text[self.last :]
        reached = self._tail(self.last, [0])
        right = self._exits(reached, self.last)
        tails = [v.packed(v.trace(rest, [0], reached, self.n - self.last + j, self.n - self.last)[1]) if c < NEVER else b"" for j, c in enumerate(right)]
        costs = np.array(left + [min(middle + c, NEVER) for c in right], "<i8").tobytes()
        return {"text": self.text[: self.first], "n": self.first, "cut": True, "costs": costs, "head": v.joined(self.middle, self.text[self.first : self.last])[0], "tails": tails}


def matrix(costs: bytes, states: int) -> np.ndarray:
    """The transfer matrix of a record: costs [state in which it is entered, state in which it is left]."""
    found = np.frombuffer(costs, "<i8")
    if len(found) == states * states:
        return found.reshape(states, states)
    return np.minimum(found[:states, None] + found[states:], NEVER)


def entries(v: Vocabulary, r: dict, entry: list[int]) -> bytes:
    """For each state in which a record's chunk is left, the state in which the best path enters it."""
    if r["cut"]:
        reached = v.best(r["text"], entry, r["n"])
        return bytes([v.trace(r["text"], entry, reached, r["n"])[0]]) * v.longest
    reached = v.best(r["text"], entry, len(r["text"]), r["n"])
    ends = range(r["n"], r["n"] + v.longest)
    return bytes(v.trace(r["text"], entry, reached, e, r["n"])[0] if e < len(reached) and reached[e] < NEVER else 255 for e in ends)


def ends_from(v: Vocabulary, r: dict, entry: list[int], state: int) -> tuple[bytes, bytes]:
    """Ids before and behind the head, of the pieces that start in a record's chunk on the best path that leaves it in a state."""
    if r["cut"]:
        _, pieces = v.trace(r["text"], entry, v.best(r["text"], entry, r["n"]), r["n"])
        return v.packed(pieces), r["tails"][state]
    reached = v.best(r["text"], entry, len(r["text"]), r["n"])
    return v.packed(v.trace(r["text"], entry, reached, r["n"] + state, r["n"])[1]), b""


def ids_from(v: Vocabulary, r: dict, entry: list[int], state: int) -> bytes:
    """All ids of the pieces that start in a record's chunk on that path."""
    before, behind = ends_from(v, r, entry, state)
    return before + r["head"] + behind


def squeezed(ids: bytes) -> bytes:
    """Ids as they lie on disk: by byte of their numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()) if ids else b""


def unsqueezed(ids: bytes) -> bytes:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8).reshape(4, -1).T.tobytes() if ids else b""


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of two cost matrices: first a, then b."""
    return np.minimum((a[..., :, None] + b).min(axis=-2), NEVER)


def product(costs: list[bytes], states: int) -> bytes:
    """The matrices of neighbours combined into one, in the same form; one with a cut settles what is before it."""
    found = [np.frombuffer(c, "<i8") for c in costs]
    while len(found) > 1:
        found = [_product(a, b, states) for a, b in zip(found[::2], found[1::2], strict=False)] + found[len(found) // 2 * 2 :]
    return found[0].astype("<i8").tobytes()


def _product(a: np.ndarray, b: np.ndarray, states: int) -> np.ndarray:
    square = [len(x) == states * states for x in (a, b)]
    if all(square):
        return compose(a.reshape(states, states), b.reshape(states, states)).ravel()
    if square[0]:
        return np.concatenate([compose(a.reshape(states, states), b[:states, None])[:, 0], b[states:]])
    left, right = a[:states], a[states:]
    if square[1]:
        return np.concatenate([left, compose(right, b.reshape(states, states))])
    return np.concatenate([np.minimum(left + min(int((right + b[:states]).min()), NEVER), NEVER), b[states:]])


def split(text: str, chunk_chars: int, longest: int) -> list[tuple[str, int]]:
    """(characters with what follows, how many are its own) of every chunk of a text, its leading space put on."""
    whole = " " + text
    return [(whole[k : k + chunk_chars + longest], min(chunk_chars, len(whole) - k)) for k in range(0, len(whole), chunk_chars)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a shipped file, loaded once in a process."""
    if name not in _LOADED:
        _LOADED[name] = Vocabulary.load(SparkFiles.get(name))
    return _LOADED[name]


def ship(spark, model: str) -> str:
    with open(model, "rb") as f:
        return ship_bytes(spark, f.read())


def id_lists(packed: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
    values = np.frombuffer(b"".join(packed), "<i4")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


BLOCK_CHARS = 1 << 20


def _result(row: pa.Array, packed: list[bytes], read: list[str], form: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, id_lists(packed) if form == "ids" else pa.array(packed, pa.binary()), pa.array(read, pa.string())], names=["row", "ids", "text"])


def _encode_short(name: str, form: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for batch in batches:
            at = 0
            texts, size = [], 0
            for k, text in enumerate(batch.column(0)):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > BLOCK_CHARS or k + 1 == batch.num_rows:
                    found = v.encode_and_read(texts)
                    yield _result(batch.column(1).slice(at, len(texts)), [f[0] for f in found], [f[1] for f in found], form)
                    at, texts, size = k + 1, [], 0
        v.forget()

    return run


def _split_rows(name: str, chunk_chars: int):
    """(key, no, text, n, row): row only beside a text's first chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(name).longest
        for batch in batches:
            for k, text in enumerate(batch.column(0)):
                parts = split(text.as_py(), chunk_chars, longest)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    row = batch.column(2).slice(k, 1).take(pa.array([0 if at + i == 0 else None for i in range(len(some))], pa.int64()))
                    key = pa.array([batch.column(1)[k].as_py()] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([key, pa.array(range(at, at + len(some)), pa.int32()), pa.array([p for p, _ in some]), pa.array([n for _, n in some], pa.int32()), row], names=["key", "no", "text", "n", "row"])

    return run


RECORD = pa.schema([("text", pa.string()), ("n", pa.int32()), ("cut", pa.bool_()), ("costs", pa.binary()), ("head", pa.binary()), ("tails", pa.list_(pa.binary()))])
RECORD_SQL = "text string, n int, cut boolean, costs binary, head binary, tails array<binary>"


def _records(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                chunks = [Chunk(v, t, n) for t, n in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
                v.learn(chain.from_iterable(c.middle for c in chunks))
                records = [c.record() for c in chunks]
                made = pa.RecordBatch.from_pylist([r | {"head": squeezed(r["head"])} for r in records], RECORD)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *made.columns, rows.column(4)], names=["key", "no", *RECORD.names, "row"])
        v.forget()

    return run


def _blocks(work, value: str):
    """work(rows) -> rows (key, no, value), over each run of equal (key, block) of sorted batches; a run may cross batches."""
    schema = pa.schema([("key", pa.int64()), ("no", pa.int32()), (value, pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["block"]) != at:
                    if rows:
                        yield pa.RecordBatch.from_pylist(work(rows), schema)
                    at, rows = (r["key"], r["block"]), []
                rows.append(r)
        if rows:
            yield pa.RecordBatch.from_pylist(work(rows), schema)

    return run


def _in_blocks(rows: DataFrame, work, value: str, backwards: bool) -> DataFrame:
    """(key, no, value) by work over every FAN neighbours of a key; rows have key, no and what else work reads."""
    ordered = rows.withColumn("block", F.expr(f"no div {FAN}").cast("int")).repartition("key", "block")
    return ordered.sortWithinPartitions("key", "block", F.desc("no") if backwards else F.col("no")).mapInArrow(released(_blocks(work, value)), f"key bigint, no int, {value} binary")


def _scan(rows: DataFrame, value: str, combine, pass_on, first, backwards: bool = False) -> DataFrame:
    """(key, no, came): what reaches each row, from the first of its key (backwards: the last), by an associative scan.

    combine(values) joins neighbours' values; pass_on(came, value) is what leaves
    a row that `came` reaches; first reaches the first row.
    """
    def up(some: list[dict]) -> list[dict]:
        return [{"key": some[0]["key"], "no": some[0]["block"], value: combine([r[value] for r in some])}]

    def down(some: list[dict]) -> list[dict]:
        came, out = first if some[0]["came"] is None else some[0]["came"], []
        for r in some:
            out.append({"key": r["key"], "no": r["no"], "came": came})
            came = pass_on(came, r[value])
        return out

    some = rows.select("key", "no", value)
    if (some.agg(F.max("no")).first()[0] or 0) < FAN:
        entered = some.withColumn("came", F.lit(None).cast("binary"))
    else:
        above = Written(_in_blocks(some, up, value, backwards), "level").df
        above = _scan(above, value, combine, pass_on, first, backwards).withColumnRenamed("no", "block")
        entered = some.withColumn("block", F.expr(f"no div {FAN}").cast("int")).join(above, ["key", "block"]).drop("block")
    return Written(_in_blocks(entered, down, "came", backwards), "scan").df


def _entered(longest: int):
    """A state vector as it is handed on by a chunk's matrix."""
    return lambda came, costs: compose(np.frombuffer(came, "<i8"), matrix(costs, longest)).astype("<i8").tobytes()


def _maps(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for batch in batches:
            came = [entries(v, r, _costs(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(came, pa.binary())], names=["key", "no", "states"])

    return run


def combined_maps(maps: list[bytes]) -> bytes:
    """Maps from the state in which a chunk is left to that in which it is entered, the last chunk's first; 255: none."""
    found = maps[0]
    for m in maps[1:]:
        found = bytes(m[s] if s != 255 else 255 for s in found)
    return found


def _trace(name: str):
    """The ids before and behind each chunk's head, traced back by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for batch in batches:
            ends = [ends_from(v, r, _costs(r), r["state"][0]) for r in batch.to_pylist()]
            packed = (pa.array([squeezed(e[k]) for e in ends], pa.binary()) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["key", "no", "before", "behind"])

    return run


def _gather(name: str, form: str):
    """A text's row with the ids of its chunks one after the other, and what they spell.

    Of each chunk come two rows: the ids of its ends, then its head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        key, row, ids, behind = None, None, [], b""

        def done() -> pa.RecordBatch:
            read = b"".join(v.spell(np.frombuffer(i, "<i4").tolist()) for i in ids)
            return _result(row, [b"".join(ids)], [read.decode()[1:]], form)

        for batch in batches:
            for k, at in enumerate(batch.column(0).to_pylist()):
                if at != key:
                    if row is not None:
                        yield done()
                    key, row, ids = at, None, []
                if batch.column("head")[k].is_valid:
                    ids += [unsqueezed(batch.column("head")[k].as_py()), behind]
                    row = batch.column("row").slice(k, 1) if row is None else row
                else:
                    before, behind = (unsqueezed(batch.column(c)[k].as_py()) for c in ("before", "behind"))
                    ids.append(before)
        if row is not None:
            yield done()

    return run


def _costs(row: dict) -> list[int]:
    return np.frombuffer(row["entry"], "<i8").tolist()


def encode_long(rows: DataFrame, name: str, longest: int, chunk_chars: int, form: str) -> DataFrame:
    """(row, ids, text) of rows (text, row) with long texts."""
    row = T.StructField("row", rows.schema["row"].dataType)
    chunk = T.StructType([T.StructField("key", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), row])
    record = T.StructType([*chunk.fields[:2], *T.StructType.fromDDL(RECORD_SQL).fields, row])
    keyed = rows.select("text", F.monotonically_increasing_id().alias("key"), "row")
    chunks = keyed.mapInArrow(released(_split_rows(name, chunk_chars)), chunk).repartition("key", "no")
    records = Written(chunks.mapInArrow(released(_records(name)), record), "records").df
    start = np.full(longest, NEVER, np.int64)
    start[0] = 0
    entered = _scan(records, "costs", lambda some: product(some, longest), _entered(longest), start.astype("<i8").tobytes()).withColumnRenamed("came", "entry")
    known = records.select("key", "no", "text", "n", "cut").join(entered.hint("merge"), ["key", "no"])
    maps = Written(known.mapInArrow(released(_maps(name)), "key bigint, no int, states binary"), "maps").df
    left = _scan(maps, "states", combined_maps, lambda state, m: m[state[0] : state[0] + 1], b"\0", backwards=True).withColumnRenamed("came", "state")
    settled = records.select("key", "no", "text", "n", "cut", "tails").join(entered.hint("merge"), ["key", "no"]).join(left.hint("merge"), ["key", "no"])
    traced = Written(settled.mapInArrow(released(_trace(name)), "key bigint, no int, before binary, behind binary"), "traced").df
    ends = traced.select("key", "no", "before", "behind", F.lit(None).cast("binary").alias("head"), F.lit(None).cast(row.dataType).alias("row"))
    heads = records.select("key", "no", F.lit(None).cast("binary").alias("before"), F.lit(None).cast("binary").alias("behind"), "head", "row")
    together = ends.union(heads).repartition("key").sortWithinPartitions("key", "no", F.col("head").isNotNull())
    return together.mapInArrow(released(_gather(name, form)), result_type(row, form))


def result_type(row: T.StructField, form: str) -> T.StructType:
    return T.StructType([row, T.StructField("ids", T.ArrayType(T.IntegerType()) if form == "ids" else T.BinaryType()), T.StructField("text", T.StringType())])


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, chunk_chars: int = CHUNK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """(row, ids): row holds the columns named in keep, all by default."""
    return encode_and_read(docs, text, model, chunk_chars, keep).select("row", "ids")


def encode_and_read(docs: DataFrame, text: str = "text", model: str = MODEL, chunk_chars: int = CHUNK_CHARS, keep: list[str] | None = None, form: str = "ids") -> DataFrame:
    """(row, ids, text): the ids, and the text that they decode to, both made by one worker; form "packed": ids as little-endian 32-bit numbers."""
    name = ship(docs.sparkSession, model)
    rows = bounded_batches(docs.select(F.col(text).alias("text"), F.struct(*(keep or docs.columns)).alias("row")))
    giant = F.coalesce(F.length("text"), F.lit(0)) >= chunk_chars
    short = rows.where(~giant).mapInArrow(released(_encode_short(name, form)), result_type(rows.schema["row"], form))
    return short.union(encode_long(rows.where(giant), name, Vocabulary.load(model).longest, chunk_chars, form))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (row, ids) with text: what the ids spell."""
    name = ship(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for batch in batches:
            texts = [v.decode(np.asarray(ids.values).tolist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["row", "ids", "text"])

    return encoded.select("row", "ids").mapInArrow(run, T.StructType([*encoded.select("row", "ids").schema, T.StructField("text", T.StringType())]))
