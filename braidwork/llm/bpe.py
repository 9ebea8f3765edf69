"""BPE encoding by a priority queue of merge ranks, and decoding by concatenation.

A word starts as a doubly linked list of its byte symbols.  All neighbouring
pairs that the vocabulary can merge wait in a priority queue by (rank, place).
The least is taken: if its two symbols still stand there as they were when the
pair was queued they become one, which is unlinked from its right neighbour and
queued with its new neighbours; otherwise the entry is stale and is skipped.  So
a word of n symbols costs n log n steps, whatever its length.

The vocabulary comes from a tokenizer file, whose path is a parameter.  The file
also names a normaliser and a splitter; their Unicode tables belong to the
library that reads the file, which is asked for them once for each distinct word
(a stretch without white space, which neither of them looks across).  Merging and
decoding are done here.

Every row is encoded by itself, in Arrow batches bounded by rows and bytes; a
worker remembers ids of at most CACHED words, and parts of words, of at most
CACHED_CHARS characters.

Defined results: a null or empty text, or one of white space alone, has no ids
and decodes to the empty text.  The strings of added tokens stand for their ids
wherever they occur in a text.  Repeated rows are encoded each by itself.  Other
columns pass through, whatever their names, within ``row``.  An empty table gives
an empty result.  A file that is no byte-level BPE raises an error.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.shared import bounded_batches, ship_bytes

#: Words that a worker remembers, and how long they may be.
CACHED, CACHED_CHARS = 200_000, 48
#: Characters that str.split takes for white space and the splitter doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_NOTHING: dict[int, int] = {}
#: Stands for no rank: an entry of it is below 0 at every place.
NEVER = -1
#: Below it composition changes nothing, and both libraries' cases and classes of characters agree (see the tests).
_AGREED = "\u0250"
_SPACE = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


_SYMBOLS = dict(enumerate(byte_symbols()))


def _rule(spec: dict) -> regex.Pattern | None:
    """What finds the parts of a lower-cased word below _AGREED, if the file's rules are of that form."""
    rules = (spec["normalizer"] or {}).get("normalizers", []), (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    kinds = [[r["type"] for r in x] for x in rules]
    if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
        return None
    split, level = rules[1]
    plain = rules[0][1]["content"] == " " and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
    return regex.compile(split["pattern"]["Regex"]) if plain else None


def _remembered(known: dict[str, bytes], word: str, make: Callable[[str], bytes]) -> bytes:
    found = known.get(word)
    if found is None:
        found = make(word)
        if len(word) <= CACHED_CHARS:
            if len(known) >= CACHED:
                known.clear()
            known[word] = found
    return found


class Vocabulary:
    """Merges, ids and strings of a tokenizer file."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model, decoder = spec["model"], spec["decoder"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or (decoder or {}).get("type") not in (None, "ByteLevel"):
            raise ValueError("not a byte-level BPE vocabulary")
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By left id: the ranks of what may follow; and the id of the two as one, by rank.
        self.follow: list[dict[int, int]] = [_NOTHING] * (max(self.ids.values(), default=0) + 1)
        for rank, (a, b) in enumerate(pairs):
            if not self.follow[self.ids[a]]:
                self.follow[self.ids[a]] = {}
            self.follow[self.ids[a]][self.ids[b]] = rank
        self.made = [self.ids[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.added.items()]}
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())} if decoder else None
        ruled = Tokenizer.from_str(data.decode())
        self.normalise = ruled.normalizer.normalize_str if ruled.normalizer else str
        self.rule = _rule(spec)
        self.split = ruled.pre_tokenizer.pre_tokenize_str
        longest = sorted(self.added, key=lambda s: (-len(s), s))
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        #: Whether words can be taken between white space, which no token holds.
        self.by_word = bool(self.end)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge symbols until no pair is in the vocabulary."""
        n, follow, made = len(symbols), self.follow, self.made
        # an entry is rank * n + place, so entries of one rank come out from left to right; queued has each place's own
        queued = [follow[a].get(b, NEVER) * n + k for k, a, b in zip(range(n), symbols, symbols[1:], strict=False)]
        queue = [e for e in queued if e >= 0]
        if not queue:
            return symbols
        heapify(queue)
        queued.append(-1)
        at, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            k = entry % n
            if queued[k] != entry:
                continue  # stale: one of the two is part of something else by now
            j = after[k]
            at[k] = both = made[entry // n]
            at[j] = queued[j] = queued[k] = -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                r = follow[both].get(at[j])
                if r is not None:
                    queued[k] = r = r * n + k
                    heappush(queue, r)
            j = before[k]
            if j >= 0:
                r = follow[at[j]].get(both)
                if r is None:
                    queued[j] = -1
                else:
                    queued[j] = r = r * n + j
                    heappush(queue, r)
        return [s for s in at if s >= 0]

    def _part(self, part: str) -> bytes:
        ids = self.ids
        return array("I", self.merge([ids[c] for c in part[:-1]] + [ids[part[-1] + self.end]])).tobytes()

    def _fresh(self, word: str) -> bytes:
        if self.rule and (word.isascii() or max(word) < _AGREED):
            found = self.rule.findall(word.lower())
            parts = found if word.isascii() and word.isprintable() and " " not in word else [p.encode().decode("latin-1").translate(_SYMBOLS) for p in found]
        else:
            parts = [p for p, _ in self.split(self.normalise(word)) if p]
        known, part = self.parts, self._part
        return b"".join([known.get(p) or _remembered(known, p, part) for p in parts])

    def _plain(self, text: str) -> bytes:
        if not self.by_word:
            return self._fresh(text)
        known, fresh = self.words, self._fresh
        words = _SPACE.split(text) if any(c in text for c in _SEPARATORS) else text.split()
        return b"".join([known.get(w) or _remembered(known, w, fresh) for w in words])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers, little-endian on every machine that Spark runs on."""
        if not text:
            return b""
        if not any(s in text for s in self.added):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(array("I", [self.added[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        strings = [self.strings[i] for i in memoryview(ids).cast("I")]
        if self.bytes_of is None:
            return " ".join(strings)  # the file has no decoder: its words are joined
        known = self.bytes_of
        return b"".join(bytes(known[c] for c in s) if all(c in known for c in s) else s.encode() for s in strings).decode(errors="replace")


def default_model() -> str:
    """The public vocabulary of words in lower case."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None, form: str = "array") -> DataFrame:
    """(row, ids, text): columns `keep` (default all) as row, ids of the text and what they decode to.

    ids are array<bigint>, or if form is "packed" 32-bit little-endian integers
    in one binary.  model: path of a tokenizer file that the driver can read.
    """
    with open(model or default_model(), "rb") as f:
        shipped = ship_bytes(docs.sparkSession, f.read())
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    packed = form == "packed"
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.LongType())), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(shipped), "rb") as f:
            vocabulary = Vocabulary(f.read())
        for batch in batches:
            ids = [vocabulary.encode(t) for t in batch.column(1).to_pylist()]
            decoded = pa.array(map(vocabulary.decode, ids), pa.string())
            out = pa.array(ids, pa.binary()) if packed else pa.array([memoryview(i).cast("I").tolist() for i in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out, decoded], names=["row", "ids", "text"])

    return bounded_batches(rows).mapInArrow(run, schema)
