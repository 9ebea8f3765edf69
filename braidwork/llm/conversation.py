"""Conversation structure repair: the cheapest edits that give a legal sequence of roles, by a rank-compressed dynamic program.

A legal conversation's role initials match ``(s?(ua)+)?``.  Edits, in the order of
the turns: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an
empty user or assistant turn) 5; a turn that breaks off and isn't deleted costs 5
more, blank and repeated turns must be deleted.  Of the cheapest the one whose
initials (the audit) come first in ASCII order is taken.

* A turn and the inserts before it are one macro edit: D, ID, IID, K, IK, ... No
  such code begins another, so audits of the same turns are in the order of their
  codes, one by one.  More than two inserts in a row are never cheapest.
* What has been put out is one of four states: nothing, s, u or a.  An audit
  determines its state, so a layer (a turn) needs for each state only its cost and
  the rank of its audit among the four: ranks of the next layer come from (rank,
  code), and a pointer to the state before.  No audit is ever stored or compared;
  the edits are read off backwards along the pointers.
* Turns are sorted by range, so a conversation of any length lies in chunks of
  CHUNK rows.  A chunk gives a matrix: from each state it may be entered in to
  each it may be left in, cost and rank.  Such matrices combine associatively, FAN
  at a time; coming down again each chunk gets its two states, and is traced back
  by itself.  Copies of a turn are one row with a count, before anything is sorted,
  and no text takes part in this, only its hash.

Texts travel once, to the partition of their conversation, through which they
stream; no conversation is gathered.  (A digest of a whole conversation is made in
one task by its nature; it holds one batch at a time.)

Defined results: a null role or text is one space; a null conversation is one like
any other; null turns come first.  Turns of one number are in the order of role
and SHA-256 of role and text.  Words like blank are about characters other than
[\\x20\\x09-\\x0D].  An empty text is blank, a text may be of any length.  Columns
other than the four named aren't read.  An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from braidwork.shared import Written, bounded_batches

#: States, by what was put out last.
NOTHING, S, U, A = range(4)
INSERT, DELETE, REROLE, BROKEN = 5, 2, 1, 5
#: The state after an insert, and the inserts that make a state's output legal.
_INSERTED, _CLOSING = (U, U, A, U), {NOTHING: 0, A: 0, U: 1, S: 2}
CODES = sorted("I" * j + e for j in range(3) for e in "DKR")
NAMES = {U: "user", A: "assistant"}
#: Rows of a chunk (a power of two), and matrices combined at once.
CHUNK_BITS, FAN_BITS = 11, 6
SPACE = " \t\n\x0b\f\r"

Layer = list[tuple[int, int] | None]
#: For each state after a macro edit: (state before, cost, code).
Moves = list[list[tuple[int, int, int]]]


def moves(initial: str, broken: bool) -> Moves:
    """The best macro edit between every two states, for a turn of this role initial."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for q in range(4):
        p = q
        for j in range(3):
            keep = {"s": {NOTHING: S}, "u": {NOTHING: U, S: U, A: U}, "a": {U: A}}.get(initial, {}).get(p)
            for to, cost, edit in ((p, DELETE, "D"), (keep, BROKEN * broken, "K"), (_INSERTED[p], REROLE + BROKEN * broken, "R")):
                if to is not None:
                    found = (INSERT * j + cost, CODES.index("I" * j + edit))
                    best[q, to] = min(found, best.get((q, to), found))
            p = _INSERTED[p]
    return [[(q, *best[q, to]) for q in range(4) if (q, to) in best] for to in range(4)]


MOVES = {(i, b): moves(i, b) for i in ("s", "u", "a", "") for b in (False, True)}


def ranked(best: list[tuple | None]) -> Layer:
    """(cost, rank) of states whose best ways are (cost, rank before, code, ...)."""
    order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b)
    out: Layer = [None] * 4
    for r, (_, _, q) in enumerate(order):
        out[q] = (best[q][0], r)
    return out


def step(layer: Layer, by: Moves) -> tuple[Layer, list[tuple | None]]:
    """(the next layer, its best ways: (cost, rank before, code, state before))."""
    best = [min(((s[0] + cost, s[1], code, q) for q, cost, code in ways if (s := layer[q])), default=None) for ways in by]
    return ranked(best), best


def entered(q: int) -> Layer:
    return [(0, 0) if p == q else None for p in range(4)]


def combined(a: list[Layer], b: list[Layer]) -> list[Layer]:
    """The matrix of two stretches, one after the other."""
    return [ranked(through(row, b)) for row in a]


def through(layer: Layer, b: list[Layer]) -> list[tuple | None]:
    """Best ways of a layer through a matrix: (cost, rank before, rank within, state before)."""
    return [min(((s[0] + b[m][q][0], s[1], b[m][q][1], m) for m, s in enumerate(layer) if s and b[m][q]), default=None) for q in range(4)]


class Turn(NamedTuple):
    initial: str
    live: bool  # not blank and not seen before; its copies are
    broken: bool
    n: int


def matrix(turns: list[Turn], entries: tuple[int, ...]) -> list[Layer]:
    """Costs and ranks of a stretch from each of these states."""
    extra = DELETE * sum(t.n - t.live for t in turns)
    out: list[Layer] = [[None] * 4] * 4
    for q in entries:
        layer = entered(q)
        for t in turns:
            if t.live:
                layer, _ = step(layer, MOVES[t.initial, t.broken])
        out[q] = [s and (s[0] + extra, s[1]) for s in layer]
    return out


def traced(turns: list[Turn], q_in: int, q_out: int) -> list[tuple[str, str]]:
    """For each turn (macro edit or "" if it isn't live, initials put out by it)."""
    layer, ways = entered(q_in), []
    for t in turns:
        if t.live:
            layer, best = step(layer, MOVES[t.initial, t.broken])
            ways.append(best)
    out, q = [], q_out
    for t in reversed(turns):
        if not t.live:
            out.append(("", ""))
            continue
        _, _, code, before = ways.pop()[q]
        edit, p, said = CODES[code], before, ""
        for c in edit:
            if c != "D":
                p = S if c == "K" and t.initial == "s" else _INSERTED[p]
                said += "nsua"[p]
        out.append((edit, said))
        q = before
    return out[::-1]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of rows with faults planted by crc32(`conv:turn`) % 20: 0 dropped, 1 emptied, 2 without [.!?], 3 twice, 4 said by the user. Nulls are one space."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    cut = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_hash(rows: DataFrame) -> DataFrame:
    """rows with h: SHA-256 of role and text."""
    return rows.withColumn("h", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def ordered(rows: DataFrame) -> DataFrame:
    """(at, chunk, conv, turn, role, h, n, blank, seen, broken): distinct turns in order, with how often they stand there."""
    bare = F.rtrim("text", F.lit(SPACE))
    marked = with_hash(rows).select("conv", "turn", "role", "h", "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("broken"))
    small = marked.groupBy("conv", "turn", "role", "h").agg(F.sum("copies").alias("n"), F.any_value("blank").alias("blank"), F.any_value("broken").alias("broken"))
    small = Written(small, "turns").df
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = small.groupBy("conv", "h").agg(F.min(place).alias("first")).select(F.col("conv").alias("conv_"), F.col("h").alias("h_"), "first")
    rows = small.join(first, same(F.col("conv"), F.col("conv_")) & (F.col("h") == F.col("h_"))).withColumn("seen", ~same(F.col("turn"), F.col("first.turn")))
    rows = rows.select("conv", "turn", "role", "h", "n", "blank", "seen", "broken")
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return Written(rows.withColumn("chunk", F.shiftright("at", CHUNK_BITS)), "ordered").df


def _runs(convs: list) -> list[tuple[int, int]]:
    """(begin, end) of runs of equal values, nulls equal."""
    cuts = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1]), len(convs)]
    return [(s, e) for s, e in zip(cuts, cuts[1:], strict=False) if s < e]


def _turns(rows: pa.Table) -> list[Turn]:
    got = zip(*(rows.column(c).to_pylist() for c in ("role", "blank", "seen", "broken", "n")), strict=True)
    return [Turn(r[:1] if r[:1] in ("s", "u", "a") else "", not (b or s), cut, n) for r, b, s, cut, n in got]


class Stretch(NamedTuple):
    """A part of a conversation: its matrix and what its summary needs."""

    cells: list[Layer]
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    turns: int  # distinct, without null
    low: int | None
    high: int | None

    def packed(self) -> tuple:
        flat = [x for row in self.cells for s in row for x in (s or (-1, -1))]
        return flat, *self[1:]

    @staticmethod
    def read(flat: list[int], *rest) -> Stretch:
        pairs = [None if c < 0 else (c, r) for c, r in zip(flat[::2], flat[1::2], strict=True)]
        return Stretch([pairs[k : k + 4] for k in range(0, 16, 4)], *rest)

    def then(self, other: Stretch) -> Stretch:
        lows, highs = ([x for x in v if x is not None] for v in ((self.low, other.low), (self.high, other.high)))
        joint = self.high is not None and self.high == other.low
        counts = (self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, self.illegal + other.illegal + illegal(self.last, other.first))
        return Stretch(combined(self.cells, other.cells), *counts, self.first, other.last, self.turns + other.turns - joint, min(lows, default=None), max(highs, default=None))


def illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


_LONGS = ("blank", "duplicate", "truncated", "illegal"), ("turns", "low", "high")
_STRETCH = T.StructType([T.StructField("cells", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in _LONGS[0]), *(T.StructField(c, T.StringType()) for c in ("first", "last")), *(T.StructField(c, T.LongType()) for c in _LONGS[1])])


def stretches(rows: DataFrame) -> DataFrame:
    """(conv, at, ...): the part of each conversation in each chunk."""

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("at")
        turns, convs, number, role = _turns(chunk), *(chunk.column(c).to_pylist() for c in ("conv", "turn", "role"))
        blank = chunk.column("blank").to_pylist()
        out, runs = [], _runs(convs)
        for s, e in runs:
            mine = turns[s:e]
            cells = matrix(mine, (NOTHING, S, U, A) if s == 0 else (NOTHING,))  # only the chunk's first one may go on from another chunk
            n_blank = sum(t.n for t, b in zip(mine, blank[s:e], strict=True) if b)
            again = sum(t.n - t.live for t in mine) - n_blank
            initials = [r[:1] for r in role[s:e]]
            wrong = sum(illegal(a, b) for a, b in zip(initials, initials[1:], strict=False)) + sum(t.n - 1 for t in mine)
            known = [x for x in number[s:e] if x is not None]
            out.append(Stretch(cells, n_blank, again, sum(t.live and t.broken for t in mine), wrong, initials[0], initials[-1], len(set(known)), min(known, default=None), max(known, default=None)).packed())
        begins = pa.array([s for s, _ in runs], pa.int64())
        return _table([chunk.column("conv").take(begins), chunk.column("at").take(begins)], out, ("conv", "at"), _STRETCH)

    schema = T.StructType([rows.schema["conv"], T.StructField("at", T.LongType()), *_STRETCH.fields])
    return rows.select("chunk", "at", "conv", "turn", "role", "n", "blank", "seen", "broken").groupBy("chunk").applyInArrow(run, schema)


def _table(head: list, rows: list[tuple], names: tuple[str, ...], fields: T.StructType) -> pa.Table:
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(fields)]
    return pa.table([*head, *columns], names=[*names, *(f.name for f in fields)])


def _bucketed(rows: DataFrame, *by: Column) -> DataFrame:
    """rows dealt to groups of some thousand, what agrees in `by` together."""
    n = max(1, rows.count() >> CHUNK_BITS)
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(n)))


def _read(rows: pa.Table) -> list[Stretch]:
    return [Stretch.read(*r) for r in zip(*(rows.column(f.name).to_pylist() for f in _STRETCH), strict=True)]


def joined(parts: DataFrame, bits: int) -> DataFrame:
    """Stretches of a conversation whose places agree but for the last `bits` bits, as one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = _by_conv(rows)
        convs, at, mine = rows.column("conv").to_pylist(), rows.column("at").to_pylist(), _read(rows)
        runs = _runs([(c, a >> bits) for c, a in zip(convs, at, strict=True)])
        out = []
        for s, e in runs:
            whole = mine[s]
            for part in mine[s + 1 : e]:
                whole = whole.then(part)
            out.append(whole.packed())
        begins = pa.array([s for s, _ in runs], pa.int64())
        return _table([rows.column("conv").take(begins), rows.column("at").take(begins)], out, ("conv", "at"), _STRETCH)

    return _bucketed(parts, F.col("conv"), F.shiftright("at", bits)).groupBy("bucket").applyInArrow(run, parts.schema)


def _by_conv(rows: pa.Table) -> pa.Table:
    """Rows by conversation, in order of place within."""
    convs, at = rows.column("conv").to_pylist(), rows.column("at").to_pylist()
    number: dict = {}
    for c in convs:
        number.setdefault(c, len(number))
    return rows.take(pa.array(sorted(range(len(convs)), key=lambda k: (number[convs[k]], at[k])), pa.int64()))


def passed(mine: list[Stretch], q_in: int, q_out: int) -> list[tuple[int, int]]:
    """(state in, state out) of each of some stretches on the best way between two states."""
    layer, ways = entered(q_in), []
    for part in mine:
        ways.append(best := through(layer, part.cells))
        layer = ranked(best)
    out, q = [], q_out
    for best in reversed(ways):
        out.append((best[q][3], q))
        q = best[q][3]
    return out[::-1]


def settled(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, at, q_in, q_out, tail) of every stretch, (conv, gaps, ..., cost)); tail: inserts after the last."""
    levels, bits = [parts], CHUNK_BITS
    while levels[-1].groupBy("conv").count().where(F.col("count") > 1 << FAN_BITS).head(1):
        bits += FAN_BITS
        levels.append(Written(joined(levels[-1], bits), "stretches").df)

    def finish(rows: pa.Table) -> pa.Table:
        rows = _by_conv(rows)
        mine, runs, out = _read(rows), _runs(rows.column("conv").to_pylist()), []
        for s, e in runs:
            whole = mine[s]
            for part in mine[s + 1 : e]:
                whole = whole.then(part)
            cost, _, tail, q = min((c[0] + INSERT * _CLOSING[q], c[1], _CLOSING[q], q) for q, c in enumerate(whole.cells[NOTHING]) if c)
            gaps = whole.high - whole.low + 1 - whole.turns if whole.low is not None else 0
            for k, (q_in, q_out) in enumerate(passed(mine[s:e], NOTHING, q)):
                out.append((q_in, q_out, tail if s + k == e - 1 else 0, k == 0, gaps, whole.blank, whole.duplicate, whole.truncated, whole.illegal, cost))
        return _table([rows.column("conv"), rows.column("at")], out, ("conv", "at"), fields)

    fields = T.StructType.fromDDL("q_in int, q_out int, tail int, head boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")
    schema = T.StructType([parts.schema["conv"], parts.schema["at"], *fields.fields])
    top = Written(_bucketed(levels[-1], F.col("conv")).groupBy("bucket").applyInArrow(finish, schema), "settled").df
    summary = top.where("head").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ways = top.select("conv", "at", "q_in", "q_out", "tail")
    for level in reversed(levels[:-1]):
        ways = Written(_spread(level, ways, bits), "ways").df
        bits -= FAN_BITS
    return ways, summary


def _spread(parts: DataFrame, ways: DataFrame, bits: int) -> DataFrame:
    """Ways of joined stretches, for those that they were joined from."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = _by_conv(rows)
        convs, at, mine = rows.column("conv").to_pylist(), rows.column("at").to_pylist(), _read(rows)
        of = {(c, a): w for c, a, *w in zip(*(known.column(n).to_pylist() for n in ("conv", "at", "q_in", "q_out", "tail")), strict=True)}
        out = []
        for s, e in _runs([(c, a >> bits) for c, a in zip(convs, at, strict=True)]):
            q_in, q_out, tail = of[convs[s], at[s]]  # a joined stretch stands where its first part does
            out += [(*w, tail if s + k == e - 1 else 0) for k, w in enumerate(passed(mine[s:e], q_in, q_out))]
        return _table([rows.column("conv"), rows.column("at")], out, ("conv", "at"), fields)

    fields = T.StructType.fromDDL("q_in int, q_out int, tail int")
    by = [F.col("conv"), F.shiftright("at", bits)]
    n = max(1, parts.count() >> CHUNK_BITS)
    left, right = (x.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(n))).groupBy("bucket") for x in (parts, ways))
    return left.cogroup(right).applyInArrow(run, ways.schema)


def edits(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv, turn, role, h, n, edit, said, tail): the macro edit of every distinct turn, what it puts out, and what follows the last one."""

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("at")
        turns, convs, at = _turns(chunk), chunk.column("conv").to_pylist(), chunk.column("at").to_pylist()
        of = {a: w for a, *w in zip(*(known.column(n).to_pylist() for n in ("at", "q_in", "q_out", "tail")), strict=True)}
        out: list[tuple] = []
        for s, e in _runs(convs):
            q_in, q_out, tail = of[at[s]]
            mine = [(*t, "") for t in traced(turns[s:e], q_in, q_out)]
            for _ in range(tail):
                q_out = _INSERTED[q_out]
                mine[-1] = (*mine[-1][:2], mine[-1][2] + "nsua"[q_out])
            out += mine
        return _table([chunk.column(c) for c in ("conv", "turn", "role", "h", "n")], out, ("conv", "turn", "role", "h", "n"), fields)

    fields = T.StructType.fromDDL("edit string, said string, tail string")
    schema = T.StructType([*(rows.schema[c] for c in ("conv", "turn", "role", "h", "n")), *fields.fields])
    ways = ways.withColumn("chunk", F.shiftright("at", CHUNK_BITS))
    return rows.groupBy("chunk").cogroup(ways.groupBy("chunk")).applyInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, edit, times, role, text): the edits of all conversations, one row each but for deletions in a row.

    Rows of a conversation lie together in one partition, in order; without
    the deletions they are the repaired conversation.
    """
    none = F.lit(None).cast("string")
    edit = found.select("conv", "turn", "role", "h", F.lit(0).alias("kind"), "n", "edit", "said", "tail", none.alias("text"))
    text = with_hash(rows).select("conv", "turn", "role", "h", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), none.alias("edit"), none.alias("said"), none.alias("tail"), "text")
    names = {"u": "user", "a": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # an edit whose text comes next
        for batch in batches:
            at, out = [], []
            columns = zip(*(batch.column(c).to_pylist() for c in range(1, batch.num_columns)), strict=True)
            for k, (role, kind, n, edit, said, tail, text) in enumerate(columns):
                if kind == 0:
                    open_ = (n, edit, said, tail)
                    continue
                if open_ is None:
                    continue  # a copy
                n, edit, said, tail = open_
                open_ = None
                own = [("I", 1, names[c], "") for c in said[: edit.count("I")]]
                if edit.endswith("K"):
                    own.append(("K", 1, role, text))
                elif edit.endswith("R"):
                    own.append(("R", 1, names[said[-1]], text))
                gone = n - (1 if edit and not edit.endswith("D") else 0)
                own += [("D", gone, None, None)] * (gone > 0)
                own += [("I", 1, names[c], "") for c in tail]
                at += [k] * len(own)
                out += own
            yield from _table([batch.column(0).take(pa.array(at, pa.int64()))], out, ("conv",), fields).combine_chunks().to_batches()

    fields = T.StructType.fromDDL("edit string, times bigint, role string, text string")
    schema = T.StructType([found.schema["conv"], *fields.fields])
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h", "kind")]
    stream = edit.union(text).repartition("conv").sortWithinPartitions(*by).select("conv", "role", "kind", "n", "edit", "said", "tail", "text")
    return bounded_batches(stream).mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of the rows of repaired(), as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (the conversation, its edits, its digest so far, whether it has a line)

        def row(conv, audit, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array(audit, pa.string()), pa.array(sha, pa.string())], names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, edit, times, role, text in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if last is None or last[0] != conv:
                    done += [last] if last else []
                    last = [conv, [], hashlib.sha256(), False]
                last[1].append(edit * times)
                if edit != "D":
                    last[2].update((("\n" if last[3] else "") + f"{role}:{text}").encode())
                    last[3] = True
            yield row(pa.array([d[0] for d in done], kind), ["".join(d[1]) for d in done], [d[2].hexdigest() for d in done])
        if last:
            yield row(pa.array([last[0]], kind), ["".join(last[1])], [last[2].hexdigest()])

    return turns.mapInArrow(run, T.StructType([turns.schema["conv"], *T.StructType.fromDDL("audit string, repaired_sha256 string").fields]))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired() of rows (conv, turn, role, text, copies), (conv, gaps, blank, duplicate, truncated, illegal, cost))."""
    lined = ordered(rows)
    ways, summary = settled(Written(stretches(lined), "stretches").df)
    return repaired(rows, Written(edits(lined, ways), "edits").df), summary
