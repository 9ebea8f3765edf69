import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from braidwork.llm import conversation, queries

WS = " \t\n\x0b\f\r"
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "ß"]
TEXTS = ["Yes.", "No!", "cut off", "", " \t", None, "Really?", "3.5 and", "ä. \n", " ", "a" * 5_000 + "."]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by trying every edit; turns: (role, text, must go, breaks off)."""

    @cache
    def best(i, said, inserts):
        ways = [(0, "", ())] if i == len(turns) and re.fullmatch("(s?(ua)+)?", said) else []
        add = lambda cost, edit, line, rest: ways.append((cost + rest[0], edit + rest[1], line + rest[2])) if rest else None
        ok = lambda s: re.fullmatch("s?(ua)*u?", s)
        short = lambda s: s if s in ("", "s") else "u" if s[-1] == "u" else "ua"
        if inserts < 3:
            for r in ("user", "assistant"):
                if ok(said + r[0]):
                    add(5, "I", ((r, ""),), best(i, short(said + r[0]), inserts + 1))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            add(2, "D", (), best(i + 1, said, 0))
            if not gone:
                if role[:1] and ok(said + role[:1]):
                    add(5 * cut, "K", ((role, text),), best(i + 1, short(said + role[:1]), 0))
                for r in ("user", "assistant"):
                    if ok(said + r[0]):
                        add(1 + 5 * cut, "R", ((r, text),), best(i + 1, short(said + r[0]), 0))
        return min(ways, key=lambda w: w[:2]) if ways else None

    return best(0, "", 0)


def plain(rows):
    by, out = {}, {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        mine = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, faults, turns = set(), [], []
        for _, _, role, text in mine:
            bare = text.strip(WS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            turns.append((role, text, faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        known = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(tuple(turns))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def random_rows(rng, convs, most):
    rows = []
    for c in range(convs):
        conv = None if c == 0 else c
        for t in range(rng.randrange(1, most)):
            rows.append((conv, None if rng.random() < 0.1 else t * rng.choice((1, 1, 2)), rng.choice(ROLES), rng.choice(TEXTS)))
            if rng.random() < 0.2:
                rows.append(rows[-1] if rng.random() < 0.5 else (conv, rows[-1][1] and rows[-1][1] + 1, *rows[-1][2:]))
    rng.shuffle(rows)
    return rows


def run(spark, rows, tmp):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "at", "n", "kind", "h")})
    df.repartition(3).write.parquet(f"{tmp}/conversations.parquet")
    got = queries.op11_repair(spark, str(tmp)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_every_edit_tried(spark, tmp_path):
    rows = random_rows(random.Random(1), 400, 9)
    assert run(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("chunk,fan", [(1, 1), (2, 2)])
def test_conversations_over_many_chunks(spark, tmp_path, monkeypatch, chunk, fan):
    monkeypatch.setattr(conversation, "CHUNK_BITS", chunk)
    monkeypatch.setattr(conversation, "FAN_BITS", fan)
    rng = random.Random(chunk)
    rows = random_rows(rng, 30, 12) + [(99, t, rng.choice(ROLES), rng.choice(TEXTS)) for t in range(60)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_combining_is_associative():
    rng = random.Random(3)
    turns = [conversation.Turn(rng.choice(["s", "u", "a", ""]), rng.random() < 0.8, rng.random() < 0.3, rng.randrange(1, 4)) for _ in range(40)]
    every = (0, 1, 2, 3)
    whole = conversation.matrix(turns, every)
    for a, b in ((1, 2), (7, 30), (13, 14)):
        x, y, z = (conversation.matrix(t, every) for t in (turns[:a], turns[a:b], turns[b:]))
        assert conversation.combined(conversation.combined(x, y), z) == conversation.combined(x, conversation.combined(y, z)) == whole


def test_given_table_and_empty(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, rows, tmp_path) == plain(rows)
    (tmp_path / "none").mkdir()
    assert run(spark, [], tmp_path / "none") == {}
