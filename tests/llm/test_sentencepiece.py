import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import sentencepiece as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no vocabulary here")


def small():
    return S.Vocabulary(["  ", "    ", "a", "b", " ", "aa", "ab", "ba", "aba", " a", " ab", "bb", "   a", "aaaa"], 300, list(range(3, 259)))


def plain(v, text):
    """Best path over the whole text, position by position, without units or chunks."""
    if not text:
        return []
    s = " " + text
    reached = v.best(s, [0], len(s))
    _, pieces = v.trace(s, [0], reached, len(s))
    return [i for p in pieces for i in v.ids_of(p)]


def texts(n=200):
    rng = random.Random(1)
    return ["".join(rng.choice("aab  bé\n▁𝄞") for _ in range(rng.randrange(1, 60))) for _ in range(n)] + ["a" * 40, " ", "   ", "ab" * 30, "é" * 20, "x"]


def chunked(v, text, size):
    """The scan of a text's chunks without Spark."""
    records = [S.Chunk(v, p, n).record() for p, n in S.split(text, size, v.longest)]
    costs = np.full(v.longest, S.NEVER, np.int64)
    costs[0] = 0
    entered = []
    for r in records:
        entered.append(costs.tolist())
        costs = S.compose(costs, S.matrix(r["costs"], v.longest))
    state, found = 0, b""
    for r, entry in zip(reversed(records), reversed(entered), strict=True):
        found = S.ids_from(v, r, entry, state) + found
        state = S.entries(v, r, entry)[state]
    assert state == 0
    return np.frombuffer(found, "<i4").tolist()


def test_units_and_chunks_give_the_best_path_of_the_whole():
    v = small()
    for t in texts():
        want = plain(v, t)
        assert np.frombuffer(v.encode(t), "<i4").tolist() == want
        for size in (5, 7, 13, 64):
            assert chunked(v, t, size) == want, (t, size)
        assert v.decode(want) == t


def test_best_path_is_the_best_of_all():
    v = small()

    def every(s):
        if not s:
            yield 0
        for k in range(1, min(len(s), v.longest) + 1):
            if v.of(s[:k]) < S.NEVER:
                for rest in every(s[k:]):
                    yield v.of(s[:k]) + rest

    for t in texts(40):
        s = " " + t[:9]
        assert v.best(s, [0], len(s))[-1] == min(every(s))


def test_many_units_at_once():
    v, rng = S.Vocabulary.load(S.MODEL), random.Random(6)
    units = {" " * rng.randrange(4) + "".join(rng.choice("etaoinshrdéñ日\n-_=.,!?") for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {"=" * k for k in range(1, 60)}
    v.learn(units)
    for u in units:
        reached = v.best(u, [0], len(u))
        _, pieces = v.trace(u, [0], reached, len(u))
        assert v[u] == v.packed(pieces) and v.unit_cost[u] == reached[-1]


def test_products_are_associative():
    v = small()
    a, b, c = (S.matrix(S.Chunk(v, p, n).record()["costs"], v.longest) for p, n in S.split("aabbab aab abab", 6, v.longest)[:3])
    assert (S.compose(S.compose(a, b), c) == S.compose(a, S.compose(b, c))).all()


def test_products_of_many_are_those_one_by_one():
    v = small()
    for text in texts(40) + ["a" * 50]:
        costs = [S.Chunk(v, p, n).record()["costs"] for p, n in S.split(text, 6, v.longest)]
        want = S.matrix(costs[0], v.longest)
        for c in costs[1:]:
            want = S.compose(want, S.matrix(c, v.longest))
        assert (S.matrix(S.product(costs, v.longest), v.longest) == want).all()


def test_public_vocabulary_reads_our_ids():
    from sentencepiece import SentencePieceProcessor

    v, sp = S.Vocabulary.load(S.MODEL), SentencePieceProcessor(model_file=S.MODEL)
    for t in ["Hello world", "  two  spaces ", "naïve Ünïcode 日本語 𝄞", "line\nbreak\ttab", "internationalisation"]:
        ids = np.frombuffer(v.encode(t), "<i4").tolist()
        assert sp.decode(ids) == t == v.decode(ids)
        assert len(ids) < 1.5 * len(sp.encode(t)) + 2


@pytest.mark.parametrize("chunk", [16_384, 32])
def test_round_trip(spark, chunk):
    rows = [(k, t) for k, t in enumerate(texts(60))] + [(900, None), (901, ""), (902, "word ä " * 9000), (None, "n" * 500), (5, "same " * 20), (5, "same " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    got = S.decode(S.encode(docs, chunk_chars=chunk)).select("row.doc_id", F.col("row.text").alias("was"), "text", "ids").collect()
    assert len(got) == len(rows) and all(r.text == (r.was or "") for r in got)
    v = S.Vocabulary.load(S.MODEL)
    assert all(r.ids == plain(v, r.was) for r in got if len(r.was or "") < 600)
    at_once = S.encode_and_read(docs, chunk_chars=chunk, form="packed").select("row.doc_id", "row.text", "ids", F.col("text").alias("read")).collect()
    assert sorted((repr(r.doc_id), r.text or "", np.frombuffer(r.ids, "<i4").tolist()) for r in at_once) == sorted((repr(r.doc_id), r.was or "", r.ids) for r in got)
    assert all(r.read == (r.text or "") for r in at_once)


def test_empty_table(spark):
    assert S.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_round_trips(spark):
    from braidwork.llm import queries

    got = queries.op4_sentencepiece(spark, "/root/testdata/sf0.001")
    assert got.count() == got.where("round_trip").count() == 200


def test_heads_of_chunks_travel_once_and_compressed(spark, monkeypatch):
    """Between the shuffles only what waits for a scan is held; ids lie there in less than half of their bytes, decoded text nowhere."""
    from pathlib import Path

    made = []

    class Kept(S.Written):
        def __init__(self, df, name):
            super().__init__(df, name)
            made.append((name, self.df.columns, sum(p.stat().st_size for p in Path(self.path.removeprefix("file://")).rglob("*.parquet"))))

    monkeypatch.setattr(S, "Written", Kept)
    rng = random.Random(12)
    words = ["the", "of", "language", "model", "house", "Strasse", "river", "and", "lemma", "verdict"]
    texts = [" ".join(rng.choice(words) for _ in range(40_000)) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r for r in S.encode_and_read(docs, chunk_chars=4096, keep=["doc_id"]).collect()}
    assert [got[k].text for k in range(3)] == texts
    size = {n: b for n, _, b in made if n in ("records", "traced")}
    assert not any("read" in c or "ids" in c for _, c, _ in made)
    assert size["records"] < 2 * sum(len(r.ids) for r in got.values()) and size["traced"] < size["records"]


def test_ids_are_the_same_after_squeezing():
    for ids in (b"", np.arange(70_000, dtype="<i4").tobytes(), np.array([2**31 - 1], "<i4").tobytes()):
        assert S.unsqueezed(S.squeezed(ids)) == ids
