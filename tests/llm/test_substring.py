import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import queries, substring


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}é"
    passage = [word() for _ in range(60)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(120))]
        if d % 3 == 0:
            cut = rng.randrange(len(text) + 1)
            text[cut:cut] = passage[rng.randrange(10) : 50]
        if d % 7 == 0:
            text += ["same"] * 90
        rows.append((d, " \t\n"[d % 3].join(text)))
    return rows + [(100, None), (101, ""), (102, "one"), (None, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (103, "x " * 3000), (104, "    a\x0bb\x0cc\x1cd")]


@pytest.mark.parametrize("how", [{}, {"hot_units": 0}, {"buckets": 3, "hot_units": 2}])
def test_removes_what_brute_force_removes(spark, how):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    got = substring.remove_repeats(docs, width=12, **how).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 12)


def test_query_on_a_fixture(spark, tmp_path):
    rows = rows_of(2)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_substring(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 35)


def test_a_frequent_minimiser_is_spread_and_still_counted(spark):
    """One run of words in every text: its windows leave the bucket of their minimiser."""
    rng = random.Random(4)
    rows = [(d, " ".join([f"w{rng.randrange(10**6)}" for _ in range(8)] + ["head", "of", "page"] + [f"v{rng.randrange(3)}" for _ in range(9)])) for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    for hot_units in (5, 5_000):
        got = substring.remove_repeats(docs, width=12, hot_units=hot_units).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, 12)
    groups = substring.repeated_spans(docs.select("text"), 12, hot_units=5, buckets=64).groupBy("key").count().count()
    assert groups == len({r[0] for r in brute(rows, 12) if r[2]})


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "word_hashes", lambda words: np.zeros(len(words), np.uint64))
    string, offset = substring.repeated_windows([b"a b c d", b"b c d e", b"x y z"], np.array([1, 1, 1]), 3)
    assert sorted(zip(string.tolist(), offset.tolist(), strict=True)) == [(0, 1), (1, 0)]


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_pieces_of_repeated_signatures_travel(spark, monkeypatch):
    """Texts that share runs of words up to the width, but no window: nothing is dealt."""
    rng = random.Random(6)
    common = [f"c{k}" for k in range(6)]
    rows = [(d, " ".join(f"w{rng.randrange(10**9)}" if k % 40 > 5 else common[k % 40] for k in range(300))) for d in range(200)]
    texts = [t.encode().split() for _, t in rows]
    signature, n = np.unique(substring.pieces(texts, 20, 3)[3], return_counts=True)
    assert n.max() == 1
    text, first, windows, _ = substring.pieces(texts, 20, 3)
    assert sorted((int(t), int(f) + k) for t, f, w in zip(text, first, windows, strict=True) for k in range(w)) == [(t, k) for t in range(200) for k in range(281)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substring, "text_key", None)  # a piece that travels needs it
    assert substring.repeated_spans(docs.select("text"), 20).count() == 0


@pytest.mark.parametrize("width, m", [(2, 1), (3, 3), (4, 3), (12, 3), (35, 3)])
def test_equal_windows_have_one_signature_in_different_pieces(width, m):
    rng = random.Random(width)
    texts = [[b"abc"[k : k + 1] for k in (rng.randrange(3) for _ in range(rng.randrange(width, 300)))] + [b"a", b"b"] * 40 for _ in range(30)]
    seen = {}
    for x, f, w, s in zip(*(c.tolist() for c in substring.pieces(texts, width, m)), strict=True):
        for k in range(f, f + w):
            assert seen.setdefault(tuple(texts[x][k : k + width]), s) == s
        same = [tuple(texts[x][k : k + width]) for k in range(f, f + w)]
        assert len(set(same)) == len(same)


@pytest.mark.parametrize("hot_units", [5, 5_000])
def test_a_frequent_passage_makes_one_row_a_text(spark, hot_units):
    """Not one for each of its windows, which are dealt over all buckets."""
    rng = random.Random(9)
    passage, other = ([f"{x}{k}" for k in range(n)] for x, n in (("p", 40), ("q", 15)))
    rows, expected = [], []
    for d in range(300):
        gap = lambda n=d % 9 + 3: [f"w{rng.randrange(10**9)}" for _ in range(n)]
        words = gap()
        for part in [passage, other][: 1 + (d % 3 == 0)]:
            at = len(words)
            words += part + gap()
            expected.append((d, at, at + len(part)))
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    names = {hashlib.sha256(t.encode()).digest()[: substring.KEY_BYTES]: d for d, t in rows}
    got = substring.repeated_spans(docs.select("text"), 12, hot_units=hot_units, buckets=64).collect()
    assert sorted((names[bytes(r.key)], r.lo, r.hi) for r in got) == sorted(expected)


def test_spans_that_meet_or_overlap_are_one():
    rng = np.random.default_rng(3)
    keys = [b"a" * 12, b"a" * 11 + b"\0", b"\0" * 12, b"b" * 12]
    for size in (0, 1, 5, 60):
        spans = np.empty(size, substring._SPAN)
        spans["key"] = [keys[k] for k in rng.integers(0, 4, size)]
        spans["lo"] = rng.integers(0, 200, size)
        spans["hi"] = spans["lo"] + rng.integers(1, 30, size)
        assert (substring._rows(substring._columns(spans), substring._SPAN) == spans).all()
        got = [(k.ljust(12, b"\0"), lo, hi) for k, lo, hi in substring.covered(spans).tolist()]
        words = {(k.ljust(12, b"\0"), w) for k, lo, hi in spans.tolist() for w in range(lo, hi)}
        assert sorted((k, w) for k, lo, hi in got for w in range(lo, hi)) == sorted(words)
        assert not any((k, hi) in words for k, _, hi in got)
