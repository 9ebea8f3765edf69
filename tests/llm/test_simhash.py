import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from braidwork.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[k][0], f"{fps[k]:016x}", least[group[k]]) for k in range(len(rows))), key=repr)


def near_rows():
    rng = random.Random(3)
    rows = []
    for d in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(150)]
        for c in range(6):
            copy = list(words)
            for _ in range(c % 4):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((100 * d + c, " ".join(copy)))
    return rows


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "x " * 40000), (8, "É é   É"), (None, "one"), (9, "𝄞 " * 3)]


@pytest.mark.parametrize("limit", [16384, 2])
def test_groups_are_those_of_all_pairs(spark, limit):
    rows = near_rows() + EDGE
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs, bucket_limit=limit).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_every_pair_within_the_radius_meets():
    rng = random.Random(0)
    masks = [m % 2**64 for m in simhash.covering_masks(4)]
    for _ in range(5000):
        difference = sum(1 << p for p in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & difference == 0 for m in masks)


def test_forest_spans_all_links():
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(p) for p in rng.integers(0, 64, rng.integers(0, 4))) for b in rng.integers(0, 2**63, 9) for _ in range(40)], np.uint64))
    a, b = simhash.forest(fps, 4, block=3)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    group = {int(f): int(f) for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in zip(a, b, strict=True):
        group[root(int(x))] = root(int(y))
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert all(root(int(fps[i])) == root(int(fps[j])) for i, j in near)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
