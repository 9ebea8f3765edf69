import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import elkan


def plain(rows, k, rounds):
    """Every distance of every round, in Python's whole numbers."""
    kept = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    at = [list(v) for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(rows, own, strict=True) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(key, *near(v)[::-1]) for key, v in rows], at


def table(rng, n, dims, spread):
    middles = [[rng.randrange(-spread, spread) for _ in range(dims)] for _ in range(7)]
    return [[m + rng.randrange(-3, 4) for m in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("n,dims,k,spread", [(0, 3, 4, 5), (1, 3, 4, 5), (60, 2, 9, 4), (300, 4, 12, 30), (200, 3, 1, 9)])
def test_as_all_distances(spark, n, dims, k, spread):
    rng = random.Random(n)
    rows = [(None if i % 50 == 49 else i, v) for i, v in enumerate(table(rng, n, dims, spread))]
    rows += rows[:5]  # repeated rows
    more = [(1000, None), (1001, [1.0]), (1002, [None] + [1.0] * (dims - 1)), (1003, [float("nan")] * dims), (1004, [float("inf")] * dims), (1005, [])]
    vectors = spark.createDataFrame([(i, [x / 8 + 0.01 for x in v]) for i, v in rows] + more, "vec_id long, embedding array<float>").withColumns({"key": F.lit("clash"), "v": F.lit(1), "cluster": F.lit("x")})
    found, at = elkan.cluster(vectors.repartition(5), k=k, dims=dims, scale=8)
    want, centroids = plain(rows, k, 5)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert at.tolist() == centroids
    out = elkan.with_inertia(found, at).collect()
    assert len(out) == len(want) and {r.inertia for r in out} <= {sum(d for _, _, d in want)}


def test_bounds_save_distances():
    rng = random.Random(5)
    v = np.array(table(rng, 2_000, 16, 1_000), np.int64)
    first = elkan.Centroids(v[:20])
    own, upper, lower = elkan.start(v, first)
    then = elkan.Centroids(np.stack([v[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else first.at[c] for c in range(20)]), first.at)
    own, upper, lower, done = elkan.move(v, own, upper, lower, then)
    far = np.stack([elkan.squared(v, c) for c in then.at], axis=1)
    assert (own == far.argmin(axis=1)).all() and done < len(v) * 20 / 3
    assert (upper.astype(float) ** 2 >= far[np.arange(len(v)), own]).all() and (np.maximum(lower, 0).astype(float) ** 2 <= far).all()


def test_too_large(spark):
    vectors = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="after scaling"):
        elkan.cluster(vectors, dims=2)
