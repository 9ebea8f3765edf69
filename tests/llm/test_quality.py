import random
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.llm import queries, quality


def brute_marginals(unary, moves):
    """Chance of good of every line by going through all labellings."""
    total, good = 0.0, np.zeros(len(unary))
    for states in product((0, 1), repeat=len(unary)):
        weight = np.exp(sum(u for u, s in zip(unary, states, strict=True) if s) + sum(moves[a, b] for a, b in zip(states, states[1:], strict=False)))
        total += weight
        good += weight * np.array(states)
    return good / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 6, 2, 6])
    unary, moves = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    chance, expected = quality.marginals(unary, moves, lines)
    at = np.cumsum(lines) - lines
    assert np.allclose(chance, np.concatenate([brute_marginals(unary[a : a + n], moves) for a, n in zip(at, lines, strict=True)]))
    assert np.isclose(expected.sum(), (lines - 1).sum())


def test_gradient_is_that_of_the_likelihood():
    moves, unary, lines = np.array([[0.3, -0.2], [0.1, 0.4]]), np.array([0.5, -1.0, 0.2]), np.array([3])
    logz = lambda u, m: np.log(sum(np.exp(sum(x for x, s in zip(u, st, strict=True) if s) + sum(m[a, b] for a, b in zip(st, st[1:], strict=False))) for st in product((0, 1), repeat=3)))
    chance, expected = quality.marginals(unary, moves, lines)
    for k in range(3):
        bump = np.eye(3)[k] * 1e-5
        assert np.isclose((logz(unary + bump, moves) - logz(unary - bump, moves)) / 2e-5, chance[k], atol=1e-6)
    for a, b in product((0, 1), repeat=2):
        bump = np.zeros((2, 2))
        bump[a, b] = 1e-5
        assert np.isclose((logz(unary, moves + bump) - logz(unary, moves - bump)) / 2e-5, expected[a, b], atol=1e-6)


def test_line_features():
    own, length, lines = quality.line_features([b"AB cd cd\n\n1;", b"", b"x y x"])
    assert lines.tolist() == [3, 1, 1] and length.tolist() == [8, 0, 2, 0, 5]
    assert np.allclose(own[0], [np.log(4), np.log(9), 1 / 3, 0, 0, 0, 1 / 3, 2 / 3, 0.2, 0])
    assert np.isclose(own[4][7], 2 / 3) and own[1][9] == own[3][9] == 1


def test_scores_do_not_depend_on_the_batch(spark):
    rng = random.Random(0)
    texts = ["\n".join(" ".join(rng.choice(["aa", "BB!!", "c", "é"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 30))).encode() for _ in range(80)]
    chain = quality.fit(texts, np.array([k % 2 for k in range(80)], float), steps=10)
    alone = np.concatenate([chain.scores([t]) for t in texts])
    assert np.allclose(alone, np.concatenate([chain.scores(b) for b in quality.blocks(pa.array(texts), 100)]))


def test_held_out_accuracy(spark):
    got = queries.op6_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 1000 and right > 0.98


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "\x00\n \n" * 2000), (None, "word " * 50_000), (4, "fine line\nand more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 6
    some = spark.createDataFrame([(4, 1), (3, 0), (9, None), (1, 7)], "doc_id long, quality int")
    got = quality.score(docs, some).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), some).count() == 0
