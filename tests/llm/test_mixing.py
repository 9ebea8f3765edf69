import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from braidwork.llm import mixing


def fixture():
    rng = random.Random(2)
    rows = [(d, f"s{min(d % 17, 6)}", " ".join(["w"] * rng.randrange(60))) for d in range(700)]
    return rows + [(900, None, "a b c"), (901, "empty", None), (902, "empty", ""), (None, "s1", "x\ty\x0b z"), (5, rows[5][1], rows[5][2])]


def tokens_by_source(rows):
    out = defaultdict(int)
    for _, s, t in rows:
        out[s] += len((t or "").split())
    return out


def wanted(rows, entropy, max_repeat, budget):
    """Exponent, weights and budgets by plain bisection."""
    have = {s: n for s, n in tokens_by_source(rows).items() if n}
    total = sum(have.values())

    def at(x):
        z = sum((n / total) ** x for n in have.values())
        w = {s: (n / total) ** x / z for s, n in have.items()}
        spent = budget or max(n / w[s] for s, n in have.items())
        h = -sum(v * math.log(v) for v in w.values())
        return w, spent, h <= entropy * math.log(len(have)) + 1e-9 and max(w[s] * spent / n for s, n in have.items()) <= max_repeat + 1e-9

    lo, hi = 0.0, 1.0
    if at(0.0)[2]:
        hi = 0.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if at(mid)[2] else (mid, hi)
    return hi, *at(hi)[:2]


@pytest.mark.parametrize(("entropy", "max_repeat", "budget"), [(0.95, 4.0, None), (0.99, 1.5, None), (0.9, 100.0, 9000.0)])
def test_weights_and_copies(spark, entropy, max_repeat, budget):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit("clash"))
    got = mixing.mix(docs, entropy=entropy, max_repeat=max_repeat, budget=budget, block_tokens=200).collect()
    exponent, weights, spent = wanted(rows, entropy, max_repeat, budget)
    assert abs(got[0].exponent - exponent) < 1e-5
    have = tokens_by_source(rows)
    taken, streams = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.tokens == len((r.row.text or "").split())
        taken[r.row.source] += r.tokens
        streams[r.row.source, r.epoch].append((r.start_token, r.tokens))
    for s, w in weights.items():
        assert w * spent - 62 <= taken[s] <= w * spent + 1  # the next document may not fit
        assert taken[s] <= max_repeat * have[s] + 1
    for (s, epoch), stream in streams.items():
        if epoch < weights.get(s, 0) * spent // max(have[s], 1):
            at = 0
            for start, n in sorted(x for x in stream if x[1]):
                assert start == at
                at += n
            assert at == have[s]
    if budget is None:
        assert len({(r.row.doc_id, r.row.text) for r in got}) == len({(d, t) for d, _, t in rows})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 1


def test_rows_without_tokens_stand_at_the_beginning(spark):
    """3,000 equal rows without tokens and some with: all are taken, at the beginning of their block."""
    rows = [(None, "e", None)] * 2000 + [(None, "s", " ")] * 1000 + [(d, "s", "a b c") for d in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(docs, block_tokens=20)
    got = mixed.collect()
    assert sum(r.row.source == "e" for r in got) == 2000 and sum(r.tokens == 0 for r in got if r.epoch == 0) == 3000
    assert sorted(r.start_token for r in got if r.tokens and r.epoch == 0) == list(range(0, 150, 3))
    begins = {(r.epoch, r.block): r.start_token for r in sorted(got, key=lambda r: -r.start_token) if r.tokens and r.row.source == "s"}
    assert all(r.start_token == begins[r.epoch, r.block] for r in got if not r.tokens and r.row.source == "s" and (r.epoch, r.block) in begins)


def test_ordered_texts_are_not_shuffled_again(spark):
    """However large the table of blocks is, only narrow tables are shuffled once texts lie by block."""
    docs = spark.createDataFrame(fixture(), "doc_id long, source string, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = mixing.mix(docs, block_tokens=200)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.index("Union") < plan.index("Exchange")
