import random
import re

import pytest

from braidwork.operators import overlaps


def plain(a, b):
    """(score, shortest best prefix of b), cell by cell."""
    was = [0] + [-(10**9)] * len(b)
    for i in range(len(a) + 1):
        row = [0] * (len(b) + 1)
        for j in range(1, len(b) + 1):
            row[j] = max(row[j - 1] - 4, was[j] - 4 if i else -(10**9), was[j - 1] + (1 if a[i - 1] == b[j - 1] else -1) if i else -(10**9))
        was = row
    return max(was), was.index(max(was))


def spent(a, b, score, a_len, b_len, cigar):
    """The score that a cigar gives."""
    i, j, total = len(a) - a_len, 0, 0
    for n, op in re.findall(r"(\d+)([MDI])", cigar):
        for _ in range(int(n)):
            if op == "M":
                total += 1 if a[i] == b[j] else -1
            else:
                total -= 4
            i, j = i + (op != "I"), j + (op != "D")
    assert (i, j) == (len(a), b_len)
    return total


def reads(rng):
    genome = "".join(rng.choice("ACGT") for _ in range(700))
    out = []
    for _ in range(40):
        at = rng.randrange(0, 620)
        read = list(genome[at : at + rng.randrange(60, 90)])
        if rng.random() < 0.5:
            k = rng.randrange(30, len(read) - 5)
            read[k] = rng.choice("ACGT")
            if rng.random() < 0.5:
                del read[k + 2]
        out.append("".join(read))
    return out + out[:1]


def test_one_row_for_each_overlapping_pair(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "AT_ONCE", 2)
    seqs = reads(random.Random(1)) + ["", "ACG"]
    got = overlaps.overlaps(spark.createDataFrame(list(enumerate(seqs)), "id long, sequence string").repartition(4), 30, 24).collect()
    found = {(r.a, r.b): r for r in got}
    assert len(found) == len(got)
    for r in got:
        a, b = seqs[r.a], seqs[r.b]
        assert (r.score, r.b_len) == plain(a, b) and spent(a, b, *tuple(r)[2:]) == r.score
    span = overlaps.WORD + overlaps.WINDOW - 1
    missed = 0
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs):
            score, n = plain(a, b)
            if i != j and (i, j) not in found and n >= 30 and score >= 24:
                missed += 1  # then no stretch of its first 30 bases is free of errors
                assert not any(b[p : p + span] == a[q : q + span] and len(a) - q + p >= 30 for p in range(30 - span + 1) for q in range(p, len(a) - span + 1))
    assert len(found) > 100 and missed < len(found) / 3


def test_bands(monkeypatch):
    rng = random.Random(2)
    for _ in range(30):
        a = "".join(rng.choice("ACGT") for _ in range(400))
        n = rng.randrange(60, 300)
        b = list(a[-n:]) + [rng.choice("ACGT") for _ in range(100)]
        del b[20]
        b[40] = "A"
        b = "".join(b)
        whole = overlaps.aligned(a, b, [n])
        monkeypatch.setattr(overlaps, "CELLS", 10)
        assert overlaps.aligned(a, b, [n]) == whole
        monkeypatch.undo()
        assert whole[:1] + whole[2:3] == plain(a, b)


def test_short_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        overlaps.overlaps(spark.createDataFrame([], "id long, sequence string"), 10)


def test_sequences_alike_by_chance_have_no_exact_overlap(spark, tmp_path):
    """Suppliers 0 and 2619 begin alike and go on alike in 19 of 32 places, so their whole sequences align with a score over 32."""
    from braidwork.plans import registry, synth

    spark.createDataFrame([(0,), (2619,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(5,), (6,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(5, 0)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, registry.QUERIES["found_overlaps"](spark, str(tmp_path)).collect()))
    assert got == [(p, s, 32, "32M") for p in ("p5", "p6") for s in ("s0", "s2619")]
    segments = synth.sql(spark, str(tmp_path), synth.J_SEGMENTS).selectExpr("node_id as id", "sequence")
    assert {(3, 5241), (5241, 3)} <= {(r.a, r.b) for r in overlaps.overlaps(segments, 32, 32).collect()}
    with_more = spark.createDataFrame([(1, "ACGGTTACAT" * 6), (2, "ACGGTTACAT" * 6)], "id long, sequence string")
    assert {(r.a_len, r.cigar) for r in overlaps.overlaps(with_more, 32, exact=True).collect()} == {(60, "60M")}
