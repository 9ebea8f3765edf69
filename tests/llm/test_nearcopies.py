import random

import numpy as np
import pytest
from braidwork.llm import nearcopies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept_by_all_pairs(rows):
    """Smallest ids of the components of all pairs that are at least 0.8 alike."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return sorted(min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))


def near_rows():
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for d in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))] + passage * (d % 2)
        for c in range(5):
            copy = list(words)
            for _ in range(c * 2):
                copy[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((100 * d + c, " ".join(copy[: len(copy) - rng.randrange(3)])))
    return rows + [(9001, "a b"), (9002, "A  b"), (9003, "a b c"), (9004, ""), (9005, None), (9006, " \n"), (9007, "x " * 9000)]


def test_masks_leave_no_pair_within_the_radius_apart():
    rng, masks = random.Random(3), nearcopies.masks()
    for _ in range(300):
        differ = rng.sample(range(128), nearcopies.STRETCHES * (nearcopies.REACH + 1) - 1)
        words = [sum(1 << p % 64 for p in differ if p // 64 == w) for w in range(2)]
        assert any(not words[0] & m and not words[1] & n for m, n in masks)


def test_alike_sizes_share_a_class():
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.integers(1, 70, 300), rng.integers(1, 40_000, 300), 4 ** np.arange(1, 9), 4 ** np.arange(1, 9) - 1]).astype(np.int32)
    fp = np.tile(rng.integers(0, 1 << 63, (1, 2)).astype(np.uint64), (len(n), 1))
    key, at = nearcopies.keys_of(fp, n)
    keys = [set(key[at == k].tolist()) for k in range(len(n))]
    q = np.floor(8 * np.log2(n + 1.0)).astype(int)
    for i in range(len(n)):
        for j in range(i):
            if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                assert keys[i] & keys[j] and abs(q[i] - q[j]) <= nearcopies.NEAR_Q


def test_large_buckets_hold_together():
    rng = np.random.default_rng(5)
    nodes = np.empty(700, nearcopies._NODE)
    base = rng.integers(0, 1 << 63, (7, 2)).astype(np.uint64)
    noise = np.array([[sum(1 << int(p) for p in rng.choice(64, 4, False)) for _ in range(2)] for _ in range(700)], np.uint64)
    nodes["fp"], nodes["sid"], nodes["n"] = base[np.arange(700) % 7] ^ noise, np.arange(700), 100
    nodes["c"], nodes["deg"] = nodes["n"], 0
    nodes["c"][699] = 80
    for key in (np.zeros(700, np.uint32), (np.arange(700) // 350).astype(np.uint32)):
        nodes["deg"] = nearcopies.company(key, nodes)
        assert nodes["deg"][699] == 0 and set(nodes["deg"][:699].tolist()) <= {48, 49, 98, 99}
        a, b, bits = nearcopies.met(key, nodes)
        assert len(a) <= 2 * 700 and (key[a] == key[b]).all() and (bits == nearcopies._apart(nodes["fp"][a], nodes["fp"][b])).all() and bits.max() <= nearcopies.WITHIN
        group = list(range(700))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if group[x] != group[y]:
                gone = group[y]
                group = [group[x] if g == gone else g for g in group]
        assert len({(group[k], k % 7, int(key[k])) for k in range(699)}) == 7 * len(set(key.tolist())) and group.count(group[699]) == 1


def rows_that_meet(nodes, key):
    near = lambda i, j: key[i] == key[j] and nearcopies._near(nodes, np.array([i]), np.array([j]))[0, 0] < 255
    return {(i, j) for j in range(len(nodes)) for i in range(j) if near(i, j)}


@pytest.mark.parametrize("leaders", [16, 4096])
def test_no_near_pair_of_different_components_is_left_out(monkeypatch, leaders):
    monkeypatch.setattr(nearcopies, "LEADERS", leaders)
    rng = np.random.default_rng(9)
    nodes = np.zeros(300, nearcopies._NODE)
    base = rng.integers(0, 1 << 63, (5, 2)).astype(np.uint64)
    nodes["fp"] = base[rng.integers(0, 5, 300)] ^ np.array([[sum(1 << int(p) for p in rng.choice(64, 5, False)) for _ in range(2)] for _ in range(300)], np.uint64)
    nodes["sid"], nodes["n"], nodes["c"] = np.arange(300), 100, rng.integers(84, 101, 300)
    nodes["root"] = rng.integers(0, 30, 300)
    for key in (np.zeros(300, np.uint32), rng.integers(0, 40, 300).astype(np.uint32)):
        meet = rows_that_meet(nodes, key)
        a, b, bits = nearcopies.across(key, nodes)
        got = sorted((min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True))
        assert got == sorted((i, j) for i, j in meet if nodes["root"][i] != nodes["root"][j])
        assert (bits == nearcopies._apart(nodes["fp"][a], nodes["fp"][b])).all()
        assert (nearcopies.company(key, nodes) > 0).tolist() == [any(k in p for p in meet) for k in range(300)]


@pytest.mark.parametrize("size", [30, 400, 60_000])
def test_slots_never_part_what_is_alike(size):
    rng = np.random.default_rng(size)
    base = rng.integers(-(1 << 63), 1 << 63, size)
    sets = [np.concatenate([rng.choice(base, size - k * size // 40, replace=False), rng.integers(-(1 << 63), 1 << 63, k * size // 40)]) for k in range(8)] + [base]
    nodes = np.zeros(len(sets), nearcopies._LIVE)
    for k, s in enumerate(sets):
        slots = nearcopies.slots_of(s, s[~np.isin(s, np.concatenate(sets[:k] + sets[k + 1 :]))])
        nodes["slots"][k], nodes["shift"][k], nodes["n"][k] = list(slots[:-1]), slots[-1], len(s)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                assert nearcopies._slots_allow(nodes, np.array([i]), np.array([j])).all()


def test_groups_are_those_of_all_pairs(spark):
    rows = near_rows()
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_all_pairs(rows)


def test_copies_with_edits_of_their_own(spark):
    """A large group round one text: some copies are near it, most are too far from all."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for d in range(1, 200):
        words = list(base)
        for at in rng.sample(range(2, 118), rng.randrange(1, 9)):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((d, " ".join(words)))
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_all_pairs(rows)


def test_no_near_copy_stays_in_the_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == kept_by_all_pairs([(r.doc_id, r.text) for r in docs.collect()])


def test_a_node_travels_once_for_two_keys():
    rng = np.random.default_rng(15)
    fp, n = rng.integers(0, 1 << 64, (3_000, 2), np.uint64), rng.integers(1, 400, 3_000).astype(np.uint32)
    key, at = nearcopies.keys_of(fp, n)
    part = nearcopies.parts_of(fp, n, 1_000)
    assert len(part) == len(key) and len(np.unique(at.astype(np.int64) * 1_000 + part)) < 0.55 * len(key)
    near = fp.copy()
    near[:, 0] ^= np.uint64(1)  # tables that leave this bit out keep their keys, and their parts
    same = nearcopies.keys_of(near, n)[0] == key
    assert 0.8 < same.mean() < 1 and (nearcopies.parts_of(near, n, 1_000) == part)[same].all()
