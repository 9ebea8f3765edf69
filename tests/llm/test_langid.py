import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import langid, queries


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = langid.Network.fresh(["a", "b", "c"], hidden=3, seed=1)
    for name in ("inputs", "gates", "candidate"):
        for d in (network.forward, network.backward):
            setattr(d, name, getattr(d, name).astype(np.float64))
    network.out = network.out.astype(np.float64)
    x = rng.integers(0, 6, (7, 4)).astype(np.int16)
    x[5:, 1] = langid.PAD
    label = np.array([0, 1, 2, 1])
    _, gradient = network.gradients(x, label)
    for p, g in zip(network.params(), gradient, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p.shape[-1] == langid.PAD + 1:
                at = (at[0], int(rng.integers(0, 6)))
            was = p[at]
            p[at] = was + 1e-3
            up = network.gradients(x, label)[0]
            p[at] = was - 1e-3
            down = network.gradients(x, label)[0]
            p[at] = was
            assert abs((up - down) / 2e-3 - g[at]) < 2e-4


def test_windows_cover_every_byte_once():
    texts = [b"", b"a" * 224, b"B" * 225, b"c" * 1000]
    symbols, starts = langid.windows(texts)
    core = np.concatenate([symbols[s + langid.CONTEXT : s + langid.CONTEXT + langid.CORE] for s in starts])
    assert bytes(core[core != langid.PAD].astype(np.uint8)) == b"a" * 224 + b"b" * 225 + b"c" * 1000


def test_pooling_does_not_depend_on_the_batch(monkeypatch):
    network = langid.Network.fresh(["a", "b"], seed=3)
    texts = [b"", b"one", b"two " * 300, bytes(range(1, 256)) * 5]
    whole = langid.pooled(network, texts)
    monkeypatch.setattr(langid, "WINDOWS_AT_ONCE", 3)
    assert np.allclose(whole, np.concatenate([langid.pooled(network, [t]) for t in texts]), atol=1e-5)


def test_held_out_accuracy(spark):
    got = queries.op1_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.95


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 _ !", "b"), (4, "abc " * 60_000, "a"), (5, "xyz É " * 15, "b"), (5, "xyz É " * 15, "b"), (None, "abc", None), (7, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(docs, docs, steps=250).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "a", "b"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), docs, steps=2).count() == 0
