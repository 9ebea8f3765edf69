import math
from collections import Counter, defaultdict

import pytest
from test_nearcopies import kept_by_all_pairs

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        out[name] = (docs.collect(), rows)
        if name != "sentencepiece":
            assert made.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_quality_drops_bad_documents(spark, stages):
    had, kept = stages["quality"]
    kept = {r.doc_id for r in kept}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [r.doc_id for r in had if r.doc_id in labels]
    assert sum((d in kept) == bool(labels[d]) for d in known) >= 0.95 * len(known)


def test_one_of_each_group_stays(stages):
    had, kept = stages["simhash"]
    assert sorted(r.doc_id for r in kept) == kept_by_all_pairs([(r.doc_id, r.text) for r in had])


def test_repeats_go(stages):
    had, kept = stages["substring"]
    words = {r.doc_id: r.text.encode().split() for r in had}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    kept = {r.doc_id: r for r in kept}
    for r in had:
        w = words[r.doc_id]
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        if gone and len(gone) == len(w):
            assert r.doc_id not in kept
        elif gone:
            assert kept[r.doc_id].text.encode() == b" ".join(x for k, x in enumerate(w) if k not in gone)
            assert kept[r.doc_id].n_chars == len(kept[r.doc_id].text)
        else:
            assert kept[r.doc_id] == r


def test_every_document_is_in_the_mixture(stages):
    had, mixture = stages["mixing"]
    times = Counter(r.doc_id for r in mixture)
    assert set(times) == {r.doc_id for r in had} and max(times.values()) <= 4
    tokens, taken = defaultdict(int), defaultdict(int)
    for r in had:
        tokens[r.source] += len(r.text.split())
        taken[r.source] += len(r.text.split()) * times[r.doc_id]
    share = [n / sum(taken.values()) for n in taken.values()]
    assert -sum(p * math.log(p) for p in share) >= 0.94 * math.log(len(share))


def test_ids_decode(stages):
    had, done = stages["sentencepiece"]
    assert len(had) == len(done) and all(r.round_trip and r.n_tokens == len(r.ids) for r in done)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(r.ids)) for r in stages["sentencepiece"][1])


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, whole string, tid long, stays string, epoch int"
    more = ("r", "w", 7, "x", 2)
    rows = [(1, None, None, None, None, *more), (None, "", "en", "s", 0, *more), (3, "a fine line", None, "s", 11, *more), (3, "a fine line", None, "s", 11, *more)]
    stages = dict(corpus_pipeline.STAGES)
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        assert {r.doc_id for r in stages["quality"](spark, docs, SF).collect()} <= {1, None, 3}
        assert sorted(tuple(r) for r in stages["simhash"](spark, docs, SF).collect()) == sorted(set(rows[:1] + rows[2:3]) if data else [])
        kept = stages["substring"](spark, docs, SF)
        assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, data))
        mixture = stages["mixing"](spark, docs, SF)
        assert mixture.columns == docs.columns and {r.doc_id for r in mixture.collect()} == {r[0] for r in data}
        assert all(r.round_trip for r in stages["sentencepiece"](spark, docs, SF).collect())
