import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidwork.llm import bpe, queries
from braidwork.shared import table

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t ", "Hello, World's 123!", "<|startoftext|> a <|endoftext|>b<|endoftext|>", "a\x1cb \x1d", "'s'S don't DON'T", "é é Ⅷ² İstanbul ǅ \x00a​\u0085x", "Σς ΑΣ", "\U0001f469‍\U0001f4bb \U0002f800",
         "ab" * 20_000, "long words " * 5_000, "Hello, World's 123!"]


def plain(vocabulary, symbols):
    """Merge the leftmost pair of the least rank, again and again."""
    symbols = list(symbols)
    while True:
        ranked = [(r, k) for k in range(len(symbols) - 1) if (r := vocabulary.follow[symbols[k]].get(symbols[k + 1])) is not None]
        if not ranked:
            return symbols
        rank, k = min(ranked)
        symbols[k : k + 2] = [vocabulary.made[rank]]


@pytest.fixture(params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def name(request):
    return request.param


def test_as_the_library(name):
    data = open(public_tokenizers.path(name), "rb").read()
    mine, library = bpe.Vocabulary(data), Tokenizer.from_str(data.decode())
    rng = random.Random(7)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x300), lambda: rng.randrange(0x300, 0xD800), lambda: rng.randrange(0xE000, 0x110000), lambda: 32, lambda: 0x301]
    texts = [t or "" for t in TEXTS] + ["".join(chr(rng.choice(kinds)()) for _ in range(60)) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert memoryview(got).cast("I").tolist() == want
        assert mine.decode(got) == library.decode(want, skip_special_tokens=False)


def test_rules_agree_on_latin_characters():
    data = open(bpe.default_model(), "rb").read()
    mine, library = bpe.Vocabulary(data), Tokenizer.from_str(data.decode())
    latin = [chr(c) for c in range(ord(bpe._AGREED))]
    for a in latin:
        for t in (a, f"x{a}y", f"1{a}{a}", f"'{a}S", f"{a}'s"):
            assert memoryview(mine.encode(t)).cast("I").tolist() == library.encode(t, add_special_tokens=False).ids
    rng = random.Random(2)
    for _ in range(3_000):
        t = "".join(rng.choices(latin, k=12))
        assert memoryview(mine.encode(t)).cast("I").tolist() == library.encode(t, add_special_tokens=False).ids


def test_merges_by_hand():
    vocabulary = bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    rng = random.Random(1)
    for n in range(200):
        symbols = [vocabulary.ids[rng.choice("aeinrst")] for _ in range(n % 40)]
        assert vocabulary.merge(symbols) == plain(vocabulary, symbols)


def test_byte_level_round_trip():
    vocabulary = bpe.Vocabulary(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    for t in TEXTS:
        assert vocabulary.decode(vocabulary.encode(t)) == (t or "")


def test_small_caches(monkeypatch):
    data = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    a, b = bpe.Vocabulary(data), bpe.Vocabulary(data)
    want = [a.encode(t) for t in TEXTS]
    monkeypatch.setattr(bpe, "CACHED", 2)
    assert [b.encode(t) for t in TEXTS] == want and len(b.words) <= 2


def test_rows_and_columns(spark):
    rows = [(k if k % 4 else None, t) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "row": F.lit(1), "a.b": F.lit(2)})
    vocabulary = bpe.Vocabulary(open(bpe.default_model(), "rb").read())
    got = sorted(((r.row["doc_id"], list(r.ids), r.text) for r in bpe.encode(docs).collect()), key=repr)
    want = [(k, memoryview(i := vocabulary.encode(t)).cast("I").tolist(), vocabulary.decode(i)) for k, t in rows]
    assert got == sorted(want, key=repr)
    assert bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.Vocabulary(open(bpe.default_model(), "rb").read().replace(b'"BPE"', b'"Other"'))


def test_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_bpe(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id] == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(library.decode(ids, skip_special_tokens=False).encode()))
