import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from braidwork.llm import imatch


def signed(x, bits):
    return x - (1 << bits) if x >> (bits - 1) else x


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.lower()))


def int_then(k, term):
    """XXH64 of an int (seed 42), then of the term with that seed."""
    return xxhash.xxh64_intdigest(term.encode(), hash_int(k))


def hash_int(k):
    return xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)


def plain(rows, least, most):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42), 64)), reverse=True)
    df = Counter(w for _, t in rows for w in words_of(t))
    n = len(rows)
    lexicon = {w for w, c in df.items() if least * n <= c <= max(most * n, 3)}

    def fp(text):
        out = []
        for k, code in enumerate(imatch.CODES):
            rate = 2 ** imatch.RATES[k // 8]
            mine = sorted((w for w in words_of(text) & lexicon if signed(int_then(k, w), 64) % rate == 0), key=str.encode)
            end = imatch.CODES[k + 1] if k + 1 < len(imatch.CODES) else ""
            piece = "".join(f" {code}{w}" for w in mine) + (f" {end}" if end else "")
            out.append(f"{xxhash.xxh64_intdigest(piece.encode(), 42):016x}" if mine else "-")
        if set(out) == {"-"}:
            out[0] = f"{xxhash.xxh64_intdigest(('* ' + ' '.join(sorted(words_of(text), key=str.encode))).encode(), 42):016x}"
        return out

    def like(a, b):
        seen = [(x, y) for x, y in zip(a, b, strict=True) if x != "-" or y != "-"]
        return sum(x == y for x, y in seen) / len(seen) if seen else 1.0

    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, b, c = fp(t), fp(edited), fp(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), ".".join(a), ".".join(b), like(a, b), like(a, c)))
    return sorted(out, key=repr)


def test_is_the_plain_method(spark):
    rng = random.Random(4)
    rows = [(d * 3, " ".join(f"W{int(rng.paretovariate(0.4)) % 900}é" for _ in range(rng.randrange(1, 150)))) for d in range(300)]
    rows += [(-5, None), (-6, ""), (1, "𝄞𝄞𝄞 x\ny"), (30, rows[3][1]), (30, rows[3][1]), (30, "other words"), (None, "nothing w1"), (None, "w2"), (2, "w1é " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).repartition(6)
    got = sorted(map(tuple, imatch.edited_fingerprints(docs).collect()), key=repr)
    assert got == plain(rows, 0.005, 0.05)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert imatch.edited_fingerprints(empty).count() == 0
    got = imatch.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert got[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_keys_that_are_no_numbers(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(10**6)}é\"", " ".join(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(40))) for _ in range(500)] + [("k", None), ("", "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = {r.doc_id: r.edited_sha256 for r in imatch.edited_fingerprints(docs).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: r[0].encode(), reverse=True)
    for k, (d, t) in enumerate(order):
        third = len(t) // 3
        assert got[d] == hashlib.sha256((t[: len(t) - third] + order[(k + 1) % len(order)][1][:third]).encode()).hexdigest()


def test_a_text_is_taken_apart_once_for_its_hashes(spark):
    """The pieces that are hashed stand in the plan as often as the question whether there are any."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = docs.select(imatch.fingerprint(F.col("text"), [" "]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("slice(") == plan.count("exists(") > 0
