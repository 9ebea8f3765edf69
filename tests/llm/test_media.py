import hashlib
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from braidwork.llm import media

ROWS = [(1, None), (2, ""), (3, "a" * 575), (4, "a" * 576), (5, "é" * 300), (5, "é" * 300), (None, "x"), (7, "long " * 50_000)]


def brute(rows):
    out = []
    for d, t in rows:
        data = (t or "").encode()
        size = max(576, -(-len(data) // 576) * 576)
        payload = data + b"\xff" * (size - len(data))
        out.append((d, len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [16 << 20, 700])
def test_what_is_read_back(spark, range_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("media", F.lit("clash")).repartition(3)
    got = media.media_columns(docs, range_bytes=range_bytes).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(ROWS)
    by_text = {(r.n_bytes, r.media_bytes, r.media_sha256, r.feature) for r in got if r.n_bytes == 600}
    assert len(by_text) == 1


def test_png_round_trip():
    payload = media.payload_of("öäü\n" * 1000)
    assert media.decode_png(media.encode_png(payload)) == payload
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(payload)[:-20] + b"0" * 20)


def test_a_member_is_read_again_alone():
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w") as z:
        for k in range(3):
            z.writestr(f"{k}/{k}.png", bytes([k]) * 99)
    members = zipfile.ZipFile(stream).infolist()
    opened = []

    def flaky():
        opened.append(1)
        if len(opened) in (2, 3):
            raise OSError("lost")
        return io.BytesIO(stream.getvalue())

    assert [media.read_member(flaky, m, wait=0) for m in members] == [bytes([k]) * 99 for k in range(3)]
    assert len(opened) == 5
    broken = bytearray(stream.getvalue())
    broken[members[1].header_offset + 60] ^= 1
    with pytest.raises(OSError):
        media.read_member(lambda: io.BytesIO(bytes(broken)), members[1], tries=2, wait=0)


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_of_any_letters():
    for key in (None, "", "a", "a\0b", "k/é.png", " %41", "x" * 20_000):
        assert media.key_of(media.member_name(7, key)) == key and media.member_name(7, key).isascii()
