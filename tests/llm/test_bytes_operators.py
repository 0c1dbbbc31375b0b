"""Round trips of the WARC and Ogg operators."""

import base64
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from linelake.llm import media, warc
from tests.llm.data import awkward


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    for n in (0, 1, 27, 300):
        x = os.urandom(n)
        assert media.ogg_crc(x) == slow_crc(x)


@pytest.mark.parametrize("n", [64, 255 * 64, 65_024, 65_088, 70_016, 300_032])
def test_ogg_round_trip(n):
    x = os.urandom(n)
    m = media.decode_ogg(media.encode_ogg(x))
    assert (m.payload, m.bad_pages, m.streams, m.seconds) == (x, 0, 2, n / media.RATE)
    assert m.envelope == bytes(sum(x[i : i + 256]) // len(x[i : i + 256]) for i in range(0, n, 256))


def test_damaged_pages_are_left_out():
    x = os.urandom(300_032)
    e = bytearray(media.encode_ogg(x))
    e[150_000] ^= 1
    m = media.decode_ogg(bytes(e))
    assert m.bad_pages == 1 and 0 < len(m.payload) < len(x)
    cut = media.decode_ogg(bytes(e[:100_000]))
    assert cut.bad_pages >= 1 and x.startswith(cut.payload)
    noise = media.decode_ogg(b"xx" + media.encode_ogg(x[:640]) + b"yy")
    assert noise.payload == x[:640]
    assert media.read_ogg(b"") == ({}, 0)


def test_media_columns(spark):
    df, rows = awkward(spark)
    got = media.media_columns(media.to_media(df)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    seen = {}
    for x in got:
        if x.doc_id is None:
            continue
        raw = (text[x.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert seen.setdefault(raw, (x.media_sha256, x.feature)) == (x.media_sha256, x.feature)
        assert x.bad_pages == 0 and x.seconds == len(padded) / media.RATE
    assert media.media_columns(media.to_media(df.limit(0))).count() == 0


def pages(spark):
    rows = [(1, "http://a/\r\nX: y", "one"), (2, None, "one"), (3, "u", "x" * 200_000), (9, "u", "x" * 200_000), (4, "u", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1"), (7, "u", "y" * 65_536), (8, "u", "y" * 65_536 + "z"), (10, "u", "one\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("chunk", F.lit(2)), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    chunks = warc.write_archive(df).cache()
    assert max(len(x.data) for x in chunks.collect()) < warc.CHUNK_BYTES + 2000
    got = {x.page_id: x for x in warc.read_archive(chunks).collect()}
    body = {i: (t or "").encode() for i, _, t in rows}
    for i, b in body.items():
        keeper = max(k for k in body if body[k] == b)
        x = got[i]
        assert (x.payload_bytes, x.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (x.record_type, x.refers_to, x.intact) == (("response", None, True) if keeper == i else ("revisit", keeper, True))


def test_small_payloads_are_not_deduplicated(spark):
    df, _ = pages(spark)
    got = {x.page_id: x.record_type for x in warc.read_archive(warc.write_archive(df, dedup_bytes=10)).collect()}
    assert got[1] == got[2] == got[4] == got[5] == "response" and got[3] == "revisit"


def test_archive_is_a_warc_file(spark, tmp_path):
    df, rows = pages(spark)
    chunks = warc.write_archive(df.coalesce(1)).cache()
    warc.export_warc(chunks, f"file://{tmp_path}/a.warc")
    data = (tmp_path / "a.warc").read_bytes()
    records = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data, records = rest[n + 4 :], records + 1
    assert records == len(rows)


def test_damage_is_seen(spark):
    df, _ = pages(spark)
    chunks = warc.write_archive(df)
    broken = chunks.withColumn("data", F.when((F.col("record") == 9) & (F.col("chunk") == 1), F.encode(F.lit("q" * 65_536), "utf-8")).otherwise(F.col("data")))
    assert {x.page_id for x in warc.read_archive(broken).filter("not intact").collect()} == {9}
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0
