import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F
from helpers import spark_rows, sql_rows

from pipecheck.llm import warc
from pipecheck.session import shared_path

LONG = "<p>" + "text " * 400


def pages(spark):
    html = [LONG, LONG, "short", "short", None, "", "é" * 500, "é" * 499 + "z", "é" * 500, LONG + "x", "a\r\n\r\nb" * 300]
    urls = ["http://a/", "http://b/x y%20z\r\nWARC-Type: bad", None, *(f"http://é/{n}" for n in range(len(html) - 3))]
    rows = [(n if n != 9 else None, urls[n], h) for n, h in enumerate(html)]
    return spark.createDataFrame([*rows, rows[0], rows[1]], "page_id long, url string, html string")


def test_round_trip(spark):
    df = pages(spark).withColumn("digest", F.lit("clash"))
    got = warc.read_archives(spark, warc.write_archives(df.repartition(3), shared_path(spark, "warc"))).cache()
    rows = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in df.collect()]
    read = [(r["page_id"], r["url"], bytes(r["payload"]) if r["payload"] is not None else None, r["record_type"], r["refers_to"]) for r in got.collect()]
    payload = {page: data for page, _, data in rows}
    assert sorted(((p, u) for p, u, *_ in read), key=repr) == sorted(((p, u) for p, u, _ in rows), key=repr)
    for page, _, data, kind, refers in read:
        assert (data == payload[page]) if kind == "response" else (data is None and payload[refers] == payload[page] and refers > page)
    out = got.filter("page_id is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert spark_rows(out) == sql_rows(warc.SQL, {"pages": df.filter("page_id is not null")})


def test_no_rows(spark):
    archives = warc.write_archives(pages(spark).limit(0), shared_path(spark, "warc"))
    assert warc.read_archives(spark, archives).count() == 0


def archive(records, dictionary=b""):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(dict_data=shared)
    head = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
    return head + b"".join(packer.compress(r) for r in records)


def test_frames():
    records = [b"a" * n for n in (0, 1, 5, 3_000_000)]
    learnt = warc.train_dictionary([f"page {n} of the many pages {n * 7}".encode() * 9 for n in range(400)])
    assert learnt and warc.train_dictionary([]) == warc.train_dictionary([b"x"]) == b""
    for dictionary in (b"", learnt):
        assert list(warc.frames(io.BytesIO(archive(records, dictionary)))) == records
    packed = zstandard.ZstdCompressor().compress(learnt)
    raw = archive(records, learnt)
    with_packed = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + raw[8 + len(learnt) :]
    assert list(warc.frames(io.BytesIO(with_packed))) == records
    for cut in (len(raw) - 3, 12):
        with pytest.raises(ValueError, match="cut off"):
            list(warc.frames(io.BytesIO(raw[:cut])))
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_damaged_records():
    good = warc.record(5, "http://a/", b"payload", "f07e5a815613c5abeddc4b682247a4c42d8a95df", None)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad, why in (
        (good.replace(b"WARC/1.1", b"WARC/9"), "no record"), (good.replace(b"WARC-Date", b"X-Date"), "missing"), (good[:-4], "stated"),
        (good.replace(b"payload\r", b"payloads\r"), "stated"), (good.replace(b"payload\r", b"Payload\r"), "digest"), (good.replace(b": ", b" ", 1), "no header"),
        (good.replace(b"Content-Length: 7", b"Content-Length: 9"), "stated"),
    ):
        with pytest.raises(ValueError, match=why):
            warc.parse_record(bad)
