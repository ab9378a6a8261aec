"""Web archives of Zstandard frames with a shared dictionary, written and read back (operator 4)."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipecheck.llm.common import hash_cut, hash_order, table
from pipecheck.session import shared_path, written

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2000-01-01T00:00:00Z"
# Payloads from this size on are written once.
LEAST_SHARED = 1000
# The dictionary is learnt from so many payloads of the smallest hash, the first so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32768, 32768
CHUNK = 1 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in the shared storage (file, hdfs, s3, gs)."""
    if re.match(r"file:/(?!//)", path):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary for payloads like these, or none if they are too few to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes() if payloads else b""
    except zstandard.ZstdError:
        return b""


def record_id(page_id: int) -> str:
    return f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = record_id(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # A header ends with its line: control characters and % go in as percent codes.
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("WARC-Profile", PROFILE)]
    lines = [VERSION, *(f"{k}: {v}".encode("utf-8", "replace") for k, v in head)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_digest(html: Column) -> Column:
    """SHA-1 of the payload in hexadecimal digits; null is the empty payload."""
    return F.sha1(F.coalesce(html, F.lit("")).cast("binary"))


def references(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat the payload of a larger page_id.

    Only ids and digests are shuffled, counted per task first.
    """
    marks = pages.select("page_id", page_digest(F.col("html")).alias("digest")).filter(
        F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_SHARED
    )
    largest = marks.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return marks.join(largest, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as one archive per task into the shared ``folder``; returns path, records.

    Each file is a skippable frame with the dictionary, then one frame per record. A task writes under a name of its own and only what
    finished tasks report is read, so a repeated or lost task leaves no doubt. Of equal payloads of LEAST_SHARED bytes the largest page_id is
    the response; rows that repeat its page_id and payload are responses too. Null html is an empty payload.
    Texts meet their reference by page_id, never by digest: a payload of a third of the pages stays spread.
    """
    starts = pages.select("page_id", F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES).alias("b")).filter("b is not null")
    cut = hash_cut(starts, "page_id", pages.count(), SAMPLE_ROWS)
    sample = cut.orderBy(hash_order("page_id")).limit(SAMPLE_ROWS).select("b").collect()  # at most SAMPLE_ROWS * SAMPLE_BYTES
    dictionary = train_dictionary([bytes(r["b"]) for r in sample])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.zst"
        fs, path = filesystem(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=True)
        n = 0
        with fs.open_output_stream(path, compression=None) as out:
            if dictionary:
                out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            for batch in batches:
                for page, url, html, digest, other in batch[["page_id", "url", "html", "digest", "refers_to"]].itertuples(index=False):
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    ids = [None if pd.isna(x) else int(x) for x in (page, other)]
                    out.write(packer.compress(record(ids[0], url, payload, digest, ids[1])))
                    n += 1
        yield pd.DataFrame({"path": [name], "records": [n]})

    refs = references(pages).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    marked = pages.select("page_id", "url", "html", page_digest(F.col("html")).alias("digest"))
    met = marked.join(refs, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")
    # Text, so that null ids stay whole numbers in pandas.
    texts = met.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return written(texts.mapInPandas(write, "path string, records long"), "archives")


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive, with the dictionary of its leading skippable frame."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", head[4:])[0]
        raw = stream.read(size)
        if len(raw) < size:
            raise ValueError("the dictionary frame is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, head = zstandard.ZstdCompressionDict(raw), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = head
    while rest or (rest := stream.read(CHUNK)):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Headers (names in lower case), http headers and payload of a record; a record that breaks the format raises."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError(f"no record of {VERSION.decode()}: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [h for h in REQUIRED if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers['warc-record-id']}: {len(rest) - 4} bytes of content, {size} stated")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = base64.b32decode(headers.get("warc-payload-digest", "sha1:").partition(":")[2]).hex()
    if headers["warc-type"] == "response":
        if stated and int(stated[1]) != len(payload):
            raise ValueError(f"{headers['warc-record-id']}: {len(payload)} bytes of payload, {int(stated[1])} stated")
        if digest and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{headers['warc-record-id']}: the payload's digest differs")
    return {"headers": headers, "payload": payload, "payload_bytes": int(stated[1]) if stated else len(payload), "digest": digest}


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of every record of ``archives`` (path).

    Each file is read by one task, a chunk and a record at a time. Headers, lengths and digests are checked; a damaged
    file fails the query with the record's name. A revisit has a null payload. Records without a page's name have a null page_id.
    """

    def page(name: str | None) -> str | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return found[1] if found else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for batch in batches for p in batch["path"]):
            fs, local = filesystem(path)
            with fs.open_input_stream(local, compression=None) as stream:
                rows, held = [], 0
                for raw in frames(stream):
                    found = parse_record(raw)
                    h = found["headers"]
                    url = h.get("warc-target-uri")
                    rows.append((
                        page(h["warc-record-id"]), url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), h["warc-type"],
                        page(h.get("warc-refers-to")), found["payload_bytes"], found["digest"],
                        found["payload"] if h["warc-type"] == "response" else None,
                    ))
                    held += len(raw)
                    if held > 16 * CHUNK:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    files = max(1, archives.count())
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    records = archives.select("path").repartition(files).mapInPandas(read, schema)
    return records.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), shared AS (
  SELECT payload_digest, max(page_id) AS largest FROM payloads WHERE payload_bytes >= {LEAST_SHARED} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM payloads LEFT JOIN shared USING (payload_digest)
"""

QUERIES = {"op4_warc": (op4_warc, SQL)}
