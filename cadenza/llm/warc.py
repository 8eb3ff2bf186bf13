"""WARC archives in Zstandard: writing through Spark's own writer, and reading frame by frame.

A file is a leading skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard frame per record.
Files are of bounded size: a task starts another when one is full. Spark's text writer lays them down, one row a file, on
whatever store the path names, under its commit protocol, so a task that runs twice leaves one set of files and a job that
fails leaves none. It ends each row with a newline; every file therefore ends in the header of a one-byte skippable frame,
of which that newline is the content, and is a plain sequence of frames that any reader can walk.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import cut, goes_at_exit, shared_dir

# Fixed values of the formats.
FRAME = 0xFD2FB528
DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
NEWLINE_FRAME = struct.pack("<II", 0x184D2A50, 1)  # its one byte is the newline that the writer adds
VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

#: The dictionary is trained on at most this many pages, none of more than so many bytes.
SAMPLE_PAGES, SAMPLE_PAGE_BYTES, DICTIONARY_BYTES = 200, 20_000, 32_768
#: An archive is closed when it has so many bytes; it is longer by its last record at most.
ARCHIVE_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; with refers_to a revisit, which has the response's HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[1:1] = [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record, checked: version, required headers, every length, the end mark and both digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError(f"not a {VERSION.decode()} record")
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        raise ValueError(f"headers missing: {missing}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4} bytes")
    block = rest[:size]
    if fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, refers = fields["warc-type"], fields.get("warc-refers-to", "").strip("<>")
    if kind == "response" and (length != len(payload) or digest != base32_sha1(payload)):
        raise ValueError("payload length or digest differs from the headers")
    if kind == "revisit" and (payload or not refers or len(digest) != 32):
        raise ValueError("a revisit has no payload, a digest and a record that it refers to")
    number = lambda urn: int(x) if (x := urn.removeprefix(URN)) else None
    return {"page_id": number(fields["warc-record-id"].strip("<>")), "url": fields.get("warc-target-uri", ""), "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(refers) if refers else None}


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends: its header, then block after block."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def records(content: bytes) -> Iterator[bytes]:
    """The records of one archive, a frame each."""
    data, at = memoryview(content), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"{len(data) - at} bytes are left over")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY:
                if at:
                    raise ValueError("the dictionary is not the leading frame")
                if size:
                    raw = bytes(data[8 : 8 + size])
                    if struct.unpack_from("<I", raw)[0] == FRAME:
                        raw = zstandard.ZstdDecompressor().decompress(raw)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(data, at)
            yield reader.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from the same bounded sample of pages each time; the pages themselves where too few to train on."""
    short = pages.select(F.col(html_col).alias("h")).where(F.octet_length("h").between(1, SAMPLE_PAGE_BYTES)).select("h", F.xxhash64("h").alias("k"))
    n = short.count()
    # a threshold on the hash leaves about twice the sample, however many tasks there are
    few = short.where((F.col("k") / float(2**63) + 1) / 2 * n < 2 * SAMPLE_PAGES + 200).dropDuplicates(["k"])
    sample = [r.h.encode() for r in few.orderBy("k").limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def write_archives(pages: DataFrame, at: str | None = None, level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a record per row of pages (page_id, url, html) below `at`; returns that folder.

    Of rows with equal payloads (null html: empty) the largest page_id is a response and the others are revisits of it.
    The response of each payload comes from one grouped maximum on the digest, combined before the shuffle; joining it
    back is a plain equi-join whose hot digests adaptive execution splits, and each task of that join writes its archives,
    of about `archive_bytes` each. Files have the names that Spark gives them, part-*.
    """
    spark = pages.sparkSession
    if at is None:
        at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        goes_at_exit(spark, at)
    own = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    first = own.groupBy("sha").agg(F.max("page_id").alias("response"))
    words = dictionary(pages)
    archive = lambda frames: pa.RecordBatch.from_arrays([pa.array([b"".join([skippable(DICTIONARY, words), *frames, NEWLINE_FRAME])], pa.binary())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=1, write_content_size=1)
        writer = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        frames: list[bytes] = []
        size = 0
        for b in cut(batches):
            for page, url, html, sha, response in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                frames.append(writer.compress(record(page, url, html.encode(), digest, None if page == response or response is None else response)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield archive(frames)
                    frames, size = [], 0
        if frames:
            yield archive(frames)

    joined = own.join(first, "sha").select("page_id", "url", "html", "sha", "response")
    files = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("compression", "none").option("maxRecordsPerFile", 1).text(at)
    return at


def read_archives(spark: SparkSession, at: str, payload: bool = True) -> DataFrame:
    """The records below `at`: page_id, url, payload (of responses), payload_bytes, payload_digest, record_type, refers_to.

    Archives are the files part-* and *.warc.zst, each read whole. A damaged archive fails the read, naming the file.
    """
    fields = [("page_id", "bigint", pa.int64()), ("url", "string", pa.string())] + [("payload", "binary", pa.binary())] * payload + [("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "bigint", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[dict] = []
                size = 0
                try:
                    for x in records(content.as_py()):
                        rows.append(parse(x))
                        size += len(x)
                        if size > 16e6:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, _, t in fields], [n for n, _, _ in fields])
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, _, t in fields], [n for n, _, _ in fields])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "{part-*,*.warc.zst}").load(at)
    return files.select("path", "content").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of pages. A null page_id is never the response of others; rows that repeat the largest page_id of a
    payload are all responses. An empty table gives no archive and no row. Other columns of pages are ignored.
    """
    at = write_archives(pages)
    return read_archives(pages.sparkSession, at, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
