"""WARC archives of Zstandard frames with a shared dictionary.

An archive is a file whose first frame is skippable and holds the dictionary;
after it comes one frame per record, so that a record can be decoded alone. The
writer lets every task cut its rows into archives of bounded size; Spark's text
sink stores each archive as a file of its own through any file system that Spark
knows (the line separator that it adds is an empty skippable frame, which readers
skip). The reader loads the dictionary, decodes frame by frame, and checks
version, required headers, block length, digests and record ends.

Payloads that several rows share are stored once: the row with the smallest id
is the response, the others are revisit records that refer to it; payloads
smaller than `min_revisit` bytes are always responses.

Defined results: null payloads are stored as empty ones; a row without an id has a
record too, to which nothing refers: a revisit if a row with an id has its payload,
else a response; of repeated ids with one payload
each row has a record, and all of them but none refer to themselves: the id's own
rows are responses; of repeated ids with different payloads each row is a response
or a revisit by its own payload, and a record's id follows from page id and payload
digest, so that a reference names the record that holds the payload; null URLs are stored as an empty target; an empty table gives
no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIP_FIRST, SKIP_LAST = 0x184D2A50, 0x184D2A5F
EMPTY_SKIP = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed when its compressed records reach this size.
ARCHIVE_BYTES = 8 << 20
#: Rows that the dictionary is trained on at most, and its size.
SAMPLE_ROWS, DICT_BYTES = 200, 32 << 10
#: Characters of each of them.
SAMPLE_CHARS = 64 << 10
LEVEL = 3
_DATE = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class BadArchive(ValueError):
    """What an archive holds is not what the format or its own headers say."""


def sha1_32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_uuid(kind: str, page: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page}/{digest}')}>"


def build(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, before compression."""
    revisit, digest = refers_to is not None, sha1_32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_uuid("record", page, digest) if page is not None else f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "X-Page-ID": "" if page is None else str(page),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_32(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_uuid("record", refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def frames(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, content of skippable frames or whole data frames) in order."""
    at = 0
    while at < len(raw):
        if at + 4 > len(raw):
            raise BadArchive("bytes after the last frame")
        magic = struct.unpack_from("<I", raw, at)[0]
        if SKIP_FIRST <= magic <= SKIP_LAST:
            if at + 8 > len(raw):
                raise BadArchive("a skippable frame without its size")
            size = struct.unpack_from("<I", raw, at + 4)[0]
            if at + 8 + size > len(raw):
                raise BadArchive("a skippable frame ends early")
            yield magic, raw[at + 8 : at + 8 + size]
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(raw, at)
            yield magic, raw[at:end]
            at = end
        else:
            raise BadArchive(f"unknown frame {magic:#x}")


def _frame_end(raw: bytes, at: int) -> int:
    """Where a data frame ends, by its block headers."""
    try:
        flags = raw[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            head = int.from_bytes(raw[at : at + 3], "little")
            if at + 3 > len(raw):
                raise BadArchive("a frame ends early")
            at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except IndexError:
        raise BadArchive("a frame ends early") from None
    at += 4 * checksum
    if at > len(raw):
        raise BadArchive("a frame ends early")
    return at


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a decoded record, checked against each other."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadArchive("no WARC version")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if not fields.get(name):
            raise BadArchive(f"no {name}")
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadArchive("the block's length is not the one stated")
    if fields.get("WARC-Block-Digest", "").removeprefix("sha1:") != sha1_32(block):
        raise BadArchive("the block's digest is not the one stated")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("no HTTP headers")
    fields["http-length"] = next((x.split(b":")[1].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), "")
    if fields["WARC-Type"] == "response":
        if str(len(payload)) != fields["http-length"] or fields["WARC-Payload-Digest"].removeprefix("sha1:") != sha1_32(payload):
            raise BadArchive("the payload is not the one stated")
    elif payload or not fields.get("WARC-Refers-To"):
        raise BadArchive("a revisit with a payload, or without a reference")
    return fields, payload


def train_dictionary(pages: DataFrame, payload_col: str = "html", rows: int = SAMPLE_ROWS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from a bounded sample of records; empty if there is too little to train on."""
    some = [build(0, None, (r[0] or "").encode(), None) for r in pages.select(F.substring(payload_col, 1, SAMPLE_CHARS)).limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, some).as_bytes()
    except zstandard.ZstdError:
        return b""


def _payload_key(payload: Column) -> tuple[Column, Column]:
    """SHA-1 and length of a payload."""
    raw = F.coalesce(payload, F.lit("")).cast("binary")
    return F.unhex(F.sha1(raw)), F.octet_length(raw)


def references(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """(id, payload's SHA-1 and length, refers_to) of the rows whose payload a row with a smaller id has too; digests alone are shuffled."""
    sha, n = _payload_key(pages[payload_col])
    facts = pages.where(n >= min_revisit).select(pages[id_col].alias("__id"), sha.alias("__sha"), n.alias("__n"))
    first = facts.groupBy("__sha", "__n").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")).where("__rows > 1").drop("__rows")
    return facts.join(first, ["__sha", "__n"]).where(~F.col("__id").eqNullSafe(F.col("__first")) & F.col("__first").isNotNull()).select("__id", "__sha", "__n", "__first").distinct()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record for each row; path becomes a folder of archives."""
    dictionary = train_dictionary(pages, payload_col)
    refs = references(pages, id_col, payload_col, min_revisit)
    rows = pages.select(pages[id_col].alias("__page"), pages[url_col].cast("string").alias("__url"), pages[payload_col].alias("__payload"))
    refs = T.stored(refs, "references")
    # payloads are shuffled only where a page of their id has a reference; rows without an id hash alike
    some, rest = T.sieves(rows.withColumn("__name", F.xxhash64("__page")), "__name", refs.select(F.xxhash64("__id").alias("name")))
    sha, n = _payload_key(F.col("__payload"))
    some = some.join(refs.hint("merge"), F.col("__page").eqNullSafe(F.col("__id")) & (sha == F.col("__sha")) & (n == F.col("__n")), "left").select("__page", "__url", "__payload", "__first")
    rows = some.unionByName(rest.select("__page", "__url", "__payload", F.lit(None).cast(refs.schema["__first"].dataType).alias("__first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        lead = dictionary_frame(dictionary)
        out, size = [lead], 0
        for batch in batches:
            for page, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                frame = packer.compress(build(page.as_py(), url.as_py(), (payload.as_py() or "").encode(), first.as_py()))
                out.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])
                    out, size = [lead], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    archives = rows.mapInArrow(T.tidy(run), "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_SKIP).option("encoding", "UTF-8").option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    T.discard(refs)


SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, record_id string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in a folder; a revisit's payload is null. Bad archives raise BadArchive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                unpacker = zstandard.ZstdDecompressor()
                for k, (magic, raw) in enumerate(frames(content.as_py())):
                    if magic == DICT_MAGIC and k:
                        raise BadArchive("a dictionary after the first frame")
                    if magic == DICT_MAGIC and raw:
                        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                    if magic != FRAME_MAGIC:
                        continue
                    head, payload = parse(unpacker.decompress(raw))
                    response = head["WARC-Type"] == "response"
                    ref = head.get("X-Refers-To-Page-ID")
                    rows.append((int(head["X-Page-ID"]) if head.get("X-Page-ID") else None, head.get("WARC-Target-URI", ""), head["WARC-Type"], int(head["http-length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(ref) if ref else None, payload if response and payloads else None, head["WARC-Record-ID"]))
                    held += len(payload) if payloads else 0
                    if held > 16 << 20 or len(rows) >= 4096:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(T.tidy(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Writes pages to archives in the shared folder and gives the records read back."""
    spark = pages.sparkSession
    path = T.scratch(spark, name)
    with T.storing(spark):
        write(pages, path)
    T.gone_at_exit(spark, path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
