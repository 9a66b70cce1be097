"""WARC archives compressed record by record with a Zstandard dictionary, written and read by Spark tasks.

Each archive starts with a skippable frame that holds the dictionary its own records trained; each record is
one frame after it, so a reader can start at any record. Payloads that repeat are archived once, by the
largest id, and the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem as _filesystem
from .shared import new_path, saved, sent_if_small, slices

#: Magic number of the skippable frame that holds a dictionary (first of the format's sixteen).
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records that train an archive's dictionary at most, and the dictionary's size.
TRAINING_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
#: Uncompressed bytes of records after which a task starts its next archive.
ARCHIVE_BYTES = 32 << 20
#: Digests that repeat are sent to all tasks up to this many (some 40 bytes each); more meet the pages in a join, where
#: the pages of one digest spread over so many keys.
SENT_DIGESTS, SALTS = 500_000, 64
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, sha: str, refers_to, date: str = DATE) -> bytes:
    """A response record, or a revisit of refers_to, which has the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, its HTTP head and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """One archive of these records."""
    import zstandard as z

    samples, total = [], 0
    for r in records[:: max(1, len(records) * (sum(map(len, records)) // max(1, len(records))) // TRAINING_BYTES)]:
        if total + len(r) > TRAINING_BYTES:
            break
        samples.append(r)
        total += len(r)
    try:
        dictionary = z.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples)
    except z.ZstdError:  # too little to train on: the samples themselves serve as raw content
        dictionary = z.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=z.DICT_TYPE_RAWCONTENT)
    packed = z.ZstdCompressor(level=1).compress(dictionary.as_bytes())
    compressor = z.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed + b"".join(map(compressor.compress, records))


def unarchived(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard as z

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive lacks its dictionary frame")
    dictionary = z.ZstdCompressionDict(z.ZstdDecompressor().decompress(data[8 : 8 + size]))
    reader = z.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        frame = reader.decompressobj()
        yield frame.decompress(rest)
        rest = memoryview(frame.unused_data)


def resolved(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest id with the same payload, null for that one.

    Pages stay where they are read unless very many digests repeat; one digest's pages are never one task's.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    repeated = saved(own.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    sent = sent_if_small(repeated, SENT_DIGESTS)
    if sent is repeated:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(repeated.withColumn("salt", salts), ["sha", "salt"], "left")
    else:
        joined = own.join(sent, "sha", "left")
    other: Column = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last"))
    # In a fixed order, so that a retried task makes the same archives again.
    return joined.select("page_id", "url", "html", other.alias("refers_to"), "sha").sortWithinPartitions("page_id", "sha", "url").drop("sha")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, level: int = LEVEL) -> DataFrame:
    """Write the pages to archives in folder, a URI of shared storage; returns (path, records, bytes), computed when read.

    A task writes an archive under a name of its attempt and then renames it to one of its partition, so a
    retried or speculative task replaces its own archives and adds none. Null html is an empty payload, a null
    url a urn; repeated rows make a record each; an empty table writes no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _filesystem(folder)
        context, count = TaskContext.get(), 0
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        records: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal count, total
            data, name = archive(records, level), f"{root}/part-{partition:06d}-{count:05d}.warc.zst"
            with filesystem.open_output_stream(f"{root}/.{partition}-{count}-{attempt}.tmp") as out:
                out.write(data)
            filesystem.move(f"{root}/.{partition}-{count}-{attempt}.tmp", name)
            done = pa.RecordBatch.from_pydict({"path": [name], "records": [len(records)], "bytes": [len(data)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            records.clear()
            count, total = count + 1, 0
            return done

        for whole in batches:
            for batch in slices(whole, "html"):
                for page_id, url, text, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = text.encode()
                    records.append(record(page_id, url, payload, digest(payload), refers_to))
                    total += len(records[-1])
                    if total >= ARCHIVE_BYTES:
                        yield close()
        if records:
            yield close()

    filesystem, root = _filesystem(folder)
    filesystem.create_dir(root, recursive=True)
    return resolved(pages, id_col, url_col, html_col, least_bytes).mapInArrow(run, "path string, records long, bytes long")


def read(spark: SparkSession, folder: str, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """Every record of the archives in folder: page_id, uri, payload_digest, record_type, refers_to, head_bytes (the payload's length by its HTTP head), checked (digest and length found right, null for revisits)."""
    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def convert(v: str | None):
            return v if v is None or id_type == "string" else int(v) if v else None

        for whole in batches:
            for data in whole.column("content"):
                rows = []
                for one in unarchived(data.as_buffer()):
                    fields, http, payload = parsed(one)
                    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r")[0])
                    sha, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                    rows.append((convert(fields["X-Page-ID"]), fields["WARC-Target-URI"], sha, fields["WARC-Type"], convert(fields.get("X-Refers-To-Page-ID")), length, digest(payload) == sha and len(payload) == length if response else None, payload if with_payload else None))
                names = ["page_id", "uri", "payload_digest", "record_type", "refers_to", "head_bytes", "checked", "payload"]
                types = [kind, pa.string(), pa.string(), pa.string(), kind, pa.int64(), pa.bool_(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                keep = len(names) - (not with_payload)
                yield pa.RecordBatch.from_arrays(columns[:keep], names=names[:keep])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, f"page_id {id_type}, uri string, payload_digest string, record_type string, refers_to {id_type}, head_bytes long, checked boolean" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = pages.sparkSession, new_path(pages.sparkSession, "warc")
    written = write(pages, folder, id_col, url_col, html_col, least_bytes).agg(F.sum("records")).first()[0]
    kind = pages.schema[id_col].dataType.simpleString()
    if not written:
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    checked = F.when(~F.col("checked"), F.raise_error("a payload differs from its digest")).otherwise(F.col("head_bytes"))
    return read(spark, folder, kind).select("page_id", checked.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
