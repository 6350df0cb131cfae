"""Deterministic sharded WARC writer and reader.

Records are sorted by page_id and payload digest and cut into segments at exact sums of
payload bytes, so the cuts depend on the records alone, not on a sample or on the
number of partitions. The task that has a segment writes gzip files (a member
per record) that it rolls by compressed size, with headers and digests made
anew; nothing in a file depends on the clock or the attempt. A file is written
under a temporary name and moved to its own when complete; the manifest, written
last and by Spark, lists the files that count. A lost task writes the same bytes
under the same name again. Readers open nothing but what the manifest lists, and
compare each file's length, digest and number of records with it.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes`` that
with the smallest page_id is a response, and the others revisit it.

Defined results: null html is an empty payload; a null url leaves its header out;
a null page_id is written as such, and never referred to by others; rows that
repeat a page_id and payload are all of the kind that page is, and stand in one segment;
a payload larger than a segment has one of its own; an empty table gives an empty
manifest and no page; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.shared import fresh_path, small, stored

ROLL_BYTES = 64 << 20
#: A segment has so many bytes of payloads, or more where there would be over MAX_SEGMENTS of them.
SEGMENT_BYTES, MAX_SEGMENTS = 8 << 20, 10_000
#: What a record's headers count for, so that tables of empty payloads are cut too.
HEADER_BYTES = 600
DATE = "2000-01-01T00:00:00Z"
#: Fixed value: the profile of revisits to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records bigint, bytes bigint, sha256 string, first_page bigint, last_page bigint"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}').urn}>"


def header_text(value: str) -> str:
    """Control characters and spaces would end a header: percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}",
             f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {header_text(url)}"] if url is not None else []),
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"X-Page: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def segment_starts(keys: DataFrame, segment_bytes: int, max_segments: int) -> list[bytes]:
    """The first key of each segment but the first, at most ``max_segments`` - 1,
    from ``keys`` (key, size).

    Keys are sorted by ranges; a key's place is what the ranges before its own hold,
    and the keys before it within its range. Where the ranges were cut makes no difference."""
    total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
    segment_bytes = max(segment_bytes, -(-total // max_segments))
    once = keys.groupBy("key").agg(F.sum("size").alias("size"))
    placed = stored(once.repartitionByRange("key").sortWithinPartitions("key").withColumn("r", F.spark_partition_id()), "warc-keys")
    sums = placed.groupBy("r").agg(F.sum("size").alias("s"))  # a row per range
    before = sums.select("r", F.coalesce(F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("r").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("before") + F.sum("size").over(inside) - F.col("size")
    cut = placed.join(before, "r").withColumn("at", at).groupBy(F.expr(f"at div {segment_bytes}").alias("segment")).agg(F.min("key").alias("key"))
    return sorted(r["key"].encode() for r in cut.collect())[1:]  # max_segments rows at most


def write(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES,
          max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``; its manifest."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # text in the order of page_id (null first) and digest
    number = F.lpad(F.hex(F.coalesce("page_id", F.lit(0).cast("long")).bitwiseXOR(F.lit(-1 << 63))), 16, "0")
    rows = rows.withColumn("key", F.concat(F.when(F.col("page_id").isNull(), "0").otherwise("1"), number, "sha"))
    keys = stored(rows.select("key", "page_id", "sha", F.octet_length("payload").cast("long").alias("size")), "warc-pages")
    groups = keys.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = small(stored(groups.where("n > 1").select(F.col("sha").alias("of"), "size", "least"), "copies"))
    starts = segment_starts(keys.select("key", (F.col("size") + HEADER_BYTES).alias("size")), segment_bytes, max_segments)
    cuts = np.array(starts, "S57")

    @F.pandas_udf("int")
    def segment(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype("S57"), side="right").astype(np.int32))

    rows = rows.withColumn("segment", segment("key"))
    rows = rows.join(groups, (F.col("sha") == F.col("of")) & (F.octet_length("payload") == F.col("size")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    rows = rows.select("segment", "page_id", "url", "payload", refers.alias("refers_to"), "key")
    rows = rows.repartitionById(len(starts) + 1, "segment").sortWithinPartitions("segment", "key", "url").drop("key")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(path)
        task = TaskContext.get()
        fs.create_dir(f"{top}/_temporary", recursive=True)
        out, n, at, listed = None, 0, None, []

        def close() -> None:
            nonlocal out
            out.close()
            fs.move(temporary, f"{top}/{name}")
            listed.append({"file": name, "records": count, "bytes": size, "sha256": digest.hexdigest(), "first_page": first, "last_page": last})
            out = None

        for batch in batches:
            for segment, page, url, payload, refers in zip(*batch.columns):
                page, segment = page.as_py(), segment.as_py()
                if segment != at:
                    if out is not None:
                        close()
                    at, n = segment, 0
                if out is None:
                    name = f"part-{segment:06d}-{n:06d}.warc.gz"
                    temporary = f"{top}/_temporary/{name}.{task.taskAttemptId()}"
                    out, n, count, size, digest, first = fs.open_output_stream(temporary), n + 1, 0, 0, hashlib.sha256(), page
                data = gzip.compress(record(page, url.as_py(), payload.as_py(), refers.as_py()), mtime=0)
                out.write(data)
                digest.update(data)
                count, size, last = count + 1, size + len(data), page
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        if listed:
            yield pa.RecordBatch.from_pylist(listed, schema=pa.schema([
                ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())]))

    rows.mapInArrow(save, MANIFEST).write.parquet(f"{path}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/_manifest")


class Digested:
    """A stream that keeps the length and the SHA-256 of what has been read."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.digest.update(data)
        return data


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    data, parts, d = stream.read(chunk), [], zlib.decompressobj(31)
    while data:
        parts.append(d.decompress(data))
        if d.eof:
            yield b"".join(parts)
            data, parts, d = d.unused_data or stream.read(chunk), [], zlib.decompressobj(31)
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("the file ends within a record")


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    got = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(got["Content-Length"])]
    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
    if base32_sha1(block) != got["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {got['WARC-Record-ID']} does not fit")
    size = int(got["X-Payload-Length"])
    if got["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest or len(payload) != size:
            raise ValueError(f"payload digest of {got['WARC-Record-ID']} does not fit")
    number = lambda x: int(x) if x else None
    return {"page_id": number(got["X-Page"]), "payload_bytes": size, "payload_digest": digest, "record_type": got["WARC-Type"],
            "refers_to": number(got.get("X-Refers-To-Page", "")), "url": got.get("WARC-Target-URI")}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files in the manifest under ``path``; the digests of files,
    blocks and payloads are checked, and the files' lengths and numbers of records."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    files = manifest.select("file", "records", "bytes", "sha256").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, records, size, sha in zip(*(c.to_pylist() for c in batch.columns)):
                rows, n = [], 0
                with fs.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    stream = Digested(stream)
                    for data in members(stream):
                        rows.append(parse(data))
                        n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if (n, stream.size, stream.digest.hexdigest()) != (records, size, sha):
                    raise ValueError(f"{file} is not the file that the manifest lists")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(load, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def archive(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages into the shared folder and read the archives back."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, roll_bytes)
    return read(pages.sparkSession, path).drop("url")
