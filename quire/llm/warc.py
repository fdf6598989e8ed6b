"""WARC archives written in key order by many tasks, and read back.

Every task writes whole archive files under temporary names, renames each when it is complete
and reports it; the reports become the manifest, committed by Spark as one table. Readers open
only files that the manifest names. Names, record ids, dates and compression depend on the rows
alone, so a repeated task writes the same bytes again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.operators.scale import hot_key_join, hot_keys

#: An archive file is closed once it holds this many compressed bytes.
ROLL_BYTES = 256 * 1024 * 1024
#: Payload bytes that one task writes, about.
TASK_BYTES = 64 * 1024 * 1024
#: Shorter payloads are stored each time, longer ones once.
REVISIT_BYTES = 1000
#: Leaders of equal payloads are broadcast up to this size and shuffled beyond.
BROADCAST_BYTES = 8 * 1024 * 1024
NAMESPACE = uuid.UUID("6d9c3e1c-6a38-5f2e-9d0b-0f8a4c2b7e11")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

MANIFEST = "file string, bytes bigint, records bigint, sha1 string"
RECORDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, payload binary, file string"
)


def file_system(location: str):
    """File system and path of a location, local or remote."""
    if "://" in location or location.startswith("file:"):
        return pafs.FileSystem.from_uri(location)
    return pafs.LocalFileSystem(), location


def decide_revisits(df: DataFrame, scratch: Scratch, key: str, url: str, html: str) -> DataFrame:
    """Rows (_id, _url, _payload, _bytes, _digest, _refers); only first copies keep a payload."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(
        F.col(key).cast("bigint").alias("_id"), F.col(url).alias("_url"), payload.alias("_payload"),
        F.octet_length(payload).cast("bigint").alias("_bytes"), F.sha1(payload).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    long = rows.filter(F.col("_bytes") >= REVISIT_BYTES)
    leaders = scratch.store(
        long.groupBy("_digest").agg(F.max("_id").alias("_leader"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_leader").isNotNull()), "leaders")
    n_leaders, n_copies = leaders.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).head()
    small = leaders.select("_digest", "_leader")
    if n_leaders * 64 <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(small), "_digest", "left")
    else:
        hot = hot_keys(long.select("_digest"), ["_digest"], n_copies)
        joined = hot_key_join(rows, small, ["_digest"], hot, F.col("_row"), "left")
    again = (
        (F.col("_bytes") >= REVISIT_BYTES) & F.col("_leader").isNotNull()
        & ~F.col("_id").eqNullSafe(F.col("_leader"))
    )
    return joined.withColumn("_refers", F.when(again, F.col("_leader"))).withColumn(
        "_payload", F.when(~again, F.col("_payload")))


def write_archives(
    df: DataFrame, location: str, key: str = "page_id", url: str = "url", html: str = "html",
    roll_bytes: int = ROLL_BYTES, task_bytes: int = TASK_BYTES, date: str = "2026-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row, in the order of the key; returns the committed manifest.

    The payload is the html in UTF-8, a null html an empty one. Of the rows with an equal payload of
    at least REVISIT_BYTES those with the largest key are responses, all others revisit them and
    hold no payload; rows without a key never lead others that have one. Repeated rows give
    repeated records. A null url leaves its header out. Other columns are not read. Ranges are
    drawn over key, digest and row, so no key or group of copies fills a task; memory holds one
    record and one compressed file part.
    """
    scratch = Scratch(df.sparkSession)
    rows = decide_revisits(df, scratch, key, url, html)
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(html))), F.lit(0))).head()[0]
    tasks = max(1, -(-total // task_bytes))
    ordered = rows.repartitionByRange(tasks, "_id", "_digest", "_row").withColumn(
        "_part", F.spark_partition_id()
    ).sortWithinPartitions("_id", "_digest", "_row")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Writer(location, roll_bytes, date)
        for batch in batches:
            for row in batch.itertuples(index=False):
                out.add(*row)
        out.close()
        yield pd.DataFrame(out.done, columns=["file", "bytes", "records", "sha1"])

    columns = ["_part", "_id", "_url", "_payload", "_bytes", "_digest", "_refers"]
    # Keys travel as text: a nullable integer column would pass through floating point.
    sent = ordered.select(*[F.col(c).cast("string") if c in ("_id", "_refers") else c for c in columns])
    sent.mapInPandas(write, MANIFEST).write.parquet(f"{location}/_manifest")
    scratch.drop()
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{location}/_manifest")


class Writer:
    """One task's archive files, in sequence."""

    def __init__(self, location: str, roll_bytes: int, date: str):
        self.fs, self.root = file_system(location)
        self.roll, self.date = roll_bytes, date
        self.done: list[tuple] = []
        self.stream = None
        self.fs.create_dir(f"{self.root}/_temporary")

    def open(self, part: int) -> None:
        self.name = f"warc-{part:07d}-{len(self.done):05d}.warc.gz"
        self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary)
        self.size = self.records = 0
        self.sha1 = hashlib.sha1()
        info = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
        self.put(self.head("warcinfo", f"info/{self.name}", len(info), ["Content-Type: application/warc-fields"]), info)

    def head(self, kind: str, name: str, length: int, more: list[str]) -> bytes:
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(name)}",
                 f"WARC-Date: {self.date}", *more, f"Content-Length: {length}"]
        return ("\r\n".join(lines) + "\r\n\r\n").encode()

    def put(self, *parts: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        for piece in [*[pack.compress(p) for p in (*parts, b"\r\n\r\n")], pack.flush()]:
            self.stream.write(piece)
            self.sha1.update(piece)
            self.size += len(piece)

    def add(self, part, key, url, payload, length, digest, refers) -> None:
        if self.stream is None:
            self.open(part)
        revisit = refers is not None
        more = [] if url is None else [f"WARC-Target-URI: {header_value(url)}"]
        more += [] if key is None else [f"Page-Id: {key}"]
        more.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
        more.append(f"Payload-Length: {length}")
        name = f"page/{key}/{digest}"
        if revisit:
            more += [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: {record_id(f'page/{refers}/{digest}')}", f"Refers-To-Page: {refers}",
            ]
        else:
            block = (HTTP.format(length).encode(), payload)
            whole = hashlib.sha1(block[0])
            whole.update(payload)
            more.append(f"WARC-Block-Digest: sha1:{base64.b32encode(whole.digest()).decode()}")
            more.append("Content-Type: application/http; msgtype=response")
        body = () if revisit else block
        self.put(self.head("revisit" if revisit else "response", name, sum(map(len, body)), more), *body)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.done.append((self.name, self.size, self.records, self.sha1.hexdigest()))
        self.stream = None


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def header_value(value: str) -> str:
    """Control characters would end a header line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


class Hashed:
    """A stream that hashes and counts what is read from it."""

    def __init__(self, stream):
        self.stream, self.sha1, self.size = stream, hashlib.sha1(), 0

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.sha1.update(data)
        self.size += len(data)
        return data


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one gzip member each."""
    data = stream.read(block)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(block)):
                raise ValueError("an archive ends inside a record")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)
        data = data or stream.read(block)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body):] != b"\r\n\r\n":
        raise ValueError("a record has not the length that its header states")
    return fields, body


def read_archives(spark: SparkSession, location: str, payloads: bool = False) -> DataFrame:
    """Records of all files in the manifest; digests and lengths are computed from the payloads.

    A file whose size or digest differs from the manifest, or a payload that differs from its
    header, ends the job. Payloads of revisits are null; so are all without ``payloads``.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{location}/_manifest")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(location)
        for batch in batches:
            for entry in batch.itertuples(index=False):
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{entry.file}", compression=None) as opened:
                    stream = Hashed(opened)
                    for record in members(stream):
                        row = record_row(record, entry.file, payloads)
                        if row is not None:
                            rows.append(row)
                            held += len(row[6] or b"") + 200
                        if held > 1 << 24:
                            yield frame(rows)
                            rows, held = [], 0
                if (stream.size, stream.sha1.hexdigest()) != (entry.bytes, entry.sha1):
                    raise ValueError(f"{entry.file} differs from the manifest")
                yield frame(rows)

    many = max(1, manifest.count())
    return manifest.repartition(many, "file").mapInPandas(read, RECORDS)


def record_row(record: bytes, file: str, payloads: bool) -> tuple | None:
    fields, body = parse_record(record)
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    length, payload = int(fields["Payload-Length"]), None
    if kind == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != stated or len(payload) != length:
            raise ValueError(f"a payload in {file} differs from its header")
    page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page")
    return (page, fields.get("WARC-Target-URI"), length, stated, kind, refers,
            payload if payloads else None, file)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    for name in ("page_id", "refers_to"):
        out[name] = pd.array([None if v is None else int(v) for v in out[name]], dtype="Int64")
    return out


def archive_report(df: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back and describe every record."""
    scratch = Scratch(df.sparkSession)
    location = scratch.path("archives")
    write_archives(df, location)
    return read_archives(df.sparkSession, location).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
