"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id (and payload digest, so that rows of one id can be spread too), each range of
about ``SHARD_BYTES`` of payload is written by one task in order, and a task rolls to the next file when the
compressed size passes ``ROLL_BYTES``, some times a range. A file is written under a temporary name of
its attempt and renamed when whole; names and contents depend on the records alone (headers, record
ids and digests are made anew from them, dates come from a parameter), so a task that is run again
after a lost executor replaces its files with the same bytes. The manifest, a table of file names,
record counts, sizes and SHA-256, is written last: readers open what it lists and nothing else, and fail
on a file whose bytes, records or digest differ from it.

Of records with equal payloads (SHA-1 and length) of at least ``least`` bytes, that with the largest id
holds the payload (response); the others are revisits that refer to it and keep only headers.

Defined results: a null payload is empty, a null address gets a urn of the record. Rows with a null id
are written and read back with a null id, after all others; of equal payloads that all have null ids,
each is a response. Rows repeated with one id are written each on its own, typed by its own payload: those
that hold the payload of the response of that id are responses too. An empty table gives no files and an empty
manifest. Of extra columns none is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .sparkutil import blocks, shared_dir, small_batches, written

ROLL_BYTES, SHARD_BYTES = 64 << 20, 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record {key}')}>"


def _address(url: str | None, key: object) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:record:{key}"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("WARC-Target-URI", _address(url, key)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if key is not None:
        headers.append(("X-Source-Id", str(key)))
    if refers_to is None:
        return _record("response", headers, http + payload)
    headers += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Id", str(refers_to)), ("WARC-Profile", PROFILE)]
    return _record("revisit", headers, http)


def _store(path: str):
    """(file system, path in it) of a folder named by path or URI; any scheme that Arrow opens."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


class Roller:
    """Writes gzip members to files of a folder and rolls by compressed size."""

    def __init__(self, folder: str, part: int, attempt: str, roll: int, date: str):
        self.fs, self.folder = _store(folder)
        self.part, self.attempt, self.roll, self.date = part, attempt, roll, date
        self.seq, self.out = 0, None

    def _open(self) -> None:
        self.name = f"part-{self.part:06d}-{self.seq:06d}.warc.gz"
        self.temp = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
        self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.put(_record("warcinfo", [("WARC-Record-ID", record_id(f"info {self.name}")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def put(self, raw: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = z.compress(raw) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1

    def add(self, raw: bytes) -> Iterator[tuple[str, int, int, str]]:
        if self.out is None:
            self._open()
        self.put(raw)
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple[str, int, int, str]:
        self.out.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        self.out = None
        self.seq += 1
        return self.name, self.records, self.size, self.sha.hexdigest()


def _keyed(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.unhex(F.sha1(body.cast("binary"))).alias("sha"), F.octet_length(body).alias("size"), F.col(f"`{url}`").alias("url"), body.alias("payload"))


def revisits(df: DataFrame, least: int = 0, key: str = "page_id", payload: str = "html") -> tuple[DataFrame, DataFrame]:
    """((key, sha, size, refers_to) of revisits, (sha, size, best) of payloads that occur more than once).

    Only digests are shuffled; refers_to is the largest id of the same payload.
    """
    rows = _keyed(df, key, key, payload).select("key", "sha", "size")
    best = rows.groupBy("sha", "size").agg(F.max("key").alias("best"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("best").isNotNull() & (F.col("size") >= least)).drop("n")
    return rows.where("key is not null").join(best, ["sha", "size"]).where("key <> best").select("key", "sha", "size", F.col("best").alias("refers_to")).distinct(), best


def write(df: DataFrame, folder: str, least: int = 0, roll: int = ROLL_BYTES, date: str = DATE, shard: int = SHARD_BYTES, **columns: str) -> DataFrame:
    """Writes the archives of df to a new folder and returns the manifest (file, records, bytes, sha256)."""
    spark = df.sparkSession
    small_batches(spark)
    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)
    names = {"key": "page_id", "url": "url", "payload": "html"} | columns
    shards = blocks(df, F.octet_length(F.col(f"`{names['payload']}`")), shard)
    pages = _keyed(df, **names)
    marks, best = revisits(df, least, names["key"], names["payload"])
    marks = written(marks, "revisits")
    # rows without an id carry their reference themselves; all others meet a mark of their id and digest in the same range
    bare = pages.where("key is null").join(best, ["sha", "size"], "left").withColumnRenamed("best", "refers_to")
    rows = pages.where("key is not null").withColumn("refers_to", F.lit(None).cast("long")).unionByName(bare).withColumn("kind", F.lit(1)).unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    place = [F.col("key").asc_nulls_last(), F.col("sha"), F.col("size")]
    rows = rows.select("key", "url", "payload", "refers_to", "kind", "sha", "size").repartitionByRange(shards, *place).sortWithinPartitions(*place, "kind", "url").drop("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = Roller(folder, task.partitionId(), f"{task.taskAttemptId()}", roll, date)
        done, marked, target = [], None, None
        for batch in batches:
            for key, url, payload, refers, kind, sha in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if not kind:
                    marked, target = (key, sha), refers
                    continue
                if key is not None:
                    refers = target if (key, sha) == marked else None
                done += out.add(page_record(key, url, payload.encode("utf-8", "surrogatepass"), refers, date))
        if out.out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha256"])

    manifest = written(rows.mapInArrow(run, "file string, records long, bytes long, sha256 string"), "manifest")
    manifest.coalesce(1).write.parquet(f"{folder}/_manifest")
    return manifest


class Checked:
    """A stream that counts and digests what is read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sha.update(data)
        return data


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(z.decompress(data))
            if not z.eof:
                break
            data = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; checks its length and block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if headers.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {headers.get('WARC-Record-ID')} does not match")
    return headers, block


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each response or revisit in the files that the manifest lists.

    Columns page_id, url, record_type, payload_bytes, payload_digest, refers_to and, with ``payloads``,
    payload (binary, null for revisits).
    """
    manifest = spark.read.parquet(f"{folder}/_manifest").select("file", "records", "bytes", "sha256")
    fields = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in fields.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _store(folder)
        for batch in batches:
            for file, records, length, sha256 in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows: list[tuple] = []
                size = seen = 0
                with fs.open_input_stream(f"{at}/{file}", compression=None) as source:
                    stream = Checked(source)
                    for raw in members(stream):
                        h, block = parse(raw)
                        if h["WARC-Type"] not in ("response", "revisit"):
                            continue
                        seen += 1
                        http, _, body = block.partition(b"\r\n\r\n")
                        n = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
                        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (len(body) != n or digest(body) != sha):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                        key, refers = h.get("X-Source-Id"), h.get("X-Refers-To-Id")
                        row = (key and int(key), h["WARC-Target-URI"], h["WARC-Type"], n, sha, refers and int(refers))
                        rows.append((*row, body if h["WARC-Type"] == "response" else None) if payloads else row)
                        size += len(body)
                        if len(rows) >= 10_000 or payloads and size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if (stream.size, stream.sha.hexdigest(), seen) != (length, sha256, records):
                    raise ValueError(f"{file} is not the file of the manifest: {stream.size} bytes for {length}, {seen} records for {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = manifest.count()
    return manifest.repartition(max(1, files), "file").mapInArrow(run, fields)


def round_trip(df: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Writes df's archives to a folder of the shared place and reads them back, without payloads."""
    folder = f"{shared_dir(df.sparkSession)}/loomery-warc-{uuid.uuid4().hex}"
    write(df, folder, least, **columns)
    return read(df.sparkSession, folder, payloads=False)
