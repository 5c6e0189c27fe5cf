"""Web archives with revisit records.

What is shuffled by payload digest are headers: digests, the smallest page id of each in a partition of the pages, and
that partition's number. Every partition gets the originals of its own digests as a small table in the shared folder,
and its task, which holds the payloads, writes archives of one gzip member per record. Payloads are never shuffled. A
revisit has no payload: it has fresh headers that name the response. Readers resolve revisits by a join on the digest.

Archives are written through pyarrow's file systems into the shared folder, under names of task attempts; a manifest
that Spark commits names those that count, so a lost or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import shared_path, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload; null html is the empty payload."""
    return pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))


def originals(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """part, sha1, original_id, owner: for each partition of pages, its distinct digests of payloads of at least so many bytes.

    original_id is the smallest page_id with that payload in all pages (null if all are null), owner marks the one
    partition whose row is the response that revisits name.
    """
    rows = payloads(pages).filter(F.length("payload") >= min_payload_bytes)
    per = rows.groupBy(F.sha1("payload").alias("sha1"), F.spark_partition_id().alias("part")).agg(F.min("page_id").alias("low"))
    # A digest has a row per partition at most, however many pages share it.
    first = F.min(F.when(F.col("low").isNotNull(), F.struct("low", "part"))).over(Window.partitionBy("sha1"))
    return per.withColumn("first", first).select("part", "sha1", F.col("first.low").alias("original_id"), F.coalesce(F.col("first.part") == F.col("part"), F.lit(False)).alias("owner"))


def record_id(page_id, sha: str, copy: str = "") -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{sha}{':' if copy else ''}{copy}>"


def record(page_id, url, payload: bytes, original, date: str, copy: str = "") -> bytes:
    """One WARC/1.1 record; a page that isn't its payload's original is a revisit without a payload. copy tells apart records that are no revisit's response."""
    sha = digest(payload)
    revisit = original is not None and original != page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha, copy)}", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(original, sha)}"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


@contextmanager
def equal_partitions(spark) -> Iterator[None]:
    """Files are cut into the same partitions at each reading, also if executors come or go in between.

    Without the setting the cut follows the cores that are registered when a job is planned.
    """
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def write_archives(pages: DataFrame, folder: str, min_payload_bytes: int = 0, archive_bytes: int = 64 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Writes archives of about archive_bytes compressed bytes at most; returns the manifest: path, n_records.

    pages is read twice and must come in the same partitions both times, as tables that are read from files do; a row
    that the first reading didn't see in its partition ends the job with an error.
    """
    with equal_partitions(pages.sparkSession):
        return _write_archives(pages, folder, min_payload_bytes, archive_bytes, level, date)


def _write_archives(pages: DataFrame, folder: str, min_payload_bytes: int, archive_bytes: int, level: int, date: str | None) -> DataFrame:
    known_at = f"{folder}-originals"
    originals(pages, min_payload_bytes).repartition("part").write.partitionBy("part").parquet(known_at)
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, done = TaskContext.get().partitionId(), []
        stem = f"{root}/{part:06d}-{uuid.uuid4().hex[:12]}"
        where, known = f"{FileSystem.from_uri(known_at)[1]}/part={part}", {}
        if fs.get_file_info(where).type == FileType.Directory:
            own = pq.read_table(where, columns=["sha1", "original_id", "owner"], filesystem=fs, partitioning=None)
            known = {s: (o, w) for s, o, w in zip(*(c.to_pylist() for c in own.columns))}  # as many as the partition has digests
        named, out, size, n, seen = set(), None, 0, 0, 0
        for batch in batches:
            for page_id, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if out is None:
                    path, size, n = f"{stem}-{len(done):05d}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                body, original, owner = payload.as_py(), None, False
                if len(body) >= min_payload_bytes:
                    sha = hashlib.sha1(body).hexdigest()
                    if sha not in known:
                        raise ValueError(f"partition {part} of the pages changed between two readings")
                    original, owner = known[sha]
                    owner = owner and page_id == original and sha not in named
                    named.update([sha] if owner else [])
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = press.compress(record(page_id, url, body, original, date, "" if owner else f"{part}.{seen}")) + press.flush()
                out.write(data)
                size, n, seen = size + len(data), n + 1, seen + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_records"])

    # The manifest is written at once: its rows come from the attempts that Spark counts.
    return written(payloads(pages).mapInArrow(write, "path string, n_records long"), "warc-manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record of a gzip stream of records."""
    press, data = zlib.decompressobj(31), bytearray()
    while chunk := stream.read(1 << 18):
        while chunk:
            data += press.decompress(chunk)
            chunk = press.unused_data
            if press.eof:
                head, _, rest = bytes(data).partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
                yield fields, rest[: int(fields["content-length"])]
                press, data = zlib.decompressobj(31), bytearray()


def read_headers(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives of a manifest; payload_bytes is null for revisits."""

    def number(urn: str | None) -> int | None:
        own = urn.split(":")[2] if urn else ""
        return int(own) if own else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, payload in records(stream):
                        revisit = head["warc-type"] == "revisit"
                        sha = head["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != sha:
                            raise ValueError(f"damaged payload in {path}: {head['warc-record-id']}")
                        rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], None if revisit else len(payload), sha, number(head.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(parts).mapInArrow(read, HEADERS)


def resolve(headers: DataFrame) -> DataFrame:
    """Revisits get the payload_bytes of the response with their digest."""
    held = headers.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("held_bytes"))
    # The size of what Python reads from archives can't be estimated, so the join must not become a broadcast. Rows are
    # headers; Spark splits the partition of a digest that very many of them share.
    return headers.join(held.hint("merge"), "payload_digest", "left").select("page_id", "url", F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive_round_trip(pages: DataFrame, min_payload_bytes: int = 0, is_table: bool = False) -> DataFrame:
    """Writes deduplicated archives of all pages and reads them back, revisits resolved.

    Pages that don't come straight from files (is_table) are written to the shared folder first, as they are read twice.
    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to: one row per row of pages.
    Null html is an empty payload; rows that repeat a page_id with an equal payload are all responses or all revisits;
    a null page_id is never an original unless no equal payload has an id, and is then a response; an empty table
    gives no rows. Columns other than page_id, url and html are ignored. Every record has an id of its own.
    """
    folder = shared_path(pages.sparkSession, "warc")
    pages = pages.select("page_id", "url", "html")
    manifest = write_archives(pages if is_table else written(pages, "warc-pages"), folder, min_payload_bytes)
    return resolve(read_headers(manifest, folder))
