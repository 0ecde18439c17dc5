"""Deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.base import prepare, scaled_partitions, whole
from cartlens.operators.ranks import RANGES, running_total
from cartlens.session import cut_lineage

FILE_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
# Every record carries this date unless the caller has another.
RECORD_DATE = "2020-01-01T00:00:00Z"
# Keys summed by one task.
_RANGE_ROWS = 5_000_000
_LEVEL = 6
_READ_BYTES = 1 << 20


# --- which record is what ------------------------------------------------------


def _key():
    """Place of a page in the archive: its id, or a hash where it has none."""
    return F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url", whole("html"))).alias("key")


def revisits(pages: DataFrame, least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``key, page_id, same, refers_to, refers_url`` of the pages that revisit another.

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is a response and the others revisit
    it. Only digests are shuffled, and copies combine before that. Null html is an empty payload. Pages without
    an id never stand for others unless all are without; rows that repeat the response's id are responses too.
    """
    facts = pages.select(
        _key(), "page_id", "url", F.sha2(whole("html"), 256).alias("same"), F.octet_length(whole("html")).alias("bytes")
    ).where(F.col("bytes") >= least_bytes)
    first = facts.groupBy("same").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first"), F.count("*").alias("n")
    )
    first = first.where("n > 1").select(
        "same", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")
    )
    met = facts.join(first, "same").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return met.select("key", "page_id", "same", "refers_to", "refers_url").distinct()


# --- one record -------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """The address without characters that would end a header line; an unnamed page gets ``about:blank``."""
    return urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "about:blank"


def record(page_id: int | str | None, url: str | None, payload: bytes, kind: str, refers_to: int | str | None = None,
           refers_url: str | None = None, date: str = RECORD_DATE) -> bytes:
    """Bytes of one WARC 1.1 record, the same for the same page wherever it is written."""
    digest = payload_digest(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    name = f"{page_id} {_uri(url)} {digest}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {_uri(refers_url)}",
            f"WARC-Refers-To-Date: {date}",
            f"Page-Refers-To: {refers_to}",
        ]
    lines += [
        *([] if page_id is None else [f"Page-ID: {page_id}"]),
        f"Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    job = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return job.compress(data) + job.flush()


# --- shards -----------------------------------------------------------------------


def shard_bounds(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """Keys at which a new shard starts, from the sizes alone: ``key, bytes`` give the same bounds in any layout.

    A key belongs to the shard its bytes begin in, counted from the smallest key on. The running sum is taken in
    ranges of keys, in a number of jobs that does not depend on the number of shards; the driver gets a number
    per shard.
    """
    keys = rows.groupBy("key").agg(F.sum("bytes").alias("bytes"))
    ranges = max(RANGES, -(-rows.count() // _RANGE_ROWS))
    begins = F.floor((F.col("running") - F.col("bytes")) / F.lit(shard_bytes))
    firsts = running_total(keys, "key", "bytes", ranges).groupBy(begins.alias("shard")).agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in firsts.collect())


class Store:
    """Files of a folder that Spark names by a URI, for tasks on any machine."""

    def __init__(self, folder: str):
        from pyarrow import fs

        if folder.startswith("file:"):
            folder = urllib.parse.urlsplit(folder).path
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return posixpath.join(self.root, name)

    def commit(self, temporary: str, name: str) -> None:
        """Give a finished file its name; a file a lost attempt left there holds the same bytes."""
        from pyarrow import fs

        if self.files.get_file_info(self.path(name)).type != fs.FileType.NotFound and self.files.type_name != "local":
            self.files.delete_file(self.path(name))
        self.files.move(self.path(temporary), self.path(name))


class _Roll:
    """Files of one shard, a new one when the next record would pass the size."""

    def __init__(self, store: Store, shard: int, file_bytes: int, attempt: str, opening: bytes):
        self.store, self.shard, self.limit, self.attempt, self.opening = store, shard, file_bytes, attempt, opening
        self.number, self.stream, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.stream is not None and self.size + len(data) > self.limit:
            self.close()
        if self.stream is None:
            self.name = f"shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temporary = f"{self.name}.{self.attempt}.tmp"
            self.stream = self.store.files.open_output_stream(self.store.path(self.temporary))
            self.size = self.records = 0
            self.hash = hashlib.sha256()
            self._put(self.opening)
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.store.commit(self.temporary, self.name)
            self.done.append((self.name, self.shard, self.records, self.size, self.hash.hexdigest()))
            self.number, self.stream = self.number + 1, None


_MANIFEST = ["file", "shard", "records", "bytes", "sha256"]


def _write(found: Iterator[pd.DataFrame], folder: str, file_bytes: int, date: str) -> Iterator[pd.DataFrame]:
    store = Store(folder)
    context = TaskContext.get()
    attempt = f"{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}" if context else uuid.uuid4().hex
    info = packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>\r\n"
                  f"WARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())  # fmt: skip
    roll, known, done = None, None, []
    for pdf in found:
        for row in pdf.itertuples(index=False):
            if row.payload is not None and (roll is None or roll.shard != row.shard):
                if roll:
                    roll.close()
                    done += roll.done
                roll = _Roll(store, row.shard, file_bytes, attempt, info)
            if row.payload is None:  # what the next rows with this key and payload revisit
                known = row
                continue
            again = known is not None and (known.key, known.same) == (row.key, row.same)
            data = packed(record(
                row.page_id, row.url, row.payload.encode(), "revisit" if again else "response",
                known.refers_to if again else None, known.refers_url if again else None, date,
            ))
            roll.add(data)
    if roll:
        roll.close()
        done += roll.done
    yield pd.DataFrame(done, columns=_MANIFEST)


def write_warc(pages: DataFrame, folder: str, least_bytes: int = MIN_REVISIT_BYTES, shard_bytes: int = SHARD_BYTES,
               file_bytes: int = FILE_BYTES, date: str = RECORD_DATE) -> DataFrame:
    """Write a record for each of ``page_id, url, html`` and give the manifest ``file, shard, records, bytes, sha256``.

    Records are ordered by page_id over all shards (pages without one by a hash of address and payload). Which
    record stands in which file depends on the rows alone, not on their layout or the cluster. Each file is
    written under a temporary name with its attempt and renamed when whole; a file counts once the manifest
    names it, which is written last, as Parquet in ``manifest`` beside the files. ``folder`` is one all executors
    share. No rows give an empty manifest.
    """
    spark = pages.sparkSession
    sizes = pages.select(_key(), (F.octet_length(whole("html")) + 600).cast("long").alias("bytes"))
    sizes = cut_lineage(sizes, "page-sizes")
    bounds = shard_bounds(sizes, shard_bytes)
    parts = max(1, len(bounds))
    # One number per shard.
    sent = spark.sparkContext.broadcast(np.array(bounds[1:], np.int64))

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, key.to_numpy(), side="right"))

    # Payloads and what is known about them go to a shard's task together, in one shuffle; of one key and
    # payload the knowledge (without a payload) comes first.
    body = whole("html")
    rows = pages.select(_key(), "page_id", "url", F.sha2(body, 256).alias("same"), body.alias("payload"))
    rows = rows.unionByName(revisits(pages, least_bytes), allowMissingColumns=True)
    rows = rows.withColumn("shard", shard("key")).repartitionById(parts, "shard")  # one task a shard
    rows = rows.sortWithinPartitions("shard", "key", "page_id", "same", F.col("payload").isNotNull(), "url")
    # As text: pandas would turn numbers among nulls into floats, which round ids above 2^53.
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    columns = "file string, shard int, records long, bytes long, sha256 string"
    out = rows.mapInPandas(lambda found: _write(found, folder, file_bytes, date), columns)
    manifest = posixpath.join(folder, "manifest")
    out.write.mode("overwrite").parquet(manifest)
    return spark.read.schema(columns).parquet(manifest)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped WARC stream, one in memory at a time."""
    buffer, job = bytearray(), zlib.decompressobj(31)
    at_end = False
    rest = b""
    while True:
        cut = buffer.find(b"\r\n\r\n")
        length = None
        if cut >= 0:
            lines = bytes(buffer[:cut]).decode().split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(headers["content-length"])
        if length is not None and len(buffer) >= cut + 4 + length + 4:
            yield headers, bytes(buffer[cut + 4 : cut + 4 + length])
            del buffer[: cut + 4 + length + 4]
            continue
        if at_end:
            if buffer:
                raise ValueError("a record is cut off")
            return
        data = rest or stream.read(_READ_BYTES)
        rest = b""
        if not data:
            at_end = True
            continue
        buffer += job.decompress(data)
        if job.eof:
            rest, job = job.unused_data, zlib.decompressobj(31)


def _read(found: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    store = Store(folder)
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    for pdf in found:
        for name in pdf["file"]:
            rows = []
            with store.files.open_input_stream(store.path(name), compression=None) as stream:
                for head, block in read_records(stream):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if f"sha1:{payload_digest(block)}" != head["warc-block-digest"]:
                        raise ValueError(f"{name}: block digest differs")
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{name}: payload digest differs")
                    refers = head.get("page-refers-to")
                    rows.append((
                        int(head["page-id"]) if "page-id" in head else None, head["warc-target-uri"],
                        int(head["payload-length"]), digest, kind,
                        None if refers in (None, "None") else int(refers), payload if kind == "response" else None,
                    ))
                    if len(rows) >= 256:
                        yield _frame(rows, columns)
                        rows = []
            if rows:
                yield _frame(rows, columns)


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    # Ids among nulls as objects first, not as floats, which round those above 2^53.
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_warc(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of all records in a manifest.

    Digests are checked; a revisit has no payload of its own (null).
    """
    prepare(spark)
    files = manifest.select("file").repartition(scaled_partitions(spark, 1, 1), "file")
    return files.mapInPandas(
        lambda found: _read(found, folder),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )
