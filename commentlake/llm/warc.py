"""WARC archives: a deterministic sharded writer, and a reader.

Pages are dealt into shards at fixed cuts of the id range and sorted inside a
shard, so the same table always gives the same archives, whatever the cluster.
A task streams its shard record by record, each as a gzip member of its own, and
starts a new file when the compressed size passes a limit. Headers and digests
are made anew from the payload. Files are written under temporary names; the
driver renames those of accepted attempts and names them in a manifest, which is
itself renamed into place last: an archive without a manifest does not exist.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.llm.common import staged
from commentlake.session import work_dir

ROLL_BYTES, SHARD_BYTES, LEVEL = 256 << 20, 32 << 20, 6
#: Steps of the id range that shard cuts are chosen from; what the driver holds of them is this many rows at most.
STEPS = 1 << 14
#: A payload of fewer bytes is always a response of its own.
LEAST_REVISIT = 0
DATE = "2000-01-01T00:00:00Z"  # of the archive format, not of the run: runs have to agree
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs
MANIFEST = "manifest.json"

WRITTEN = "shard int, number int, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


# ---- records ----------------------------------------------------------------
def record_id(page_id: int | None, digest: str, nth: int) -> str:
    """The id of a page's record: its nth one with this payload."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}:{nth}')}>"


def _header(value: str) -> str:
    """A value on one line: line ends would start another header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, nth: int, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit keeps the response's headers but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    lines += [] if url is None else [f"WARC-Target-URI: {_header(url)}"]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest, 0)}",  # a response is the first with its payload
        ]
        lines += [] if refers_to is None else [f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to, url, payload); digests and references are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    at = _fields(head)
    block = rest[: int(at["content-length"])]
    if "sha1:" + base32_sha1(block) != at["warc-block-digest"]:
        raise ValueError(f"block digest of {at['warc-record-id']} does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    digest = at["warc-payload-digest"].removeprefix("sha1:")
    page_id = int(at["x-page-id"]) if "x-page-id" in at else None
    if at["warc-type"] == "revisit":
        to = int(at["x-refers-to-page-id"]) if "x-refers-to-page-id" in at else None
        if at["warc-refers-to"] != record_id(to, digest, 0):
            raise ValueError(f"{at['warc-record-id']} refers to another payload")
        return page_id, size, digest, "revisit", to, at.get("warc-target-uri"), None
    if len(payload) != size or base32_sha1(payload) != digest:
        raise ValueError(f"payload digest of {at['warc-record-id']} does not match")
    return page_id, size, digest, "response", None, at.get("warc-target-uri"), payload


# ---- planning ---------------------------------------------------------------
def with_shard(rows: DataFrame, sizes: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``rows`` with the shard of their page_id; ``sizes`` has (page_id, size) of every page.

    A shard is a run of steps of the id range that together hold ``shard_bytes``
    or more. The driver sees one row per step, ``STEPS`` at most, and the table
    that goes back out has as many. Null ids are in the first shard.
    """
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return rows.withColumn("shard", F.lit(0))
    width = max(1, -(-(high - low + 1) // STEPS))
    step = F.floor((F.col("page_id") - F.lit(low)) / F.lit(width)).cast("long").alias("step")
    found = sizes.where("page_id IS NOT NULL").groupBy(step).agg(F.sum("size").alias("size")).collect()
    shards, shard, held = [], 0, 0
    for r in sorted(found):
        if held >= shard_bytes:
            shard, held = shard + 1, 0
        shards.append((r["step"], shard))
        held += r["size"]
    steps = rows.sparkSession.createDataFrame(shards, "step long, shard int")
    at = rows.select("*", step).join(F.broadcast(steps), "step", "left")
    return at.withColumn("shard", F.coalesce("shard", F.lit(0))).drop("step")


def first_of_equals(slim: DataFrame) -> DataFrame:
    """(page_id, sha256, refers_to) of the pages whose payload an earlier page has.

    Equal payloads are one row per task before they meet.
    """
    first = slim.where(F.col("size") >= LEAST_REVISIT).groupBy("sha256").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")
    ).where("pages > 1")
    later = slim.join(first, "sha256").where("page_id > first")
    return later.select("page_id", "sha256", F.col("first").alias("refers_to")).distinct()


def planned(pages: DataFrame, page_id: str, url: str, html: str, shard_bytes: int) -> DataFrame:
    """Rows of payloads and rows of decisions, together in shards and sorted.

    Decisions are slim rows that sort right before the payload they speak of, so
    one shuffle of the payloads brings both together.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    )
    slim = staged(
        rows.select("page_id", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("size")),
        "warc-slim",
    )
    content = rows.select(
        "page_id", F.sha2("payload", 256).alias("sha256"), F.lit(1).alias("kind"), "url", "payload",
        F.lit(None).cast("long").alias("refers_to"),
    )
    decisions = first_of_equals(slim).select(
        "page_id", "sha256", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "refers_to",
    )
    both = with_shard(content.unionByName(decisions), slim, shard_bytes)
    return both.repartition("shard").sortWithinPartitions("shard", "page_id", "sha256", "kind", "url")


# ---- writing ----------------------------------------------------------------
class _Roller:
    """Gzip members into files of bounded size, under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number = shard, roll_bytes, 0
        self.attempt = TaskContext.get().taskAttemptId()
        self.out, self.done = None, []

    def add(self, raw: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = squeeze.compress(raw) + squeeze.flush()
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"_temporary/{self.shard:06d}-{self.number:05d}.{self.attempt}"
            self.files.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.done.append((self.shard, self.number, self.name, self.records, self.size, self.digest.hexdigest()))
        self.number += 1


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, refers = None, {}
        page, seen = object(), {}
        done = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "sha256", "kind", "url", "payload", "refers_to")),
                           strict=True):
                shard, page_id, sha, kind, url, payload, to = row
                if roller is None or shard != roller.shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, shard, roll_bytes)
                    page = object()
                if page_id != page:
                    page, seen, refers = page_id, {}, {}
                if kind == 0:
                    refers[sha] = to
                    continue
                nth = seen.get(sha, 0)
                again = nth > 0 and len(payload) >= LEAST_REVISIT
                to = refers.get(sha, page_id if again else None)
                revisit = again or sha in refers
                seen[sha] = nth + 1
                roller.add(record(page_id, nth, url, payload, base32_sha1(payload), to, revisit))
        if roller is not None:
            roller.close()
            done += roller.done
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(
                    zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["shard", "number", "temporary", "records", "bytes", "sha256"],
            )

    return write


def commit(spark: SparkSession, written: DataFrame, folder: str) -> list[dict]:
    """Rename the files of accepted attempts, then the manifest that names them.

    Runs again without harm: a file that already has its name is left alone. The
    driver holds one short row per archive file.
    """
    files, root = fs.FileSystem.from_uri(folder)
    entries = []
    for r in sorted(written.collect()):
        name = f"pages-{r['shard']:06d}-{r['number']:05d}.warc.gz"
        if files.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
            files.move(f"{root}/{r['temporary']}", f"{root}/{name}")
        entries.append({"file": name, "records": r["records"], "bytes": r["bytes"], "sha256": r["sha256"]})
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/_{MANIFEST}.tmp") as out:
        out.write(json.dumps(entries, indent=0).encode())
    files.move(f"{root}/_{MANIFEST}.tmp", f"{root}/{MANIFEST}")
    return entries


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> list[dict]:
    """Write all pages and return the manifest.

    A null payload is empty. Of equal payloads the one with the smallest id is a
    response and the others revisit it; of rows that repeat an id and a payload
    the first by url is the response. Pages without an id come first and only
    revisit each other. An empty table gives a manifest without files.
    """
    plan = planned(pages, page_id, url, html, shard_bytes)
    written = staged(plan.mapInArrow(_writer(folder, roll_bytes), WRITTEN), "warc-written")
    return commit(pages.sparkSession, written, folder)


# ---- reading ----------------------------------------------------------------
def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            data = rest or source.read(chunk)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(unzip.decompress(data))
        rest = unzip.unused_data
        yield b"".join(parts)


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for raw in members(source):
                        row = parse(raw)
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(raw) if with_payload else 100
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names."""
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/{MANIFEST}") as source:
        entries = json.loads(source.read())
    names = spark.createDataFrame([(e["file"],) for e in entries], "file string")
    spread = names.repartition(max(1, len(entries)))
    return spread.mapInArrow(_reader(folder, with_payload), RECORD)


def new_folder(spark: SparkSession) -> str:
    return work_dir(spark, "warc")
