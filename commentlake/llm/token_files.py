"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart.

A file is a run of blocks. In each block ids are replaced by their rank, the most
frequent being 0, so that most take one byte. A control byte holds the lengths of
four ranks; all control bytes come before all data bytes, so a reader finds the
place of every rank with one table lookup and one running sum, without a branch
per id. Documents lie in ascending id order over all files.

A writer names its files after its attempt. Which attempts count is said by the
manifest, a table of the rows that Spark accepted; what a lost executor left
behind is in no manifest and is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentlake.llm.common import staged
from commentlake.llm.tokens import default_tokenizer, encoder
from commentlake.session import work_dir

MAGIC = b"RVB1"
HEAD = struct.Struct("<4sIQIQ")  # magic, documents, ids, ranks, data bytes
#: Ids buffered before a block is closed; a longer document makes a longer block.
BLOCK_IDS = 1 << 21
END_ID = 1

MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"
#: Lengths in bytes of the four ranks that a control byte speaks of.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """(ids by rank, control bytes, data bytes) of unsigned 32-bit ids."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        counts = counts[used]
    else:
        used, counts = np.unique(ids, return_counts=True)
    by_rank = used[np.lexsort((used, -counts))].astype("<u4")
    if len(ids) and int(by_rank.max()) < 1 << 22:  # a table is faster than a search for each id
        table = np.zeros(int(by_rank.max()) + 1, np.uint32)
        table[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        rank = table[ids]
    else:
        order = np.argsort(by_rank)
        rank = order[np.searchsorted(by_rank[order], ids)].astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    code = (rank > 0xFF).astype(np.uint8) + (rank > 0xFFFF) + (rank > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, dtype=np.uint8)
    padded[: len(code)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    length = code.astype(np.int64) + 1
    at = np.cumsum(length) - length
    data = np.empty(int(length.sum()), dtype=np.uint8)
    data[at] = rank & 0xFF
    for k in (1, 2, 3):
        more = code >= k
        if not more.any():
            break
        data[at[more] + k] = rank[more] >> np.uint32(8 * k) & 0xFF
    return by_rank, control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ids(by_rank: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids again, by table lookup."""
    length = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(length) - length
    rank = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = length > k
        if not more.any():
            break
        rank[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return by_rank[rank]


def block_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    by_rank, control, data = encode_ids(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    body = b"".join((
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(by_rank), len(data)),
        by_rank.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(),
        np.array(counts, dtype="<u8").tobytes(), control, data,
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def read_blocks(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, all ids) of each block of an open file."""
    while head := source.read(HEAD.size):
        magic, n_docs, n_ids, n_ranks, n_data = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a block of ranked token ids")
        n_control = -(-n_ids // 4)
        body = source.read(4 * n_ranks + 17 * n_docs + n_control + n_data)
        if struct.unpack("<I", source.read(4))[0] != zlib.crc32(body, zlib.crc32(head)):
            raise ValueError("a block does not match its checksum")
        raw, at = np.frombuffer(body, dtype=np.uint8), 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = raw[at : at + n].view(kind)
            at += n
            return out

        by_rank = take(4 * n_ranks, "<u4")
        doc_ids, known = take(8 * n_docs, "<i8"), take(n_docs, "u1")
        counts = take(8 * n_docs, "<u8").astype(np.int64)
        control, data = take(n_control, "u1"), take(n_data, "u1")
        yield (
            [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)],
            counts, decode_ids(by_rank, control, data, n_ids),
        )


def _writer(folder: str, tokenizer: str, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        name = f"part-{part:06d}-{attempt}.ids"
        encode = encoder(tokenizer).encode
        out, docs, total, size = None, 0, 0, 0
        held_ids, held_counts, held, n_held = [], [], [], 0
        end = np.array([END_ID], dtype="<u4").tobytes()

        def close_block() -> None:
            nonlocal out, docs, total, size, held_ids, held_counts, held, n_held
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}")
            body = block_bytes(held_ids, held_counts, np.frombuffer(b"".join(held), dtype="<u4"))
            out.write(body)
            docs, total, size = docs + len(held_ids), total + n_held, size + len(body)
            held_ids, held_counts, held, n_held = [], [], [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    held.append(ids + end)
                    held_ids.append(doc_id)
                    held_counts.append(len(ids) // 4 + 1)
                    n_held += held_counts[-1]
                    if n_held >= block_ids:
                        close_block()
        if held:
            close_block()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [name], "n_docs": [docs], "n_ids": [total], "n_bytes": [size],
            })

    return write


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text",
          tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode all texts into files below ``folder`` and return the stored manifest.

    A null text is empty and holds the end id alone. Null ids come first; of rows
    that repeat an id the order is that of their texts. An empty table writes no
    file. The one shuffle sorts whole texts by range, once, before encoding.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(_writer(folder, tokenizer, block_ids), MANIFEST), "ids-manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """Files with the number of ids before each; one row per file, however many documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}") as source:
                    for doc_ids, counts, ids in read_blocks(source):
                        edge = np.concatenate([[0], np.cumsum(counts)])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64()), pa.array(base + edge[:-1]), pa.array(counts),
                            pa.LargeListArray.from_arrays(pa.array(edge), pa.array(ids)).cast(pa.list_(pa.int64())),
                        ], ["doc_id", "start", "n_tokens", "ids"])
                        base += len(ids)

    return read


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of a manifest."""
    return _each_file(manifest).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids array<long>")


def _each_file(manifest: DataFrame) -> DataFrame:
    """A task per file: left to themselves, such short rows would meet in one."""
    return placed(manifest).select("file", "base").repartition(max(1, manifest.count()))


def _checker(folder: str):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}") as source:
                    for doc_ids, counts, ids in read_blocks(source):
                        edge = np.concatenate([[0], np.cumsum(counts)])
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, pa.int64()), pa.array(base + edge[:-1]), pa.array(counts), pa.array(crc, pa.int64()),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += len(ids)

    return check


def read_checksums(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Like ``read``, with the checksum of each document's ids in place of the ids."""
    return _each_file(manifest).mapInArrow(_checker(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return work_dir(spark, "ids")
