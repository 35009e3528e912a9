"""Directory trees as tables: listing that sees every name, reading and writing of files.

Spark's own listing leaves out names that begin with ``_`` or ``.``, and with them
``__init__.py``, ``.env`` and ``.github/``. Here directories are listed in tasks, level
by level: a round lists all directories of one depth side by side, and its result is
stored, so a lost executor costs the directories it had in hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.session import work_dir

#: Bytes of files that one task reads, about, and that leave it in one batch.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
LISTED = "path string, size long, directory boolean"
CONTENT = "path string, size long, content binary"


def _lister(root: str):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for below in batch.column(0).to_pylist():
                at = f"{base}/{below}".rstrip("/")
                found = [
                    (f"{below}/{x.base_name}".lstrip("/"), x.size, x.type == fs.FileType.Directory)
                    for x in files.get_file_info(fs.FileSelector(at))
                    if x.type in (fs.FileType.File, fs.FileType.Directory)
                ]
                if found:
                    path, size, directory = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path), pa.array(size, pa.int64()), pa.array(directory)], ["path", "size", "directory"]
                    )

    return listed


def list_tree(spark: SparkSession, directory: str) -> DataFrame:
    """(path, size) of every file below a directory, whatever its name; paths relative to it.

    As many rounds as the tree is deep. A link to a directory is followed, so a tree
    must not link back into itself.
    """
    root = directory.rstrip("/")
    todo, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        folder = work_dir(spark, "listing")
        todo.repartition("path").mapInArrow(_lister(root), LISTED).write.parquet(folder)
        level = spark.read.schema(LISTED).parquet(folder)
        rounds.append(level.where(~F.col("directory")).select("path", "size"))
        todo = level.where("directory").select("path")
        if todo.isEmpty():
            break
    out = rounds[0]
    for level in rounds[1:]:
        out = out.unionByName(level)
    return out


def _reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            path, size, content = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(path), pa.array(size, pa.int64()), pa.array(content, pa.binary())], ["path", "size", "content"]
            )

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{path}", compression=None) as source:
                    content = source.read()
                rows.append((path, len(content), content))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield batch_of()
                    rows, held = [], 0
        if rows:
            yield batch_of()

    return read


def read_files(spark: SparkSession, directory: str, listing: DataFrame) -> DataFrame:
    """(path, size, content) of the listed files; what the listing leaves out is never opened."""
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-total[0] // TASK_BYTES), min(total[1], spark.sparkContext.defaultParallelism))
    return listing.select("path").repartition(tasks, "path").mapInArrow(_reader(directory.rstrip("/")), CONTENT)


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(root)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            sizes = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder, _, name = f"{base}/{path}".rpartition("/")
                files.create_dir(folder, recursive=True)
                # Whole under another name first: a reader sees the old file or the new one.
                with files.open_output_stream(f"{folder}/.{name}.{attempt}.part", compression=None) as out:
                    out.write(content)
                files.move(f"{folder}/.{name}.{attempt}.part", f"{folder}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "size"])

    return write


def write_files(files: DataFrame, directory: str, text: str = "text") -> DataFrame:
    """Write each row's text as the file at its path below ``directory``; returns the stored (path, size).

    Paths are taken as they are and must differ; a null text writes no file. A retry
    writes the same file again.
    """
    spark = files.sparkSession
    rows = files.where(F.col(text).isNotNull()).select("path", F.encode(F.col(text), "UTF-8").alias("content"))
    folder = work_dir(spark, "written")
    rows.mapInArrow(_writer(directory.rstrip("/")), "path string, size long").write.parquet(folder)
    return spark.read.schema("path string, size long").parquet(folder)
