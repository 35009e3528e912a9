"""Incremental extraction of newly landed files.

Extraction is per file and stateless, so the batch operators run unchanged on a
stream: no watermark, no state store, append output.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from commentlake.functions import lexer
from commentlake.functions.protect import Protections
from commentlake.operators.comments import scan_comments
from commentlake.sources.files import decode

LANDED = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, directory: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of files as they land below ``directory``."""
    reader = spark.readStream.format("binaryFile").schema(LANDED).option("recursiveFileLookup", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(directory).select("path", "length", "content").withColumnRenamed("length", "size")


def extract_stream(files: DataFrame, output: str, checkpoint: str,
                   protections: Protections = Protections(),
                   languages: Collection[str] = lexer.LANGUAGES) -> StreamingQuery:
    """Append the comments of the files seen since the last run, then stop.

    ``files`` is a stream with path, lang and text or content. The checkpoint is
    what makes a rerun after a lost executor or driver pick up where it stopped.
    """
    comments = scan_comments(decode(files), protections, languages)
    return (
        comments.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
