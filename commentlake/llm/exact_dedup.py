"""Exact deduplication as a stateful stream.

Rows arrive as a stream of (digest, identifier, content locator). The keyed
state, held by RocksDB on disk and never expired, keeps for each digest how many
rows had it and which one stays: its identifier and where its content lies.
A hit on a digest is not believed before the full bytes are compared, so that two
texts with one digest come apart again. Texts pass through neither the stream
nor the state; only those of hits are read a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.llm.common import ascii_lower, staged
from commentlake.session import work_dir

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Each store would reserve 4 MB for its log, which many small stores never fill.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ARRIVAL = "digest string, id long, file string, at long"


def normalised(text: str = "text") -> Column:
    """What is compared: A-Z in lower case, null as empty."""
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def sha256(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def file_of(docs: DataFrame) -> Column:
    """The file a row of ``docs`` lies in, also beside a column of the user's that is called _metadata."""
    return docs.metadataColumn("_metadata")["file_path"]


def place_of(docs: DataFrame) -> Column:
    return docs.metadataColumn("_metadata")["row_index"]


def located(docs: DataFrame) -> DataFrame:
    """Rows whose place in a file is known; others are written out first."""
    try:
        docs.select(file_of(docs), place_of(docs)).schema  # noqa: B018  asks for the analysis
        return docs
    except AnalysisException:
        return staged(docs, "exact-rows")


def arrivals(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """What the stream carries of each row."""
    return docs.select(
        digest(normalised(text)).alias("digest"),
        F.col(doc_id).cast("long").alias("id"),
        file_of(docs).alias("file"),
        place_of(docs).alias("at"),
    )


def absorb(spark: SparkSession, folder: str, checkpoint: str) -> None:
    """Take what has landed in ``folder`` since the last call into the state.

    The checkpoint holds the state's versions: after a lost executor or driver a
    further call goes on from the last finished batch.
    """
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        landed = spark.readStream.schema(ARRIVAL).parquet(folder)
        # A struct's maximum is that of its first field, then of the next: the
        # largest identifier stays, and of rows that repeat it the last place.
        held = landed.groupBy("digest").agg(
            F.max(F.struct("id", "file", "at")).alias("stays"), F.count(F.lit(1)).alias("rows")
        )
        held.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state as a table (digest, keep, file, at, rows)."""
    kept = spark.read.format("statestore").load(checkpoint)
    stays, rows = kept.schema["value"].dataType.names
    return kept.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.{stays}.id").alias("keep_id"),
        F.col(f"value.{stays}.file").alias("keep_file"),
        F.col(f"value.{stays}.at").alias("keep_at"),
        F.col(f"value.{rows}").alias("group_size"),
    )


def _places(df: DataFrame) -> DataFrame:
    return df.select(F.col("file").alias("_file"), F.col("at").alias("_at"))


def _hits(docs: DataFrame, slim: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The full bytes of rows whose digest came more than once, by their locators."""
    body = docs.select(
        file_of(docs).alias("file"), place_of(docs).alias("at"),
        F.col(doc_id).cast("long").alias("id"), normalised(text).alias("body"),
    )
    return slim.where("group_size > 1").select("digest", "file", "at").join(body, ["file", "at"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, digest, keep_id, group_size, kept, file, at.

    Of equal texts the row with the largest id stays. A null id is smaller than
    any other; of rows that repeat an id and a text the one furthest on in the
    files stays. An empty table gives an empty one. Of copies in one group each
    task sends one summary, so a group of any size is one row per task.
    """
    spark = docs.sparkSession
    docs = located(docs)
    folder, checkpoint = work_dir(spark, "exact-landed"), work_dir(spark, "exact-state")
    arrivals(docs, doc_id, text, digest).write.parquet(folder)
    absorb(spark, folder, checkpoint)
    landed = spark.read.schema(ARRIVAL).parquet(folder)
    held = state(spark, checkpoint)
    slim = landed.join(held, "digest")
    bodies = _hits(docs, slim, doc_id, text).groupBy("digest", "body").agg(
        F.max(F.struct("id", "file", "at")).alias("stays"), F.count(F.lit(1)).alias("rows")
    )
    several = bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    found = slim.select(
        "id", "digest", "keep_id", "group_size",
        ((F.col("file") == F.col("keep_file")) & (F.col("at") == F.col("keep_at"))).alias("kept"), "file", "at",
    )
    apart = staged(several.select("digest"), "exact-collisions")
    if apart.isEmpty():
        return found
    return found.join(apart, "digest", "left_anti").unionByName(
        _separated(docs, slim.join(apart, "digest", "left_semi"), doc_id, text)
    )


def _separated(docs: DataFrame, slim: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Groups of one digest but several texts, told apart by their bytes."""
    rows = _hits(docs, slim, doc_id, text)
    groups = rows.groupBy("digest", "body").agg(
        F.max(F.struct("id", "file", "at")).alias("stays"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(groups, ["digest", "body"]).select(
        "id", "digest", F.col("stays.id").alias("keep_id"), "group_size",
        ((F.col("file") == F.col("stays.file")) & (F.col("at") == F.col("stays.at"))).alias("kept"), "file", "at",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with the columns it had."""
    docs = located(docs)
    gone = deduplicated(docs, doc_id, text).where("NOT kept")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        file_of(docs).alias("_file"), place_of(docs).alias("_at"),
    )
    return rows.join(_places(gone), ["_file", "_at"], "left_anti").select("row.*")
