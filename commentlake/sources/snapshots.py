"""Publishing cleaned files with a snapshot of the originals, and going back.

A store is a directory with one Parquet table ``runs``, partitioned by ``run_id``,
of each file's text before and after, and a log of numbered entries, one per run.
``originals`` and ``cleaned`` are projections of the table, and a projection reads one
of the two texts only. Runs are only ever added. A run counts from the moment its log
entry exists, which is created under the next free number or not at all: one that is
half written, or whose driver died before the entry, is never listed and never read.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS, LOG = "runs", "log"
ENTRY = "run_id string, files long, characters long"
CLEANED, ORIGINALS = "cleaned", "originals"
#: The column that each projection shows as its text.
_TEXT = {CLEANED: "after", ORIGINALS: "before"}


def new_run_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S-%f")


def publishable(cleaned: DataFrame) -> DataFrame:
    """Changed files whose code outside comments is proved unchanged."""
    return cleaned.where(F.col("ok") & (F.col("after") != F.col("before")))


def rejected(cleaned: DataFrame) -> DataFrame:
    """Files set aside because the code would have changed."""
    return cleaned.where(~F.col("ok")).select("path", "first_difference")


def publish(cleaned: DataFrame, store: str, run_id: str | None = None,
            failed: DataFrame | None = None) -> str:
    """Write one run, each file's original beside its cleaned text.

    ``failed`` (path) names files to leave as they were; the rest is kept. Texts
    are written once, and the cleaning runs once.
    """
    run_id = run_id or new_run_id()
    changed = publishable(cleaned)
    if failed is not None:
        changed = changed.join(failed.select("path").distinct(), "path", "left_anti")
    spark, folder = cleaned.sparkSession, f"{store}/{RUNS}/run_id={run_id}"
    changed.select("path", "lang", "before", "after").write.parquet(folder)
    sizes = spark.read.parquet(folder).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("after")), F.lit(0))).first()
    commit(spark, store, run_id, sizes[0], sizes[1])
    return run_id


def commit(spark: SparkSession, store: str, run_id: str, files: int, characters: int) -> int:
    """Enter a run in the log under the next free number, which it returns.

    A file that exists is never written over, so of two drivers that want one number
    the second takes the next.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{store}/{LOG}")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(root)
    taken = [int(x.getPath().getName().split(".")[0]) for x in system.listStatus(root) if x.getPath().getName()[0].isdigit()]
    number = max(taken, default=0) + 1
    while True:
        try:
            out = system.create(path(f"{store}/{LOG}/{number:08d}.json"), False)
            break
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            number += 1
    out.write(bytearray(json.dumps({"run_id": run_id, "files": files, "characters": characters}).encode() + b"\n"))
    out.close()
    return number


def runs(spark: SparkSession, store: str) -> DataFrame:
    """(number, run_id, files, characters) of the committed runs, from the log alone.

    An entry that is still being written does not parse and does not count.
    """
    entries = spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{store}/{LOG}")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
    return entries.select(number.alias("number"), "run_id", "files", "characters").where(F.col("run_id").isNotNull())


def read_store(spark: SparkSession, store: str, table: str = ORIGINALS) -> DataFrame:
    """The committed runs' texts; their ids, one short row each, prune the folders that are read."""
    # Named in full, so that run ids stay strings and a filter on them prunes folders.
    schema = "path string, lang string, before string, after string, run_id string"
    known = [r["run_id"] for r in runs(spark, store).select("run_id").distinct().collect()]
    found = spark.read.schema(schema).parquet(f"{store}/{RUNS}").where(F.col("run_id").isin(known))
    return found.select("path", "lang", F.col(_TEXT[table]).alias("text"), "run_id")


def snapshots(originals: DataFrame) -> DataFrame:
    """Runs, newest first, with their number of files."""
    return originals.groupBy("run_id").agg(F.count("*").alias("files")).orderBy(F.desc("run_id"))


def restore(current: DataFrame, originals: DataFrame, run_id: str | None = None) -> DataFrame:
    """The corpus with the files of one run (the latest by default) put back.

    ``run_id`` is a partition column: naming a run reads that run alone. Files of
    the snapshot that no longer exist come back too.
    """
    if run_id is None:
        # Reads folder names alone in a store; the snapshot below is then pruned to it.
        run_id = originals.agg(F.max("run_id")).first()[0]
    snap = originals.where(F.col("run_id") == run_id)
    back = snap.select("path", "text", F.lit(True).alias("restored"))
    # Only paths meet in the join: texts move in neither side unless the list of
    # restored files is itself too large to broadcast.
    rest = current.join(snap.select("path"), "path", "left_anti")
    return rest.select("path", "text", F.lit(False).alias("restored")).unionByName(back)


def roll_back(cleaned: DataFrame, failed: DataFrame) -> DataFrame:
    """Put only the failing files back; the others keep their new text."""
    bad = failed.select("path").distinct().withColumn("_bad", F.lit(True))
    gone: Column = F.coalesce("_bad", F.lit(False))
    return cleaned.join(bad, "path", "left").select(
        "path",
        F.when(gone, F.col("before")).otherwise(F.col("after")).alias("text"),
        gone.alias("rolled_back"),
    )
