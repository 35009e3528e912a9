"""Session settings the jobs are designed for, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Lexing expands a row several times over while it is worked on, so splits
    # are kept smaller than the 128 MB default.
    "spark.sql.files.maxPartitionBytes": "64m",
    # Recording a call site for every Column call costs more than the calls.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "commentlake",
                  shared_dir: str | None = None, **conf: str) -> SparkSession:
    """A session with ``SETTINGS``; ``shared_dir`` is where jobs cut lineage and stage tables."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    shared = {"spark.checkpoint.dir": shared_dir} if shared_dir else {}
    for key, value in {**SETTINGS, **shared, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Executors do not see each other's disks, so where none is named only a
    session whose driver and executors are one process gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="commentlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
