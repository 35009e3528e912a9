"""Source corpora: reading, language lookup and selection of files.

A corpus is a DataFrame with ``path`` and either ``content`` (bytes) or ``text``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.dims import (
    EXCLUDED_DIRS,
    EXCLUDED_SUFFIXES,
    EXT_DIM,
    NAME_DIM,
    NAME_PREFIXES,
)
from commentlake.functions.hof import rlike, strings
from commentlake.sources.trees import list_tree, read_files


def read_tree(spark: SparkSession, directory: str, glob: str | None = None,
              max_bytes: int | None = None) -> DataFrame:
    """Files below a directory as (path, size, content), paths relative to it.

    Every name is seen. ``glob`` (of the file's name) and a size limit apply to the
    listing, so files that they leave out are never opened; ``skipped_files`` over
    ``list_tree`` tells what rules drop.
    """
    listing = list_tree(spark, directory)
    if glob:
        listing = listing.where(rlike(file_name(F.col("path")), _glob_pattern(glob)))
    if max_bytes is not None:
        listing = listing.where(F.col("size") <= max_bytes)
    return read_files(spark, directory, listing)


def _glob_pattern(glob: str) -> str:
    """A name pattern with ``*``, ``?`` and ``[...]`` for Java."""
    out = "".join({"*": "[^/]*", "?": "[^/]", "[": "[", "]": "]", "-": "-"}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in glob)
    return rf"\A{out}\z"


#: Stored bytes that one task of a spread table takes: lexing and classifying them is
#: seconds to a minute of work, where a scan's own split would be many minutes.
TASK_BYTES = 1 << 20


def spread(files: DataFrame) -> DataFrame:
    """Deal a table to tasks of about ``TASK_BYTES``, one per core at least.

    A row group is read by one task, however many cores there are, and lexing is bound
    by the processor: what a scan gives one task is far too much work. One round-robin
    exchange moves the texts, which costs little beside reading them as code.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(max(cores, -(-size // TASK_BYTES)))


def decode(files: DataFrame) -> DataFrame:
    """Drop undecodable files, decode the rest and fold line ends to a newline.

    Adds ``text``, ``file_sha1`` and, when missing, ``size`` in bytes.
    """
    if "text" not in files.columns:
        files = (
            files.where(F.is_valid_utf8(F.col("content").cast("string")))
            .withColumn("text", F.decode("content", "UTF-8"))
            .drop("content")
        )
    if "size" not in files.columns:
        files = files.withColumn("size", F.octet_length("text").cast("bigint"))
    folded = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r\n?", "\n"))
    files = files.withColumn("text", F.coalesce(folded, F.col("text")))
    return files.withColumn("file_sha1", F.sha1(F.encode("text", "UTF-8")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix in lower case; '' for none, for dot files and a final dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def with_language(files: DataFrame) -> DataFrame:
    """Add ``lang``: whole name, then name prefix, then extension; null if unknown.

    Both dimensions are fixed tables of a few dozen rows and are broadcast.
    """
    spark = files.sparkSession
    names = spark.createDataFrame(NAME_DIM, "_name string, _by_name string")
    exts = spark.createDataFrame(EXT_DIM, "_ext string, _by_ext string")
    name = file_name(F.col("path"))
    by_prefix = reduce(
        lambda acc, p: F.when(name.startswith(p[0]), F.lit(p[1])).otherwise(acc),
        reversed(NAME_PREFIXES),
        F.lit(None).cast("string"),
    )
    return (
        files.withColumn("_name", name)
        .withColumn("_ext", extension(F.col("path")))
        .join(F.broadcast(names), "_name", "left")
        .join(F.broadcast(exts), "_ext", "left")
        .withColumn("lang", F.coalesce("_by_name", by_prefix, "_by_ext"))
        .drop("_name", "_ext", "_by_name", "_by_ext")
    )


def is_kept(path: Column, size: Column, lang: Column, excluded_dirs: Sequence[str] = EXCLUDED_DIRS,
            max_bytes: int | None = None) -> Column:
    """The standing selection rules; ``excluded_dirs`` may be extended, a size limit set."""
    suffixes = "|".join(s.replace(".", r"\.") for s in EXCLUDED_SUFFIXES)
    return (
        ~F.arrays_overlap(F.split(path, "/"), strings(excluded_dirs))
        & ~rlike(path, f"(?:{suffixes})$")
        & lang.isNotNull()
        & (F.lit(True) if max_bytes is None else size <= max_bytes)
    )


def is_hidden(path: Column, base: str = "") -> Column:
    """Below a directory whose name starts with a dot, of those below ``base``: what is asked for by name is not hidden."""
    prefix = base.strip("/") + "/" if base.strip("/") else ""
    below = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if prefix else path
    return rlike(below, r"(?:^|/)\.[^/]*/")


def select_files(files: DataFrame, excluded_dirs: Sequence[str] = EXCLUDED_DIRS,
                 max_bytes: int | None = None, skip_hidden: bool = False,
                 unique_paths: bool = False, base: str = "") -> DataFrame:
    """Distinct files the jobs work on, with their language.

    ``skip_hidden`` applies to files found by walking a tree, not to listed ones, and
    to directories below ``base`` only.
    Removing repeated paths moves every text; say ``unique_paths`` for a listing
    or a table keyed by path, and selection stays in the scan stage.
    """
    found = with_language(files if not skip_hidden else files.where(~is_hidden(F.col("path"), base)))
    kept = found.where(is_kept(F.col("path"), F.col("size"), F.col("lang"), excluded_dirs, max_bytes))
    return kept if unique_paths else kept.dropDuplicates(["path"])


def skipped_files(files: DataFrame, excluded_dirs: Sequence[str] = EXCLUDED_DIRS,
                  max_bytes: int | None = None, skip_hidden: bool = False, base: str = "") -> DataFrame:
    """Files left out and the first rule that said so; a corpus count is one agg away.

    Where ``files`` has ``content``, files that are no UTF-8 count too.
    """
    bad = ~F.is_valid_utf8(F.col("content").cast("string")) if "content" in files.columns else F.lit(False)
    found = with_language(files.select("path", "size", bad.alias("_bad"))).dropDuplicates(["path"])
    suffixes = "|".join(s.replace(".", r"\.") for s in EXCLUDED_SUFFIXES)
    hidden = is_hidden(F.col("path"), base) if skip_hidden else F.lit(False)
    why = (
        F.when(hidden, F.lit("hidden_dir"))
        .when(F.arrays_overlap(F.split("path", "/"), strings(excluded_dirs)), F.lit("excluded_dir"))
        .when(rlike(F.col("path"), f"(?:{suffixes})$"), F.lit("generated"))
        .when(F.col("lang").isNull(), F.lit("unknown_language"))
    )
    if max_bytes is not None:
        why = why.when(F.col("size") > max_bytes, F.lit("too_large"))
    why = why.when(F.col("_bad"), F.lit("not_utf8"))
    return found.withColumn("why", why).where(F.col("why").isNotNull()).select("path", "size", "why")


def requested_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files named by ``requests.path``, either exactly or as a directory.

    Every file yields its ancestors, so a directory request is an equi-join and
    not a prefix scan of all pairs. Only paths and ancestors shuffle; text is
    fetched by a semi join on the matching paths.
    """
    wanted = requests.select(F.rtrim("path", F.lit("/")).alias("_want")).distinct()
    hits = _ancestry(files).join(wanted, "_want", "left_semi").select("path").distinct()
    return files.join(hits, "path", "left_semi")


def missing_requests(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that name no file and no directory."""
    wanted = requests.select("path", F.rtrim("path", F.lit("/")).alias("_want")).distinct()
    known = _ancestry(files).select("_want").distinct()
    return wanted.join(known, "_want", "left_anti").select("path")


def _ancestry(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    chain = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return files.select("path", F.explode(chain).alias("_want"))


def changed_since(current: DataFrame, base: DataFrame) -> DataFrame:
    """path and status (added or modified) of current files against a base.

    Compares hashes, so only path and hash are read and shuffled. Files deleted
    since the base are not reported.
    """
    old = base.select("path", F.col("file_sha1").alias("_old"))
    new = current.select("path", "file_sha1")
    status = F.when(F.col("_old").isNull(), F.lit("added")).when(
        F.col("_old") != F.col("file_sha1"), F.lit("modified")
    )
    return (
        new.join(old, "path", "left")
        .select("path", "file_sha1", status.alias("status"))
        .where(F.col("status").isNotNull())
    )


def only_changed(current: DataFrame, base: DataFrame) -> DataFrame:
    """The changed files themselves, text included."""
    return current.join(changed_since(current, base).select("path"), "path", "left_semi")
