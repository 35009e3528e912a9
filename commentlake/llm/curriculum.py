"""Mixing sources by a time-varying curriculum.

A source's weight decides how many of its words training takes, its schedule when. The
schedule is a piecewise linear density over training time; integrated, it says
which part of the source's demand is due by any time. Documents of a source stand in
a drawn order, pass after pass; the words before one are a demand, and the inverse of the integral
is the time at which the document is trained on. A range sort by that time is the
curriculum. Sums along a source are running sums over range partitions with the
totals of the partitions before, so no source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlake.llm.common import WORD, staged

SEED = 42
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, as a fraction; and times a source's own words at most.
SHARE, PASSES = (3, 2), 2
#: Relative weight of a source at evenly spaced times, for each of WEIGHTS: the heavy ones
#: come early, the others late. Each has its own mean as unit.
SCHEDULES = ((1.5, 1.0, 0.5), (0.25, 1.0, 1.75), (0.75, 1.0, 1.25))
#: Copies of one row are numbered in runs of this many.
RUN = 8192


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the earlier rows of its group, which may hold most rows.

    Rows are range-partitioned by group and order and stored; a partition's part of a
    group is summed by itself, and the totals of earlier partitions are added.
    """
    cut = df.withColumn("value", value.cast("long")).repartitionByRange(*by, *order)
    cut = staged(cut.withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("part", *by).agg(F.sum("value").alias("value")).select(
        F.col("part"), *by, F.coalesce(F.sum("value").over(earlier), F.lit(0)).alias("ahead")
    )
    local = cut.withColumn("before", F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return local.join(totals, ["part", *by]).withColumn("before", F.col("before") + F.col("ahead")).drop("value", "part", "ahead")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, draw, digest, size, copies): rows of equal id, source and text are one row here.

    ``size`` counts words; a null text has none. ``draw`` orders a source's documents
    and depends on seed, id and text alone, so reruns agree.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("size"),
    )
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"))
    return rows.groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "draw", F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 16)
    )


def targets(known: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
            passes: int = PASSES) -> DataFrame:
    """(source, place, weight, source_size, target) per source of ``sized`` documents.

    Places count sources by code point from 0, null last. Targets share ``share`` of all
    words by weight; one that exceeds ``passes`` times its source is cut to that, and
    the excess goes to the others by weight until none is above. Each round is one
    aggregation whose three sums meet at the driver.
    """
    found = known.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    found = found.withColumn("last", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    at = running(found.withColumn("every", F.lit(0)), ["every"], ["last", "name"], F.lit(1), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int"))
    at = staged(at.select("source", F.col("before").alias("place"), weight.cast("long").alias("weight"), "source_size"), "mix-weights")
    # A source is cut when its ratio of words to weight is below that of the level; the level only rises.
    above, most = F.lit(False), F.col("source_size") * passes
    words = at.agg(F.sum("source_size")).first()[0] or 0
    cut_before = -1
    while True:
        n, cut_words, free = at.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        rest = words * share[0] - cut_words * share[1]  # times share[1]
        if n == cut_before or not free:
            break
        cut_before = n
        level = F.lit(rest).cast("decimal(38,0)") * F.col("weight")
        above = level >= most.cast("decimal(38,0)") * F.lit(share[1] * free).cast("decimal(38,0)")
    due = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(share[1] * max(1, free)))
    return at.withColumn("target", F.when(above, most.cast("double")).otherwise(due))


# ---- schedules -------------------------------------------------------------
def integral(heights: tuple[float, ...]) -> list[float]:
    """Share of the demand that is due by each knot of a schedule."""
    parts = [(a + b) / 2 for a, b in zip(heights, heights[1:], strict=False)]
    if min(heights) < 0 or sum(parts) <= 0:
        raise ValueError("a schedule needs weights from zero up, and one above")
    out, total = [0.0], sum(parts)
    for p in parts:
        out.append(out[-1] + p / total)
    return [*out[:-1], 1.0]


def due_time(share: Column, heights: tuple[float, ...]) -> Column:
    """The time in 0..1 by which ``share`` of the demand of one schedule is due: its integral inverted."""
    due, steps = integral(heights), len(heights) - 1
    total = sum((a + b) / 2 for a, b in zip(heights, heights[1:], strict=False))
    out = None
    for k in reversed(range(steps)):
        a, slope = heights[k], heights[k + 1] - heights[k]
        area = (share - F.lit(due[k])) * F.lit(total)  # in steps: a * x + slope / 2 * x ** 2
        # The smaller root, in the form that holds for any slope.
        under = F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * slope) * area, F.lit(0.0)))
        x = F.when((area > 0) & (under > 0), F.lit(2.0) * area / under).otherwise(F.lit(0.0))
        time = (F.least(x, F.lit(1.0)) + F.lit(float(k))) / F.lit(float(steps))
        out = time if out is None else F.when(share < F.lit(due[k + 1]), time).otherwise(out)
    return out


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
          share: tuple[int, int] = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """One row per document in the order of its first training time: doc_id, source, digest, size, source_size, target, taken, times.

    ``times`` has (pass, time, words) of each pass that takes words of the document;
    ``taken`` sums them. The document at which a target is reached is taken in
    part, so a source's words meet its target to less than a word. Documents without
    words are taken at no time and come last. Null ids and sources are values like
    others; copies of a row stand side by side; an empty table gives an empty one.
    """
    known = staged(sized(docs, doc_id, text, source, seed), "mix-documents")
    goal = staged(targets(known, weights, share, passes), "mix-targets").withColumnRenamed("source", "goal_source")
    rows = known.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = rows.withColumn("doc_key", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    at = running(rows, ["place"], ["draw", "doc_key", "digest"], F.col("size") * F.col("copies"), "mix-order").drop("doc_key")
    run = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("copies") - 1) / RUN).cast("long")))
    one = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1))
    at = at.select("*", run.alias("run")).select("*", one.alias("copy"))
    at = at.withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    words = F.floor("target").cast("long")

    def one_pass(k: Column) -> Column:
        begin = F.col("before") + k * F.col("source_size")
        part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), words - begin))
        due = F.when(F.col("target") > 0, begin.cast("double") / F.col("target"))
        time = None
        for i, heights in enumerate(schedules):
            mine = due_time(due, heights)
            time = mine if time is None else F.when(F.col("place") % len(schedules) == i, mine).otherwise(time)
        return F.struct(k.cast("int").alias("pass"), time.alias("time"), part.alias("words"))

    times = F.filter(F.transform(F.array(*(F.lit(k).cast("long") for k in range(passes))), one_pass), lambda x: x["words"] > 0)
    at = at.withColumn("times", times).withColumn(
        "taken", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    )
    first = F.get(F.col("times"), F.lit(0))["time"]
    out = at.select("doc_id", "source", "digest", "size", "source_size", "target", "taken", "times", first.alias("first"), "draw")
    # Equal times, and the documents that are never taken, are cut by their draws.
    return out.repartitionByRange(F.col("first").asc_nulls_last(), "draw").sortWithinPartitions(
        F.col("first").asc_nulls_last(), "draw"
    ).drop("first", "draw")


def curriculum(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """What training reads, in order: time, pass, doc_id, source, text, words; range-sorted by time.

    A document comes once for each pass that takes words of it; ``words`` says how
    many from its start.
    """
    at = mixed(docs, doc_id, text, source, **options)
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(
        F.col(doc_id).cast("long").alias("d"), F.col(source).cast("string").alias("s"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("h"), said.alias("text"),
    ).groupBy("d", "s", "h").agg(F.first("text").alias("text"))
    trained = at.select("doc_id", "source", "digest", F.explode("times").alias("t"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("h"))
    out = trained.join(texts, same).select("t.time", "t.pass", "doc_id", "source", "text", "t.words", "digest")
    order = ("time", "digest", "doc_id")
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
