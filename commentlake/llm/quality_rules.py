"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Catalyst expression over the row's own text, so scoring and
filtering stay in the scan stage: no shuffle, no user function, and a row's
memory is that of its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlake.functions.hof import pinned
from commentlake.llm.common import WORD

#: Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to in is that for it as was with be by on not he are this or from at which but have an had they you were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de et des un une du que est pour qui dans par sur pas au ne se ce il "
    "el los las y del por con su para al lo como más pero sus".split()
)

#: (measure, at least, at most); None leaves that side open.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 16.0),
    ("symbol_ratio", None, 0.2),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.4),
    ("max_word_chars", None, 1000),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(words: Column, triples: str) -> Column:
    """Words inside 3-word windows that occur twice or more.

    ``triples`` is a column of (hash, position) sorted by hash: equal windows are
    neighbours, so one pass finds them however often a window repeats.
    """
    s = F.col(triples)
    twin = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(
        x["h"] == F.get(s, k + 1)["h"], F.lit(False)
    )
    return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["p"]))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as a struct ``row``, with the measures beside it.

    A null or empty text has no word, and all its measures are 0. The struct
    keeps columns of any name apart from the measures.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    at = docs.select(F.struct("*").alias("row"), pinned(t).alias("t"))
    at = at.select("row", "t", pinned(F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    w = F.col("words")
    triple = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
    )
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    at = at.select(
        "row", "t", "words",
        pinned(F.sort_array(triple)).alias("triples"),
        pinned(lines).alias("lines"),
    )
    at = at.select("row", "t", "words", "lines", pinned(_repeated_words(w, "triples")).alias("found"))
    found = F.col("found")
    gaps = F.transform(found, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(found, k + 1) - p, F.lit(3))))
    stop = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))
    return at.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        pinned(stop).cast("long").alias("n_stop"),
        F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).cast("long").alias("max_word_chars"),
    )


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean of all thresholds; ratios of nothing are 0."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratios = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_ratio": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    tests = []
    for name, least, most in thresholds:
        value = ratios.get(name, F.col(name))
        tests += [value >= least] if least is not None else []
        tests += [value <= most] if most is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judged(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``row`` with the measures, ``base_failed`` and ``kept``.

    One row per input row, in no order. Repeated rows are judged alike; an empty
    table gives an empty one.
    """
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    at = measured(docs, text).withColumn("base_failed", base)
    return at.withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))


def keep_good(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows that pass, with the columns they had."""
    return judged(docs, text, thresholds).where("kept").select("row.*")
