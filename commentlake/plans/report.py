"""Reports over comments and cleaning results; partial aggregation does the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlake.functions.score import FLAGGED


def is_flagged() -> Column:
    return F.col("protected").isNull() & (F.col("ai_score") >= FLAGGED)


def scan_files(counts: DataFrame) -> DataFrame:
    """Per file with comments: changeable, flagged and protected counts.

    ``counts`` is ``file_counts``, which has one row per file already: no shuffle.
    """
    return counts.where(F.col("comments") > 0).select("path", "changeable", "flagged", "protected")


def scan_totals(counts: DataFrame) -> DataFrame:
    """Corpus totals in one row; files without comments count as files."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    names = ("comments", "protected", "flagged", "hidden_docs", "comment_lines", "total_lines")
    out = counts.agg(F.count("*").alias("files"), *[total(n) for n in names])
    share = F.col("comment_lines") * 100.0 / F.greatest(F.lit(1), F.col("total_lines"))
    return out.withColumn("comment_share", share)


def flagged(comments: DataFrame, width: int | None = None) -> DataFrame:
    """Every flagged comment, its text whole or cut to ``width`` characters."""
    text = F.col("inner") if width is None else F.substring("inner", 1, width)
    return comments.where(is_flagged()).select(
        "path", "start", "line", F.round("ai_score", 2).alias("score"), "ai_reasons", text.alias("text")
    )


def flagged_top(comments: DataFrame, n: int, width: int | None = None) -> DataFrame:
    """The first ``n`` flagged comments by file and place."""
    return flagged(comments, width).orderBy("path", "start").limit(n).drop("start")


def first_files(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("path").limit(n)


def by_protection(comments: DataFrame) -> DataFrame:
    """Comments per language and protection code, with subtotals per language."""
    code = F.coalesce("protected", F.lit("none"))
    return (
        comments.select("lang", code.alias("protected"))
        .rollup("lang", "protected")
        .agg(F.count("*").alias("comments"))
    )


def by_style_reason(comments: DataFrame) -> DataFrame:
    """Comments per style rule that fired; numbers inside a reason are dropped."""
    rule = F.explode(F.transform("ai_reasons", lambda r: F.substring_index(r, ":", 1)))
    return comments.select(rule.alias("rule")).groupBy("rule").agg(F.count("*").alias("comments"))


def change_summary(cleaned: DataFrame) -> DataFrame:
    """Per changed file: deleted, shortened, protected and lines saved."""
    touched = (F.col("deleted") + F.col("shortened")) > 0
    return cleaned.where(F.col("ok") & touched).select(
        "path", "deleted", "shortened", "protected", "lines_saved"
    )


def change_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.col("deleted") + F.col("shortened")), F.lit(0)).alias("comments"),
        F.coalesce(F.sum("lines_saved"), F.lit(0)).alias("lines_saved"),
    )


def as_json(rows: DataFrame, **literals: str) -> DataFrame:
    """One JSON document per row, with constant fields such as the mode."""
    extra = [F.lit(v).alias(k) for k, v in literals.items()]
    return rows.select(F.to_json(F.struct(*extra, *rows.columns)).alias("json"))
