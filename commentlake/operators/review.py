"""The review round trip: a queue of comments out, edits and rejects back."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentlake.functions import lexer, shorten
from commentlake.functions.hof import is_blank, let, pinned, rlike, strip, sub
from commentlake.functions.protect import API_DOC, Protections
from commentlake.operators.comments import annotate, classify, extract_comments, placed_arrays, text_arrays
from commentlake.operators.edits import (
    DELETE,
    REPLACE,
    Options,
    _summarised,
    apply_edits,
    can_delete,
    eligible,
    verify,
)

VERSION = 1
MODES = ("synthesize", "humanize")

# Fixed value: comment marks that a submitted text must not contain.
SUBMITTED_MARKS = r"(?U)(/\*|\*/|<!--|-->|\"\"\"|'''|^\s*//|^\s*#\s|^\s*\*\s|^\s*--\s)"

REVIEW_SCHEMA = (
    "version int, mode string, id string, file string, file_sha1 string, lang string, kind string, "
    "is_api_doc boolean, deletable boolean, lines string, span array<int>, raw_sha1 string, "
    "ai_score double, ai_reasons array<string>, max_lines int, max_chars int, current array<string>, "
    "code_before string, code_after string, new_text array<string>"
)


def build_reviews(files: DataFrame, mode: str, opts: Options = Options(),
                  protections: Protections = Protections(),
                  languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """One row per eligible comment with what a reviewer needs; no shuffle."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    found = extract_comments(files, languages, keep=["file_sha1"])
    c = classify(annotate(found), protections).where(eligible(F.col, opts))
    half = F.greatest(F.lit(1), F.floor(F.size("inner_lines") / 2).cast("int"))
    return c.select(
        F.lit(VERSION).alias("version"),
        F.lit(mode).alias("mode"),
        F.concat_ws("#", "path", "comment_id").alias("id"),
        F.col("path").alias("file"),
        "file_sha1", "lang", "kind",
        F.coalesce(F.col("protected") == API_DOC, F.lit(False)).alias("is_api_doc"),
        can_delete(F.col).alias("deletable"),
        F.concat_ws("-", F.col("line").cast("string"), F.col("end_line").cast("string")).alias("lines"),
        F.array("start", "end").alias("span"),
        F.sha1(F.encode("text", "UTF-8")).alias("raw_sha1"),
        F.round("ai_score", 2).alias("ai_score"),
        "ai_reasons",
        (F.lit(1) if mode == "synthesize" else half).alias("max_lines"),
        shorten.budget(
            F.col("indent"), F.col("kind"), F.col("open_tok"), F.col("close_tok"), opts.max_len
        ).alias("max_chars"),
        F.filter("inner_lines", lambda x: ~is_blank(x)).alias("current"),
        "code_before", "code_after",
        F.lit(None).cast("array<string>").alias("new_text"),
    )


def write_reviews(reviews: DataFrame, path: str) -> None:
    """JSON lines; null fields are written so that the format is explicit.

    They repeat names, hashes and code, so they are stored with gzip, whose fastest level
    leaves about a tenth.
    """
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    reviews.write.option("ignoreNullFields", "false").options(**packed).json(path)


def read_reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, malformed): rows of the right version and shape, and the others.

    A string in ``new_text`` counts as a list of one line.
    """
    loose = REVIEW_SCHEMA.replace("new_text array<string>", "new_text string")
    raw = spark.read.schema(f"{loose}, _corrupt string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path)
    listed = F.from_json("new_text", "array<string>")
    text = F.col("new_text")
    raw = raw.withColumn(
        "new_text",
        F.when(text.isNull(), F.lit(None).cast("array<string>"))
        .when(text.startswith("["), listed)
        .otherwise(F.array(text)),
    )
    valid = F.coalesce(
        (F.col("version") == VERSION) & F.col("id").isNotNull() & F.col("file").isNotNull()
        & F.col("_corrupt").isNull(),
        F.lit(False),
    )
    return raw.where(valid).drop("_corrupt"), raw.where(~valid).select("version", "id", "_corrupt")


def clean_submission(new_text: Column, max_lines: Column, max_chars: Column) -> Column:
    """struct<lines, warnings> of a submitted text.

    Marks are cut out, lines beyond the limit dropped, and a line of more than
    twice the budget cut at its last blank.
    """
    pieces = F.filter(
        F.flatten(F.transform(new_text, lambda x: F.split(x, r"\r\n|[\n\r\f\x0B]"))),
        lambda x: x.isNotNull(),
    )
    bare = F.transform(pieces, lambda x: strip(x))

    def build(ls: Column) -> Column:
        marked = F.exists(ls, lambda x: rlike(x, SUBMITTED_MARKS))
        cleaned = F.filter(
            F.transform(ls, lambda x: strip(sub(x, SUBMITTED_MARKS))), lambda x: x != ""
        )

        def finish(cs: Column) -> Column:
            limit = max_chars * 2
            kept = F.slice(cs, F.lit(1), F.greatest(max_lines, F.lit(0)))

            def cut(x: Column) -> Column:
                head = F.left(x, limit)
                at_blank = F.left(head, F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1)
                short = F.when(F.contains(head, F.lit(" ")), at_blank).otherwise(head)
                return F.when(F.length(x) > limit, short).otherwise(x)

            warnings = F.array_compact(
                F.array(
                    F.when(F.exists(new_text, lambda x: x.isNull()), F.lit("value_not_text")),
                    F.when(marked, F.lit("delimiter_removed")),
                    F.when(F.size(cs) > max_lines, F.lit("lines_dropped")),
                    F.when(F.exists(kept, lambda x: F.length(x) > limit), F.lit("line_cut")),
                )
            )
            return F.struct(F.transform(kept, cut).alias("lines"), warnings.alias("warnings"))

        return let(cleaned, finish)

    return let(bare, build)


def _slim(sha: Column) -> Column:
    """A hash for the way: forty hex digits as bytes, any other text as it is; equal where the texts are."""
    digits = rlike(sha, r"\A[0-9a-f]{40}\z")
    return F.when(digits, F.concat(F.lit(b"\x00"), F.unhex(sha))).otherwise(F.concat(F.lit(b"\x01"), F.encode(sha, "UTF-8")))


def judge_reviews(reviews: DataFrame, files: DataFrame,
                  languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """Every answered review with its verdict: an edit, or a reason against it.

    ``files`` needs file_sha1. Reviews and files move once each, by path; what an answer
    says for itself is worked out before, so only that, two hashes and the submitted
    lines travel. The answers of a file (one per comment) gather in its row, and the
    file is read there, if it is the one that was asked about.
    """
    cleaned = clean_submission(F.col("new_text"), F.col("max_lines"), F.col("max_chars"))
    told = reviews.withColumn("_t", F.when(F.size("new_text") > 0, cleaned))
    empty = F.size("new_text") == 0
    own = (
        F.when(empty, F.when(~F.coalesce("deletable", F.lit(False)), F.lit("deletion_refused")))
        .when(F.size("_t.lines") == 0, F.lit("nothing_submitted"))
        .when(F.col("_t.lines") == F.col("current"), F.lit("unchanged"))
    )
    none = F.array().cast("array<string>")
    asked = told.select(
        F.col("file").alias("path"), "id", F.col("span")[0].alias("_s"), _slim(F.col("file_sha1")).alias("_file"),
        _slim(F.col("raw_sha1")).alias("_raw"), F.col("new_text").isNotNull().alias("_answered"), empty.alias("_empty"),
        own.alias("_own"), F.coalesce("_t.lines", none).alias("_lines"), F.coalesce("_t.warnings", none).alias("_warnings"),
    )
    order = F.struct(F.col("_s").alias("s"), F.col("id").alias("i"))
    # The first item's hash speaks for the whole file.
    of_file = Window.partitionBy("path")
    asked = asked.withColumn("_claimed", F.min_by("_file", order).over(of_file))
    answered = asked.where("_answered").withColumn("comment_id", F.substring_index("id", "#", -1))
    # Of two answers to one comment the first counts.
    nth = F.row_number().over(Window.partitionBy("path", "comment_id").orderBy("_s", "id"))
    once = answered.withColumn("_nth", nth).where(F.col("_nth") == 1)
    # Two lists in one order, so that who asks for no lines gathers none.
    gathered = once.groupBy("path").agg(
        F.first("_claimed").alias("_claimed"),
        F.collect_list(F.struct("comment_id", "_raw", "_empty", "_own")).alias("_answers"),
        F.collect_list(F.struct("_lines", "_warnings")).alias("_texts"),
    )
    known = files.select("path", "lang", "text", _slim(F.col("file_sha1")).alias("_actual"))
    met = gathered.join(known, "path", "left")
    met = met.withColumn(
        "_file_reason",
        F.when(F.col("path").isNull(), F.lit(None).cast("string"))
        .when(F.col("_actual").isNull(), F.lit("file_unreadable"))
        .when(~F.col("_actual").eqNullSafe(F.col("_claimed")), F.lit("file_changed")),
    )
    # Only fresh files are lexed again. A path may stand for several texts: all of them are
    # read if one is fresh, and each of their comments is held against the answer.
    fresh = F.col("path").isNotNull() & F.max(F.col("_file_reason").isNull()).over(of_file)
    met = text_arrays(met.withColumn("_fresh", F.when(fresh, F.col("text"))), languages, "_fresh")
    hashes = F.transform("comments", lambda x: _slim(F.sha1(F.encode(x, "UTF-8"))))
    met = met.select("path", "_answers", "_texts", "_file_reason", pinned(hashes).alias("_hashes"))
    met = met.withColumn("_copies", F.collect_list("_hashes").over(of_file))
    rows = met.select("path", "_texts", "_file_reason", "_copies", F.posexplode("_answers").alias("_at", "a"))
    number = F.expr("try_cast(substring(a.comment_id, 2) AS int)")
    number = F.when(F.format_string("c%04d", number) == F.col("a.comment_id"), number)
    rows = rows.withColumn("_number", number)
    found = F.array_compact(F.transform("_copies", lambda x: F.get(x, F.col("_number"))))
    rows = rows.select("path", "_texts", "_file_reason", "_at", "a", F.explode_outer(found).alias("_sha"))
    reason = (
        F.when(F.col("_file_reason").isNotNull(), F.col("_file_reason"))
        .when(~F.col("_sha").eqNullSafe(F.col("a._raw")), F.lit("comment_missing"))
        .otherwise(F.col("a._own"))
    )
    mine = F.get("_texts", F.col("_at"))
    return rows.withColumn("reason", reason).select(
        "path", F.col("a.comment_id").alias("comment_id"),
        F.when(F.col("reason").isNull(), F.when(F.col("a._empty"), F.lit(DELETE)).otherwise(F.lit(REPLACE))).alias("action"),
        mine["_lines"].alias("lines"),
        mine["_warnings"].alias("warnings"),
        "reason",
    )


def review_edits(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNull()).select(
        "path", "comment_id", "action", "lines", "warnings"
    )


def review_rejects(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull()).select("path", "comment_id", "reason")


def apply_reviews(files: DataFrame, judged: DataFrame, protections: Protections = Protections(),
                  languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """Apply accepted edits; returns the same columns as ``clean_files``.

    Edits gather per file (at most one per comment, so bounded by the file size)
    and meet the texts in one join; files without edits never take part in it.
    """
    number = F.expr("int(substring(comment_id, 2))")
    per_file = (
        review_edits(judged)
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct(number.alias("n"), "action", "lines"))).alias("_given"))
    )
    touched = files.join(per_file, "path", "inner")
    planned = placed_arrays(touched, protections, languages)

    # Comment ids are positions: spread the answers out to one slot per comment,
    # so that each comment finds its own by index.
    def slots(a: Column, k: Column) -> Column:
        before = F.coalesce(F.get("_given", k - 1)["n"], F.lit(-1))
        blank = F.when(F.lit(False), a)
        return F.concat(F.array_repeat(blank, a["n"] - before - 1), F.array(a))

    planned = planned.withColumn("_slots", pinned(F.flatten(F.transform("_given", slots))))
    fields = planned.schema["comments"].dataType.elementType.fieldNames()

    def decide(c: Column, i: Column) -> Column:
        return let(
            F.get("_slots", i),
            lambda a: F.struct(
                *[c[n].alias(n) for n in fields],
                a["lines"].alias("new_lines"),
                a["action"].alias("action"),
                F.when(a["action"].isNotNull(), F.lit("review")).alias("reason"),
            ),
        )

    planned = planned.withColumn("comments", F.transform("comments", decide))
    return _summarised(verify(apply_edits(planned), languages), F.size(F.array_compact("_protected")))
