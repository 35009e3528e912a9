"""Edit plans and their application, one file row at a time."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlake.dims import BRACE_WRAPPED
from commentlake.functions import lexer, nesting, rewrite, shorten
from commentlake.functions.hof import is_blank, let, pinned, prefix
from commentlake.functions.protect import API_DOC, Protections
from commentlake.functions.text import count_lines
from commentlake.operators.comments import (
    PROTECTED,
    RESTATED,
    SCORE,
    Get,
    add_fields,
    classified_arrays,
    code_of,
    lex,
)

DELETE, REPLACE = "delete", "replace"
RESTATED_ENOUGH = 0.7
NEAR_LINES = 3


@dataclass(frozen=True)
class Options:
    """How far a plan may go."""

    max_len: int = 80
    shrink_docs: bool = False
    min_score: float = 0.0
    dedupe: bool = True


def eligible(c: Get, opts: Options) -> Column:
    """Unprotected (or an API doc open to shortening) and scored high enough."""
    free = c("protected").isNull()
    if opts.shrink_docs:
        free = free | (c("protected") == API_DOC)
    return free & (c("ai_score") >= opts.min_score) if opts.min_score > 0 else free


def can_delete(c: Get) -> Column:
    return c("protected").isNull() & ~c("sole_statement")


# ---- runs of comments framed by decoration ----------------------------------
def banner_flags(comments: Column) -> Column:
    """Per comment: part of a run of two or more that holds a banner.

    A run is consecutive own-line, unprotected line comments on adjacent lines.
    Each comment becomes two letters (joined to the previous line or not, and
    its class), so a regular expression finds the runs in linear time.
    """

    def letters(c: Column, i: Column) -> Column:
        member = c["own_line"] & (c["kind"] == "line") & c["protected"].isNull()
        joined = F.coalesce(
            c["line"] == F.get(comments, i - 1)["end_line"] + 1, F.lit(False)
        )
        return F.concat(
            F.when(joined, F.lit("-")).otherwise(F.lit("|")),
            F.when(~member, F.lit("x"))
            .when(shorten.is_banner(c["inner_lines"]), F.lit("b"))
            .otherwise(F.lit("c")),
        )

    word = F.array_join(F.transform(comments, letters), "")
    runs = F.regexp_extract_all(word, F.lit(r"[|\-]x|[|\-][bc](?:-[bc])*+"), F.lit(0))
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.array_repeat(
                (F.length(r) >= 4) & F.contains(r, F.lit("b")), (F.length(r) / 2).cast("int")
            ),
        )
    )


# ---- near duplicates ----------------------------------------------------------
def duplicate_flags(comments: Column, candidate: Callable[[Column, Column], Column]) -> Column:
    """Per comment: same text as the last one *kept* at most three lines above.

    Dropped comments do not move the anchor, so this is a fold; it runs only
    over files in which some candidate repeats close to the previous one.
    Comments are sorted by text for the fold and sorted back by place after it.
    """
    entry = F.transform(
        comments,
        lambda c, i: F.struct(
            F.when(candidate(c, i), F.lower(c["inner"])).alias("key"), c["line"].alias("line"),
            c["end_line"].alias("end_line"), i.alias("i"),
        ),
    )

    def near(s: Column, x: Column, i: Column) -> Column:
        prev = F.get(s, i - 1)
        return F.coalesce(
            (prev["key"] == x["key"]) & (x["line"] - prev["end_line"] <= NEAR_LINES), F.lit(False)
        )

    def build(s: Column) -> Column:
        chained = F.transform(
            s,
            lambda x, i: F.struct(
                x["i"].alias("i"), x["line"].alias("line"), x["end_line"].alias("end_line"),
                near(s, x, i).alias("near"),
            ),
        )

        def flagged(ch: Column) -> Column:
            def is_copy(anchor: Column, x: Column) -> Column:
                return x["near"] & (x["line"] - anchor <= NEAR_LINES)

            def in_place(anchors: Column) -> Column:
                told = F.transform(
                    ch,
                    lambda x, k: F.struct(
                        x["i"].alias("i"), is_copy(F.get(anchors, k), x).alias("copy")
                    ),
                )
                return F.transform(F.sort_array(told), lambda x: x["copy"])

            anchors = prefix(
                ch, F.lit(0), "int",
                lambda a, x: F.when(is_copy(a, x), a).otherwise(x["end_line"]),
            )
            return F.when(F.exists(ch, lambda x: x["near"]), let(anchors, in_place)).otherwise(
                F.transform(ch, lambda x: F.lit(False))
            )

        return let(chained, flagged)

    return let(F.sort_array(entry), build)


# ---- plans ----------------------------------------------------------------------
def _with_action(df: DataFrame, decide) -> DataFrame:
    names = df.schema["comments"].dataType.elementType.fieldNames()
    df, _ = add_fields(df, names, decide)
    return df


def plan_delete(classified: DataFrame, opts: Options = Options()) -> DataFrame:
    """Decide per comment: delete everything eligible that can go."""

    def decide(c: Get):
        go = eligible(c, opts) & can_delete(c)
        return {
            "action": F.when(go, F.lit(DELETE)),
            "reason": F.when(go, F.lit("delete_all")),
            "new_lines": F.lit(None).cast("array<string>"),
        }

    return _with_action(classified, decide)


def plan_reduce(classified: DataFrame, opts: Options = Options()) -> DataFrame:
    """Decide per comment: drop what says nothing, shorten the rest."""
    df = classified.withColumn("_banner", pinned(banner_flags(F.col("comments"))))

    def first_rules(c: Column, i: Column) -> Column:
        get = lambda n: c[n]
        open_ = eligible(get, opts) & can_delete(get)
        return F.when(
            open_,
            F.when(F.get(F.col("_banner"), i), F.lit("banner_group"))
            .when(is_blank(c["inner"]) | shorten.is_banner(c["inner_lines"]), F.lit("empty_or_banner"))
            .when(c["restated"] >= RESTATED_ENOUGH, F.lit("restates_code"))
            .otherwise(F.lit("")),
        )

    # null: not deletable; '': survived the first rules; else the reason to go.
    df = df.withColumn("_first", pinned(F.transform("comments", first_rules)))
    if opts.dedupe:
        copies = duplicate_flags(
            F.col("comments"), lambda c, i: F.coalesce(F.get(F.col("_first"), i) == "", F.lit(False))
        )
    else:
        copies = F.transform("comments", lambda c: F.lit(False))
    df = df.withColumn("_copies", pinned(copies))

    def short(c: Column, i: Column) -> Column:
        get = lambda n: c[n]
        gone = (F.coalesce(F.get(F.col("_first"), i), F.lit("")) != "") | F.get(F.col("_copies"), i)
        limit = shorten.budget(c["indent"], c["kind"], c["open_tok"], c["close_tok"], opts.max_len)
        return F.when(
            eligible(get, opts) & ~gone,
            let(
                limit,
                lambda n: shorten.shorten(c["inner"], c["inner_lines"], c["kind"], c["doc"], n),
            ),
        )

    df = df.withColumn("_short", pinned(F.transform("comments", short)))
    fields = df.schema["comments"].dataType.elementType.fieldNames()

    def decide(c: Column, i: Column) -> Column:
        get = lambda n: c[n]
        first, lines = F.get(F.col("_first"), i), F.get(F.col("_short"), i)
        changed = ~shorten.same_lines(lines, c["inner_lines"])
        reason = (
            F.when(first != "", first)
            .when(F.get(F.col("_copies"), i), F.lit("duplicate"))
            .when(lines.isNull(), F.lit(None).cast("string"))
            .when(F.size(lines) == 0, F.when(can_delete(get), F.lit("nothing_left")))
            .when(changed, F.lit("shortened"))
        )
        return F.struct(*[c[n].alias(n) for n in fields], reason.alias("reason"), lines.alias("new_lines"))

    df = df.withColumn("comments", F.transform("comments", decide))

    def act(c: Get):
        return {
            "action": F.when(c("reason") == "shortened", F.lit(REPLACE)).when(
                c("reason").isNotNull(), F.lit(DELETE)
            )
        }

    return _with_action(df, act).drop("_banner", "_first", "_copies", "_short")


def edits_of(planned: DataFrame) -> DataFrame:
    """The change log: one row per edit."""
    rows = planned.select("path", F.posexplode_outer("comments").alias("_n", "c")).where(
        F.col("c.action").isNotNull()
    )
    return rows.select(
        "path",
        F.format_string("c%04d", "_n").alias("comment_id"),
        "c.start", "c.end", "c.action",
        F.coalesce("c.new_lines", F.array().cast("array<string>")).alias("lines"),
        "c.reason",
    )


# ---- application ------------------------------------------------------------------
def _spans(df: DataFrame) -> DataFrame:
    """Spans of the decided comments: whole-line deletions and the others."""

    def span(c: Column) -> Column:
        new = F.when(
            c["action"] == REPLACE,
            rewrite.render(
                c["kind"], c["open_tok"], c["close_tok"], c["indent"], c["own_line"], c["new_lines"]
            ),
        ).otherwise(F.lit(""))

        def choose(repl: Column) -> Column:
            gone = rewrite.delete_span(
                c["line"], c["end_line"], c["col"], c["text"], c["gap"], c["follower"], c["lead"],
                c["jsx_wrapped"], c["own_line"], c["trailing"],
            )
            swapped = F.struct(
                rewrite.place(c["line"] - 1, c["col"]).alias("a"),
                rewrite.end_place(c["line"], c["col"], c["text"]).alias("b"),
                F.lit(False).alias("whole"), repl.alias("repl"),
            )
            removed = let(
                gone,
                lambda g: F.struct(
                    g["a"].alias("a"), g["b"].alias("b"), g["whole"].alias("whole"),
                    F.lit("").alias("repl"),
                ),
            )
            return F.when(repl == "", removed).otherwise(swapped)

        return let(new, choose)

    decided = F.filter("comments", lambda c: c["action"].isNotNull())
    return df.withColumn("_spans", pinned(F.transform(decided, span)))


def apply_edits(planned: DataFrame) -> DataFrame:
    """Add ``after``: the text with the decided edits applied."""
    df = _spans(planned)
    whole = F.transform(
        F.filter("_spans", lambda s: s["whole"]), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))
    )
    df = df.withColumn("_whole", pinned(rewrite.merge_lines(whole, F.col("_lines"))))
    other = F.transform(
        F.filter("_spans", lambda s: ~s["whole"]),
        lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["repl"].alias("repl")),
    )
    df = df.withColumn("_cuts", pinned(F.array_sort(F.concat("_whole", other))))
    df = df.withColumn("_cuts", pinned(rewrite.without_overlaps(F.col("_cuts"))))
    changed = F.coalesce(F.size("_cuts") > 0, F.lit(False))
    out = df.withColumn(
        "after",
        F.when(changed, rewrite.stitch(F.col("_lines"), F.col("_cuts"))).otherwise(F.col("text")),
    )
    return out.drop("_spans", "_whole")


def undo_log(applied: DataFrame) -> DataFrame:
    """One row per cut: path, at, removed, repl. With ``after`` it gives the file back, byte by byte."""
    log = rewrite.undo_log(F.col("text"), F.col("_lines"), F.col("_cuts"))
    rows = applied.select("path", F.explode_outer(log).alias("x")).where(F.col("x").isNotNull())
    return rows.select("path", "x.at", "x.removed", "x.repl")


def prove(applied: DataFrame, languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """Add ``reversible`` and ``confirmed``, each apart from the lexer that planned the edits.

    ``reversible``: the text after the edits and the log of what they removed give the
    text before, byte by byte. ``confirmed``: every edited comment is one for an
    automaton that reads the whole file without the lexer's patterns; null where there
    is none for the language. Files without edits are not read.
    """
    log = rewrite.undo_log(F.col("text"), F.col("_lines"), F.col("_cuts"))
    df = applied.withColumn("_log", pinned(F.when(F.size("_cuts") > 0, log)))
    back = F.coalesce(rewrite.undone(F.col("after"), F.col("_log")) == F.col("text"), F.lit(False))
    edited = F.transform(
        F.filter("comments", lambda c: c["action"].isNotNull()),
        lambda c: F.shiftleft(c["start"].cast("bigint"), 32) + c["end"],
    )
    confirmed = None
    for auto in dict.fromkeys(nesting.SECOND_OPINIONS[n] for n in languages if n in nesting.SECOND_OPINIONS):
        names = [n for n in languages if nesting.SECOND_OPINIONS.get(n) is auto]
        same = F.size(F.array_except(edited, nesting.comment_spans(F.col("text"), auto))) == 0
        hit = F.col("lang").isin(*names)
        confirmed = F.when(hit, same) if confirmed is None else confirmed.when(hit, same)
    untouched = F.col("_log").isNull()
    return df.withColumn("reversible", pinned(untouched | back)).withColumn(
        "confirmed", pinned(F.when(untouched, F.lit(True)).otherwise(F.lit(None).cast("boolean") if confirmed is None else confirmed))
    ).drop("_log")


def verify(applied: DataFrame, languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """Add ``ok`` and ``first_difference``: is the code outside comments the same?

    Only changed files are lexed a second time; the tokens of ``text`` are reused.
    """
    wrapped = F.col("lang").isin(*BRACE_WRAPPED)
    df = applied.withColumn(
        "_again", F.when(F.col("after") != F.col("text"), F.col("after"))
    )
    df = lex(df, languages, "_again", "_again_", places=False)
    df = df.withColumn(
        "_code", F.when(F.col("_again").isNotNull(), rewrite.canonical(code_of("_tok", "_is"), wrapped))
    ).withColumn("_code2", rewrite.canonical(code_of("_again_tok", "_again_is"), wrapped))
    df = df.withColumn("ok", F.coalesce(F.col("_code") == F.col("_code2"), F.lit(True)))
    df = df.withColumn(
        "first_difference",
        F.when(~F.col("ok"), rewrite.first_difference(F.col("_code"), F.col("_code2"))),
    )
    return df.drop("_again", "_again_tok", "_again_is", "_code", "_code2")


PLANS = {"delete": plan_delete, "reduce": plan_reduce}


def wanted(mode: str, opts: Options = Options()) -> int:
    """How far comments must be classified for a plan: a score is asked for only from a least one on."""
    return SCORE if opts.min_score > 0 else RESTATED if mode == "reduce" else PROTECTED


def clean_files(files: DataFrame, mode: str = "delete", opts: Options = Options(),
                protections: Protections = Protections(),
                languages: Collection[str] = lexer.LANGUAGES, proof: bool = False) -> DataFrame:
    """Plan, apply and verify in one narrow pass over the files.

    Returns path, lang, before, after, ok, first_difference and the per-file
    counts. ``after`` equals ``before`` where nothing changed. With ``proof`` a file is
    ok only if it is also proved (``prove``); that reads each changed file once more.
    """
    planned = PLANS[mode](classified_arrays(files, protections, languages, wanted(mode, opts)), opts)
    return _summarised(_verified(apply_edits(planned), languages, proof))


def _verified(applied: DataFrame, languages: Collection[str], proof: bool) -> DataFrame:
    out = verify(applied, languages)
    if not proof:
        return out
    out = prove(out, languages)
    failed = F.when(~F.col("reversible"), F.lit("the edits cannot be undone")).when(
        ~F.col("confirmed"), F.lit("an edited region is no comment")
    )
    return out.withColumn("first_difference", F.coalesce("first_difference", failed)).withColumn(
        "ok", F.col("ok") & failed.isNull()
    )


def _summarised(verified: DataFrame, n_protected: Column | None = None) -> DataFrame:
    def count(cond) -> Column:
        return F.size(F.filter("comments", cond))

    saved = count_lines(F.col("text")) - count_lines(F.col("after"))
    columns = {
        "before": F.col("text"),
        "after": F.col("after"),
        "ok": F.col("ok"),
        "first_difference": F.col("first_difference"),
        "deleted": count(lambda c: c["action"] == DELETE),
        "shortened": count(lambda c: c["action"] == REPLACE),
        "protected": count(lambda c: c["protected"].isNotNull()) if n_protected is None else n_protected,
        "lines_saved": saved,
    }
    return verified.select("path", "lang", *[pinned(v).alias(k) for k, v in columns.items()])


def canonical_code(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """path, lang and the code form that cleaning must not change."""
    df = lex(files, languages, places=False)
    wrapped = F.col("lang").isin(*BRACE_WRAPPED)
    return df.select(
        "path", "lang", rewrite.canonical(code_of("_tok", "_is"), wrapped).alias("code")
    )


def strip_comments(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """path, lang and the text with every comment cut out."""
    df = lex(files, languages, places=False)
    return df.select("path", "lang", code_of("_tok", "_is").alias("code"))
