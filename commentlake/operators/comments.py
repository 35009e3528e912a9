"""Comment extraction, annotation and classification as DataFrame operators.

All work is per file and narrow: tokens, comments and context are array columns
of the file row, and ``extract_comments`` explodes them last. Nothing shuffles,
and a column nobody selects is not computed after the explode.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlake.functions import lexer, protect, score, text
from commentlake.functions.hof import let, newlines, pinned, scan, strip, substr
from commentlake.functions.protect import Protections

Get = Callable[[str], Column]


# Building these expressions takes thousands of calls into the JVM and depends on
# nothing but the arguments, so they are built once per JVM.
def _jvm():
    return SparkContext._jvm


@lru_cache(maxsize=64)
def _lexer_columns(source: str, languages: tuple, prefix: str, jvm) -> dict[str, Column]:
    tok, pos, bol, flag = (prefix + n for n in ("tok", "pos", "bol", "is"))
    return {
        tok: pinned(lexer.tokens(F.col(source), F.col("lang"), languages)),
        pos: pinned(lexer.positions(F.col(tok))),
        bol: pinned(lexer.line_starts(F.col(tok), F.col(pos))),
        flag: pinned(lexer.comment_flags(F.col(tok))),
    }


def lex(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES, source: str = "text",
        prefix: str = "_", places: bool = True) -> DataFrame:
    """Add the tokens of ``source``, their positions and their comment flags."""
    columns = _lexer_columns(source, tuple(languages), prefix, _jvm())
    for name, column in columns.items():
        if places or name.endswith(("tok", "is")):
            files = files.withColumn(name, column)
    return files


def code_of(tok: str, flag: str) -> Column:
    """The text without its comments."""
    return F.array_join(
        F.transform(
            tok, lambda t, i: F.when(F.get(F.col(flag), i), F.lit("")).otherwise(t["tok"])
        ),
        "",
    )


def _located(i: Column) -> Column:
    """struct of the raw facts about the comment at token ``i``."""
    t = F.get(F.col("_tok"), i)
    body, lang = t["tok"], t["lang"]
    start = lexer.offset_of(F.get(F.col("_pos"), i))
    kind = text.kind_of(t["kind"], body, lang)
    before, after = text.sides(F.col("_tok"), F.col("_is"), i, F.col("_before"), F.col("_after"))
    return F.struct(
        start.alias("start"),
        (start + F.length(body)).alias("end"),
        kind.alias("kind"),
        text.is_doc(kind, body, lang).alias("doc"),
        lang.alias("lang"),
        body.alias("text"),
        (lexer.newlines_of(F.get(F.col("_pos"), i)) + 1).alias("line"),
        (start - F.get(F.col("_bol"), i)).alias("col"),
        newlines(body).alias("breaks"),
        F.when(body.endswith("\n"), F.lit(1)).otherwise(F.lit(0)).alias("open_end"),
        before.alias("before"),
        after.alias("after"),
        i.alias("at"),
    )


# Later layers read earlier ones; each is one pass over the comments of a file.
def _layer_lines(c: Get) -> Mapping[str, Column]:
    return {
        "end_line": c("line") + c("breaks") - c("open_end"),
        "open_tok": text.open_mark(c("kind"), c("doc"), c("text")),
        "close_tok": text.close_mark(c("kind"), c("text")),
        "front": text.kind_in(c("before")),
        "gap": text.count_in(c("before")),
        # A comment that ends with its line has nothing after it there.
        "follower": F.when(c("open_end") == 1, F.lit(0)).otherwise(text.kind_in(c("after"))),
        "lead": F.when(c("open_end") == 1, F.lit(0)).otherwise(text.count_in(c("after"))),
    }


def _layer_place(c: Get) -> Mapping[str, Column]:
    # Blank up to the comment: the first one on its line, so no line is cut twice.
    alone = substr(F.coalesce(F.get(F.col("_lines"), c("line") - 1), F.lit("")), F.lit(0), c("col"))
    return {
        "jsx_wrapped": (c("kind") == "block") & (c("front") == 1) & (c("follower") == ord("}")),
        "indent": F.when(c("front") == 0, alone).otherwise(F.get(F.col("_indents"), c("line") - 1)),
    }


def _same_line(c: Get) -> Column:
    return strip(substr(F.coalesce(F.get(F.col("_lines"), c("line") - 1), F.lit("")), F.lit(0), c("col")))


def _layer_same(c: Get) -> Mapping[str, Column]:
    return {"code_same_line": _same_line(c)}


def _layer_before(c: Get) -> Mapping[str, Column]:
    first = F.greatest(F.lit(1), c("line") - 3)
    return {
        "code_before": text.context(F.col("_real_lines"), first, F.least(F.lit(3), c("line") - 1))
    }


def _layer_after(c: Get) -> Mapping[str, Column]:
    return {"code_after": text.context(F.col("_real_lines"), c("end_line") + 1, F.lit(3))}


def _layer_following(c: Get) -> Mapping[str, Column]:
    found = text.next_statement(F.col("_real_lines"), c("end_line"))
    return {"following": F.when(c("kind") == "docstring", found)}


CONTEXT = {"same": _layer_same, "before": _layer_before, "after": _layer_after, "following": _layer_following}


def _layer_own(c: Get) -> Mapping[str, Column]:
    own = c("jsx_wrapped") | (c("front") == 0)
    return {"own_line": own, "trailing": ~own}


def _layer_text(c: Get) -> Mapping[str, Column]:
    return {**_layer_own(c), "inner_lines": text.bare_lines(c("kind"), c("text"))}


def _layer_inner(c: Get) -> Mapping[str, Column]:
    return {"inner": text.joined(c("inner_lines"))}


def _layer_sole(c: Get) -> Mapping[str, Column]:
    return {"sole_statement": text.is_sole_statement(c("kind"), c("indent"), c("following"))}


LOCATED = ("start", "end", "kind", "doc", "lang", "text", "line", "col", "breaks", "open_end", "before", "after", "at")


def comment_arrays(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES,
                   context: Collection[str] = tuple(CONTEXT)) -> DataFrame:
    """Add ``comments``: array of located comments with their surroundings.

    ``context`` limits which neighbouring lines are copied into each comment.
    """
    out = lex(files, languages)
    out = out.withColumn("_lines", pinned(F.split("text", "\n")))
    out = out.withColumn("_before", pinned(text.all_before(F.col("_tok"), F.col("_is"))))
    out = out.withColumn("_after", pinned(text.all_after(F.col("_tok"), F.col("_is"))))
    places = F.filter(
        F.transform(F.col("_is"), lambda f, i: F.when(f, i).otherwise(F.lit(-1))), lambda i: i >= 0
    )
    out = out.withColumn("comments", pinned(F.transform(places, _located)))
    names = list(LOCATED)
    out, names = add_fields(out, names, _layer_lines)
    behind = F.exists("comments", lambda c: c["front"] != 0)
    out = out.withColumn("_indents", pinned(F.when(behind, text.indents(F.col("_lines")))))
    out = out.withColumn("_real_lines", pinned(text.lines_of(F.col("text"))))
    for layer in (_layer_place, *(CONTEXT[name] for name in context)):
        out, names = add_fields(out, names, layer)
    return out


def add_fields(df: DataFrame, names: list[str], layer: Callable[[Get], Mapping[str, Column]],
               array: str = "comments") -> tuple[DataFrame, list[str]]:
    """One pass over an array of structs that appends the fields of ``layer``."""
    column, names = _grown(layer, tuple(names), array, _jvm())
    return df.withColumn(array, column), list(names)


@lru_cache(maxsize=256)
def _grown(layer, names: tuple, array: str, jvm) -> tuple[Column, tuple]:
    added: list[str] = []

    def grow(c: Column) -> Column:
        new = layer(lambda n: c[n])
        added.extend(n for n in new if n not in added)
        kept = [c[n].alias(n) for n in names if n not in new]
        return F.struct(*kept, *[v.alias(n) for n, v in new.items()])

    column = F.transform(array, grow)
    return column, tuple(n for n in names if n not in added) + tuple(added)


@lru_cache(maxsize=64)
def _row_columns(layer, jvm) -> dict[str, Column]:
    return dict(layer(F.col))


@lru_cache(maxsize=None)
def _layer_protect(prot: Protections):
    def layer(c: Get) -> Mapping[str, Column]:
        code = protect.reason(c("text"), c("line"), c("kind"), c("doc"), prot)
        return {"protected": code}

    return layer


def _layer_restated(c: Get) -> Mapping[str, Column]:
    near = F.when(c("trailing"), c("code_same_line")).otherwise(F.substring_index(c("code_after"), "\n", 2))
    return {"restated": score.restates(c("inner"), near)}


#: Lines of code before comments may be read so many times the file's length; beyond it they are read once, by a fold.
REREAD = 4


def _line_shares() -> Column:
    """``restated`` of every trailing comment, from one vocabulary that grows along each line.

    The code before a comment is that before the last one on its line, that comment
    and what follows it: only the new part is read.
    """
    toks = F.col("_tok")

    def part(c: Column, i: Column) -> Column:
        """(text since the last comment began, whether the line began in it, words asked for)."""
        since = F.coalesce(F.get(F.col("comments"), i - 1)["at"], F.lit(0))
        run = F.array_join(F.transform(F.slice(toks, since + 1, c["at"] - since), lambda t: t["tok"]), "")
        return let(run, lambda r: F.struct(
            text.last_line(r).alias("code"), F.contains(r, F.lit("\n")).alias("fresh"),
            F.when(c["trailing"], score.content(c["inner"])).alias("words"),
        ))

    def step(state: Column, x: Column) -> Column:
        # The state is the vocabulary, then the last characters of the line so far.
        known = F.when(x["fresh"], F.lit(" ")).otherwise(F.substring_index(state, "\n", 1))
        tail = F.when(x["fresh"], F.lit("")).otherwise(F.substring_index(state, "\n", -1))

        def told(vocab: Column) -> Column:
            return F.struct(
                F.concat(vocab, F.lit("\n"), F.right(F.concat(tail, x["code"]), F.lit(4))).alias("st"),
                F.when(x["words"].isNotNull(), score.share_in(x["words"], vocab)).alias("out"),
            )

        whole = F.concat(x["code"], F.lit(" "), score.crosses(tail, x["code"]))
        return let(let(known, lambda k: score.grown(k, whole)), told)

    return scan(F.transform("comments", part), F.lit(" \n"), "string", "double", step)


def _with_restated(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Add ``restated`` from the lines of the file: no comment holds a copy of its surroundings."""
    df = df.withColumns(_restated_columns(_jvm())).withColumn("_below", _below_column(_jvm()))
    column, names = _indexed_restated(tuple(names), _jvm())
    return df.withColumn("comments", column), list(names)


def _line_at(k: Column) -> Column:
    return F.coalesce(F.get(F.col("_real_lines"), k), F.lit(""))


@lru_cache(maxsize=8)
def _restated_columns(jvm) -> dict[str, Column]:
    asks = lambda c: c["trailing"] & F.contains(c["inner"], F.lit(" "))  # noqa: E731  two words or more
    read = F.aggregate("comments", F.lit(0).cast("bigint"), lambda a, c: a + F.when(asks(c), c["col"]).otherwise(F.lit(0)))
    return {
        "_shares": pinned(F.when(read > REREAD * F.length("text"), _line_shares())),
        "_words": pinned(F.transform("comments", lambda c: score.content(c["inner"]))),
    }


@lru_cache(maxsize=8)
def _below_column(jvm) -> Column:
    """The vocabulary of the line below each comment that is compared with it."""

    def one(c: Column, i: Column) -> Column:
        return F.when(~c["trailing"] & (F.size(F.get("_words", i)) >= 2), score.vocabulary(_line_at(c["end_line"])))

    return pinned(F.transform("comments", one))


@lru_cache(maxsize=64)
def _indexed_restated(names: tuple, jvm) -> tuple[Column, tuple]:
    def one(c: Column, i: Column) -> Column:
        ws = F.get("_words", i)
        # The second line below a comment is mostly the first one below the next comment.
        after = F.get("comments", i + 1)["end_line"] == c["end_line"] + 1
        second = F.coalesce(F.when(after, F.get("_below", i + 1)), score.vocabulary(_line_at(c["end_line"] + 1)))
        beside = let(_same_line(lambda n: c[n]), lambda code: score.share_of(ws, code))
        below = let(F.concat(F.get("_below", i), second), lambda v: score.share_in(ws, v))
        share = F.when(F.size(ws) >= 2, F.when(c["trailing"], beside).otherwise(below)).otherwise(F.lit(0.0))
        return F.struct(*[c[n].alias(n) for n in names], F.coalesce(F.get(F.col("_shares"), i), share).alias("restated"))

    return F.transform("comments", one), (*names, "restated")


def _layer_rules(c: Get) -> Mapping[str, Column]:
    n_lines = c("end_line") - c("line") + 1
    return {
        "rules": score.parts(c("inner"), c("inner_lines"), c("kind"), n_lines, c("restated"))
    }


def _layer_points(c: Get) -> Mapping[str, Column]:
    return {"ai_score": score.score(c("rules"))}


def _layer_score(c: Get) -> Mapping[str, Column]:
    n_lines = c("end_line") - c("line") + 1
    return {
        "ai_score": score.score(c("rules")),
        "ai_reasons": score.reasons(c("rules"), n_lines),
        "protected_by": protect.detail(c("text"), c("protected")),
    }


DESCRIBE = (_layer_text, _layer_inner, _layer_sole)
RATE = (_layer_rules, _layer_score)


#: How far comments are classified; each includes those before it.
PROTECTED, RESTATED, SCORE, REASONS = range(4)


def classified_arrays(files: DataFrame, protections: Protections = Protections(),
                      languages: Collection[str] = lexer.LANGUAGES, upto: int = REASONS) -> DataFrame:
    """``comment_arrays`` with annotation and classification in place, without copies of neighbouring lines.

    What a lambda computes is never pruned, so ``upto`` says what is wanted: PROTECTED
    (nothing is scored), RESTATED, SCORE or REASONS (everything).
    """
    out = comment_arrays(files, languages, context=("following",))
    names = out.schema["comments"].dataType.elementType.fieldNames()
    for layer in (*DESCRIBE, _layer_protect(protections)):
        out, names = add_fields(out, names, layer)
    if upto >= RESTATED:
        out, names = _with_restated(out, names)
    for layer in {SCORE: (_layer_rules, _layer_points), REASONS: RATE}.get(upto, ()):
        out, names = add_fields(out, names, layer)
    return out.withColumn("comments", pinned(F.col("comments")))


def file_counts(files: DataFrame, protections: Protections = Protections(),
                languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """One row per file with its comment counts, in one pass and without a shuffle."""
    out = comment_arrays(files, languages, context=())
    names = out.schema["comments"].dataType.elementType.fieldNames()
    for layer in (_layer_text, _layer_inner, _layer_protect(protections)):
        out, names = add_fields(out, names, layer)
    out, names = _with_restated(out, names)
    for layer in (_layer_rules, _layer_points):
        out, names = add_fields(out, names, layer)

    def count(cond) -> Column:
        return F.size(F.filter("comments", cond))

    def filler(c: Column) -> Column:
        return c["ai_score"] >= score.FLAGGED

    spans = F.transform("comments", lambda c: c["end_line"] - c["line"] + 1)
    columns = {
        "comments": F.size("comments"),
        "changeable": count(lambda c: c["protected"].isNull()),
        "flagged": count(lambda c: c["protected"].isNull() & filler(c)),
        "protected": count(lambda c: c["protected"].isNotNull()),
        "hidden_docs": count(lambda c: (c["protected"] == protect.API_DOC) & filler(c)),
        "comment_lines": F.aggregate(spans, F.lit(0), lambda a, n: a + n),
        "total_lines": text.count_lines(F.col("text")),
    }
    return out.select("path", "lang", *[pinned(v).alias(k) for k, v in columns.items()])


def file_regions(files: DataFrame) -> DataFrame:
    """The parts of each file that have a syntax of their own, in order."""
    region = (
        F.when(F.col("lang").isin(*lexer.MARKUP), lexer.markup_regions(F.col("text")))
        .when(F.col("lang") == "php", lexer.php_regions(F.col("text")))
        .otherwise(F.array(F.struct(F.col("lang").alias("lang"), F.col("text").alias("body"))))
    )
    df = files.withColumn("_regions", pinned(region))
    sizes = F.transform("_regions", lambda r: F.length(r["body"]))
    df = df.withColumn(
        "_starts", pinned(lexer.prefix(sizes, F.lit(0), "int", lambda a, n: a + n))
    )
    placed = F.transform(
        "_regions",
        lambda r, i: F.struct(
            F.get("_starts", i).alias("start"),
            (F.get("_starts", i) + F.length(r["body"])).alias("end"),
            r["lang"].alias("sublang"), r["body"].alias("body"),
        ),
    )
    rows = df.select("path", F.posexplode_outer(placed).alias("region_no", "r"))
    return rows.select("path", "region_no", "r.*")


def extract_comments(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES,
                     context: Collection[str] = tuple(CONTEXT),
                     keep: Collection[str] = ()) -> DataFrame:
    """One row per comment, in file order: where it is and what surrounds it.

    ``keep`` names further columns of ``files`` to carry along.
    """
    arrays = comment_arrays(files, languages, context)
    # Outer, because for a plain explode Catalyst infers a filter on the array and
    # pushes a copy of everything that computes it towards the scan.
    rows = arrays.select("path", *keep, F.posexplode_outer("comments").alias("_n", "c"))
    return rows.where(F.col("_n").isNotNull()).select(
        "path", *keep, F.format_string("c%04d", "_n").alias("comment_id"), "c.*"
    )


def _found(i: Column) -> Column:
    """struct of what the comment at token ``i`` says by itself."""
    t = F.get(F.col("_tok"), i)
    body, lang = t["tok"], t["lang"]
    start = lexer.offset_of(F.get(F.col("_pos"), i))
    kind = text.kind_of(t["kind"], body, lang)
    return F.struct(
        start.alias("start"), (start + F.length(body)).alias("end"), kind.alias("kind"),
        text.is_doc(kind, body, lang).alias("doc"), lang.alias("lang"), body.alias("text"),
    )


def _layer_mark(c: Get) -> Mapping[str, Column]:
    return {"open_tok": text.open_mark(c("kind"), c("doc"), c("text"))}


FOUND = ("start", "end", "kind", "doc", "lang", "text")


def list_comments(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """One row per comment like ``extract_comments``, with nothing about its lines.

    What a lambda computes is never pruned, so a job that wants no lines, columns or
    neighbours asks for none here: path, comment_id, FOUND and open_tok.
    """
    out = lex(files, languages)
    places = F.filter(
        F.transform(F.col("_is"), lambda f, i: F.when(f, i).otherwise(F.lit(-1))), lambda i: i >= 0
    )
    out = out.withColumn("comments", pinned(F.transform(places, _found)))
    out, _ = add_fields(out, list(FOUND), _layer_mark)
    rows = out.select("path", F.posexplode_outer("comments").alias("_n", "c"))
    return rows.where(F.col("_n").isNotNull()).select(
        "path", F.format_string("c%04d", "_n").alias("comment_id"), "c.*"
    )


def text_arrays(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES, source: str = "text") -> DataFrame:
    """Add ``comments``: the texts of the comments of ``source`` alone, by number; null where there is no text."""
    out = lex(files, languages, source, places=False)
    places = F.filter(
        F.transform(F.col("_is"), lambda f, i: F.when(f, i).otherwise(F.lit(-1))), lambda i: i >= 0
    )
    return out.withColumn("comments", pinned(F.transform(places, lambda i: F.get(F.col("_tok"), i)["tok"])))


def list_texts(files: DataFrame, languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """One row per comment like ``list_comments``, with path, comment_id and text alone: no place is worked out."""
    rows = text_arrays(files, languages).select("path", F.posexplode_outer("comments").alias("_n", "text"))
    return rows.where(F.col("_n").isNotNull()).select("path", F.format_string("c%04d", "_n").alias("comment_id"), "text")


def placed_arrays(files: DataFrame, protections: Protections = Protections(),
                  languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """``comment_arrays`` with what an edit's place needs, and ``_protected`` beside it.

    A field that a lambda computes is never pruned, a column is: who asks for no
    protection reads none.
    """
    out = comment_arrays(files, languages, context=())
    names = out.schema["comments"].dataType.elementType.fieldNames()
    out, _ = add_fields(out, names, _layer_own)
    out = out.withColumn("comments", pinned(F.col("comments")))
    layer = _layer_protect(protections)
    return out.withColumn("_protected", pinned(F.transform("comments", lambda c: layer(lambda n: c[n])["protected"])))


def annotate(comments: DataFrame) -> DataFrame:
    """Bare text, own-line and sole-statement flags."""
    return _apply(comments, DESCRIBE)


def classify(comments: DataFrame, protections: Protections = Protections()) -> DataFrame:
    """Protection code and detail, style score and its reasons."""
    rated = _apply(comments, (_layer_protect(protections), _layer_restated, *RATE))
    return rated.withColumns({n: pinned(F.col(n)) for n in ("protected", "ai_score")})


def _apply(df: DataFrame, layers) -> DataFrame:
    for layer in layers:
        df = df.withColumns(_row_columns(layer, _jvm()))
    return df


COMMENT_COLUMNS = (
    "path", "comment_id", "start", "end", "kind", "doc", "lang", "text", "open_tok", "close_tok",
    "line", "end_line", "col", "indent", "own_line", "trailing", "inner", "inner_lines",
    "code_before", "code_after", "code_same_line", "jsx_wrapped", "sole_statement", "protected",
    "protected_by", "ai_score", "ai_reasons",
)


def scan_comments(files: DataFrame, protections: Protections = Protections(),
                  languages: Collection[str] = lexer.LANGUAGES) -> DataFrame:
    """The full ``comments`` table: extract, annotate, classify."""
    found = classify(annotate(extract_comments(files, languages)), protections)
    return found.select(*COMMENT_COLUMNS)
