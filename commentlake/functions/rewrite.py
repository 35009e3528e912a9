"""Replacement text, deletion spans and their application.

A place in a file is a line number and a column packed into one BIGINT
(``line * 2^32 + column``, both 0-based), so spans compare as numbers and text
is cut line by line instead of scanning the whole file for each offset.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.functions.hof import (
    find,
    is_blank,
    last_line,
    let,
    newlines,
    prefix,
    rstrip,
    strip,
    sub,
)

SPAN = "struct<a:bigint,b:bigint,repl:string>"


def place(line: Column, col: Column) -> Column:
    return F.shiftleft(line.cast("bigint"), 32) + col


def line_at(p: Column) -> Column:
    return F.shiftright(p, 32).cast("int")


def col_at(p: Column) -> Column:
    return p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def render(
    kind: Column, open_tok: Column, close_tok: Column, indent: Column, own_line: Column, lines: Column
) -> Column:
    """A comment of the same form around new bare lines; '' when they are empty."""
    pad = F.when(own_line, indent).otherwise(F.lit(""))

    def docstring(ls: Column) -> Column:
        head = strip(F.get(ls, F.lit(0)))
        body = F.transform(
            F.slice(ls, F.lit(2), F.size(ls)),
            lambda x: F.when(is_blank(x), F.lit("")).otherwise(rstrip(F.concat(pad, x))),
        )
        many = F.concat(open_tok, head, F.lit("\n"), F.array_join(body, "\n"), F.lit("\n"), pad, open_tok)
        return (
            F.when(F.size(ls) == 0, F.lit(""))
            .when(F.size(ls) == 1, F.concat(open_tok, head, open_tok))
            .otherwise(many)
        )

    def comment(ls: Column) -> Column:
        next_line = F.concat(F.lit("\n"), pad)
        line = F.array_join(F.transform(ls, lambda x: F.concat(open_tok, F.lit(" "), x)), "\n")
        starred = F.array_join(F.transform(ls, lambda x: F.concat(pad, F.lit(" * "), x)), "\n")
        doc = F.concat(F.lit("/**\n"), starred, F.lit("\n"), pad, F.lit(" */"))
        block = F.concat_ws(" ", open_tok, F.array_join(ls, "\n"), close_tok)
        return (
            F.when(F.size(ls) == 0, F.lit(""))
            .when(kind == "line", F.replace(line, F.lit("\n"), next_line))
            .when((open_tok == "/**") & (F.size(ls) > 1), doc)
            .otherwise(F.replace(block, F.lit("\n"), next_line))
        )

    kept = sub(F.array_join(lines, "\n"), r"(?<!\s)\s++\z")
    whole = let(
        kept, lambda k: F.when(k == "", F.array().cast("array<string>")).otherwise(F.split(k, "\n"))
    )
    bare = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    return F.when(kind == "docstring", let(whole, docstring)).otherwise(let(bare, comment))


def end_place(line: Column, col: Column, text: Column) -> Column:
    """Place just after a comment."""
    n = newlines(text)
    return place(
        line - 1 + n, F.when(n > 0, F.length(last_line(text))).otherwise(col + F.length(text))
    )


def delete_span(
    line: Column, end_line: Column, col: Column, text: Column,
    gap: Column, follower: Column, lead: Column, wrapped: Column, own_line: Column, trailing: Column,
) -> Column:
    """struct<a, b, whole>: what goes with a deleted comment.

    Whole lines when nothing else is on them; the blanks before a trailing
    comment; the blanks after a leading one. ``gap`` and ``lead`` count those blanks,
    and ``follower`` is 0 where nothing visible follows on the line.
    """
    end = end_place(line, col, text)
    return (
        F.when(
            wrapped | (own_line & (follower == 0)),
            _span(place(line - 1, F.lit(0)), place(end_line, F.lit(0)), F.lit(True)),
        )
        .when(trailing, _span(place(line - 1, col - gap), end, F.lit(False)))
        .otherwise(_span(place(line - 1, col), end + lead, F.lit(False)))
    )


def _span(a: Column, b: Column, whole: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), whole.alias("whole"))


def merge_lines(spans: Column, lines: Column) -> Column:
    """Merge touching whole-line deletions; take one blank line along when the
    merged group has a blank line (or the file start) before it and one after."""
    last_real = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)

    def blank_at(i: Column) -> Column:
        return is_blank(F.get(lines, i))

    def build(s: Column) -> Column:
        reached = prefix(
            F.transform(s, lambda x: x["b"]), F.lit(-1), "bigint", lambda m, b: F.greatest(m, b)
        )

        def groups(before: Column) -> Column:
            starts = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["a"] > F.get(before, i)
            )

            def one_of(st: Column):
                def one(i: Column, k: Column) -> Column:
                    a = line_at(F.get(s, i)["a"])
                    end = F.greatest(F.get(before, F.size(s) - 1), F.get(s, F.size(s) - 1)["b"])
                    b = line_at(F.coalesce(F.get(before, F.get(st, k + 1)), end))
                    absorb = ((a == 0) | blank_at(a - 1)) & (b < last_real) & blank_at(b)
                    stop = b + F.when(absorb, 1).otherwise(0)
                    return F.struct(
                        place(a, F.lit(0)).alias("a"),
                        place(stop, F.lit(0)).alias("b"),
                        F.lit("").alias("repl"),
                    )

                return one

            return let(starts, lambda st: F.transform(st, one_of(st)))

        return let(reached, groups)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(spans) == 0, none).otherwise(
        let(F.array_sort(spans), build)
    )


def without_overlaps(spans: Column) -> Column:
    """Ascending spans; of two that overlap the later start wins."""

    def resolve(s: Column) -> Column:
        def keep(limits: Column) -> Column:
            return F.filter(s, lambda x, i: x["b"] <= F.get(limits, i))

        far = F.lit((1 << 62))
        # The accumulator is the start of the last span kept so far.
        limits = prefix(
            s, far, "bigint", lambda st, x: F.when(x["b"] <= st, x["a"]).otherwise(st)
        )
        return F.reverse(let(limits, keep))

    clash = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(spans) - 1, F.lit(1))),
        lambda i: F.get(spans, i - 1)["b"] > F.get(spans, i)["a"],
    )
    return F.when(clash, let(F.reverse(spans), resolve)).otherwise(spans)


def stitch(lines: Column, spans: Column) -> Column:
    """The text with every span replaced; ``spans`` ascending and disjoint."""

    def between(start: Column, stop: Column) -> Column:
        la, ca, lb, cb = line_at(start), col_at(start), line_at(stop), col_at(stop)
        first = F.coalesce(F.get(lines, la), F.lit(""))
        last = F.get(lines, lb)
        inner = F.slice(lines, la + 2, F.greatest(lb - la - 1, F.lit(0)))
        many = F.concat(
            F.array(F.substring(first, ca + 1, F.length(first))),
            inner,
            F.when(last.isNull(), F.array().cast("array<string>")).otherwise(
                F.array(F.substring(last, F.lit(1), cb))
            ),
        )
        # Past the last line nothing follows, so its newline is not written.
        return F.when(la >= F.size(lines), F.lit("")).when(
            la == lb, F.substring(first, ca + 1, cb - ca)
        ).otherwise(F.array_join(many, "\n"))

    n = F.size(spans)
    eof = place(F.size(lines) - 1, F.length(F.element_at(lines, -1)))
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            between(F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(spans, i - 1)["b"]), s["a"]),
            s["repl"],
        ),
    )
    tail = between(F.get(spans, n - 1)["b"], eof)
    return F.concat(F.array_join(pieces, ""), tail)


def canonical(code: Column, brace_wrapped: Column) -> Column:
    """Code without trailing blanks, blank lines and braces left empty."""
    bare = F.when(brace_wrapped, sub(code, r"\{\s*+\}")).otherwise(code)
    return sub(sub(bare, r"(?<!\s)\s*\n", "\n"), r"\A\n|(?<!\s)\s++\z")


def first_difference(a: Column, b: Column) -> Column:
    """Where two canonical texts part, for the reject report."""

    def compare(x: Column, y: Column) -> Column:
        n = F.greatest(F.size(x), F.size(y))
        at = F.array_position(
            F.transform(
                F.sequence(F.lit(0), n - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))
            ),
            True,
        ).cast("int")

        def told(i: Column) -> Column:
            def show(v: Column) -> Column:
                return F.coalesce(F.left(strip(F.get(v, i - 1)), F.lit(70)), F.lit("(nothing)"))

            return F.concat(
                F.lit("code line "), i.cast("string"), F.lit(": "), show(x), F.lit(" -> "), show(y)
            )

        return let(at, told)

    return let(F.split(a, "\n"), lambda x: let(F.split(b, "\n"), lambda y: compare(x, y)))


# ---- proof of an edit --------------------------------------------------------------
def undo_log(text: Column, lines: Column, cuts: Column) -> Column:
    """array<struct<at, removed, repl>>: what each cut took from which offset, and what it put there."""

    def log(starts: Column) -> Column:
        def offset(p: Column) -> Column:
            return F.coalesce(F.get(starts, line_at(p)) + col_at(p), F.length(text))

        return F.transform(
            cuts,
            lambda x: let(
                F.struct(offset(x["a"]).alias("a"), offset(x["b"]).alias("b"), x["repl"].alias("repl")),
                lambda c: F.struct(
                    c["a"].alias("at"), F.substring(text, c["a"] + 1, c["b"] - c["a"]).alias("removed"), c["repl"].alias("repl")
                ),
            ),
        )

    sizes = F.transform(lines, lambda x: F.length(x) + 1)
    return let(prefix(sizes, F.lit(0), "int", lambda a, n: a + n), log)


def undone(after: Column, log: Column) -> Column:
    """The text before the edits, from the text after them and the log alone; null if the two do not fit.

    ``moved`` is how far the edits up to an entry have shifted the text.
    """

    def build(moved: Column) -> Column:
        def place_of(i: Column) -> Column:
            return F.get(log, i)["at"] + F.get(moved, i)

        def piece(x: Column, i: Column) -> Column:
            since = F.when(i == 0, F.lit(0)).otherwise(place_of(i - 1) + F.length(F.get(log, i - 1)["repl"]))
            return F.concat(F.substring(after, since + 1, place_of(i) - since), x["removed"])

        fits = F.forall(
            F.transform(log, lambda x, i: F.substring(after, place_of(i) + 1, F.length(x["repl"])) == x["repl"]), lambda ok: ok
        )
        last = F.size(log) - 1
        tail = F.substring(after, place_of(last) + F.length(F.get(log, last)["repl"]) + 1, F.length(after))
        return F.when(fits, F.concat(F.array_join(F.transform(log, piece), ""), tail))

    shift = prefix(log, F.lit(0), "int", lambda a, x: a + F.length(x["repl"]) - F.length(x["removed"]))
    return F.when(F.size(log) == 0, after).otherwise(let(shift, build))
