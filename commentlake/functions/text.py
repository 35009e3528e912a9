"""Bare text of comments, and their place in the surrounding lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.functions.hof import (
    find,
    is_blank,
    last_line,
    let,
    lstrip,
    newlines,
    prefix,
    rstrip,
    strip,
    sub,
)

# Comment marks removed from the start of a line, in this order.
OPENING_MARKS = (
    r"<!--|-->|/\*\*|\*/|/\*|///|//!|//|--\[\[|\]\]|=begin|=end|--|#|;"
)
# ... and from its end, innermost last.
CLOSING_MARKS = r"(?:\]\])?(?:\*/)?(?:-->)?\z"
LEADING_STAR = r"\A\s*\*(?!/)"

TAB_STOP = r" {4}| {0,3}\t"
LOOKAHEAD_LINES = 32


def lines_of(text: Column) -> Column:
    """Lines without a final empty one when the text ends with a newline."""
    body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def count_lines(text: Column) -> Column:
    return newlines(text) + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def kind_of(token_kind: Column, text: Column, lang: Column) -> Column:
    block = text.startswith("/*") | text.startswith("<!--") | text.startswith("=begin")
    block = block | ((lang == "lua") & text.startswith("--[["))
    return (
        F.when(token_kind == 2, F.lit("docstring")).when(block, F.lit("block")).otherwise(F.lit("line"))
    )


def is_doc(kind: Column, text: Column, lang: Column) -> Column:
    block = (lang != "sql") & text.startswith("/**") & ~text.startswith("/**/")
    line = lang.isin("c", "csharp", "rust", "swift") & (
        text.startswith("///") | text.startswith("//!")
    )
    return F.when(kind == "docstring", F.lit(True)).when(kind == "block", block).otherwise(line)


def _quote(text: Column) -> Column:
    near = F.substring(text, 1, 6)
    return F.when(F.contains(near, F.lit('"""')), F.lit('"""')).otherwise(F.lit("'''"))


def open_mark(kind: Column, doc: Column, text: Column) -> Column:
    block = F.when(doc, F.lit("/**")).otherwise(find(text, r"\A(?:/\*|<!--|=begin|--\[\[)"))
    line = F.when(doc, F.left(text, F.lit(3))).otherwise(find(text, r"\A(?://|--|#|;)"))
    return F.when(kind == "docstring", _quote(text)).when(kind == "block", block).otherwise(line)


def close_mark(kind: Column, text: Column) -> Column:
    block = (
        F.when(text.startswith("/*"), F.lit("*/"))
        .when(text.startswith("<!--"), F.lit("-->"))
        .when(text.startswith("=begin"), F.lit("=end"))
        .otherwise(F.lit("]]"))
    )
    return (
        F.when(kind == "docstring", _quote(text)).when(kind == "block", block).otherwise(F.lit(""))
    )


def _docstring_lines(text: Column) -> Column:
    def dedented(body: Column) -> Column:
        head = strip(F.substring_index(body, "\n", 1))
        rest = F.when(
            F.contains(body, F.lit("\n")),
            F.split(F.substring(body, F.length(F.substring_index(body, "\n", 1)) + 2, F.length(body)), "\n"),
        ).otherwise(F.array().cast("array<string>"))

        def shift(lines: Column) -> Column:
            indents = F.transform(
                F.filter(lines, lambda x: ~is_blank(x)), lambda x: F.length(find(x, r"\A[ \t]*"))
            )
            return let(
                F.coalesce(F.array_min(indents), F.lit(0)),
                lambda n: F.transform(lines, lambda x: rstrip(F.substring(x, n + 1, F.length(x)))),
            )

        joined = F.rtrim(F.array_join(F.concat(F.array(head), let(rest, shift)), "\n"), F.lit("\n"))
        return let(
            joined,
            lambda j: F.when(j == "", F.array().cast("array<string>")).otherwise(F.split(j, "\n")),
        )

    mark = F.when(F.contains(text, F.lit('"""')), F.lit('"""')).otherwise(F.lit("'''"))
    body = let(
        mark,
        lambda q: let(
            F.substring(text, F.position(q, text) + 3, F.length(text)),
            lambda b: F.when(F.endswith(b, q), F.left(b, F.length(b) - 3)).otherwise(b),
        ),
    )
    return let(body, dedented)


def _unclosed(line: Column) -> Column:
    marked = line.endswith("]]") | line.endswith("*/") | line.endswith("-->")
    return F.when(marked, sub(line, CLOSING_MARKS)).otherwise(line)


def bare_lines(kind: Column, text: Column) -> Column:
    """Text lines without delimiters and decoration."""

    def bare(line: Column) -> Column:
        opened = sub(strip(line), rf"\A(?:{OPENING_MARKS})")
        return strip(sub(let(opened, _unclosed), LEADING_STAR))

    plain = F.transform(lines_of(text), bare)
    return F.when(kind == "docstring", _docstring_lines(text)).otherwise(plain)


def joined(lines: Column) -> Column:
    return strip(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def indent_width(indent: Column) -> Column:
    return F.length(sub(indent, TAB_STOP, "    "))


def next_statement(lines: Column, end_line: Column) -> Column:
    """First later line that is neither blank nor a ``#`` comment, else null."""

    def first(block: Column) -> Column:
        return F.get(F.filter(block, lambda x: ~is_blank(x) & ~lstrip(x).startswith("#")), F.lit(0))

    near = first(F.slice(lines, end_line + 1, F.lit(LOOKAHEAD_LINES)))
    far = first(F.slice(lines, end_line + 1 + LOOKAHEAD_LINES, F.greatest(F.size(lines), F.lit(1))))
    return F.coalesce(near, far)


def is_sole_statement(kind: Column, indent: Column, following: Column) -> Column:
    """An indented docstring with no sibling statement must stay."""
    sibling = indent_width(find(following, r"\A\s*"))
    return (
        (kind == "docstring")
        & (indent != "")
        & F.coalesce(sibling < indent_width(indent), F.lit(True))
    )


# ---- what stands around a comment on its lines -----------------------------------
# Two packed numbers per comment instead of its line's text, so that a line of very
# many comments costs as much as its length. Before: whether the line holds nothing
# (0), one opening brace (1) or more (2) up to the comment, and the blanks right before
# it. After: the code of the first visible character on the rest of the line (0 for
# none), and the blanks right after it.
BLANKS = " \t"


def _packed(kind: Column, count: Column) -> Column:
    return F.shiftleft(kind.cast("bigint"), 32) + count


def kind_in(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def count_in(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _ends(part: Column) -> Column:
    """The fact before what follows ``part``, the last line of a token."""
    kind = let(
        lstrip(part),
        lambda x: F.when(x == "", F.lit(0)).when(x.startswith("{") & is_blank(F.substring(x, 2, 1 << 30)), F.lit(1)).otherwise(F.lit(2)),
    )
    return _packed(kind, F.length(part) - F.length(F.rtrim(part, F.lit(BLANKS))))


def _begins(part: Column) -> Column:
    """The fact after what precedes ``part``, the first line of a token."""
    return _packed(F.ascii(lstrip(part)), F.length(part) - F.length(F.ltrim(part, F.lit(BLANKS))))


def _breaks(tok: Column) -> Column:
    return F.contains(tok, F.lit("\n"))


def sides(toks: Column, flags: Column, i: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """(before, after) of the comment at token ``i``.

    Mostly the neighbouring token alone says it; ``before`` and ``after`` hold the
    facts of all tokens in files where it does not.
    """
    ahead, behind = F.get(toks, i - 1)["tok"], F.get(toks, i + 1)["tok"]
    front = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(_ends(last_line(ahead)))
    back = F.when(behind.isNull(), F.lit(0).cast("bigint")).otherwise(_begins(F.substring_index(behind, "\n", 1)))
    return F.coalesce(F.get(before, i), front), F.coalesce(F.get(after, F.size(toks) - 1 - i), back)


def all_before(toks: Column, flags: Column) -> Column:
    """Facts before every token; null where no comment needs more than its neighbour."""
    crowded = F.exists(
        F.sequence(F.lit(2), F.greatest(F.size(toks) - 1, F.lit(2))),
        lambda i: F.coalesce(F.get(flags, i), F.lit(False)) & ~F.coalesce(_breaks(F.get(toks, i - 1)["tok"]), F.lit(True)),
    )

    def one(t: Column) -> Column:
        part = last_line(t["tok"])
        return F.struct(_breaks(t["tok"]).alias("cut"), F.length(part).alias("size"), _ends(part).alias("fact"))

    def step(state: Column, x: Column) -> Column:
        k, n = kind_in(x["fact"]), count_in(x["fact"])
        kind = F.when(k == 0, kind_in(state)).when(kind_in(state) == 0, k).otherwise(F.lit(2))
        return F.when(x["cut"], x["fact"]).otherwise(
            _packed(kind, n + F.when(n == x["size"], count_in(state)).otherwise(F.lit(0)))
        )

    return F.when(crowded, let(F.transform(toks, one), lambda a: prefix(a, F.lit(0), "bigint", step)))


def all_after(toks: Column, flags: Column) -> Column:
    """Facts after every token, the last token's first; null as above."""
    crowded = F.exists(
        F.sequence(F.lit(0), F.greatest(F.size(toks) - 3, F.lit(0))),
        lambda i: F.coalesce(F.get(flags, i), F.lit(False)) & (i < F.size(toks) - 2) & ~F.coalesce(_breaks(F.get(toks, i + 1)["tok"]), F.lit(True)),
    )

    def one(t: Column) -> Column:
        part = F.substring_index(t["tok"], "\n", 1)
        return F.struct(_breaks(t["tok"]).alias("cut"), F.length(part).alias("size"), _begins(part).alias("fact"))

    def step(state: Column, x: Column) -> Column:
        k, n = kind_in(x["fact"]), count_in(x["fact"])
        return F.when(x["cut"], x["fact"]).otherwise(
            _packed(F.when(k == 0, kind_in(state)).otherwise(k), n + F.when(n == x["size"], count_in(state)).otherwise(F.lit(0)))
        )

    return F.when(crowded, let(F.transform(F.reverse(toks), one), lambda a: prefix(a, F.lit(0), "bigint", step)))


def indents(lines: Column) -> Column:
    """The blanks that each line begins with."""
    return F.transform(lines, lambda x: F.left(x, F.length(x) - F.length(F.ltrim(x, F.lit(BLANKS)))))


def context(lines: Column, first: Column, count: Column) -> Column:
    """``count`` lines from 1-based ``first`` on, joined."""
    return F.array_join(F.slice(lines, first, F.greatest(count, F.lit(0))), "\n")

