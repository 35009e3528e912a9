"""Small helpers over Spark's array functions.

Everything here is a Column expression: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip() sees it; passed to Spark's trim functions.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(n) for n in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


# Trimming by a set of characters looks each one up in the whole set and measures the
# whole text, so texts that begin and end with visible ASCII are told apart first.
def _visible(first: Column) -> Column:
    return F.ascii(first).isin(*range(33, 127))


def strip(c: Column) -> Column:
    ends = lambda x: _visible(x) & _visible(F.substring(x, -1, 1))
    return let(c, lambda x: F.when(ends(x), x).otherwise(F.btrim(x, F.lit(WHITESPACE))))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return ~_visible(c) & (lstrip(c) == F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Inside a lambda Catalyst neither shares common sub-expressions nor adds a
    projection, so naming a value needs a one-element array. It is read by
    ``element_at``, which knows its type once; ``get`` works the type of the whole
    body out again at every call.
    """
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def pinned(c: Column) -> Column:
    """The same value, computed once where it is defined.

    Catalyst copies expressions in two places that hurt here. A column used once
    is inlined at its use, even when that is inside a lambda, where it would run
    once per array element; and a filter on a derived column is pushed below its
    projection with a copy of the whole expression, level by level. Neither
    happens to a projection that reads the partition id. Filter ``files`` (path,
    language, size) before extraction: those predicates reach the scan.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def replace_lit(c: Column, what: str, by: str = "") -> Column:
    return F.replace(c, F.lit(what), F.lit(by))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(replace_lit(c, "\n"))


def last_line(c: Column) -> Column:
    return F.substring_index(c, "\n", -1)


def substr(c: Column, start: Column, length: Column) -> Column:
    """Substring from a 0-based start."""
    return F.substring(c, start + 1, length)


def rlike(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def find(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def any_of(patterns, heads: str = "") -> str:
    """One pattern for many; anchored ones are left at the first character.

    ``heads`` is a pattern of what the others begin with: where it fails they are not tried.
    """
    patterns = list(patterns)
    at_start = [p for p in patterns if p.startswith("^")]
    anywhere = [p for p in patterns if not p.startswith("^")]
    if anywhere and heads:
        anywhere = [f"(?={heads})(?:{'|'.join(anywhere)})"]
    return "(?iU)" + "|".join([rf"\A(?:{'|'.join(at_start)})", *anywhere])


def case(branches: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def block_of(a: Column, k: Column, size: Column) -> Column:
    """The k-th block of an array; an array of one block is not copied."""
    return F.when(F.size(a) <= size, a).otherwise(F.slice(a, k * size + 1, size))


#: Elements that a running fold takes in one block.
ONE_BLOCK = 32


def prefix(
    arr: Column, init: Column, sql_type: str, combine: Callable[[Column, Column], Column]
) -> Column:
    """Exclusive running fold: the state *before* each element.

    Spark copies a fold's accumulator at every step, so growing an array inside
    ``aggregate`` is quadratic. Folding over blocks of about sqrt(n) elements
    keeps a file with half a million tokens affordable, and the state is a
    scalar so that the copies stay flat. Up to ``ONE_BLOCK`` elements are one block,
    without the fold over blocks around it.
    """
    none = F.array().cast(f"array<{sql_type}>")

    def fold(block: Column, state: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(state.alias("st"), none.alias("out")),
            lambda acc, x: F.struct(
                combine(acc["st"], x).cast(sql_type).alias("st"),
                F.array_append(acc["out"], acc["st"]).alias("out"),
            ),
        )

    def blocked(a: Column, size: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))
        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.struct(init.cast(sql_type).alias("st"), none.alias("out")),
            lambda acc, k: let(
                fold(block_of(a, k, size), acc["st"]),
                lambda r: F.struct(
                    r["st"].alias("st"), F.concat(acc["out"], r["out"]).alias("out")
                ),
            ),
        )["out"]

    return let(
        arr,
        lambda a: F.when(F.size(a) <= ONE_BLOCK, fold(a, init.cast(sql_type))["out"]).otherwise(
            let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda b: blocked(a, b))
        ),
    )


def scan(
    arr: Column, init: Column, state_type: str, out_type: str,
    step: Callable[[Column, Column], Column],
) -> Column:
    """Running fold with an output per element: ``step`` gives struct<st: next state, out: output>.

    In blocks of about sqrt(n) like ``prefix``.
    """
    none = F.array().cast(f"array<{out_type}>")

    def fold(block: Column, state: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["st"], x), lambda r: F.struct(r["st"].alias("st"), F.array_append(acc["out"], r["out"]).alias("out")))

        return F.aggregate(block, F.struct(state.alias("st"), none.alias("out")), one)

    def blocked(a: Column, size: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))
        return F.aggregate(
            F.sequence(F.lit(0), last),
            F.struct(init.cast(state_type).alias("st"), none.alias("out")),
            lambda acc, k: let(
                fold(block_of(a, k, size), acc["st"]),
                lambda r: F.struct(r["st"].alias("st"), F.concat(acc["out"], r["out"]).alias("out")),
            ),
        )["out"]

    return let(
        arr,
        lambda a: let(
            F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda b: blocked(a, b)
        ),
    )
