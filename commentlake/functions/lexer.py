"""Tiling lexer: one generated regular expression per language.

``regexp_extract_all`` cuts a text into maximal runs of non-comment text and
single comments, so the pieces always concatenate back to the input. Quantifiers
over groups are possessive: Java runs those iteratively, which is what lets one
string literal be hundreds of kilobytes long without a stack overflow. Where a
construct nests (templates, some block comments), its opener comes out alone and
``nesting`` reads the file from there on.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.dims import MARKUP, SYNTAX, Str, Syntax
from commentlake.functions.hof import (
    case,
    find_all,
    is_blank,
    last_line,
    let,
    newlines,
    prefix,
    rlike,
    sub,
)
from commentlake.functions.nesting import AUTOMATA, JS_REGEX_BODY, REGEX_AFTER, REGEX_WORDS, resolved

BLANK = r"[ \t\n\r\f\x0B]"
AFTER_BLANK = r"(?<![^ \t\n\r\f\x0B])"


def _q(text: str) -> str:
    """Quote a literal for a Java pattern, also inside a character class."""
    return "".join("\\" + ch if not (ch.isalnum() or ch in " _") else ch for ch in text)


def string_pattern(s: Str) -> str:
    q, first = _q(s.quote), _q(s.quote[0])
    stop = first + (r"\\" if s.escape else "") + ("" if s.multiline else r"\n")
    parts = [f"[^{stop}]++"]
    if s.escape:
        parts.append(r"\\(?s:.|\z)")
    if s.doubled:
        parts.append(q + q)
    if len(s.quote) > 1:
        parts.append(f"{first}(?!{_q(s.quote[1:])})")
    return f"{q}(?:{'|'.join(parts)})*+(?:{q})?+"


def _block_pattern(open_: str, close: str, nested: bool) -> str:
    o, c = _q(open_), _q(close)
    if not nested:
        return rf"{o}(?s:.*?)(?:{c}|\z)"
    o1, c1 = _q(open_[0]), _q(close[0])
    plain = rf"[^{o1}{c1}]++|{o1}(?!{_q(open_[1:])})|{c1}(?!{_q(close[1:])})"
    return rf"{o}(?:{plain})*+(?:{c}|\z)|{o}"  # a bare opener marks a comment within


def _openers(syn: Syntax) -> list[str]:
    """Alternatives that start a comment, longest block opener first."""
    out = [_q(o) for o, _ in sorted(syn.block, key=lambda b: -len(b[0]))]
    for tok in syn.line:
        mark = _q(tok)
        if tok == "#" and syn.special == "php":
            mark += r"(?!\[)"  # attribute, not a comment
        out.append((AFTER_BLANK if syn.needs_space else "") + mark)
    return out


# ---- JavaScript ------------------------------------------------------------
_JS_REGEX = rf"/(?![/*]){JS_REGEX_BODY}\p{{L}}*+"


def _js_code(other: str, ops: str) -> list[str]:
    """Words, operators (with the regex literal they admit), other runs."""
    rx = rf"{BLANK}*+(?:{_JS_REGEX})?+"
    return [
        rf"(?:{'|'.join(REGEX_WORDS)})(?![A-Za-z0-9_$]){rx}",
        r"[A-Za-z0-9_$]++",
        rf"[{_q(ops)}]{rx}",
        rf"[^A-Za-z0-9_${_q(other)}{_q(ops)}]++",
        *(string_pattern(s) for s in SYNTAX["javascript"].strings),
        r"/(?![/*])",
    ]


# A template whose interpolations hold words and plain strings; a slash could be a comment.
_JS_PLAIN = rf"[^{{}}`'\"/\\]++|{'|'.join(string_pattern(x) for x in SYNTAX['javascript'].strings)}"
_JS_TEMPLATE = rf"`(?:[^`\\$]++|\\(?s:.|\z)|\$(?!\{{)|\$\{{(?:{_JS_PLAIN})*+\}})*+(?:`|\z)"


_PY_LEAD = r"[ \t\r\f\x0B]*+(?=[rRbBuUfF]{0,2}(?:\"\"\"|'''))"


# ---- per-language patterns -------------------------------------------------
def _gap_parts(name: str, syn: Syntax) -> list[str]:
    firsts = {t[0] for t in syn.line} | {o[0] for o, _ in syn.block}
    quotes = {s.quote[0] for s in syn.strings}
    ordered = sorted(syn.strings, key=lambda s: -len(s.quote))
    strs = [string_pattern(s) for s in ordered]
    single = rf"(?!{'|'.join(_openers(syn))})[{''.join(_q(c) for c in sorted(firsts))}]"
    special = "".join(_q(c) for c in sorted(firsts | quotes))

    if syn.special == "js":
        parts = _js_code("/'\"`", REGEX_AFTER)
        return [*parts, _JS_TEMPLATE]
    if syn.special == "python":
        return [rf"[^{special}\n]++", rf"\n(?!{_PY_LEAD})", *strs]
    if syn.special == "rust":
        raw = r"r(?<hashes>#*+)\"(?s:.*?)(?:\"\k<hashes>|\z)"
        char = r"'(?:\\[^\n]+?|[^'\\\n])'"
        return [raw, r"[A-Za-z0-9_$]++", rf"[^A-Za-z0-9_${special}']++", char, "'", *strs, single]
    if syn.special == "shell":
        end = r"(?md:^){lead}\k<{name}>[ \t]*+(?md:$)"
        docs = [
            rf"<<{dash}(?!<)\s*+(?<q{n}>['\"]?+)(?<w{n}>[A-Za-z_]\w*+)\k<q{n}>[^\n]*+"
            rf"(?:\z|\n(?s:.*?)(?:{end.format(lead=lead, name='w' + n)}|\z))"
            for n, dash, lead in (("a", "[-~]", r"[ \t]*+"), ("b", "", ""))
        ]
        return [rf"[^{special}<]++", *strs, "<<<", *docs, "<", single]
    if syn.special == "php":
        doc = (
            r"<<<[ \t]*+(?<q>['\"]?+)(?<w>\w++)\k<q>[ \t]*+\r?\n"
            r"(?s:.*?)(?:(?md:^)[ \t]*+\k<w>\b|\z)"
        )
        return [rf"[^{special}<]++", *strs, doc, "<", single]
    if syn.special == "yaml":
        scalar = (
            r"[|>][+-]?\d*+[ \t]*+(?:#[^\n]*+)?+\r?\n"
            r"(?:[ \t]*+\n|\k<in>[ \t]++[^\n]*+(?:\n|\z)|[ \t]++\z)*+"
        )
        line = rf"(?md:^)(?<in>[ \t]*+)(?:[^{special}|>\n]|{'|'.join(strs)}|{scalar})"
        return [line, rf"[^{special}|>\n]++", r"\n", *strs, scalar, "[|>]", single]
    parts = [rf"[^{special}]++", *strs]
    if firsts:
        parts.append(single)
    return parts


def _comment_parts(syn: Syntax) -> list[str]:
    blocks = [
        _block_pattern(o, c, syn.nested) for o, c in sorted(syn.block, key=lambda b: -len(b[0]))
    ]
    lines = [op + r"[^\n]*+" for op in _openers(syn)[len(syn.block):]]
    return blocks + lines


PY_TRIPLE = "[rRbBuUfF]{0,2}(?:" + "|".join(
    string_pattern(s) for s in SYNTAX["python"].strings if len(s.quote) == 3
) + ")"


@lru_cache(maxsize=None)
def token_pattern(name: str) -> str:
    """Pattern whose successive matches tile a text of this language."""
    syn = SYNTAX[name]
    gap = f"(?:{'|'.join(_gap_parts(name, syn))})"
    comments = _comment_parts(syn)
    if syn.special == "js":
        lead = rf"(?:\A|\n){BLANK}*+{_JS_REGEX}{gap}*+"
        parts = [lead, f"{gap}++", *comments]
    elif syn.special == "python":
        # A triple quote that starts a line may be a docstring: its own token.
        parts = [
            PY_TRIPLE, *comments, rf"\A{_PY_LEAD}", rf"{gap}++(?:\n{_PY_LEAD})?+",
            rf"\n{_PY_LEAD}",
        ]
    else:
        parts = [f"{gap}++", *comments]
    return "|".join([*parts, "(?s:.)"])


# ---- markup and PHP regions ------------------------------------------------
# A script counts as code unless its first type= names something else.
_TYPE = r"(?>[^>]*?type\s*=\s*[\"']?(?=[^\"'\s>]))"
_JS_TYPES = "(?:javascript|module|ts|jsx?|babel)"
_SCRIPT = rf"<script\b(?:(?!{_TYPE})|(?={_TYPE}[^\"'\s>]*?{_JS_TYPES}))[^>]*+>"
_STYLE = r"<style\b[^>]*+>"
_OPEN = rf"(?:{_SCRIPT}(?=(?s:.*?)</script\s*+>)|{_STYLE}(?=(?s:.*?)</style\s*+>))"
_ELEMENT = rf"(?:{_SCRIPT}(?s:.*?)(?=</script\s*+>)|{_STYLE}(?s:.*?)(?=</style\s*+>))"
_MARKUP = rf"(?:[^<]++|<(?!(?:script|style)\b)|(?!{_OPEN})<)"
# Pieces alternate: an opening tag with its body, and markup, which starts with the closing tag.
MARKUP_PIECES = rf"(?i){_ELEMENT}|{_MARKUP}++"
_HTML_BEFORE_PHP = r"(?:[^<]++|<(?!\?))"
PHP_PIECES = (
    r"(?i)(?<=<\?|<\?=|<\?php)(?!\?>)(?s:.+?)(?=\?>|\z)"
    rf"|{_HTML_BEFORE_PHP}*+<\?(?:php\b|=)?+|{_HTML_BEFORE_PHP}++"
)


def _region(lang: Column, body: Column) -> Column:
    return F.struct(lang.alias("lang"), body.alias("body"))


def markup_regions(text: Column) -> Column:
    """Regions of a markup file: script and style bodies against the rest.

    An opening tag belongs to the markup before it.
    """

    def label(pieces: Column) -> Column:
        def is_element(i: Column) -> Column:
            return F.coalesce(F.get(pieces, i + 1).startswith("</"), F.lit(False))

        def parts(piece: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pieces, i - 1)).otherwise(F.lit(""))

            def element(tag: Column) -> Column:
                lang = (
                    F.when(rlike(tag, r"(?i)\A<style"), F.lit("css"))
                    .when(rlike(tag, r"(?i)lang\s*=\s*[\"']?ts"), F.lit("typescript"))
                    .otherwise(F.lit("javascript"))
                )
                both = F.array(
                    _region(F.lit("html"), F.concat(before, tag)),
                    _region(lang, F.substring(piece, F.length(tag) + 1, F.length(piece))),
                )
                return F.filter(both, lambda r: r["body"] != "")

            tag = F.regexp_extract(piece, r"(?i)\A<(?:script|style)\b[^>]*+>", 0)
            alone = F.array(_region(F.lit("html"), piece))
            return (
                F.when(is_element(i), let(tag, element))
                .when(is_element(i + 1), F.slice(alone, 1, 0))  # goes with the tag after it
                .otherwise(alone)
            )

        return F.flatten(F.transform(pieces, parts))

    return let(find_all(text, MARKUP_PIECES), label)


def php_regions(text: Column) -> Column:
    """PHP code between its tags against the markup around it."""

    def label(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            opened = F.coalesce(rlike(F.get(pieces, i - 1), r"(?i)<\?(?:php|=)?\z"), F.lit(False))
            lang = F.when(opened & ~piece.startswith("?>"), F.lit("php")).otherwise(F.lit("html"))
            return _region(lang, piece)

        return F.transform(pieces, one)

    return let(find_all(text, PHP_PIECES), label)


# ---- tokens ----------------------------------------------------------------
TOKEN = "struct<tok:string,lang:string,kind:int>"
CODE, COMMENT, CANDIDATE = 0, 1, 2

_FAMILIES: dict[tuple, list[str]] = {}
for _name, _syn in SYNTAX.items():
    _FAMILIES.setdefault((token_pattern(_name), _syn.block, _syn.line), []).append(_name)


def _kind(tok: Column, before: Column, syn: Syntax) -> Column:
    """What a token is, told by how it starts."""
    starts = [tok.startswith(o) for o, _ in syn.block] + [tok.startswith(t) for t in syn.line]
    found = starts[0]
    for s in starts[1:]:
        found = found | s
    if syn.needs_space and syn.block:
        # A dash or hash right after a closed block comment opens nothing.
        glued = F.coalesce(before.endswith("*/"), F.lit(False)) & ~tok.startswith("/*")
        found = found & ~glued
    kind = F.when(found, F.lit(COMMENT))
    if syn.special == "python":
        kind = kind.when(rlike(tok, r"\A[rRbBuUfF]{0,2}(?:\"\"\"|''')"), F.lit(CANDIDATE))
    return kind.otherwise(F.lit(CODE))


def _labelled(pieces: Column, lang: Column, syn: Syntax) -> Column:
    def label(toks: Column) -> Column:
        return F.transform(
            toks,
            lambda t, i: F.struct(
                t.alias("tok"), lang.alias("lang"), _kind(t, F.get(toks, i - 1), syn).alias("kind")
            ),
        )

    return let(pieces, label)


def _lex(body: Column, lang: Column, languages: Collection[str]) -> Column:
    branches = []
    for (pattern, *_), family in _FAMILIES.items():
        names = [n for n in family if n in languages]
        if not names:
            continue
        syn = SYNTAX[names[0]]
        pieces = find_all(body, pattern)
        if names[0] in AUTOMATA:
            opener, auto = "`" if syn.special == "js" else syn.block[0][0], AUTOMATA[names[0]]
            pieces = let(pieces, lambda t: resolved(t, opener, auto))  # noqa: B023  built at once
        branches.append((lang.isin(*names), _labelled(pieces, lang, syn)))
    plain = F.array(F.struct(body.alias("tok"), lang.alias("lang"), F.lit(CODE).alias("kind")))
    return case(branches, plain)


LANGUAGES = (*SYNTAX, *(m for m in MARKUP if m not in SYNTAX))


def tokens(text: Column, lang: Column, languages: Collection[str] = LANGUAGES) -> Column:
    """array<TOKEN> that tiles a file: code runs and single comments, in order.

    ``languages`` names the languages the corpus holds. Files of other languages
    count as all code; naming fewer keeps the generated expression small.
    """
    whole = [n for n in languages if n in SYNTAX and n not in (*MARKUP, "php")]
    branches = []
    for names, split, inner in (
        ([m for m in MARKUP if m in languages], markup_regions, MARKUP_LANGUAGES),
        ([m for m in languages if m == "php"], php_regions, ("php", "html")),
    ):
        if names:
            branches.append((lang.isin(*names), F.flatten(_lex_regions(split(text), inner))))
    return case(branches, _lex(text, lang, whole))


MARKUP_LANGUAGES = ("html", "javascript", "typescript", "css")


def _lex_regions(regions: Column, languages: Collection[str]) -> Column:
    return F.transform(regions, lambda r: _lex(r["body"], r["lang"], languages))


def positions(toks: Column) -> Column:
    """Offset and newline count before each token, packed as nl * 2^32 + offset."""
    sizes = F.transform(
        toks,
        lambda t: F.shiftleft(newlines(t["tok"]).cast("bigint"), 32) + F.length(t["tok"]),
    )
    return prefix(sizes, F.lit(0), "bigint", lambda a, n: a + n)


def offset_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def newlines_of(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def line_starts(toks: Column, pos: Column) -> Column:
    """Offset at which the line holding each token starts."""
    ends = F.transform(
        toks,
        lambda t, i: F.when(
            F.contains(t["tok"], F.lit("\n")),
            offset_of(F.get(pos, i)) + F.length(t["tok"]) - F.length(last_line(t["tok"])),
        ).otherwise(F.lit(0)),
    )
    return prefix(ends, F.lit(0), "int", lambda a, n: F.greatest(a, n))


_PY_STRINGS = "|".join(string_pattern(s) for s in SYNTAX["python"].strings)


def _bracket_depth(code: Column) -> Column:
    """Opening minus closing brackets, outside string literals."""
    return let(
        sub(sub(code, _PY_STRINGS), r"[^()\[\]{}]++"),
        lambda bare: F.length(sub(bare, r"[^(\[{]++")) * 2 - F.length(bare),
    )


def comment_flags(toks: Column) -> Column:
    """Which tokens are comments, per token.

    A triple-quoted string that starts its line is a docstring when nothing but
    comments precedes it, or when the last code character before it is a colon
    and no bracket is open.
    """

    def docstrings(seen: Column) -> Column:
        def with_depth(depths: Column) -> Column:
            def flag(t: Column, i: Column) -> Column:
                at = F.get(seen, i)
                tail = F.regexp_extract(F.get(toks, at)["tok"], r"(?U)\S(?=\s*+\z)", 0)
                after_colon = (F.get(depths, i) <= 0) & (tail == ":")
                here = (at < 0) | after_colon
                return (t["kind"] == COMMENT) | ((t["kind"] == CANDIDATE) & here)

            return F.transform(toks, flag)

        depths = F.transform(
            toks,
            lambda t: F.when(t["kind"] == CODE, _bracket_depth(t["tok"])).otherwise(F.lit(0)),
        )
        return let(prefix(depths, F.lit(0), "int", lambda a, n: a + n), with_depth)

    visible = F.transform(
        toks,
        lambda t, i: F.when((t["kind"] != COMMENT) & ~is_blank(t["tok"]), i).otherwise(F.lit(-1)),
    )
    plain = F.transform(toks, lambda t: t["kind"] == COMMENT)
    return F.when(
        F.exists(toks, lambda t: t["kind"] == CANDIDATE),
        let(prefix(visible, F.lit(-1), "int", lambda a, n: F.greatest(a, n)), docstrings),
    ).otherwise(plain)
