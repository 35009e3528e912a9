"""Deterministic shortening of comment prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.functions.hof import any_of, find, is_blank, let, lstrip, rlike, strip, sub
from commentlake.functions.score import PARAM_TAG, RETURN_TAG, empty_tags

# ---- fixed values: preambles, filler sentences, headings, noise words -------
PREAMBLES = (
    r"^this\s+(?:function|method|class|component|hook|module|file|script|block)\s+"
    r"(?:is\s+)?(?:used\s+to\s+|responsible\s+for\s+|that\s+|which\s+|will\s+)?",
    r"^(?:a|the)\s+(?:helper|utility|simple|small)?\s*(?:function|method|class)\s+"
    r"(?:that|to|which)\s+",
    r"^(?:helper|utility)\s+(?:function|method)\s+(?:that|to)\s+",
    r"^(?:function|method)\s+(?:that|to)\s+",
    r"^(?:cette|ce|cet)\s+(?:fonction|méthode|classe|composant|module|fichier)\s+"
    r"(?:sert\s+à\s+|permet\s+de\s+|qui\s+|qu[ie]\s+va\s+)?",
    r"^(?:basically|essentially|simply|just)\s*,?\s*",
    r"^(?:first|next|then|finally|now)\s*,\s*",
    r"^(?:d'abord|ensuite|puis|enfin)\s*,\s*",
    r"^step\s+\d+\s*[:.\-]\s*",
    r"^(?:we|here we|this will|it will)\s+",
    r"^(?:on|nous)\s+(?:va|allons)\s+",
)
FILLER = (
    r"^note that\b", r"^notez que\b",
    r"^(?:this|it)\s+is\s+(?:important|worth noting|done|used)\b",
    r"^il\s+(?:est|convient)\b",
    r"^in other words\b", r"^autrement dit\b",
    r"^for example\b", r"^par exemple\b",
    r"^(?:this|the)\s+(?:function|method|class|component|module|hook)\b",
    r"^(?:cette|ce)\s+(?:fonction|méthode|classe|composant|module)\b",
    r"^make sure\b", r"^assurez-vous\b",
    r"^see (?:above|below)\b",
)
BANNER_ONLY = r"^[\s=*\-~_#/+<>|]+$"
SENTENCE_END = r"(?<=[.!?])\s+"
DOC_SECTION = (
    r"(?iU)^\s*(Args|Arguments|Parameters|Returns|Yields|Raises|Attributes|Examples?|"
    r"Notes?|Warnings?|See Also|Paramètres|Retourne|Renvoie|Exemples?)\s*:"
)
TYPE_NOISE = (
    "array", "list", "string", "number", "boolean", "object", "value", "values",
    "param", "parameter", "argument", "optional", "given", "provided", "instance",
    "tableau", "liste", "chaîne", "chaine", "nombre", "objet", "valeur", "facultatif",
)
PREAMBLE_ROUNDS = 3
MIN_BUDGET = 24

_FLAGS = "(?iU)"
_ANY_PREAMBLE = any_of(PREAMBLES)
_ANY_FILLER = any_of(FILLER)
_NOISE = rf"(?iU)\b({'|'.join(TYPE_NOISE)})\b"


def is_banner(lines: Column) -> Column:
    """Every line that holds text is pure decoration."""
    shown = F.filter(lines, lambda x: ~is_blank(x))
    return let(shown, lambda ls: (F.size(ls) > 0) & F.forall(ls, lambda x: rlike(x, BANNER_ONLY)))


def _strip_one_preamble(text: Column) -> Column:
    """The first preamble whose removal changes the text and leaves some."""

    def removed(pattern: str) -> Column:
        return let(
            lstrip(sub(text, _FLAGS + pattern)),
            lambda new: F.when((new != "") & (new != text), new),
        )

    found = F.coalesce(*[removed(p) for p in PREAMBLES], text)
    return F.when(rlike(text, _ANY_PREAMBLE), found).otherwise(text)


def clean_prose(text: Column) -> Column:
    """Without preambles and without filler sentences."""
    out = strip(sub(text, r"(?U)\s+", " "))
    for _ in range(PREAMBLE_ROUNDS):
        out = let(out, _strip_one_preamble)

    def keep(sentences: Column) -> Column:
        kept = F.filter(sentences, lambda s: ~rlike(s, _ANY_FILLER))
        return let(
            kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(sentences, 1, 1))
        )

    sentences = F.filter(F.split(out, SENTENCE_END), lambda s: ~is_blank(s))
    return strip(F.array_join(let(sentences, keep), " "))


def truncate(text: Column, limit: Column) -> Column:
    """Cut at the last space past half the limit."""

    def cut(t: Column) -> Column:
        head = F.left(t, limit + 1)
        space = F.when(
            F.contains(head, F.lit(" ")),
            F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1,
        ).otherwise(F.lit(-1))
        short = F.when(space > F.floor(limit / 2), F.left(head, space)).otherwise(F.left(t, limit))
        return F.when(F.length(t) <= limit, t).otherwise(F.rtrim(short, F.lit(" ,;:-")))

    return let(strip(text), cut)


def fit(text: Column, limit: Column) -> Column:
    """As many whole sentences as the limit holds."""

    def fold(t: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            longer = strip(F.concat(acc["out"], F.lit(" "), s))
            stop = acc["stop"] | ((acc["out"] != "") & (F.length(longer) > limit))
            return F.struct(F.when(stop, acc["out"]).otherwise(longer).alias("out"), stop.alias("stop"))

        packed = F.aggregate(
            F.split(t, SENTENCE_END),
            F.struct(F.lit("").alias("out"), F.lit(False).alias("stop")),
            step,
            lambda acc: acc["out"],
        )
        whole = truncate(F.when(packed != "", packed).otherwise(t), limit)
        return F.when(F.length(t) <= limit, t).otherwise(whole)

    return let(strip(text), fold)


def budget(indent: Column, kind: Column, open_tok: Column, close_tok: Column, max_len: int) -> Column:
    def size(tok: Column, default: int) -> Column:
        return F.when(tok == "", F.lit(default)).otherwise(F.length(tok))

    closing = F.when(kind == "block", size(close_tok, 2) + 1).otherwise(F.lit(0))
    return F.greatest(
        F.lit(MIN_BUDGET), F.lit(max_len) - F.length(indent) - size(open_tok, 2) - 1 - closing
    )


def _unless_empty(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def _summary(text: Column, limit: Column) -> Column:
    return let(fit(clean_prose(text), limit), _unless_empty)


def _docstring(lines: Column, limit: Column) -> Column:
    """The summary paragraph, then everything from the first section heading."""
    blank_at = F.array_position(F.transform(lines, lambda x: is_blank(x)), True).cast("int")
    head_size = F.when(blank_at > 0, blank_at - 1).otherwise(F.size(lines))

    def build(n: Column) -> Column:
        head = F.array_join(F.transform(F.slice(lines, F.lit(1), n), lambda x: strip(x)), " ")
        heading = F.array_position(
            F.transform(lines, lambda x, i: (i >= n) & rlike(x, DOC_SECTION)), True
        ).cast("int")
        body = let(
            heading,
            lambda at: F.when(
                at > 0,
                F.concat(F.array(F.lit("")), F.slice(lines, at, F.size(lines))),
            ).otherwise(F.array().cast("array<string>")),
        )
        return F.concat(_summary(head, limit), body)

    return let(head_size, build)


def _tag_informs(tag: Column) -> Column:
    bare = F.concat(
        F.lit("@param "), find(tag, PARAM_TAG, 1), F.lit(" - "), sub(find(tag, PARAM_TAG, 2), _NOISE)
    )
    param = empty_tags(F.array(bare)) == 0
    said = F.filter(F.split(find(tag, RETURN_TAG, 1), r"(?U)\s+"), lambda w: w != "")
    return (
        F.when(rlike(tag, PARAM_TAG), param)
        .when(rlike(tag, RETURN_TAG), F.size(said) > 3)
        .otherwise(F.lit(True))
    )


def _doc_block(lines: Column, limit: Column) -> Column:
    """A one-line description and the tags that carry information."""
    shown = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")

    def build(ls: Column) -> Column:
        prose = F.array_join(F.filter(ls, lambda x: ~x.startswith("@")), " ")
        tags = F.filter(ls, lambda x: x.startswith("@") & _tag_informs(x))
        return F.concat(_summary(prose, limit), F.transform(tags, lambda t: truncate(t, limit)))

    return let(shown, build)


def shorten(inner: Column, lines: Column, kind: Column, doc: Column, limit: Column) -> Column:
    """Replacement lines of a comment; empty when nothing is left to say."""
    return (
        F.when(kind == "docstring", _docstring(lines, limit))
        .when(doc, _doc_block(lines, limit))
        .otherwise(_summary(inner, limit))
    )


def same_lines(a: Column, b: Column) -> Column:
    """Equal apart from outer blank lines and trailing white space."""

    def core(lines: Column) -> Column:
        text = F.array_join(lines, "\n")
        return sub(sub(sub(text, r"(?<![^\S\n])[^\S\n]++(?=\n|\z)"), r"\A\n++"), r"(?<!\n)\n++\z")

    return core(a) == core(b)
