"""How much a comment reads like machine-written filler, 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.functions.hof import (
    any_of,
    find,
    find_all,
    is_blank,
    let,
    rlike,
    strings,
    sub,
)

# ---- fixed values: phrase openers, first hit counts ------------------------
OPENERS = (
    (r"^this (?:function|method|class|component|hook|file|module|script|variable|"
     r"constant|interface|type|block|section|line|code)\b", 0.45, "opener_this"),
    (r"^(?:cette|ce|cet) (?:fonction|méthode|classe|composant|fichier|module|"
     r"variable|constante|section)\b", 0.45, "opener_cette"),
    (r"^(?:the )?(?:function|method|class) \w+ (?:does|is|returns|handles|takes)\b",
     0.4, "signature_paraphrase"),
    (r"^step \d+\s*[:.\-]", 0.4, "step_number"),
    (r"^(?:first|next|then|finally|now)\s*,", 0.3, "story_connector"),
    (r"^(?:d'abord|ensuite|puis|enfin)\s*,", 0.3, "story_connector"),
    (r"^note that\b|^notez que\b|^il est important de\b|^il convient de\b",
     0.35, "escort_phrase"),
    (r"^(?:here|we|let's|on va|nous allons)\b", 0.3, "narration"),
    (r"^(?:initialize|initializes|create|creates|return|returns|handle|handles|"
     r"set up|sets up|get|gets|update|updates|calculate|calculates|check|checks|"
     r"loop through|loops through|iterate|iterates) \b", 0.25, "action_restated"),
    (r"\b(?:for example|in other words|essentially|basically|simply put|"
     r"autrement dit|c'est-à-dire|par exemple)\b", 0.25, "padding"),
    (r"\bensur(?:e|es|ing) that\b|\bmake sure to\b", 0.2, "explanatory"),
)

# ---- fixed values: decoration, tags, words ---------------------------------
BANNER_LINE = r"^[\s=*\-~_#/+]{6,}$"
SECTION_LINE = r"^[=\-*~_#]{2,}[^\n]*[=\-*~_#]{2,}$"
PARAM_TAG = r"@param\s+(?:\{[^}]*\}\s*)?\[?([\w.$]+)\]?\s*[-–—:]?\s*([^\n]*)"
RETURN_TAG = r"@returns?\s+(?:\{[^}]*\}\s*)?([^\n]*)"

STOPWORDS = (
    "the", "a", "an", "of", "to", "for", "and", "or", "is", "are", "be", "this",
    "that", "it", "in", "on", "with", "as", "by", "from", "we", "if", "then",
    "le", "la", "les", "un", "une", "de", "du", "des", "et", "ou", "est", "sont",
    "ce", "cette", "dans", "sur", "avec", "pour", "par", "si", "au", "aux", "en",
)
DIGIT_WORDS = {
    "0": ("zero", "zéro"), "1": ("one", "un"), "2": ("two", "deux"),
    "3": ("three", "trois"), "10": ("ten", "dix"), "100": ("hundred", "cent"),
}
OPERATOR_WORDS = {
    "++": ("increment", "incrémente", "incremente"),
    "--": ("decrement", "décrémente", "decremente"),
    "+=": ("increment", "add", "adds", "sum", "incrémente", "ajoute"),
    "-=": ("decrement", "subtract", "retire", "soustrait"),
}
KEYWORD_WORDS = {
    "if": ("check", "checks", "vérifie", "verifie", "test", "tests", "teste"),
    "for": ("loop", "loops", "iterate", "iterates", "each", "boucle", "parcourt"),
    "while": ("loop", "loops", "boucle"),
    "return": ("return", "returns", "retourne", "renvoie"),
    "true": ("enable", "enabled", "vrai", "active"),
    "false": ("disable", "disabled", "faux", "désactive"),
    "null": ("empty", "vide"),
    "none": ("empty", "vide"),
    "new": ("create", "creates", "crée", "cree", "instantiate"),
}

LETTER = "A-Za-zÀ-ſ"
WORD = f"[{LETTER}]+"
WORDY = 25  # words beyond which a comment is long-winded
MANY_WORDS = rf"\A[^{LETTER}]*+(?:[{LETTER}]++[^{LETTER}]++){{{WORDY}}}[{LETTER}]"
IDENTIFIER = r"[A-Za-z_$](?:[\w$]++|[\p{L}\p{N}]++)*+"
NAME_CUT = r"_|(?=[A-Z])(?<=[a-z0-9])"

FLAGGED = 0.5  # score from which a comment counts as filler


def words(text: Column) -> Column:
    return find_all(F.lower(text), WORD)


def _none() -> Column:
    return F.array().cast("array<string>")


def _padded(ws: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))


def _evoked(present: Column, table: dict[str, tuple[str, ...]], pad: str = " ") -> list[Column]:
    """Words that the keys found in ``present`` stand for."""
    return [
        F.when(F.contains(present, F.lit(f"{pad}{key}{pad}")), F.lit(" ".join(ws) + " ")).otherwise(F.lit(""))
        for key, ws in table.items()
    ]


def vocabulary(code: Column) -> Column:
    """Split identifiers, and the words that keywords, digits and operators evoke.

    One string with every word between blanks: searching it is far cheaper than
    comparing every word of a comment with every word of the code.
    """
    names = sub(code, rf"[^A-Za-z_$]*+({IDENTIFIER})|[^A-Za-z_$]++\z", " $1")
    parts = F.concat(F.lit(" "), F.lower(sub(names, NAME_CUT, " ")), F.lit(" "))
    digits = F.when(rlike(code, "[0-9]"), _padded(find_all(code, r"\b\d+\b"))).otherwise(F.lit(""))

    def meant(found: Column, table: dict[str, tuple[str, ...]]) -> Column:
        return let(found, lambda n: F.when(n != "", F.concat(*_evoked(n, table))).otherwise(n))

    def named(p: Column) -> Column:
        # The few keywords are listed in one pass, and what they stand for is looked up in that list.
        keys = F.regexp_extract_all(p, F.lit(f" ({'|'.join(KEYWORD_WORDS)})(?= )"), F.lit(1))
        said = let(keys, lambda ks: F.when(F.size(ks) > 0, _padded(ks)).otherwise(F.lit("")))
        return F.concat(p, meant(said, KEYWORD_WORDS))

    signs = F.when(rlike(code, r"\+\+|--|[+\-]="), F.concat(*_evoked(code, OPERATOR_WORDS, pad=""))).otherwise(F.lit(""))
    return F.concat(let(parts, named), meant(digits, DIGIT_WORDS), signs)


def echoes(word: Column, vocab: Column) -> Column:
    """Exact, or a prefix either way of an identifier of four letters or more."""
    blank = F.lit(" ")
    # From three letters on, a word that begins so and is longer has the four
    # letters, and one that does not is the exact match.
    short = F.contains(vocab, F.concat(blank, word, blank)) | F.contains(
        sub(vocab, "(?<= )[^ ]{1,3}(?= )"), F.concat(blank, word)
    )
    begins = F.when(F.length(word) < 3, short).otherwise(F.contains(vocab, F.concat(blank, word)))
    extends = (F.length(word) > 4) & F.exists(
        F.sequence(F.lit(4), F.greatest(F.length(word) - 1, F.lit(4))),
        lambda n: F.contains(vocab, F.concat(blank, F.left(word, n), blank)),
    )
    # Every way needs the first letters somewhere: most words stop here.
    return F.contains(vocab, F.left(word, F.lit(4))) & (begins | extends)


def _content(ws: Column, longer_than: int) -> Column:
    return F.filter(ws, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > longer_than))


def content(inner: Column) -> Column:
    """The words of a comment that could restate code."""
    return _content(words(inner), 2)


#: From so many letters on, a word and what echoes it begin with the same ones.
HEAD = 4


def share_in(ws: Column, vocab: Column) -> Column:
    """Share of the words that a vocabulary echoes; 0 for fewer than two.

    Beginnings are compared by hash first, so that only words that share theirs with
    the vocabulary are searched in it.
    """
    heads = F.regexp_extract_all(vocab, F.lit(f"([^ ]{{1,{HEAD}}})[^ ]*+"), F.lit(1))
    shared = F.array_intersect(F.transform(ws, lambda w: F.left(w, F.lit(HEAD))), heads)

    def hits(known: Column) -> Column:
        maybe = lambda w: (F.length(w) < HEAD) | F.array_contains(known, F.left(w, F.lit(HEAD)))
        return F.size(F.filter(ws, lambda w: maybe(w) & echoes(w, vocab))) / F.size(ws)

    return F.when(F.size(ws) >= 2, let(shared, hits)).otherwise(F.lit(0.0))


def share_of(ws: Column, code: Column) -> Column:
    """``share_in`` for the words of a piece of code."""
    return F.when(is_blank(code), F.lit(0.0)).otherwise(let(vocabulary(code), lambda v: share_in(ws, v)))


def restates(inner: Column, target: Column) -> Column:
    """Share of the content words that the neighbouring code (``target``) says already.

    The code is looked at only for a comment of two such words or more.
    """

    def of(ws: Column) -> Column:
        return F.when(F.size(ws) >= 2, let(target, lambda code: share_of(ws, code))).otherwise(F.lit(0.0))

    return let(content(inner), of)


def grown(vocab: Column, code: Column) -> Column:
    """A vocabulary with the words of more code that it lacks."""
    fresh = F.array_except(F.split(vocabulary(code), " "), F.split(vocab, " "))
    return F.concat(vocab, F.array_join(fresh, " "), F.lit(" "))


def crosses(before: Column, code: Column) -> Column:
    """The operators that lie across the cut between two runs of code, where each half lacks them."""
    longest = max(map(len, OPERATOR_WORDS))
    seam = F.concat(F.right(before, F.lit(longest - 1)), F.left(code, F.lit(longest - 1)))
    return F.regexp_replace(seam, F.lit(r"[\w$]"), F.lit(" "))


def _empty_tag(line: Column) -> Column:
    """A parameter or return tag that says nothing beyond the name."""
    desc = find(line, PARAM_TAG, 2)

    def all_echo(ws: Column) -> Column:
        return (F.size(ws) > 0) & let(
            vocabulary(find(line, PARAM_TAG, 1)),
            lambda ids: F.forall(ws, lambda w: echoes(w, ids)),
        )

    param = is_blank(desc) | let(_content(words(desc), 0), all_echo)
    returns = rlike(line, RETURN_TAG) & (F.size(words(find(line, RETURN_TAG, 1))) <= 3)
    return F.when(rlike(line, PARAM_TAG), param).otherwise(returns)


def empty_tags(lines: Column) -> Column:
    """Number of uninformative documentation tags."""
    return F.size(F.filter(lines, lambda x: F.contains(x, F.lit("@")) & _empty_tag(x)))


def has_decoration(lines: Column) -> Column:
    return F.exists(lines, lambda x: ~is_blank(x) & (rlike(x, BANNER_LINE) | rlike(x, SECTION_LINE)))


def opener(inner: Column) -> Column:
    """Index of the first phrase opener that hits, else null."""
    out = F.lit(None).cast("int")
    for i, (pattern, _, _) in reversed(list(enumerate(OPENERS))):
        out = F.when(rlike(inner, "(?iU)" + pattern), F.lit(i)).otherwise(out)
    return out


# One pass over a text that no opener touches, before the eleven are told apart.
ANY_OPENER = any_of((p for p, _, _ in OPENERS), heads="[fiebsacpm][onsaiu']")

PARTS = "struct<opener:int,decorated:boolean,restated:double,tags:int,long:boolean,wordy:boolean>"


def parts(
    inner: Column, lines: Column, kind: Column, n_lines: Column, restated: Column
) -> Column:
    """The six rules, each on its own; null for a comment without text."""
    blank = is_blank(inner)
    return F.when(
        ~blank,
        F.struct(
            F.when(rlike(inner, ANY_OPENER), opener(inner)).alias("opener"),
            has_decoration(lines).alias("decorated"),
            restated.alias("restated"),
            empty_tags(lines).alias("tags"),
            ((n_lines >= 4) & (kind != "docstring")).alias("long"),
            rlike(F.lower(inner), MANY_WORDS).alias("wordy"),
        ),
    )


def _weight(p: Column) -> Column:
    weights = F.array(*[F.lit(float(w)) for _, w, _ in OPENERS])
    return F.coalesce(F.get(weights, p["opener"]), F.lit(0.0))


def score(p: Column) -> Column:
    """Sum of the rules in their fixed order, at most 1."""

    def points(cond: Column, n: float) -> Column:
        return F.when(cond, F.lit(n)).otherwise(F.lit(0.0))

    restated = (
        F.when(p["restated"] >= 0.6, F.lit(0.5)).when(p["restated"] >= 0.4, F.lit(0.25)).otherwise(F.lit(0.0))
    )
    total = (
        _weight(p)
        + points(p["decorated"], 0.5)
        + restated
        + points(p["tags"] > 0, 0.3)
        + points(p["long"], 0.2)
        + points(p["wordy"], 0.15)
    )
    return F.coalesce(F.least(total, F.lit(1.0)), F.lit(0.0))


def reasons(p: Column, n_lines: Column) -> Column:
    percent = F.floor(p["restated"] * 100).cast("string")
    labels = strings([label for _, _, label in OPENERS])
    listed = F.array(
        F.get(labels, p["opener"]),
        F.when(p["decorated"], F.lit("decoration")),
        F.when(p["restated"] >= 0.6, F.concat(F.lit("restates_code:"), percent)).when(
            p["restated"] >= 0.4, F.concat(F.lit("near_code:"), percent)
        ),
        F.when(p["tags"] > 0, F.concat(F.lit("empty_tags:"), p["tags"].cast("string"))),
        F.when(p["long"], F.concat(F.lit("lines:"), n_lines.cast("string"))),
        F.when(p["wordy"], F.lit("wordy")),
    )
    return F.coalesce(F.array_compact(listed), _none())


__all__ = [
    "FLAGGED", "OPENERS", "PARAM_TAG", "RETURN_TAG", "STOPWORDS", "empty_tags", "parts", "reasons",
    "restates", "score", "words",
]
