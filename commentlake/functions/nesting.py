"""Comments inside nested constructs, to any depth: a pushdown automaton as a fold.

A regular expression cannot follow templates within templates or comments within
comments. Where one meets such a construct, the rest of the file is cut into atoms
that mean the same in every mode (one special character or a run of others), each gets
a class, and a running fold carries the mode in which an atom starts, with a short
string of what the mode has to remember (open braces per template, the depth of a
comment, the hashes of a raw string). Transitions are a table built from the rules
below and read by index; a run of plain characters is one atom.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlake.functions.hof import block_of, let, prefix, rlike

# ---- fixed values: words and characters after which a slash opens a regex ----
REGEX_WORDS = (
    "return", "typeof", "instanceof", "in", "of", "new", "delete", "void",
    "throw", "case", "do", "else", "yield", "await", "if", "while",
)
REGEX_AFTER = "(,=:[!&|?{};+-*%~^<>"

JS_REGEX_BODY = r"(?:[^/\\\[\n]|\\(?s:.)|\[(?:[^\]\\\n]|\\(?s:.))*+\])++/"
RUST_CHAR_BODY = r"(?:\\[^\n]+?|[^'\\\n])'"

# Classes of atoms.
(OTHER, OPERATOR, WORD, KEYWORD, BLANK, NEWLINE, SLASH, SLASH_STAR, SLASH_SLASH, SLASH_REGEX, STAR, DOUBLE,
 TRIPLE, SINGLE, CHARACTER, TICK, ESCAPE, BRACE, UNBRACE, DOLLAR, BRACKET, UNBRACKET, RAW, SOLE_WORD,
 SOLE_KEYWORD) = range(25)
CLASSES = 25
SLASHES = (SLASH, SLASH_STAR, SLASH_SLASH, SLASH_REGEX)
QUOTES = (DOUBLE, TRIPLE)

Rule = Callable[[int], str]


@dataclass(frozen=True)
class Automaton:
    """How one syntax is read: its atoms, their classes, and what each does in each mode.

    ``rules`` maps a mode to the class's effect: the next mode with what is put in
    front of the memory, or a word from ``effects``, which compute the next state from
    (memory, atom). With ``braces`` the words are "{", "}" and "${", see ``_braced_fold``.
    """

    atoms: str
    classify: Callable[[Column, Column], Column]
    rules: dict[str, Rule]
    start: str
    inside: str  # modes in which an atom is part of a comment
    opening: str  # modes that the first atom of a comment leads to
    effects: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    braces: bool = False  # remembers open braces per template and nothing else

    def __hash__(self) -> int:
        return id(self)


#: What an atom is: code, part of a comment, or the first atom of one.
CODE_ATOM, COMMENT_ATOM, FIRST_ATOM = "0", "1", "2"


def _marks(auto: Automaton) -> list[str]:
    """What an atom is, by mode * CLASSES + class; effects never open a comment."""

    def mark(mode: str, after: str) -> str:
        plain = len(after) == 1 and after in auto.rules
        opens = plain and after in auto.opening and mode not in auto.inside + auto.opening
        inside = mode in auto.inside or plain and after in auto.inside + auto.opening
        return FIRST_ATOM if opens else COMMENT_ATOM if inside else CODE_ATOM

    return [mark(m, auto.rules[m](c)) for m in auto.rules for c in range(CLASSES)]


def _fold(atoms: Column, auto: Automaton) -> Column:
    """One letter per atom (see ``_marks``): a fold over struct<c: class, a: atom>.

    The state is the mode's row in the table and its memory. In blocks of about
    sqrt(n) like ``hof.prefix``, as the accumulator is copied at each step.
    """
    modes, table = list(auto.rules), [auto.rules[m](c) for m in auto.rules for c in range(CLASSES)]
    row = {m: CLASSES * k for k, m in enumerate(modes)}
    # The next row; below zero where the memory matters, for the effects one by one.
    words = list(dict.fromkeys(w for w in table if w not in row or w in auto.effects))
    following = F.array(*(F.lit(-1 - words.index(w) if w in words else row[w]) for w in table))
    marks = F.array(*map(F.lit, _marks(auto)))
    rows = F.array(*(F.lit(row.get(chr(k), 0)) for k in range(128)))

    def step(acc: Column, x: Column) -> Column:
        key = acc["m"] + x["c"]
        to = F.get(following, key)
        out = F.concat(acc["out"], F.get(marks, key))

        def told(state: Column) -> Column:
            return F.struct(
                F.get(rows, F.ascii(state)).alias("m"), F.substring(state, 2, 1 << 30).alias("mem"), out.alias("out")
            )

        state = None
        for k, word in enumerate(words):
            effect = auto.effects.get(word, lambda m, a, w=word: F.concat(F.lit(w), m))
            value = effect(acc["mem"], x["a"])
            state = F.when(to == -1 - k, value) if state is None else state.when(to == -1 - k, value)
        plain = F.struct(to.alias("m"), acc["mem"].alias("mem"), out.alias("out"))
        return plain if state is None else F.when(to >= 0, plain).otherwise(let(state, told))

    def begin(m: Column, mem: Column) -> Column:
        return F.struct(m.alias("m"), mem.alias("mem"), F.lit("").alias("out"))

    return _in_blocks(atoms, begin(F.lit(row[auto.start]), F.lit("")), lambda s: begin(s["m"], s["mem"]), step)


def _in_blocks(atoms: Column, first: Column, again: Callable[[Column], Column], step) -> Column:
    """The letters of a fold that starts at ``first``; ``again`` is a state with no letters yet."""

    def blocked(a: Column, size: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int"))

        def joined(acc: Column, r: Column) -> Column:
            return r.withField("out", F.concat(acc["out"], r["out"]))

        return F.aggregate(
            F.sequence(F.lit(0), last), first,
            lambda acc, k: let(F.aggregate(block_of(a, k, size), again(acc), step), lambda r: joined(acc, r)),
        )["out"]

    return let(
        atoms,
        lambda a: let(
            F.greatest(F.lit(256), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda b: blocked(a, b)
        ),
    )


def _top(memory: Column) -> Column:
    """Braces that are open in the innermost of the interpolations remembered."""
    return F.substring_index(memory, "t", 1)


def _outer(memory: Column) -> Column:
    return F.substring(memory, F.length(_top(memory)) + 2, F.lit(1 << 30))


def _braced_fold(classes: Column, auto: Automaton) -> Column:
    """``_fold`` over classes alone, for a syntax that remembers open braces per template.

    ``n`` counts the braces open in the innermost interpolation; ``mem`` holds the counts
    of those around it, so that a brace costs an addition and only the start and the end
    of an interpolation touch the string. Outside of all templates ``n`` means nothing.
    """
    modes, words = list(auto.rules), [auto.rules[m](c) for m in auto.rules for c in range(CLASSES)]
    row = {m: CLASSES * k for k, m in enumerate(modes)}
    operand, template, enter, leave = row["a"], row["t"], -1, -2
    special = {"{": operand, "${": enter, "}": leave}
    following = F.array(*(F.lit(special[w] if w in special else row[w]) for w in words))
    opened = F.array(*(F.lit(int(w == "{")) for w in words))
    marks = F.array(*map(F.lit, _marks(auto)))

    def state(m, n, mem, out) -> Column:
        return F.struct(m.alias("m"), n.alias("n"), mem.alias("mem"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        key = acc["m"] + x
        to, n, mem, out = F.get(following, key), acc["n"], acc["mem"], F.concat(acc["out"], F.get(marks, key))
        return (
            F.when(to >= 0, state(to, n + F.get(opened, key), mem, out))
            .when(to == enter, state(F.lit(operand), F.lit(0), F.concat(n.cast("string"), F.lit("t"), mem), out))
            .when((n == 0) & (mem != ""), state(F.lit(template), _top(mem).cast("int"), _outer(mem), out))
            .otherwise(state(F.lit(operand), n - 1, mem, out))
        )

    none = F.lit("")
    return _in_blocks(
        classes, state(F.lit(row[auto.start]), F.lit(0), none, none), lambda s: state(s["m"], s["n"], s["mem"], none), step
    )


# ---- JavaScript ----------------------------------------------------------------
# Code modes: after a keyword, where an operand may follow, after another word, after
# an operand; f is n right after a regex, whose flags are no word.
_AFTER_BLOCK = {"k": "k", "a": "n", "w": "w", "n": "n", "f": "n"}
_AFTER_LINE = {"k": "k", "a": "a", "w": "w", "n": "a", "f": "a"}
_LINE = {"k": "l", "a": "m", "w": "o"}  # line comment, by the mode after it
_OPEN = {"k": "G", "w": "H", "n": "I"}  # after the slash of a block comment's opener
_BLOCK = {"k": "B", "w": "C", "n": "D"}
_STARRED = {"k": "P", "w": "Q", "n": "R"}  # in a block comment after a star


def _js_code(mode: str) -> Rule:
    plain = {
        BLANK: mode, NEWLINE: mode, KEYWORD: "k", SOLE_KEYWORD: "k", WORD: "w", SOLE_WORD: "w", OPERATOR: "a", STAR: "a", BRACKET: "a", DOUBLE: "d", SINGLE: "s", TICK: "t",
        BRACE: "{", DOLLAR: "{", UNBRACE: "}", SLASH_STAR: _OPEN[_AFTER_BLOCK[mode]], SLASH_SLASH: _LINE[_AFTER_LINE[mode]],
        SLASH_REGEX: "r" if mode in "ka" else "n",
    }
    if mode == "f":
        plain |= {SOLE_WORD: "n", SOLE_KEYWORD: "n", BLANK: "n", NEWLINE: "n"}
    return lambda c: plain.get(c, "n")


def _quoted(mode: str, escaped: str, ends: tuple[int, ...], after: str) -> Rule:
    return lambda c: after if c in ends else escaped if c == ESCAPE else mode


def _js_rules() -> dict[str, Rule]:
    rules: dict[str, Rule] = {m: _js_code(m) for m in "kawnf"}
    for after in "kwn":
        block, starred = _BLOCK[after], _STARRED[after]
        rules[_OPEN[after]] = lambda c, b=block: b
        rules[block] = lambda c, b=block, s=starred: s if c == STAR else b
        rules[starred] = lambda c, a=after, b=block, s=starred: a if c in SLASHES else s if c == STAR else b
    for after in "kaw":
        rules[_LINE[after]] = lambda c, a=after: a if c == NEWLINE else _LINE[a]
    rules["s"] = _quoted("s", "S", (SINGLE, NEWLINE), "n")
    rules["d"] = _quoted("d", "E", (DOUBLE, NEWLINE), "n")
    rules["t"] = lambda c: {TICK: "n", ESCAPE: "T", DOLLAR: "${"}.get(c, "t")
    rules["r"] = lambda c: "f" if c in SLASHES else {NEWLINE: "n", ESCAPE: "V", BRACKET: "c"}.get(c, "r")
    rules["c"] = lambda c: {UNBRACKET: "r", ESCAPE: "W", NEWLINE: "n"}.get(c, "c")
    for escaped, mode in ("Ss", "Ed", "Tt", "Vr", "Wc"):
        rules[escaped] = lambda c, m=mode: m
    return rules


# A run ends with the next character that means something. Where a comment can begin or
# end there, and after a backslash, the run is an atom of its own; a star means something
# before a slash only. Of a run in code only its last word or sign counts.
_JS_RUN = r"(?:[^/*\"'`\\{}\[\]\n$]|\$(?!\{)|\*(?!/))"
JS_ATOMS = (
    rf"(?<=\\){_JS_RUN}++|{_JS_RUN}*+(?:\$\{{|[\"'`\\{{}}\[\]])|{_JS_RUN}++|/(?=(\*|/|{JS_REGEX_BODY})?)|[*\n]"
)
_JS_BLANKS = " \t\r\f\x0b"
_JS_KEYWORD = rf"(?:\A|[^A-Za-z0-9_$])(?:{'|'.join(REGEX_WORDS)})\z"


def _js_class(atom: Column, seen: Column) -> Column:
    slash = (
        F.when(seen == "*", F.lit(SLASH_STAR)).when(seen == "/", F.lit(SLASH_SLASH))
        .when(seen != "", F.lit(SLASH_REGEX)).otherwise(F.lit(SLASH))
    )
    single = {'"': DOUBLE, "'": SINGLE, "`": TICK, "\\": ESCAPE, "}": UNBRACE, "[": BRACKET, "]": UNBRACKET, "\n": NEWLINE}
    last = [OTHER] * 128
    for k in range(128):
        ch = chr(k)
        ends = WORD if ch.isalnum() or ch in "_$" else OPERATOR if ch in REGEX_AFTER else OTHER
        last[k] = single.get(ch, SLASH if ch == "/" else BRACE if ch == "{" else BLANK if ch in _JS_BLANKS else ends)
    # Most atoms end in a character that says it all; the others are looked at again.
    again = (SLASH, BRACE, BLANK, WORD, OPERATOR)
    first = [CLASSES + c if c in again else c for c in last]

    def at_end(text: Column, known: list[int]) -> Column:
        return F.coalesce(F.get(F.array(*map(F.lit, known)), F.ascii(F.substring(text, -1, 1))), F.lit(OTHER))

    def word(text: Column) -> Column:
        sole = rlike(atom, rf"\A[A-Za-z0-9_$]++[{_JS_BLANKS}]*+\z")
        key = rlike(F.substring(text, -1 - max(map(len, REGEX_WORDS)), 1 << 30), _JS_KEYWORD)
        return F.when(key, F.when(sole, F.lit(SOLE_KEYWORD)).otherwise(F.lit(KEYWORD))).otherwise(
            F.when(sole, F.lit(SOLE_WORD)).otherwise(F.lit(WORD))
        )

    def before_blanks(text: Column) -> Column:
        return let(at_end(text, last), lambda c: F.when(text == "", F.lit(BLANK)).when(c == WORD, word(text)).otherwise(c))

    return let(
        at_end(atom, first),
        lambda c: F.when(c < CLASSES, c)
        .when(c == CLASSES + BRACE, F.when(atom.endswith("${"), F.lit(DOLLAR)).otherwise(F.lit(BRACE)))
        .when(c == CLASSES + SLASH, slash)
        .when(c == CLASSES + BLANK, let(F.rtrim(atom, F.lit(_JS_BLANKS)), before_blanks))
        .when(c == CLASSES + WORD, word(atom))
        .otherwise(F.when(atom == "*", F.lit(STAR)).otherwise(F.lit(OPERATOR))),
    )


JAVASCRIPT = Automaton(
    atoms=JS_ATOMS,
    classify=_js_class,
    rules=_js_rules(),
    start="a",
    inside="".join([*_OPEN.values(), *_BLOCK.values(), *_STARRED.values()]),
    opening="".join([*_OPEN.values(), *_LINE.values()]),
    braces=True,
)


# ---- languages whose block comments nest -----------------------------------------
# c code, l line comment, o after the opener's slash, b in a block comment, s and t there
# after a slash that a star follows and after a star, d string, p q character, r raw string;
# e f before the rest of a triple quote, u v w in a triple string after 0 1 2 quotes.
def _nested_rules() -> dict[str, Rule]:
    code = {SLASH_STAR: "o", SLASH_SLASH: "l", DOUBLE: "d", TRIPLE: "e", CHARACTER: "p", RAW: "raw"}
    rules: dict[str, Rule] = {
        "c": lambda c: code.get(c, "c"),
        "l": lambda c: "c" if c == NEWLINE else "l",
        "o": lambda c: "b1",
        "b": lambda c: {SLASH_STAR: "s", STAR: "t"}.get(c, "b"),
        "s": lambda c: "deeper",
        "t": lambda c: "t" if c == STAR else "closed" if c in SLASHES else "b",
        # A raw opener holds a quote, which ends a string; after a backslash only its r is escaped.
        "d": _quoted("d", "D", (DOUBLE, TRIPLE, RAW, NEWLINE), "c"),
        "D": lambda c: "c" if c == RAW else "d",
        "p": lambda c: "Q" if c == ESCAPE else "q",
        "q": lambda c: "c" if c in (SINGLE, CHARACTER, NEWLINE) else "q",
        "Q": lambda c: "q",
        "r": lambda c: "quote" if c in (DOUBLE, TRIPLE, RAW) else "r",
        "e": lambda c: "f",
        "f": lambda c: "u",
        "u": lambda c: "v" if c in QUOTES else "U" if c == ESCAPE else "u",
        "v": lambda c: "w" if c in QUOTES else "U" if c == ESCAPE else "u",
        "w": lambda c: "c" if c in QUOTES else "U" if c == ESCAPE else "u",
        "U": lambda c: "u",
    }
    return rules


def _depth(memory: Column, by: int) -> Column:
    return F.concat(F.lit("b"), (memory.cast("int") + by).cast("string"))


_NESTED_EFFECTS = {
    "deeper": lambda m, a: _depth(m, 1),
    "closed": lambda m, a: F.when(m == "1", F.lit("c")).otherwise(_depth(m, -1)),
    "raw": lambda m, a: F.concat(F.lit("r"), F.substring(F.substring_index(a, '"', 1), 2, 1 << 30)),
    "quote": lambda m, a: F.when(F.startswith(F.substring_index(a, '"', -1), m), F.lit("c")).otherwise(F.concat(F.lit("r"), m)),
}


def _nested_class(characters: bool, triple: bool):
    def classify(atom: Column, seen: Column) -> Column:
        near = F.left(seen, F.lit(1))
        out = F.when(
            atom == "/",
            F.when(near == "*", F.lit(SLASH_STAR)).when(near == "/", F.lit(SLASH_SLASH)).otherwise(F.lit(SLASH)),
        ).when(atom == "*", F.lit(STAR)).when(atom == "\n", F.lit(NEWLINE)).when(atom == "\\", F.lit(ESCAPE))
        if triple:
            out = out.when((atom == '"') & (seen == '""'), F.lit(TRIPLE))
        if characters:
            out = out.when(atom == "'", F.when(seen.endswith("'"), F.lit(CHARACTER)).otherwise(F.lit(SINGLE)))
            out = out.when(atom.startswith("r") & F.contains(atom, F.lit('"')), F.lit(RAW))
        return out.when(atom.startswith('"'), F.lit(DOUBLE)).otherwise(F.lit(OTHER))

    return classify


RUST = Automaton(
    atoms=(
        r"r#*+\"#*+|[A-Za-z0-9_$]++|" + rf"[/'](?=({RUST_CHAR_BODY}|[/*])?)" + r"|\"#*+|[*\\\n]|[^A-Za-z0-9_$/'\"*\\\n]++"
    ),
    classify=_nested_class(characters=True, triple=False),
    rules=_nested_rules(),
    start="c",
    inside="obst",
    opening="ol",
    effects=_NESTED_EFFECTS,
)
SWIFT = Automaton(
    atoms=r"[/\"](?=(\"\"|[/*])?)|[*\\\n]|[^/\"*\\\n]++",
    classify=_nested_class(characters=False, triple=True),
    rules=_nested_rules(),
    start="c",
    inside="obst",
    opening="ol",
    effects=_NESTED_EFFECTS,
)
AUTOMATA = {"javascript": JAVASCRIPT, "typescript": JAVASCRIPT, "rust": RUST, "swift": SWIFT}


# ---- a second opinion ---------------------------------------------------------------
# The same modes without nesting, for languages that patterns alone lex; z is a character
# or string in single quotes, g a raw string between ticks.
def _flat_rules(line: bool, tick: bool) -> dict[str, Rule]:
    code = {SLASH_STAR: "o", DOUBLE: "d", TRIPLE: "e", SINGLE: "z"} | ({SLASH_SLASH: "l"} if line else {}) | ({TICK: "g"} if tick else {})
    rules = _nested_rules()
    return {k: rules[k] for k in ("l" if line else "") + "DefuvwU"} | {
        "c": lambda c: code.get(c, "c"),
        "o": lambda c: "b",
        "b": lambda c: "t" if c == STAR else "b",
        "t": lambda c: "t" if c == STAR else "c" if c in SLASHES else "b",
        "d": _quoted("d", "D", (DOUBLE, TRIPLE, NEWLINE), "c"),
        "z": _quoted("z", "Z", (SINGLE, NEWLINE), "c"),
        "Z": lambda c: "z",
        "g": lambda c: "c" if c == TICK else "g",
    }


def _flat(line: bool = True, triple: bool = False, tick: bool = False) -> Automaton:
    base = _nested_class(characters=False, triple=triple)

    def classify(atom: Column, seen: Column) -> Column:
        return F.when(atom == "'", F.lit(SINGLE)).when(atom == "`", F.lit(TICK)).otherwise(base(atom, seen))

    return Automaton(
        atoms=r"[/\"](?=(\"\"|[/*])?)|[*\\\n'`]|[^/\"*\\\n'`]++", classify=classify, rules=_flat_rules(line, tick),
        start="c", inside="obt", opening="ol",
        effects={"": lambda m, a: m},  # nothing to remember
    )


#: Readers of a whole file that share nothing with the lexer's patterns.
SECOND_OPINIONS = AUTOMATA | {
    "css": _flat(line=False), "scss": _flat(), "c": _flat(), "go": _flat(tick=True),
    **dict.fromkeys(("java", "kotlin", "scala", "csharp"), _flat(triple=True)),
}


def comment_spans(text: Column, auto: Automaton) -> Column:
    """start * 2^32 + end of every comment, as the automaton alone reads the whole text."""

    # Code right after a comment may begin with slashes where those open nothing.
    opens = (lambda p: p.startswith("/*") | p.startswith("//")) if "l" in auto.rules else lambda p: p.startswith("/*")

    def spans(parts: Column) -> Column:
        def placed(starts: Column) -> Column:
            found = F.transform(
                parts,
                lambda p, i: F.when(
                    opens(p),
                    F.shiftleft(F.get(starts, i).cast("bigint"), 32) + F.get(starts, i) + F.length(p),
                ),
            )
            return F.array_compact(found)

        return let(prefix(F.transform(parts, F.length), F.lit(0), "int", lambda a, n: a + n), placed)

    return let(pieces(text, auto), spans)


# ---- the fold ----------------------------------------------------------------------
def pieces(text: Column, auto: Automaton) -> Column:
    """Comments and the code between them, in order; they tile ``text``."""

    def cut(atoms: Column) -> Column:
        seen = F.regexp_extract_all(text, F.lit(auto.atoms), F.lit(1))

        def classed(flags: Column) -> Column:
            known = lambda a, i: auto.classify(a, F.get(flags, i))
            if auto.braces:
                return F.transform(atoms, known)
            return F.transform(atoms, lambda a, i: F.struct(known(a, i).alias("c"), a.alias("a")))

        # A piece is a comment's atoms from its first on, or those between two comments.
        runs = F.regexp_extract_all(
            (_braced_fold if auto.braces else _fold)(let(seen, classed), auto), F.lit(f"{FIRST_ATOM}{COMMENT_ATOM}*+|{CODE_ATOM}++|{COMMENT_ATOM}++"), F.lit(0)
        )

        def grouped(sizes: Column) -> Column:
            starts = prefix(sizes, F.lit(0), "int", lambda a, n: a + n)
            return let(
                starts,
                lambda s: F.transform(sizes, lambda n, k: F.array_join(F.slice(atoms, F.get(s, k) + 1, n), "")),
            )

        return let(F.transform(runs, F.length), grouped)

    return let(F.regexp_extract_all(text, F.lit(auto.atoms), F.lit(0)), cut)


def resolved(tokens: Column, opener: str, auto: Automaton) -> Column:
    """Tokens in which everything from the first bare ``opener`` on is read by the automaton."""

    def from_first(first: Column) -> Column:
        rest = F.array_join(F.slice(tokens, first, F.size(tokens)), "")
        return F.concat(F.slice(tokens, F.lit(1), first - 1), let(rest, lambda r: pieces(r, auto)))

    found = F.array_position(tokens, F.lit(opener)).cast("int")
    return F.when(F.array_contains(tokens, F.lit(opener)), let(found, from_first)).otherwise(tokens)
