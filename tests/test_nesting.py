"""The pushdown automaton against a plain scanner, and depth without a limit."""

import random

import plain_scan
import pytest
from pyspark.sql import functions as F

from commentlake.functions import lexer, nesting
from commentlake.operators import comments as ops

PLAIN = {
    "javascript": plain_scan.javascript,
    "rust": lambda t: plain_scan.nested(t, True),
    "swift": lambda t: plain_scan.nested(t, False),
}
PARTS = {
    "javascript": ["`", "${", "}", "{", "/*", "*/", "//", "/", "*", "'", '"', "\\", "\n", " ", "x", "return", "in", "(", ")", "[", "]", "=", "$", "é", "1"],
    "rust": ["/*", "*/", "//", "/", "*", '"', "'", "\\", "\n", " ", "r", "#", 'r#"', '"#', "x", "br", "'a'", "'\\n'", "'\"'", "é"],
    "swift": ["/*", "*/", "//", "/", "*", '"', '"""', "'", "\\", "\n", " ", "x", "#", "é"],
}


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        if p.startswith(("/*", "//")):
            out.append((at, at + len(p)))
        at += len(p)
    return out


@pytest.mark.parametrize("lang", sorted(PLAIN))
def test_automaton_agrees_with_a_plain_scanner(spark, lang):
    rng = random.Random(lang)
    texts = ["".join(rng.choices(PARTS[lang], k=rng.randrange(1, 40))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(8)
    got = {r.n: r.p for r in df.select("n", nesting.pieces(F.col("text"), nesting.AUTOMATA[lang]).alias("p")).collect()}
    wrong = []
    for n, text in enumerate(texts):
        assert "".join(got[n]) == text
        if spans(got[n]) != PLAIN[lang](text):
            wrong.append((text, spans(got[n]), PLAIN[lang](text)))
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("lang", ["rust", "swift"])
def test_lexer_agrees_with_a_plain_scanner(spark, lang):
    """Pattern and automaton together, as the operators use them."""
    rng = random.Random(lang + "both")
    texts = ["".join(rng.choices(PARTS[lang], k=rng.randrange(1, 40))) for _ in range(4000)]
    df = spark.createDataFrame([(str(n), t, lang) for n, t in enumerate(texts)], "path string, text string, lang string").repartition(8)
    wrong = []
    for r in ops.lex(df, (lang,)).collect():
        pieces = [t.tok for t in r._tok]
        if spans(pieces) != PLAIN[lang](r.text):
            wrong.append((r.text, spans(pieces), PLAIN[lang](r.text)))
    assert not wrong, wrong[:3]


def template(depth):
    """A template in a template and so on, braces in each, a comment in the innermost."""
    out = "x /* deep */"
    for k in range(depth):
        out = f"f({{ a: {{ b: {{ c: {{ d: `t{k} ${{ {out} }} // no` }} }} }} }})"
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 6, 40])
def test_templates_of_any_depth(files, depth):
    text = f"// first\nlet s = {template(depth)}; // last\n"
    found = ops.scan_comments(files(("a.js", text, "javascript")), languages=("javascript",)).orderBy("start").collect()
    assert [c.text for c in found] == ["// first", "/* deep */", "// last"]
    assert [text[c.start:c.end] for c in found] == [c.text for c in found]


@pytest.mark.parametrize(("lang", "depth"), [("rust", 9), ("rust", 300), ("swift", 12)])
def test_block_comments_of_any_depth(files, lang, depth):
    deep = "/* a " * depth + "*/ b " * (depth - 1) + "*/"
    text = f"let a = 1; {deep} let b = 2; // end\n"
    found = ops.scan_comments(files(("a", text, lang)), languages=(lang,)).orderBy("start").collect()
    assert [c.text for c in found] == [deep, "// end"]
    counts = ops.file_counts(files(("a", text, lang)), languages=(lang,)).first()
    assert counts.comments == 2


def test_scripts_in_markup_nest_too(files):
    text = f"<script>let s = {template(3)};</script><!-- m -->"
    found = ops.extract_comments(files(("a.html", text, "html")), ("html",), context=()).orderBy("start").collect()
    assert [c.text for c in found] == ["/* deep */", "<!-- m -->"]


def test_cleaning_follows_the_depth(files):
    from commentlake.operators.edits import clean_files

    deep = "/*" * 12 + " x " + "*/" * 12 + "\nfn main() {}\n"
    row = clean_files(files(("a.rs", deep, "rust")), languages=("rust",)).first()
    assert row.ok and row.after == "fn main() {}\n" and row.deleted == 1


def test_time_grows_with_the_file_not_with_its_square(files):
    import time

    def seconds(n):
        text = "`${ f(`${ a /* c */ }`) }`;\n" * n
        started = time.perf_counter()
        out = ops.lex(files(("a.js", text, "javascript")), ("javascript",)).select(F.size(F.filter("_is", lambda x: x)).alias("n")).first().n
        assert out == n
        return time.perf_counter() - started

    seconds(10)
    small, large = seconds(2_000), seconds(16_000)
    assert large < 16 * small + 2


def test_a_run_of_plain_characters_is_one_atom(files):
    """the fold's steps are what reading nested templates costs."""
    text = f"let s = {template(6)};"
    atoms = F.regexp_extract_all("text", F.lit(nesting.JS_ATOMS), F.lit(0))
    row = files(("a.js", text, "javascript")).select(atoms.alias("a")).first()
    assert "".join(row.a) == text
    assert len(row.a) < 100  # 279 when words, blanks and signs were atoms each


def test_words_before_a_slash_decide_what_it_opens(files):
    """Runs hold many words: the last one counts, and flags right after a regex are none."""
    cases = ["return  /`/g /* a */", "x = y /* a */ / `b` // c\n/`/", "/x/g\n/`/ /* a */", "a instanceof /'/i // b", "f(/`/in x /* y */)",
             "/x/ return /`/ // z", "my_return /`/* a */`/", "$return /* a */", "a\n\n  /b`/* c */`/", "/*/ a */ b", "/***/ /**/ x **/ /`/"]
    df = files(*((str(n), text, "javascript") for n, text in enumerate(cases)))
    for r in df.select("text", nesting.pieces(F.col("text"), nesting.JAVASCRIPT).alias("p")).collect():
        assert "".join(r.p) == r.text
        assert spans(r.p) == plain_scan.javascript(r.text), r.text
