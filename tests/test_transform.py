"""Protection, scoring, planning and rewriting on small texts of their own."""

import pytest
from pyspark.sql import functions as F

from commentlake.functions.protect import Protections
from commentlake.operators import comments as ops
from commentlake.operators.edits import Options, canonical_code, clean_files

ALL_OFF = Protections(False, False, False, False)


def run(files, cases, mode="delete", **kw):
    """Clean all cases in one job; returns the new texts in order."""
    langs = {"ts": "typescript", "py": "python", "sh": "shell", "go": "go", "html": "html", "tsx": "typescript"}
    rows = [(f"{i:03d}.{ext}", text, langs[ext]) for i, (ext, text) in enumerate(cases)]
    out = clean_files(files(*rows), mode, **kw).orderBy("path").collect()
    for r in out:
        # Removing a comment that code follows also takes the blanks between them.
        # That shifts the code, so the check sets such a file aside.
        leading = r.before.startswith("/* ") and "*/ " in r.before and mode == "delete"
        assert r.ok != leading, (r.path, r.first_difference)
    return [r.after for r in out]


PROTECTED = [
    ("ts", "// eslint-disable-next-line no-undef\ng();\n", "directive"),
    ("ts", "// @ts-ignore old\ng();\n", "directive"),
    ("py", "import sys  # noqa: E402\n", "directive"),
    ("py", "y = g()  # type: ignore[misc]\n", "directive"),
    ("sh", "#!/bin/bash\nls\n", "shebang"),
    ("py", "# -*- coding: latin-1 -*-\ny = 1\n", "directive"),
    ("ts", "// Copyright 2020 Someone\nlet a = 1;\n", "header"),
    ("ts", "/*! keep me */\nlet a = 1;\n", "preserved"),
    ("ts", "// FIXME wrong order\nlet a = 1;\n", "marker"),
    ("ts", "// fixme: wrong order\nlet a = 1;\n", "marker"),
    ("ts", "/**\n * Adds.\n */\nfunction add() {}\n", "api_doc"),
    ("py", 'def g():\n    """Adds."""\n    return 2\n', "api_doc"),
    ("go", "//go:generate x\npackage p\n", "directive"),
    ("sh", "# shellcheck disable=SC1090\nls\n", "directive"),
    ("go", "// Code generated by gen. DO NOT EDIT.\npackage p\n", "directive"),
]


def test_protected_comments_survive_and_carry_their_code(files):
    cases = [(ext, text) for ext, text, _ in PROTECTED]
    assert run(files, cases) == [text for _, text in cases]
    langs = {"ts": "typescript", "py": "python", "sh": "shell", "go": "go"}
    rows = [(f"{i:03d}", text, langs[ext]) for i, (ext, text) in enumerate(cases)]
    found = {r.path: r for r in ops.scan_comments(files(*rows)).collect()}
    assert [found[f"{i:03d}"].protected for i in range(len(cases))] == [c for *_, c in PROTECTED]
    assert found["008"].protected_by == "FIXME" and found["009"].protected_by == "FIXME"
    assert found["002"].protected_by == "noqa"


DELETED = [
    ("ts", "// gone\nlet a = 1;\n", "let a = 1;\n"),
    ("ts", "let a = 1; // gone\n", "let a = 1;\n"),
    ("ts", "/* gone */ let a = 1;\n", "let a = 1;\n"),
    ("tsx", "<p>\n  {/* gone */}\n  <i/>\n</p>\n", "<p>\n  <i/>\n</p>\n"),
    ("ts", "let a = 1;\n\n// gone\n// too\n\nlet b = 2;\n", "let a = 1;\n\nlet b = 2;\n"),
    ("ts", "let a = 1;\n// gone\nlet b = 2;\n", "let a = 1;\nlet b = 2;\n"),
    ("ts", "// gone\n\nlet b = 2;\n", "let b = 2;\n"),
    ("ts", "let a = 1;\n// last", "let a = 1;\n"),
    ("ts", "/* one */ /* two */ let a = 1;\n", "/* one */ let a = 1;\n"),
    ("ts", 'let u = "ws://a//b"; // gone\n', 'let u = "ws://a//b";\n'),
    ("html", "<p>\n<!-- gone -->\n</p>\n", "<p>\n</p>\n"),
]


def test_deletion_is_exact(files):
    assert run(files, [(e, t) for e, t, _ in DELETED]) == [w for *_, w in DELETED]


def test_deleting_twice_changes_nothing_more(files):
    once = run(files, [(e, t) for e, t, _ in DELETED if "/* two */" not in t])
    exts = [e for e, t, _ in DELETED if "/* two */" not in t]
    assert run(files, list(zip(exts, once))) == once


def test_sole_docstring_stays_even_unprotected(files):
    cases = [
        ("py", 'def stub():\n    """Only body."""\n'),
        ("py", 'def stub():\n    """Only body."""\n\n# c\nz = 1\n'),
        ("py", 'def g():\n    """Doc."""\n    return 1\n'),
        ("py", '"""Module."""\n'),
    ]
    got = run(files, cases, protections=ALL_OFF)
    assert got == [cases[0][1], 'def stub():\n    """Only body."""\n\nz = 1\n', "def g():\n    return 1\n", ""]


REDUCED = [
    ("ts", "// =======\n// PART A\n// =======\nlet a = 1;\n", "let a = 1;\n"),
    ("ts", "// Increment the total\ntotal += 1;\n", "total += 1;\n"),
    ("ts", "// rebates come before taxes here\nt = g(x);\n", "// rebates come before taxes here\nt = g(x);\n"),
    ("ts", "// This function parses the header\nfunction h() {}\n", "// parses the header\nfunction h() {}\n"),
    ("ts", "/* Short first. Note that padding follows here for nothing. */\nlet a = 1;\n",
     "/* Short first. */\nlet a = 1;\n"),
    # The second repeats the first three lines on; the third only the dropped one.
    ("ts", "// same words\na();\nb();\n// same words\nc();\nd();\n// same words\ne();\n",
     "// same words\na();\nb();\nc();\nd();\n// same words\ne();\n"),
    ("ts", "/**\n * Sum.\n * Note that padding.\n */\nfunction s() {}\n",
     "/**\n * Sum.\n * Note that padding.\n */\nfunction s() {}\n"),
]


def test_reduction_is_exact(files):
    assert run(files, [(e, t) for e, t, _ in REDUCED], "reduce") == [w for *_, w in REDUCED]


def test_line_length_bounds_the_result(files):
    text = "// " + "ab " * 90 + "\nlet a = 1;\n"
    (out,) = run(files, [("ts", text)], "reduce", opts=Options(max_len=50))
    assert max(map(len, out.splitlines())) <= 50 and out.startswith("// ab")


def test_docs_are_shortened_on_request_but_never_deleted(files):
    cases = [
        ("ts", "/**\n * Sum.\n * Note that padding.\n * @param a - balance in cents\n * @param b\n */\nfunction s() {}\n"),
        ("ts", "/**\n * Note that only padding.\n */\nfunction s() {}\n"),
        ("py", 'def ld(p):\n    """Load it.\n\n    Long prose here.\n\n    Args:\n        p: Where\n    """\n    return 1\n'),
    ]
    got = run(files, cases, "reduce", opts=Options(shrink_docs=True))
    assert got[0] == "/**\n * Sum.\n * @param a - balance in cents\n */\nfunction s() {}\n"
    assert got[1].startswith("/**")
    assert got[2] == 'def ld(p):\n    """Load it.\n\n    Args:\n        p: Where\n    """\n    return 1\n'


def test_min_score_spares_low_scores(files):
    text = "// Initialize the counter to zero\nlet counter = 0;\n// odd business rule\nlet x = 1;\n"
    (out,) = run(files, [("ts", text)], opts=Options(min_score=0.5))
    assert out == "let counter = 0;\n// odd business rule\nlet x = 1;\n"


@pytest.mark.parametrize("mode", ["delete", "reduce"])
def test_code_survives_every_protection_setting(files, mode):
    page = (
        "<template>\n  <!-- a -->\n  <p/>\n</template>\n<script>\n// b\nlet r = /\\/\\//; // c\n"
        "let s = `x${y/* d */}`;\n</script>\n<style>\n/* e */\np { c: url(//f) } /* g */\n</style>\n"
    )
    rows = [("w.vue", page, "vue"), ("s.sh", "#!/bin/sh\ncat <<E\n# in\nE\nls # out\n", "shell")]
    for prot in (Protections(), ALL_OFF):
        for r in clean_files(files(*rows), mode, Options(shrink_docs=True), prot).collect():
            assert r.ok, r.first_difference
            assert "# in" in r.after or r.path == "w.vue"


def test_canonical_form(files):
    rows = [
        ("a", "// one\nlet a = 1;  \n\n\nlet b = 2; // two\n", "javascript"),
        ("b", "let a = 1;\nlet b = 2;\n", "javascript"),
        ("c", "<p>\n  {/* c */}\n</p>\n", "javascript"),
        ("d", "<p>\n</p>\n", "javascript"),
        ("e", "def g():\n    return 1\n", "python"),
        ("f", "def g():\nreturn 1\n", "python"),
    ]
    code = {r.path: r.code for r in canonical_code(files(*rows)).collect()}
    assert code["a"] == code["b"] and code["c"] == code["d"] and code["e"] != code["f"]


def test_annotation(files):
    text = "let z = 0;\n\tlet a = 1; /* one\n  two */ let b;\n  // own\nlast();\n"
    block, own = ops.scan_comments(files(("a.ts", text, "typescript"))).orderBy("start").collect()
    assert (block.line, block.end_line, block.col, block.trailing, block.indent) == (2, 3, 12, True, "\t")
    assert block.inner_lines == ["one", "two"] and block.code_same_line == "let a = 1;"
    assert (own.own_line, own.indent, own.inner, own.comment_id) == (True, "  ", "own", "c0001")
    assert own.code_before == "let z = 0;\n\tlet a = 1; /* one\n  two */ let b;"
    assert own.code_after == "last();"


def test_required_literals_do_not_lose_a_directive():
    from commentlake.functions.protect import DIRECTIVE_LITERALS, DIRECTIVES, required_literal

    assert all(len(x) >= 3 for x in DIRECTIVE_LITERALS)
    assert required_literal(r"\beslint\s*\{") == "eslint"
    assert required_literal(r"auto-?generated") == "generated"
    assert required_literal(r"-\*-\s*\w+") == "-*-"
    assert required_literal(r"^\s*//\s*\+build") == "+build"
    held = [any(x in p.replace("\\", "").lower() for x in DIRECTIVE_LITERALS) for p in DIRECTIVES]
    assert all(held)


def _planted(spark, text, lang, region, action="delete"):
    """A plan that takes a region of code for a comment."""
    from commentlake.operators import edits as ed

    frame = spark.createDataFrame([("a", text, lang)], "path string, text string, lang string")
    planned = ed.plan_delete(ops.classified_arrays(frame, languages=(lang,)))
    start = text.index(region)
    moved = F.transform(
        "comments",
        lambda c: c.withField("start", F.lit(start)).withField("end", F.lit(start + len(region))).withField("text", F.lit(region))
        .withField("line", F.lit(text.count("\n", 0, start) + 1)).withField("col", F.lit(start - text.rfind("\n", 0, start) - 1))
        .withField("breaks", F.lit(0)).withField("end_line", F.lit(text.count("\n", 0, start) + 1)),
    )
    return ed.prove(ed.apply_edits(planned.withColumn("comments", moved)), (lang,)).first()


def test_a_planted_region_is_refused(spark):
    js = "let u = `${ f(1) } // not a comment`; // real\n"
    honest = _planted(spark, js, "javascript", "// real")
    assert honest.reversible and honest.confirmed
    wrong = _planted(spark, js, "javascript", "// not a comment")
    assert wrong.reversible and wrong.confirmed is False
    for lang, text, region in (("java", 'String s = "/* x */"; // y\n', "/* x */"), ("go", "p := `// x`\n// y\n", "// x"),
                               ("rust", 'let s = r#"// x"#; // y\n', "// x"), ("css", "a { b: '/* x */' } /* y */\n", "/* x */")):
        assert _planted(spark, text, lang, region).confirmed is False


def test_edits_can_be_undone_byte_by_byte(spark):
    from commentlake.operators import edits as ed

    texts = [("a.js", "// one\nlet é = 1; /* two */ f(); /* three\n four */\n\n\n// five\n\ng();\n", "javascript"),
             ("b.js", "x();\n", "javascript"), ("c.py", "# a\n# b\nx = 1  # c\n", "python")]
    frame = spark.createDataFrame(texts, "path string, text string, lang string")
    languages = ("javascript", "python")
    applied = ed.apply_edits(ed.plan_delete(ops.classified_arrays(frame, languages=languages)))
    log = {}
    for r in ed.undo_log(applied).collect():
        log.setdefault(r.path, []).append((r.at, r.removed, r.repl))
    for r in applied.select("path", "after").collect():
        before = {p: t for p, t, _ in texts}[r.path]
        back = r.after
        for start, removed, repl in sorted(log.get(r.path, [])):
            assert back[start : start + len(repl)] == repl
            back = back[:start] + removed + back[start + len(repl):]
        assert back == before
    proved = {r.path: (r.reversible, r.confirmed) for r in ed.prove(applied, languages).collect()}
    assert proved == {"a.js": (True, True), "b.js": (True, True), "c.py": (True, None)}
    tampered = applied.withColumn("after", F.concat("after", F.lit("!")))
    assert {r.path: r.reversible for r in ed.prove(tampered, languages).collect()} == {"a.js": False, "b.js": True, "c.py": False}
    clean = ed.clean_files(frame, "delete", languages=languages, proof=True).collect()
    assert all(r.ok for r in clean if r.path != "a.js")
