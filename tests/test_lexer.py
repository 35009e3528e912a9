"""Table-driven cases: language, text, and the comments it holds, in one job."""

from pyspark.sql import functions as F

from commentlake.functions import lexer
from commentlake.operators import comments as ops

CASES = [
    ("javascript", "// alpha\nlet n = 2; /* beta */\n", ["// alpha", "/* beta */"]),
    ("javascript", 'open("ftp://host/dir");\n', []),
    ("javascript", "open(`ftp://h/${id}//x`);\n", []),
    ("javascript", "s = `p${ /* in */ k }q`; // out\n", ["/* in */", "// out"]),
    ("javascript", "s = `p${ f(`r${ g /* deep */ }//no`) }//no`; // z\n", ["/* deep */", "// z"]),
    ("javascript", "const rx = /a\\/\\/[^/]*/i;\n", []),
    ("javascript", "q = w / h; // ratio\n", ["// ratio"]),
    ("javascript", "if (x) return /'\\/\"/.exec(y); // done\n", ["// done"]),
    ("javascript", "t = `${v.replace(/\"/g, '')}`; // d\n", ["// d"]),
    ("javascript", "/**/ a\n/* don't */\n", ["/**/", "/* don't */"]),
    ("javascript", "x = '" + "b" * 600_000 + "'; // far", ["// far"]),
    ("python", "k = 1  # one\nm=2#two\n", ["# one", "#two"]),
    ("python", 's = "no # here"\nt = \'nor # here\'\n', []),
    ("python", '"""Module text."""\nimport re\n', ['"""Module text."""']),
    ("python", "#!/bin/py\n# -*- x -*-\nr'''Raw text.'''\n", ["#!/bin/py", "# -*- x -*-", "r'''Raw text.'''"]),
    ("python", 'def g():  # c\n    # d\n\n    """Doc."""\n    pass\n', ["# c", "# d", '"""Doc."""']),
    ("python", 'SQL = """\n# inside\n"""\n', []),
    ("python", 'call(\n    """\n    arg # x\n    """\n)\n', []),
    ("python", 'a = 1\n"""loose"""\n# end', ["# end"]),
    ("shell", "ls a#b\nls a # b\n", ["# b"]),
    ("shell", "cat <<END\n# body\nEND\n# tail\n", ["# tail"]),
    ("shell", "cat <<-'END' | sort # head\n# body\n\tEND\n# tail\n", ["# tail"]),
    ("shell", "cat <<< word # a\nn=$((1 << 3)) # b\n# c\n", ["# a", "# b", "# c"]),
    ("yaml", "k: v  # yes\nu: http://h/p#frag\n", ["# yes"]),
    ("yaml", "run: |\n  go\n\n  # body\nnext: 1  # yes\n", ["# yes"]),
    ("yaml", "l:\n  - a: >-  # head\n      # body\n  # yes\n", ["# yes"]),
    ("toml", "a = '''\n# in\n'''  # out\nb = 'c\\' # d\n", ["# out", "# d"]),
    ("ini", "a = 1 ; one\nb=2;no\n# two\n", ["; one", "# two"]),
    ("makefile", "all: a#b\n\t# two\n", ["# two"]),
    ("sql", "SELECT 'it''s -- in'; -- out\n/* x */--glued\nSELECT a--b\n", ["-- out", "/* x */"]),
    ("css", "a { b: url(//c) } /* d */", ["/* d */"]),
    ("scss", "// e\na { b: c }\n", ["// e"]),
    ("c", '/// api\nchar *s = "//"; // no api\n', ["/// api", "// no api"]),
    ("java", 'String s = """\n // in\n"""; // out\n', ["// out"]),
    ("go", "p := `x // y`\n// z\n", ["// z"]),
    ("rust", "fn f<'a>(s: &'a str) {} // life\nlet q = '\"'; //! doc\n", ["// life", "//! doc"]),
    ("rust", "/* a /* b */ c */ let s = r#\"x\" // y\"#; // z\n", ["/* a /* b */ c */", "// z"]),
    ("swift", "/* a /* b */ */ let x = 1 // y\n", ["/* a /* b */ */", "// y"]),
    ("ruby", "=begin\nlong\n=end\nputs 1 # s\n", ["=begin\nlong\n=end", "# s"]),
    ("lua", "--[[ l\nm ]] x = 1 -- n\n", ["--[[ l\nm ]]", "-- n"]),
    ("html", '<a href="http://h">l</a>\n<!-- real -->\n', ["<!-- real -->"]),
    ("html", "<script>\n// js\n</script><!-- h --><style>/* c */</style>", ["// js", "<!-- h -->", "/* c */"]),
    ("html", '<script data-x="' + "x" * 5000 + '"></script>\n<p>see http://x.y/z and more</p><!-- e -->', ["<!-- e -->"]),
    ("html", '<style title="' + "x" * 5000 + '">/* s */</style><p>http://x</p><script src="a"></script>// no', ["/* s */"]),
    ("html", "<script>// a\n</script><script type='text/plain'>// no\n</script><script>// b", ["// a"]),
    ("html", '<script type="application/ld+json">{"u": "//x"}</script>', []),
    ("html", "<script></script><script type=module>//m\n</script><script> // open", ["//m"]),
    ("vue", '<p/><!-- t --><script lang="ts">\n// s\n</script>', ["<!-- t -->", "// s"]),
    ("php", '<a href="http://h">\n<?php // in\n#[Attr]\n$a = 1; ?> //out <?= 2 # e ?>', ["// in", "# e "]),
    ("php", "<?php\n$t = <<<TXT\n// body\n  TXT;\n# tail\n", ["# tail"]),
    ("javascript", "unclosed = 'abc\n// next\n", ["// next"]),
    ("javascript", "a /* to the end", ["/* to the end"]),
    ("python", "é = '😀'  # ünï\n", ["# ünï"]),
]


def test_cases(spark, files):
    rows = [(f"{i}", text, lang) for i, (lang, text, _) in enumerate(CASES)]
    found = {r.path: r for r in ops.lex(files(*rows)).collect()}
    wrong = []
    for i, (lang, text, want) in enumerate(CASES):
        row = found[str(i)]
        tokens = [t.tok for t in row._tok]
        assert "".join(tokens) == text, f"{lang}: tokens must tile the text"
        got = [t for t, is_comment in zip(tokens, row._is) if is_comment]
        if got != want:
            wrong.append((lang, text[:80], got, want))
        for tok, packed, start in zip(tokens, row._pos, row._bol):
            offset, lines = packed & 0xFFFFFFFF, packed >> 32
            assert text[offset:offset + len(tok)] == tok
            assert text[:offset].count("\n") == lines
            assert text.rfind("\n", 0, offset) + 1 == start
    assert not wrong


def test_many_comments_in_one_file(files):
    text = "# n\nx = 1\n" * 20_000
    out = ops.extract_comments(files(("big.py", text, "python")), ("python",), context=())
    last = out.orderBy(F.desc("start")).first()
    assert out.count() == 20_000
    assert (last.start, last.line) == (len(text) - 10, 39_999)


def test_prefix_is_an_exclusive_running_fold(spark):
    n = 5_000
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a"))
    got = df.select(lexer.prefix(F.col("a"), F.lit(0), "int", lambda s, x: s + x).alias("p")).first().p
    assert got == [k * (k + 1) // 2 for k in range(n)]
    assert df.select(lexer.prefix(F.slice("a", 1, 0), F.lit(0), "int", lambda s, x: s + x).alias("p")).first().p == []
