"""Lines that hold very many comments: what stands around them, and what they cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from commentlake.operators import comments as ops
from commentlake.operators.edits import clean_files

JS = ("javascript",)


def plain_sides(text, start, end):
    """(before, after) on the comment's lines, read from the text."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    return text[line:start], text[end : len(text) if stop < 0 else stop]


def test_facts_agree_with_the_text(files):
    rng = random.Random(5)
    parts = ["/* a */", "/* b\n c */", "// d\n", "\n", " ", "\t", "{", "}", "x;", " ", "'s'", "", "/re/"]
    rows = [(str(n), "".join(rng.choices(parts, k=rng.randrange(1, 14))), "javascript") for n in range(1500)]
    text = {p: t for p, t, _ in rows}
    found = ops.annotate(ops.extract_comments(files(*rows), JS)).collect()
    assert len(found) > 2000
    for c in found:
        before, after = plain_sides(text[c.path], c.start, c.end)
        blank = not before.strip()
        wrapped = c.kind == "block" and before.strip() == "{" and after.lstrip().startswith("}")
        lead = before[: len(before) - len(before.lstrip(" \t"))]
        assert (c.own_line, c.trailing, c.jsx_wrapped) == (blank or wrapped, not (blank or wrapped), wrapped)
        assert c.indent == (before if blank else lead)
        assert c.code_same_line == before.strip()
        assert c.gap == len(before) - len(before.rstrip(" \t")) and c.lead == len(after) - len(after.lstrip(" \t"))
        assert c.follower == (ord(after.strip()[0]) if after.strip() else 0)


def seconds(job):
    started = time.perf_counter()
    job()
    return time.perf_counter() - started


@pytest.mark.parametrize("text", ["/*a*/x;", "/* two words */ y; "])
def test_counts_of_one_line_are_linear(files, text):
    def counted(n):
        return lambda: [
            (r.comments, r.changeable) == (n, n) or pytest.fail(str(r))
            for r in ops.file_counts(files(("a.js", text * n, "javascript")), languages=JS).collect()
        ]

    counted(100)()
    n = 1_000 if "two" in text else 4_000
    small, large = seconds(counted(n)), seconds(counted(8 * n))
    assert large < 2 * 8 * small + 5


def test_one_vocabulary_per_line_says_the_same(files, monkeypatch):
    rng = random.Random(9)
    code = ["user_count", "getName()", "x += 1;", "if (a", "== b)", "total", "0", "42", "return user;", "{", "}", "+", "="]
    words = ["user", "count", "name", "gets", "add", "check", "totals", "return", "zero", "equals", "the", "some other"]
    rows = []
    for n in range(150):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            parts += rng.choices(code, k=rng.randrange(0, 4)) + [f"/* {' '.join(rng.choices(words, k=rng.randrange(1, 5)))} */"]
            parts += rng.choice([["\n"], [], [], []])
        rows.append((str(n), " ".join(parts), "javascript"))

    def shares(reread):
        monkeypatch.setattr(ops, "REREAD", reread)
        ops._restated_columns.cache_clear()
        arrays = ops.classified_arrays(files(*rows), languages=JS)
        return {(r.path, c.start): c.restated for r in arrays.select("path", "comments").collect() for c in r.comments}

    direct, folded = shares(10**6), shares(-1)
    assert direct == folded and len(set(direct.values())) > 4
    ops._restated_columns.cache_clear()
    rowwise = ops.scan_comments(files(*rows), languages=JS)
    assert rowwise.count() == len(direct)


def test_one_line_is_cleaned(files):
    n = 2_000
    row = clean_files(files(("a.js", "/*a*/x;" * n + "\n", "javascript")), languages=JS).first()
    assert row.ok and row.after == "x;" * n + "\n" and row.deleted == n


def test_context_is_not_copied_into_the_array(files):
    wide = "// " + "w" * 200_000
    text = "\n".join([wide, "x = 1; /* a */ y = 2; /* b */ z = 3;" * 2_000, wide])
    arrays = ops.classified_arrays(files(("a.js", text, "javascript")), languages=JS)
    size = arrays.select(F.length(F.to_json("comments")).alias("n")).first().n
    assert size < 20 * len(text)
