"""What a row costs: how values are named, how folds are built, what travels and what is stored."""

from __future__ import annotations

import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from commentlake.functions import nesting
from commentlake.functions.hof import ONE_BLOCK, let, prefix
from commentlake.operators import review as rv
from commentlake.sources.files import decode


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_named_value_is_read_without_working_out_its_type_per_call(spark):
    df = spark.range(3).select(let(F.col("id") + 1, lambda x: x * x).alias("v"))
    assert [r.v for r in df.collect()] == [1, 4, 9]
    assert "element_at(transform(array(" in _plan(df)


@pytest.mark.parametrize("n", [0, 1, ONE_BLOCK - 1, ONE_BLOCK, ONE_BLOCK + 1, 1000])
def test_prefix_on_both_sides_of_one_block(spark, n):
    values = [random.Random(n).randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(prefix(F.col("v"), F.lit(5), "int", lambda a, x: a + x)).first()[0]
    assert got == [5 + sum(values[:i]) for i in range(n)]


def test_braces_are_counted_without_strings(spark):
    """Braces at the top, in interpolations and in templates within them, also unbalanced ones."""
    text = "}{{ `a ${ {b: {c: `x ${ {} /* 1 */ } // no ${ `}` }` /* 2 */ }} } // no` /* 3 */ }} `${`${ '}' }`}/* no */` // 4"
    spans = spark.range(1).select(nesting.comment_spans(F.lit(text), nesting.JAVASCRIPT)).first()[0]
    assert [text[p >> 32:p & 0xFFFFFFFF] for p in spans] == ["/* 1 */", "/* 2 */", "/* 3 */", "// 4"]
    assert nesting.JAVASCRIPT.braces and not nesting.JAVASCRIPT.effects


# ---- reviews -----------------------------------------------------------------------
def _sha(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


A, B = "// one\nlet a; /* two */\n", "// other\nlet b;\n"


def _files(spark, *rows):
    return decode(spark.createDataFrame([(p, t, "javascript") for p, t in rows], "path string, text string, lang string"))


def _review(path, n, raw, new_text, claimed, span=None, deletable=True, current=("old",)):
    return (1, "humanize", f"{path}#c{n:04d}", path, claimed, "javascript", "line", False, deletable, "1-1", span or [n, n + 1],
            raw, 0.0, [], 1, 40, list(current), "", "", new_text)


def test_reviews_are_stored_packed_and_read_back(spark, tmp_path):
    asked = spark.createDataFrame([_review("a.js", k, _sha("// one"), ["line"], _sha(A)) for k in range(500)], rv.REVIEW_SCHEMA)
    rv.write_reviews(asked.coalesce(1), f"{tmp_path}/out")
    parts = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    lines = b"".join(gzip.decompress(p.read_bytes()) for p in parts)
    assert lines.count(b"\n") == 500 and b'"code_before":""' in lines
    assert sum(p.stat().st_size for p in parts) * 5 < len(lines)
    valid, malformed = rv.read_reviews(spark, f"{tmp_path}/out")
    assert sorted(valid.collect()) == sorted(asked.collect()) and malformed.count() == 0


def test_verdicts_where_paths_repeat_or_are_null(spark):
    files = _files(spark, ("p", A), ("twice", A), ("twice", B), (None, A))
    one, two, other = _sha("// one"), _sha("/* two */"), _sha("// other")
    asked = [
        _review("p", 0, one, ["new"], _sha(A)), _review("p", 0, one, ["later"], _sha(A), span=[7, 8]), _review("p", 1, two, [], "0"),
        _review("p", 9, two, ["new"], "0"), _review("p", 2, one, None, "0"),
        _review("twice", 0, other, ["new"], _sha(B)), _review("twice", 1, two, ["old"], _sha(B)),
        _review("gone", 0, one, ["new"], _sha(A)), _review(None, 0, None, ["new"], _sha(A)), _review(None, 1, one, ["new"], _sha(A)),
    ]
    judged = rv.judge_reviews(spark.createDataFrame(asked, rv.REVIEW_SCHEMA), files, ("javascript",))
    got = sorted((r.path or "", r.comment_id, r.action or "", ",".join(r.lines), r.reason or "") for r in judged.collect())
    # Each text of a repeated path speaks for the file, and each of its comments is held against the answer.
    assert got == sorted([
        ("p", "c0000", "replace", "new", ""), ("p", "c0001", "delete", "", ""), ("p", "c0009", "", "new", "comment_missing"),
        ("twice", "c0000", "replace", "new", ""), ("twice", "c0000", "", "new", "comment_missing"),
        ("twice", "c0000", "", "new", "file_changed"), ("twice", "c0000", "", "new", "file_changed"),
        ("twice", "c0001", "", "old", "file_changed"), ("twice", "c0001", "", "old", "unchanged"),
        ("gone", "c0000", "", "new", "file_unreadable"), ("", "c0000", "replace", "new", ""), ("", "c0001", "", "new", "comment_missing"),
    ])


def test_reviews_and_files_move_once_each(spark):
    files = _files(spark, ("p", A))
    asked = spark.createDataFrame([_review("p", 0, _sha("// one"), ["new"], _sha(A))], rv.REVIEW_SCHEMA)
    judged = rv.judge_reviews(asked, files, ("javascript",))
    exchanges = lambda df: re.findall(r"Exchange hashpartitioning\((\w+)", df._jdf.queryExecution().executedPlan().toString())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(rv.review_edits(judged)) == ["path", "path"]
        assert exchanges(rv.review_rejects(judged)) == ["path", "path"]
        gathered = [_plan(v(judged)).count("collect_list(") for v in (rv.review_rejects, rv.review_edits)]
        assert gathered[0] < gathered[1]  # rejects gather no lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
