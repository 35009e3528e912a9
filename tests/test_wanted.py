"""What a plan asks of the classification, and the searches that rule comments out early."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from commentlake.functions import protect, score
from commentlake.operators import comments as ops
from commentlake.operators import edits as ed
from commentlake.operators import review as rv
from commentlake.sources.files import decode


def test_plans_compute_only_what_they_read(spark):
    text = "# Return the key\nkey = 1  # the key is one\n# ====\n# kept as is\n# kept as is\nx = key\n"
    files = spark.createDataFrame([("a.py", text, "python")], "path string, text string, lang string")
    for mode, missing in (("delete", {"restated", "rules", "ai_score"}), ("reduce", {"rules", "ai_score"})):
        lean = ops.classified_arrays(files, languages=("python",), upto=ed.wanted(mode))
        full = ops.classified_arrays(files, languages=("python",))
        assert not missing & set(lean.schema["comments"].dataType.elementType.fieldNames())
        after = [ed.apply_edits(ed.PLANS[mode](x)).select("after").first()[0] for x in (lean, full)]
        assert after[0] == after[1] != text
    assert ed.wanted("delete", ed.Options(min_score=0.5)) == ops.SCORE


@pytest.mark.parametrize(("words", "code", "share"), [
    (["key", "returned", "valued"], "return keyName", 2 / 3),
    (["loops", "empty", "zero", "increment"], "for (i = 0; i < n; i++) null", 1.0),
    (["enable", "naming"], "class_name = True  # é", 0.5),
    (["alpha", "beta"], "alphabet", 0.5),
    (["alone"], "alone", 0.0),
])
def test_share_of_echoed_words(spark, words, code, share):
    row = spark.createDataFrame([(words, code)], "w array<string>, c string")
    assert row.select(score.share_of(F.col("w"), F.col("c"))).first()[0] == pytest.approx(share)


def test_every_licence_and_directive_passes_the_early_search():
    assert all(any(p in x for p in protect.DIRECTIVE_PIECES) for x in protect.DIRECTIVE_LITERALS)
    for line in ("SPDX-License-Identifier", "Copyright", "(c) 2020", "Licensed", "license", "All Rights Reserved",
                 "@license", "@preserve", "GNU General Public", "MIT License", "Apache License"):
        assert any(p in line.lower() for p in protect.LICENSE_PIECES)


def test_applying_reviews_reads_protection_only_where_its_count_is_asked_for(spark):
    text = "// eslint-disable-next-line\nlet a = 1; // old words\n/* go */\nlet b = 2;\n"
    files = decode(spark.createDataFrame([("a.js", text, "javascript"), ("b.js", text, "javascript")], "path string, text string, lang string"))
    judged = spark.createDataFrame(
        [("a.js", "c0001", "replace", ["new words"], [], None), ("a.js", "c0002", "delete", [], [], None), ("b.js", "c0001", None, [], [], "unchanged")],
        "path string, comment_id string, action string, lines array<string>, warnings array<string>, reason string",
    )
    out = rv.apply_reviews(files, judged, languages=("javascript",))
    row = out.collect()
    assert [(r.path, r.after, r.ok, r.deleted, r.shortened, r.protected) for r in row] == [
        ("a.js", "// eslint-disable-next-line\nlet a = 1; // new words\nlet b = 2;\n", True, 1, 1, 1)
    ]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "eslint" in plan(out.select("protected"))
    assert "eslint" not in plan(out.select("path", "after", "ok"))


def test_judging_reviews_works_out_no_places(spark):
    files = decode(spark.createDataFrame([("a.js", "// one\nlet a; /* two */\n", "javascript")], "path string, text string, lang string"))
    texts = ops.list_texts(files, ("javascript",))
    assert sorted(map(tuple, texts.collect())) == [("a.js", "c0000", "// one"), ("a.js", "c0001", "/* two */")]
    listed = ops.list_comments(files, ("javascript",)).select("path", "comment_id", "text")
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, listed.collect()))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_pos#" in plan(listed) and "_pos#" not in plan(texts)
