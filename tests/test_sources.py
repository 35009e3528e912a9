"""Selection, snapshots, reviews and the stream, on small folders."""

from pyspark.sql import functions as F

from commentlake.catalog.queries import HTML, PY
from commentlake.operators import comments as ops
from commentlake.operators import review as rv
from commentlake.operators.edits import Options, clean_files
from commentlake.plans import report
from commentlake.sources import files as src
from commentlake.sources import snapshots as snap
from commentlake.sources import trees
from commentlake.streaming import incremental


def tree(tmp_path, entries):
    for name, data in entries.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(tmp_path)


def test_tree_is_read_selected_and_decoded(spark, tmp_path):
    root = tree(tmp_path, {
        "a.py": "x = 1\r\n# c\r",
        "node_modules/b.py": "# skipped\n",
        "lib/c.min.js": "// skipped\n",
        "lib/.hidden/d.py": "# hidden\n",
        "lib/e.PY": "# upper\n",
        "lib/f.xyz": "# unknown\n",
        "lib/Dockerfile.prod": "# docker\n",
        "lib/bad.py": b"# \xff\xfe\n",
        "lib/big.py": "#" * 1_000_001,
        "lib/edge.py": "#" * 1_000_000,
    })
    found = src.decode(src.select_files(src.read_tree(spark, root, max_bytes=1_000_000), skip_hidden=True))
    got = {r.path: (r.lang, r.text[:20]) for r in found.collect()}
    assert set(got) == {"a.py", "lib/e.PY", "lib/Dockerfile.prod", "lib/edge.py"}
    assert got["a.py"] == ("python", "x = 1\n# c\n")
    assert got["lib/Dockerfile.prod"][0] == "dockerfile"
    everything = src.select_files(src.read_tree(spark, root), skip_hidden=True)
    assert {r.path for r in everything.collect()} == {*got, "lib/big.py", "lib/bad.py"}
    left_out = src.skipped_files(src.read_tree(spark, root), max_bytes=1_000_000)
    assert ("lib/big.py", "too_large") in {(r.path, r.why) for r in left_out.collect()}
    assert "lib/big.py" not in {r.path for r in src.read_tree(spark, root, max_bytes=1_000_000).select("path").collect()}


def test_every_name_is_listed_and_every_file_accounted_for(spark, tmp_path):
    names = ["__init__.py", "pkg/__init__.py", ".env", ".github/ci.yml", "_a/_b.py", "a b/ü.py", "deep/1/2/3/x.py", "empty.py", ".git/config", "x.bin"]
    tree(tmp_path, {**dict.fromkeys(names, "# x\n"), "empty.py": "", "pkg/bad.py": b"# \xff\xfe\n"})
    (tmp_path / "nothing").mkdir()
    listing = trees.list_tree(spark, str(tmp_path))
    assert {(r.path, r.size) for r in listing.collect()} == {(n, 0 if n == "empty.py" else 4) for n in names} | {("pkg/bad.py", 5)}
    found = src.read_tree(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {*names, "pkg/bad.py"}
    kept = {r.path for r in src.decode(src.select_files(found, skip_hidden=True)).collect()}
    why = {r.path: r.why for r in src.skipped_files(found, skip_hidden=True).collect()}
    assert kept.isdisjoint(why) and {*kept, *why} == {*names, "pkg/bad.py"}
    assert why == {".github/ci.yml": "hidden_dir", ".git/config": "hidden_dir", "x.bin": "unknown_language", "pkg/bad.py": "not_utf8"}
    assert {r.path for r in src.read_tree(spark, str(tmp_path), glob="_*.py").collect()} == {"__init__.py", "pkg/__init__.py", "_a/_b.py"}
    asked = src.select_files(found, skip_hidden=True, base=".github/")
    assert ".github/ci.yml" in {r.path for r in asked.collect()}
    assert trees.list_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_files_are_written_whole_and_read_back(spark, tmp_path):
    rows = [(f"d{k % 3}/.x{k}.py", "é\n" * k) for k in range(20)] + [("gone.py", None)]
    root = str(tmp_path / "out")
    for _ in range(2):  # writing again changes nothing
        written = trees.write_files(spark.createDataFrame(rows, "path string, text string"), root)
        assert written.count() == 20
    back = {r.path: r.content.decode() for r in src.read_tree(spark, root).collect()}
    assert back == {p: t for p, t in rows if t is not None}


def test_path_filter_reaches_the_parquet_scan(spark, files, tmp_path):
    files(("a.py", "# a\n", "python"), ("b.py", "# b\n", "python")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).where(F.col("path") == "a.py")
    out = ops.extract_comments(table, PY, context=())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(path,a.py)" in plan and "Exchange" not in plan and "Python" not in plan
    assert [r.text for r in out.collect()] == ["# a"]


def test_cleaning_never_shuffles(files):
    plan = clean_files(files(("a.py", "# a\n", "python")), "reduce", languages=PY)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "PythonUDF" not in text and "InPandas" not in text


def test_publish_restore_and_roll_back(spark, files, tmp_path):
    store = str(tmp_path / "store")
    corpus = files(
        ("a.py", "# a\nx = 1\n", "python"), ("b.py", "y = 2  # b\n", "python"), ("c.py", "z = 3\n", "python")
    )
    cleaned = clean_files(corpus, languages=PY)
    snap.publish(cleaned, store, "20240101-000000")
    failed = spark.createDataFrame([("b.py",)], "path string")
    snap.publish(cleaned, store, "20240102-000000", failed)
    originals = snap.read_store(spark, store)
    one = originals.where(F.col("run_id") == "20240102-000000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in one and "after" not in one
    assert {r.text for r in snap.read_store(spark, store, snap.CLEANED).collect()} == {"x = 1\n", "y = 2\n"}
    assert [(r.run_id, r.files) for r in snap.snapshots(originals).collect()] == [
        ("20240102-000000", 1), ("20240101-000000", 2)
    ]
    new = {r.path: r.text for r in snap.roll_back(cleaned, failed).collect()}
    assert new == {"a.py": "x = 1\n", "b.py": "y = 2  # b\n", "c.py": "z = 3\n"}
    now = cleaned.select("path", F.col("after").alias("text"))
    last = {r.path: r.text for r in snap.restore(now, originals).collect()}
    assert last == {"a.py": "# a\nx = 1\n", "b.py": "y = 2\n", "c.py": "z = 3\n"}
    first = {r.path: r.text for r in snap.restore(now, originals, "20240101-000000").collect()}
    assert first["b.py"] == "y = 2  # b\n"


def answer(reviews, path, text):
    kept = {"path": str(path)}
    filled = reviews.withColumn("new_text", text)
    rv.write_reviews(filled, kept["path"])
    return rv.read_reviews(reviews.sparkSession, kept["path"])


def test_review_round_trip(spark, files, tmp_path):
    corpus = src.decode(files(
        ("a.ts", "// wordy comment\nlet a = 1;\n", "typescript"),
        ("b.ts", "let b = 2; // gone\n", "typescript"),
        ("c.ts", "/**\n * Doc.\n */\nfunction c() {}\n", "typescript"),
        ("d.ts", "// eslint-disable-line\n// stale\nlet d = 4;\n", "typescript"),
        ("e.ts", "// left alone\nlet e = 5;\n", "typescript"),
    ))
    queue = rv.build_reviews(corpus, "humanize", Options(shrink_docs=True))
    assert {r.id for r in queue.collect()} == {
        "a.ts#c0000", "b.ts#c0000", "c.ts#c0000", "d.ts#c0001", "e.ts#c0000"
    }
    doc = queue.where("file = 'c.ts'").first()
    assert doc.is_api_doc and not doc.deletable and doc.current == ["Doc."]
    reply = (
        F.when(F.col("file") == "a.ts", F.array(F.lit("// short */"), F.lit("more")))
        .when(F.col("file").isin("b.ts", "c.ts"), F.array().cast("array<string>"))
        .when(F.col("file") == "d.ts", F.array(F.lit("x")))
    )
    valid, malformed = answer(queue, tmp_path / "r", reply)
    assert malformed.count() == 0
    later = corpus.withColumn(
        "file_sha1", F.when(F.col("path") == "d.ts", F.lit("other")).otherwise(F.col("file_sha1"))
    )
    judged = rv.judge_reviews(valid, later)
    rejects = {(r.path, r.reason) for r in rv.review_rejects(judged).collect()}
    assert rejects == {("c.ts", "deletion_refused"), ("d.ts", "file_changed")}
    edit = rv.review_edits(judged).where("path = 'a.ts'").first()
    assert edit.lines == ["short"] and edit.warnings == ["delimiter_removed", "lines_dropped"]
    done = {r.path: r.after for r in rv.apply_reviews(later, judged).collect()}
    assert done == {"a.ts": "// short\nlet a = 1;\n", "b.ts": "let b = 2;\n"}


def test_malformed_reviews_are_set_apart(spark, tmp_path):
    lines = [
        '{"version": 1, "id": "a#c0000", "file": "a", "span": [0, 3], "new_text": "one line"}',
        '{"version": 2, "id": "a#c0001", "file": "a", "new_text": null}',
        "not json",
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    valid, bad = rv.read_reviews(spark, str(tmp_path / "r.json"))
    assert [r.new_text for r in valid.collect()] == [["one line"]]
    assert bad.count() == 2


def test_counts_agree_with_the_comment_table(files):
    rows = [
        ("a.py", "# Return the key\nreturn key\n# TODO x\n\n", "python"),
        ("b.html", "<!-- x -->\n<script>// y\n</script>", "html"),
        ("c.py", "z = 1\n", "python"),
    ]
    df = files(*rows)
    comments = ops.scan_comments(df, languages=PY + HTML)
    slow = {
        r.path: (r.changeable, r.flagged, r.protected)
        for r in comments.groupBy("path").agg(
            F.count_if(F.col("protected").isNull()).alias("changeable"),
            F.count_if(report.is_flagged()).alias("flagged"),
            F.count_if(F.col("protected").isNotNull()).alias("protected"),
        ).collect()
    }
    counts = ops.file_counts(df, languages=PY + HTML)
    fast = {r.path: (r.changeable, r.flagged, r.protected) for r in report.scan_files(counts).collect()}
    assert fast == slow == {"a.py": (1, 1, 1), "b.html": (2, 0, 0)}
    total = report.scan_totals(counts).first()
    assert (total.files, total.comments, total.total_lines) == (3, 4, 8)


def test_stream_picks_up_only_new_files(spark, tmp_path):
    landing = tmp_path / "in"
    tree(landing, {"a.py": "# one\n"})

    def run():
        stream = incremental.landed_files(spark, str(landing)).withColumn("lang", F.lit("python"))
        incremental.extract_stream(
            stream, str(tmp_path / "out"), str(tmp_path / "state"), languages=PY
        ).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["# one"]
    tree(landing, {"sub/b.py": "x = 1  # two\n"})
    assert run() == ["# one", "# two"]
    assert run() == ["# one", "# two"]


def test_tasks_follow_the_stored_bytes_of_a_table(spark, tmp_path, monkeypatch):
    """the longest task must not grow with the table."""
    from commentlake.sources import files as source

    path = str(tmp_path / "t")
    spark.range(200_000).select(F.sha1(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(source, "TASK_BYTES", 1 << 18)
    out = source.spread(spark.read.parquet(path))
    assert out.rdd.getNumPartitions() > 16  # 8, one per core, before
    assert out.count() == 200_000


def test_listed_comments_are_the_extracted_ones(files):
    """a list of comments without their lines, for jobs that want none."""
    from commentlake.catalog import corpora as C

    texts = [(f"{n}.{c[0]}", c[2].replace("¶", "\n").replace("´", "'").replace("¬", "\\").replace("§", "7"), c[1]) for n, c in enumerate(C.CASES)]
    df = files(*texts, ("none.js", "x", "javascript"), ("empty.py", "", "python"), ("null.py", None, "python"))
    listed = ops.list_comments(df, C.CASE_LANGUAGES)
    full = ops.extract_comments(df, C.CASE_LANGUAGES, context=()).select(*listed.columns)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, full.collect()))
    assert listed.count() > 20
    assert "_lines" not in listed._jdf.queryExecution().optimizedPlan().toString()
