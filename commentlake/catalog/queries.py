"""One entry per operator, over corpora derived from the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.catalog import corpora as C
from commentlake.dims import MAX_BYTES
from commentlake.functions import shorten
from commentlake.functions.hof import pinned
from commentlake.functions.protect import Protections
from commentlake.operators import comments as ops
from commentlake.operators import edits as ed
from commentlake.operators import review as rv
from commentlake.operators.edits import Options
from commentlake.plans import report
from commentlake.session import work_dir
from commentlake.sources import files as src
from commentlake.sources import snapshots as snap
from commentlake.sources import trees
from commentlake.streaming import incremental

PY, SQL, JS, TS, HTML = ("python",), ("sql",), ("javascript",), ("typescript",), ("html",)


def _files(spark: SparkSession, d: str, select: str) -> DataFrame:
    return C.corpus(spark, d, select)


def _hashed(spark: SparkSession, d: str, select: str) -> DataFrame:
    return src.decode(_files(spark, d, select))


# ---- selection --------------------------------------------------------------
def select_files(spark, d):
    return src.select_files(_files(spark, d, C.PATHS), max_bytes=MAX_BYTES).select("path", "size", "lang")


def select_visible_files(spark, d):
    return src.select_files(_files(spark, d, C.PATHS), max_bytes=MAX_BYTES, skip_hidden=True).select("path", "lang")


def skipped_files(spark, d):
    return src.skipped_files(_files(spark, d, C.PATHS), max_bytes=MAX_BYTES)


def language_of_file(spark, d):
    return src.with_language(_files(spark, d, C.PATHS)).select("path", "lang").distinct()


def _requests(spark, d):
    """A directory, exact files and names that do not exist, from the table itself."""
    return C.corpus(
        spark, d,
        f"SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'src2/' WHEN doc_id % 3 = 1 THEN {C._DOC_PATH} "
        f"ELSE concat('gone/', {C._str('doc_id')}) END AS path FROM documents",
    )


def requested_files(spark, d):
    return src.requested_files(_files(spark, d, C.DOCUMENTS), _requests(spark, d)).select("path")


def missing_requests(spark, d):
    return src.missing_requests(_files(spark, d, C.DOCUMENTS), _requests(spark, d))


def changed_since_snapshot(spark, d):
    return src.changed_since(_hashed(spark, d, C.CURRENT), _hashed(spark, d, C.BASE)).select(
        "path", "status", "file_sha1"
    )


def changed_files_text(spark, d):
    out = src.only_changed(_hashed(spark, d, C.CURRENT), _hashed(spark, d, C.BASE))
    return out.select("path", F.length("text").alias("n_chars"))


# ---- trees --------------------------------------------------------------------
def _tree(spark, d) -> DataFrame:
    """Files of every name, written as a directory tree and read back."""
    folder = work_dir(spark, "tree")
    trees.write_files(_files(spark, d, C.TREE), folder)
    return src.read_tree(spark, folder)


def tree_files(spark, d):
    return src.decode(_tree(spark, d)).select("path", "size", "file_sha1")


def tree_skipped(spark, d):
    return src.skipped_files(_tree(spark, d), skip_hidden=True)


# ---- extraction ---------------------------------------------------------------
def page_regions(spark, d):
    return ops.file_regions(_files(spark, d, C.PAGES))


def page_comments(spark, d):
    found = ops.extract_comments(_files(spark, d, C.PAGES), HTML, context=())
    return found.select("path", "comment_id", "start", "end", "kind", "text")


def page_comment_counts(spark, d):
    found = ops.extract_comments(_files(spark, d, C.PAGES), HTML, context=())
    return found.groupBy("path").agg(F.count("*").alias("comments"))


def _plain(files: DataFrame, languages) -> DataFrame:
    found = ops.list_comments(files, languages)
    return found.select("path", "comment_id", "start", "kind", "doc", "open_tok", "text")


def sql_comments(spark, d):
    return _plain(_files(spark, d, C.PARTS), SQL)


def js_comments(spark, d):
    return _plain(_files(spark, d, C.EVENTS), JS)


def py_comments(spark, d):
    return _plain(_files(spark, d, C.DOCUMENTS), PY)


def ts_comments(spark, d):
    return _plain(_files(spark, d, C.SUPPLIERS), TS)


def nested_block_comments(spark, d):
    return _plain(_files(spark, d, C.NESTED_BLOCKS), ("rust",))


def js_template_comments(spark, d):
    return _plain(_files(spark, d, C.NESTED_TEMPLATES), JS)


def rule_cases(spark, d):
    """Every language with the constructs that are special to it."""
    found = ops.scan_comments(_files(spark, d, C.RULE_CASES), languages=C.CASE_LANGUAGES)
    return found.select(
        "path", "comment_id", "start", "kind", "doc", "lang", "text", "inner", "own_line", "jsx_wrapped",
        "sole_statement", "protected",
    )


def comment_positions(spark, d):
    found = ops.annotate(ops.extract_comments(_files(spark, d, C.EVENTS), JS, context=()).withColumn(
        "following", F.lit(None).cast("string")))
    return found.select("path", "start", "end", "line", "end_line", "col", "indent", "own_line", "trailing")


def comment_context(spark, d):
    found = ops.annotate(ops.extract_comments(_files(spark, d, C.DOCUMENTS), PY))
    return found.select("path", "start", "code_before", "code_after", "code_same_line", "inner")


def bare_doc_lines(spark, d):
    found = ops.annotate(ops.extract_comments(_files(spark, d, C.SUPPLIERS), TS))
    return found.select(
        "path", "start", F.array_join("inner_lines", "|").alias("lines"), "jsx_wrapped", "sole_statement"
    )


# ---- classification -------------------------------------------------------------
def _scan(spark, d, select=C.DOCUMENTS, languages=PY) -> DataFrame:
    return ops.scan_comments(_files(spark, d, select), languages=languages)


def protected_by_reason(spark, d):
    return report.by_protection(_scan(spark, d))


def license_headers(spark, d):
    c = _scan(spark, d)
    return c.where(F.col("protected") == "header").select("path", "line", "text")


def protection_details(spark, d):
    c = _scan(spark, d)
    return c.where(F.col("protected_by").isNotNull()).select("path", "line", "protected", "protected_by")


def unprotected_when_off(spark, d):
    """The same corpus with every protection switched off but API docs."""
    off = Protections(directives=False, headers=False, markers=False)
    c = ops.scan_comments(_files(spark, d, C.DOCUMENTS), off, PY)
    return c.groupBy("protected").agg(F.count("*").alias("comments"))


def style_openers(spark, d):
    return report.by_style_reason(_scan(spark, d))


def style_restates(spark, d):
    c = ops.classify(ops.annotate(ops.extract_comments(_files(spark, d, C.DOCUMENTS), PY)))
    return c.select("path", "start", F.round("restated", 6).alias("restated"))


def style_score(spark, d):
    return _scan(spark, d).select("path", "start", F.round("ai_score", 4).alias("ai_score"))


def style_score_sql(spark, d):
    return _scan(spark, d, C.PARTS, SQL).select("path", "start", F.round("ai_score", 4).alias("ai_score"))


def style_tags(spark, d):
    return _scan(spark, d, C.SUPPLIERS, TS).select(
        "path", "start", F.round("ai_score", 4).alias("ai_score"), F.array_join("ai_reasons", ",").alias("reasons")
    )


# ---- reports ------------------------------------------------------------------------
def _counts(spark, d):
    return ops.file_counts(_files(spark, d, C.DOCUMENTS), languages=PY)


def scan_totals(spark, d):
    return report.scan_totals(_counts(spark, d)).withColumn(
        "comment_share", F.round("comment_share", 4)
    )


def scan_files(spark, d):
    return report.scan_files(_counts(spark, d))


def first_files(spark, d):
    return report.first_files(report.scan_files(_counts(spark, d)), 40)


def flagged_top(spark, d):
    return report.flagged_top(_scan(spark, d), 200, width=100).select("path", "line", "score", "text")


def flagged_all(spark, d):
    return report.flagged(_scan(spark, d)).select("path", "start", "line", "score", "text")


def report_json(spark, d):
    return report.as_json(report.scan_files(_counts(spark, d)), mode="scan")


# ---- shortening -----------------------------------------------------------------------
def _sentences(spark, d):
    return C.corpus(spark, d, "SELECT doc_id, text FROM documents")


def clean_prose(spark, d):
    return _sentences(spark, d).select("doc_id", shorten.clean_prose(F.col("text")).alias("prose"))


def fit_budget(spark, d):
    return _sentences(spark, d).select("doc_id", shorten.fit(F.col("text"), F.lit(80)).alias("fitted"))


def truncate_text(spark, d):
    return _sentences(spark, d).select("doc_id", shorten.truncate(F.col("text"), F.lit(60)).alias("cut"))


def banner_groups(spark, d):
    arrays = ops.classified_arrays(_files(spark, d, C.DOCUMENTS), languages=PY, upto=ops.PROTECTED)
    arrays = arrays.withColumn("_banner", pinned(ed.banner_flags(F.col("comments"))))
    pairs = F.arrays_zip(F.transform("comments", lambda c: c["line"]).alias("line"), F.col("_banner").alias("flag"))
    rows = arrays.select("path", F.explode_outer(F.filter(pairs, lambda p: p["flag"])).alias("p"))
    return rows.where(F.col("p").isNotNull()).select("path", F.col("p.line").alias("line"))


def dedupe_nearby(spark, d):
    arrays = ops.classified_arrays(_files(spark, d, C.DOCUMENTS), languages=PY, upto=ops.PROTECTED)
    copies = ed.duplicate_flags(F.col("comments"), lambda c, i: c["protected"].isNull())
    arrays = arrays.withColumn("_copies", pinned(copies))
    pairs = F.arrays_zip(F.transform("comments", lambda c: c["line"]).alias("line"), F.col("_copies").alias("flag"))
    rows = arrays.select("path", F.explode_outer(F.filter(pairs, lambda p: p["flag"])).alias("p"))
    return rows.where(F.col("p").isNotNull()).select("path", F.col("p.line").alias("line"))


# ---- rewriting ---------------------------------------------------------------------------
def strip_comments(spark, d):
    return ed.strip_comments(_files(spark, d, C.EVENTS), JS).select("path", "code")


def canonical_code(spark, d):
    return ed.canonical_code(_files(spark, d, C.DOCUMENTS), PY).select("path", "code")


def canonical_pages(spark, d):
    return ed.canonical_code(_files(spark, d, C.PAGES), HTML).select("path", "code")


def delete_comments(spark, d):
    return ed.clean_files(_files(spark, d, C.DOCUMENTS), "delete", languages=PY).select("path", "after")


def delete_sql_comments(spark, d):
    return ed.clean_files(_files(spark, d, C.PARTS), "delete", languages=SQL).select("path", "after")


def delete_page_comments(spark, d):
    return ed.clean_files(_files(spark, d, C.PAGES), "delete", languages=HTML).select("path", "after")


def delete_flagged(spark, d):
    """Only comments from a score on."""
    out = ed.clean_files(_files(spark, d, C.DOCUMENTS), "delete", Options(min_score=0.5), languages=PY)
    return out.select("path", "after")


def reduce_comments(spark, d):
    return ed.clean_files(_files(spark, d, C.EVENTS), "reduce", languages=JS).select("path", "after")


def reduce_documents(spark, d):
    return ed.clean_files(_files(spark, d, C.DOCUMENTS), "reduce", languages=PY).select("path", "after")


def shrink_docs(spark, d):
    opts = Options(shrink_docs=True)
    return ed.clean_files(_files(spark, d, C.SUPPLIERS), "reduce", opts, languages=TS).select("path", "after")


def delete_docs(spark, d):
    """API documentation may go as well."""
    prot = Protections(docs=False)
    out = ed.clean_files(_files(spark, d, C.SUPPLIERS), "delete", protections=prot, languages=TS)
    return out.select("path", "after")


def edit_log(spark, d):
    planned = ed.plan_reduce(ops.classified_arrays(_files(spark, d, C.EVENTS), languages=JS, upto=ed.wanted("reduce")))
    return ed.edits_of(planned).select(
        "path", "comment_id", "start", "end", "action", F.array_join("lines", "|").alias("lines"), "reason"
    )


def verify_unchanged(spark, d):
    out = ed.clean_files(_files(spark, d, C.DOCUMENTS), "reduce", languages=PY)
    return out.select("path", "ok", "first_difference")


def verify_tampered(spark, d):
    """A rewrite that also touched code is caught, with the place named."""
    files = _files(spark, d, C.PARTS)
    planned = ed.plan_delete(ops.classified_arrays(files, languages=SQL, upto=ed.wanted("delete")))
    applied = ed.apply_edits(planned).withColumn("after", F.replace("after", F.lit("AS s;"), F.lit("AS t;")))
    return ed.verify(applied, SQL).select("path", "ok", "first_difference")


def verify_proved(spark, d):
    """Cleaned files whose edits are undone byte by byte and confirmed by a second reading."""
    applied = ed.apply_edits(ed.plan_delete(ops.classified_arrays(_files(spark, d, C.NESTED_TEMPLATES), languages=JS, upto=ed.wanted("delete"))))
    proved = ed.prove(applied, JS)
    return proved.select("path", F.sha1(F.encode("after", "UTF-8")).alias("after_sha1"), "reversible", "confirmed")


def undo_log(spark, d):
    applied = ed.apply_edits(ed.plan_delete(ops.classified_arrays(_files(spark, d, C.NESTED_TEMPLATES), languages=JS, upto=ed.wanted("delete"))))
    return ed.undo_log(applied)


def change_summary(spark, d):
    return report.change_summary(ed.clean_files(_files(spark, d, C.DOCUMENTS), "delete", languages=PY))


def change_totals(spark, d):
    return report.change_totals(change_summary(spark, d))


# ---- reviews -------------------------------------------------------------------------------
def _queue(spark, d, mode="humanize"):
    return rv.build_reviews(_hashed(spark, d, C.EVENTS), mode, languages=JS)


def _answers(spark, d):
    """The queue filled in by rule with replies of every kind, as a file of JSON
    lines that goes out and comes back."""
    q = _queue(spark, d)
    n = F.regexp_extract("file", r"(\d+)", 1).cast("bigint")
    which = (n + F.substring("id", -1, 1).cast("int")) % 6
    reply = (
        F.when(which == 0, F.array(F.lit("kept short")))
        .when(which == 1, F.array().cast("array<string>"))
        .when(which == 2, F.array(F.lit("// marked */"), F.lit("second line")))
        .when(which == 3, F.col("current"))
        .when(which == 4, F.array(F.repeat(F.lit("long words "), 40)))
    )
    stale = F.when(n % 5 == 0, F.lit("0")).otherwise(F.col("file_sha1"))
    odd = F.when(n % 7 == 0, F.lit("0")).otherwise(F.col("raw_sha1"))
    filled = q.withColumns(
        {"new_text": reply, "file_sha1": stale, "raw_sha1": odd, "deletable": F.col("deletable") & (n % 3 != 0)}
    )
    path = work_dir(spark, "reviews")
    rv.write_reviews(filled, path)
    return rv.read_reviews(spark, path)[0]


def review_queue(spark, d):
    return _queue(spark, d).select(
        "id", "file", "kind", "is_api_doc", "deletable", "lines", "raw_sha1", "file_sha1", "max_lines",
        "max_chars", F.array_join("current", "|").alias("current"),
        F.array_join("span", "-").alias("span"),
    )


def _judged(spark, d):
    return rv.judge_reviews(_answers(spark, d), _hashed(spark, d, C.EVENTS), JS)


def review_edits(spark, d):
    return rv.review_edits(_judged(spark, d)).select(
        "path", "comment_id", "action", F.array_join("lines", "|").alias("lines"),
        F.array_join("warnings", ",").alias("warnings"),
    )


def review_rejects(spark, d):
    return rv.review_rejects(_judged(spark, d))


def review_apply(spark, d):
    out = rv.apply_reviews(_hashed(spark, d, C.EVENTS), _judged(spark, d), languages=JS)
    return out.select("path", "after", "ok")


# ---- snapshots ------------------------------------------------------------------------------
def _originals(spark, d):
    """Two runs of originals: all documents, then those of the later base."""
    first = _files(spark, d, C.DOCUMENTS).withColumn("run_id", F.lit("20240101-000000"))
    second = _files(spark, d, C.BASE).withColumn("run_id", F.lit("20240102-000000"))
    return first.unionByName(second)


def list_snapshots(spark, d):
    return snap.snapshots(_originals(spark, d))


def restore_latest(spark, d):
    out = snap.restore(_files(spark, d, C.CURRENT), _originals(spark, d))
    return out.select("path", F.sha1(F.encode("text", "UTF-8")).alias("sha1"), "restored")


def restore_named(spark, d):
    out = snap.restore(_files(spark, d, C.CURRENT), _originals(spark, d), "20240101-000000")
    return out.select("path", F.sha1(F.encode("text", "UTF-8")).alias("sha1"), "restored")


def _published(spark, d) -> str:
    """A store of two runs: the parts without comments, then half of them again."""
    cleaned = ed.clean_files(_files(spark, d, C.PARTS), "delete", languages=SQL)
    store = work_dir(spark, "store")
    snap.publish(cleaned, store, "20240101-000000")
    snap.publish(cleaned, store, "20240102-000000", failed=cleaned.where(F.length("before") % 2 == 0).select("path"))
    return store


def published_runs(spark, d):
    return snap.runs(spark, _published(spark, d))


def published_files(spark, d):
    out = snap.read_store(spark, _published(spark, d), snap.CLEANED)
    return out.select("run_id", "path", F.sha1(F.encode("text", "UTF-8")).alias("sha1"))


def restore_published(spark, d):
    """Published files go back to the originals of the latest run that has them."""
    store = _published(spark, d)
    now = snap.read_store(spark, store, snap.CLEANED).where("run_id = '20240101-000000'").select("path", "text")
    out = snap.restore(now, snap.read_store(spark, store))
    return out.select("path", F.sha1(F.encode("text", "UTF-8")).alias("sha1"), "restored")


def rollback_selected(spark, d):
    cleaned = ed.clean_files(_files(spark, d, C.PARTS), "delete", languages=SQL)
    failed = _files(spark, d, C.PARTS).where(F.length("text") % 3 == 0).select("path")
    return snap.roll_back(cleaned, failed)


# ---- streaming ---------------------------------------------------------------------------------
def stream_comments(spark, d):
    """Events landed as a Parquet stream, extracted incrementally, read back."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    landed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    files = spark.sql(C.EVENTS.replace("FROM events", "FROM {events}"), events=landed)
    base = work_dir(spark, "stream_comments")
    query = incremental.extract_stream(files, f"{base}/comments", f"{base}/state", languages=JS)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/comments").select("path", "comment_id", "start", "kind", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        select_files, select_visible_files, skipped_files, language_of_file, requested_files,
        missing_requests, tree_files, tree_skipped, changed_since_snapshot, changed_files_text,
        page_regions, page_comments, page_comment_counts, sql_comments, js_comments, py_comments,
        ts_comments, nested_block_comments, js_template_comments, rule_cases, comment_positions, comment_context, bare_doc_lines,
        protected_by_reason, license_headers, protection_details, unprotected_when_off,
        style_openers, style_restates, style_score, style_score_sql, style_tags,
        scan_totals, scan_files, first_files, flagged_top, flagged_all, report_json,
        clean_prose, fit_budget, truncate_text, banner_groups, dedupe_nearby,
        strip_comments, canonical_code, canonical_pages, delete_comments, delete_sql_comments,
        delete_page_comments, delete_flagged, reduce_comments, reduce_documents, shrink_docs,
        delete_docs, edit_log, verify_proved, undo_log, verify_unchanged, verify_tampered, change_summary, change_totals,
        review_queue, review_edits, review_rejects, review_apply,
        list_snapshots, published_runs, published_files, restore_published, restore_latest, restore_named, rollback_selected, stream_comments,
    )
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Per-file report over web pages and documents in one pass."""
    both = _files(spark, d, C.PAGES).unionByName(_files(spark, d, C.DOCUMENTS))
    return report.scan_files(ops.file_counts(both, languages=HTML + PY))
