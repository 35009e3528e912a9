"""Source corpora derived from the driver tables.

Each is one SELECT of plain string functions that reads the same in Spark SQL and
in DuckDB; it describes the input of a query, never the work under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commentlake.sources.files import spread

NL = "chr(10)"
QUOTE = "chr(39)"


def _text(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _str(column: str) -> str:
    return f"CAST({column} AS STRING)"


PAGES = f"SELECT {_text(repr('page_'), _str('page_id'), repr('.html'))} AS path, html AS text, 'html' AS lang FROM pages"

PARTS = f"""
SELECT {_text("'part/'", _str('p_partkey'), "'.sql'")} AS path,
  {_text("'-- '", 'p_name', NL, "'SELECT '", _str('p_partkey'), "' AS k; -- '", 'p_type', NL,
         "'SELECT '", QUOTE, "'a -- no'", QUOTE, "' AS s;'", NL, "'/* '", 'p_brand', "' */'", NL)} AS text,
  'sql' AS lang
FROM part"""

EVENTS = f"""
SELECT {_text("'ev/'", _str('event_id'), "'.js'")} AS path,
  {_text("'const u = \"http://e/'", _str('event_id'), "'\"; // '", 'event_type', NL,
         "'// user '", _str('user_id'), "' sent this'", NL,
         "'/* Note that the batch is '", _str('event_id'), "'.'", NL, "'   Values stay as sent. */'", NL,
         "'send(u, '", QUOTE, 'event_type', QUOTE, "');'", NL)} AS text,
  'javascript' AS lang
FROM events"""

_NOTES = ", ".join(
    f"'# kept in step', {NL}, '{v} = {i}', {NL}" for i, v in enumerate(("aa", "bb", "cc"))
)
_DOC_TEXT = f"""concat('#!/usr/bin/env python3', {NL},
    CASE WHEN doc_id % 5 = 0 THEN concat('# ==========', {NL}, '# SECTION', {NL}, '# ==========', {NL}) ELSE '' END,
    '# ', replace(text, {NL}, concat({NL}, '# ')), {NL},
    'doc_', {_str('doc_id')}, ' = ', {_str('n_chars')}, '  # ', lang, {NL},
    CASE WHEN doc_id % 3 = 0 THEN concat({_NOTES}) ELSE '' END,
    CASE WHEN doc_id % 7 = 0 THEN concat('# TODO: read ', {_str('doc_id')}, {NL}) ELSE '' END)"""
_DOC_PATH = f"concat(source, '/', {_str('doc_id')}, '.py')"

DOCUMENTS = f"SELECT {_DOC_PATH} AS path, {_DOC_TEXT} AS text, 'python' AS lang FROM documents"

PATHS = f"""
SELECT concat(
    CASE doc_id % 9 WHEN 0 THEN 'app/node_modules/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'src/.cache/' ELSE 'src/' END,
    source, '/',
    CASE doc_id % 11 WHEN 0 THEN 'Dockerfile.dev' WHEN 1 THEN '.env.local' WHEN 2 THEN 'Makefile'
      ELSE concat('f', {_str('doc_id')},
        CASE doc_id % 8 WHEN 0 THEN '.min.js' WHEN 1 THEN '.PY' WHEN 2 THEN '.ts' WHEN 3 THEN '.unknown'
          WHEN 4 THEN '.Rs' WHEN 5 THEN '' WHEN 6 THEN '.tar.gz' ELSE '.scala' END) END) AS path,
  CASE WHEN doc_id % 11 < 3 THEN 1000 WHEN doc_id % 10 = 0 THEN n_chars * 400 ELSE n_chars END AS size
FROM documents"""

CURRENT = f"""
SELECT {_DOC_PATH} AS path,
  {_DOC_TEXT} || CASE WHEN doc_id % 7 = 0 THEN concat('# edited', {NL}) ELSE '' END AS text, 'python' AS lang
FROM documents WHERE doc_id % 13 <> 0"""
BASE = f"SELECT {_DOC_PATH} AS path, {_DOC_TEXT} AS text, 'python' AS lang FROM documents WHERE doc_id % 11 <> 0"

# Documented functions: an API comment, a docstring-like summary, tags of all sorts.
SUPPLIERS = f"""
SELECT {_text("'sup/'", _str('s_suppkey'), "'.ts'")} AS path,
  {_text("'/**'", NL, "' * This function returns the supplier '", 's_name', "'. Note that it is slow.'", NL,
         "' * @param key - The key'", NL, "' * @param account - balance in cents of '", 's_name', NL,
         "' * @returns The row'", NL, "' */'", NL,
         "'function supplier(key, account) '", "chr(123)", NL, "'  // Return the key'", NL, "'  return key; // as is'", NL,
         "chr(125)", NL)} AS text,
  'typescript' AS lang
FROM supplier"""

# ---- rule by rule ------------------------------------------------------------
# Small files that each turn on one rule, told apart by the key of a table's row. In the
# texts § stands for the key, ¶ for a line end, ´ for a single quote, ¬ for a backslash;
# beside each file what it holds, read from the rules by hand:
# (text, kind, doc, bare text, own line, alone in braces, sole statement, protected).
CASES = (
    ("js", "javascript", "let r = /a¬/¬/[/*]§/i; // tail §¶", [("// tail §", "line", False, "tail §", False, False, False, None)]),
    ("js", "javascript", "s = `${ f({ a: { b: { c: { d: `${ `${ x /* in § */ } // no` } // no` } } } }) } // no`; // out §¶", [
        ("/* in § */", "block", False, "in §", False, False, False, None), ("// out §", "line", False, "out §", False, False, False, None)]),
    ("ts", "typescript", "t = `a${ `b${ `c${ `d${ `e${ `f${ g({ h: /}`/ }) /* six § */ }` }` }` }` }` }`;¶", [
        ("/* six § */", "block", False, "six §", False, False, False, None)]),
    ("jsx", "javascript", "const a = (¶  <p>¶    {/* note § */}¶  </p>¶);¶", [("/* note § */", "block", False, "note §", True, True, False, None)]),
    ("rs", "rust", "/* a /* b /* c § */ */ */¶let q = ´\"´; let s = r#\"// \"no\" §\"#; // life §¶", [
        ("/* a /* b /* c § */ */ */", "block", False, "a /* b /* c § */ */", True, False, False, None),
        ("// life §", "line", False, "life §", False, False, False, None)]),
    ("sh", "shell", "#!/bin/sh¶cat <<´END´ # head §¶# body §¶END¶x=$((1 << 3)) # shift §¶", [
        ("#!/bin/sh", "line", False, "!/bin/sh", True, False, False, "shebang"),
        ("# shift §", "line", False, "shift §", False, False, False, None)]),
    ("php", "php", "<p>// no</p>¶<?php¶$t = <<<TXT¶// body §¶TXT;¶// real §¶?>¶<i># no</i>¶", [
        ("// real §", "line", False, "real §", True, False, False, None)]),
    ("yml", "yaml", "run: |¶  # body §¶  go¶key: 1  # yes §¶", [("# yes §", "line", False, "yes §", False, False, False, None)]),
    ("py", "python", "def f():¶    \"\"\"Sole §.\"\"\"¶¶¶def g():¶    \"\"\"First §.¶¶    Second.¶    \"\"\"¶    return 1  # noqa: E501¶", [
        ("\"\"\"Sole §.\"\"\"", "docstring", True, "Sole §.", True, False, True, "api_doc"),
        ("\"\"\"First §.¶¶    Second.¶    \"\"\"", "docstring", True, "First §. Second.", True, False, False, "api_doc"),
        ("# noqa: E501", "line", False, "noqa: E501", False, False, False, "directive")]),
    ("js", "javascript", "// eslint-disable-next-line no-console¶console.log(§);¶", [
        ("// eslint-disable-next-line no-console", "line", False, "eslint-disable-next-line no-console", True, False, False, "directive")]),
    ("go", "go", "p := `x // § y`¶//go:build linux¶// z §¶", [
        ("//go:build linux", "line", False, "go:build linux", True, False, False, "directive"),
        ("// z §", "line", False, "z §", True, False, False, None)]),
    ("html", "html", "<!-- m § --><script>// j §¶</script><style>/* c § */</style>¶", [
        ("<!-- m § -->", "block", False, "m §", True, False, False, None), ("// j §", "line", False, "j §", False, False, False, None),
        ("/* c § */", "block", False, "c §", False, False, False, None)]),
    ("toml", "toml", "a = ´´´¶# in §¶´´´  # out §¶", [("# out §", "line", False, "out §", False, False, False, None)]),
    ("sql", "sql", "SELECT ´it´´s -- §´; -- out §¶", [("-- out §", "line", False, "out §", False, False, False, None)]),
    ("lua", "lua", "--[[ l¶ § ]] x = 1 -- n §¶", [
        ("--[[ l¶ § ]]", "block", False, "l §", True, False, False, None), ("-- n §", "line", False, "n §", False, False, False, None)]),
    ("rb", "ruby", "=begin¶long §¶=end¶puts 1 # s §¶", [
        ("=begin¶long §¶=end", "block", False, "long §", True, False, False, None), ("# s §", "line", False, "s §", False, False, False, None)]),
    ("swift", "swift", "let a = \"\"\"¶// in §¶\"\"\" /* b /* § */ */¶/// doc §¶", [
        ("/* b /* § */ */", "block", False, "b /* § */", False, False, False, None),
        ("/// doc §", "line", True, "doc §", True, False, False, "api_doc")]),
    ("java", "java", "// Copyright § A¶class B {} // TODO: §¶", [
        ("// Copyright § A", "line", False, "Copyright § A", True, False, False, "header"),
        ("// TODO: §", "line", False, "TODO: §", False, False, False, "marker")]),
)
CASE_LANGUAGES = tuple(dict.fromkeys(c[1] for c in CASES))


def case_text(template: str) -> str:
    """SQL for a text of ``CASES`` in the row whose key is p_partkey."""
    # Braces name tables where Spark takes a SELECT.
    quoted = "'" + template.replace("{", "⟨").replace("}", "⟩") + "'"
    for mark, value in (("§", _str("p_partkey")), ("¶", NL), ("´", QUOTE), ("¬", "chr(92)"), ("⟨", "chr(123)"), ("⟩", "chr(125)")):
        quoted = f"replace({quoted}, '{mark}', {value})"
    return quoted


def _by_case(values) -> str:
    return f"CASE p_partkey % {len(CASES)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


RULE_CASES = f"""
SELECT concat('case/', {_str('p_partkey')}, '.', {_by_case(f"'{c[0]}'" for c in CASES)}) AS path,
  {_by_case(case_text(c[2]) for c in CASES)} AS text, {_by_case(f"'{c[1]}'" for c in CASES)} AS lang
FROM part"""

# Block comments as deep as the key says, and templates around a comment likewise.
NESTED_BLOCKS = f"""
SELECT concat('deep/', {_str('p_partkey')}, '.rs') AS path,
  concat('let a = 1; ', repeat('/* x ', CAST(p_partkey % 12 + 1 AS INT)), p_name, repeat(' */', CAST(p_partkey % 12 + 1 AS INT)),
    ' let b = "/* no */"; // end', {NL}) AS text, 'rust' AS lang
FROM part"""
_DEPTH = "CAST(event_id % 7 AS INT)"
_OPEN, _SHUT = "chr(123)", "chr(125)"
NESTED_TEMPLATES = f"""
SELECT concat('deep/', {_str('event_id')}, '.js') AS path,
  concat('const s = ', repeat(concat('`a $', {_OPEN}, ' f(', {_OPEN}, ' k: ', {_OPEN}, ' v: '), {_DEPTH}), 'x /* deep ',
    {_str('event_id')}, ' */', repeat(concat(' ', {_SHUT}, ' ', {_SHUT}, ') ', {_SHUT}, ' // no`'), {_DEPTH}), '; // ',
    event_type, {NL}) AS text, 'javascript' AS lang
FROM events"""

# Names that listings tend to miss, and files that selection leaves out.
TREE = f"""
SELECT concat(CASE p_partkey % 7 WHEN 0 THEN concat('pkg/m', {_str('p_partkey')}, '/__init__.py')
    WHEN 1 THEN concat('conf/c', {_str('p_partkey')}, '/.env') WHEN 2 THEN concat('.github/', {_str('p_partkey')}, '.yml')
    WHEN 3 THEN concat('src/_', {_str('p_partkey')}, '.py') WHEN 4 THEN concat('node_modules/', {_str('p_partkey')}, '.js')
    WHEN 5 THEN concat('src/', {_str('p_partkey')}, '.bin') ELSE concat('src/', {_str('p_partkey')}, '.min.js') END) AS path,
  {_text("'# '", 'p_name', NL)} AS text
FROM part"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def corpus(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """Run a corpus SELECT over the tables it names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in select}
    used = {t: spread(df) for t, df in used.items()}
    for t in used:
        select = select.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(select, **used)
