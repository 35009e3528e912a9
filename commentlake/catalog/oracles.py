"""Independent SQL for the catalog, written for DuckDB.

The corpora are known line patterns, so comments are found here by splitting
lines and by instr(), not by a lexer; RE2 has no look-around, so the rules that
use it in Spark are rephrased.
"""

from __future__ import annotations

from commentlake.catalog import corpora as C
from commentlake.dims import EXCLUDED_DIRS, EXCLUDED_SUFFIXES, EXT_DIM, MAX_BYTES, NAME_DIM
from commentlake.functions import protect, score, shorten


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _rule_cases() -> str:
    """The comments that CASES lists, one SELECT each."""
    out = []
    for k, (ending, lang, template, comments) in enumerate(C.CASES):
        for n, (text, kind, doc, inner, own, wrapped, sole, protected) in enumerate(comments):
            said = C.case_text(text)
            out.append(
                f"SELECT concat('case/', CAST(p_partkey AS STRING), '.{ending}') AS path, 'c{n:04d}' AS comment_id, "
                f"instr({C.case_text(template)}, {said}) - 1 AS \"start\", '{kind}' AS kind, {doc} AS doc, "
                f"{_q(_region_of(lang, text))} AS lang, {said} AS text, {C.case_text(inner)} AS \"inner\", {own} AS own_line, "
                f"{wrapped} AS jsx_wrapped, {sole} AS sole_statement, {_q(protected) if protected else 'CAST(NULL AS STRING)'} AS protected "
                f"FROM part WHERE p_partkey % {len(C.CASES)} = {k}"
            )
    return " UNION ALL ".join(out)


def _region_of(lang: str, text: str) -> str:
    """Scripts and styles in markup are of their own language."""
    return {"//": "javascript", "/*": "css"}.get(text[:2], lang) if lang == "html" else lang


# ---- selection ----------------------------------------------------------------
_NAME = "regexp_replace(path, '^.*/', '')"
_SELECTION = f"""
WITH paths AS ({C.PATHS}), named AS (
  SELECT path, size, {_NAME} AS name,
    lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) AS ext FROM paths),
names(name, by_name) AS (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in NAME_DIM)}),
exts(ext, by_ext) AS (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in EXT_DIM)}),
known AS (
  SELECT DISTINCT n.path, n.size, coalesce(by_name,
      CASE WHEN starts_with(n.name, 'Dockerfile') THEN 'dockerfile' WHEN starts_with(n.name, '.env') THEN 'shell' END,
      by_ext) AS lang
  FROM named n LEFT JOIN names USING (name) LEFT JOIN exts USING (ext)),
ruled AS (
  SELECT *, list_has_any(string_split(path, '/'), {_list(EXCLUDED_DIRS)}) AS in_dir,
    {" OR ".join(f"ends_with(path, {_q(s)})" for s in EXCLUDED_SUFFIXES)} AS generated FROM known)
"""
_KEPT = f"NOT in_dir AND NOT generated AND lang IS NOT NULL AND size <= {MAX_BYTES}"

_REQUESTS = f"""requests AS (
  SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'src2/' WHEN doc_id % 3 = 1 THEN {C._DOC_PATH}
    ELSE concat('gone/', CAST(doc_id AS STRING)) END AS path FROM documents)"""

# ---- document corpus: one row per line, one per comment --------------------------
_LINES = f"""
corpus AS ({C.DOCUMENTS}),
cut AS (SELECT path, string_split(text, chr(10)) AS ls FROM corpus),
lines AS (
  SELECT path, ls, n, ls[n] AS l,
    coalesce(sum(length(ls[n]) + 1) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM cut, LATERAL (SELECT unnest(generate_series(1, len(ls) - 1)) AS n))"""
_COMMENTS = rf"""
found AS (
  SELECT path, ls, n AS line, l, CAST(off AS BIGINT) + instr(l, '#') - 1 AS start, substr(l, instr(l, '#')) AS text,
    NOT starts_with(l, '#') AS behind, substr(l, 1, instr(l, '#') - 1) AS head,
    row_number() OVER (PARTITION BY path ORDER BY n) - 1 AS k
  FROM lines WHERE starts_with(l, '#') OR (starts_with(l, 'doc_') AND contains(l, '#'))),
opened AS (SELECT *, regexp_replace({_strip('text')}, '^#', '') AS o FROM found),
closed AS (SELECT *, regexp_replace(o, '(\]\])?(\*/)?(-->)?$', '') AS c FROM opened),
bare AS (
  SELECT *, {_strip(r"CASE WHEN regexp_matches(c, '^\s*\*([^/]|$)') THEN regexp_replace(c, '^\s*\*', '') ELSE c END")} AS inner_
  FROM closed),
near AS (
  SELECT *, array_to_string(ls[greatest(1, line - 3):line - 1], chr(10)) AS code_before,
    array_to_string(ls[line + 1:least(line + 3, len(ls) - 1)], chr(10)) AS code_after FROM bare),
guarded AS (
  SELECT *, CASE
    WHEN starts_with(text, '#!') AND line = 1 THEN 'shebang'
    WHEN regexp_matches(text, {_q(protect.DIRECTIVE_PATTERN)}) THEN 'directive'
    WHEN line <= 8 AND regexp_matches(text, {_q(protect.LICENSE_PATTERN)}) THEN 'header'
    WHEN regexp_matches(text, {_q(protect.MARKER_PATTERN)}) OR regexp_matches(text, {_q(protect.ANY_CASE_PATTERN)}) THEN 'marker'
    END AS protected FROM near)"""
_FOUND = f"WITH {_LINES}, {_COMMENTS}"

# ---- style rules ----------------------------------------------------------------
_OPENER_HIT = " ".join(
    f"WHEN regexp_matches(inner_, {_q('(?i)' + p)}) THEN {i}" for i, (p, _, _) in enumerate(score.OPENERS)
)
_OPENER_WEIGHT = " ".join(
    f"WHEN {i} THEN CAST({w} AS DOUBLE)" for i, (_, w, _) in enumerate(score.OPENERS)
)
_OPENER_LABEL = " ".join(f"WHEN {i} THEN {_q(label)}" for i, (_, _, label) in enumerate(score.OPENERS))


def _evokes(has: str, table) -> str:
    parts = [f"CASE WHEN {has.format(key=_q(k))} THEN {_list(ws)} ELSE [] END" for k, ws in table.items()]
    return "flatten([" + ", ".join(parts) + "])"


_STYLE = rf"""
targets AS (
  SELECT *, CASE WHEN behind THEN {_strip('head')}
    ELSE array_to_string(string_split(code_after, chr(10))[1:2], chr(10)) END AS target FROM guarded),
idents AS (
  SELECT *, list_filter(flatten(list_transform(
      regexp_extract_all(target, '[A-Za-z_$][\p{{L}}\p{{N}}_$]*'),
      lambda t: string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[_\s]+'))), lambda p: p <> '') AS parts
  FROM targets),
lowered AS (SELECT *, list_transform(parts, lambda p: lower(p)) AS low,
    regexp_extract_all(target, '\b\d+\b') AS nums FROM idents),
vocab AS (
  SELECT *, list_concat(list_concat(low, {_evokes('list_contains(low, {key})', score.KEYWORD_WORDS)}),
    list_concat({_evokes('list_contains(nums, {key})', score.DIGIT_WORDS)},
      {_evokes('contains(target, {key})', score.OPERATOR_WORDS)})) AS ids,
    regexp_extract_all(lower(inner_), '[a-zA-ZÀ-ſ]+') AS ws FROM lowered),
content AS (
  SELECT *, list_filter(ws, lambda w: length(w) > 2 AND NOT list_contains({_list(score.STOPWORDS)}, w)) AS cw FROM vocab),
shared AS (
  SELECT *, CASE WHEN {_strip('target')} = '' OR len(cw) < 2 THEN 0.0 ELSE
    CAST(len(list_filter(cw, lambda w: list_contains(ids, w) OR len(list_filter(ids, lambda i: length(i) >= 4
      AND (starts_with(w, i) OR starts_with(i, w)))) > 0)) AS DOUBLE) / len(cw) END AS restated FROM content),
rules AS (
  SELECT *, CASE {_OPENER_HIT} END AS opener,
    {_strip('inner_')} <> '' AND (regexp_matches(inner_, {_q(score.BANNER_LINE)}) OR regexp_matches(inner_, {_q(score.SECTION_LINE)})) AS decorated,
    len(ws) > 25 AS wordy FROM shared),
rated AS (
  SELECT *, CASE WHEN {_strip('inner_')} = '' THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE),
      coalesce(CASE opener {_OPENER_WEIGHT} END, CAST(0 AS DOUBLE))
      + CASE WHEN decorated THEN CAST(0.5 AS DOUBLE) ELSE 0 END
      + CASE WHEN restated >= 0.6 THEN CAST(0.5 AS DOUBLE) WHEN restated >= 0.4 THEN CAST(0.25 AS DOUBLE) ELSE 0 END
      + CASE WHEN wordy THEN CAST(0.15 AS DOUBLE) ELSE 0 END) END AS ai_score FROM rules)"""
_RATED = f"{_FOUND}, {_STYLE}"
_FLAG = "protected IS NULL AND ai_score >= 0.5"


def _copies(source: str) -> str:
    """CTEs ending in ``copies``: near duplicates of the last kept one, row by row."""
    return f"""
ranked AS (SELECT path, line, lower(inner_) AS key, row_number() OVER (PARTITION BY path, lower(inner_) ORDER BY line) AS r FROM {source}),
walk AS (
  SELECT path, key, r, line, line AS anchor, FALSE AS copy FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.path, n.key, n.r, n.line, CASE WHEN n.line - w.anchor <= 3 THEN w.anchor ELSE n.line END, n.line - w.anchor <= 3
  FROM walk w JOIN ranked n ON n.path = w.path AND n.key = w.key AND n.r = w.r + 1),
copies AS (SELECT path, line FROM walk WHERE copy)"""


_BANNER_RUNS = f"""flags AS (
  SELECT path, line, inner_, NOT behind AND protected IS NULL AS member,
    {_strip('inner_')} <> '' AND regexp_matches(inner_, {_q(shorten.BANNER_ONLY)}) AS banner FROM guarded),
isl AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS g FROM flags WHERE member),
runs AS (SELECT path, g, count(*) AS c, bool_or(banner) AS b FROM isl GROUP BY path, g),
framed AS (SELECT isl.path, isl.line FROM isl JOIN runs ON runs.path = isl.path AND runs.g = isl.g WHERE c >= 2 AND b)"""

_COUNTS = f"""{_RATED}, counts AS (
  SELECT path, count(*) FILTER (WHERE protected IS NULL) AS changeable,
    count(*) FILTER (WHERE {_FLAG}) AS flagged,
    count(*) FILTER (WHERE protected IS NOT NULL) AS protected FROM rated GROUP BY path)"""

# ---- shortening -------------------------------------------------------------------
_I = "(?i)"


def _rounds(source: str, column: str) -> str:
    """Three rounds of preamble removal as chained CTEs r1..r3."""
    out = []
    prev = source
    for n in (1, 2, 3):
        removed = [
            f"nullif(nullif(regexp_replace(regexp_replace(t, {_q(_I + p)}, ''), '^\\s+', ''), ''), t)"
            for p in shorten.PREAMBLES
        ]
        src = f"trim(regexp_replace({column}, '\\s+', ' ', 'g')) AS t" if n == 1 else "t"
        inner = f"SELECT * EXCLUDE ({column}), {src} FROM {prev}" if n == 1 else f"SELECT * FROM {prev}"
        out.append(f"r{n} AS (SELECT * EXCLUDE (t), coalesce({', '.join(removed)}, t) AS t FROM ({inner}))")
        prev = f"r{n}"
    return ", ".join(out)


_MARK = "chr(1)"
_SENTENCES = rf"string_split(regexp_replace({{x}}, '([.!?])\s+', '\1' || {_MARK}, 'g'), {_MARK})"
_FILLER_HIT = " OR ".join(f"regexp_matches(s, {_q(_I + p)})" for p in shorten.FILLER)


def _prose(source: str, column: str) -> str:
    """CTEs ending in ``prose`` (column ``p``)."""
    return f"""{_rounds(source, column)},
sents AS (SELECT * EXCLUDE (t), list_filter({_SENTENCES.format(x='t')}, lambda s: {_strip('s')} <> '') AS ss FROM r3),
kept AS (SELECT *, list_filter(ss, lambda s: NOT ({_FILLER_HIT})) AS ks FROM sents),
prose AS (SELECT * EXCLUDE (ss, ks), trim(array_to_string(CASE WHEN len(ks) > 0 THEN ks ELSE ss[1:1] END, ' ')) AS p FROM kept)"""


def _truncate(x: str, limit: str) -> str:
    head = f"left({x}, {limit} + 1)"
    space = f"(length({head}) - instr(reverse({head}), ' '))"
    return (
        f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE rtrim(CASE WHEN contains({head}, ' ') "
        f"AND {space} > {limit} // 2 THEN left({head}, {space}) ELSE left({x}, {limit}) END, ' ,;:-') END"
    )


def _fit(source: str, x: str, limit: str) -> str:
    """CTEs ending in ``fitted`` (column ``f``): whole sentences within a limit."""
    return f"""
fs AS (SELECT *, {_strip(x)} AS t0, {_SENTENCES.format(x=_strip(x))} AS ss FROM {source}),
fk AS (SELECT *, coalesce(len(list_filter(generate_series(1, len(ss)),
    lambda k: length(array_to_string(ss[1:k], ' ')) <= {limit})), 0) AS k FROM fs),
fj AS (SELECT *, trim(array_to_string(ss[1:greatest(k, 1)], ' ')) AS j FROM fk),
fitted AS (SELECT * EXCLUDE (ss, k), CASE WHEN length(t0) <= {limit} THEN t0 ELSE {_truncate('j', limit)} END AS f FROM fj)"""


# ---- deletion on the document corpus --------------------------------------------------
# Whole comment lines go, the trailing comment goes with its blanks, nothing else.
_DELETED = f"""{_FOUND}, gone AS (SELECT path, line, behind FROM guarded WHERE protected IS NULL),
after_lines AS (
  SELECT l.path, l.n, CASE WHEN g.behind THEN rtrim(substr(l.l, 1, instr(l.l, '#') - 1)) ELSE l.l END AS l
  FROM lines l LEFT JOIN gone g ON g.path = l.path AND g.line = l.n WHERE g.line IS NULL OR g.behind),
cleaned AS (SELECT path, string_agg(l, chr(10) ORDER BY n) || chr(10) AS after FROM after_lines GROUP BY path)"""

# ---- events -------------------------------------------------------------------------------
_E0 = "length(concat('const u = \"http://e/', CAST(event_id AS STRING), '\"; '))"
_E1 = f"({_E0} + 3 + length(event_type) + 1)"
_E2 = f"({_E1} + length(concat('// user ', CAST(user_id AS STRING), ' sent this')) + 1)"
_EPATH = "concat('ev/', CAST(event_id AS STRING), '.js')"
_ET1 = "concat('// ', event_type)"
_ET2 = "concat('// user ', CAST(user_id AS STRING), ' sent this')"
_ET3 = "concat('/* Note that the batch is ', CAST(event_id AS STRING), '.', chr(10), '   Values stay as sent. */')"
_EVENT_COMMENTS = f"""ec AS (
  SELECT {_EPATH} AS path, 'c0000' AS comment_id, {_E0} AS start, 'line' AS kind, '//' AS open_tok, {_ET1} AS text,
    1 AS line, 1 AS end_line, {_E0} AS col, TRUE AS behind, event_id, event_type AS current FROM events
  UNION ALL SELECT {_EPATH}, 'c0001', {_E1}, 'line', '//', {_ET2}, 2, 2, 0, FALSE, event_id, substr({_ET2}, 4) FROM events
  UNION ALL SELECT {_EPATH}, 'c0002', {_E2}, 'block', '/*', {_ET3}, 3, 4, 0, FALSE, event_id,
    concat('Note that the batch is ', CAST(event_id AS STRING), '.|Values stay as sent.') FROM events)"""
_EVENT_TEXT = f"events_text AS ({C.EVENTS})"

# The review answers, restated over the event comments.
_REVIEW = f"""WITH {_EVENT_COMMENTS}, {_EVENT_TEXT},
q AS (
  SELECT ec.*, event_id AS n, (event_id + CAST(right(comment_id, 1) AS BIGINT)) % 6 AS which,
    CASE WHEN kind = 'block' THEN 74 ELSE 77 END AS max_chars FROM ec),
judged AS (
  SELECT *, CASE
      WHEN n % 5 = 0 THEN 'file_changed'
      WHEN n % 7 = 0 THEN 'comment_missing'
      WHEN which = 1 AND n % 3 = 0 THEN 'deletion_refused'
      -- An unchanged reply of two lines is over the one-line limit of a humanised block.
      WHEN which = 3 AND kind = 'line' THEN 'unchanged' END AS reason,
    CASE which WHEN 0 THEN 'kept short' WHEN 1 THEN '' WHEN 2 THEN 'marked' WHEN 3 THEN string_split(current, '|')[1]
      WHEN 4 THEN left(repeat('long words ', 40), max_chars * 2) END AS reply
  FROM q WHERE which <= 4),
accepted AS (
  SELECT path, comment_id, CASE WHEN which = 1 THEN 'delete' ELSE 'replace' END AS action,
    CASE WHEN which = 4 THEN regexp_replace(reply, ' [^ ]*$', '') ELSE reply END AS lines,
    CASE which WHEN 2 THEN 'delimiter_removed,lines_dropped' WHEN 3 THEN 'lines_dropped' WHEN 4 THEN 'line_cut' ELSE '' END AS warnings,
    event_id FROM judged WHERE reason IS NULL)"""

_RUN_TEXTS = f"""first_run AS ({C.DOCUMENTS}), second_run AS ({C.BASE}), current_files AS ({C.CURRENT})"""


def _restored(run: str) -> str:
    return f"""WITH {_RUN_TEXTS}
SELECT coalesce(r.path, c.path) AS path, sha1(coalesce(r.text, c.text)) AS sha1, r.path IS NOT NULL AS restored
FROM current_files c FULL JOIN {run} r ON r.path = c.path"""


# ---- suppliers ------------------------------------------------------------------------------
_SUP = f"""sup AS (
  SELECT concat('sup/', CAST(s_suppkey AS STRING), '.ts') AS path, s_name,
    concat('/**', chr(10), ' * This function returns the supplier ', s_name, '. Note that it is slow.', chr(10),
      ' * @param key - The key', chr(10), ' * @param account - balance in cents of ', s_name, chr(10),
      ' * @returns The row', chr(10), ' */') AS doc,
    concat('function supplier(key, account) ', chr(123), chr(10)) AS open_line FROM supplier),
sc AS (
  SELECT path, 'c0000' AS comment_id, 0 AS start, 'block' AS kind, TRUE AS doc, '/**' AS open_tok, doc AS text, s_name FROM sup
  UNION ALL SELECT path, 'c0001', length(doc) + 1 + length(open_line) + 2, 'line', FALSE, '//', '// Return the key', s_name FROM sup
  UNION ALL SELECT path, 'c0002', length(doc) + 1 + length(open_line) + 2 + 17 + 1 + length('  return key; '), 'line', FALSE, '//', '// as is', s_name FROM sup)"""
_SUP_CODE = "concat('function supplier(key, account) ', chr(123), chr(10), '{note}  return key;{tail}', chr(10), chr(125), chr(10))"

_PART_BODY = "concat('SELECT ', CAST(p_partkey AS STRING), ' AS k;', chr(10), 'SELECT ', chr(39), 'a -- no', chr(39), ' AS s;', chr(10))"
_PART_PATH = "concat('part/', CAST(p_partkey AS STRING), '.sql')"

_PAGE_PARTS = """pp AS (
  SELECT concat('page_', CAST(page_id AS STRING), '.html') AS path, html,
    string_split_regex(html, '<!--[^>]*-->') AS gaps, regexp_extract_all(html, '<!--[^>]*-->') AS cs FROM pages)"""
_PAGE_CUTS = """cuts AS (
  SELECT concat('page_', CAST(page_id AS STRING), '.html') AS path, html, 0 AS a0,
    instr(html, '<style>') + 6 AS a1, instr(html, '</style>') - 1 AS a2,
    instr(html, '<script>') + 7 AS a3, instr(html, '</script>') - 1 AS a4, length(html) AS a5 FROM pages)"""

_REDUCED = f"""{_RATED.replace("WITH", "WITH RECURSIVE", 1)}, {_BANNER_RUNS},
open_ AS (
  SELECT r.*, f.line IS NOT NULL OR {_strip('r.inner_')} = '' OR regexp_matches(r.inner_, {_q(shorten.BANNER_ONLY)})
    OR r.restated >= 0.7 AS dropped
  FROM rated r LEFT JOIN framed f ON f.path = r.path AND f.line = r.line WHERE r.protected IS NULL),
alive AS (SELECT * FROM open_ WHERE NOT dropped), {_copies('alive')},
body AS (
  SELECT a.path, a.line, a.inner_, a.inner_ AS src FROM alive a LEFT JOIN copies c ON c.path = a.path AND c.line = a.line WHERE c.line IS NULL),
{_prose('body', 'src')}, {_fit('prose', 'p', '78')},
acts AS (
  SELECT path, line, CAST(NULL AS VARCHAR) AS put FROM open_ WHERE dropped UNION ALL SELECT path, line, CAST(NULL AS VARCHAR) FROM copies
  UNION ALL SELECT path, line, CASE WHEN f = '' THEN NULL ELSE concat('# ', f) END FROM fitted WHERE f <> inner_),
rebuilt AS (
  SELECT l.path, l.n, CASE WHEN a.line IS NULL THEN l.l WHEN starts_with(l.l, '#') THEN a.put
    WHEN a.put IS NULL THEN rtrim(substr(l.l, 1, instr(l.l, '#') - 1)) ELSE concat(substr(l.l, 1, instr(l.l, '#') - 1), a.put) END AS l
  FROM lines l LEFT JOIN acts a ON a.path = l.path AND a.line = l.n)"""

# Parts: the own-line name, the trailing type and the brand block, as ``guarded`` rows.
_PART_ROWS = f"""base AS (SELECT *, {_PART_PATH} AS path, length(concat('-- ', p_name)) + 1 + length(concat('SELECT ', CAST(p_partkey AS STRING), ' AS k; ')) AS s2 FROM part),
guarded AS (
  SELECT path, 0 AS start, p_name AS inner_, FALSE AS behind, '' AS head, NULL AS protected,
    concat('SELECT ', CAST(p_partkey AS STRING), ' AS k; -- ', p_type, chr(10), 'SELECT ', chr(39), 'a -- no', chr(39), ' AS s;') AS code_after FROM base
  UNION ALL SELECT path, s2, p_type, TRUE, concat('SELECT ', CAST(p_partkey AS STRING), ' AS k;'), NULL, '' FROM base
  UNION ALL SELECT path, s2 + length(p_type) + 4 + 23, p_brand, FALSE, '', NULL, '' FROM base)"""

ORACLES: dict[str, str] = {
    "style_score_sql": f"""WITH {_PART_ROWS}, {_STYLE} SELECT path, start AS "start", round(ai_score, 4) AS ai_score FROM rated""",
    "style_tags": f"""WITH {_SUP} SELECT path, start AS "start", CAST(CASE comment_id WHEN 'c0000' THEN 1 WHEN 'c0001' THEN 0.75 ELSE 0 END AS DOUBLE) AS ai_score,
  CASE comment_id WHEN 'c0000' THEN 'opener_this,near_code:56,empty_tags:2,lines:6' WHEN 'c0001' THEN 'action_restated,restates_code:100' ELSE '' END AS reasons FROM sc""",
    "delete_flagged": f"""{_RATED}, gone AS (SELECT path, line FROM rated WHERE {_FLAG}),
kept_lines AS (SELECT l.path, l.n, CASE WHEN g.line IS NULL THEN l.l ELSE rtrim(substr(l.l, 1, instr(l.l, '#') - 1)) END AS l
  FROM lines l LEFT JOIN gone g ON g.path = l.path AND g.line = l.n WHERE g.line IS NULL OR NOT starts_with(l.l, '#'))
SELECT path, string_agg(l, chr(10) ORDER BY n) || chr(10) AS after FROM kept_lines GROUP BY path""",
    "reduce_documents": f"""{_REDUCED} SELECT path, string_agg(l, chr(10) ORDER BY n) || chr(10) AS after FROM rebuilt WHERE l IS NOT NULL GROUP BY path""",
    "select_files": f"{_SELECTION} SELECT path, size, lang FROM ruled WHERE {_KEPT}",
    "select_visible_files": f"{_SELECTION} SELECT path, lang FROM ruled WHERE {_KEPT} AND NOT contains(path, '/.cache/')",
    "skipped_files": f"""{_SELECTION} SELECT path, size, CASE WHEN in_dir THEN 'excluded_dir' WHEN generated THEN 'generated'
  WHEN lang IS NULL THEN 'unknown_language' ELSE 'too_large' END AS why FROM ruled WHERE NOT coalesce({_KEPT}, FALSE)""",
    "language_of_file": f"{_SELECTION} SELECT DISTINCT path, lang FROM known",
    "requested_files": f"""WITH d AS ({C.DOCUMENTS}), {_REQUESTS}
SELECT path FROM d WHERE starts_with(path, 'src2/') OR path IN (SELECT path FROM requests)""",
    "missing_requests": f"WITH {_REQUESTS} SELECT path FROM requests WHERE starts_with(path, 'gone/')",
    "changed_since_snapshot": f"""WITH cur AS ({C.CURRENT}), base AS ({C.BASE})
SELECT cur.path, CASE WHEN base.path IS NULL THEN 'added' ELSE 'modified' END AS status, sha1(cur.text) AS file_sha1
FROM cur LEFT JOIN base USING (path) WHERE base.path IS NULL OR base.text <> cur.text""",
    "changed_files_text": f"""WITH cur AS ({C.CURRENT}), base AS ({C.BASE})
SELECT cur.path, length(cur.text) AS n_chars FROM cur LEFT JOIN base USING (path) WHERE base.path IS NULL OR base.text <> cur.text""",
    "page_regions": f"""WITH {_PAGE_CUTS}, r AS (
  SELECT path, html, 0 AS region_no, a0 AS s, a1 AS e, 'html' AS sublang FROM cuts UNION ALL SELECT path, html, 1, a1, a2, 'css' FROM cuts
  UNION ALL SELECT path, html, 2, a2, a3, 'html' FROM cuts UNION ALL SELECT path, html, 3, a3, a4, 'javascript' FROM cuts
  UNION ALL SELECT path, html, 4, a4, a5, 'html' FROM cuts)
SELECT path, region_no, s AS "start", e AS "end", sublang, substr(html, s + 1, e - s) AS body FROM r""",
    "page_comments": f"""WITH {_PAGE_PARTS}, ix AS (SELECT *, unnest(generate_series(1, len(cs))) AS k FROM pp),
o AS (SELECT path, cs[k] AS text, k, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) +
    coalesce(list_sum(list_transform(cs[1:k - 1], lambda c: length(c))), 0) AS BIGINT) AS s FROM ix)
SELECT path, concat('c', lpad(CAST(k - 1 AS STRING), 4, '0')) AS comment_id, s AS "start", s + length(text) AS "end", 'block' AS kind, text FROM o""",
    "page_comment_counts": f"WITH {_PAGE_PARTS} SELECT path, len(cs) AS comments FROM pp WHERE len(cs) > 0",
    "sql_comments": f"""WITH p AS (SELECT *, {_PART_PATH} AS path FROM part), b AS (SELECT *,
    length(concat('-- ', p_name)) + 1 + length(concat('SELECT ', CAST(p_partkey AS STRING), ' AS k; ')) AS s2 FROM p)
SELECT path, 'c0000' AS comment_id, 0 AS "start", 'line' AS kind, FALSE AS doc, '--' AS open_tok, concat('-- ', p_name) AS text FROM b
UNION ALL SELECT path, 'c0001', s2, 'line', FALSE, '--', concat('-- ', p_type) FROM b
UNION ALL SELECT path, 'c0002', s2 + length(p_type) + 4 + 23, 'block', FALSE, '/*', concat('/* ', p_brand, ' */') FROM b""",
    "js_comments": f"""WITH {_EVENT_COMMENTS} SELECT path, comment_id, start AS "start", kind, FALSE AS doc, open_tok, text FROM ec""",
    "stream_comments": f"""WITH {_EVENT_COMMENTS} SELECT path, comment_id, start AS "start", kind, text FROM ec""",
    "py_comments": f"""{_FOUND} SELECT path, concat('c', lpad(CAST(k AS STRING), 4, '0')) AS comment_id, start AS "start",
  'line' AS kind, FALSE AS doc, '#' AS open_tok, text FROM found""",
    "ts_comments": f"""WITH {_SUP} SELECT path, comment_id, start AS "start", kind, doc, open_tok, text FROM sc""",
    "tree_files": f"""WITH c AS ({C.TREE}) SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha1(text) AS file_sha1 FROM c""",
    "tree_skipped": f"""WITH c AS ({C.TREE}) SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size,
  CASE WHEN starts_with(path, '.github/') THEN 'hidden_dir' WHEN starts_with(path, 'node_modules/') THEN 'excluded_dir'
    WHEN ends_with(path, '.min.js') THEN 'generated' ELSE 'unknown_language' END AS why
FROM c WHERE starts_with(path, '.github/') OR starts_with(path, 'node_modules/') OR ends_with(path, '.min.js') OR ends_with(path, '.bin')""",
    "verify_proved": f"""WITH c AS ({C.NESTED_TEMPLATES})
SELECT path, sha1(concat(replace(regexp_replace(text, ' /[*] deep [0-9]+ [*]/', ''), regexp_extract(text, '; // [^`]*$'), ';'), chr(10))) AS after_sha1,
  TRUE AS reversible, TRUE AS confirmed FROM c""",
    "undo_log": f"""WITH c AS ({C.NESTED_TEMPLATES}), t AS (SELECT *, substr(regexp_extract(rtrim(text, chr(10)), '; // [^`]*$'), 2) AS tail FROM c)
SELECT path, instr(text, ' /* deep') - 1 AS "at", regexp_extract(text, ' /[*] deep [0-9]+ [*]/') AS removed, '' AS repl FROM t
UNION ALL SELECT path, length(text) - 1 - length(tail), tail, '' FROM t""",
    "published_runs": f"""WITH p AS ({C.PARTS}), b AS (SELECT {_PART_PATH} AS path, {_PART_BODY} AS body FROM part)
SELECT CAST(1 AS BIGINT) AS number, '20240101-000000' AS run_id, count(*) AS files, CAST(sum(length(body)) AS BIGINT) AS characters FROM b
UNION ALL SELECT 2, '20240102-000000', count(*), CAST(sum(length(body)) AS BIGINT) FROM b JOIN p USING (path) WHERE length(text) % 2 = 1""",
    "published_files": f"""WITH p AS ({C.PARTS}), b AS (SELECT {_PART_PATH} AS path, {_PART_BODY} AS body FROM part)
SELECT '20240101-000000' AS run_id, path, sha1(body) AS sha1 FROM b
UNION ALL SELECT '20240102-000000', path, sha1(body) FROM b JOIN p USING (path) WHERE length(text) % 2 = 1""",
    "restore_published": f"""WITH p AS ({C.PARTS}), b AS (SELECT {_PART_PATH} AS path, {_PART_BODY} AS body FROM part)
SELECT path, sha1(CASE WHEN length(text) % 2 = 1 THEN text ELSE body END) AS sha1, length(text) % 2 = 1 AS restored FROM b JOIN p USING (path)""",
    "nested_block_comments": f"""WITH c AS ({C.NESTED_BLOCKS})
SELECT path, 'c0000' AS comment_id, 11 AS "start", 'block' AS kind, FALSE AS doc, '/*' AS open_tok,
  substr(text, 12, instr(text, ' let b') - 12) AS text FROM c
UNION ALL SELECT path, 'c0001', length(text) - 7, 'line', FALSE, '//', '// end' FROM c""",
    "js_template_comments": f"""WITH c AS ({C.NESTED_TEMPLATES})
SELECT path, 'c0000' AS comment_id, instr(text, '/* deep') - 1 AS "start", 'block' AS kind, FALSE AS doc, '/*' AS open_tok,
  regexp_extract(text, '/[*] deep [0-9]+ [*]/') AS text FROM c
UNION ALL SELECT path, 'c0001', instr(text, '; //') + 1, 'line', FALSE, '//', rtrim(substr(text, instr(text, '; //') + 2), chr(10)) FROM c""",
    "rule_cases": _rule_cases(),
    "comment_positions": f"""WITH {_EVENT_COMMENTS} SELECT path, start AS "start", start + length(text) AS "end", line, end_line, col,
  '' AS indent, NOT behind AS own_line, behind AS "trailing" FROM ec""",
    "comment_context": f"""{_FOUND} SELECT path, start AS "start", code_before, code_after, {_strip('head')} AS code_same_line,
  inner_ AS "inner" FROM near""",
    "bare_doc_lines": f"""WITH {_SUP} SELECT path, start AS "start", CASE comment_id WHEN 'c0000' THEN concat(
    '|This function returns the supplier ', s_name, '. Note that it is slow.|@param key - The key|@param account - balance in cents of ',
    s_name, '|@returns The row|') WHEN 'c0001' THEN 'Return the key' ELSE 'as is' END AS lines,
  FALSE AS jsx_wrapped, FALSE AS sole_statement FROM sc""",
    "protected_by_reason": f"""{_FOUND} SELECT 'python' AS lang, coalesce(protected, 'none') AS protected, count(*) AS comments FROM guarded GROUP BY 2
UNION ALL SELECT 'python', NULL, count(*) FROM guarded UNION ALL SELECT NULL, NULL, count(*) FROM guarded""",
    "license_headers": f"{_FOUND} SELECT path, line, text FROM guarded WHERE protected = 'header'",
    "protection_details": f"""{_FOUND} SELECT path, line, protected, CASE protected
    WHEN 'directive' THEN {_strip(f"regexp_extract(text, {_q(protect.DIRECTIVE_PATTERN)})")}
    ELSE upper(coalesce(nullif(regexp_extract(text, {_q(protect.MARKER_PATTERN)}, 1), ''),
      regexp_extract(text, {_q(protect.ANY_CASE_PATTERN)}, 1))) END AS protected_by
FROM guarded WHERE protected IN ('directive', 'marker')""",
    "unprotected_when_off": f"{_FOUND} SELECT CAST(NULL AS STRING) AS protected, count(*) AS comments FROM near",
    "style_openers": f"""{_RATED}, hits AS (
  SELECT CASE opener {_OPENER_LABEL} END AS rule FROM rated UNION ALL SELECT CASE WHEN decorated THEN 'decoration' END FROM rated
  UNION ALL SELECT CASE WHEN {_strip('inner_')} = '' THEN NULL WHEN restated >= 0.6 THEN 'restates_code' WHEN restated >= 0.4 THEN 'near_code' END FROM rated
  UNION ALL SELECT CASE WHEN wordy THEN 'wordy' END FROM rated)
SELECT rule, count(*) AS comments FROM hits WHERE rule IS NOT NULL GROUP BY rule""",
    "style_restates": f"""{_RATED} SELECT path, start AS "start", round(restated, 6) AS restated FROM rated""",
    "style_score": f"""{_RATED} SELECT path, start AS "start", round(ai_score, 4) AS ai_score FROM rated""",
    "scan_totals": f"""{_RATED}, t AS (SELECT (SELECT count(*) FROM corpus) AS files, count(*) AS comments,
    count(*) FILTER (WHERE protected IS NOT NULL) AS protected, count(*) FILTER (WHERE {_FLAG}) AS flagged, 0 AS hidden_docs,
    count(*) AS comment_lines, (SELECT count(*) FROM lines) AS total_lines FROM rated)
SELECT *, round(comment_lines * CAST(100 AS DOUBLE) / greatest(1, total_lines), 4) AS comment_share FROM t""",
    "scan_files": f"{_COUNTS} SELECT * FROM counts",
    "first_files": f"{_COUNTS} SELECT * FROM counts ORDER BY path LIMIT 40",
    "flagged_top": f"""{_RATED} SELECT path, line, round(ai_score, 2) AS score, left(inner_, 100) AS text FROM rated
WHERE {_FLAG} ORDER BY path, start LIMIT 200""",
    "flagged_all": f"{_RATED} SELECT path, start AS \"start\", line, round(ai_score, 2) AS score, inner_ AS text FROM rated WHERE {_FLAG}",
    "report_json": f"""{_COUNTS} SELECT concat('{{"mode":"scan","path":"', path, '","changeable":', changeable, ',"flagged":', flagged,
  ',"protected":', protected, '}}') AS json FROM counts""",
    "clean_prose": f"WITH d AS (SELECT doc_id, text FROM documents), {_prose('d', 'text')} SELECT doc_id, p AS prose FROM prose",
    "fit_budget": f"WITH d AS (SELECT doc_id, text FROM documents), {_fit('d', 'text', '80')} SELECT doc_id, f AS fitted FROM fitted",
    "truncate_text": f"SELECT doc_id, {_truncate(_strip('text'), '60')} AS cut FROM documents",
    "banner_groups": f"{_FOUND}, {_BANNER_RUNS} SELECT path, line FROM framed",
    "dedupe_nearby": f"""{_FOUND.replace("WITH", "WITH RECURSIVE", 1)}, free AS (SELECT * FROM guarded WHERE protected IS NULL),
{_copies('free')} SELECT path, line FROM copies""",
    "strip_comments": f"""SELECT {_EPATH} AS path, concat('const u = "http://e/', CAST(event_id AS STRING), '"; ', chr(10), chr(10), chr(10),
  'send(u, ', chr(39), event_type, chr(39), ');', chr(10)) AS code FROM events""",
    "canonical_code": f"""SELECT {C._DOC_PATH} AS path, concat('doc_', CAST(doc_id AS STRING), ' = ', CAST(n_chars AS STRING),
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'aa = 0', chr(10), 'bb = 1', chr(10), 'cc = 2') ELSE '' END) AS code FROM documents""",
    "canonical_pages": r"""WITH s AS (SELECT concat('page_', CAST(page_id AS STRING), '.html') AS path,
    string_split(regexp_replace(html, '<!--[^>]*-->', '', 'g'), chr(10)) AS ls FROM pages)
SELECT path, array_to_string(list_filter(list_transform(ls, lambda l: regexp_replace(l, '\s+$', '')), lambda l: l <> ''), chr(10)) AS code FROM s""",
    "delete_comments": f"{_DELETED} SELECT path, after FROM cleaned",
    "delete_sql_comments": f"SELECT {_PART_PATH} AS path, {_PART_BODY} AS after FROM part",
    "delete_page_comments": r"""SELECT concat('page_', CAST(page_id AS STRING), '.html') AS path,
  regexp_replace(html, '[ \t]*<!--[^>]*-->', '', 'g') AS after FROM pages""",
    "reduce_comments": f"""SELECT {_EPATH} AS path, concat('const u = "http://e/', CAST(event_id AS STRING), '"; // ', event_type, chr(10),
  '// user ', CAST(user_id AS STRING), ' sent this', chr(10), '/* Values stay as sent. */', chr(10),
  'send(u, ', chr(39), event_type, chr(39), ');', chr(10)) AS after FROM events""",
    "edit_log": f"""WITH {_EVENT_COMMENTS} SELECT path, comment_id, start AS "start", start + length(text) AS "end", 'replace' AS action,
  'Values stay as sent.' AS lines, 'shortened' AS reason FROM ec WHERE kind = 'block'""",
    "shrink_docs": f"""WITH {_SUP} SELECT path, concat('/**', chr(10), ' * returns the supplier ', s_name, '.', chr(10),
  ' * @param account - balance in cents of ', s_name, chr(10), ' */', chr(10),
  {_SUP_CODE.format(note="", tail=" // as is")}) AS after FROM sup""",
    "delete_docs": f"WITH {_SUP} SELECT path, {_SUP_CODE.format(note='', tail='')} AS after FROM sup",
    "verify_unchanged": f"""SELECT {C._DOC_PATH} AS path, TRUE AS ok, CAST(NULL AS STRING) AS first_difference FROM documents""",
    "verify_tampered": f"""SELECT {_PART_PATH} AS path, FALSE AS ok, concat('code line 2: SELECT ', chr(39), 'a -- no', chr(39), ' AS s; -> SELECT ',
  chr(39), 'a -- no', chr(39), ' AS t;') AS first_difference FROM part""",
    "change_summary": f"""{_DELETED} SELECT path, count(*) FILTER (WHERE protected IS NULL) AS deleted, 0 AS shortened,
  count(*) FILTER (WHERE protected IS NOT NULL) AS protected, count(*) FILTER (WHERE protected IS NULL AND NOT behind) AS lines_saved
FROM guarded GROUP BY path HAVING count(*) FILTER (WHERE protected IS NULL) > 0""",
    "change_totals": f"""{_DELETED} SELECT count(DISTINCT path) AS files, count(*) AS comments, count(*) FILTER (WHERE NOT behind) AS lines_saved
FROM guarded WHERE protected IS NULL""",
    "review_queue": f"""WITH {_EVENT_COMMENTS}, {_EVENT_TEXT} SELECT concat(ec.path, '#', comment_id) AS id, ec.path AS file, kind,
  FALSE AS is_api_doc, TRUE AS deletable, concat(line, '-', end_line) AS lines, sha1(ec.text) AS raw_sha1,
  sha1(t.text) AS file_sha1, 1 AS max_lines, CASE WHEN kind = 'block' THEN 74 ELSE 77 END AS max_chars, current,
  concat(start, '-', start + length(ec.text)) AS span FROM ec JOIN events_text t ON t.path = ec.path""",
    "review_edits": f"{_REVIEW} SELECT path, comment_id, action, lines, warnings FROM accepted",
    "review_rejects": f"{_REVIEW} SELECT path, comment_id, reason FROM judged WHERE reason IS NOT NULL",
    "review_apply": f"""{_REVIEW}, a AS (
  SELECT e.*, a0.action AS x0, a0.lines AS l0, a1.action AS x1, a1.lines AS l1, a2.action AS x2, a2.lines AS l2
  FROM (SELECT *, {_EPATH} AS path FROM events) e
  LEFT JOIN accepted a0 ON a0.path = e.path AND a0.comment_id = 'c0000'
  LEFT JOIN accepted a1 ON a1.path = e.path AND a1.comment_id = 'c0001'
  LEFT JOIN accepted a2 ON a2.path = e.path AND a2.comment_id = 'c0002'
  WHERE coalesce(a0.action, a1.action, a2.action) IS NOT NULL)
SELECT path, concat('const u = "http://e/', CAST(event_id AS STRING), '";',
  CASE WHEN x0 = 'delete' THEN '' WHEN x0 = 'replace' THEN concat(' // ', l0) ELSE concat(' ', {_ET1}) END, chr(10),
  CASE WHEN x1 = 'delete' THEN '' WHEN x1 = 'replace' THEN concat('// ', l1, chr(10)) ELSE concat({_ET2}, chr(10)) END,
  CASE WHEN x2 = 'delete' THEN '' WHEN x2 = 'replace' THEN concat('/* ', l2, ' */', chr(10)) ELSE concat({_ET3}, chr(10)) END,
  'send(u, ', chr(39), event_type, chr(39), ');', chr(10)) AS after, TRUE AS ok FROM a""",
    "list_snapshots": f"""WITH {_RUN_TEXTS} SELECT '20240102-000000' AS run_id, count(*) AS files FROM second_run
UNION ALL SELECT '20240101-000000', count(*) FROM first_run""",
    "restore_latest": _restored("second_run"),
    "restore_named": _restored("first_run"),
    "rollback_selected": f"""WITH p AS ({C.PARTS}), c AS (SELECT {_PART_PATH} AS path, {_PART_BODY} AS after FROM part)
SELECT p.path, CASE WHEN length(p.text) % 3 = 0 THEN p.text ELSE c.after END AS text, length(p.text) % 3 = 0 AS rolled_back
FROM p JOIN c ON c.path = p.path""",
}
