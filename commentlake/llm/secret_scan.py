"""Secret scan with corpus-wide ownership frequency.

Spans come from the text alone; what they are worth comes from the corpus. Every
candidate value is hashed, and its hash is counted over distinct repositories and
distinct owners. A value that many owners hold in many repositories is an example
that was copied around; any other that looks random is taken for live.
Values themselves leave their document as hashes only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlake.llm.common import staged

#: Base kinds in their order: pattern, group with the value, its least length.
KINDS = (
    ("assign", re.compile(
        r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: A line break as it is or escaped, as in a JSON string; one or more of them.
_BREAK = r"[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*+"
_BREAKS = rf"(?:{_BREAK})++"
_END_OF_LINE = r"""(?=[ \t]*(?:[\r\n"',]|\\[nr]|\Z))"""
#: A private key from its first line to its last. Where the last is missing, to the last line of
#: base64; behind an empty line only a long line is taken for that.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?P<whole>(?:[^-]++|-(?!----(?:BEGIN|END) ))*+)-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?P<cut>(?:{_BREAKS}(?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+{_BREAKS})++[A-Za-z0-9+/]++={{0,2}}+{_END_OF_LINE}"
    rf"|{_BREAK}[A-Za-z0-9+/]++={{0,2}}+{_END_OF_LINE}|{_BREAKS}[A-Za-z0-9+/]{{16,}}+={{0,2}}+{_END_OF_LINE})*+))"
)
_WHITE = re.compile(r"\s|\\[nrt]")
#: Further credentials of public, self-describing formats.
MORE_KINDS = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    # From the first eyJ of a run of letters: where that fails no later one of the run can match.
    ("jwt", re.compile(
        r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)"), 1, 40),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 20),
    ("pem", re.compile(PEM), 0, 27),
)
BASE = tuple(k[0] for k in KINDS)
#: What the corpus says about a value, appended as a span over the value.
LIVE, EXAMPLE = "live", "example"
#: Held by so many owners and in so many repositories, a value is an example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 3
#: Bits a character below which a value does not look random.
LEAST_ENTROPY = 2.5

FOUND = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("value_start", T.IntegerType()),
    T.StructField("value_end", T.IntegerType()), T.StructField("value", T.LongType()),
    T.StructField("random", T.BooleanType()),
]))


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _secret(kind: str, m: re.Match, group: int) -> str:
    """What is hashed of a match: of a private key its body without white space, or else the value."""
    if kind == "pem":
        body = _WHITE.sub("", m["whole"] or m["cut"] or "")
        if body:
            return body
    return m.group(group)


def candidates(text: str | None) -> list[tuple]:
    """All matches in one text, by start and then kind; ends are exclusive code points."""
    if not text:
        return []
    out = []
    low = text.lower()
    maybe = (":" in text or "=" in text) and any(w in low for w in ("passw", "secret", "token", "api"))
    for order, (kind, pattern, group, least) in enumerate((*KINDS, *MORE_KINDS)):
        if kind == "assign" and not maybe:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                value = _secret(kind, m, group)
                out.append((a if kind == "jwt" else m.start(), order, kind, m.end(), a, b,
                            xxhash.xxh64_intdigest(value.encode()) - 2**63, entropy(value) >= LEAST_ENTROPY))
    out.sort()
    return [(kind, s, e, a, b, h, r) for s, _, kind, e, a, b, h, r in out]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()),
        ("value_end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_()),
    ])
    names = [kind.field(i).name for i in range(kind.num_fields)]
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = [
            [dict(zip(names, c, strict=True)) for c in candidates(t.as_py())] for t in batch.column(at)
        ]
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        kept = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(kind))], [*kept, "found"])


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: Column | None = None,
         carried: Column | None = None) -> DataFrame:
    """(row, carried, owner, repository, found): the candidates of every row's whole text, stored.

    A null or empty text has none. A null owner or repository counts as one of
    its own name, the empty one. Rows are numbered as they are written, to find
    back together whatever ids they carry or repeat.
    """
    rows = docs.select(
        (F.lit(None).cast("int") if carried is None else carried).alias("carried"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce((F.col(owner) if repository is None else repository).cast("string"), F.lit("")).alias("repository"),
        F.col(text).cast("string").alias("text"),
    )
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("found", FOUND)
    found = rows.mapInArrow(_scan_batches, schema)
    return staged(found.select(F.monotonically_increasing_id().alias("row"), "*"), "secrets")


def ownership(scanned: DataFrame, copied_owners: int = COPIED_OWNERS,
              copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(value, owners, repositories, verdict) of every candidate value of the corpus.

    Distinct (value, owner, repository) come first, so a value that a third of all
    rows hold reaches no task more than once per place; the distinct counts over those
    are partial sums again.
    """
    places = scanned.select(F.explode("found").alias("c"), "owner", "repository").select(
        F.col("c.value").alias("value"), F.col("c.random").alias("random"), "owner", "repository"
    ).distinct()
    counts = places.groupBy("value", "random").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )
    copied = (F.col("owners") >= copied_owners) & (F.col("repositories") >= copied_repositories)
    verdict = F.when(copied, F.lit(EXAMPLE)).when(F.col("random"), F.lit(LIVE))
    return counts.select("value", "owners", "repositories", verdict.alias("verdict"))


def judged(scanned: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``carried`` with ``spans``: candidates in order, each with its verdict."""
    rows = scanned.select("row", "carried", "found")
    verdicts = ownership(scanned, copied_owners).select("value", "verdict")
    told = rows.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "c")).select(
        "row", "at", "c", F.col("c.value").alias("value")
    ).join(verdicts, "value", "left")
    lists = told.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "c", "verdict"))).alias("spans")
    )
    none = F.array().cast(lists.schema["spans"].dataType)
    return rows.join(lists, "row", "left").select("carried", F.coalesce("spans", none).alias("spans"))


def span(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


def listed(spans: Column, base_only: bool) -> Column:
    """kind:start:end by start and then kind, comma-joined; verdicts follow their candidate."""
    base = lambda x: x["c"]["kind"].isin(*BASE)
    if base_only:
        return F.array_join(
            F.transform(F.filter(spans, base), lambda x: span(x["c"]["kind"], x["c"]["start"], x["c"]["end"])), ","
        )
    # Kinds in the order they are listed, verdicts last.
    order = F.lit(",".join((*BASE, *(k[0] for k in MORE_KINDS), LIVE, EXAMPLE)))
    entry = lambda kind, start, end: F.struct(
        start.alias("start"), F.find_in_set(kind, order).alias("order"), end.alias("end"), span(kind, start, end).alias("s")
    )
    own = F.transform(spans, lambda x: entry(x["c"]["kind"], x["c"]["start"], x["c"]["end"]))
    said = F.transform(
        F.filter(spans, lambda x: x["verdict"].isNotNull()),
        lambda x: entry(x["verdict"], x["c"]["value_start"], x["c"]["value_end"]),
    )
    everything = F.array_sort(F.array_distinct(F.concat(own, said)))
    return F.array_join(F.transform(everything, lambda x: x["s"]), ",")


def masked(text: str, spans: list[tuple[int, int]], mask: str = "[secret]") -> str:
    """The text with its spans (code points, end exclusive) masked; overlapping ones are one."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += (text[at:a], mask)
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = (batch.column(c).to_pylist() for c in ("text", "spans"))
        new = [masked(t, [(x["a"], x["b"]) for x in s]) if s else t for t, s in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(new, pa.string())], ["carried", "new"])


def redact(docs: DataFrame, text: str = "text", owner: str = "source", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with live secrets masked; ``length`` is set anew where the text changed.

    Rows without a candidate pass beside the joins: only those with one move.
    """
    columns = docs.columns
    scanned = scan(docs, text, owner, carried=F.struct("*"))
    clean = scanned.where(F.size("found") == 0).select("carried.*")
    spoken = scanned.where(F.size("found") > 0).select("row", "carried", "found")
    verdicts = ownership(scanned).select("value", "verdict")
    spans = spoken.select("row", F.explode("found").alias("c")).select(
        "row", F.struct(F.col("c.value_start").alias("a"), F.col("c.value_end").alias("b")).alias("span"), F.col("c.value").alias("value")
    ).join(verdicts, "value", "left").groupBy("row").agg(
        F.collect_list(F.when(F.coalesce("verdict", F.lit("")) != EXAMPLE, F.col("span"))).alias("spans")
    )
    both = spoken.join(spans, "row").select("carried", F.col(f"carried.`{text}`").cast("string").alias("text"), "spans")
    both = both.mapInArrow(_mask_batches, T.StructType([both.schema["carried"]]).add("new", T.StringType()))
    out = []
    for name in columns:
        old = F.col(f"carried.`{name}`")
        if name == text:
            out.append(F.col("new").alias(name))
        elif name == length:
            out.append(F.when(F.col("new") != F.col(f"carried.`{text}`"), F.length("new").cast(docs.schema[name].dataType))
                       .otherwise(old).alias(name))
        else:
            out.append(old.alias(name))
    return clean.unionByName(both.select(*out))
