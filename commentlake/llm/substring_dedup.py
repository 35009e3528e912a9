"""Removal of repeated passages, by FM-indexes over shards of shared text.

A window of words that two documents share has the same smallest word n-gram in
both, so documents are cut to the surroundings of such anchors that occur in more
than one text. Surroundings with one anchor meet in one shard. There an FM-index
is built over them, and each is streamed through it: backward search gives its
matching statistics, and every window that begins in a smaller document is
reported as an interval. Copies of a whole text are one text until the end.
The surroundings of one anchor stay together, so anchors of very many places take
an exact way without a shard: a partial minimum over their hashed windows. Words
are numbered by hash and compared within a shard; texts, segments and windows that
meet across tasks are known by 128 bits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlake.llm.common import mix, same_words, staged, word_bounds, word_hashes
from commentlake.llm.fm_index import FMIndex

WINDOW, GRAM = 50, 8
#: Words of one index at most; an anchor with more is worked off in pairs of such blocks.
SHARD_WORDS = 1_200_000
#: An anchor that occurs more often than this, a dozen blocks' worth, is not gathered: its windows are grouped one by one.
HOT_PLACES = 100_000
#: Segments streamed through an index at a time.
STREAM = 8192
_WORDS = re.compile(r"[^ \t-\r]+").findall
_STEP, _STEP_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    pick, now, have = (np.minimum if least else np.maximum), values, 1
    while 2 * have <= width:
        now, have = pick(now[:-have], now[have:]), 2 * have
    rest = width - have
    return pick(now[: len(now) - rest], now[rest:]) if rest else now


def anchors(text: str | None, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the grams that are smallest in some window of the text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    start, end = word_bounds(data)
    n = len(start)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    h = word_hashes(data, start, end)
    g = np.zeros(n - gram + 1, dtype=np.uint64)
    for j in range(gram):
        g = g * _STEP + h[j : n - gram + 1 + j]
    g = mix(g)
    width = window - gram + 1
    least = _sliding(g, width, least=True)
    around = np.zeros(len(g) + width - 1, dtype=np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    # A gram is an anchor if the greatest of the minima over its windows is the gram itself.
    at = np.flatnonzero(_sliding(around, width, least=False) == g)
    return g[at].view(np.int64), at.astype(np.int32)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int32())),
        ], ["doc_id", "body", "hashes", "places"])


def _segments(text: str, places: list[int]) -> Iterator[tuple[str, int]]:
    """(words around an anchor, place of the first) for each anchor."""
    words = _WORDS(text)
    for p in places:
        a = max(0, p - (WINDOW - GRAM))
        yield " ".join(words[a : p + WINDOW]), a


def _keys(segment: str) -> tuple[int, int]:
    raw = segment.encode()
    return xxhash.xxh64_intdigest(raw, 1) - 2**63, xxhash.xxh64_intdigest(raw, 2) - 2**63


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, segment, doc_id) once per document."""
    for batch in batches:
        for doc, text, hashes, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = dict.fromkeys(zip(hashes, (s for s, _ in _segments(text, places)), strict=True))
            if own:
                shard, segment = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), pa.array(segment), pa.array([doc] * len(own), pa.int64())],
                    ["anchor", "segment", "doc"],
                )


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, body, first): where each segment lies in its text."""
    for batch in batches:
        for body, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [(*_keys(s), body, a) for s, a in _segments(text, places)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)],
                    ["k1", "k2", "body", "first"],
                )


def _windows(text: str, hot: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, other hashes) of the windows that hold the anchors at ``hot``."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    h, other = word_hashes(data, *word_bounds(data)), word_hashes(data, *word_bounds(data), seed=1)
    around = (np.array(hot, dtype=np.int64)[:, None] - np.arange(WINDOW - GRAM + 1)).ravel()
    at = np.unique(around[(around >= 0) & (around <= len(h) - WINDOW)])
    w1, w2 = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for j in range(WINDOW):
        w1, w2 = mix(w1 * _STEP + h[at + j]), mix(w2 * _STEP_2 + other[at + j])
    return at, w1.view(np.int64), w2.view(np.int64)


WINDOWS = "w1 long, w2 long, body binary, first int, own long"


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body, own, text, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, w1, w2 = _windows(text, hot)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1), pa.array(w2), pa.array([body] * len(at), pa.binary()), pa.array(at.astype(np.int32)),
                 pa.array(np.full(len(at), own))], ["w1", "w2", "body", "first", "own"],
            )


RUNS = "k1 long, k2 long, runs array<struct<at: int, n: int, doc: long>>"
_RUN = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("doc", pa.int64())]))


def _numbered(segments: list[str]) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    data = np.frombuffer("\n".join(segments).encode(), dtype=np.uint8)
    start, end = word_bounds(data)
    _, first, word = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    if same_words(data, start, end, first[word]):
        return word
    known: dict[str, int] = {}  # two words of one hash
    return np.array([known.setdefault(w, len(known)) for s in segments for w in s.split(" ")])


def _indexed(segments: list[str], docs: np.ndarray) -> np.ndarray:
    """Smallest document of every window of every segment, from one index over all of them."""
    sizes = np.array([s.count(" ") + 1 for s in segments])
    word = _numbered(segments) + 2  # 0 ends the text, 1 ends a segment
    owner_of_word = np.repeat(np.arange(len(segments)), sizes)
    place = np.arange(len(word)) + owner_of_word
    text = np.ones(len(word) + len(segments) + 1, dtype=np.int64)
    text[place] = word
    text[-1] = 0
    owner = np.full(len(text), np.iinfo(np.int64).max)
    owner[place] = docs[owner_of_word]
    index = FMIndex(text, owner, WINDOW, int(word.max()) + 1)
    first = np.cumsum(sizes) - sizes
    out = np.full((len(segments), 2 * WINDOW), np.iinfo(np.int64).max)
    for at in range(0, len(segments), STREAM):
        some = slice(at, at + STREAM)
        width = int(sizes[some].max())
        take = np.minimum(first[some, None] + np.arange(width)[None, :], len(word) - 1)
        found = index.statistics(word[take], sizes[some])
        out[some, : found.shape[1]] = found
    return out


def _runs(found: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Neighbouring windows with the same smallest document as (first, number, document)."""
    windows = found[: size - WINDOW + 1]
    cut = np.r_[0, np.flatnonzero(np.diff(windows)) + 1, len(windows)].tolist()
    return [(a, b - a, int(windows[a])) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (anchor, segment, doc, holders) in runs of whole anchors, or of parts of a large one."""
    held, words = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if words >= SHARD_WORDS // 2 and (row[0] != held[-1][0] or words >= SHARD_WORDS):
                yield held
                held, words = [], 0
            held.append(row)
            words += row[1].count(" ") + 1
    if held:
        yield held


def _search_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matching statistics within each shard; rows come sorted by anchor."""
    group: list[list[tuple]] = []

    def told(rows: list[tuple], found: np.ndarray) -> pa.RecordBatch:
        out = []
        for (_, segment, doc, holders), line in zip(rows, found, strict=True):
            runs = _runs(line, segment.count(" ") + 1)
            if holders > 1 or any(d < doc for _, _, d in runs):
                out.append((*_keys(segment), [dict(zip(("at", "n", "doc"), r, strict=True)) for r in runs]))
        k1, k2, runs = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(runs, _RUN)], ["k1", "k2", "runs"]
        )

    def searched(blocks: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        """One block as a rule; of several with one anchor every two meet once."""
        best = [None] * len(blocks)
        pairs = [(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks))] or [(0, 0)]
        for i, j in pairs:
            rows = blocks[i] if i == j else blocks[i] + blocks[j]
            found = _indexed([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64))
            for k, part in ((i, found[: len(blocks[i])]), (j, found[len(rows) - len(blocks[j]) :])):
                best[k] = part if best[k] is None else np.minimum(best[k], part)
        for rows, found in zip(blocks, best, strict=True):
            yield told(rows, found)

    for rows in _blocks(batches):
        if group and group[-1][-1][0] != rows[0][0]:
            yield from searched(group)
            group = []
        group.append(rows)
    if group:
        yield from searched(group)


def _clean(text: str, doc_id: int | None, least: int | None, found: list[dict] | None) -> tuple[int, int, str]:
    """(words, words removed, digest of the kept ones)."""
    words = _WORDS(text)
    n = len(words)
    gone = np.zeros(n + 1, dtype=np.int64)
    if doc_id is not None and n >= WINDOW:
        if least is not None and least < doc_id:
            gone[0] += 1
        else:
            for x in found or ():
                if x["doc"] < doc_id:
                    gone[x["first"]] += 1
                    gone[x["first"] + x["n"] - 1 + WINDOW] -= 1
    removed = np.cumsum(gone)[:n] > 0
    kept = [w for w, r in zip(words, removed.tolist(), strict=True) if not r] if removed.any() else words
    return n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()


def _prepare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that share nothing are done with here; the others are carried on."""
    for batch in batches:
        ids, texts, least, places = (batch.column(c).to_pylist() for c in ("doc_id", "text", "least", "places"))
        done = [
            _clean(t or "", None, None, None) if p is None and (m is None or i is None or m == i) else None
            for i, t, m, p in zip(ids, texts, least, places, strict=True)
        ]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([None if d else t or "" for d, t in zip(done, texts, strict=True)], pa.string()),
            batch.column(3), batch.column(4), batch.column(5), batch.column(6),
            pa.array([d[0] if d else None for d in done], pa.int64()), pa.array([d[1] if d else None for d in done], pa.int64()),
            pa.array([d[2] if d else None for d in done], pa.string()),
        ], ["doc_id", "body", "text", "least", "places", "hashes", "hot", "n_words", "n_removed", "kept_sha256"])


def _finish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, least, found = (c.to_pylist() for c in batch.columns)
        rows = [_clean(t, i, m, f) for i, t, m, f in zip(ids, texts, least, found, strict=True)]
        n, gone, digest = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PREPARED = ("doc_id long, body binary, text string, least long, places array<int>, hashes array<long>, "
            "hot array<int>, n_words long, n_removed long, kept_sha256 string")


def shared_anchors(heads: DataFrame) -> DataFrame:
    """(body, places, hashes, hot): the anchors that occur under two documents or more.

    ``hot`` holds the places of those that occur more than ``HOT_PLACES`` times, the
    other two the rest. Counted by partial sums; a hash that a third of all texts hold
    is a row per task there, and the join that follows can be split.
    """
    each = heads.select("body", "least", F.explode(F.arrays_zip("hashes", "places")).alias("z")).select(
        "body", "least", F.col("z.hashes").alias("hash"), F.col("z.places").alias("place")
    )
    # Texts that one document holds take nothing from each other, so documents tell them apart.
    known = each.groupBy("hash").agg(F.min("least").alias("a"), F.max("least").alias("b"), F.count(F.lit(1)).alias("n"))
    common = known.where("a < b").select("hash", (F.col("n") > HOT_PLACES).alias("hot"))
    z = F.col("z")
    cold = F.filter(z, lambda x: ~x["hot"])
    return each.drop("least").join(common, "hash").groupBy("body").agg(
        F.array_sort(F.collect_list(F.struct("place", "hash", "hot"))).alias("z")
    ).select(
        "body", cold["place"].alias("places"), cold["hash"].alias("hashes"), F.filter(z, lambda x: x["hot"])["place"].alias("hot")
    )


def intervals(prepared: DataFrame) -> DataFrame:
    """(body, found): the windows of each text with the smallest document that holds them."""
    heads = prepared.where("places IS NOT NULL AND doc_id = least").dropDuplicates(["body"])
    segments = heads.select("least", "text", "hashes", "places").mapInArrow(
        _segment_batches, "anchor long, segment string, doc long"
    ).groupBy("anchor", "segment").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("holders"))
    runs = staged(
        segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search_batches, RUNS), "passages"
    )
    places = heads.select("body", "text", "places").mapInArrow(_place_batches, "k1 long, k2 long, body binary, first int")
    run = F.struct((F.col("first") + F.col("r.at")).alias("first"), F.col("r.n").alias("n"), F.col("r.doc").alias("doc"))
    found = places.join(runs, ["k1", "k2"]).select("body", "first", F.explode("runs").alias("r")).select(
        "body", run.alias("run")
    )
    if not prepared.where("size(hot) > 0").select("hot").isEmpty():
        found = found.unionByName(_hot_windows(prepared))
    return found.groupBy("body").agg(F.collect_set("run").alias("found"))


def _hot_windows(prepared: DataFrame) -> DataFrame:
    """(body, run) around the anchors of very many texts; no task meets more than a row per task of a window."""
    heads = prepared.where("size(hot) > 0 AND doc_id = least").dropDuplicates(["body"])
    windows = staged(heads.select("body", "least", "text", "hot").mapInArrow(_window_batches, WINDOWS), "hot-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("own").alias("doc"), F.max("own").alias("last")).where("doc < last")
    run = F.struct("first", F.lit(1).alias("n"), "doc")
    return windows.join(least, ["w1", "w2"]).where("doc < own").select("body", run.alias("run"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    A null or empty text has no words. Rows without an id lose nothing and cause
    no loss. Rows that repeat an id are one document, and lose only what smaller
    ids hold too. An empty table gives an empty one.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = F.substring(F.unhex(F.sha2(F.encode(t, "UTF-8"), 256)), 1, 16)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), t.alias("text"))
    marked = rows.mapInArrow(_anchor_batches, "doc_id long, body binary, hashes array<long>, places array<int>")
    marked = staged(marked.where("doc_id IS NOT NULL AND size(hashes) > 0"), "anchors")
    heads = staged(
        marked.groupBy("body").agg(
            F.min("doc_id").alias("least"), F.min_by(F.struct("hashes", "places"), "doc_id").alias("z")
        ).select("body", "least", "z.hashes", "z.places"),
        "texts",
    )
    about = heads.select("body", "least").join(shared_anchors(heads), "body", "left")
    prepared = staged(
        rows.join(about, "body", "left").select("doc_id", "body", "text", "least", "places", "hashes", "hot").mapInArrow(
            _prepare_batches, PREPARED
        ),
        "prepared",
    )
    open_rows = prepared.where("text IS NOT NULL").select("doc_id", "body", "text", "least")
    finished = open_rows.join(intervals(prepared), "body", "left").select("doc_id", "text", "least", "found").mapInArrow(
        _finish_batches, RESULT
    )
    return prepared.where("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(finished)
