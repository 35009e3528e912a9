"""Near-duplicates by SimHash and pivot distance tables.

Equal fingerprints become one representative first. Two fingerprints that
differ in at most ``REACH`` of 64 bits agree on whole blocks, and those blocks
are the key under which they meet. Under a key, a table of the distances of each
fingerprint to many reference fingerprints does the work: by the triangle
inequality a pair whose distances to one reference differ by more than ``REACH``
cannot be close. Sorted by the first reference only a narrow band is looked at,
the largest difference over all references discards the rest of it, and
survivors are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlake.llm.common import mix, staged, word_bounds
from commentlake.llm.components import connected
from commentlake.llm.exact_dedup import file_of, located, place_of

SHINGLE, SEED, REACH = 3, 42, 3
#: 64 bits in five blocks: within three differing bits two blocks are untouched.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIVOTS = 16
#: Fingerprints under one key, about. Those of a larger one meet under finer keys.
KEY_ROWS = 20_000


def references(n: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """The reference fingerprints: fixed by their number and a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))


def fingerprint(text: str | None) -> int:
    """SimHash of one text, as an unsigned number; 0 for a text without words."""
    if not text:
        return 0
    raw = text.encode().translate(_LOWER)
    start, end = word_bounds(np.frombuffer(raw, dtype=np.uint8))
    n = len(start)
    if not n:
        return 0
    words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    if n < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bits of a bounded piece at a time
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]],
            ["doc_id", "print", *batch.schema.names[2:]],
        )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print), the fingerprint's bits as a signed long; one row per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_print_batches, "doc_id long, print long")


def _keys(prints: Column) -> Column:
    """For each pair of blocks their bits, with the pair's number in front."""
    block = [F.shiftrightunsigned(prints, at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in BLOCKS]
    return F.array(*[
        F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j])
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ])


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def close_pairs(prints: np.ndarray, pivots: np.ndarray, reach: int = REACH,
                block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs at most ``reach`` bits apart, piece by piece.

    Distances to the references are the table; rows are sorted by the first, so
    that a row's partners lie in a band right after it.
    """
    far = np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(far[:, 0], kind="stable")
    prints, far = prints[order], far[order]
    last = np.searchsorted(far[:, 0], far[:, 0] + reach, side="right")
    step = max(1, block * block // max(len(prints), 1))
    for at in range(0, len(prints), step):
        rows = np.arange(at, min(at + step, len(prints)))
        width = last[rows] - rows - 1
        left = np.repeat(rows, width)
        right = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + left + 1
        for p in range(1, len(pivots)):  # the largest coordinate difference decides
            near = np.abs(far[left, p] - far[right, p]) <= reach
            left, right = left[near], right[near]
        near = np.bitwise_count(prints[left] ^ prints[right]) <= reach
        if near.any():
            yield order[left[near]], order[right[near]]


def _forest(ids: np.ndarray, prints: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is close under one key: fewer than there are rows, not all pairs."""
    parent, links = list(range(len(ids))), []
    label = np.arange(len(ids))
    for left, right in close_pairs(prints, pivots):
        apart = label[left] != label[right]
        for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
        if apart.any():
            label = np.array([_root(parent, i) for i in range(len(ids))])
    return links


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows may go on over several batches."""
    pivots = references()
    kept: list[np.ndarray] = []

    def linked(rows: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(rows[:, 0])) + 1
        out = []
        for a, b in zip(np.r_[0, edge], np.r_[edge, len(rows)], strict=True):
            if b - a > 1:
                out += _forest(rows[a:b, 1], rows[a:b, 2].view(np.uint64), pivots)
        return out

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (np.array(links, dtype=np.int64).reshape(-1, 2)).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if kept and kept[0][0, 0] != rows[0, 0]:
            yield batch_of(linked(np.concatenate(kept)))
            kept = []
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if cut:
            yield batch_of(linked(np.concatenate([*kept, rows[:cut]])))
            kept = []
        kept.append(rows[cut:])
    if kept:
        yield batch_of(linked(np.concatenate(kept)))


def _rest_masks() -> list[list[int]]:
    """For each pair of blocks the other bits in four parts: one is untouched within three differing bits."""
    out = []
    for pair in combinations(range(len(BLOCKS)), 2):
        rest = [b for k, (at, size) in enumerate(BLOCKS) if k not in pair for b in range(at, at + size)]
        masks = [sum(1 << b for b in rest[part :: REACH + 1]) for part in range(REACH + 1)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def _large(keyed: DataFrame) -> DataFrame:
    """(key, n) of the keys with more rows than one task should hold."""
    return staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KEY_ROWS), "simhash-large")


def _dealt(keyed: DataFrame) -> DataFrame:
    """The same meetings under keys of bounded size; hashed keys that collide only cost comparisons.

    A large key first splits by the parts of the bits it leaves open. Where that is
    not enough, its rows are dealt into tiles, and every two tiles meet once.
    """
    large = _large(keyed)
    if large.isEmpty():
        return keyed
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _rest_masks()])
    own = F.get(masks, F.shiftright("key", 32).cast("int"))
    finer = keyed.join(large, "key").select(
        "key", "rep", "print", F.posexplode(own).alias("part", "mask")
    ).select(F.xxhash64("key", "part", F.col("print").bitwiseAND(F.col("mask"))).alias("key"), "rep", "print")
    kept = keyed.join(large, "key", "left_anti")
    still = _large(finer)
    tiles = F.ceil(F.col("n") / KEY_ROWS).cast("int")
    tile = F.pmod(F.xxhash64("print"), tiles).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), tiles - 1), lambda j: j != F.col("tile")))
    tiled = finer.join(still, "key").select("key", "rep", "print", "n", tile.alias("tile")).select(
        "key", "rep", "print", "tile", other.alias("other")
    ).select(
        F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), "rep", "print"
    )
    return kept.unionByName(finer.join(still, "key", "left_anti")).unionByName(tiled)


def links(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between representatives (rep, print) that connect all close ones."""
    keyed = _dealt(reps.select(F.explode(_keys(F.col("print"))).alias("key"), "rep", "print"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_batches, "a long, b long")


def _roots(prints: DataFrame) -> DataFrame:
    """(node, component) of the fingerprints that have close ones; a component is named by one of them."""
    nodes = staged(prints.select("print").distinct(), "simhash-nodes")
    return staged(connected(links(nodes.select(F.col("print").alias("rep"), "print"))), "simhash-components")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, print, component_id.

    Null and empty texts have the fingerprint 0 and link like any other. What
    links are fingerprints, so that texts which share an id stay apart, and those
    without an id link like others. A component is named by its smallest id,
    and by null only where it has none. An empty table gives an empty one.
    """
    prints = staged(fingerprints(docs, doc_id, text), "simhash-prints")
    reps = prints.groupBy("print").agg(F.min("doc_id").alias("rep"))
    found = _roots(prints)
    rooted = staged(
        reps.join(found, reps["print"] == found["node"], "left").select("print", "rep", "component"), "simhash-reps"
    )
    names = rooted.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = rooted.join(names, "component", "left").select("print", F.coalesce("least", "rep").alias("component_id"))
    return prints.join(named, "print", "left").select("doc_id", "print", "component_id")


def survivors(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Of located ``docs`` one row per root, with the columns it had, by (root, doc_id, file, at) of all rows.

    The row with the smallest id stays, one without an id only if no other has
    one, and of equal ids the first in the files.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at")
    several = rooted.groupBy("root").agg(F.min(order).alias("stays"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    gone = rooted.join(several, "root").where("file != stays.file OR at != stays.at").select(
        F.col("file").alias("_file"), F.col("at").alias("_at")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        file_of(docs).alias("_file"), place_of(docs).alias("_at"),
    )
    return rows.join(gone, ["_file", "_at"], "left_anti").select("row.*")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, the one with the smallest id, with the columns it had.

    Rows are told apart by their place, whatever ids they repeat or lack.
    """
    docs = located(docs)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        file_of(docs).alias("file"), place_of(docs).alias("at"),
    )
    prints = staged(rows.mapInArrow(_print_batches, "doc_id long, print long, file string, at long"), "simhash-prints")
    found = _roots(prints)
    return survivors(docs, prints.join(found, prints["print"] == found["node"], "left").select(
        F.coalesce("component", "print").alias("root"), "doc_id", "file", "at"
    ))
