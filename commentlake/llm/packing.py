"""Best-fit packing by sums of squares.

Every whole text becomes token ids with an end id; only documents longer than a
sequence are cut. A piece then goes where the sum of the squared numbers of open
sequences per residual gap becomes smallest, so that no gap piles up. Longest
pieces go first. Pieces are dealt into groups of bounded size that are packed
apart; what lies in badly filled sequences of all groups is dealt and packed
again, until one group holds the rest. No task sees more than a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlake.llm.common import staged
from commentlake.llm.tokens import default_tokenizer, encoder

SEQUENCE, END_ID = 4096, 1
#: Pieces per group; and the part of a sequence that may stay empty before it is packed again.
GROUP_PIECES, WASTE = 16_384, 32

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, `group` int, bin int, offset long, gap long"


def _cutter(tokenizer: str, size: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[a : a + 4 * size]
                        rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return cut


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
           size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text, in place and unmoved.

    A null or empty text is one piece with the end id alone. ``with_ids`` adds the
    ids themselves as little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_cutter(tokenizer or default_tokenizer(), size, with_ids), PIECE)


def sum_of_squares(lengths: list[int], size: int = SEQUENCE) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset, final gap) of each piece, placed in the order given."""
    open_bins = np.zeros(size + 1, dtype=np.int64)  # by gap; closed ones are not counted
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    blocked = np.iinfo(np.int64).max // 4
    gaps: list[int] = []
    bins, offsets = [], []
    for s in lengths:
        # Moving a bin from gap g to g - s changes the sum by 2 (N[g - s] - N[g]) + 2.
        after, before = open_bins[: size + 1 - s], open_bins[s:]
        change = np.where(before > 0, 2 * (after - before) + 2, blocked)
        change[0] -= before[0] > 0  # that bin closes and counts no more
        best = int(change.argmin())
        fresh = 2 * int(open_bins[size - s]) + 1 if s < size else 0
        if change[best] <= fresh:
            where = stacks[best + s].pop()
            open_bins[best + s] -= 1
        else:
            best = size - s
            where = len(gaps)
            gaps.append(size)
        bins.append(where)
        offsets.append(size - best - s)
        gaps[where] = best
        if best:
            open_bins[best] += 1
            stacks[best].append(where)
    return bins, offsets, [gaps[b] for b in bins]


def _packer(size: int):
    def pack(key: tuple, group: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        tie = [group.column(c).fill_null(-(2**63) if c == "doc_id" else 0).to_numpy() for c in ("piece", "doc_id")]
        order = np.lexsort((*tie, -length))
        bins, offsets, gaps = sum_of_squares(length[order].tolist(), size)
        out = group.take(pa.array(order))
        return pa.table(
            [*(out.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")),
             pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(bins, pa.int32()), pa.array(offsets, pa.int64()), pa.array(gaps, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "group", "bin", "offset", "gap"],
        )

    return pack


def packed(cut: DataFrame, size: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset; gapless from 0 in every sequence.

    Repeated rows are pieces of their own and are dealt apart, by the number they were
    written under; an empty table gives an empty one. Each round's result is stored,
    and a later round takes only what it packs anew.
    """
    numbered = lambda df, name: staged(df.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), name)
    todo, done, number, before = numbered(cut, "pack-pieces"), None, 0, None
    while True:
        n = todo.count()
        groups = max(1, -(-n // group_pieces))
        dealt = todo.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)).cast("int")).drop("row")
        placed = staged(dealt.groupBy("group").applyInArrow(_packer(size), PLACED), "pack-placed")
        last = groups == 1 or (before is not None and 2 * n > before)
        ready = placed if last else placed.where(F.col("gap") <= size // WASTE)
        sequence = (
            F.lit(number << 56).bitwiseOR(F.shiftleft(F.col("group").cast("long"), 32)).bitwiseOR(F.col("bin").cast("long"))
        )
        ready = ready.select(
            "doc_id", "piece", "start", "length", "ids_crc32", "ids", sequence.alias("sequence_id"), "offset"
        )
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        todo = numbered(placed.where(F.col("gap") > size // WASTE), "pack-again")
        number, before = number + 1, n


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the ids of its pieces in order; needs pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one per token of a sequence
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(whole.alias("ids"))
