"""Prefix trie of conversations from vertical bitmaps.

Conversations are sorted by id and cut into shards. A shard indexes every (position,
turn) to the bitset of its conversations that hold the turn there. A walk from the
root intersects a node's bitset with the postings of the next position: each
intersection is a child, its population count the number of members, and what no
posting takes ends there. Shards meet by a digest of the path, so one first turn that
a third of all conversations share is one row per shard. A node that several shards
hold is owned by the first of them; only the owner counts it as a child or a leaf,
which makes sums over subtrees, built bottom-up in each shard, add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlake.llm.common import WORD, staged

#: A shard is cut at so many conversations or turns; a longer conversation is a shard of its own.
SHARD_CONVS, SHARD_TURNS = 4096, 1 << 17
#: Rows of one Arrow batch that leaves a task.
OUT_ROWS = 20_000
ROOT = bytes(16)

NODE = (
    "shard long, number long, parent long, path binary, depth long, conv_id long, n_convs long, words long, "
    "inner boolean, ends binary"
)
SUMMED = (
    "shard long, path binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends binary, shards long"
)
RESULT = (
    "path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
TURN = ("conv_id", "position", "turn_id", "words")


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """(conv_id, position, turn_id, words): each conversation's turns from position 1 on, without their texts.

    A null role or text is empty. Null turns come first and equal ones in the order of
    ``turn_id``, 128 bits of SHA-256 over role and text; repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation and are left out.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.octet_length(own(role)).cast("string"), F.lit(":"), own(role), own(text))
    slim = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.substring(F.unhex(F.sha2(F.encode(said, "UTF-8"), 256)), 1, 16).alias("turn_id"),
        F.regexp_count(own(text), F.lit(WORD)).cast("long").alias("words"),
    )
    at = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_id")
    return slim.select("conv_id", F.row_number().over(at).cast("long").alias("position"), "turn_id", "words")


def rebuilt(numbered: DataFrame, step: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % step in place of its own first h.

    h is crc32(decimal c) % most, and % leaves no negative rest. Of a shorter
    conversation all turns are taken, of an absent one none. A conversation that is
    left without turns has one row whose other columns are null.
    """
    numbered = staged(numbered, "trie-turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(step))).alias("base")
    head = F.struct("position", "turn_id", "words").alias("head")
    heads = numbered.where((F.pmod("conv_id", F.lit(step)) == 0) & (F.col("position") < most)).groupBy(
        F.col("conv_id").alias("base")
    ).agg(F.collect_list(head).alias("heads"))  # fewer than ``most`` each
    taken = numbered.where("position = 1").select("conv_id", base, h).join(heads, "base", "left").select(
        "conv_id", F.explode_outer(F.filter("heads", lambda x: x["position"] <= F.col("h"))).alias("t")
    ).select("conv_id", "t.*")
    rest = numbered.select("*", h).where("position > h").drop("h")
    return taken.select(*TURN).unionByName(rest.select(*TURN))


# ---- nodes of a shard ------------------------------------------------------
class _Out:
    """Rows of a schema, handed on in batches."""

    def __init__(self, kinds: list[pa.DataType], names: list[str]):
        self.kinds, self.names, self.rows = kinds, names, []

    def batches(self, rest: bool = False) -> Iterator[pa.RecordBatch]:
        while len(self.rows) >= OUT_ROWS or (rest and self.rows):
            some, self.rows = self.rows[:OUT_ROWS], self.rows[OUT_ROWS:]
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)], self.names
            )


def _out(schema: str) -> _Out:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return _Out([kinds[k] for _, k in fields], [n for n, _ in fields])


def _joined(path: bytes, turn_id: bytes) -> bytes:
    return hashlib.sha256(path + turn_id).digest()[:16]


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def bitmap_nodes(convs: list[tuple[int, list[bytes], list[int]]]) -> Iterator[tuple]:
    """Nodes of the trie over ``convs`` (conv_id, turn ids, words), sorted by conv_id; parents come first."""
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for bit, (_, ids, _) in enumerate(convs):
        one = 1 << bit
        for at in enumerate(ids):
            postings[at] = postings.get(at, 0) | one
        ending[len(ids)] = ending.get(len(ids), 0) | one
    shard, number = convs[0][0], 0
    stack = [((1 << len(convs)) - 1, 0, -1, ROOT, 0)]
    while stack:
        members, depth, parent, path, words = stack.pop()
        ended = members & ending.get(depth, 0)
        rest = members ^ ended
        first = (members & -members).bit_length() - 1
        ends = ",".join(str(convs[b][0]) for b in _bits(ended)).encode()
        yield (shard, number, parent, path, depth, convs[first][0], members.bit_count(), words, rest > 0, ends)
        left = rest
        while left:
            _, ids, counts = convs[(left & -left).bit_length() - 1]
            child = left & postings[depth, ids[depth]]
            stack.append((child, depth + 1, number, _joined(path, ids[depth]), counts[depth]))
            left ^= child
        number += 1


def _chain(conv_id: int, steps: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
    """Nodes of one conversation that is too long to be held: its trie is a path."""
    path, words, number = ROOT, 0, 0
    for turn_id, count in steps:
        yield (conv_id, number, number - 1, path, number, conv_id, 1, words, True, b"")
        path, words, number = _joined(path, turn_id), count, number + 1
    yield (conv_id, number, number - 1, path, number, conv_id, 1, words, False, str(conv_id).encode())


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[bytes, int]]]]:
    """(conv_id, its turns) from rows sorted by conversation; the turns are read as they are asked for."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    row = next(rows, None)

    def own(conv_id):
        nonlocal row
        while row is not None and row[0] == conv_id:
            turn, row = row[1:], next(rows, None)
            if turn[0] is not None:
                yield turn

    while row is not None:
        conv_id = row[0]
        steps = own(conv_id)
        yield conv_id, steps
        for _ in steps:  # what nobody asked for
            pass


def _sharder(shard_convs: int, shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = _out(NODE), [], 0
        for conv_id, steps in _conversations(batches):
            ids, counts = [], []
            for turn_id, count in steps:
                ids.append(turn_id)
                counts.append(count)
                if len(ids) > shard_turns:
                    break
            if len(held) >= shard_convs or (held and size + len(ids) > shard_turns):
                out.rows.extend(bitmap_nodes(held))
                yield from out.batches()
                held, size = [], 0
            if len(ids) > shard_turns:
                begun = list(zip(ids, counts, strict=True))
                for node in _chain(conv_id, (t for part in (begun, steps) for t in part)):
                    out.rows.append(node)
                    yield from out.batches()
                continue
            held.append((conv_id, ids, counts))
            size += len(ids)
        if held:
            out.rows.extend(bitmap_nodes(held))
        yield from out.batches(rest=True)

    return run


# ---- sums over subtrees ----------------------------------------------------
def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each node's part in a shard, from rows that come children first.

    A row waits for its parent's, which knows the parent's smallest member.
    """
    out = _out(SUMMED)
    sums: dict[int, list[int]] = {}  # by parent: children, leaves, saved
    waiting: dict[int, list[list]] = {}
    for batch in batches:
        for shard, number, parent, path, depth, conv_id, n, words, ends, owned, leaf, shards in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            children, leaves, saved = sums.pop(number, (0, 0, 0))
            leaves += owned and leaf
            saved += (n - owned) * words
            for child in waiting.pop(number, ()):
                child[4] = conv_id
                out.rows.append(child)
            mine = [shard, path, depth, conv_id, None, n, children, leaves, saved, ends, shards]
            if parent < 0:
                out.rows.append(mine)
            else:
                waiting.setdefault(parent, []).append(mine)
                above = sums.setdefault(parent, [0, 0, 0])
                above[0] += owned
                above[1] += leaves
                above[2] += saved
            if len(out.rows) >= OUT_ROWS:
                yield from out.batches()
    yield from out.batches(rest=True)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that several shards hold, from their parts in the order of the shards."""
    out, now, sha, some = _out(RESULT), None, None, False
    for batch in batches:
        for path, conv_id, depth, parent, n, children, leaves, saved, ends in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if now is None or now[0] != path:
                if now is not None:
                    out.rows.append((*now, sha.hexdigest()))
                    yield from out.batches()
                now, sha, some = [path, conv_id, depth, parent, 0, 0, 0, 0], hashlib.sha256(), False
            for k, v in enumerate((n, children, leaves, saved)):
                now[4 + k] += v
            if ends:
                sha.update((b"," if some else b"") + ends)
                some = True
    if now is not None:
        out.rows.append((*now, sha.hexdigest()))
    yield from out.batches(rest=True)


def trie(numbered: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: path, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``numbered`` has conv_id, position, turn_id and words as ``turns`` makes them; a
    row without a turn_id says only that its conversation exists. Without any
    conversation there is no node, not even a root. Memory is bounded by a shard: a
    conversation of more turns is walked without being held.
    """
    nodes = numbered.select(*TURN).repartitionByRange("conv_id").sortWithinPartitions(
        "conv_id", F.col("position").asc_nulls_first(), "turn_id"
    ).select("conv_id", "turn_id", "words").mapInArrow(_sharder(shard_convs, shard_turns), NODE)
    same = Window.partitionBy("path")  # one row per shard at most
    whole: dict[str, Column] = {
        "owned": (F.col("shard") == F.min("shard").over(same)).cast("long"),
        "leaf": (~F.max("inner").over(same)).cast("long"),
        "conv_id": F.min("conv_id").over(same),
        "shards": F.count(F.lit(1)).over(same),
    }
    known = nodes.select("shard", "number", "parent", "path", "depth", "n_convs", "words", "ends", *(c.alias(n) for n, c in whole.items()))
    summed = known.repartition("shard").sortWithinPartitions("shard", F.col("number").desc()).select(
        "shard", "number", "parent", "path", "depth", "conv_id", "n_convs", "words", "ends", "owned", "leaf", "shards"
    ).mapInArrow(_subtrees, SUMMED)
    summed = staged(summed, "trie-nodes")
    columns = ("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    alone = summed.where("shards = 1").select(*columns, F.sha2("ends", 256).alias("ends_sha256"))
    shared = summed.where("shards > 1").repartition("path").sortWithinPartitions("path", "shard").select(*columns, "ends")
    return alone.unionByName(shared.mapInArrow(_merged, RESULT))
