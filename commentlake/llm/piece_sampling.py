"""Sampled segmentation over the piece lattice, reproducible by row key.

All ways to spell a text in pieces form a lattice. Forward filtering sums their
weights from the left; backward sampling then walks from the end, choosing each
piece in proportion to what leads to it. No piece holds a space but at its start,
and none a line end, so the lattice falls apart at those and is filtered once per distinct unit (the
spaces before a word and the word); the walk goes through all units of a batch
together. Each choice draws from a counter of (seed, row key, place in the text):
neither batches nor partitions nor retries change it.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlake.llm.common import mix

SEED, SHARPNESS = 42, 1.5
#: Lattice nodes held per worker; beyond it the memory starts anew.
HELD_NODES = 2_500_000
#: Bits of a share: whole numbers, the same whatever else a worker holds.
SHARE_BITS = 53
_WHOLE = 1 << SHARE_BITS
#: Longest unit that is filtered together with others.
BLOCK_CHARS = 48
_UNITS = re.compile(r" *[^ \n]+| +|\n").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind: str):
        self._kept, self.n = np.empty(1 << 16, dtype=kind), 0

    def extend(self, values) -> None:
        values = np.asarray(values, dtype=self._kept.dtype)
        while self.n + len(values) > len(self._kept):
            self._kept = np.concatenate([self._kept, np.empty_like(self._kept)])
        self._kept[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def array(self) -> np.ndarray:
        return self._kept[: self.n]


class Lattice:
    """A model's pieces with weights, and the filtered lattices of the units seen.

    Units of one length are filtered together; those that hold a character of
    several bytes without a piece, or are long, one by one.
    """

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in usual}
        # Merge ranks are no log-probabilities; Zipf's law makes them such.
        ranks = all(s <= 0 and s == int(s) for s in scores.values())
        weight = (lambda s: -sharpness * math.log(2 - s)) if ranks else (lambda s: sharpness * s)
        self.piece = {model.id_to_piece(i).replace("▁", " "): (i, weight(scores[i])) for i in usual}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.piece):
            raise ValueError("a piece with a space or line end inside: units would not be independent")
        self.longest = max(map(len, self.piece))
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.least = min(w for _, w in self.piece.values())
        self.spelled = [b""] * n
        for p, (i, _) in self.piece.items():
            self.spelled[i] = p.encode()
        for b, i in enumerate(self.byte):
            self.spelled[i] = bytes([b])
        self._tabulate()
        self.clear()

    def _tabulate(self) -> None:
        """Pieces by the hash of their characters, in an open table with short probes."""
        self._power = np.ones(BLOCK_CHARS + 1, dtype=np.uint64)
        self._power[1:] = np.multiply.accumulate(np.full(BLOCK_CHARS, _BASE, dtype=np.uint64))
        size = 1 << 19
        self._mask = np.uint64(size - 1)
        self._slot_hash, self._slot = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self._weight, self._piece_id = np.zeros(len(self.piece)), np.zeros(len(self.piece), dtype=np.int32)
        self._probes = 1
        for k, (p, (i, w)) in enumerate(self.piece.items()):
            h = int(self._sums(np.array([[ord(c) for c in p]], dtype=np.uint64))[0, -1])
            at = int(mix(np.array([h], dtype=np.uint64))[0]) & (size - 1)
            probe = 1
            while self._slot[at] >= 0:
                at, probe = (at + 1) & (size - 1), probe + 1
            self._slot_hash[at], self._slot[at] = h, k
            self._weight[k], self._piece_id[k] = w, i
            self._probes = max(self._probes, probe)

    def _sums(self, chars: np.ndarray) -> np.ndarray:
        """Hash of every prefix; that of a part follows by one product."""
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), dtype=np.uint64)
        coded = mix(chars + np.uint64(1))
        for k in range(chars.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + coded[:, k]
        return out

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece's number for each hash, -1 for none."""
        flat = h.ravel()
        at = mix(flat) & self._mask
        found = self._slot[at]
        open_ = np.flatnonzero(found >= 0)  # most slots are empty, which settles it
        open_ = open_[self._slot_hash[at[open_]] != flat[open_]]
        for _ in range(self._probes - 1):
            at[open_] = (at[open_] + np.uint64(1)) & self._mask
            found[open_] = self._slot[at[open_]]
            open_ = open_[found[open_] >= 0]
            open_ = open_[self._slot_hash[at[open_]] != flat[open_]]
        found[open_] = -1
        return found.reshape(h.shape)

    def clear(self) -> None:
        self.unit: dict[str, int] = {}
        self._first, self._last = _Column("i8"), _Column("i8")  # of a unit: its first node and its last
        self._edge = _Column("i8")  # of a node: its first edge
        self._share = _Column("i8")  # of an edge: the share of its node's up to its own
        self._id, self._from = _Column("i4"), _Column("i4")  # its piece, and its node of origin or -1
        self._nodes = 0

    def _learn(self, units: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for u in sorted(units):
            if len(u) <= BLOCK_CHARS and (u.isascii() or not self._spelled_out(u)):
                by_size.setdefault(len(u), []).append(u)
            else:
                self._filter(u)
        for size, same in by_size.items():
            step = max(1, 400_000 // (size * min(size, self.longest)))
            for at in range(0, len(same), step):
                self._filter_block(same[at : at + step], size)

    def _spelled_out(self, unit: str) -> bool:
        """Whether it has a character of several bytes and no piece."""
        return any(c not in self.piece for c in unit if c > "\x7f")

    def _filter_block(self, units: list[str], size: int) -> None:
        """Forward-filter units of one length together."""
        m = len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4").reshape(m, size).astype(np.uint64)
        sums = self._sums(chars)
        alpha = np.zeros((m, size + 1))
        base = self._nodes + size * np.arange(m)
        nodes, shares, ids, origins = [], [], [], []
        for e in range(1, size + 1):
            s = np.arange(max(0, e - self.longest), e)
            found = self._lookup(sums[:, e : e + 1] - sums[:, s] * self._power[e - s][None, :])
            value = np.where(found >= 0, self._weight[found] + alpha[:, s], -np.inf)
            piece = self._piece_id[found]
            bare = found[:, -1] < 0  # no piece for the character: its byte
            value[bare, -1] = self.least + alpha[bare, e - 1]
            piece[bare, -1] = self._byte_ids[chars[bare, e - 1].astype(np.int64)]
            top = value.max(axis=1, keepdims=True)
            share = np.exp(value - top)
            run = np.cumsum(share, axis=1)
            alpha[:, e] = top[:, 0] + np.log(run[:, -1])
            run /= run[:, -1:]
            row, col = np.nonzero(value > -np.inf)
            nodes.append(base[row] + e - 1)
            shares.append(np.rint(run[row, col] * _WHOLE).astype(np.int64))
            ids.append(piece[row, col])
            origins.append(np.where(s[col] > 0, base[row] + s[col] - 1, -1))
        node = np.concatenate(nodes) - self._nodes
        order = np.argsort(node, kind="stable")
        degree = np.bincount(node, minlength=m * size)
        self._edge.extend(self._share.n + np.cumsum(degree) - degree)
        self._share.extend(np.concatenate(shares)[order])
        self._id.extend(np.concatenate(ids)[order])
        self._from.extend(np.concatenate(origins)[order])
        self.unit.update(zip(units, range(self._last.n, self._last.n + m), strict=True))
        self._first.extend(base)
        self._last.extend(base + size - 1)
        self._nodes += m * size

    @property
    def _byte_ids(self) -> np.ndarray:
        return np.array(self.byte, dtype=np.int32)

    def _filter(self, unit: str) -> None:
        """Forward-filter one unit; nodes are ends of pieces, of bytes where no piece fits."""
        piece, longest = self.piece, self.longest
        opens, share, ids, origin = [], [], [], []
        begun = self._share.n
        first = node = self._nodes
        size = len(unit)
        alpha = [0.0] + [-math.inf] * size
        at = [-1] * (size + 1)  # the node of each position
        for e in range(1, size + 1):
            edges = []
            for s in range(max(0, e - longest), e):
                if found := piece.get(unit[s:e]):
                    edges.append((alpha[s] + found[1], found[0], at[s]))
            if unit[e - 1] not in piece:
                raw = unit[e - 1].encode("utf-8")
                before = at[e - 1]
                for b in raw[:-1]:
                    opens.append(begun + len(share))
                    share.append(_WHOLE)
                    ids.append(self.byte[b])
                    origin.append(before)
                    before, node = node, node + 1
                edges.append((alpha[e - 1] + self.least * len(raw), self.byte[raw[-1]], before))
            top = max(x[0] for x in edges)
            parts = [math.exp(x[0] - top) for x in edges]
            total = math.fsum(parts)
            alpha[e], at[e] = top + math.log(total), node
            run = 0.0
            opens.append(begun + len(share))
            for part, (_, i, before) in zip(parts, edges, strict=True):
                run += part / total
                share.append(round(run * _WHOLE))
                ids.append(i)
                origin.append(before)
            share[-1] = _WHOLE
            node += 1
        self.unit[unit] = self._last.n
        self._edge.extend(opens)
        self._share.extend(share)
        self._id.extend(ids)
        self._from.extend(origin)
        self._first.extend([first])
        self._last.extend([node - 1])
        self._nodes = node

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, sampled for its key."""
        if not texts:
            return []
        # The space that begins every text lets its first word look like the others.
        lists = [_UNITS(" " + t) if t else [] for t in texts]
        new = set().union(*lists).difference(self.unit)
        if new:
            if self._nodes > HELD_NODES:
                self.clear()
                new = set().union(*lists)
            self._learn(new)
        flat = [u for own in lists for u in own]
        if not flat:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        counts = np.array([len(own) for own in lists])
        unit = np.fromiter(map(self.unit.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        opens = np.cumsum(counts) - counts
        begin = np.cumsum(sizes) - sizes
        starts = begin - np.repeat(begin[np.minimum(opens, len(begin) - 1)], counts)
        first_edge, share, ids, origin = self._edge.array, self._share.array, self._id.array, self._from.array
        seeds = np.repeat(mix(mix(keys.astype(np.int64).view(np.uint64)) ^ np.uint64(SEED)), counts)
        # A place is four times a character's, room for its bytes.
        place = seeds + starts.astype(np.uint64) * np.uint64(4) * _GOLDEN
        live = np.arange(len(unit))
        node, base = self._last.array[unit], self._first.array[unit]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        taken = np.zeros(len(unit), dtype=np.int64)
        while len(live):
            draw = (mix(place[live] + (node - base[live]).astype(np.uint64) * _GOLDEN) >> np.uint64(64 - SHARE_BITS)).view(np.int64)
            edge = first_edge[node]
            # Longer pieces stand first and are the likelier ones; a node's last share is above every draw.
            on = np.flatnonzero(share[edge] <= draw)
            while len(on):
                edge[on] += 1
                on = on[share[edge[on]] <= draw[on]]
            steps.append((live, ids[edge]))
            taken[live] += 1
            node = origin[edge]
            on = node >= 0
            live, node = live[on], node[on]
        end = np.cumsum(taken)
        out = np.empty(int(end[-1]), dtype=np.int32)
        for k, (who, what) in enumerate(steps):
            out[end[who] - 1 - k] = what
        cut = np.concatenate([[0], end])[np.cumsum(counts)]
        return np.split(out, cut[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded; for no ids the empty one."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))[1:].decode()


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One per worker process."""
    return Lattice(path)


def _sampled(batches: Iterator[pa.RecordBatch], model: str, chars: int = 500_000):
    """(rows of a batch, their texts, their ids), in runs of bounded length."""
    lat = lattice(model)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        keys = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + len(texts[to]) <= chars):
                held += len(texts[to])
                to += 1
            yield batch.slice(at, to - at), texts[at:to], lat.sample(texts[at:to], keys[at:to]), lat
            at = to


def _encoder(model: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, ids, _ in _sampled(batches, model):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encode


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids): one sampled segmentation of every whole text.

    A null or empty text has no ids. Rows that repeat an id and a text have the
    same ids; null ids share a key of their own.
    """
    return _rows(docs, doc_id, text).mapInArrow(_encoder(model or default_model()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): for what ``encode`` made, the very text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        for batch in batches:
            texts = [lat.decode(np.array(x, dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Every row encoded and decoded: doc_id, n_tokens, ids_crc32, decoded_sha256, lossless."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, ids, lat in _sampled(batches, path):
            back = [lat.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                pa.array([a == b for a, b in zip(back, texts, strict=True)]),
            ], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return _rows(docs, doc_id, text).mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean"
    )
