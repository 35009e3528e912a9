"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every text. How accurate each
is comes from expectation maximisation over the counts of vote patterns in the
whole corpus; no true label is used. The posterior of a pattern labels the
documents of a bounded sample, and those train a hashed linear scorer, which then
scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlake.llm.common import mix, staged, word_bounds, word_hashes

GOOD, BAD, NONE = 1, -1, 0
#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on der die und das den von zu ist nicht auf "
    "le la les de et des un une du que est pour el los las y del por con su se en"
).split()
#: (measure, bad from, good from): a vote on either side, none between; None where a labeller
#: knows the bad only. Where bad is below good, small values are bad.
LABELLERS = (
    ("symbols_per_word", 0.3, None),
    ("marks_per_word", 0.3, None),
    ("repeated_windows", 0.3, None),
    ("repeated_words", 0.1, None),
    ("upper_letters", 0.5, None),
    ("repeated_lines", 0.4, None),
    ("stop_words", 0.06, 0.1),
    ("different_words", 0.25, 0.45),
)
FEATURES = 1 << 16
#: Documents that the scorer is fitted on, at most: those with the smallest hashes.
SAMPLE = 3000
ROUNDS, STEPS, RATE = 100, 150, 0.3
KEEP_FROM = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>~^=+{}[]\\_@", dtype=np.uint8)] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[np.frombuffer(b"!?|", dtype=np.uint8)] = True


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.unique(word_hashes(raw, *word_bounds(raw)))


_STOP = _hashes_of(STOP_WORDS)


class Measured:
    """Measures and hashed features of one text."""

    def __init__(self, text: str | None):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        start, end = word_bounds(data)
        self.n = n = len(start)
        if not n:
            return
        h = word_hashes(data, start, end, lower=True)
        upper = int(((data >= 65) & (data <= 90)).sum())
        letters = max(1, int((((data | 32) >= 97) & ((data | 32) <= 122)).sum()))
        windows = mix(h[:-2] + mix(h[1:-1] + mix(h[2:]))) if n > 2 else h[:0]
        lines = [x for x in (text or "").split("\n") if x.strip()]
        self.ratio = {
            "symbols_per_word": int(_SYMBOL[data].sum()) / n,
            "marks_per_word": int(_MARK[data].sum()) / n,
            "repeated_windows": 1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0,
            "repeated_words": float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
            "upper_letters": upper / letters,
            "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)),
            "stop_words": float(np.isin(h, _STOP).mean()),
            "different_words": len(np.unique(h)) / n,
        }
        self._data = data

    def votes(self) -> list[int]:
        """One vote per labeller; a text without words is bad to each."""
        if not self.n:
            return [BAD] * len(LABELLERS)
        out = []
        for name, bad, good in LABELLERS:
            x = self.ratio[name]
            if good is None:
                out.append(BAD if x >= bad else NONE)
            else:
                out.append(BAD if x <= bad else GOOD if x >= good else NONE)
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, values): parts of its four-byte runs, and its measures by name."""
        d = self._data.astype(np.uint64)
        runs = d[:-3] | d[1:-2] << np.uint64(8) | d[2:-1] << np.uint64(16) | d[3:] << np.uint64(24) if len(d) > 3 else d
        place, count = np.unique(mix(runs) & np.uint64(FEATURES - 1), return_counts=True)
        value = np.sqrt(count / count.sum())
        named = mix(np.arange(1, len(LABELLERS) + 1, dtype=np.uint64) << np.uint64(40)) & np.uint64(FEATURES - 1)
        return (
            np.concatenate([place, named]).astype(np.int64),
            np.concatenate([value, [min(1.0, self.ratio[name]) for name, _, _ in LABELLERS]]),
        )


def _pattern(votes: list[int]) -> int:
    """Votes as digits to the base of three."""
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    return code


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_pattern(Measured(t.as_py()).votes()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32())], ["doc_id", "pattern"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, P(vote | class) per labeller, share of good).

    Expectation maximisation of a model in which labellers err independently. It
    starts at the majority of votes, which also says which class is the good one.
    """
    m = len(LABELLERS)
    votes = patterns[:, None] // 3 ** np.arange(m - 1, -1, -1)[None, :] % 3  # 0 bad, 1 none, 2 good
    balance = (votes == 2).sum(axis=1) - (votes == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-balance.astype(float)))
    table, share = np.zeros((2, m, 3)), 0.5
    for _ in range(rounds):
        for c, weight in ((0, counts * (1 - good)), (1, counts * good)):
            for v in range(3):
                table[c, :, v] = (weight[:, None] * (votes == v)).sum(axis=0) + 1.0  # one seen of each
            table[c] /= table[c].sum(axis=1, keepdims=True)
        share = float(((counts * good).sum() + 1) / (counts.sum() + 2))
        said = np.log(table)[:, np.arange(m)[None, :], votes].sum(axis=2)
        good = 1 / (1 + np.exp(np.clip(said[0] + np.log(1 - share) - said[1] - np.log(share), -500, 500)))
    return good, table, share


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = STEPS,
        rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic scorer, by full-batch Adam on soft labels."""
    w, b = np.zeros(FEATURES), 0.0
    if not rows:
        return w, b
    place = np.concatenate([p for p, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[place] * value, minlength=len(rows)) + b
        miss = 1 / (1 + np.exp(-z)) - target
        g = np.append(np.bincount(place, weights=miss[row] * value, minlength=FEATURES) / len(rows) + 1e-5 * w, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1] / 10, b - step[-1] / 10
    return w, float(b)


def _scorer(w: np.ndarray, b: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, scores = [], []
            for t in batch.column(1):
                at = Measured(t.as_py())
                codes.append(_pattern(at.votes()))
                if at.n:
                    place, value = at.features()
                    scores.append(float(1 / (1 + np.exp(-np.clip(w[place] @ value + b, -500, 500)))))
                else:
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes, pa.int32()), pa.array(scores)], ["doc_id", "pattern", "score"]
            )

    return score


def _example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        measured = [Measured(t.as_py()) for t in batch.column(0)]
        found = [m.features() for m in measured]
        yield pa.RecordBatch.from_arrays([
            pa.array([_pattern(m.votes()) for m in measured], pa.int32()),
            pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()),
            pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
        ], ["pattern", "place", "value"])


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, posterior (of its votes), score, kept.

    A null or empty text scores 0 and is not kept. Repeated rows are judged alike;
    an empty table gives an empty one. The driver holds the counts of at most
    3 ** labellers patterns and the features of ``sample`` documents, one row each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    voted = staged(rows.mapInArrow(_vote_batches, "doc_id long, pattern int"), "votes")
    counted = sorted(voted.groupBy("pattern").count().collect())
    patterns = np.array([r["pattern"] for r in counted], dtype=np.int64)
    good, _, _ = estimate(patterns, np.array([r["count"] for r in counted], dtype=float))
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    # A sample by hash is the same on every run; only its ids meet at the driver. Rows that
    # repeat an id are one example, the one with the smallest hash of its text.
    order = F.xxhash64(F.lit("weak labels"), "doc_id")
    chosen = staged(
        voted.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(order, "doc_id").limit(sample), "weak-sample"
    )
    words = rows.join(F.broadcast(chosen), "doc_id").where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    one = words.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    examples = one.select("text").mapInArrow(_example, "pattern int, place binary, value binary").collect()
    examples.sort(key=lambda r: (r["pattern"], r["place"], r["value"]))
    w, b = fit(
        [(np.frombuffer(r["place"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in examples],
        np.array([posterior[r["pattern"]] for r in examples]),
    )
    scored = rows.mapInArrow(_scorer(w.astype(np.float32), b), "doc_id long, pattern int, score double")
    known = spark.createDataFrame(list(posterior.items()) or [(-1, 0.0)], "pattern int, posterior double")
    return scored.join(F.broadcast(known), "pattern", "left").select(
        "doc_id", "posterior", "score", (F.col("score") >= KEEP_FROM).alias("kept")
    )
