"""What the operators share: carrying rows, staging tables, words as arrays."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.session import work_dir

#: A word is a run of other characters than these, in every operator.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text without other letters takes the faster way to the same result."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_table() -> np.ndarray:
    """For each byte whether it separates words; bytes of longer characters never do."""
    out = np.zeros(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


_SPACE = space_table()
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of UTF-8 ``data`` start and end."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its eight-byte parts go through the finaliser one after another.

    Equal words always have equal hashes; operators that need more than that
    compare the words themselves afterwards, or take a second seed.
    """
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    size = (end - start).astype(np.int64)
    h = mix((size + (seed << 40)).astype(np.uint64) * _MULTIPLIER + _MULTIPLIER)
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] * _MULTIPLIER ^ (eight[start[live] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    return h


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word equals the word at index ``like``, byte by byte."""
    size = end - start
    if (size != size[like]).any():
        return False
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    live = np.flatnonzero(like != np.arange(len(like)))
    at = 0
    while len(live):
        left = size[live] - at
        mask = _FIRST_BYTES[np.minimum(left, 8)]
        if ((eight[start[live] + at] ^ eight[start[like[live]] + at]) & mask).any():
            return False
        at += 8
        live = live[left > 8]
    return True
