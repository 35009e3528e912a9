"""Whitening of embeddings along their leading directions.

Entries become whole numbers, so sums and distances are exact. Centred rows are
reduced to one triangular matrix by QR in blocks: each task keeps one of the size of
the dimensions, and a tree of tasks joins them. Its bidiagonal form gives singular
values and directions (``bidiagonal``), and every row is projected by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlake.llm.bidiagonal import leading
from commentlake.llm.common import staged

#: An entry c becomes floor(c * SCALE) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries beyond this are no exact whole numbers any more.
LARGEST = float(1 << 42)
#: Rows of a QR block; triangular matrices that one task joins.
BLOCK_ROWS, FAN_IN = 4096, 32

WHITE = "vec_id long, deviation decimal(38,0), whitened array<double>"


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose vector is there and holds finite numbers only, of magnitude up to 2 ** 42.

    Of several lengths the most frequent one is kept, the longer at a tie; vectors
    without entries are dropped.
    """
    kept = dict(vectors.select(embedding).dtypes)[embedding] == "array<float>"  # half the size, and exact as doubles
    entries = F.col(embedding) if kept else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), entries.alias("v"))
    # A null entry, NaN or an infinity is not within the bound.
    rows = rows.where("size(v) > 0").where(F.forall("v", lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False))))
    sizes = rows.groupBy(F.size("v").alias("size")).count()
    usual = sizes.agg(F.max_by("size", F.struct("count", "size"))).first()[0]  # one row per length
    return rows.where(F.size("v") == (usual or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Whole-number vectors of a batch, one per row."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (place, n, sum) of each dimension."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            part = x.sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(s) for s in total])],
            ["place", "n", "sum"],
        )


class Centre:
    """Count and exact sums of the fit list, and what follows from them for a row."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # n * x - S through whole and fractional mean: no large products.
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)
        self.part = self.rest / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2, exactly."""
        by = x - self.whole
        most = (int(np.abs(by).max(initial=0)) + 1) * self.n
        if most < 2**31 and most * most * x.shape[1] < 2**63:
            at = self.n * by - self.rest
            return (at * at).sum(axis=1).tolist()
        at = self.n * by.astype(object) - self.rest.astype(object)
        return (at * at).sum(axis=1).tolist()


def fit_centre(rows: DataFrame) -> Centre | None:
    """Count and sums of the vectors ``v``; None without any. One row per dimension meets at the driver."""
    found = rows.select("v").mapInArrow(_sums, "place int, n long, sum string").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")
    ).orderBy("place").collect()
    return Centre(int(found[0]["n"]), [int(r["sum"]) for r in found]) if found else None


def _packed(group: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"]
    )


def _stack(kept: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of what is kept and more rows."""
    return np.linalg.qr(rows if kept is None else np.concatenate([kept, rows]), mode="r")


def _reducer(centre: Centre):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                kept = _stack(kept, centre.centred(_matrix(batch.column(0).slice(at, BLOCK_ROWS))))
        if kept is not None:
            yield _packed(TaskContext.get().partitionId(), kept)

    return reduce


def _joiner(dims: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, part = None, 0
        for batch in batches:
            for group, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept is not None and group != part:
                    yield _packed(part, kept)
                    kept = None
                kept, part = _stack(kept, np.frombuffer(r).reshape(-1, dims)), group
        if kept is not None:
            yield _packed(part, kept)

    return join


def triangular(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred vectors: blockwise QR in tasks, joined by a tree of ``FAN_IN``; square."""
    dims = len(centre.sums)
    parts = staged(rows.select("v").mapInArrow(_reducer(centre), "part long, r binary"), "whiten-r")
    while parts.limit(2).count() > 1:
        # Ids of tasks need not be dense, but each round has FAN_IN times fewer of them.
        joined = parts.select(F.floor(F.col("part") / FAN_IN).cast("long").alias("part"), "r")
        # The bytes order equal parts, so that reruns add in one order.
        parts = staged(
            joined.repartition("part").sortWithinPartitions("part", "r").mapInArrow(_joiner(dims), "part long, r binary"), "whiten-r"
        )
    r = np.frombuffer(parts.first()["r"]).reshape(-1, dims)
    return np.concatenate([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def _projector(centre: Centre, directions: np.ndarray):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        width = directions.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            white = centre.centred(x) @ directions
            values = pa.ListArray.from_arrays(np.arange(0, len(x) * width + 1, width, dtype=np.int32), pa.array(white.ravel()))
            exact = pa.array([decimal.Decimal(d) if d < 10**38 else None for d in centre.deviation(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, values], ["vec_id", "deviation", "whitened"])

    return project


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per clean vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Directions whose variance is nothing but rounding are no components, so vectors
    that all agree, or a single one, give no rows; nor does an empty table. Repeated
    rows count each. A deviation beyond the range of long is null. The driver holds
    one triangular matrix of the dimensions' size.
    """
    rows = staged(clean(vectors, vec_id, embedding), "whiten-rows")
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], kinds)
    centre = fit_centre(rows)
    if centre is None:
        return nothing
    values, top, directions = leading(triangular(rows, centre) / np.sqrt(centre.n), components)
    if not len(top):
        return nothing
    white = staged(rows.mapInArrow(_projector(centre, (directions / np.sqrt(top)[:, None]).T), WHITE), "whitened")
    at = [F.get("whitened", F.lit(k)) for k in range(len(top))]
    error = F.greatest(*(F.abs(F.covar_pop(a, b) - float(j == k)) for j, a in enumerate(at) for k, b in enumerate(at) if j <= k), F.lit(0.0))
    worst = white.agg(error).first()[0]
    share = F.element_at(F.array(*(F.lit(float(v)) for v in top / values.sum())), F.col("component"))
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "white")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"), F.col("white").alias("whitened"),
    ).withColumn("explained", share).withColumn("identity_error", F.lit(float(worst)))
