"""Whitening of embeddings by hierarchical SVD merging.

Every task sums up its vectors, block by block, by their number, exact integer
sums, and the singular values and right singular vectors of the centred block,
all dimensions of them. Two summaries merge without loss: the one's scaled
vectors are stacked on the other's, one row for the difference of the means is
appended, and the stack is decomposed again. The tasks' summaries are merged
FAN at a time, in as many rounds of tasks as it takes; what a summary holds
depends on the dimensions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize

#: Entries become integers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Summaries that one task merges, and vectors of a block.
FAN, BLOCK = 8, 4096
#: Eigenvalues under this share of the largest are those of no direction at all.
FLAT = 1e-20


@dataclass
class Summary:
    """Number, exact sums, and the decomposition of the centred vectors: singular values (falling) and right vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of a block of integer vectors."""
        sums = x.sum(axis=0)
        centred = (x - x[0]).astype(float)
        _, values, vectors = np.linalg.svd(np.linalg.qr(centred - centred.mean(axis=0), mode="r"), full_matrices=False)
        return cls(len(x), sums, values, vectors)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([(int(a) * other.n - int(b) * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        stack = np.concatenate([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, (self.n * other.n / n) ** 0.5 * apart[None]])
        _, values, vectors = np.linalg.svd(stack, full_matrices=False)
        return Summary(n, self.sums + other.sums, values, vectors)


SUMMARY = "part long, n long, sums array<long>, vals array<double>, vectors array<double>"


def _row(part: int, s: Summary) -> pa.RecordBatch:
    cols = [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), pa.array([s.sums.tolist()], pa.list_(pa.int64())), pa.array([s.values.tolist()], pa.list_(pa.float64())), pa.array([s.vectors.ravel().tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, ["part", "n", "sums", "vals", "vectors"])


def _read(row: dict) -> Summary:
    values = np.array(row["vals"], float)
    return Summary(row["n"], np.array(row["sums"], np.int64), values, np.array(row["vectors"], float).reshape(len(values), -1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of the task's vectors."""
    held = None
    for b in batches:
        x = _matrix(b.column(0)) if b.num_rows else np.zeros((0, 0), np.int64)
        for lo in range(0, len(x), BLOCK):
            s = Summary.of(x[lo : lo + BLOCK])
            held = held.merge(s) if held else s
    if held:
        yield _row(TaskContext.get().partitionId(), held)


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    return pa.Table.from_batches([_row(rows[0]["part"] // FAN, reduce(Summary.merge, map(_read, rows)))])


@dataclass
class Whitener:
    """What maps integer vectors to whitened components."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray  # components x dimensions
    eigenvalues: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the usable vectors as integers, those of the commonest length (of equally common ones the longest)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).select("id", x.alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The covariance's leading unit eigenvectors over all rows of (x); None without a row. One row, of FAN summaries at most, reaches the driver."""
    found = materialize(rows.select("x").mapInArrow(_summaries, SUMMARY), "op12-summaries")
    while (left := found.count()) > 1:
        found = materialize(found.groupBy(F.floor(F.col("part") / FAN).alias("of")).applyInArrow(_merged, SUMMARY), "op12-summaries")
        if found.count() == left:  # parts lie too far apart: number them anew
            found = materialize(found.select(F.col("part").alias("p"), "n", "sums", "vals", "vectors").withColumn("part", F.floor(F.col("p") / FAN)).drop("p").select("part", "n", "sums", "vals", "vectors"), "op12-summaries")
    if not left:
        return None
    s = _read(found.first().asDict())
    d = len(s.sums)
    values = np.zeros(d)
    values[: len(s.values)] = s.values**2 / s.n
    _, _, vectors = np.linalg.svd(s.vectors if len(s.values) else np.zeros((1, d)), full_matrices=True) if len(s.values) < d else (None, None, s.vectors)
    if len(s.values) < d:  # the missing directions, which have no variance
        vectors = np.concatenate([s.vectors, vectors[len(s.values) :]]) if len(s.values) else vectors
    k = min(components, d)
    top = vectors[:k]
    top = top * np.where(top[np.arange(k), np.abs(top).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Whitener(s.n, s.sums, top, values[:k], float(values.sum()))


def transform(rows: DataFrame, w: Whitener) -> DataFrame:
    """(id, deviation, whitened array) of (id, x); a component without variance gives null, as does a deviation beyond a long."""
    scale = np.where(w.eigenvalues > FLAT * max(float(w.eigenvalues[0]), 1e-300), w.eigenvalues, np.nan) ** -0.5
    sent = rows.sparkSession.sparkContext.broadcast((w.n, w.sums, w.vectors, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, vectors, scale = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                x = _matrix(b.column(1))
                off = x * n - sums  # exact, as the result is
                near = x.astype(float) * n - sums.astype(float)
                fits = (near**2).sum(axis=1) < 9.2e18
                deviation = pa.array((off**2).sum(axis=1), mask=~fits)
                y = (off / n) @ vectors.T * scale
                flat = pa.array(y.ravel(), pa.float64(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), deviation, lists], ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of the first ``k`` whitened components, less the identity; components without variance are left out."""
    cols = [F.get("whitened", i) for i in range(k)]
    means = whitened.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).first()
    some = [i for i in range(k) if means[i] is not None]
    if not some:
        return None
    pairs = [(i, j) for i in some for j in some if i <= j]
    got = whitened.agg(*(F.avg((cols[i] - F.lit(means[i])) * (cols[j] - F.lit(means[j]))) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, got, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null or empty, or hold null or non-finite entries, are
    dropped, and so are vectors of another length than the commonest. Entries
    become integers; components are the unit eigenvectors of their covariance
    over all vectors, by falling eigenvalue, each with its largest entry
    positive. A component without variance has a null ``whitened``; explained
    is null where no component has any. A deviation that no long can hold is
    null. Null and repeated ids are rows of their own; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = materialize(integers(vectors, id_col, vector_col), "op12-integers")
    w = fit(rows, components)
    kind = vectors.schema[id_col].dataType.simpleString()
    if w is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = materialize(transform(rows, w), "op12-whitened")
    k = len(w.eigenvalues)
    error = identity_error(out, k)
    explained = F.array(*(F.lit(float(e / w.trace) if w.trace > 0 else None).cast("double") for e in w.eigenvalues))
    each = out.select("id", "deviation", F.posexplode("whitened").alias("i", "y"))
    return each.select(
        F.col("id").alias(id_col), (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", F.col("y").alias("whitened"),
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
