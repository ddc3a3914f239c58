"""Embedding whitening by TSQR: a tree of QR factors instead of a covariance matrix.

1. Vectors that are null or hold null or non-finite entries are left out; the others become whole
   numbers x = floor(SCALE * c).  The fit list is each distinct x once, written to the shared folder.
2. One pass gives its number of vectors n and their exact sums S, as partial sums of each partition
   in whole numbers.
3. Rows are centred as (n * x - S) / n, whose numerator is exact.  Each partition keeps the
   triangular factor of the rows so far: QR of the factor on top of the next batch.
4. Factors meet in groups of FAN until one is left.  Its singular values are those of the centred
   rows, so that eigenvalues of the covariance are their squares over n, and its right vectors the
   components.  The covariance is never formed, which would square its condition number.
5. Rows are projected in a last scan.  The same pass over the fit list adds up the whitened rows and
   their products, from which their covariance is compared with the identity.

The driver gets sums, one factor and counts (dimensions squared); no step holds more than a batch
and a factor.  A component's sign is such that its largest entry is positive.

Edge cases: vectors of unequal length are filled up with zeros to the longest; components whose
eigenvalue is not above rounding (vectors that fill fewer dimensions, a single vector, equal
vectors) are left out, so that fewer rows may come; vec_id may be null or repeated, each row is
returned; extra columns are ignored, whatever their names; an empty table gives an empty result.
A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

SCALE, COMPONENTS = 256, 4
#: Factors that one task merges.
FAN = 16
#: Of the largest eigenvalue: what is below it is taken for rounding.
TINY = 1e-24


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix of longs, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if (ends == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    of = np.repeat(np.arange(len(column)), ends)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


@dataclass(frozen=True)
class Fit:
    """n vectors with sums by dimension; components and eigenvalues, largest first; the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; as Python's numbers where longs don't hold them."""
        if float(self.n) * max(1.0, np.abs(x.astype(float)).max(initial=0)) + max(map(abs, self.sums), default=0) < 2.0**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        top = self.numerators(x)
        if float(np.abs(top.astype(float)).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return (top**2).sum(axis=1).tolist()
        exact = (top.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x).astype(float) / self.n) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def fit_list(vectors: DataFrame) -> DataFrame:
    """Each distinct whole-number vector of the usable vectors in column v."""
    return common.save(vectors.select("v").distinct(), "fit-list")


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            n += len(x)
            small = np.abs(x.astype(float)).max(initial=0) * max(1, len(x)) < 2.0**62
            total = total + (x if small else x.astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": range(-1, dims), "part": [str(n), *(str(int(t)) for t in total)]}, pa.schema([("dim", pa.int32()), ("part", pa.string())]))

    parts = common.map_batches(fit.select("v"), run, "dim int, part string")
    found = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factor(fit: DataFrame, n: int, sums: list[int], dims: int, fan: int) -> np.ndarray:
    """The triangular factor of all centred rows."""
    centre = Fit(n, sums, np.zeros((0, dims)), np.zeros(0), 0.0)

    def local(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            r = _triangle(np.concatenate([r, centre.numerators(x).astype(float) / n]))
            part = batch.column(0)[0].as_py() if batch.num_rows else 0
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": [part], "r": [r.ravel().tolist()]}, pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))]))

    def merged(key, table):  # FAN factors at most
        r = _triangle(np.concatenate([np.array(x).reshape(-1, dims) for x in table.column("r").to_pylist()]))
        return pa.table({"part": [key[0].as_py()], "r": [r.ravel().tolist()]}, pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))]))

    factors = common.save(common.map_batches(fit.select(F.spark_partition_id().cast("long").alias("part"), "v"), local, "part long, r array<double>"), "factors")
    while factors.limit(2).count() > 1:
        grouped = factors.select((F.col("part") / fan).cast("long").alias("part"), "r").groupBy("part")
        factors = common.save(grouped.applyInArrow(merged, "part long, r array<double>"), "factors")
    return np.array(factors.first()["r"]).reshape(-1, dims)


def fitted(fit: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> Fit | None:
    """The whitening of a fit list, None if it has no vector or no dimension."""
    dims = fit.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return None
    n, sums = _sums(fit, dims)
    _, values, right = np.linalg.svd(_factor(fit, n, sums, dims, fan), full_matrices=False)
    e = values**2 / n
    keep = (e > TINY * max(e[0], 0.0)) & (np.arange(len(e)) < components) if len(e) else np.zeros(0, bool)
    right = right[keep]
    largest = right[np.arange(len(right)), np.abs(right).argmax(axis=1)] if len(right) else np.zeros(0)
    return Fit(n, sums, right * np.sign(largest)[:, None], e[keep], float(e.sum()))


def identity_error(fit: DataFrame, found: Fit) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured in one pass."""
    k, dims = len(found.eigenvalues), len(found.sums)

    def run(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            w = found.whitened(_matrix(batch.column(0), dims))
            total += np.append(w.sum(axis=0), (w.T @ w).ravel())
        yield pa.RecordBatch.from_pydict({"at": list(range(len(total))), "part": total.tolist()}, pa.schema([("at", pa.int32()), ("part", pa.float64())]))

    parts = common.map_batches(fit.select("v"), run, "at int, part double")
    total = np.array([r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).orderBy("at").collect()]) / found.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max(initial=0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """For each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = embeddings.where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("v"))
    fit = fit_list(vectors)
    found = fitted(fit, components, fan)
    if found is None or not len(found.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], schema)
    error, dims, k = identity_error(fit, found), len(found.sums), len(found.eigenvalues)
    explained = found.eigenvalues / found.trace

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), found.n)),
                pa.array(found.deviations(x), pa.int64()).take(pa.array(rows)), pa.array(found.whitened(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return common.map_batches(vectors, run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
