"""Embedding whitening: principal components of whole-number vectors, scaled to unit variance.

Sums and covariance are gathered by Spark over the distinct vectors; only matrices of the vectors'
dimension go to the driver. Their eigenvectors are found in float32 and refined in higher precision
(``eigen.refined``). Vectors are then projected where they lie.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, parts, table
from .eigen import refined

SCALE, COMPONENTS = 256, 4
_SAFE = 1 << 62
_EXACT = pa.decimal128(38, 0)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of every entry as long."""
    return F.transform(vector, lambda c: F.floor(scale * c.cast("double")))


def usable(vector: Column) -> Column:
    """Vectors that are there and whose entries all are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & finite


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _greatest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _sums(fit: DataFrame) -> list[int]:
    """The exact sum of every dimension."""
    def add(batches):
        total = None
        for batch in parts(batches, 4096):
            x = _matrix(batch)
            x = x.sum(axis=0) if _greatest(x) * len(x) < _SAFE else x.astype(object).sum(axis=0)
            total = x.astype(object) if total is None else total + x
        if total is not None:
            yield pa.record_batch({"dim": pa.array(np.arange(len(total)), pa.int32()),
                                   "s": pa.array([Decimal(int(t)) for t in total], _EXACT)})

    rows = fit.mapInArrow(add, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s")).collect()
    return [int(s) for _, s in sorted(rows)]


class _Centred:
    """x - S/n as doubles: the whole part of S/n is taken off exactly, the rest in floating point."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        safe = _greatest(x) < _SAFE and _greatest(self.whole) < _SAFE
        near = x - self.whole if safe else x.astype(float) - self.whole.astype(float)
        return near.astype(float) - self.rest


def _moments(fit: DataFrame, n: int, vectors) -> np.ndarray:
    """The covariance, divisor n, of ``vectors`` (matrix of x to centred rows) over the fit list."""
    def gather(batches):
        total = None
        for batch in parts(batches, 4096):
            c = vectors(_matrix(batch))
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                   "v": pa.array(total[i, j], pa.float64())})

    cells = (fit.mapInArrow(gather, "i int, j int, v double").groupBy("i", "j")
             .agg(F.sum("v").alias("v")).toPandas())
    out = np.zeros((cells["i"].max() + 1,) * 2)
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["v"] / n
    return out


def whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE,
              column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row.

    Rows whose vector is null or has a null or non-finite entry are dropped. The others are fitted as
    distinct whole-number vectors, and all, repeated ones and those with a null vec_id too, are
    projected. Components come by falling eigenvalue; those without variance (equal vectors, one
    vector, dimensions that depend on others) are left out, as they cannot be scaled, so there
    may be no rows at all, as for an empty table. Entries beyond the longs are held to their limits.
    ``deviation`` is exact and a decimal. Vectors of unequal length raise ValueError.
    Other columns are not read.
    """
    schema = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    store = Store(rows.sparkSession, "whitening")
    vector = F.col(column)
    whole = rows.filter(usable(vector)).select("vec_id", whole_numbers(vector, scale).alias("x"))
    fit = store.keep(whole.select("x").distinct())
    n, least, most = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors of unequal length, {least} to {most}")
    if not n or not most:
        return rows.sparkSession.createDataFrame([], schema)
    sums = _sums(fit)
    centred = _Centred(n, sums)
    covariance = _moments(fit, n, centred)
    trace = float(np.trace(covariance))
    values, axes = refined(covariance)
    kept = [k for k in range(min(components, len(values))) if values[k] > len(values) * 1e-14 * trace]
    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    onto = axes[:, kept] / np.sqrt(values[kept])
    error = float(np.abs(_moments(fit, n, lambda x: centred(x) @ onto) - np.eye(len(kept))).max())
    explained = values[kept] / trace

    def project(batches):
        exact, wide = np.array(sums, object), max(map(abs, sums))
        for batch in parts(batches, 1024):
            x = _matrix(batch)
            # the square sum of all dimensions must fit, else it is taken in whole numbers of any size
            if x.shape[1] * (_greatest(x) * n + wide) ** 2 < _SAFE:
                deviation = ((x * n - exact.astype(np.int64)) ** 2).sum(axis=1)
            else:
                deviation = ((x.astype(object) * n - exact) ** 2).sum(axis=1)
            z, k = centred(x) @ onto, len(kept)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(len(x) * k, n), pa.int64()),
                "deviation": pa.array([Decimal(int(d)) for d in deviation for _ in kept], _EXACT),
                "whitened": z.ravel(), "explained": np.tile(explained, len(x)),
                "identity_error": np.full(len(x) * k, error)})

    return whole.mapInArrow(project, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
