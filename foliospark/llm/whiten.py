"""Embedding whitening from an exact fit over all rows.

Entries become integers, ``floor(scale * c) + shift``, so sums per dimension are exact and a row is centred exactly:
``n * x - S`` is an integer, divided by ``n`` once. ``RowMatrix.computeGramianMatrix`` over the centred rows, divided by
``n``, is the covariance. Its eigenvectors are found on the driver (one matrix of the vectors' width, whatever
the number of rows) and go to the tasks, which project each row in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import own_name

SCALE, SHIFT = 1024, 100_000
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    inner = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & inner, F.lit(False))


@dataclass(frozen=True)
class Fit:
    """``sums`` and ``n`` of the integer vectors; ``axes``, the kept eigenvectors as columns; ``values``, their eigenvalues;
    ``trace`` of the covariance. A component has no variance, and no whitened value, if its eigenvalue is ``floor`` at most.
    """

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def floor(self) -> float:
        return len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)


def integers(df: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows with a usable vector, and ``__x``, its entries as integers."""
    good = usable(F.col(f"`{vector}`"))
    entry = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * scale) + shift)
    return df.filter(good).withColumn("__x", F.when(good, entry))  # the condition goes along wherever Spark moves the entries


def _padded(x: str, missing: int, width: int) -> Column:
    """Entries beyond the end of a shorter vector are those of 0.0."""
    return F.when(F.size(x) == width, F.col(x)).otherwise(F.concat(F.col(x), F.array_repeat(F.lit(missing).cast("long"), F.lit(width) - F.size(x))))


def _centred(sums: list[int], n: int, shift: int) -> Column:
    """``n * x - S``, as integers."""
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    return F.zip_with(_padded("__x", shift, len(sums)), total, lambda x, s: x * n - s)


def fit(df: DataFrame, vector: str, components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """The fit over all usable rows of ``df``; None if there are none, or all are without entries."""
    rows = integers(df, vector, scale, shift).select("__x")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("__x"))).first()
    if not n or not width:
        return None
    found = rows.select(F.posexplode("__x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count("x").alias("k")).collect()  # one row a dimension
    by_place = {r["i"]: r["s"] + (n - r["k"]) * shift for r in found}
    sums = [by_place[i] for i in range(width)]
    over_n = F.transform(_centred(sums, n, shift), lambda d: d.cast("double") / F.lit(float(n)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(over_n).alias("v")), "v")
    covariance = RowMatrix(vectors).computeGramianMatrix().toArray() / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    heavy = axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]
    return Fit(n, sums, axes * np.where(heavy < 0, -1.0, 1.0), values[order], float(np.trace(covariance)))


def _weights(own: Fit) -> np.ndarray:
    """Columns that take a centred row to its whitened values; not-a-number where a component has no variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(own.values > own.floor, own.axes / np.sqrt(own.values), np.nan)


def _projected(rows: pd.Series, own: Fit, weights: np.ndarray) -> np.ndarray:
    deviations = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(own.sums)), np.int64)
    return (deviations / float(own.n)) @ weights


def identity_error(centred: DataFrame, own: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the components with variance;
    None if there is none. ``centred``: column ``__d``. A task sends sums of its rows, of the components' number squared.
    """
    keep = np.flatnonzero(own.values > own.floor)
    weights, k = _weights(own)[:, keep], len(keep)
    if not k:
        return None

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1) * k)
        for frame in frames:
            w = _projected(frame["__d"], own, weights)
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pd.DataFrame({"i": np.arange(len(total)), "m": total})

    parts = centred.mapInPandas(moments, "i int, m double").groupBy("i").agg(F.sum("m").alias("m")).collect()
    total = np.zeros((k + 1) * k)
    for r in parts:
        total[r["i"]] = r["m"] / own.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, key: str, vector: str, components: int = 8, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """For each row with a usable vector and each of the first ``components`` components, numbered from 1 by falling
    eigenvalue: ``key``, ``component``, ``n``, ``deviation`` (the exact sum over dimensions of ``(n * x - S) ** 2``, a decimal, as
    it outgrows a long at some 10**5 rows of wide entries), ``whitened``, ``explained`` and ``identity_error``.

    A null vector, or one with a null or non-finite entry, has no rows and no part in the fit. A shorter vector counts as filled up
    with 0.0. Vectors without entries, and empty tables, give no rows. Repeated rows count and come back each; a null key stays
    null. A component without variance has ``whitened`` null and is left out of ``identity_error``, which is null if none has any;
    ``explained`` is then null too if the whole table has no variance. There are at most as many components as dimensions.
    Eigenvectors of equal eigenvalues are any basis of their space; the largest entry of each is positive. Other columns are
    ignored; a key with the name of a result is an error. Entries must be small enough for ``n * x`` to fit a long.
    """
    own_name(key, RESULTS)
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    own = fit(df, vector, components, scale, shift)
    if own is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = integers(df, vector, scale, shift).select(F.col(f"`{key}`").alias("__key"), _centred(own.sums, own.n, shift).alias("__d"))
    error, weights, count = identity_error(rows.select("__d"), own), _weights(own), len(own.values)
    explained = own.values / own.trace if own.trace > 0 else np.full(count, np.nan)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            w = _projected(frame["__d"], own, weights)
            yield pd.DataFrame({"__key": frame["__key"].repeat(count), "__deviation": frame["__deviation"].repeat(count), "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(frame)), "whitened": w.ravel(), "explained": np.tile(explained, len(frame))})

    square = F.aggregate("__d", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    rows = rows.withColumn("__deviation", square)
    inner = T.StructType([T.StructField("__key", schema[key].dataType), T.StructField("__deviation", T.DecimalType(38, 0)), *[schema[c] for c in ("component", "whitened", "explained")]])
    found = rows.mapInPandas(project, inner)
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)
    return found.select(F.col("__key").alias(key), "component", F.lit(own.n).cast("long").alias("n"), F.col("__deviation").alias("deviation"), number("whitened"), number("explained"), F.lit(error).cast("double").alias("identity_error"))
