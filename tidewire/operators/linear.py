"""Linear baselines over flattened histories, fitted by sums that tasks make and merge in a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common.store import written

#: The most features of a model: sums of their products travel as one row.
MOST = 2_000
#: Least variance by which a feature is divided.
FLAT = 1e-12


def flattened(df: DataFrame, keys: list[str], t: str, tie: str, values: list[str], steps: int, name: str = "features") -> DataFrame:
    """``df`` with the values of a key's last ``steps`` rows up to this one, oldest first, as one array, and these rows' ages.

    Rows that are not there count as nought, with the age of the oldest that is. An age is log-compressed seconds, at most 0.
    """
    w = Window.partitionBy(*keys).orderBy(t, tie).rowsBetween(-(steps - 1), 0)
    rows = F.collect_list(F.struct(F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values]).alias("x"), F.col(t).alias("t"))).over(w)
    lack = F.lit(steps) - F.size("history")
    x = F.concat(F.array_repeat(F.lit(0.0), lack * len(values)), F.flatten(F.transform("history", lambda r: r["x"])))
    age = lambda r: -F.log1p(F.col(t) - r["t"])
    ages = F.concat(F.array_repeat(age(F.get("history", 0)), lack), F.transform("history", age))
    return df.withColumn("history", rows).withColumn(name, F.concat(x, ages)).drop("history")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column whose arrays are all of one length, as a table of doubles."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def merged(df: DataFrame, columns: list[str], of_batch: Callable[[pa.RecordBatch], tuple], merge: Callable[[tuple, tuple], tuple], widths: int) -> tuple | None:
    """One tuple of arrays from all rows: each task merges what its batches give, about the root of the number of shuffle partitions tasks
    merge these, and one task what they give.

    Results are merged as they come, so a task holds two. Only the last tuple, of ``widths`` arrays, reaches the driver; None if there are no rows.
    """
    schema = ", ".join(f"s{k} array<double>" for k in range(widths))
    kinds = [(f"s{k}", pa.list_(pa.float64())) for k in range(widths)]

    def out(total: tuple | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, dtype=np.float64).reshape(-1)], pa.list_(pa.float64())) for x in total], schema=pa.schema(kinds))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(batch)
                total = part if total is None else merge(total, part)
        yield from out(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                part = tuple(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(widths))
                total = part if total is None else merge(total, part)
        yield from out(total)

    between = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    parts = df.select(*columns).mapInArrow(first, schema)
    for tasks in (between, 1):
        parts = parts.repartition(tasks).mapInArrow(again, schema)
    found = parts.collect()  # one row
    return tuple(np.array(x) for x in found[0]) if found else None


def moments(df: DataFrame, name: str = "features") -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and sums of squared deviations of an array column of one length, merged pair by pair without loss (no sums of squares)."""

    def of_batch(batch: pa.RecordBatch) -> tuple:
        x = _matrix(batch, name)
        mean = x.mean(axis=0)
        return np.array([float(len(x))]), mean, ((x - mean) ** 2).sum(axis=0)

    def merge(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)

    found = merged(df, [name], of_batch, merge, 3)
    return (0.0, np.zeros(0), np.zeros(0)) if found is None else (float(found[0][0]), found[1], found[2])


@dataclass
class Model:
    """Coefficients of standardised features, the constant last, and what standardises them."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rounds: int

    def score(self, features: Column) -> Column:
        """The linear score of an array column, in built-in functions."""
        slope = self.weights[:-1] / self.scale
        constant = float(self.weights[-1] - slope @ self.mean)
        products = F.zip_with(features, F.array(*[F.lit(float(w)) for w in slope]), lambda x, w: x.cast("double") * w)
        return F.aggregate(products, F.lit(constant), lambda s, x: s + x)

    def probability(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-self.score(features)))


def _standard(df: DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    n, mean, m2 = moments(df, name)
    if len(mean) > MOST:
        raise ValueError(f"{len(mean)} features; {MOST} at most")
    return mean, np.sqrt(np.maximum(m2 / max(n, 2.0), FLAT))


def fit_logistic(df: DataFrame, label: str, name: str = "features", ridge: float = 1e-4, rounds: int = 25, tolerance: float = 1e-10) -> Model:
    """Logistic regression of a 0/1 label on standardised features, with ``ridge`` times half the squared coefficients on the mean loss.

    A row without label, a censored one, counts for the moments and not for the loss. A round is one pass: tasks add up
    gradients and curvatures, which are merged in a tree, and the driver takes Newton's step; no row leaves a task. Rounds end
    when no coefficient moves by more than ``tolerance``.
    """
    rows = written(df.select(F.col(name).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y")), "fit")
    mean, scale = _standard(rows, "x")
    weights = np.zeros(len(mean) + 1)
    known = rows.where("y is not null")
    for k in range(1, rounds + 1):
        now = weights

        def of_batch(batch: pa.RecordBatch, now: np.ndarray = now) -> tuple:
            x = np.hstack([(_matrix(batch, "x") - mean) / scale, np.ones((batch.num_rows, 1))])
            p = 1 / (1 + np.exp(-np.clip(x @ now, -500, 500)))
            return np.array([float(len(x))]), x.T @ (p - batch.column("y").to_numpy()), ((x.T * (p * (1 - p))) @ x).reshape(-1)

        found = merged(known, ["x", "y"], of_batch, lambda a, b: tuple(u + v for u, v in zip(a, b, strict=True)), 3)
        if found is None:
            return Model(mean, scale, weights, 0)
        penalty = np.append(np.full(len(mean), ridge), 0.0)
        slope = found[1] / found[0] + penalty * now
        curve = found[2].reshape(len(now), -1) / found[0] + np.diag(penalty + FLAT)
        step = np.linalg.solve(curve, slope)
        weights = now - step
        if np.abs(step).max() <= tolerance:
            break
    return Model(mean, scale, weights, k)


def fit_linear(df: DataFrame, target: str, name: str = "features", ridge: float = 0.0) -> Model:
    """Least squares of ``target`` on standardised features, with ``ridge`` times the squared coefficients on the mean; one pass and no rounds.

    A linear model of what comes next takes the change from the last value as target. Rows without target count for the moments alone.
    """
    rows = written(df.select(F.col(name).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")), "fit")
    mean, scale = _standard(rows, "x")

    def of_batch(batch: pa.RecordBatch) -> tuple:
        x = np.hstack([(_matrix(batch, "x") - mean) / scale, np.ones((batch.num_rows, 1))])
        return np.array([float(len(x))]), x.T @ batch.column("y").to_numpy(), (x.T @ x).reshape(-1)

    found = merged(rows.where("y is not null"), ["x", "y"], of_batch, lambda a, b: tuple(u + v for u, v in zip(a, b, strict=True)), 3)
    if found is None:
        return Model(mean, scale, np.zeros(len(mean) + 1), 0)
    penalty = np.append(np.full(len(mean), ridge), 0.0)
    return Model(mean, scale, np.linalg.solve(found[2].reshape(len(mean) + 1, -1) / found[0] + np.diag(penalty + FLAT), found[1] / found[0]), 1)
