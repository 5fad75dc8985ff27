"""Drift that brings rows of different times together: the overlap of all close pairs is made as large as it gets.

Every pair of rows of different time windows within ``most`` of each other adds exp(-d^2 / (4 s^2)) / s, where d is their
distance after the drift of their windows was taken off. The pairs are found once and written; the overlap and its gradient at
a given drift are one aggregate over them, with a row a window as result, so the driver holds as many numbers
as there are windows. The width s goes from a third of ``most`` down to ``target``, by 1.5 each time, and each
step starts from the one before. The drift of the first window, which the overlap leaves open, is set to zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .joins import cell_pairs
from .storage import cut


def time_windows(df: DataFrame, width: int, frame: str = "frame") -> DataFrame:
    """``df`` with window: numbers of so many frames each, from its first frame."""
    first = df.agg(F.min(frame).alias("__first"))  # one row
    return df.crossJoin(F.broadcast(first)).withColumn("window", F.floor((F.col(frame) - F.col("__first")) / width).cast("long")).drop("__first")


def drift_pairs(df: DataFrame, most: float, axes: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(wa, wb, dx, dy) of all pairs within ``most`` whose windows (wa < wb) differ."""
    rows = df.select(row, *axes, "window")
    pairs = cell_pairs(rows, rows.withColumnRenamed("window", "w"), most, xy=axes, row=row)
    pairs = pairs.where(F.col("a_window") < F.col("b_w"))
    d = [(F.col(f"b_{a}") - F.col(f"a_{a}")) for a in axes]
    return pairs.select(F.col("a_window").alias("wa"), F.col("b_w").alias("wb"), d[0].alias("dx"), d[1].alias("dy"))


def shifts_of(drift: np.ndarray, window: Column) -> list[Column]:
    """The drift of a window, looked up in literals: as many as there are windows."""
    return [F.element_at(F.array(*[F.lit(float(v)) for v in drift[:, k]]), window.cast("int") + 1) for k in range(drift.shape[1])]


def overlap(pairs: DataFrame, drift: np.ndarray, sigma: float) -> DataFrame:
    """(window, value, gx, gy): each window's half of the overlap of its pairs, and the gradient by its drift."""
    a, b = shifts_of(drift, F.col("wa")), shifts_of(drift, F.col("wb"))
    moved = pairs.select("wa", "wb", *[(F.col(n) - b[k] + a[k]).alias(n) for k, n in enumerate(("dx", "dy"))])
    v = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (4 * sigma * sigma)) / sigma
    pull = moved.select("wa", "wb", v.alias("v"), *[(v * F.col(n) / (2 * sigma * sigma)).alias(g) for n, g in (("dx", "gx"), ("dy", "gy"))])
    # By both windows first, so that what is dealt are sums and not pairs.
    sums = pull.groupBy("wa", "wb").agg(*[F.sum(c).alias(c) for c in ("v", "gx", "gy")])
    sides = F.explode(F.array(*[F.struct(F.col(w).alias("window"), (F.col("v") / 2).alias("value"), (s * F.col("gx")).alias("gx"), (s * F.col("gy")).alias("gy")) for w, s in (("wa", -1), ("wb", 1))])).alias("s")
    return sums.select(sides).select("s.*").groupBy("window").agg(*[F.sum(c).alias(c) for c in ("value", "gx", "gy")])


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a step that shrinks until the value falls enough."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            k = s @ way / (s @ y)
            way -= k * y
            kept.append(k)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(np.abs(slope).max(), 1e-300)
        for (s, y), k in zip(past, reversed(kept), strict=True):
            way += s * (k - y @ way / (s @ y))
        step, falls = 1.0, slope @ way
        if falls <= 0:
            break
        while True:
            there = x - step * way
            new, new_slope = f(there)
            if new <= value - 1e-4 * step * falls or step < 1e-6:
                break
            step /= 2
        if new >= value:
            break
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - new <= tolerance * max(abs(value), abs(new))
        x, value, slope = there, new, new_slope
        if done:
            break
    return x


def widths(most: float, target: float) -> list[float]:
    out = [most / 3]
    while out[-1] > target:
        out.append(max(out[-1] / 1.5, target))
    return out


def overlap_drift(df: DataFrame, width: int, most: float, target: float, axes: tuple[str, str] = ("x_nm", "y_nm"), frame: str = "frame", row: str = "row_id") -> np.ndarray:
    """(window, 2) drift of time windows of ``width`` frames; windows without pairs stay where the others' mean is."""
    rows = time_windows(df.where(N.finite(axes[0]) & N.finite(axes[1])), width, frame)
    last = rows.agg(F.max("window")).first()[0]
    if last is None:
        return np.zeros((0, 2))
    n, pairs = int(last) + 1, cut(drift_pairs(rows, most, axes, row))

    def cost(sigma: float):
        def f(x: np.ndarray) -> tuple[float, np.ndarray]:
            got = overlap(pairs, x.reshape(n, 2), sigma).collect()  # a row a window
            slope = np.zeros((n, 2))
            for r in got:
                slope[r["window"]] = r["gx"], r["gy"]
            return -sum(r["value"] for r in got), -slope.ravel()

        return f

    x = np.zeros(2 * n)
    for sigma in widths(most, target):
        x = minimise(cost(sigma), x)
    out = x.reshape(n, 2)
    return out - out[0]


def drift_curve(df: DataFrame, drift: np.ndarray, width: int, axes: tuple[str, str] = ("x_nm", "y_nm"), frame: str = "frame") -> DataFrame:
    """(frame, d_<axis>) of every frame from the first to the last: a natural cubic spline through the windows' middles.

    Before the first middle and after the last the curve goes on straight. The knots are literals, one a window.
    """
    ends = df.agg(F.min(frame).alias("lo"), F.max(frame).alias("hi")).first()
    spark, n = df.sparkSession, len(drift)
    if ends["lo"] is None:
        return spark.createDataFrame([], ", ".join([f"{frame} long", *(f"d_{a} double" for a in axes)]))
    bend = np.zeros_like(drift)
    if n > 2:
        m = 4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)
        bend[1:-1] = np.linalg.solve(m, 6 * np.diff(drift, 2, axis=0))
    at = (F.col(frame) - ends["lo"] - (width - 1) / 2) / width
    k = F.greatest(F.least(F.floor(at), F.lit(n - 2)), F.lit(0)).cast("int")
    u = at - k
    frames = spark.range(ends["lo"], ends["hi"] + 1).withColumnRenamed("id", frame)
    cols = []
    for j, a in enumerate(axes):
        value = lambda z, i, j=j: F.element_at(F.array(*[F.lit(float(v)) for v in z[:, j]]), F.least(i, F.lit(n - 1)) + 1)
        p, q, bp, bq = value(drift, k), value(drift, k + 1), value(bend, k), value(bend, k + 1)
        if n == 1:
            cols.append(p.alias(f"d_{a}"))
            continue
        inner = (1 - u) * p + u * q + ((F.pow(1 - u, 3) - (1 - u)) * bp + (F.pow(u, 3) - u) * bq) / 6
        early = p + u * (q - p - (2 * bp + bq) / 6)
        late = q + (u - 1) * (q - p + (bp + 2 * bq) / 6)
        cols.append(F.when(u < 0, early).when(u > 1, late).otherwise(inner).alias(f"d_{a}"))
    return frames.select(frame, *cols)
