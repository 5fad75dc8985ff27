"""Spatial statistics, precision, resolution and comparison with a truth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from . import aggregate as A
from .blocks import histogram
from .graph import assign_sparse, connected_components, cut
from .joins import cell_pairs, pair_histogram

XY = ("x_nm", "y_nm")


def pair_correlation(a: DataFrame, b: DataFrame, r_max: float, dr: float, area: float, same: bool = False, **of) -> DataFrame:
    """(bin, r, n, g, k, l): pair correlation, Ripley's K and L(r) - r for a window of the given area.

    Edge effects are left to the window that the caller has chosen.
    """
    na, nb = a.count(), b.count()
    density = (nb - (1 if same else 0)) / area
    h = pair_histogram(a, b, r_max, dr, same, **of)
    bins = a.sparkSession.range(math.ceil(r_max / dr)).withColumnRenamed("id", "bin").join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    ring = math.pi * dr * dr * (2 * F.col("bin") + 1)
    from pyspark.sql import Window

    k = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / (na * density)  # bins are few
    return bins.select("bin", ((F.col("bin") + 0.5) * dr).alias("r"), "n", (F.col("n") / (na * density * ring)).alias("g"), k.alias("k"), (F.sqrt(k / math.pi) - (F.col("bin") + 1) * dr).alias("l"))


def random_like(df: DataFrame, box: tuple[float, float, float, float], simulations: int, seed: int = 0, xy: tuple[str, str] = XY) -> DataFrame:
    """As many uniform rows as ``df`` in each of several simulations (column sim), from a seeded hash."""
    x0, y0, x1, y1 = box
    u = lambda k: F.pmod(F.xxhash64("row_id", "sim", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)
    rows = df.sparkSession.range(df.count() * simulations).select((F.col("id") % F.lit(max(1, df.count()))).alias("row_id"), F.floor(F.col("id") / max(1, df.count())).cast("int").alias("sim"))
    return rows.select("sim", (F.col("sim") * F.lit(1 << 40) + F.col("row_id")).alias("row_id"), (u(1) * (x1 - x0) + x0).alias(xy[0]), (u(2) * (y1 - y0) + y0).alias(xy[1]))


def envelope(df: DataFrame, box: tuple[float, float, float, float], r_max: float, dr: float, simulations: int, seed: int = 0) -> DataFrame:
    """(bin, low, high): least and largest pair counts by distance over random tables."""
    r = random_like(df, box, simulations, seed)
    h = histogram(r, r, r_max, dr, True, ("sim",))
    return h.groupBy("bin").agg(F.when(F.count(F.lit(1)) < simulations, 0).otherwise(F.min("n")).alias("low"), F.max("n").alias("high"))


def displacement_pairs(df: DataFrame, d_max: float, gaps: int = 1, frame: str = "frame", row: str = "row_id") -> DataFrame:
    """(gap, d): distances of rows one to ``gaps`` frames apart: repeats of one emitter, over a background."""
    from .joins import lag_pairs

    return lag_pairs(df, d_max, gaps - 1, frame, row=row).select(F.col("lag").alias("gap"), "d")


def nearest_precision(df: DataFrame, d_max: float, bins: int = 60, frame: str = "frame", row: str = "row_id") -> float:
    """Localization precision from distances between neighbouring frames.

    Their histogram is fitted by the law of two readings of one place and a background that grows with distance.
    """
    h = displacement_pairs(df, d_max, 1, frame, row).groupBy(F.least(F.floor(F.col("d") / (d_max / bins)), F.lit(bins - 1)).cast("int").alias("b")).count().toPandas()
    n = np.zeros(bins)
    n[h["b"]] = h["count"]
    r = (np.arange(bins) + 0.5) * d_max / bins
    best = (np.inf, math.nan)
    for s in np.geomspace(d_max / 200, d_max / 2, 400):
        m = np.stack([r / (2 * s * s) * np.exp(-r * r / (4 * s * s)), r], 1)
        c, *_ = np.linalg.lstsq(m, n, rcond=None)
        e = float(((m @ np.maximum(c, 0) - n) ** 2).sum())
        best = min(best, (e, float(s)))
    return best[1] if n.sum() else math.nan


def ring_correlation(df: DataFrame, half: str, size: float, x0: float, y0: float, n: int, xy: tuple[str, str] = XY) -> np.ndarray:
    """Fourier ring correlation (one value a ring) of the images of rows with half = 0 and 1."""
    a, b = (A.dense_image(A.pixels(df.where(F.col(half) == k), *xy, x0, y0, size, n, n), n, n) for k in (0, 1))
    w = np.hanning(n)[:, None] * np.hanning(n)
    p, q = np.fft.fft2(a * w), np.fft.fft2(b * w)
    f = np.fft.fftfreq(n) * n
    ring = np.rint(np.hypot(f[:, None], f)).astype(int)
    total = lambda v: np.bincount(ring.ravel(), v.ravel())[: n // 2]
    return total((p * np.conj(q)).real) / np.sqrt(np.maximum(total(np.abs(p) ** 2) * total(np.abs(q) ** 2), 1e-300))


def resolution(curve: np.ndarray, size: float, threshold: float = 1 / 7) -> float:
    """Length at which the ring correlation first falls below the threshold."""
    n = 2 * len(curve)
    for i in range(1, len(curve)):
        if curve[i] < threshold <= curve[i - 1]:
            at = i - 1 + (curve[i - 1] - threshold) / (curve[i - 1] - curve[i])
            return n * size / at
    return math.nan


# Truth ------------------------------------------------------------------------------------------------------


def matched(found: DataFrame, truth: DataFrame, radius: float, method: str = "optimal", frame: str = "frame", row: str = "row_id") -> DataFrame:
    """(found, truth, d) one to one within a frame: of least total distance, or greedily the nearest first.

    Pairs in reach fall apart in components, each of which is matched by itself, in memory that grows with its pairs.
    """
    pairs = cut(cell_pairs(found, truth, radius, keys=(frame,), row=row).select(F.col(f"a_{row}").alias("found"), F.col(f"b_{row}").alias("truth"), "d"))
    ends = pairs.select((F.col("found") * 2).alias("a"), (F.col("truth") * 2 + 1).alias("b"))
    parts = connected_components(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct(), ends, "node")
    e = pairs.join(parts.select(F.expr("node div 2").alias("found"), "component", (F.col("node") % 2).alias("k")).where("k = 0").drop("k"), "found")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if method == "greedy":
            a, b, out = set(), set(), []
            for r in pdf.sort_values(["d", "found", "truth"]).itertuples():
                if r.found not in a and r.truth not in b:
                    a.add(r.found), b.add(r.truth), out.append((r.found, r.truth, r.d))
            return pd.DataFrame(out, columns=["found", "truth", "d"])
        i, ii = np.unique(pdf["found"], return_inverse=True)
        j, jj = np.unique(pdf["truth"], return_inverse=True)
        far = radius * (min(len(i), len(j)) + 1) + 1.0
        sides = (jj, ii) if len(i) > len(j) else (ii, jj)
        d = pdf["d"].to_numpy()
        ok = assign_sparse(*sides, d, far)
        return pd.DataFrame({"found": i[ii[ok]], "truth": j[jj[ok]], "d": d[ok]})

    return e.groupBy("component").applyInPandas(run, "found long, truth long, d double")


def detection(found: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, recall, correct (precision), Jaccard and root mean square distance, in one row."""
    n = pairs.agg(F.count(F.lit(1)).alias("tp"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    both = n.crossJoin(found.agg(F.count(F.lit(1)).alias("nf"))).crossJoin(truth.agg(F.count(F.lit(1)).alias("nt")))  # one row each
    tp, nf, nt = map(F.col, ("tp", "nf", "nt"))
    return both.select("tp", (nf - tp).alias("fp"), (nt - tp).alias("fn"), F.try_divide(tp, nt).alias("recall"), F.try_divide(tp, nf).alias("correct"), F.try_divide(tp, nf + nt - tp).alias("jaccard"), "rmse")


def errors(pairs: DataFrame, found: DataFrame, truth: DataFrame, axes: tuple[str, ...] = XY, row: str = "row_id") -> DataFrame:
    """(axis, bias, rmse, slope) of matched positions."""
    both = pairs.join(found.select(F.col(row).alias("found"), *[F.col(a).alias(f"f_{a}") for a in axes]), "found").join(truth.select(F.col(row).alias("truth"), *[F.col(a).alias(f"t_{a}") for a in axes]), "truth")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), N.double(f"f_{a}").alias("f"), N.double(f"t_{a}").alias("t")) for a in axes])).alias("r")).select("r.*")
    return long.groupBy("axis").agg(F.avg(F.col("f") - F.col("t")).alias("bias"), F.sqrt(F.avg(F.pow(F.col("f") - F.col("t"), 2))).alias("rmse"), F.regr_slope("f", "t").alias("slope"))


# Shapes in data ---------------------------------------------------------------------------------------------


def circles(df: DataFrame, key: str, rounds: int = 10, xy: tuple[str, str] = XY) -> DataFrame:
    """(key, cx, cy, radius, n): a circle through the rows of each region, refitted with weights against outliers."""
    x, y = xy

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        ok = np.isfinite(u) & np.isfinite(v)
        u, v = u[ok], v[ok]
        c = (np.nan,) * 3
        if len(u) >= 3:
            mu, mv, w = u.mean(), v.mean(), np.ones(len(u))
            a, b = u - mu, v - mv
            for _ in range(rounds):
                s, *_ = np.linalg.lstsq(np.stack([2 * a, 2 * b, np.ones(len(a))], 1) * w[:, None], (a * a + b * b) * w, rcond=None)
                r = math.sqrt(max(s[2] + s[0] ** 2 + s[1] ** 2, 0))
                e = np.hypot(a - s[0], b - s[1]) - r
                scale = 1.4826 * np.median(np.abs(e)) + 1e-12
                w = 1 / np.sqrt(1 + (e / (2 * scale)) ** 2)
            c = (s[0] + mu, s[1] + mv, r)
        return pd.DataFrame([(pdf[key].iloc[0], *c, len(u))], columns=[key, "cx", "cy", "radius", "n"])

    return df.select(key, *xy).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, cx double, cy double, radius double, n long")


def line_profile(df: DataFrame, a: tuple[float, float], b: tuple[float, float], width: float, bin_nm: float, xy: tuple[str, str] = XY) -> DataFrame:
    """(bin, n): rows within ``width`` of a line, by their place across it."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = math.hypot(dx, dy)
    u, v = N.double(xy[0]) - a[0], N.double(xy[1]) - a[1]
    along, across = (u * dx + v * dy) / length, (v * dx - u * dy) / length
    rows = df.where((along >= 0) & (along <= length) & (F.abs(across) <= width / 2))
    return rows.groupBy(F.floor(across / bin_nm).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mixtures(df: DataFrame, key: str, most: int = 4, least: int = 5, rounds: int = 60, xy: tuple[str, str] = XY) -> DataFrame:
    """(key, molecule, x, y, sigma, n): round Gaussian mixtures of each cluster; the number by information criterion."""
    x, y = xy

    def fit(p: np.ndarray, m: int):
        c = p[np.argsort(p[:, 0] + 1e-3 * p[:, 1], kind="stable")[((np.arange(m) + 0.5) / m * len(p)).astype(int)]].copy()
        s, w = np.full(m, p.var() / m + 1e-9), np.full(m, 1 / m)
        for _ in range(rounds):
            d = ((p[:, None] - c) ** 2).sum(2)
            lg = np.log(w) - np.log(2 * np.pi * s) - d / (2 * s)
            top = lg.max(1, keepdims=True)
            r = np.exp(lg - top)
            total = r.sum(1, keepdims=True)
            ll = float((np.log(total) + top).sum())
            r /= total
            n = r.sum(0) + 1e-12
            w, c = n / n.sum(), (r.T @ p) / n[:, None]
            s = np.maximum((r * ((p[:, None] - c) ** 2).sum(2)).sum(0) / (2 * n), 1e-6)
        return -2 * ll + (4 * m - 1) * math.log(len(p)), c, np.sqrt(s), r

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[x, y]].to_numpy(float)
        best = min((fit(p, m) for m in range(1, max(1, min(most, len(p) // least)) + 1)), key=lambda f: f[0])
        n = np.bincount(best[3].argmax(1), minlength=len(best[1]))
        return pd.DataFrame({key: pdf[key].iloc[0], "molecule": range(len(n)), "x": best[1][:, 0], "y": best[1][:, 1], "sigma": best[2], "n": n})

    return df.where(F.col(key) >= 0).select(key, *xy).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, molecule int, x double, y double, sigma double, n long")


def centres(df: DataFrame, key: str = "cluster_id", gap: int = 3, frame: str = "frame", xy: tuple[str, str] = XY, row: str = "row_id") -> DataFrame:
    """Plain mean, deviation and standard error of each cluster, its events (by frame gaps) and its frames."""
    from .windows import along

    rows = df.where(F.col(key) >= 0).withColumn("__new", F.when(F.col(frame) - F.lag(frame).over(along(key, frame, row)) > gap, 1).otherwise(0))
    out = [F.count(F.lit(1)).alias("n_locs"), (F.sum("__new") + 1).alias("n_events"), F.avg(frame).alias("frame_mean"), N.filled(F.stddev_samp(frame)).alias("frame_std")]
    for a in xy:
        out += [F.avg(a).alias(a), N.filled(F.stddev_samp(a)).alias(f"{a}_std"), N.filled(F.stddev_samp(a) / F.sqrt(F.count(F.lit(1)))).alias(f"{a}_sem")]
    return rows.groupBy(key).agg(*out)
