"""Pair statistics in a window of pixels, normalised by how much of the window each distance leaves in itself.

The window is a set of pixels. How many of its pixels lie at each lag from one another (its set covariance, as a raster)
is a join of the pixels with themselves moved; by lag it is as small as the reach. From it follow the pair
counts that chance alone would give in each ring, and so g, K and L - r without a correction at the edges. Simulations place as
many rows in the window's pixels, all at once with the simulation as a key; what comes back are their counts by ring.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .blocks import histogram
from .storage import cut, numbered

#: Directions over which the covariance is averaged.
ANGLES = 90


def lag_counts(pixels: DataFrame, reach: int) -> DataFrame:
    """(lx, ly, n): pairs of pixels of the window at each lag up to ``reach`` on both axes, itself included."""
    own = pixels.select("px", "py")
    by = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    moved = own.withColumn("lx", by).withColumn("ly", by).where((F.col("ly") > 0) | ((F.col("ly") == 0) & (F.col("lx") >= 0)))
    moved = moved.select((F.col("px") + F.col("lx")).alias("px"), (F.col("py") + F.col("ly")).alias("py"), "lx", "ly")
    half = moved.join(own, ["px", "py"]).groupBy("lx", "ly").agg(F.count(F.lit(1)).alias("n"))
    # The other half is the same by symmetry.
    return half.unionByName(half.where("lx <> 0 OR ly <> 0").select((-F.col("lx")).alias("lx"), (-F.col("ly")).alias("ly"), "n"))


def covariance(lags: np.ndarray, size: float, r: np.ndarray) -> np.ndarray:
    """Area that the window shares with itself moved by each distance, over all directions; ``lags``: counts, lag 0 in the middle."""
    reach = len(lags) // 2
    way = (np.arange(ANGLES) + 0.5) * math.pi / ANGLES
    x, y = (np.outer(np.asarray(r, float), f(way)) / size + reach for f in (np.cos, np.sin))
    i, j = (np.clip(np.floor(v).astype(int), 0, 2 * reach - 1) for v in (x, y))
    u, v = x - i, y - j
    got = lags[j, i] * (1 - u) * (1 - v) + lags[j, i + 1] * u * (1 - v) + lags[j + 1, i] * (1 - u) * v + lags[j + 1, i + 1] * u * v
    return np.maximum(got.mean(1), 0) * size * size


def lag_array(pixels: DataFrame, reach: int) -> np.ndarray:
    out = np.zeros((2 * reach + 1, 2 * reach + 1))
    for r in lag_counts(pixels, reach).collect():  # a row a lag
        out[r["ly"] + reach, r["lx"] + reach] = r["n"]
    return out


def expected_counts(lags: np.ndarray, size: float, pairs: float, r_max: float, dr: float) -> np.ndarray:
    """Ordered pairs that chance gives in each ring, of ``pairs`` in the window."""
    edges = dr * np.arange(int(round(r_max / dr)) + 1)
    area = lags[len(lags) // 2, len(lags) // 2] * size * size
    ring = math.pi * np.diff(edges**2)
    return pairs / area**2 * ring * covariance(lags, size, (edges[1:] + edges[:-1]) / 2) if area > 0 else np.zeros(len(ring))


def curves(counts: np.ndarray, expected: np.ndarray, dr: float) -> dict[str, np.ndarray]:
    """g, K and L - r at the middle of each ring; NaN where nothing is expected."""
    edges = dr * np.arange(len(counts) + 1)
    g = np.where(expected > 0, counts / np.where(expected > 0, expected, 1), np.nan)
    middle = (edges[1:] + edges[:-1]) / 2
    k = np.cumsum(g * math.pi * np.diff(edges**2)) - g * math.pi * (edges[1:] ** 2 - middle**2)
    return {"g": g, "K": k, "L_r": np.sqrt(np.maximum(k, 0) / math.pi) - middle}


def in_window(df: DataFrame, pixels: DataFrame, size: float, xy: tuple[str, str] = ("x_nm", "y_nm")) -> DataFrame:
    px, py = (F.floor(N.double(c) / size).cast("long") for c in xy)
    return df.withColumns({"__px": px, "__py": py}).join(pixels.select(F.col("px").alias("__px"), F.col("py").alias("__py")), ["__px", "__py"], "left_semi").select(*df.columns)


def uniform(pixels: DataFrame, size: float, rows: int, simulations: int, seed: int = 0) -> DataFrame:
    """(sim, row_id, x_nm, y_nm): so many places in the window's pixels in each simulation, from a seeded hash."""
    places = cut(numbered(pixels.select("px", "py"), "place", "py", "px"))
    n = places.count()
    u = lambda k: F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)
    all_rows = pixels.sparkSession.range(rows * simulations).withColumnRenamed("id", "row_id")
    all_rows = all_rows.select("row_id", F.floor(F.col("row_id") / max(rows, 1)).cast("int").alias("sim"), F.floor(u(1) * n).cast("long").alias("place"), u(2).alias("u"), u(3).alias("v"))
    return all_rows.join(places, "place").select("sim", "row_id", ((F.col("px") + F.col("u")) * size).alias("x_nm"), ((F.col("py") + F.col("v")) * size).alias("y_nm"))


def deviation_test(observed: np.ndarray, simulated: np.ndarray, use: np.ndarray, level: float = 0.95) -> dict[str, float]:
    """Largest deviation from the simulations' mean, against that of each simulation from the others' mean."""
    n = len(simulated)
    use = use & np.isfinite(observed) & np.isfinite(simulated).all(0)
    if n < 2 or not use.any():
        return {"p": math.nan, "T": math.nan, "T_crit": math.nan}
    mean = simulated.mean(0)
    own = np.abs(simulated - (n * mean - simulated) / (n - 1))[:, use].max(1)
    t = float(np.abs(observed - mean)[use].max())
    return {"p": (1 + int((own >= t).sum())) / (n + 1), "T": t, "T_crit": float(np.sort(own)[min(n, max(1, math.ceil(level * (n + 1)))) - 1])}


def pair_statistics(df: DataFrame, pixels: DataFrame, size: float, r_max: float, dr: float, simulations: int = 99, level: float = 0.95, r_min: float = 0.0, seed: int = 0) -> tuple[list[dict], dict[str, float]]:
    """By ring: r, counts, expected, g, K, L_r and the simulations' band of each; and the test of L - r from ``r_min`` on.

    Rows outside the window take no part; with fewer than two there is nothing to tell and the list is empty.
    """
    pixels = cut(pixels.select("px", "py").distinct())
    rows = cut(in_window(df, pixels, size))
    n, bins = rows.count(), int(round(r_max / dr))
    if n < 2:
        return [], deviation_test(np.zeros(0), np.zeros((0, 0)), np.zeros(0, bool))
    expected = expected_counts(lag_array(pixels, math.ceil(r_max / size) + 1), size, n * (n - 1.0), r_max, dr)
    counts = np.zeros(bins)
    for r in histogram(rows, rows, bins * dr, dr, True).collect():
        counts[min(r["bin"], bins - 1)] += r["n"]
    own, r = curves(counts, expected, dr), (np.arange(bins) + 0.5) * dr
    out = [{"r": float(r[i]), "n": float(counts[i]), "expected": float(expected[i])} | {k: float(v[i]) for k, v in own.items()} for i in range(bins)]
    if simulations < 1:
        return out, deviation_test(own["L_r"], np.zeros((0, bins)), r >= r_min)
    moved = cut(uniform(pixels, size, n, simulations, seed))
    found = np.zeros((simulations, bins))
    for x in histogram(moved, moved, bins * dr, dr, True, ("sim",)).collect():  # simulations by rings
        found[x["sim"], min(x["bin"], bins - 1)] += x["n"]
    sims = [curves(s, expected, dr) for s in found]
    for k in own:
        both = np.array([s[k] for s in sims])
        some = np.isfinite(both).any(0)
        for name, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2)):
            for i in range(bins):
                out[i][f"{k}_{name}"] = float(np.nanquantile(both[:, i], q)) if some[i] else math.nan
    return out, deviation_test(own["L_r"], np.array([s["L_r"] for s in sims]), r >= r_min, level)
