"""Bounds of a quality measure from its histogram, and the decay of rows over frames.

What is counted are rows by bin or frame window, in Spark; the curves that come of it have as many points as bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .aggregate import truncated_mean_scale
from .phase import quantile

#: Rows below which nothing is fitted; times the acquisition beyond which a decay is none. Fixed values.
LEAST_ROWS, NO_DECAY = 20, 10.0


@dataclass
class Valley:
    """The fullest place, the bound above it, and whether a second rise made that a valley."""

    peak: float
    bound: float
    valley: bool


def smooth(counts: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over four deviations, the ends mirrored."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(counts.astype(float), reach, mode="symmetric") if len(counts) else counts
    return np.convolve(padded, w / w.sum(), "valid")


def upper_valley(df: DataFrame, column: str, bins: int = 120, sigma: float = 2.0, tail: float = 0.05) -> Valley:
    """The upper bound of single molecules: the least place of the smoothed histogram between its peak and twice that, if it rises after it.

    The histogram is of the positive finite values up to their 99.5th percentile. Without a rise the bound is where it first falls to
    ``tail`` of the peak, or else the percentile; with fewer than 20 values all is NaN.
    """
    x = N.double(column)
    known = df.where(N.finite(column) & (x > 0))
    if known.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return Valley(math.nan, math.nan, False)
    top = quantile(known, x, 0.995)
    at = F.least(F.floor(x / (top / bins)), F.lit(bins - 1)).cast("int")
    counts = np.zeros(bins)
    for r in known.where(x <= top).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row a bin
        counts[r["b"]] = r["n"]
    s, middle = smooth(counts, sigma), (np.arange(bins) + 0.5) * top / bins
    j = int(s.argmax())
    inside = np.flatnonzero((middle > middle[j]) & (middle <= 2 * middle[j]))
    if not len(inside):
        return Valley(float(middle[j]), top, False)
    k = int(inside[s[inside].argmin()])
    after = s[k : min(bins, 2 * j + 2)]
    if len(after) > 2 and after.max() > 1.2 * s[k] + 1.0:
        return Valley(float(middle[j]), float(middle[k]), True)
    low = np.flatnonzero((middle > middle[j]) & (s <= tail * s[j]))
    return Valley(float(middle[j]), float(middle[low[0]]) if len(low) else top, False)


def frame_decay(df: DataFrame, frame: str = "frame", first: float | None = None, last: float | None = None) -> dict[str, float]:
    """n, first, last, median_frame, first_rate and last_rate (rows a frame in the first and last tenth) and decay_frames.

    The decay is the maximum-likelihood scale of an exponential cut off at both ends: infinite beyond ten times the acquisition, NaN with
    fewer than 20 rows.
    """
    rows = df.where(N.finite(frame)).select(N.double(frame).alias("f"))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).first()
    if not ends["n"]:
        return {"n": 0} | dict.fromkeys(("first", "last", "median_frame", "first_rate", "last_rate", "decay_frames"), math.nan)
    lo, hi = (float(ends["lo"]) if first is None else first), (float(ends["hi"]) if last is None else last)
    span = max(hi - lo, 1.0)
    tenth = span / 10
    part = rows.agg(*[F.sum(c.cast("int")).alias(k) for k, c in (("a", F.col("f") < lo + tenth), ("b", F.col("f") > hi - tenth))], F.avg(F.when(F.col("f").between(lo, hi), F.col("f"))).alias("m")).first()
    decay = truncated_mean_scale(part["m"], lo, hi) if ends["n"] >= LEAST_ROWS and part["m"] is not None else math.nan
    return {
        "n": ends["n"], "first": lo, "last": hi, "median_frame": quantile(rows, F.col("f")), "first_rate": part["a"] / tenth, "last_rate": part["b"] / tenth,
        "decay_frames": math.inf if decay > NO_DECAY * span else decay,
    }
