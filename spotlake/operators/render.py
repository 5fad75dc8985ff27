"""Pixel tables: histograms, Gaussian splats, track lines, contrast and steps of a movie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .windows import along


def gaussian_splat(df: DataFrame, x0: float, y0: float, size: float, nx: int, ny: int, sigma: str, least: float = 0.0, weight: str | None = None, reach: float = 3.0, xy: tuple[str, str] = ("x_nm", "y_nm")) -> DataFrame:
    """(row, col, value): each row spread as a Gaussian of its own width, integrated over pixels and of sum one.

    Each task adds its rows to an image of the field (fixed size) and gives its pixels; Spark sums them.
    """
    from math import erf

    wide = np.vectorize(erf, otypes=[float])

    def run(batches):
        image = np.zeros((ny, nx))
        for pdf in batches:
            for x, y, s, w in pdf.itertuples(index=False):
                s = max(s, least) / size
                u, v = (x - x0) / size, (y - y0) / size
                if not (np.isfinite(u) and np.isfinite(v) and np.isfinite(s) and np.isfinite(w)):
                    continue
                h = int(np.ceil(reach * s)) + 1
                a, b = int(np.floor(u)) - h, int(np.floor(v)) - h
                k = np.arange(2 * h + 2)
                px, py = (np.diff(wide((o + k - p) / (max(s, 1e-6) * 2**0.5))) / 2 for o, p in ((a, u), (b, v)))
                px, py = px / px.sum(), py / py.sum()
                c, r = a + np.arange(len(px)), b + np.arange(len(py))
                i, j = (r >= 0) & (r < ny), (c >= 0) & (c < nx)
                image[np.ix_(r[i], c[j])] += w * py[i][:, None] * px[j]
        r, c = np.nonzero(image)
        yield pd.DataFrame({"row": r.astype(np.int32), "col": c.astype(np.int32), "value": image[r, c]})

    w = N.double(weight) if weight else F.lit(1.0)
    rows = df.select(N.double(xy[0]).alias("x"), N.double(xy[1]).alias("y"), N.double(sigma).alias("s"), w.alias("w"))
    return rows.mapInPandas(run, "row int, col int, value double").groupBy("row", "col").agg(F.sum("value").alias("value"))


def contrast(pixels: DataFrame, power: float, total: int) -> float:
    """Value above which 10^-power of all ``total`` pixels lie; pixels that aren't in the table are zero."""
    filled = pixels.count()
    share = 1 - 10.0**-power
    zero = (total - filled) / total
    if share <= zero or not filled:
        return 0.0
    return pixels.agg(F.percentile("value", (share - zero) / (1 - zero)).alias("v")).first()["v"]


def segments(df: DataFrame, key: str = "track_id", frame: str = "frame", row: str = "row_id") -> DataFrame:
    """(key, x0, y0, x1, y1): lines between rows that follow each other in a track."""
    w = along(key, frame, row)
    s = df.where(F.col(key) >= 0).select(key, F.col("x_nm").alias("x0"), F.col("y_nm").alias("y0"), F.lead("x_nm").over(w).alias("x1"), F.lead("y_nm").over(w).alias("y1"))
    return s.where("x1 is not null")


def movie_steps(df: DataFrame, column: str, first: float, last: float, step: float, window: float, cumulative: bool = False) -> DataFrame:
    """Rows with the number of each step (from 0) whose window holds them."""
    n = int((last - first) // step) + 1
    x = N.double(column)
    low = F.greatest(F.ceil((x - first - window) / step + 1e-9), F.lit(0)) if not cumulative else F.greatest(F.ceil((x - first - window) / step + 1e-9), F.lit(0))
    high = F.lit(n - 1) if cumulative else F.least(F.floor((x - first) / step), F.lit(n - 1))
    ok = N.finite(column) & (x >= first) & (low <= high)
    return df.where(ok).withColumn("step", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def colours(df: DataFrame, column: str, lo: float, hi: float, entries: int = 256) -> DataFrame:
    """Index from 0 of each value in a colour table."""
    at = F.floor((N.double(column) - lo) / (hi - lo) * entries)
    return df.withColumn("colour", F.greatest(F.lit(0), F.least(at, F.lit(entries - 1))).cast("int"))


def camera_noise(frames: DataFrame) -> DataFrame:
    """(y, x, mean, variance) of each pixel over dark frames (frame, y, x, adu)."""
    return frames.groupBy("y", "x").agg(F.avg("adu").alias("mean"), F.var_samp("adu").alias("variance"))


def photons(df: DataFrame, offset: float, gain: float, adu: str = "adu") -> DataFrame:
    return df.withColumn("photons", ((F.col(adu) - offset) * gain).cast("float"))


def peaks(frames: DataFrame, sigma: float, factor: float, height: int, width: int) -> DataFrame:
    """(frame, y, x, value): strict maxima of the 3 x 3 surroundings after a difference of Gaussians.

    ``frames``: (frame, image array<double> of height x width). The cut-off of a frame is the median of its
    maxima plus ``factor`` times (80 % - 20 %) / 0.6, or the mean times the factor below ten maxima.
    """

    def kernel(s):
        k = np.exp(-0.5 * (np.arange(-int(4 * s) - 1, int(4 * s) + 2) / s) ** 2)
        return k / k.sum()

    def blur(im, s):
        k = kernel(s)
        p = len(k) // 2
        for axis in (0, 1):
            pad = np.pad(im, [(p, p) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if min(im.shape) > p else "edge")
            im = np.apply_along_axis(np.convolve, axis, pad, k, "valid")
        return im

    def run(batches):
        for pdf in batches:
            out = []
            for f, image in zip(pdf["frame"], pdf["image"], strict=True):
                im = np.asarray(image, float).reshape(height, width)
                d = blur(im, sigma) - blur(im, 2.5 * sigma)
                around = np.stack([np.roll(np.roll(np.pad(d, 1, constant_values=np.inf), i, 0), j, 1)[1:-1, 1:-1] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
                y, x = np.nonzero((d[None] > around).all(0))
                v = d[y, x]
                if not len(v):
                    continue
                s = np.sort(v)
                q = lambda p, s=s: s[min(len(s) - 1, max(0, int(np.ceil(p * len(s))) - 1))]
                cutoff = q(0.5) + factor * (q(0.8) - q(0.2)) / 0.6 if len(s) >= 10 else s.mean() * factor
                keep = v > cutoff
                out += [(f, int(a), int(b), float(c)) for a, b, c in zip(y[keep], x[keep], v[keep], strict=True)]
            yield pd.DataFrame(out, columns=["frame", "y", "x", "value"])

    return frames.select("frame", "image").mapInPandas(run, "frame long, y int, x int, value double")


def lines_in_time(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("next", F.lead(order).over(Window.partitionBy(key).orderBy(order)))
