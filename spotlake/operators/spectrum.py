"""The spectrum of diffusion coefficients: how the jumps of tracks share out over a grid, without a number of states.

Tracks are cut into pieces of at most ``split`` jumps. A piece's jumps are normal in each axis, with the variance 2 D t of their time and
the errors of their two places, of which neighbours share one; its likelihood at every D of the grid is one pass
along the piece. The occupations of the grid come from variational Bayes with a flat prior: a round gives each piece to the
D's by likelihood and occupation, and its sum over all pieces, as long as the grid, is the next. The pieces' likelihoods
are written once; a round reads them in numpy batches and sends one row a task. Rounds are extrapolated, so few are needed.

A piece has at most split + 1 rows, so no track, however long, is gathered; its order alone is a window over the track.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .storage import cut


def grid(least: float = 1e-3, most: float = 1e2, points: int = 100) -> np.ndarray:
    return np.geomspace(least, most, points)


def pieces(df: DataFrame, track: str = "track_id", frame: str = "frame", xy: tuple[str, ...] = ("x_nm", "y_nm"), errors: tuple[str, ...] | None = None, split: int = 10, row: str = "row_id") -> DataFrame:
    """(track, piece, n_jumps, rows): the rows (at, row, frame, places, squared errors) of each piece, in order; two neighbours share a row.

    Rows without a track, a frame or a finite place are left out, an error that isn't finite is 0, and of rows with one frame the first counts.
    """
    ok = F.col(track).isNotNull() & F.col(frame).isNotNull()
    for c in xy:
        ok = ok & N.finite(c)
    square = lambda c: F.when(N.finite(c), N.double(c) * N.double(c)).otherwise(0.0)
    rows = df.where(ok).select(F.col(track).alias("track"), F.struct(F.col(frame).cast("long").alias("frame"), F.col(row).alias("row"), F.array(*[N.double(c) for c in xy]).alias("p"), F.array(*([square(c) for c in errors] if errors else [F.lit(0.0)] * len(xy))).alias("e")).alias("r"))
    rows = rows.groupBy("track", F.col("r.frame").alias("f")).agg(F.min("r").alias("r"))
    at = F.row_number().over(Window.partitionBy("track").orderBy("f")) - 1
    put = rows.withColumn("at", at).withColumn("own", F.floor(F.col("at") / split))
    ends = F.when((F.col("at") % split == 0) & (F.col("at") > 0), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))
    put = put.select("track", F.explode(ends).alias("piece"), F.struct("at", "r.*").alias("r"))
    found = put.groupBy("track", "piece").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return found.where(F.size("rows") > 1).select("track", "piece", (F.size("rows") - 1).alias("n_jumps"), "rows")


def log_likelihood(frames: np.ndarray, places: np.ndarray, errors: np.ndarray, dt: float, d: np.ndarray) -> np.ndarray:
    """(pieces, grid) of pieces of one length: frames (pieces, n), places and squared errors (pieces, n, axes), in units of ``d`` times seconds."""
    lag, jump = np.diff(frames, axis=1) * dt, np.diff(places, axis=1)
    total = np.zeros((len(frames), len(d)))
    for axis in range(places.shape[2]):
        noise = errors[:, 1:, axis] + errors[:, :-1, axis]
        v = 2 * d * lag[:, :1] + noise[:, :1]
        y = np.repeat(jump[:, :1, axis], len(d), 1)
        total -= 0.5 * (y * y / v + np.log(v) + math.log(2 * math.pi))
        for j in range(1, jump.shape[1]):
            share = -errors[:, j, axis][:, None] / v
            v = 2 * d * lag[:, j : j + 1] + noise[:, j : j + 1] + share * errors[:, j, axis][:, None]
            y = jump[:, j, axis][:, None] - share * y
            total -= 0.5 * (y * y / v + np.log(v) + math.log(2 * math.pi))
    return total


def likelihoods(found: DataFrame, dt: float, d: np.ndarray, unit: float = 1e-3) -> DataFrame:
    """(track, piece, n_jumps, lik): each piece's likelihood over the grid, 1 at its largest. ``unit``: of a place, in the roots of those of d."""

    def run(frames):
        for f in frames:
            out = np.zeros((len(f), len(d)))
            for n in f["n_jumps"].unique():
                at = np.flatnonzero(f["n_jumps"].to_numpy() == n)
                own = [f["rows"].iloc[i] for i in at]
                get = lambda k: np.array([[r[k] for r in rows] for rows in own])  # noqa: E731, B023
                out[at] = log_likelihood(get("frame").astype(float), get("p").astype(float) * unit, get("e").astype(float) * unit * unit, dt, d)
            lik = np.exp(out - out.max(1, keepdims=True)) if len(f) else out
            yield pd.DataFrame({"track": f["track"], "piece": f["piece"], "n_jumps": f["n_jumps"], "lik": list(lik)})

    kind = found.schema["track"].dataType.simpleString()
    return found.select("track", "piece", "n_jumps", "rows").mapInPandas(run, f"track {kind}, piece long, n_jumps int, lik array<double>")


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, of positive numbers."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        out -= np.where(x < 8, 1 / x, 0)
        x = np.where(x < 8, x + 1, x)
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def occupations(lik: DataFrame, points: int, prior: float = 1.0, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Parameters of the occupations' distribution (their shares are its mean) after at most ``rounds`` passes over the pieces."""
    weight = lik.agg(F.sum("n_jumps")).first()[0] or 0
    left = rounds

    def step(alpha: np.ndarray) -> np.ndarray:
        nonlocal left
        left -= 1
        e = np.exp(digamma(alpha) - digamma(alpha.sum()))

        def run(frames):
            total = np.zeros(points)
            for f in frames:
                if len(f):
                    m = np.array(f["lik"].tolist())
                    total += m.T @ (f["n_jumps"].to_numpy() / np.maximum(m @ e, 1e-300))
            yield pd.DataFrame({"i": range(points), "v": total})

        got = lik.select("n_jumps", "lik").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.full(points, prior)
        for r in got:
            out[r["i"]] += e[r["i"]] * r["v"]
        return out

    alpha = np.full(points, prior) + weight / points
    while left > 0:
        one = step(alpha)
        moved = np.abs(one / one.sum() - alpha / alpha.sum()).max()
        if moved < tolerance or left < 2:
            return one
        two = step(one)
        # Two steps tell where the way leads; it is followed as far as they agree, and one more step makes it a proper state.
        a, b = one - alpha, two - 2 * one + alpha
        far = max(1.0, math.sqrt((a @ a) / max(b @ b, 1e-300)))
        alpha = np.maximum(alpha + 2 * far * a + far * far * b, prior) if left > 0 else two
        alpha = np.maximum(alpha * (two.sum() / alpha.sum()), prior)
    return alpha


def spectrum(df: DataFrame, dt: float, d: np.ndarray | None = None, split: int = 10, prior: float = 1.0, rounds: int = 200, tolerance: float = 1e-6, unit: float = 1e-3, **names) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The grid, the share of the jumps at each of its points, and (track, piece, n_jumps, d_post), each piece's mean of log D as a D."""
    d = grid() if d is None else np.asarray(d, float)
    lik = cut(likelihoods(pieces(df, split=split, **names), dt, d, unit))
    alpha = occupations(lik, len(d), prior, rounds, tolerance)
    e = np.exp(digamma(alpha) - digamma(alpha.sum()))
    logs = np.log(d)

    def run(frames):
        for f in frames:
            m = np.array(f["lik"].tolist()).reshape(len(f), -1) * e if len(f) else np.zeros((0, len(d)))
            yield pd.DataFrame({"track": f["track"], "piece": f["piece"], "n_jumps": f["n_jumps"], "d_post": np.exp(m @ logs / np.maximum(m.sum(1), 1e-300))})

    kind = lik.schema["track"].dataType.simpleString()
    return d, alpha / alpha.sum(), lik.mapInPandas(run, f"track {kind}, piece long, n_jumps int, d_post double")


def peaks(d: np.ndarray, share: np.ndarray, least: float = 0.02) -> list[tuple[float, float]]:
    """(D, share) of each local maximum with its basin down to the minima beside it, of at least ``least``."""
    rising = np.diff(share) > 0
    cuts = [0, *(i + 1 for i in range(len(rising) - 1) if not rising[i] and rising[i + 1]), len(share)]
    basins = [(float(d[a + int(np.argmax(share[a:b]))]), float(share[a:b].sum())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [x for x in basins if x[1] >= least]
