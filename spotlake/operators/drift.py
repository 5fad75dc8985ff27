"""Drift curves, transformations of positions and registration of layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nansafe as N
from . import aggregate as A


def apply_drift(df: DataFrame, curve: DataFrame, axes: tuple[str, ...] = ("x_nm", "y_nm"), frame: str = "frame", where: Column | None = None) -> DataFrame:
    """Positions less the curve (frame, d_<axis>) of their frame; a frame outside the curve is an error."""
    got = df.join(curve, frame, "left")
    rows = F.lit(True) if where is None else where
    fail = F.raise_error(F.concat(F.lit("no drift for frame "), F.col(frame).cast("string"))).cast("double")
    for a in axes:
        d = F.coalesce(F.col(f"d_{a}"), fail)
        got = got.withColumn(a, F.when(rows, F.col(a) - d).otherwise(F.col(a)))
    return got.select(*df.columns)


def referenced(curve: DataFrame, at: str = "first", axes: tuple[str, ...] = ("x_nm", "y_nm"), frame: str = "frame") -> DataFrame:
    """The curve moved so that it is zero at its first (last) frame."""
    pick = F.min_by if at == "first" else F.max_by
    zero = curve.agg(*[pick(f"d_{a}", frame).alias(a) for a in axes]).first()
    return curve.withColumns({f"d_{a}": F.col(f"d_{a}") - F.lit(zero[a]) for a in axes})


class Transformation:
    """x, y by an affine (2 x 3), projective (3 x 3) or polynomial map (coefficients by power of x and y)."""

    def __init__(self, kind: str, coefficients):
        self.kind, self.c = kind, np.asarray(coefficients, float)

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        c = self.c
        if self.kind == "affine":
            return x * c[0, 0] + y * c[0, 1] + c[0, 2], x * c[1, 0] + y * c[1, 1] + c[1, 2]
        if self.kind == "projective":
            w = x * c[2, 0] + y * c[2, 1] + c[2, 2]
            return N.divide(x * c[0, 0] + y * c[0, 1] + c[0, 2], w), N.divide(x * c[1, 0] + y * c[1, 1] + c[1, 2], w)
        out = []
        for axis in c:
            total = F.lit(0.0)
            for (i, j), v in np.ndenumerate(axis):
                total = total + F.lit(float(v)) * F.pow(x, F.lit(i)) * F.pow(y, F.lit(j))
            out.append(total)
        return out[0], out[1]

    def apply(self, df: DataFrame, x: str = "x_nm", y: str = "y_nm", where: Column | None = None) -> DataFrame:
        a, b = self.columns(N.double(x), N.double(y))
        if where is not None:
            a, b = F.when(where, a).otherwise(F.col(x)), F.when(where, b).otherwise(F.col(y))
        return df.withColumns({x: a, y: b})

    def inverse(self) -> Transformation:
        if self.kind == "polynomial":
            raise ValueError("a polynomial map is inverted by fitting it the other way round")
        m = np.linalg.inv(np.vstack([self.c, [0, 0, 1]]) if self.kind == "affine" else self.c)
        return Transformation(self.kind, m[:2] if self.kind == "affine" else m)

    def to_dict(self) -> dict:
        return {"kind": self.kind, "coefficients": self.c.tolist()}

    @classmethod
    def from_dict(cls, d: dict) -> Transformation:
        return cls(d["kind"], d["coefficients"])


def fit_affine(pairs: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> Transformation:
    """Least-squares affine map from ``a`` to ``b`` by sums over the pairs (normal equations)."""
    x, y, u, v = (N.double(c) for c in (*a, *b))
    names, terms = [], [F.lit(1.0), x, y]
    for i in range(3):
        for j in range(i, 3):
            names.append(F.sum(terms[i] * terms[j]).alias(f"m{i}{j}"))
        names += [F.sum(terms[i] * u).alias(f"u{i}"), F.sum(terms[i] * v).alias(f"v{i}")]
    r = pairs.agg(*names).first()
    m = np.array([[r[f"m{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
    p, q = (np.linalg.solve(m, [r[f"{k}{i}"] for i in range(3)]) for k in "uv")
    return Transformation("affine", [[p[1], p[2], p[0]], [q[1], q[2], q[0]]])


def peak_shift(a: np.ndarray, b: np.ndarray, most: int) -> tuple[float, float]:
    """(rows, columns) by which ``b`` is moved against ``a``: the correlation's peak, refined by parabolas."""
    f = np.fft.irfft2(np.conj(np.fft.rfft2(a - a.mean())) * np.fft.rfft2(b - b.mean()), a.shape)
    ny, nx = a.shape
    f = np.roll(f, (ny // 2, nx // 2), (0, 1))
    cy, cx = ny // 2, nx // 2
    part = f[max(0, cy - most) : cy + most + 1, max(0, cx - most) : cx + most + 1]
    i, j = np.unravel_index(np.argmax(part), part.shape)

    def fine(row, k):
        if 0 < k < len(row) - 1 and (d := row[k - 1] - 2 * row[k] + row[k + 1]):
            return k + 0.5 * (row[k - 1] - row[k + 1]) / d
        return k

    return fine(part[:, j], i) - min(cy, most), fine(part[i], j) - min(cx, most)


def layer_shift(reference: DataFrame, target: DataFrame, size: float, x0: float, y0: float, nx: int, ny: int, most: float, x: str = "x_nm", y: str = "y_nm") -> tuple[float, float]:
    """(dx, dy) of the target against the reference, from histograms of a fixed field."""
    a, b = (A.dense_image(A.pixels(d, x, y, x0, y0, size, nx, ny), ny, nx) for d in (reference, target))
    dy, dx = peak_shift(a, b, max(1, int(most / size)))
    return dx * size, dy * size


def redundant_drift(df: DataFrame, windows: int, size: float, x0: float, y0: float, nx: int, ny: int, most: float, x: str = "x_nm", y: str = "y_nm", frame: str = "frame") -> np.ndarray:
    """(window, 2) drift: histograms of time windows, all pairs of them correlated, and least squares.

    What reaches the driver are ``windows`` images of the field, however many rows there are.
    """
    r = df.agg(F.min(frame).alias("a"), F.max(frame).alias("b")).first()
    width, n = A.frame_windows(r["a"], r["b"], windows)
    w = F.floor((F.col(frame) - r["a"]) / width).cast("int")
    images = np.zeros((n, ny, nx))
    c, q = (F.floor((N.double(v) - o) / size).cast("int") for v, o in ((x, x0), (y, y0)))
    table = df.select(w.alias("w"), q.alias("r"), c.alias("c")).where((F.col("r") >= 0) & (F.col("r") < ny) & (F.col("c") >= 0) & (F.col("c") < nx)).groupBy("w", "r", "c").count()
    for t in table.toLocalIterator():
        images[t["w"], t["r"], t["c"]] = t["count"]
    rows, dx, dy = [], [], []
    for i in range(n):
        for j in range(i + 1, n):
            sy, sx = peak_shift(images[i], images[j], max(1, int(most / size)))
            line = np.zeros(n)
            line[j], line[i] = 1, -1
            rows.append(line), dx.append(sx * size), dy.append(sy * size)
    m = np.array(rows)[:, 1:]
    return np.vstack([np.zeros(2), np.stack([np.linalg.lstsq(m, np.array(d), rcond=None)[0] for d in (dx, dy)], 1)])


def fiducial_curve(df: DataFrame, bead: str, frame: str = "frame", axes: tuple[str, ...] = ("x_nm", "y_nm")) -> DataFrame:
    """(frame, d_<axis>): mean over beads of the distance to their mean place, by frame."""
    centre = df.groupBy(bead).agg(*[F.avg(a).alias(f"__{a}") for a in axes])
    both = df.join(centre, bead)
    return both.groupBy(frame).agg(*[F.avg(F.col(a) - F.col(f"__{a}")).alias(f"d_{a}") for a in axes])


def z_from_widths(df: DataFrame, a: tuple[float, ...], b: tuple[float, ...], z_range: tuple[float, float], steps: int = 400, sx: str = "sigma_x_nm", sy: str = "sigma_y_nm") -> DataFrame:
    """z_nm where the two calibrated widths (polynomials in z) fit best, on a grid refined by a parabola."""
    grid = np.linspace(*z_range, steps)
    wa, wb = np.polyval(a, grid), np.polyval(b, grid)

    @F.pandas_udf("double")
    def best(p: pd.Series, q: pd.Series) -> pd.Series:
        out = np.full(len(p), np.nan)
        for lo in range(0, len(p), 4096):
            u, v = p.to_numpy(float)[lo : lo + 4096, None], q.to_numpy(float)[lo : lo + 4096, None]
            cost = (np.sqrt(u) - np.sqrt(wa)) ** 2 + (np.sqrt(v) - np.sqrt(wb)) ** 2
            ok = np.isfinite(cost).all(1)
            k = np.clip(np.argmin(np.where(ok[:, None], cost, 0), 1), 1, steps - 2)
            c0, c1, c2 = (np.take_along_axis(cost, (k + d)[:, None], 1)[:, 0] for d in (-1, 0, 1))
            bend = c0 - 2 * c1 + c2
            shift = np.where(bend > 0, np.clip(0.5 * (c0 - c2) / np.where(bend > 0, bend, 1), -0.5, 0.5), 0)
            out[lo : lo + 4096] = np.where(ok, grid[k] + shift * (grid[1] - grid[0]), np.nan)
        return pd.Series(out)

    return df.withColumn("z_nm", best(N.double(sx), N.double(sy)))


def class_probabilities(ratio: Column, means: list[float], sigmas: list[float], priors: list[float] | None = None) -> list[Column]:
    """Posterior of each colour class for a photon ratio that is normal in each class."""
    priors = priors or [1 / len(means)] * len(means)
    like = [F.exp(-((ratio - m) * (ratio - m)) / (2 * s * s)) * (p / s) for m, s, p in zip(means, sigmas, priors, strict=True)]
    total = sum(like[1:], like[0])
    return [F.coalesce(F.try_divide(x, total), F.lit(0.0)) for x in like]


def assign_colours(df: DataFrame, ratio: Column, means: list[float], sigmas: list[float], least: float = 0.9) -> DataFrame:
    """channel (from 0; -1 in the gap between classes) and its probability."""
    p = class_probabilities(ratio, means, sigmas)
    best = F.greatest(*p) if len(p) > 1 else p[0]
    at = F.lit(-1)
    for i in range(len(p) - 1, -1, -1):
        at = F.when(p[i] == best, i).otherwise(at)
    return df.withColumns({"channel_p": best, "channel": F.when(best >= least, at).otherwise(-1)})
