"""z from an interference phase: precise, but known up to whole fringes only.

A row at z has the phase k z + phase0(t), where phase0 drifts. The envelope's z, unambiguous but coarse, tells phase0
by windows of frames and then, row by row, the fringe. Windows are one aggregate of weighted sines and cosines; everything about
them (as many rows as windows) is put next to the rows by a broadcast join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N


@dataclass
class Names:
    phase: str = "phase_rad"
    phase_err: str = "phase_err_rad"
    z: str = "z_env_nm"
    z_err: str = "z_env_err_nm"
    frame: str = "frame"


def quantile(df: DataFrame, value: Column, q: float = 0.5, held: int = 100_000, bins: int = 1000, place: int | None = None) -> float | None:
    """Exact quantile of the finite values (linear between neighbours), by counts in ever narrower bins; at most ``held`` different values meet in a task.

    ``place``: the value at this place from 0 on instead.
    """
    v = df.select(value.cast("double").alias("v")).where(N.finite("v"))
    ends = v.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not ends["n"]:
        return None

    def nth(k: int) -> float:
        lo, hi, before, n = ends["lo"], ends["hi"], 0, ends["n"]
        while True:
            inside = v.where((F.col("v") >= lo) & (F.col("v") <= hi))
            width = (hi - lo) / bins
            if n <= held or not width > 0 or lo + width == lo:
                counts = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c")).orderBy("v").collect() if n <= held or lo + width == lo and lo < hi else [{"v": lo, "c": n}]
                for r in counts:
                    before += r["c"]
                    if before > k:
                        return r["v"]
            cells = inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for r in sorted(cells, key=lambda r: r["b"]):
                if before + r["c"] > k:
                    lo, hi, n = r["lo"], r["hi"], r["c"]
                    break
                before += r["c"]
            if lo == hi:
                return lo

    at = q * (ends["n"] - 1) if place is None else place
    low = nth(math.floor(at))
    return low if at == math.floor(at) else low + (nth(math.floor(at) + 1) - low) * (at - math.floor(at))


def quantiles(df: DataFrame, value: Column, qs: tuple[float, ...], held: int = 10_000, bins: int = 1000) -> tuple[float | None, ...]:
    """``quantile`` at several places together: every scan counts in bins around all of them; up to ``held`` different values a place come to the driver."""
    v = df.select(value.cast("double").alias("v")).where(N.finite("v"))
    ends = v.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not ends["n"]:
        return (None,) * len(qs)
    at = [q * (ends["n"] - 1) for q in qs]
    wanted = sorted({math.floor(a) for a in at} | {math.ceil(a) for a in at})
    # Spans (lo, hi, rows before, rows within) that hold places not yet known; spans don't overlap.
    found, spans = {}, {(ends["lo"], ends["hi"], 0, ends["n"]): wanted}
    while spans:
        keys = sorted(spans)
        pick = F.lit(None).cast("struct<s:int,b:double>")
        for i, (lo, hi, _, n) in enumerate(keys):
            width = hi / bins - lo / bins  # the difference of the ends may be infinite
            whole = n <= held or not width > 0 or lo + width == lo  # by its values
            b = F.col("v") if whole else F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("double")
            pick = F.when((F.col("v") >= lo) & (F.col("v") <= hi), F.struct(F.lit(i).alias("s"), b.alias("b"))).otherwise(pick)
        cells = v.select(pick.alias("p"), "v").where("p IS NOT NULL").groupBy("p.s", "p.b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        new: dict = {}
        for i, key in enumerate(keys):
            before, todo = key[2], list(spans[key])
            for r in sorted((r for r in cells if r["s"] == i), key=lambda r: r["b"]):
                inside = [k for k in todo if before <= k < before + r["c"]]
                if r["lo"] == r["hi"]:
                    found.update(dict.fromkeys(inside, r["lo"]))
                elif inside:
                    new[(r["lo"], r["hi"], before, r["c"])] = inside
                before += r["c"]
        spans = new
    return tuple(found[math.floor(a)] if a == math.floor(a) else found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a)) for a in at)


def percentile(df: DataFrame, value: Column, q: float = 0.5, held: int = 100_000, bins: int = 1000) -> float | None:
    """Spark's ``percentile`` of all values that are not null, infinite ones and NaN (as the largest) too, as ``quantile`` finds it."""
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    inf = float("inf")
    n = v.agg(*[F.count_if(c).alias(k) for k, c in (("low", F.col("v") == -inf), ("all", F.lit(True)), ("top", F.col("v") == inf), ("nan", F.isnan("v")))]).first()
    if not n["all"]:
        return None
    inside = n["all"] - n["low"] - n["top"] - n["nan"]
    at = q * (n["all"] - 1)

    def nth(k: int) -> float:
        if k < n["low"]:
            return -inf
        k -= n["low"]
        if k >= inside:
            return inf if k - inside < n["top"] else float("nan")
        return quantile(v, F.col("v"), held=held, bins=bins, place=k)

    lo, hi = math.floor(at), math.ceil(at)
    low = nth(lo)
    if lo == hi:
        return low
    high = nth(hi)
    return low if low == high else (hi - at) * low + (at - lo) * high


def _weighted(df: DataFrame, k: float, names: Names) -> DataFrame:
    """Rows with a phase, a z, a frame and finite errors, with w (one over the variance of phase - k z) and their angle."""
    var = N.double(names.phase_err) * N.double(names.phase_err) + k * k * N.double(names.z_err) * N.double(names.z_err)
    rows = df.withColumns({"__w": F.when((var > 0) & ~F.isnan(var) & (var < float("inf")), 1 / F.greatest(var, F.lit(1e-12))), "__a": N.double(names.phase) - k * N.double(names.z)})
    return rows.where(F.col("__w").isNotNull() & N.finite(names.phase) & N.finite(names.z) & N.finite(names.frame))


def cavity_phase(df: DataFrame, k: float, width: int = 1000, smoothing: int = 1, least: int = 20, names: Names = Names()) -> DataFrame:
    """(window, centre, phase0, error, n): the weighted circular mean of phase - k z by windows of ``width`` frames.

    ``smoothing`` windows are added up around each; those with fewer than ``least`` rows are left out. phase0 goes on from window to window
    by less than half a turn. error is the circular spread over the root of the effective count.
    """
    rows = _weighted(df, k, names)
    first = rows.agg(F.min(N.double(names.frame))).first()[0]
    at = F.floor((N.double(names.frame) - F.lit(first)) / width).cast("long") if first is not None else F.lit(0).cast("long")
    w, a = F.col("__w"), F.col("__a")
    sums = rows.groupBy(at.alias("window")).agg(F.sum(w * F.cos(a)).alias("c"), F.sum(w * F.sin(a)).alias("s"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.count(F.lit(1)).alias("n"))
    # From here on a row a window.
    if smoothing > 1:
        near = Window.orderBy("window").rangeBetween(-(smoothing // 2), (smoothing - 1) // 2)
        last = rows.agg(F.max(at)).first()[0]
        every = df.sparkSession.range(0, (last if last is not None else -1) + 1).withColumnRenamed("id", "window")
        sums = every.join(sums, "window", "left").select("window", *[F.coalesce(F.sum(c).over(near), F.lit(0)).alias(c) for c in ("c", "s", "w", "w2", "n")])
    kept = sums.where(F.col("n") >= least)
    length = F.least(F.greatest(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("w"), F.lit(1e-9)), F.lit(1.0))
    kept = kept.select("window", ((F.lit(first or 0.0) + (F.col("window") + 0.5) * width)).alias("centre"), F.atan2("s", "c").alias("angle"), (F.sqrt(-2 * F.log(length)) / F.sqrt(F.col("w") * F.col("w") / F.col("w2"))).alias("error"), F.col("n").cast("long").alias("n"))
    along = Window.orderBy("window")
    turn = -F.round((F.col("angle") - F.lag("angle").over(along)) / (2 * math.pi))
    kept = kept.withColumn("turn", F.coalesce(turn, F.lit(0.0)))
    return kept.select("window", "centre", (F.col("angle") + 2 * math.pi * F.sum("turn").over(along)).alias("phase0"), "error", "n")


def with_cavity_phase(df: DataFrame, windows: DataFrame, width: int, names: Names = Names()) -> DataFrame:
    """``df`` with phase0_rad: linear between the windows' centres, and on with the end windows' slope."""
    known = windows.orderBy("window").select("centre", "phase0").collect()  # a row a window
    if not known:
        raise ValueError("too few rows with a phase and a z in every window: make the window longer")
    x, y = (np.array([r[c] for r in known]) for c in ("centre", "phase0"))
    # A line for each stretch of one window's width between centres, whether or not a window there was left out.
    steps = np.round((x - x[0]) / width).astype(int)
    slope = np.diff(y) / np.diff(x) if len(x) > 1 else np.zeros(1)
    lines = []
    for h in range(-1, int(steps[-1]) + 1):
        i = min(max(int(np.searchsorted(steps, h, "right")) - 1, 0), len(slope) - 1)
        lines.append((h, float(x[i]), float(y[i]), float(slope[i])))
    table = F.broadcast(df.sparkSession.createDataFrame(lines, "__h int, __x double, __y double, __m double"))
    f = N.double(names.frame)
    h = F.least(F.greatest(F.floor((f - float(x[0])) / width), F.lit(-1)), F.lit(int(steps[-1]))).cast("int")
    both = df.withColumn("__h", h).join(table, "__h", "left")
    return both.withColumn("phase0_rad", F.col("__y") + F.col("__m") * (f - F.col("__x"))).select(*df.columns, "phase0_rad")


def unwrapped(df: DataFrame, k: float, calibrate: bool = True, reach: int = 2, names: Names = Names()) -> DataFrame:
    """``df`` with z_nm on its most probable fringe, z_err_nm, fringe and fringe_probability.

    The envelope's z is normal about the true one by its error; the probability is that of the nearest fringe among it and ``reach``
    on each side. With ``calibrate`` the errors grow by the robust spread of (envelope - z) / error, where that is above 1 and 20 rows tell it.
    Without a finite z and error z and probability are NaN and the fringe 0.
    """
    period = 2 * math.pi / abs(k)
    z, err = N.double(names.z), N.double(names.z_err)
    base = (N.double(names.phase) - F.col("phase0_rad")) / k
    # Halves go to the even fringe, as everywhere else here.
    df = df.withColumn("__n", F.rint((z - base) / period)).withColumn("__z", base + F.col("__n") * period)
    scale = 1.0
    if calibrate:
        chi = (z - F.col("__z")) / err
        known = df.where(N.finite("__z") & N.finite(names.z_err) & (err != 0))
        if known.limit(20).count() >= 20:
            middle = quantile(known, chi)
            scale = max(1.4826 * quantile(known, F.abs(chi - F.lit(middle))), 1.0)
    s = F.greatest(err * scale, F.lit(1e-3))
    away = [(z - F.col("__z") - i * period) / s for i in range(-reach, reach + 1)]
    others = sum((F.exp(-0.5 * (a * a - away[reach] * away[reach])) for a in away[1:]), F.exp(-0.5 * (away[0] * away[0] - away[reach] * away[reach])))
    ok = N.finite("__z") & N.finite(names.z_err)
    nan = F.lit(float("nan"))
    out = df.withColumns({"z_nm": F.when(ok, F.col("__z")).otherwise(nan), "z_err_nm": F.abs(N.double(names.phase_err) / k), "fringe": F.when(ok, F.col("__n")).otherwise(0).cast("long"), "fringe_probability": F.when(ok, 1 / others).otherwise(nan)})
    return out.drop("__n", "__z")


def refined_slope(df: DataFrame, k: float, width: int = 1000, span: float = 0.1, steps: int = 201, names: Names = Names()) -> float:
    """The slope within ``span`` of ``k`` whose windows' resultants are largest; ``k`` if z covers less than a fringe or 50 rows.

    Every row gives all trial slopes at once, summed by window and slope; errors of z flatten a resultant, which is divided out, and
    rows whose error is above one radian take no part.
    """
    rows = _weighted(df, k, names).where(abs(k) * N.double(names.z_err) < 1)
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min(N.double(names.z)).alias("a"), F.max(N.double(names.z)).alias("b"), F.min(N.double(names.frame)).alias("f")).first()
    if ends["n"] < 50 or ends["b"] - ends["a"] < 2 * math.pi / abs(k):
        return float(k)
    trial = F.col("k") * N.double(names.z)
    at = F.floor((N.double(names.frame) - ends["f"]) / width).alias("window")
    slopes = F.lit([float(v) for v in k * (1 + np.linspace(-span, span, steps))])
    each = rows.select("*", at, F.posexplode(slopes).alias("i", "k"))
    grow = F.col("__w") * F.exp(0.5 * F.pow(F.col("k") * N.double(names.z_err), 2))
    a = N.double(names.phase) - trial
    sums = each.groupBy("window", "i").agg(F.sum(grow * F.cos(a)).alias("c"), F.sum(grow * F.sin(a)).alias("s"))
    got = sums.groupBy("i").agg(F.sum(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("v")).orderBy("i").collect()
    score, trials = np.array([r["v"] for r in got]), k * (1 + np.linspace(-span, span, steps))
    best = int(np.argmax(score))
    if 0 < best < steps - 1:
        p, q, r = score[best - 1 : best + 2]
        bend = p - 2 * q + r
        return float(trials[best] + (0.5 * (p - r) / bend if bend else 0.0) * (trials[1] - trials[0]))
    return float(trials[best])
