"""Kinetics, diffusion and steps of traces: per-trace work runs as grouped maps, sums stay in Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .storage import cut
from .windows import along, lag_sums


def blinks_of(df: DataFrame, key: str, gap: int, frame: str = "frame", row: str = "row_id") -> DataFrame:
    """(key, blink, first, last, on, n, dark): runs of a molecule's rows whose frames are at most gap + 1 apart."""
    w = along(key, frame, row)
    d = F.col(frame) - F.lag(frame).over(w)
    rows = df.where(F.col(key) >= 0).withColumn("__new", F.when(d > gap + 1, 1).otherwise(0)).withColumn("blink", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = rows.groupBy(key, "blink").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("n"))
    before = F.max("last").over(Window.partitionBy(key).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    return b.select(key, "blink", "first", "last", (F.col("last") - F.col("first") + 1).alias("on"), "n", (F.col("first") - before - 1).alias("dark"))


def blinking_summary(blinks: DataFrame, key: str) -> DataFrame:
    """(key, blinks, mean_on, mean_dark) of each molecule."""
    return blinks.groupBy(key).agg(F.count(F.lit(1)).alias("blinks"), F.avg("on").alias("mean_on"), N.filled(F.avg("dark")).alias("mean_dark"))


def kinetics(blinks: DataFrame, key: str, frames: int) -> DataFrame:
    """Per region: events, mean bright and dark time, and dark time by maximum likelihood (open ends counted)."""
    g = blinks.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.avg("on").alias("bright"), N.filled(F.avg("dark")).alias("dark"), F.sum("on").alias("__on"))
    return g.withColumn("dark_ml", (F.lit(frames) - F.col("__on")) / F.col("events")).drop("__on")


def pooled_dark(blinks: DataFrame) -> float:
    """Sum of dark times over the number of dark periods: of sums, not a mean of ratios."""
    r = blinks.agg(F.sum("dark").alias("s"), F.count("dark").alias("n")).first()
    return r["s"] / r["n"] if r["n"] else math.nan


def sites_from_kinetics(table: DataFrame, influx: float, index: str = "dark_ml") -> DataFrame:
    """Binding sites of each region: 1 / (influx x dark time)."""
    return table.withColumn("sites", F.try_divide(F.lit(1.0), F.col(index) * influx))


def msd(df: DataFrame, max_lag: int, frame_s: float, key: str = "track_id", frame: str = "frame", x: str = "x_nm", y: str = "y_nm", fitted: int = 4) -> DataFrame:
    """(key, d_um2_s, alpha, lags): a line through the first ``fitted`` mean squared displacements of each track, and the slope of their logarithms."""
    s = lag_sums(df, max_lag, key, frame, x, y).where(F.col("lag") <= fitted).withColumn("m", F.col("sum") / F.col("n") * 1e-6).withColumn("t", F.col("lag") * frame_s)
    positive = F.col("m") > 0
    g = s.groupBy(key).agg(F.regr_slope("m", "t").alias("slope"), F.regr_slope(F.when(positive, F.log("m")), F.when(positive, F.log("t"))).alias("alpha"), F.count(F.lit(1)).alias("lags"))
    return g.select(key, N.filled(F.col("slope") / 4).alias("d_um2_s"), N.filled("alpha").alias("alpha"), "lags")


def pooled_msd(df: DataFrame, max_lag: int, key: str = "track_id", frame: str = "frame", x: str = "x_nm", y: str = "y_nm") -> DataFrame:
    """(lag, msd, n) over all tracks: sums over sums."""
    return lag_sums(df, max_lag, key, frame, x, y).groupBy("lag").agg((F.sum("sum") / F.sum("n")).alias("msd"), F.sum("n").alias("n"))


def track_summary(df: DataFrame, max_lag: int, frame_s: float, key: str = "track_id", frame: str = "frame", x: str = "x_nm", y: str = "y_nm", row: str = "row_id") -> DataFrame:
    """(key, n, path_nm, net_nm, straightness, d_um2_s, alpha, lags) of every track with an id.

    ``straightness`` is net over path. It is NaN for a track that doesn't move, as d and alpha are for one with too few lags.
    """
    w = Window.partitionBy(key).orderBy(frame, row)
    at = df.where(F.col(key) >= 0).select(key, frame, row, N.double(x).alias("__x"), N.double(y).alias("__y"))
    step = F.sqrt(F.pow(F.col("__x") - F.lag("__x").over(w), 2) + F.pow(F.col("__y") - F.lag("__y").over(w), 2))
    place = F.struct(F.col(frame), F.col(row), F.col("__x"), F.col("__y"))
    g = at.withColumn("__s", step).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__s"), F.lit(0.0)).alias("path_nm"), F.min(place).alias("__a"), F.max(place).alias("__b"))
    net = F.sqrt(F.pow(F.col("__b.__x") - F.col("__a.__x"), 2) + F.pow(F.col("__b.__y") - F.col("__a.__y"), 2))
    g = g.select(key, "n", "path_nm", net.alias("net_nm")).withColumn("straightness", F.when(F.col("path_nm") > 0, F.col("net_nm") / F.col("path_nm")).otherwise(float("nan")))
    fits = msd(df, max_lag, frame_s, key, frame, x, y)
    return g.join(fits, key, "left").withColumns({"d_um2_s": N.filled("d_um2_s"), "alpha": N.filled("alpha"), "lags": F.coalesce("lags", F.lit(0))})


def robust_spreads(df: DataFrame, key: str, time: str, value: str, row: str = "row_id") -> DataFrame:
    """(key, n, median, mad, quartiles, steps): spreads of each trace as a normal distribution's deviation.

    ``mad`` from the median distance to the median, ``quartiles`` from their difference, ``steps`` from the median
    difference of neighbours, which a slow drift doesn't raise. Rows without a finite value take no part.
    """
    v = df.where(N.finite(value)).select(key, N.double(value).alias("__v"), F.abs(N.double(value) - F.lag(N.double(value)).over(Window.partitionBy(key).orderBy(time, row))).alias("__s"))
    g = v.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile("__v", [0.25, 0.5, 0.75]).alias("__q"), F.median("__s").alias("__m"))
    middle = v.join(g.select(key, F.col("__q")[1].alias("__c")), key).groupBy(key).agg(F.median(F.abs(F.col("__v") - F.col("__c"))).alias("__d"))
    normal = 0.6744897501960817  # the normal distribution's upper quartile
    return g.join(middle, key).select(
        key, "n", F.col("__q")[1].alias("median"), (F.col("__d") / normal).alias("mad"),
        ((F.col("__q")[2] - F.col("__q")[0]) / (2 * normal)).alias("quartiles"), N.filled(F.col("__m") / (normal * 2**0.5)).alias("steps"),
    )


def jump_states(df: DataFrame, states: int, frame_s: float, rounds: int = 60, bins: int = 2000, key: str = "track_id", frame: str = "frame", x: str = "x_nm", y: str = "y_nm") -> list[tuple[float, float]]:
    """(fraction, D in um^2/s) of diffusive states from one-frame jumps, by expectation-maximisation.

    It runs on the jumps' histogram in the logarithm of r^2, whose size is fixed.
    """
    early = df.where(F.col(key) >= 0).select(key, (F.col(frame) + 1).alias(frame), N.double(x).alias("__x"), N.double(y).alias("__y"))
    r2 = F.pow(N.double(x) - F.col("__x"), 2) + F.pow(N.double(y) - F.col("__y"), 2)
    jumps = early.join(df.select(key, frame, x, y), [key, frame]).select((r2 * 1e-6).alias("r2")).where("r2 > 0")
    h = jumps.groupBy(F.floor(F.log10("r2") * (bins / 20)).cast("int").alias("b")).agg(F.sum("r2").alias("s"), F.count(F.lit(1)).alias("n")).toPandas()
    if h.empty:
        return []
    v, n = (h["s"] / h["n"]).to_numpy(), h["n"].to_numpy(float)
    scale = np.quantile(np.repeat(v, np.maximum(1, (n / n.sum() * 10000).astype(int))), (np.arange(states) + 0.5) / states)
    part = np.full(states, 1 / states)
    for _ in range(rounds):
        like = part * np.exp(-v[:, None] / scale) / scale
        like /= np.maximum(like.sum(1, keepdims=True), 1e-300)
        w = like * n[:, None]
        part, scale = w.sum(0) / n.sum(), np.maximum((w * v[:, None]).sum(0) / np.maximum(w.sum(0), 1e-300), 1e-12)
    return sorted(zip(part.tolist(), (scale / (4 * frame_s)).tolist(), strict=True), key=lambda s: s[1])


def trace_statistics(df: DataFrame, key: str, time: str, x: str = "x_nm", y: str = "y_nm", row: str = "row_id") -> DataFrame:
    """n, duration, displacement, path, velocity, precision and principal axes of each trace."""
    w = along(key, time, row)
    rows = df.where(F.col(key) >= 0).withColumn("__dx", N.double(x) - F.lag(N.double(x)).over(w)).withColumn("__dy", N.double(y) - F.lag(N.double(y)).over(w))
    a, b, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.max(time) - F.min(time)).cast("double").alias("duration"), F.hypot(F.max_by(x, F.struct(time, row)) - F.min_by(x, F.struct(time, row)), F.max_by(y, F.struct(time, row)) - F.min_by(y, F.struct(time, row))).alias("displacement"),
        F.coalesce(F.sum(F.hypot("__dx", "__dy")), F.lit(0.0)).alias("path"), N.filled(F.sqrt((F.var_samp("__dx") + F.var_samp("__dy")) / 4)).alias("precision"), a.alias("a"), b.alias("b"), c.alias("c"),
    )
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow(F.col("a") - F.col("b"), 2) / 4 + F.col("c") * F.col("c"))
    return g.select(key, "n", "duration", "displacement", "path", N.filled(F.try_divide(F.col("displacement"), F.col("duration"))).alias("velocity"), "precision", F.sqrt(half + root).alias("length"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("width"))


def find_steps(x: np.ndarray, threshold: float = 2.0) -> list[int]:
    """Change points of a trace: each split takes the place that lowers the squared error most, as long as the
    step is ``threshold`` times its standard error."""
    cuts, todo = [], [(0, len(x))]
    noise = np.median(np.abs(np.diff(x))) / 0.6745 / math.sqrt(2) if len(x) > 2 else 0.0
    while todo:
        best = None
        for k, (lo, hi) in enumerate(todo):
            n = hi - lo
            if n < 4:
                continue
            s = np.cumsum(x[lo:hi])
            i = np.arange(2, n - 1)
            gain = s[i - 1] ** 2 / i + (s[-1] - s[i - 1]) ** 2 / (n - i) - s[-1] ** 2 / n
            j = int(np.argmax(gain))
            height = abs(s[i[j] - 1] / i[j] - (s[-1] - s[i[j] - 1]) / (n - i[j]))
            error = noise * math.sqrt(1 / i[j] + 1 / (n - i[j]))
            if height > threshold * max(error, 1e-12) and (best is None or gain[j] > best[0]):
                best = (gain[j], k, lo + int(i[j]))
        if best is None:
            break
        lo, hi = todo.pop(best[1])
        cuts.append(best[2])
        todo += [(lo, best[2]), (best[2], hi)]
    return sorted(cuts)


def steps_table(df: DataFrame, key: str, time: str, value: str, threshold: float = 3.0) -> DataFrame:
    """(key, plateau, start, end, n, level, step): plateaus of each trace and the step to each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        x, t = pdf[value].to_numpy(float), pdf[time].to_numpy(float)
        edges = [0, *find_steps(x, threshold), len(x)]
        level = [x[a:b].mean() for a, b in zip(edges, edges[1:], strict=False)]
        return pd.DataFrame({key: pdf[key].iloc[0], "plateau": range(len(level)), "start": [t[a] for a in edges[:-1]], "end": [t[b - 1] for b in edges[1:]], "n": np.diff(edges), "level": level, "step": [np.nan, *np.diff(level)]})

    kind = dict(df.dtypes)[key]
    return df.where(F.col(key) >= 0).select(key, time, value).groupBy(key).applyInPandas(run, f"{key} {kind}, plateau int, start double, end double, n long, level double, step double")


def _digamma(x: float) -> float:
    """Derivative of the logarithm of the gamma function: recurrence up to 6, then the asymptotic series."""
    low = 0.0
    while x < 6:
        low, x = low - 1 / x, x + 1
    y = 1 / (x * x)
    return low + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def dwell_models(table: DataFrame, column: str) -> dict[str, float]:
    """Exponential and gamma laws of dwell times by maximum likelihood, from sums over the table: mean, shape = mean^2 /
    variance, the gamma law's own shape, and log-likelihood and AIC of both.

    Times that aren't positive take no part; under five there is no fit. Equal times have no finite gamma shape: the gamma
    entries are then infinite or NaN.
    """
    x = F.when(N.double(column) > 0, N.present(column))
    r = table.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.avg(F.log(x)).alias("l")).first()
    if not r["n"] or r["n"] < 5:
        return {}
    n, mean = r["n"], r["m"]
    ll = -n * (math.log(mean) + 1)
    out = {"n": n, "mean": mean, "shape": mean**2 / r["v"] if r["v"] else math.inf, "exponential_ll": ll, "exponential_aic": 2 - 2 * ll}
    gap = math.log(mean) - r["l"]  # the shape k solves log k - digamma(k) = gap, which falls in k
    if gap < 1e-12:
        return out | {"gamma_shape": math.inf, "gamma_ll": math.nan, "gamma_aic": math.nan}
    lo, hi = 1e-6, 1e13
    for _ in range(200):
        k = math.sqrt(lo * hi)
        lo, hi = (k, hi) if math.log(k) - _digamma(k) > gap else (lo, k)
    ll = n * ((k - 1) * r["l"] - k - k * math.log(mean / k) - math.lgamma(k))
    return out | {"gamma_shape": k, "gamma_ll": ll, "gamma_aic": 4 - 2 * ll}


def allan(df: DataFrame, key: str, time: str, value: str, spans: list[int]) -> DataFrame:
    """(span, deviation, n): Allan deviation over all traces, from sums over traces."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time, kind="stable")[value].to_numpy(float)
        s, out = np.cumsum(np.r_[0.0, x]), []
        for m in spans:
            if len(x) >= 2 * m:
                means = (s[m:] - s[:-m]) / m
                d = means[m:] - means[:-m]
                out.append((m, float((d * d).sum()), len(d)))
        return pd.DataFrame(out, columns=["span", "sum", "n"])

    sums = df.select(key, time, value).groupBy(key).applyInPandas(run, "span long, sum double, n long")
    return sums.groupBy("span").agg(F.sqrt(F.sum("sum") / (2 * F.sum("n"))).alias("deviation"), F.sum("n").alias("n"))


def regular_steps(df: DataFrame, key: str, time: str, row: str = "row_id") -> DataFrame:
    """An irregular clock as whole steps of the trace's median spacing."""
    w = along(key, time, row)
    rows = df.withColumn("__d", N.double(time) - F.lag(N.double(time)).over(w))
    scale = rows.groupBy(key).agg(F.median("__d").alias("__s"), F.min(time).alias("__0"))
    return rows.join(scale, key).withColumn("step_index", F.coalesce(F.bround(F.try_divide(N.double(time) - F.col("__0"), F.col("__s"))), F.lit(0.0)).cast("long")).drop("__d", "__s", "__0")


#: Values of traces that are walked side by side, of one length or less.
_WALKED = 500_000


def _hidden_sums(traces: list[np.ndarray], mean: np.ndarray, dev: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights, first and second moments of the states and their expected transitions, summed over traces.

    Forward and backward go along all traces at once: they are sorted by falling length, so those that last are the first ones.
    """
    size = np.array([len(x) for x in traces])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # traces that are longer than t
    there = np.arange(size[0])[:, None] < size
    x = np.zeros(there.shape)
    x.T[there.T] = np.concatenate([traces[i] for i in order])
    e = np.exp(-0.5 * ((x[..., None] - mean) / dev) ** 2) / dev + 1e-300
    f, b = np.zeros_like(e), np.ones_like(e)
    f[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, len(x)):
        n = alive[t]
        f[t, :n] = (f[t - 1, :n] @ move) * e[t, :n]
        f[t, :n] /= f[t, :n].sum(1, keepdims=True)
    for t in range(len(x) - 2, -1, -1):
        n = alive[t + 1]
        b[t, :n] = (e[t + 1, :n] * b[t + 1, :n]) @ move.T
        b[t, :n] /= b[t, :n].sum(1, keepdims=True)
    g = f * b
    g[there] /= g[there].sum(1, keepdims=True)
    g[~there] = 0.0
    on = there[1:]
    xi = f[:-1][on][:, :, None] * move * (e[1:] * b[1:])[on][:, None, :]
    xi = (xi / np.maximum(xi.sum((1, 2), keepdims=True), 1e-300)).sum(0)
    moments = [(g * v[..., None]).sum((0, 1)) for v in (np.ones_like(x), x, x * x)]
    return (*moments, xi)


def hidden_states(df: DataFrame, key: str, time: str, value: str, states: int = 2, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and transition matrix of a Gaussian hidden Markov model over all traces.

    Traces are gathered once. Each round runs forward and backward along many traces side by side, in parallel; only sums
    come to the driver. Rows of one time go by value.
    """
    q = df.agg(F.percentile(N.present(value), [float((i + 0.5) / states) for i in range(states)]).alias("q"), F.stddev_pop(N.present(value)).alias("s")).first()
    mean, dev = np.array(q["q"], float), np.full(states, (q["s"] or 1.0) / states + 1e-9)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(N.finite(value)).select(key, F.struct(F.isnull(time).alias("none"), F.col(time).alias("t"), N.double(value).alias("x")).alias("r"))
    traces = cut(rows.repartition(buckets, key).groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("r")).select(F.col("r.x").alias("x")))
    for _ in range(rounds):
        model = (mean, dev, move)

        def run(batches, model=model):
            total = None
            for batch in batches:
                ends = batch.column(0).offsets.to_numpy()
                flat = batch.column(0).values.to_numpy()
                some = sorted((flat[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)), key=len)
                while some:
                    n = max(1, min(len(some), _WALKED // len(some[-1])))
                    some, part = some[:-n], some[-n:]
                    got = _hidden_sums(part, *model)
                    total = got if total is None else tuple(p + q for p, q in zip(total, got, strict=True))
            if total is not None:
                out = [(k, i, 0, float(total[k][i])) for k in range(3) for i in range(states)] + [(3, i, j, float(total[3][i, j])) for i in range(states) for j in range(states)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["kind", "i", "j", "v"])

        got = traces.mapInArrow(run, "kind int, i int, j int, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).toPandas()
        take = lambda k: got[got["kind"] == k].sort_values(["i", "j"])["v"].to_numpy()
        n, s, s2 = take(0), take(1), take(2)
        mean = s / np.maximum(n, 1e-12)
        dev = np.sqrt(np.maximum(s2 / np.maximum(n, 1e-12) - mean**2, 1e-12))
        x = take(3).reshape(states, states)
        move = x / np.maximum(x.sum(1, keepdims=True), 1e-12)
    return mean, dev, move
