"""Grouping by rules, statistics of ids, histograms, time windows and laws fitted to them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nansafe as N
from .tables import is_id

#: Which rule combines a column, by its name; others are precisions (*_err) or weighted means.
RULES = {
    "photons": "sum", "background": "sum", "photons_err": "quad", "background_err": "quad",
    "logl_rel": "max", "iterations": "max", "track_id": "max", "track_length": "max",
    "frame": "min", "tid": "min", "trace_index": "min", "track_id_true": "min", "fringe_probability": "min",
    "state_true": "min", "tid_file": "min", "track_id_file": "max",
    "phase_rad": "circular", "cavity_phase_rad": "circular", "logl": "drop",
}


def rule_of(name: str, rules: dict[str, str] | None = None) -> str:
    return (rules or {}).get(name) or RULES.get(name) or ("precision" if name.endswith("err") or "_err_" in name else "mean")


def weight(error: Column | None) -> Column:
    """Inverse variance; 1 where that isn't finite."""
    if error is None:
        return F.lit(1.0)
    e = N.double(error)
    w = N.divide(F.lit(1.0), e * e)
    return F.when(N.finite(w), w).otherwise(F.lit(1.0))


def error_for(name: str, columns: list[str]) -> str | None:
    """The column that weighs a mean: its own error, else a pooled one."""
    stem, dot, unit = name.rpartition("_")
    own = f"{stem}_err_{unit}" if dot else f"{name}_err"
    for c in (own, f"{name}_err", "xy_err_nm", "x_err_nm"):
        if c in columns and c != name:
            return c
    return None


def combined(name: str, rule: str, columns: list[str]) -> Column:
    x = N.present(name)
    if rule == "mean":
        e = error_for(name, columns)
        w = weight(F.col(e)) if e else N.highest(N.double("photons"), F.lit(0.0)) if "photons" in columns and name != "photons" else F.lit(1.0)
        w = F.when(x.isNotNull(), F.when(N.finite(w), w).otherwise(F.lit(1.0)))
        return F.try_divide(F.sum(x * w), F.sum(w))
    if rule == "precision":
        return F.try_divide(F.lit(1.0), F.sqrt(F.sum(F.when(x > 0, F.try_divide(F.lit(1.0), x * x)))))
    if rule == "circular":
        e = next((c for c in (f"{name.removesuffix('_rad')}_err_rad", f"{name}_err") if c in columns), None)
        w = F.when(x.isNotNull(), weight(F.col(e)) if e else F.lit(1.0))
        return F.atan2(F.sum(F.sin(x) * w), F.sum(F.cos(x) * w))
    return {"sum": F.sum(x), "quad": F.sqrt(F.sum(x * x)), "max": F.max(x), "min": F.min(x), "any": F.max(F.when(x != 0, 1.0).otherwise(0.0)), "all": F.min(F.when(x != 0, 1.0).otherwise(0.0))}[rule]


def combine(df: DataFrame, keys: list[str], columns: list[str] | None = None, rules: dict[str, str] | None = None, count: str = "n_in_group") -> DataFrame:
    """One row a group: each column by its rule, in one aggregate; NaN is left out, all NaN gives NaN."""
    use = [c for c in (columns or df.columns) if c not in keys and isinstance(df.schema[c].dataType, T.NumericType)]
    out = {}
    for c in use:
        rule = rule_of(c, rules)
        if rule in ("drop", "none"):
            continue
        made = combined(c, rule, df.columns)
        whole = isinstance(df.schema[c].dataType, T.IntegralType) and rule in ("min", "max")
        out[c] = made.cast(df.schema[c].dataType) if whole else N.filled(made)
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[v.alias(k) for k, v in out.items()])
    # The lateral precision follows from the combined pair rather than being combined itself.
    return lateral_error(grouped) if "xy_err_nm" in out and "xy_err_nm" not in (rules or {}) else grouped


def lateral_error(df: DataFrame, out: str = "xy_err_nm", pair: tuple[str, str] = ("x_err_nm", "y_err_nm")) -> DataFrame:
    """``df`` with the root mean square of both lateral errors; unchanged where it hasn't both."""
    if not set(pair) <= set(df.columns):
        return df
    x, y = (N.double(c) for c in pair)
    return df.withColumn(out, F.sqrt((x * x + y * y) / 2))


def id_statistics(df: DataFrame, key: str, columns: list[str], time: str | None = None, frame: str | None = None, positions: tuple[str, ...] = (), keep: Column | None = None) -> DataFrame:
    """Per id (>= 0): n; centre and sample deviation of positions; first, last, frames or start, end, duration; mean, median, std, min, max."""
    rows = df.where(F.col(key) >= 0)
    rows = rows.where(keep) if keep is not None else rows
    out = [F.count(F.lit(1)).alias("n")]
    for p in positions:
        out += [N.filled(F.avg(N.present(p))).alias(f"{p}_mean"), N.filled(F.stddev_samp(N.present(p))).alias(f"{p}_std")]
    if len(positions) >= 2:
        a, b = positions[:2]
        out.append(N.filled(F.sqrt((F.var_samp(N.present(a)) + F.var_samp(N.present(b))) / 2)).alias("std_xy"))
    if time:
        out += [F.min(time).alias("start"), F.max(time).alias("end"), (F.max(time) - F.min(time)).alias("duration")]
    elif frame:
        out += [F.min(frame).alias("first"), F.max(frame).alias("last"), (F.max(frame) - F.min(frame) + 1).alias("frames")]
    for c in columns:
        x = F.when(N.finite(c), N.double(c))
        for name, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out.append(N.filled(f(x)).alias(f"{c}_{name}"))
    return rows.groupBy(key).agg(*out)


def collapse(df: DataFrame, key: str, row: str = "row_id", unassigned: str = "keep", extra: tuple[str, ...] = (), **how) -> DataFrame:
    """One row an id (and file, channel); rows without an id stay single or go."""
    if unassigned == "remove":
        df = df.where(F.col(key) >= 0)
    by = F.when(F.col(key) < 0, -2 - F.col(row)).otherwise(F.col(key))
    out = combine(df.withColumn("__by", by), ["__by", *extra], count="n_merged", rules={key: "min"} | how.pop("rules", {}), **how)
    return out.drop("__by")


def window_aggregate(df: DataFrame, key: str, order: str, half: int, columns: dict[str, str]) -> DataFrame:
    """Every row with sum, mean, min or max over the rows of its key within ``half`` of its frame."""
    w = Window.partitionBy(key).orderBy(order).rangeBetween(-half, half)
    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    return df.withColumns({f"{c}_{a}": f[a](N.present(c)).over(w) for c, a in columns.items()})


# Histograms -------------------------------------------------------------------------------------------------


def bins_of(df: DataFrame, column: str, bins: int | None = None, lo: float | None = None, hi: float | None = None) -> np.ndarray:
    """Edges: unit bins for whole numbers, else by quartiles and count (Freedman-Diaconis)."""
    x = F.when(N.finite(column), N.double(column))
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile(x, [0.25, 0.75]).alias("q"), F.count(x).alias("n")).first()
    lo, hi = r["lo"] if lo is None else lo, r["hi"] if hi is None else hi
    if lo is None or hi is None:
        return np.array([0.0, 1.0])
    if isinstance(df.schema[column].dataType, T.IntegralType) and bins is None:
        return np.arange(math.floor(lo), math.floor(hi) + 2) - 0.5
    if bins is None:
        width = 2 * (r["q"][1] - r["q"][0]) / max(r["n"], 1) ** (1 / 3)
        bins = int(min(1000, max(1, math.ceil((hi - lo) / width)))) if width > 0 else 1
    return np.linspace(lo, hi if hi > lo else lo + 1, bins + 1)


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n): equal bins, the last one closed; outside is left out."""
    x = N.double(column)
    at = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(N.between(column, lo, hi)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str, lo: float, hi: float, keys: tuple[str, ...] = ()) -> DataFrame:
    x, inside = N.present(column), N.between(column, lo, hi)
    v = F.when(inside, x)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(x.isNotNull() & ~inside).alias("outside"), N.filled(F.avg(v)).alias("mean"), N.filled(F.median(v)).alias("median"), N.filled(F.stddev_pop(v)).alias("std"))


def pixels(df: DataFrame, x: str, y: str, x0: float, y0: float, size: float, nx: int, ny: int, weight: str | None = None) -> DataFrame:
    """(row, col, value): counts or weight sums by half-open pixel; what lies outside is dropped."""
    c, r = (F.floor((N.double(v) - o) / size).cast("int") for v, o in ((x, x0), (y, y0)))
    inside = N.finite(x) & N.finite(y) & (N.double(x) >= x0) & (N.double(y) >= y0) & (N.double(x) < x0 + nx * size) & (N.double(y) < y0 + ny * size)
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(N.present(weight))
    return df.where(inside).groupBy(r.alias("row"), c.alias("col")).agg(value.alias("value"))


def dense_image(table: DataFrame, ny: int, nx: int) -> np.ndarray:
    """The pixel table as an array on the driver: its size is given by the field and not by the rows."""
    out = np.zeros((ny, nx))
    for r in table.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


# Time -------------------------------------------------------------------------------------------------------


def frame_windows(first: int, last: int, windows: int) -> tuple[int, int]:
    """Width in whole frames, and how many windows there then are."""
    width = max(1, round((last - first + 1) / windows))
    return width, -(-(last - first + 1) // width)


def rate(df: DataFrame, first: int, last: int, width: int, frame: str = "frame", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, window, n, rate): rows for each frame that a window covers, empty windows being 0."""
    n = -(-(last - first + 1) // width)
    found = df.where(F.col(frame).between(first, last)).groupBy(*keys, F.floor((F.col(frame) - first) / width).cast("int").alias("window")).agg(F.count(F.lit(1)).alias("n"))
    all_windows = (df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    covered = F.least(F.lit(width), F.lit(last - first + 1) - F.col("window") * width)
    return all_windows.join(found, [*keys, "window"], "left").select(*keys, "window", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / covered).alias("rate"))


def window_statistic(df: DataFrame, column: str, first: int, width: int, statistic: str = "median", least: int = 1, frame: str = "frame", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, window, value): NaN below ``least`` finite values."""
    x = F.when(N.finite(column), N.double(column))
    f = {"median": F.median, "mean": F.avg}[statistic]
    return df.groupBy(*keys, F.floor((F.col(frame) - first) / width).cast("int").alias("window")).agg(N.filled(F.when(F.count(x) >= least, f(x))).alias("value"))


# Laws -------------------------------------------------------------------------------------------------------


def truncated_mean_scale(mean: float, lo: float, hi: float) -> float:
    """Scale of an exponential on [lo, hi] with this mean (infinite from the middle on), by bisection."""
    span, m = hi - lo, mean - lo
    if not m > 0:
        return 0.0
    if m >= span / 2:
        return math.inf
    def of(tau):
        return tau - span / math.expm1(span / tau) if span / tau < 700 else tau

    a, b = 1e-12 * span, 1e6 * span
    for _ in range(200):
        c = math.sqrt(a * b)
        a, b = (c, b) if of(c) < m else (a, c)
    return math.sqrt(a * b)


def exponential_scale(df: DataFrame, column: str, lo: float, hi: float) -> float:
    mean = df.where(N.between(column, lo, hi)).agg(F.avg(N.double(column)).alias("m")).first()["m"]
    return math.nan if mean is None else truncated_mean_scale(mean, lo, hi)


def on_time(df: DataFrame, column: str) -> float:
    """Mean on time in frames of geometric counts from 1: -1 / ln(1 - 1 / mean)."""
    mean = df.where(N.double(column) >= 1).agg(F.avg(N.double(column)).alias("m")).first()["m"]
    return math.nan if mean is None else 0.0 if mean <= 1 else -1 / math.log(1 - 1 / mean)


def precision_scale(df: DataFrame, column: str) -> float:
    """a of p(s) = 2 a / s^3 exp(-a / s^2) by maximum likelihood: rows over the sum of 1 / s^2."""
    x = F.when(N.double(column) > 0, N.present(column))
    r = df.agg(F.count(x).alias("n"), F.sum(1 / (x * x)).alias("s")).first()
    return r["n"] / r["s"] if r["n"] else math.nan


def compare_groups(df: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """(group, measure, n, mean, median) of each measure in each group."""
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), N.present(m).alias("v")) for m in measures])).alias("r")).select(group, "r.*")
    return long.groupBy(group, "measure").agg(F.count("v").alias("n"), N.filled(F.avg("v")).alias("mean"), N.filled(F.median("v")).alias("median"))


def mean_curves(df: DataFrame, group: str, array: str) -> DataFrame:
    """(group, at, mean, sd, sem, n) by grid point of arrays on one grid, NaN left out."""
    long = df.select(group, F.posexplode(array).alias("at", "v")).withColumn("v", N.present("v"))
    return long.groupBy(group, "at").agg(N.filled(F.avg("v")).alias("mean"), N.filled(F.stddev_samp("v")).alias("sd"), N.filled(F.try_divide(F.stddev_samp("v"), F.sqrt(F.count("v")))).alias("sem"), F.count("v").alias("n"))


def cluster_shape(df: DataFrame, key: str, x: str = "x_nm", y: str = "y_nm") -> DataFrame:
    """Size, extent, axes and orientation of each cluster from its covariance."""
    a, b, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    g = df.where(F.col(key) >= 0).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), a.alias("a"), b.alias("b"), c.alias("c"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 4 + F.col("c") * F.col("c"))
    return g.select(key, "n", "x", "y", "width", "height", F.sqrt(half + root).alias("major"), F.sqrt(F.greatest(half - root, F.lit(0.0))).alias("minor"), (0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))).alias("angle"))


def ids_present(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_id(c)]
