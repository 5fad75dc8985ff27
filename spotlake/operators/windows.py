"""Operators along traces: rows of one id in the order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .storage import numbered


def along(key: str, time: str, row: str = "row_id"):
    return Window.partitionBy(key).orderBy(time, row)


def trace_index(df: DataFrame, key: str = "tid", time: str = "time_s", row: str = "row_id") -> DataFrame:
    """1, 2, 3 … within each trace."""
    return df.withColumn("trace_index", F.row_number().over(along(key, time, row)))


def leading_index(df: DataFrame, final: str, key: str = "tid", time: str = "time_s", row: str = "row_id") -> DataFrame:
    """1 and the number of final rows of the trace before this one."""
    w = along(key, time, row).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("leading_index", 1 + F.coalesce(F.sum(F.col(final).cast("int")).over(w), F.lit(0)))


def steps(df: DataFrame, key: str, time: str, x: str = "x_nm", y: str = "y_nm", row: str = "row_id") -> DataFrame:
    """Distance to the trace's row before; NaN for its first."""
    w = along(key, time, row)
    return df.withColumn("step", N.filled(F.hypot(N.double(x) - F.lag(N.double(x)).over(w), N.double(y) - F.lag(N.double(y)).over(w))))


def rolling_std(df: DataFrame, column: str, window: int, key: str, time: str, row: str = "row_id") -> DataFrame:
    """Sample deviation of the rows from i - w // 2 to before i + w - w // 2; NaN below 3 values."""
    w = along(key, time, row).rowsBetween(-(window // 2), window - window // 2 - 1)
    x = N.present(column)
    return df.withColumn("rolling_std", N.filled(F.when(F.count(x).over(w) >= 3, F.stddev_samp(x).over(w))))


def smoothed(df: DataFrame, column: str, n: int, key: str, time: str, statistic: str = "mean", row: str = "row_id") -> DataFrame:
    w = along(key, time, row).rowsBetween(-(n // 2), n - n // 2 - 1)
    f = {"mean": F.avg, "median": F.median}[statistic]
    return df.withColumn("smoothed", N.filled(f(N.present(column)).over(w)))


def first_and_last(df: DataFrame, column: str, key: str, time: str, row: str = "row_id") -> DataFrame:
    w = along(key, time, row).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"first_{column}": F.first(column).over(w), f"last_{column}": F.last(column).over(w)})


def consecutive_precision(df: DataFrame, column: str, key: str, time: str, row: str = "row_id") -> DataFrame:
    """(key, precision): deviation of differences in a row over the root of two."""
    d = df.withColumn("__d", N.present(column) - F.lag(N.present(column)).over(along(key, time, row)))
    return d.groupBy(key).agg(N.filled(F.stddev_samp("__d") / F.sqrt(F.lit(2.0))).alias("precision"))


def before_first_above(df: DataFrame, column: str, limit: float, key: str, time: str, row: str = "row_id") -> DataFrame:
    """Rows of each trace before the first that exceeds the limit."""
    w = along(key, time, row).rowsBetween(Window.unboundedPreceding, 0)
    over = F.max(N.compare(">", N.double(column), F.lit(limit)).cast("int")).over(w)
    return df.withColumn("__over", over).where("__over = 0").drop("__over")


def dark_frames(blinks: DataFrame, key: str = "molecule", first: str = "first", last: str = "last", row: str = "row_id") -> DataFrame:
    """Dark frames before each blink: to the latest end so far; NaN for a molecule's first and for overlaps."""
    w = Window.partitionBy(key).orderBy(first, row).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col(first) - F.max(last).over(w) - 1
    return blinks.withColumn("dark", N.filled(F.when(gap >= 0, gap)))


def bursts(df: DataFrame, gap: Column, limit: float, key: str, time: str, row: str = "row_id") -> DataFrame:
    """A burst number from 0 within each molecule: a new one where the gap is above the limit."""
    w = along(key, time, row)
    new = F.when(N.compare(">", N.double(gap), F.lit(limit)), 1).otherwise(0)
    return df.withColumn("burst", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(df: DataFrame, key: str, time: str, limit: float, row: str = "row_id") -> DataFrame:
    """Bursts by the time since the row before."""
    w = along(key, time, row)
    t = N.double(F.col(time))
    d = df.withColumn("__gap", t - F.lag(t).over(w))
    return bursts(d, F.coalesce("__gap", F.lit(float("nan"))), limit, key, time, row).drop("__gap")


def ranked_by_size(df: DataFrame, cluster: str = "cluster_id", row: str = "row_id") -> DataFrame:
    """Clusters numbered from 1, the largest first (ties by first row), with n_in_cluster; -1 for none."""
    size = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count(F.lit(1)).alias("n_in_cluster"), F.min(row).alias("__first"))
    rank = numbered(size, "__rank", F.desc("n_in_cluster"), F.asc("__first")).withColumn("__rank", F.col("__rank") + 1)
    both = df.drop("n_in_cluster").join(rank.select(cluster, "n_in_cluster", "__rank"), cluster, "left")
    return both.withColumn(cluster, F.coalesce("__rank", F.lit(-1))).withColumn("n_in_cluster", F.coalesce("n_in_cluster", F.lit(0))).drop("__rank")


def cumulative_count(df: DataFrame, key: str, row: str = "row_id") -> DataFrame:
    return df.withColumn("count_so_far", F.row_number().over(Window.partitionBy(key).orderBy(row)) - 1)


def strictly_increasing(df: DataFrame, column: str, key: str, row: str = "row_id") -> DataFrame:
    """(key, increasing): whether all differences along the rows are positive."""
    d = df.withColumn("__d", N.double(column) - F.lag(N.double(column)).over(Window.partitionBy(key).orderBy(row)))
    return d.groupBy(key).agg(F.coalesce(F.bool_and(F.col("__d") > 0), F.lit(True)).alias("increasing"))


def lag_sums(df: DataFrame, max_lag: int, key: str = "track_id", frame: str = "frame", x: str = "x_nm", y: str = "y_nm") -> DataFrame:
    """(key, lag, sum, n): squared displacements of rows exactly ``lag`` frames apart in one track."""
    early = df.where(F.col(key) >= 0).select(key, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(frame), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    early = early.select(key, "lag", "__x", "__y", (F.col(frame) + F.col("lag")).alias(frame))
    both = early.join(df.select(key, frame, x, y), [key, frame])
    dx, dy = N.double(x) - F.col("__x"), N.double(y) - F.col("__y")
    return both.groupBy(key, "lag").agg(F.sum(dx * dx + dy * dy).alias("sum"), F.count(F.lit(1)).alias("n"))


def outcome_table(df: DataFrame, key: str, outcome: str, values: list[str]) -> DataFrame:
    """Counts of each outcome by key, as columns."""
    return df.groupBy(key).pivot(outcome, values).count().na.fill(0)


def outcome_counts(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, outcome, n): the same as rows, for any number of outcomes."""
    return df.groupBy(key, F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
