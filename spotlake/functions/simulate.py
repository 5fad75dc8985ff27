"""Seeded test data: blinking molecules, tracks and binding sites, the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return (F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *of: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *of))) * F.cos(6.283185307179586 * uniform(seed + 7919, *of))


def blinking(spark: SparkSession, molecules: int | DataFrame, frames: int, blinks: int = 5, on: float = 2.0, size_nm: float = 10_000.0, photons: float = 1000.0, seed: int = 0) -> DataFrame:
    """Rows of molecules at random places, or at those of a table (molecule, x0, y0), with ``blinks`` times on, an exponential number of frames each."""
    m = molecules if isinstance(molecules, DataFrame) else spark.range(molecules).select(F.col("id").alias("molecule"), (uniform(seed, F.col("id")) * size_nm).alias("x0"), (uniform(seed + 1, F.col("id")) * size_nm).alias("y0"))
    b = m.withColumn("blink", F.explode(F.sequence(F.lit(0), F.lit(blinks - 1))))
    b = b.withColumn("first", F.floor(uniform(seed + 2, F.col("molecule"), F.col("blink")) * frames).cast("long")).withColumn("n", F.ceil(-F.log(uniform(seed + 3, F.col("molecule"), F.col("blink"))) * on).cast("int"))
    r = b.withColumn("frame", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + F.greatest(F.col("n"), F.lit(1)) - 1, F.lit(frames - 1)))))
    key = [F.col("molecule"), F.col("blink"), F.col("frame")]
    p = -F.log(uniform(seed + 4, *key)) * photons + 50
    err = 130 / F.sqrt(p)
    r = r.withColumns({"photons": p, "xy_err_nm": err}).withColumns({"x_nm": F.col("x0") + normal(seed + 5, *key) * err, "y_nm": F.col("y0") + normal(seed + 6, *key) * err})
    return r.select(F.xxhash64(*key).alias("row_id"), "molecule", "blink", "frame", "x_nm", "y_nm", "xy_err_nm", "photons")


def tracks(spark: SparkSession, n: int, length: int, d_um2_s: float, frame_s: float, size_nm: float = 10_000.0, seed: int = 0) -> DataFrame:
    """Brownian tracks: running sums of seeded normal steps."""
    from pyspark.sql import Window

    step = (2 * d_um2_s * 1e6 * frame_s) ** 0.5
    t = spark.range(n).select(F.col("id").alias("track_id_true"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("frame"))
    key = [F.col("track_id_true"), F.col("frame")]
    w = Window.partitionBy("track_id_true").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    first = lambda s: uniform(seed + s, F.col("track_id_true")) * size_nm
    return t.select((F.col("track_id_true") * length + F.col("frame")).alias("row_id"), *key, (first(1) + F.sum(normal(seed + 2, *key) * step).over(w)).alias("x_nm"), (first(3) + F.sum(normal(seed + 4, *key) * step).over(w)).alias("y_nm"))


def binding(spark: SparkSession, sites: int | DataFrame, frames: int, bright: float, dark: float, events: int = 50, seed: int = 0) -> DataFrame:
    """(site, event, first, last): alternating exponential dark and bright times within ``frames``, of sites 0, 1, ... or of a table (site)."""
    from pyspark.sql import Window

    e = (sites if isinstance(sites, DataFrame) else spark.range(sites).select(F.col("id").alias("site"))).select("site", F.explode(F.sequence(F.lit(0), F.lit(events - 1))).alias("event"))
    key = [F.col("site"), F.col("event")]
    e = e.withColumns({"__d": F.ceil(-F.log(uniform(seed, *key)) * dark), "__b": F.ceil(-F.log(uniform(seed + 1, *key)) * bright)})
    end = F.sum(F.col("__d") + F.col("__b")).over(Window.partitionBy("site").orderBy("event").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("last", (end - 1).cast("long")).select("site", "event", (F.col("last") - F.col("__b") + 1).cast("long").alias("first"), "last").where(F.col("last") < frames)


def to_frames(df: DataFrame, start: str, end: str, photons: str) -> DataFrame:
    """Time intervals (in frames, fractional) as one row a frame with their part of the photons."""
    last = F.greatest(F.ceil(end) - 1, F.floor(start))
    rows = df.withColumn("frame", F.explode(F.sequence(F.floor(start).cast("long"), last.cast("long"))))
    part = F.greatest(F.least(F.col(end), F.col("frame") + 1) - F.greatest(F.col(start), F.col("frame").cast("double")), F.lit(0.0))
    return rows.withColumn("photons_frame", F.col(photons) * F.coalesce(F.try_divide(part, F.col(end) - F.col(start)), F.lit(1.0)))
