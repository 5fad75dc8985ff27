"""Selections, event parts, offsets, rasters and pixel tables as compositions of joins and aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .graph import link_blinks
from .joins import cell_pairs, nearest_within
from .phase import quantile
from .storage import cut, numbered


# Events -----------------------------------------------------------------------------------------------------


def middle_rows(df: DataFrame, key: str, frame: str = "frame", least: int = 1) -> DataFrame:
    """Rows of groups of at least ``least`` rows that lie in neither the first nor the last frame of their group."""
    ends = df.groupBy(key).agg(F.min(frame).alias("__lo"), F.max(frame).alias("__hi"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(ends, key).where((F.col(frame) > F.col("__lo")) & (F.col(frame) < F.col("__hi"))).drop("__lo", "__hi", "__n").select(*df.columns)


def event_cores(df: DataFrame, radius: float, dt: int, least: int, frame: str = "frame", row: str = "row_id", **of) -> DataFrame:
    """The middle rows of linked binding events of at least ``least`` rows, with their group_id.

    Rows are linked within a circle of ``radius``, whatever their precision.
    """
    linked = link_blinks(df.withColumn("__none", F.lit(0.0)), radius, dt, precision="__none", k=1.0, lowest=radius, frame=frame, row=row, **of)
    return middle_rows(linked.drop("__none"), "group_id", frame, least)


# Selections -------------------------------------------------------------------------------------------------


def selection(df: DataFrame, first: Column, second: Column, how: str) -> DataFrame:
    """Rows in both selections, in the first only, in either, or in one of them; a null condition isn't met."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return df.where({"and": a & b, "without": a & ~b, "or": a | b, "xor": a != b}[how])


def with_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """``df`` whose columns carry their bounds as metadata, which Parquet files keep."""
    return df.select(*[F.col(c).alias(c, metadata={"bounds": json.dumps(bounds[c])}) if c in bounds else F.col(c) for c in df.columns])


def kept_bounds(df: DataFrame) -> DataFrame:
    """The rows within the bounds that the columns carry."""
    for f in df.schema:
        lo, hi = json.loads(f.metadata.get("bounds", "[null, null]"))
        df = df if lo is None else df.where(F.col(f.name) >= lo)
        df = df if hi is None else df.where(F.col(f.name) <= hi)
    return df


def time_halves(df: DataFrame, blocks: int, frame: str = "frame", seed: int | None = None) -> DataFrame:
    """A column half (0 or 1): equal blocks of frames in turn, or with a ``seed`` by a hash of the block."""
    span = df.agg(F.min(frame).alias("__lo"), F.max(frame).alias("__hi"))  # one row
    block = F.least(F.floor((F.col(frame) - F.col("__lo")) * blocks / (F.col("__hi") - F.col("__lo") + 1)), F.lit(blocks - 1))
    half = block % 2 if seed is None else F.pmod(F.xxhash64(block, F.lit(seed)), F.lit(2))
    return df.crossJoin(F.broadcast(span)).withColumn("half", half.cast("int")).drop("__lo", "__hi")


def column_scan(df: DataFrame, column: str, start: float, step: float, width: float, steps: int, value: str) -> DataFrame:
    """(step, lo, n, mean) of a range of ``width`` that moves along a column; a row is put to the ranges it lies in."""
    x = N.double(column)
    last = F.least(F.floor((x - start) / step), F.lit(steps - 1))
    first = F.greatest(F.floor((x - start - width) / step) + 1, F.lit(0))
    rows = df.where(N.finite(column)).select(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).alias("s"), N.double(value).alias("v"))
    return rows.select(F.explode("s").alias("step"), "v").groupBy("step").agg((start + F.col("step") * step).alias("lo"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


def valley(df: DataFrame, column: str, lo: float, hi: float, bins: int, apart: int) -> DataFrame:
    """(peak, second, valley): the fullest bin, the fullest at least ``apart`` bins away, and the emptiest between them."""
    width = (hi - lo) / bins
    x = N.double(column)
    full = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    h = df.where((x >= lo) & (x < hi)).groupBy(F.floor((x - lo) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    h = cut(full.join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n")))  # ``bins`` rows
    top = h.agg(F.min(F.struct(-F.col("n"), "bin")).alias("m")).select(F.col("m.bin").alias("peak"))
    other = h.crossJoin(top).where(F.abs(F.col("bin") - F.col("peak")) >= apart).groupBy("peak").agg(F.min(F.struct(-F.col("n"), "bin")).alias("m")).select("peak", F.col("m.bin").alias("second"))
    inside = h.crossJoin(other).where((F.col("bin") > F.least("peak", "second")) & (F.col("bin") < F.greatest("peak", "second")))
    return inside.groupBy("peak", "second").agg(F.min(F.struct("n", "bin")).alias("m")).select("peak", "second", F.col("m.bin").alias("valley"))


def first_present(df: DataFrame, names: list[str], chosen: str | None = None) -> str:
    """The chosen column, or the first of a list that the table has."""
    if chosen:
        if chosen not in df.columns:
            raise ValueError(f"no column {chosen}")
        return chosen
    found = next((n for n in names if n in df.columns), None)
    if found is None:
        raise ValueError(f"none of {', '.join(names)}")
    return found


# Ids --------------------------------------------------------------------------------------------------------


def replaced_ids(whole: DataFrame, again: DataFrame, ident: str, row: str = "row_id") -> DataFrame:
    """``whole`` with the ids of the rows that ``again`` holds replaced; new ids go above the old, -1 stays none."""
    top = whole.agg((F.coalesce(F.max(ident), F.lit(-1)) + 1).alias("__top"))  # one row
    new = again.select(row, F.col(ident).alias("__new"), F.lit(True).alias("__read"))
    out = whole.join(new, row, "left").crossJoin(F.broadcast(top))
    fresh = F.when(F.col("__new") >= 0, F.col("__new") + F.col("__top")).otherwise(F.lit(-1))
    return out.withColumn(ident, F.when(F.col("__read"), fresh).otherwise(F.col(ident))).select(*whole.columns)


def regions_of_ids(df: DataFrame, key: str, xy: tuple[str, str] = ("x_nm", "y_nm")) -> DataFrame:
    """(key, x, y, radius, n): a circle around the mean place of each id's rows that holds all of them."""
    x, y = (N.double(c) for c in xy)
    mid = df.where(F.col(key) >= 0).groupBy(key).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n"))
    far = df.join(mid, key).groupBy(key).agg(F.max(F.hypot(x - F.col("x"), y - F.col("y"))).alias("radius"))
    return mid.join(far, key).select(key, "x", "y", "radius", "n")


def accept_proposals(regions: DataFrame, proposals: DataFrame, apart: float, ident: str = "row_id", xy: tuple[str, str] = ("x_nm", "y_nm")) -> DataFrame:
    """``regions`` and those proposals that are ``apart`` or more from each of them, numbered on from the largest id."""
    near = cell_pairs(proposals, regions, apart, xy=xy, row=ident, strict=True).select(F.col(f"a_{ident}").alias(ident)).distinct()
    new = numbered(proposals.join(near, ident, "left_anti"), "__k", ident)
    top = regions.agg((F.coalesce(F.max(ident), F.lit(-1)) + 1).alias("__top"))  # one row
    new = new.crossJoin(F.broadcast(top)).withColumn(ident, F.col("__k") + F.col("__top"))
    return regions.select(ident, *xy).union(new.select(ident, *xy))


# Places -----------------------------------------------------------------------------------------------------


def mutual_nearest(a: DataFrame, b: DataFrame, tolerance: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(a, b, d): rows of two measurements that are each other's nearest within ``tolerance`` (ties: smaller row)."""
    to_b = cut(nearest_within(a, b, tolerance, xy, row))
    asked = b.join(to_b.select(F.col("b").alias(row)).distinct().hint("merge"), row, "left_semi")
    to_a = nearest_within(asked, a, tolerance, xy, row).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return to_b.join(to_a.hint("merge"), ["a", "b"])


def channel_offset(a: DataFrame, b: DataFrame, tolerance: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(dx, dy, n): median offset from a to b of mutually nearest rows; no task holds all offsets."""
    x, y = xy
    m = mutual_nearest(a, b, tolerance, xy, row)
    m = m.join(a.select(F.col(row).alias("a"), N.double(x).alias("xa"), N.double(y).alias("ya")), "a").join(b.select(F.col(row).alias("b"), N.double(x).alias("xb"), N.double(y).alias("yb")), "b")
    m = cut(m.select((F.col("xb") - F.col("xa")).alias("dx"), (F.col("yb") - F.col("ya")).alias("dy")))
    return a.sparkSession.createDataFrame([(quantile(m, F.col("dx")), quantile(m, F.col("dy")), m.count())], "dx double, dy double, n long")


def offset_histogram(a: DataFrame, b: DataFrame, reach: float, width: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(ix, iy, n): pairs of rows closer than ``reach``, by the bin of their offset on each axis."""
    x, y = xy
    pairs = cell_pairs(a, b, reach, xy=xy, row=row, strict=True).select(F.col(f"a_{row}").alias("a"), F.col(f"b_{row}").alias("b"))
    pairs = pairs.join(a.select(F.col(row).alias("a"), N.double(x).alias("xa"), N.double(y).alias("ya")), "a").join(b.select(F.col(row).alias("b"), N.double(x).alias("xb"), N.double(y).alias("yb")), "b")
    bins = [F.floor((F.col(f"{c}b") - F.col(f"{c}a")) / width).cast("long").alias(f"i{c}") for c in "xy"]
    return pairs.groupBy(*bins).agg(F.count(F.lit(1)).alias("n"))


def cell_order(df: DataFrame, size: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """A column place: the rows' turn by cell, row of cells after row, and by row within a cell."""
    cx, cy = (F.floor(N.double(c) / size) for c in xy)
    return numbered(df.withColumns({"__cx": cx, "__cy": cy}), "place", "__cy", "__cx", row).drop("__cx", "__cy")


def spread_selection(df: DataFrame, key: str, value: str, factor: float = 3.0, rounds: int = 10, least: int = 3) -> DataFrame:
    """(key, spread, kept): beads whose spread is within ``factor`` scaled MADs of the kept ones' median.

    Rejected round by round until nothing changes, or fewer than ``least`` would stay; a round is one aggregate.
    """
    stats = cut(df.groupBy(key).agg(F.stddev_samp(N.double(value)).alias("spread")).where("spread is not null"))
    kept, n = stats, stats.count()
    for _ in range(rounds):
        mid = kept.agg(F.median("spread").alias("m")).first()["m"]
        if mid is None:
            break
        mad = kept.agg(F.median(F.abs(F.col("spread") - mid)).alias("m")).first()["m"]
        inside = kept.where(F.abs(F.col("spread") - mid) <= factor * 1.4826 * mad)
        now = inside.count()
        if now == n or now < least:
            break
        kept, n = cut(inside), now
    return stats.join(kept.select(key, F.lit(True).alias("kept")), key, "left").select(key, "spread", F.coalesce("kept", F.lit(False)).alias("kept"))


# Pixel tables (px, py, value) -------------------------------------------------------------------------------


def occupied(df: DataFrame, size: float, grow: int = 0, xy: tuple[str, str] = ("x_nm", "y_nm")) -> DataFrame:
    """(px, py): pixels with a row in them or, with ``grow``, in one so many pixels away on an axis: an observation window."""
    px, py = (F.floor(N.double(c) / size).cast("long") for c in xy)
    own = df.where(N.finite(xy[0]) & N.finite(xy[1])).select(px.alias("px"), py.alias("py")).distinct()
    return shifted(own, grow).select("px", "py").distinct() if grow else own


def shifted(pixels: DataFrame, reach: int) -> DataFrame:
    """Each pixel's row put to all pixels up to ``reach`` away on both axes."""
    by = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)).alias(c)
    rest = [c for c in pixels.columns if c not in ("px", "py")]
    return pixels.select(by("px"), "py", *rest).select("px", by("py"), *rest)


def without_background(pixels: DataFrame, reach: int) -> DataFrame:
    """(px, py, value): less the mean of the square of pixels around each, absent pixels being 0."""
    mean = shifted(pixels, reach).groupBy("px", "py").agg((F.sum("value") / (2 * reach + 1) ** 2).alias("__b"))
    return pixels.join(mean, ["px", "py"]).select("px", "py", (F.col("value") - F.col("__b")).alias("value"))


def cut_boxes(pixels: DataFrame, centres: DataFrame, reach: int, size: tuple[int, int], ident: str = "row_id") -> DataFrame:
    """(ident, ix, iy, value): the pixels of a square box around each centre; boxes over the image's border are dropped."""
    w, h = size
    inside = (F.col("px") >= reach) & (F.col("py") >= reach) & (F.col("px") < w - reach) & (F.col("py") < h - reach)
    at = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    box = centres.where(inside).select(ident, "px", "py", at.alias("ix")).select(ident, "px", "py", "ix", at.alias("iy"))
    box = box.select(ident, "ix", "iy", (F.col("px") + F.col("ix")).alias("px"), (F.col("py") + F.col("iy")).alias("py"))
    return box.join(pixels, ["px", "py"], "left").select(ident, "ix", "iy", F.coalesce("value", F.lit(0)).alias("value"))


def error_map(image: DataFrame, reference: DataFrame) -> DataFrame:
    """(px, py, error): reference less the image after the least-squares scale and offset, over pixels of either."""
    both = image.select("px", "py", N.double("value").alias("a")).join(reference.select("px", "py", N.double("value").alias("b")), ["px", "py"], "full_outer").na.fill(0.0, ["a", "b"])
    fit = both.agg(F.coalesce(F.regr_slope("b", "a"), F.lit(0.0)).alias("__k"), F.avg("a").alias("__ma"), F.avg("b").alias("__mb"))  # one row
    return both.crossJoin(F.broadcast(fit)).select("px", "py", (F.col("b") - F.col("__mb") - F.col("__k") * (F.col("a") - F.col("__ma"))).alias("error"))


# Counts -----------------------------------------------------------------------------------------------------


def frame_decay(df: DataFrame, frame: str = "frame") -> DataFrame:
    """(median_frame, first, last): the median frame of the rows, and rows a frame in the first and last tenth of the frames."""
    span = df.agg(F.min(frame).alias("__lo"), (F.max(frame) + 1).alias("__hi"))  # one row
    tenth = (F.col("__hi") - F.col("__lo")) / 10
    rate = lambda cond: F.count_if(cond) / F.first(tenth)
    rows = df.crossJoin(F.broadcast(span))
    return rows.agg(F.median(frame).alias("median_frame"), rate(F.col(frame) < F.col("__lo") + tenth).alias("first"), rate(F.col(frame) >= F.col("__hi") - tenth).alias("last"))


def iteration_counts(df: DataFrame, iteration: str, outcome: str, value: str) -> DataFrame:
    """(iteration, outcome, n, part, median): rows by outcome in each iteration, their part of it, and a median."""
    by = df.groupBy(F.col(iteration).alias("iteration"), F.col(outcome).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.median(N.double(value)).alias("median"))
    return by.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy("iteration")))
