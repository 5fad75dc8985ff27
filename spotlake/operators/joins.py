"""Joins by distance, time and interval, all reduced to equality on cells or buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nansafe as N
from .storage import carried, cut


def cell_pairs(a: DataFrame, b: DataFrame, radius: float, xy: tuple[str, str] = ("x_nm", "y_nm"), z: str | None = None, z_half: float | None = None, keys: tuple[str, ...] = (), same: bool = False, row: str = "row_id", strict: bool = False) -> DataFrame:
    """Pairs (columns a_*, b_*, d) of rows within ``radius`` in the plane and ``z_half`` along z.

    Cells are ``radius`` wide; the first table is put to its nine cells, the second to its own, so each pair
    meets once. ``keys``: columns that have to agree. ``same``: both are one table, a row doesn't meet itself.
    Without ``z_half`` a z makes the distance three-dimensional. Sides are merged, never broadcast: Spark's estimate of
    a small file doesn't count the nine copies.
    """
    x, y = xy
    cell = lambda c: F.floor(N.double(c) / radius).cast("long")
    ok = N.finite(x) & N.finite(y) & (N.finite(z) if z else F.lit(True))
    keep = list(dict.fromkeys([row, x, y, *([z] if z else []), *keys]))
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    left = a.where(ok).select(*[F.col(c).alias(f"a_{c}") for c in a.columns if c in keep or not same], cell(x).alias("__x"), cell(y).alias("__y"))
    left = left.withColumn("__i", around).withColumn("__x", F.col("__x") + F.col("__i")).withColumn("__i", around).withColumn("__y", F.col("__y") + F.col("__i")).drop("__i")
    right = b.where(ok).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], cell(x).alias("__x"), cell(y).alias("__y"))
    for k in keys:
        left, right = left.withColumn(f"__{k}", F.col(f"a_{k}")), right.withColumn(f"__{k}", F.col(f"b_{k}"))
    pairs = left.join(right.hint("merge"), ["__x", "__y", *[f"__{k}" for k in keys]])
    dx, dy = F.col(f"a_{x}") - F.col(f"b_{x}"), F.col(f"a_{y}") - F.col(f"b_{y}")
    d2 = dx * dx + dy * dy
    if z and z_half is None:
        d2 = d2 + (F.col(f"a_{z}") - F.col(f"b_{z}")) * (F.col(f"a_{z}") - F.col(f"b_{z}"))
    pairs = pairs.withColumn("d", F.sqrt(d2)).where(F.col("d") < radius if strict else F.col("d") <= radius)
    if z and z_half is not None:
        pairs = pairs.where(F.abs(F.col(f"a_{z}") - F.col(f"b_{z}")) <= z_half)
    if same:
        pairs = pairs.where(F.col(f"a_{row}") != F.col(f"b_{row}"))
    return pairs.drop("__x", "__y", *[f"__{k}" for k in keys])


def neighbour_count(around: DataFrame, others: DataFrame, radius: float, same: bool = False, gaussian: float | None = None, row: str = "row_id", **of) -> DataFrame:
    """(row, n) of every row of ``around``: neighbours within ``radius``, or with ``gaussian`` (sigma) their weight."""
    reach = radius if gaussian is None else 3 * gaussian
    pairs = cell_pairs(around, others, reach, same=same, row=row, **of)
    weight = F.lit(1.0) if gaussian is None else F.exp(-F.col("d") * F.col("d") / (2 * gaussian * gaussian))
    found = pairs.groupBy(F.col(f"a_{row}").alias(row)).agg((F.count(F.lit(1)) if gaussian is None else F.sum(weight)).alias("n"))
    return around.select(row).join(found, row, "left").select(row, F.coalesce("n", F.lit(0)).alias("n"))


_STATISTIC = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_pop}


def neighbour_statistic(around: DataFrame, others: DataFrame, column: str, radius: float, statistic: str = "median", quantile: float = 0.5, row: str = "row_id", **of) -> DataFrame:
    """(row, value): a statistic of the neighbours' finite values, a row of the same table counting itself."""
    pairs = cell_pairs(around, others, radius, row=row, **of)
    x = F.when(N.finite(f"b_{column}"), N.double(f"b_{column}"))
    value = F.percentile(x, quantile) if statistic == "quantile" else _STATISTIC[statistic](x)
    found = pairs.groupBy(F.col(f"a_{row}").alias(row)).agg(value.alias("value"))
    return around.select(row).join(found, row, "left").select(row, N.filled("value").alias("value"))


def near_any(a: DataFrame, b: DataFrame, radius: float, row: str = "row_id", **of) -> DataFrame:
    """Rows of ``a`` with a row of ``b`` within ``radius`` (same keys)."""
    hit = cell_pairs(a, b, radius, row=row, **of).select(F.col(f"a_{row}").alias(row)).distinct()
    return a.join(hit, row, "left_semi")


def pair_histogram(a: DataFrame, b: DataFrame, r_max: float, dr: float, same: bool = False, **of) -> DataFrame:
    """(bin, n): ordered pairs closer than ``r_max``, by distance."""
    pairs = cell_pairs(a, b, r_max, same=same, strict=True, **of)
    return pairs.groupBy(F.floor(F.col("d") / dr).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Rows of the other table that a row meets in its own cell on average, at most, where a search begins.
MET = 8.0


def first_reach(a: DataFrame, b: DataFrame, radius: float, keys: tuple[str, ...] = (), xy: tuple[str, str] = ("x_nm", "y_nm")) -> float:
    """``radius``, or less where tables are dense: what cells of that size make a row of ``a`` meet is bounded by ``MET``, as far as places differ."""
    side = lambda d, n: d.select(*keys, *[N.double(c).alias(k) for c, k in zip(xy, ("__x", "__y"))], F.lit(n).alias("__n"))
    both, before = side(a, 1).unionByName(side(b, 0)).where(N.finite("__x") & N.finite("__y")), None
    while True:
        cells = both.groupBy(*keys, *[F.floor(F.col(c) / radius).alias(c) for c in ("__x", "__y")]).agg(F.sum("__n").cast("double").alias("p"), F.sum(1 - F.col("__n")).alias("q"))
        got = cells.agg(F.sum(F.col("p") * F.col("q")).alias("pairs"), F.sum("p").alias("n")).first()
        mean = (got["pairs"] or 0.0) / (got["n"] or 1.0)
        if mean <= MET or before is not None and mean > 0.9 * before:
            return radius
        radius, before = radius * max((MET / mean) ** 0.5 * 0.9, 1 / 16), mean


def nearest_neighbours(a: DataFrame, b: DataFrame, k: int, first_radius: float, same: bool = False, row: str = "row_id", **of) -> DataFrame:
    """(row, rank, d): the k nearest of each row with a finite place, infinity where ``b`` has fewer (of its keys).

    The radius doubles until every row has as many as there are. It begins at ``first_radius``, or at less where that would meet many rows, so
    pairs grow with the rows and not with their square. Of rows at one place no more than k and the row itself can count.
    """
    xy, keys, z = of.get("xy", ("x_nm", "y_nm")), list(of.get("keys", ())), of.get("z")
    placed = lambda d: d.where(N.finite(xy[0]) & N.finite(xy[1]))
    a, b, done = placed(a), placed(b), None
    there = cut(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__there")))
    place = Window.partitionBy(*keys, *[N.double(c) + 0.0 for c in (*xy, *([z] if z else []))]).orderBy(row)
    b = cut(b.withColumn("__turn", F.row_number().over(place)).where(F.col("__turn") <= k + int(same)).drop("__turn"))
    need = F.least(F.lit(k), F.coalesce("__there", F.lit(0)) - int(same)).alias("__need")
    left = a.join(there, keys, "left") if keys else a.crossJoin(there)  # one row
    left = cut(left.select(*a.columns, need).where("__need > 0"))
    radius = first_reach(left, b, first_radius, tuple(keys), xy)
    while not left.isEmpty():
        pairs = cell_pairs(left, b, radius, same=same, row=row, **of).select(F.col(f"a_{row}").alias(row), "d", F.col(f"b_{row}").alias("__o"))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(row).orderBy("d", "__o"))).where(F.col("rank") <= k)
        ranked = ranked.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(row))).join(left.select(row, "__need").hint("merge"), row)
        ranked = cut(ranked.where(F.col("__n") >= F.col("__need")).select(row, "rank", "d"))
        done = ranked if done is None else done.union(ranked)
        left = cut(left.join(ranked.select(row).distinct(), row, "left_anti"))
        radius *= 2
    ranks = a.select(row, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    if done is None:
        return ranks.withColumn("d", F.lit(float("inf")))
    return ranks.join(done, [row, "rank"], "left").select(row, "rank", F.coalesce("d", F.lit(float("inf"))).alias("d"))


def nearest_within(a: DataFrame, b: DataFrame, radius: float, xy: tuple[str, str] = ("x_nm", "y_nm"), row: str = "row_id") -> DataFrame:
    """(a, b, d): the nearest row of ``b`` within ``radius`` of each row of ``a`` that has one (ties: smaller row).

    As in ``nearest_neighbours`` the reach begins small and doubles for the rows that found none.
    """
    places = lambda d: d.select(row, *[(N.double(c) + 0.0).alias(c) for c in xy]).where(N.finite(xy[0]) & N.finite(xy[1]))
    left, b, done = cut(places(a)), cut(places(b).groupBy(*xy).agg(F.min(row).alias(row))), None
    reach = min(first_reach(left, b, radius, (), xy), radius)
    while True:
        pairs = cell_pairs(left, b, reach, xy=xy, row=row)
        found = cut(pairs.groupBy(F.col(f"a_{row}").alias("a")).agg(F.min(F.struct("d", F.col(f"b_{row}").alias("b"))).alias("m")).select("a", "m.b", "m.d"))
        done = found if done is None else done.union(found)
        if reach >= radius:
            return done
        left = cut(left.join(found.select(F.col("a").alias(row)), row, "left_anti"))
        if left.isEmpty():
            return done
        reach = min(2 * reach, radius)


def lag_pairs(df: DataFrame, max_jump: float, memory: int = 0, frame: str = "frame", keys: tuple[str, ...] = (), row: str = "row_id", xy: tuple[str, str] = ("x_nm", "y_nm"), z: str | None = None) -> DataFrame:
    """(a, b, lag, d): rows up to memory + 1 frames apart and within ``max_jump``: candidates of tracking.

    Frames are in blocks of memory + 1: the early row is put to its own block and the next, the late one to its own.
    """
    span = memory + 1
    block = F.floor(F.col(frame) / span).cast("long")
    cols = [F.col(c) for c in dict.fromkeys([row, *xy, *([z] if z else []), *keys])] + [F.col(frame).alias("__f")]
    early, late = df.select(*cols, F.explode(F.array(block, block + 1)).alias("__frame")), df.select(*cols, block.alias("__frame"))
    pairs = cell_pairs(early, late, max_jump, xy=xy, z=z, keys=(*keys, "__frame"), row=row)
    lag = F.col("b___f") - F.col("a___f")
    pairs = pairs.where((lag >= 1) & (lag <= span) & (lag == F.floor(lag)))
    return pairs.select(F.col(f"a_{row}").alias("a"), F.col(f"b_{row}").alias("b"), lag.cast("int").alias("lag"), "d")


def nearest_in_time(left: DataFrame, right: DataFrame, time: str, value: list[str], keys: tuple[str, ...] = (), max_dt: float | None = None, row: str = "row_id") -> DataFrame:
    """``left`` with dt and the columns ``value`` of the row of ``right`` that is nearest in time (the earlier on a tie).

    One union and two windows; NULL where none is within ``max_dt``.
    """
    got = F.struct(F.col(time).alias("t"), *[F.col(v).alias(v) for v in value])
    both = left.withColumns({"__left": F.lit(True), "__got": F.lit(None).cast(right.select(got.alias("g")).schema["g"].dataType)})
    other = right.select(*keys, F.col(time), F.lit(False).alias("__left"), got.alias("__got"))
    both = both.unionByName(other, allowMissingColumns=True)
    t = N.double(time)
    if keys:
        before = F.last("__got", True).over(Window.partitionBy(*keys).orderBy(F.col(time), F.col("__left")).rowsBetween(Window.unboundedPreceding, 0))
        after = F.last("__got", True).over(Window.partitionBy(*keys).orderBy(F.desc(time), F.col("__left")).rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumns({"__before": before, "__after": after}).where("__left")
    else:
        both = carried(both, "__got", time, "__left").where("__left")
    far = lambda c: F.abs(N.double(F.col(c)["t"]) - t)
    use = F.when(F.col("__after").isNull() | (F.coalesce(far("__before"), F.lit(float("inf"))) <= F.coalesce(far("__after"), F.lit(float("inf")))), F.col("__before")).otherwise(F.col("__after"))
    both = both.withColumn("__use", use).withColumn("dt", N.double(F.col("__use")["t"]) - t)
    ok = F.abs(F.col("dt")) <= max_dt if max_dt is not None else F.lit(True)
    return both.select(*left.columns, F.when(ok, F.col("dt")).alias("dt"), *[F.when(ok, F.col("__use")[v]).alias(f"near_{v}") for v in value])


def overlapping(a: DataFrame, b: DataFrame, width: float, keys: tuple[str, ...] = (), least: float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of closed intervals with an overlap of at least ``least`` (columns a_*, b_*, overlap).

    Intervals are put to the time buckets (of ``width``) that they touch; a pair counts in the bucket of the
    later start, so it comes once.
    """
    bucket = lambda c: F.floor(N.double(c) / width).cast("long")
    put = lambda d, p: d.select(*[F.col(c).alias(f"{p}{c}") for c in d.columns], *[F.col(k).alias(f"__{k}") for k in keys], F.explode(F.sequence(bucket(start), bucket(end))).alias("__b"))
    pairs = put(a, "a_").join(put(b, "b_").hint("merge"), ["__b", *[f"__{k}" for k in keys]])
    late, early = F.greatest(f"a_{start}", f"b_{start}"), F.least(f"a_{end}", f"b_{end}")
    pairs = pairs.withColumn("overlap", (early - late).cast("double")).where(F.col("overlap") >= least).where(F.col("__b") == F.floor(late.cast("double") / width).cast("long"))
    return pairs.drop("__b", *[f"__{k}" for k in keys])


def lookup(df: DataFrame, other: DataFrame, key: str, missing: float = float("nan")) -> DataFrame:
    """Values of a table with one row a key onto the rows; NaN for floats and 0 or -1 for others that miss."""
    from .tables import fill_missing

    return fill_missing(df.join(other, key, "left"), [c for c in other.columns if c != key])


def last_frames(ids: DataFrame, df: DataFrame, key: str = "group_id", frame: str = "frame") -> DataFrame:
    found = df.groupBy(key).agg(F.max(frame).alias("last"))
    return ids.join(found, key, "left").withColumn("last", F.coalesce("last", F.lit(-1)))


def interpolated(df: DataFrame, knots: DataFrame, time: str, values: list[str], keys: tuple[str, ...] = (), row: str = "row_id") -> DataFrame:
    """``df`` with at_* of a curve given at knots, linear between them and constant outside."""
    k = F.struct(N.double(time).alias("t"), *[N.double(v).alias(v) for v in values])
    both = df.withColumns({"__row": F.lit(True), "__k": F.lit(None).cast(knots.select(k.alias("k")).schema["k"].dataType)})
    both = both.unionByName(knots.select(*keys, F.col(time).cast(df.schema[time].dataType).alias(time), F.lit(False).alias("__row"), k.alias("__k")), allowMissingColumns=True)
    if keys:
        w = lambda order: Window.partitionBy(*keys).orderBy(order, F.col("__row")).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({"__lo": F.last("__k", True).over(w(F.asc(time))), "__hi": F.last("__k", True).over(w(F.desc(time)))}).where("__row")
    else:
        both = carried(both, "__k", time, "__row").where("__row").withColumnsRenamed({"__before": "__lo", "__after": "__hi"})
    lo, hi, t = F.coalesce("__lo", "__hi"), F.coalesce("__hi", "__lo"), N.double(time)
    part = F.when(hi["t"] > lo["t"], (t - lo["t"]) / (hi["t"] - lo["t"])).otherwise(F.lit(0.0))
    return both.select(*df.columns, *[(lo[v] + (hi[v] - lo[v]) * part).alias(f"at_{v}") for v in values])


def members(rows: DataFrame, regions: DataFrame, size: float, x: str = "x_nm", y: str = "y_nm", row: str = "row_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(region_id, row): rows in circles or boxes given as region_id, cx, cy, and radius or half_x, half_y.

    Optional bounds of a region: frame_lo, frame_hi. Regions are put to the grid cells (``size``) they touch.
    """
    half = lambda c: F.col("radius") if "radius" in regions.columns else F.col(f"half_{c}")
    span = lambda c: F.explode(F.sequence(F.floor((F.col(f"c{c}") - half(c)) / size).cast("long"), F.floor((F.col(f"c{c}") + half(c)) / size).cast("long")))
    put = regions.withColumn("__x", span("x")).withColumn("__y", span("y"))
    cells = rows.where(N.finite(x) & N.finite(y)).withColumns({"__x": F.floor(N.double(x) / size).cast("long"), "__y": F.floor(N.double(y) / size).cast("long")})
    both = cells.join(put, ["__x", "__y", *keys])
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    both = both.where(dx * dx + dy * dy <= F.col("radius") * F.col("radius") if "radius" in regions.columns else (F.abs(dx) <= F.col("half_x")) & (F.abs(dy) <= F.col("half_y")))
    if "frame_lo" in regions.columns:
        both = both.where((F.col("frame") >= F.col("frame_lo")) & (F.col("frame") <= F.col("frame_hi")))
    return both.select("region_id", row)


def values_onto(rows: DataFrame, member: DataFrame, values: DataFrame, rule: str = "last", row: str = "row_id") -> DataFrame:
    """A region's value on its rows; of several: last or first (by region_id), mean, or any (a flag); NaN in none."""
    v = N.double("value")
    made = {"last": F.max_by(v, "region_id"), "first": F.min_by(v, "region_id"), "mean": F.avg(N.present("value")), "any": F.max(F.when(v != 0, 1.0).otherwise(0.0))}[rule]
    found = member.join(values, "region_id").groupBy(row).agg(made.alias("value"))
    return rows.join(found, row, "left").withColumn("value", N.filled("value"))


def region_filter(rows: DataFrame, member: DataFrame, passed: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows in at least one region that passed; rows in no region are out. Apply once for each source."""
    return rows.join(member.join(passed.select("region_id"), "region_id").select(row).distinct(), row, "left_semi")


def outer_align(tables: dict[str, DataFrame], key: str = "region_id") -> DataFrame:
    """Full outer join of evaluations on the region, columns as alias_value, missing as NaN."""
    out = None
    for alias, t in tables.items():
        t = t.select(key, *[F.col(c).alias(f"{alias}_{c}") for c in t.columns if c != key])
        out = t if out is None else out.join(t, key, "full_outer")
    number = {"double", "float"}
    return out.select(key, *[N.filled(c).alias(c) if k in number else F.col(c) for c, k in out.dtypes if c != key])
