"""Registered queries of the library's own operators over the driver's tables, with the equivalent SQL.

Rows of ``lineitem`` and ``events`` stand for measurements: an event's frame is its minute, its place its
value, and its trace its user; the first two coordinates of an embedding are a place in the plane.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import aggregate as A
from ..operators import filters as L
from ..operators import graph as G
from ..operators import joins as J
from ..operators import tables as S
from ..operators import windows as W

FLAGSHIP = "grouped_lines"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _more()
    return dict(_ORACLES)


def _more() -> None:
    from . import catalog_analysis, catalog_flow, catalog_measure, catalog_structure  # noqa: F401


def r6(c, name: str | None = None):
    """Rounded to six digits: sums of doubles depend on their order."""
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, t (seconds), frame (minute), user_id, event_type, value."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", (t / 1e6).alias("t"), F.floor(t / 60_000_000).cast("long").alias("frame"), "user_id", "event_type", "value")


EV = "WITH ev AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS frame, user_id, event_type, value FROM events)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id as row_id, x_nm, y_nm, label: the plane of the first two coordinates, 1000 to the unit."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("embedding")[0].cast("double") * 1000).alias("x_nm"), (F.col("embedding")[1].cast("double") * 1000).alias("y_nm"), "label")


PT = "WITH pt AS (SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x_nm, CAST(embedding[2] AS DOUBLE) * 1000 AS y_nm, label FROM embeddings)"


@query(
    "grouped_lines",
    """SELECT l_orderkey, count(*) AS n_in_group, round(sum(price * w) / sum(w), 6) AS price, round(sum(l_extendedprice), 6) AS total,
       round(sqrt(sum(l_tax * l_tax)), 6) AS quad, round(1 / sqrt(sum(1 / (l_quantity * l_quantity))), 6) AS precision, min(l_linenumber) AS first_line, max(l_discount) AS top_discount
       FROM (SELECT *, l_extendedprice * (1 - l_discount) AS price, 1 / (l_quantity * l_quantity) AS w FROM lineitem WHERE l_quantity BETWEEN 5 AND 45) GROUP BY l_orderkey""",
)
def _(spark, sf):
    """Range filter, compiled expression and grouping by rules in one plan."""
    df = L.Filters().set("l_quantity", 5, 45).apply(lines(spark, sf))
    df = E.with_expression(df, "price", "l_extendedprice * (1 - l_discount)", exact=True)
    df = df.select("l_orderkey", "price", F.col("l_quantity").alias("price_err"), F.col("l_extendedprice").alias("total"), F.col("l_tax").alias("quad"), F.col("l_quantity").alias("precision"), F.col("l_linenumber").alias("first_line"), F.col("l_discount").alias("top_discount"))
    g = A.combine(df, ["l_orderkey"], ["price", "total", "quad", "precision", "first_line", "top_discount"], {"total": "sum", "quad": "quad", "precision": "precision", "first_line": "min", "top_discount": "max"})
    return g.select("l_orderkey", "n_in_group", *[r6(c, c) for c in ("price", "total", "quad", "precision")], "first_line", "top_discount")


@query("range_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount <= 0.05")
def _(spark, sf):
    return L.Filters().set("l_quantity", 10, 20).set("l_discount", None, 0.05).apply(lines(spark, sf)).select("l_orderkey", "l_linenumber")


@query("inverted_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity BETWEEN 10 AND 20)")
def _(spark, sf):
    return L.Filters().set("l_quantity", 10, 20, invert=True).apply(lines(spark, sf)).select("l_orderkey", "l_linenumber")


@query("mask_without", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.05")
def _(spark, sf):
    f = L.Filters().set("l_quantity", 10, 20).set("l_discount", None, 0.05)
    return lines(spark, sf).where(f.mask(without=("l_quantity",))).select("l_orderkey", "l_linenumber")


@query("filter_counts", "SELECT 'l_quantity' AS filter, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 UNION ALL SELECT 'l_discount', count(*) FROM lineitem WHERE l_discount <= 0.05 UNION ALL SELECT 'late', count(*) FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, sf):
    f = L.Filters().set("l_quantity", 10, 20).set("l_discount", None, 0.05).set_mask("late", F.col("l_returnflag") == "R")
    return f.counts(lines(spark, sf))


@query("value_range", "SELECT round(quantile_cont(l_extendedprice, 0.001), 6) AS lo, round(quantile_cont(l_extendedprice, 0.999), 6) AS hi FROM lineitem")
def _(spark, sf):
    return L.quantile_range(lines(spark, sf), "l_extendedprice").select(r6("lo", "lo"), r6("hi", "hi"))


@query(
    "display_range",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) a, quantile_cont(l_extendedprice, 0.25) b, quantile_cont(l_extendedprice, 0.75) c, quantile_cont(l_extendedprice, 0.99) d FROM lineitem)
       SELECT round(greatest(a, b - 3 * (c - b)), 6) AS lo, round(least(d, c + 3 * (c - b)), 6) AS hi FROM q""",
)
def _(spark, sf):
    return L.display_range(lines(spark, sf), "l_extendedprice").select(r6("lo", "lo"), r6("hi", "hi"))


@query("mad_cut", "WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem), s AS (SELECT median(abs(l_extendedprice - m)) AS s FROM lineitem, m) SELECT l_orderkey, l_linenumber FROM lineitem, m, s WHERE l_extendedprice <= m + 1.5 * 1.4826 * s")
def _(spark, sf):
    return L.mad_cut(lines(spark, sf), "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber")


@query("below_quantile", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.2) FROM lineitem)")
def _(spark, sf):
    return L.below_quantile(lines(spark, sf), "l_extendedprice", 0.2).select("l_orderkey", "l_linenumber")


@query("shape_circle", f"{PT} SELECT row_id FROM pt WHERE (x_nm - 20) * (x_nm - 20) + (y_nm - 10) * (y_nm - 10) <= 8100")
def _(spark, sf):
    return points(spark, sf).where(L.Shape("circle", (20, 10, 90)).inside(F.col("x_nm"), F.col("y_nm"))).select("row_id")


@query("shape_ellipse", f"{PT}, r AS (SELECT row_id, (x_nm - 5) * cos(0.5) + (y_nm + 5) * sin(0.5) AS u, (y_nm + 5) * cos(0.5) - (x_nm - 5) * sin(0.5) AS v FROM pt) SELECT row_id FROM r WHERE u * u / 14400 + v * v / 3600 <= 1")
def _(spark, sf):
    return points(spark, sf).where(L.Shape("ellipse", (5, -5, 120, 60, 0.5)).inside(F.col("x_nm"), F.col("y_nm"))).select("row_id")


@query("shape_polygon", f"{PT} SELECT row_id FROM pt WHERE y_nm >= -80 AND y_nm <= 100 - 1.8 * abs(x_nm)")
def _(spark, sf):
    return points(spark, sf).where(L.Shape("polygon", points=((-100, -80), (100, -80), (0, 100))).inside(F.col("x_nm"), F.col("y_nm"))).select("row_id")


@query("rim_distance", f"{PT} SELECT row_id, round(CASE WHEN x_nm < -50 THEN sqrt((x_nm + 50) ** 2 + y_nm ** 2) WHEN x_nm > 50 THEN sqrt((x_nm - 50) ** 2 + y_nm ** 2) ELSE abs(y_nm) END, 6) AS d FROM pt")
def _(spark, sf):
    d = L.Shape("line", points=((-50, 0), (50, 0)), width=20).distance(F.col("x_nm"), F.col("y_nm"))
    return points(spark, sf).select("row_id", r6(d, "d"))


@query("remove_region", f"{PT} SELECT row_id FROM pt WHERE NOT (x_nm BETWEEN -60 AND 60 AND y_nm BETWEEN -40 AND 40)")
def _(spark, sf):
    return L.remove_region(points(spark, sf), L.Shape("rect", (-60, -40, 60, 40))).select("row_id")


@query("conditions", "SELECT doc_id FROM documents WHERE (lang IN ('en', 'de') AND n_chars >= 500) OR NOT (n_chars < 2000)")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    return d.where(L.condition("lang in ['en', 'de'] and n_chars >= 500 or not n_chars < 2000", {"lang": F.col("lang"), "n_chars": F.col("n_chars")})).select("doc_id")


@query("top_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber LIMIT 25")
def _(spark, sf):
    df = lines(spark, sf).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return L.top_n(df, 25, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("frame_subset", f"{EV}, m AS (SELECT min(frame) AS f FROM ev) SELECT event_id, frame - f AS frame FROM ev, m WHERE frame >= f + 10 AND frame < f + 500")
def _(spark, sf):
    e = events(spark, sf)
    first = e.agg(F.min("frame").alias("f")).first()["f"] or 0
    return L.frame_subset(e, first + 10, first + 500, -first).select("event_id", "frame")


@query(
    "expr_columns",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN 1.0 ELSE 0.0 END AS big,
       l_orderkey % 7 + l_linenumber // 2 AS code, round(CASE WHEN l_discount = 0 THEN 1e9 ELSE ln(l_discount) END, 6) AS logd, round(least(greatest(l_quantity, 10), 40), 6) AS q FROM lineitem""",
)
def _(spark, sf):
    df = lines(spark, sf)
    for name, text in {"charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "big": "(l_quantity > 25) & (l_discount < 0.05)", "code": "l_orderkey % 7 + l_linenumber // 2", "logd": "where(l_discount == 0, 1e9, log(l_discount))", "q": "clip(l_quantity, 10, 40)"}.items():
        df = E.with_expression(df, name, text, exact=True)
    return df.select("l_orderkey", "l_linenumber", r6("charge", "charge"), "big", "code", r6("logd", "logd"), r6("q", "q"))


@query(
    "expr_reduction",
    """SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) AS z, round(l_quantity - p, 6) AS above
       FROM lineitem, (SELECT median(l_extendedprice) m, stddev_pop(l_extendedprice) s, quantile_cont(l_quantity, 0.9) p FROM lineitem)""",
)
def _(spark, sf):
    df = E.with_expression(lines(spark, sf), "z", "(l_extendedprice - median(l_extendedprice)) / std(l_extendedprice)", exact=True)
    df = E.with_expression(df, "above", "l_quantity - percentile(l_quantity, 90)", exact=True)
    return df.select("l_orderkey", "l_linenumber", r6("z", "z"), r6("above", "above"))


@query("recipes", "SELECT l_orderkey, l_linenumber, CAST(CAST(CAST(l_extendedprice * (1 - l_discount) AS FLOAT) AS DOUBLE) / l_quantity AS FLOAT) AS unit FROM lineitem")
def _(spark, sf):
    r = E.Recipes()
    r.add(E.Recipe("unit", "net / l_quantity"))
    r.add(E.Recipe("net", "l_extendedprice * (1 - l_discount)"))
    return r.apply(lines(spark, sf)).select("l_orderkey", "l_linenumber", "unit")


@query(
    "combine_rules",
    """SELECT l_suppkey, count(*) AS n_in_group, round(sum(l_extendedprice / (l_quantity * l_quantity)) / sum(1 / (l_quantity * l_quantity)), 6) AS x_nm, round(1 / sqrt(sum(1 / (l_quantity * l_quantity))), 6) AS x_err_nm,
       round(sum(l_discount), 6) AS photons, round(sqrt(sum(l_tax * l_tax)), 6) AS photons_err, min(l_linenumber) AS frame, round(atan2(sum(sin(l_quantity)), sum(cos(l_quantity))), 6) AS phase_rad FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, sf):
    df = lines(spark, sf).select("l_suppkey", F.col("l_extendedprice").alias("x_nm"), F.col("l_quantity").alias("x_err_nm"), F.col("l_discount").alias("photons"), F.col("l_tax").alias("photons_err"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("phase_rad"))
    g = A.combine(df, ["l_suppkey"])
    return g.select("l_suppkey", "n_in_group", *[r6(c, c) for c in ("x_nm", "x_err_nm", "photons", "photons_err")], "frame", r6("phase_rad", "phase_rad"))


@query(
    "id_statistics",
    f"""{EV} SELECT user_id, count(*) AS n, round(min(t), 3) AS start, round(max(t), 3) AS "end", round(max(t) - min(t), 3) AS duration, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median,
        round(coalesce(stddev_samp(value), -1), 6) AS value_std, min(value) AS value_min, max(value) AS value_max FROM ev GROUP BY user_id""",
)
def _(spark, sf):
    s = A.id_statistics(events(spark, sf), "user_id", ["value"], time="t")
    return s.select("user_id", "n", *[F.round(c, 3).alias(c) for c in ("start", "end", "duration")], r6("value_mean", "value_mean"), r6("value_median", "value_median"), r6(F.nanvl("value_std", F.lit(-1.0)), "value_std"), "value_min", "value_max")


@query("collapse_ids", f"{EV} SELECT count(*) AS n_merged, round(avg(value), 6) AS value, min(user_id) AS user_id FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN -2 - event_id ELSE user_id END AS g FROM ev) GROUP BY g")
def _(spark, sf):
    e = events(spark, sf).withColumnRenamed("event_id", "row_id").withColumn("key_id", F.when(F.col("user_id") % 5 == 0, -1).otherwise(F.col("user_id")))
    c = A.collapse(e.select("row_id", "key_id", "user_id", "value"), "key_id", columns=["value", "user_id"], rules={"user_id": "min"})
    return c.select("n_merged", r6("value", "value"), "user_id")


@query("dense_ids", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM orders")
def _(spark, sf):
    return S.dense_ids(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "code")


@query("shuffle_ids")
def _(spark, sf):
    return S.shuffle_ids(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey"), "o_custkey", 3)


@query("histogram", "SELECT l_returnflag, CAST(least(floor((l_extendedprice - 1000) / 1980), 49) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 100000 GROUP BY 1, 2")
def _(spark, sf):
    return A.histogram(lines(spark, sf), "l_extendedprice", 1000, 100000, 50, ("l_returnflag",))


@query("describe_values", "SELECT l_returnflag, count(*) FILTER (l_quantity <= 40) AS n, count(*) FILTER (l_quantity > 40) AS outside, round(avg(l_quantity) FILTER (l_quantity <= 40), 6) AS mean, round(median(l_quantity) FILTER (l_quantity <= 40), 6) AS median, round(stddev_pop(l_quantity) FILTER (l_quantity <= 40), 6) AS std FROM lineitem GROUP BY 1")
def _(spark, sf):
    d = A.describe(lines(spark, sf), "l_quantity", 0, 40, ("l_returnflag",))
    return d.select("l_returnflag", "n", "outside", r6("mean", "mean"), r6("median", "median"), r6("std", "std"))


@query("pixel_histogram", f"{PT} SELECT CAST(floor((y_nm + 400) / 20) AS INTEGER) AS row, CAST(floor((x_nm + 400) / 20) AS INTEGER) AS col, CAST(count(*) AS DOUBLE) AS value FROM pt WHERE x_nm >= -400 AND x_nm < 400 AND y_nm >= -400 AND y_nm < 400 GROUP BY 1, 2")
def _(spark, sf):
    return A.pixels(points(spark, sf), "x_nm", "y_nm", -400, -400, 20, 40, 40)


@query(
    "rate_per_window",
    f"""{EV}, b AS (SELECT min(frame) a, max(frame) z FROM ev), w AS (SELECT unnest(range(0, (z - a + 1 + 59) // 60)) AS win FROM b), c AS (SELECT (frame - a) // 60 AS win, count(*) AS n FROM ev, b GROUP BY 1)
        SELECT CAST(w.win AS INTEGER) AS "window", coalesce(n, 0) AS n, round(coalesce(n, 0) / least(60, z - a + 1 - w.win * 60), 6) AS rate FROM w LEFT JOIN c ON w.win = c.win, b""",
)
def _(spark, sf):
    e = events(spark, sf)
    b = e.agg(F.min("frame").alias("a"), F.max("frame").alias("z")).first()
    return A.rate(e, b["a"], b["z"], 60).select("window", "n", r6("rate", "rate"))


@query("time_course", f"{EV}, b AS (SELECT min(frame) a FROM ev) SELECT event_type, CAST((frame - a) // 120 AS INTEGER) AS \"window\", round(CASE WHEN count(*) >= 3 THEN median(value) ELSE -1 END, 6) AS value FROM ev, b GROUP BY 1, 2")
def _(spark, sf):
    e = events(spark, sf)
    first = e.agg(F.min("frame").alias("a")).first()["a"] or 0
    w = A.window_statistic(e, "value", first, 120, "median", 3, keys=("event_type",))
    return w.select("event_type", "window", r6(F.nanvl("value", F.lit(-1.0)), "value"))


@query("compare_groups", "SELECT l_returnflag, m AS measure, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_tax']) AS m, unnest([l_quantity, l_tax]) AS v FROM lineitem) GROUP BY 1, 2")
def _(spark, sf):
    c = A.compare_groups(lines(spark, sf), "l_returnflag", ["l_quantity", "l_tax"])
    return c.select("l_returnflag", "measure", "n", r6("mean", "mean"), r6("median", "median"))


@query("mean_curves", "SELECT label, i AS at, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM (SELECT label, CAST(unnest(range(8)) AS INTEGER) AS i, CAST(unnest(embedding[1:8]) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.slice("embedding", 1, 8).alias("curve"))
    return A.mean_curves(e, "label", "curve").select("label", "at", *[r6(c, c) for c in ("mean", "sd", "sem")], "n")


@query(
    "cluster_shape",
    f"""{PT}, g AS (SELECT label, count(*) n, avg(x_nm) x, avg(y_nm) y, max(x_nm) - min(x_nm) width, max(y_nm) - min(y_nm) height, var_pop(x_nm) a, var_pop(y_nm) b, covar_pop(x_nm, y_nm) c FROM pt GROUP BY label)
        SELECT label, n, round(x, 6) x, round(y, 6) y, round(width, 6) width, round(height, 6) height, round(sqrt((a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c)), 5) AS major, round(sqrt((a + b) / 2 - sqrt((a - b) ** 2 / 4 + c * c)), 5) AS minor, round(0.5 * atan2(2 * c, a - b), 5) AS angle FROM g""",
)
def _(spark, sf):
    s = A.cluster_shape(points(spark, sf), "label")
    return s.select("label", "n", *[r6(c, c) for c in ("x", "y", "width", "height")], *[F.round(c, 5).alias(c) for c in ("major", "minor", "angle")])


@query("frame_groupby", f"{EV} SELECT event_id, round(sum(value) OVER w, 6) AS value_sum FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING)")
def _(spark, sf):
    return A.window_aggregate(events(spark, sf), "user_id", "frame", 30, {"value": "sum"}).select("event_id", r6("value_sum", "value_sum"))


@query("union_pad", "SELECT o_orderkey AS id, o_totalprice AS amount, 0 AS n FROM orders UNION ALL SELECT c_custkey, NULL, c_nationkey FROM customer")
def _(spark, sf):
    a = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    return S.concat([a, b]).select("id", F.when(~F.isnan("amount"), F.col("amount")).alias("amount"), "n")


def _files(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select((F.col("o_orderkey") % 1000).alias("frame"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("filenumber"))


FILES = "WITH f AS (SELECT o_orderkey % 1000 AS frame, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS filenumber FROM orders)"


@query("combine_files", f"{FILES}, t AS (SELECT filenumber, max(frame) + 1 AS m FROM f GROUP BY 1), b AS (SELECT filenumber, coalesce(sum(m) OVER (ORDER BY filenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t) SELECT CAST(frame + off AS BIGINT) AS frame, o_orderkey, f.filenumber FROM f JOIN b ON f.filenumber = b.filenumber")
def _(spark, sf):
    return S.combine_files(_files(spark, sf))


@query("keep_apart", f"{FILES}, m AS (SELECT max(frame) AS m FROM f WHERE filenumber = 0) SELECT o_orderkey, CASE WHEN (SELECT min(frame) FROM f WHERE filenumber = 1) <= m THEN frame + m + 1 ELSE frame END AS group_id FROM f, m WHERE filenumber = 1")
def _(spark, sf):
    f = _files(spark, sf).withColumnRenamed("frame", "group_id")
    return S.keep_apart(f.where("filenumber = 0"), f.where("filenumber = 1")).select("o_orderkey", "group_id")


@query("remove_file", f"{FILES} SELECT o_orderkey, CASE WHEN filenumber > 1 THEN filenumber - 1 ELSE filenumber END AS filenumber FROM f WHERE filenumber <> 1")
def _(spark, sf):
    return S.remove_file(_files(spark, sf), 1).select("o_orderkey", "filenumber")


@query("frames_apart", f"{FILES} SELECT o_orderkey, frame + filenumber * 2 * (SELECT max(frame) - min(frame) + 1 FROM f) AS frame FROM f")
def _(spark, sf):
    return S.frames_apart(_files(spark, sf)).select("o_orderkey", "frame")


@query("repeat_rows", "SELECT n_nationkey, c AS copy, n_regionkey + 5 * c AS frame FROM nation, (SELECT unnest([0, 1, 2]) AS c)")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.col("n_regionkey").alias("frame"))
    return S.repeat(n, 3, 5).select("n_nationkey", "copy", "frame")


@query("linearize", "SELECT vec_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS code, unnest(embedding[1:3]) AS phot FROM embeddings")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 3).alias("phot"))
    return S.linearize(e, ["phot"])


@query("first_per_value", f"{EV} SELECT user_id, arg_min(event_id, event_id) AS event_id FROM ev GROUP BY user_id")
def _(spark, sf):
    return S.first_of(events(spark, sf), ["user_id"], "event_id").select("user_id", "event_id")


@query("trace_index", f"{EV} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS INTEGER) AS trace_index FROM ev")
def _(spark, sf):
    return W.trace_index(events(spark, sf), "user_id", "t", "event_id").select("event_id", "trace_index")


@query("leading_index", f"{EV} SELECT event_id, CAST(1 + coalesce(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS leading_index FROM ev")
def _(spark, sf):
    e = events(spark, sf).withColumn("final", F.col("value") > 50)
    return W.leading_index(e, "final", "user_id", "t", "event_id").select("event_id", F.col("leading_index").cast("long").alias("leading_index"))


@query("trace_steps", f"{EV} SELECT event_id, round(coalesce(sqrt((value - lag(value) OVER w) ** 2 + (frame - lag(frame) OVER w) ** 2), -1), 6) AS step FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def _(spark, sf):
    return W.steps(events(spark, sf), "user_id", "t", "value", "frame", "event_id").select("event_id", r6(F.nanvl("step", F.lit(-1.0)), "step"))


@query("rolling_std", f"{EV} SELECT event_id, round(coalesce(CASE WHEN count(*) OVER w >= 3 THEN stddev_samp(value) OVER w END, -1), 6) AS rolling_std FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def _(spark, sf):
    return W.rolling_std(events(spark, sf), "value", 7, "user_id", "t", "event_id").select("event_id", r6(F.nanvl("rolling_std", F.lit(-1.0)), "rolling_std"))


@query("smoothed", f"{EV} SELECT event_id, round(avg(value) OVER w, 6) AS smoothed FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, sf):
    return W.smoothed(events(spark, sf), "value", 5, "user_id", "t", row="event_id").select("event_id", r6("smoothed", "smoothed"))


@query("consecutive_precision", f"{EV}, d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM ev) SELECT user_id, round(coalesce(stddev_samp(d) / sqrt(2), -1), 6) AS precision FROM d GROUP BY user_id")
def _(spark, sf):
    p = W.consecutive_precision(events(spark, sf), "value", "user_id", "t", "event_id")
    return p.select("user_id", r6(F.nanvl("precision", F.lit(-1.0)), "precision"))


@query("cut_after_limit", f"{EV}, c AS (SELECT event_id, max(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM ev) SELECT event_id FROM c WHERE o = 0")
def _(spark, sf):
    return W.before_first_above(events(spark, sf), "value", 80, "user_id", "t", "event_id").select("event_id")


@query("bursts", f"{EV}, g AS (SELECT event_id, user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS n FROM ev) SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM g")
def _(spark, sf):
    return W.sessions(events(spark, sf), "user_id", "t", 3600, "event_id").select("event_id", "burst")


@query("dark_frames", f"{EV}, g AS (SELECT event_id, frame - max(frame + 3) OVER (PARTITION BY user_id ORDER BY frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS d FROM ev) SELECT event_id, CAST(CASE WHEN d >= 0 THEN d ELSE -1 END AS DOUBLE) AS dark FROM g")
def _(spark, sf):
    b = events(spark, sf).withColumn("last", F.col("frame") + 3)
    return W.dark_frames(b, "user_id", "frame", "last", "event_id").select("event_id", F.nanvl("dark", F.lit(-1.0)).alias("dark"))


@query("ranked_by_size", f"{EV}, s AS (SELECT user_id, count(*) n, min(event_id) f FROM ev GROUP BY 1), r AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, f) AS k FROM s) SELECT event_id, k AS user_id, n AS n_in_cluster FROM ev JOIN r ON ev.user_id = r.user_id")
def _(spark, sf):
    return W.ranked_by_size(events(spark, sf), "user_id", "event_id").select("event_id", "user_id", "n_in_cluster")


@query("strictly_increasing", f"{EV}, d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM ev) SELECT user_id, coalesce(bool_and(d > 0), true) AS increasing FROM d GROUP BY user_id")
def _(spark, sf):
    return W.strictly_increasing(events(spark, sf), "value", "user_id", "event_id")


@query("lag_sums", f"{EV}, p AS (SELECT user_id, frame, value FROM ev) SELECT a.user_id, b.frame - a.frame AS lag, round(sum((a.value - b.value) ** 2), 4) AS sum, count(*) AS n FROM p a JOIN p b ON a.user_id = b.user_id AND b.frame - a.frame BETWEEN 1 AND 20 GROUP BY 1, 2")
def _(spark, sf):
    e = events(spark, sf).withColumn("zero", F.lit(0.0))
    s = W.lag_sums(e, 20, "user_id", "frame", "value", "zero")
    return s.select("user_id", F.col("lag").cast("long").alias("lag"), F.round("sum", 4).alias("sum"), "n")


@query("outcomes", "SELECT user_id, event_type AS outcome, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return W.outcome_counts(events(spark, sf), "user_id", "event_type")


@query(
    "asof_match",
    f"""{EV}, a AS (SELECT event_id, user_id, t FROM ev WHERE event_type = (SELECT min(event_type) FROM ev)), b AS (SELECT user_id, t, min(value) AS value FROM ev WHERE event_type = (SELECT max(event_type) FROM ev) GROUP BY 1, 2),
        p AS (SELECT a.event_id, a.t AS ta, b.t AS tb, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS k FROM a JOIN b ON a.user_id = b.user_id)
        SELECT a.event_id, CASE WHEN abs(tb - ta) <= 86400 THEN round(tb - ta, 3) END AS dt, CASE WHEN abs(tb - ta) <= 86400 THEN value END AS near_value FROM a LEFT JOIN p ON a.event_id = p.event_id AND k = 1""",
)
def _(spark, sf):
    e = events(spark, sf)
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    left = e.where(F.col("event_type") == kinds["a"]).select("event_id", "user_id", "t")
    right = e.where(F.col("event_type") == kinds["b"]).groupBy("user_id", "t").agg(F.min("value").alias("value"))
    m = J.nearest_in_time(left, right, "t", ["value"], ("user_id",), 86400, "event_id")
    return m.select("event_id", F.round("dt", 3).alias("dt"), "near_value")


@query(
    "interval_overlap",
    f"""{EV}, s AS (SELECT user_id, event_type, min(t) AS a, max(t) AS z FROM ev GROUP BY 1, 2), l AS (SELECT * FROM s WHERE event_type = (SELECT min(event_type) FROM ev)), r AS (SELECT * FROM s WHERE event_type = (SELECT max(event_type) FROM ev))
        SELECT l.user_id, round(least(l.z, r.z) - greatest(l.a, r.a), 3) AS overlap FROM l JOIN r ON l.user_id = r.user_id WHERE least(l.z, r.z) - greatest(l.a, r.a) >= 60""",
)
def _(spark, sf):
    e = events(spark, sf)
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    spans = e.groupBy("user_id", "event_type").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    a, b = (spans.where(F.col("event_type") == k).drop("event_type") for k in (kinds["a"], kinds["b"]))
    o = J.overlapping(a, b, 7 * 86400, ("user_id",), 60)
    return o.select(F.col("a_user_id").alias("user_id"), F.round("overlap", 3).alias("overlap"))


@query("neighbour_count", f"{PT} SELECT a.row_id, count(b.row_id) AS n FROM pt a LEFT JOIN pt b ON a.row_id <> b.row_id AND (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 <= 400 GROUP BY 1")
def _(spark, sf):
    p = points(spark, sf)
    return J.neighbour_count(p, p, 20, same=True)


@query("neighbour_weight", f"{PT} SELECT a.row_id, round(coalesce(sum(exp(-((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) / 200)), 0), 6) AS n FROM pt a LEFT JOIN pt b ON a.row_id <> b.row_id AND (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 <= 900 GROUP BY 1")
def _(spark, sf):
    p = points(spark, sf)
    return J.neighbour_count(p, p, 0, same=True, gaussian=10.0).select("row_id", r6("n", "n"))


@query("neighbour_median", f"{PT} SELECT a.row_id, round(median(b.label), 6) AS value FROM pt a JOIN pt b ON (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 <= 400 GROUP BY 1")
def _(spark, sf):
    p = points(spark, sf)
    return J.neighbour_statistic(p, p, "label", 20).select("row_id", r6("value", "value"))


@query("pair_histogram", f"{PT}, d AS (SELECT sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) AS d FROM pt a JOIN pt b ON a.row_id <> b.row_id) SELECT CAST(floor(d / 5) AS BIGINT) AS bin, count(*) AS n FROM d WHERE d < 50 GROUP BY 1")
def _(spark, sf):
    p = points(spark, sf)
    return J.pair_histogram(p, p, 50, 5, same=True)


@query("knn", f"{PT}, d AS (SELECT a.row_id, sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) AS d FROM pt a JOIN pt b ON a.row_id <> b.row_id), r AS (SELECT row_id, d, row_number() OVER (PARTITION BY row_id ORDER BY d) AS rank FROM d) SELECT row_id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS d FROM r WHERE rank <= 3")
def _(spark, sf):
    p = points(spark, sf)
    return J.nearest_neighbours(p, p, 3, 20, same=True).select("row_id", "rank", r6("d", "d"))


@query("near_any", f"{PT} SELECT row_id FROM pt a WHERE label = 1 AND EXISTS (SELECT 1 FROM pt b WHERE b.label = 2 AND (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 <= 100)")
def _(spark, sf):
    p = points(spark, sf)
    return J.near_any(p.where("label = 1"), p.where("label = 2"), 10).select("row_id")


@query("tracking_candidates", f"{EV} SELECT a.event_id AS a, b.event_id AS b, CAST(b.frame - a.frame AS INTEGER) AS lag FROM ev a JOIN ev b ON b.frame - a.frame BETWEEN 1 AND 3 AND abs(a.value - b.value) <= 2")
def _(spark, sf):
    e = events(spark, sf).withColumn("zero", F.lit(0.0))
    return J.lag_pairs(e, 2.0, 2, "frame", (), "event_id", ("value", "zero")).select("a", "b", "lag")


@query("point_in_region", f"{PT}, c AS (SELECT row_id AS region_id, x_nm AS cx, y_nm AS cy FROM pt WHERE row_id < 40) SELECT region_id, row_id FROM pt JOIN c ON (x_nm - cx) ** 2 + (y_nm - cy) ** 2 <= 900")
def _(spark, sf):
    p = points(spark, sf)
    c = p.where("row_id < 40").select(F.col("row_id").alias("region_id"), F.col("x_nm").alias("cx"), F.col("y_nm").alias("cy"), F.lit(30.0).alias("radius"))
    return J.members(p, c, 60)


@query(
    "region_filter",
    f"""{PT}, c AS (SELECT row_id AS region_id, x_nm AS cx, y_nm AS cy FROM pt WHERE row_id < 40), m AS (SELECT region_id, row_id FROM pt JOIN c ON (x_nm - cx) ** 2 + (y_nm - cy) ** 2 <= 900), s AS (SELECT region_id FROM m GROUP BY 1 HAVING count(*) >= 12)
        SELECT DISTINCT row_id FROM m WHERE region_id IN (SELECT region_id FROM s)""",
)
def _(spark, sf):
    p = points(spark, sf)
    c = p.where("row_id < 40").select(F.col("row_id").alias("region_id"), F.col("x_nm").alias("cx"), F.col("y_nm").alias("cy"), F.lit(30.0).alias("radius"))
    m = J.members(p, c, 60)
    return J.region_filter(p, m, m.groupBy("region_id").count().where("count >= 12")).select("row_id")


@query(
    "values_onto",
    f"""{PT}, c AS (SELECT row_id AS region_id, x_nm AS cx, y_nm AS cy FROM pt WHERE row_id < 40), m AS (SELECT region_id, row_id FROM pt JOIN c ON (x_nm - cx) ** 2 + (y_nm - cy) ** 2 <= 900)
        SELECT pt.row_id, CAST(coalesce(v, -1) AS DOUBLE) AS value FROM pt LEFT JOIN (SELECT row_id, max(region_id) * 2 AS v FROM m GROUP BY 1) q ON pt.row_id = q.row_id""",
)
def _(spark, sf):
    p = points(spark, sf)
    c = p.where("row_id < 40").select(F.col("row_id").alias("region_id"), F.col("x_nm").alias("cx"), F.col("y_nm").alias("cy"), F.lit(30.0).alias("radius"))
    v = J.values_onto(p, J.members(p, c, 60), c.select("region_id", (F.col("region_id") * 2).alias("value")), "last")
    return v.select("row_id", F.nanvl("value", F.lit(-1.0)).alias("value"))


@query("star_join_regions", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf):
    o, c, n, r = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer", "nation", "region"))
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("outer_align", "WITH a AS (SELECT c_nationkey AS region_id, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS region_id, count(*) AS n FROM supplier GROUP BY 1) SELECT coalesce(a.region_id, b.region_id) AS region_id, a.n AS customers_n, b.n AS suppliers_n FROM a FULL JOIN b ON a.region_id = b.region_id")
def _(spark, sf):
    a = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))
    b = spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.col("s_nationkey").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))
    return J.outer_align({"customers": a, "suppliers": b})


@query(
    "connected_components",
    f"""WITH RECURSIVE {PT[5:]}, e AS (SELECT a.row_id AS a, b.row_id AS b FROM pt a JOIN pt b ON (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 <= 16 WHERE a.label = b.label), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS row_id, min(b) AS component FROM w GROUP BY 1""",
)
def _(spark, sf):
    p = points(spark, sf)
    e = J.cell_pairs(p, p, 4, keys=("label",), same=True).select(F.col("a_row_id").alias("a"), F.col("b_row_id").alias("b"))
    return G.connected_components(p, e)


@query(
    "dbscan",
    f"""{PT.replace("WITH", "WITH RECURSIVE", 1)}, d AS (SELECT a.row_id AS a, b.row_id AS b, sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) AS d FROM pt a JOIN pt b ON a.row_id <> b.row_id AND sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) <= 12),
        core AS (SELECT a AS id FROM d GROUP BY a HAVING count(*) >= 5), e AS (SELECT a, b FROM d WHERE a IN (FROM core) AND b IN (FROM core)),
        reach AS (SELECT id AS node, id AS root FROM core UNION SELECT b, root FROM reach JOIN e ON a = node), comp AS (SELECT node, min(root) AS c FROM reach GROUP BY 1),
        edge AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d WHERE b IN (FROM core) AND a NOT IN (FROM core)),
        lab AS (SELECT node AS row_id, c FROM comp UNION ALL SELECT a, c FROM edge JOIN comp ON node = b WHERE k = 1), size AS (SELECT c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) AS place FROM lab GROUP BY c)
        SELECT row_id, coalesce(place, -1) AS cluster_id, coalesce(n, 0) AS n_in_cluster FROM pt LEFT JOIN lab USING (row_id) LEFT JOIN size USING (c)""",
)
def _(spark, sf):
    return G.dbscan(points(spark, sf), 12, 5).select("row_id", "cluster_id", "n_in_cluster")


@query("local_maxima")
def _(spark, sf):
    return G.local_maxima(points(spark, sf), 25, 8).select("row_id", "cluster_id", "n_in_cluster")


def _spots(spark, sf):
    e = events(spark, sf)
    return e.select(F.col("event_id").alias("row_id"), "frame", (F.col("value") * 10).alias("x_nm"), (F.col("user_id") % 50 * 40.0).alias("y_nm"), (5 + F.col("event_id") % 7).cast("double").alias("err"))


@query("link_blinks")
def _(spark, sf):
    return G.link_blinks(_spots(spark, sf), 60.0, 20).select("row_id", "group_id", "n_in_group")


@query("link_blinks_precision")
def _(spark, sf):
    return G.link_blinks(_spots(spark, sf), 90.0, 20, "err").select("row_id", "group_id", "n_in_group")


@query("link_tracks")
def _(spark, sf):
    return G.link_tracks(_spots(spark, sf), 80.0, 10).select("row_id", "track_id", "track_length")


@query("link_tracks_global")
def _(spark, sf):
    return G.link_tracks(_spots(spark, sf), 80.0, 10, method="global").select("row_id", "track_id", "track_length")


@query("dedupe_close")
def _(spark, sf):
    p = points(spark, sf).withColumn("frame", F.lit(0)).withColumn("peak", F.abs("x_nm"))
    return G.one_per_molecule(p, 6, "peak").select("row_id")
