"""Queries of selections, event parts, offsets and pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import measure as M
from .catalog import EV, PT, events, lines, points, query, r6

PIX = f"{PT}, pix AS (SELECT CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py, label, count(*) AS value FROM pt GROUP BY ALL)"


def pixels(spark, sf, *more):
    p = points(spark, sf)
    return p.groupBy(F.floor(p["x_nm"] / 50).cast("long").alias("px"), F.floor(p["y_nm"] / 50).cast("long").alias("py"), *more).agg(F.count(F.lit(1)).alias("value"))


@query("lateral_error", "SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity * l_quantity + l_tax * l_tax) / 2), 6) AS xy_err_nm FROM lineitem")
def _(spark, sf):
    e = A.lateral_error(lines(spark, sf).withColumnsRenamed({"l_quantity": "x_err_nm", "l_tax": "y_err_nm"}))
    return e.select("l_orderkey", "l_linenumber", r6("xy_err_nm", "xy_err_nm"))


@query(
    "combine_pairs",
    """SELECT l_suppkey, count(*) AS n_in_group, round(sqrt((1 / sum(1 / (l_quantity * l_quantity)) + 1 / sum(1 / ((l_quantity + l_linenumber) * (l_quantity + l_linenumber)))) / 2), 6) AS xy_err_nm, min(l_linenumber) AS state_true,
       round(atan2(sum(sin(l_discount) / (l_quantity * l_quantity)), sum(cos(l_discount) / (l_quantity * l_quantity))), 6) AS phase_rad FROM lineitem GROUP BY l_suppkey""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    df = lines(spark, sf).select("l_suppkey", q.alias("x_err_nm"), (q + F.col("l_linenumber")).alias("y_err_nm"), q.alias("xy_err_nm"), F.col("l_linenumber").alias("state_true"), F.col("l_discount").alias("phase_rad"), q.alias("phase_err_rad"))
    return A.combine(df, ["l_suppkey"]).select("l_suppkey", "n_in_group", r6("xy_err_nm", "xy_err_nm"), "state_true", r6("phase_rad", "phase_rad"))


@query("event_middles", f"{EV}, g AS (SELECT user_id, min(frame) AS lo, max(frame) AS hi FROM ev GROUP BY 1 HAVING count(*) >= 5) SELECT event_id FROM ev JOIN g USING (user_id) WHERE frame > lo AND frame < hi")
def _(spark, sf):
    return M.middle_rows(events(spark, sf), "user_id", least=5).select("event_id")


@query("selection_without", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 AND NOT l_discount > 0.05")
def _(spark, sf):
    return M.selection(lines(spark, sf), F.col("l_quantity") > 20, F.col("l_discount") > 0.05, "without").select("l_orderkey", "l_linenumber")


@query("selection_xor", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 20) <> (l_discount > 0.05)")
def _(spark, sf):
    return M.selection(lines(spark, sf), F.col("l_quantity") > 20, F.col("l_discount") > 0.05, "xor").select("l_orderkey", "l_linenumber")


@query("kept_bounds", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_discount >= 0.02")
def _(spark, sf):
    return M.kept_bounds(M.with_bounds(lines(spark, sf), {"l_quantity": (10, 30), "l_discount": (0.02, None)})).select("l_orderkey", "l_linenumber")


@query("time_halves", f"{EV}, s AS (SELECT min(frame) AS lo, max(frame) AS hi FROM ev) SELECT event_id, CAST(least(floor((frame - lo) * 20 / (hi - lo + 1)), 19) AS INT) % 2 AS half FROM ev, s")
def _(spark, sf):
    return M.time_halves(events(spark, sf), 20).select("event_id", "half")


@query(
    "column_scan",
    "SELECT step, 5.0 + step * 2.5 AS lo, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem, (SELECT unnest(range(15))::INT AS step) WHERE l_quantity >= 5 + step * 2.5 AND l_quantity < 5 + step * 2.5 + 10 GROUP BY step",
)
def _(spark, sf):
    return M.column_scan(lines(spark, sf), "l_quantity", 5.0, 2.5, 10.0, 15, "l_extendedprice").select("step", "lo", "n", F.round("mean", 4).alias("mean"))


@query(
    "valley",
    """WITH h AS (SELECT b AS bin, (SELECT count(*) FROM lineitem WHERE l_extendedprice >= 0 AND l_extendedprice < 100000 AND floor(l_extendedprice / 2500) = b) AS n FROM (SELECT unnest(range(40)) AS b)),
       p AS (SELECT bin AS peak FROM h ORDER BY n DESC, bin LIMIT 1), s AS (SELECT peak, bin AS second FROM h, p WHERE abs(bin - peak) >= 5 ORDER BY n DESC, bin LIMIT 1)
       SELECT peak, second, bin AS valley FROM h, s WHERE bin > least(peak, second) AND bin < greatest(peak, second) ORDER BY n, bin LIMIT 1""",
)
def _(spark, sf):
    return M.valley(lines(spark, sf), "l_extendedprice", 0.0, 100000.0, 40, 5)


@query("replaced_ids", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id % 7 + (SELECT max(user_id) + 1 FROM events) END ELSE user_id END AS user_id FROM events")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "user_id")
    again = e.where("event_id % 3 = 0").withColumn("user_id", F.when(F.col("user_id") % 4 == 0, -1).otherwise(F.col("user_id") % 7))
    return M.replaced_ids(e, again, "user_id", row="event_id")


@query("regions_of_ids", f"{PT}, m AS (SELECT label, avg(x_nm) AS x, avg(y_nm) AS y, count(*) AS n FROM pt GROUP BY 1) SELECT label, round(x, 6) AS x, round(y, 6) AS y, round(max(sqrt((x_nm - x) ** 2 + (y_nm - y) ** 2)), 6) AS radius, any_value(n) AS n FROM pt JOIN m USING (label) GROUP BY label, x, y")
def _(spark, sf):
    r = M.regions_of_ids(points(spark, sf), "label")
    return r.select("label", r6("x", "x"), r6("y", "y"), r6("radius", "radius"), "n")


@query(
    "accept_proposals",
    f"""{PT}, r AS (SELECT * FROM pt WHERE label % 2 = 0), p AS (SELECT * FROM pt WHERE label % 2 = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE sqrt((r.x_nm - pt.x_nm) ** 2 + (r.y_nm - pt.y_nm) ** 2) < 40))
        SELECT row_id, round(x_nm, 6) AS x_nm, round(y_nm, 6) AS y_nm FROM r UNION ALL SELECT (SELECT max(row_id) FROM r) + row_number() OVER (ORDER BY row_id), round(x_nm, 6), round(y_nm, 6) FROM p""",
)
def _(spark, sf):
    p = points(spark, sf)
    a = M.accept_proposals(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 40.0)
    return a.select("row_id", r6("x_nm", "x_nm"), r6("y_nm", "y_nm"))


NEAR = f"""{PT}, a AS (SELECT * FROM pt WHERE label % 2 = 0), b AS (SELECT * FROM pt WHERE label % 2 = 1),
    d AS (SELECT a.row_id AS a, b.row_id AS b, sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) AS d, b.x_nm - a.x_nm AS dx, b.y_nm - a.y_nm AS dy FROM a, b WHERE sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) <= 60),
    m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ka, row_number() OVER (PARTITION BY b ORDER BY d, a) AS kb FROM d)"""


@query("mutual_nearest", f"{NEAR} SELECT a, b, round(d, 6) AS d FROM m WHERE ka = 1 AND kb = 1")
def _(spark, sf):
    p = points(spark, sf)
    return M.mutual_nearest(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 60.0).select("a", "b", r6("d", "d"))


@query("channel_offset", f"{NEAR} SELECT round(median(dx), 6) AS dx, round(median(dy), 6) AS dy, count(*) AS n FROM m WHERE ka = 1 AND kb = 1")
def _(spark, sf):
    p = points(spark, sf)
    return M.channel_offset(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 60.0).select(r6("dx", "dx"), r6("dy", "dy"), "n")


@query("offset_histogram", f"{PT} SELECT CAST(floor((b.x_nm - a.x_nm) / 20) AS BIGINT) AS ix, CAST(floor((b.y_nm - a.y_nm) / 20) AS BIGINT) AS iy, count(*) AS n FROM pt a, pt b WHERE a.label % 2 = 0 AND b.label % 2 = 1 AND sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) < 80 GROUP BY ALL")
def _(spark, sf):
    p = points(spark, sf)
    return M.offset_histogram(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 80.0, 20.0)


@query("nearest_in_frame", f"{PT} SELECT a.row_id, round(min(sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2)), 6) AS d FROM pt a JOIN pt b ON a.label = b.label AND a.row_id <> b.row_id GROUP BY 1")
def _(spark, sf):
    p = points(spark, sf)
    n = J.nearest_neighbours(p, p, 1, 20.0, same=True, keys=("label",))
    return n.where(F.col("d") < float("inf")).select("row_id", r6("d", "d"))


@query("cell_order", f"{PT} SELECT row_id, row_number() OVER (ORDER BY floor(y_nm / 100), floor(x_nm / 100), row_id) - 1 AS place FROM pt")
def _(spark, sf):
    return M.cell_order(points(spark, sf), 100.0).select("row_id", "place")


@query("observation_window", f"{PT} SELECT count(*) AS pixels FROM (SELECT DISTINCT floor(x_nm / 50) + i AS px, floor(y_nm / 50) + j AS py FROM pt, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))")
def _(spark, sf):
    return M.occupied(points(spark, sf), 50.0, 1).agg(F.count(F.lit(1)).alias("pixels"))


@query(
    "without_background",
    f"{PT}, pix AS (SELECT CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py, count(*) AS value FROM pt GROUP BY ALL) SELECT p.px, p.py, round(p.value - sum(q.value) / 25.0, 6) AS value FROM pix p JOIN pix q ON abs(q.px - p.px) <= 2 AND abs(q.py - p.py) <= 2 GROUP BY p.px, p.py, p.value",
)
def _(spark, sf):
    return M.without_background(pixels(spark, sf), 2).select("px", "py", r6("value", "value"))


@query(
    "cut_boxes",
    f"""{PT}, pix AS (SELECT CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py, count(*) AS value FROM pt GROUP BY ALL),
        c AS (SELECT row_id, CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py FROM pt)
        SELECT row_id, ix, iy, coalesce(value, 0) AS value FROM c CROSS JOIN (SELECT unnest([-1, 0, 1])::INT AS ix) CROSS JOIN (SELECT unnest([-1, 0, 1])::INT AS iy) LEFT JOIN pix ON pix.px = c.px + ix AND pix.py = c.py + iy
        WHERE c.px >= 1 AND c.py >= 1 AND c.px < 63 AND c.py < 63""",
)
def _(spark, sf):
    p = points(spark, sf)
    centres = p.select("row_id", F.floor(p["x_nm"] / 50).cast("long").alias("px"), F.floor(p["y_nm"] / 50).cast("long").alias("py"))
    return M.cut_boxes(pixels(spark, sf), centres, 1, (64, 64))


@query(
    "error_map",
    f"""{PIX}, j AS (SELECT px, py, coalesce(sum(value) FILTER (label % 2 = 0), 0)::DOUBLE AS a, coalesce(sum(value) FILTER (label % 2 = 1), 0)::DOUBLE AS b FROM pix GROUP BY ALL), f AS (SELECT regr_slope(b, a) AS k, avg(a) AS ma, avg(b) AS mb FROM j)
        SELECT px, py, round(b - mb - k * (a - ma), 6) AS error FROM j, f""",
)
def _(spark, sf):
    p = pixels(spark, sf, "label")
    of = lambda k: p.where(F.col("label") % 2 == k).groupBy("px", "py").agg(F.sum("value").alias("value"))
    return M.error_map(of(0), of(1)).select("px", "py", r6("error", "error"))


@query("frame_decay", f"{EV}, s AS (SELECT min(frame) AS lo, max(frame) + 1 AS hi FROM ev) SELECT median(frame) AS median_frame, round(count(*) FILTER (frame < lo + (hi - lo) / 10) / any_value((hi - lo) / 10), 6) AS first, round(count(*) FILTER (frame >= hi - (hi - lo) / 10) / any_value((hi - lo) / 10), 6) AS last FROM ev, s")
def _(spark, sf):
    return M.frame_decay(events(spark, sf)).select("median_frame", r6("first", "first"), r6("last", "last"))


@query("iteration_counts", "SELECT iteration, outcome, n, round(m, 6) AS median, round(n / sum(n) OVER (PARTITION BY iteration), 6) AS part FROM (SELECT l_linenumber AS iteration, l_returnflag AS outcome, count(*) AS n, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL)")
def _(spark, sf):
    return M.iteration_counts(lines(spark, sf), "l_linenumber", "l_returnflag", "l_extendedprice").select("iteration", "outcome", "n", r6("median", "median"), r6("part", "part"))


@query(
    "spread_selection",
    f"""{EV}, s AS (SELECT user_id, stddev_samp(value) AS spread FROM ev GROUP BY 1 HAVING spread IS NOT NULL), m AS (SELECT median(spread) AS mid FROM s), d AS (SELECT median(abs(spread - mid)) AS mad FROM s, m)
        SELECT user_id, round(spread, 6) AS spread, abs(spread - mid) <= 2 * 1.4826 * mad AS kept FROM s, m, d""",
)
def _(spark, sf):
    return M.spread_selection(events(spark, sf), "user_id", "value", 2.0, rounds=1).select("user_id", r6("spread", "spread"), "kept")


@query("metadata_lookup", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    c, n = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "nation"))
    found = J.lookup(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, "n_nationkey")
    return found.select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("n_name"), "n_regionkey")
