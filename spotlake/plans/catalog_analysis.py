"""Queries of the analysis operators: drift, kinetics, spatial statistics, regions and pixels."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import simulate
from ..operators import aggregate as A
from ..operators import drift as D
from ..operators import graph as G
from ..operators import joins as J
from ..operators import matching as M
from ..operators import regions as R
from ..operators import render as P
from ..operators import spatial as X
from ..operators import traces as T
from .catalog import EV, PT, events, lines, points, query, r6


@query(
    "drift_apply",
    f"""{EV}, c AS (SELECT frame, avg(value) AS d FROM ev GROUP BY 1) SELECT event_id, round(value - d, 6) AS value FROM ev JOIN c ON ev.frame = c.frame""",
)
def _(spark, sf):
    e = events(spark, sf)
    curve = e.groupBy("frame").agg(F.avg("value").alias("d_value"))
    return D.apply_drift(e, curve, ("value",)).select("event_id", r6("value", "value"))


@query(
    "curve_interpolation",
    f"""{EV}, k AS (SELECT floor(t / 86400) * 86400 AS t, avg(value) AS v FROM ev GROUP BY 1),
        p AS (SELECT event_id, ev.t, (SELECT max(k.t) FROM k WHERE k.t <= ev.t) AS a, (SELECT min(k.t) FROM k WHERE k.t > ev.t) AS b FROM ev)
        SELECT event_id, round(CASE WHEN b IS NULL THEN ka.v WHEN a IS NULL THEN kb.v ELSE ka.v + (kb.v - ka.v) * (p.t - a) / (b - a) END, 5) AS at_v FROM p LEFT JOIN k ka ON ka.t = a LEFT JOIN k kb ON kb.t = b""",
)
def _(spark, sf):
    e = events(spark, sf)
    knots = e.groupBy((F.floor(F.col("t") / 86400) * 86400).cast("double").alias("t")).agg(F.avg("value").alias("v"))
    return J.interpolated(e, knots, "t", ["v"]).select("event_id", F.round("at_v", 5).alias("at_v"))


@query("transform_affine", f"{PT} SELECT row_id, round(1.1 * x_nm - 0.2 * y_nm + 5, 6) AS x_nm, round(0.2 * x_nm + 0.9 * y_nm - 3, 6) AS y_nm FROM pt")
def _(spark, sf):
    t = D.Transformation("affine", [[1.1, -0.2, 5], [0.2, 0.9, -3]])
    return t.apply(points(spark, sf)).select("row_id", r6("x_nm", "x_nm"), r6("y_nm", "y_nm"))


@query("transform_projective", f"{PT} SELECT row_id, round((x_nm + 2) / (0.0001 * x_nm + 1), 6) AS x_nm, round((y_nm - 1) / (0.0001 * x_nm + 1), 6) AS y_nm FROM pt")
def _(spark, sf):
    t = D.Transformation("projective", [[1, 0, 2], [0, 1, -1], [0.0001, 0, 1]])
    return t.apply(points(spark, sf)).select("row_id", r6("x_nm", "x_nm"), r6("y_nm", "y_nm"))


@query("transform_fit", "SELECT round(1.1, 6) AS a, round(-0.2, 6) AS b, round(5.0, 6) AS c")
def _(spark, sf):
    p = points(spark, sf)
    moved = D.Transformation("affine", [[1.1, -0.2, 5], [0.2, 0.9, -3]]).apply(p).select("row_id", F.col("x_nm").alias("u"), F.col("y_nm").alias("v"))
    c = D.fit_affine(p.join(moved, "row_id"), ("x_nm", "y_nm"), ("u", "v")).c
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in c[0])], "a double, b double, c double")


@query("fiducial_curve", f"{EV}, m AS (SELECT user_id, avg(value) AS m FROM ev GROUP BY 1) SELECT frame, round(avg(value - m), 6) AS d_value FROM ev JOIN m ON ev.user_id = m.user_id GROUP BY frame")
def _(spark, sf):
    return D.fiducial_curve(events(spark, sf), "user_id", axes=("value",)).select("frame", F.round("d_value", 6).alias("d_value"))


@query("layer_shift")
def _(spark, sf):
    p = points(spark, sf)
    moved = p.withColumns({"x_nm": F.col("x_nm") + 40, "y_nm": F.col("y_nm") - 20})
    return spark.createDataFrame([tuple(map(float, D.layer_shift(p, moved, 10, -640, -640, 128, 128, 200)))], "dx double, dy double")


@query("redundant_drift")
def _(spark, sf):
    p = events(spark, sf).select("frame", F.col("value").alias("x_nm"), (F.col("user_id") % 50 * 10.0).alias("y_nm"))
    d = D.redundant_drift(p, 5, 4, 0, 0, 128, 128, 40)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(d)], "window int, dx double, dy double")


@query("astigmatic_z")
def _(spark, sf):
    li = lines(spark, sf).select("l_orderkey", "l_linenumber", (150 + F.col("l_quantity")).alias("sigma_x_nm"), (200 - F.col("l_quantity")).alias("sigma_y_nm"))
    return D.z_from_widths(li, (1e-4, 0.1, 150.0), (1e-4, -0.1, 150.0), (-400, 400)).select("l_orderkey", "l_linenumber", F.round("z_nm", 3).alias("z_nm"))


@query(
    "assign_colours",
    "WITH p AS (SELECT l_orderkey, l_linenumber, exp(-((l_discount - 0.02) ** 2) / (2 * 0.01 ** 2)) / 0.01 AS a, exp(-((l_discount - 0.07) ** 2) / (2 * 0.02 ** 2)) / 0.02 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN greatest(a, b) / (a + b) < 0.9 THEN -1 WHEN a >= b THEN 0 ELSE 1 END AS channel FROM p",
)
def _(spark, sf):
    return D.assign_colours(lines(spark, sf), F.col("l_discount"), [0.02, 0.07], [0.01, 0.02]).select("l_orderkey", "l_linenumber", "channel")


@query(
    "blinking",
    f"""{EV}, g AS (SELECT user_id, frame, event_id, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame, event_id) > 61 THEN 1 ELSE 0 END AS n FROM ev), b AS (SELECT user_id, frame, sum(n) OVER (PARTITION BY user_id ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING) AS blink FROM g)
        SELECT user_id, CAST(blink AS BIGINT) AS blink, min(frame) AS first, max(frame) AS last, max(frame) - min(frame) + 1 AS "on", count(*) AS n FROM b GROUP BY 1, 2""",
)
def _(spark, sf):
    return T.blinks_of(events(spark, sf), "user_id", 60, row="event_id").select("user_id", F.col("blink").cast("long").alias("blink"), "first", "last", "on", "n")


@query(
    "kinetics",
    f"""{EV}, g AS (SELECT user_id, frame, event_id, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame, event_id) > 61 THEN 1 ELSE 0 END AS n FROM ev), b AS (SELECT user_id, frame, sum(n) OVER (PARTITION BY user_id ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING) AS blink FROM g),
        r AS (SELECT user_id, min(frame) AS f, max(frame) AS l FROM b GROUP BY user_id, blink), d AS (SELECT user_id, l - f + 1 AS lit, f - lag(l) OVER (PARTITION BY user_id ORDER BY f) - 1 AS dark FROM r),
        k AS (SELECT user_id, count(*) AS events, avg(lit) AS bright, coalesce(avg(dark), CAST('NaN' AS DOUBLE)) AS dark, (100000 - sum(lit)) / count(*) AS dark_ml FROM d GROUP BY 1)
        SELECT user_id, events, round(bright, 6) AS bright, round(dark, 6) AS dark, round(dark_ml, 6) AS dark_ml, round(1 / (dark_ml * 0.001), 6) AS sites FROM k""",
)
def _(spark, sf):
    b = T.blinks_of(events(spark, sf), "user_id", 60, row="event_id")
    k = T.sites_from_kinetics(T.kinetics(b, "user_id", 100_000), 1e-3)
    return k.select("user_id", "events", *[r6(c, c) for c in ("bright", "dark", "dark_ml", "sites")])


@query(
    "trace_statistics",
    f"""{EV}, d AS (SELECT *, value - lag(value) OVER w AS dv, frame - lag(frame) OVER w AS df FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
        SELECT user_id, count(*) AS n, round(max(t) - min(t), 3) AS duration, round(coalesce(sum(sqrt(dv * dv + df * df)), 0), 4) AS path FROM d GROUP BY 1""",
)
def _(spark, sf):
    s = T.trace_statistics(events(spark, sf), "user_id", "t", "value", "frame", "event_id")
    return s.select("user_id", "n", F.round("duration", 3).alias("duration"), F.round("path", 4).alias("path"))


def _tracks(spark, sf):
    """Each user's events in order, a frame each, as a track."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("frame", "event_id"))
    return events(spark, sf).withColumn("turn", turn).select(F.col("event_id").alias("row_id"), F.col("user_id").alias("track_id"), F.col("turn").cast("long").alias("frame"), F.col("value").alias("x_nm"), F.lit(0.0).alias("y_nm"))


@query(
    "msd",
    f"""{EV}, t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY frame, event_id) AS f FROM ev),
        l AS (SELECT a.user_id, b.f - a.f AS lag, avg((a.value - b.value) ** 2) * 1e-6 AS m FROM t a JOIN t b ON a.user_id = b.user_id AND b.f - a.f BETWEEN 1 AND 4 GROUP BY 1, 2),
        g AS (SELECT user_id, regr_slope(m, lag * 0.02) / 4 AS d, regr_slope(CASE WHEN m > 0 THEN ln(m) END, CASE WHEN m > 0 THEN ln(lag * 0.02) END) AS alpha, count(*) AS lags FROM l GROUP BY 1)
        SELECT user_id AS track_id, round(coalesce(d, CAST('NaN' AS DOUBLE)), 6) AS d_um2_s, round(coalesce(alpha, CAST('NaN' AS DOUBLE)), 5) AS alpha, lags FROM g""",
)
def _(spark, sf):
    return T.msd(_tracks(spark, sf), 4, 0.02).select("track_id", r6("d_um2_s", "d_um2_s"), F.round("alpha", 5).alias("alpha"), "lags")


@query(
    "track_summary",
    f"""{PT}, t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY row_id) AS frame, x_nm, y_nm FROM pt), s AS (SELECT *, sqrt((x_nm - lag(x_nm) OVER w) ** 2 + (y_nm - lag(y_nm) OVER w) ** 2) AS s FROM t WINDOW w AS (PARTITION BY label ORDER BY frame)),
        g AS (SELECT label, count(*) AS n, coalesce(sum(s), 0) AS path, sqrt((arg_max(x_nm, frame) - arg_min(x_nm, frame)) ** 2 + (arg_max(y_nm, frame) - arg_min(y_nm, frame)) ** 2) AS net FROM s GROUP BY 1),
        l AS (SELECT a.label, b.frame - a.frame AS lag, avg((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) * 1e-6 AS m FROM t a JOIN t b ON a.label = b.label AND b.frame - a.frame BETWEEN 1 AND 4 GROUP BY 1, 2),
        f AS (SELECT label, regr_slope(m, lag * 0.02) / 4 AS d, regr_slope(ln(m), ln(lag * 0.02)) AS alpha, count(*) AS lags FROM l GROUP BY 1)
        SELECT label, n, round(path, 6) AS path_nm, round(net, 6) AS net_nm, round(net / path, 6) AS straightness, round(d, 6) AS d_um2_s, round(alpha, 6) AS alpha, lags FROM g JOIN f USING (label)""",
)
def _(spark, sf):
    p = points(spark, sf).withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("row_id")))
    return T.track_summary(p, 4, 0.02, "label").select("label", "n", *[r6(c, c) for c in ("path_nm", "net_nm", "straightness", "d_um2_s", "alpha")], "lags")


@query(
    "robust_spreads",
    f"""{EV}, s AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS s FROM ev), g AS (SELECT user_id, count(*) AS n, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, median(s) AS m FROM s GROUP BY 1),
        d AS (SELECT user_id, median(abs(value - q[2])) AS d FROM s JOIN g USING (user_id) GROUP BY 1)
        SELECT user_id, n, round(q[2], 6) AS median, round(d / 0.6744897501960817, 6) AS mad, round((q[3] - q[1]) / (2 * 0.6744897501960817), 6) AS quartiles, round(coalesce(m / (0.6744897501960817 * sqrt(2)), CAST('NaN' AS DOUBLE)), 6) AS steps FROM g JOIN d USING (user_id)""",
)
def _(spark, sf):
    return T.robust_spreads(events(spark, sf), "user_id", "t", "value", "event_id").select("user_id", "n", *[r6(c, c) for c in ("median", "mad", "quartiles", "steps")])


@query("jump_states")
def _(spark, sf):
    return spark.createDataFrame(T.jump_states(_tracks(spark, sf), 2, 0.02), "fraction double, d_um2_s double")


@query("steps_table")
def _(spark, sf):
    return T.steps_table(events(spark, sf), "user_id", "t", "value")


@query(
    "allan_deviation",
    f"{EV}, e AS (SELECT user_id, t, event_id, row_number() OVER w AS i, sum(value) OVER w AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)) "
    + " UNION ALL ".join(
        f"SELECT CAST({m} AS BIGINT) AS span, round(sqrt(sum(d * d) / (2 * count(*))), 6) AS deviation, count(*) AS n FROM (SELECT i, (s - 2 * lag(s, {m}, 0.0) OVER w + lag(s, {2 * m}, 0.0) OVER w) / {m} AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE i >= {2 * m}"
        for m in (1, 2, 4, 8)
    ),
)
def _(spark, sf):
    return T.allan(events(spark, sf), "user_id", "t", "value", [1, 2, 4, 8]).select("span", r6("deviation", "deviation"), "n")


@query("hidden_states")
def _(spark, sf):
    m, d, move = T.hidden_states(events(spark, sf), "user_id", "t", "value", 2)
    return spark.createDataFrame([(i, float(m[i]), float(d[i]), float(move[i, i])) for i in range(2)], "state int, mean double, deviation double, stay double")


@query("exponential_scale", "SELECT round(avg(l_extendedprice), 4) AS mean, true AS solved FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 200000")
def _(spark, sf):
    li = lines(spark, sf)
    tau = A.exponential_scale(li, "l_extendedprice", 0, 200_000)
    mean = li.where("l_extendedprice BETWEEN 0 AND 200000").agg(F.avg("l_extendedprice").alias("m")).first()["m"]
    solved = math.isinf(tau) or abs(tau - 200_000 / math.expm1(200_000 / tau) - mean) < 1e-4 * mean
    return spark.createDataFrame([(round(mean, 4), bool(solved))], "mean double, solved boolean")


@query("precision_scale", "SELECT round(count(*) / sum(1 / (l_quantity * l_quantity)), 6) AS a FROM lineitem")
def _(spark, sf):
    return spark.createDataFrame([(round(A.precision_scale(lines(spark, sf), "l_quantity"), 6),)], "a double")


@query("dwell_models", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) ** 2 / var_samp(l_quantity), 6) AS shape FROM lineitem")
def _(spark, sf):
    d = T.dwell_models(lines(spark, sf), "l_quantity")
    return spark.createDataFrame([(d["n"], round(d["mean"], 6), round(d["shape"], 6))], "n long, mean double, shape double")


@query(
    "pair_correlation",
    f"""{PT}, d AS (SELECT CAST(floor(sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) / 10) AS BIGINT) AS bin FROM pt a JOIN pt b ON a.row_id <> b.row_id AND (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 < 10000), h AS (SELECT bin, count(*) AS n FROM d GROUP BY 1), c AS (SELECT count(*) AS k FROM pt)
        SELECT b.i AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (k * ((k - 1) / 1000000.0) * pi() * 100 * (2 * b.i + 1)), 6) AS g FROM (SELECT unnest(range(10)) AS i) b LEFT JOIN h ON h.bin = b.i, c""",
)
def _(spark, sf):
    p = points(spark, sf)
    return X.pair_correlation(p, p, 100, 10, 1e6, same=True).select("bin", "n", r6("g", "g"))


@query("null_envelope")
def _(spark, sf):
    return X.envelope(points(spark, sf), (-300, -300, 300, 300), 40, 10, 99)


@query("nearest_precision")
def _(spark, sf):
    b = events(spark, sf).select(F.col("event_id").alias("row_id"), F.floor(F.col("frame") / 60).cast("long").alias("frame"), F.col("value").alias("x_nm"), (F.col("user_id") * 10.0).alias("y_nm"))
    return spark.createDataFrame([(X.nearest_precision(b, 60.0),)], "sigma double")


@query("ring_correlation")
def _(spark, sf):
    c = X.ring_correlation(points(spark, sf).withColumn("half", F.col("row_id") % 2), "half", 20, -600, -600, 60)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "ring int, correlation double")


def _found(spark, sf):
    p = points(spark, sf).withColumn("frame", F.col("row_id") % 20)
    return p.withColumns({"x_nm": F.col("x_nm") + 3, "y_nm": F.col("y_nm") - 2}).where("row_id % 7 <> 0"), p


@query("match_truth")
def _(spark, sf):
    f, t = _found(spark, sf)
    return X.matched(f, t, 15.0)


@query("match_greedy")
def _(spark, sf):
    f, t = _found(spark, sf)
    return X.matched(f, t, 15.0, "greedy")


@query("detection_scores")
def _(spark, sf):
    f, t = _found(spark, sf)
    return X.detection(f, t, X.matched(f, t, 15.0))


@query("position_errors")
def _(spark, sf):
    f, t = _found(spark, sf)
    return X.errors(X.matched(f, t, 15.0), f, t).select("axis", r6("bias", "bias"), r6("rmse", "rmse"), r6("slope", "slope"))


@query("circle_fit")
def _(spark, sf):
    return X.circles(points(spark, sf), "label").select("label", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "radius")], "n")


@query("line_profile", f"{PT}, u AS (SELECT ((x_nm + 100) * 200 + (y_nm + 50) * 100) / sqrt(50000) AS a, ((y_nm + 50) * 200 - (x_nm + 100) * 100) / sqrt(50000) AS c FROM pt) SELECT CAST(floor(c / 5) AS INTEGER) AS bin, count(*) AS n FROM u WHERE a BETWEEN 0 AND sqrt(50000) AND abs(c) <= 40 GROUP BY 1")
def _(spark, sf):
    return X.line_profile(points(spark, sf), (-100, -50), (100, 50), 80, 5)


@query("mixtures")
def _(spark, sf):
    return X.mixtures(points(spark, sf), "label")


@query("cluster_centres", f"{EV}, g AS (SELECT user_id, frame, value, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame, event_id) > 60 THEN 1 ELSE 0 END AS n FROM ev) SELECT user_id, count(*) AS n_locs, CAST(sum(n) + 1 AS BIGINT) AS n_events, round(avg(frame), 4) AS frame_mean, round(avg(value), 6) AS value FROM g GROUP BY 1")
def _(spark, sf):
    c = X.centres(events(spark, sf), "user_id", 60, xy=("value", "t"), row="event_id")
    return c.select("user_id", "n_locs", "n_events", F.round("frame_mean", 4).alias("frame_mean"), r6("value", "value"))


@query(
    "frame_analysis",
    f"""{PT}, f AS (SELECT row_id, CAST(label AS BIGINT) AS c, (row_id % 100) / 99.0 AS r FROM pt), b AS (SELECT c, least(floor(r * 20), 19) AS b, count(*) AS k FROM f GROUP BY ALL), m AS (SELECT c, max(k) AS k FROM b GROUP BY c),
        g AS (SELECT c, avg(r) AS mean, count(*) AS n, min(row_id) AS first FROM f GROUP BY c), kept AS (SELECT c, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM g JOIN m USING (c) WHERE mean BETWEEN 0.2 AND 0.8 AND k <= 0.8 * n)
        SELECT row_id, coalesce(place, -1) AS cluster_id, coalesce(n, 0) AS n_in_cluster FROM f LEFT JOIN kept USING (c)""",
)
def _(spark, sf):
    p = points(spark, sf).withColumns({"cluster_id": F.col("label").cast("long"), "frame": F.col("row_id") % 100})
    return G.frame_analysis(p, 0, 99).select("row_id", "cluster_id", "n_in_cluster")


def _regions(spark, sf):
    p = points(spark, sf)
    c = p.where("row_id < 40").select(F.col("row_id").alias("region_id"), F.col("x_nm").alias("cx"), F.col("y_nm").alias("cy"), F.lit(30.0).alias("radius"))
    return p, c, J.members(p, c, 60)


@query("regions_run", f"{PT}, c AS (SELECT row_id AS region_id, x_nm AS cx, y_nm AS cy FROM pt WHERE row_id < 40) SELECT region_id, round(avg(x_nm), 6) AS x, count(*) AS n FROM pt JOIN c ON (x_nm - cx) ** 2 + (y_nm - cy) ** 2 <= 900 GROUP BY 1")
def _(spark, sf):
    p, _, m = _regions(spark, sf)
    return R.run_regions(p.select("row_id", "x_nm"), m, lambda d: {"x": d["x_nm"].mean()}, ["x"]).select("region_id", r6("x", "x"), "n")


@query("region_maths", f"{PT}, c AS (SELECT row_id AS region_id, x_nm AS cx, y_nm AS cy FROM pt WHERE row_id < 40), a AS (SELECT region_id, count(*) AS n, max(x_nm) - min(x_nm) AS w FROM pt JOIN c ON (x_nm - cx) ** 2 + (y_nm - cy) ** 2 <= 900 GROUP BY 1) SELECT region_id, round(n / (w + 1), 6) AS density FROM a")
def _(spark, sf):
    p, _, m = _regions(spark, sf)
    t = R.aggregate_regions(p, m, n=F.count(F.lit(1)), w=F.max("x_nm") - F.min("x_nm"))
    return R.region_maths(t, {"density": "n / (w + 1)"}).select("region_id", r6("density", "density"))


@query("average_regions", f"{PT}, c AS (SELECT row_id AS region_id, x_nm AS cx, y_nm AS cy FROM pt WHERE row_id < 40) SELECT region_id, row_id, round(x_nm - cx, 6) AS x_nm, round(y_nm - cy, 6) AS y_nm FROM pt JOIN c ON (x_nm - cx) ** 2 + (y_nm - cy) ** 2 <= 900")
def _(spark, sf):
    p, c, m = _regions(spark, sf)
    a = R.average_regions(p.withColumn("frame", F.lit(0)), m, c)
    return a.select("region_id", "row_id", r6("x_nm", "x_nm"), r6("y_nm", "y_nm"))


@query("corners")
def _(spark, sf):
    p, c, m = _regions(spark, sf)
    a = R.average_regions(p.withColumn("frame", F.lit(0)), m, c)
    return R.corners(a, "region_id", inner=5, outer=30)


@query("gaussian_splat")
def _(spark, sf):
    p = points(spark, sf).withColumn("s", 8.0 + F.col("label"))
    return P.gaussian_splat(p, -400, -400, 10, 80, 80, "s").select("row", "col", F.round("value", 6).alias("value"))


@query("movie_steps", f"{EV}, b AS (SELECT min(frame) AS a FROM ev) SELECT event_id, CAST(s AS INTEGER) AS step FROM ev, b, (SELECT unnest(range(11)) AS s) q WHERE frame - a >= s * 100 AND frame - a < s * 100 + 250")
def _(spark, sf):
    e = events(spark, sf)
    a = e.agg(F.min("frame").alias("a")).first()["a"] or 0
    return P.movie_steps(e.withColumn("f", F.col("frame") - a), "f", 0, 1000, 100, 250).select("event_id", "step")


@query("track_segments", f"{EV} SELECT user_id, frame AS x0, value AS y0, lead(frame) OVER w AS x1, lead(value) OVER w AS y1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame, event_id) QUALIFY lead(frame) OVER w IS NOT NULL")
def _(spark, sf):
    e = events(spark, sf).withColumns({"x_nm": F.col("frame"), "y_nm": F.col("value")})
    return P.segments(e, "user_id", "frame", "event_id")


@query("simulate_blinking")
def _(spark, sf):
    """Molecules at the points' places."""
    return simulate.blinking(spark, points(spark, sf).select(F.col("row_id").alias("molecule"), F.col("x_nm").alias("x0"), F.col("y_nm").alias("y0")), 200)


@query("simulate_binding")
def _(spark, sf):
    """A site for each customer."""
    return simulate.binding(spark, spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("site")), 5000, 10, 60)


@query("intervals_to_frames", "SELECT l_orderkey, l_linenumber, f AS frame, round(l_extendedprice * (least(l_quantity / 10 + 1.5, f + 1) - greatest(l_quantity / 10, f)) / 1.5, 4) AS photons_frame FROM (SELECT *, unnest(range(CAST(floor(l_quantity / 10) AS BIGINT), CAST(ceil(l_quantity / 10 + 1.5) AS BIGINT))) AS f FROM lineitem)")
def _(spark, sf):
    li = lines(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_quantity") / 10 + 1.5).alias("b"), "l_extendedprice")
    return simulate.to_frames(li, "a", "b", "l_extendedprice").select("l_orderkey", "l_linenumber", "frame", F.round("photons_frame", 4).alias("photons_frame"))


@query("find_peaks")
def _(spark, sf):
    # An image of counts for each label, over the whole plane.
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) / 80) + 8, F.lit(0)), F.lit(15))
    cells = points(spark, sf).groupBy(F.col("label").cast("long").alias("frame"), (at("y_nm") * 16 + at("x_nm")).cast("int").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    f = cells.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    f = f.select("frame", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("image"))
    return P.peaks(f, 1.0, 1.0, 16, 16)


def _spans(spark, sf):
    e = events(spark, sf)
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    s = e.groupBy("user_id", "event_type").agg(F.min("t").alias("start"), F.max("t").alias("end")).withColumnRenamed("user_id", "id")
    return tuple(s.where(F.col("event_type") == k).select("id", "start", "end", (F.col("id") % 7).alias("file")) for k in (kinds["a"], kinds["b"]))


@query("pair_intervals")
def _(spark, sf):
    a, b = _spans(spark, sf)
    return M.pair_intervals(a, b, 7 * 86400, 3600, ("file",))


@query(
    "pair_offsets",
    f"""{EV}, a AS (SELECT user_id, t, min(value) AS x FROM ev WHERE event_type = (SELECT min(event_type) FROM ev) GROUP BY 1, 2), b AS (SELECT event_id, user_id, t, value AS x FROM ev WHERE event_type = (SELECT max(event_type) FROM ev)),
        p AS (SELECT b.event_id, b.user_id, b.x - a.x AS d, abs(a.t - b.t) AS dt, row_number() OVER (PARTITION BY b.event_id ORDER BY abs(a.t - b.t), a.t) AS k FROM b JOIN a ON a.user_id = b.user_id)
        SELECT user_id, round(median(d), 6) AS dx, count(*) AS n FROM p WHERE k = 1 AND dt <= 86400 GROUP BY 1""",
)
def _(spark, sf):
    e = events(spark, sf)
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    a = e.where(F.col("event_type") == kinds["a"]).groupBy("user_id", "t").agg(F.min("value").alias("x_nm")).withColumn("y_nm", F.lit(0.0))
    b = e.where(F.col("event_type") == kinds["b"]).select("event_id", "user_id", "t", F.col("value").alias("x_nm"), F.lit(0.0).alias("y_nm"))
    return M.pair_offsets(a, b, 86400, "user_id", row="event_id").select("user_id", r6("dx", "dx"), "n")


@query("remove_double_regions")
def _(spark, sf):
    p, c, m = _regions(spark, sf)
    n = c.join(m.groupBy("region_id").count().withColumnRenamed("count", "n"), "region_id").withColumn("filenumber", F.lit(0))
    return M.remove_double_regions(n, 80).select("region_id", "n")


@query("overlapping_circles")
def _(spark, sf):
    p = points(spark, sf).withColumn("radius", 5.0 + F.col("label")).withColumn("score", F.col("row_id") % 17)
    return M.overlapping_circles(p, 15.0).select("row_id")


@query(
    "close_groups",
    f"""WITH RECURSIVE {PT[5:]}, e AS (SELECT a.row_id AS a, b.row_id AS b FROM pt a JOIN pt b ON a.label = b.label AND (a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2 < 25), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT a AS row_id, min(b) AS component FROM w GROUP BY 1""",
)
def _(spark, sf):
    return M.close_groups(points(spark, sf), 5, ("label",))


@query("find_beads")
def _(spark, sf):
    # A user is a place, and a day a frame.
    b = events(spark, sf).select(F.col("event_id").alias("row_id"), F.floor(F.col("t") / 86400).cast("long").alias("frame"), (F.col("user_id") * 1000.0).alias("x_nm"), F.col("value").alias("y_nm"), (F.col("value") * 10).alias("photons"))
    return M.find_beads(b, 30, 100, 0.5, 200)


@query("mean_shift")
def _(spark, sf):
    p = points(spark, sf)
    return M.mean_shift(p, p, 60, 4).select("row_id", *[F.round(c, 4).alias(c) for c in ("x_nm", "y_nm")], "n")


@query(
    "equalised",
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS x, x - floor(x) AS part FROM lineitem), q AS (SELECT quantile_cont(part, {[i / 50 for i in range(51)]}) AS q FROM f),
        k AS (SELECT i, CASE WHEN i = 0 THEN 0.0 ELSE q[i + 1] END AS lo, CASE WHEN i = 49 THEN 1.0 ELSE q[i + 2] END AS hi FROM q, (SELECT unnest(range(50)) AS i))
        SELECT l_orderkey, l_linenumber, round(floor(x) + (i + (part - lo) / (hi - lo)) / 50, 6) AS x_pix FROM f JOIN k ON part >= lo AND part < hi""",
)
def _(spark, sf):
    return M.equalised(lines(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("x_pix")), "x_pix").withColumn("x_pix", r6("x_pix"))


@query(
    "paired_channels",
    f"""{PT}, a AS (SELECT row_id, row_id % 20 AS frame, x_nm + 3 - 3 AS x, y_nm - 2 + 2 AS y FROM pt WHERE row_id % 7 <> 0), d AS (SELECT frame, a.row_id AS a, pt.row_id AS b, sqrt((x - x_nm) ** 2 + (y - y_nm) ** 2) AS d FROM a JOIN pt ON frame = pt.row_id % 20),
        m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY b ORDER BY d, a) AS j FROM d WHERE d <= 5) SELECT frame, a, b, round(d, 6) AS d FROM m WHERE i = 1 AND j = 1""",
)
def _(spark, sf):
    f, t = _found(spark, sf)
    return M.paired_channels(f, t, D.Transformation("affine", [[1, 0, -3], [0, 1, 2]]), 5).withColumn("d", r6("d"))
