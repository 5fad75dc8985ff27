"""Queries of overlap drift, trees and cells of points, bead curves, phases and colours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import beads as B
from ..operators import colours as C
from ..operators import fit as Q
from ..operators import grouping as G
from ..operators import hierarchy as H
from ..operators import measure as M
from ..operators import overlap as O
from ..operators import phase as P
from ..operators import quality as K
from ..operators import spectrum as S
from ..operators import steps as T
from ..operators import voronoi as V
from ..operators import window_stats as W
from .catalog import EV, PT, events, lines, points, query, r6
from .catalog_measure import pixels

SITES = f"{EV}, s AS (SELECT event_id AS row_id, frame, value AS x_nm, user_id * 10.0 AS y_nm, CAST(floor((frame - (SELECT min(frame) FROM ev)) / 4320) AS BIGINT) AS win FROM ev WHERE isfinite(value))"


def sites(spark, sf):
    """Events as places: the value across, the user down, so that one user's equal values are one site."""
    return events(spark, sf).select(F.col("event_id").alias("row_id"), "frame", F.col("value").alias("x_nm"), (F.col("user_id") * 10.0).alias("y_nm"))


@query(
    "drift_overlap",
    f"""{SITES}, p AS (SELECT a.win AS wa, b.win AS wb, (b.x_nm - 0.1 * b.win) - (a.x_nm - 0.1 * a.win) AS dx, (b.y_nm + 0.05 * b.win) - (a.y_nm + 0.05 * a.win) AS dy
        FROM s a JOIN s b ON a.win < b.win AND sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) <= 4),
        v AS (SELECT *, exp(-(dx * dx + dy * dy) / (4 * 2.0 ** 2)) / 2 AS v FROM p),
        g AS (SELECT wa AS win, v / 2 AS v, -v * dx / 8 AS gx, -v * dy / 8 AS gy FROM v UNION ALL SELECT wb, v / 2, v * dx / 8, v * dy / 8 FROM v)
        SELECT win AS "window", round(sum(v), 4) AS value, round(sum(gx), 4) AS gx, round(sum(gy), 4) AS gy FROM g GROUP BY win""",
)
def _(spark, sf):
    rows = O.time_windows(sites(spark, sf), 4320)
    k = np.arange(rows.agg(F.max("window")).first()[0] + 1)
    got = O.overlap(O.drift_pairs(rows, 4.0), np.stack([0.1 * k, -0.05 * k], 1), 2.0)
    return got.select("window", *[F.round(c, 4).alias(c) for c in ("value", "gx", "gy")])


@query("drift_by_overlap")
def _(spark, sf):
    s = sites(spark, sf)
    drift = O.overlap_drift(s, 4320, 4.0, 1.0)
    return O.drift_curve(s, drift, 4320).select("frame", r6("d_x_nm", "d_x_nm"), r6("d_y_nm", "d_y_nm"))


# The tree of the places' mutual reachability with four others as core, one edge a step from the first place on.
TREE = f"""{PT}, p AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS INT) AS i, x_nm, y_nm FROM pt),
    d AS MATERIALIZED (SELECT a.i AS a, b.i AS b, sqrt((a.x_nm - b.x_nm) ** 2 + (a.y_nm - b.y_nm) ** 2) AS d FROM p a JOIN p b ON a.i <> b.i),
    c AS (SELECT a AS i, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 4),
    e AS MATERIALIZED (SELECT a, b, greatest(d, ca.core, cb.core) AS w FROM d JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b)"""


@query(
    "spanning_tree",
    TREE.replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT 0 AS n, set_bit(repeat('0', (SELECT count(*) FROM p)::INT)::BIT, 0, 1) AS seen, 0.0::DOUBLE AS w
        UNION ALL SELECT t.n + 1, set_bit(any_value(t.seen), arg_min(e.b, e.w), 1), min(e.w) FROM t JOIN e ON get_bit(t.seen, e.a) = 1 AND get_bit(t.seen, e.b) = 0 GROUP BY t.n)
        SELECT count(*) - 1 AS n, round(sum(w), 4) AS weight, round(max(w), 6) AS longest FROM t""",
)
def _(spark, sf):
    tree, _, _ = H.condensed(points(spark, sf), 5, 4, 100.0)
    return tree.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("weight"), r6(F.max("w"), "longest"))


@query("hdbscan")
def _(spark, sf):
    return H.hdbscan(points(spark, sf), 5, 4).select("row_id", "cluster_id", "n_in_cluster")


@query("voronoi_density")
def _(spark, sf):
    p = points(spark, sf)
    bound = 0.05 * p.count() / V.hull_area(p)
    return V.voronoi_density(p, bound).select("row_id", F.round("density", 9).alias("density"))


@query("voronoi_clusters")
def _(spark, sf):
    return V.voronoi_clusters(points(spark, sf), 2.0, 5).select("row_id", "cluster_id", "n_in_cluster")


@query(
    "bead_sums",
    f"""{EV}, e AS (SELECT (SELECT min(frame) FROM ev) AS lo, (SELECT max(frame) FROM ev) AS hi), s AS (SELECT user_id AS bead, value AS p, (frame - lo) / ((hi - lo) / 5.0) AS s FROM ev, e),
        j AS (SELECT *, CAST(least(floor(s), 4) AS INT) AS j FROM s),
        k AS (SELECT *, s - j AS l1, s - greatest(j - 1, 0) AS l2, s - greatest(j - 2, 0) AS l3, j + 1 - s AS r1, least(j + 2, 5) - s AS r2, least(j + 3, 5) - s AS r3 FROM j),
        a AS (SELECT *, r1 / (r1 + l1) AS a0, l1 / (r1 + l1) AS a1 FROM k),
        c AS (SELECT *, r1 * a0 / (r1 + l2) AS c0, l2 * a0 / (r1 + l2) + r2 * a1 / (r2 + l1) AS c1, l1 * a1 / (r2 + l1) AS c2 FROM a),
        b AS (SELECT bead, j, p, r1 * c0 / (r1 + l3) AS b0, l3 * c0 / (r1 + l3) + r2 * c1 / (r2 + l2) AS b1, l2 * c1 / (r2 + l2) + r3 * c2 / (r3 + l1) AS b2, l1 * c2 / (r3 + l1) AS b3 FROM c)
        SELECT bead, j AS span, count(*)::DOUBLE AS w, round(sum(b0), 6) AS b0, round(sum(b3), 6) AS b3, round(sum(b0 * b0), 6) AS b00, round(sum(b1 * b2), 6) AS b12, round(sum(p), 4) AS p_value, round(sum(b2 * p), 4) AS q2_value FROM b GROUP BY 1, 2""",
)
def _(spark, sf):
    e = events(spark, sf)
    ends = e.agg(F.min("frame"), F.max("frame")).first()
    got = B.spline_sums(e, float(ends[0]), float(ends[1]), 8, ("value",), "user_id", "frame")
    return got.select("bead", "span", "w", *[r6(c, c) for c in ("b0", "b3", "b00", "b12")], *[F.round(c, 4).alias(c) for c in ("p_value", "q2_value")])


@query("bead_choice")
def _(spark, sf):
    got = B.select_beads(events(spark, sf), 4320.0, ("value",), "user_id", "frame", margin=5.0)
    rows = got.table.reset_index(names="bead")[["bead", "n", "coverage", "noise_nm", "wander_nm", "jump_nm", "used"]]
    return spark.createDataFrame(rows)


# An event's value is its coarse place, its phase that of the value with a drift over frames and an error from its number.
PHASE = f"""{EV}, r AS (SELECT event_id, frame, 0.05 * value + 0.0001 * (frame - (SELECT min(frame) FROM ev)) + 0.1 * (event_id % 7 - 3) AS a, value + (event_id % 11 - 5) * 4.0 AS z, 10.0 + event_id % 13 AS err FROM ev),
    ph AS (SELECT *, a - 2 * pi() * round(a / (2 * pi())) AS phase, 1 / (0.04 + 0.0025 * err * err) AS w FROM r),
    win AS (SELECT CAST(floor((frame - (SELECT min(frame) FROM ph)) / 4320) AS BIGINT) AS win, sum(w * cos(phase - 0.05 * z)) AS c, sum(w * sin(phase - 0.05 * z)) AS s, sum(w) AS w, sum(w * w) AS w2, count(*) AS n FROM ph GROUP BY 1 HAVING count(*) >= 20),
    tu AS (SELECT *, atan2(s, c) AS angle, coalesce(-round((atan2(s, c) - lag(atan2(s, c)) OVER (ORDER BY win)) / (2 * pi())), 0) AS turn FROM win),
    ca AS (SELECT win, (SELECT min(frame) FROM ph) + (win + 0.5) * 4320 AS centre, angle + 2 * pi() * sum(turn) OVER (ORDER BY win) AS phase0, sqrt(-2 * ln(sqrt(c * c + s * s) / w)) / sqrt(w * w / w2) AS error, n FROM tu)"""


def phases(spark, sf):
    e = events(spark, sf)
    first = e.agg(F.min("frame")).first()[0]
    a = 0.05 * F.col("value") + 0.0001 * (F.col("frame") - first) + 0.1 * (F.col("event_id") % 7 - 3)
    return e.select("event_id", "frame", (a - 2 * np.pi * F.round(a / (2 * np.pi))).alias("phase_rad"), F.lit(0.2).alias("phase_err_rad"), (F.col("value") + (F.col("event_id") % 11 - 5) * 4.0).alias("z_env_nm"), (10.0 + F.col("event_id") % 13).alias("z_env_err_nm"))


@query("cavity_phase", f"{PHASE} SELECT win AS \"window\", centre, round(phase0, 6) AS phase0, round(error, 6) AS error, n FROM ca")
def _(spark, sf):
    got = P.cavity_phase(phases(spark, sf), 0.05, 4320)
    return got.select("window", "centre", r6("phase0", "phase0"), r6("error", "error"), "n")


@query(
    "fringes",
    f"""{PHASE}, uu AS (SELECT ph.*, ((frame - (SELECT min(centre) FROM ca)) / 4320) AS u FROM ph), k AS (SELECT *, greatest(least(floor(u), (SELECT max(win) - 1 FROM ca)), 0) AS lo FROM uu),
        b AS (SELECT k.*, p.phase0 + (q.phase0 - p.phase0) * (k.frame - p.centre) / 4320 AS phase0 FROM k JOIN ca p ON p.win = k.lo JOIN ca q ON q.win = k.lo + 1),
        n AS (SELECT *, (phase - phase0) / 0.05 AS base, round_even((z - (phase - phase0) / 0.05) / (2 * pi() / 0.05), 0) AS n FROM b)
        SELECT event_id, round(base + n * 2 * pi() / 0.05, 5) AS z_nm, n::BIGINT AS fringe,
        round(1 / (SELECT sum(exp(-0.5 * (((z - base - (n + i) * 2 * pi() / 0.05) / err) ** 2 - ((z - base - n * 2 * pi() / 0.05) / err) ** 2))) FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS i)), 6) AS probability FROM n""",
)
def _(spark, sf):
    rows = phases(spark, sf)
    got = P.unwrapped(P.with_cavity_phase(rows, P.cavity_phase(rows, 0.05, 4320), 4320), 0.05, calibrate=False)
    return got.select("event_id", F.round("z_nm", 5).alias("z_nm"), "fringe", r6("fringe_probability", "probability"))


# Users with even numbers are traces of one colour, with odd ones of the other; a row's time is its minute.
PAIRS = f"""{EV}, a AS (SELECT DISTINCT user_id AS a, frame AS t, value AS x FROM ev WHERE user_id % 2 = 0), b AS (SELECT DISTINCT user_id AS b, frame AS t, value AS x FROM ev WHERE user_id % 2 = 1),
    m AS (SELECT b, b.t, b.x, a, arg_min(b.x - a.x, (abs(a.t - b.t), a.t, a.x)) AS dx FROM b JOIN a ON abs(a.t - b.t) <= 240 GROUP BY b, b.t, b.x, a)"""


def two_colours(spark, sf):
    e = events(spark, sf).select("user_id", (F.col("user_id") % 2).alias("channel"), F.col("frame").cast("double").alias("t"), F.col("value").alias("x_nm"), F.lit(0.0).alias("y_nm"))
    return C.traces(e, "user_id")


@query(
    "colour_matches",
    f"SELECT a, b, n AS matched, c AS close, round(s, 6) AS separation FROM ({PAIRS} SELECT a, b, count(*) AS n, sum((abs(dx) <= 40)::INT)::BIGINT AS c, median(abs(dx)) AS s FROM m GROUP BY 1, 2) WHERE n >= 4 AND c >= 0.6 * n",
)
def _(spark, sf):
    got = C.pair_candidates(two_colours(spark, sf), 240.0, 40.0, 4, 0.6, -1e9)
    return got.select("a", "b", "matched", "close", r6("separation", "separation"))


@query("colour_pairs")
def _(spark, sf):
    rows = two_colours(spark, sf)
    pairs = C.paired(rows, 240.0, 40.0, 4, 0.6)
    return C.pair_values(rows, pairs, 240.0, 40.0).select("pair_id", "n_traces", "n_0", "n_1", "n_matched", *[r6(c, c) for c in ("within", "separation_nm", "dx_nm")], "both")


@query(
    "window_lags",
    f"""{PT}, pix AS (SELECT DISTINCT CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py FROM pt)
        SELECT CAST(b.px - a.px AS INT) AS lx, CAST(b.py - a.py AS INT) AS ly, count(*) AS n FROM pix a JOIN pix b ON abs(b.px - a.px) <= 4 AND abs(b.py - a.py) <= 4 GROUP BY 1, 2""",
)
def _(spark, sf):
    p = points(spark, sf)
    pixels = p.select(F.floor(F.col("x_nm") / 50).cast("long").alias("px"), F.floor(F.col("y_nm") / 50).cast("long").alias("py")).distinct()
    return W.lag_counts(pixels, 4)


@query("window_statistics")
def _(spark, sf):
    p = points(spark, sf)
    pixels = p.select(F.floor(F.col("x_nm") / 50).cast("long").alias("px"), F.floor(F.col("y_nm") / 50).cast("long").alias("py")).distinct()
    rings, test = W.pair_statistics(p, pixels, 50.0, 100.0, 10.0)
    return spark.createDataFrame([{k: v for k, v in r.items()} | {"p": test["p"]} for r in rings])


@query(
    "track_pieces",
    f"""{EV}, f AS (SELECT user_id, frame, min(event_id) AS event_id FROM ev GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS i FROM f),
        p AS (SELECT user_id, event_id, i, i // 10 AS piece FROM n UNION ALL SELECT user_id, event_id, i, i // 10 - 1 FROM n WHERE i % 10 = 0 AND i > 0)
        SELECT user_id AS track, piece::BIGINT AS piece, count(*) - 1 AS n_jumps, arg_min(event_id, i) AS first_row, arg_max(event_id, i) AS last_row FROM p GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf):
    got = S.pieces(events(spark, sf), "user_id", xy=("value",), row="event_id")
    return got.select("track", "piece", "n_jumps", F.element_at("rows", 1)["row"].alias("first_row"), F.element_at("rows", -1)["row"].alias("last_row"))


@query("diffusion_spectrum")
def _(spark, sf):
    d, share, _ = S.spectrum(events(spark, sf), 60.0, S.grid(1e-9, 1e-4, 60), rounds=60, track="user_id", xy=("value",), row="event_id")
    return spark.createDataFrame([(float(a), round(float(b), 6)) for a, b in zip(d, share, strict=True)], "d double, share double")


@query("s_curve_steps")
def _(spark, sf):
    got = T.steps_of(events(spark, sf), "user_id", "t", "value")
    return got.select("user_id", "plateau", "start", "n", *[r6(c, c) for c in ("dwell", "level", "step")])


# Each user is a trace; every seventh event isn't used.
TRACES = f"""{EV}, u AS (SELECT *, dense_rank() OVER (ORDER BY user_id) AS g FROM ev WHERE event_id % 7 <> 0)"""


def _traces(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("row_id"), F.col("user_id").alias("tid"), "frame", F.col("value").alias("x_nm"), (F.col("event_id") % 7).alias("use"))
    return G.group_table(e, rules={"x_nm": "mean", "frame": "min"})


@query("grouped_traces", f"{TRACES} SELECT g AS group_id, count(*) AS n_in_group, min(frame) AS frame, round(avg(value), 6) AS x_nm FROM u GROUP BY g")
def _(spark, sf):
    return _traces(spark, sf)[0].select("group_id", F.col("n_in_group").cast("long").alias("n_in_group"), "frame", r6("x_nm", "x_nm"))


@query("trace_groups", f"{TRACES} SELECT ev.event_id AS row_id, coalesce(g, -1) AS group_id, coalesce(n, 0) AS n_in_group FROM ev LEFT JOIN u USING (event_id) LEFT JOIN (SELECT g, count(*) AS n FROM u GROUP BY g) USING (g)")
def _(spark, sf):
    return _traces(spark, sf)[1].select("row_id", "group_id", "n_in_group")


@query("event_cores")
def _(spark, sf):
    return M.event_cores(sites(spark, sf), 5.0, 600, 3).select("row_id", "group_id")


def _boxes(spark, sf):
    p = points(spark, sf)
    centres = p.select("row_id", F.floor(p["x_nm"] / 50).cast("long").alias("px"), F.floor(p["y_nm"] / 50).cast("long").alias("py"))
    return Q.boxes(M.cut_boxes(pixels(spark, sf), centres, 3, (64, 64)))


@query(
    "spot_boxes",
    f"""{PT}, pix AS (SELECT CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py, count(*) AS value FROM pt GROUP BY ALL),
        c AS (SELECT row_id, CAST(floor(x_nm / 50) AS BIGINT) AS px, CAST(floor(y_nm / 50) AS BIGINT) AS py FROM pt)
        SELECT row_id, 7 AS side, coalesce(sum(value), 0)::DOUBLE AS total, coalesce(sum(value * ((pix.py - c.py + 3) * 7 + pix.px - c.px + 4)), 0)::DOUBLE AS placed
        FROM c LEFT JOIN pix ON abs(pix.px - c.px) <= 3 AND abs(pix.py - c.py) <= 3 WHERE c.px >= 3 AND c.py >= 3 AND c.px < 61 AND c.py < 61 GROUP BY row_id""",
)
def _(spark, sf):
    placed = F.aggregate(F.zip_with("box", F.sequence(F.lit(1), F.lit(49)), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return _boxes(spark, sf).select("row_id", "side", F.aggregate("box", F.lit(0.0), lambda a, v: a + v).alias("total"), placed.alias("placed"))


@query("gaussian_fits")
def _(spark, sf):
    return Q.fit_boxes(_boxes(spark, sf), 1.0).select("row_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "photons", "background", "sigma")])


@query(
    "upper_valley",
    """WITH v AS (SELECT l_extendedprice::DOUBLE AS x FROM lineitem WHERE l_extendedprice > 0), q AS (SELECT quantile_cont(x, 0.995) AS top FROM v),
        h AS (SELECT i, (SELECT count(*) FROM v, q WHERE x <= top AND least(floor(x / (top / 120)), 119) = i) AS n FROM (SELECT unnest(range(120)) AS i)),
        g AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) AS w FROM (SELECT unnest(range(-8, 9)) AS k)),
        s AS (SELECT a.i, sum(g.w * h.n) / (SELECT sum(w) FROM g) AS s FROM h a, g JOIN h ON h.i = CASE WHEN a.i + k < 0 THEN -(a.i + k) - 1 WHEN a.i + k > 119 THEN 239 - (a.i + k) ELSE a.i + k END GROUP BY a.i),
        j AS (SELECT i AS j, s AS sj FROM s ORDER BY s DESC, i LIMIT 1),
        k AS (SELECT i AS k, s AS sk FROM s, j WHERE i > j AND i + 0.5 <= 2 * (j + 0.5) ORDER BY s, i LIMIT 1),
        a AS (SELECT max(s) AS m, count(*) AS c FROM s, j, k WHERE i >= k AND i < least(120, 2 * j + 2)),
        t AS (SELECT min(i) AS i FROM s, j WHERE i > j AND s <= 0.05 * sj)
        SELECT round((j + 0.5) * top / 120, 4) AS peak, c > 2 AND m > 1.2 * sk + 1 AS valley,
        round(CASE WHEN k IS NULL THEN top WHEN c > 2 AND m > 1.2 * sk + 1 THEN (k + 0.5) * top / 120 WHEN t.i IS NOT NULL THEN (t.i + 0.5) * top / 120 ELSE top END, 4) AS bound FROM j LEFT JOIN k ON true, a, t, q""",
)
def _(spark, sf):
    v = K.upper_valley(lines(spark, sf), "l_extendedprice")
    return spark.createDataFrame([(round(v.peak, 4), v.valley, round(v.bound, 4))], "peak double, valley boolean, bound double")


@query(
    "frame_rates",
    f"""{EV}, e AS (SELECT min(frame) AS lo, max(frame) AS hi, count(*) AS n, median(frame) AS m, avg(frame) - min(frame) AS a FROM ev)
        SELECT n, lo::DOUBLE AS first, hi::DOUBLE AS last, m AS median_frame, round((SELECT count(*) FROM ev WHERE frame < lo + (hi - lo) / 10.0) / ((hi - lo) / 10.0), 6) AS first_rate,
        round((SELECT count(*) FROM ev WHERE frame > hi - (hi - lo) / 10.0) / ((hi - lo) / 10.0), 6) AS last_rate, a < (hi - lo) / 2.0 AS falls FROM e""",
)
def _(spark, sf):
    e = events(spark, sf)
    d = K.frame_decay(e)
    mean = e.agg(F.avg("frame")).first()[0]
    row = (d["n"], d["first"], d["last"], d["median_frame"], round(d["first_rate"], 6), round(d["last_rate"], 6), mean - d["first"] < (d["last"] - d["first"]) / 2)
    return spark.createDataFrame([row], "n long, first double, last double, median_frame double, first_rate double, last_rate double, falls boolean")
