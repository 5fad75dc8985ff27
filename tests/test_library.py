"""Semantics of the operators on small fixtures, and every query with SQL against DuckDB at the smallest scale."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotlake.functions import expressions as E
from spotlake.functions import simulate
from spotlake.operators import aggregate as A
from spotlake.operators import drift as D
from spotlake.operators import filters as L
from spotlake.operators import graph as G
from spotlake.operators import joins as J
from spotlake.operators import spatial as X
from spotlake.operators import tables as S
from spotlake.operators import traces as T
from spotlake.operators import windows as W
from spotlake.plans import catalog
from spotlake.plans.registry import Batch, Chain, Step
from spotlake.sources import discovery, formats
from spotlake.streaming import live

NAN = float("nan")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    cols = sorted(df.columns)
    def text(x):
        if pd.isna(x):
            return "-"
        return f"{float(x) + 0.0:.6g}" if isinstance(x, (float, int, np.number)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_against_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = catalog.queries()[name](spark, sf).toPandas(), c.execute(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_range_is_inclusive_and_nan_fails(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, NAN)], "i int, v double")
    ids = lambda f: sorted(r["i"] for r in f.apply(df).collect())
    assert ids(L.Filters().set("v", 1, 2)) == [1, 2]
    assert ids(L.Filters().set("v", 1, 2, invert=True)) == [3, 4]
    assert ids(L.Filters().set("v", 2, None)) == [2, 3]
    assert ids(L.Filters().set("v")) == [1, 2, 3, 4]


@pytest.mark.parametrize(
    "text, want",
    [("a / 0", math.inf), ("-a / 0", -math.inf), ("0 / 0", NAN), ("log(0)", -math.inf), ("log(-1)", NAN), ("sqrt(-1)", NAN), ("-3.5 % 2", 0.5), ("7 // -2", -4), ("round(2.5)", 2.0), ("minimum(a, nan)", NAN), ("where(a > 1, 5, 6)", 5), ("(a > 1) & (a < 2)", 0.0), ("a if a > 3 else 0", 0.0), ("2 ** 3", 8.0)],
)
def test_expressions(spark, text, want):
    df = spark.createDataFrame([(2.0,)], "a double")
    got = E.with_expression(df, "v", text, exact=True).first()["v"]
    assert (math.isnan(got) and math.isnan(want)) or got == want


@pytest.mark.parametrize("text", ["a and b", "1 < a < 2", "a > 1 & b > 2", "__import__('os')", "a.b", "[1]", "missing + 1"])
def test_expressions_refused(spark, text):
    with pytest.raises(E.ExpressionError):
        E.evaluate(spark.createDataFrame([(2.0, 1.0)], "a double, b double"), text)


def test_rename_in():
    assert E.rename_in("sin(x) + xx * x", "x", "y") == "sin(y) + xx * y"
    assert E.names_in("sin(x) + pi * count(y)") == {"x", "y"}


def test_combine_rules(spark):
    rows = [(0, 1.0, 1.0, 10.0, 3.0), (0, 3.0, 2.0, 20.0, 4.0), (1, NAN, 1.0, 5.0, 1.0)]
    r = {x["g"]: x for x in A.combine(spark.createDataFrame(rows, "g int, x_nm double, x_err_nm double, photons double, photons_err double"), ["g"]).collect()}
    assert r[0]["x_nm"] == pytest.approx((1 + 3 / 4) / (1 + 1 / 4)) and r[0]["x_err_nm"] == pytest.approx(1 / math.sqrt(1.25))
    assert r[0]["photons"] == 30 and r[0]["photons_err"] == 5 and r[0]["n_in_group"] == 2
    assert math.isnan(r[1]["x_nm"])


def spots(spark, runs):
    rows, i = [], 0
    for x, y, first, n in runs:
        for f in range(first, first + n):
            rows.append((i, float(x), float(y), f))
            i += 1
    return spark.createDataFrame(rows, "row_id long, x_nm double, y_nm double, frame long")


@pytest.mark.parametrize("runs, dx, dt, groups", [([(0, 0, 0, 3), (0, 0, 5, 3)], 10, 1, 2), ([(0, 0, 0, 3), (0, 0, 5, 3)], 10, 2, 1), ([(0, 0, 0, 1), (9, 9, 1, 1)], 10, 0, 1), ([(0, 0, 0, 1), (11, 0, 1, 1)], 10, 0, 2)])
def test_linking(spark, runs, dx, dt, groups):
    assert G.link_blinks(spots(spark, runs), dx, dt).select("group_id").distinct().count() == groups


def test_linking_is_the_undivided_walk(spark):
    rng = np.random.default_rng(0)
    x, y, f = rng.uniform(0, 300, 250), rng.uniform(0, 300, 250), rng.integers(0, 40, 250)
    order = np.lexsort((x, f))
    want = G.walk_links(f[order], x[order], y[order], 25.0, 1)
    df = spark.createDataFrame([(int(k), float(x[k]), float(y[k]), int(f[k])) for k in range(250)], "row_id long, x_nm double, y_nm double, frame long")
    got = {r["row_id"]: r["group_id"] for r in G.link_blinks(df, 25.0, 1).collect()}
    assert [got[int(k)] for k in order] == want.tolist()


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(c, 15, (n, 2)) for c, n in (((0, 0), 60), ((500, 0), 40), ((0, 600), 25))] + [rng.uniform(-2000, 2000, (30, 2))])
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "row_id long, x_nm double, y_nm double")
    got = {r["row_id"]: r["cluster_id"] for r in G.dbscan(df, 30, 5).collect()}
    d = np.hypot(*(p[:, None] - p).transpose(2, 0, 1))
    core = (d <= 30).sum(1) - 1 >= 5
    label = np.where(core, np.arange(len(p)), -1)
    for _ in range(len(p)):
        new = np.array([min([label[j] for j in np.flatnonzero((d[i] <= 30) & core)], default=-1) if core[i] else -1 for i in range(len(p))])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        near = np.flatnonzero((d[i] <= 30) & core)
        label[i] = label[near[np.argmin(d[i][near])]] if len(near) else -1
    sizes = sorted(((-(label == v).sum(), np.flatnonzero(label == v)[0], v) for v in set(label) - {-1}))
    number = {v: i + 1 for i, (_, _, v) in enumerate(sizes)} | {-1: -1}
    assert [got[i] for i in range(len(p))] == [number[v] for v in label]


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (2, 5), (5, 3)):
        c = rng.uniform(0, 1, (n, m))
        a, b = G.assign(c)
        small = c if n <= m else c.T
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in permutations(range(max(n, m)), min(n, m)))
        assert c[a, b].sum() == pytest.approx(best) and len(a) == min(n, m)


def test_tracks_are_found(spark):
    t = simulate.tracks(spark, 20, 15, 0.01, 0.02, size_nm=50_000)
    linked = G.link_tracks(t, 300.0, 1)
    s = G.link_score(linked, "track_id", "track_id_true").first()
    assert s["links_found"] == s["links_true"] == 20 * 14 and s["links_wrong"] == 0 and s["tracks_whole"] == 20


def test_components_of_a_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r["row_id"]: r["component"] for r in G.connected_components(spark.range(200).withColumnRenamed("id", "row_id"), spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[150] == 150


def test_one_per_molecule_chain(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0, 1.0), (1, 5.0, 0.0, 0, 2.0), (2, 10.0, 0.0, 0, 3.0)], "row_id long, x_nm double, y_nm double, frame int, peak double")
    assert sorted(r["row_id"] for r in G.one_per_molecule(df, 6, "peak").collect()) == [0, 2]


def test_nearest_in_time_takes_the_earlier_on_a_tie(spark):
    a = spark.createDataFrame([(0, 5.0), (1, 100.0)], "row_id long, t double")
    b = spark.createDataFrame([(4.0, 1.0), (6.0, 2.0)], "t double, v double")
    r = {x["row_id"]: x for x in J.nearest_in_time(a, b, "t", ["v"], max_dt=10).collect()}
    assert r[0]["near_v"] == 1.0 and r[0]["dt"] == -1.0 and r[1]["near_v"] is None


def test_nearest_neighbours_when_there_are_few(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 1000.0, 0.0)], "row_id long, x_nm double, y_nm double")
    r = {(x["row_id"], x["rank"]): x["d"] for x in J.nearest_neighbours(p, p, 2, 1.0, same=True).collect()}
    assert r[0, 1] == 1000 and r[0, 2] == math.inf


def test_union_pads_by_kind(spark):
    a = spark.createDataFrame([(1, 2.0)], "track_id long, x double")
    b = spark.createDataFrame([(7,)], "n int")
    r = S.concat([a, b]).where("n = 7").first()
    assert r["track_id"] == -1 and math.isnan(r["x"])


def test_sort_puts_missing_last_both_ways(spark):
    df = spark.createDataFrame([(0, NAN), (1, 2.0), (2, 1.0)], "row_id long, v double")
    assert [r["row_id"] for r in S.ordered(df, [("v", False)]).collect()] == [2, 1, 0]
    assert [r["row_id"] for r in S.ordered(df, [("v", True)]).collect()] == [1, 2, 0]


def test_conditions_are_two_valued(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 1.0), (3, None)], "i int, v double")
    keep = lambda t: sorted(r["i"] for r in df.where(L.condition(t, {"v": F.col("v")})).collect())
    assert keep("v >= 6") == [1] and keep("not v >= 6") == [2, 3]


def test_drift_outside_the_curve_is_an_error(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0)], "frame long, x_nm double, y_nm double")
    curve = spark.createDataFrame([(5, 0.0, 0.0)], "frame long, d_x_nm double, d_y_nm double")
    with pytest.raises(Exception, match="no drift for frame"):
        D.apply_drift(df, curve).collect()


def test_transformation_inverse():
    t = D.Transformation("affine", [[1.1, -0.2, 5], [0.2, 0.9, -3]])
    m = np.vstack([t.c, [0, 0, 1]]) @ np.vstack([t.inverse().c, [0, 0, 1]])
    assert np.allclose(m, np.eye(3)) and D.Transformation.from_dict(t.to_dict()).kind == "affine"


def test_steps_of_a_clean_trace():
    x = np.r_[np.zeros(50), np.full(40, 5.0), np.full(60, 2.0)] + np.random.default_rng(3).normal(0, 0.2, 150)
    assert T.find_steps(x, 5.0) == [50, 90]


def test_bursts_ignore_nan_gaps(spark):
    b = spark.createDataFrame([(0, 1, 0, 3), (1, 1, 10, 12), (2, 1, 11, 11)], "row_id long, molecule long, first long, last long")
    d = W.dark_frames(b)
    assert [r["dark"] if r["dark"] == r["dark"] else None for r in d.orderBy("row_id").collect()] == [None, 6.0, None]
    assert [r["burst"] for r in W.bursts(d, F.col("dark"), 5, "molecule", "first").orderBy("row_id").collect()] == [0, 1, 1]


def test_truncated_mean():
    for tau in (1.0, 5.0, 50.0):
        mean = tau - 20 / math.expm1(20 / tau)
        assert A.truncated_mean_scale(mean, 0, 20) == pytest.approx(tau, rel=1e-6)
    assert math.isinf(A.truncated_mean_scale(10, 0, 20))


def test_matching(spark):
    f = spark.createDataFrame([(0, 0.0, 0.0, 0), (1, 4.0, 0.0, 0)], "row_id long, x_nm double, y_nm double, frame int")
    t = spark.createDataFrame([(0, 3.0, 0.0, 0), (1, 9.0, 0.0, 0)], "row_id long, x_nm double, y_nm double, frame int")
    assert sorted((r["found"], r["truth"]) for r in X.matched(f, t, 6).collect()) == [(0, 0), (1, 1)]
    assert sorted((r["found"], r["truth"]) for r in X.matched(f, t, 6, "greedy").collect()) == [(1, 0)]


def test_path_filter():
    f = discovery.parse_filter("*.csv & !old*, (a?.json | 'b c.txt')")
    assert f("x/new.csv") and not f("x/old1.csv") and f("A1.JSON") and f("b c.txt") and not f("d.txt")
    with pytest.raises(ValueError):
        discovery.parse_filter("(a")


def test_csv_headers():
    assert formats.delimiter("a\tb,c\td") == "\t"
    assert formats.header_mapping(["x [um]", "frame", "uncertainty [nm]"]) == {"x [um]": ("x_nm", 1000.0), "frame": ("frame", 1.0), "uncertainty [nm]": ("xy_err_nm", 1.0)}


def test_chain_and_batch(spark, sf, tmp_path):
    c = Chain([Step("Filter/Range", {"column": "l_quantity", "lo": 10, "hi": 20, "unknown": 1})])
    b, p = Batch(c), f"{sf}/lineitem.parquet"
    load = lambda s, path: s.read.parquet(path)
    first = b.run(spark, [p, "/nowhere.parquet"], str(tmp_path), load).collect()
    assert [r["status"] for r in first] == ["done", "failed"] and b.run(spark, [p], str(tmp_path), load).first()["status"] == "unchanged"
    assert Chain([Step("No/Such")]).check()


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value").withColumn("t", F.col("us") / 1e6).drop("us")
    e.orderBy("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = live.follow(spark, str(tmp_path / "in"), e.schema)
    q = live.link_online(s, "user_id", 3600.0).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    b = W.sessions(e, "user_id", "t", 3600.0, "event_id").groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"))
    last = b.groupBy("user_id").agg(F.max("burst").alias("burst"))
    want = sorted((r["user_id"], round(r["start"], 3), r["n"]) for r in b.join(last, ["user_id", "burst"], "left_anti").collect())
    assert sorted((r["user_id"], round(r["start"], 3), r["n"]) for r in spark.sql("select * from online").collect()) == want
    with pytest.raises(live.LiveTableError):
        live.check_live(s, "link")


def test_scans_read_only_what_they_need(spark, sf):
    plan = catalog.queries()["range_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "GreaterThanOrEqual(l_quantity" in plan


def test_empty_tables(spark):
    e = spark.createDataFrame([], "row_id long, x_nm double, y_nm double, frame long")
    assert G.dbscan(e, 5, 3).count() == 0 and G.link_blinks(e).count() == 0 and G.link_tracks(e).count() == 0
    assert J.neighbour_count(e, e, 5, same=True).count() == 0


@pytest.mark.parametrize("name", ["hidden_states", "null_envelope", "mixtures", "mean_shift"])
def test_queries_read_all_rows(spark, tmp_path, name):
    """Ids above any limit give the same results as small ones."""
    got = []
    for k in (0, 1_000_000):
        rows = [(k + i, [math.sin(i) / 10, math.cos(i * i) / 10], i % 3) for i in range(60)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        rows = [(k + i, k + i % 5, "a", i % 7 + 10.0 * (i // 20 % 2)) for i in range(200)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(f"{tmp_path}/{k}/events.parquet")
        found = catalog.queries()[name](spark, f"{tmp_path}/{k}").toPandas()
        if name == "mean_shift":
            assert len(found) == 60
            found["row_id"] -= k
        got.append(found.sort_values(list(found.columns)[:2]).reset_index(drop=True).round(4))
    assert len(got[0]) and got[0].equals(got[1])
