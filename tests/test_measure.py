"""Event parts, ids numbered by ranges, borders of linking, and searches of odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import aggregate as A
from spotlake.operators import graph as G
from spotlake.operators import joins as J
from spotlake.operators import measure as M
from spotlake.operators import storage, tables
from spotlake.operators import traces as T


def test_numbers_along_an_order(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(7)
    got = {r["id"]: r["n"] for r in storage.numbered(df, "n", "v", "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(500), key=lambda i: (i * 37 % 101, i)))}
    assert storage.numbered(df.limit(0), "n", "v").count() == 0
    parts = [r["chunk"] for r in tables.chunks(df.withColumnRenamed("id", "row_id"), 3).orderBy("row_id").collect()]
    assert [parts.count(k) for k in range(3)] == [167, 167, 166] and parts == sorted(parts)


def test_curves_without_keys(spark):
    rng = np.random.default_rng(0)
    knots = [(float(t), float(v)) for t, v in zip(sorted(rng.choice(1000, 30, False)), rng.random(30), strict=True)]
    rows = [(i, float(t)) for i, t in enumerate(rng.random(300) * 1200 - 100)]
    k = spark.createDataFrame(knots, "t double, v double")
    got = J.interpolated(spark.createDataFrame(rows, "row_id long, t double").repartition(5), k, "t", ["v"]).collect()
    want = np.interp([t for _, t in rows], *zip(*knots, strict=True))
    assert len(got) == 300 and all(r["at_v"] == pytest.approx(want[r["row_id"]]) for r in got)


def test_neighbours_of_odd_tables(spark):
    nan = math.nan
    df = spark.createDataFrame([(0, 0.0, 0.0, 1), (1, 3.0, 4.0, 1), (2, nan, 0.0, 1), (3, 900.0, 0.0, 2)], "row_id long, x_nm double, y_nm double, label int")
    got = {(r["row_id"], r["rank"]): r["d"] for r in J.nearest_neighbours(df, df, 2, 1.0, same=True).collect()}
    assert got[0, 1] == 5.0 and got[0, 2] == 900.0 and (2, 1) not in got
    got = {(r["row_id"], r["rank"]): r["d"] for r in J.nearest_neighbours(df, df, 1, 1.0, same=True, keys=("label",)).collect()}
    assert got == {(0, 1): 5.0, (1, 1): 5.0, (3, 1): math.inf}


@pytest.mark.parametrize("x, y, groups", [((0, 9), (0, 9), 1), ((0, 11), (0, 0), 2), ((10, 0), (0, 0), 1), ((0, 10), (0, 0), 2), ((0, 0), (0, 10), 2)])
def test_borders_of_the_linking_box(x, y, groups):
    got = G.walk_links(np.array([0, 1]), np.array(x, float), np.array(y, float), 10.0, 1)
    assert len(set(got.tolist())) == groups


def test_event_cores(spark):
    rows = [(i, 0.0, 0.0, f) for i, f in enumerate(range(5))] + [(10, 500.0, 0.0, 2), (11, 500.0, 0.0, 3)]
    df = spark.createDataFrame(rows, "row_id long, x_nm double, y_nm double, frame long")
    assert sorted(r["row_id"] for r in M.event_cores(df, 10.0, 1, 3).collect()) == [1, 2, 3]


def test_rules_of_pairs_and_ids(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 9.0, 1), (1, 3.0, 4.0, 9.0, 2)], "g int, x_err_nm double, y_err_nm double, xy_err_nm double, state_true int")
    r = A.combine(df, ["g"]).first()
    assert r["xy_err_nm"] == pytest.approx(math.sqrt((1 / (1 + 1 / 9) + 1 / (1 / 4 + 1 / 16)) / 2)) and r["state_true"] == 1


def test_halves_and_columns(spark):
    df = spark.range(100).withColumnRenamed("id", "frame")
    n = M.time_halves(df, 10, seed=3).groupBy("half").count().collect()
    assert sum(r["count"] for r in n) == 100 and all(r["count"] % 10 == 0 for r in n)
    assert M.first_present(df, ["track_id", "frame"]) == "frame"
    with pytest.raises(ValueError):
        M.first_present(df, ["track_id"])


def test_spread_selection_goes_on_until_nothing_changes(spark):
    rng = np.random.default_rng(1)
    rows = [(b, float(v)) for b in range(20) for v in rng.normal(0, 1 if b < 17 else 5 * (b - 15), 50)]
    got = {r["bead"]: r["kept"] for r in M.spread_selection(spark.createDataFrame(rows, "bead long, v double"), "bead", "v").collect()}
    assert all(got[b] for b in range(17)) and not any(got[b] for b in range(17, 20))


def test_spreads_of_traces(spark):
    rows = [(1, i, float(t), float(v)) for i, (t, v) in enumerate([(0, 1.0), (1, 3.0), (2, 2.0), (3, float("nan")), (4, 8.0)])] + [(2, 9, 0.0, 5.0), (3, 10, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t double, value double")
    got = {r["user_id"]: r for r in T.robust_spreads(df, "user_id", "t", "value", "event_id").collect()}
    q = 0.6744897501960817
    assert set(got) == {1, 2} and got[1]["n"] == 4 and got[1]["median"] == 2.5
    assert got[1]["mad"] == pytest.approx(1.0 / q) and got[1]["steps"] == pytest.approx(2.0 / (q * 2**0.5))
    assert got[1]["quartiles"] == pytest.approx((4.25 - 1.75) / (2 * q))
    assert got[2]["mad"] == 0 and math.isnan(got[2]["steps"])
    assert T.robust_spreads(df.limit(0), "user_id", "t", "value", "event_id").count() == 0


def test_summary_of_tracks(spark):
    straight = [(1, f, f, 3.0 * f, 4.0 * f) for f in range(6)]
    still = [(2, 10 + f, f, 1.0, 1.0) for f in range(3)]
    df = spark.createDataFrame([*straight, *still, (3, 20, 0, 0.0, 0.0), (-1, 21, 0, 0.0, 0.0)], "track_id long, row_id long, frame long, x_nm double, y_nm double")
    got = {r["track_id"]: r for r in T.track_summary(df, 4, 0.1).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["n"], got[1]["path_nm"], got[1]["net_nm"], got[1]["straightness"], got[1]["lags"]) == (6, 25.0, 25.0, 1.0, 4)
    assert got[1]["alpha"] == pytest.approx(2.0)  # a steady run: squared displacement grows with the square of time
    assert got[2]["d_um2_s"] == 0 and math.isnan(got[2]["alpha"]) and math.isnan(got[2]["straightness"])
    assert got[3]["lags"] == 0 and got[3]["path_nm"] == 0 and math.isnan(got[3]["d_um2_s"])


def test_clusters_of_queries_are_not_trivial(spark, sf):
    from spotlake.plans import catalog

    for name in ("dbscan", "frame_analysis"):
        ids = {r["cluster_id"] for r in catalog.queries()[name](spark, sf).select("cluster_id").distinct().collect()}
        assert 1 in ids, name


def test_laws_of_dwell_times(spark):
    x = np.random.default_rng(2).gamma(2.5, 3.0, 4000)
    df = spark.createDataFrame([(float(v),) for v in [*x, -1.0, float("nan")]], "dwell double")
    d = T.dwell_models(df, "dwell")

    def likelihood(k):  # at the best scale for this shape
        return float(((k - 1) * np.log(x) - x * k / x.mean()).sum()) - len(x) * (k * math.log(x.mean() / k) + math.lgamma(k))

    assert d["n"] == 4000 and d["gamma_shape"] == pytest.approx(2.5, rel=0.1)
    assert d["gamma_ll"] == pytest.approx(likelihood(d["gamma_shape"]))
    assert all(d["gamma_ll"] > likelihood(d["gamma_shape"] * f) for f in (0.98, 1.02)) and d["gamma_aic"] < d["exponential_aic"]
    assert T.dwell_models(df.limit(0), "dwell") == {}
    assert T.dwell_models(spark.createDataFrame([(2.0,)] * 6, "dwell double"), "dwell")["gamma_shape"] == math.inf
