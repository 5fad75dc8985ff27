"""Voronoi cells by tiles against cells cut by all points, and the clusters of dense cells."""

import math
from collections import defaultdict

import numpy as np
import pytest

from spotlake.operators import voronoi as V


def plain_cells(p, far=1e6):
    """place -> (area or None if open, touching places)."""
    out = {}
    for i, (x, y) in enumerate(p):
        polygon = V.square(far)
        for j in sorted(range(len(p)), key=lambda j: math.hypot(*(p[j] - p[i]))):
            if j != i:
                dx, dy = p[j] - p[i]
                polygon = V.clipped(polygon, dx, dy, (dx * dx + dy * dy) / 2, j)
        touch = {k for (a, b, k), (c, d, _) in zip(polygon, [*polygon[1:], polygon[0]]) if k >= 0 and math.hypot(c - a, d - b) > 1e-6}
        out[i] = (None if any(k < 0 for _, _, k in polygon) else V.area(polygon), touch)
    return out


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(6)
    return np.round(np.concatenate([rng.uniform(0, 2000, (160, 2)), rng.normal(600, 25, (60, 2)), rng.normal((1500, 1400), 40, (50, 2))]), 3)


def frame(spark, p, more=()):
    rows = [(int(i), float(x), float(y), "t") for i, (x, y) in enumerate(p)]
    return spark.createDataFrame([*rows, *more], "row_id long, x_nm double, y_nm double, tx string").repartition(3)


@pytest.mark.parametrize("tile", [5000, 12])
def test_cells_of_one_tile_and_of_many(spark, places, tile):
    df = frame(spark, places, [(900, *map(float, places[7]), "t"), (901, float("nan"), 1.0, "t")])
    want = plain_cells(places)
    least = 1e-6
    cells, sides = V.voronoi_cells(df, least, tile=tile)
    got = {r["row"]: r for r in cells.collect()}
    assert set(got) == set(want) and got[7]["n"] == 2
    touch = defaultdict(set)
    for r in sides.collect():
        touch[r["a"]].add(r["b"])
    for i, (a, near) in want.items():
        n = 2 if i == 7 else 1
        if a is None or n / a < least:
            assert got[i]["density"] is None
        else:
            assert got[i]["density"] == pytest.approx(n / a, rel=1e-6) and touch[i] == near
    assert sum(r["density"] is not None for r in got.values()) > 220


def test_clusters(spark, places):
    df = frame(spark, places, [(900, *map(float, places[200]), "t"), (901, float("inf"), 1.0, "t")])
    want = plain_cells(places)
    hull = V.corners(places)
    mean = (len(places) + 1) / V.area([tuple(q) for q in hull])
    dense = {i for i, (a, _) in want.items() if a and (2 if i == 200 else 1) / a > 2 * mean}
    groups, seen = [], set()
    for i in sorted(dense):
        if i not in seen:
            todo, own = [i], {i}
            while todo:
                for k in want[todo.pop()][1] & dense - own:
                    own.add(k)
                    todo.append(k)
            seen |= own
            groups.append(own | ({900} if 200 in own else set()))
    groups = [g for g in groups if len(g) >= 10]
    got = defaultdict(set)
    for r in V.voronoi_clusters(df, 2.0, 10, tile=40).collect():
        got[r["cluster_id"]].add(r["row_id"])
    none = got.pop(-1)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups)) and len(groups) >= 2 and 901 in none
    assert len(got[1]) >= len(got[2])


def test_odd_tables(spark):
    none = spark.createDataFrame([], "row_id long, x_nm double, y_nm double")
    assert V.voronoi_clusters(none).count() == 0 and V.voronoi_density(none, 1e-6).count() == 0
    line = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(30)], none.schema)
    assert {r["cluster_id"] for r in V.voronoi_clusters(line).collect()} == {-1}
    grid = spark.createDataFrame([(10 * i + j, 10.0 * i, 10.0 * j) for i in range(10) for j in range(10)], none.schema)
    got = {r["row_id"]: r["density"] for r in V.voronoi_density(grid, 1e-3, tile=15).collect()}
    assert all(got[10 * i + j] == pytest.approx(0.01) for i in range(1, 9) for j in range(1, 9)) and got[0] is None and len(got) == 100
