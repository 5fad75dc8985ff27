"""Operators by path with their settings, and tables of regions as text."""

import numpy as np
import pytest

from spotlake.operators import regions as R
from spotlake.plans.registry import OPERATORS, Chain, Step


def points(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.normal(c, 5, (40, 2)) for c in ((0, 0), (300, 0))] + [rng.uniform(-200, 500, (20, 2))])
    return spark.createDataFrame([(i, i % 7, 5, float(x), float(y)) for i, (x, y) in enumerate(p)], "row_id long, frame long, spare int, x_nm double, y_nm double")


def test_edit(spark):
    df = points(spark)
    chain = Chain([Step("Columns/Edit", {"operation": "rename", "column": "spare", "new_name": "other "})])
    assert Chain.parse(chain.dump()).run(df).columns == ["row_id", "frame", "other", "x_nm", "y_nm"]
    assert "spare" not in OPERATORS["Columns/Edit"](df, {"operation": "remove", "remove": ["spare"]}).columns
    for bad in ({"operation": "rename"}, {"operation": "remove"}, {"operation": "turn"}, {"operation": "rename", "column": "frame", "new_name": "f"}):
        with pytest.raises(ValueError):
            OPERATORS["Columns/Edit"](df, bad)


def test_voronoi_and_drift_by_path(spark):
    df = points(spark)
    got = OPERATORS["Clusters/Voronoi"](df, {"least": 15}).groupBy("cluster_id").count().collect()
    assert {r["cluster_id"] for r in got} == {-1, 1, 2}
    out = OPERATORS["Drift/Overlap"](df, {"width": 4, "most": 30.0, "target": 8.0})
    assert out.columns == df.columns and out.count() == df.count()


def test_export(spark, tmp_path):
    values = spark.createDataFrame([(1, 0.1 + 0.2, [1.0, 2.5], "a,b"), (2, float("nan"), None, None)], "region_id long, size double, parts array<double>, name string")
    regions = spark.createDataFrame([(1, 10.0, 20.0), (3, 0.0, 0.0)], "region_id long, x_nm double, y_nm double")
    path = str(tmp_path / "table.csv")
    assert R.export_table(values, path, regions) == ["region_id", "x_nm", "y_nm", "size", "parts", "name"]
    got = {r["region_id"]: r for r in spark.read.option("header", True).csv(path).collect()}
    assert float(got["1"]["size"]) == 0.1 + 0.2 and got["1"]["parts"] == "1.0 2.5" and got["1"]["name"] == "a,b" and got["1"]["x_nm"] == "10.0"
    assert got["2"]["size"] is None and got["2"]["x_nm"] is None
    tabs = str(tmp_path / "table.txt")
    assert R.export_table(values, tabs, columns=["size", "none"]) == ["size"]
    assert spark.read.option("header", True).option("sep", "\t").csv(tabs).columns == ["size"]
    with pytest.raises(ValueError):
        R.export_table(values, path, columns=["none"])
