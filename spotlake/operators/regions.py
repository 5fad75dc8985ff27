"""Work by region: a step runs once on each region's rows, errors become rows, results are a table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import nansafe as N


def run_regions(rows: DataFrame, member: DataFrame, step: Callable[[pd.DataFrame], dict[str, float]], values: list[str], row: str = "row_id") -> DataFrame:
    """(region_id, values…, n, error): ``step`` on the rows of each region; an exception is that region's error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"region_id": int(pdf["region_id"].iloc[0]), "n": len(pdf), "error": None, **dict.fromkeys(values, float("nan"))}
        try:
            out |= {k: float(v) for k, v in step(pdf.drop(columns="region_id")).items() if k in values}
        except Exception as error:  # noqa: BLE001  a region's failure is part of the result
            out["error"] = f"{type(error).__name__}: {error}"
        return pd.DataFrame([out])[["region_id", *values, "n", "error"]]

    schema = ", ".join(["region_id long", *[f"`{v}` double" for v in values], "n long", "error string"])
    return member.join(rows, row).groupBy("region_id").applyInPandas(run, schema)


def aggregate_regions(rows: DataFrame, member: DataFrame, row: str = "row_id", **values) -> DataFrame:
    """(region_id, values…): aggregates that Spark has itself, without leaving it."""
    return member.join(rows, row).groupBy("region_id").agg(*[v.alias(k) for k, v in values.items()])


def region_maths(table: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Expressions over the (aligned) results of regions, in order; a later one may read an earlier one."""
    for name, text in expressions.items():
        table = E.with_expression(table, name, text, exact=True)
    return table


def signature(step: str, settings: dict, inputs: list[str]) -> str:
    """Digest of a step with its settings and inputs: results with the same one are kept."""
    return hashlib.sha256(json.dumps([step, settings, sorted(inputs)], sort_keys=True, default=str).encode()).hexdigest()


def average_regions(rows: DataFrame, member: DataFrame, regions: DataFrame, row: str = "row_id", frame: str = "frame") -> DataFrame:
    """All regions on top of each other: centred, turned by minus their angle, and frames kept apart."""
    r = rows.agg(F.min(frame).alias("a"), F.max(frame).alias("b")).first()
    span = (r["b"] or 0) - (r["a"] or 0) + 2
    both = member.join(rows, row).join(regions.select("region_id", "cx", "cy", *(["angle"] if "angle" in regions.columns else [])), "region_id")
    angle = F.col("angle") if "angle" in regions.columns else F.lit(0.0)
    u, v = N.double("x_nm") - F.col("cx"), N.double("y_nm") - F.col("cy")
    return both.withColumns({"x_nm": u * F.cos(angle) + v * F.sin(angle), "y_nm": v * F.cos(angle) - u * F.sin(angle), "frame_in_file": F.col(frame), frame: F.col(frame) + F.col("region_id") * span}).drop("cx", "cy", "angle")


def corners(rows: DataFrame, key: str, n: int = 8, inner: float = 40.0, outer: float = 100.0) -> DataFrame:
    """(key, rotation, occupied, n): rotation by the mean of n times the angle; corners with a row between the radii."""
    r, a = F.hypot(N.double("x_nm"), N.double("y_nm")), F.atan2(N.double("y_nm"), N.double("x_nm"))
    ring = rows.where((r >= inner) & (r <= outer)).withColumn("__a", a)
    turn = ring.groupBy(key).agg((F.atan2(F.sum(F.sin(n * F.col("__a"))), F.sum(F.cos(n * F.col("__a")))) / n).alias("rotation"), F.count(F.lit(1)).alias("n"))
    at = F.pmod(F.bround((F.col("__a") - F.col("rotation")) / (2 * 3.141592653589793 / n)).cast("int"), F.lit(n))
    return ring.join(turn, key).groupBy(key, "rotation", "n").agg(F.count_distinct(at).alias("occupied"))


def labelling_efficiency(table: DataFrame, corners_: int = 8, per: int = 4) -> float:
    """Most likely labelling probability from counts of occupied corners (each has ``per`` sites)."""
    import math

    import numpy as np

    h = {int(r["occupied"]): r["count"] for r in table.groupBy("occupied").count().collect()}
    best = (-math.inf, math.nan)
    for p in np.linspace(0.005, 0.995, 199):
        q = 1 - (1 - p) ** per
        seen = 1 - (1 - q) ** corners_
        ll = sum(n * (math.log(math.comb(corners_, k)) + k * math.log(q) + (corners_ - k) * math.log(1 - q) - math.log(seen)) for k, n in h.items() if k)
        best = max(best, (ll, float(p)))
    return best[1]


def export_table(values: DataFrame, path: str, regions: DataFrame | None = None, columns: list[str] | None = None, key: str = "region_id") -> list[str]:
    """Writes a row a region as text and gives the columns: commas for a path that ends in .csv, else tabs; a folder of files, each with a header.

    ``regions`` (key and more, as centres and comments): its columns go after the key. ``columns``: those to write, in this order; unknown ones are
    left out, and it is an error if none is known. Numbers are written in full, NaN and null as empty cells, arrays with spaces between.
    """
    if regions is not None:
        own = [c for c in regions.columns if c not in values.columns]
        values = values.join(regions.select(key, *own), key, "left").select(key, *own, *[c for c in values.columns if c != key])
    names = [c for c in columns or values.columns if c in values.columns]
    if not names:
        raise ValueError("none of the chosen columns is in the table; it has " + ", ".join(values.columns))
    cell = {"array": lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " "), "double": lambda c: F.when(~F.isnan(c), F.col(c)), "float": lambda c: F.when(~F.isnan(c), F.col(c))}
    out = values.select(*[cell.get(values.schema[c].dataType.typeName(), F.col)(c).alias(c) for c in names])
    out.write.mode("overwrite").option("header", True).option("sep", "," if path.lower().endswith(".csv") else "\t").csv(path)
    return names
