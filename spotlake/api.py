"""Short entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregate, graph
from .plans.registry import Chain
from .sources import formats


def open_table(spark: SparkSession, path: str, pixelsize_nm: float | None = None) -> DataFrame:
    return formats.load(spark, path, pixelsize_nm)


def group(df: DataFrame, dx: float = 50.0, dt: int = 1) -> DataFrame:
    return aggregate.combine(graph.link_blinks(df, dx, dt).drop("n_in_group"), ["group_id"])


def run_chain(df: DataFrame, text: str) -> DataFrame:
    return Chain.parse(text).run(df)
