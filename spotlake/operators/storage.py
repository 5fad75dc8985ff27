"""Tables written between steps, and numbers along a global order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the shared folder of spark.checkpoint.dir; a temporary one if unset, on one machine only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df``, written, with __part: ranges of the order, of which equal keys never share two."""
    return cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def numbered(df: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """``df`` with consecutive numbers from 0 along ``order``: within ranges, from offsets of one row a range."""
    dealt = ranges(df, *order)
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    offsets, total = {}, 0
    for part, n in counts:
        offsets[part], total = total, total + n
    if not offsets:
        return dealt.drop("__part").withColumn(out, F.lit(None).cast("long"))
    base = F.element_at(F.array(*[F.lit(offsets.get(i, 0)).cast("long") for i in range(max(offsets) + 1)]), F.col("__part") + 1)
    turn = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(out, (base + turn - 1).cast("long")).drop("__part")


def carried(df: DataFrame, value: str, time: str, tie: str) -> DataFrame:
    """``df`` with __before and __after: the last ``value`` at or before each row's time, and the first at or after.

    The rows go to ranges of time; what a range ends and begins with is carried over a table of one row a range.
    """
    dealt = ranges(df, F.col(time))
    up = Window.partitionBy("__part").orderBy(F.col(time), F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__part").orderBy(F.desc(time), F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col(value).isNotNull(), F.struct(F.col(time), F.col(tie)))
    ends = dealt.groupBy("__part").agg(F.max_by(value, some).alias("__last"), F.min_by(value, some).alias("__first"))
    along = Window.orderBy("__part")  # one row a range
    ends = ends.select(
        "__part",
        F.last("__last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__early"),
        F.first("__first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__late"),
    )
    both = dealt.withColumns({"__b": F.last(value, True).over(up), "__a": F.last(value, True).over(down)}).join(ends, "__part")
    return both.withColumns({"__before": F.coalesce("__b", "__early"), "__after": F.coalesce("__a", "__late")}).drop("__b", "__a", "__early", "__late", "__part")
