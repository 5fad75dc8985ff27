"""Linking of blinks in space and time while rows still come in.

Rows that can influence each other's links form components (chains of rows near in place and frame). A component is settled once
all its frames lie more than dt + 1 before the oldest frame that may still come: then its links are final and equal
to those of the whole table. Every batch joins what was left open before with its new rows, settles what it can, and
writes both parts under its number, so a batch that is tried again after a failure writes the same. What is kept open is the last
frames' components, however long the stream; a component that never ends stays open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nansafe as N
from ..operators.graph import link_heads, near_in_time, with_groups
from ..operators.storage import cut


class OnlineLinker:
    """Links a stream's rows into ``path``; rows are at most ``late`` frames behind the newest one.

    ``path`` holds settled/batch=n (rows with __head, the first row of their group) and open/batch=n (rows that wait). A row that is later than
    that is linked with what is still open.
    """

    def __init__(self, path: str, dx: float = 50.0, dt: int = 1, late: int = 0, keys: tuple[str, ...] = (), xy: tuple[str, str] = ("x_nm", "y_nm"), frame: str = "frame", row: str = "row_id", **how):
        self.path, self.dx, self.dt, self.late, self.keys, self.xy, self.frame, self.row, self.how = path, dx, dt, late, keys, xy, frame, row, how

    def _heads(self, rows: DataFrame) -> DataFrame:
        found = link_heads(rows, self.dx, self.dt, keys=self.keys, xy=self.xy, frame=self.frame, row=self.row, **self.how)
        return rows.join(found, self.row)

    def batch(self, new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        rows = new if number == 0 else new.unionByName(spark.read.schema(new.schema).parquet(f"{self.path}/open/batch={number - 1}"))
        rows = cut(rows)
        newest = rows.agg(F.max(self.frame)).first()[0]
        place = rows.select(self.row, *self.keys, F.col(self.frame).cast("long").alias("__f"), N.double(self.xy[0]).alias("__x"), N.double(self.xy[1]).alias("__y"))
        comps = near_in_time(place, 1.5 * self.dx * 2**0.5, self.dt, self.keys, self.row).select(self.row, "__f", "component")
        ends = comps.groupBy("component").agg(F.max("__f").alias("__last"))
        horizon = (newest if newest is not None else 0) - self.late
        state = cut(comps.join(ends, "component").select(self.row, (F.col("__last") + self.dt + 1 < horizon).alias("__done")))
        both = rows.join(state, self.row)
        self._heads(both.where("__done").drop("__done")).write.mode("overwrite").parquet(f"{self.path}/settled/batch={number}")
        both.where("NOT __done").drop("__done").write.mode("overwrite").parquet(f"{self.path}/open/batch={number}")

    def start(self, df: DataFrame, checkpoint: str, every: str | None = None):
        """Links a stream; without ``every`` until the input is used up."""
        w = df.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()

    def settled(self, spark: SparkSession, schema, upto: int) -> DataFrame:
        """Rows whose groups are final after batch ``upto``, with __head."""
        return spark.read.schema(f"{_ddl(schema)}, __head long").parquet(*[f"{self.path}/settled/batch={i}" for i in range(upto + 1)])

    def grouped(self, spark: SparkSession, schema, upto: int) -> DataFrame:
        """All rows up to batch ``upto`` with group_id and n_in_group, what is open linked as it stands."""
        rest = self._heads(spark.read.schema(schema).parquet(f"{self.path}/open/batch={upto}"))
        rows = cut(self.settled(spark, schema, upto).unionByName(rest))
        return with_groups(rows.drop("__head"), rows.select(self.row, "__head"), self.keys, self.xy[0], self.frame, self.row)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
