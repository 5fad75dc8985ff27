"""Growing inputs: file streams, live recipes, windowed rates, sessions and linking across batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Recipes
from ..operators.filters import Filters


class LiveTableError(RuntimeError):
    """A change that a table can't take while it grows."""


def follow(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    """A folder that a writer adds finished files to, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def check_live(df: DataFrame, operation: str) -> None:
    if df.isStreaming and operation not in ("filter", "recipe", "select", "window", "session"):
        raise LiveTableError(f"{operation} isn't possible while the table grows; stop the stream first")


def live_view(df: DataFrame, filters: Filters | None = None, recipes: Recipes | None = None) -> DataFrame:
    """Filters and row-wise recipes on a stream: each batch is seen once, rows by themselves."""
    check_live(df, "filter")
    df = recipes.apply(df) if recipes else df
    return df.where(filters.mask()) if filters else df


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = None, by: tuple[str, ...] = ()):
    """Appends a stream to a parquet table, exactly once; without ``every`` until the input is used up."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.partitionBy(*by) if by else w
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def windowed_rate(df: DataFrame, time: str, window: str, late: str, keys: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """(window start, keys, n): rows by event time, late ones up to ``late``."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, start, end, n): bursts of rows with gaps below ``gap``."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    s = rows.groupBy(*keys, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def recompute(df: DataFrame, path: str, target: str, checkpoint: str, whole):
    """Appends each batch, then makes a result over the whole table anew (for recipes that need all rows)."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        whole(spark.read.schema(df.schema).parquet(*[f"{path}/batch={i}" for i in range(number + 1)])).write.mode("overwrite").parquet(target)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completed(df: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """The whole result of a stream's aggregate once its input is used up, kept at ``target`` and replaced with every batch."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    done: list[int] = []
    query = df.writeStream.foreachBatch(one).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(f"{target}/batch={max(done)}")


def snapshot(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """The table as it was after batch ``upto``: later batches are in other files."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={i}" for i in range(upto + 1)])


def link_online(df: DataFrame, key: str, gap: float, time: str = "t", value: str = "value") -> DataFrame:
    """(key, start, end, n, mean): runs of rows with gaps up to ``gap``, given out when a later row closes them.

    The state of a key is one open run; rows of a batch are taken in time order.
    """
    schema = f"{key} long, start double, end double, n long, mean double"

    def run(k, batches, state):
        start, end, n, total = state.get if state.exists else (None, None, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, v in zip(rows[time], rows[value], strict=True):
            if n and t - end > gap:
                out.append((k[0], start, end, n, total / n))
                n, total = 0, 0.0
            start = t if not n else start
            end, n, total = float(t), n + 1, total + float(v)
        state.update((float(start), float(end), int(n), float(total)))
        yield pd.DataFrame(out, columns=[key, "start", "end", "n", "mean"])

    return df.groupBy(key).applyInPandasWithState(run, schema, "start double, end double, n long, total double", "append", "NoTimeout")
