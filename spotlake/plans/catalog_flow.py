"""Queries of sources, streams and declarative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Recipe, Recipes
from ..operators.filters import Filters
from ..operators.graph import cut
from ..sources import discovery, formats
from ..streaming import live
from .catalog import EV, events, lines, query, r6
from .registry import Chain, History, Step


def scratch(df: DataFrame) -> str:
    """A new folder in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        cut(df.limit(0))
    return f"{sc.getCheckpointDir()}/flow-{uuid.uuid4().hex}"


@query("chain", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * (1 - l_discount) AS FLOAT) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND CAST(l_extendedprice * (1 - l_discount) AS FLOAT) >= 20000")
def _(spark, sf):
    steps = [
        Step("Filter/Range", {"column": "l_quantity", "lo": 10, "hi": 30}),
        Step("Columns/Expression", {"name": "net", "text": "l_extendedprice * (1 - l_discount)"}),
        Step("Filter/Range", {"column": "net", "lo": 20000}),
    ]
    return Chain.parse(Chain(steps).dump()).run(lines(spark, sf), History()).select("l_orderkey", "l_linenumber", "net")


@query("csv_round_trip", "SELECT l_orderkey AS frame, l_extendedprice * 1000 AS x_nm, l_quantity AS photons FROM lineitem")
def _(spark, sf):
    path = scratch(lines(spark, sf)) + ".csv"
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("frame"), F.col("l_extendedprice").alias("x [um]"), F.col("l_quantity").alias("intensity"))
    formats.write_csv(rows, path, first_frame=1)
    return formats.load(spark, path, first_frame=1)


@query("pixel_scaling", "SELECT l_orderkey, l_extendedprice * 130 AS x_nm FROM lineitem")
def _(spark, sf):
    return formats.with_nm(lines(spark, sf).select("l_orderkey", F.col("l_extendedprice").alias("x_pix")), 130.0).select("l_orderkey", "x_nm")


@query("parquet_append", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    path = scratch(o) + ".parquet"
    formats.write_parquet(o.where("o_orderkey % 2 = 0"), path, meta={"pixelsize_nm": 100})
    formats.write_parquet(o.where("o_orderkey % 2 = 1"), path, "append")
    return formats.load(spark, path)


@query("json_traces", "SELECT user_id AS tid, value * 1e9 AS x_nm FROM events WHERE event_id % 3 = 0")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    zero = F.lit(0.0)
    nested = e.select(F.col("user_id").alias("tid"), (F.col("event_id") % 3 == 0).alias("vld"), F.array(F.struct(F.array(zero, zero, zero).alias("loc"), F.lit(1).alias("k")), F.struct(F.array("value", zero, zero).alias("loc"), F.lit(2).alias("k"))).alias("itr"))
    path = scratch(e) + ".json"
    nested.write.json(path)
    return formats.read_json_traces(spark, path).select("tid", "x_nm")


@query(
    "flat_traces",
    "SELECT event_id, user_id AS tid, CAST(event_id % 4 AS BIGINT) AS iteration, value * 1e9 AS x_nm, value / 2 AS dcr, CASE WHEN event_id % 3 <> 1 AND event_id % 4 = 3 THEN 1 ELSE 0 END AS final FROM events",
)
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    zero = F.lit(0.0)
    flat = e.select("event_id", F.col("user_id").alias("tid"), (F.col("event_id") % 3 != 1).alias("vld"), (F.col("event_id") % 4 == 3).alias("fnl"), (F.col("event_id") % 4).alias("itr"), F.array("value", zero, zero).alias("loc"), F.array(F.col("value") / 2, zero).alias("dcr"))
    path = scratch(e) + ".json"
    flat.write.json(path)
    return formats.read_json_traces(spark, path, every=True).select("event_id", "tid", "iteration", "x_nm", "dcr", "final")


@query("file_conditions", "SELECT doc_id, CASE WHEN source = 'src3' THEN 99.0 ELSE CAST(regexp_extract(source, 'src([0-9]+)', 1) AS DOUBLE) END AS number FROM documents WHERE source IS NOT NULL")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").where("source is not null")
    d = d.withColumn("name", F.concat("source", F.lit(".tif")))
    return discovery.file_conditions(d, F.col("name"), r"src(?P<number>\d+)\.", {"src3.": {"number": "99"}}).select("doc_id", "number")


@query("frame_tags", "WITH k AS (SELECT event_id AS frame, unnest(['Laser-Power', 'Stage-Name']) AS tag, unnest([CAST(user_id % 4 AS VARCHAR), 'a']) AS value FROM events) SELECT frame, tag, value FROM k WHERE tag = 'Laser-Power'")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    tags = F.to_json(F.struct(F.struct((F.col("user_id") % 4).cast("string").alias("Power")).alias("Laser"), F.struct(F.lit("a").alias("Name")).alias("Stage")))
    return discovery.frame_tags(e.select(F.col("event_id").alias("frame"), tags.alias("tags")))


@query("text_codes", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS c_mktsegment_code FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer)")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    return discovery.codes(c, "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment_code")


def _stream(spark, sf):
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*" if not path.endswith("/") else path)


@query("live_append", "SELECT event_id, CAST(CAST(value AS DOUBLE) * 2 AS FLOAT) AS twice FROM events WHERE value BETWEEN 10 AND 60")
def _(spark, sf):
    """A stream through a filter and a recipe into a table, then read."""
    r = Recipes()
    r.add(Recipe("twice", "value * 2"))
    s = live.live_view(_stream(spark, sf).select("event_id", "value"), Filters().set("value", 10, 60), r)
    out = scratch(lines(spark, sf))
    live.append_to(s, f"{out}/table", f"{out}/state").awaitTermination(600)
    return spark.read.schema(s.schema).parquet(f"{out}/table").select("event_id", "twice")


@query("live_rate", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    """Counts by hour of a stream, after its last batch."""
    out = scratch(lines(spark, sf))
    e = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rate = live.completed(live.windowed_rate(e, "ts", "1 hour", "1 hour", ("event_type",)), f"{out}/table", f"{out}/state")
    return rate.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("live_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, sf):
    out = scratch(lines(spark, sf))
    e = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.completed(live.sessions(e, "ts", "30 minutes", "1 hour", ("user_id",)), f"{out}/table", f"{out}/state").select("user_id", "n")
