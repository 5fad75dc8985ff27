"""Proportional stratified interleaving of documents into shards.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is
(2 rank - 1) / (2 rows of the source), so every source is spread evenly over 0 to 1. Rows are then ordered
by fractional rank and the order is cut into shards whose row counts differ by one at most; each shard so
has the mixture of the whole.

Neither ranking sorts a source or the table in one task: the hash (and the fractional rank) is uniform, so
it is cut into cells of about ``CELL`` rows each; a row's rank is its rank in its cell plus the rows of the
cells before, and only cell counts are summed up along the order.

Defined results: a null source is a source of its own; ties of the hash go by doc_id (nulls first), then
checksum and size; repeated rows are separate rows; null text has size 16 and a null checksum; an empty
table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a cell, and the most cells (then cells grow instead).
CELL, MOST_CELLS = 2000, 1 << 18


def interleave(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    stratum = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    base = cut(docs.select("doc_id", stratum.alias("s"), size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), u.alias("u")))
    rows = base.count()
    cells = min(MOST_CELLS, max(16, -(-rows // CELL)))
    last = F.lit(cells - 1).cast("long")

    own = base.withColumn("c", F.least(F.floor(F.col("u") / F.lit(float(1 << 52)) * cells), last))
    counts = own.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"))
    by_source = Window.partitionBy("s")
    counts = counts.select("s", "c", (F.sum("n").over(by_source.orderBy("c")) - F.col("n")).alias("before"), F.sum("n").over(by_source).alias("total"))
    in_cell = F.row_number().over(Window.partitionBy("s", "c").orderBy("u", "doc_id", "text_crc32", "size"))
    ranked = own.join(counts, ["s", "c"]).withColumn("rank", F.col("before") + in_cell)
    ranked = cut(ranked.select("doc_id", "size", "text_crc32", "u", ((2 * F.col("rank") - 1) / (2 * F.col("total"))).alias("f")))

    spread = ranked.withColumn("c", F.least(F.floor(F.col("f") * cells), last))
    counts = spread.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("c", (F.sum("n").over(Window.orderBy("c")) - F.col("n")).alias("before"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("c").orderBy("f", "u", "doc_id", "text_crc32", "size")) - 1
    placed = spread.join(counts, "c").withColumn("at", at.cast("long")).withColumn("shard", F.floor(F.col("at") * shards / F.lit(max(rows, 1))))
    # Exact in whole numbers: the quotient above may be off by one at a border.
    first = lambda k: F.expr(f"(({k}) * {rows}L + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", F.when(F.col("at") < first("shard"), F.col("shard") - 1).when(F.col("at") >= first("shard + 1"), F.col("shard") + 1).otherwise(F.col("shard")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - first("shard")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same in DuckDB. crc32 is worked out byte by byte from a table built by its rule.
ORACLE = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t
), base AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 16 AS size, text,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u FROM documents
), crcs AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), tab
), ranked AS (
  SELECT b.doc_id, b.size, c.crc, b.u,
    (2 * row_number() OVER (PARTITION BY b.source ORDER BY b.u, b.doc_id NULLS FIRST, c.crc NULLS FIRST, b.size) - 1)::DOUBLE
      / (2 * count(*) OVER (PARTITION BY b.source))::DOUBLE AS f
  FROM base b LEFT JOIN crcs c ON b.text = c.text
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, u, doc_id NULLS FIRST, crc NULLS FIRST, size) - 1 AS pos, (SELECT count(*) FROM documents) AS n FROM ranked
), cut AS (SELECT *, (pos * 40) // n AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (pos - (shard * n + 39) // 40)::BIGINT AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""
