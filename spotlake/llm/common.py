"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of text sent to Python at once, and bytes; long texts stay within a worker's memory.
TEXT_BATCH, TEXT_BYTES = 1000, 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that memory follows the batch and not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there.

    The folder is the one in ``spark.checkpoint.dir``; only where none is set and the master is local (tests
    on one machine) a temporary one is used. Executors that are lost later don't lose these rows, and their
    compressed columns take a part of the disk that a checkpoint of rows would.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        set_dir = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not set_dir and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="checkpoint-"))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
