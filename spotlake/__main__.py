"""spark-submit entry: convert, info or chain."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.registry import Chain
from .sources import formats


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spotlake")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("convert", "info", "chain"):
        s = sub.add_parser(name)
        s.add_argument("path")
        if name != "info":
            s.add_argument("out")
        if name == "chain":
            s.add_argument("chain")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    df = formats.load(spark, a.path)
    if a.what == "info":
        df.printSchema()
        print(df.count(), "rows")
    elif a.what == "convert":
        formats.save(df, a.out)
    else:
        Chain.parse(spark.read.text(a.chain, wholetext=True).first()[0]).run(df).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
