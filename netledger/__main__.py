"""python -m netledger QUERY DATA OUT [--ip-version 4|6] [--start YYYYMMDD] [--end YYYYMMDD] [--format csv|parquet]

Runs one query over a folder of Parquet tables and writes its result: a delimited report with a header, or Parquet
partitioned by day where there is one. ``--ip-version`` keeps one family, ``--start`` and ``--end`` the days after
the one up to the other, where the result has these columns. ``--list`` names the queries.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.sources.landing import write_days, write_report


def catalogue() -> dict:
    from netledger.plans import catalogue as domain
    from netledger.plans import pipeline_queries

    return domain.QUERIES | pipeline_queries.QUERIES


def narrowed(df: DataFrame, family: int | None, start: int | None, end: int | None) -> DataFrame:
    """Rows of one family and of the days after ``start`` up to ``end``."""
    if family is not None and "family" in df.columns:
        df = df.where(F.col("family") == family)
    if "date" in df.columns:
        if start is not None:
            df = df.where(F.col("date") > start)
        if end is not None:
            df = df.where(F.col("date") <= end)
    return df


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="netledger", description=__doc__)
    p.add_argument("query", nargs="?")
    p.add_argument("data", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("--ip-version", type=int, choices=(4, 6))
    p.add_argument("--start", type=int)
    p.add_argument("--end", type=int)
    p.add_argument("--format", choices=("csv", "parquet"), default="csv")
    p.add_argument("--list", action="store_true")
    a = p.parse_args(argv)
    queries = catalogue()
    if a.list:
        print("\n".join(sorted(queries)))
        return 0
    if a.query not in queries or not a.data or not a.out:
        p.print_usage(sys.stderr)
        return 2
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = narrowed(queries[a.query](spark, a.data.rstrip("/")), a.ip_version, a.start, a.end)
    if a.format == "parquet":
        if "date" in df.columns:
            write_days(df, a.out)
        else:
            df.write.mode("overwrite").parquet(a.out)
    else:
        write_report(df, a.out, [c for c in ("date", "family", "source", "rir") if c in df.columns] or df.columns[:1])
    return 0


if __name__ == "__main__":
    sys.exit(main())
