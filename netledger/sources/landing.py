"""Landed files: names to dates and sources, delimited tables, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def file_name() -> Column:
    """Name of the file a row comes from; that of its folder, where a landing folder holds ``file=NAME``."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, "/file=([^/]+)/", 1), F.lit("")), F.element_at(F.split(path, "/"), -1))


def file_day(name: Column | None = None) -> Column:
    """``yyyymmdd`` in a file name like ``20230301_radb.db.gz`` or ``vrps-2023-04-01.csv``; null if none."""
    digits = F.regexp_extract(file_name() if name is None else name, r"(\d{4})-?(\d{2})-?(\d{2})", 0)
    return F.regexp_replace(digits, "-", "").try_cast("int")


def file_source(name: Column | None = None) -> Column:
    """Registry in a file name like ``20230301_radb.db.gz``: ``RADB``."""
    return F.upper(F.regexp_extract(file_name() if name is None else name, r"^(?:\d{8}[_.-])?([A-Za-z0-9-]+?)(?:\.db)?(?:\.(?:gz|bz2|txt|tsv|csv))*$", 1))


def read_delimited(spark: SparkSession, paths: str | Sequence[str], schema: str, sep: str = "\t", glob: str | None = None) -> DataFrame:
    """Rows of a declared schema; the text ``None`` is null, codecs go by extension, fields that don't parse are null."""
    r = spark.read.schema(schema).option("sep", sep).option("nullValue", "None").option("mode", "PERMISSIVE").option("comment", "#").option("quote", "")
    return (r.option("pathGlobFilter", glob) if glob else r).csv(paths)


# fixed values: schemas of the tables that earlier jobs hand over
PREDICTIONS = "idx long, date int, rir string, prefix_addr string, prefix_len int, origin long, isp string, sum_rel string, validation string, source string, record_type string, is_test int, score0 double, score1 double"
TRANSFERS = "date int, prefix_addr string, prefix_len int, from_rir string, from_isp string, to_rir string, to_isp string, transfer_type string"
VALIDATED_IRR = "date int, rir string, prefix string, origin long, isp string, country string, source string, changed string, validation string"


def row_text(columns: Sequence[str], schema: StructType, sep: str = "\t") -> Column:
    """A row as delimited text: lists in brackets, missing values and elements as ``None``."""
    none = F.lit("None")

    def text(c: str) -> Column:
        if isinstance(schema[c].dataType, ArrayType):
            inner = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), none)), ",")
            return F.when(F.col(c).isNull(), none).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
        return F.coalesce(F.col(c).cast("string"), none)

    return F.concat_ws(sep, *map(text, columns))


def write_days(df: DataFrame, path: str, day: str = "date", mode: str = "overwrite") -> None:
    """Parquet partitioned by day; overwriting replaces the days at hand and no others."""
    # one writer per day and bucket, so that a large day doesn't end in one file
    df.repartition(F.col(day), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str], sep: str = ",") -> None:
    """A small ordered report as one delimited file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "None").csv(path)
