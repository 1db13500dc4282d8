"""Route objects from registry dumps in RPSL, within the JVM.

A dump is read as records parted by blank lines. Continuation lines are glued to their attribute
first, so an object is then a list of lines that each hold a key and a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netledger.sources.landing import file_day, file_name, file_source

_GLUE = "\u0001"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``date, source, value``: one row an object; day and registry come from the file name."""
    raw = spark.read.option("lineSep", "\n\n").text(path)
    return raw.select(file_day(file_name()).alias("date"), file_source(file_name()).alias("source"), "value")


def attributes(value) -> Column:
    """Array of ``(k, v)`` in order. Continuations (blank, tab or plus first) join their value by a line
    break, comment lines and lines without a colon go."""
    c = F.col(value) if isinstance(value, str) else value
    bare = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(c, "\r", "")), "\n[ \t]*[#%][^\n]*", "")
    glued = F.regexp_replace(bare, "\n[ \t+][ \t]*", _GLUE)
    lines = F.filter(F.split(glued, "\n"), lambda x: F.instr(x, ":") > 1)
    return F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"),
            F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), _GLUE, "\n").alias("v"),
        ),
    )


def all_values(attrs: str, key: str) -> Column:
    return F.transform(F.filter(attrs, lambda x: x["k"] == key), lambda x: x["v"])


def first_value(attrs: str, key: str) -> Column:
    return F.get(all_values(attrs, key), F.lit(0))


def route_objects(objects: DataFrame, value: str = "value") -> DataFrame:
    """``prefix_addr, prefix_len, origin, changed`` and the other columns of ``objects``.

    Objects without a route or an origin go. ``changed`` is the latest date of the changed lines, else
    the day last modified, else the day created. A remark behind the prefix length or the origin is
    ignored; repeated objects stay.
    """
    a = objects.withColumn("_attrs", attributes(value))
    route = F.coalesce(first_value("_attrs", "route"), first_value("_attrs", "route6"))
    prefix = F.trim(F.split_part(F.regexp_replace(route, "[\n+ ]", ""), F.lit("#"), F.lit(1)))
    origin = F.regexp_extract(F.upper(first_value("_attrs", "origin")), r"AS\s*(\d+)", 1).try_cast("long")
    dates = F.filter(F.transform(all_values("_attrs", "changed"), lambda c: F.get(F.split(c, " +"), F.lit(1))), lambda x: x.isNotNull())
    day = lambda k: F.regexp_replace(F.split_part(first_value("_attrs", k), F.lit("T"), F.lit(1)), "-", "")
    changed = F.coalesce(F.array_max(dates), day("last-modified"), day("created")).try_cast("int")
    rows = a.select(*[c for c in objects.columns if c != value], F.split_part(prefix, F.lit("/"), F.lit(1)).alias("prefix_addr"), F.split_part(prefix, F.lit("/"), F.lit(2)).try_cast("int").alias("prefix_len"), origin.alias("origin"), changed.alias("changed"))
    return rows.where(F.col("prefix_addr").isNotNull() & F.col("prefix_len").isNotNull() & F.col("origin").isNotNull())
