"""Nearest dated snapshot, in either direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def int_day(col) -> Column:
    """Day number of a ``yyyymmdd`` integer; null if it is no date."""
    return F.unix_date(F.try_to_date((F.col(col) if isinstance(col, str) else col).cast("string"), "yyyyMMdd"))


def nearest_snapshot(days: DataFrame, snapshots: DataFrame, day: str = "date", snapshot: str = "snapshot") -> DataFrame:
    """``(day, snapshot)`` with the snapshot nearest to each distinct day; of two equally near the earlier.

    Both sides are reduced to distinct dates first. Days and snapshots are ordered together and each
    day looks back and ahead for a snapshot, so the work is a sort of the dates, whatever their
    number. Null or malformed dates get no snapshot.
    """
    d = days.select(F.col(day).alias("day")).distinct().select("day", int_day("day").alias("n"), F.lit(None).cast("int").alias("snap"))
    s = snapshots.select(F.col(snapshot).alias("snap")).distinct().select(F.lit(None).cast("int").alias("day"), int_day("snap").alias("n"), "snap")
    both = d.unionByName(s).where(F.col("n").isNotNull())
    order = Window.partitionBy(F.lit(0)).orderBy("n", F.col("snap").isNull())  # one row a date: thousands at most
    back = F.last("snap", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("snap", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = both.select("day", "n", back.alias("back"), ahead.alias("ahead")).where(F.col("day").isNotNull())
    near = F.when(F.col("ahead").isNull() | (F.col("n") - int_day("back") <= int_day("ahead") - F.col("n")), F.col("back")).otherwise(F.col("ahead"))
    return placed.select(F.col("day").alias(day), near.alias(snapshot)).where(F.col(snapshot).isNotNull())


def substitute_days(days: DataFrame, gaps: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    """Add ``use_date``: the day whose file stands in for a missing one.

    ``gaps`` has ``keys`` and dates ``gap_from, gap_to``: days from ``gap_from`` up to but without
    ``gap_to`` use the file of ``gap_to``; other days use their own. Gaps are spelled out by day, so
    the lookup is an equi-join; of overlapping gaps the nearest end counts.
    """
    each = gaps.where(F.col("gap_to") > F.col("gap_from")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.sequence("gap_from", F.date_sub("gap_to", 1))).alias("_day"), "gap_to"
    )
    one = each.groupBy(*[f"_{k}" for k in keys], "_day").agg(F.min("gap_to").alias("_to"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(day) == F.col("_day")]
    return days.join(one, on, "left").select(*days.columns, F.coalesce("_to", F.col(day)).alias("use_date"))
