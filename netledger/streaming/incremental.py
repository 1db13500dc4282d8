"""Incremental runs: which days are due, and a stream over landed announcements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def due_days(inputs: list[DataFrame], done: DataFrame, day: str = "date") -> DataFrame:
    """Days after the last one done and up to the least of the inputs' last days, that every input has."""
    last = None
    both = None
    for df in inputs:
        d = df.select(F.col(day).alias("day")).distinct()
        top = d.agg(F.max("day").alias("top"))
        last = top if last is None else last.unionByName(top)
        both = d if both is None else both.join(d, "day", "left_semi")
    bounds = both.select("day", last.agg(F.min("top")).scalar().alias("top"), done.agg(F.max(day)).scalar().alias("start"))
    return bounds.where((F.col("day") <= F.col("top")) & (F.col("start").isNull() | (F.col("day") > F.col("start")))).select(F.col("day").alias(day))


def due_months(available: DataFrame, done: DataFrame, day: str = "date", month: str = "month") -> DataFrame:
    """Whole months of the available ``yyyymmdd`` days, but the last, that are not done."""
    have = available.select(F.expr(f"{day} div 100").cast("int").alias(month)).distinct()
    last = have.agg(F.max(month)).scalar()
    return have.where(F.col(month) < last).join(done.select(month).distinct(), month, "left_anti")


def target_days(inputs: list[DataFrame], day: str = "date") -> DataFrame:
    """Days that any of the inputs asks for."""
    every = inputs[0].select(day)
    for df in inputs[1:]:
        every = every.unionByName(df.select(day))
    return every.where(F.col(day).isNotNull()).distinct()


def day_batches(days: DataFrame, size: int, day: str = "date") -> DataFrame:
    """Distinct days in order with the ``batch`` of ``size`` days each falls in; for jobs that take several at once."""
    order = Window.orderBy(day)  # one row a day: thousands at most
    return days.select(day).distinct().withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def missing_days(available: DataFrame, done: DataFrame, day: str = "date") -> DataFrame:
    """Days available and not done, whatever their order."""
    return available.select(day).distinct().join(done.select(day).distinct(), day, "left_anti")


def complete_days(updates: DataFrame, ts: str = "ts") -> DataFrame:
    """Days whose last hour has arrived."""
    per = updates.groupBy(F.to_date(ts).alias("date")).agg(F.max(F.hour(ts)).alias("last_hour"))
    return per.where("last_hour = 23").select("date")


def daily_counts(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str = "7 days") -> DataFrame:
    """Events by tumbling day and ``keys``; on a stream, days close once the watermark has passed them."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events.withColumn(ts, F.col(ts).cast("timestamp"))
    return t.groupBy(F.window(ts, "1 day").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *keys, "n")


def run_available(spark: SparkSession, source: str, schema, checkpoint: str, step: Callable[[DataFrame, int], None], pattern: str = "*.parquet") -> StreamingQuery:
    """Process what has landed since the last run, then stop; ``step`` gets each batch once it is planned.

    The checkpoint folder holds which files are done, so a run that fails is repeated from its batch.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
