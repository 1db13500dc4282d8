"""Daily presence as bitmaps, run lengths and features over windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: windows in days
WINDOWS = (1, 3, 5, 7, 14, 21, 30, 90, 180, 270, 365, 730, 1095, 1460, 1825, 2190, 2555, 2920, 3285, 3650)
SPAN = 365
METRICS = (
    "uptime", "lifespan", "relUptime", "ups", "downs", "minActiveDays", "maxActiveDays", "meanActiveDays", "stdActiveDays",
    "minInactiveDays", "maxInactiveDays", "meanInactiveDays", "stdInactiveDays",
)


def feature_names() -> list[str]:
    """Every metric over ascending windows, then four statistics of each metric: 312 names."""
    return [f"{m}_{w}" for m in METRICS for w in WINDOWS] + [f"{m}_{s}" for m in METRICS for s in ("min", "max", "mean", "std")]


def trimmed_names(windows: int) -> list[str]:
    """Names of the first ``windows`` windows of each metric and of all statistics."""
    kept = {f"{m}_{w}" for m in METRICS for w in WINDOWS[windows:]}
    return [n for n in feature_names() if n not in kept]


def month_bitmaps(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``keys, month, bits, bit_text``: bit i of ``bits`` is day i + 1 of the month; text has day 1 rightmost.

    Partial bitmaps combine before the shuffle. Null days set nothing.
    """
    d = F.col(day)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(d) - 1)
    marked = df.where(d.isNotNull()).groupBy(*keys, F.trunc(d, "MM").alias("month_start")).agg(F.bit_or(bit).alias("bits"))
    text = F.lpad(F.bin("bits"), F.dayofmonth(F.last_day("month_start")), "0")
    return marked.select(*keys, F.date_format("month_start", "yyyyMM").cast("int").alias("month"), "bits", text.alias("bit_text"))


def year_presence(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, month, updays``: of every month that ends within a year of a present day, up to the newest month there is,
    the days back from its end (0 = newest) on which the key was present, in order.

    ``bitmaps`` are those of :func:`month_bitmaps`. Each month's bitmap goes to the twelve months it counts in, so
    twelve bitmaps meet in a row and no window is needed. Months in which nothing is left give no row.
    """
    number = lambda m: F.expr(f"{m} div 100") * 12 + F.col(m) % 100 - 1
    newest = bitmaps.agg(F.max("month")).scalar()
    first = lambda n: F.make_date(F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1))
    each = bitmaps.select(*keys, "bits", number("month").alias("_n"), F.explode(F.sequence(number("month"), number("month") + 11)).alias("_to"), newest.alias("_newest"))
    each = each.where(F.col("_to") <= number("_newest"))
    met = each.groupBy(*keys, "_to").agg(F.collect_list(F.struct("_n", "bits")).alias("_months"))
    days = met.withColumn("_end", F.last_day(first(F.col("_to"))))
    offsets = F.flatten(F.transform("_months", lambda m: F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.getbit(m["bits"], i) == 1), lambda i: F.date_diff(F.col("_end"), first(m["_n"])) - i)))
    out = days.select(*keys, F.date_format("_end", "yyyyMM").cast("int").alias("month"), F.array_sort(F.filter(offsets, lambda d: d < SPAN)).alias("updays"))
    return out.where(F.size("updays") > 0)


def runs(df: DataFrame, key: str, offsets: str) -> DataFrame:
    """``key, start, stop, online`` of each maximal run of present or absent days 0..364 (0 = newest).

    ``offsets`` is an array of present days; rows of one key are united. Offsets outside the year,
    repeats and nulls count for nothing; a key without any offset is one absent run.
    """
    days = df.select(key, F.explode_outer(offsets).alias("d")).where(F.col("d").between(0, SPAN - 1)).distinct()
    order = Window.partitionBy(key).orderBy("d")
    island = days.withColumn("island", F.col("d") - F.row_number().over(order))
    on = island.groupBy(key, "island").agg(F.min("d").alias("start"), F.max("d").alias("stop")).select(key, "start", "stop")
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("start")) == 1
    marked = on.withColumns({"next": F.coalesce(after, F.lit(SPAN)), "first": first})
    off_after = marked.select(key, (F.col("stop") + 1).alias("start"), (F.col("next") - 1).alias("stop"))
    off_before = marked.where("first").select(key, F.lit(0).alias("start"), (F.col("start") - 1).alias("stop"))
    never = df.select(key).distinct().join(on.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("start"), F.lit(SPAN - 1).alias("stop"))
    off = off_after.unionByName(off_before).unionByName(never).where("stop >= start")
    return on.withColumn("online", F.lit(True)).unionByName(off.withColumn("online", F.lit(False)))


def run_metrics(df: DataFrame, key: str, offsets: str) -> DataFrame:
    """``key, wnd`` and the 13 metrics of each window.

    Runs are cut at the window's end. Windows longer than the year see the whole year but leave out
    the run that holds its last day. Standard deviations are of the population.
    """
    r = runs(df, key, offsets).withColumn("wnd", F.explode(F.array(*map(F.lit, WINDOWS))))
    reach = F.least(F.col("wnd"), F.lit(SPAN))
    inside = r.where(F.col("start") < reach).withColumn("length", F.least("stop", reach - 1) - F.col("start") + 1)
    counted = ~((F.col("wnd") > SPAN) & (F.col("stop") == SPAN - 1))
    online, offline = F.col("online"), ~F.col("online")
    pick = lambda side: F.when(side & counted, F.col("length"))
    top = F.max(F.when(online, F.least("stop", reach - 1)))
    agg = inside.groupBy(key, "wnd").agg(
        F.coalesce(F.sum(F.when(online, F.col("length"))), F.lit(0)).alias("n"),
        F.coalesce(top - F.min(F.when(online, F.col("start"))) + 1, F.lit(0)).alias("life"),
        F.count(F.when(online & (F.col("stop") + 1 < reach), 1)).alias("ups"),
        F.count(F.when(online & (F.col("start") >= 1), 1)).alias("downs"),
        *[
            F.coalesce(f(pick(side)), F.lit(0)).cast("double").alias(f"{n}{name}")
            for side, name in ((online, "ActiveDays"), (offline, "InactiveDays"))
            for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
        ],
    )
    n, life, wnd = F.col("n"), F.col("life"), F.col("wnd")
    first = {"uptime": n / wnd, "lifespan": life / wnd, "relUptime": F.coalesce(F.try_divide(n, life), F.lit(0.0))}
    return agg.select(key, "wnd", *[c.cast("double").alias(k) for k, c in first.items()], *[F.col(m).cast("double").alias(m) for m in METRICS[3:]])


def metric_stats(metrics: DataFrame, key: str) -> DataFrame:
    """Minimum, maximum, mean and population deviation of each metric over its windows."""
    fs = (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
    return metrics.groupBy(key).agg(*[f(m).alias(f"{m}_{s}") for m in METRICS for s, f in fs])


def wide_features(metrics: DataFrame, key: str) -> DataFrame:
    """The 312 features in one row a key, in the order of :func:`feature_names`."""
    cells = metrics.groupBy(key).agg(*[F.max(F.when(F.col("wnd") == w, F.col(m))).alias(f"{m}_{w}") for m in METRICS for w in WINDOWS])
    return cells.join(metric_stats(metrics, key), key).select(key, *feature_names())
