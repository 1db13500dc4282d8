from pyspark.sql import functions as F

from netledger.plans import learning
from netledger.streaming import incremental
from tests.conftest import DATA


def days(spark, *d):
    return spark.createDataFrame([(x,) for x in d], "date int")


def test_days_due(spark):
    due = incremental.due_days([days(spark, 1, 2, 3, 4), days(spark, 2, 3, 5, 4), days(spark, 1, 2, 3)], days(spark, 1, 2))
    assert [r.date for r in due.collect()] == [3]
    assert sorted(r.date for r in incremental.due_days([days(spark, 1, 2)], days(spark)).collect()) == [1, 2]
    assert sorted(r.date for r in incremental.missing_days(days(spark, 1, 2, 3), days(spark, 2)).collect()) == [1, 3]


def test_complete_days(spark):
    df = spark.createDataFrame([("2023-01-01 23:10:00",), ("2023-01-02 22:59:59",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert [str(r.date) for r in incremental.complete_days(df).collect()] == ["2023-01-01"]


def test_stream_of_what_is_available_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []

    def step(df, batch):
        got.extend(tuple(r) for r in incremental.daily_counts(df).collect())

    for _ in range(2):  # the second run finds nothing new
        incremental.run_available(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "ck"), step).awaitTermination()
    assert sorted(got) == sorted(tuple(r) for r in incremental.daily_counts(events).collect())


def test_watermarked_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    counts = incremental.daily_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()


def test_training_and_reuse(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("a"), F.rand(1).alias("b")).withColumn("label", (F.col("a") > 8).cast("int"))
    split = learning.stratified_split(df, "id", "label")
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    per = {(r.label, r.part): r["count"] for r in split.groupBy("label", "part").count().collect()}
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    assert all(per[k, "train"] == int(n * 0.8) and per[k, "test"] == n - int(n * 0.8) for k, n in sizes.items())
    fold = {(r.label, r.fold): r["count"] for r in learning.folds(df, "id", "label", 3).groupBy("label", "fold").count().collect()}
    assert len(fold) == 6 and all(fold[k, f] in (n // 3, n // 3 + 1) for k, n in sizes.items() for f in range(3))
    model = learning.train(train, ["a", "b"], depth=2, rounds=3)
    scored = learning.apply(model, test, ["a", "b"])
    assert scored.where((F.col("score1") > 0) == (F.col("label") == 1)).count() == test.count()
    assert scored.where(F.col("score0") != -F.col("score1")).count() == 0
    learning.save(model, str(tmp_path), 20230301)
    again = learning.apply(learning.load(str(tmp_path), 20230315), test, ["a", "b"])
    assert again.select(F.sum("score1")).first()[0] == scored.select(F.sum("score1")).first()[0]
    best, area = learning.tune(df, ["a", "b"], "id", [{"depth": 1, "rounds": 1}, {"depth": 2, "rounds": 2}], k=2)
    assert area > 0.9 and best["depth"] in (1, 2)
    firsts = {(r.date, r.trains) for r in learning.latest_per_month(days(spark, 20230105, 20230106, 20230201)).collect()}
    assert firsts == {(20230105, True), (20230106, False), (20230201, True)}


def test_models_by_month_and_repeated_evaluation(spark, tmp_path):
    df = spark.range(240).select("id", F.when(F.col("id") % 3 == 0, 20230105).when(F.col("id") % 3 == 1, 20230120).otherwise(20230203).alias("date"), (F.col("id") % 10).cast("double").alias("a"))
    df = df.withColumn("label", F.when(F.col("id") % 20 == 0, -1).otherwise((F.col("a") > 4).cast("int")))
    scored = learning.apply_by_day(df, ["a"], str(tmp_path), depth=1, rounds=1)
    assert scored.count() == 240 and scored.where((F.col("label") >= 0) & ((F.col("score1") > 0) != (F.col("label") == 1))).count() == 0
    one = df.withColumn("label", F.lit(1))
    assert learning.apply_by_day(one, ["a"], str(tmp_path)).collect() == []
    runs = {r.run: r.auc_pr for r in learning.evaluate(df, ["a"], "id", times=2, depth=1, rounds=1).collect()}
    assert set(runs) == {0, 1, -1} and abs(runs[-1] - (runs[0] + runs[1]) / 2) < 1e-12
    best, area = learning.random_search(df, ["a"], "id", {"depth": (1, 2), "rate": (0.1, 0.3)}, tries=2, k=2)
    assert best["depth"] in (1, 2) and 0.1 <= best["rate"] <= 0.3 and area > 0.9


def test_days_wanted_and_batches(spark):
    assert sorted(r.date for r in incremental.target_days([days(spark, 1, 2, None), days(spark, 2, 5)]).collect()) == [1, 2, 5]
    assert {tuple(r) for r in incremental.day_batches(days(spark, 7, 1, 3, 3, 9), 2).collect()} == {(1, 0), (3, 0), (7, 1), (9, 1)}
    assert incremental.day_batches(days(spark), 2).collect() == []
