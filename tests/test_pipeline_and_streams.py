import numpy as np
from pyspark.sql import functions as F

from arrayloom.operators import encoders, pyramids, stats
from arrayloom.plans.pipeline import Pipeline, PyramidClassifier
from arrayloom.streaming import stages


def stacks(spark, n, seed=5):
    """Weak waves by small radii, strong ones by large: both classes have points of both sorts, and differ in which wave leads."""
    rng = np.random.default_rng(seed)
    t, r = np.meshgrid(np.arange(16), np.arange(16), indexing="ij")
    rows = []
    for i in range(n):
        k = i % 2
        lead, other = np.cos(2 * np.pi * 2 * t / 16 + rng.random() * 6), np.cos(2 * np.pi * 3 * r / 16 + rng.random() * 6)
        a = np.where(r < 8, 1.0, 4.0) * ((lead, other)[k] + 0.5 * (other, lead)[k]) + rng.normal(size=(16, 16)) * 0.05
        rows.append((i, k, 1, 16, 16, a.ravel().tolist()))
    return spark.createDataFrame(rows, "id long, label int, channels int, rows int, cols int, data array<double>")


def test_pyramid_classifier(spark):
    """Right on images it hasn't seen, and the same model however the rows are dealt."""
    models = [PyramidClassifier(pyramids.Pyramid(16, 16, 2, 2, 4), clusters=3).fit(stacks(spark, 24).repartition(n)) for n in (1, 4, 8)]
    assert models[0].score(stacks(spark, 12)).first()[0] > 90
    assert models[0].score(stacks(spark, 40, seed=6)).first()[0] > 90
    for m in models[1:]:
        assert all(np.allclose(m.codebooks[k], models[0].codebooks[k]) for k in m.codebooks)
        assert np.allclose(m.model.weights, models[0].model.weights, atol=1e-6)
    assert len(models[0].predict(stacks(spark, 2)).first()["vec"]) == (3 + 2) * 3


def test_pipeline_keeps_stages(spark):
    p = Pipeline([("half", lambda d: d.filter("id % 2 = 0")), ("double", lambda d: d.withColumn("x", F.col("id") * 2))], {"half"})
    assert [r.x for r in p.run(spark.range(6)).orderBy("id").collect()] == [0, 4, 8]


def test_stream_equals_batch(spark, sf, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(source))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = stages.through(stages.arrays(spark, str(source), schema, 2), lambda d: d.filter("value > 1"), lambda d: d.withColumn("k", F.floor(F.col("value") / 100)))
    stages.written(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.filter("value > 1").count()
    stages.written(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.filter("value > 1").count()
    for i, f in enumerate((stages.windowed_moments(stages.arrays(spark, str(source), schema), "ts", F.col("value"), "30 days", "1 day", ("event_type",)), stages.running_histogram(stages.arrays(spark, str(source), schema), "ts", stats.bin_of(F.col("value"), 50.0, 10), "30 days", "1 day"))):
        q = f.writeStream.format("memory").queryName(f"w{i}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(f"w{i}").agg(F.sum("n")).first()[0] == events.count()


def test_assignment_needs_no_shuffle(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>")
    plan = encoders.assigned(df, np.eye(2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fold_goes_on_from_its_checkpoint(spark, sf, tmp_path):
    """Started again when more files are there, a fold's last row by key is that of the whole table; idle keys close."""
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    half = events.agg(F.percentile_approx(F.unix_millis("ts"), 0.5)).first()[0]
    keys = {"event_type": events.schema["event_type"].dataType.simpleString()}

    def run():
        stream = stages.folded_moments(stages.arrays(spark, str(source), schema, 2), keys, "ts", F.col("value"), "3650 days", 10_000)
        stages.written(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out"))
        assert rows.filter("closed").count() == 0
        return {r[0]: r[1] for r in rows.groupBy("event_type").agg(F.max_by(F.struct("n", "mean", "var"), "n")).collect()}

    def equal(df):
        got, want = run(), df.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")).collect()
        assert {r.event_type for r in want} == set(got)
        for r in want:
            assert got[r.event_type].n == r.n and np.allclose([got[r.event_type].mean, got[r.event_type]["var"]], [r["mean"], r["var"]])

    events.filter(F.unix_millis("ts") <= half).repartition(3).write.parquet(str(source))
    equal(events.filter(F.unix_millis("ts") <= half))
    events.filter(F.unix_millis("ts") > half).repartition(3).write.mode("append").parquet(str(source))
    equal(events)
    equal(events)  # nothing new


def test_idle_keys_close(spark, tmp_path):
    source, at = tmp_path / "in", "timestamp_millis(1700000000000 + s * 1000)"
    schema, keys = "k string, ts timestamp, v double", {"k": "string"}

    def run(rows):
        spark.createDataFrame(rows, "k string, s long, v double").select("k", F.expr(at).alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(source))
        stream = stages.folded_moments(stages.arrays(spark, str(source), schema), keys, "ts", F.col("v"), "0 seconds", 5000)
        stages.written(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        return {(r.k, r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("closed").collect()}

    assert run([("a", 0, 1.0), ("a", 1, 3.0), ("b", 1, 7.0), ("b", None, 9.0)]) == set()
    closed = run([("b", 4, None), ("c", 8, 1.0)])  # the time is 8: a, last seen at 1, is idle; b isn't, seen at 4
    assert closed == {("a", 2, 2.0)}
    assert run([("a", 20, 5.0)]) == {("a", 2, 2.0), ("b", 1, 7.0), ("c", 1, 1.0)}
    assert run([("d", 40, 5.0)]) >= {("a", 1, 5.0)}  # a starts anew after its end
