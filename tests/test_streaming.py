from pyspark.sql import functions as F

from corpusframe.streaming import windows


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def events(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))


def test_tumbling_stream_equals_batch(spark, sf, tmp_path):
    batch, stream = events(spark, sf, tmp_path)
    got = drain(windows.tumbling(stream, "ts", "1 day", ["event_type"], "value", "40 days"), "tumbling", "complete")
    want = windows.tumbling(batch, "ts", "1 day", ["event_type"], "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00", 1.0), ("u", "2024-01-01 00:04:00", 2.0), ("u", "2024-01-01 01:00:00", 4.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    got = windows.sessions(e, "t", "5 minutes", ["k"], "v").orderBy("start").collect()
    assert [(r["n"], r["total"]) for r in got] == [(2, 3.0), (1, 4.0)]


def test_error_rate_monitor(spark, sf, tmp_path):
    _, stream = events(spark, sf, tmp_path)
    rated = stream.select("ts", "event_type", (F.col("event_id") % 3).alias("edits"), F.lit(5).alias("n_ref"))
    got = drain(windows.error_rate(rated, "ts", "10 days", "event_type", "1 day"), "rates", "complete")
    assert got.agg(F.sum("units")).first()[0] == 5000 and got.where("rate < 0 or rate > 1").count() == 0


def test_retained_steps(spark, tmp_path):
    spark.createDataFrame([("m", s, v) for s, v in [(1, 0.5), (2, 0.3), (3, None), (4, 0.4), (5, 0.9)]], "g string, step long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, step long, v double").parquet(str(tmp_path / "in"))
    got = drain(windows.retained_steps(stream, "g", "step", "v", 2), "kept", "update")
    assert {r["step"] for r in got.where("keep").collect()} == {2, 4, 5}
