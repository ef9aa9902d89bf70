"""Exact percentiles of large groups, and functions of tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import metrics, percentiles, segments, table_functions


def test_percentiles_equal_sorted_groups(spark):
    r = random.Random(3)
    rows = [(g, v) for g in ("a", "b", None, "c") for v in [r.choice([r.gauss(0, 1), 0.25, 1e9 * r.random()]) for _ in range({"a": 6000, "b": 7, None: 900, "c": 1}[g])]]
    df = spark.createDataFrame([*rows, ("a", None), ("d", None)], "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {x["g"]: x for x in df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect()}
    for accuracy in (20, 1000):
        made = percentiles.exact_percentiles(df, ["g"], F.col("v"), shares, accuracy)
        got = {x["g"]: x for x in made.collect()}
        assert got.keys() == want.keys()
        for g, x in got.items():
            assert x["n"] == want[g]["n"]
            assert x["percentiles"] == ([None] * 5 if g == "d" else pytest.approx(want[g]["p"], rel=1e-12, abs=1e-12))
    assert "percentile(" not in made._jdf.queryExecution().toString()
    assert percentiles.exact_percentiles(df.limit(0), ["g"], F.col("v"), [0.5]).collect() == []
    with pytest.raises(ValueError):
        percentiles.exact_percentiles(df, ["g"], F.col("v"), [])


def test_one_large_group_orders_few_values(spark):
    df = spark.range(400_000).select(F.lit("g").alias("g"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    got = percentiles.exact_percentiles(df, ["g"], F.col("v"), [0.5]).first()
    values = sorted(x["v"] for x in df.select("v").collect())
    assert got["percentiles"][0] == (values[199_999] + values[200_000]) / 2
    gate = metrics.percentile_gate(df, "g", "v", 0.9)
    assert gate.count() == sum(v >= values[359_999] * 0.1 + values[360_000] * 0.9 for v in values)


def test_functions_of_tables_equal_columns(spark):
    table_functions.register(spark)
    clips = spark.createDataFrame([(k, d) for k, d in enumerate([None, 0.5, 1.9, 2.0, 4.2, 5.0, 6.9, 10.0, 12.3])], "id int, dur double")
    for hop in (5.0, 2.5):
        got = spark.sql(f"SELECT * FROM segment_windows(TABLE({{clips}}), 'dur', 5.0D, {hop}D, 2.0D)", clips=clips).collect()
        want = segments.segment_table(clips, "dur", 5.0, hop, 2.0).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 8
    r = random.Random(5)
    rows = []
    for clip in range(6):
        at = r.random() * 0.1
        for k in range([1, 3, 9, 40, 12, 7][clip]):
            long_ = r.choice([0.0, 0.08, 0.2, 0.3])
            rows.append((clip, k, r.choice(["a", "bb", " ", "c"]), at, at + long_, r.random() < 0.9, None))
            at += long_ + r.choice([0.0, 0.02, 0.05, 0.3])
        rows = [(*x[:6], at + 0.03) if x[0] == clip else x for x in rows]
    words = spark.createDataFrame(rows, "clip int, k int, w string, start double, end double, aligned boolean, dur double")
    got = spark.sql("SELECT * FROM word_spans(TABLE({words}), 'clip', 'k', 'dur')", words=words.orderBy(F.rand(1))).collect()
    whole = words.groupBy("clip", "dur").agg(F.array_sort(F.collect_list(F.struct("k", "w", "start", "end", "aligned"))).alias("words"))
    want = segments.word_spans(whole.withColumnRenamed("dur", "whole"), "words", "whole")
    want = want.select("clip", "i", "j", "nw", "t0", "t1", "gap", "span_text").collect()
    near = lambda rows: sorted((x["clip"], x["i"], x["j"], x["nw"], round(x["t0"], 9), round(x["t1"], 9), round(x["gap"], 9), x["span_text"]) for x in rows)
    assert near(got) == near(want) and len(got) > 20
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM word_spans(TABLE({words}), 'clip', 'nowhere', 'dur')", words=words).collect()


def test_spans_of_a_clip_leave_in_few_messages():
    from pyspark.sql import Row

    spans, sizes = table_functions.WordSpans(), []
    for k in range(2_000):
        sizes.append(len(list(spans.eval(Row(c=1, k=k, w=f"w{k}", start=k * 0.2, end=k * 0.2 + 0.15, d=400.0), "c", "k", "d"))))
        assert len(spans.held) <= 8 and len(spans.made) < 300
    sizes.append(len(list(spans.terminate())))
    assert 5_000 < sum(sizes) < 12_000 and sum(n > 0 for n in sizes) < 50
