"""Builds, items, parameters and pooling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusframe.operators import joins, metrics, models, quality, select
from corpusframe.plans import corpora


def test_transcripts_last_wins_across_groups(spark):
    clips = spark.createDataFrame([("/x/EG/a.flac",), ("/x/MA/a.flac",), ("/x/EG/z.flac",)], "audio string")
    said = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "stem string, text string, row int")
    got = joins.transcripts_to_clips(clips, said, F.regexp_extract("audio", "([^/]+)[.]flac", 1), "stem", ["row"]).collect()
    assert sorted((r["audio"], r["text"]) for r in got) == [("/x/EG/a.flac", "new"), ("/x/MA/a.flac", "new")]
    vc = spark.createDataFrame([("a__v1.wav",), ("b__v1.wav",)], "name string")
    assert [r["text"] for r in joins.converted_to_sources(vc, said, F.col("name"), "stem", ["row"]).collect()] == ["new"]


def test_missing_alignment_fails(spark):
    left, right = spark.createDataFrame([("a",), ("b",)], "src string"), spark.createDataFrame([("a", 1)], "audio string, v int")
    with pytest.raises(Exception, match="no alignment for b"):
        joins.required_join(left, right, "src", "audio", "alignment").collect()
    assert joins.required_join(left.where("src = 'a'"), right, "src", "audio", "alignment").collect()[0]["v"] == 1


def test_build_modes_and_checks(spark):
    base = spark.createDataFrame([("b", "t", "EG")], "audio string, text string, dialect string")
    words = [{"w": "x", "start": 0.0, "end": 0.5, "aligned": True}, {"w": "y", "start": 0.6, "end": 0.62, "aligned": True}]
    al = spark.createDataFrame([("s", words)], "audio string, words array<struct<w:string,start:double,end:double,aligned:boolean>>")
    short = spark.createDataFrame([("c1", "t", "EG", "s", [0, 0], 0.1), ("c2", "t", "EG", "s", [0, 1], 0.1), ("c3", "t", "EG", "s", [0, 0], 0.01), ("c3", "t", "EG", "s", [0, 5], 0.01)], "audio string, text string, dialect string, src string, span array<int>, gap double")
    files = spark.createDataFrame([("b",), ("c1",)], "audio string")
    want = {"filtered": (2, 0, 0), "identity": (5, 1, 3), "none": (1, 0, 0)}
    for mode, (n, twice, gone) in want.items():
        rows, checks = corpora.short_clip_build(base, short, al, mode, files)
        bad = {r["check"]: r["violations"] for r in checks.collect()}
        assert rows.count() == n and bad == {"span_inside": 1, "duplicates": twice, "missing_files": gone}
    with pytest.raises(ValueError):
        quality.chosen(base, "other", F.lit(True))


def test_remaining_budget_without_real_hours_takes_all(spark):
    rows = spark.createDataFrame([(f"c{i}", "EG" if i % 2 else "MA", float(i)) for i in range(20)], "id string, dialect string, duration double")
    assert corpora.remaining_budget(rows, None, 1.0).count() == 17
    assert corpora.remaining_budget(rows, None, 1.0, None, 10.0).count() == 10
    have = spark.createDataFrame([("EG", 1000.0)], "dialect string, have double")
    got = corpora.remaining_budget(rows, have, 20.0)
    assert {r["dialect"] for r in got.collect()} == {"MA"} and 20 <= got.agg(F.sum("duration")).first()[0] < 40


def test_items_are_put_together_on_demand(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    items = models.Items().provides("s", ("a", "b"), lambda a, b: a + b).provides("t", ("s",), lambda s: s * 10).provides("bad", ("nothing",), lambda x: x).provides("loop", ("loop",), lambda x: x)
    assert items.select(df, ["t", "a"]).collect() == [(30, 1)] and items.select(df, ["b"]).columns == ["b"]
    with pytest.raises(KeyError):
        items.select(df, ["bad"])
    with pytest.raises(ValueError):
        items.select(df, ["loop"])


def test_parameter_groups_count_shared_storage_once(spark):
    p = spark.createDataFrame([("e.w", 10, True, 1), ("e.tied", 10, True, 1), ("d.w", 5, False, 2)], "name string, numel long, trainable boolean, storage int")
    assert [tuple(r) for r in models.parameter_groups(p, F.lit(1e-4), F.lit(0.0)).collect()] == [(1e-4, 0.0, 1, 10)]
    assert tuple(models.trainable_summary(p, F.col("trainable"), F.startswith("name", F.lit("e."))).first()) == (20, 25, 2)


def test_attentive_pooling_against_loops():
    r = np.random.default_rng(0)
    layers, frames, width, inner, heads, taps, size = 3, 7, 5, 4, 2, 3, 6
    x = r.normal(size=(layers, frames, width))
    w = {"layer_k": r.normal(size=layers), "layer_v": r.normal(size=layers), "k": r.normal(size=(width, inner)), "v": r.normal(size=(width, inner)), "k_b": r.normal(size=inner), "conv": r.normal(size=(taps, inner, heads)), "out": r.normal(size=(heads * inner, size)), "out_b": r.normal(size=size)}
    n = 5
    mix = lambda z: np.exp(z) / np.exp(z).sum()
    key = sum(a * f for a, f in zip(mix(w["layer_k"]), x, strict=True)) @ w["k"] + w["k_b"]
    value = sum(a * f for a, f in zip(mix(w["layer_v"]), x, strict=True)) @ w["v"]
    pooled = []
    for h in range(heads):
        score = [sum(key[t + d] @ w["conv"][d + 1, :, h] for d in (-1, 0, 1) if 0 <= t + d < n) / taps for t in range(n)]
        pooled.append(sum(a * value[t] for t, a in enumerate(mix(np.array(score)))))
    assert models.attentive_pooling(x, n, w) == pytest.approx(np.concatenate(pooled) @ w["out"] + w["out_b"])


def test_sample_rows_and_batches(spark):
    df = spark.createDataFrame([(1, "a b", "a", "a b"), (2, "", "", "x")], "id int, ref string, base string, cur string")
    assert [(r["base_wer"], r["current_wer"]) for r in models.sample_rows(df, "id", "ref", "base", "cur").orderBy("id").collect()] == [(0.5, 0.0), (0.0, 1.0)]
    rows = spark.range(200).withColumn("s", F.col("id") % 40)
    got = models.length_batches(rows, F.col("s"), 8, 8, 40.0).collect()
    assert len(got) == 200 and all(max(r["s"] for r in b) - min(r["s"] for r in b) <= 40 for b in ([x for x in got if x["batch"] == k] for k in {r["batch"] for r in got}))


def test_problem_list_and_errors(spark):
    df = spark.createDataFrame([("a", 5.0, 4.0), ("b", -1.0, -1.0), ("c", 5.0, 0.1), ("d", 0.0, 0.0)], "id string, total double, speech double")
    reason = F.when(F.col("speech") < 0.5, "empty")
    got = metrics.problems(df, "total", "speech", reason)
    assert [(r["id"], r["reason"], r["speech_ratio"]) for r in got.collect()] == [("b", "decode_fail", -1.0), ("d", "empty", 0.0), ("c", "empty", 0.02)]
    errs = spark.createDataFrame([("x",), ("y",), ("y",), ("",), (None,)], "e string")
    assert [tuple(r) for r in metrics.top_values(errs, "e", 1).collect()] == [("y", 2)]
    assert select.either(errs, errs).count() == 4


def test_build_modes_list_spans_once(spark, sf, monkeypatch):
    from corpusframe.plans import build_queries

    asked, made = corpora.met_short_clips, []
    monkeypatch.setattr(corpora, "met_short_clips", lambda *a: made.append(1) or asked(*a))
    monkeypatch.setattr(corpora.segments, "boundary_ok", lambda *a: made.append(2) or F.lit(True))
    got = build_queries.q76_build_modes(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    assert made == [1, 2] and got.count() == 3
