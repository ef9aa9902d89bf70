import pytest
from pyspark.sql import functions as F

from corpusframe.functions.signal import encode_wav
from corpusframe.operators import metrics, quality
from corpusframe.plans import corpora
from corpusframe.sources import sinks


def clips(spark, n, dialects=("EG", "MA"), start=0, dur=10.0):
    return spark.createDataFrame([(f"vid{i % 5:08d}_{i + start:04d}", dialects[i % len(dialects)], dur + i % 3) for i in range(n)], "id string, dialect string, duration double")


def test_selection_fills_up_in_order(spark):
    all_ = clips(spark, 40)
    problems = all_.limit(4).select("id")
    kept = corpora.keep_ids(all_, problems, 11.0)
    assert kept.count() == all_.where("duration >= 11").join(problems, "id", "left_anti").count()
    video = spark.createDataFrame([("vid00000001",)], "id string")
    assert corpora.keep_ids(all_, problems, 0, video).where("id not like 'vid00000001%'").count() == 0
    out = corpora.balanced_hours(clips(spark, 10), clips(spark, 4, ("EG",), 100), clips(spark, 90, start=200), 150.0)
    per = {r["dialect"]: r["s"] for r in out.groupBy("dialect").agg(F.sum("duration").alias("s")).collect()}
    assert all(150 <= s < 163 for s in per.values())
    assert {r["origin"] for r in out.collect()} == {"real", "extra", "converted"}
    assert out.where("origin = 'extra' and dialect = 'MA'").count() == 0 and out.select("id").distinct().count() == out.count()


def test_segments_of_two_corpora(spark):
    first, second = clips(spark, 6), clips(spark, 9)
    built = corpora.segment_build(first, second, 5.0, 5.0, 2.0)
    assert {r["source"]: r["n"] for r in built.select("id", "source").distinct().groupBy("source").agg(F.count("*").alias("n")).collect()} == {"first": 6, "second": 3}
    even = corpora.segment_build(first, second, 5.0, 5.0, 2.0, balance=True)
    totals = corpora.segment_totals(even).collect()
    assert len({r["n"] for r in totals}) == 1 and sum(r["share"] for r in totals) == pytest.approx(1)
    assert corpora.segment_build(first, second, 5.0, 5.0, 2.0, cap=3).count() == 6


def test_short_clips(spark):
    words = [(w, k * 0.3, k * 0.3 + 0.25, True) for k, w in enumerate("a b c d e f".split())]
    rows = [(f"/audio/{i}.flac", "EG", words, 2.0, float(-i)) for i in range(10)]
    al = spark.createDataFrame(rows, "audio string, dialect string, words array<struct<w:string,start:double,end:double,aligned:boolean>>, duration double, score double")
    bins = spark.createDataFrame([("EG", 2, 2, 4), ("EG", 3, 5, 3)], "dialect string, nw int, bin int, quota int")
    got = corpora.short_clips(al, bins).collect()
    assert len(got) == 7 and all(r["utt"] != "/audio/9.flac" for r in got)


def test_assembly_and_risk(spark):
    m = spark.createDataFrame([("/audio/original/a", "p:x", "EG", 1), ("/audio/original_val/b", "x", None, 2)], "audio string, text string, dialect string, extra int")
    rows, checks = corpora.assemble([m, m], m.limit(1), "p:")
    assert rows.columns == ["audio", "text", "dialect"] and rows.count() == 4
    assert {r["check"]: r["violations"] for r in checks.collect()} == {"whole": 0, "begins": 2, "original": 2, "leakage": 2}
    with pytest.raises(ValueError):
        quality.require(checks)
    h = spark.createDataFrame([("u", 0.0, 0.0), ("u", 0.0, 1.0), ("v", 0.0, 1.0), ("v", -50.0, 0.0)], "k string, lp double, r double")
    risk = {r["k"]: r["risk"] for r in metrics.expected_risk(h, "k", "lp", "r").collect()}
    assert risk["u"] == pytest.approx(0) and risk["v"] == pytest.approx(0.5)


def test_audio_export(spark, tmp_path):
    wav = encode_wav([0.0] * 10)
    df = spark.createDataFrame([("EG/1.flac", bytearray(wav)), ("EG/2.flac", bytearray(b"raw!"))], "name string, blob binary")
    got = {r["name"]: r for r in sinks.export_audio(df, "name", "blob", str(tmp_path), lambda b: b"RIFF" + b).collect()}
    assert all(r["written"] for r in got.values()) and (tmp_path / "EG/1.flac").read_bytes() == wav and (tmp_path / "EG/2.flac").read_bytes() == b"RIFFraw!"
    assert not any(r["written"] for r in sinks.export_audio(df, "name", "blob", str(tmp_path)).collect())
    bad = sinks.export_audio(df.limit(2).withColumn("name", F.concat("name", F.lit("x"))).where("name like '%2%'"), "name", "blob", str(tmp_path)).first()
    assert bad["error"] and not (tmp_path / "EG/2.flacx").exists()
