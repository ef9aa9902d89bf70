"""Exports that commit, and single files that tasks write."""

import json
import random
import tracemalloc
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusframe.sources import export, ordered


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()} if folder.exists() else set()


def clips(spark, n=40, bad=()):
    rows = [(str(i), b"junk" if i in bad else b"RIFF" + bytes([i]), f"said {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, blob binary, text string").repartition(5, "id")


def test_export_commits_once(spark, tmp_path):
    seen = clips(spark, bad={3, 4})
    root, manifest = tmp_path / "audio", tmp_path / "manifest"
    errors = export.export_clips(seen, "Egypt", str(root), str(manifest), "> ")
    assert {r["name"] for r in errors.collect()} == {"Egypt/3.flac", "Egypt/4.flac"} == {r["name"] for r in errors.collect()}
    assert files(root) == {f"Egypt/{i}.flac" for i in range(40) if i not in (3, 4)}
    rows = [json.loads(x) for p in manifest.glob("part-*.json") for x in p.read_text().splitlines()]
    assert sorted(r["text"] for r in rows) == sorted(f"> said {i}" for i in range(40) if i not in (3, 4))
    assert {r["audio"] for r in rows} == {f"{root}/{n}" for n in files(root)} and not list(manifest.glob("_staging*"))
    before = (root / "Egypt" / "5.flac").stat().st_mtime_ns
    again = export.export_clips(seen, "Egypt", str(root), str(manifest), "> ", lambda b: b"RIFF" + b)
    assert again.count() == 0 and (root / "Egypt" / "3.flac").read_bytes() == b"RIFFjunk"
    assert (root / "Egypt" / "5.flac").stat().st_mtime_ns == before
    assert sum(len(p.read_text().splitlines()) for p in manifest.glob("part-*.json")) == 40


def test_failed_export_leaves_nothing(spark, tmp_path):
    root, manifest = tmp_path / "audio", tmp_path / "manifest"
    broken = clips(spark).withColumn("text", F.when(F.col("id") == "39", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        export.export_clips(broken, "Egypt", str(root), str(manifest))
    assert files(root) == set() and files(manifest) == set()
    export.export_clips(clips(spark, 4), "Egypt", str(root), str(manifest))
    with pytest.raises(Exception, match="lost"):
        export.export_clips(broken, "Egypt", str(root), str(manifest))
    assert files(root) == {f"Egypt/{i}.flac" for i in range(4)} and len(files(manifest)) >= 1


def test_combined_checksums():
    r = random.Random(1)
    for _ in range(200):
        a, b = r.randbytes(r.randrange(50)), r.randbytes(r.choice([0, 1, 7, 900]))
        assert ordered.combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_single_files_in_order_without_the_driver(spark, tmp_path):
    n = 120_000
    rows = spark.range(n).repartition(7).select(F.col("id").alias("k"), F.concat(F.lit("line é "), F.col("id").cast("string")).alias("a"), (F.col("id") % 20).alias("b"))
    tracemalloc.start()
    ordered.write_ordered(rows, ["k"], {"a.txt": "a", "b.csv": "b"}, str(tmp_path / "out"), {"b.csv": "head"}, {"both.zip": ["a.txt", "b.csv"]})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    a, b = "".join(f"line é {i}\n" for i in range(n)), "head\n" + "".join(f"{i % 20}\n" for i in range(n))
    assert (tmp_path / "out" / "a.txt").read_text(encoding="utf-8") == a and (tmp_path / "out" / "b.csv").read_text() == b
    with zipfile.ZipFile(tmp_path / "out" / "both.zip") as z:
        assert z.testzip() is None and z.namelist() == ["a.txt", "b.csv"]
        assert z.read("a.txt").decode() == a and z.read("b.csv").decode() == b
    assert peak < 3 << 20
    ordered.write_ordered(rows.limit(0), ["k"], {"a.txt": "a", "b.csv": "b"}, str(tmp_path / "none"), {"b.csv": "head"}, {"both.zip": ["b.csv"]})
    assert (tmp_path / "none" / "b.csv").read_text() == "head\n" and (tmp_path / "none" / "a.txt").read_text() == ""
    with zipfile.ZipFile(tmp_path / "none" / "both.zip") as z:
        assert z.read("b.csv") == b"head\n"


def test_error_report_counts_once(spark, tmp_path):
    """Rates come from the rows that the report was written from, not from counting edits again."""
    from corpusframe.sources import sinks

    pairs = spark.createDataFrame([("a b c", "a c", "x"), ("<tag> A _ b", "a b", "x"), ("", "a", "y"), (None, "a", "y")], "r string, h string, g string")
    rates = sinks.error_report(pairs, "r", "h", "g", str(tmp_path))
    assert "word_edits" not in rates._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["g"] or "", x["edits"], x["units"], x["n"], x["pooled"]) for x in rates.collect()) == [("", 1, 5, 2, 1), ("x", 1, 5, 2, 0), ("y", 0, 0, 0, 0)]
