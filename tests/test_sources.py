import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pyspark.sql import datasource

from corpusframe import schemas
from corpusframe.functions import signal
from corpusframe.sources import arrow_cache, manifests, sinks


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    return str(path)


def test_hypotheses_last_one_wins(spark, tmp_path):
    put(tmp_path / "hyp.shard_0", [{"utt_id": "a", "hyp": "1"}, "", {"utt_id": "b", "dataset": "x", "hyp": "2"}])
    put(tmp_path / "hyp.shard_1", [{"utt_id": "a", "dataset": "y", "hyp": "3"}, {"utt_id": "a", "dataset": "y", "hyp": "4"}])
    assert manifests.hypotheses(spark, str(tmp_path)).count() == 4
    assert {r["utt_id"]: (r["hyp"], r["dataset"]) for r in manifests.hypotheses_by_id(spark, str(tmp_path)).collect()} == {"a": ("4", "y"), "b": ("2", "x")}


def test_truncated_log(spark, tmp_path):
    p = put(tmp_path / "log.jsonl", [{"id": "a", "duration_s": 1.0}, {"id": "a", "duration_s": 2.0}, '{"id": "b", "dur'])
    rows = manifests.readable_rows(spark, p, schemas.CONVERSION, "id").collect()
    assert [(r["id"], r["duration_s"]) for r in rows] == [("a", 2.0)]


def test_alignments_errors_and_kaldi(spark, tmp_path):
    p = put(tmp_path / "al.jsonl", [{"audio": "a", "words": [{"w": "x", "start": 0, "end": 1}], "score": -1.0}, {"audio": "b", "error": "short"}])
    good, bad = manifests.alignments(spark, p)
    assert good.first()["words"][0]["aligned"] is None and [r["audio"] for r in bad.collect()] == ["b"]
    k = put(tmp_path / "wav.scp", ["a one two ", "", "b", "a three"])
    assert {r["id"]: r["value"] for r in manifests.id_values(spark, k).collect()} == {"a": "three", "b": ""}


def test_parquet_shards(spark, tmp_path):
    df = spark.createDataFrame([("1", " hi ", None), ("2", "  ", None), ("3", None, None)], "id string, transcription string, audio struct<bytes:binary,path:string>")
    df.coalesce(1).write.parquet(str(tmp_path / "raw"))
    (tmp_path / "Egypt").mkdir()
    part = next((tmp_path / "raw").glob("part-*.parquet"))
    part.rename(tmp_path / "Egypt" / "train-0.parquet")
    assert [(r["id"], r["transcription"]) for r in manifests.parquet_shards(spark, str(tmp_path), "Egypt", "train").collect()] == [("1", "hi")]
    with pytest.raises(manifests.NoInput):
        manifests.parquet_shards(spark, str(tmp_path), "Egypt", "validation")


def test_tables_and_inventory(spark, tmp_path):
    p = put(tmp_path / "p.csv", ["id,split,dialect,dur_s,speech_s,speech_ratio,reason", "a,t,EG,1,0,0,empty", "b,t,EG,1,1,1,low"])
    assert [r["id"] for r in manifests.problem_ids(spark, [p], ["empty", "severe"]).collect()] == ["a"]
    d = put(tmp_path / "d.csv", ["ID,duration", "a,1.5", "b,-1"])
    assert {r["ID"]: r["duration"] for r in manifests.durations(spark, d).collect()} == {"a": 1.5, "b": -1.0}
    put(tmp_path / "vc" / "EG" / "metadata.jsonl", [{"id": "x", "dialect": "EG", "duration_s": 4.0}, {"id": "y", "dialect": "EG", "duration_s": 1.0}])
    assert [(r["id"], r["folder_dialect"]) for r in manifests.conversion_rows(spark, str(tmp_path / "vc"), 3.0).collect()] == [("x", "EG")]
    assert manifests.inventory(spark, str(tmp_path), "*.csv").count() == 2
    c = put(tmp_path / "clips.json", [json.dumps([{"id": "abcdefghijklm", "duration_s": 1.0, "country": "EG", "split": "train"}])])
    assert manifests.clips(spark, c, "/r", "split").first()["wav_path"] == "/r/EG/train/abcdefghijklm.wav"
    assert manifests.clips(spark, c, "/r", "flat").first()["prefix"] == "abcdefghijk"
    t = put(tmp_path / "t.jsonl", [{"audio": "/audio/Egypt/1.flac", "text": "language Arabic<asr_text>hi"}])
    assert tuple(manifests.training_rows(spark, t).first()) == ("/audio/Egypt/1.flac", "hi", "Egypt")
    assert manifests.existing(spark, [str(tmp_path / "none")], "id string").count() == 0
    with pytest.raises(ValueError, match="missing"):
        manifests.required(spark.range(1), ["idx"])
    with pytest.raises(ValueError, match="training"):
        manifests.config({"a": {"splits": ["test"]}}, "a")


def test_clip_id_and_names(spark):
    df = spark.createDataFrame([("x", "/a/b.wav", 0), ("", "/a/b.wav", 1), (None, None, 2)], "id string, path string, i int")
    assert [r[0] for r in df.select(manifests.clip_id(F.col("id"), F.col("path"), "train", F.col("i"))).collect()] == ["x", "b", "train#2"]
    n = spark.range(1).select(manifests.source_names(F.lit("Org/Data-Set")).alias("n")).first()["n"]
    assert (n["folder"], n["prefix"]) == ("Org___Data-Set", "data-set")


def test_arrow_cache(spark, tmp_path):
    names = ["d-train-00001-of-00002.arrow", "d-train-00000-of-00002.arrow", "d-test.arrow", "cache-d-train.arrow", "d-train.arrow"]
    assert arrow_cache.cache_shards(names, "d", "train") == ["d-train-00000-of-00002.arrow", "d-train-00001-of-00002.arrow", "d-train.arrow"]
    table = pa.table({"id": ["a", "b"], "dialect": ["EG", "MA"], "n": [1, 2]})
    with pa.OSFile(str(tmp_path / "d-train.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    df = arrow_cache.read_cache(spark, [str(tmp_path / "d-train.arrow")], "id string, dialect string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("a", "EG"), ("b", "MA")]


def written(path, kind, bounds=True):
    """Ten batches of 100 rows, with a column of repeated texts in a dictionary."""
    word = pa.DictionaryArray.from_arrays(pa.array([0, 1] * 50, pa.int8()), pa.array(["x", "y"]))
    parts = [pa.record_batch({"n": pa.array(range(k, k + 100)), "audio": [{"bytes": bytes(500), "path": f"/a/{i}"} for i in range(100)], "word": word}) for k in range(0, 1000, 100)]
    with pa.OSFile(str(path), "wb") as f, kind(f, parts[0].schema) as w:
        for p in parts:
            w.write_batch(p, **({"custom_metadata": arrow_cache.bounds_of(p)} if bounds else {}))


@pytest.mark.parametrize("kind", [pa.ipc.new_stream, pa.ipc.new_file])
def test_one_cache_file_is_read_by_many_tasks(spark, tmp_path, kind):
    path = tmp_path / "c-train.arrow"
    written(path, kind)
    df = arrow_cache.read_cache(spark, [str(path)], split_bytes=60_000)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // 60_000) > 8
    assert df.schema["audio"].dataType.simpleString() == "struct<bytes:binary,path:string>"
    got = df.select("n", "word", F.length("audio.bytes").alias("b")).collect()
    assert sorted(r["n"] for r in got) == list(range(1000)) and {r["b"] for r in got} == {500}
    assert {(r["n"] % 2, r["word"]) for r in got} == {(0, "x"), (1, "y")}
    with pytest.raises(OSError):
        with open(path, "rb") as f:
            raw = f.read()[: path.stat().st_size // 2]
        (tmp_path / "half.arrow").write_bytes(raw[: raw.rindex(b"\xff\xff\xff\xff") + 20])
        with open(tmp_path / "half.arrow", "rb") as f:
            list(arrow_cache.messages(f))


def test_filters_pass_over_batches(spark, tmp_path):
    class Counted:
        def __init__(self, f):
            self.f, self.seek, self.n = f, f.seek, 0

        def read(self, k):
            self.n += k
            return self.f.read(k)

    path = tmp_path / "c-train.arrow"
    written(path, pa.ipc.new_stream)
    with open(path, "rb") as f:
        told = Counted(f)
        at_most = datasource.LessThan(("n",), 250)
        got = list(arrow_cache.batches(told, 0, None, lambda b: arrow_cache.may_hold(at_most, b)))
    assert [b.num_rows for b in got] == [100, 100, 100] and told.n < path.stat().st_size * 0.4
    for test, n in ((datasource.EqualTo(("n",), 950), 1), (datasource.In(("n",), (5, 105)), 2), (datasource.GreaterThanOrEqual(("n",), 999), 1), (datasource.EqualTo(("word",), "x"), 10), (datasource.IsNull(("n",)), 10), (datasource.GreaterThan(("n",), "a"), 10)):
        with open(path, "rb") as f:
            assert len(list(arrow_cache.batches(f, 0, None, lambda b, t=test: arrow_cache.may_hold(t, b)))) == n
    plain = tmp_path / "p-train.arrow"
    written(plain, pa.ipc.new_stream, bounds=False)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        reader = arrow_cache.FilteringReader([str(path)], ["n"], 1 << 20)
        assert list(reader.pushFilters([at_most])) == [at_most]
        assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 300
        for p in (path, plain):
            assert arrow_cache.read_cache(spark, [str(p)]).where("n < 250 and word = 'x'").count() == 125
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("EG", 1, "b"), ("EG", 0, "أ"), ("MA", 0, None)], "d string, row int, hyp string")
    sinks.write_json(df, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {"d": "MA", "row": 0, "hyp": None} in lines and any("أ" in str(x) for x in lines)
    sinks.write_groups_in_order(df.fillna(""), "d", ["row"], "hyp", str(tmp_path / "g"))
    files = list((tmp_path / "g" / "d=EG").glob("part-*"))
    assert len(files) == 1 and files[0].read_text(encoding="utf-8") == "أ\nb\n"
    seg = spark.createDataFrame([("b", "EG", "s", "p", 5.0, 5.0), ("a", "EG", "s", "p", 0.0, 5.0)], schemas.SEGMENT)
    sinks.write_segments(seg, str(tmp_path / "seg.csv"), {"n": 2})
    assert json.loads((tmp_path / "seg.csv.meta.json").read_text()) == {"n": 2}
    six = spark.createDataFrame([(0.1234565,), (1.0,)], "x double").select(sinks.six_places("x")).collect()
    assert [r[0] for r in six] == ["%.6f" % 0.1234565, "1.000000"]
    b = spark.createDataFrame([(bytearray(b"RIFFxx"),), (bytearray(b"fLaC"),), (bytearray(b"OggS"),)], "b binary")
    assert [r[0] for r in b.select(sinks.is_encoded(F.col("b"))).collect()] == [True, True, False]
    sinks.write_report(spark.range(1), str(tmp_path / "r.json"), F.struct(F.lit(None).cast("int").alias("wer"), F.lit(1).alias("n")))
    assert json.loads((tmp_path / "r.json").read_text()) == {"wer": None, "n": 1}
    sinks.archive([("a.txt", "x")], str(tmp_path / "z.zip"))
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["a.txt"]
    sinks.append_new(df, None, "row", str(tmp_path / "app"))
    sinks.append_new(df, spark.read.json(str(tmp_path / "app")), "row", str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 3


def test_bank_durations_and_once(spark, tmp_path):
    assert manifests.bank(spark, str(tmp_path / "none.json")).count() == 0
    p = put(tmp_path / "bank.json", [json.dumps([{"clips": ["a"], "dur": 61.0}, {"clips": ["b"], "dur": 31.0}])])
    assert sorted(r["dur"] for r in manifests.bank(spark, p).collect()) == [31.0, 61.0]
    df = spark.createDataFrame([(1,)], "x int")
    assert sinks.write_once(df, str(tmp_path / "once")).collect() == sinks.write_once(df.withColumn("x", F.col("x") + 1), str(tmp_path / "once")).collect()
    assert manifests.source("adi20", {"name": "other"})["name"] == "other"
    with pytest.raises(KeyError):
        manifests.source("none")


def test_bank_files(spark, tmp_path):
    from corpusframe.operators import metrics

    clips = spark.createDataFrame([("EG", 100.0), ("EG", 20.0), ("MA", 5.0)], "country string, dur double")
    voices = spark.createDataFrame([("EG", 61.0, ["a"]), ("EG", 31.0, ["b"])], "country string, dur double, clips array<string>")
    summary = metrics.bank_summary(voices, clips, "country")
    got = {r["country"]: r for r in summary.collect()}
    assert (got[None]["voices"], got[None]["long_voices"], got["MA"]["voices"], got["EG"]["clips"]) == (2, 1, 0, 2)
    sinks.write_bank(voices, summary, {"exp": "x"}, str(tmp_path / "b"))
    said = json.loads((tmp_path / "b" / "bank_summary.json").read_text())
    assert said["exp"] == "x" and said["totals"]["voices"] == 2 and said["per_dialect"]["EG"] == {"voices": 2, "long_voices": 1}


def test_embedding_pairs_must_match(spark, tmp_path):
    spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row int, embedding array<float>").write.parquet(str(tmp_path / "m"))
    p = put(tmp_path / "meta.json", [json.dumps([{"id": "a", "dur": 1.0, "country": "EG"}])])
    with pytest.raises(Exception, match="stands alone"):
        manifests.embeddings(spark, str(tmp_path / "m"), p).collect()


def test_large_logs_are_split_and_stay_in_order(spark, tmp_path):
    rows = [{"utt_id": f"u{i % 50}", "hyp": str(i)} for i in range(4000)]
    put(tmp_path / "hyp.shard_0", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = manifests.hypotheses(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert {r["utt_id"]: r["hyp"] for r in manifests.hypotheses_by_id(spark, str(tmp_path)).collect()} == {f"u{i}": str(3950 + i) for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_are_numbered_over_files(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "if(id % 9 = 0, null, id) as file").repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(p)
    spark.range(0).selectExpr("id", "id as file").write.mode("append").parquet(p)
    got = manifests.numbered_rows(spark, p, ["id", "file"], "n")
    assert got.columns == ["id", "file", "n"] and all(r["id"] == r["n"] for r in got.collect()) and got.count() == 100
    with pytest.raises(ValueError):
        manifests.numbered_rows(spark, p, ["none"])


def test_a_written_bank_is_read_by_country(spark, tmp_path):
    from corpusframe.operators import metrics

    clips = spark.createDataFrame([("EG", 100.0), ("MA", 5.0)], "country string, dur double")
    voices = spark.createDataFrame([("EG", 61.0, ["a"]), ("EG", 31.0, ["b"]), ("MA", 5.0, ["c"])], "country string, dur double, clips array<string>")
    sinks.write_bank(voices, metrics.bank_summary(voices, clips, "country"), {}, str(tmp_path / "b"))
    got = manifests.bank(spark, str(tmp_path / "b" / "bank"), lines=True)
    assert sorted((r["country"], r["dur"], r["clips"]) for r in got.collect()) == [("EG", 31.0, ["b"]), ("EG", 61.0, ["a"]), ("MA", 5.0, ["c"])]
    assert "PartitionFilters: [isnotnull(country" in got.where("country = 'EG'")._jdf.queryExecution().toString()
    assert manifests.bank(spark, str(tmp_path / "none"), lines=True).count() == 0


def test_inventory_by_tasks(spark, tmp_path):
    """Folders are listed and headers read by tasks, not by the driver's file index with 32 files a task."""
    for k in range(150):
        put_bytes = tmp_path / "w" / str(k % 5) / f"{k}.wav"
        put_bytes.parent.mkdir(parents=True, exist_ok=True)
        put_bytes.write_bytes(signal.encode_wav(np.zeros(160 * k)))
    (tmp_path / "w" / "_tmp").mkdir()
    (tmp_path / "w" / "_tmp" / "x.wav").write_bytes(b"junk")
    (tmp_path / "w" / "0" / ".hidden.wav").write_bytes(b"junk")
    (tmp_path / "w" / "junk.wav").write_bytes(b"junk")
    (tmp_path / "w" / "1" / "a.wavx").write_bytes(b"junk")
    files = manifests.inventory(spark, str(tmp_path / "w"), "*.wav")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(str(tmp_path / "w"))
    said = lambda df, n: sorted((r["path"], r[n]) for r in df.select("path", n).collect())
    assert said(files, "bytes") == said(want, "length") and files.count() == 151
    seconds = {r["path"].rpartition("/")[2]: r["seconds"] for r in manifests.measured(files).collect()}
    assert seconds.pop("junk.wav") == -1 and seconds == {f"{k}.wav": k / 100 for k in range(150)}
    assert manifests.measured(files).rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism)
    with pytest.raises(manifests.NoInput):
        manifests.augmentation_table(spark, str(tmp_path / "w"), str(tmp_path / "t"), "mp3")


def test_large_group_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # small ranges stay apart
    try:
        df = spark.range(2000).selectExpr("'a' AS g", "1999 - id AS row", "cast(1999 - id AS string) AS t")
        sinks.write_groups_in_order(df, "g", ["row"], "t", str(tmp_path / "g"))
    finally:
        spark.conf.set(key, before)
    files = sorted((tmp_path / "g" / "g=a").glob("part-*"))
    assert len(files) > 1 and [int(x) for f in files for x in f.read_text().splitlines()] == list(range(2000))
