"""Readers of manifests, hypotheses, alignments, tables and inventories."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.signal import spread
from ..functions.text import stem_simple


class NoInput(FileNotFoundError):
    """A pattern that must match files matches none."""


def parquet_shards(spark: SparkSession, root: str, group: str, split: str) -> DataFrame:
    """Rows of <root>/<group>/<split>-*.parquet with a transcript, trimmed; three columns are read.
    No shard is an error."""
    df = spark.read.option("pathGlobFilter", f"{split}-*.parquet").schema(schemas.SOURCE_AUDIO).parquet(f"{root}/{group}")
    if not df.inputFiles():
        raise NoInput(f"{root}/{group}/{split}-*.parquet")
    return df.select("id", "audio", F.trim("transcription").alias("transcription")).where("transcription <> ''")


def json_rows(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines of a known schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


#: Where a line stands: its file, the part of the file that a task reads, the line's place in it.
ORDER = ("file", "part", "line")


def lines_in_order(spark: SparkSession, path) -> DataFrame:
    """(file, part, line, value) of the lines of text files that are not blank. Files are split
    among tasks as Spark splits them; ordering by ORDER is the order of the lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), "value")
    return rows.where("trim(value) <> ''")


def json_in_order(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines with file, part and line, the order of rows."""
    return lines_in_order(spark, path).select(*ORDER, F.from_json("value", schema).alias("r")).select(*ORDER, "r.*")


def last_wins(rows: DataFrame, key: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per key, the last by order."""
    cols = [c for c in rows.columns if c not in order]
    got = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key]), F.struct(*order)).alias("r"))
    return got.select(key, "r.*")


def hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """All hypothesis rows of hyp.shard_* with their order; a missing dataset is ''."""
    return json_in_order(spark, f"{folder}/hyp.shard_*", schemas.HYPOTHESIS).withColumn("dataset", F.coalesce("dataset", F.lit("")))


def hypotheses_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return last_wins(hypotheses(spark, folder), "utt_id")


def readable_rows(spark: SparkSession, path, schema: str, key: str) -> DataFrame:
    """The last row per key of a log that may end in the middle of a line: malformed lines are
    left out."""
    rows = json_in_order(spark, path, f"{schema}, _corrupt_record STRING").where(f"_corrupt_record is null and {key} is not null")
    return last_wins(rows.drop("_corrupt_record"), key)


def alignments(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Aligned rows, and the rows that hold an error instead."""
    rows = json_rows(spark, path, schemas.ALIGNMENT)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("audio", "error")


def source_names(name: Column) -> Column:
    """Cache folder and file prefix of a published dataset name."""
    low = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.struct(F.regexp_replace(name, "/", "___").alias("folder"), low.alias("prefix"))


def clip_id(id_: Column, path: Column, split: str, index: Column) -> Column:
    """The id, else the file's stem, else split#index."""
    s = stem_simple(path)
    return F.coalesce(F.when(id_ != "", id_), F.when(s != "", s), F.concat(F.lit(f"{split}#"), index.cast("string")))


def durations(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.DURATION).csv(path)


def problem_ids(spark: SparkSession, paths: list[str], reasons: list[str]) -> DataFrame:
    rows = spark.read.option("header", True).schema(schemas.PROBLEM).csv(paths)
    return rows.where(F.col("reason").isin(reasons)).select("id").distinct()


def conversion_rows(spark: SparkSession, root: str, min_dur: float) -> DataFrame:
    """Rows of <root>/<dialect>/metadata.jsonl, a file or a folder of parts, with their folder's dialect."""
    rows = spark.read.schema(schemas.CONVERSION).json(f"{root}/*/metadata.jsonl")
    return rows.withColumn("folder_dialect", F.regexp_extract("_metadata.file_path", "([^/]+)/metadata[.]jsonl(/[^/]*)?$", 1)).where(F.col("duration_s") >= min_dur)


def clips(spark: SparkSession, path, root: str, layout: str) -> DataFrame:
    """Clip metadata (a JSON array) with wav paths: layout 'flat' or 'split'."""
    rows = spark.read.option("multiLine", True).schema(schemas.CLIP + ", country STRING, split STRING").json(path)
    where = F.concat_ws("/", F.lit(root), "country", "id") if layout == "flat" else F.concat_ws("/", F.lit(root), "country", "split", "id")
    return rows.withColumn("wav_path", F.concat(where, F.lit(".wav"))).withColumn("prefix", F.substring("id", 1, 11))


def id_values(spark: SparkSession, path) -> DataFrame:
    """Lines '<id> <value>'; the value is trimmed, '' if there is none."""
    rows, parts = lines_in_order(spark, path), F.split("value", " ", 2)
    rows = rows.select(*ORDER, F.get(parts, F.lit(0)).alias("id"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("value"))
    return last_wins(rows, "id")


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of a folder's files at any depth, without those that Spark holds for hidden;
    contents are not read. root is a URI or path that every executor reaches.

    Runs when it is called and leaves its rows in the shared folder. Tasks list folders, level by level,
    so the driver holds no file; the files of one folder pass one task, a thousand at a time."""
    from . import scratch

    schema = "path string, bytes long, modified timestamp, folder boolean"
    level, out = spark.createDataFrame([(root if "://" in root else f"file://{root}",)], "path string"), None
    while True:
        at = scratch.folder(spark, "listed")
        level.mapInArrow(_listed, schema).write.parquet(at)
        found = spark.read.schema(schema).parquet(at)
        files = found.where("not folder and path is not null")
        out = files if out is None else out.unionByName(files)
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            break
        level = spread(folders, "path")
    matches = F.regexp_like(F.substring_index("path", "/", -1), F.lit(f"^{_java(pattern)}$"))
    return out.where(matches).select(F.regexp_replace("path", "^file://", "file:").alias("path"), "bytes", "modified")


def _java(pattern: str) -> str:
    """A name's pattern (* and ?) as a regular expression."""
    return "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else f"\\{c}") for c in pattern)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files and folders in each of the folders given."""
    from pyarrow.fs import FileSelector, FileType

    from .ordered import reached

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            where, base = reached(uri)
            found = where.get_file_info(FileSelector(base))
            for k in range(0, len(found), 1000):
                some = [f for f in found[k : k + 1000] if f.type in (FileType.File, FileType.Directory) and not _hidden(f.base_name)]
                columns = [[f"{uri}/{f.base_name}" for f in some], [f.size for f in some], [f.mtime for f in some], [f.type == FileType.Directory for f in some]]
                kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "bytes", "modified", "folder"])


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def measured(files: DataFrame) -> DataFrame:
    """Rows of inventory() with seconds, from the headers of WAV and FLAC files; -1 where one can't be
    read. Samples are not read, and tasks hold one header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.signal import header_seconds
        from .ordered import reached

        for batch in batches:
            made = []
            for uri in batch.column(0).to_pylist():
                where, at = reached(uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") else uri)
                with where.open_input_file(at) as f:
                    made.append(header_seconds(f))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, "seconds"])

    return spread(files, "path").mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("seconds", T.DoubleType())]))


def in_row_order(df: DataFrame) -> DataFrame:
    """Parquet rows with file and index, their stored order."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))


def numbered_rows(spark: SparkSession, path, columns: list[str], index: str = "index") -> DataFrame:
    """The columns of stored Parquet rows and their index, numbered from 0 over all files in the order of
    their names. Files are read in parts by any number of tasks: one small row a file tells how
    many rows lie before it. A missing column and an empty table are errors."""
    table = required(spark.read.parquet(path), columns)
    file = F.col("_metadata.file_path").alias("file")
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = table.select(file).groupBy("file").agg(F.count("*").alias("n")).select("file", before.alias("before"))
    rows = table.select(F.struct(*columns).alias("row"), file, F.col("_metadata.row_index").alias("at"))
    return rows.join(files, "file").select("row.*", (F.col("before") + F.col("at")).alias(index))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def training_rows(spark: SparkSession, paths, with_group: bool = True) -> DataFrame:
    """audio, target (text behind the mark) and, if asked for, the group."""
    from ..functions.text import after_first, group_of

    rows = json_rows(spark, paths, schemas.TRAINING + ", dataset STRING")
    group = [group_of([F.col("dialect"), F.col("dataset")], F.col("audio")).alias("dialect")] if with_group else []
    return rows.select("audio", after_first(F.col("text")).alias("target"), *group)


def config(settings: Mapping, name: str, splits: tuple[str, ...] = ("train",)) -> Mapping:
    """A named dataset's settings; other splits than training ones are refused."""
    got = settings[name]
    if bad := [s for s in got.get("splits", ()) if s not in splits]:
        raise ValueError(f"{name}: splits {bad} are not for training")
    return got


def existing(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Parquet rows of those paths that exist; an empty table if none does."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


#: Ways to name the corpora a build reads: folder, file prefix, where its id stands, names of splits.
SOURCES: dict[str, dict] = {
    "adi17": {"name": "ADI17", "id_key": "id", "splits": {"train": "train", "dev": "dev", "test": "test"}},
    "adi20": {"name": "ADI20", "id_key": None, "splits": {"train": "train", "dev": "validation", "test": "test"}},
}


def source(name: str, settings: Mapping | None = None) -> dict:
    """A corpus's entry of SOURCES with a run's settings over it; an unknown name is an error."""
    if name not in SOURCES:
        raise KeyError(f"{name} is none of {sorted(SOURCES)}")
    return SOURCES[name] | dict(settings or {})


def id_dialect(rows: DataFrame, entry: Mapping, split: str, label: str = "dialect", audio: str = "audio") -> DataFrame:
    """(ID, dialect) of a corpus's rows (label, audio path, index and its id column, if it has one);
    no sample is read."""
    own = F.col(entry["id_key"]) if entry.get("id_key") else F.lit(None).cast("string")
    return rows.select(clip_id(own, F.col(f"{audio}.path"), entry["splits"].get(split, split), F.col("index")).alias("ID"), F.col(label).alias("dialect"))


def adi17(rows: DataFrame, split: str = "train") -> DataFrame:
    return id_dialect(rows, source("adi17"), split)


def adi20(rows: DataFrame, split: str = "train") -> DataFrame:
    return id_dialect(rows, source("adi20"), split)


def embeddings(spark: SparkSession, matrix, meta) -> DataFrame:
    """(id, ..., embedding): rows of a matrix table (row, embedding) with the entry of the same place
    of a JSON array of metadata. Different numbers of rows are an error when the table is read."""
    whole = spark.read.text(meta, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<struct<id:string,dur:double,country:string>>").alias("all"))
    entries = whole.select(F.posexplode("all").alias("row", "m")).select("row", "m.*")
    met = spark.read.parquet(matrix).select("row", "embedding").join(entries, "row", "full_outer")
    guard = F.when(F.col("embedding").isNull() | F.col("id").isNull(), F.raise_error(F.lit("a matrix row or a metadata entry stands alone")).cast("boolean")).otherwise(True)
    return met.where(guard).select("id", "dur", "country", "embedding")


def bank(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The voices of a bank; none if there is nothing at path. A bank is one file with a JSON array, or
    (lines) the folder that sinks.write_bank makes: JSON lines in a folder per country, which is
    split among tasks and read by country."""
    from .scratch import exists

    schema = schemas.VOICE + ", country STRING" if lines else schemas.VOICE
    return spark.read.option("multiLine", not lines).schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def augmentation_table(spark: SparkSession, root: str, path: str, extension: str = "wav", largest: float | None = None) -> DataFrame:
    """(ID, duration, wav, wav_format) of a folder's files, written as CSV once: where the table is
    there already it is only read. Files longer than `largest` seconds are listed in parts of that
    length (start, stop). A folder without such files is an error."""
    from .scratch import exists

    schema = "ID STRING, duration DOUBLE, wav STRING, wav_format STRING, start DOUBLE, stop DOUBLE"
    if not exists(spark, path):
        found = inventory(spark, root, f"*.{extension}")
        if found.isEmpty():
            raise NoInput(f"{root}/*.{extension}")
        rows = measured(found).select("path", F.col("seconds").alias("all"))
        parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / largest).cast("int") - 1, F.lit(0))) if largest else F.array(F.lit(0))
        rows = rows.select("path", "all", F.explode(parts).alias("k"))
        start = F.col("k") * (largest or 0.0)
        stop = F.least(start + largest, F.col("all")) if largest else F.col("all")
        rows = rows.select(F.concat(stem_simple("path"), F.lit("_"), F.col("k").cast("string")).alias("ID"), F.round(stop - start, 6).alias("duration"), F.col("path").alias("wav"), F.lit(extension).alias("wav_format"), start.alias("start"), stop.alias("stop"))
        rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(schema).csv(path)


def cached_durations(spark: SparkSession, listed: DataFrame, clips_: DataFrame, audio: str, path: str) -> DataFrame:
    """(ID, duration) of a manifest's listed clips and of all others, which are measured from their
    headers once and kept as CSV; a clip that can't be measured is kept with -1 there and left out
    here. clips_ holds (ID, {bytes, path})."""
    from ..functions.signal import wav_seconds
    from .scratch import exists

    if not exists(spark, path):
        todo = clips_.join(listed.select("ID").distinct(), "ID", "left_anti")
        todo.select("ID", F.round(wav_seconds(F.col(f"{audio}.bytes")), 3).alias("duration")).write.option("header", True).csv(path)
    measured = spark.read.option("header", True).schema(schemas.DURATION).csv(path).where("duration > 0")
    return listed.select("ID", "duration").join(measured.select("ID"), "ID", "left_anti").unionByName(measured)
