"""What the operators of this subpackage share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds as lists of words at once, and rows that go to it
#: in one message.
CHUNK_CHARS, BATCH_ROWS = 1_000_000, 1000
#: Rows of at most 64 bytes that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Texts go to Python in messages of BATCH_ROWS rows: with Spark's usual
    10,000 long ones would fill an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it. Only a local session, where
    everything is one machine, may do without; it gets a temporary one (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (own := sc.getCheckpointDir()):
        named = own
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpusframe-")
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage there. by: a column whose
    values get folders of their own, so that a filter on it reads these only.

    The files go with discard(), at the latest when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusframe-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path, partitionBy=by)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    back = spark.read.schema(df.schema).parquet(path)
    back.corpusframe_path = path
    return back


def discard(*made: DataFrame) -> None:
    """Delete tables of materialize() that no plan to come reads any more."""
    for df in made:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.corpusframe_path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan needs any more; it does so when the driver
    collects its garbage, which may not happen for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast when its counted rows are within the bound, else left to a shuffle."""
    return F.broadcast(df) if rows <= bound else df


def release() -> None:
    """Hand memory that a finished part has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, null text as empty; other columns, whatever their names, stay behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def chunks(ids: list, texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Split a batch so that each part has limit characters at most, or one text."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield ids[at:i], texts[at:i]
            at, held = i, 0
        held += len(text)
    if at < len(ids):
        yield ids[at:], texts[at:]


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list, list[str]], list]], schema: pa.Schema, spark_schema: str, limit: int = CHUNK_CHARS
) -> DataFrame:
    """Run make()'s function over (ids, texts) parts of df's first two columns; it returns
    one list or array per column of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            if not batch.num_rows:
                continue
            work = work or make()
            ids, texts = batch.column(0), batch.column(1)
            for i, t in chunks(ids.to_pylist(), texts.to_pylist(), limit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(work(i, t), schema, strict=True)], schema=schema
                )
        work = None
        release()

    return df.mapInArrow(run, spark_schema)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, for which make()'s function over texts says True.
    Null texts count as empty. Nothing shuffles."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = None
        for batch in batches:
            decide = decide or make()
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = [k for _, part in chunks(texts, texts) for k in decide(part)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        decide = None
        release()

    return docs.mapInArrow(run, docs.schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that df has no column of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """docs without the rows whose `on` columns are in gone: a broadcast of gone while its counted
    rows are within the bound, else a shuffle of both sides."""
    n = gone.count()
    return docs.join(small(gone, n), on, "left_anti") if n else docs


def crc_mod(id_col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
