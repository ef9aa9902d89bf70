"""A Spark data source of Arrow IPC cache files: spark.read.format("arrow_cache")."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from pathlib import PurePath
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads.
SPLIT_BYTES = 32 << 20
#: The entry of a batch's own metadata that holds the least and largest values of columns.
BOUNDS = b"bounds"
_MAGIC, _GOES_ON, _END = b"ARROW1", 0xFFFFFFFF, struct.pack("<Ii", 0xFFFFFFFF, 0)
SCHEMA, DICTIONARY, BATCH = 1, 2, 3


def cache_shards(names: list[str], dataset: str, split: str) -> list[str]:
    """Of file names those of <dataset>-<split>.arrow or <dataset>-<split>-*-of-*.arrow, sorted;
    derived cache-*.arrow files don't count."""
    want = re.compile(rf"{re.escape(dataset)}-{re.escape(split)}(-\d+-of-\d+)?\.arrow")
    return sorted(n for n in names if want.fullmatch(PurePath(n).name) and not PurePath(n).name.startswith("cache-"))


def bounds_of(batch: pa.RecordBatch) -> dict[bytes, bytes]:
    """A batch's metadata: least and largest value of its columns of numbers and texts, so that a
    reader can pass over the batch."""
    kinds = (pa.types.is_integer, pa.types.is_floating, pa.types.is_string)
    said = {f.name: list(pc.min_max(c).as_py().values()) for f, c in zip(batch.schema, batch.columns, strict=True) if any(k(f.type) for k in kinds)}
    return {BOUNDS: json.dumps({k: v for k, v in said.items() if v[0] is not None and v[0] == v[0]}).encode()}


class Message(NamedTuple):
    """One encapsulated message of a file: its kind, where it begins, its metadata, its body."""

    kind: int
    at: int
    head: bytes
    body_at: int
    body: int


def _field(raw: bytes, table: int, k: int) -> int | None:
    """Where field k of a flatbuffer table lies."""
    layout = table - struct.unpack_from("<i", raw, table)[0]
    if 4 + 2 * k >= struct.unpack_from("<H", raw, layout)[0]:
        return None
    at = struct.unpack_from("<H", raw, layout + 4 + 2 * k)[0]
    return table + at if at else None


def _follow(raw: bytes, at: int) -> int:
    return at + struct.unpack_from("<I", raw, at)[0]


def own_metadata(head: bytes) -> dict[bytes, bytes]:
    """The key-value pairs of a message, from its metadata alone."""
    pairs = _field(head, _follow(head, 0), 4)
    if pairs is None:
        return {}
    vector, out = _follow(head, pairs), {}

    def text(table: int, k: int) -> bytes:
        at = _field(head, table, k)
        if at is None:
            return b""
        at = _follow(head, at)
        return head[at + 4 : at + 4 + struct.unpack_from("<I", head, at)[0]]

    for k in range(struct.unpack_from("<I", head, vector)[0]):
        pair = _follow(head, vector + 4 + 4 * k)
        out[text(pair, 0)] = text(pair, 1)
    return out


def messages(f, stop: int | None = None) -> Iterator[Message]:
    """The messages of a stream or file that begin before `stop`, in order. Bodies are passed over."""
    f.seek(0)
    at = 8 if f.read(len(_MAGIC)) == _MAGIC else 0
    while stop is None or at < stop:
        f.seek(at)
        lead = f.read(8)
        if len(lead) < 4:
            return
        size, skip = struct.unpack_from("<I", lead)[0], 4
        if size == _GOES_ON:
            size, skip = struct.unpack_from("<I", lead, 4)[0] if len(lead) == 8 else 0, 8
        if size == 0:
            return
        f.seek(at + skip)
        head = bytes(f.read(size))
        if len(head) < size:
            raise OSError("an Arrow file ends within a message")
        table = _follow(head, 0)
        kind, body = _field(head, table, 1), _field(head, table, 3)
        body = struct.unpack_from("<q", head, body)[0] if body else 0
        yield Message(head[kind] if kind else 0, at, head, at + skip + size, body)
        at += skip + size + body


def _whole(f, m: Message) -> bytes:
    f.seek(m.body_at)
    return struct.pack("<II", _GOES_ON, len(m.head)) + m.head + (bytes(f.read(m.body)) if m.body else b"")


def batches(f, start: int = 0, stop: int | None = None, wanted=None) -> Iterator[pa.RecordBatch]:
    """The record batches that begin in [start, stop) of an open file. wanted() gets each one's
    bounds, if it has them; bodies of batches that it refuses aren't read."""
    lead = b""
    for m in messages(f, stop):
        if m.kind in (SCHEMA, DICTIONARY):
            lead += _whole(f, m)
        elif m.kind == BATCH and m.at >= start:
            if wanted and (said := own_metadata(m.head).get(BOUNDS)) and not wanted(json.loads(said)):
                continue
            yield ipc.open_stream(pa.py_buffer(lead + _whole(f, m) + _END)).read_next_batch()


def may_hold(test: ds.Filter, bounds: dict[str, list]) -> bool:
    """Could a row of a batch with these bounds pass the test? True where they don't tell."""
    column = getattr(test, "attribute", None)
    if not column or len(column) != 1 or column[0] not in bounds:
        return True
    least, most = bounds[column[0]]
    try:
        match test:
            case ds.EqualTo(value=v) | ds.EqualNullSafe(value=v):
                return v is None or least <= v <= most
            case ds.GreaterThan(value=v):
                return most > v
            case ds.GreaterThanOrEqual(value=v):
                return most >= v
            case ds.LessThan(value=v):
                return least < v
            case ds.LessThanOrEqual(value=v):
                return least <= v
            case ds.In(value=vs):
                return any(v is None or least <= v <= most for v in vs)
    except TypeError:
        pass
    return True


def opened(path: str):
    """An open file of a path or URI; one on the machine's own disk is mapped, not read."""
    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return pa.memory_map(inner) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(inner)


def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without dictionaries, which Spark doesn't read."""
    columns = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


class Reader(DataSourceReader):
    """A task reads the batches that begin in its bytes of a file; it finds them by passing over
    the metadata of those before."""

    def __init__(self, paths: list[str], columns: list[str], split_bytes: int):
        self.paths, self.columns, self.split_bytes, self.tests = paths, columns, split_bytes, []

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            size = where.get_file_info(inner).size
            out += [Split(path, at, min(at + self.split_bytes, size)) for at in range(0, size, self.split_bytes)]
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        wanted = (lambda bounds: all(may_hold(t, bounds) for t in self.tests)) if self.tests else None
        with opened(partition.path) as f:
            for b in batches(f, partition.start, partition.stop, wanted):
                yield plain(b.select(self.columns))


class FilteringReader(Reader):
    """A Reader that Spark tells its filters. They choose batches; Spark applies them to rows again."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        self.tests = list(filters)
        yield from filters


class ArrowCache(DataSource):
    """Options: paths (comma-separated shards), which the driver and every executor must be able to
    open; splitBytes; filters (true if the session pushes filters down to Python sources). Without
    a schema that of the first shard holds; only its columns are read. Register with
    spark.dataSource.register(ArrowCache), or use read_cache()."""

    @classmethod
    def name(cls):
        return "arrow_cache"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with opened(self.options["paths"].split(",")[0]) as f:
            first = next(m for m in messages(f) if m.kind == SCHEMA)
            return from_arrow_schema(ipc.open_stream(pa.py_buffer(_whole(f, first) + _END)).schema)

    def reader(self, schema):
        kind = FilteringReader if self.options.get("filters") == "true" else Reader
        return kind(self.options["paths"].split(","), schema.names, int(self.options.get("splitBytes", SPLIT_BYTES)))


def read_cache(spark: SparkSession, paths: list[str], schema=None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of cache files. Filters choose batches where the session lets Python sources have
    them (spark.sql.python.filterPushdown.enabled); no setting is changed."""
    spark.dataSource.register(ArrowCache)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    load = spark.read.format("arrow_cache").option("paths", ",".join(paths)).option("splitBytes", split_bytes).option("filters", pushes)
    return (load.schema(schema) if schema is not None else load).load()
