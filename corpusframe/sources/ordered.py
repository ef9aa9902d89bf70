"""Single files with lines in order, and ZIP archives of them, made by tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Bytes that the driver holds while it copies a part.
CHUNK = 1 << 20
_POLYNOMIAL, _ONE = 0xEDB88320, 1 << 31


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, the lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def combined_crc(first: int, second: int, n: int) -> int:
    """The CRC-32 of two texts one after the other, from theirs and the second one's n bytes."""
    shift, power, bits = _ONE, _ONE >> 1, 8 * n
    while bits:
        if bits & 1:
            shift = _times(shift, power)
        power, bits = _times(power, power), bits >> 1
    return _times(shift, first) ^ second


def reached(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_parts(rows: DataFrame, order: list[str], files: dict[str, str], folder: str) -> list[dict]:
    """Sorted parts of several files, under folder. files: the column with each file's lines. Gives,
    part by part in order, the bytes, CRC-32 and deflated bytes of each file: one small row a part.

    Spark sorts (and spills); a task writes its lines as they come, plain and as a piece of a deflate
    stream that another piece can follow."""
    names = list(files)
    kinds = ", ".join(["part int", "name string", "file string", "bytes long", "crc long", "deflated long"])
    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("file", pa.string()), ("bytes", pa.int64()), ("crc", pa.int64()), ("deflated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, own = task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}"
        where, base = reached(folder)
        out: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for k, n in enumerate(names):
                if n not in out:
                    path = f"{base}/{k}-{own}"
                    out[n] = [where.open_output_stream(path), where.open_output_stream(f"{path}.z"), zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, 0]
                plain, packed, press, size, crc, deflated = out[n]
                raw = "".join(f"{line}\n" for line in batch.column(k).to_pylist()).encode()
                some = press.compress(raw)
                plain.write(raw)
                packed.write(some)
                out[n][3:] = [size + len(raw), zlib.crc32(raw, crc), deflated + len(some)]
        made = []
        for k, (n, (plain, packed, press, size, crc, deflated)) in enumerate(out.items()):
            rest = press.flush(zlib.Z_FULL_FLUSH)
            packed.write(rest)
            plain.close()
            packed.close()
            made.append((part, n, f"{k}-{own}", size, crc, deflated + len(rest)))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    where, base = reached(folder)
    where.create_dir(base, recursive=True)
    keys = [F.col(f"__o{k}") for k in range(len(order))]
    lines = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__l{k}") for k, c in enumerate(files.values())], *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    done = lines.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, kinds)
    return sorted((r.asDict() for r in done.collect()), key=lambda r: (r["part"], names.index(r["name"])))


def join_parts(rows: DataFrame, parts: list[str], target: str, lead: bytes = b"") -> None:
    """One file of parts one after the other: HDFS's own concatenation if nothing leads, else a copy
    in which the driver holds a megabyte."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop.delete(path(target), False)
    if parts and not lead and hadoop.getScheme() == "hdfs":
        hadoop.create(path(target)).close()
        sources = spark.sparkContext._gateway.new_array(path, len(parts))
        for k, p in enumerate(parts):
            sources[k] = path(p)
        hadoop.concat(path(target), sources)
        return
    where, inner = reached(target)
    with where.open_output_stream(inner) as out:
        out.write(lead)
        for p in parts:
            copied(p, out)


def copied(part: str, out) -> None:
    where, inner = reached(part)
    with where.open_input_stream(inner) as f:
        while some := f.read(CHUNK):
            out.write(some)


def write_zip(parts: list[dict], names: list[str], folder: str, target: str, leads: dict[str, bytes] | None = None) -> None:
    """An archive of the named files at its root, from the deflated pieces of write_parts(): the
    pieces follow one another, sizes and checksums are combined, nothing is packed again. Sizes are
    written in 64 bits where they need them."""
    where, inner = reached(target)
    index, at = b"", 0
    with where.open_output_stream(inner) as out:
        for name in names:
            mine = [p for p in parts if p["name"] == name]
            press = zlib.compressobj(6, zlib.DEFLATED, -15)
            lead = (leads or {}).get(name, b"")
            first = press.compress(lead) + press.flush(zlib.Z_FULL_FLUSH) if lead else b""
            crc, size, packed = zlib.crc32(lead), len(lead), len(first) + 2
            for p in mine:
                crc, size, packed = combined_crc(crc, p["crc"], p["bytes"]), size + p["bytes"], packed + p["deflated"]
            raw = name.encode()
            large = max(size, packed, at) >= 0xFFFFFFFF
            small = lambda v: 0xFFFFFFFF if large else v  # noqa: E731, B023
            extra = struct.pack("<HHQQ", 1, 16, size, packed) if large else b""
            common = struct.pack("<HHHHHIIIHH", 45 if large else 20, 0x800, 8, 0, 0x21, crc, small(packed), small(size), len(raw), len(extra))
            out.write(b"PK\x03\x04" + common + raw + extra)
            out.write(first)
            for p in mine:
                copied(f"{folder}/{p['file']}.z", out)
            out.write(b"\x03\x00")  # an empty last block ends the stream
            more = struct.pack("<HHQQQ", 1, 24, size, packed, at) if large else b""
            index += b"PK\x01\x02" + struct.pack("<H", 45) + common[:-2] + struct.pack("<HHHHII", len(more), 0, 0, 0, 0, small(at)) + raw + more
            at += 30 + len(raw) + len(extra) + packed
        out.write(index)
        n = len(names)
        if at >= 0xFFFFFFFF or n >= 0xFFFF:
            out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(index), at))
            out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(index), 1))
        out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(index), 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))


def write_ordered(rows: DataFrame, order: list[str], files: dict[str, str], path: str, headers: dict[str, str] | None = None, archives: dict[str, list[str]] | None = None) -> None:
    """Single files under path, their lines in order (columns, ascending), each after its header line, and
    archives of them. The driver holds a row for each part and a megabyte of a copy, however many
    lines there are. Null lines are empty ones; without rows a file has its header only."""
    folder = scratch.folder(rows.sparkSession, "parts")
    parts = write_parts(rows, order, files, folder)
    where, base = reached(path)
    where.create_dir(base, recursive=True)
    leads = {n: f"{h}\n".encode() for n, h in (headers or {}).items()}
    for name, held in (archives or {}).items():
        write_zip(parts, held, folder, f"{path}/{name}", leads)
    for name in files:
        join_parts(rows, [f"{folder}/{p['file']}" for p in parts if p["name"] == name], f"{path}/{name}", leads.get(name, b""))
