"""Token ids in files of fixed-width bits, with offsets of blocks for random access."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_text, materialize, release, shared_dir, table
from .packing import gpt_parts, tokenizer

MAGIC = b"IDBITS1\n"
#: Ids of a block (a multiple of 8, so blocks are whole bytes); ids and documents after which a new file begins.
BLOCK, FILE_IDS, FILE_DOCS = 1 << 14, 1 << 25, 1 << 20
#: width, ids of a block, ids, documents, blocks, place of the index.
TAIL = struct.Struct("<IIQQQQ8s")


def width_of(ids: int) -> int:
    """Bits that every id under `ids` fits into."""
    return max(1, (ids - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids one after the other, width bits each, low bits first; the last byte is filled up with 0.

    Eight ids take width bytes, and each of the eight begins at the same bit there: eight columns
    are laid into the bytes at once."""
    n = -(-len(ids) // 8)
    lanes = np.zeros((n, 8), dtype=np.uint64)
    lanes.ravel()[: len(ids)] = ids
    out = np.zeros((n, width), dtype=np.uint8)
    for lane in range(8):
        byte, bit = divmod(lane * width, 8)
        v = lanes[:, lane] << np.uint64(bit)
        for k in range(-(-(bit + width) // 8)):
            out[:, byte + k] |= (v >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    """The n ids of pack_bits()."""
    rows = -(-n // 8)
    data = np.zeros(rows * width, dtype=np.uint8)
    data[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    data = data.reshape(rows, width)
    out = np.empty((rows, 8), dtype=np.uint32)
    for lane in range(8):
        byte, bit = divmod(lane * width, 8)
        v = np.zeros(rows, dtype=np.uint64)
        for k in range(-(-(bit + width) // 8)):
            v |= data[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (v >> np.uint64(bit)) & np.uint64((1 << width) - 1)
    return out.ravel()[:n]


class Writer:
    """One file: magic, blocks, index (ids of documents, which of them are null, where each ends, where
    each block begins, each block's crc32), tail. Only an unfinished block and the index are held."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.doc_ids, self.ends, self.offsets, self.sums = [], [], [len(MAGIC)], []
        self.waiting, self.held, self.n = [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.waiting.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self.put(ids[at : at + self.block])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def put(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.width)
        self.out.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))
        self.sums.append(zlib.crc32(raw))

    def close(self) -> None:
        if self.held:
            self.put(np.concatenate(self.waiting))
        for values, kind in (([d or 0 for d in self.doc_ids], "<i8"), ([d is None for d in self.doc_ids], "u1"), (self.ends, "<u8"), (self.offsets, "<u8"), (self.sums, "<u4")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(TAIL.pack(self.width, self.block, self.n, len(self.ends), len(self.sums), self.offsets[-1], MAGIC))
        self.out.close()


class Reader:
    """Random access to a file of Writer, over an open seekable file. Blocks are checked as they are read."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < len(MAGIC) + TAIL.size:
            raise ValueError("not a file of token ids")
        source.seek(size - TAIL.size)
        self.width, self.block, self.n, docs, blocks, at, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        source.seek(at)
        take = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), dtype=kind)
        self.doc_ids, self.null = take("<i8", docs), take("u1", docs)
        self.ends, self.offsets, self.sums = (take(k, n).astype(np.int64) for k, n in (("<u8", docs), ("<u8", blocks + 1), ("<u4", blocks)))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last, last not included."""
        self.source.seek(int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last] - self.offsets[first]))
        at = (self.offsets[first : last + 1] - self.offsets[first]).tolist()
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if zlib.crc32(raw[a:b]) != self.sums[first + k]:
                raise ValueError(f"block {first + k} is damaged")
        return unpack_bits(raw, self.width, min(last * self.block, self.n) - first * self.block)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; reads the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first = start // self.block
        return self.blocks(first, -(-stop // self.block))[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def digests(self, at_once: int = 64) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, n, crc32 of its ids) of each document, blocks read in their order; no
        document is held whole."""
        k, start, crc, done = 0, 0, 0, 0
        for first in range(0, max(len(self.sums), 1), at_once):
            ids = self.blocks(first, min(first + at_once, len(self.sums))) if len(self.sums) else np.zeros(0, dtype=np.uint32)
            raw, base = memoryview(ids.astype("<u4").tobytes()), first * self.block
            while k < len(self.ends):
                end = int(self.ends[k])
                crc = zlib.crc32(raw[4 * (done - base) : 4 * (min(end, base + len(ids)) - base)], crc)
                done = min(end, base + len(ids))
                if done < end:
                    break
                yield None if self.null[k] else int(self.doc_ids[k]), start, end - start, crc
                k, start, crc = k + 1, end, 0


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, as tasks see it; a path without scheme is the machine's own."""
    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], vocabulary: int, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Encode whole documents and write their ids to files under folder, a URI that the driver and
    all executors reach. Gives the list of files: part, place, name, n_docs, n_ids; in the order of
    (part, place), the files hold the documents by ascending doc_id.

    Texts are dealt by ranges of doc_id, sorted by Spark (which spills) and encoded and written as
    a stream. A task writes files with names of their own and lists them when it ends, so what a failed
    or repeated attempt left is in no list. Null ids come first, equal ids in the order of a hash of
    the text, and null texts are empty ones."""
    width = width_of(vocabulary)
    schema = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), [], None
        tokens = encode()
        where, path = open_fs(folder)

        def finish() -> None:
            writer.close()
            made.append((part, len(made), name, len(writer.ends), writer.n))

        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for d, text in zip(ids, texts, strict=True):
                    if writer is None:
                        name = f"ids-{part:06d}-{uuid.uuid4().hex}.bits"
                        writer = Writer(where.open_output_stream(f"{path}/{name}"), width, block)
                    code = tokens(text)
                    if end_id is not None:
                        code.append(end_id)
                    writer.add(d, np.array(code, dtype=np.uint32))
                    if writer.n >= file_ids or len(writer.ends) >= FILE_DOCS:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        release()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    where, path = open_fs(folder)
    where.create_dir(path, recursive=True)
    rows = id_text(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return materialize(rows.mapInArrow(run, "part int, place int, name string, n_docs long, n_ids long"))


def read_ids(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files of write_ids().

    The driver adds up the files' lengths, one row for many megabytes of ids; every file is read by
    one task, block after block."""
    listed = sorted(files.collect(), key=lambda r: (r.part, r.place))
    before = np.cumsum([0, *(r.n_ids for r in listed)]).tolist()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = open_fs(folder)

        def give(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{path}/{name}") as source:
                    rows = []
                    for d, start, n, crc in Reader(source).digests():
                        rows.append((d, base + start, n, crc))
                        if len(rows) == 10_000:
                            yield give(rows)
                            rows = []
                    if rows:
                        yield give(rows)

    names = spark.createDataFrame([(r.name, b) for r, b in zip(listed, before, strict=False)], "name string, base long")
    return names.repartition(max(1, len(listed))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write whole documents' ids, each with the end id 0, at the vocabulary's width, and read the
    files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null texts count as empty (the end id alone); null ids come first; repeated rows are written each;
    an empty table makes no file and gives no rows; other columns, whatever their names, stay behind.
    The files are deleted when the session's JVM ends; write_ids() leaves them."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/corpusframe-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    files = write_ids(docs, lambda: tokenizer(path, pattern), vocabulary(path), folder, 0, id_col, text_col)
    return read_ids(spark, files, folder)


def vocabulary(path: str) -> int:
    """One more than the largest id of a tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    return 1 + max([*said["model"]["vocab"].values(), *(t["id"] for t in said["added_tokens"])])


def op12_token_bits(spark, sf_dir: str) -> DataFrame:
    return written_ids(table(spark, sf_dir, "documents"), *gpt_parts())
