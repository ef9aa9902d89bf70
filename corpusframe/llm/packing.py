"""Best-fit packing of documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts, materialize, table
from .token_count import shown_bytes

SEQ_LEN = 2048
#: Pieces that one group packs; groups are dealt by a hash, so more documents make more groups.
GROUP_PIECES = 8192


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each size.

    Sizes go in from the largest. Each is placed in the open bin that takes it where the sum
    over gaps of (number of open bins with that gap)^2 becomes smallest; ties take the smallest
    gap, and of bins with that gap the one that got it last. A bin is opened only where no open
    one takes the size."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    open_: dict[int, list[int]] = {}
    where = np.empty(len(sizes), dtype=np.int64)
    bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        gaps = np.flatnonzero(n[s:capacity]) + s
        if len(gaps):
            rise = 1 - 2 * n[gaps] + np.where(gaps > s, 2 * n[gaps - s] + 1, 0)
            gap = int(gaps[np.argmin(rise)])
            b = open_[gap].pop()
            n[gap] -= 1
        else:
            gap, b, bins = capacity, bins, bins + 1
        where[i] = b
        if gap > s:
            n[gap - s] += 1
            open_.setdefault(gap - s, []).append(b)
    return where


def tokenizer(path: str, pattern: str):
    """Ids of a text as the tokenizers library has them for a byte-level BPE file, special strings
    inside it as their single ids. The file's vocabulary is run by tiktoken, which gives the same ids
    in a fifth of the time; its merges must be in the order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocab = said["model"]["vocab"]
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in said["model"]["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: merges are not in the order of their ids")
    value = {s: b for b, s in enumerate(shown_bytes())}
    ranks = {bytes(value[c] for c in token): i for token, i in vocab.items() if token not in special}
    coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return coding.encode(text, allowed_special="all")
        return coding.encode_ordinary(text)

    return encode


def cut(docs: DataFrame, path: str, pattern: str, capacity: int = SEQ_LEN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32. A document is its text's ids and end_id;
    one longer than capacity is cut so that all pieces but the first are full."""

    def make():
        encode = tokenizer(path, pattern)

        def work(ids: list, texts: list[str]) -> list:
            out: list[list] = [[], [], [], [], []]
            for d, text in zip(ids, texts, strict=True):
                code = encode(text)
                code.append(end_id)
                raw = struct.pack(f"<{len(code)}I", *code)
                first = (len(code) - 1) % capacity + 1
                edges = [0, *range(first, len(code) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for c, v in zip(out, (d, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                        c.append(v)
            return out

        return work

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    return map_texts(id_text(docs, id_col, text_col), make, pa.schema(fields), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = SEQ_LEN, group: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset: no two overlap, no sequence exceeds capacity.

    Full pieces take a sequence of their own without a shuffle. The others are dealt by a hash
    of (doc_id, piece, start) into groups of about `group` pieces, however many there are, and
    each group is packed by itself; only 40 bytes a piece shuffle. More groups cost at most a
    part of a sequence each."""
    full = pieces.where(F.col("length") >= capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sizes = t["length"].to_numpy()
        where = sum_of_squares(sizes, capacity)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.r_[True, where[order][1:] != where[order][:-1]])
        base = np.repeat((ends - sizes[order])[first], np.diff(np.r_[first, len(order)]))
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = ends - sizes[order] - base
        seq = (t["g"][0].as_py() << 32) + where
        return t.drop_columns(["g"]).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    packed = dealt.groupBy("g").applyInArrow(run, f"{kinds}, sequence_id long, offset long")
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = SEQ_LEN, group: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. The cut pieces are written once, so texts are encoded once.

    Null texts count as empty: a piece of one id. Texts of any length are encoded whole. Repeated
    rows are packed each; an empty table gives no rows; ties of size go by doc_id and piece; other
    columns, whatever their names, stay behind."""
    return pack(materialize(cut(docs, path, pattern, capacity, 0, id_col, text_col)), capacity, group)


def gpt_parts() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *gpt_parts())
