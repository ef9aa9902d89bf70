"""Near duplicates by word-shingle Jaccard similarity: a parity-sketch join.

Every document is the set of its shingle hashes, seen as bits of a sketch in which a bit set
twice is cleared again (parity). The Hamming distance of two sketches is at most the symmetric
difference D of the sets, and similarity 4/5 needs D <= (a + b) / 9 for sets of a and b members.

1. Pass over the texts: size, two 64-bit fingerprints of the set and a folded 1024-bit sketch of
   each document, and a count of all shingles in 2^22 cells (4 MB, whatever the input; a task's
   share of a cell counts to 255, which is enough to tell rare from common). Documents
   with equal sets are one class; only its smallest id goes on.
2. Pass over the texts: per size band [2^k, 2^(k+1)) the sketch is cut into 2^k slices (2^16 for
   sets under 64); a slice is held as the XOR of its bits' 64-bit codes. By the pigeonhole principle two similar documents
   agree in one of the first D + 1 occupied slices of each, in any order fixed for all; here
   slices of rarely counted shingles come first. Smaller documents also take part in the next band
   when a partner can be there.
3. Slices that several documents share are found by an aggregation of minima (pre-aggregated, so
   a slice of a third of all rows is one row a task). Each document is checked
   against the most central document of its slices that shares most of them with it: by folded
   sketches first, then exactly.
4. Slices whose documents still lie in several components: those of few documents give their pairs,
   tested by folded sketches, then exactly. Larger ones are refined: their documents are joined on
   one-sided prefixes (at most a - 4(a + b)/9 members of the smaller set are missing from the
   larger), per pair of narrow size bands, rarely counted shingles first; folded sketches, then
   the exact check follow. Every similar pair of different components is met here.
5. Components of the links; classes pass theirs on to their copies.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, chunks, discard, fresh, id_text, map_texts, materialize, reclaim, release, small, table, without
from .components import components
from .shingles import mix, shingle_sets

CELLS, PARTS = 1 << 22, 64
FOLDED = 1024
#: Partial counts that one task adds up at a time.
FAN = 32
#: Ratio of the narrow size bands of step 4.
NARROW = 1.1
#: Bits that tell the second reading which slices are shared: 16 MB at most.
SHARED_BITS = 1 << 27
#: Slices of at most so many documents give their pairs directly in step 4; larger ones are refined.
FEW = 24
#: Characters of text that are hashed at once; a hundred bytes of memory a character.
CHARS = 400_000
_U = np.uint64


def fold(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((s >> _U(40)).astype(np.int64) % FOLDED, minlength=FOLDED) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    f1 = [mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) for s in sets]
    f2 = [np.bitwise_xor.reduce(mix(s + _U(0x14057B7EF767814F)), initial=_U(0)) for s in sets]
    return np.array(f1, dtype=_U), np.array(f2, dtype=_U)


def nodes(ids: list, sets: list[np.ndarray], f1: np.ndarray, f2: np.ndarray) -> pa.Array:
    """A 64-bit hash of each id with its set; null for null ids. It names a text whose id has others."""
    known = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(_U)
    n = np.array([len(s) for s in sets], dtype=_U)
    made = mix(mix(mix(f1 + n) ^ f2) ^ known).view(np.int64)
    return pa.array(made, mask=np.array([i is None for i in ids], dtype=bool))


def describe(docs: DataFrame) -> DataFrame:
    """Rows of two kinds in one reading: of each document (doc_id, n, f1, f2, sketch, node), and of each
    task its shingle counts (task, part, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("node", pa.int64()), ("task", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        cells = np.zeros(CELLS, dtype=np.uint8)
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHARS):
                sets = shingle_sets(texts)
                at, n = np.unique((np.concatenate(sets) % _U(CELLS)).astype(np.int64), return_counts=True)
                cells[at] = np.minimum(cells[at] + n, 255)
                f1, f2 = fingerprints(sets)
                none = [None] * len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((ids, [len(s) for s in sets], f1.view(np.int64), f2.view(np.int64), [fold(s) for s in sets], nodes(ids, sets, f1, f2), none, none, none), schema, strict=True)], schema=schema)
        if cells.any():
            packed = [zlib.compress(c.tobytes(), 1) for c in cells.reshape(PARTS, -1)]
            del cells
            none, task = [None] * PARTS, [TaskContext.get().partitionId()] * PARTS
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((none, none, none, none, none, none, task, list(range(PARTS)), packed), schema, strict=True)], schema=schema)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch array<long>, node long, task int, part int, counts binary")


def levels(described: DataFrame) -> np.ndarray:
    """Twice the log2 of the count of each cell over all tasks: CELLS bytes. Counts of FAN tasks are
    added at a time, then sums of those, so that no task holds those of all."""
    size = CELLS // PARTS

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype=np.uint64)
        for c in t["counts"].to_pylist():
            raw = zlib.decompress(c)
            total += np.frombuffer(raw, dtype=np.uint8 if len(raw) == size else np.uint64)
        return pa.table({"task": t["task"][:1], "part": t["part"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = described.where("part is not null").select("task", "part", "counts")
    tasks, steps = (rows.agg(F.max("task")).first()[0] or 0) + 1, 0
    while tasks > 1 or not steps:
        rows = rows.withColumn("task", F.expr(f"task div {FAN}").cast("int")).groupBy("task", "part").applyInArrow(add, "task int, part int, counts binary")
        tasks, steps = -(-tasks // FAN), steps + 1
    out = np.zeros((PARTS, size), dtype=np.uint8)
    for r in rows.select("part", "counts").collect():
        out[r.part] = 2 * np.log2(np.frombuffer(zlib.decompress(r.counts), dtype=np.uint64) + 1.0)
    return out.reshape(-1)


def cut_bits(band: int) -> int:
    """Slices that a sketch of a size band is cut into, as a power of two. Small sets get many: were
    all of a set's few shingles to fall in one slice with one that another lacks, the two would agree
    in none; the odds of that are those of equal 64-bit hashes."""
    return band if band >= 6 else 16


def slices(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Keys of the slices that a set takes part with, one array for all its bands."""
    n = len(s)
    k = n.bit_length() - 1
    need = (n + 5 * n // 4) // 9 + 1
    rare = level[(s % _U(CELLS)).astype(np.int64)]
    out = []
    for band in (k, k + 1) if 5 * n // 4 >= 1 << k + 1 else (k,):
        at = (s >> _U(20)) % _U(1 << cut_bits(band))
        by = np.argsort(at, kind="stable")
        at, code = at[by], s[by]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        key = mix(np.bitwise_xor.reduceat(code, first) ^ mix(at[first] + _U(band << 40)))
        order = np.minimum.reduceat(rare[by], first)
        out.append(key[np.lexsort((key, order))[:need]] if len(key) > need else key)
    return np.concatenate(out)


def narrow(n: int) -> int:
    """The narrow band of a size."""
    return int(math.log(n) / math.log(NARROW) + 1e-9)


def prefixes(s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of step 4 and their places: for each narrow band that a partner may be of, a prefix."""
    n = len(s)
    s = s[np.lexsort((s, level[(s % _U(CELLS)).astype(np.int64)]))]
    mine, out, places = narrow(n), [s[:0]], [np.zeros(0, np.int32)]
    for other in range(narrow(max(1, -(-4 * n // 5))), narrow(5 * n // 4) + 1):
        # the smallest size of that band; a partner of at least it shares 4/9 of both sizes
        least = max(-(-4 * n // 5), math.ceil(NARROW**other - 1e-6))
        while least > 1 and narrow(least - 1) == other and 5 * (least - 1) >= 4 * n:
            least -= 1
        if other == mine:
            least = min(least, n)
        take = n - -(-4 * (n + least) // 9) + 1
        if take > 0:
            lo, hi = sorted((mine, other))
            out.append(mix(s[:take] ^ mix(np.array([lo << 20 | hi], dtype=_U))))
            places.append(np.arange(take, dtype=np.int32))
    return np.concatenate(out), np.concatenate(places)


def keyed(docs: DataFrame, level: np.ndarray, make) -> DataFrame:
    """(doc_id, keys, places): make(set, level) of every document as arrays; places may be absent."""
    held = docs.sparkSession.sparkContext.broadcast(level)

    def work():
        def run(ids: list, texts: list[str]) -> list:
            made = [make(s, held.value) if len(s) else s for s in shingle_sets(texts)]
            two = [m if isinstance(m, tuple) else (m, None) for m in made]
            return [ids, [k.view(np.int64) for k, _ in two], [p for _, p in two]]

        return run

    fields = [("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]
    return map_texts(docs.select("doc_id", "text"), work, pa.schema(fields), "doc_id long, keys array<long>, places array<int>", CHARS)


def shared_only(keys: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(key, doc_id, place) of the keys that may be in shared: a bitmap of their hashes, up to 16 MB,
    leaves out nearly all others before the shuffle, as far as it is not full."""
    bits = min(SHARED_BITS, 1 << max(15, math.ceil(math.log2(max(1, n) * 16))))
    at = F.pmod(F.col("key"), F.lit(bits)) + 1  # buckets count positions from 1
    got = shared.select(at.alias("p")).select(F.bitmap_bucket_number("p").alias("b"), F.bitmap_bit_position("p").alias("i")).groupBy("b").agg(F.bitmap_construct_agg("i").alias("m")).collect()
    filter_ = np.zeros(bits // 8, dtype=np.uint8)
    for r in got:
        filter_.reshape(-1, len(r.m))[r.b - 1] = np.frombuffer(bytes(r.m), dtype=np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat = np.asarray(lists.flatten())
            ids = np.repeat(np.asarray(b.column(0)), np.diff(np.asarray(lists.offsets)))
            p = (flat.view(_U) % _U(bits)).astype(np.int64)
            hit = held.value[p >> 3] >> (p & 7) & 1 == 1
            place = np.asarray(b.column(2).flatten())
            place = place[hit] if len(place) else np.zeros(int(hit.sum()), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), pa.array(ids[hit]), pa.array(place)], names=["key", "doc_id", "place"])
        release()

    return keys.select("doc_id", "keys", "places").mapInArrow(run, "key long, doc_id long, place int")


def with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """wanted (doc_id, other) with the document's set as bytes."""

    def run(batches):
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            for part, texts in chunks(rows, b.column(1).to_pylist(), CHARS):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["doc_id", "other", "members"])
        release()

    return docs.join(small(wanted, n), "doc_id").select("doc_id", "text", "other").mapInArrow(run, "doc_id long, other long, members binary")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: 100 * intersection >= 80 * union of their sets."""
    pairs = materialize(pairs.select("a", "b"))
    n = pairs.count()
    left = with_sets(docs, pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("other")), n)
    ends = materialize(pairs.select(F.col("b").alias("doc_id")).distinct().withColumn("other", F.lit(0).cast("long")))
    right = with_sets(docs, ends, ends.count())
    both = left.select(F.col("doc_id").alias("a"), F.col("other").alias("b"), F.col("members").alias("x")).join(right.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                inter = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                if inter and 100 * inter >= 80 * (len(p) + len(q) - inter):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])
        release()

    found = materialize(both.mapInArrow(run, "a long, b long"))
    discard(pairs, ends)
    return found


def close(pairs: DataFrame, meta: DataFrame, n_meta: int) -> DataFrame:
    """Pairs whose sizes and folded sketches allow similarity."""
    side = lambda c: small(meta.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), n_meta, BROADCAST_ROWS // 10)
    far = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").where(far * 9 <= F.col("n_a") + F.col("n_b"))


def with_nodes(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """df with the node of each row's id (a long) and text."""
    at, text_at = df.columns.index(id_col), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(at).to_pylist(), [t or "" for t in batch.column(text_at).to_pylist()]
            made = []
            for i, t in chunks(ids, texts, CHARS):
                sets = shingle_sets(t)
                made.append(nodes(i, sets, *fingerprints(sets)))
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(made)], names=[*batch.schema.names, name])
        release()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def linked(base: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Of (doc_id, text): the rows (doc_id, node, n); ids that have several sets, or None; and the
    components (id, component) over nodes, of nodes that are not their component's name. A node is
    the id, or a hash of id and set where an id has several of them: each text is then compared
    by itself."""
    described = materialize(describe(base))
    meta = described.where("part is null").select("doc_id", "n", "f1", "f2", "sketch", "node")
    level = levels(described)
    several = meta.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    several = materialize(several.select("doc_id"))
    n_several = several.count()
    named = base.where("doc_id is not null")
    if n_several:
        told = small(several, n_several)
        parts = materialize(with_nodes(named.join(told, "doc_id", "left_semi").select("doc_id", "text"), "doc_id", "text", "node"))
        named = named.join(told, "doc_id", "left_anti").unionByName(parts.select(F.col("node").alias("doc_id"), "text"))
        marked = several.withColumn("several", F.lit(True))
        meta = meta.join(small(marked, n_several), "doc_id", "left").withColumn("node", F.when(F.col("several"), F.col("node")).otherwise(F.col("doc_id")))
    else:
        meta = meta.withColumn("node", F.col("doc_id"))
    rows = meta.select("doc_id", "node", "n")
    meta = meta.select(F.col("node").alias("doc_id"), "n", "f1", "f2", "sketch")
    return rows, several if n_several else None, node_components(base.sparkSession, named, meta, level)


def node_components(spark: SparkSession, named: DataFrame, meta: DataFrame, level: np.ndarray) -> DataFrame:
    """(id, component) of texts (doc_id, text) and their descriptions, where the two differ."""
    classes = meta.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = materialize(classes.where("size > 1").select("n", "f1", "f2", "rep"))
    copies = meta.where("n > 0").select("doc_id", "n", "f1", "f2").join(small(classes, classes.count()), ["n", "f1", "f2"]).where("doc_id <> rep")
    copies = materialize(copies.select("doc_id", "rep"))
    n_copies = copies.count()
    alone = named.join(small(copies.select("doc_id"), n_copies), "doc_id", "left_anti") if n_copies else named

    keys = materialize(keyed(alone, level, slices))
    reclaim(spark)
    each = keys.select("doc_id", F.explode("keys").alias("key"))
    shared = materialize(each.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"))
    n_shared = shared.count()
    reclaim(spark)
    members = materialize(shared_only(keys, shared, n_shared).join(small(shared, n_shared), "key").select("key", "doc_id"))
    discard(keys, shared)
    # the centre of a slice: the document with most shared slices, as the text that others were
    # copied from has, however its id compares
    degree = materialize(members.groupBy("doc_id").agg(F.count("*").alias("d")))
    centre = members.join(small(degree, degree.count()), "doc_id").groupBy("key").agg(F.max(F.struct("d", (-F.col("doc_id")).alias("i"))).alias("m"))
    starred = members.join(centre.select("key", (-F.col("m.i")).alias("a")), "key").where("doc_id <> a")
    stars = starred.groupBy("doc_id", "a").agg(F.count("*").alias("hits")).withColumnRenamed("doc_id", "b")
    reps = degree.select("doc_id")
    sketches = materialize(meta.join(small(reps, reps.count()), "doc_id", "left_semi").select("doc_id", "n", "sketch").dropDuplicates(["doc_id"]))
    n_sketches = sketches.count()
    best = close(stars, sketches, n_sketches).groupBy("b").agg(F.max(F.struct("hits", -F.col("a"))).alias("m")).select("b", (-F.col("m.col2")).alias("a"))
    links = verified(alone, best.select(F.col("b").alias("a"), F.col("a").alias("b")))

    reclaim(spark)
    # documents of slices that lie in more than one component so far
    found = materialize(components(links))
    comp = reps.join(small(found.withColumnRenamed("id", "doc_id"), found.count()), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
    comp = materialize(comp)
    marked = members.select("key", "doc_id").join(small(comp, n_sketches), "doc_id")
    mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    mixed = materialize(mixed)
    few, many = mixed.where(F.col("n") <= FEW).select("key"), mixed.where(F.col("n") > FEW).select("key")
    some = materialize(marked.join(small(few, few.count()), "key"))
    other = some.select("key", F.col("doc_id").alias("b"), F.col("c").alias("d"))
    pairs = some.withColumnRenamed("doc_id", "a").join(other, "key").where("a < b and c <> d").select("a", "b").distinct()
    links = links.unionByName(verified(alone, close(pairs, sketches, n_sketches)))
    open_ = materialize(members.select("key", "doc_id").join(small(many, many.count()), "key", "left_semi").select("doc_id").distinct())
    n_open = open_.count()
    if n_open:
        texts = alone.join(small(open_, n_open), "doc_id", "left_semi")
        fine = materialize(keyed(texts, level, prefixes))
        fine_each = fine.select("doc_id", F.explode("keys").alias("key")).join(small(comp, n_sketches), "doc_id")
        several = materialize(fine_each.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
        n_several = several.count()
        picked = shared_only(fine, several, n_several).join(small(several, n_several), "key", "left_semi").join(small(comp, n_sketches), "doc_id")
        picked = picked.join(small(sketches.select("doc_id", "n"), n_sketches), "doc_id")
        picked = materialize(picked.select("key", "doc_id", "c", "n", "place"))
        discard(fine, several)
        other = picked.select("key", F.col("doc_id").alias("b"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("place").alias("q"))
        # a band's prefix is for its smallest size: with both sizes known it is shorter
        fit = "place <= n - (4 * (n + m) + 8) div 9 and q <= m - (4 * (n + m) + 8) div 9"
        pairs = picked.withColumnRenamed("doc_id", "a").join(other, "key").where(f"a < b and c <> d and {fit}").select("a", "b").distinct()
        links = links.unionByName(verified(alone, close(pairs, sketches, n_sketches)))

    whole = components(links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return materialize(whole.where("id <> component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= 80 * union of their sets of 5-word shingles
    (A-Z lower-cased; fewer words: the whole sequence as one shingle). component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have no shingles, link with
    nothing and are their own component. Rows repeated with id and text give repeated results.
    Where one id has several texts each row has its own size and is compared by itself, but the id
    is one document: its rows share a component, with whatever any of them links with. Null ids are
    compared with nothing. An empty table gives no rows; other columns, whatever their names, stay
    behind."""
    rows, several, whole = linked(id_text(docs, id_col, text_col))
    if several is None:
        found = small(whole.withColumnRenamed("id", "node"), whole.count())
        return rows.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    same = rows.join(small(several, several.count()), "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    folded = materialize(components(whole.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(same)))
    held = rows.join(small(folded.withColumnRenamed("id", "node"), folded.count()), "node", "left")
    names = materialize(held.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")))
    out = held.join(small(names, names.count()), "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns whatever their names, one document of each component: that of the
    smallest id. Rows without an id and those without shingles stay; rows repeated with id and text
    stay or go together; of an id with several texts each is judged by itself; an empty table stays
    empty."""
    id_, node = fresh(docs, "id", "node")
    rows, several, whole = linked(id_text(docs, id_col, text_col))
    docs_ = docs.withColumn(id_, F.col(id_col).cast("long"))
    if several is None:
        return without(docs_, whole.select(F.col("id").alias(id_)), [id_]).select(*docs.columns)
    members = whole.unionByName(whole.select(F.col("component").alias("id"), "component").distinct())
    owned = materialize(rows.distinct().join(members, F.col("node") == F.col("id")).select("doc_id", "node", "component"))
    best = owned.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    gone = materialize(owned.join(best, "component").where("node <> best.node").select(F.col("node").alias(node)))
    told = small(several.withColumnRenamed("doc_id", id_), several.count())
    keyed_ = docs_.join(told, id_, "left_anti").select(*docs.columns, id_).withColumn(node, F.col(id_))
    apart = docs_.join(told, id_, "left_semi").select(*docs.columns, id_)
    return without(keyed_.unionByName(with_nodes(apart, id_, text_col, node)), gone, [node]).select(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * i >= 80 * (u.n + v.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id) USING (doc_id)
"""
