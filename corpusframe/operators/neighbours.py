"""Nearest neighbours of a stated, growing query set: exact, with pivots and the triangle inequality.

Vectors have unit length, so that a larger cosine is a smaller distance. A few pivots are chosen far
apart from a bounded sample; of equal vectors as many items as an answer can hold go on; every item lies in the cell of its nearest pivot, and items are written once,
dealt and sorted by (cell, distance to the pivot, id): a large cell spreads over many files, and any run of
rows is a thin shell of a cell. Queries go to the tasks in blocks of bounded size, each block twice. First
they meet the nearest cells that hold enough items, which bounds the distance of their k-th neighbour.
Then they meet only those shells of other cells that may hold something nearer. Where vectors have no clusters
the bounds exclude nothing and all are compared, as they must be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import l2_normalized
from ..sources import scratch

#: Queries that go to every task at once, pivots, rows that pivots are chosen from, rows compared at once.
BLOCK, PIVOTS, SAMPLE, ROWS = 4096, 64, 4096, 1024
#: More than any error of a distance made from a cosine, and of a cosine.
SLACK, CLOSE = 1e-6, 1e-9
FOUND = "query long, neighbour long, cosine double"


def unit_rows(df: DataFrame, item: str, embedding: str) -> DataFrame:
    """(i, e): ids and unit vectors of the rows that have an id and a finite vector other than zero."""
    square = F.aggregate(embedding, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = df.where(F.col(item).isNotNull() & (square > 0) & (square < float("inf")))
    return usable.select(F.col(item).cast("long").alias("i"), l2_normalized(F.col(embedding)).alias("e"))


def told_apart(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with the same vector the k + 1 smallest ids, each once: no query has others among its k
    nearest. Limited in every task before the shuffle, so that a vector of a third of all rows is k + 1 rows a task."""
    hashed = rows.withColumn("h", F.xxhash64("e"))
    w = Window.partitionBy("h", "e").orderBy("i")
    some = hashed.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= k + 1)
    return some.withColumn("before", F.lag("place", 1, 0).over(w)).where("place > before").select("i", "e")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows of x: from the first on, always the one farthest from those taken."""
    taken, away = [0], distances(x, x[:1])[:, 0]
    while len(taken) < n and away.max() > SLACK:
        taken.append(int(away.argmax()))
        away = np.minimum(away, distances(x, x[taken[-1:]])[:, 0])
    return x[taken]


def laid_out(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(i, e, cell, r) in the shared folder, in the order of (cell, r, i)."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column(1)), held.value)
                cell = d.argmin(axis=1)
                made = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["i", "e", "cell", "r"])

    path = scratch.folder(rows.sparkSession, "cells")
    schema = "i long, e array<double>, cell int, r double"
    rows.mapInArrow(run, schema).repartitionByRange("cell", "r", "i").sortWithinPartitions("cell", "r", "i").write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


class Block:
    """Queries of one block, their distances to the pivots, the cells that each asks (rows: queries)
    and the distance within which it wants neighbours."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        self.ids, self.x = ids, x
        self.to = distances(x, pivots)
        self.cells = np.zeros(self.to.shape, dtype=bool)
        self.within = np.full(len(ids), np.inf)

    def ask_home(self, size: np.ndarray, far: np.ndarray, k: int) -> None:
        """The nearest cells that hold k items beside the query itself; all cells with their radii
        tell how far the k-th is at most."""
        by = np.argsort(self.to, axis=1, kind="stable")
        before = np.cumsum(size[by], axis=1) - size[by]
        np.put_along_axis(self.cells, by, before <= k, axis=1)
        reach = np.where(size > 0, self.to + far, np.inf)
        by = np.argsort(reach, axis=1, kind="stable")
        enough = np.cumsum(size[by], axis=1) > k
        at = np.arange(len(by))
        self.within = np.where(enough[:, -1], reach[at, by[at, enough.argmax(axis=1)]], np.inf)

    def ask_others(self, size: np.ndarray, near: np.ndarray, far: np.ndarray, between: np.ndarray) -> None:
        """Cells not asked yet that may hold an item within the wanted distance: by the shell that the
        cell's items lie in, and by the planes halfway between its pivot and the others."""
        least = np.maximum(self.to - far, near - self.to)
        for c in range(len(size)):
            gap = np.where(between[c] > SLACK, (self.to[:, c, None] ** 2 - self.to**2) / np.maximum(2 * between[c], SLACK), 0.0)
            least[:, c] = np.maximum(least[:, c], gap.max(axis=1))
        self.cells = ~self.cells & (least <= self.within[:, None] + SLACK) & (size > 0)

    def askers(self, cell: int, nearest: float, farthest: float) -> np.ndarray:
        """Queries that a run of the cell's items between two distances from its pivot matters to."""
        to, reach = self.to[:, cell], self.within + SLACK
        return np.flatnonzero(self.cells[:, cell] & (to - farthest <= reach) & (nearest - to <= reach))

    def best(self, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
        """The k items with the largest cosines (ties: the smallest ids) of each query asked, without
        itself. A product of matrices proposes them; their cosines are then summed in one fixed order,
        so that equal vectors have equal ones wherever they lie."""
        s = self.x[asked] @ x.T
        s[self.ids[asked][:, None] == ids] = -np.inf
        floor = 1.0 - np.minimum(self.within[asked] + SLACK, 2.0) ** 2 / 2
        if len(ids) > k:
            floor = np.maximum(floor, -np.partition(-s, k - 1, axis=1)[:, k - 1])
        q, n = np.nonzero(s >= floor[:, None] - CLOSE)
        step = max(1, (1 << 22) // x.shape[1])
        sums = [(self.x[asked[q[i : i + step]]] * x[n[i : i + step]]).sum(axis=1) for i in range(0, len(q), step)]
        cosine = np.concatenate(sums) if sums else np.zeros(0)
        by = np.lexsort((ids[n], -cosine, q))
        q, n, cosine = q[by], n[by], cosine[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, n, cosine = q[rank < k], n[rank < k], cosine[rank < k]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[asked[q]]), pa.array(ids[n]), pa.array(cosine)], names=["query", "neighbour", "cosine"])


def search(items: DataFrame, block: Block, k: int, compared: Accumulator | None) -> DataFrame:
    """Candidates of the block's queries in the cells that they ask: up to k for every run of a cell."""
    held = items.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids, cell, r = (np.asarray(part.column(c)) for c in (0, 2, 3))
                x = matrix(part.column(1))
                edges = [0, *np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    ask = held.value.askers(int(cell[a]), r[a:b].min(), r[a:b].max())
                    if compared is not None:
                        compared.add(len(ask) * int(b - a))
                    for q in (ask[i : i + ROWS // 2] for i in range(0, len(ask), ROWS // 2)):
                        yield held.value.best(q, ids[a:b], x[a:b], k)

    return items.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def written(found: DataFrame) -> DataFrame:
    path = scratch.folder(found.sparkSession, "neighbours")
    found.write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def nearest(df: DataFrame, item: str, embedding: str, queries: DataFrame, k: int = 4, pivots: int = PIVOTS, compared: Accumulator | None = None) -> DataFrame:
    """(query, neighbour, cosine, rank): each query's k nearest other items, exactly; equal cosines go by
    the smaller id. Runs when it is called and leaves its rows in the shared folder.

    Rows without an id, and vectors that are null, zero or hold null or endless entries, are neither items
    nor queries. Fewer than k other items give as many rows; an empty table gives none. Rows repeated
    with id and vector are one item; an id with several vectors is several. compared, an accumulator, is given the pairs compared."""
    spark = df.sparkSession
    rows, asked = unit_rows(df, item, embedding), unit_rows(queries, item, embedding).dropDuplicates(["i"])
    sample = rows.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).select("e").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    chosen = far_apart(matrix(sample.column(0).combine_chunks()), pivots)
    between = distances(chosen, chosen)
    items = laid_out(told_apart(rows, k), chosen)
    size, near, far = np.zeros(len(chosen), dtype=np.int64), np.full(len(chosen), np.inf), np.zeros(len(chosen))
    # one row a pivot
    for c in items.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():
        size[c.cell], near[c.cell], far[c.cell] = c.n, c.lo, c.hi
    blocks, out = max(1, -(-asked.count() // BLOCK)), None
    for b in range(blocks):
        q = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow()
        if not q.num_rows:
            continue
        block = Block(q.column(0).to_numpy(), matrix(q.column(1).combine_chunks()), chosen)
        block.ask_home(size, far, k)
        home = written(ranked(search(items, block, k, compared), k).drop("rank"))
        # the k-th of each query of the block
        last = home.groupBy("query").agg(F.min("cosine").alias("c"), F.count("*").alias("n")).where(F.col("n") >= k).select("query", "c").toArrow()
        by = np.argsort(block.ids)
        at = by[np.searchsorted(block.ids, last.column(0).to_numpy(), sorter=by)]
        block.within[at] = np.minimum(block.within[at], np.sqrt(np.maximum(0.0, 2.0 - 2.0 * last.column(1).to_numpy())))
        block.ask_others(size, near, far, between)
        got = home
        if block.cells.any():
            got = home.unionByName(search(items, block, k, compared))
        part = written(ranked(got, k))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"{FOUND}, rank int")
