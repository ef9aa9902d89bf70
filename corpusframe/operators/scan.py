"""Order-dependent columns of groups of any size: a segmented scan over ranges.

Spark deals rows by sampled ranges of (group, order) and sorts each range, so that a large group
spreads over many tasks and a small one lies in one. A task then scans its range once, as a stream:
numbers and last values within the range, and which rows belong to the range's first group. What a
range hands on is one small row (its last group, that group's rows and last value in it); an exclusive
scan over these gives every range what its first group brings along, and only rows of first groups
take it up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch


class RangeScan:
    """The state of one range's scan: the group of the last row, its rows so far, its last value."""

    def __init__(self, groups: list[int], value: int | None):
        self.groups, self.value = groups, value
        self.at, self.runs, self.n, self.name, self.held = 0, 0, 0, None, None

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
        """Of rows in order: place in the range, number in the group (within the range, from 1),
        whether the group is the range's first, last value of the group's earlier rows."""
        here = np.arange(batch.num_rows)
        change = np.zeros(batch.num_rows, dtype=bool)
        for g in self.groups:
            code = np.asarray(batch.column(g).dictionary_encode(null_encoding="encode").indices)
            change[1:] |= code[1:] != code[:-1]
        at = lambda k: tuple(batch.column(g)[k].as_py() for g in self.groups)
        change[0] = self.name is None or at(0) != self.name
        begin = np.maximum.accumulate(np.where(change, here, -1))
        number = np.where(begin < 0, self.n + here + 1, here - begin + 1)
        run = self.runs + np.cumsum(change)
        place, kept = self.at + here, None
        if self.value is not None:
            column = batch.column(self.value)
            last = np.maximum.accumulate(np.where(np.asarray(column.is_valid()), here, -1))
            before = np.r_[-1, last[:-1]]
            inside = (before >= begin) & (before >= 0)
            taken = column.take(pa.array(np.where(inside, before, 0), mask=~inside))
            kept = pc.if_else(pa.array((begin < 0) & ~inside), pa.scalar(self.held, column.type), taken)
            if last[-1] >= max(begin[-1], 0):
                self.held = column[int(last[-1])].as_py()
            elif begin[-1] >= 0:
                self.held = None
        self.at, self.runs, self.n, self.name = self.at + len(here), int(run[-1]), int(number[-1]), at(-1)
        return place, number, run == 1, kept


#: Rows, and bytes of their (compressed) files, of a range: more rows are dealt into more ranges.
RANGE_ROWS, RANGE_BYTES = 500_000, 32 << 20


def _kept_rows(df: DataFrame) -> tuple[DataFrame, int | None]:
    """df as a table in the shared folder, which is made once, where sampling for ranges would make it again,
    and how many ranges it takes for none to be too large; None where Spark's own number does."""
    spark, path = df.sparkSession, scratch.folder(df.sparkSession, "rows")
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    ranges = max(-(-kept.count() // RANGE_ROWS), -(-scratch.length(spark, path) // RANGE_BYTES))
    return kept, ranges if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def scanned_ranges(df: DataFrame, groups: list[str], order: list[str | Column], value: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with __range, __at (place in it), __number, __first (does the row's group begin the
    range?) and, with a value, __kept: all within the range. Written to the shared folder, so that
    ranges stay the same for all that reads it. Without a number of ranges it grows with the rows, so
    that a task's share doesn't."""
    if ranges is None:
        df, ranges = _kept_rows(df)
    keys = [*map(F.col, groups), *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys)
    places, at = [df.columns.index(g) for g in groups], df.columns.index(value) if value else None
    more = [T.StructField("__range", T.IntegerType()), T.StructField("__at", T.LongType()), T.StructField("__number", T.LongType()), T.StructField("__first", T.BooleanType())]
    if value:
        more.append(T.StructField("__kept", df.schema[value].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = RangeScan(places, at), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                place, number, first, kept = state.step(batch)
                made = [pa.array(np.full(len(place), part, dtype=np.int32)), pa.array(place), pa.array(number), pa.array(first)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made, *([] if kept is None else [kept])], names=[*batch.schema.names, *(f.name for f in more[: 4 + bool(value)])])

    path = scratch.folder(df.sparkSession, "ranges")
    schema = T.StructType([*df.schema.fields, *more])
    dealt.mapInArrow(run, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def brought_along(scanned: DataFrame, groups: list[str], value: str | None = None) -> list[tuple]:
    """(range, rows, last value) for each range whose first group began in an earlier one: an
    exclusive scan over one summary a range, as many as there are shuffle partitions."""
    group = F.struct(*groups) if groups else F.struct(F.lit(0))
    last = F.coalesce(F.col(value), F.col("__kept")) if value else F.lit(None)
    told = scanned.groupBy("__range").agg(
        F.min_by(group, "__at").alias("head"), F.max_by(F.struct(group.alias("group"), F.col("__number").alias("n"), F.col("__first").alias("whole"), last.alias("last")), "__at").alias("tail")
    )
    out, name, n, held = [], None, 0, None
    for r in sorted(told.collect(), key=lambda r: r["__range"]):
        goes_on = name is not None and r["head"] == name
        if goes_on:
            out.append((r["__range"], n, held))
        tail: Row = r["tail"]
        more = goes_on and tail["whole"]
        n = tail["n"] + (n if more else 0)
        held = tail["last"] if tail["last"] is not None or not more else held
        name = tail["group"]
    return out


def _with_brought(df: DataFrame, groups: list[str], order: list[str | Column], value: str | None, ranges: int | None) -> DataFrame:
    scanned = scanned_ranges(df, groups, order, value, ranges)
    kind = df.schema[value].dataType if value else T.StringType()
    schema = T.StructType([T.StructField("__range", T.IntegerType()), T.StructField("__rows", T.LongType()), T.StructField("__value", kind)])
    brought = df.sparkSession.createDataFrame(brought_along(scanned, groups, value), schema)
    # one row a range at most, whatever the number of rows
    return scanned.join(F.broadcast(brought), "__range", "left")


def numbered_in_order(df: DataFrame, groups: list[str], order: list[str | Column], name: str = "n", ranges: int | None = None) -> DataFrame:
    """df with the row's number in its group by order, from 1. Null groups are a group; rows equal
    in all of order are numbered in some order."""
    rows = _with_brought(df, groups, order, None, ranges)
    n = F.col("__number") + F.when(F.col("__first"), F.coalesce("__rows", F.lit(0))).otherwise(0)
    return rows.select(*df.columns, n.alias(name))


def carried_forward(df: DataFrame, groups: list[str], order: list[str | Column], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with the value of the latest earlier row of the group that has one, else null."""
    rows = _with_brought(df, groups, order, value, ranges)
    return rows.select(*df.columns, F.coalesce("__kept", F.when(F.col("__first"), F.col("__value"))).alias(name))
