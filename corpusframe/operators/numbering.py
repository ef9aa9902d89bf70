"""Order within groups of any size, without one task holding a group.

Rows are dealt into buckets by the leading hexadecimal digits of an MD5 key, so buckets follow the
key's order. Sums per (group, bucket) are small; their running total tells which buckets lie
wholly before, across or behind a limit, and only rows of one bucket are ever sorted together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a bucket: 4,096 buckets a group.
DIGITS = 3


def key_of(seed: int | str, *parts: Column) -> Column:
    """A reproducible chance order: MD5 of the seed and the parts, the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _before(rows: DataFrame, groups: list[str], amount: str) -> DataFrame:
    """rows with __bucket, __sum of the bucket and __before, the group's total before it."""
    rows = rows.withColumn("__bucket", F.substring("__key", 1, DIGITS))
    sums = rows.groupBy(*groups, "__bucket").agg(F.sum(amount).alias("__sum"))
    w = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0)))
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.col("l.__bucket") == F.col("r.__bucket")]
    return rows.alias("l").join(sums.alias("r"), on).select("l.*", "r.__sum", "r.__before")


def running_before(df: DataFrame, groups: list[str], key: Column, ties: list[str], amount: Column) -> DataFrame:
    """df with __run: the sum of amount over the group's earlier rows by (key, ties)."""
    rows = _before(df.withColumns({"__key": key, "__amount": amount}), groups, "__amount")
    w = Window.partitionBy(*groups, "__bucket").orderBy("__key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__run", F.col("__before") + F.coalesce(F.sum("__amount").over(w), F.lit(0)))
    return rows.drop("__key", "__amount", "__bucket", "__sum", "__before")


def numbered(df: DataFrame, groups: list[str], key: Column, ties: list[str], name: str = "n") -> DataFrame:
    """df with the row's number in its group by (key, ties), from 1."""
    return running_before(df, groups, key, ties, F.lit(1)).withColumn(name, F.col("__run") + 1).drop("__run")


def budget_prefix(df: DataFrame, groups: list[str], key: Column, ties: list[str], amount: Column, target: Column, start: Column | None = None) -> DataFrame:
    """Rows of each group, by (key, ties), as long as start plus the amounts before stays under
    target; the row that crosses it is included. Amounts are positive. Only buckets that the
    target falls into are sorted."""
    start = F.lit(0) if start is None else start
    rows = _before(df.withColumns({"__key": key, "__amount": amount, "__target": target, "__start": start}), groups, "__amount")
    rows = rows.where(F.col("__start") + F.col("__before") < F.col("__target"))
    inside = F.col("__start") + F.col("__before") + F.col("__sum") <= F.col("__target")
    w = Window.partitionBy(*groups, "__bucket").orderBy("__key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    crossed = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("__run", F.coalesce(F.sum("__amount").over(w), F.lit(0)))
    crossed = crossed.where(F.col("__start") + F.col("__before") + F.col("__run") < F.col("__target")).drop("__run")
    return rows.where(inside).unionByName(crossed).select(*df.columns)
