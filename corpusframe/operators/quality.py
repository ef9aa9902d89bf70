"""Contract checks as queries: each gives (check, violations), all of them together one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, **checks: Column) -> DataFrame:
    """One row per named condition: how many rows break it; a null condition is broken."""
    agg = df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), True)).alias(n) for n, c in checks.items()])
    return agg.unpivot([], list(checks), "check", "violations")


def digest(keys: list[str]) -> Column:
    """32 bytes that stand for a row's keys, so that long texts need not move."""
    return F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256))


def duplicate_rows(df: DataFrame, keys: list[str], name: str = "duplicates") -> DataFrame:
    n = df.groupBy(digest(keys).alias("d")).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.lit(name).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def leaked_rows(df: DataFrame, held_out: DataFrame, keys: list[str], name: str = "leakage") -> DataFrame:
    """Rows of df that are also in held_out; rows with a null key are in neither."""
    whole = lambda x: x.dropna(subset=keys).select(digest(keys).alias("d"))
    return whole(df).join(whole(held_out).distinct(), "d", "left_semi").agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def missing_rows(wanted: DataFrame, there: DataFrame, keys: list[str], name: str = "missing") -> DataFrame:
    return wanted.join(there.select(*keys).distinct(), keys, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def unequal_counts(a: DataFrame, b: DataFrame, group: str, name: str = "unequal_counts") -> DataFrame:
    """Groups whose numbers of rows differ, those of one side only included."""
    x, y = a.groupBy(group).agg(F.count("*").alias("n")), b.groupBy(group).agg(F.count("*").alias("m"))
    return x.join(y, group, "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Fail on the driver if any check has violations; the table has one row a check."""
    if bad := {r["check"]: r["violations"] for r in checks.where("violations > 0").collect()}:
        raise ValueError(f"contract broken: {bad}")


def original_training_audio(path: Column) -> Column:
    """Is this path of original training audio, and none of the validation set?"""
    return F.contains(path, F.lit("/audio/original/")) & ~F.contains(path, F.lit("original_val"))


MODES = ("filtered", "identity", "none")


def chosen(rows: DataFrame, mode: str, keep: Column) -> DataFrame:
    """The rows that a build takes: those that keep holds for, all of them, or none."""
    if mode not in MODES:
        raise ValueError(f"{mode} is none of {MODES}")
    return rows if mode == "identity" else rows.where(keep if mode == "filtered" else F.lit(False))


def unexpected_counts(df: DataFrame, group: str, expected: dict, name: str = "unexpected_counts") -> DataFrame:
    """Groups that have another number of rows than expected, missing and surplus ones included."""
    want = df.sparkSession.createDataFrame([(g, int(n)) for g, n in expected.items()], f"{group} {dict(df.dtypes)[group]}, m long")
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(want), group, "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def missing_files(rows: DataFrame, files: DataFrame, path: str, name: str = "missing_files") -> DataFrame:
    """Rows whose path is not in a file inventory."""
    return rows.join(files.select(path).distinct(), path, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def metadata_checks(rows: DataFrame, clean: DataFrame, groups: list[str], prefix: str) -> DataFrame:
    """Source metadata (audio, text, group, id) before it is used: original training audio, a known
    group, the text's prefix, a clean counterpart (group, id), and a row of every group."""
    own = violations(rows, original=original_training_audio(F.col("audio")), known_group=F.col("group").isin(groups), begins=F.startswith("text", F.lit(prefix)))
    wanted = rows.sparkSession.createDataFrame([(g,) for g in groups], "group string")
    return together(own, missing_rows(rows, clean, ["group", "id"], "no_counterpart"), missing_rows(wanted, rows, ["group"], "empty_group"))
