"""Event-time windows, the same functions for batches and streams (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, which only times with a zone can have."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df


def tumbling(df: DataFrame, time: str, length: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """start, keys, n, mean per window; a stream needs `late`, how long to wait for rows."""
    df = _late(df, time, late)
    w = df.groupBy(F.window(time, length).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """start, end, keys, n, total per session: rows nearer than gap belong together."""
    df = _late(df, time, late)
    w = df.groupBy(F.session_window(time, gap).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def error_rate(df: DataFrame, time: str, length: str, group: str, late: str) -> DataFrame:
    """A monitor of corpus error rates over a stream of rows with edits and n_ref."""
    w = _late(df, time, late).groupBy(F.window(time, length).alias("w"), group)
    out = w.agg(F.sum("edits").alias("edits"), F.sum("n_ref").alias("units"))
    return out.select(F.col("w.start").alias("start"), group, "edits", "units", F.when(F.col("units") > 0, F.col("edits") / F.col("units")).otherwise(0.0).alias("rate"))


def retained_steps(df: DataFrame, group: str, step: str, score: str, k: int) -> DataFrame:
    """Top-k retention over a stream: after each batch of a group's steps, what is kept and what
    goes. The state is k + 1 scores a group."""
    from ..operators.retention import TopK

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, values = state.get if state.exists else ([], [])
        top = TopK(k, dict(zip(steps, values, strict=True)))
        rows = pd.concat(list(parts)).sort_values("s")
        gone = [g for r in rows.itertuples() for g in top.add(int(r.s), None if pd.isna(r.v) else float(r.v))]
        state.update((list(top.scores), list(top.scores.values())))
        yield pd.DataFrame([(key[0], s, True) for s in top.scores] + [(key[0], s, False) for s in gone], columns=["g", "step", "keep"])

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(step).cast("long").alias("s"), F.col(score).cast("double").alias("v"))
    return rows.groupBy("g").applyInPandasWithState(run, "g string, step long, keep boolean", "steps array<long>, values array<double>", "update", "NoTimeout")
