"""Several systems' hypotheses combined by weighted votes over the pivot's word slots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit import ITEMS, aligned_places, in_parts, numbered_words, within


def complete_ids(systems: DataFrame, n_systems: int, key: str = "utt_id") -> DataFrame:
    """Keys that every system has."""
    return systems.groupBy(key).agg(F.count_distinct("sys_idx").alias("n")).where(F.col("n") == n_systems).select(key)


def voted(weights: list[float], *columns: pa.Array) -> pa.Array:
    """The winning words of lists of words, row by row, in the slots of the first column's. Weights are added
    as doubles in the order of the lists; the largest sum wins, then the pivot's own word, then that of
    the earlier list. Words are numbers throughout: of all rows' slots at once."""
    numbers, words = numbered_words(*columns)
    blank = pc.index(words, "").as_py()
    there = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    (own, size), said = numbers[0], [numbers[0][0]]
    row, _ = within(size)
    for other, length in numbers[1:]:
        at = aligned_places(own, size, other, length)
        word = np.full(len(own), blank)
        word[at >= 0] = other[(np.cumsum(length) - length)[row[at >= 0]] + at[at >= 0]]
        said.append(word)
    sums = np.zeros((len(said), len(own)))
    for total, word in zip(sums, said, strict=True):
        for w, who in zip(weights, said, strict=True):
            total += np.where(who == word, w, 0.0)
    won = np.take_along_axis(np.array(said), sums.argmax(axis=0)[None], axis=0)[0]
    kept = (won != blank) & there[row]
    ends = np.r_[0, np.cumsum(np.bincount(row[kept], minlength=len(size)))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[~there, False]), words.take(pa.array(won[kept])))


def vote_columns(weights: list[float], *words: Column) -> Column:
    """The winning words of one row's lists, the first being the pivot: an array; null if any list is."""

    @F.arrow_udf("array<string>")
    def decided(*columns: pa.Array) -> pa.Array:
        size = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns)
        return in_parts(size, list(columns), ITEMS, lambda *c: voted(weights, *c), pa.list_(pa.string()))

    return decided(*words)


def vote(systems: DataFrame, weights: list[float], key: str = "utt_id") -> DataFrame:
    """(key, words): of rows (key, sys_idx, words), system 0 being the pivot, the winning word of
    each pivot slot; a slot won by '' falls away, and an empty pivot gives no words. Keys that some
    system lacks are left out; of a system's repeated rows for a key one counts.

    Each system's words meet once by key, in one shuffle; alignment and votes are one Arrow step. Where
    the systems already are columns of one table, vote_columns() needs no shuffle."""
    n = len(weights)
    each = [F.max(F.when(F.col("sys_idx") == i, F.col("words"))).alias(f"w{i}") for i in range(n)]
    met = systems.where(F.col("sys_idx").between(0, n - 1)).groupBy(key).agg(*each).dropna(subset=[f"w{i}" for i in range(n)])
    return met.select(key, vote_columns(weights, *[F.col(f"w{i}") for i in range(n)]).alias("words"))
