"""Majority spellings per group, and texts rewritten by them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lexicon rows that may be broadcast: some 50 bytes each in a Python worker.
BROADCAST_ROWS = 4_000_000
#: Words that a Python worker spells at once.
WORDS = 200_000


def build_lexicon(rows: DataFrame, group: str, words: str, order: list[str], fold: Callable[[Column], Column], min_share: float = 0.6, min_count: int = 30) -> DataFrame:
    """(group, folded, surface): for each folded word seen min_count times or more, its most
    frequent spelling if that has min_share of them; of equally frequent ones the first seen by
    (order, place). Repeated rows count each time; rows without a group are an error.

    Two spellings that are equally frequent have half of a word's places at most, so with a min_share of
    more than half none is chosen by where it was seen first, and words are only counted, by hash."""
    rows = rows.withColumn(group, F.when(F.col(group).isNull() | (F.col(group) == ""), F.raise_error(F.lit(f"a row has no {group}")).cast("string")).otherwise(F.col(group)))
    if min_share > 0.5:
        forms = rows.select(group, F.explode(words).alias("surface")).groupBy(group, "surface").agg(F.count("*").alias("n")).withColumn("first", F.lit(0))
    else:
        each = rows.select(group, *order, F.posexplode(words).alias("pos", "surface"))
        forms = each.groupBy(group, "surface").agg(F.count("*").alias("n"), F.min(F.struct(*order, "pos")).alias("first"))
    forms = forms.withColumn("folded", fold(F.col("surface")))
    best = forms.groupBy(group, "folded").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.min(F.struct(-F.col("n"), "first", "surface")).alias("m"))
    return best.where((F.col("total") >= min_count) & (F.col("top") >= min_share * F.col("total"))).select(group, "folded", F.col("m.surface").alias("surface"))


def parts_of(size: np.ndarray, most: int) -> list[int]:
    """Where parts of rows end that have `most` words together, or are one row."""
    total = np.cumsum(size)
    ends, at = [], 0
    while at < len(size):
        at = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        ends.append(at)
    return ends


class Spellings:
    """Spellings of (group, folded word) in Arrow, by sorted 64-bit hashes of the two: some 50 bytes an entry
    where a dictionary takes hundreds. Entries are compared whole, and those that share a hash are kept aside."""

    def __init__(self, groups: pa.Array, folded: pa.Array, surface: pa.Array):
        there = pc.and_(groups.is_valid(), folded.is_valid())
        groups, folded, surface = (c.filter(there).cast(pa.string()) for c in (groups, folded, surface))
        of = groups.dictionary_encode()
        self.names = of.dictionary
        hashes = self._hashes(of.indices, folded)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        same = np.r_[False, hashes[1:] == hashes[:-1]]
        shared = same | np.r_[same[1:], False]
        mine = pa.array(order[shared])
        self.aside = dict(zip(zip(groups.take(mine).to_pylist(), folded.take(mine).to_pylist(), strict=True), surface.take(mine).to_pylist(), strict=True))
        order = pa.array(order[~shared])
        self.hashes, self.group, self.folded, self.surface = hashes[~shared], of.indices.take(order), folded.take(order), surface.take(order)

    def _hashes(self, group: pa.Array, folded: pa.Array) -> np.ndarray:
        some = lambda at: pd.util.hash_array(folded.slice(at, WORDS).to_numpy(zero_copy_only=False).astype(object), categorize=False)
        words = np.concatenate([np.zeros(0, np.uint64), *map(some, range(0, len(folded), WORDS))])
        return words * np.uint64(0x9E3779B97F4A7C15) + pc.fill_null(group, -1).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)

    def find(self, groups: pa.Array, folded: pa.Array) -> pa.Array:
        """The spelling of each (group, folded word), null where there is none."""
        if not len(self.hashes) and not self.aside:
            return pa.nulls(len(folded), pa.string())
        group = pc.index_in(groups, value_set=self.names)
        found = pa.nulls(len(folded), pa.string())
        if len(self.hashes):
            wanted = self._hashes(group, folded)
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            close = np.flatnonzero((self.hashes[at] == wanted) & group.is_valid().to_numpy(zero_copy_only=False) & folded.is_valid().to_numpy(zero_copy_only=False))
            mine, own = pa.array(at[close]), pa.array(close)
            right = pc.and_(pc.equal(self.folded.take(mine), folded.take(own)), pc.equal(self.group.take(mine), group.take(own))).to_numpy(zero_copy_only=False)
            place = np.full(len(folded), -1)
            place[close[right]] = at[close[right]]
            found = self.surface.take(pa.array(place, mask=place < 0))
        if self.aside:
            found = pc.coalesce(found, pa.array([self.aside.get(k) for k in zip(groups.to_pylist(), folded.to_pylist(), strict=True)], pa.string()))
        return found


def respelled(entries: Spellings | dict, groups: pa.Array, words: pa.Array, folded: pa.Array) -> pa.Array:
    """Lists of words as entries (group, folded word) spell them, others as they are. Each different word
    of a group is looked up once, words stay in Arrow."""
    size = pc.fill_null(pc.list_value_length(words), 0)
    flat, keys = pc.list_flatten(words).cast(pa.string()), pc.list_flatten(folded).cast(pa.string()).dictionary_encode(null_encoding="encode")
    of = groups.cast(pa.string()).dictionary_encode(null_encoding="encode")
    n = max(1, len(keys.dictionary))
    place = np.repeat(of.indices.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False)) * n + keys.indices.to_numpy(zero_copy_only=False)
    pairs, at = np.unique(place, return_inverse=True)
    names, known = of.dictionary.take(pa.array(pairs // n)), keys.dictionary.take(pa.array(pairs % n))
    if isinstance(entries, Spellings):
        found = entries.find(names, known)
    else:
        found = pa.array([entries.get(k) for k in zip(names.to_pylist(), known.to_pylist(), strict=True)], pa.string())
    new = pc.coalesce(found.take(pa.array(at)), flat)
    ends = pa.array(np.r_[0, np.cumsum(size.to_numpy(zero_copy_only=False))], pa.int32(), mask=np.r_[words.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(ends, new)


def canonicalize(rows: DataFrame, lexicon: DataFrame, key: str, group: str, words: str, fold: Callable[[Column], Column]) -> DataFrame:
    """rows' (key, group, words) with words spelled as the lexicon says, and changed: whether any
    differs. A word without an entry stays, and so does every row, repeated ones too. A lexicon
    of BROADCAST_ROWS at most goes to every task and no text moves; a larger one is joined word by word."""
    entries = lexicon.select(F.col(group).cast("string"), "folded", "surface").limit(BROADCAST_ROWS + 1).toArrow()
    rows = rows.select(key, group, words).withColumn("__folded", F.transform(words, fold))
    if len(entries) <= BROADCAST_ROWS:
        held = rows.sparkSession.sparkContext.broadcast(Spellings(*(c.combine_chunks() for c in entries.columns)))

        @F.arrow_udf("array<string>")
        def spelled(groups: pa.Array, old: pa.Array, folded: pa.Array) -> pa.Array:
            """A message's rows in parts of bounded numbers of words."""
            size, made, at = pc.fill_null(pc.list_value_length(old), 0).to_numpy(zero_copy_only=False), [], 0
            for end in parts_of(size, WORDS):
                made.append(respelled(held.value, *(c.slice(at, end - at) for c in (groups, old, folded))))
                at = end
            return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

        out = rows.withColumn("__new", spelled(F.col(group).cast("string"), words, "__folded"))
    else:
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        each = rows.select("__row", group, F.posexplode(F.arrays_zip(F.col(words).alias("w"), F.col("__folded").alias("folded"))).alias("pos", "x")).select("__row", group, "pos", "x.w", "x.folded")
        each = each.join(lexicon, [group, "folded"], "left").select("__row", F.struct("pos", F.coalesce("surface", "w").alias("w")).alias("p"))
        made = each.groupBy("__row").agg(F.sort_array(F.collect_list("p"))["w"].alias("__new"))
        out = rows.join(made, "__row", "left").withColumn("__new", F.coalesce("__new", words))
    return out.select(key, group, F.coalesce("__new", F.array().cast("array<string>")).alias("words"), F.coalesce(F.col("__new") != F.col(words), F.lit(False)).alias("changed"))


def changed_rows(canonical: DataFrame) -> DataFrame:
    """One row: rows, and those of them whose text the lexicon changed."""
    return canonical.agg(F.count("*").alias("rows"), F.count(F.when(F.col("changed"), 1)).alias("changed"))
