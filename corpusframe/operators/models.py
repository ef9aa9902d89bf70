"""A registry for models that run inside Arrow batches: decoding, speech activity, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAKERS: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}
_READY: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register(name: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """make() loads the model and returns a function from a batch to its results; it runs once in
    each worker, when the first batch comes."""
    _MAKERS[name] = make


def apply_model(df: DataFrame, name: str, schema: str, columns: list[str], order: str | None = None) -> DataFrame:
    """The named model over batches of columns. With order, rows are sorted within their
    partitions, so that batches hold inputs of like length."""
    make = _MAKERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _READY.get(name)
        if model is None:
            model = _READY[name] = make()
        for b in batches:
            if len(b):
                yield model(b)

    rows = df.select(*columns)
    return (rows.sortWithinPartitions(order) if order else rows).mapInPandas(run, schema)


class Items:
    """Columns that name what they take and what they provide, put together when they are asked for:
    only what an output needs is computed, and each item once."""

    def __init__(self):
        self._made: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {}

    def provides(self, name: str, takes: tuple[str, ...], make: Callable[..., Column]) -> Items:
        self._made[name] = (takes, make)
        return self

    def select(self, df: DataFrame, outputs: list[str]) -> DataFrame:
        """df's rows with the outputs. Something that neither df nor an item provides, or an item that
        needs itself, is an error."""
        given = set(df.columns)
        order: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in given or name in order:
                return
            if name not in self._made:
                raise KeyError(f"nothing provides {name}")
            if name in path:
                raise ValueError(f"{name} needs itself: {' > '.join(path)}")
            for need in self._made[name][0]:
                visit(need, (*path, name))
            order.append(name)

        for o in outputs:
            visit(o, ())
        for name in order:
            takes, make = self._made[name]
            df = df.withColumn(name, make(*map(F.col, takes)))
        return df.select(*outputs)


def parameter_groups(params: DataFrame, rate: Column, decay: Column) -> DataFrame:
    """(lr, wd, tensors, numel) of trainable parameters (name, numel, trainable), shared ones (the same
    storage) counted once if they have one."""
    rows = params.where("trainable")
    if "storage" in params.columns:
        rows = rows.dropDuplicates(["storage"])
    return rows.groupBy(rate.alias("lr"), decay.alias("wd")).agg(F.count("*").alias("tensors"), F.sum("numel").alias("numel"))


def trainable_summary(params: DataFrame, train: Column, frozen: Column) -> DataFrame:
    """One row: numel that trains, numel of all, and names that train though they must be frozen."""
    return params.agg(
        F.coalesce(F.sum(F.when(train, F.col("numel"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("numel"), F.lit(0)).alias("n_total"),
        F.count(F.when(train & frozen, 1)).alias("wrong"),
    )


def attentive_pooling(layers: np.ndarray, n: int, w: dict[str, np.ndarray]) -> np.ndarray:
    """The embedding of (layers, frames, width) features of which n frames are valid.

    Keys and values are projections of softmax-weighted sums over layers. Each head's score of a frame
    is a convolution of the keys round it, divided by its taps; the softmax of the scores over
    valid frames weighs the values, and all heads' sums are projected. Weights: layer_k, layer_v
    (layers), k, v (width, inner), conv (taps, inner, heads), out (heads * inner, size); a bias
    k_b, v_b, conv_b, out_b may go with each."""
    soft = lambda z: (e := np.exp(z - z.max(axis=0))) / e.sum(axis=0)
    key, value = (np.tensordot(soft(w[f"layer_{c}"]), layers, 1) @ w[c] + w.get(f"{c}_b", 0) for c in "kv")
    taps = len(w["conv"])
    key[n:] = 0
    round_ = np.lib.stride_tricks.sliding_window_view(np.pad(key, (((taps - 1) // 2, taps // 2), (0, 0))), taps, axis=0)
    scores = (np.einsum("tdl,ldh->th", round_, w["conv"]) + w.get("conv_b", 0)) / taps
    return (soft(scores[:n]).T @ value[:n]).ravel() @ w["out"] + w.get("out_b", 0)


def sample_rows(df: DataFrame, id_: str, ref: str, base: str, current: str) -> DataFrame:
    """A table to look at: id, reference, both texts, and the word error rate of each."""
    from ..functions.edit import utterance_rate, word_edits
    from ..functions.text import tokens

    words = {c: tokens(F.col(c)) for c in (ref, base, current)}
    rate = lambda c: utterance_rate(word_edits(words[ref], words[c]), F.size(words[ref]), F.size(words[c]))
    return df.select(id_, ref, base, current, rate(base).alias("base_wer"), rate(current).alias("current_wer"))


def length_batches(df: DataFrame, length: Column, size: int, buckets: int = 64, largest: float = 30.0) -> DataFrame:
    """df with bucket, the place of its length among `buckets` equal steps up to largest, and in_batch
    order: rows are dealt by bucket and sorted longest first within a task, so a batch of a model
    holds like lengths and no task holds all."""
    at = F.least(F.floor(length / largest * buckets), F.lit(buckets - 1)).cast("int")
    rows = df.withColumn("bucket", at).repartitionByRange("bucket", F.hash(*df.columns)).sortWithinPartitions(F.col("bucket").desc(), length.desc())
    return rows.withColumn("batch", F.floor(F.monotonically_increasing_id() / size))
