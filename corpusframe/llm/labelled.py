"""Bounded samples of labelled documents and the small models fitted to them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Labelled documents of each class that a fit takes; they are read whole.
PER_CLASS = 1500


def sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], float]:
    """Texts and labels of at most per_class documents of each class, of those where train holds
    over doc_id. They are the first by a hash of the id, so the choice depends on the labelled
    ids only, never on a text or its length. Null labels and ids don't take part; an id labelled
    twice has the larger label. The text of an id that has several rows is the largest; null texts
    are empty ones. Also returned: the share of class 1 among all labelled documents where train
    holds. Empty tables give no texts and the share 0.5."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.where("doc_id is not null and y in (0, 1)").where(train).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).collect()]
    if not chosen:
        return [], [], 0.5
    prior = marked.agg(F.avg("y")).first()[0]
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int"))
    got = id_text(docs, id_col, text_col).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).collect()
    got = sorted(got, key=lambda r: (hash_order(r.doc_id), r.doc_id))
    return [r.text for r in got], [r.y for r in got], prior


def hash_order(i: int) -> int:
    """A fixed shuffle of ids."""
    return (i * 0x9E3779B97F4A7C15 + 0x7F4A7C15) >> 7 & 0xFFFFFFFF


class Logistic:
    """L2-regularised logistic regression on standardised columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60):
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - self.mean) / self.std, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        ridge = l2 * len(y) * np.r_[np.ones(z.shape[1] - 1), 1e-6] + 1e-9
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + ridge * w
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        self.w = w

    def shift(self, share: float, prior: float) -> Logistic:
        """For a population where class 1 has the share prior, fitted where it had share."""
        share, prior = min(max(share, 1e-3), 1 - 1e-3), min(max(prior, 1e-3), 1 - 1e-3)
        self.w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float) - self.mean) / self.std
        return 1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30)))
