"""Checkpoint retention: the best few and the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import first_k


def retained(scores: DataFrame, groups: list[str], step: str, score: str, k: int) -> DataFrame:
    """scores with keep: whether the step is among its group's k lowest scores (none counts as
    infinite, ties by step) or the latest. A group's steps are cut to k in every task, and the rows that
    stay are joined back by step, so a large group is not one task's."""
    order = [F.coalesce(F.col(score), F.lit(float("inf"))), step]
    best = first_k(scores.select(*groups, step, score), groups, order, k)
    latest = scores.groupBy(*groups).agg(F.max(step).alias(step))
    kept = best.select(*groups, step).unionByName(latest.select(*groups, step)).distinct().withColumn("__kept", F.lit(True))
    same = F.lit(True)
    for c in [*groups, step]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return scores.alias("l").join(kept.alias("r"), same, "left").select("l.*", F.coalesce("r.__kept", F.lit(False)).alias("keep"))


class TopK:
    """The same rule step by step, with scores that a restart may restore."""

    def __init__(self, k: int, scores: dict[int, float] | None = None, present: set[int] | None = None):
        self.k = k
        self.scores = {s: v for s, v in (scores or {}).items() if present is None or s in present}

    def add(self, step: int, score: float | None) -> list[int]:
        """Take a step in; the steps that go."""
        self.scores[step] = float("inf") if score is None else score
        keep = set(sorted(self.scores, key=self.scores.get)[: self.k]) | {step}
        gone = [s for s in self.scores if s not in keep]
        for s in gone:
            del self.scores[s]
        return gone


def best_or_latest(checkpoints: DataFrame, step: str, score: str) -> DataFrame:
    """The checkpoint of the lowest score; without scores the latest."""
    return checkpoints.agg(F.coalesce(F.min_by(step, score), F.max(step)).alias("step"))
