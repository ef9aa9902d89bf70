"""Embeddings: cohesion, voices by complete linkage, targets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import l2_normalized
from ..sources import scratch
from .scan import numbered_in_order


def cohesion(df: DataFrame, group: str, embedding: str) -> DataFrame:
    """Mean cosine of different members of each group, 1 for a single one. The sum of all pairwise
    products is the squared length of the members' sum, so members are added, never paired."""
    rows = df.select(group, F.posexplode(l2_normalized(F.col(embedding))).alias("d", "x"))
    sums = rows.groupBy(group, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    per = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    mean = F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return per.select(group, "n", mean.alias("cohesion"))


def complete_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of unit rows: the two clusters whose farthest members are nearest join as
    long as that cosine distance is under threshold. Follows chains of nearest neighbours, so the
    distances are looked at a constant number of times."""
    n = len(x)
    d = 1.0 - np.asarray(x, float) @ np.asarray(x, float).T
    np.fill_diagonal(d, np.inf)
    alive, label = np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(np.argmin(np.where(alive, d[a], np.inf)))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            if d[a, b] >= threshold:
                # neither can join anything nearer: both are finished
                alive[a] = alive[b] = False
                continue
            lo, hi = sorted((a, b))
            d[lo], d[:, lo] = np.maximum(d[lo], d[hi]), np.maximum(d[:, lo], d[:, hi])
            d[lo, lo] = np.inf
            alive[hi] = False
            d[hi], d[:, hi] = np.inf, np.inf
            label[label == hi] = lo
            chain = [c for c in chain if alive[c]]
        else:
            chain.append(b)
    return np.unique(label, return_inverse=True)[1]


#: Different vectors of a group on one side of a block of pairs, and rows of them compared at once.
BLOCK, ROWS = 3000, 500


def near_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(g, u, v, d): pairs u < v of each group's rows (g, r, e) whose cosine distance is under threshold.
    Rows are dealt into blocks of about BLOCK, every two blocks of a group meet in one task."""
    blocks = F.ceil(F.count("*") / BLOCK)
    rows = reps.join(reps.groupBy("g").agg(blocks.alias("k")), "g").withColumn("b", F.pmod(F.xxhash64("r"), F.col("k")))
    rows = rows.select("g", "r", "e", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    rows = rows.select("g", "r", "e", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        r, b = (table.column(c).to_numpy() for c in ("r", "b"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x = np.asarray(table.column("e").combine_chunks().flatten()).reshape(len(r), -1)
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        y, found = x[right].T, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k in range(0, len(left), ROWS):
            own = left[k : k + ROWS]
            d = 1.0 - x[own] @ y
            i, j = np.nonzero(d < threshold)
            p, q = r[own[i]], r[right[j]]
            keep = p < q if lo == hi else p != q
            found.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], d[i, j][keep]))
        u, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(u), pa.string()), "u": u, "v": v, "d": d})

    return rows.groupBy("g", "lo", "hi").applyInArrow(run, "g string, u long, v long, d double")


def linked(edges: DataFrame) -> DataFrame:
    """(g, r, c): of all rows in pairs (g, u, v, d), u < v, their cluster c (its smallest member) by
    complete linkage, where two rows that are no pair never come together. In each round all clusters that are each
    other's nearest join at once, which gives what joining them one by one gives; equal distances go by
    the smaller members. A pair of clusters stays one as long as all pairs of their parts are there."""
    labels = _kept(edges.select("g", F.explode(F.array("u", "v")).alias("r")).distinct().withColumn("c", F.col("r")))
    while not edges.isEmpty():
        key = F.struct("d", "u", "v").alias("k")
        best = edges.select("g", F.explode(F.array("u", "v")).alias("x"), key).groupBy("g", "x").agg(F.min("k").alias("k"))
        joins = _kept(best.groupBy("g", "k").agg(F.count("*").alias("n")).where("n = 2").select("g", "k.u", "k.v"))
        to = joins.select("g", F.explode(F.array("u", "v")).alias("x"), F.col("u").alias("to"))
        side = lambda c: to.select("g", F.col("x").alias(c), F.col("to").alias(f"to_{c}"))
        met = edges.join(side("u"), ["g", "u"], "left").join(side("v"), ["g", "v"], "left")
        a, b = F.coalesce("to_u", "u"), F.coalesce("to_v", "v")
        parts = F.when(F.col("to_u").isNull(), 1).otherwise(2) * F.when(F.col("to_v").isNull(), 1).otherwise(2)
        met = met.where(a != b).select("g", F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "d", parts.alias("p"))
        edges = _kept(met.groupBy("g", "u", "v").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("p").alias("p")).where("n = p").drop("n", "p"))
        moved = joins.select("g", F.col("v").alias("c"), F.col("u").alias("to"))
        labels = _kept(labels.join(moved, ["g", "c"], "left").select("g", "r", F.coalesce("to", "c").alias("c")))
    return labels


def _kept(df: DataFrame) -> DataFrame:
    path = scratch.folder(df.sparkSession, "clusters")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, group: str, item: str, embedding: str, threshold: float, *more: str) -> DataFrame:
    """(group, item, more, e, cluster): e the unit vector. See cluster()."""
    e = l2_normalized(F.col(embedding))
    rows = df.select(F.to_json(F.struct(F.col(group).alias("g"))).alias("__g"), group, item, *more, e.alias("e"))
    rows = numbered_in_order(rows, ["__g"], [item, F.xxhash64("e")], "__n")
    square = F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v)
    rows = rows.withColumn("__e", F.when(square.between(0.5, 2.0), F.col("e")))
    # equal vectors join before all others: one of them stands for all
    reps = _kept(rows.where("__e is not null").groupBy(F.col("__g").alias("g"), F.col("__e").alias("e")).agg(F.min("__n").alias("r")))
    labels = linked(_kept(near_pairs(reps, threshold)))
    reps = reps.join(labels, ["g", "r"], "left").select(F.col("g").alias("__g"), F.col("e").alias("__e"), F.coalesce("c", "r").alias("__c"))
    rows = _kept(rows.join(reps, ["__g", "__e"], "left").withColumn("__c", F.coalesce("__c", "__n")))
    numbers = numbered_in_order(rows.select("__g", "__c").distinct(), ["__g"], ["__c"], "__k")
    return rows.join(numbers, ["__g", "__c"]).select(group, item, *more, "e", (F.col("__k") - 1).alias("cluster"))


def cluster(df: DataFrame, group: str, item: str, embedding: str, threshold: float = 0.45) -> DataFrame:
    """(group, item, cluster): complete linkage within each group under threshold (more than 0), clusters numbered by
    their smallest items. Runs when it is called. All pairs of a group's different vectors are compared, a block of
    pairs a task; only those under threshold are kept, and no group meets in one task. A row without a
    usable vector is a cluster of its own."""
    return clustered(df, group, item, embedding, threshold).select(group, item, "cluster")


def voices(clustered: DataFrame, clips: DataFrame, group: str, item: str, embedding: str, duration: str, prefix: str, min_cohesion: float = 0.70, min_dur: float = 30.0) -> DataFrame:
    """Clusters whose cohesion and total duration pass, with their clips, distinct prefixes and
    groups, longest first."""
    rows = clustered.join(clips, [group, item]).withColumn("voice", F.concat_ws("/", F.col(group).cast("string"), F.col("cluster").cast("string")))
    tight = cohesion(rows, "voice", embedding).select("voice", "cohesion")
    agg = rows.groupBy("voice").agg(
        F.sort_array(F.collect_list(item)).alias("clips"),
        F.round(F.sum(duration), 1).alias("dur"),
        F.count_distinct(prefix).alias("n_video"),
        F.sort_array(F.collect_set(group)).alias("dialects"),
    )
    return agg.join(tight, "voice").where((F.col("cohesion") >= min_cohesion) & (F.col("dur") >= min_dur)).orderBy(F.col("dur").desc(), "voice")


#: Targets that are broadcast at a time.
TARGETS = 10_000


def top_targets(voices_: DataFrame, n: int, min_dur: float = 60.0, name: str = "voice") -> DataFrame:
    """The n longest voices of at least min_dur, equally long ones by name; n <= 0 keeps all."""
    rows = voices_.where(F.col("dur") >= min_dur)
    return rows if n <= 0 else rows.orderBy(F.col("dur").desc(), name).limit(n)


def conversions(sources: DataFrame, targets: DataFrame, item: str, members: str) -> DataFrame:
    """Every source with every target that doesn't contain it. Targets are the few of top_targets; where
    they are more than TARGETS they go in blocks of about as many, each by a reading of the sources,
    as each target meets every source in the result."""
    parts = -(-targets.count() // TARGETS) or 1
    block = F.pmod(F.xxhash64(*targets.columns), F.lit(parts))
    blocks = [targets.where(block == k) if parts > 1 else targets for k in range(parts)]
    met = reduce(DataFrame.unionByName, [sources.crossJoin(F.broadcast(b)) for b in blocks])
    return met.where(~F.array_contains(F.col(members), F.col(item)))


def sweep(df: DataFrame, group: str, item: str, embedding: str, duration: str, thresholds: list[float], cohesions: list[float]) -> DataFrame:
    """For each threshold and cohesion: clusters of 60 and of 30 seconds or more."""

    out = []
    for t in thresholds:
        rows = clustered(df, group, item, embedding, t, duration).withColumn("__v", F.struct(group, "cluster"))
        per = rows.groupBy("__v").agg(F.sum(duration).alias("total")).join(cohesion(rows, "__v", "e"), "__v")
        for c in cohesions:
            long = lambda s: F.sum((F.col("total") >= s).cast("long")).alias(f"n{s}")
            out.append(per.where(F.col("cohesion") >= c).agg(F.coalesce(long(60), F.lit(0)).alias("n60"), F.coalesce(long(30), F.lit(0)).alias("n30")).select(F.lit(float(t)).alias("threshold"), F.lit(float(c)).alias("min_cohesion"), "n60", "n30"))
    return reduce(DataFrame.unionByName, out)
