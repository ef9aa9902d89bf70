"""Exact percentiles of groups of any size, by selection instead of sorting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's places should be off by a group's rows / ACCURACY at most; brackets are twice as wide.
ACCURACY = 1000
#: Groups whose brackets may be broadcast.
GROUPS_BOUND = 100_000


def same_groups(groups: list[str]) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return out


def exact_percentiles(df: DataFrame, groups: list[str], value: Column, shares: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """groups, n, percentiles (one for each share, between neighbours by linear interpolation).

    A percentile of n values lies between those at places floor(share * (n - 1)) and one more, from
    0. First a bounded sketch of each group gives two values that should bracket these places. One
    pass counts the values below and inside the bracket, which tells the part that does hold them; a
    second counts each value of that part: of a group, only a few thousandths' distinct values are
    ever ordered. A wrong sketch makes the part larger, never the result wrong. Null values
    don't count; a group with nothing else has nulls. Null groups are a group."""
    if not shares:
        raise ValueError("no shares")
    rows = df.select(*groups, value.cast("double").alias("__v"))
    wide = [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 / accuracy, 2 / accuracy)]
    sketch = F.percentile_approx("__v", F.array(*map(F.lit, wide)), F.lit(accuracy))
    told = rows.groupBy(*groups).agg(F.count("__v").alias("n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__b"))
    each = [
        F.struct(
            F.lit(k).alias("k"),
            (F.lit(float(s)) * (F.col("n") - 1)).alias("place"),
            F.col("__b")[2 * k].alias("low"),
            F.col("__b")[2 * k + 1].alias("high"),
            F.col("__min").alias("least"),
            F.col("__max").alias("most"),
        )
        for k, s in enumerate(shares)
    ]
    brackets = told.where("n > 0").select(*groups, F.array(*each).alias("__each"))
    many = brackets.limit(GROUPS_BOUND + 1).count() > GROUPS_BOUND
    side = brackets if many else F.broadcast(brackets)
    met = rows.where("__v is not null").alias("l").join(side.alias("r"), same_groups(groups)).select("l.*", "r.__each")
    asked = met.select(*groups, "__v", F.explode("__each").alias("__a")).select(*groups, "__v", "__a.*")
    within = F.col("__v").between(F.col("low"), F.col("high"))
    sizes = asked.groupBy(*groups, "k", "place", "low", "high", "least", "most").agg(
        F.count_if(F.col("__v") < F.col("low")).alias("below"), F.count_if(within).alias("inside")
    )
    # the part of the values that holds both places; it is the bracket unless the sketch was wrong
    early, late = F.floor("place") < F.col("below"), F.ceil("place") >= F.col("below") + F.col("inside")
    part = F.struct("k", "place", F.when(early, F.col("least")).otherwise(F.col("low")).alias("low"), F.when(late, F.col("most")).otherwise(F.col("high")).alias("high"), F.when(early, 0).otherwise(F.col("below")).alias("below"))
    parts = sizes.groupBy(*groups).agg(F.collect_list(part).alias("__each"))
    met = rows.where("__v is not null").alias("l").join((parts if many else F.broadcast(parts)).alias("r"), same_groups(groups)).select("l.*", "r.__each")
    asked = met.select(*groups, "__v", F.explode("__each").alias("__a")).select(*groups, "__v", "__a.*").where(within)
    counted = asked.groupBy(*groups, "k", "place", "below", F.col("__v").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*groups, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.col("below") + F.sum("c").over(w))
    at = upto.groupBy(*groups, "k", "place").agg(
        F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("b")
    )
    part = F.col("place") - F.floor("place")
    between = F.when((part == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    found = at.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("k", between.alias("v")))).alias("__m"))
    out = told.alias("l").join((found if many else F.broadcast(found)).alias("r"), same_groups(groups), "left")
    return out.select(*[F.col(f"l.{g}").alias(g) for g in groups], "l.n", F.array(*[F.try_element_at("r.__m", F.lit(k)) for k in range(len(shares))]).alias("percentiles"))
