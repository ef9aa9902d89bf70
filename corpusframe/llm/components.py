"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id of links (a, b), the smallest id that it reaches.

    Alternates two star steps until nothing changes, each time written to the shared folder:
    every id hands its smallest neighbour to its larger ones, then to its smaller ones. The
    number of steps grows with the logarithm of a component's size; no step gathers a
    neighbourhood, as only minima are aggregated. Links to itself name an id that stands alone."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    said = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # larger neighbours of a get a's least; a link to itself keeps an id in the list
        far = both.where("b > a").join(small(least, least.count()), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        handed = materialize(far.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(edges, least)
        least = materialize(handed.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        near = handed.join(small(least, least.count()), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(near.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(handed, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        said = now
