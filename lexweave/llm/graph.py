"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to one row (id, component) for each end of a link; component: the least id reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until nothing changes; each round's links are written
    to the shared folder, so that plans stay short and a lost executor costs one round. Only counts reach the driver.
    """
    edge = lambda df, u, v: df.select(F.col(u).alias("u"), F.col(v).alias("v"))
    now = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edge(now, "u", "v").unionByName(edge(now, "v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # Small star: all links point from greater to less.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(small.where(F.col("u") != F.col("v")).distinct())
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component")).distinct()
