"""Connected components of an edge table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import materialize, release


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every node that has an edge to another; component is the smallest id reachable.

    `edges` has columns a, b; repeated and reversed edges and loops do no harm. Each round cuts the
    lineage by a written table. Rounds grow as the logarithm of the longest path, and end when every id that isn't
    the least of its component hangs on one that is.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "edges")
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(joined.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        release(now)
        now = after
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return materialize(stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
