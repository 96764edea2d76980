"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable, for every node of links (a, b).

    Alternating large-star and small-star steps: every node links its larger
    (then its smaller) neighbours to the smallest node it sees, until nothing
    changes. Each step is a grouped minimum (combined before the shuffle) and a
    join back, so a node with any number of links is never gathered.
    """
    now = materialise(links.where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        after = materialise(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(),
            "links")
        # A star forest: nobody is both above and below.
        if after.join(after.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty() \
                and after.groupBy("hi").count().where("count > 1").isEmpty():
            roots = after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            return roots.unionByName(
                after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        now = after
