"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the smallest node it reaches.

    Rounds double the reach, each writes its links to the shared folder, and
    nothing but two numbers comes to the driver. Neighbours are only ever
    summed to their minimum, so a node with very many links is no hot group.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialise(links, "links")
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
        # Each link gives one row here, so none need be told apart before the small stars.
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b"), "links")
        released(links)
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).where("b <> m").select("b", "m").union(least).toDF("a", "b")
        links = materialise(small.distinct(), "links")
        released(large)
        # Over when all are stars: no node has two links, or one and is a root.
        ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or up = 1 and down = 1").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
