"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """Links ``(u, v)`` of long ids -> ``(u, root)``: for every vertex that has a smaller one in its component, the smallest.

    Each round is two joins on a vertex with its least neighbour (an aggregate that combines before the
    shuffle), so a hub is never gathered in one task. Rounds grow as the logarithm of the longest path.
    Each is written to the shared folder, and the rounds end when one changes nothing. Self-links and
    nulls are left out; no links give no rows.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select("u", F.col("v").alias("root"))
        mark = seen
        now = written(_small_star(_large_star(now)).where("u <> v").distinct(), "links")
