"""Connected components of a link table by alternating large and small stars.

Every round is a grouped minimum and a join on the node, so a node with very many links is
split by Spark like any hot key, and nothing but two totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import stage


def _least(links: DataFrame) -> DataFrame:
    # written, so that Spark can split a hot node in the join that follows
    return stage(links.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")))
    return (
        down.join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node reachable.

    ``links`` has two columns of one orderable type, in any direction, repeats allowed.
    Rounds end when a round changes nothing; their number grows with the logarithm of the
    longest chain.
    """
    u, v = links.columns
    current = stage(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    state = _state(current)
    while state[0]:
        current = stage(_small_star(_large_star(current)))
        after = _state(current)
        if after == state:
            break
        state = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
