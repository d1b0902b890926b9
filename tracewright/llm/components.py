"""Connected components of a table of links, by alternating large and small stars.

Each round is two groupings with joins. Least neighbours are aggregates that combine before the
shuffle, and are written before the join to them, so that Spark splits the links of a hub when
the join runs. Tables are cut with checkpoint() each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b to links of stars around least neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.saved(both.groupBy("a").agg(F.min("b").alias("__m")).withColumn("__m", F.least("a", "__m")))
        out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("__m").alias("b"))
    else:
        least = common.saved(links.groupBy("a").agg(F.min("b").alias("__m")))
        out = links.join(least, "a").select(F.col("b").alias("a"), F.col("__m").alias("b")).filter("a > b").unionByName(least.select("a", F.col("__m").alias("b")))
    return out.distinct()


def _print(links: DataFrame) -> tuple:
    # a sum of hashes modulo a prime, so that it can't overflow
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2_147_483_647)))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of a link, the least node it is connected with.

    Links may repeat and have either direction; links from a node to itself and
    null ends are ignored; an empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    current = common.saved(links.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    seen = _print(current)
    while seen[0]:
        current = common.saved(_star(_star(current, True), False))
        now = _print(current)
        if now == seen:
            break
        seen = now
    # now every link leads from a node to the least one of its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
