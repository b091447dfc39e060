"""Connected components by alternating large-star and small-star.

Each round is two groupBys with partial aggregation and two joins on a node, which Spark may split where a node
has very many links.  A round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.storage import cut, discard


def dealt_join(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``rows`` with the row of ``one`` that has their key, by a merge join.

    The hash as a second key makes Spark deal out both sides for this join, even where ``one`` is an aggregate by the key: only
    then may it split a key with very many rows.
    """
    return rows.withColumn("_h", F.hash(key)).join(one.withColumn("_h", F.hash(key)).hint("merge"), [key, "_h"]).drop("_h")


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Each link (a, b) with ``m`` of its a."""
    return dealt_join(links, least, "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``links`` (columns a, b); component is its smallest reachable node.

    Links with a null end and links of a node to itself are ignored.  No links: no rows.
    """
    links = cut(links.where("a is not null and b is not null and a != b").select("a", "b").distinct(), name)
    fingerprint = lambda f: f.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = None
    while (now := fingerprint(links)) != seen and now[0]:
        seen, before = now, links
        links = cut(_small_star(_large_star(before)), name)
        discard(before)
    # every link now goes from a node to the smallest of its component
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
