"""Connected components of a link table, by alternating large and small stars.

Each round is a minimum per node (combined before the shuffle) and a join, so a
hub with very many links is one aggregation row, in a table of its own, and a
join that Spark may split.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.storage import written_table


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """``edges`` (u, v) to (u, least): everything a node sees moves to its least neighbour."""
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written_table(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = edges.join(least, "u")
    if both_ways:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between long ids to (node, component): the least id reachable.

    Nodes without links to other nodes are left out; nulls are ignored.
    """
    now = written_table(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
                        .where("u is not null and v is not null and u != v").distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = mark
        now = written_table(_star(_star(now, True), False), "links")
