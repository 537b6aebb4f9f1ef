"""Pairwise matches consolidated into groups.

Seed-tree pruning. In each round every vertex connects its neighbourhood to the smallest key in it; a vertex that nobody
chose as smallest drops out of the graph and hangs in a forest below the smallest key it was connected to. The rest, at
most about half of the vertices, goes on. When no edge is left the seeds are the smallest keys of the components, and
their keys flow down the forest, from the last vertices that dropped out to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.skew import hot_join, hot_keys
from quire.session import cut
from quire.sources.tables import table

MOST_ROUNDS = 100


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def seed_tree(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(first_key, member_key): each key of a component other than its smallest (byte order), with that smallest key.

    Null ends link nothing; a key that is linked only with itself, or not at all, is a component of its own and has no
    row. Repeated pairs and pairs in both directions count once. Other columns are not looked at. An empty table gives
    no rows. Hubs are split: no task gets all pairs of a vertex.
    """
    e = pairs.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).where("u is not null and v is not null and u <> v")
    graph = cut(_both_ways(e))
    forest: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        least = graph.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        hubs = hot_keys(least, "u", "n")
        chosen = hot_join(graph, least.select("u", "m"), "u", hubs, F.col("v")).select("v", "m")
        chosen = cut(chosen.unionByName(least.select(F.col("u").alias("v"), "m")).distinct())
        own = chosen.groupBy("v").agg(F.min("m").alias("top"), F.max(F.col("m") == F.col("v")).alias("stays"), F.count("*").alias("n"))
        hubs = hot_keys(own, "v", "n")
        forest.append(cut(own.where(~F.col("stays")).select("v", "top")))
        rest = hot_join(chosen, own.select("v", "top"), "v", hubs, F.col("m")).where(F.col("m") != F.col("top"))
        graph = cut(_both_ways(rest.select(F.col("m").alias("u"), F.col("top").alias("v"))))
        if graph.isEmpty():
            break
    else:
        raise RuntimeError(f"edges are left after {MOST_ROUNDS} rounds")
    flowed: DataFrame | None = None
    for leaves in reversed(forest):
        if flowed is None:
            flowed = leaves.select(F.col("top").alias("first_key"), F.col("v").alias("member_key"))
            continue
        above = flowed.select(F.col("member_key").alias("top"), "first_key")
        hubs = hot_keys(leaves.groupBy("top").agg(F.count("*").alias("n")), "top", "n")
        down = hot_join(leaves, above, "top", hubs, F.col("v"), how="left").select(F.coalesce("first_key", "top").alias("first_key"), F.col("v").alias("member_key"))
        flowed = cut(flowed.unionByName(down))
    return flowed


def p6_found(spark, root: str) -> DataFrame:
    return seed_tree(table(spark, root, "ibid_draw"), "backref", "target")


def p6_sizes(spark, root: str) -> DataFrame:
    """How many components have how many keys."""
    g = p6_found(spark, root).groupBy("first_key").agg((F.count("*") + 1).alias("keys"))
    return g.groupBy("keys").agg(F.count("*").alias("components"))


_SQL = """
WITH RECURSIVE e AS (
  SELECT backref AS u, target AS v FROM ibid_draw WHERE backref IS NOT NULL AND target IS NOT NULL AND backref <> target
  UNION SELECT target, backref FROM ibid_draw WHERE backref IS NOT NULL AND target IS NOT NULL AND backref <> target),
reach AS (
  SELECT DISTINCT u, u AS v FROM e
  UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
found AS (SELECT min(v) AS first_key, u AS member_key FROM reach GROUP BY u HAVING min(v) <> u)
"""

QUERIES = {"p6_found": p6_found, "p6_sizes": p6_sizes}
ORACLE = {
    "p6_found": _SQL + "SELECT first_key, member_key FROM found",
    "p6_sizes": _SQL + "SELECT keys, count(*) AS components FROM (SELECT count(*) + 1 AS keys FROM found GROUP BY first_key) GROUP BY 1",
}
