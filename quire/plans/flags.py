"""All doubts about an article as one relation: a kind of doubt each, with its severity and number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire.plans import archive, layout, quality

QUERIES, ORACLE = {}, {}
#: (query, kind of doubt, severity): queries with a row for each doubtful thing of an article, in its column stem.
KINDS = [
    (layout, "order_inversions", "medium"), (layout, "lines_placed_twice", "low"), (layout, "doubtful_runs", "high"), (quality, "outlier_pages", "medium"), (quality, "interval_overlaps", "low"),
    (quality, "level_jump", "low"), (archive, "pages_without_head", "low"),
]


def doubt_flags(spark, folder):
    """(stem, kind, severity, places): every article's doubts."""
    of = lambda m, q, sev: m.QUERIES[q](spark, folder).groupBy("stem").agg(F.count("*").alias("places")).select("stem", F.lit(q).alias("kind"), F.lit(sev).alias("severity"), "places")
    return reduce(lambda a, b: a.unionByName(b), [of(*k) for k in KINDS])


def worst_flags(spark, folder):
    """(stem, worst, kinds, places): an article's worst severity, how many kinds of doubt it has, and in how many places."""
    from quire.operators.trust import severity_rank

    return doubt_flags(spark, folder).groupBy("stem").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("kinds"), F.sum("places").alias("places"))


_SQL = " UNION ALL ".join(f"SELECT stem, '{q}' AS kind, '{sev}' AS severity, count(*) AS places FROM ({m.ORACLE[q]}) GROUP BY 1" for m, q, sev in KINDS)
QUERIES |= {"doubt_flags": doubt_flags, "worst_flags": worst_flags}
ORACLE |= {
    "doubt_flags": _SQL,
    "worst_flags": f"SELECT stem, arg_min(severity, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS worst, count(*) AS kinds, CAST(sum(places) AS BIGINT) AS places FROM ({_SQL}) GROUP BY 1",
}
