"""References to records that do not exist.

Keys are range-partitioned. The parents of a range are one sorted array; batches of references are probed against it by
binary search, and the misses are aggregated per child table and period. A range that holds more references than a task
should take (one hot key can hold a third of them) is dealt over several tasks, each with its own copy of the array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.tables import table

#: References that one task probes at a time, at most (on average).
PER_TASK = 200_000
#: Keys from which the cut points are drawn. They balance the tasks and have no influence on the result.
SPLITTER_SAMPLE = 20_000
MOST_RANGES = 4096
#: White space in the sense of Unicode, for Java's and RE2's regular expressions.
BLANK = r"[\s\p{Z}]"
PROBED = "child string, parent string, row_id long, loaded timestamp, reason string"


def normal_key(c: Column) -> Column:
    """A key without surrounding white space and case; null for null and blank."""
    k = F.lower(F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", ""))
    return F.when(k != "", k)


def references(df: DataFrame, child: str, parent: str, key: str, row_id: str, loaded: str) -> DataFrame:
    """(child, parent, key, row_id, loaded) of the rows that refer to something."""
    return df.select(
        F.lit(child).alias("child"), F.lit(parent).alias("parent"), normal_key(F.col(key)).alias("key"), F.col(row_id).cast("long").alias("row_id"), F.col(loaded).alias("loaded")
    ).where(F.col("key").isNotNull())


def parent_keys(df: DataFrame, parent: str, key: str, loaded: str, withdrawn: str) -> DataFrame:
    """(parent, key, alive, since): per key whether a row is not withdrawn, and the earliest load of those."""
    alive = F.col(withdrawn).isNull()
    return (
        df.select(normal_key(F.col(key)).alias("key"), alive.alias("a"), F.when(alive, F.col(loaded)).alias("l"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("a").alias("alive"), F.min("l").alias("since"))
        .select(F.lit(parent).alias("parent"), "key", "alive", "since")
    )


def _full_key() -> Column:
    return F.concat_ws("\x1f", "parent", "key")


def _ranged(cuts: list[str]):
    @F.pandas_udf(T.IntegerType())
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, dtype=object), k.to_numpy(dtype=object), side="right").astype("int32"))

    return range_of


def _probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    out = refs[["child", "parent", "row_id", "loaded"]].copy()
    if len(parents) == 0:
        return out.assign(reason="missing")
    row = parents.iloc[0]
    keys = np.array(row["ks"], dtype=object)
    k = refs["k"].to_numpy(dtype=object)
    at = np.searchsorted(keys, k)
    hit = at < len(keys)
    hit[hit] = keys[at[hit]] == k[hit]
    at[~hit] = 0
    alive = np.array(row["alive"], dtype=bool)[at]
    since = np.array(pd.array(row["since"], dtype="Int64").to_numpy(dtype="float64", na_value=np.nan))[at]
    late = since > refs["us"].astype("float64").to_numpy()
    out["reason"] = np.where(~hit, "missing", np.where(~alive, "deleted", np.where(late, "late", None)))
    return out


def probe(refs: DataFrame, parents: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Each reference with its reason: missing, deleted, late, or null where it holds.

    refs: (child, parent, key, row_id, loaded), parents: (parent, key, alive, since), unique by (parent, key).
    Null load times are never late. An empty table of parents makes every reference missing; no references give no
    rows; repeated rows are kept. Columns beyond the named ones are not looked at.
    """
    r = refs.select("child", "parent", "row_id", "loaded", _full_key().alias("k"), F.unix_micros("loaded").alias("us"))
    p = parents.select(_full_key().alias("k"), "alive", F.unix_micros("since").alias("since"))
    n = r.count() + p.count()
    ranges = min(MOST_RANGES, max(1, math.ceil(n / per_task)))
    cuts: list[str] = []
    if ranges > 1:
        seen = sorted({x[0] for x in r.select("k").unionByName(p.select("k")).orderBy(F.xxhash64("k")).limit(SPLITTER_SAMPLE).collect()})
        cuts = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)})
    range_of = _ranged(cuts)
    r = r.withColumn("rng", range_of("k") if cuts else F.lit(0))
    p = p.withColumn("rng", range_of("k") if cuts else F.lit(0))
    held = {x["rng"]: x["n"] for x in r.groupBy("rng").agg(F.count("*").alias("n")).collect()}
    tasks = [max(1, math.ceil(held.get(i, 0) / per_task)) for i in range(len(cuts) + 1)]
    fan = F.element_at(F.array(*[F.lit(t) for t in tasks]), F.col("rng") + 1)
    r = r.withColumn("part", F.pmod(F.xxhash64("row_id", "child"), fan).cast("int"))
    arrays = p.groupBy("rng").agg(F.sort_array(F.collect_list(F.struct("k", "alive", "since"))).alias("s"))
    arrays = arrays.select(
        "rng", F.col("s.k").alias("ks"), F.col("s.alive").alias("alive"), F.col("s.since").alias("since"), F.explode(F.sequence(F.lit(0), (fan - 1).cast("int"))).alias("part")
    )
    return r.groupBy("rng", "part").cogroup(arrays.groupBy("rng", "part")).applyInPandas(lambda a, b: _probe(a, b) if len(a) else pd.DataFrame(columns=["child", "parent", "row_id", "loaded", "reason"]), PROBED)


def orphan_report(probed: DataFrame) -> DataFrame:
    """(child, parent, period, with_value, orphans): references and misses per child and month of its load."""
    return probed.groupBy("child", "parent", F.date_format("loaded", "yyyy-MM").alias("period")).agg(F.count("*").alias("with_value"), F.count("reason").alias("orphans"))


def archive_probe(spark, root: str) -> DataFrame:
    """All references of the archive's run tables, probed."""
    ar, runs, articles = (table(spark, root, t) for t in ("article_runs", "runs", "articles"))
    refs = (
        references(ar, "article_runs.stem", "articles.stem", "stem", "ar_id", "loaded")
        .unionByName(references(ar, "article_runs.run", "runs.run", "run", "ar_id", "loaded"))
        .unionByName(references(runs, "runs.parent_run", "runs.run", "parent_run", "run_no", "loaded"))
    )
    parents = parent_keys(articles, "articles.stem", "stem", "loaded", "withdrawn").unionByName(parent_keys(runs, "runs.run", "run", "loaded", "withdrawn"))
    return probe(refs, parents)


def p4_found(spark, root: str) -> DataFrame:
    return archive_probe(spark, root).where(F.col("reason").isNotNull()).select("child", "row_id", "reason")


def p4_report(spark, root: str) -> DataFrame:
    return orphan_report(archive_probe(spark, root))


_SQL_REFS = r"""
WITH refs AS (
  SELECT 'article_runs.stem' AS child, 'articles.stem' AS parent, stem AS raw, ar_id AS row_id, loaded FROM article_runs
  UNION ALL SELECT 'article_runs.run', 'runs.run', run, ar_id, loaded FROM article_runs
  UNION ALL SELECT 'runs.parent_run', 'runs.run', parent_run, run_no, loaded FROM runs),
par AS (
  SELECT 'articles.stem' AS parent, stem AS raw, loaded, withdrawn FROM articles
  UNION ALL SELECT 'runs.run', run, loaded, withdrawn FROM runs),
r AS (SELECT child, parent, row_id, loaded, lower(regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key FROM refs),
p AS (
  SELECT parent, lower(regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS key,
         bool_or(withdrawn IS NULL) AS alive, min(CASE WHEN withdrawn IS NULL THEN loaded END) AS since
  FROM par GROUP BY 1, 2),
probed AS (
  SELECT r.child, r.parent, r.row_id, r.loaded,
         CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT p.alive THEN 'deleted' WHEN p.since > r.loaded THEN 'late' END AS reason
  FROM r LEFT JOIN p ON r.parent = p.parent AND r.key = p.key WHERE r.key <> '')
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLE = {
    "p4_found": _SQL_REFS + "SELECT child, row_id, reason FROM probed WHERE reason IS NOT NULL",
    "p4_report": _SQL_REFS
    + "SELECT child, parent, strftime(loaded AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS with_value, count(reason) AS orphans FROM probed GROUP BY 1, 2, 3",
}
