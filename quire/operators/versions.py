"""Upsert, versions, patches and provenance on plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key: the newest of both tables by `newest` (all descending); a key in either table stays.

    A null in a key is a value of its own. Extra columns of only one table become null in the other's rows. The choice is
    a partial aggregation (max_by), not a window, so a hot key is reduced before the shuffle.
    """
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in both.columns])


def unchanged(old: DataFrame, new: DataFrame, keys: list[str], sha: str) -> DataFrame:
    """Rows of `new` that need loading: their content hash isn't the one of the same key in `old`."""
    seen = old.select(*keys, F.col(sha).alias("__sha")).distinct()
    cond = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col(f"n.{sha}").eqNullSafe(F.col("o.__sha"))]
    return new.alias("n").join(seen.alias("o"), cond, "left_anti")


def chosen(assertions: DataFrame, keys: list[str], source: str, ranks: list[str], tie: list[str]) -> DataFrame:
    """One assertion per key: of the source that stands first in `ranks` (unknown sources last), then by `tie` ascending."""
    order = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(source))
    w = Window.partitionBy(*keys).orderBy(F.when(F.coalesce(order, F.lit(0)) == 0, len(ranks) + 1).otherwise(order), *tie)
    return assertions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def corrections_merge(held: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions already taken stay as they are; of the proposals only those for other keys are added."""
    return held.unionByName(proposed.join(held.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def overlay(words: DataFrame, corrections: DataFrame, key: str, text: str = "text", status: str = "applied") -> DataFrame:
    """Words with the text of applied corrections, and the text as it was. Corrections are unique by key among the applied."""
    c = corrections.where(F.col("status") == status).select(key, F.col(text).alias("__new"))
    return words.join(c, key, "left").withColumn("was", F.when(F.col("__new").isNotNull(), F.col(text))).withColumn(text, F.coalesce("__new", text)).drop("__new")


def inherited_ids(members: DataFrame, new_id: str, old_id: str) -> DataFrame:
    """(new_id, kept, retired): a new card keeps the id most of its members had (then the smallest), the others are retired."""
    n = members.where(F.col(old_id).isNotNull()).groupBy(new_id, old_id).agg(F.count("*").alias("n"))
    top = n.groupBy(new_id).agg(F.min_by(old_id, F.struct((-F.col("n")).alias("n"), old_id)).alias("kept"), F.collect_set(old_id).alias("all"))
    return top.select(new_id, "kept", F.array_sort(F.array_except("all", F.array("kept"))).alias("retired"))


def symmetric_diff(a: DataFrame, b: DataFrame, volatile: list[str] = ()) -> DataFrame:
    """Rows (with repeats) that only one of the tables has, but for volatile columns; `side` says which."""
    cols = [c for c in a.columns if c not in volatile]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))


#: Who goes before whom where patches touch the same thing.
RANKS = ("person", "judge", "retry")


def _applied(f):
    import pandas as pd

    taken: dict[str, str] = {}
    rows = []
    for r in f.sort_values(["rank", "created", "patch_id"]).itertuples():
        targets = [] if r.targets is None else list(r.targets)
        by = next((taken[x] for x in targets if x in taken and taken[x][0] < r.rank), None)
        if by is None:
            for x in targets:
                taken.setdefault(x, (r.rank, r.patch_id))
        rows.append((r.doc, r.patch_id, "applied" if by is None else "blocked", None if by is None else by[1]))
    return pd.DataFrame(rows, columns=["doc", "patch_id", "outcome", "blocked_by"])


def patch_outcomes(patches: DataFrame) -> DataFrame:
    """(doc, patch_id, outcome, blocked_by) of patches (doc, patch_id STRING, by, created, targets ARRAY<STRING>).

    A document's patches go in the order of RANKS (others last), then by time and id; a target that one of a higher rank
    has claimed blocks those below. A document's patches are bounded by its size, so they are one group. A patch without
    targets always applies.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RANKS)), F.col("by")), F.lit(0)), F.lit(len(RANKS) + 1)).cast("int")
    p = patches.select("doc", "patch_id", rank.alias("rank"), "created", "targets")
    return p.groupBy("doc").applyInPandas(_applied, "doc string, patch_id string, outcome string, blocked_by string")


def word_changes(then: DataFrame, now: DataFrame, keys: list[str], text: str, scope: DataFrame | None = None) -> DataFrame:
    """(keys, gone, added): rows whose words differ between two states, within the keys of `scope`; words as multisets."""
    words = lambda d, c: d.select(*keys, F.split(F.coalesce(text, F.lit("")), r"\s+").alias(c))
    x = words(then, "a").join(words(now, "b"), keys, "full")
    if scope is not None:
        x = x.join(scope.select(*keys).distinct(), keys, "left_semi")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    count = lambda ws, w: F.size(F.filter(ws, lambda v: v == w))
    more = lambda p, q: F.array_sort(F.filter(F.array_distinct(p), lambda w: (w != "") & (count(p, w) > count(q, w))))
    return x.select(*keys, more(a, b).alias("gone"), more(b, a).alias("added")).where((F.size("gone") > 0) | (F.size("added") > 0))
