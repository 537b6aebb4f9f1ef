"""Records that are one thing: components of links, keys that are nearly alike, cards, roles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import script_of
from quire.session import cut

MOST_ROUNDS = 60


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(key, first): every key of the pairs with the smallest key it is linked to, directly or over others.

    Stars in turn: each key's larger neighbours go to the smallest one around it, then its smaller ones do. Both steps are
    aggregations and joins on the key; rounds grow with the logarithm of the longest chain. Null ends link nothing but
    themselves; repeated pairs count once. An empty table gives no rows.
    """
    p = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    keys = p.select(F.col("u").alias("key")).unionByName(p.select(F.col("v").alias("key"))).where("key is not null").distinct()
    e = cut(p.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        before = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if e.count() == before.count() and e.exceptAll(before).isEmpty():
            break
    else:
        raise RuntimeError(f"edges still move after {MOST_ROUNDS} rounds")
    return keys.join(e.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("first")), "key", "left").select("key", F.coalesce("first", "key").alias("first"))


def _ratios(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from quire.functions.kernels import ratio

    for f in frames:
        yield f.assign(ratio=[ratio(x, y) for x, y in zip(f["a"], f["b"])])


def alike_keys(keys: DataFrame, key: str, least: float = 0.92, shortest: int = 8) -> DataFrame:
    """(a, b, ratio), a < b: keys of one script and `shortest` letters at least, whose ratio is `least` at least.

    Of two such keys, 2 (1 - least) / least of the shorter one's letters are unmatched in both together at most, each
    breaks three of its groups of three letters: of so many and one more of its groups, the other has one. The rarest
    find all pairs. Repeated keys count once, null ones not at all.
    """
    k = keys.select(F.col(key).alias("k")).where(F.length("k") >= shortest).distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("k") - 2), lambda i: F.substring("k", i, F.lit(3))))
    g = k.select("k", F.coalesce(script_of(F.col("k")), F.lit("-")).alias("s"), F.explode(grams).alias("g"))
    common = g.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(g.join(common, "g"))
    seek = F.floor(F.length("k") * 3 * 2 * (1 - least) / least + 1e-9).cast("int") + 1
    rare = shared.groupBy("k", "s").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("x")).select(F.col("k").alias("p"), "s", F.explode(F.slice("x", F.lit(1), F.least(seek, F.size("x")))).alias("x")).select("p", "s", F.col("x.g").alias("g"))
    fit = 2 * F.least(F.length("p"), F.length("k")) >= least * (F.length("p") + F.length("k"))
    met = rare.join(shared.select("k", "s", "g"), ["s", "g"]).where((F.col("p") != F.col("k")) & fit).select(F.least("p", "k").alias("a"), F.greatest("p", "k").alias("b")).distinct()
    return met.mapInPandas(_ratios, "a string, b string, ratio double").where(F.col("ratio") >= least)


def institution_clusters(mentions: DataFrame, key: Column, person: str | None = None) -> DataFrame:
    """(key, first): keys of institutions that are one: nearly alike in one script, or of one person in two scripts.

    mentions: one row for each, with a person's column where persons tell scripts apart: the key most mentions of a
    person have in one script goes with the one of the other.
    """
    m = mentions.withColumn("__k", key).where("__k <> ''")
    links = alike_keys(m, "__k").select("a", "b").unionByName(m.select(F.col("__k").alias("a"), F.col("__k").alias("b")).distinct())
    if person:
        n = m.where(F.col(person).isNotNull()).groupBy(F.col(person).alias("p"), script_of(F.col("__k")).alias("s"), "__k").agg(F.count("*").alias("n"))
        top = n.groupBy("p", "s").agg(F.max_by("__k", F.struct("n", "__k")).alias("k"))
        twins = top.groupBy("p").agg(F.max(F.when(F.col("s") == "Arab", F.col("k"))).alias("a"), F.max(F.when(F.col("s") == "Latn", F.col("k"))).alias("b")).where("a is not null and b is not null")
        links = links.unionByName(twins.select("a", "b"))
    return components(links, "a", "b")


def chosen_names(members: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name): of each group the name most members have, of equals the smallest."""
    n = members.where(F.col(name).isNotNull()).groupBy(group, name).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min_by(name, F.struct((-F.col("n")).alias("n"), name)).alias(name))


def resolved_persons(mentions: DataFrame) -> DataFrame:
    """(mention_id, person, method) of mentions (mention_id, key, authority, signal).

    An authority id first; then the only authority that bears the key, if just one does; then the key together with the
    second signal (a place of work, a fellow author); else the mention stays by itself. Null keys stay by themselves.
    """
    bearers = mentions.where("authority is not null and key is not null").select("key", "authority").distinct()
    only = bearers.groupBy("key").agg(F.count("*").alias("bearers"), F.min("authority").alias("only"))
    x = mentions.join(only, "key", "left")
    many = F.coalesce(F.col("bearers") > 1, F.lit(False))
    method = F.when(F.col("authority").isNotNull(), "authority").when(F.col("bearers") == 1, "key of one").when(F.col("key").isNotNull() & F.col("signal").isNotNull() & ~many, "key and signal").otherwise("alone")
    who = F.when(method == "authority", F.concat_ws(":", F.lit("a"), "authority")).when(method == "key of one", F.concat_ws(":", F.lit("a"), "only")).when(method == "key and signal", F.concat_ws(":", F.lit("k"), "key", "signal")).otherwise(F.concat_ws(":", F.lit("m"), F.col("mention_id").cast("string")))
    return x.select("mention_id", who.alias("person"), method.alias("method"))


def supervisions(contributors: DataFrame) -> DataFrame:
    """(record, supervisor, author): of each record's contributors (record, seq, role, name) those who supervised, and the first author."""
    first = contributors.where("role = 'author' and name is not null").groupBy("record").agg(F.min_by("name", F.struct("seq", "name")).alias("author"))
    return contributors.where("role = 'supervisor' and name is not null").select("record", F.col("name").alias("supervisor")).distinct().join(first, "record")


def carried_over(verdicts: DataFrame, now: DataFrame, subject: str, fingerprint: str) -> DataFrame:
    """The verdicts with `now_subject` and `state`: kept under their subject, moved to the one that has the fingerprint now, or stale."""
    n = now.select(F.col(subject).alias("__s"), F.col(fingerprint).alias("__f")).distinct()
    same = n.select(F.col("__s").alias(subject), F.col("__f").alias(fingerprint)).withColumn("__same", F.lit(True))
    moved = n.groupBy(F.col("__f").alias(fingerprint)).agg(F.min("__s").alias("__to"))
    x = verdicts.join(same, [subject, fingerprint], "left").join(moved, fingerprint, "left")
    return x.withColumn("now_subject", F.when(F.col("__same"), F.col(subject)).otherwise(F.col("__to"))).withColumn("state", F.when(F.col("__same"), "kept").when(F.col("__to").isNotNull(), "moved").otherwise("stale")).drop("__same", "__to")


def ranked_once(rows: DataFrame, by: list[str], order: list, top: int) -> DataFrame:
    """The `top` first rows of each group in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= top).drop("__n")
