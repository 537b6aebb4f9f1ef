"""Scores of readings against gold, and the statistics around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _score(gold: pd.DataFrame, pred: pd.DataFrame) -> pd.DataFrame:
    from quire.functions.edit import distance
    from quire.functions.kernels import concordance, token_distance

    g, p = (x.sort_values("pos") if len(x) else pd.DataFrame(columns=["page_id", "pos", "text"]) for x in (gold, pred))
    page = (g if len(g) else p)["page_id"].iloc[0]
    gt, pt = g["text"].fillna("").tolist(), p["text"].fillna("").tolist()
    left = list(range(len(pt)))
    pairs, chars, wrong, words, bad = [], 0, 0, 0, 0
    dropped = 0
    for i, x in enumerate(gt):
        near = sorted((distance(x, pt[j]) / max(len(x), len(pt[j]), 1), abs(i - j), j) for j in left)
        chars += len(x)
        words += len(x.split())
        if near and near[0][0] <= 0.6:
            j = near[0][2]
            left.remove(j)
            pairs.append(j)
            wrong += distance(x, pt[j])
            bad += token_distance(x.split(), pt[j].split())
        else:
            dropped += 1
            wrong += len(x)
            bad += len(x.split())
    repeated = sum(pt[j] in gt for j in left)
    ok, n = concordance(pairs)
    row = (page, chars, wrong, words, bad, len(gt), dropped, len(left) - repeated, repeated, ok, n)
    return pd.DataFrame([row], columns=["page_id", "chars", "char_errors", "words", "word_errors", "lines", "dropped", "invented", "repeated", "pairs_right", "pairs"])


_PAGE = "page_id string, chars long, char_errors long, words long, word_errors long, lines long, dropped long, invented long, repeated long, pairs_right long, pairs long"


def score_pages(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per page: character and word errors of the lines that face each other, lines dropped, invented and repeated, order pairs.

    gold, pred: (page_id, pos, text). A page with no prediction is all errors. A page is one group.
    """
    c = ["page_id", "pos", "text"]
    return gold.select(*c).groupBy("page_id").cogroup(pred.select(*[F.col(x).alias(x) for x in c]).groupBy("page_id")).applyInPandas(_score, _PAGE)


def micro(pages: DataFrame, *by: str) -> DataFrame:
    """Error rates as sums of errors by sums of units."""
    rate = lambda a, b, n: F.round(F.try_divide(F.sum(a), F.sum(b)), 6).alias(n)
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), rate("char_errors", "chars", "cer"), rate("word_errors", "words", "wer"), rate("dropped", "lines", "dropped_share"), rate("pairs_right", "pairs", "order"))


def micro_by_kinds(pages: DataFrame, kinds: str, *by: str) -> DataFrame:
    """Rates over all pages, per column of `by`, and per kind, where a page counts in each of its kinds."""
    out = micro(pages.withColumn("group", F.lit("all")), "group")
    for c in by:
        out = out.unionByName(micro(pages.withColumn("group", F.concat_ws(":", F.lit(c), F.col(c))), "group"))
    return out.unionByName(micro(pages.withColumn("k", F.explode(kinds)).withColumn("group", F.concat_ws(":", F.lit("kind"), "k")), "group"))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(rate, lo, hi); nulls without cases."""
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    return F.when(n > 0, F.struct(p.alias("rate"), ((mid - half) / (1 + z2 / n)).alias("lo"), ((mid + half) / (1 + z2 / n)).alias("hi")))


def weighted_measure(rows: DataFrame, flag: Column, truth: Column, weight: Column, *by: str) -> DataFrame:
    """flagged, caught, left, precision and recall, each row counting its sampling weight."""
    s = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    g = rows.groupBy(*by).agg(s(flag).alias("flagged"), s(flag & truth).alias("caught"), s(~flag & truth).alias("left"))
    return g.withColumn("precision", F.try_divide(F.col("caught"), F.col("flagged"))).withColumn("recall", F.try_divide(F.col("caught"), F.col("caught") + F.col("left")))


def poisson_bootstrap(docs: DataFrame, errors: str, units: str, key: str, reps: int = 200) -> DataFrame:
    """(lo, hi) of sum(errors) / sum(units) when documents are redrawn; the weights come from hashes, so runs agree.

    Every document counts Poisson(1) times in each of `reps` redraws; only their sums are shuffled.
    """
    u = (F.pmod(F.xxhash64(F.col(key), F.col("rep")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts, total, term = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += term
        cuts.append(total)
        term /= i + 1
    times = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    r = docs.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("t", times).groupBy("rep").agg((F.sum(F.col(errors) * F.col("t")) / F.sum(F.col(units) * F.col("t"))).alias("x"))
    return r.agg(F.percentile("x", 0.025).alias("lo"), F.percentile("x", 0.975).alias("hi"))
