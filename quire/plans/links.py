"""Links found by search over whole tables: works, quotations, near duplicates, titles in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import linkage as L
from quire.plans.citations import t
from quire.plans.texts import fold_sql, folded, worded, words_sql
from quire.session import cut

QUERIES, ORACLE = {}, {}
#: Words of a shingle, and the share of the smaller text's shingles that near duplicates share.
SHINGLE, ALIKE = 5, 0.8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def linkage_score(s, d):
    """(stem, work_stem, title_ratio, score, best): each article of `masters` with the works of `catalogue` alike enough, of whatever stem.

    The articles have no authors; the language takes that weight. Equal titles are compared once.
    """
    a = t(s, d, "articles").where("title is not null").select("source", "stem", folded("title").alias("title"), F.col("language").alias("author"), F.col("pub_year").alias("year")).where("title <> ''").distinct()
    cited, works = a.where("source = 'masters'"), a.where("source = 'catalogue'")
    alike = L.alike_titles(cited.select("title").distinct(), works.select("title").distinct())
    right = works.select(F.col("title").alias("work_title"), F.col("stem").alias("work_stem"), F.col("author").alias("a2"), F.col("year").alias("y2"))
    x = cited.join(alike, "title").join(right, "work_title").withColumn("score", L.score("title_ratio", "author", "a2", "year", "y2"))
    x = x.groupBy("stem", "work_stem").agg(F.round(F.max("title_ratio"), 6).alias("title_ratio"), F.round(F.max("score"), 6).alias("score"))
    return L.best(x, "stem", "work_stem")


@query()
def quotation_matches(s, d):
    """(doc_id, ref_id, first, last, matched, span): the runs of words in which documents quote eval_items."""
    docs = t(s, d, "documents")
    found = L.quotations(worded(docs, "doc_id", w="words"), worded(t(s, d, "eval_items").withColumnRenamed("item_id", "ref_id"), "ref_id", w="words"))
    # Ids are unique as a rule; only where they aren't do all runs have to meet.
    return found if docs.groupBy("doc_id").count().where("count > 1").isEmpty() else found.distinct()


_GRAMS = f"""w AS (SELECT doc_id, {words_sql("text")} AS w FROM documents), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id, w FROM w WHERE len(w) > 0),
  g AS (SELECT doc_id, CASE WHEN len(w) >= {SHINGLE} THEN list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) ELSE [array_to_string(w, ' ')] END AS g FROM c WHERE doc_id = class_id),
  e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
  p AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) AS share FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) / least(any_value(x.n), any_value(y.n)) >= {ALIKE})"""


def _classes(s, d) -> DataFrame:
    """(doc_id, class_id, g): a class is documents of equal words, named by the smallest of them; g are hashes of its
    shingles. Documents without words have none. The texts are read and folded once."""
    w = worded(t(s, d, "documents"), "doc_id").where("size(w) > 0")
    grams = F.when(F.size("w") >= SHINGLE, X.ngram_hashes(F.col("w"), SHINGLE)).otherwise(F.array(F.xxhash64("w")))
    w = cut(w.select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("h"), F.array_distinct(grams).alias("g")))
    return w.join(w.groupBy("h").agg(F.min("doc_id").alias("class_id")), "h").drop("h")


def _near(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, share) of (doc_id, g). Of any (1 - ALIKE) n + 1 of a document's n shingles, a document that shares
    ALIKE of them has one: the rarest ones find all pairs, which are then counted."""
    docs = docs.select("doc_id", "g")
    each = docs.select("doc_id", F.size("g").alias("n"), F.explode("g").alias("g"))
    df = each.groupBy("g").agg(F.count("*").alias("df"))
    shared = each.join(df.where("df > 1"), "g")
    # Shingles of one document only come first and find nothing: of the others, as many fewer are looked up.
    own = shared.groupBy("doc_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    left = F.floor((1 - ALIKE) * F.col("n") + 1e-9) + 1 - (F.col("n") - F.size("s"))
    seek = own.where(left > 0).select("doc_id", "n", F.explode(F.slice("s", F.lit(1), F.least(left.cast("int"), F.size("s")))).alias("s")).select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s.g").alias("g"))
    pairs = seek.join(shared.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "g"), "g").where("na < nb or (na = nb and a <> b)").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
    x = pairs.join(docs.select(F.col("doc_id").alias("doc_a"), F.col("g").alias("ga")), "doc_a").join(docs.select(F.col("doc_id").alias("doc_b"), F.col("g").alias("gb")), "doc_b")
    return x.select("doc_a", "doc_b", X.tokset("ga", "gb").alias("share")).where(F.col("share") >= ALIKE).withColumn("share", F.round("share", 6))


@query(f"WITH {_GRAMS} SELECT doc_a, doc_b, share FROM p")
def near_duplicates(s, d):
    """(doc_a, doc_b, share), doc_a < doc_b: classes that share ALIKE of the smaller one's shingles, by their first documents."""
    return _near(_classes(s, d).where("doc_id = class_id"))


@query(f"WITH {_GRAMS}, l AS (SELECT doc_a AS k FROM p UNION ALL SELECT doc_b FROM p), n AS (SELECT k, count(*) AS n FROM l GROUP BY 1) SELECT c.doc_id, c.class_id, coalesce(n.n, 0) AS links FROM c LEFT JOIN n ON c.class_id = n.k")
def near_duplicate_classes(s, d):
    """(doc_id, class_id, links): every document with words, its class and how many other classes are near it."""
    c = _classes(s, d)
    p = _near(c.where("doc_id = class_id"))
    n = p.select(F.col("doc_a").alias("class_id")).unionByName(p.select(F.col("doc_b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    return c.select("doc_id", "class_id").join(n, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""WITH a AS (SELECT DISTINCT stem, {fold_sql("title")} AS k FROM articles), o AS (SELECT doc_id, ' ' || {fold_sql("text")} || ' ' AS body FROM documents)
  SELECT DISTINCT stem, doc_id FROM (SELECT * FROM a WHERE length(k) >= 8 AND contains(k, ' ')) a JOIN o ON contains(body, ' ' || k || ' ')""")
def title_inside_text(s, d):
    """(stem, doc_id): articles whose title, of two words and eight characters at least, stands in a document, of whatever stem."""
    a = cut(t(s, d, "articles").where("title is not null").select("stem", folded("title").alias("k")).where("length(k) >= 8 and contains(k, ' ')").distinct())
    return L.phrases_inside(worded(t(s, d, "documents"), "doc_id"), a).select("stem", "doc_id").distinct()
