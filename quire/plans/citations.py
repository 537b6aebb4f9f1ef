"""Citation and catalogue views. lineitem stands for citation mentions, orders for the citing publications, part for the
cited works, supplier and customer for authors; the archive's own tables stand for themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.sources.tables import table as t

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _n(cond):
    return F.sum(cond.cast("long"))


@query("""SELECT l_partkey AS work, count(DISTINCT l_orderkey) AS pubs, count(*) AS mentions,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS full_mentions,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS short_mentions FROM lineitem GROUP BY 1""")
def times_cited(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(
        F.countDistinct("l_orderkey").alias("pubs"), F.count("*").alias("mentions"), _n(F.col("l_returnflag") == "A").alias("full_mentions"), _n(F.col("l_returnflag") == "N").alias("short_mentions")
    )


@query("""WITH best AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS k
  FROM lineitem WHERE l_linestatus = 'F')
  SELECT p_brand AS brand, count(DISTINCT l_orderkey) AS pubs, count(DISTINCT l_partkey) AS works FROM best JOIN part ON l_partkey = p_partkey WHERE k = 1 GROUP BY 1""")
def pub_times_cited(s, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")
    best = t(s, d, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("k")).where("k = 1")
    return best.join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.countDistinct("l_orderkey").alias("pubs"), F.countDistinct("l_partkey").alias("works"))


@query("""SELECT l_partkey AS work, max(l_extendedprice) AS score, arg_min(l_orderkey, (-l_extendedprice, l_orderkey)) AS best FROM lineitem GROUP BY 1""")
def best_link_per_group(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.max("l_extendedprice").alias("score"), F.min_by("l_orderkey", F.struct(-F.col("l_extendedprice"), "l_orderkey")).alias("best"))


@query("""SELECT c_nationkey AS citing, s_nationkey AS cited, count(*) AS mentions, count(DISTINCT l_orderkey) AS pubs, CAST(c_nationkey = s_nationkey AS INT) AS self
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 5""")
def journal_citation_pairs(s, d):
    x = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("c_nationkey").alias("citing"), F.col("s_nationkey").alias("cited")).agg(F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("pubs")).withColumn("self", (F.col("citing") == F.col("cited")).cast("int"))


@query("""SELECT DISTINCT o_custkey AS author, l_suppkey AS cited FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey WHERE l_returnflag <> 'R'""")
def author_self_citations(s, d):
    x = t(s, d, "lineitem").where("l_returnflag <> 'R'").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(t(s, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select(F.col("o_custkey").alias("author"), F.col("l_suppkey").alias("cited")).distinct()


@query("""SELECT issue_id, count(*) AS articles, CAST(sum(CASE WHEN b.stem IS NOT NULL THEN 1 END) AS BIGINT) AS with_blocks, CAST(sum(b.pages) AS BIGINT) AS pages
  FROM (SELECT DISTINCT issue_id, stem FROM articles) a LEFT JOIN (SELECT stem, count(DISTINCT page) AS pages FROM blocks GROUP BY 1) b ON a.stem = b.stem GROUP BY 1""")
def issue_coverage(s, d):
    b = t(s, d, "blocks").groupBy("stem").agg(F.countDistinct("page").alias("pages"))
    a = t(s, d, "articles").select("issue_id", "stem").distinct().join(b, "stem", "left")
    return a.groupBy("issue_id").agg(F.count("*").alias("articles"), F.sum(F.when(F.col("pages").isNotNull(), 1)).alias("with_blocks"), F.sum("pages").alias("pages"))


@query("""SELECT rule, count(*) AS blocks, count(verdict) AS reviewed, CAST(sum(CASE WHEN verdict = 'content' THEN 1 ELSE 0 END) AS BIGINT) AS kept,
  round(sum(CASE WHEN verdict = 'content' THEN 1.0 ELSE 0 END) / nullif(count(verdict), 0), 6) AS precision FROM heldout_blocks GROUP BY 1""")
def judge_precision(s, d):
    ok = F.sum((F.coalesce(F.col("verdict"), F.lit("")) == "content").cast("long"))
    return t(s, d, "heldout_blocks").groupBy("rule").agg(F.count("*").alias("blocks"), F.count("verdict").alias("reviewed"), ok.alias("kept")).withColumn("precision", F.round(F.try_divide(F.col("kept").cast("double"), F.nullif(F.col("reviewed"), F.lit(0))), 6))


@query("""SELECT DISTINCT a.stem, a.source AS source_a, b.source AS source_b, a.pub_year AS year_a, b.pub_year AS year_b FROM articles a JOIN articles b ON a.stem = b.stem
  WHERE (a.loaded < b.loaded) AND (coalesce(a.title, '') <> coalesce(b.title, '') OR coalesce(a.pub_year, 0) <> coalesce(b.pub_year, 0) OR coalesce(a.language, '') <> coalesce(b.language, ''))""")
def catalogue_disagreements(s, d):
    a = t(s, d, "articles")
    b = a.select("stem", *[F.col(c).alias(f"{c}_b") for c in ("source", "pub_year", "title", "language", "loaded")])
    no = lambda c, z: F.coalesce(F.col(c), F.lit(z)) != F.coalesce(F.col(f"{c}_b"), F.lit(z))
    x = a.join(b, "stem").where((F.col("loaded") < F.col("loaded_b")) & (no("title", "") | no("pub_year", 0) | no("language", "")))
    return x.select("stem", F.col("source").alias("source_a"), F.col("source_b"), F.col("pub_year").alias("year_a"), F.col("pub_year_b").alias("year_b")).distinct()


@query("""WITH o AS (SELECT DISTINCT stem, run FROM article_runs WHERE current = 0 AND stem IS NOT NULL), n AS (SELECT DISTINCT stem FROM article_runs WHERE current = 1 AND stem IS NOT NULL)
  SELECT o.run, CASE WHEN n.stem IS NULL THEN 'gone' ELSE 'kept' END AS fate, count(*) AS stems FROM o LEFT JOIN n ON o.stem = n.stem WHERE o.stem IN (SELECT stem FROM articles) GROUP BY 1, 2""")
def flag_lifecycle(s, d):
    r = t(s, d, "article_runs").where("stem is not null")
    o, n = r.where("current = 0").select("stem", "run").distinct(), r.where("current = 1").select("stem").distinct().withColumn("there", F.lit(1))
    x = o.join(t(s, d, "articles").select("stem").distinct(), "stem", "left_semi").join(n, "stem", "left")
    return x.groupBy("run", F.when(F.col("there").isNull(), "gone").otherwise("kept").alias("fate")).agg(F.count("*").alias("stems"))


@query("""WITH w AS (SELECT block_pk, min(conf) AS low, CAST(sum(CASE WHEN conf < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS fixes FROM words GROUP BY 1)
  SELECT b.block_pk, round(greatest(0.05, (CASE WHEN low < 0.6 THEN 0.6 ELSE 1.0 END) * power(0.9, least(coalesce(fixes, 0), 3)) * (CASE WHEN b.role IS NULL THEN 0.8 ELSE 1.0 END)), 6) AS trust
  FROM blocks b LEFT JOIN w ON b.block_pk = w.block_pk""")
def block_trust(s, d):
    w = t(s, d, "words").groupBy("block_pk").agg(F.min("conf").alias("low"), F.sum(F.when(F.col("conf") < 0.8, 1).otherwise(0)).alias("fixes"))
    trust = F.when(F.col("low") < 0.6, 0.6).otherwise(1.0) * F.pow(F.lit(0.9), F.least(F.coalesce("fixes", F.lit(0)), F.lit(3))) * F.when(F.col("role").isNull(), 0.8).otherwise(1.0)
    return t(s, d, "blocks").join(w, "block_pk", "left").select("block_pk", F.round(F.greatest(F.lit(0.05), trust), 6).alias("trust"))


@query("""WITH a AS (SELECT stem, arg_max(title, (loaded, source)) AS title, count(*) AS deliveries FROM articles GROUP BY 1),
  r AS (SELECT stem, count(*) AS runs, max(made) AS last_made FROM article_runs WHERE stem IS NOT NULL GROUP BY 1), b AS (SELECT stem, count(*) AS blocks, max(page) AS last_page FROM blocks GROUP BY 1)
  SELECT a.stem, title, deliveries, coalesce(runs, 0) AS runs, last_made, blocks, last_page FROM a LEFT JOIN r ON a.stem = r.stem LEFT JOIN b ON a.stem = b.stem""")
def article_overview(s, d):
    a = t(s, d, "articles").groupBy("stem").agg(F.max_by("title", F.struct("loaded", "source")).alias("title"), F.count("*").alias("deliveries"))
    r = t(s, d, "article_runs").where("stem is not null").groupBy("stem").agg(F.count("*").alias("n"), F.max("made").alias("last_made"))
    b = t(s, d, "blocks").groupBy("stem").agg(F.count("*").alias("blocks"), F.max("page").alias("last_page"))
    return a.join(r, "stem", "left").join(b, "stem", "left").select("stem", "title", "deliveries", F.coalesce("n", F.lit(0)).alias("runs"), "last_made", "blocks", "last_page")


@query("""SELECT stem, count(*) AS words, CAST(sum(CASE WHEN conf < 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN conf >= 0.6 AND conf < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
  string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM words GROUP BY 1""")
def flags_per_article(s, d):
    c = F.col("conf")
    return t(s, d, "words").groupBy("stem").agg(
        F.count("*").alias("words"), F.sum(F.when(c < 0.6, 1).otherwise(0)).alias("high"), F.sum(F.when((c >= 0.6) & (c < 0.8), 1).otherwise(0)).alias("medium"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("lang")), ","), F.lit("")).alias("langs"),
    )


@query("""SELECT 'article' AS kind, stem AS subject, source AS evidence FROM articles UNION ALL SELECT 'run', stem, run FROM article_runs WHERE stem IS NOT NULL
  UNION ALL SELECT 'affiliation', stem, orgname FROM affiliations WHERE orgname IS NOT NULL""")
def evidence_union_all(s, d):
    pick = lambda n, k, c: t(s, d, n).where(f"stem is not null and {c} is not null").select(F.lit(k).alias("kind"), F.col("stem").alias("subject"), F.col(c).alias("evidence"))
    return t(s, d, "articles").select(F.lit("article").alias("kind"), F.col("stem").alias("subject"), F.col("source").alias("evidence")).unionByName(pick("article_runs", "run", "run")).unionByName(pick("affiliations", "affiliation", "orgname"))


@query("""SELECT 'articles only' AS side, count(*) AS stems FROM (SELECT stem FROM articles EXCEPT SELECT stem FROM blocks)
  UNION ALL SELECT 'blocks only', count(*) FROM (SELECT stem FROM blocks EXCEPT SELECT stem FROM articles)""")
def except_both_ways(s, d):
    a, b = t(s, d, "articles").select("stem"), t(s, d, "blocks").select("stem")
    n = lambda x, k: x.agg(F.count("*").alias("stems")).select(F.lit(k).alias("side"), "stems")
    return n(a.subtract(b), "articles only").unionByName(n(b.subtract(a), "blocks only"))


@query("""WITH k AS (SELECT stem, 1 AS a, 0 AS b, 0 AS c, 0 AS e FROM articles UNION ALL SELECT stem, 0, 1, 0, 0 FROM blocks UNION ALL SELECT stem, 0, 0, 1, 0 FROM documents WHERE stem IS NOT NULL
  UNION ALL SELECT lower(trim(stem)), 0, 0, 0, 1 FROM article_runs WHERE stem IS NOT NULL),
  f AS (SELECT stem, max(a) AS in_articles, max(b) AS in_blocks, max(c) AS in_documents, max(e) AS in_runs FROM k GROUP BY 1) SELECT in_articles, in_blocks, in_documents, in_runs, count(*) AS stems FROM f GROUP BY 1, 2, 3, 4""")
def id_overlap_inventory(s, d):
    cols = ["in_articles", "in_blocks", "in_documents", "in_runs"]
    one = lambda n, k, c="stem": t(s, d, n).where("stem is not null").select(F.expr(c).alias("stem"), *[F.lit(int(x == k)).alias(x) for x in cols]).distinct()
    k = one("articles", cols[0]).unionByName(one("blocks", cols[1])).unionByName(one("documents", cols[2])).unionByName(one("article_runs", cols[3], "lower(trim(stem))"))
    return k.groupBy("stem").agg(*[F.max(c).alias(c) for c in cols]).groupBy(*cols).agg(F.count("*").alias("stems"))


@query("""SELECT 'words.block_pk' AS child, count(*) AS orphans FROM words w WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.block_pk = w.block_pk)
  UNION ALL SELECT 'blocks.stem', count(*) FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.stem = b.stem)
  UNION ALL SELECT 'affiliations.stem', count(*) FROM affiliations b WHERE b.stem IS NOT NULL AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.stem = b.stem)""")
def orphan_check(s, d):
    n = lambda c, k, p: t(s, d, c).where(F.col(k).isNotNull()).join(t(s, d, p).select(k), k, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(f"{c}.{k}").alias("child"), "orphans")
    return n("words", "block_pk", "blocks").unionByName(n("blocks", "stem", "articles")).unionByName(n("affiliations", "stem", "articles"))


@query("""SELECT stem, block_id, count(*) AS deliveries, count(DISTINCT text) AS texts FROM blocks GROUP BY 1, 2 HAVING count(*) > 1""")
def having_duplicates(s, d):
    return t(s, d, "blocks").groupBy("stem", "block_id").agg(F.count("*").alias("deliveries"), F.countDistinct("text").alias("texts")).where("deliveries > 1")


@query("""WITH RECURSIVE up AS (SELECT run, lower(trim(parent_run)) AS ancestor, 1 AS depth FROM runs WHERE trim(coalesce(parent_run, '')) <> ''
  UNION ALL SELECT up.run, lower(trim(r.parent_run)), depth + 1 FROM up JOIN runs r ON r.run = up.ancestor WHERE trim(coalesce(r.parent_run, '')) <> '' AND depth < 12)
  SELECT run, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2""")
def ancestor_recursion(s, d):
    t(s, d, "runs").select("run", F.lower(F.trim("parent_run")).alias("parent")).where("parent <> ''").createOrReplaceTempView("quire_runs")
    return s.sql("""WITH RECURSIVE up(run, ancestor, depth) MAX RECURSION LEVEL 20 AS (SELECT run, parent, 1 FROM quire_runs
      UNION ALL SELECT up.run, r.parent, depth + 1 FROM up JOIN quire_runs r ON r.run = up.ancestor WHERE depth < 12) SELECT run, ancestor, min(depth) AS depth FROM up GROUP BY run, ancestor""")


@query("""SELECT r_name AS region, n_name AS nation, count(*) AS people, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def institution_tree(s, d):
    x = t(s, d, "customer").join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("people"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT p_name AS title, count(*) AS mentions, count(DISTINCT l_orderkey) AS pubs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY pubs DESC, mentions DESC, title LIMIT 12""")
def top_cited_works(s, d):
    x = t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("title")).agg(F.count("*").alias("mentions"), F.countDistinct("l_orderkey").alias("pubs"))
    return x.orderBy(F.desc("pubs"), F.desc("mentions"), "title").limit(12)


@query("""SELECT kind, coalesce(model, '?') AS model, count(*) AS runs, round(sum(usd), 4) AS usd, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(pages) AS BIGINT) AS pages,
  round(sum(usd) / nullif(sum(pages), 0), 6) AS usd_per_page FROM runs GROUP BY 1, 2""")
def run_cost_rollup(s, d):
    g = t(s, d, "runs").groupBy("kind", F.coalesce("model", F.lit("?")).alias("model"))
    x = g.agg(F.count("*").alias("runs"), F.sum("usd").alias("u"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("pages").alias("pages"))
    return x.select("kind", "model", "runs", F.round("u", 4).alias("usd"), "tokens_in", "tokens_out", "pages", F.round(F.try_divide(F.col("u"), F.col("pages")), 6).alias("usd_per_page"))


@query("""SELECT coalesce(kind, '-') AS kind, coalesce(mode, '-') AS mode, count(*) AS runs, CAST(sum(pages) AS BIGINT) AS pages, CAST(grouping(kind) AS INT) AS all_kinds, CAST(grouping(mode) AS INT) AS all_modes
  FROM runs GROUP BY GROUPING SETS ((kind), (mode), (kind, mode), ())""")
def grouping_sets_summary(s, d):
    t(s, d, "runs").createOrReplaceTempView("quire_all_runs")
    return s.sql("""SELECT coalesce(kind, '-') AS kind, coalesce(mode, '-') AS mode, count(*) AS runs, sum(pages) AS pages, cast(grouping(kind) AS int) AS all_kinds, cast(grouping(mode) AS int) AS all_modes
      FROM quire_all_runs GROUP BY GROUPING SETS ((kind), (mode), (kind, mode), ())""")


@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS a, p_type AS b FROM part), c AS (SELECT a, b, count(*) AS n FROM w GROUP BY 1, 2)
  SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM c WHERE n >= 3""")
def pair_learning(s, d):
    c = t(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("a"), F.col("p_type").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))
