"""Signals, scores, statistics and versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.citations import t

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH k AS (SELECT stem, run, made, current, ar_id, row_number() OVER (PARTITION BY stem ORDER BY current DESC, made DESC, ar_id) AS n,
  lead(current) OVER (PARTITION BY stem ORDER BY current DESC, made DESC, ar_id) AS other, lead(made) OVER (PARTITION BY stem ORDER BY current DESC, made DESC, ar_id) AS other_made FROM article_runs WHERE stem IS NOT NULL)
  SELECT stem, run, ar_id, CASE WHEN other IS NULL THEN 'only' WHEN current > other THEN 'current' WHEN made > other_made THEN 'newest' ELSE 'first' END AS reason FROM k WHERE n = 1""")
def version_choice(s, d):
    w = Window.partitionBy("stem").orderBy(F.desc("current"), F.desc("made"), "ar_id")
    k = t(s, d, "article_runs").where("stem is not null").select("stem", "run", "made", "current", "ar_id", F.row_number().over(w).alias("n"), F.lead("current").over(w).alias("other"), F.lead("made").over(w).alias("om"))
    reason = F.when(F.col("other").isNull(), "only").when(F.col("current") > F.col("other"), "current").when(F.col("made") > F.col("om"), "newest").otherwise("first")
    return k.where("n = 1").select("stem", "run", "ar_id", reason.alias("reason"))


@query("""WITH k AS (SELECT aff_id, CAST('0x' || substr(sha1(stem || chr(31) || author_seq || chr(31) || seq), 1, 13) AS BIGINT) AS key, stem, author_seq, seq FROM affiliations WHERE stem IS NOT NULL AND author_seq IS NOT NULL AND seq IS NOT NULL)
  SELECT aff_id, key, row_number() OVER (PARTITION BY stem, author_seq, seq ORDER BY aff_id) AS ordinal FROM k""")
def natural_key_ordinals(s, d):
    w = Window.partitionBy("stem", "author_seq", "seq").orderBy("aff_id")
    return t(s, d, "affiliations").where("stem is not null and author_seq is not null and seq is not null").select("aff_id", X.surrogate_key("stem", "author_seq", "seq").alias("key"), F.row_number().over(w).cast("long").alias("ordinal"))


@query("""SELECT kind, run, ancestor_rank, usd FROM (SELECT kind, run, usd, row_number() OVER (PARTITION BY kind ORDER BY usd DESC NULLS LAST, run) AS ancestor_rank FROM runs) WHERE ancestor_rank <= 3""")
def dearest_runs(s, d):
    w = Window.partitionBy("kind").orderBy(F.desc_nulls_last("usd"), "run")
    return t(s, d, "runs").select("kind", "run", "usd", F.row_number().over(w).cast("long").alias("ancestor_rank")).where("ancestor_rank <= 3")


@query("""WITH q AS (SELECT CASE WHEN length(text) < 40 THEN 1 ELSE 0 END AS flag, CAST(verdict = 'furniture' AS INT) AS truth, stratum FROM heldout_blocks WHERE verdict IN ('content', 'furniture'))
  SELECT stratum, count(*) AS n, CAST(sum(truth) AS BIGINT) AS k, round((sum(truth) / count(*) + 3.8416 / (2 * count(*)) - 1.96 * sqrt(sum(truth) / count(*) * (1 - sum(truth) / count(*)) / count(*) + 3.8416 / (4.0 * count(*) * count(*)))) / (1 + 3.8416 / count(*)), 6) AS lo,
  round((sum(truth) / count(*) + 3.8416 / (2 * count(*)) + 1.96 * sqrt(sum(truth) / count(*) * (1 - sum(truth) / count(*)) / count(*) + 3.8416 / (4.0 * count(*) * count(*)))) / (1 + 3.8416 / count(*)), 6) AS hi FROM q GROUP BY 1""")
def wilson_interval(s, d):
    q = t(s, d, "heldout_blocks").where("verdict in ('content', 'furniture')").groupBy("stratum").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "furniture").cast("long")).alias("k"))
    n, p, z2 = F.col("n"), F.col("k") / F.col("n"), 1.96 * 1.96
    mid, half = p + z2 / (2 * n), 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    return q.select("stratum", "n", "k", F.round((mid - half) / (1 + z2 / n), 6).alias("lo"), F.round((mid + half) / (1 + z2 / n), 6).alias("hi"))


@query("""WITH q AS (SELECT length(text) AS x, CAST(verdict = 'furniture' AS INT) AS y FROM heldout_blocks WHERE verdict IN ('content', 'furniture')), th AS (SELECT unnest(range(10, 210, 10)) AS t)
  SELECT CAST(t AS INT) AS threshold, CAST(sum(CAST(x < t AS INT)) AS BIGINT) AS flagged, CAST(sum(CAST(x < t AND y = 1 AS INT)) AS BIGINT) AS caught, CAST(sum(CAST(x >= t AND y = 1 AS INT)) AS BIGINT) AS left_over,
  round(sum(CAST(x < t AND y = 1 AS INT)) / nullif(sum(CAST(x < t AS INT)), 0), 6) AS precision FROM q CROSS JOIN th GROUP BY 1""")
def threshold_curve(s, d):
    q = t(s, d, "heldout_blocks").where("verdict in ('content', 'furniture')").select(F.length("text").alias("x"), (F.col("verdict") == "furniture").cast("long").alias("y"), F.explode(F.sequence(F.lit(10), F.lit(200), F.lit(10))).alias("threshold"))
    f = (F.col("x") < F.col("threshold")).cast("long")
    g = q.groupBy("threshold").agg(F.sum(f).alias("flagged"), F.sum(f * F.col("y")).alias("caught"), F.sum((1 - f) * F.col("y")).alias("left_over"))
    return g.withColumn("precision", F.round(F.try_divide(F.col("caught"), F.col("flagged")), 6))


@query("""WITH q AS (SELECT -length(text) AS x, verdict = 'furniture' AS y FROM heldout_blocks WHERE verdict IN ('content', 'furniture')), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM q)
  SELECT round((sum(CASE WHEN y THEN r END) - count(CASE WHEN y THEN 1 END) * (count(CASE WHEN y THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y THEN 1 END) * count(CASE WHEN NOT y THEN 1 END)), 6) AS auc FROM r""")
def auc_by_rank(s, d):
    """The rank-sum formula on counts per score, so that no window goes over all rows: scores are few."""
    q = t(s, d, "heldout_blocks").where("verdict in ('content', 'furniture')").groupBy((-F.length("text")).alias("x")).agg(F.sum((F.col("verdict") == "furniture").cast("long")).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    r = q.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("r", F.col("before") + (F.col("n") + 1) / 2.0)
    z = r.agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("m"))
    return z.select(F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("m")), 6).alias("auc"))


@query("""WITH q AS (SELECT block_pk, list_sort(list(conf)) AS c FROM words WHERE conf IS NOT NULL GROUP BY 1) SELECT block_pk, len(c) AS n, c[CAST(floor(0.5 * len(c)) AS INT) + 1] AS mid, c[CAST(floor(0.25 * len(c)) AS INT) + 1] AS quarter, c[CAST(floor(0.1 * len(c)) AS INT) + 1] AS tenth FROM q""")
def block_confidence_profile(s, d):
    """Floor-index quantiles of a block's words; a block is bounded by a page."""
    q = t(s, d, "words").where("conf is not null").groupBy("block_pk").agg(F.array_sort(F.collect_list("conf")).alias("c"))
    at = lambda p: F.get("c", F.floor(F.lit(p) * F.size("c")).cast("int"))
    return q.select("block_pk", F.size("c").cast("long").alias("n"), at(0.5).alias("mid"), at(0.25).alias("quarter"), at(0.1).alias("tenth"))


@query("""WITH r AS (SELECT stem, unnest(list_filter([CASE WHEN conf < 0.8 THEN 'confidence' END, CASE WHEN length(text) = 1 THEN 'speck' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' END, CASE WHEN lang IS NOT NULL THEN 'labelled' END], lambda x: x IS NOT NULL)) AS reason FROM words)
  SELECT stem, reason, count(*) AS words FROM r GROUP BY 1, 2""")
def flag_reasons(s, d):
    r = F.array_compact(F.array(F.when(F.col("conf") < 0.8, "confidence"), F.when(F.length("text") == 1, "speck"), F.when(F.col("text").rlike("[A-Za-z]"), "latin"), F.when(F.col("lang").isNotNull(), "labelled")))
    return t(s, d, "words").select("stem", F.explode(r).alias("reason")).groupBy("stem", "reason").agg(F.count("*").alias("words"))


@query("""WITH p AS (SELECT stem, page, CAST(sum(CASE WHEN conf < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS fixes FROM words GROUP BY 1, 2), m AS (SELECT stem, median(fixes) AS mid FROM p GROUP BY 1)
  SELECT p.stem, page, fixes FROM p JOIN m ON p.stem = m.stem WHERE fixes >= greatest(8, 3 * mid)""")
def outlier_pages(s, d):
    p = t(s, d, "words").groupBy("stem", "page").agg(F.sum(F.when(F.col("conf") < 0.8, 1).otherwise(0)).alias("fixes"))
    m = p.groupBy("stem").agg(F.median("fixes").alias("mid"))
    return p.join(m, "stem").where(F.col("fixes") >= F.greatest(F.lit(8.0), 3 * F.col("mid"))).select("stem", "page", "fixes")


@query("""WITH h AS (SELECT date_trunc('day', ts) AS day, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2), tot AS (SELECT day, sum(n) AS s FROM h GROUP BY 1), days AS (SELECT day, lead(day) OVER (ORDER BY day) AS next FROM tot), kinds AS (SELECT DISTINCT k FROM h)
  SELECT strftime(d.day, '%Y-%m-%d') AS day, round(sum(abs(coalesce(a.n, 0) / ta.s - coalesce(b.n, 0) / tb.s)) / 2, 6) AS tv FROM days d CROSS JOIN kinds JOIN tot ta ON ta.day = d.day JOIN tot tb ON tb.day = d.next
  LEFT JOIN h a ON a.day = d.day AND a.k = kinds.k LEFT JOIN h b ON b.day = d.next AND b.k = kinds.k GROUP BY 1""")
def neighbour_mix_distance(s, d):
    """Total variation between the mix of event types of a day and of the next day that has events."""
    h = t(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    mix = h.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"), F.sum("n").alias("s"))
    w = Window.orderBy("day")  # a row per day
    x = mix.select("day", "m", "s", F.lead("m").over(w).alias("m2"), F.lead("s").over(w).alias("s2")).where("m2 is not null")
    keys = F.array_union(F.map_keys("m"), F.map_keys("m2"))
    tv = F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.abs(F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("s") - F.coalesce(F.try_element_at("m2", k), F.lit(0)) / F.col("s2")))
    return x.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(tv / 2, 6).alias("tv"))


@query("""WITH p AS (SELECT stem, page, count(*) AS blocks FROM blocks GROUP BY 1, 2), l AS (SELECT stem, page, blocks, lag(blocks) OVER (PARTITION BY stem ORDER BY page) AS before FROM p) SELECT stem, page, blocks - before AS jump FROM l WHERE blocks - before >= 2""")
def level_jump(s, d):
    p = t(s, d, "blocks").groupBy("stem", "page").agg(F.count("*").alias("blocks"))
    return p.withColumn("before", F.lag("blocks").over(Window.partitionBy("stem").orderBy("page"))).where("blocks - before >= 2").select("stem", "page", (F.col("blocks") - F.col("before")).alias("jump"))


@query("""WITH b AS (SELECT stem, page, ord, block_pk, CAST(sum(CASE WHEN role = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY page, ord, block_pk) AS BIGINT) AS section FROM blocks) SELECT stem, section, count(*) AS blocks, min(page) AS first_page, max(page) AS last_page FROM b GROUP BY 1, 2""")
def section_islands(s, d):
    """The running count goes over pages first, then within a page: a long article isn't one task's rows."""
    title = F.when(F.col("role") == "title", 1).otherwise(0)
    b = t(s, d, "blocks").select("stem", "page", "ord", "block_pk", title.alias("is_title"))
    w = Window.partitionBy("stem").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = b.groupBy("stem", "page").agg(F.sum("is_title").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(w), F.lit(0))).drop("k")
    within = Window.partitionBy("stem", "page").orderBy("ord", "block_pk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.join(pages, ["stem", "page"]).withColumn("section", F.col("base") + F.sum("is_title").over(within))
    return b.groupBy("stem", "section").agg(F.count("*").alias("blocks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query("""WITH m AS (SELECT DISTINCT stem, page, backref, target FROM ibid_draw WHERE page IS NOT NULL) SELECT stem, page, backref, target,
  last_value(target IGNORE NULLS) OVER (PARTITION BY stem ORDER BY page, backref, target NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resolved FROM m""")
def previous_mention(s, d):
    """Over pages first, then within a page, as section_islands."""
    m = t(s, d, "ibid_draw").where("page is not null").select("stem", "page", "backref", "target").distinct()
    w = Window.partitionBy("stem").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    last = m.groupBy("stem", "page").agg(F.max(F.when(F.col("target").isNotNull(), F.struct("backref", "target"))).alias("x"))
    base = last.select("stem", "page", F.last("x.target", ignorenulls=True).over(w).alias("base"))
    within = Window.partitionBy("stem", "page").orderBy("backref", F.asc_nulls_first("target")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.join(base, ["stem", "page"]).withColumn("resolved", F.coalesce(F.last("target", ignorenulls=True).over(within), "base")).drop("base")


@query("""WITH p AS (SELECT DISTINCT stem, page FROM blocks), g AS (SELECT stem, page, page - row_number() OVER (PARTITION BY stem ORDER BY page) AS k FROM p), r AS (SELECT stem, k, min(page) AS a, max(page) AS b FROM g GROUP BY 1, 2)
  SELECT stem, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1""")
def pages_to_ranges(s, d):
    g = t(s, d, "blocks").select("stem", "page").distinct().withColumn("k", F.col("page") - F.row_number().over(Window.partitionBy("stem").orderBy("page")))
    r = g.groupBy("stem", "k").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return r.groupBy("stem").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", one.alias("x")))), lambda z: z["x"]), ", ").alias("pages"))


@query("""WITH b AS (SELECT block_pk, stem, page, vpos AS a, vpos + height AS z FROM blocks) SELECT x.stem, count(*) AS overlaps FROM b x JOIN b y ON x.stem = y.stem AND x.page = y.page AND x.block_pk < y.block_pk AND x.a < y.z AND y.a < x.z GROUP BY 1""")
def interval_overlaps(s, d):
    b = t(s, d, "blocks").select("block_pk", "stem", "page", F.col("vpos").alias("a"), (F.col("vpos") + F.col("height")).alias("z"))
    y = b.select("stem", "page", F.col("block_pk").alias("pk"), F.col("a").alias("a2"), F.col("z").alias("z2"))
    return b.join(y, ["stem", "page"]).where("block_pk < pk and a < z2 and a2 < z").groupBy("stem").agg(F.count("*").alias("overlaps"))


@query("""WITH k AS (SELECT a.stem, a.run, r.kind, row_number() OVER (PARTITION BY a.stem ORDER BY CASE r.kind WHEN 'judged' THEN 1 WHEN 'final' THEN 2 WHEN 'replay' THEN 3 ELSE 4 END, a.made, a.ar_id) AS n FROM article_runs a JOIN runs r ON a.run = r.run WHERE a.stem IS NOT NULL)
  SELECT stem, run, kind, CASE WHEN n = 1 THEN 'applied' ELSE 'blocked' END AS outcome, n FROM k""")
def patch_precedence(s, d):
    x = t(s, d, "article_runs").where("stem is not null").join(t(s, d, "runs").select("run", "kind"), "run")
    rank = F.when(F.col("kind") == "judged", 1).when(F.col("kind") == "final", 2).when(F.col("kind") == "replay", 3).otherwise(4)
    k = x.select("stem", "run", "kind", F.row_number().over(Window.partitionBy("stem").orderBy(rank, "made", "ar_id")).cast("long").alias("n"))
    return k.select("stem", "run", "kind", F.when(F.col("n") == 1, "applied").otherwise("blocked").alias("outcome"), "n")


@query("""SELECT stem, block_id, arg_max(block_pk, (loaded, block_pk)) AS block_pk, count(*) - 1 AS replaced FROM blocks GROUP BY 1, 2""")
def upsert_merge(s, d):
    from quire.operators.versions import upsert

    b = t(s, d, "blocks").select("stem", "block_id", "block_pk", "loaded")
    n = b.groupBy("stem", "block_id").agg((F.count("*") - 1).alias("replaced"))
    return upsert(b.limit(0), b, ["stem", "block_id"], ["loaded", "block_pk"]).select("stem", "block_id", "block_pk").join(n, ["stem", "block_id"])


@query("""SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum, CAST(max(CAST(json_extract_string(props, '$.k') AS INT)) AS INT) AS k_max FROM events GROUP BY 1""")
def json_path(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("""SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, event_type, count(*) AS objects, round(sum(value), 2) AS size FROM events GROUP BY 1, 2""")
def storage_inventory(s, d):
    return t(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("objects"), F.round(F.sum("value"), 2).alias("size"))


@query("""WITH c AS (SELECT block_pk, lang, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY 1, 2), s AS (SELECT block_pk, arg_max(lang, (n, lang)) AS lang, max(n) AS n, sum(n) AS s FROM c GROUP BY 1) SELECT block_pk, lang, n AS votes FROM s WHERE n >= 2 AND n / s >= 0.6""")
def majority_vote(s, d):
    c = t(s, d, "words").where("lang is not null").groupBy("block_pk", "lang").agg(F.count("*").alias("n"))
    k = c.groupBy("block_pk").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("votes"), F.sum("n").alias("s"))
    return k.where("votes >= 2 and votes / s >= 0.6").select("block_pk", "lang", "votes")


@query("""WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS d FROM customer), r AS (SELECT c_custkey, (11 - list_sum(list_transform(range(1, 8), lambda i: CAST(substr(d, CAST(i AS INT), 1) AS INT) * (9 - i))) % 11) % 11 AS r FROM k)
  SELECT c_custkey, CASE WHEN r = 10 THEN 'X' ELSE CAST(CAST(r AS INT) AS VARCHAR) END AS digit FROM r""")
def issn_digit(s, d):
    return t(s, d, "customer").select("c_custkey", X.issn_check(F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("digit"))


@query("""SELECT DISTINCT pub_year, CAST(round((pub_year - 621.5643) / 0.970229) AS INT) AS hijri, CAST(round(round((pub_year - 621.5643) / 0.970229) * 0.970229 + 621.5643) AS INT) AS back FROM articles WHERE pub_year IS NOT NULL""")
def calendar_conversion(s, d):
    h = X.gregorian_to_hijri(F.col("pub_year"))
    return t(s, d, "articles").where("pub_year is not null").select("pub_year", h.alias("hijri"), X.hijri_to_gregorian(h).alias("back")).distinct()


@query("""SELECT c.child, c.period, c.with_value AS now, o.with_value AS reported FROM (SELECT 'runs.parent_run' AS child, strftime(loaded AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS with_value FROM runs WHERE trim(coalesce(parent_run, '')) <> '' GROUP BY 2) c
  JOIN orphans o ON o.child = c.child AND o.period = c.period WHERE o.with_value IS NULL OR o.with_value <> c.with_value""")
def reconciliation(s, d):
    c = t(s, d, "runs").where("trim(coalesce(parent_run, '')) <> ''").groupBy(F.date_format("loaded", "yyyy-MM").alias("period")).agg(F.count("*").alias("now")).withColumn("child", F.lit("runs.parent_run"))
    o = t(s, d, "orphans").select("child", "period", F.col("with_value").alias("reported"))
    return c.join(o, ["child", "period"]).where("reported is null or reported <> now").select("child", "period", "now", "reported")


@query("""SELECT b.block_pk, count(*) AS words, CAST(sum(CASE WHEN w.vpos >= b.vpos AND w.vpos < b.vpos + b.height THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM blocks b JOIN words w ON w.block_pk = b.block_pk GROUP BY 1""")
def words_in_boxes(s, d):
    b = t(s, d, "blocks").select("block_pk", F.col("vpos").alias("top"), F.col("height").alias("tall"))
    x = t(s, d, "words").select("block_pk", "vpos").join(b, "block_pk")
    return x.groupBy("block_pk").agg(F.count("*").alias("words"), F.sum(F.when((F.col("vpos") >= F.col("top")) & (F.col("vpos") < F.col("top") + F.col("tall")), 1).otherwise(0)).alias("inside"))
