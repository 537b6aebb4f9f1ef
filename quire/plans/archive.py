"""Works, people, institutions, runs and deliveries of the archive as relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.plans.citations import t
from quire.plans.texts import fold_sql, folded

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- runs ---------------------------------------------------------------------------------------------------------


@query("""SELECT kind, count(*) AS runs, round(median(usd / pages), 8) AS usd_page, round(median(CAST(tokens_out AS DOUBLE) / pages), 6) AS out_page FROM runs WHERE pages > 0 GROUP BY 1""")
def run_norms(s, d):
    """What a page costs and puts out, by kind of run: medians."""
    return t(s, d, "runs").where("pages > 0").groupBy("kind").agg(F.count("*").alias("runs"), F.round(F.median(F.col("usd") / F.col("pages")), 8).alias("usd_page"), F.round(F.median(F.col("tokens_out") / F.col("pages")), 6).alias("out_page"))


@query("""WITH m AS (SELECT kind, median(usd / pages) AS m FROM runs WHERE pages > 0 GROUP BY 1) SELECT run, r.kind, round(usd / pages / m, 6) AS times FROM runs r JOIN m ON r.kind = m.kind WHERE pages > 0 AND usd / pages > 1.2 * m""")
def cost_outliers(s, d):
    """Runs a fifth dearer by the page than the median of their kind."""
    r = t(s, d, "runs").where("pages > 0").select("run", "kind", (F.col("usd") / F.col("pages")).alias("x"))
    return r.join(r.groupBy("kind").agg(F.median("x").alias("m")), "kind").where("x > 1.2 * m").select("run", "kind", F.round(F.col("x") / F.col("m"), 6).alias("times"))


@query("""SELECT count(*) AS runs, count(finished) AS done, CAST(sum(CASE WHEN finished IS NOT NULL THEN pages ELSE 0 END) AS BIGINT) AS pages_done, CAST(sum(CASE WHEN finished IS NULL THEN pages ELSE 0 END) AS BIGINT) AS pages_left,
  CAST(sum(CAST(floor(epoch(finished)) - floor(epoch(started)) AS BIGINT)) AS BIGINT) AS seconds FROM runs""")
def progress_totals(s, d):
    done = F.col("finished").isNotNull()
    span = F.unix_timestamp("finished") - F.unix_timestamp("started")
    n = lambda c: F.sum(F.when(c, F.col("pages")).otherwise(0))
    return t(s, d, "runs").agg(F.count("*").alias("runs"), F.count("finished").alias("done"), n(done).alias("pages_done"), n(~done).alias("pages_left"), F.sum(span).alias("seconds"))


@query("""WITH p AS (SELECT kind, (floor(epoch(finished)) - floor(epoch(started))) / pages AS x FROM runs WHERE finished IS NOT NULL AND pages > 0), m AS (SELECT kind, median(x) AS per_page, count(*) AS timed FROM p GROUP BY 1), a AS (SELECT median(x) AS prior FROM p),
  l AS (SELECT kind, CAST(sum(pages) AS BIGINT) AS pages_left FROM runs WHERE finished IS NULL GROUP BY 1)
  SELECT l.kind, pages_left, CASE WHEN coalesce(timed, 0) >= 5 THEN 'own' ELSE 'prior' END AS basis, round(pages_left * CASE WHEN coalesce(timed, 0) >= 5 THEN per_page ELSE prior END, 4) AS seconds_left FROM l LEFT JOIN m ON l.kind = m.kind CROSS JOIN a""")
def effort_estimate(s, d):
    """Seconds that unfinished runs will take: by their kind's median per page where five were timed, else by all."""
    r = t(s, d, "runs")
    p = r.where("finished is not null and pages > 0").select("kind", ((F.unix_timestamp("finished") - F.unix_timestamp("started")) / F.col("pages")).alias("x"))
    m, a = p.groupBy("kind").agg(F.median("x").alias("per_page"), F.count("*").alias("timed")), p.agg(F.median("x").alias("prior"))
    left = r.where("finished is null").groupBy("kind").agg(F.sum("pages").alias("pages_left"))
    x = left.join(m, "kind", "left").join(F.broadcast(a))  # one row
    own = F.coalesce("timed", F.lit(0)) >= 5
    return x.select("kind", "pages_left", F.when(own, "own").otherwise("prior").alias("basis"), F.round(F.col("pages_left") * F.when(own, F.col("per_page")).otherwise(F.col("prior")), 4).alias("seconds_left"))


# --- articles and deliveries --------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT stem, language, pub_year, title, row_number() OVER (PARTITION BY stem ORDER BY CASE source WHEN 'masters' THEN 1 WHEN 'catalogue' THEN 2 ELSE 3 END, loaded DESC, made DESC) AS n, source FROM articles)
  SELECT stem, arg_min(language, n) FILTER (WHERE language IS NOT NULL) AS language, arg_min(pub_year, n) FILTER (WHERE pub_year IS NOT NULL) AS pub_year, arg_min(title, n) FILTER (WHERE title IS NOT NULL) AS title, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM r GROUP BY 1""")
def assertion_choice(s, d):
    """Of each field the value of the first source that has one: masters before the catalogue, the latest first."""
    rank = F.when(F.col("source") == "masters", 1).when(F.col("source") == "catalogue", 2).otherwise(3)
    a = t(s, d, "articles").withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy(rank, F.desc_nulls_last("loaded"), F.desc_nulls_last("made"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    return a.groupBy("stem").agg(first("language"), first("pub_year"), first("title"), F.countDistinct("source").alias("sources"))


@query("""SELECT CAST(pub_year // 10 * 10 AS INT) AS decade, coalesce(language, '-') AS language, CAST(ceil((try_cast(lpage AS INT) - try_cast(fpage AS INT) + 1) / 5.0) * 5 AS INT) AS pages, count(*) AS articles FROM articles GROUP BY 1, 2, 3""")
def strata_table(s, d):
    """Articles by decade, language and length in steps of five pages."""
    n = F.expr("try_cast(lpage as int) - try_cast(fpage as int) + 1")
    return t(s, d, "articles").groupBy((F.floor(F.col("pub_year") / 10) * 10).cast("int").alias("decade"), F.coalesce("language", F.lit("-")).alias("language"), (F.ceil(n / 5.0) * 5).cast("int").alias("pages")).agg(F.count("*").alias("articles"))


@query("""WITH k AS (SELECT stem, list_sort(list(DISTINCT source)) AS sources FROM (SELECT stem, 'article' AS source FROM articles UNION SELECT stem, 'block' FROM blocks UNION SELECT stem, 'text' FROM documents WHERE stem IS NOT NULL UNION SELECT stem, 'affiliation' FROM affiliations WHERE stem IS NOT NULL) GROUP BY 1)
  SELECT array_to_string(sources, '+') AS sources, count(*) AS stems FROM k GROUP BY 1""")
def file_set_completeness(s, d):
    """What there is for each article: which sets of tables hold it."""
    of = lambda n, x: t(s, d, n).where("stem is not null").select("stem", F.lit(x).alias("source")).distinct()
    u = of("articles", "article").unionByName(of("blocks", "block")).unionByName(of("documents", "text")).unionByName(of("affiliations", "affiliation"))
    return u.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources")).groupBy("sources").agg(F.count("*").alias("stems"))


@query("""WITH o AS (SELECT stem, block_id, arg_min(struct_pack(role, lang, text, width, height), (loaded, block_pk)) AS a, arg_max(struct_pack(role, lang, text, width, height), (loaded, block_pk)) AS b FROM blocks GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT count(*) AS delivered_again, CAST(sum(CASE WHEN a.role IS DISTINCT FROM b.role THEN 1 ELSE 0 END) AS BIGINT) AS role, CAST(sum(CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 1 ELSE 0 END) AS BIGINT) AS lang, CAST(sum(CASE WHEN a.text IS DISTINCT FROM b.text THEN 1 ELSE 0 END) AS BIGINT) AS text FROM o""")
def delivery_changes(s, d):
    """Which fields differ between a block's first and latest delivery."""
    k, f = F.struct("loaded", "block_pk"), F.struct("role", "lang", "text")
    o = t(s, d, "blocks").groupBy("stem", "block_id").agg(F.min_by(f, k).alias("a"), F.max_by(f, k).alias("b"), F.count("*").alias("n")).where("n > 1")
    differs = lambda c: F.sum(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 1).otherwise(0)).alias(c)
    return o.agg(F.count("*").alias("delivered_again"), differs("role"), differs("lang"), differs("text"))


@query("""WITH j AS (SELECT DISTINCT issue_id, journal_id FROM articles WHERE issue_id IS NOT NULL) SELECT journal_id, split_part(issue_id, '-', 2) AS volume, unnest(string_split(split_part(issue_id, '-', 3), ',')) AS issue FROM j""")
def journal_issues(s, d):
    """(journal_id, volume, issue): a joint issue is one row for each of its numbers."""
    j = t(s, d, "articles").where("issue_id is not null").select("issue_id", "journal_id").distinct()
    p = F.split("issue_id", "-")
    return j.select("journal_id", F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("volume"), F.explode(F.split(F.coalesce(F.get(p, F.lit(2)), F.lit("")), ",")).alias("issue"))


@query("""WITH f AS (SELECT stem, CAST(sum(CASE WHEN role = 'pageHeader' THEN 1 ELSE 0 END) AS BIGINT) AS heads, count(DISTINCT page) AS pages FROM blocks GROUP BY 1) SELECT stem, heads, pages FROM f WHERE heads < pages""")
def pages_without_head(s, d):
    """Articles with fewer running heads than pages."""
    b = t(s, d, "blocks").groupBy("stem").agg(F.sum(F.when(F.col("role") == "pageHeader", 1).otherwise(0)).alias("heads"), F.countDistinct("page").alias("pages"))
    return b.where("heads < pages")


@query("""SELECT h.n, CASE WHEN h.text IS NULL THEN 'none' WHEN b.h IS NULL THEN 'stale' ELSE 'attached' END AS state FROM heldout_blocks h LEFT JOIN (SELECT DISTINCT stem, page, md5(trim(text)) AS h FROM blocks WHERE text IS NOT NULL) b ON h.doc = b.stem AND h.page = b.page AND md5(trim(h.text)) = b.h""")
def verdicts_reattached(s, d):
    """Whether a judged block is still there with the same text, by its fingerprint."""
    b = t(s, d, "blocks").where("text is not null").select(F.col("stem").alias("doc"), "page", F.md5(F.trim("text")).alias("h")).distinct().withColumn("there", F.lit(True))
    h = t(s, d, "heldout_blocks").select("n", "doc", "page", "text", F.md5(F.trim("text")).alias("h"))
    return h.join(b, ["doc", "page", "h"], "left").select("n", F.when(F.col("text").isNull(), "none").when(F.col("there").isNull(), "stale").otherwise("attached").alias("state"))


# --- citations and back references --------------------------------------------------------------------------------


@query("""SELECT CASE WHEN backref = target THEN 'self' WHEN target IS NULL THEN 'none' WHEN target IN (SELECT backref FROM ibid_draw WHERE backref IS NOT NULL) THEN 'chain' ELSE 'work' END AS leads_to, count(*) AS rows_ FROM ibid_draw GROUP BY 1""")
def back_reference_checks(s, d):
    """Back references that lead to themselves, to another one, to a work or nowhere."""
    i = t(s, d, "ibid_draw").groupBy("backref", "target").agg(F.count("*").alias("n"))
    keys = i.where("backref is not null").select(F.col("backref").alias("target")).distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("backref") == F.col("target"), "self").when(F.col("target").isNull(), "none").when(F.col("known"), "chain").otherwise("work")
    return i.join(keys, "target", "left").groupBy(kind.alias("leads_to")).agg(F.sum("n").alias("rows_"))


@query("""SELECT split_part(target, '|', 1) AS stem, count(DISTINCT target) AS works FROM ibid_draw WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.stem = split_part(target, '|', 1)) GROUP BY 1""")
def catalogued_only_targets(s, d):
    """Articles that are cited but not in the archive."""
    x = t(s, d, "ibid_draw").where("target is not null").select(F.substring_index("target", "|", 1).alias("stem"), "target").distinct()
    return x.join(t(s, d, "articles").select("stem").distinct(), "stem", "left_anti").groupBy("stem").agg(F.count("*").alias("works"))


@query("""WITH m AS (SELECT DISTINCT stem, page, target FROM ibid_draw WHERE target IS NOT NULL AND page IS NOT NULL), p AS (SELECT stem, page, target, lag(page) OVER (PARTITION BY stem, target ORDER BY page) AS before FROM m)
  SELECT stem, page, target, page - before AS gap FROM p WHERE page - before <= 30""")
def page_continuity(s, d):
    """Works cited again within thirty pages of an earlier place."""
    m = t(s, d, "ibid_draw").where("target is not null and page is not null").select("stem", "page", "target").distinct()
    p = m.withColumn("before", F.lag("page").over(Window.partitionBy("stem", "target").orderBy("page")))
    return p.withColumn("gap", F.col("page") - F.col("before")).where("gap <= 30").select("stem", "page", "target", "gap")


@query("""WITH n AS (SELECT stem, note, try_cast(regexp_extract(note, '^fn-p([0-9]+)-[0-9]+$', 1) AS INT) AS p, page FROM ibid_draw) SELECT stem, count(*) AS calls, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS untied, CAST(sum(CASE WHEN p <> page THEN 1 ELSE 0 END) AS BIGINT) AS elsewhere FROM n GROUP BY 1""")
def call_note_links(s, d):
    """Calls whose note can't be told, or stands on another page."""
    n = t(s, d, "ibid_draw").select("stem", "page", F.expr("try_cast(nullif(regexp_extract(note, '^fn-p([0-9]+)-[0-9]+$', 1), '') as int)").alias("p"))
    return n.groupBy("stem").agg(F.count("*").alias("calls"), F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("untied"), F.sum(F.when(F.col("p") != F.col("page"), 1).otherwise(0)).alias("elsewhere"))


@query("""WITH p AS (SELECT backref, try_cast(regexp_extract(translate(printed, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '(?:ص|p\\.)\\s*([0-9]+)', 1) AS INT) AS cited FROM ibid_draw)
  SELECT backref, min(cited) AS first_page, max(cited) AS last_page, count(cited) AS places FROM p WHERE backref IS NOT NULL GROUP BY 1""")
def cited_pages(s, d):
    """The pages that a back reference names."""
    p = F.expr(r"try_cast(nullif(regexp_extract(x, '(?:ص|p\\.)\\s*([0-9]+)', 1), '') as int)")
    i = t(s, d, "ibid_draw").where("backref is not null").select("backref", X.fold_digits(F.col("printed")).alias("x")).select("backref", p.alias("cited"))
    return i.groupBy("backref").agg(F.min("cited").alias("first_page"), F.max("cited").alias("last_page"), F.count("cited").alias("places"))


@query(f"""WITH a AS (SELECT DISTINCT stem, {fold_sql("title")} AS k, journal_id, pub_year FROM articles WHERE title IS NOT NULL) SELECT md5(k) AS card, min(stem) AS first_stem, count(DISTINCT stem) AS articles, count(DISTINCT journal_id) AS journals, CAST(max(pub_year) - min(pub_year) AS INT) AS years FROM a WHERE k <> '' GROUP BY 1""")
def work_cards(s, d):
    """One card for each title key, with what its articles agree in."""
    a = t(s, d, "articles").where("title is not null").select("stem", folded("title").alias("k"), "journal_id", "pub_year").where("k <> ''")
    return a.groupBy(F.md5("k").alias("card")).agg(F.min("stem").alias("first_stem"), F.countDistinct("stem").alias("articles"), F.countDistinct("journal_id").alias("journals"), (F.max("pub_year") - F.min("pub_year")).alias("years"))


# --- people and institutions --------------------------------------------------------------------------------------

#: Words that tell nothing in a Latin institution's key, and the article before an Arabic word.
_STOP, _AL = "of the de des du la le l et and for fur in".split(), "^(وال|بال|لل|ال)"
_KEY_SQL = f"""array_to_string(list_transform(list_filter(string_split({fold_sql("orgname")}, ' '), lambda x: x NOT IN ({", ".join(map(repr, _STOP))})), lambda x: CASE WHEN length(x) > 4 THEN regexp_replace(x, '{_AL}', '') ELSE x END), '')"""


def institution_key(c: str):
    """Words folded, without articles and words that tell nothing, without blanks."""
    words = F.filter(F.split(folded(c), " "), lambda w: ~w.isin(_STOP))
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, _AL, "")).otherwise(w)), "")


@query(f"""WITH a AS (SELECT {_KEY_SQL} AS k, orgname, country FROM affiliations WHERE orgname IS NOT NULL), n AS (SELECT k, orgname, count(*) AS n FROM a GROUP BY 1, 2), c AS (SELECT k, country, count(*) AS n FROM a WHERE country IS NOT NULL GROUP BY 1, 2),
  x AS (SELECT k, arg_min(orgname, (-n, orgname)) AS name, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS spellings FROM n GROUP BY 1), y AS (SELECT k, arg_min(country, (-n, country)) AS country FROM c GROUP BY 1)
  SELECT md5(x.k) AS institution, name, mentions, spellings, country FROM x LEFT JOIN y ON x.k = y.k WHERE x.k <> ''""")
def institution_cards(s, d):
    """Spellings of one key, the commonest as the name, the country by vote; ties by text."""
    a = t(s, d, "affiliations").where("orgname is not null").groupBy("orgname", "country").agg(F.count("*").alias("n")).withColumn("k", institution_key("orgname")).where("k <> ''")
    top = lambda c: F.min_by(c, F.struct((-F.col("n")).alias("n"), c)).alias(c)
    x = a.groupBy("k", "orgname").agg(F.sum("n").alias("n")).groupBy("k").agg(top("orgname"), F.sum("n").alias("mentions"), F.count("*").alias("spellings"))
    y = a.where("country is not null").groupBy("k", "country").agg(F.sum("n").alias("n")).groupBy("k").agg(top("country"))
    return x.join(y, "k", "left").select(F.md5("k").alias("institution"), F.col("orgname").alias("name"), "mentions", "spellings", "country")


@query(f"""WITH v AS (SELECT inst_key, {_KEY_SQL.replace("orgname", "variant")} AS k, coalesce(n, 1) AS n FROM institution_variants WHERE inst_key IS NOT NULL AND variant IS NOT NULL), c AS (SELECT inst_key, k, sum(n) AS n FROM v WHERE k <> '' GROUP BY 1, 2)
  SELECT inst_key, arg_max(k, (n, k)) AS new_key, count(*) AS candidates FROM c GROUP BY 1""")
def retired_keys(s, d):
    """Where each earlier key goes: to the new key that most of its members have."""
    v = t(s, d, "institution_variants").where("inst_key is not null and variant is not null").select("inst_key", institution_key("variant").alias("k"), F.coalesce("n", F.lit(1)).alias("n")).where("k <> ''")
    c = v.groupBy("inst_key", "k").agg(F.sum("n").alias("n"))
    return c.groupBy("inst_key").agg(F.max_by("k", F.struct("n", "k")).alias("new_key"), F.count("*").alias("candidates"))


@query(f"""WITH m AS (SELECT DISTINCT replace({fold_sql("authors")}, ' ', '') AS k, orgname FROM meta_draw WHERE authors IS NOT NULL) SELECT md5(k) AS person_key, count(DISTINCT orgname) AS organisations FROM m WHERE k <> '' GROUP BY 1 HAVING count(DISTINCT orgname) > 1""")
def homonym_veto(s, d):
    """Name keys under which several organisations appear: the name alone identifies nobody."""
    m = t(s, d, "meta_draw").where("authors is not null").select("authors", "orgname").distinct().select(F.replace(folded("authors"), F.lit(" "), F.lit("")).alias("k"), "orgname").where("k <> ''")
    return m.groupBy(F.md5("k").alias("person_key")).agg(F.countDistinct("orgname").alias("organisations")).where("organisations > 1")


@query("""SELECT a.stem, a.authors AS first_author, b.authors AS other, CAST(min(b.seq) AS INT) AS seq FROM meta_draw a JOIN meta_draw b ON a.stem = b.stem AND a.seq = 0 AND b.seq > 0 WHERE a.authors IS NOT NULL AND b.authors IS NOT NULL GROUP BY 1, 2, 3""")
def first_author_edges(s, d):
    """From each article's first author to the others."""
    m = t(s, d, "meta_draw").where("authors is not null").select("stem", "seq", "authors").distinct()
    a, b = m.where("seq = 0").select("stem", F.col("authors").alias("first_author")), m.where("seq > 0").select("stem", F.col("authors").alias("other"), "seq")
    return a.join(b, "stem").groupBy("stem", "first_author", "other").agg(F.min("seq").alias("seq"))


@query("""WITH k AS (SELECT stem, row_number() OVER (PARTITION BY substr(sha1('article' || chr(31) || stem), 1, 4) ORDER BY stem) AS n, substr(sha1('article' || chr(31) || stem), 1, 4) AS short, sha1('article' || chr(31) || stem) AS long FROM (SELECT DISTINCT stem FROM articles))
  SELECT stem, 'A' || CASE WHEN n = 1 THEN short ELSE substr(long, 1, 9) END AS id FROM k""")
def registered_ids(s, d):
    """A short hashed id for each article; on a collision the later one's is longer."""
    h = F.sha1(F.concat_ws("\x1f", F.lit("article"), "stem"))
    k = t(s, d, "articles").where("stem is not null").select("stem").distinct().withColumn("long", h).withColumn("short", F.substring("long", 1, 4))
    n = F.row_number().over(Window.partitionBy("short").orderBy("stem"))
    return k.withColumn("n", n).select("stem", F.concat(F.lit("A"), F.when(F.col("n") == 1, F.col("short")).otherwise(F.substring("long", 1, 9))).alias("id"))


@query()
def persons_resolved(s, d):
    """(draw_id, person): mentions of one name key are one person if the key has one organisation; else by organisation too."""
    m = t(s, d, "meta_draw").where("authors is not null").select("draw_id", F.replace(folded("authors"), F.lit(" "), F.lit("")).alias("k"), F.coalesce(institution_key("orgname"), F.lit("")).alias("o")).where("k <> ''")
    n = m.where("o <> ''").groupBy("k").agg(F.countDistinct("o").alias("orgs"))
    x = m.join(n, "k", "left")
    return x.select("draw_id", F.md5(F.when(F.coalesce("orgs", F.lit(0)) <= 1, F.col("k")).when(F.col("o") == "", F.concat_ws("|", "k", F.col("draw_id").cast("string"))).otherwise(F.concat_ws("|", "k", "o"))).alias("person"))


@query()
def institution_groups(s, d):
    """(first, keys, mentions, name): institution keys consolidated by near spellings, with the commonest printed name."""
    from quire.operators.clusters import chosen_names, institution_clusters

    a = t(s, d, "affiliations").where("orgname is not null").select("orgname", institution_key("orgname").alias("key")).where("key <> ''")
    g = a.join(institution_clusters(a.select("key").distinct(), F.col("key")), "key")
    return g.groupBy("first").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("mentions")).join(chosen_names(g, "first", "orgname").withColumnRenamed("orgname", "name"), "first")
