"""Canned queries with parameters, as `spark.sql(text, args)` over the tables; an empty parameter means any."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources.tables import table

QUERIES, ORACLE = {}, {}


def canned(name: str, tables: list[str], text: str, duck: str | None = None, /, **args):
    """Registers a query; {table} in the text stands for a table. duck: the text for DuckDB where the dialects differ."""

    def run(spark, folder):
        return spark.sql(text, args=args, **{n: table(spark, folder, n) for n in tables})

    sql = duck or text
    for n in tables:
        sql = sql.replace("{" + n + "}", n)
    for k, v in args.items():
        sql = sql.replace(f":{k}", "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v))
    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, sql
    return run


canned(
    "articles_by_author", ["meta_draw", "articles"],
    """SELECT m.stem, min(a.title) AS title, count(DISTINCT m.seq) AS mentions FROM {meta_draw} m JOIN {articles} a ON m.stem = a.stem
       WHERE (:name = '' OR contains(lower(m.authors), :name)) AND (:source = '' OR m.source = :source) GROUP BY m.stem""",
    name="samuel", source="",
)
canned(
    "who_cites_whom", ["ibid_draw"],
    """SELECT stem AS citing, split_part(target, '|', 1) AS cited, count(*) AS mentions, count(DISTINCT backref) AS backrefs, CAST(stem = split_part(target, '|', 1) AS INT) AS self
       FROM {ibid_draw} WHERE target IS NOT NULL AND stem IS NOT NULL GROUP BY stem, split_part(target, '|', 1)""",
)
canned(
    "most_cited_targets", ["ibid_draw"],
    """SELECT target, count(*) AS mentions, count(DISTINCT stem) AS articles, round(avg(score), 6) AS score FROM {ibid_draw} WHERE target IS NOT NULL GROUP BY target ORDER BY articles DESC, mentions DESC, target LIMIT 20""",
)
canned(
    "resolved_by_method", ["ibid_draw"],
    """SELECT method, count(*) AS links, count(target) AS resolved, round(count(target) / count(*), 6) AS share, round(min(score), 3) AS low, round(max(score), 3) AS high FROM {ibid_draw} GROUP BY method""",
)
canned(
    "disagreements_summary", ["articles"],
    """WITH p AS (SELECT a.title AS t1, b.title AS t2, a.pub_year AS y1, b.pub_year AS y2, a.language AS l1, b.language AS l2, a.lpage AS p1, b.lpage AS p2 FROM {articles} a JOIN {articles} b ON a.stem = b.stem AND a.loaded < b.loaded),
       f AS (SELECT 'title' AS field, coalesce(t1, '') <> coalesce(t2, '') AS differs FROM p UNION ALL SELECT 'pub_year', coalesce(y1, 0) <> coalesce(y2, 0) FROM p
             UNION ALL SELECT 'language', coalesce(l1, '') <> coalesce(l2, '') FROM p UNION ALL SELECT 'lpage', coalesce(p1, '') <> coalesce(p2, '') FROM p)
       SELECT field, count(*) AS pairs, CAST(sum(CASE WHEN differs THEN 1 ELSE 0 END) AS BIGINT) AS differing FROM f GROUP BY field""",
)
canned(
    "versions_side_by_side", ["article_runs"],
    """SELECT stem, count(*) AS versions, count(DISTINCT sha) AS texts, min(made) AS first_made, max(made) AS last_made, CAST(max(current) AS INT) AS has_current FROM {article_runs}
       WHERE stem IS NOT NULL AND (:stem = '' OR stem = :stem) GROUP BY stem HAVING count(DISTINCT run) > 1""",
    stem="",
)
canned(
    "text_search_snippet", ["documents"],
    """SELECT doc_id, CAST(instr(lower(text), :word) AS BIGINT) AS at, substr(text, greatest(1, instr(lower(text), :word) - 20), 60) AS snippet FROM {documents} WHERE instr(lower(text), :word) > 0 AND (:lang = '' OR lang = :lang)""",
    word="curriculum", lang="eng",
)
canned(
    "institution_countries", ["affiliations"],
    """WITH k AS (SELECT lower(trim(orgname)) AS org, country, count(*) AS n FROM {affiliations} WHERE orgname IS NOT NULL AND country IS NOT NULL GROUP BY lower(trim(orgname)), country),
       r AS (SELECT org, country, n, row_number() OVER (PARTITION BY org ORDER BY n DESC, country) AS k, sum(n) OVER (PARTITION BY org) AS total, count(*) OVER (PARTITION BY org) AS countries FROM k)
       SELECT org, country, n, CAST(total AS BIGINT) AS total, countries FROM r WHERE k = 1""",
)
canned(
    "coauthors", ["affiliations"],
    """SELECT a.orgname AS org_a, b.orgname AS org_b, count(DISTINCT a.stem) AS articles FROM {affiliations} a JOIN {affiliations} b ON a.stem = b.stem AND a.orgname < b.orgname GROUP BY a.orgname, b.orgname""",
)
canned(
    "least_trusted_blocks", ["words"],
    """SELECT block_pk, count(*) AS n, min(conf) AS low, round(avg(conf), 6) AS mean FROM {words} WHERE conf IS NOT NULL GROUP BY block_pk ORDER BY low, mean, block_pk LIMIT 300""",
)
canned(
    "loads_by_month", ["articles", "runs"],
    """SELECT 'articles' AS tbl, date_format(loaded, 'yyyy-MM') AS month, count(*) AS n, count(withdrawn) AS withdrawn FROM {articles} GROUP BY 2 UNION ALL SELECT 'runs', date_format(loaded, 'yyyy-MM'), count(*), count(withdrawn) FROM {runs} GROUP BY 2""",
    """SELECT 'articles' AS tbl, strftime(loaded AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n, count(withdrawn) AS withdrawn FROM {articles} GROUP BY 2 UNION ALL SELECT 'runs', strftime(loaded AT TIME ZONE 'UTC', '%Y-%m'), count(*), count(withdrawn) FROM {runs} GROUP BY 2""",
)


def country_codes(spark, folder):
    """Rows per country in one form, from the forms printed."""
    codes = F.create_map(*[F.lit(x) for p in _COUNTRIES.items() for x in p])
    c = F.lower(F.trim("country"))
    return table(spark, folder, "affiliations").groupBy(F.coalesce(F.try_element_at(codes, c), F.upper(c), F.lit("-")).alias("iso")).agg(F.count("*").alias("rows_"), F.countDistinct("country").alias("forms"))


# Printed country names and codes.
_COUNTRIES = {"egypt": "EG", "eg": "EG", "مصر": "EG", "jordan": "JO", "الأردن": "JO", "germany": "DE", "deutschland": "DE", "france": "FR", "iran": "IR", "turkey": "TR", "spain": "ES"}
QUERIES["country_codes"] = country_codes
ORACLE["country_codes"] = (
    "SELECT CASE lower(trim(country)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _COUNTRIES.items()) + " ELSE coalesce(upper(trim(country)), '-') END AS iso, count(*) AS rows_, count(DISTINCT country) AS forms FROM affiliations GROUP BY 1"
)
