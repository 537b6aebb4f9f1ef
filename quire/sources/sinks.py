"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, key: str) -> None:
    """JSON Lines, one nested record per row, sorted by key (a range partitioning, so no task sorts everything)."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by key: point lookups read one bucket, joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def append_log(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Rewrites only the partitions that have rows in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def markdown(articles: DataFrame) -> DataFrame:
    """(stem, markdown) from (stem, title, language, blocks ARRAY<STRUCT<role, text>>): YAML header, headings, text, notes."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    head = F.concat(F.lit("---\nid: "), "stem", F.lit("\ntitle: "), quote(F.col("title")), F.lit("\nlanguage: "), F.coalesce("language", F.lit("und")), F.lit("\n---\n"))
    body = F.filter("blocks", lambda b: ~F.coalesce(b["role"], F.lit("")).isin("footnote", "pageHeader", "pageFooter", "pageNumber"))
    notes = F.filter("blocks", lambda b: F.coalesce(b["role"], F.lit("")) == "footnote")
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    text = F.array_join(F.transform(body, lambda b: F.when(b["role"] == "title", F.concat(F.lit("## "), flat(b["text"]))).otherwise(flat(b["text"]))), "\n\n")
    foot = F.array_join(F.transform(notes, lambda b, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), flat(b["text"]))), "\n")
    return articles.select("stem", F.concat_ws("\n", head, text, foot).alias("markdown"))


def layout_xml(lines: DataFrame) -> DataFrame:
    """(page_id, xml): ALTO text blocks and lines in order, from (page_id, pos, id, region, text)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    one = F.concat(F.lit('<TextLine ID="'), "id", F.lit('">'), F.array_join(F.transform(F.split(esc(F.col("text")), r"\s+"), lambda w: F.concat(F.lit('<String CONTENT="'), w, F.lit('"/>'))), ""), F.lit("</TextLine>"))
    b = lines.groupBy("page_id", "region").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("x")))), lambda z: z["x"]), "").alias("x"))
    block = F.concat(F.lit('<TextBlock ID="'), F.coalesce("region", F.lit("r0")), F.lit('">'), "x", F.lit("</TextBlock>"))
    p = b.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))), lambda z: z["b"]), "").alias("x"))
    return p.select("page_id", F.concat(F.lit('<alto><Layout><Page ID="'), "page_id", F.lit('"><PrintSpace>'), "x", F.lit("</PrintSpace></Page></Layout></alto>")).alias("xml"))


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def article_xml(articles: DataFrame) -> DataFrame:
    """(stem, xml): JATS front, body and notes from (stem, title, language, pub_year, authors ARRAY<STRUCT<family, given>>,
    blocks ARRAY<STRUCT<id, role, text>>). Headings open sections; null parts are left out."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _escaped(c), F.lit(f"</{name.split(' ')[0]}>"))
    join = lambda xs: F.array_join(xs, "")
    people = F.transform("authors", lambda a: F.concat(F.lit('<contrib contrib-type="author"><name>'), F.coalesce(tag("surname", a["family"]), F.lit("")), F.coalesce(tag("given-names", a["given"]), F.lit("")), F.lit("</name></contrib>")))
    meta = F.concat(F.coalesce(F.concat(F.lit("<title-group>"), tag("article-title", F.col("title")), F.lit("</title-group>")), F.lit("")), F.coalesce(F.concat(F.lit("<contrib-group>"), join(people), F.lit("</contrib-group>")), F.lit("")), F.coalesce(F.concat(F.lit("<pub-date><year>"), F.col("pub_year").cast("string"), F.lit("</year></pub-date>")), F.lit("")))
    role = lambda b: F.coalesce(b["role"], F.lit(""))
    par = lambda b: F.concat(F.lit('<p id="'), _escaped(b["id"]), F.lit('">'), _escaped(b["text"]), F.lit("</p>"))
    body = F.filter("blocks", lambda b: ~role(b).isin("footnote", "pageHeader", "pageFooter", "pageNumber"))
    flow = join(F.transform(body, lambda b: F.when(role(b) == "title", F.concat(F.lit("</sec><sec>"), tag("title", b["text"]))).otherwise(par(b))))
    notes = join(F.transform(F.filter("blocks", lambda b: role(b) == "footnote"), lambda b: F.concat(F.lit('<fn id="'), _escaped(b["id"]), F.lit('">'), tag("p", b["text"]), F.lit("</fn>"))))
    xml = F.concat(F.lit('<article xml:lang="'), F.coalesce("language", F.lit("und")), F.lit('"><front><article-meta><article-id>'), _escaped(F.col("stem")), F.lit("</article-id>"), meta, F.lit("</article-meta></front><body><sec>"), F.coalesce(flow, F.lit("")), F.lit("</sec></body><back><fn-group>"), F.coalesce(notes, F.lit("")), F.lit("</fn-group></back></article>"))
    return articles.select("stem", F.replace(xml, F.lit("<sec></sec>"), F.lit("")).alias("xml"))
