"""Pages and their blocks: columns, order, heads, numbers, overlaps, placements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.plans.citations import t

QUERIES, ORACLE = {}, {}
#: Pixels of a page; the share of its height where heads end and feet begin.
PAGE_HEIGHT, PAGE_WIDTH, HEAD, FOOT = 3300, 2400, 0.1, 0.9
#: A box spans columns from this share of the text's width on; columns are parted by gaps of this share of the page's.
NARROW, GAP = 0.6, 0.08


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH p AS (SELECT stem, page, max(hpos + width) - min(hpos) AS tw FROM blocks GROUP BY 1, 2), n AS (SELECT block_pk, b.stem, b.page, hpos + width / 2.0 AS c FROM blocks b JOIN p ON b.stem = p.stem AND b.page = p.page WHERE width < {NARROW} * tw),
  g AS (SELECT *, CASE WHEN coalesce(lag(c) OVER (PARTITION BY stem, page ORDER BY c DESC, block_pk) - c > {GAP * PAGE_WIDTH}, true) THEN 1 ELSE 0 END AS new FROM n),
  k AS (SELECT block_pk, CAST(sum(new) OVER (PARTITION BY stem, page ORDER BY c DESC, block_pk) AS INT) AS col FROM g) SELECT b.block_pk, coalesce(k.col, 0) AS col FROM blocks b LEFT JOIN k ON b.block_pk = k.block_pk""")
def column_numbers(s, d):
    """(block_pk, col): columns from the right, by gaps between the centres of narrow boxes; wide boxes are 0."""
    b = t(s, d, "blocks").select("block_pk", "stem", "page", "hpos", "width")
    page = Window.partitionBy("stem", "page")
    b = b.withColumn("tw", F.max(F.col("hpos") + F.col("width")).over(page) - F.min("hpos").over(page)).withColumn("narrow", F.coalesce(F.col("width") < NARROW * F.col("tw"), F.lit(False)))
    w = Window.partitionBy("stem", "page", "narrow").orderBy(F.desc("c"), "block_pk")
    b = b.withColumn("c", F.col("hpos") + F.col("width") / 2.0).withColumn("new", F.when(F.coalesce(F.lag("c").over(w) - F.col("c") > GAP * PAGE_WIDTH, F.lit(True)), 1).otherwise(0))
    return b.select("block_pk", F.when(F.col("narrow"), F.sum("new").over(w)).otherwise(0).cast("int").alias("col"))


@query("""WITH b AS (SELECT stem, page, vpos, height, hpos AS x0, hpos + width AS x1, lead(vpos) OVER w AS v2, lead(hpos) OVER w AS a0, lead(hpos + width) OVER w AS a1 FROM blocks WINDOW w AS (PARTITION BY stem, page ORDER BY ord, block_pk))
  SELECT stem, count(*) AS inversions FROM b WHERE v2 < vpos - 0.5 * height AND least(x1, a1) - greatest(x0, a0) > 0.3 * least(x1 - x0, a1 - a0) GROUP BY 1""")
def order_inversions(s, d):
    """Blocks that go back up the page within a column."""
    w = Window.partitionBy("stem", "page").orderBy("ord", "block_pk")
    b = t(s, d, "blocks").select("stem", "page", "ord", "block_pk", "vpos", "height", F.col("hpos").alias("x0"), (F.col("hpos") + F.col("width")).alias("x1"))
    b = b.select("stem", "vpos", "height", "x0", "x1", F.lead("vpos").over(w).alias("v2"), F.lead("x0").over(w).alias("a0"), F.lead("x1").over(w).alias("a1"))
    return b.where("v2 < vpos - 0.5 * height and least(x1, a1) - greatest(x0, a0) > 0.3 * least(x1 - x0, a1 - a0)").groupBy("stem").agg(F.count("*").alias("inversions"))


@query("""WITH b AS (SELECT stem, page, block_pk, vpos, hpos, max(vpos + height) OVER (PARTITION BY stem, page ORDER BY vpos, block_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM blocks),
  g AS (SELECT *, CAST(sum(CASE WHEN vpos < low THEN 0 ELSE 1 END) OVER (PARTITION BY stem, page ORDER BY vpos, block_pk) AS INT) AS band FROM b)
  SELECT block_pk, band, CAST(row_number() OVER (PARTITION BY stem, page ORDER BY band, hpos DESC, block_pk) AS INT) AS place FROM g""")
def band_order(s, d):
    """(block_pk, band, place): from top to bottom by bands that no gap parts, from the right within one."""
    down = Window.partitionBy("stem", "page").orderBy("vpos", "block_pk")
    b = t(s, d, "blocks").select("stem", "page", "block_pk", "vpos", "hpos", "height")
    b = b.withColumn("low", F.max(F.col("vpos") + F.col("height")).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("band", F.sum(F.when(F.col("vpos") < F.col("low"), 0).otherwise(1)).over(down).cast("int"))
    return b.select("block_pk", "band", F.row_number().over(Window.partitionBy("stem", "page").orderBy("band", F.desc("hpos"), "block_pk")).alias("place"))


_HEAD_SQL = "trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '\\p{Nd}+', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH h AS (SELECT DISTINCT stem, page, {_HEAD_SQL} AS head FROM blocks WHERE vpos < {HEAD * PAGE_HEIGHT}), c AS (SELECT stem, head, count(*) AS pages FROM h WHERE head <> '' GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT stem, head, pages FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY pages DESC, head) AS n FROM c) WHERE n = 1""")
def running_heads(s, d):
    """(stem, head, pages): the commonest first line at the top of an article's pages, digits left out, on three at least."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.substring_index("text", "\n", 1), r"\p{Nd}+", ""), r"\s+", " "))
    h = t(s, d, "blocks").where(F.col("vpos") < HEAD * PAGE_HEIGHT).select("stem", "page", line.alias("head")).distinct().where("head <> ''")
    c = h.groupBy("stem", "head").agg(F.count("*").alias("pages")).where("pages >= 3")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("pages"), "head"))).where("n = 1").drop("n")


_FOLIO_SQL = f"""f AS (SELECT stem, page, min(CAST(regexp_extract(text, '^[^0-9]?\\s?([0-9]{{1,4}})\\s?[^0-9]?$', 1) AS INT)) AS folio FROM blocks
  WHERE (vpos > {FOOT * PAGE_HEIGHT} OR vpos < {HEAD * PAGE_HEIGHT}) AND regexp_matches(text, '^[^0-9]?\\s?([0-9]{{1,4}})\\s?[^0-9]?$') GROUP BY 1, 2)"""


def _folios(s, d):
    """(stem, page, folio): the number alone in a page's head or foot; the smallest of several."""
    p = r"^[^0-9]?\s?([0-9]{1,4})\s?[^0-9]?$"
    b = t(s, d, "blocks").where(((F.col("vpos") > FOOT * PAGE_HEIGHT) | (F.col("vpos") < HEAD * PAGE_HEIGHT)) & F.col("text").rlike(p))
    return b.groupBy("stem", "page").agg(F.min(F.regexp_extract("text", p, 1).cast("int")).alias("folio"))


@query(f"""WITH {_FOLIO_SQL}, n AS (SELECT stem, folio - page AS d, count(*) AS n FROM f GROUP BY 1, 2), b AS (SELECT stem, arg_max(d, (n, -d)) AS shift, max(n) AS pages, CAST(sum(n) AS BIGINT) AS numbered FROM n GROUP BY 1)
  SELECT * FROM b WHERE pages >= 2 AND 3 * pages >= 2 * numbered""")
def folio_shift(s, d):
    """(stem, shift, pages, numbered): the steady difference between printed and physical page numbers."""
    n = _folios(s, d).groupBy("stem", (F.col("folio") - F.col("page")).alias("d")).agg(F.count("*").alias("n"))
    b = n.groupBy("stem").agg(F.max_by("d", F.struct("n", (-F.col("d")).alias("x"))).alias("shift"), F.max("n").alias("pages"), F.sum("n").alias("numbered"))
    return b.where("pages >= 2 and 3 * pages >= 2 * numbered")


@query()
def printed_pages(s, d):
    """(stem, page, folio, fixed, offset): printed numbers, lone outliers set right between two that fit."""
    from quire.operators.trust import page_numbers

    pages = t(s, d, "blocks").select("stem", "page").distinct().join(_folios(s, d), ["stem", "page"], "left")
    return page_numbers(pages)


@query("""WITH b AS (SELECT block_pk, stem, page, hpos AS x0, hpos + width AS x1, vpos AS y0, vpos + height AS y1 FROM blocks), o AS (SELECT a.block_pk AS a, b.block_pk AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM b a JOIN b ON a.stem = b.stem AND a.page = b.page AND a.block_pk < b.block_pk AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
  SELECT a, b, round(shared / small, 6) AS share FROM o WHERE shared > 0.25 * small""")
def box_overlaps(s, d):
    """(a, b, share): blocks of a page that cover more than a quarter of the smaller of them."""
    b = t(s, d, "blocks").select("stem", "page", F.col("block_pk").alias("a"), F.col("hpos").alias("x0"), (F.col("hpos") + F.col("width")).alias("x1"), F.col("vpos").alias("y0"), (F.col("vpos") + F.col("height")).alias("y1"))
    o = b.select("stem", "page", F.col("a").alias("b"), *[F.col(c).alias(f"{c}b") for c in ("x0", "x1", "y0", "y1")])
    x = b.join(o, ["stem", "page"]).where("a < b and x0 < x1b and x0b < x1 and y0 < y1b and y0b < y1")
    x = x.withColumn("shared", F.expr("(least(x1, x1b) - greatest(x0, x0b)) * (least(y1, y1b) - greatest(y0, y0b))")).withColumn("small", F.expr("least((x1 - x0) * (y1 - y0), (x1b - x0b) * (y1b - y0b))"))
    return x.where("shared > 0.25 * small").select("a", "b", F.round(F.col("shared") / F.col("small"), 6).alias("share"))


@query("""WITH l AS (SELECT stem, page, block_id, trim(unnest(string_split(text, chr(10)))) AS line FROM blocks) SELECT stem, page, line, count(DISTINCT block_id) AS blocks FROM l WHERE length(line) >= 4 GROUP BY 1, 2, 3 HAVING count(DISTINCT block_id) > 1""")
def lines_placed_twice(s, d):
    """Lines that stand in more than one block of a page."""
    x = t(s, d, "blocks").select("stem", "page", "block_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("length(line) >= 4")
    return x.distinct().groupBy("stem", "page", "line").agg(F.count("*").alias("blocks")).where("blocks > 1")


@query("""SELECT stem, page, count(*) AS blocks, CAST(sum(CASE WHEN role = 'paragraph' OR role = 'text' THEN 1 ELSE 0 END) AS BIGINT) AS running, CAST(sum(CASE WHEN role IN ('pageHeader', 'pageFooter', 'pageNumber') THEN 1 ELSE 0 END) AS BIGINT) AS furniture,
  CAST(sum(CASE WHEN role LIKE '%note%' THEN 1 ELSE 0 END) AS BIGINT) AS notes, CAST(sum(CASE WHEN role IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unnamed FROM blocks GROUP BY 1, 2""")
def page_mix(s, d):
    """A page's blocks by coarse role."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    r = F.col("role")
    return t(s, d, "blocks").groupBy("stem", "page").agg(F.count("*").alias("blocks"), n(r.isin("paragraph", "text")).alias("running"), n(r.isin("pageHeader", "pageFooter", "pageNumber")).alias("furniture"), n(r.like("%note%")).alias("notes"), n(r.isNull()).alias("unnamed"))


@query("""WITH r AS (SELECT coalesce(role, '-') AS role, stem, count(*) AS n FROM blocks GROUP BY 1, 2) SELECT role, count(*) AS articles, CAST(sum(n) AS BIGINT) AS blocks FROM r GROUP BY 1""")
def role_statistics(s, d):
    """How many articles have a role, and how often it occurs."""
    r = t(s, d, "blocks").groupBy(F.coalesce("role", F.lit("-")).alias("role"), "stem").agg(F.count("*").alias("n"))
    return r.groupBy("role").agg(F.count("*").alias("articles"), F.sum("n").alias("blocks"))


@query("""WITH b AS (SELECT stem, height / (1.0 + length(text) - length(replace(text, chr(10), ''))) AS line, width / nullif(length(string_split(text, chr(10))[1]), 0) AS letter FROM blocks WHERE text IS NOT NULL)
  SELECT stem, round(median(line), 4) AS line_height, round(median(letter), 4) AS letter_width FROM b GROUP BY 1""")
def document_medians(s, d):
    """Median line height and width per letter of an article's blocks."""
    lines = 1.0 + F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    letter = F.col("width") / F.nullif(F.length(F.substring_index("text", "\n", 1)), F.lit(0))
    b = t(s, d, "blocks").where("text is not null").select("stem", (F.col("height") / lines).alias("line"), letter.alias("letter"))
    return b.groupBy("stem").agg(F.round(F.median("line"), 4).alias("line_height"), F.round(F.median("letter"), 4).alias("letter_width"))


@query("""WITH w AS (SELECT stem, page, block_pk, line, min(hpos) AS x, max(vpos) AS y, count(*) AS words, round(avg(conf), 6) AS conf FROM words GROUP BY 1, 2, 3, 4) SELECT stem, page, count(*) AS lines, CAST(sum(words) AS BIGINT) AS words, round(min(conf), 6) AS worst FROM w GROUP BY 1, 2""")
def page_lines(s, d):
    """Lines of a page put together from its words, with the least certain one's mean confidence."""
    w = t(s, d, "words").groupBy("stem", "page", "block_pk", "line").agg(F.count("*").alias("words"), F.round(F.avg("conf"), 6).alias("conf"))
    return w.groupBy("stem", "page").agg(F.count("*").alias("lines"), F.sum("words").alias("words"), F.round(F.min("conf"), 6).alias("worst"))


@query("""WITH w AS (SELECT stem, page, block_pk, ord, CASE WHEN conf < 0.8 THEN 1 ELSE 0 END AS low FROM words), k AS (SELECT *, row_number() OVER (PARTITION BY block_pk ORDER BY ord, low) - row_number() OVER (PARTITION BY block_pk, low ORDER BY ord) AS isle FROM (SELECT DISTINCT block_pk, ord, low, stem FROM w)),
  r AS (SELECT stem, block_pk, isle, count(*) AS n FROM k WHERE low = 1 GROUP BY 1, 2, 3) SELECT stem, count(*) AS runs, max(n) AS longest, CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM r GROUP BY 1""")
def doubtful_runs(s, d):
    """Runs of neighbouring words below the confidence limit; three and more in a row are a high flag."""
    w = t(s, d, "words").select("stem", "block_pk", "ord", F.when(F.col("conf") < 0.8, 1).otherwise(0).alias("low")).distinct()
    isle = F.row_number().over(Window.partitionBy("block_pk").orderBy("ord", "low")) - F.row_number().over(Window.partitionBy("block_pk", "low").orderBy("ord"))
    r = w.withColumn("isle", isle).where("low = 1").groupBy("stem", "block_pk", "isle").agg(F.count("*").alias("n"))
    return r.groupBy("stem").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.sum(F.when(F.col("n") >= 3, 1).otherwise(0)).alias("high"))
