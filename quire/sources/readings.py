"""Readers of nested sources: OCR readings (JSON), layout and catalogue XML, gold pages, predictions, listings, lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.intervals import containing

_SPAN = "array<struct<offset:int,length:int>>"
OCR_SCHEMA = (
    "analyzeResult struct<content:string,modelId:string,stringIndexType:string,"
    "pages:array<struct<pageNumber:int,width:double,height:double,unit:string,angle:double,"
    "words:array<struct<content:string,confidence:double,polygon:array<double>,span:struct<offset:int,length:int>>>,"
    f"lines:array<struct<content:string,polygon:array<double>,spans:{_SPAN}>>>>,"
    f"paragraphs:array<struct<content:string,role:string,spans:{_SPAN},boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>,"
    f"styles:array<struct<isHandwritten:boolean,confidence:double,spans:{_SPAN}>>>"
)
#: Dots per inch that boxes in inches are brought to.
DPI = 300


def read_ocr(spark, path: str) -> DataFrame:
    """One row per reading, with its file's stem."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.schema(OCR_SCHEMA).option("multiLine", True).json(path).select(stem.alias("stem"), "analyzeResult.*")


def _box(polygon: Column, unit: Column) -> Column:
    """x0, y0, x1, y1 in pixels of a polygon; null for none."""
    xs, ys = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    k = F.when(unit == "inch", F.lit(float(DPI))).otherwise(1.0)
    return F.when(F.size(polygon) >= 6, F.array(F.array_min(xs) * k, F.array_min(ys) * k, F.array_max(xs) * k, F.array_max(ys) * k))


def ocr_words(readings: DataFrame) -> DataFrame:
    """(stem, page, n, word_id, text, conf, off, len, box): words with a polygon in reading order, numbered per page."""
    p = readings.select("stem", F.explode("pages").alias("p")).select("stem", F.col("p.pageNumber").alias("page"), F.col("p.unit").alias("unit"), F.explode("p.words").alias("w"))
    w = p.where(F.size("w.polygon") >= 6).select("stem", "page", F.col("w.content").alias("text"), F.col("w.confidence").alias("conf"), F.col("w.span.offset").alias("off"), F.col("w.span.length").alias("len"), _box(F.col("w.polygon"), F.col("unit")).alias("box"))
    n = F.row_number().over(Window.partitionBy("stem", "page").orderBy("off", "text"))
    return w.withColumn("n", n).withColumn("word_id", F.format_string("p%dw%04d", "page", "n"))


def ocr_lines(readings: DataFrame) -> DataFrame:
    """(stem, page, line, label, text, off, len) of the lines that have a text; labelled "page:number"."""
    p = readings.select("stem", F.explode("pages").alias("p")).select("stem", F.col("p.pageNumber").alias("page"), F.posexplode("p.lines").alias("line", "l"))
    x = p.where(F.trim("l.content") != "").select("stem", "page", "line", F.col("l.content").alias("text"), F.col("l.spans")[0]["offset"].alias("off"), F.col("l.spans")[0]["length"].alias("len"))
    return x.withColumn("label", F.concat_ws(":", "page", "line"))


def ocr_paragraphs(readings: DataFrame) -> DataFrame:
    """(stem, para, role, text, off, len)."""
    p = readings.select("stem", F.posexplode("paragraphs").alias("para", "q"))
    return p.select("stem", "para", F.col("q.role").alias("role"), F.col("q.content").alias("text"), F.col("q.spans")[0]["offset"].alias("off"), F.col("q.spans")[0]["length"].alias("len"))


def assign(words: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Words with the key of the span that holds them, by character offsets; null where none does."""
    s = spans.select("stem", F.col("off").alias("lo"), (F.col("off") + F.col("len")).alias("hi"), key)
    return containing(words.drop(key) if key in words.columns else words, s, ["stem"], "off", "lo", "hi", keep=True)


def handwriting(words: DataFrame, readings: DataFrame) -> DataFrame:
    """Words with the highest confidence of the handwriting styles over them, 0 without one."""
    st = readings.select("stem", F.explode("styles").alias("s")).where("s.isHandwritten").select("stem", F.col("s.confidence").alias("hand"), F.explode("s.spans").alias("x"))
    st = st.select("stem", "hand", F.col("x.offset").alias("lo"), (F.col("x.offset") + F.col("x.length")).alias("hi"))
    hit = containing(words.select("stem", "page", "n", "off"), st, ["stem"], "off", "lo", "hi").groupBy("stem", "page", "n").agg(F.max("hand").alias("hand"))
    return words.join(hit, ["stem", "page", "n"], "left").withColumn("hand", F.coalesce("hand", F.lit(0.0)))


# --- XML ----------------------------------------------------------------------------------------------------------

_MARC = "leader string, controlfield array<struct<_VALUE:string,_tag:string>>, datafield array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_VALUE:string,_code:string>>>>"
_STRING = "struct<_ID:string,_CONTENT:string,_HPOS:double,_VPOS:double,_WIDTH:double,_HEIGHT:double,_WC:double>"
_ALTO = f"_ID string, _PHYSICAL_IMG_NR int, PrintSpace struct<TextBlock:array<struct<_ID:string,TextLine:array<struct<_ID:string,String:array<{_STRING}>>>>>>"


def read_marc(spark, path: str) -> DataFrame:
    """One row per catalogue record: rec (its 001), leader, control and data fields in order."""
    r = spark.read.format("xml").option("rowTag", "record").schema(_MARC).load(path)
    return r.withColumn("rec", F.filter("controlfield", lambda x: x["_tag"] == "001")[0]["_VALUE"])


def marc_fields(records: DataFrame) -> DataFrame:
    """(rec, fseq, sseq, tag, ind1, ind2, code, value): every subfield, order and repeats kept; control fields have no code."""
    c = records.select("rec", F.posexplode("controlfield").alias("fseq", "c")).select("rec", "fseq", F.lit(0).alias("sseq"), F.col("c._tag").alias("tag"), *[F.lit(None).cast("string").alias(x) for x in ("ind1", "ind2", "code")], F.col("c._VALUE").alias("value"))
    base = F.coalesce(F.size("controlfield"), F.lit(0))
    d = records.select("rec", base.alias("base"), F.posexplode("datafield").alias("i", "d")).select("rec", (F.col("base") + F.col("i")).alias("fseq"), F.col("d._tag").alias("tag"), F.col("d._ind1").alias("ind1"), F.col("d._ind2").alias("ind2"), F.posexplode("d.subfield").alias("sseq", "s"))
    return c.unionByName(d.select("rec", "fseq", "sseq", "tag", "ind1", "ind2", F.col("s._code").alias("code"), F.col("s._VALUE").alias("value")))


def marc_value(fields: DataFrame, tag: str, code: str, name: str) -> DataFrame:
    """(rec, name): the first such subfield of each record, without cataloguer's punctuation."""
    v = fields.where((F.col("tag") == tag) & (F.col("code") == code)).groupBy("rec").agg(F.min_by("value", F.struct("fseq", "sseq")).alias(name))
    return v.withColumn(name, F.regexp_replace(name, r"[\s:;/=,،.]+$", ""))


def marc_tag_statistics(fields: DataFrame) -> DataFrame:
    """(tag, code, records, occurrences)."""
    return fields.groupBy("tag", "code").agg(F.countDistinct("rec").alias("records"), F.count("*").alias("occurrences"))


def read_alto(spark, path: str) -> DataFrame:
    """(file, page, block, line, n, text, conf, box): the words of layout XML."""
    p = spark.read.format("xml").option("rowTag", "Page").schema(_ALTO).load(path).select(F.input_file_name().alias("file"), F.col("_PHYSICAL_IMG_NR").alias("page"), F.explode("PrintSpace.TextBlock").alias("b"))
    w = p.select("file", "page", F.col("b._ID").alias("block"), F.posexplode("b.TextLine").alias("line", "l")).select("file", "page", "block", "line", F.posexplode("l.String").alias("n", "s"))
    return w.select("file", "page", "block", "line", "n", F.col("s._CONTENT").alias("text"), F.col("s._WC").alias("conf"), F.array("s._HPOS", "s._VPOS", F.col("s._HPOS") + F.col("s._WIDTH"), F.col("s._VPOS") + F.col("s._HEIGHT")).alias("box"))


def article_front(xml: Column) -> dict[str, Column]:
    """Columns of an article's front matter from its XML text."""
    meta = "//article-meta"
    return {
        "title": F.xpath_string(xml, F.lit(f"{meta}//article-title")), "language": F.xpath_string(xml, F.lit("/article/@*[name()='xml:lang']")), "doi": F.xpath_string(xml, F.lit(f"{meta}/article-id[@pub-id-type='doi']")),
        "year": F.xpath_string(xml, F.lit(f"{meta}/pub-date/year")), "fpage": F.xpath_string(xml, F.lit(f"{meta}/fpage")), "lpage": F.xpath_string(xml, F.lit(f"{meta}/lpage")),
        "surnames": F.xpath(xml, F.lit(f"{meta}//contrib/name/surname/text()")), "keywords": F.xpath(xml, F.lit(f"{meta}//kwd/text()")), "abstract": F.xpath_string(xml, F.lit(f"{meta}/abstract")),
    }


def article_sections(xml: Column) -> Column:
    """Titles of the body's sections in order."""
    return F.xpath(xml, F.lit("/article/body//sec/title/text()"))


# --- gold, predictions, listings, lists -----------------------------------------------------------------------------

GOLD_SCHEMA = (
    "page_id string, stem string, page int, split string, kinds array<string>, primary string, decade string, status string,"
    "lines array<struct<id:string,region:string,box:array<double>,kind:string,lang:string,text:string,status:string>>, `order` array<string>,"
    "tables array<struct<id:string,html:string>>, equations array<struct<id:string,latex:string>>"
)


def read_gold(spark, path: str) -> DataFrame:
    return spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path)


def gold_lines(pages: DataFrame, kinds: list[str] | None = None, unsure: bool = True) -> DataFrame:
    """(page_id, pos, id, kind, text): a page's lines in reading order (those not in it last), without deleted ones."""
    x = pages.select("page_id", F.explode("lines").alias("l"), "order")
    x = x.where("l.status <> 'deleted' or l.status is null")
    if kinds:
        x = x.where(F.col("l.kind").isin(kinds))
    if not unsure:
        x = x.where("l.status <> 'unsure' or l.status is null")
    at = F.array_position("order", F.col("l.id"))
    return x.select("page_id", F.when(at > 0, at).otherwise(1_000_000).alias("pos"), "l.id", "l.kind", "l.text")


def first_of(readers: list[DataFrame], key: str) -> DataFrame:
    """Per key the row of the first reader that has it (a prediction in several formats)."""
    all_ = None
    for i, r in enumerate(readers):
        r = r.withColumn("__rank", F.lit(i))
        all_ = r if all_ is None else all_.unionByName(r, allowMissingColumns=True)
    cols = [c for c in all_.columns if c not in (key, "__rank")]
    return all_.groupBy(key).agg(F.min_by(F.struct(*cols), "__rank").alias("r")).select(key, "r.*")


def read_reference_text(spark, path: str) -> DataFrame:
    """(chapter, verse, text) of lines `a|b|text`; lines that begin with # and blank ones are left out."""
    p = F.split("value", r"\|", 3)
    return spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(p[0].cast("int").alias("chapter"), p[1].cast("int").alias("verse"), p[2].alias("text"))


def read_lexicon(spark, path: str) -> DataFrame:
    """(word, docs) of a tab-separated list with # comments."""
    return spark.read.schema("word string, docs long").option("sep", "\t").option("comment", "#").csv(path)


def read_listing(spark, path: str) -> DataFrame:
    """(bucket, key, size, mtime, class, ext, prefix) of an object store's listing."""
    x = spark.read.schema("bucket string, key string, size long, mtime timestamp, class string").option("sep", "\t").csv(path)
    return x.withColumn("ext", F.lower(F.regexp_extract("key", r"\.([^./]+)$", 1))).withColumn("prefix", F.substring_index("key", "/", 1))


def read_records(spark, path: str, field: str = "text") -> DataFrame:
    """(id, text) of JSON Lines records."""
    return spark.read.schema(f"id string, {field} string").json(path).select("id", F.col(field).alias("text"))


def _book_text(frames):
    import io
    import re
    import zipfile
    from html import unescape

    import pandas as pd

    def text(raw: bytes) -> str:
        x = re.sub(r"(?is)<(script|style|template|head)\b.*?</\1\s*>|<!--.*?-->", " ", raw.decode("utf-8", "replace"))
        return re.sub(r"\s+", " ", unescape(re.sub(r"(?s)<[^>]*>", " ", x))).strip()

    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"]):
            try:
                book = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                rows.append((path, None, None, "not a book"))
                continue
            names = sorted(n for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
            rows += [(path, i, text(book.read(n)), None) for i, n in enumerate(names)]
        yield pd.DataFrame(rows, columns=["path", "part", "text", "problem"]).astype({"part": "Int64"}).astype({"part": object})


def read_books(spark, path: str) -> DataFrame:
    """(path, part, text, problem): the visible text of each page file in EPUB books, in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInPandas(_book_text, "path string, part int, text string, problem string")


def read_listing_kinds(listing: DataFrame, key: str = "key") -> DataFrame:
    """(id, kinds): which kinds of files each id of an object listing has, from the ends of their names."""
    name = F.element_at(F.split(F.col(key), "/"), -1)
    return listing.select(F.regexp_extract(name, r"^([^.]+)", 1).alias("id"), F.regexp_extract(name, r"\.(.+)$", 1).alias("kind")).groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def checked_gold(pages: DataFrame) -> DataFrame:
    """(page_id, problem) of pages (page_id, order ARRAY<STRING>, lines ARRAY<STRUCT<id, box ARRAY<DOUBLE>>>): ids twice,
    boxes that aren't four numbers or have no area, an order that isn't all the lines."""
    ids = F.transform("lines", lambda x: x["id"])
    bad = F.exists("lines", lambda x: F.coalesce((F.size(x["box"]) != 4) | (F.get(x["box"], F.lit(2)) <= F.get(x["box"], F.lit(0))) | (F.get(x["box"], F.lit(3)) <= F.get(x["box"], F.lit(1))), F.lit(True)))
    same = F.array_sort("order") == F.array_sort(ids)
    p = F.array_compact(F.array(F.when(F.size(F.array_distinct(ids)) < F.size(ids), "line twice"), F.when(bad, "box"), F.when(~F.coalesce(same, F.lit(False)), "order")))
    return pages.select("page_id", F.explode(p).alias("problem"))
