import json

from pyspark.sql import functions as F

from quire.functions import values as V
from quire.operators import intervals as I
from quire.sources import readings as R
from quire.sources import sinks as K


def poly(x, y, w=1, h=1):
    return [x, y, x + w, y, x + w, y + h, x, y + h]


def test_ocr(spark, tmp_path):
    words = [("one", 0, 3, poly(1, 1), 0.9), ("two", 4, 3, poly(3, 1), None), ("lost", 8, 4, [], 0.5), ("three", 13, 5, poly(1, 3), 0.7)]
    doc = {"analyzeResult": {"content": "one two lost three", "pages": [{"pageNumber": 1, "unit": "inch", "words": [{"content": t, "confidence": c, "polygon": p, "span": {"offset": o, "length": n}} for t, o, n, p, c in words],
        "lines": [{"content": "one two lost", "spans": [{"offset": 0, "length": 12}]}, {"content": "three", "spans": [{"offset": 13, "length": 5}]}]}],
        "paragraphs": [{"content": "one two lost three", "role": "title", "spans": [{"offset": 0, "length": 18}], "boundingRegions": []}],
        "styles": [{"isHandwritten": True, "confidence": 0.8, "spans": [{"offset": 13, "length": 5}]}]}}
    (tmp_path / "1000-001-001-001.json").write_text(json.dumps(doc))
    r = R.read_ocr(spark, str(tmp_path))
    w = R.ocr_words(r)
    got = {x["text"]: x for x in R.handwriting(R.assign(w, R.ocr_lines(r), "line"), r).collect()}
    assert {t: (x["word_id"], x["line"], x["hand"]) for t, x in got.items()} == {"one": ("p1w0001", 0, 0.0), "two": ("p1w0002", 0, 0.0), "three": ("p1w0003", 1, 0.8)}
    assert got["one"]["box"] == [300.0, 300.0, 600.0, 600.0] and got["one"]["stem"] == "1000-001-001-001"
    assert [x["role"] for x in R.ocr_paragraphs(r).collect()] == ["title"]


def test_marc_alto_jats(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<collection><record><leader>x</leader><controlfield tag="001">r1</controlfield><datafield tag="245" ind1="1" ind2="0"><subfield code="a">Title /</subfield><subfield code="b">more</subfield></datafield><datafield tag="245" ind1=" " ind2=" "><subfield code="a">Second</subfield></datafield></record></collection>')
    f = R.marc_fields(R.read_marc(spark, str(tmp_path / "m.xml")))
    assert f.count() == 4 and R.marc_value(f, "245", "a", "title").first()["title"] == "Title"
    assert {(r["tag"], r["records"], r["occurrences"]) for r in R.marc_tag_statistics(f).where("code = 'a'").collect()} == {("245", 1, 2)}
    (tmp_path / "a.xml").write_text('<alto><Layout><Page ID="p" PHYSICAL_IMG_NR="3"><PrintSpace><TextBlock ID="b"><TextLine ID="l"><String CONTENT="hi" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4" WC="0.5"/><String CONTENT="you" HPOS="5" VPOS="2" WIDTH="3" HEIGHT="4"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>')
    a = R.read_alto(spark, str(tmp_path / "a.xml")).orderBy("n").collect()
    assert [(x["page"], x["text"], x["conf"], x["box"]) for x in a] == [(3, "hi", 0.5, [1.0, 2.0, 4.0, 6.0]), (3, "you", None, [5.0, 2.0, 8.0, 6.0])]
    x = '<article><front><article-meta><article-id pub-id-type="doi">10/x</article-id><title-group><article-title>T</article-title></title-group><contrib-group><contrib><name><surname>S</surname></name></contrib></contrib-group><pub-date><year>1999</year></pub-date></article-meta></front><body><sec><title>A</title></sec><sec><title>B</title></sec></body></article>'
    c = R.article_front(F.col("x"))
    row = spark.createDataFrame([(x,)], "x string").select(*[v.alias(k) for k, v in c.items()], R.article_sections(F.col("x")).alias("sections")).first()
    assert (row["title"], row["doi"], row["year"], row["surnames"], row["sections"]) == ("T", "10/x", "1999", ["S"], ["A", "B"])


def test_gold_predictions_lists(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"page_id": "p", "lines": [{"id": "a", "kind": "x", "text": "1"}, {"id": "b", "kind": "x", "text": "2", "status": "deleted"}, {"id": "c", "kind": "y", "text": "3", "status": "unsure"}], "order": ["c", "a"]}))
    g = R.read_gold(spark, str(tmp_path / "g.json"))
    assert [r["id"] for r in R.gold_lines(g).orderBy("pos").collect()] == ["c", "a"] and R.gold_lines(g, ["x"], False).count() == 1
    a, b = spark.createDataFrame([("k", "first")], "id string, t string"), spark.createDataFrame([("k", "second"), ("m", "other")], "id string, t string")
    assert {(r["id"], r["t"]) for r in R.first_of([a, b], "id").collect()} == {("k", "first"), ("m", "other")}
    (tmp_path / "q.txt").write_text("# note\n1|2|a|b\n\n")
    assert [tuple(r) for r in R.read_reference_text(spark, str(tmp_path / "q.txt")).collect()] == [(1, 2, "a|b")]
    (tmp_path / "l.tsv").write_text("#c\nword\t5\n")
    assert [tuple(r) for r in R.read_lexicon(spark, str(tmp_path / "l.tsv")).collect()] == [("word", 5)]
    (tmp_path / "s.tsv").write_text("b\tp/x.PDF\t3\t2024-01-01 00:00:00\tSTD\n")
    assert [(r["ext"], r["prefix"]) for r in R.read_listing(spark, str(tmp_path / "s.tsv")).collect()] == [("pdf", "p")]
    K.write_records(b, str(tmp_path / "out"), "id")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    K.append_log(b, str(tmp_path / "log"), "id")
    K.replace_partitions(b.where("id = 'k'").withColumn("t", F.lit("new")), str(tmp_path / "log"), "id")
    assert {r["t"] for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {"new", "other"}


def test_writers(spark):
    df = spark.createDataFrame([("s", 'A "b"', None, [("title", "Head"), ("text", "a\nb"), ("footnote", "n"), ("pageNumber", "3")])], "stem string, title string, language string, blocks array<struct<role:string,text:string>>")
    assert K.markdown(df).first()["markdown"] == '---\nid: s\ntitle: "A \\"b\\""\nlanguage: und\n---\n\n## Head\n\na b\n[^1]: n'
    x = spark.createDataFrame([("p", 2, "l2", "r", "c"), ("p", 1, "l1", "r", "a & b")], "page_id string, pos int, id string, region string, text string")
    assert K.layout_xml(x).first()["xml"].index("&amp;") < K.layout_xml(x).first()["xml"].index("l2")


def test_intervals_against_loops(spark):
    pts = [("a", i * 7 % 300) for i in range(60)] + [("b", 5)]
    spans = [("a", i * 11, i * 11 + (i * 37) % 150, i) for i in range(25)] + [("a", 5, 5, 99), ("a", None, 7, 98)]
    p, s = spark.createDataFrame(pts, "k string, at int"), spark.createDataFrame(spans, "k string, lo int, hi int, no int")
    got = sorted((r["k"], r["at"], r["no"]) for r in I.containing(p, s, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((k, x, n) for k, x in pts for j, lo, hi, n in spans if j == k and lo is not None and lo <= x < hi)
    assert I.containing(p, s, ["k"], "at", "lo", "hi", keep=True).where("k = 'b'").count() == 1
    e = s.where("lo is not null").select("k", "lo", "hi", F.col("no").alias("id"))
    got = sorted((r["id_a"], r["id_b"]) for r in I.overlapping(e, e, ["k"]).collect())
    ok = [x for x in spans if x[1] is not None and x[2] > x[1]]
    assert got == sorted((x[3], y[3]) for x in ok for y in ok if x[1] < y[2] and y[1] < x[2])


def test_match_lines(spark):
    s = "page_id string, id string, box array<double>, text string"
    g = spark.createDataFrame([("p", "g1", [0.0, 0.0, 10.0, 10.0], "x"), ("p", "g2", None, "hello world"), ("q", "g3", None, "z")], s)
    r = spark.createDataFrame([("p", "r1", [0.0, 0.0, 10.0, 9.0], "y"), ("p", "r2", None, "hello word")], s)
    assert {(x["gold"], x["pred"]) for x in I.match_lines(g, r).collect()} == {("g1", "r1"), ("g2", "r2")}


def test_values(spark):
    def one(value, f, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]

    assert one("pp. 45-٤٢", V.page_range) == [42, 45] and one("x", V.page_range) is None
    assert one("071,072", V.issue_number) == "71-72" and one("000", V.issue_number) == "0"
    assert one(1400, lambda c: V.calendar_of(F.lit(""), c), "int") == "hijri"
    assert one(1400, lambda c: V.year_agrees(c, F.lit(1980)), "int") and not one(1985, lambda c: V.year_agrees(c, F.lit(1984)), "int")
    assert tuple(one("ISSN 0378-5955", V.issn_clean)) == ("0378-5955", True) and one("12", V.issn_clean) is None
    assert one("Ali, Omar", V.display_name) == "Omar Ali" and one("أ.د. عمر علي", V.strip_titles) == "عمر علي" and one("Dr. Ann Lee", V.strip_titles) == "Ann Lee"
    assert tuple(one("X, 1889-1973", V.life_years)) == (1889, 1973)
    assert one("Vol. ٦", V.clean_label) == "٦" and one("http://a.b/\nc", V.join_address) == "http://a.b/c"
    assert str(one("3 March 1999", V.parse_date)) == "1999-03-03" and one("soon", V.parse_date) is None
    assert tuple(one("1110-000-001-002", V.id_split)) == ("1110", 0, "001", 2) and one("x", V.id_split) is None
    assert one("libr-", lambda c: V.line_end_join(c, F.lit("ary"))) == "library" and one("libr-", lambda c: V.line_end_join(c, F.lit("Ary"))) is None
    assert [p["level"] for p in one("قسم التاريخ، جامعة فاس، Fes", V.affiliation_pieces)] == ["department", "organisation", "other"]
    assert one(None, lambda c: V.total_variation(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("b"), F.lit(3)))) == 1.0
