import zipfile

from pyspark.sql import functions as F

from quire.operators import intervals as I
from quire.operators import trust as T
from quire.operators import versions as V
from quire.sources import readings as R
from quire.sources import sinks as S


def test_patches(spark):
    rows = [("d", "1", "retry", 1, ["a"]), ("d", "2", "person", 5, ["a", "b"]), ("d", "3", "judge", 2, ["b"]), ("d", "4", "judge", 3, ["c"]), ("d", "5", "judge", 4, ["c"]), ("d", "6", "robot", 1, None), ("e", "7", "retry", 1, ["a"]), ("d", "8", "retry", 9, [])]
    got = {x["patch_id"]: (x["outcome"], x["blocked_by"]) for x in V.patch_outcomes(spark.createDataFrame(rows, "doc string, patch_id string, by string, created int, targets array<string>")).collect()}
    assert got == {"1": ("blocked", "2"), "2": ("applied", None), "3": ("blocked", "2"), "4": ("applied", None), "5": ("applied", None), "6": ("applied", None), "7": ("applied", None), "8": ("applied", None)}


def test_word_changes(spark):
    a = spark.createDataFrame([(1, "the old old cat"), (2, "same"), (3, None), (4, "gone")], "k int, text string")
    b = spark.createDataFrame([(1, "the old cat sat"), (2, "same"), (3, "new"), (5, "more")], "k int, text string")
    got = {x["k"]: (x["gone"], x["added"]) for x in V.word_changes(a, b, ["k"], "text").collect()}
    assert got == {1: (["old"], ["sat"]), 3: ([], ["new"]), 4: (["gone"], []), 5: ([], ["more"])}
    assert V.word_changes(a, b, ["k"], "text", a.where("k = 1")).count() == 1


def test_crosswalk(spark):
    cols = "page_id string, id string, x double, y double, w double, h double"
    s = spark.createDataFrame([("p", "s1", 100.0, 100.0, 50.0, 20.0), ("p", "s2", 200.0, 100.0, 150.0, 20.0), ("p", "s3", 900.0, 900.0, 5.0, 5.0), ("q", "s4", 100.0, 100.0, 50.0, 20.0)], cols)
    w = spark.createDataFrame([("p", "w1", 101.0, 99.0, 51.0, 21.0), ("p", "w2", 200.0, 100.0, 60.0, 20.0), ("p", "w3", 270.0, 100.0, 70.0, 20.0), ("p", "w4", 700.0, 100.0, 70.0, 20.0)], cols)
    walk = I.crosswalk(s, w)
    assert {tuple(x) for x in walk.collect()} == {("p", "s1", "w1", "box"), ("p", "s2", "w2", "centre"), ("p", "s2", "w3", "centre")}
    lines = I.line_map(walk, spark.createDataFrame([("p", "s1", "L"), ("p", "s2", "L")], "page_id string, string_id string, line string"), spark.createDataFrame([("p", "w1", 7), ("p", "w2", 8), ("p", "w3", 8)], "page_id string, word_id string, word_line int"))
    assert [tuple(x) for x in lines.collect()] == [("p", "L", 8, 0.666667)]
    t = spark.createDataFrame([("p", "t", 0.0, 0.0, 100.0, 100.0)], cols)
    c = spark.createDataFrame([("p", "t", 0.0, 0.0, 100.0, 50.0)], "page_id string, table_id string, x double, y double, w double, h double")
    li = spark.createDataFrame([("p", "in", 10.0, 10.0, 10.0, 10.0), ("p", "lost", 10.0, 70.0, 10.0, 10.0), ("p", "out", 300.0, 10.0, 10.0, 10.0)], cols)
    assert [x["line_id"] for x in I.lost_in_tables(li, t, c).collect()] == ["lost"]


def test_notes(spark):
    m = spark.createDataFrame([("d", 1, "1", 5, "m1"), ("d", 2, "1", 3, "m2"), ("d", 2, "2", 9, "m3"), ("d", 3, "9", 1, "m4")], "doc string, page int, label string, pos int, mark_id string")
    n = spark.createDataFrame([("d", 1, "1", 90, "n1"), ("d", 2, "1", 90, "n2"), ("d", 8, "2", 1, "n3")], "doc string, page int, label string, pos int, note_id string")
    assert {(x["mark_id"], x["note_id"], x["where"]) for x in I.notes_matched(m, n).collect()} == {("m1", "n1", "page"), ("m2", "n2", "page"), ("m3", "n3", "end")}


def test_trust(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(T.mention_trust(F.lit(0.8), F.lit(True), F.lit("high"))) == 0.476 and one(T.mention_trust(F.lit(0.8), F.lit(False), F.lit(None))) == 0.8
    r = lambda c, p, d, t: one(T.routed(F.lit(c), F.lit(p), F.lit(d), F.lit(t)))
    assert (r(0.95, True, False, 0), r(0.95, False, False, 0), r(0.5, True, False, 2), r(0.99, True, True, 0)) == ("auto", "retry", "human", "dismissed")
    w = spark.createDataFrame([(1, "abcd", 0.5, True, 0.9), (1, "ab", 1.5, False, None), (1, "—", 0.0, False, 0.1)], "b int, text string, ink double, known boolean, conf double")
    assert [tuple(x) for x in T.noise_evidence(w, ["b"]).collect()] == [(1, 2, 0.333333, 0.333333, 0.9)]
    f = spark.createDataFrame([("a", i, i in (3, 4)) for i in range(10)] + [("b", i, i > 4) for i in range(10)] + [("c", i, i > 8) for i in range(10)] + [("d", 1, False)], "doc string, pos int, other boolean")
    assert {x["doc"]: x["flag"] for x in T.foreign_share(f, "doc", "other").collect()} == {"a": "inner", "b": "most", "c": "edge"}
    lex = spark.createDataFrame([("كتاب",), ("مكتب",)], "word string")
    got = {x["word"]: x["real"] for x in T.real_words(spark.createDataFrame([("والكتاب",), ("كتابها",), ("xyz",), (None,)], "word string"), lex).collect()}
    assert got == {"والكتاب": True, "كتابها": True, "xyz": False, None: False}


def test_article_xml(spark):
    import xml.etree.ElementTree as E

    a = spark.createDataFrame([("7-1", 'A & "B"', "ara", 1999, [("علي", "محمد")], [("b1", "title", "H<1>"), ("b2", None, "text & more"), ("b3", "footnote", "n"), ("b4", "pageNumber", "3")]), ("7-2", None, None, None, None, [])], "stem string, title string, language string, pub_year int, authors array<struct<family string, given string>>, blocks array<struct<id string, role string, text string>>")
    xml = {x["stem"]: E.fromstring(x["xml"]) for x in S.article_xml(a).collect()}
    assert xml["7-1"].find(".//article-title").text == 'A & "B"' and xml["7-1"].find(".//surname").text == "علي" and xml["7-1"].find(".//sec/title").text == "H<1>"
    assert [p.get("id") for p in xml["7-1"].findall(".//body//p")] == ["b2"] and xml["7-1"].find(".//fn").get("id") == "b3" and xml["7-2"].find(".//article-title") is None


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("p2.xhtml", "<html><head><title>t</title></head><body><p>Two &amp; three</p><script>x</script></body></html>")
        z.writestr("p1.xhtml", "<p>One</p>")
        z.writestr("style.css", "p {}")
    (tmp_path / "b.epub").write_bytes(b"no zip")
    got = sorted((x["path"][-6:], x["part"], x["text"], x["problem"]) for x in R.read_books(spark, str(tmp_path)).collect())
    assert got == [("a.epub", 0, "One", None), ("a.epub", 1, "Two & three", None), ("b.epub", None, None, "not a book")]
    k = R.read_listing_kinds(spark.createDataFrame([("x/7-1.json",), ("y/7-1.alto.xml",), ("7-2.json",)], "key string")).collect()
    assert {x["id"]: x["kinds"] for x in k} == {"7-1": ["alto.xml", "json"], "7-2": ["json"]}
    pages = spark.createDataFrame([("ok", ["a"], [("a", [0.0, 0.0, 1.0, 1.0])]), ("bad", ["a"], [("a", [0.0, 0.0, 1.0]), ("a", None)]), ("none", None, [])], "page_id string, order array<string>, lines array<struct<id string, box array<double>>>")
    assert {tuple(x) for x in R.checked_gold(pages).collect()} == {("bad", "line twice"), ("bad", "box"), ("bad", "order"), ("none", "order")}
