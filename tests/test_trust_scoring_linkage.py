import pytest
from pyspark.sql import functions as F

from quire.functions.kernels import ratio
from quire.operators import linkage as L
from quire.operators import scoring as S
from quire.operators import trust as Q


def test_words(spark):
    w = spark.createDataFrame([("s", 1, "كتاب", 0.7, 10.0, False), ("s", 2, ".", 0.9, 2.0, False), ("s", 3, "abc", 0.9, 10.0, True), ("s", 4, "پل", None, 10.0, False), ("s", 5, "كتاب", 0.4, None, False)], "stem string, n int, text string, conf double, height double, marked boolean")
    r = Q.reasons(Q.signals(w))
    assert {x["n"]: x["why"] for x in r.collect()} == {1: ["conf"], 2: ["speck", "ornament"], 3: ["latin"], 4: ["persian"], 5: ["conf"]}
    lex = spark.createDataFrame([("كتاب", 9)], "word string, docs int")
    assert {x["n"]: x["why"] for x in Q.refine(r, lex, "text").collect()}[1] == [] and {x["n"]: x["why"] for x in Q.refine(r, lex, "text").collect()}[5] == ["conf"]
    p = Q.block_profile(w, "stem")
    assert tuple(p.select("n", "mid", "quarter", "tenth").first()) == (4, 0.9, 0.7, 0.4)
    assert {x["n"]: x["why"] for x in Q.in_region(r.withColumn("marked", F.lit(True)), p, "stem").collect()} == {1: [], 2: ["speck", "ornament"], 3: ["latin"], 4: ["persian"], 5: ["conf"]}
    m = Q.marks(r.withColumn("verified", F.col("n") == 1).withColumn("corrected", F.lit(False)))
    assert {(x["mark"], x["reason"]): x["n"] for x in Q.summary(m, ["stem"]).collect()}[("flagged", None)] == 4
    h = spark.createDataFrame([("b", "x", 0.9)] * 10 + [("c", "كِتَاب", 0.0)], "k string, text string, hand double")
    assert {(x["k"], x["mark"]) for x in Q.region_marks(h, "k").collect()} == {("b", "handwritten"), ("c", "vowelled")}


def test_trust_pages_tables(spark):
    assert spark.range(1).select(Q.trust(F.lit(True), F.lit(5), F.lit(True), F.lit(True))).first()[0] == pytest.approx(0.6 * 0.9**3 * 0.8 * 0.7)
    p = spark.createDataFrame([("s", 1, 11), ("s", 2, 72), ("s", 3, 13), ("s", 4, None), ("s", 5, 15), ("t", 1, 4), ("t", 2, 9)], "stem string, page int, folio int")
    got = {(x["stem"], x["page"]): (x["fixed"], x["offset"]) for x in Q.page_numbers(p).collect()}
    assert got[("s", 2)] == (12, 10) and got[("s", 4)] == (None, 10) and got[("t", 2)] == (9, None)
    c = spark.createDataFrame([("a", i, n) for i, n in enumerate([1, 2, 2, 9])], "g string, p int, n int")
    assert [x["p"] for x in Q.outliers(c, "g", "n").collect()] == [3]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(x) for x in Q.unpaired(a, b, ["k"]).collect()} == {(1, "call without note"), (3, "note without call")}
    t = spark.createDataFrame([("t", 0, 0, 1, 2), ("t", 1, 0, 1, 1), ("u", 0, 0, 2, 1), ("u", 0, 1, 1, 1), ("u", 1, 1, 1, 1)], "table_id string, row int, col int, rowspan int, colspan int")
    assert [tuple(x) for x in Q.ragged_tables(t).collect()] == [("t", [1, 2])]


def test_scores(spark):
    s = "page_id string, pos int, text string"
    g = spark.createDataFrame([("p", 1, "first line"), ("p", 2, "second one"), ("p", 3, "third"), ("q", 1, "lost")], s)
    r = spark.createDataFrame([("p", 1, "second one"), ("p", 2, "first line"), ("p", 3, "first line"), ("p", 4, "zzzzzzzzzz")], s)
    x = {y["page_id"]: y for y in S.score_pages(g, r).collect()}
    assert (x["p"]["dropped"], x["p"]["repeated"], x["p"]["invented"], x["p"]["pairs_right"], x["p"]["pairs"]) == (1, 1, 1, 0, 1) and x["q"]["char_errors"] == 4
    same = S.micro(S.score_pages(g, g)).first()
    assert same["cer"] == 0 and same["order"] == 1
    k = S.score_pages(g, g).withColumn("kinds", F.array(F.lit("a"), F.lit("b")))
    assert {y["group"]: y["pages"] for y in S.micro_by_kinds(k, "kinds", "page_id").collect()} == {"all": 2, "page_id:p": 1, "page_id:q": 1, "kind:a": 2, "kind:b": 2}
    w = spark.range(1).select(S.wilson(F.lit(5), F.lit(10)).alias("w")).first()["w"]
    assert w["lo"] == pytest.approx(0.2366, abs=1e-3) and w["hi"] == pytest.approx(0.7634, abs=1e-3)
    d = spark.createDataFrame([(i, float(i % 3), 10.0) for i in range(60)], "k int, e double, u double")
    b = S.poisson_bootstrap(d, "e", "u", "k").first()
    assert 0.06 < b["lo"] < 0.1 < b["hi"] < 0.14
    m = S.weighted_measure(d, F.col("e") > 0, F.col("e") > 1, F.lit(2.0)).first()
    assert (m["flagged"], m["caught"], m["left"]) == (80.0, 40.0, 0.0)


def test_links(spark):
    c = spark.createDataFrame([(1, "The Library of the Old Treaty", "ali", 1950), (2, "Unknown matters entirely", None, None)], "cite_id int, title string, author string, year int")
    v = spark.createDataFrame([(10, "The library of the old treaty", "ali", 1950), (11, "The library of the new treaty", "omar", 1950), (12, "Pottery", None, None)], "work_id int, title string, author string, year int")
    p = L.candidates(c, v)
    assert {tuple(x) for x in p.collect()} == {(1, 10), (1, 11)}
    fold = lambda d: d.select(F.lower("title").alias("title"))
    alike = {(x["title"], x["work_title"]): round(x["title_ratio"], 4) for x in L.alike_titles(fold(c), fold(v)).collect()}
    t = ratio("the library of the old treaty", "the library of the new treaty")
    assert alike == {("the library of the old treaty", "the library of the old treaty"): 1.0, ("the library of the old treaty", "the library of the new treaty"): round(t, 4)}
    s = spark.createDataFrame([(1, 10, 1.0, "ali", "ali", 1950, 1950), (1, 11, t, "ali", "omar", 1950, 1950), (2, 12, 0.9, None, None, None, None)], "cite_id int, work_id int, r double, a1 string, a2 string, y1 int, y2 int")
    b = {(x["cite_id"], x["work_id"]): (round(x["score"], 4), x["best"]) for x in L.best(s.withColumn("score", L.score("r", "a1", "a2", "y1", "y2"))).collect()}
    assert b == {(1, 10): (1.0, 1), (1, 11): (round(0.6 * t + 0.15, 4), 0), (2, 12): (0.54, 1)}
    assert L.candidates(c.limit(0), v).count() == 0 and L.candidates(c, v.limit(0)).count() == 0
    j = lambda sure, a, h: spark.range(1).select(L.judged(F.lit(sure), F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, h)).cast("array<string>"))).first()[0]
    assert (j(True, ["a"], ["a"]), j(False, ["a"], ["b"]), j(True, ["a"], ["b"]), j(False, [], ["b"])) == ("accepted", "rejected", "candidate", "candidate")


def test_quotations(spark):
    ref = "in the beginning was the word and the word was good".split()
    doc = "he said in the beginning was the wrd and the word was good as we know".split()
    d = spark.createDataFrame([(1, doc), (2, "the word was never".split()), (3, [])], "doc_id int, words array<string>")
    got = L.quotations(d, spark.createDataFrame([(7, ref)], "ref_id int, words array<string>")).collect()
    assert [(x["doc_id"], x["first"], x["last"]) for x in got] == [(1, 2, 12)]
