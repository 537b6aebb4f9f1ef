import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import edit, kernels
from quire.functions import text as X


def plain_distance(a, b):
    if not a or not b:
        return len(a) or len(b)
    return min(plain_distance(a[1:], b) + 1, plain_distance(a, b[1:]) + 1, plain_distance(a[1:], b[1:]) + (a[0] != b[0]))


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_distance(a, b):
    d = plain_distance(a, b)
    assert edit.distance(a, b) == d
    assert (edit.distance(a, b, 1) <= 1) == (d <= 1)
    m, n = edit.codes([a, b, "abcab"])
    assert edit.distances(m[:1], n[:1], m[1:2], n[1:2])[0] == d


def test_swapped():
    assert edit.swapped("abcd", "acbd") and not edit.swapped("abcd", "abdd") and not edit.swapped("abc", "abcd")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), max_size=8))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert kernels.lcs_length(a, b) == t[-1][-1]


def test_kernels():
    assert kernels.token_distance("a b c".split(), "a x c d".split()) == 2
    assert kernels.concordance([1, 3, 2]) == (2, 3)
    assert kernels.multiset_balance(list("aab"), list("abbc")) == {"missing": 1, "duplicated": 1, "extra": 1}
    assert kernels.greedy_pairs(["abcd", "xyz"], ["abce", "zzz"], 0.6) == [("abcd", "abce", 0.75)]
    assert kernels.iou((0, 0, 2, 2), (1, 1, 3, 3)) == pytest.approx(1 / 7) and kernels.iou((0, 0, 1, 1), (2, 2, 3, 3)) == 0
    g = "<table><tr><td>a</td><td>b</td></tr></table>"
    assert kernels.teds(g, g) == 1 and kernels.teds(g, None) == 0 and kernels.teds("no", g) is None
    assert kernels.teds(g, g.replace("<td>b</td>", "")) == pytest.approx(0.75)
    score, at = kernels.align("x the cat sat".split(), "a the cat sat b".split())
    assert score == 6 and at == [(1, 1), (2, 2), (3, 3)]
    lo, hi = kernels.bootstrap_interval([1, 2, 3], [10, 10, 10])
    assert 0.1 <= lo <= 0.2 <= hi <= 0.3


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("profile", "text", "want"),
    [
        ("match", "الكِتـاب، 12", "الكتاب12"),
        ("faithful", "a  b c ـ", "a b c"),
        ("folded", "أَحمد، Foo-Bar ٣", "احمد foo bar 3"),
        ("search", "می‌کند", "ميكند"),
        ("db_fold", "‏École  À", "école à"),
        ("latin_key", "École, À la", "ecole a la"),
        ("letters", "a1-b2", "ab"),
        ("scripture_skeleton", "بتث", "ببب"),
    ],
)
def test_profiles(spark, profile, text, want):
    assert one(spark, text, X.normalize(F.col("x"), profile)) == want


def test_profiles_keep_null(spark):
    assert all(one(spark, None, X.normalize(F.col("x"), p)) is None for p in X.PROFILES)


def test_expressions(spark):
    assert one(spark, "والكتاب", X.stem(F.col("x"))) == "كتاب"
    assert one(spark, "1234567", X.issn_check(F.col("x"))) == "9"
    assert one(spark, "in ١٩٨٤ م", X.year_of(F.col("x"))) == 1984
    assert one(spark, "<p>a<script>x()</script> b&amp;c</p>", X.visible_text(F.col("x"))) == "a b&c"
    assert one(spark, "---\na: 1\n---\n# T\n*b* [c](d)[^1]", X.plain_markdown(F.col("x"))) == "T\nb c"
    assert one(spark, "Title / :", X.isbd_trim(F.col("x"))) == "Title"
    assert one(spark, "a b c", X.ngrams(F.split("x", " "), 2)) == ["a b", "b c"] and one(spark, "a", X.ngrams(F.split("x", " "), 2)) == []
    assert one(spark, "go on go on go on go on x", F.col("x").rlike(X.LOOP)) and not one(spark, "go on go on go on x", F.col("x").rlike(X.LOOP))
    assert len(one(spark, "a", X.public_id("w", "x"))) == 10


def test_search_against_loops(spark):
    random.seed(1)
    docs = [(i, random.choices("a b c d e".split(), k=random.randint(1, 9))) for i in range(40)]
    df = spark.createDataFrame(docs, "id int, w array<string>")
    assert {r[0] for r in X.and_search(df, "id", "w", ["a", "b"]).collect()} == {i for i, w in docs if {"a", "b"} <= set(w)}
    got = X.bm25(df, "id", "w", ["a"], 5).collect()
    assert len(got) == 5 and [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)
