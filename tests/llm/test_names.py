import random

import pytest

from quire.functions.edit import distance
from quire.llm import names as N


@pytest.mark.parametrize("per_pivot", [1, 40, 10_000])
def test_radius_join_against_brute_force(spark, monkeypatch, per_pivot):
    monkeypatch.setattr(N, "NAMES_PER_PIVOT", per_pivot)
    r = random.Random(2)
    base = ["".join(r.choices("abcdefgh", k=r.randint(1, 8))) for _ in range(60)]
    names = set(base)
    for b in base:
        for _ in range(2):
            i = r.randrange(len(b))
            names.add(r.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + b[i + 1 : i + 2] + b[i : i + 1] + b[i + 2 :]]))
    names = sorted(n for n in names if n)
    df = spark.createDataFrame([("latin", n) for n in names] + [("other", names[0])], "script string, name string")
    got = {(x["a"], x["b"]) for x in N.radius_join(df).collect()}
    assert got == {(a, b) for a in names for b in names if a != b and distance(a, b) <= N.RADIUS}
    assert N.radius_join(df.limit(0)).count() == 0


def test_parse_org():
    for name, want in {
        "Univ. of Julilul": ("latin", "university", "julilul"), "Julilul Tech. Institute": ("latin", "institute", "julilul"), "Hohcschule zu Kagha": ("latin", "hochschule", "kagha"), "College of Teachers, Kagha": ("latin", "college", "kagha"),
        "Faculté des lettres, Université de Fazub": ("latin", "university", "fazub"), "م. بحوث كوكوموما": ("other", "centre", "كوكوموما"), "المعهد العالى في كوكوموما": ("other", "institute", "كوكوموما"),
        "قسم التاريخ كلية الاداب جامعة كوكوموما": ("other", "university", "كوكوموما"),
    }.items():
        assert N.parse_org(name) == want


def test_parse_person():
    for name, want in {
        "Dr. Yaqub, Theodore Said": ("yaqub", "theodore", "said"), "THEODORE S. YAQUB": ("yaqub", "theodore", "s"), "Yaqub T.S.": ("yaqub", "t", "s"), "T. S. Yaqub": ("yaqub", "t", "s"), "Ted Yaqub": ("yaqub", "ted", ""),
        "أ.د. الفيدوبا، عبد الله عمر": ("فيدوبا", "عبدالله", "عمر"), "أبو يعقوب ي. الفيدوبا": ("فيدوبا", "ابويعقوب", "ي"),
    }.items():
        assert N.parse_person(name)[1:] == want


def test_persons(spark):
    groups = [
        ["Theodore Said Qurata", "Qurata, Theodore Said", "Ted S. Qurata", "Qurata T.S.", "Theodore Said Quratta", "TED QURATA", "Dr Theodore Siad Qurata"],
        ["Samuel Francisco Qurata", "Sam F. Qurata", "Qurata, S. F."],
        ["Samuel Francisco Bimuyu"], ["عمر فاطمة القوموتاسو", "أبو حفص القوموتاسو", "قوموتاسو، عمر فاطمه"],
    ]
    rows, want = [], set()
    i = 0
    for g in groups * 1:
        ids = []
        for n in g:
            i += 1
            ids.append(i)
            rows.append((i, n, "x"))
        want |= {(a, b) for a in ids for b in ids if a < b}
    # Enough of the given names to be known.
    rows += [(1000 + k, f"{g} {h} Zz{c}{c}uluka", "y") for k, (g, h, c) in enumerate((g, h, c) for g, h in (("Theodore", "Said"), ("Samuel", "Francisco")) for c in "bdgkm")]
    rows += [(2000, None, None), (2001, "", ""), (2002, "...", "z")]
    df = spark.createDataFrame(rows, "draw_id long, authors string, person string")
    p = {r["draw_id"]: r["person"] for r in N.persons(df).collect()}
    got = {(a, b) for a in p for b in p if a < b < 1000 and p[a] == p[b]}
    assert got == want


def test_organisations(spark):
    names = ["University of Julilul", "Univ Julilul", "U. of Julillul", "Julilul University", "Julilul Technical Institute", "Tech. Inst. Julilul", "University of Kaghadi", "Kaghadi University", "", "  ", "of"]
    o = {r["name"]: r["org"] for r in N.organisations(spark.createDataFrame([(n, 1) for n in names], "name string, n long")).collect()}
    groups = {}
    for n, k in o.items():
        groups.setdefault(k, set()).add(n)
    assert sorted(map(len, groups.values())) == [2, 2, 4] and "" not in o


def test_many_given_names(spark):
    """No given name makes up a share of all worth the name: misspelt ones are found by their number all the same."""
    import random

    pick = random.Random(3)
    given = sorted({"".join(pick.choice("bcdfghklmnprstvz") + pick.choice("aeiou") for _ in range(5)) for _ in range(400)})
    rows = [f"{g} Fam{'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 3}{'uvwxy'[i // 100] * 3}" for i, g in enumerate(given) for _ in range(5)]
    rows += [given[7] + "q Zuluka"] + [given[7] + " Zuluka"] + ["Jim Bokaruna", "James Bokaruna", "Dick Bokaruna"]
    p = [r["person"] for r in N.persons(spark.createDataFrame(list(enumerate(rows)), "draw_id long, authors string")).orderBy("draw_id").collect()]
    assert p[-5] == p[-4] and p[-3] == p[-2] != p[-1]
    # A rare name near a name that is hardly more frequent stays what it is.
    n = spark.createDataFrame([("latin", "hannah", 3), ("latin", "hannas", 4), ("latin", "hannan", 15)], "script string, g string, n long")
    assert {r["g"]: r["full"] for r in N.given_names(n).collect()} == {"hannah": "hannan", "hannas": "hannas", "hannan": "hannan"}
