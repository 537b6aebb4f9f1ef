import pytest
from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.functions import names as N
from quire.functions import text as X


def one(spark, f, *args):
    r = spark.range(1).select(f(*[F.lit(a) if not isinstance(a, list) else F.array(*map(F.lit, a)) for a in args]).alias("x")).first()["x"]
    return r.asDict() if hasattr(r, "asDict") else r


def test_life_and_parts(spark):
    life = one(spark, N.life_note, "محمود، زكي نجيب، ت. 1414 هـ")
    assert life == {"name": "محمود، زكي نجيب", "born": None, "died": 1993, "died_hijri": 1414}
    assert one(spark, N.life_note, "Smith, John, 1901-1980")["born"] == 1901 and one(spark, N.life_note, "Smith, John")["died"] is None
    parts = lambda n: {k: v for k, v in one(spark, N.name_parts, n).items() if v}
    assert parts("د. أبو الحسن علي بن محمد الماوردي") == {"ism": "علي", "nasab": "بن محمد", "nisba": "الماوردي", "kunya": "أبو الحسن", "family": "الماوردي"}
    assert parts("صلاح الدين عبد الله المنجد") == {"ism": "عبد الله", "laqab": "صلاح الدين", "family": "المنجد"}
    assert parts("ابن خلدون") == {"shuhra": "ابن خلدون"} and parts("Smith, John") == {"ism": "John", "family": "Smith"} and parts("Plato") == {"ism": "Plato"}
    assert parts("") == {} and not any((one(spark, N.name_parts, None) or {}).values())


def test_name_keys(spark):
    assert one(spark, N.name_key, "د. أحمد علي") == one(spark, N.name_key, "احمد على") == "احمدعلي"
    assert one(spark, N.name_key, "ROLDÁN, Juan") == "roldanjuan"
    assert one(spark, N.heading_key, "السيد، عبدالحليم محمود، ت. 1427 هـ") == "عبدالحليممحمودالسيد"
    assert one(spark, N.title_key, "كتاب النبي ﷺ (2)") == one(spark, N.title_key, "كتاب النبي صلى الله عليه وسلم")
    forms = [(x["form"], x["least"]) for x in one(spark, N.name_variants, "بالي، فيصل محمد")]
    assert forms == [("فيصل محمد بالي", 0.8), ("بالي فيصل محمد", 0.8), ("فيصل بالي", 0.9)]
    assert one(spark, N.given_agrees, "Juan", ["J.", "Roldan"]) and not one(spark, N.given_agrees, "Juan", ["P.", "Roldan"]) and not one(spark, N.given_agrees, "", ["x"])
    assert one(spark, N.sound_classes, "محمد سليم") == one(spark, N.sound_classes, "Mohammad Salim") == "MDSLM"
    assert one(spark, N.strip_role, "مدرس في قسم التاريخ") == "قسم التاريخ" and one(spark, N.strip_role, "Lecturer at Kiel University") == "Kiel University"
    assert one(spark, N.same_title, "the old library", "the old library of kiel", 0.7) and not one(spark, N.same_title, "a", "b", 0.9) and not one(spark, N.same_title, "", "", 1.0)


def test_letters(spark):
    assert one(spark, X.arabic_letters, "کتابی فی") == "كتابى فى" and one(spark, X.arabic_letters, "یوم") == "يوم" and one(spark, X.arabic_letters, "پیک") == "پیک"
    assert one(spark, X.arabic_digits, "سنة ۱۹۳۰") == "سنة ١٩٣٠" and one(spark, X.arabic_digits, "گل ۱۹") == "گل ۱۹"
    assert one(spark, X.joined_runs, "الحكم") == ["ا", "لحكم"] and one(spark, X.joined_runs, "العربى،") == ["ا", "لعر", "بى", "،"] and one(spark, X.joined_runs, "126/4") == ["126/4"] and one(spark, X.joined_runs, "ماء") == ["ما", "ء"]
    assert one(spark, X.graphemes, "éa\r\n") == ["é", "a", "\r\n"] and one(spark, X.graphemes, "") == []
    assert one(spark, X.attached_punctuation, "معجمية : نص . ثم") == ["معجمية :", "نص .", "ثم"]
    assert one(spark, X.latex_tokens, r"$\frac{x}{12} \left( y \right)$") == ["\\frac", "x", "{", "1", "2", "}", "(", "y", ")"]
    assert one(spark, X.is_real, "a") and not one(spark, X.is_real, "—") and one(spark, X.same_reading, "كِتاب,", "كتاب") and one(spark, X.same_reading, "(١)", "1") and not one(spark, X.same_reading, "—", ".")
    assert (one(spark, X.script_of, "كتاب a"), one(spark, X.script_of, "abc"), one(spark, X.script_of, "12")) == ("Arab", "Latn", None)
    assert one(spark, X.year_in_range, "no. 1234, 1987") == 1987 and one(spark, X.year_in_range, "12345") is None and one(spark, X.year_in_range, "٢٠٠١") == 2001
    assert one(spark, X.month_numbers, "يونيو / جمادى الأولى") == {"gregorian": 6, "hijri": 5} and one(spark, X.month_numbers, "ربيع الآخر") == {"gregorian": None, "hijri": 4}
    assert [tuple(x) for x in one(spark, X.history_dates, "Received 3 May 1999; accepted: June 2000.")] == [("received", "3 May 1999"), ("accepted", "June 2000")]


def test_kernels():
    assert K.equation_similarity(["x", "+"], ["x", "-"]) == (0.5, False) and K.equation_similarity([], []) == (1.0, True)
    a, b = "one two three four".split(), "five six seven eight".split()
    assert K.reading_order(a + b, b + a, [a, b]) == {"expected": 8, "in_order": 4, "share": 0.5, "placed": 2, "inversions": 1}
    assert K.reading_order([], [])["share"] == 1.0
    assert K.best_span("in the olde library of kiel".split(), "the old library")[:2] == (1, 3) and K.best_span(["x"], "library") is None and K.best_span([], "a") is None
    fold = lambda c: "" if c == "ـ" else c.lower()
    assert K.folded_find("xLiـbRary", "LIBR", fold) == 1 and K.folded_find("ab ab", "AB", fold, 1) == 3 and K.folded_find("ab", "c", fold) == -1 and K.folded_find("", "c", fold) == -1
    assert K.warped_distance([1, 2, 3], [1, 1, 2, 3, 3]) == 0 and K.warped_distance([0, 0], [1, 1]) == 2 and K.warped_distance([], []) == 0
    assert [K.word_difference(*p) for p in (("قال", "قال"), ("قال", "فال"), ("وقال", "فقال"), ("كتاب", "كتب"), ("قال", "ومشى"), (None, "x"), ("x", None))] == ["same", "dots", "conjunction", "letters", "different", "extra", "missing"]


@pytest.mark.parametrize("f", [N.name_parts, N.name_key, N.heading_key, N.title_key, N.sound_classes, N.strip_role, N.life_note, N.name_variants, X.joined_runs, X.latex_tokens, X.month_numbers, X.history_dates, X.attached_punctuation, X.script_of])
def test_null_and_long(spark, f):
    rows = spark.createDataFrame([(None,), ("",), ("كتاب abc 12 " * 400,)], "c string").select(f(F.col("c")).alias("x"))
    assert rows.count() == 3 and len(rows.collect()) == 3
