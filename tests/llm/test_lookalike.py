import pytest

from quire.llm import lookalike as L

AR, PE = "وقد بين الباحث أن المدرسة في القرية", "از میان این مدرسه که در شهر پیدا شده است"
CASES = [
    ("plain", "es", False), ("ｐlain", "es", True), ("pl​ain", "es", True), ("plain ", "es", True), ("é", "es", True), ("é", "es", False), ("ﬁn", "es", True),
    ("рlain", "es", True), ("книга", "es", False), ("λόγος", "es", False), ("α", "es", False), ("l‌a", "es", True), ("el", "es", False), ("на", "es", False),
    ("فی", "ar", True), ("في", "ar", False), ("كتاب", "pe", True), ("کتاب", "pe", False), ("می‌کند", "pe", False), ("ﻛﺘﺎب", "ar", True), ("كِتاب", "ar", False),
    ("١٩٣٠", "ar", False), ("۱۹۳۰", "ar", True), ("۱۹۳۰", "pe", False), ("", "es", False), (None, "es", False),
]


def test_words(spark):
    rows, want, pk = [], set(), 0
    for g, (text, lang, odd) in enumerate(CASES):
        around = {"es": "la nota en el mercado", "ar": AR, "pe": PE}[lang].split()
        for i, w in enumerate(around[:4] + [text] + around[4:]):
            pk += 1
            rows.append((pk, g, i, w, "x"))
            if i == 4 and odd:
                want.add(pk)
    df = spark.createDataFrame(rows, "word_pk long, block_pk long, ord int, text string, skel string")
    got = {r[0] for r in L.variant_words(df, "word_pk", "block_pk", "ord").collect()}
    assert got == want
    assert L.variant_words(df.limit(0), "word_pk", "block_pk", "ord").count() == 0


def test_lookalikes_only(spark):
    # Cyrillic letters that make up a word: one if the Latin word is common, none otherwise.
    rows = [(i, 0, i, "y") for i in range(9)] + [(20, 0, 20, "у"), (21, 0, 21, "сор")]
    df = spark.createDataFrame(rows, "word_pk long, block_pk long, ord int, text string")
    assert [r[0] for r in L.variant_words(df, "word_pk", "block_pk", "ord").collect()] == [20]


def test_lines(spark):
    df = spark.createDataFrame([(1, "Institut für Sprachen, Kiel"), (2, "Institut für Sprachen"), (3, "قسم التاريخ، جامعة"), (4, "قسم التاریخ، جامعة"), (5, None), (6, ""), (7, "a b")], "aff_id long, printed string")
    assert {r[0] for r in L.variant_lines(df, "aff_id", "printed").collect()} == {4, 7}


@pytest.mark.parametrize(("a", "b"), [("раrt", "part"), ("ｐart", "part"), ("p​art", "part"), ("ﬁn", "fin"), ("تاریخ", "تاريخ")])
def test_equal_skeletons(a, b):
    assert L.skeleton(a) == L.skeleton(b)


def test_plain_form():
    assert L.plain_form("ｐаrt ", None) == "part " and L.plain_form("كه", "per") == "که" and L.plain_form("می‌کند", "per") == "می‌کند"
    assert L.fold_word("É,T") == "et"
