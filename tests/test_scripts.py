import datetime

import pytest

from quire.plans import registry

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("scripts"))
    texts = ["كتاب المكتبة الكبيرة", "كِتاب، المكتبة الكبيرة.", "كتاب المكتبة الصغيرة", "Prêt à l’été", "Prat a l'ata", "گل", "كل", "…", None]
    docs = [(i, x, "ara" if i < 3 else "fre", "7-1-1-1") for i, x in enumerate(texts)]
    put = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{n}.parquet")
    put("documents", docs + [(20 + i, "déjà vu", "fre", None) for i in range(5)], "doc_id long, text string, lang string, stem string")
    put("words", [("Été",), ("été",), ("مكتبة",), ("مَكتبة",)], "text string")
    put("articles", [("7-1-1-1", "i", "المكتبة الكبيرة"), ("7-1-1-2", "i", "المكتبة الصغيرة"), ("7-1-1-3", "i", "...")], "stem string, issue_id string, title string")
    put("eval_items", [(1, "في المكتبة الكبيرة")], "item_id long, text string")
    put("blocks", [(1, "7-1-1-1", "b", "كتاب", DAY), (2, "7-1-1-1", "b", "كتب", DAY)], "block_pk long, stem string, block_id string, text string, loaded timestamp")
    return d


def rows(spark, folder, name):
    return sorted(tuple(x) for x in registry.queries()[name](spark, folder).collect())


def test_all_scripts(spark, folder):
    # Texts without a letter A-Z count, and differences outside of A-Z part texts.
    assert sorted(x[1:] for x in rows(spark, folder, "exact_duplicates")) == [(0, 2), (20, 5)]
    assert [x[:3] for x in rows(spark, folder, "folded_token_counts")] == [("ara", 3, 9), ("fre", 11, 4 + 4 + 1 + 1 + 10)]
    assert rows(spark, folder, "word_list_learning") == [("été", 2), ("مكتبه", 2)]
    assert rows(spark, folder, "lexicon_doc_frequency") == [("déjà", 5), ("vu", 5)]
    assert rows(spark, folder, "quotation_seeds") == [(1, 2, 2)]
    assert rows(spark, folder, "same_title_candidates") == [("7-1-1-1", "7-1-1-2", 0.5)]
    assert rows(spark, folder, "title_inside_text") == [("7-1-1-1", 0), ("7-1-1-1", 1), ("7-1-1-2", 2)]
    assert rows(spark, folder, "cer_by_journal") == [("7", 1, 1, 4, 0.25)]
