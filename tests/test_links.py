from quire.plans import registry


def test_links_over_whole_tables(spark, tmp_path):
    d = str(tmp_path)
    put = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{n}.parquet")
    long = [f"w{i}" for i in range(30)]
    texts = ["قال في تاريخ المكتبة الكبيرة ثم مضى", " ".join(long), " ".join(long[:-1] + ["x"]), " ".join(long[:15] + list("abcdefghijklmno")), "one two", "One, two!", None]
    put("documents", [(i, x, "9-9-9-9") for i, x in enumerate(texts)], "doc_id long, text string, stem string")
    put("eval_items", [(7, "قال في تاريخ المكتبة الكبيرة ولم يمض")], "item_id long, text string")
    rows = [("1-1-1-1", "masters", "تاريخ المكتبة الكبيرة", "ara", 1990), ("1-1-1-2", "masters", "Unrelated pottery shards", "eng", 1990), ("2-1-1-1", "catalogue", "تاريخ المكتبة الكبيره", "ara", 1990), ("2-1-1-2", "catalogue", "The old treaty survey", "eng", 1990)]
    put("articles", rows, "stem string, source string, title string, language string, pub_year int")
    run = lambda n: sorted(tuple(x) for x in registry.queries()[n](spark, d).collect())
    # No stem is shared.
    assert run("linkage_score") == [("1-1-1-1", "2-1-1-1", 1.0, 1.0, 1)]
    assert run("title_inside_text") == [("1-1-1-1", 0), ("2-1-1-1", 0)]
    # 4 and 5 have the same words: one class.
    assert [x[:2] for x in run("near_duplicates")] == [(1, 2)]
    assert run("near_duplicate_classes") == [(0, 0, 0), (1, 1, 1), (2, 2, 1), (3, 3, 0), (4, 4, 0), (5, 4, 0)]
    assert [x[:5] for x in run("quotation_matches")] == [(0, 7, 0, 4, 5)]
