import random

from quire.operators import linkage as L
from quire.plans import registry


def shuffles(df):
    """The plan's exchanges."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def runs(doc, ref, least=5, share=0.75):
    """The same from all places of both texts."""
    seeds = [(i, i - j) for i in range(len(doc) - 1) for j in range(len(ref) - 1) if doc[i : i + 2] == ref[j : j + 2]]
    out = set()
    for half in (0, 2):
        for band in {(d + half) // 4 for _, d in seeds}:
            at = sorted({i for i, d in seeds if (d + half) // 4 == band})
            parts = [[at[0]]]
            for i in at[1:]:
                if i - parts[-1][-1] > 4:
                    parts.append([])
                parts[-1].append(i)
            for p in parts:
                matched, span = len({i + k for i in p for k in (0, 1)}), p[-1] - p[0] + 2
                if matched >= least and matched >= share * span:
                    out.add((p[0], p[-1] + 1, matched, span))
    return out


def test_quotations_meet_in_one_pass(spark, monkeypatch):
    # More blocks of texts and of seeds than one.
    monkeypatch.setattr(L, "REF_WORDS", 50), monkeypatch.setattr(L, "SEEDS", 100), monkeypatch.setattr(L, "CELLS", 30)
    rnd = random.Random(3)
    texts = lambda n, most: [(i, [rnd.choice("abcde") for _ in range(rnd.randint(0, most))]) for i in range(n)]
    docs, refs = texts(25, 50), texts(8, 30)
    got = L.quotations(spark.createDataFrame([*docs, (99, None)], "doc_id long, words array<string>"), spark.createDataFrame(refs, "ref_id string, words array<string>"))
    want = {(d, str(r), *x) for d, dw in docs for r, rw in refs for x in runs(dw, rw)}
    assert len(want) > 100 and sorted(tuple(x) for x in got.collect()) == sorted(want)
    # Seeds outnumber the documents' words: they must not be shuffled.
    assert shuffles(got) == 0


def test_quotations_of_repeated_and_missing_ids(spark, tmp_path):
    put = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}.parquet")
    put("documents", [(1, "x a b c d e"), (1, "x a b c d e"), (None, "a b c d e"), (2, None), (3, "")], "doc_id long, text string")
    put("eval_items", [(7, "a b c d e"), (7, "a b c d e"), (8, "a"), (9, None)], "item_id long, text string")
    got = registry.queries()["quotation_matches"](spark, str(tmp_path))
    assert {tuple(x) for x in got.collect()} == {(1, 7, 1, 5, 5, 5), (None, 7, 0, 4, 5, 5)} and got.count() == 2


def written(spark):
    """Bytes that all shuffles so far have written."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    e = sc.statusStore().executorList(False)
    return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))


def test_phrases_are_found_in_one_pass(spark, monkeypatch):
    rnd = random.Random(5)
    some = lambda n: " ".join(rnd.choice(["a", "bb", "ccc", "é", "كتاب"]) for _ in range(n))
    texts = [(i, some(rnd.randint(1, 60))) for i in range(80)]
    phrases = sorted({some(rnd.choice([1, 2, 3, 4, 5, 7])) for _ in range(150)} | {texts[3][1]})
    want = {(d, p, p.upper()) for d, x in texts for p in phrases if f" {p} " in f" {x} "}
    docs = spark.createDataFrame([*((d, x.split()) for d, x in texts), (99, []), (98, None)], "doc_id long, w array<string>")
    frame = spark.createDataFrame([(p, p.upper()) for p in phrases], "k string, u string")
    # The smallest bitmap, which lets others through, and documents parted.
    monkeypatch.setattr(L, "MOST_BITS", 15), monkeypatch.setattr(L, "BATCH_WORDS", 50)
    got = [(x["doc_id"], x["k"], x["u"]) for x in L.phrases_inside(docs, frame).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)
    assert L.phrases_inside(docs, frame.limit(0)).count() == 0 and L.phrases_inside(docs.limit(0), frame).count() == 0


def test_title_inside_text_does_not_shuffle_documents(spark, tmp_path):
    put = lambda n, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}.parquet")
    rnd = random.Random(7)
    put("documents", [(i, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(300)) + (" of the old, treaty" if i == 5 else "")) for i in range(200)] + [(None, "The Old Treaty")], "doc_id long, text string")
    put("articles", [("s", "The Old Treaty"), ("t", "the old treaty survey"), ("u", "the old"), (None, "old treaty")], "stem string, title string")
    before = written(spark)
    assert {tuple(x) for x in registry.queries()["title_inside_text"](spark, str(tmp_path)).collect()} == {("s", 5), ("s", None), (None, 5), (None, None)}
    # The documents' 60,000 words alone are 600 kB.
    assert written(spark) - before < 100_000
