import random

from quire.functions.edit import distance
from quire.llm import scan_noise as N


def test_trie_finds_every_candidate():
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcd", k=r.randint(1, 7))) for _ in range(300)})
    asked = ["".join(r.choices("abcde", k=r.randint(1, 8))) for _ in range(200)] + ["a" * 59, "é"]
    got = N.Trie(words).near(asked)
    for q, g in zip(asked, got):
        assert sorted(g) == [w for w in words if distance(q, w) <= 1]
    assert N.Trie([]).near(["abc"]) == [[]]


def types_of(spark, counts):
    return spark.createDataFrame([(w, n, N.kind_of(w)) for w, n in counts.items()], "core string, n long, kind int")


def test_candidates_over_many_tries(spark):
    r = random.Random(2)
    words = {"".join(r.choices("abes", k=r.randint(1, 8))): r.choice([1, 2, 15, 300]) for _ in range(400)} | {"modern": 50, "modem": 2, "tlie": 1, "the": 900}
    got = {(x["core"], x["v"]) for x in N.candidates(types_of(spark, words), trie_words=60, asked_words=50).collect()}
    confused = lambda a, b: any(b[:i] + y + b[i + len(x) :] == a for x, y in N.CONFUSED for i in range(len(b)) if b.startswith(x, i))
    near = {(a, b) for a in words for b in words if len(a) > 1 and a != b and words[b] >= 10 * words[a] and (distance(a, b) <= 1 or confused(a, b))}
    assert got == near and ("modem", "modern") in got and ("tlie", "the") in got
    assert N.candidates(types_of(spark, words).limit(0)).count() == 0


def test_misread_types(spark):
    counts = {"the": 9000, "then": 300, "tlie": 9, "thc": 8, "cat": 900, "cct": 2, "see": 800, "scc": 1, "sec": 4, "catalogue": 400, "catalogne": 2, "rare": 3, "descr.ibes": 1, "describes": 90, "19o4": 1, "l'élève": 2, "élève": 40, "1st": 9, "": 5, "xiv": 3}
    got = {r["core"]: r["reading"] for r in N.misread_types(types_of(spark, counts)).collect()}
    # A word that is far more frequent than any misreading would be stays, and so does a rare one without candidates.
    assert got.pop("19o4") is None and got == {"tlie": "the", "thc": "the", "cct": "cat", "sec": "see", "catalogne": "catalogue", "descr.ibes": "describes"}
    assert N.misread_types(types_of(spark, counts).limit(0)).count() == 0


def test_rare_words_of_any_corpus_size(spark):
    counts = {"archive": 500, "archivc": 2, "allerdings": 6, "allerdlngs": 1, "dagegen": 70, "dagegn": 1}
    for times in (1, 100):
        got = {r["core"] for r in N.misread_types(types_of(spark, {w: n * times if n > 2 else n for w, n in counts.items()})).collect()}
        assert got == {"archivc", "dagegn"} | ({"allerdlngs"} if times > 1 else set())


def test_judge():
    text = "— 3 — Review\nthe old libr-\nary descr.ibes the catalogne\nmodern 12 19O4"
    got = N.judge(text, [0], frozenset(["the", "old"]))
    raw = text.replace("\n", " ").split(" ")
    assert [(raw[i], k, c) for i, k, _, c, *_ in got] == [
        ("—", "furniture", None), ("3", "furniture", None), ("—", "furniture", None), ("Review", "furniture", None), ("libr-", "hyphen", None), ("libr-", "word", "library"),
        ("descr.ibes", "word", "descr.ibes"), ("catalogne", "word", "catalogne"), ("modern", "word", "modern"), ("19O4", "word", "19o4"),
    ]
    assert N.judge("", None) == [] and N.judge("lo-", None)[0][:2] == (0, "hyphen")


def test_halves(spark):
    misread = spark.createDataFrame([("libnary", "library", ["library"]), ("librany", "library", ["library"]), ("l1brary", None, [])], "core string, reading string, readings array<string>")
    texts = spark.createDataFrame([(1, "libn-\nary", None, False), (2, "lib-\nrany", None, False), (3, "l1b-\nrary", None, False), (4, "", [0], False)], "key long, text string, gone array<int>, continued boolean")
    plain, words = N.suspects(texts, frozenset(), misread)
    assert {(r["key"], r["ord"]) for r in words.collect()} == {(1, 0), (2, 1), (3, 0)}
    assert {(r["key"], r["ord"], r["kind"]) for r in plain.collect()} == {(k, 0, "hyphen") for k in (1, 2, 3)}


def test_context_ranks(spark):
    words = spark.createDataFrame([(1, 0, "caz", "the", "runs", ["cat", "car"]), (2, 3, "caz", None, None, ["cat", "car"]), (2, 4, "x1", "a", "b", [])], "key long, unit int, core string, before string, after string, readings array<string>")
    pairs = spark.createDataFrame([("the", "car", 5), ("the", "cat", 2)], "a string, b string, n long")
    assert {(r["key"], r["unit"], r["want"]) for r in N.best_readings(words, pairs).collect()} == {(1, 0, "car"), (2, 3, "cat")}


def test_heads():
    assert N.head_keys("— 12 —") == (True, []) and N.head_keys("[l5]")[0] and N.head_keys("ص ٥٣")[0] and N.head_keys("vii")[0]
    assert N.head_keys("3 Review of X")[1] == ["# review of x", "review of x"] and not N.head_keys("See page")[0]


def block(pk, page, ord_, vpos, text, stem="7000-001-001-001", loaded="2024-01-01"):
    return (pk, stem, f"p{page}b{ord_}", page, ord_, "text", "eng", text, vpos, loaded)


def test_whole(spark, tmp_path):
    body = "the old library describes the modern catalogue and the village\nof the same library until the old catalogue was known"
    rows, pk = [], 0
    for page in range(1, 9):
        rows.append(block(10 * page, page, 0, 90, f"Review of the Poem\n{body}"))
        rows.append(block(10 * page + 1, page, 1, 500, body.replace("village", "vil-\nlage") if page % 2 else body.replace("library", "libr.ary", 1)))
        rows.append(block(10 * page + 2, page, 2, 3100, f"[{page}]"))
    rows.append(block(500, 1, 1, 500, "", stem="7000-001-001-002"))
    rows.append(block(501, 1, 0, 500, None, stem="7000-001-001-002"))
    b = spark.createDataFrame(rows, "block_pk long, stem string, block_id string, page int, ord int, role string, lang string, text string, vpos int, loaded string")
    b.write.parquet(str(tmp_path / "blocks.parquet"))
    words = []
    for r in rows:
        k = 0
        for i, line in enumerate((r[7] or "").split("\n")):
            for w in line.split(" "):
                if w:
                    pk += 1
                    words.append((pk, r[0], i, k, w))
                    k += 1
    spark.createDataFrame(words, "word_pk long, block_pk long, line int, ord int, text string").write.parquet(str(tmp_path / "words.parquet"))
    held = [(1, "7000-001-001-001", "Review of the Poem\n— 9 —"), (2, "x", "the old lib-\nrary"), (3, None, None), (4, "x", "")]
    spark.createDataFrame(held, "n long, doc string, text string").write.parquet(str(tmp_path / "heldout_blocks.parquet"))
    got = {(r["tbl"], r["row_id"], r["kind"]) for r in N.p2_found(spark, str(tmp_path)).collect()}
    want = set()
    for p, b_, line, _, w in words:
        if (b_ % 10 == 0 and line == 0) or b_ % 10 == 2:
            want.add(("words", p, "furniture"))
        elif w == "vil-":
            want.add(("words", p, "hyphen"))
        elif w == "libr.ary":
            want.add(("words", p, "misread"))
    assert {g for g in got if g[0] == "words"} == want
    assert {g[1:] for g in got if g[0] == "heldout_blocks" and g[1] < 4} == {(1, "furniture"), (2, "hyphen")}
    text = {r["ord"]: r["text"] for r in N.p2_paragraphs(spark, str(tmp_path)).where("page = 1").collect()}
    assert "vil-" not in text[1] and "village of" in text[1] and "Review" not in text[0] and 2 not in text
