import random

from quire.llm import packing as P


def packed(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in docs], "doc_id long, text string, source string, bin string")
    return P.packed(df, **kw).collect()


def check(docs, rows, capacity):
    load, enc = {}, P.encoder(P.TOKENIZER)
    by = {}
    for r in rows:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        by.setdefault(r["doc_id"], []).append(r)
    assert max(load.values(), default=0) <= capacity
    for i, t, _ in docs:
        p = sorted(by[i], key=lambda r: r["piece"])
        n = len(enc.encode_ordinary(t or ""))
        assert sum(r["tokens"] for r in p) == n and (len(p) == 1) == (n <= capacity)
        assert [r["char_start"] for r in p] == [0] + [r["char_end"] for r in p[:-1]] and p[-1]["char_end"] == len(t or "")
    return load


def test_pack(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdeéش漢", k=r.randint(1, 7)))
    docs = [(i, " ".join(word() for _ in range(r.choice([3, 20, 60, 90]))), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(150)]
    docs += [(900, " ".join(word() for _ in range(700)), None), (901, "", None), (902, None, "s1"), (903, "漢" * 500, "s2")]
    for per_shard in (20, 10_000):
        rows = packed(spark, docs, capacity=256, per_shard=per_shard)
        load = check(docs, rows, 256)
    assert sum(load.values()) / (256 * len(load)) > 0.95
    assert packed(spark, []) == []


def test_copies_are_kept_apart(spark):
    docs = [(i, "one two three" if i % 2 else "ONE, two Three!", f"s{i}") for i in range(6)]
    rows = packed(spark, docs, capacity=64)
    assert len({r["container"] for r in rows}) == 6


def test_near_copies_are_one_cluster(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    near = lambda k: " ".join(base[:k] + ["x"] + base[k + 1 :])
    half = " ".join(base[:200] + [f"v{i}" for i in range(200)])
    rows = [(i, near(13 * i)) for i in range(8)] + [(20, half), (30, ""), (31, None), (32, "— … —"), (33, "one two"), (34, "One two!"), (35, " ".join(base * 40))]
    got = {x["doc_id"]: x["cluster"] for x in P.duplicate_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(8)} == {"0"} and got[20] == "20" and got[34] == got[33] and not {30, 31, 32} & set(got)
    assert P.duplicate_clusters(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_letters_share_containers(spark):
    assert len({r["container"] for r in packed(spark, [(i, ["", None, "—"][i % 3], "s") for i in range(30)], capacity=64)}) == 1


def test_likeness_of_minima():
    r = random.Random(6)
    a = [str(r.random()) for _ in range(3000)]
    same = lambda n: float((P.minima(" ".join(a)) == P.minima(" ".join(a[n:] + [str(r.random()) for _ in range(n)]))).mean())
    assert same(0) == 1.0 and abs(same(333) - 0.8) < 0.12 and same(3000) < 0.05 and P.minima("— …") is None


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = [[10, 1, 1], [7, 2, 2], [9, 0, 0]]
    assert P.best_fit([(6, 1, 5)], 20, [list(b) for b in bins])[0] == [2]  # the bin with 7 left holds source 1
    assert P.best_fit([(6, 3, 5)], 20, [list(b) for b in bins])[0] == [1]
    assert P.best_fit([(6, 1, 1)], 20, [[7, 2, 2]])[0] == [1]
    assert P.best_fit([(6, 1, 5)], 20, [[7, 2, 2]])[0] == [0]  # only the source is in the way
