import random

from pyspark.sql import functions as F

from quire.functions.kernels import ratio
from quire.operators import clusters as C


def test_components(spark):
    r = random.Random(1)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(40)] + [("x", "x"), ("a", "b"), ("b", "a"), (None, "n"), ("n", None)]
    r.shuffle(pairs)
    df = spark.createDataFrame([(a, b, "extra") for a, b in pairs], "p string, q string, u string")
    got = {x["key"]: x["first"] for x in C.components(df, "p", "q").collect()}
    assert {got[f"c{i}"] for i in range(61)} == {"c0"} and {got[f"h{i}"] for i in range(40)} == {"h0"} and got["hub"] == "h0"
    assert got["x"] == "x" and got["b"] == "a" and got["n"] == "n" and len(got) == 61 + 41 + 4
    assert C.components(df.limit(0), "p", "q").count() == 0


def test_alike_keys_against_all_pairs(spark):
    r = random.Random(2)
    base = ["".join(r.choices("abcdefgh", k=r.randint(8, 26))) for _ in range(60)]
    keys = set(base)
    for b in base:
        for _ in range(3):
            k = r.randrange(len(b))
            keys.add(r.choice([b[:k] + b[k + 1 :], b[:k] + "x" + b[k:], b[:k] + "x" + b[k + 1 :], b[:k] + b[k + 2 :]]))
    keys = sorted(keys)
    df = spark.createDataFrame([(k,) for k in keys + keys[:5]] + [(None,), ("",), ("short",)], "key string")
    got = {(x["a"], x["b"]) for x in C.alike_keys(df, "key").collect()}
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if min(len(a), len(b)) >= 8 and ratio(a, b) >= 0.92}
    assert want and want <= got and got <= {(a, b) for a in keys for b in keys if a < b}


def test_institutions_and_names(spark):
    df = spark.createDataFrame([("universitykielnorth", 1), ("universitykielnorht", 1), ("جامعهكيلالشماليه", 1), ("oxford", 2), ("", 3)], "k string, p int")
    got = {x["key"]: x["first"] for x in C.institution_clusters(df, F.col("k"), "p").collect()}
    assert got["universitykielnorth"] == got["universitykielnorht"] == got["جامعهكيلالشماليه"] and got["oxford"] == "oxford" and "" not in got
    n = C.chosen_names(spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "d"), (2, "c"), (3, None)], "g int, name string"), "g", "name")
    assert {tuple(x) for x in n.collect()} == {(1, "b"), (2, "c")}


def test_persons_supervisions_verdicts(spark):
    m = spark.createDataFrame([(1, "k", "A1", None), (2, "k", None, None), (3, "h", "A2", None), (4, "h", "A3", None), (5, "h", None, "o"), (6, "z", None, "o"), (7, "z", None, "o"), (8, None, None, "o")], "mention_id int, key string, authority string, signal string")
    got = {x["mention_id"]: (x["person"], x["method"]) for x in C.resolved_persons(m).collect()}
    assert got[2] == ("a:A1", "key of one") and got[1][0] == "a:A1" and got[5] == ("m:5", "alone") and got[6] == got[7] == ("k:z:o", "key and signal") and got[8][1] == "alone"
    c = spark.createDataFrame([(1, 2, "author", "b"), (1, 1, "author", "a"), (1, 3, "supervisor", "s"), (2, 1, "supervisor", "t"), (1, 3, "supervisor", "s")], "record int, seq int, role string, name string")
    assert [tuple(x) for x in C.supervisions(c).collect()] == [(1, "s", "a")]
    v = spark.createDataFrame([("x", "f1", "ok"), ("y", "f2", "ok"), ("z", "f9", "ok")], "subject string, fp string, verdict string")
    now = spark.createDataFrame([("x", "f1"), ("w", "f2"), ("w2", "f2")], "subject string, fp string")
    assert {(x["subject"], x["now_subject"], x["state"]) for x in C.carried_over(v, now, "subject", "fp").collect()} == {("x", "x", "kept"), ("y", "w", "moved"), ("z", None, "stale")}
    assert C.ranked_once(v, ["verdict"], ["subject"], 2).count() == 2
