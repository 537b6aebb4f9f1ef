import random

import pytest

from quire.llm.components import seed_tree
from quire.operators import skew


def brute(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)), key=lambda s: s.encode())
            top[y] = x
    return sorted((find(x), x) for x in top if find(x) != x)


def grouped(spark, pairs):
    df = spark.createDataFrame([(a, b, "u", 1) for a, b in pairs], "a string, b string, u string, top int")
    return sorted(map(tuple, seed_tree(df, "a", "b").collect()))


CASES = {
    "empty": [],
    "nulls and loops": [("a", None), (None, "b"), ("c", "c"), ("", "d"), ("d", "")],
    "repeats both ways": [("b", "a"), ("a", "b"), ("b", "a"), ("é", "z"), ("z", "Z")],
    "chain": [(f"k{i:03}", f"k{i + 1:03}") for i in range(70)],
    "shuffled chain": [(f"k{(i * 37) % 71:03}", f"k{((i + 1) * 37) % 71:03}") for i in range(70)],
    "star": [("m", f"x{i}") for i in range(60)] + [("x3", "a")],
    "random": [(random.Random(i).choice("abcdefghijklmnop"), random.Random(i + 99).choice("abcdefghijklmnop") + "q") for i in range(40)],
}


@pytest.mark.parametrize("name", CASES)
def test_groups(spark, name):
    assert grouped(spark, CASES[name]) == brute(CASES[name])


def test_hub_is_split(spark, monkeypatch):
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.01, 20))
    pairs = [("m", f"x{i}") for i in range(200)] + [("y", "x5"), ("p", "q")]
    assert grouped(spark, pairs) == brute(pairs)
