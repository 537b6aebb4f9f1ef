import random

import numpy as np
from quire.llm import shared_spans as S


def brute(docs, k=S.STRETCH):
    own = {}
    for d, t in docs:
        for i in range(len(t or "") - k + 1):
            own.setdefault(t[i : i + k], set()).add(d)
    out = []
    for d, t in docs:
        at = [i for i in range(len(t or "") - k + 1) if len(own[t[i : i + k]]) > 1]
        spans = []
        for i in at:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + k
            else:
                spans.append([i, i + k])
        out += [(d, a, b) for a, b in spans]
    return sorted(set(out))


def found(spark, docs):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, run int")
    return sorted(map(tuple, S.shared_spans(df).collect()))


def prose(r, n, marks=True):
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n)]
    return "".join(w + (r.choice([". ", "? ", "\n\n", ".\n"]) if marks and r.random() < 0.08 else " ") for w in words)


def test_against_brute_force(spark):
    r = random.Random(4)
    docs = []
    for i in range(40):
        t = prose(r, r.randint(60, 260), marks=i % 3 > 0)
        if docs and i % 2:
            # Pieces of other texts at any place, some just long enough, some one character short.
            for _ in range(r.randint(1, 3)):
                src = r.choice(docs)[1]
                n = r.choice([399, 400, 401, 460, 700])
                a = r.randint(0, max(0, len(src) - n))
                at = r.choice([0, len(t), r.randint(0, len(t))])
                t = t[:at] + src[a : a + n] + t[at:]
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, docs[5][1][7:]), (103, docs[5][1][:-9])]
    assert found(spark, docs) == brute(docs)


def test_without_blanks_and_odd_characters(spark):
    r = random.Random(5)
    a = "".join(r.choices("abcdefghijklmnop😀é漢", k=1500))
    docs = [(1, a), (2, "x" * 50 + a[200:900]), (3, "ab" * 600), (4, "z" + "ab" * 500), (5, a[:399])]
    assert found(spark, docs) == brute(docs)


def test_null_empty_repeated(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, ""), (3, "a" * 399)]) == []
    t = prose(random.Random(6), 200)
    # A text that only repeats itself shares nothing.
    assert found(spark, [(1, t + t)]) == []
    assert found(spark, [(1, t), (1, t)]) == []


def test_there_is_a_cut_in_every_window():
    t = S.Texts([prose(random.Random(7), 900), "a" * 700])
    c = t.cuts()
    inside = c[c < t.off[1]]
    assert np.diff(inside).max() <= S.W
