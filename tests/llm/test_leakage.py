import random

from quire.llm import leakage as K

R = random.Random(3)
WORDS = ["".join(R.choices("bcdfglmnprst", k=1) + R.choices("aeiou", k=1) + R.choices("bcdfglmnprst", k=1) + R.choices("aeiou", k=1)) for _ in range(400)]


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    return sorted(map(tuple, K.leaked(d, spark.createDataFrame(items, "item_id long, text string")).collect()))


def test_cases(spark):
    item = R.sample(WORDS, 24)
    other = R.sample([w for w in WORDS if w not in item], 200)
    bad = lambda w: w[:2] + "x" + w[3:]
    far = other[:10]

    def doc(words):
        return " ".join(far) + ". " + " ".join(words) + " " + " ".join(reversed(far))

    part = item[5:15]
    docs = {
        1: doc(part), 2: doc(part[:9]), 3: doc([w.upper() + "," for w in part]), 4: doc([bad(w) if i in (2, 7) else w for i, w in enumerate(part)]),
        5: doc([bad(w) if i in (2, 5) else w for i, w in enumerate(part)]), 6: doc([other[50] if i == 4 else w for i, w in enumerate(part)]),
        7: " ".join(part[:4]) + " " + part[4][:2] + "-\n" + part[4][2:] + " " + " ".join(part[5:]), 8: "", 9: " ".join(item * 2), 10: doc([w[0] + "​" + w[1:] for w in part]),
        # Split or joined by spacing, alone and together with misreadings.
        12: doc(part[:4] + [part[4][:2], part[4][2:]] + part[5:]), 13: doc(part[:5] + [part[5] + part[6]] + part[7:]), 14: doc([*part[:6], part[6][:1], part[6][1:], bad(part[7]), *part[8:]]), 15: doc([bad(part[0]), *part[1:5], part[5] + part[6], *part[7:]]),
    }
    want = [(i, 7) for i in (1, 3, 4, 7, 9, 10, 12, 13, 14, 15)]
    assert found(spark, [*docs.items(), (11, None)], [(7, " ".join(item)), (8, " ".join(item[:9])), (9, None), (10, "")]) == want


def test_blocks_of_items_and_empty(spark, monkeypatch):
    monkeypatch.setattr(K, "ITEM_BLOCK", 2)
    items = [(i, " ".join(R.sample(WORDS, 15))) for i in range(5)]
    docs = [(i, "x y z " + t) for i, t in items]
    got = found(spark, docs, items)
    assert {(i, i) for i in range(5)} <= set(got)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_any_four_equal_words_share_a_kept_hash():
    import numpy as np

    for seed in range(50):
        r = random.Random(seed)
        four = [r.getrandbits(40) for _ in range(4)]
        seen = []
        for _ in range(2):
            h = np.array([r.getrandbits(40) for _ in range(3)] + four + [r.getrandbits(40) for _ in range(3)], dtype=np.int64)
            seen.append(set(K._grams(h, np.zeros(len(h), dtype=np.int64))[0].tolist()))
        assert seen[0] & seen[1]


def test_misreadings():
    assert K.misread("modern", "modem", set()) and K.misread("clear", "dear", set())
    assert not K.misread("village", "library", set()) and not K.misread("cat", "car", {"car"}) and not K.misread("1980", "1947", set())
