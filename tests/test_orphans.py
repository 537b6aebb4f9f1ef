import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import orphans as O

T0, T1, T2 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))
REFS = "child string, parent string, raw string, row_id long, loaded timestamp, extra int"


def probed(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, REFS)
    r = r.select("child", "parent", O.normal_key(F.col("raw")).alias("key"), "row_id", "loaded", "extra").where("key is not null")
    p = O.parent_keys(spark.createDataFrame(parents, "raw string, loaded timestamp, withdrawn timestamp"), "p", "raw", "loaded", "withdrawn")
    return sorted((x["row_id"], x["reason"]) for x in O.probe(r, p, **kw).collect())


def brute(refs, parents):
    out = []
    for _, _, raw, i, loaded, _ in refs:
        k = (raw or "").strip().lower()
        if not k:
            continue
        same = [(a, w) for r, a, w in parents if (r or "").strip().lower() == k]
        alive = [a for a, w in same if w is None]
        since = min((a for a in alive if a is not None), default=None)
        out.append((i, "missing" if not same else "deleted" if not alive else "late" if since and loaded and since > loaded else None))
    return sorted(out)


PARENTS = [("a", T0, None), ("A ", T2, None), ("gone", T0, T1), ("gone", T1, T2), ("back", T0, T1), ("back", T2, None), ("new", T2, None), ("undated", None, None), (None, T0, None), ("  ", T0, None)]


@pytest.mark.parametrize("per_task", [1, 3, 1000])
def test_reasons(spark, per_task):
    raws = ["a", " A ", "gone", "GONE", "back", "new", "undated", "nowhere", None, "", "  ", "　", "zzz"]
    refs = [("c", "p", raw, 100 * j + i, loaded, 1) for i, raw in enumerate(raws) for j, loaded in enumerate((T0, T1, T2, None))]
    refs.append(refs[0])
    assert probed(spark, refs, PARENTS, per_task=per_task) == brute(refs, PARENTS)


def test_hot_key_is_dealt_over_tasks(spark):
    refs = [("c", "p", "a" if i % 3 else f"k{i}", i, T1, 0) for i in range(600)]
    assert probed(spark, refs, PARENTS, per_task=50) == brute(refs, PARENTS)


def test_empty(spark):
    assert probed(spark, [], PARENTS) == []
    assert probed(spark, [("c", "p", "a", 1, T1, 0)], []) == [(1, "missing")]


def test_report_counts(spark):
    p = spark.createDataFrame([("c", "p", 1, T0, "missing"), ("c", "p", 2, T0, None), ("c", "p", 3, T1, None), ("c", "p", 4, None, "late")], "child string, parent string, row_id long, loaded timestamp, reason string")
    assert {(r["period"], r["with_value"], r["orphans"]) for r in O.orphan_report(p).collect()} == {("2024-01", 2, 1), ("2024-02", 1, 0), (None, 1, 1)}
