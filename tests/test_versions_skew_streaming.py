import os

from pyspark.sql import functions as F

from quire.operators import skew
from quire.operators import versions as V
from quire.sources.tables import table
from quire.streaming import windows as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, at int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 1), (None, "n", 1)], "k int, v string, at int")
    assert sorted(map(tuple, V.upsert(a, b, ["k"], ["at"]).collect()), key=str) == sorted([(1, "x", 1), (2, "z", 2), (3, "w", 1), (None, "n", 1)], key=str)
    assert V.upsert(a.limit(0), b.limit(0), ["k"], ["at"]).count() == 0


def test_unchanged_chosen_merge_overlay(spark):
    old = spark.createDataFrame([(1, "s"), (2, None)], "k int, sha string")
    new = spark.createDataFrame([(1, "s"), (2, None), (3, "t"), (1, "u")], "k int, sha string")
    assert rows(V.unchanged(old, new, ["k"], "sha")) == [(1, "u"), (3, "t")]
    a = spark.createDataFrame([(1, "rule", "a"), (1, "person", "b"), (1, "odd", "c")], "k int, source string, v string")
    assert rows(V.chosen(a, ["k"], "source", ["person", "rule"], ["v"])) == [(1, "person", "b")]
    held = spark.createDataFrame([(1, "accepted")], "id int, status string")
    assert rows(V.corrections_merge(held, spark.createDataFrame([(1, "proposed"), (2, "proposed")], "id int, status string"), ["id"])) == [(1, "accepted"), (2, "proposed")]
    w = spark.createDataFrame([(1, "tbe"), (2, "cat")], "id int, text string")
    c = spark.createDataFrame([(1, "the", "applied"), (2, "dog", "declined")], "id int, text string, status string")
    assert rows(V.overlay(w, c, "id").select("id", "text")) == [(1, "the"), (2, "cat")]
    m = spark.createDataFrame([("n", "b"), ("n", "b"), ("n", "a"), ("n", None)], "new string, old string")
    assert [tuple(r) for r in V.inherited_ids(m, "new", "old").collect()] == [("n", "b", ["a"])]
    assert rows(V.symmetric_diff(old, new).select("k", "side")) == [(1, "second"), (3, "second")]


def test_hot_join_equals_join(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = skew.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), "k", "n", least=100)
    assert hot == [7]
    for how in ("inner", "left"):
        assert sorted(map(str, skew.hot_join(big, small, "k", hot, F.col("v"), how).collect())) == sorted(map(str, big.join(small, "k", how).collect()))


def test_stream_equals_batch(spark, small, tmp_path):
    table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for i, f in enumerate((W.tumbling, W.sliding, W.sessions)):
        got = W.run_to_end(f(stream), f"w{i}", str(tmp_path / f"c{i}"), "complete" if f is not W.sessions else "append")
        late = f(events)
        if f is W.sessions:
            assert got.exceptAll(late).count() == 0
        else:
            assert rows(got) == rows(late)
    assert W.first_deliveries(events.union(events)).count() == events.count()
    assert os.path.isdir(tmp_path)
