"""Every problem's query on empty tables, on rows of nulls, and on tables with extra columns of clashing names."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quire.llm import registry as llm
from quire.plans import registry

FOUND = {**{f"p{n}_found": llm for n in (1, 2, 3, 5, 6, 8, 9)}, "p4_found": registry, "p7_packed": llm, "p2_paragraphs": llm}
KEYS = {"documents": "doc_id", "words": "word_pk", "blocks": "block_pk", "articles": "stem", "article_runs": "ar_id", "runs": "run_no", "affiliations": "aff_id", "ibid_draw": "backref", "meta_draw": "draw_id", "institution_variants": "variant_id", "heldout_blocks": "n", "eval_items": "item_id", "orphans": "child"}
CLASHING = ["key", "core", "kind", "v", "w", "u", "g", "bucket", "cell", "band", "name", "org", "cluster", "shard", "gone", "skel", "who", "first", "last", "h", "code", "begin", "end"]


def written(spark, small, folder, change):
    for n, key in KEYS.items():
        d = spark.read.parquet(f"{small}/{n}.parquet")
        change(d, key).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{n}.parquet")
    for p in glob.glob(f"{small}/*.parquet"):
        if os.path.basename(p)[:-8] not in KEYS and not os.path.exists(f"{folder}/{os.path.basename(p)}"):
            os.symlink(p, f"{folder}/{os.path.basename(p)}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    return written(spark, small, tmp_path_factory.mktemp("empty"), lambda d, key: d.limit(0))


@pytest.fixture(scope="module")
def nulls(spark, small, tmp_path_factory):
    """Rows of nulls but for their key among ten others that have the same keys, and extra columns of nulls."""
    alone = lambda d, key: d.limit(2).select(*[F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in d.dtypes])
    more = lambda d: d.withColumns({c: F.lit(None).cast("string") for c in CLASHING if c not in d.columns})
    return written(spark, small, tmp_path_factory.mktemp("nulls"), lambda d, key: more(d.orderBy(F.desc(key)).limit(10).unionByName(alone(d, key))))


@pytest.fixture(scope="module")
def extra(spark, small, tmp_path_factory):
    return written(spark, small, tmp_path_factory.mktemp("extra"), lambda d, key: d.withColumns({c: F.lit("x") for c in CLASHING if c not in d.columns}))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", FOUND)
def test_empty(spark, empty, name):
    assert rows(FOUND[name].queries()[name](spark, empty)) == []


@pytest.mark.parametrize("name", FOUND)
def test_nulls(spark, nulls, name):
    rows(FOUND[name].queries()[name](spark, nulls))


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p7_packed"])
def test_extra_columns_change_nothing(spark, small, extra, name):
    f = FOUND[name].queries()[name]
    assert rows(f(spark, extra)) == rows(f(spark, small))
