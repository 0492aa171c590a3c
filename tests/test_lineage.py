import os
import random

from pyspark.sql import functions as F

from scholaspark import lineage


def test_cut_and_release(spark):
    df = spark.range(5)
    again = lineage.cut(df)
    assert again.dtypes == df.dtypes and again.count() == 5
    assert lineage.shared_folder(spark) == lineage.shared_folder(spark)
    lineage.release(spark)
    assert lineage.cut(df.limit(0)).count() == 0


def test_a_scope_leaves_nothing(spark):
    kept = lineage.cut(spark.range(3))
    with lineage.scope():
        assert lineage.cut(spark.range(4)).count() == 4
        path = lineage._made[-1]
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_numbered_is_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), i, 7) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, count int").repartition(5)
    got = lineage.numbered(df, [F.desc("a"), F.col("b")], "place", 1).collect()
    want = {r[:2]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert {(r.a, r.b): r.place for r in got} == want
    assert lineage.numbered(df.limit(0), ["a"], "place").count() == 0


def test_unions_do_not_pass_on_partitioning(spark):
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    lineage.cut(spark.range(2))
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
