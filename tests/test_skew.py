"""Fallback paths of the scale guards give the same results as the fast paths."""

from pyspark.sql import functions as F

from assetsweep.operators import skew
from assetsweep.session import spread


def key(df):
    return sorted(tuple(r) for r in df.collect())


def test_spread_only_acts_on_inputs_smaller_than_one_wave(spark):
    many = spark.range(0, 1000, numPartitions=32)
    assert spread(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    spread_one = spread(one, 8)
    assert spread_one.rdd.getNumPartitions() == 8 and key(spread_one) == key(one)


def test_filter_by_ids_shuffle_fallback(spark):
    wide = spark.range(0, 500).withColumn("payload", F.sha2(F.col("id").cast("string"), 256))
    ids = spark.range(0, 500, 7).withColumnRenamed("id", "id")
    for keep in (True, False):
        fast = skew.filter_by_ids(wide, ids, "id", keep=keep)
        slow = skew.filter_by_ids(wide, ids, "id", keep=keep, max_ids=0)
        assert key(fast) == key(slow)
    assert skew.filter_by_ids(wide, ids, "id", keep=True).count() == len(range(0, 500, 7))


def test_hot_join_falls_back_when_too_many_hot_keys(spark, monkeypatch):
    rows = spark.range(0, 3000).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"))
    split = skew.join_members_to_groups(rows, groups, ["k"], "n", hot_rows=100)
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1)
    fallback = skew.join_members_to_groups(rows, groups, ["k"], "n", hot_rows=100)
    plain = rows.join(groups, "k")
    assert key(split) == key(plain) == key(fallback)
