import pytest
from pyspark.sql import functions as F

from assetsweep.operators import skew as S


def wide_and_ids(spark, n=40_000):
    wide = spark.range(n).select((F.col("id") * 7 - 1000).alias("asset_id"), F.concat(F.lit("payload "), F.col("id")).alias("payload"))
    wide = wide.unionByName(spark.createDataFrame([(None, "no id"), (6, "twice"), (6, "twice")], "asset_id long, payload string"))
    ids = spark.range(0, n // 2).select((F.col("id") * 21 - 1000).alias("asset_id"))
    return wide, ids.unionByName(ids.limit(50)).unionByName(spark.createDataFrame([(None,)], "asset_id long"))


@pytest.mark.parametrize("bits", [1 << 31, 1 << 16])
@pytest.mark.parametrize("keep", [True, False])
def test_filters_equal_the_plain_join(spark, bits, keep):
    wide, ids = wide_and_ids(spark)
    want = wide.join(ids.distinct(), "asset_id", "left_semi" if keep else "left_anti").select(*wide.columns)
    got = S.filter_by_ids(wide, ids, keep=keep, max_ids=100, filter_bits=bits)  # 1 << 16: four filters, one after the other
    assert got.columns == wide.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("max_ids", [0, 1000])
def test_text_keys_are_broadcast_as_hashes(spark, keep, max_ids):
    wide = spark.range(500).select(F.concat(F.lit("some/long/path/"), F.col("id")).alias("asset_id"), F.col("id").alias("payload"))
    ids = wide.where("payload % 3 = 0").select("asset_id")
    got = S.filter_by_ids(wide, ids, keep=keep, max_ids=max_ids)
    assert {r.payload for r in got.collect()} == {k for k in range(500) if (k % 3 == 0) == keep}
    assert S.filter_by_ids(wide, ids.limit(0), keep=keep, max_ids=max_ids).count() == (0 if keep else 500)


def test_false_positives_stay_below_one_percent_at_50_million_ids(spark):
    """The filter of 50 million ids is 75 MB; the share that passes is counted on a million other ids."""
    n = 50_000_000
    blocks = -(-n * S.BITS_PER_ID // S.BLOCK_BITS)
    assert blocks * S.BLOCK_BITS <= S.FILTER_BITS
    filter_ = S.bloom_filter(spark.range(n).withColumnRenamed("id", "k"), "k", blocks)

    def passed(rows):
        d = rows.withColumn("_block", F.pmod(S._hash("k"), F.lit(blocks))).join(filter_, "_block")
        return d.where(S._in_filter("k")).count()
    assert passed(spark.range(0, n, 97).withColumnRenamed("id", "k").limit(200_000)) == 200_000
    assert passed(spark.range(n, n + 1_000_000).withColumnRenamed("id", "k")) < 10_000


def test_payloads_of_other_rows_reach_no_exchange(spark):
    wide, ids = wide_and_ids(spark)
    for keep in (True, False):
        out = S.filter_by_ids(wide, ids, keep=keep, max_ids=100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Rows are filtered by the broadcast filter before any exchange.
        assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
        logical = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_words" in logical
