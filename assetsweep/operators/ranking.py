"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetsweep.session import materialize


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-sorted and stored, with its partition (``_part``) and place in it (``_row``)."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    d = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return materialize(d.withColumn("_part", F.shiftright(number, 33)).withColumn(
        "_row", number.bitwiseAND(2 ** 33 - 1)))


def _before(sizes: DataFrame) -> DataFrame:
    """Per partition the sum of ``n`` over the partitions before it (one row per partition)."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before")))


def balanced(df: DataFrame, weight: str, parts: int, order: list[Column]) -> DataFrame:
    """``df`` dealt into ``parts`` partitions of about equal total ``weight``, neighbours in ``order`` together."""
    d = _numbered(df, order)
    before = _before(d.groupBy("_part").agg(F.sum(weight).alias("n")))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy("_row"))
    d = d.withColumn("_sum", inside).join(before, "_part")
    total = df.agg(F.sum(weight)).first()[0] or 0
    share = F.floor((F.col("_before") + F.col("_sum") - F.col(weight)) / F.lit(max(1.0, total / parts)))
    # repartition() deals by hash: each bin gets a key that hashes to the partition of its number.
    keys = (df.sparkSession.range(parts * 32).groupBy(F.pmod(F.hash("id"), F.lit(parts)).cast("long").alias("_bin"))
            .agg(F.min("id").alias("_key")))
    d = d.withColumn("_bin", F.least(share, F.lit(parts - 1)).cast("long")).join(F.broadcast(keys), "_bin", "left")
    return d.withColumn("_key", F.coalesce("_key", "_bin")).repartition(parts, "_key").select(*df.columns)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based rank in ``order`` (which must be total for a stable result).

    A range sort deals the rows out in order; each partition numbers its own rows,
    and the number of rows in the partitions before it is added.  Only one row per
    partition takes part in the running sum.
    """
    d = _numbered(df, order)
    out = d.join(_before(d.groupBy("_part").agg(F.count("*").alias("n"))), "_part")
    return out.select((F.col("_before") + F.col("_row") + 1).cast("long").alias(name), *df.columns)
