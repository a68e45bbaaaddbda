"""Reclaim planning and re-verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.operators.duplicates import Duplicates
from assetsweep.operators.skew import DEFAULT_HOT_ROWS, filter_by_ids, join_members_to_groups
from assetsweep.session import materialize


@dataclass
class ReclaimPlan:
    removal: DataFrame   # one row per asset to remove: group_id, asset_id, path, store, size, hash, keeper_id
    allowed: DataFrame   # groups passing the policy gate
    blocked: DataFrame   # groups refused by the policy gate

    def blocked_rollup(self) -> DataFrame:
        """Number of blocked groups and their reclaimable bytes."""
        return self.blocked.agg(F.count(F.lit(1)).alias("blocked_groups"),
                                F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("long").alias("blocked_bytes"))


def reclaim_plan(dups: Duplicates, keep: str = "preferred", cap: int | None = None,
                 groups: DataFrame | None = None) -> ReclaimPlan:
    """Which copies to remove.

    ``keep="preferred"``: keep a copy in a preferred store, else the first (W1);
    ``keep="first"``: keep the first member by ``asset_id`` (W2).  ``cap`` is the
    group policy gate (P7): a group is actionable only if every member is at most
    ``cap`` bytes.  ``groups`` restricts the plan to selected group ids (J7).
    The gate and the selection act on the one-row-per-group table, before the
    members are joined, so no member-level join is spent on refused groups.
    """
    g = dups.groups
    if groups is not None:
        g = g.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    if keep == "preferred":
        g = g.withColumn("keep_id", F.col("keeper_id"))
    elif keep == "first":
        g = g.withColumn("keep_id", F.col("group_id"))
    else:
        raise ValueError("keep must be 'preferred' or 'first'")
    if cap is None:
        allowed, blocked = g, g.limit(0)
    else:
        # Members of a group share one size, so max(size) <= cap is size_each <= cap.
        allowed = g.where(F.col("size_each") <= cap)
        blocked = g.where(F.col("size_each") > cap)
    members = dups.members(allowed.drop("keeper_id").withColumnRenamed("keep_id", "keeper_id"))
    removal = members.where(~F.col("is_keeper")).select(
        "group_id", "asset_id", "path", "store", "size", "hash", "keeper_id")
    return ReclaimPlan(removal, allowed, blocked)


def row_gate(rows: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the cap, rows over it)."""
    return rows.where(F.col("size") <= cap), rows.where(F.col("size") > cap)


def kept_assets(assets: DataFrame, removal: DataFrame) -> DataFrame:
    """The asset table without the removal set.

    The removal ids, or beyond a checked count a bitmap of fixed size, are broadcast,
    so asset rows (with payloads) are filtered where they are read.
    """
    return filter_by_ids(assets, removal, "asset_id", keep=False)


def verify_plan(removal: DataFrame, current: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Re-check every planned removal against the present fingerprints.

    ``current`` holds fingerprints of the live assets (``asset_id, size, hash,
    head_hash, tail_hash``).  Status per row:
    ``missing`` (target gone), ``keeper_missing``, ``changed`` (target no longer
    identical to its keeper) or ``ok``.  Keeper state is looked up once per group
    (join on ``keeper_id``), targets by ``asset_id``; the per-group state joins
    back by ``group_id`` through the hot-group split.
    """
    fp_cols = ["size", "hash", "head_hash", "tail_hash"]
    # The plan rows feed both the keeper lookup and the target lookup.
    removal = materialize(removal)
    planned = removal.select("asset_id").union(removal.select("keeper_id")).distinct()
    # Only planned assets and their keepers are hashed: the ids are filtered below
    # the hash expressions, in the scan.  The narrow rows are read twice.
    cur = materialize(filter_by_ids(current, planned, "asset_id", keep=True).select("asset_id", *fp_cols))
    # One row per group with its keeper's present state; ``n`` feeds the hot split.
    keeper_state = (removal.groupBy("group_id", "keeper_id").agg(F.count(F.lit(1)).alias("n"))
                    .join(cur.select(F.col("asset_id").alias("keeper_id"),
                                     *[F.col(c).alias("k_" + c) for c in fp_cols]),
                          "keeper_id", "left"))
    target = removal.join(
        cur.select("asset_id", *[F.col(c).alias("t_" + c) for c in fp_cols]), "asset_id", "left")
    j = join_members_to_groups(target, keeper_state.drop("keeper_id"), ["group_id"], "n", hot_rows, how="left")
    same = F.lit(True)
    for c in fp_cols:
        same = same & F.col("t_" + c).eqNullSafe(F.col("k_" + c))
    status = (F.when(F.col("t_hash").isNull(), "missing")
              .when(F.col("k_hash").isNull(), "keeper_missing")
              .when(~same, "changed")
              .otherwise("ok"))
    return j.select("group_id", "asset_id", "keeper_id", "size", status.alias("status"))


def status_rollup(status_rows: DataFrame) -> DataFrame:
    """A10 + A11: rows and bytes per status."""
    return status_rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
