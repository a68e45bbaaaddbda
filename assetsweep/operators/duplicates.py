"""Exact-duplicate detection.

Plan shape for ``find_duplicates`` on in-table payloads:

1. scan + hash in one narrow stage (payload never leaves the scan task);
2. the fingerprint rows (~250 bytes each) are materialized once;
3. ``groupBy(size, hash, head_hash, tail_hash)`` with partial aggregation, so a
   hot key is pre-combined on the map side: one shuffle of fingerprint rows;
4. members are joined back to the (materialized) group table with
   ``join_members_to_groups``, which sends hot groups map-side.

Keeper choice is an aggregate too: ``min(asset_id)`` among preferred stores, else
``min(asset_id)``; no window ever holds a whole group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.functions.hashing import fingerprint_columns
from assetsweep.functions.scalars import MANAGED_STORES
from assetsweep.operators.ranking import ranked
from assetsweep.operators.skew import DEFAULT_HOT_ROWS, join_members_to_groups
from assetsweep.session import materialize

KEY = ["size", "hash", "head_hash", "tail_hash"]
DEFAULT_MIN_SIZE = 8 * 1024 * 1024


def fingerprint_payloads(assets: DataFrame, algo: str = "sha256",
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint rows for assets whose payload is a column.

    A row without payload is kept with ``ok = false`` so it can be quarantined
    rather than silently dropped.
    """
    has = F.col("payload").isNotNull()
    size = F.coalesce(F.col("size"), F.octet_length("payload").cast("long"))
    fps = fingerprint_columns("payload", size, algo)  # null payload -> null hashes
    return assets.select(
        "asset_id", "path", "store", size.alias("size"), *fps,
        has.alias("ok"),
        F.when(~has, F.lit("unreadable: no payload")).alias("error"),
        *keep,
    )


def quarantine(fingerprints: DataFrame) -> DataFrame:
    """Rows that could not be fingerprinted."""
    return fingerprints.where(~F.col("ok"))


def size_candidates(assets: DataFrame, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """A3 / O1: sizes that occur more than once (the hashing prefilter)."""
    return (assets.where((F.col("size") >= min_size) & (F.col("size") > 0))
            .groupBy("size")
            .agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("min_id"))
            .where(F.col("n") > 1))


def ordered_candidates(candidates: DataFrame) -> DataFrame:
    """O1: candidate sizes with their rank, largest first, ties by first id."""
    return ranked(candidates, [F.desc("size"), F.asc("min_id")])


def hash_workload(candidates: DataFrame) -> DataFrame:
    """Files and bytes that still need hashing after the size prefilter."""
    return candidates.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files"),
                          F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).cast("long").alias("bytes"))


@dataclass
class Duplicates:
    """Result of ``find_duplicates``: materialized candidates and groups."""

    candidates: DataFrame  # fingerprint rows that passed P1/P6/P9
    groups: DataFrame      # one row per duplicate group
    hot_rows: int = DEFAULT_HOT_ROWS

    def members(self, groups: DataFrame | None = None) -> DataFrame:
        """Long form: one row per member of the given (default: all) groups."""
        g = self.groups if groups is None else groups
        g = g.select(*KEY, "group_id", "keeper_id", "n_members")
        rows = self.candidates.select(*KEY, "asset_id", "path", "store")  # KEY has the hash
        joined = join_members_to_groups(rows, g, KEY, "n_members", self.hot_rows)
        return joined.select(
            "group_id", "asset_id", "path", "store", "size", "hash", "keeper_id",
            (F.col("asset_id") == F.col("keeper_id")).alias("is_keeper"),
            (F.col("asset_id") == F.col("group_id")).alias("is_first"),
        )

    def totals(self) -> DataFrame:
        """Number of groups, members and total reclaimable bytes."""
        return self.groups.agg(
            F.count(F.lit(1)).alias("n_groups"),
            F.coalesce(F.sum("n_members"), F.lit(0)).cast("long").alias("n_members"),
            F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("long").alias("reclaimable"),
        )

    def ordered(self) -> DataFrame:
        """O2: all groups with their rank by reclaimable desc, size desc, group_id asc."""
        return ranked(self.groups, [F.desc("reclaimable"), F.desc("size_each"), F.asc("group_id")])


def find_duplicates(fingerprints: DataFrame, min_size: int = DEFAULT_MIN_SIZE,
                    managed: list[str] | None = None, hot_rows: int = DEFAULT_HOT_ROWS,
                    exclude_same_split: bool = False) -> Duplicates:
    """Group content-identical assets.

    ``fingerprints`` comes from ``fingerprint_payloads`` or the file hasher.
    ``managed`` lists preferred stores for the keeper (W1); the first member by
    ``asset_id`` is always available as ``group_id`` (W2).  With
    ``exclude_same_split`` (needs a ``split_group`` column) copies inside one
    split count once, so shards of one split never form a group together (D1).
    A ``physical_id`` column (device + inode, or a resolved link target) makes
    names of one physical file count once (D17).
    """
    managed = MANAGED_STORES if managed is None else list(managed)
    cands = fingerprints.where(F.col("ok") & (F.col("size") >= min_size) & (F.col("size") > 0))
    if exclude_same_split:
        # Keep one row per (content, split); other rows of the same split drop out.
        firsts = (cands.where(F.col("split_group").isNotNull())
                  .groupBy(*KEY, "split_group").agg(F.min("asset_id").alias("asset_id")))
        same_split = cands.where(F.col("split_group").isNotNull()).join(
            firsts, [*KEY, "split_group", "asset_id"], "left_anti")
        cands = cands.join(same_split.select("asset_id"), "asset_id", "left_anti")
    if "physical_id" in cands.columns:
        # Several names of one physical file (hard links) count once.
        firsts = cands.where(F.col("physical_id").isNotNull()).groupBy("physical_id").agg(
            F.min("asset_id").alias("asset_id"))
        linked = cands.where(F.col("physical_id").isNotNull()).join(firsts, ["physical_id", "asset_id"], "left_anti")
        cands = cands.join(linked.select("asset_id"), "asset_id", "left_anti")
    cands = materialize(cands.select("asset_id", "path", "store", *KEY))
    pref = F.col("store").isin(managed)
    groups = (cands.groupBy(*KEY)
              .agg(F.count(F.lit(1)).alias("n_members"),
                   F.min("asset_id").alias("group_id"),
                   F.coalesce(F.min(F.when(pref, F.col("asset_id"))), F.min("asset_id")).alias("keeper_id"),
                   # 64-bit store digests keep every buffer fixed-width, so this
                   # stays a hash aggregate (string min/max would force a sort).
                   (F.min(F.xxhash64("store")) != F.max(F.xxhash64("store"))).alias("spans_stores"))
              .where(F.col("n_members") > 1)
              .withColumn("size_each", F.col("size"))
              .withColumn("reclaimable", F.col("size") * (F.col("n_members") - F.lit(1))))
    groups = materialize(groups)
    return Duplicates(cands, groups, hot_rows)


def bucket_guard(fingerprints: DataFrame, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """Per (size, hash) bucket, do all members agree on head and tail?

    With a 256-bit hash a disagreement means a collision or a file changing
    while read; those buckets split into several groups in ``find_duplicates``.
    """
    cands = fingerprints.where(F.col("ok") & (F.col("size") >= min_size) & (F.col("size") > 0))
    return (cands.groupBy("size", "hash")
            .agg(F.count(F.lit(1)).alias("n"),
                 ((F.min(F.xxhash64("head_hash")) == F.max(F.xxhash64("head_hash"))) &
                  (F.min(F.xxhash64("tail_hash")) == F.max(F.xxhash64("tail_hash")))).alias("edges_agree"))
            .where(F.col("n") > 1))
