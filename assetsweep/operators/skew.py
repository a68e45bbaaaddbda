"""Joining many member rows to one row per group when some groups are huge.

A single duplicate group (boilerplate copied millions of times) may hold a third
of all rows.  A plain shuffle join would send that whole group to one task.  We
split instead: groups above ``hot_rows`` members are few by construction (at most
``total_rows / hot_rows``); if they are too many to broadcast, ``hot_rows`` is doubled
until they fit.  They are joined map-side; every remaining row goes through an ordinary shuffle join in
which no key exceeds ``hot_rows``.  AQE skew-join stays enabled as a backstop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.session import materialize

# Groups with more members than this are joined map-side.
DEFAULT_HOT_ROWS = 1_000_000
# Never broadcast more hot group rows than this.
MAX_HOT_KEYS = 200_000


def join_members_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str],
                           count_col: str = "n_members", hot_rows: int = DEFAULT_HOT_ROWS,
                           how: str = "inner") -> DataFrame:
    """Join ``rows`` (many per key) to ``groups`` (one per key) without a hot task.

    ``groups`` should be materialized: its hot-key count is read with one small job.
    ``how`` is ``inner`` or ``left`` (rows without a group are kept with nulls).
    """
    hot = groups.where(F.col(count_col) > hot_rows)
    n_hot = hot.count()
    while n_hot > MAX_HOT_KEYS:
        # Too many to broadcast: only the hotter ones are split off, so that the
        # split always happens and no ordinary key exceeds the raised threshold.
        hot_rows *= 2
        hot = groups.where(F.col(count_col) > hot_rows)
        n_hot = hot.count()
    if n_hot == 0:
        return rows.join(groups, keys, how)
    hot_keys = F.broadcast(hot.select(*keys))
    hot_part = rows.join(F.broadcast(hot), keys, "inner")
    cold_rows = rows.join(hot_keys, keys, "left_anti")
    cold_part = cold_rows.join(groups.where(F.col(count_col) <= hot_rows), keys, how)
    return hot_part.unionByName(cold_part)


# An id set up to this many rows is broadcast as 64-bit hashes (8 bytes each) to pick rows out of a wide table.
MAX_BROADCAST_IDS = 5_000_000
# Above it, a Bloom filter of at most this many bits (256 MB) is broadcast instead, one after the other if one does not hold them.
FILTER_BITS = 1 << 31
# Bits per id and positions set per id: 0.4 % of other ids pass by calculation.
BITS_PER_ID = 12
POSITIONS = 6
# Spark's bitmap aggregates work on blocks of this many bits.
BLOCK_BITS = 1 << 15


def _hash(key: str, part: int = 0) -> F.Column:
    return F.xxhash64(F.lit(part), key) if part else F.xxhash64(key)


def _positions(key: str) -> F.Column:
    """``POSITIONS`` bit numbers inside the block of an id, 15 bits each of two further hashes."""
    bits = [F.shiftrightunsigned(_hash(key, 1 + k // 4), 15 * (k % 4)).bitwiseAND(BLOCK_BITS - 1) for k in range(POSITIONS)]
    return F.array(*bits)


def bloom_filter(ids: DataFrame, key: str, blocks: int) -> DataFrame:
    """(``_block``, ``_words``): a blocked Bloom filter, each block as 512 longs; at most ``blocks`` rows of 4 KB.

    An id belongs to one block by its hash and sets bits in it.  Blocks are made by aggregates with map-side
    combine, so hot blocks and repeated ids cost nothing.
    """
    bits = ids.select(F.pmod(_hash(key), F.lit(blocks)).alias("_block"), F.explode(_positions(key)).alias("_bit"))
    maps = bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    # A long from 8 bytes; byte k of a bitmap holds the bits 8k to 8k + 7, the lowest first.
    word = lambda k: F.conv(F.hex(F.substring("_map", k * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), word)
    return materialize(maps.select("_block", words.alias("_words")))


def _in_filter(key: str) -> F.Column:
    """Whether all bits of an id are set in ``_words``."""
    def is_set(bit):
        place = 8 * (7 - (bit % 64 / 8).cast("int")) + (bit % 8).cast("int")
        return F.getbit(F.get(F.col("_words"), (bit / 64).cast("int")), place) == 1
    return F.forall(_positions(key), is_set)


def filter_by_ids(wide: DataFrame, ids: DataFrame, key: str = "asset_id", keep: bool = True,
                  max_ids: int = MAX_BROADCAST_IDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``wide`` whose ``key`` is (``keep``) or is not in ``ids``; a null key is in no set.

    ``wide`` may carry payloads, which a shuffle join would move.  Up to ``max_ids`` ids are broadcast as hashes; above
    that a Bloom filter whose size is bounded by ``filter_bits`` is.  Either way a row that does not pass is decided in its scan
    task, and the rows that do go to an exact join: with ``keep`` those are the wanted rows and few others.  Ids that one
    filter cannot hold are split by hash into parts of equal expected size, each with a filter and a scan of its own over the rows of its
    part, so no filter exceeds the bound and its share of false positives stays.
    """
    id_rows = ids.select(key).where(F.col(key).isNotNull()).distinct()
    how = "left_semi" if keep else "left_anti"
    n = id_rows.count()
    if n <= max_ids:
        if _fixed_width(wide, key):
            return wide.join(F.broadcast(id_rows), key, how)
        hashes = F.broadcast(id_rows.select(_hash(key).alias("_hash")).distinct())
        marked = wide.withColumn("_hash", _hash(key)).join(hashes.withColumn("_hit", F.lit(True)), "_hash", "left")
        return _decided(marked.withColumn("_hit", F.col("_hit").isNotNull()), wide, id_rows, key, keep)
    blocks = max(1, filter_bits // BLOCK_BITS)
    parts = -(-n * BITS_PER_ID // (blocks * BLOCK_BITS))
    blocks = min(blocks, -(-n * BITS_PER_ID // (parts * BLOCK_BITS)))
    part = F.pmod(_hash(key, 9), F.lit(parts))
    out = None
    for k in range(parts):
        own = (part == k) if parts > 1 else F.lit(True)
        rows, own_ids = (wide, id_rows) if parts == 1 else (wide.where(own), id_rows.where(own))
        filter_ = F.broadcast(bloom_filter(own_ids, key, blocks))
        marked = rows.withColumn("_block", F.pmod(_hash(key), F.lit(blocks))).join(filter_, "_block", "left")
        marked = marked.withColumn("_hit", F.col("_words").isNotNull() & F.coalesce(_in_filter(key), F.lit(False)))
        found = _decided(marked, wide, own_ids, key, keep)
        out = found if out is None else out.unionByName(found)
    return out


def _fixed_width(df: DataFrame, key: str) -> bool:
    return df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "date", "timestamp")


def _decided(marked: DataFrame, wide: DataFrame, ids: DataFrame, key: str, keep: bool) -> DataFrame:
    """Rows with ``_hit`` go to an exact join, the others are decided."""
    maybe = marked.where("_hit").select(*wide.columns).join(ids, key, "left_semi" if keep else "left_anti").select(*wide.columns)
    return maybe if keep else marked.where("not _hit").select(*wide.columns).unionByName(maybe)
