"""Content identity: full-payload hash plus head/tail window hashes.

All three are built-in JVM expressions evaluated in the scan stage, so only
``(size, hash, head_hash, tail_hash, asset_id, ...)`` ever reaches a shuffle.
The algorithm name is recorded next to every stored hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetsweep.functions.scalars import EDGE_BYTES
from assetsweep.session import materialize

SUPPORTED = ("sha256", "md5", "sha256-tree")

# Scheme of ``sha256-tree``: the content is cut into ranges of RANGE_BYTES (an empty one has one empty range).  A leaf is
# SHA-256 of 00 and a range, a node SHA-256 of 01 and up to FANOUT digests of the level below in order, until one
# is left; the hash is SHA-256 of 02, the size as 8 bytes (big-endian) and that digest.
TREE = "sha256-tree"
RANGE_BYTES = 64 * 1024 * 1024
FANOUT = 1024
LEAF, NODE, ROOT = b"\x00", b"\x01", b"\x02"


def _digest(prefix: bytes, *parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(prefix), *parts), 256))


def tree_root(size, top: Column) -> Column:
    """The hash (hex) from the size and the top digest."""
    s = F.col(size) if isinstance(size, str) else size
    return F.sha2(F.concat(F.lit(ROOT), F.unhex(F.lpad(F.hex(s.cast("long")), 16, "0")), top), 256)


def fold(leaves: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, ``digest``) from (keys, ``no``, ``digest``): the top of the tree over each key's digests in order of ``no``.

    Each round is an aggregate over at most ``fanout`` digests, so no group grows with the file; a file of n ranges takes
    log(n) rounds, all files together.
    """
    most = leaves.agg(F.max("no")).first()[0]
    while most:
        of = leaves.groupBy(*keys, F.floor(F.col("no") / fanout).alias("no"))
        joined = of.agg(F.sort_array(F.collect_list(F.struct(F.col("no").alias("k"), "digest"))).alias("d"))
        below = F.aggregate("d", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["digest"]))
        alone = (F.size("d") == 1) & (F.col("no") == 0)  # the only digest of its level is the top already
        leaves = materialize(joined.select(*keys, "no", F.when(alone, F.col("d")[0]["digest"]).otherwise(_digest(NODE, below)).alias("digest")))
        most //= fanout
    return leaves.select(*keys, "digest")


def tree_hash(payload: Column, size: Column, range_bytes: int = RANGE_BYTES) -> Column:
    """``sha256-tree`` of a column; a value below 2 GB has at most 32 ranges, so one node is over its leaves."""
    n = F.greatest(F.lit(1), F.ceil(size / range_bytes)).cast("int")
    leaf = lambda i: _digest(LEAF, F.substring(payload, i * range_bytes + 1, F.lit(range_bytes)))
    leaves = F.transform(F.sequence(F.lit(0), n - 1), leaf)
    below = F.aggregate(leaves, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return tree_root(size, F.when(n == 1, leaves[0]).otherwise(_digest(NODE, below)))


def content_hash(payload, algo: str = "sha256") -> Column:
    p = F.col(payload) if isinstance(payload, str) else payload
    if algo == "sha256":
        return F.sha2(p, 256)
    if algo == "md5":
        return F.md5(p)
    if algo == TREE:
        return tree_hash(p, F.octet_length(p))
    raise ValueError(f"unsupported hash algorithm {algo!r}; use one of {SUPPORTED}")


def head_slice(payload) -> Column:
    p = F.col(payload) if isinstance(payload, str) else payload
    return F.substring(p, 1, EDGE_BYTES)


def tail_slice(payload, size) -> Column:
    """Last ``EDGE_BYTES`` bytes; the whole payload when it is shorter."""
    p = F.col(payload) if isinstance(payload, str) else payload
    s = F.col(size) if isinstance(size, str) else size
    start = F.greatest(s - F.lit(EDGE_BYTES - 1), F.lit(1)).cast("int")
    return F.substring(p, start, F.lit(EDGE_BYTES))


def fingerprint_columns(payload="payload", size="size", algo: str = "sha256") -> list[Column]:
    """Content, head and tail hash; a payload within one window is hashed once and
    has its own hash as head and tail (Spark evaluates the shared expression once)."""
    p = F.col(payload) if isinstance(payload, str) else payload
    whole = content_hash(p, algo)
    if algo == TREE:  # windows are hashed plainly
        return [whole.alias("hash"), content_hash(head_slice(payload)).alias("head_hash"),
                content_hash(tail_slice(payload, size)).alias("tail_hash"), F.lit(algo).alias("algo")]
    short = F.octet_length(p) <= EDGE_BYTES
    return [
        whole.alias("hash"),
        F.when(short, whole).otherwise(content_hash(head_slice(payload), algo)).alias("head_hash"),
        F.when(short, whole).otherwise(content_hash(tail_slice(payload, size), algo)).alias("tail_hash"),
        F.lit(algo).alias("algo"),
    ]
