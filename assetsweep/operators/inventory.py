"""Inventory: union of scans, predicates, store summaries, tag lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.functions import scalars as S


def union_scans(*scans: DataFrame) -> DataFrame:
    """All scans as one table; a path reached through two roots counts once.

    Meant for listings (no payload column): the de-duplication shuffles whole
    rows by path.  The row kept for a path is the smallest by its other columns
    (store first), so reruns agree.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    others = [c for c in both.columns if c != "path"]
    if not others:
        return both.distinct()
    return (both.groupBy("path").agg(F.min(F.struct(*others)).alias("_r"))
            .select("path", *[F.col("_r." + c).alias(c) for c in others]))


def looks_like_model(name_col="name", payload_col="payload", ext: str = "gguf") -> F.Column:
    """Wanted extension, or header magic, or a split-file name."""
    name = F.col(name_col)
    by_ext = F.coalesce(S.file_ext(name) == F.lit(ext), F.lit(False))
    by_magic = S.has_header_magic(F.col(payload_col))
    by_split = S.split_group_key(S.file_stem(name)).isNotNull()
    return by_ext | by_magic | by_split


def with_name_parts(assets: DataFrame) -> DataFrame:
    """Name, stem, extension and split group of every asset."""
    name = F.coalesce(F.col("name"), S.file_name(F.col("path")))
    stem = S.file_stem(name)
    return (assets.withColumn("name", name)
            .withColumn("stem", stem)
            .withColumn("ext", S.file_ext(name))
            .withColumn("split_group", S.split_group_key(stem)))


def totals(assets: DataFrame) -> DataFrame:
    """A1: number of assets and bytes."""
    return assets.agg(F.count(F.lit(1)).alias("total_files"),
                      F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def per_store(assets: DataFrame, store_col: str = "store") -> DataFrame:
    """A2: count and bytes per store value."""
    return assets.groupBy(store_col).agg(F.count(F.lit(1)).alias("files"),
                                         F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def store_summaries(assets: DataFrame, stores: DataFrame, boundary: bool = True) -> DataFrame:
    """Per store root, count and bytes of the assets whose path starts with the root.

    ``boundary=True`` (default): the root must end at a ``/`` of the path, so
    ``/a/b`` does not count ``/a/bc/x``; ``boundary=False`` is the plain string-prefix
    test (D5).  A path can only start with a root if its first characters, as
    many as the root has, are the root.  So each path is cut at the different
    root lengths, the pieces are counted with map-side combine (a hot directory
    is one row per task) and equi-joined with the roots: any number of roots,
    no comparison of every asset with every root.  The driver only learns the
    different lengths, at most as many as a path has characters.

    Stores without assets are kept with zero counts.
    """
    if "missing" not in stores.columns:
        stores = stores.withColumn("missing", F.lit(False))
    root = F.col("root")
    if boundary:
        root = F.when(root == "/", F.lit("")).when(root.endswith("/"), F.regexp_replace("root", "/+$", "")).otherwise(root)
    keyed = stores.select("kind", "root", root.alias("prefix")).distinct()
    lengths = sorted(r[0] for r in keyed.where("prefix is not null").select(F.length("prefix")).distinct().collect())
    path = F.col("path")
    fits = (lambda n: (n == F.length(path)) | (F.substr(path, n + 1, F.lit(1)) == "/")) if boundary else (lambda n: F.lit(True))
    cuts = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    cuts = F.filter(cuts, lambda n: (n <= F.length(path)) & fits(n))
    pieces = assets.select(F.explode(F.transform(cuts, lambda n: F.substr(path, F.lit(1), n))).alias("prefix"), "size")
    per_prefix = pieces.groupBy("prefix").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    matched = keyed.join(per_prefix, "prefix").select("kind", "root", "files", "bytes")
    return (stores.join(matched, ["kind", "root"], "left")
            .select("kind", "root",
                    F.coalesce("files", F.lit(0)).cast("long").alias("files"),
                    F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
                    F.col("missing").cast("boolean").alias("missing")))


def attach_tags(assets: DataFrame, tags: DataFrame) -> DataFrame:
    """Blob name -> tag, one row per blob name (``tags`` from ``manifest_tags``).

    ``tags`` has one row per blob name but its size grows with the manifests, so
    Spark chooses the join strategy (AQE turns it into a broadcast when small).
    """
    t = tags.select(F.col("blob").alias("name"), "tag")
    return assets.join(t, "name", "left")


def shard_rollup(assets: DataFrame) -> DataFrame:
    """Size and shard count per split group (an unsplit asset is its own group)."""
    key = F.coalesce(F.col("split_group"), F.col("path"))
    return (assets.groupBy(key.alias("model_key"))
            .agg(F.count(F.lit(1)).alias("shards"),
                 F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("weights_bytes")))
