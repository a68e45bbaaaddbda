"""Registry manifests: blob digest -> ``model:tag``.

A manifest is a small JSON file at ``<manifests root>/<registry>/<namespace...>/<model>/<tag>``
whose ``layers[].digest`` name the blobs of that model.  Files are listed and read whole
in tasks, one row per file, parsed as variants and exploded.  A layer that is
no object, or whose digest is no string, is passed over; the other layers of its
manifest count.  A file right below a registry is no manifest.  A digest named by
several manifests keeps ``min(tag)`` and the number of references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetsweep.functions import scalars as S
from assetsweep.sources.files import texts_of
from assetsweep.sources.listing import list_trees, local_path


def read_manifest_files(spark: SparkSession, manifests_root: str) -> DataFrame:
    """(rel_path, json) for every file below the manifests root."""
    root = local_path(manifests_root.rstrip("/"))
    root = manifests_root.rstrip("/") if root is None else f"file:{root}"
    files = list_trees(spark, [(None, root, None)]).select("path")
    return texts_of(files).select(F.substring("path", len(root) + 2, 1 << 30).alias("rel_path"), F.col("text").alias("json"))


def manifest_layers(manifests: DataFrame) -> DataFrame:
    """One row per (manifest, layer digest); unparsable JSON and unfit layers are passed over."""
    deep = F.size(F.split("rel_path", "/")) >= 3
    layers = F.try_variant_get(F.try_parse_json("json"), "$.layers", "array<variant>")
    digest = F.try_variant_get("layer", "$.digest", "variant")
    return (manifests.where(deep).select(S.manifest_tag(F.col("rel_path")).alias("tag"), F.explode(layers).alias("layer"))
            .where(F.schema_of_variant(digest) == "STRING")
            .select("tag", F.try_variant_get("layer", "$.digest", "string").alias("digest"))
            .select("tag", "digest", S.digest_to_blob(F.col("digest")).alias("blob")))


def manifest_tags(manifests: DataFrame) -> DataFrame:
    """Blob name -> tag.  One row per blob (partial aggregation on a hot blob)."""
    return (manifest_layers(manifests).groupBy("blob")
            .agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n_refs")))
