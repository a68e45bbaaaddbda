"""Capacity fit: which model fits which machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.functions import scalars as S
from assetsweep.session import literal_table

# Device tables up to this many rows are broadcast; larger ones join without a hint.
BROADCAST_DEVICES = 10_000
_DEVICE = "device string, ram_total bigint, vram array<bigint>"


def capacity_fit(catalog: DataFrame, devices: DataFrame | list[tuple],
                 contexts: list[int] | None = None) -> DataFrame:
    """Estimate memory per (model, device, context) and judge the fit.

    ``catalog`` needs ``weights_bytes, n_layers, n_embd, n_head, n_head_kv`` and may
    carry ``context_length`` (any u64; used when ``contexts`` is None, default 8192).
    The estimate is computed once per (model, context).  Every model meets every
    device, which is what the operator is for: a device table whose row count is
    checked is broadcast, so the catalog is not shuffled; any larger one is joined
    as Spark sees fit.
    """
    spark = catalog.sparkSession
    if not isinstance(devices, DataFrame):
        devices = literal_table(spark, list(devices), _DEVICE)
    devices = devices.select(F.struct(F.col("device").cast("string").alias("device"), F.col("ram_total").cast("long").alias("ram_total"),
                                      F.coalesce(F.col("vram").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("vram")).alias("dev"))
    if contexts is None:
        given = F.col("context_length") if "context_length" in catalog.columns else F.lit(None)
        ctx = F.array(F.coalesce(given.cast("decimal(20,0)"), F.lit(S.DEFAULT_CONTEXT).cast("decimal(20,0)")))
    else:
        ctx = F.array(*[F.lit(int(c)).cast("long") for c in contexts])
    rows = catalog.withColumn("context_tokens", F.explode(ctx))
    kv = S.kv_cache_bytes("weights_bytes", "n_layers", "n_embd", "n_head", "n_head_kv", "context_tokens")
    rows = (rows.withColumn("kv_cache_bytes", kv)
            .withColumn("total_estimate_bytes", S.total_estimate(F.col("weights_bytes"), F.col("kv_cache_bytes"))))
    few = devices.limit(BROADCAST_DEVICES + 1).count() <= BROADCAST_DEVICES
    rows = rows.crossJoin(F.broadcast(devices) if few else devices)
    gpu, ram, note = S.fit_verdict(F.col("total_estimate_bytes"), F.col("dev.ram_total"), F.col("dev.vram"))
    return rows.select(
        *[c for c in catalog.columns if c not in ("context_length",)],
        F.col("dev.device").alias("device"),
        "context_tokens",
        F.col("kv_cache_bytes").cast("decimal(20,0)").alias("kv_cache_bytes"),
        F.lit(S.RUN_OVERHEAD_BYTES).cast("long").alias("overhead_bytes"),
        F.col("total_estimate_bytes").cast("decimal(20,0)").alias("total_estimate_bytes"),
        F.array_max(F.col("dev.vram")).alias("largest_gpu"),
        gpu.alias("fits_largest_gpu"), ram.alias("fits_all_ram"), note.alias("note"))


def with_shard_weights(catalog: DataFrame, assets: DataFrame) -> DataFrame:
    """``weights_bytes`` = bytes of all shards of the file's model.

    ``assets`` needs ``path, size, split_group`` (from ``inventory.with_name_parts``);
    a file outside any split weighs its own size.  Both joins are on keys with
    one row per file or per model, so no join key is hot.
    """
    key = F.coalesce(F.col("split_group"), F.col("path"))
    keyed = assets.select("path", key.alias("model_key"))
    totals = (assets.groupBy(key.alias("model_key"))
              .agg(F.sum("size").cast("long").alias("weights_bytes"), F.count(F.lit(1)).alias("shards")))
    base = catalog.drop("weights_bytes") if "weights_bytes" in catalog.columns else catalog
    return base.join(keyed, "path", "left").join(totals, "model_key", "left").drop("model_key")
