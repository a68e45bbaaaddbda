"""Machine profiles (S5): GPU memory exports and RAM figures as a devices table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetsweep.sources.files import texts_of
from assetsweep.sources.listing import list_trees

MIB = 1024 * 1024


def read_vram_exports(spark: SparkSession, path: str) -> DataFrame:
    """One text file per device, one MiB figure per line (a GPU query's CSV output).

    Lines that do not parse as a whole number are dropped; a device whose file is empty
    or has no usable line gets an empty list (no GPU known).  Device = file stem.
    """
    stem = F.regexp_extract(F.col("name"), r"^(.*?)(\.[^.]*)?$", 1)
    files = list_trees(spark, [(None, path, None)], min_size=0).select("path", stem.alias("device"))
    lines = (texts_of(files).select("device", F.explode_outer(F.split("text", "\\R")).alias("value"))
             .select("device", F.expr("try_cast(trim(value) AS BIGINT)").alias("mib")))
    # Negative figures do not parse as unsigned; collect_list skips the nulls.
    usable = F.when(F.col("mib") >= 0, F.try_multiply(F.col("mib"), F.lit(MIB)))
    per_dev = lines.groupBy("device").agg(F.collect_list(usable).alias("vram"))
    return per_dev


def devices_table(vram: DataFrame, ram: DataFrame) -> DataFrame:
    """``(device, ram_total, vram)``: RAM figures (bytes, 0 = unknown) joined to GPU lists."""
    return (ram.select("device", F.col("ram_total").cast("long"))
            .join(vram, "device", "full_outer")
            .select("device", F.coalesce("ram_total", F.lit(0)).cast("long").alias("ram_total"),
                    F.coalesce("vram", F.array().cast("array<bigint>")).alias("vram")))
