"""Table adapters: turn lake tables into the ``assets`` shape.

An asset is a row with an id, a location, an owning store and a payload.  The
adapters only project and rename; Catalyst prunes every column a later step
does not read, so ``payload`` is never read when only sizes are needed.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_assets(df: DataFrame, id_col: str, text_col: str, store_col, path_col: Column | None = None
                ) -> DataFrame:
    """Generic adapter for a table whose payload is a text column (UTF-8 bytes)."""
    store = F.col(store_col) if isinstance(store_col, str) else store_col
    path = path_col if path_col is not None else F.concat(store, F.lit("/"), F.col(id_col).cast("string"))
    return df.select(
        F.col(id_col).cast("long").alias("asset_id"),
        path.alias("path"),
        F.element_at(F.split(path, "/"), -1).alias("name"),
        store.alias("store"),
        F.octet_length(F.col(text_col)).cast("long").alias("size"),
        F.encode(F.col(text_col), "UTF-8").alias("payload"),
    )


def documents_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as assets: store = source, path = source/lang/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return text_assets(docs, "doc_id", "text", "source", path)


def pages_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as assets: path = url, store = scheme+host, payload = html."""
    pages = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract(F.col("url"), r"^([a-z]+://[^/?#]*)", 1)
    return text_assets(pages, "page_id", "html", host, F.col("url"))


def conversations_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` turns as assets: store = role; the id pairs conv_id and turn.

    ``conv_id << 24 | turn`` is one-to-one below 2^39 conversations of 2^24 turns; a row
    beyond that fails the job instead of sharing an id.
    """
    conv = read_table(spark, sf_dir, "conversations")
    inside = F.col("conv_id").between(0, 2 ** 39 - 1) & F.col("turn").between(0, 2 ** 24 - 1)
    pair = F.shiftleft(F.col("conv_id").cast("long"), 24) + F.col("turn")
    unfit = F.raise_error(F.concat(F.lit("turn outside of the id range: "), F.concat_ws("/", "conv_id", "turn")))
    conv = conv.withColumn("turn_id", F.when(inside, pair).otherwise(unfit.cast("long")))
    path = F.concat_ws("/", F.col("role"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return text_assets(conv, "turn_id", "text", "role", path)

