"""Schemas of the tables the library reads and writes."""

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DecimalType, DoubleType,
                               IntegerType, LongType, StringType, StructField, StructType)

U64 = DecimalType(20, 0)
# Largest unsigned 64-bit value; saturating arithmetic clamps here.
U64_MAX = 18446744073709551615

ASSETS = StructType([
    StructField("asset_id", LongType(), False),
    StructField("path", StringType(), True),
    StructField("name", StringType(), True),
    StructField("store", StringType(), True),
    StructField("size", LongType(), True),
    StructField("payload", BinaryType(), True),
])

FINGERPRINT = StructType([
    StructField("asset_id", LongType(), False),
    StructField("path", StringType(), True),
    StructField("store", StringType(), True),
    StructField("size", LongType(), True),
    StructField("hash", StringType(), True),
    StructField("head_hash", StringType(), True),
    StructField("tail_hash", StringType(), True),
    StructField("algo", StringType(), True),
    StructField("ok", BooleanType(), True),
    StructField("error", StringType(), True),
])

STORES = StructType([
    StructField("kind", StringType(), True),
    StructField("root", StringType(), True),
    StructField("missing", BooleanType(), True),
])

DEVICES = StructType([
    StructField("device", StringType(), True),
    StructField("ram_total", LongType(), True),
    StructField("vram", ArrayType(LongType()), True),
])

MANIFEST_JSON = StructType([
    StructField("schemaVersion", IntegerType(), True),
    StructField("config", StructType([StructField("digest", StringType(), True)]), True),
    StructField("layers", ArrayType(StructType([
        StructField("digest", StringType(), True),
        StructField("mediaType", StringType(), True),
        StructField("size", LongType(), True),
    ])), True),
])

ARCHIVE_ENTRY = StructType([
    StructField("from", StringType(), True),
    StructField("to", StringType(), True),
    StructField("size", LongType(), True),
    StructField("hash", StringType(), True),
    StructField("algo", StringType(), True),
])

UNDO_MANIFEST = StructType([
    StructField("created_unix", LongType(), True),
    StructField("destination", StringType(), True),
    StructField("entries", ArrayType(ARCHIVE_ENTRY), True),
    StructField("_corrupt", StringType(), True),
])

HEADERS = StructType([
    StructField("path", StringType(), True),
    StructField("version", IntegerType(), True),
    StructField("tensor_count", LongType(), True),
    StructField("kv_count", LongType(), True),
    StructField("error", StringType(), True),
])

HEADER_KV = StructType([
    StructField("path", StringType(), True),
    StructField("pos", IntegerType(), True),
    StructField("key", StringType(), True),
    StructField("type", StringType(), True),
    StructField("v_int", U64, True),
    StructField("v_float", DoubleType(), True),
    StructField("v_bool", BooleanType(), True),
    StructField("v_str", StringType(), True),
    StructField("v_arr", ArrayType(StringType()), True),
])

HEADER_TENSORS = StructType([
    StructField("path", StringType(), True),
    StructField("pos", IntegerType(), True),
    StructField("name", StringType(), True),
    StructField("dims", ArrayType(U64), True),
    StructField("type_id", LongType(), True),
    StructField("offset", U64, True),
])
