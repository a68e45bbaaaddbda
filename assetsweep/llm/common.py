"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assetsweep.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, its size is known."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) of a URI or local path; Hadoop's names for S3 are mapped to Arrow's."""
    from pyarrow import fs
    scheme, sep, rest = uri.partition("://")
    if sep and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    elif uri.startswith("file:/") and not sep:
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
