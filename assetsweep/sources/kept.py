"""Rows kept between runs, keyed by file version.

A kept table is a folder of batches, ``rows/run=...``, and a commit log that says which count: batches are added, and a
snapshot replaces all before it.  Two runs may add at once; a batch without a commit is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from assetsweep.operators.commits import CommitLog

# What makes a file the same as before.
VERSION = ["path", "size", "modificationTime"]


class KeptRows:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.log = CommitLog(spark, f"{self.folder}/log")

    def rows(self, upto: int | None = None) -> DataFrame:
        """The rows that count, as of commit ``upto``: one partitioned read, pruned by the batches."""
        commits = self.log.records()
        if upto is not None:
            commits = commits.where(F.col("version") <= upto)
        newest = commits.where(F.col("kind") == "snapshot").orderBy(F.desc("version")).select("version", "covers").first()
        version, covers = (-1, -1) if newest is None else (newest.version, newest.covers)
        # The newest snapshot, and what was added after it was read, even if that was committed before it.
        live = commits.where((F.col("version") == version) | ((F.col("kind") == "add") & (F.col("version") > covers)))
        if not live.limit(1).count():
            return self.spark.createDataFrame([], self.schema)
        data = self.spark.read.schema(StructType([*self.schema.fields, StructField("run", StringType())])).parquet(f"{self.folder}/rows")
        return data.join(F.broadcast(live.select("run")), "run", "left_semi").select(*self.schema.fieldNames())

    def _write(self, rows: DataFrame) -> str:
        run = f"r{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.folder}/rows/run={run}")
        return run

    def add(self, rows: DataFrame) -> int:
        run = self._write(rows)
        return self.log.commit(self.log.latest(), {"kind": "add", "run": run, "covers": -1}, lambda first, last: None)

    def compact(self, listing: DataFrame) -> int:
        """Replaces all batches by one that holds only rows of file versions in ``listing``."""
        seen = self.log.latest()
        run = self._write(self.rows(seen).join(listing.select(*VERSION).distinct(), VERSION, "left_semi"))
        return self.log.commit(seen, {"kind": "snapshot", "run": run, "covers": seen}, lambda first, last: None)
