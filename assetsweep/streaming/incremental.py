"""Incremental fingerprinting: hash each file once, keep the results as a table.

Re-running duplicate detection over a lake should not re-read files that have
not changed.  Fingerprints are kept in a table keyed by
``(path, size, modificationTime)``:

* ``refresh_fingerprints`` (batch): anti-join the current listing against the
  table and hash only new or changed files.
* ``fingerprint_stream`` (Structured Streaming): a ``binaryFile`` file stream
  over a landing root; each micro-batch lists only files the stream has not
  seen, hashes them in tasks and appends their rows.  ``availableNow`` runs
  it as an incremental batch job; the checkpoint makes it resumable.

A row counts only if it was read without error and with the wanted algorithm:
failed reads are tried again on the next run.  Readers take the newest good row
per path with ``latest_fingerprints``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from assetsweep.session import materialize
from assetsweep.sources import files as FS

KEY = ["path", "size", "modificationTime"]
# The fixed schema of Spark's binaryFile source (file streams need it given).
BINARY_FILE_SCHEMA = StructType([
    StructField("path", StringType(), False), StructField("modificationTime", TimestampType(), False),
    StructField("length", LongType(), False), StructField("content", BinaryType(), True)])


def refresh_fingerprints(listing: DataFrame, cache: DataFrame | None, algo: str = "sha256") -> DataFrame:
    """Fingerprint rows for listed files that the cache does not hold yet.

    ``listing`` comes from ``files.list_files`` (with ``asset_id``); the result
    carries ``modificationTime`` so it can be appended to the cache.
    """
    todo = listing
    if cache is not None:
        good = cache.where(F.col("ok") & (F.col("algo") == algo))
        todo = materialize(listing.join(good.select(*KEY), KEY, "left_anti"))
    fp = FS.hash_files(todo, algo)
    return fp.join(todo.select("path", "modificationTime"), "path")


def latest_fingerprints(cache: DataFrame, algo: str = "sha256") -> DataFrame:
    """Newest good fingerprint per path (a rewritten file supersedes its old row)."""
    good = cache.where(F.col("ok") & (F.col("algo") == algo))
    others = [c for c in cache.columns if c not in ("path", "modificationTime")]
    newest = good.groupBy("path").agg(F.max(F.struct("modificationTime", *others)).alias("r"))
    return newest.select(*["path" if c == "path" else F.col("r")[c].alias(c) for c in cache.columns])


def fingerprint_stream(spark: SparkSession, root: str, table_path: str, checkpoint_location: str,
                       glob: str | None = "*.gguf", store: str | None = None, algo: str = "sha256",
                       available_now: bool = True, max_files_per_trigger: int | None = None
                       ) -> StreamingQuery:
    """Start the incremental fingerprinting stream; returns the running query.

    Each micro-batch is written to ``table_path/batch=<id>`` with overwrite, so a
    batch replayed after a failure replaces its own output (exactly-once table).
    """
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    listed = reader.load(root).select("path", F.col("length").alias("size"), "modificationTime")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        files = FS.with_asset_ids(batch.where(F.col("size") > 0).withColumn(
            "store", F.lit(store).cast("string")))
        out = FS.hash_files(files, algo).join(files.select("path", "modificationTime"), "path")
        out.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/batch={batch_id}")

    writer = listed.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
