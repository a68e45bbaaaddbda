"""Verified archive moves with an undo manifest, and undo.

Tables are immutable, so "moving" a row means: write it to the archive
location, read the archive back and re-hash it, and only when every row
verifies append the manifest and publish the kept table to a *new* location.
Nothing that is being read is ever overwritten, and every step can be re-run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetsweep.functions.hashing import content_hash
from assetsweep.functions.scalars import BAD_LINE_DETAIL, BAD_LINE_PREVIEW
from assetsweep.operators.skew import DEFAULT_HOT_ROWS, join_members_to_groups
from assetsweep.schemas import UNDO_MANIFEST
from assetsweep.session import materialize

# Entries per manifest line: a run writes ceil(rows / this) lines, never one
# unbounded line.
ENTRIES_PER_LINE = 10_000


def destination_status(removal: DataFrame, existing_names: DataFrame, dest_name: F.Column,
                       hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """J6 + W4: can each planned row move to its destination name?

    ``destination_exists``: the archive already holds the name (J6);
    ``name_collision``: an earlier row (smaller ``asset_id``) of this batch takes
    the name first (W4); otherwise ``movable``.  The first row per name is an
    aggregate joined back with the hot-name split, not a window over the name.
    """
    # Read twice (names aggregate and the join back): materialize the narrow rows.
    rows = materialize(removal.withColumn("dest_name", dest_name))
    existing = existing_names.select(F.col("name").alias("dest_name")).distinct().withColumn("exists", F.lit(True))
    # One row per destination name (first id, count, already archived?), then a
    # single hot-name-safe join back to the rows.
    firsts = (rows.groupBy("dest_name").agg(F.min("asset_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .join(existing, "dest_name", "left"))
    rows = join_members_to_groups(rows, firsts, ["dest_name"], "n", hot_rows)
    status = (F.when(F.col("exists").isNotNull(), "destination_exists")
              .when(F.col("asset_id") != F.col("first_id"), "name_collision")
              .otherwise("movable"))
    return rows.withColumn("status", status).drop("first_id", "n", "exists")


def manifest_lines(entries: DataFrame, destination: str, created_unix: int,
                   per_line: int = ENTRIES_PER_LINE) -> DataFrame:
    """Manifest lines ``{created_unix, destination, entries[]}`` for one run.

    Entries are spread over ``ceil(n / per_line)`` lines by a hash of the source
    path, so no line (and no task) holds an unbounded list.
    """
    n = entries.count()
    buckets = max(1, -(-n // per_line))
    e = entries.select(F.struct(F.col("from"), F.col("to"), F.col("size").cast("long").alias("size"),
                                F.col("hash"), F.col("algo")).alias("entry"),
                       F.pmod(F.xxhash64(F.col("from")), F.lit(buckets)).alias("bucket"))
    return (e.groupBy("bucket").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
            .select(F.lit(int(created_unix)).cast("long").alias("created_unix"),
                    F.lit(destination).alias("destination"), "entries"))


def undo_lines(entries: DataFrame, created_unix: int, per_line: int = ENTRIES_PER_LINE) -> DataFrame:
    """Manifest lines of entries of many runs, at most about ``per_line`` of one ``destination`` in each."""
    n = entries.groupBy("destination").agg(F.count("*").alias("n"))
    e = entries.join(n, "destination").select(
        "destination", F.struct(F.col("from"), F.col("to"), F.col("size").cast("long").alias("size"), F.col("hash"), F.col("algo")).alias("entry"),
        F.pmod(F.xxhash64(F.col("from")), F.ceil(F.col("n") / per_line)).alias("bucket"))
    return (e.groupBy("destination", "bucket").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
            .select(F.lit(int(created_unix)).cast("long").alias("created_unix"), "destination", "entries"))


def append_manifest(lines: DataFrame, manifest_dir: str) -> None:
    lines.write.mode("append").json(manifest_dir)


def write_lines(lines: DataFrame, folder: str) -> str:
    """Writes manifest lines to a new folder ``run=...`` and returns its run; they count once a commit names it."""
    run = f"r{uuid.uuid4().hex}"
    lines.write.mode("errorifexists").json(f"{folder.rstrip('/')}/run={run}")
    return run


def committed_lines(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """Manifest lines below ``folder`` whose run is in ``runs``: one partitioned read, pruned by the runs."""
    lines = spark.read.option("basePath", folder).text(f"{folder}/run=*").where(F.trim(F.col("value")) != "")
    return parse_lines(lines.join(F.broadcast(runs.select("run")), "run", "left_semi"))


def read_manifest(spark: SparkSession, manifest_dir: str) -> DataFrame:
    """Manifest lines; blank lines skipped, a line that does not parse to a
    manifest with an ``entries`` list is kept whole in ``_corrupt``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(manifest_dir).where(F.trim(F.col("value")) != "")
    return parse_lines(lines)


def parse_lines(lines: DataFrame) -> DataFrame:
    schema = StructType([f for f in UNDO_MANIFEST.fields if f.name != "_corrupt"])
    parsed = lines.select("value", F.from_json("value", schema).alias("m"))
    good = F.col("m.entries").isNotNull()
    return parsed.select(
        F.when(good, F.col("m.created_unix")).alias("created_unix"),
        F.when(good, F.col("m.destination")).alias("destination"),
        F.when(good, F.col("m.entries")).alias("entries"),
        F.when(~good | F.col("m").isNull(), F.col("value")).alias("_corrupt"))


def manifest_entries(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, bad lines): one row per entry, and the unparsable lines' first characters."""
    bad = manifest.where(F.col("_corrupt").isNotNull()).select(
        F.substring(F.col("_corrupt"), 1, BAD_LINE_PREVIEW).alias("line"),
        F.lit(BAD_LINE_DETAIL).alias("detail"))
    good = (manifest.where(F.col("_corrupt").isNull())
            .select("created_unix", "destination", F.explode("entries").alias("e"))
            .select("created_unix", "destination", F.col("e.from").alias("from"), F.col("e.to").alias("to"),
                    F.col("e.size").alias("size"), F.col("e.hash").alias("hash"), F.col("e.algo").alias("algo")))
    return good, bad


def undo_status(entries: DataFrame, live: DataFrame, archived: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """What undo would do per manifest entry, tested in this order:

    ``occupied`` (the original path exists again), ``archive_missing`` (the
    archived copy is gone), ``hash_mismatch`` (the archived copy changed) or
    ``restore``.  ``live`` has ``path``; ``archived`` has ``path`` and ``hash``
    of the archived copies (recomputed from their content), and ``destination`` if
    several runs may hold the same path.  ``extra`` columns of the entries are kept.
    """
    lv = live.select(F.col("path").alias("from")).distinct().withColumn("live", F.lit(True))
    by = ["to", "destination"] if "destination" in archived.columns else ["to"]
    ar = archived.withColumnsRenamed({"path": "to", "hash": "archived_hash"}).select(*by, "archived_hash")
    j = entries.join(lv, "from", "left").join(ar, by, "left")
    status = (F.when(F.col("live").isNotNull(), "occupied")
              .when(F.col("archived_hash").isNull(), "archive_missing")
              .when(F.col("archived_hash") != F.col("hash"), "hash_mismatch")
              .otherwise("restore"))
    return j.select("from", "to", "size", *extra, status.alias("status"))


def write_archive(rows: DataFrame, archive_dir: str, run_id: str | None = None) -> str:
    """S9 step 1: write the rows being moved (with payload) under a new run folder."""
    run_id = run_id or f"r{uuid.uuid4().hex}"
    path = f"{archive_dir.rstrip('/')}/run={run_id}"
    rows.write.mode("errorifexists").parquet(path)
    return path
