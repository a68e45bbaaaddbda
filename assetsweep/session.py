"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins and coalesces partitions at
# run time; skew-join splitting is kept on as a second line of defence behind
# the explicit hot-key split in ``operators.skew``.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    # Duplicate metadata keys keep the last value (header key/value maps).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Checkpoint files in the shared folder are deleted once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "assetsweep", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster use the session you were given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("ASSETSWEEP_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``assetsweep`` importable in Python workers (header decoder, hashers).

    When the package is not installed on the executors, it is zipped once per
    application and added with ``addPyFile``; Spark distributes the archive.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="assetsweep-pkg-"), "assetsweep.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session (Spark also applies it to the context at start-up).
    Only with a local master (tests, a laptop) may it be unset; then a scratch folder
    is set on the context with ``setCheckpointDir``.  Any other master raises.
    """
    try:
        named = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # some deployments hide core settings from the SQL conf
        named = None
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return named or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    target = named or tempfile.mkdtemp(prefix="assetsweep-ckpt-")
    sc.setCheckpointDir(target)
    return target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, asked of the file system that Spark itself uses for the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether some file or folder matches a Hadoop glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used for small derived tables that several later stages read (fingerprints,
    group statistics) so an executor loss recomputes from the checkpoint and the
    expensive payload scan/hash is never repeated.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a CPU-heavy per-row stage at least one partition per core.

    Only used on narrow rows (keys, small strings), never on payload columns.
    A large input already has more scan partitions than cores and is returned
    unchanged, so this adds a shuffle only for inputs smaller than one wave.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    # Hash on the row itself: deterministic under task retries without the
    # local sort that a round-robin repartition needs for the same guarantee.
    return df.repartition(want, *df.columns)


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table built JVM-side (``inline`` over a literal array).

    ``spark.createDataFrame(list)`` would ship the rows through a Python RDD,
    so every read of it starts Python workers; this plan is pure JVM and
    Catalyst folds it like a ``VALUES`` list.  ``ddl`` is ``"a string, b long"``.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(ddl)
    names = schema.fieldNames()
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*names)
