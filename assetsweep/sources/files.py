"""Assets that are files under lake directories.

Trees are listed by tasks (``sources.listing``), every name included.  Content is read only by the
hashing and prefix workers, which stream each file in bounded blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.functions import hashing as H
from assetsweep.functions.scalars import EDGE_BYTES
from assetsweep.operators.ranking import balanced
from assetsweep.schemas import FINGERPRINT
from assetsweep.session import materialize
from assetsweep.sources.headers import READ_ERRORS, _open_path
from assetsweep.sources.listing import list_trees

HASH_BLOCK = 1024 * 1024
# Bytes of file content one hashing task should read.
TASK_BYTES = 512 * 1024 * 1024


def list_files(spark: SparkSession, root: str, glob: str | None = "*.gguf", store: str | None = None,
               min_size: int = 1) -> DataFrame:
    """Regular non-empty files below ``root`` whose name matches ``glob``."""
    return list_trees(spark, [(store, root, glob)], max(1, min_size))


def scan_stores(spark: SparkSession, stores: list[tuple[str, str, str | None]]) -> DataFrame:
    """U1 over several ``(kind, root, glob)`` scans; a path seen twice counts once."""
    both = list_trees(spark, stores)
    # Deterministic choice for a path listed under two roots: the smallest store name.
    return (both.groupBy("path").agg(F.min(F.struct("store", "name", "size", "modificationTime")).alias("r"))
            .select("path", "r.name", "r.store", "r.size", "r.modificationTime"))


def with_asset_ids(files: DataFrame) -> DataFrame:
    """A stable id per path: 63 bits of its SHA-256, so reruns agree.

    Jobs that remove or archive files match on the path, so two paths that share an id stay apart.
    """
    digest = F.sha2(F.col("path"), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return files.withColumn("asset_id", F.shiftleft(high.bitwiseAND(2 ** 31 - 1), 32).bitwiseOR(low))


def _prefix_rows(it, n: int):
    schema = pa.schema([("path", pa.string()), ("prefix", pa.binary())])
    for batch in it:
        paths, out = batch.column("path").to_pylist(), []
        for p in paths:
            try:
                f, _ = _open_path(p)
                with f:
                    out.append(f.read(n))
            except READ_ERRORS:
                out.append(None)
        yield pa.RecordBatch.from_pydict({"path": paths, "prefix": out}, schema=schema)


def _text_rows(it, most: int):
    for batch in it:
        for k, p in enumerate(batch.column("path").to_pylist()):
            try:
                f, _ = _open_path(p)
                with f:
                    text = f.read(most + 1)
            except READ_ERRORS:
                text = None
            good = text is not None and len(text) <= most
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(k, 1).columns, pa.array([text.decode("utf-8", "replace") if good else None], pa.string())],
                names=[*batch.schema.names, "text"])


def texts_of(files: DataFrame, most: int = 16 * 1024 * 1024) -> DataFrame:
    """``files`` plus ``text``, the whole content of small files, read in tasks; null if unreadable or over ``most`` bytes."""
    schema = T.StructType([*files.schema.fields, T.StructField("text", T.StringType())])
    return files.mapInArrow(lambda it: _text_rows(it, most), schema)


def read_prefixes(files: DataFrame, n: int = 4) -> DataFrame:
    """First ``n`` bytes of each file (null when unreadable), read in tasks."""
    return files.select("path").mapInArrow(lambda it: _prefix_rows(it, n), "path string, prefix binary")


def with_magic(files: DataFrame) -> DataFrame:
    """``has_magic`` per file from its first four bytes; short or unreadable = false."""
    from assetsweep.functions.scalars import HEADER_MAGIC_HEX
    pref = read_prefixes(files, 4)
    flag = F.coalesce(F.hex(F.col("prefix")) == F.lit(HEADER_MAGIC_HEX), F.lit(False))
    return files.join(pref.select("path", flag.alias("has_magic")), "path", "left") \
        .withColumn("has_magic", F.coalesce("has_magic", F.lit(False)))


def select_models(files: DataFrame, ext: str = "gguf", blob_store: str = "ollama") -> DataFrame:
    """Which listed files are models.

    In the blob store: names that start with ``sha256-`` whose content has the header
    magic.  Elsewhere: the wanted extension, or a split-file name, or the magic.  Only
    files that their name does not decide are opened, for four bytes, in tasks.
    """
    from assetsweep.functions import scalars as S
    stem, name = S.file_stem(F.col("name")), F.col("name")
    blob = F.coalesce(F.col("store") == blob_store, F.lit(False))
    named = ~blob & (F.coalesce(S.file_ext(name) == ext, F.lit(False)) | S.split_group_key(stem).isNotNull())
    ask = ~named & (~blob | name.startswith("sha256-"))
    by_magic = with_magic(files.where(ask)).where("has_magic").drop("has_magic")
    return files.where(named).unionByName(by_magic.select(*files.columns))


def _identity_rows(it):
    import os
    schema = pa.schema([("path", pa.string()), ("physical_id", pa.string())])
    for batch in it:
        paths, out = batch.column("path").to_pylist(), []
        for p in paths:
            found = None
            if p.startswith("file:") or "://" not in p:
                local = p[5:] if p.startswith("file:") else p
                try:
                    s = os.stat("/" + local.lstrip("/"))  # follows links, so a link has its target's identity
                    found = f"{s.st_dev}:{s.st_ino}"
                except OSError:
                    found = None
            out.append(found)
        yield pa.RecordBatch.from_pydict({"path": paths, "physical_id": out}, schema=schema)


def physical_ids(files: DataFrame) -> DataFrame:
    """Device and inode per local path (hard links and links share it); null on object stores."""
    return files.select("path").mapInArrow(_identity_rows, "path string, physical_id string")


def _hash_file(path: str, size: int | None, algo: str):
    """(size, hash, head_hash, tail_hash, error) for one file, streamed in 1 MiB blocks."""
    try:
        f, n = _open_path(path)
    except READ_ERRORS as e:
        return None, None, None, None, f"unreadable: {e}"
    try:
        with f:
            h = hashlib.new(algo)
            head = b""
            while True:
                block = f.read(HASH_BLOCK)
                if not block:
                    break
                if len(head) < EDGE_BYTES:
                    head += block[:EDGE_BYTES - len(head)]
                h.update(block)
            total = f.tell()
            f.seek(max(0, total - EDGE_BYTES))
            tail = f.read(EDGE_BYTES)
    except READ_ERRORS as e:
        return None, None, None, None, f"unreadable: {e}"
    if size is not None and total != size:
        return total, None, None, None, "changed while reading: size differs from listing"
    return (total, h.hexdigest(), hashlib.new(algo, head).hexdigest(),
            hashlib.new(algo, tail).hexdigest(), None)


def _range_rows(it, range_bytes: int):
    """Leaf digest of each (file, range); the first and last range also bring the hash of their 4 KiB window."""
    schema = pa.schema([("asset_id", pa.int64()), ("path", pa.string()), ("no", pa.int64()), ("digest", pa.binary()), ("head_hash", pa.string()),
                        ("tail_hash", pa.string()), ("error", pa.string())])
    for batch in it:
        rows = []
        for aid, path, size, no in zip(*(batch.column(c).to_pylist() for c in ("asset_id", "path", "size", "no"))):
            head = tail = digest = error = None
            last = (no + 1) * range_bytes >= size
            try:
                f, n = _open_path(path)
                with f:
                    if n != size:
                        error = "changed while reading: size differs from listing"
                    else:
                        h, left = hashlib.sha256(H.LEAF), min(range_bytes, size - no * range_bytes)
                        f.seek(no * range_bytes)
                        while left:
                            block = f.read(min(HASH_BLOCK, left))
                            if not block:
                                raise OSError("file ended early")
                            h.update(block)
                            left -= len(block)
                        digest = h.digest()
                        if no == 0:
                            f.seek(0)
                            head = hashlib.sha256(f.read(EDGE_BYTES)).hexdigest()
                        if last:
                            f.seek(max(0, size - EDGE_BYTES))
                            tail = hashlib.sha256(f.read(EDGE_BYTES)).hexdigest()
            except READ_ERRORS as e:
                digest, error = None, f"unreadable: {e}"
            rows.append((aid, path, no, digest, head, tail, error))
        cols = list(zip(*rows)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def hash_file_trees(files: DataFrame, range_bytes: int = H.RANGE_BYTES, fanout: int = H.FANOUT) -> DataFrame:
    """Fingerprint rows by ``sha256-tree``: tasks read (file, range) pairs, so one file of any size is hashed by many.

    Ranges are dealt out by bytes.  Digests are folded by aggregates over at most ``fanout`` of them.  One range that cannot be read
    makes its file ``ok = false``.
    """
    src = files.select("asset_id", "path", "store", "size")
    total = src.agg(F.sum("size")).first()[0] or 0
    tasks = int(max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / range_bytes)).cast("long")
    ranges = src.select("asset_id", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("no"))
    ranges = ranges.withColumn("bytes", F.least(F.lit(range_bytes), F.col("size") - F.col("no") * range_bytes))
    ranges = balanced(ranges, "bytes", tasks, [F.asc("path"), F.asc("no")])
    kind = "asset_id long, path string, no long, digest binary, head_hash string, tail_hash string, error string"
    read = materialize(ranges.select("asset_id", "path", "size", "no").mapInArrow(lambda it: _range_rows(it, range_bytes), kind))
    ends = read.groupBy("asset_id", "path").agg(F.max("head_hash").alias("head_hash"), F.max("tail_hash").alias("tail_hash"),
                                                F.min("error").alias("error"))
    top = H.fold(read.where("digest is not null").select("asset_id", "path", "no", "digest"), ["asset_id", "path"], fanout)
    out = src.join(ends, ["asset_id", "path"]).join(top, ["asset_id", "path"], "left")
    good = F.col("error").isNull()
    whole = H.tree_root("size", F.col("digest"))
    return out.select("asset_id", "path", "store", "size", F.when(good, whole).alias("hash"), F.when(good, F.col("head_hash")).alias("head_hash"),
                      F.when(good, F.col("tail_hash")).alias("tail_hash"), F.lit(H.TREE).alias("algo"), good.alias("ok"), "error")


def hash_files(files: DataFrame, algo: str = "sha256", num_partitions: int | None = None) -> DataFrame:
    """F12 F13 P9 for files: fingerprint rows computed by tasks that open each path.

    ``files`` needs ``asset_id, path, store, size``.  The listing rows (not the
    content) are dealt into ``num_partitions`` tasks of about equal bytes, by default
    as many as the total bytes need; a failed read becomes ``ok = false``.  With ``sha256-tree`` the tasks
    get ranges of files instead of files, see ``hash_file_trees``.
    """
    if algo == H.TREE:
        return hash_file_trees(files)
    spark = files.sparkSession
    if num_partitions is None:
        # Enough tasks that each hashes about TASK_BYTES (a file larger than that
        # is one task on its own); at least four tasks per core.
        total = files.agg(F.sum("size")).first()[0] or 0
        num_partitions = max(4 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    src = balanced(files.select("asset_id", "path", "store", "size"), "size", int(num_partitions), [F.asc("path")])
    schema = pa.schema([(f.name, t) for f, t in zip(FINGERPRINT.fields, [
        pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(),
        pa.string(), pa.bool_(), pa.string()])])

    def run(it):
        for batch in it:
            d = batch.to_pydict()
            cols = {k: [] for k in FINGERPRINT.fieldNames()}
            for aid, p, st, sz in zip(d["asset_id"], d["path"], d["store"], d["size"]):
                size, hh, head, tail, err = _hash_file(p, sz, algo)
                for k, v in zip(FINGERPRINT.fieldNames(),
                                [aid, p, st, size if size is not None else sz, hh, head, tail, algo,
                                 err is None, err]):
                    cols[k].append(v)
            yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return src.mapInArrow(run, FINGERPRINT)


def _window_rows(it):
    """Hashes of the first and last 4 KiB of each file; at most 8 KiB are read."""
    schema = pa.schema([("asset_id", pa.int64()), ("path", pa.string()), ("head_hash", pa.string()), ("tail_hash", pa.string()), ("error", pa.string())])
    for batch in it:
        rows = []
        for aid, path, size in zip(*(batch.column(c).to_pylist() for c in ("asset_id", "path", "size"))):
            head = tail = error = None
            try:
                f, n = _open_path(path)
                with f:
                    if n != size:
                        error = "changed while reading: size differs from listing"
                    else:
                        head = f.read(EDGE_BYTES)
                        f.seek(max(0, n - EDGE_BYTES))
                        head, tail = (hashlib.sha256(x).hexdigest() for x in (head, f.read(EDGE_BYTES)))
            except READ_ERRORS as e:
                error = f"unreadable: {e}"
            rows.append((aid, path, head, tail, error))
        cols = list(zip(*rows)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def window_hashes(files: DataFrame) -> DataFrame:
    """``files`` (asset_id, path, store, size) plus head_hash, tail_hash (SHA-256) and error of the two windows."""
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    src = files.select("asset_id", "path", "store", "size")
    read = src.repartition(tasks, "path").mapInArrow(
        _window_rows, "asset_id long, path string, head_hash string, tail_hash string, error string")
    return src.join(read, ["asset_id", "path"])


def cascade(files: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J3 in two steps: (files whose size occurs twice, with their windows; those whose size and both windows
    occur twice; those whose windows could not be read).

    Only narrow rows are counted and joined; a file that drops out in the second step was read for 8 KiB.
    """
    f = files.where(F.col("size") >= min_size)
    sizes = f.groupBy("size").count().where(F.col("count") > 1).select("size")
    seen = materialize(window_hashes(f.join(sizes, "size", "left_semi")))
    key = ["size", "head_hash", "tail_hash"]
    good = seen.where("error is null")
    twice = good.groupBy(*key).count().where(F.col("count") > 1).select(*key)
    return seen, good.join(twice, key, "left_semi"), seen.where("error is not null")


def cascade_workload(files: DataFrame, min_size: int) -> DataFrame:
    """A7 per step: files and bytes that remain to be hashed after the listing, the sizes and the windows."""
    seen, left, _ = cascade(files, min_size)
    parts = [("listed", files.where(F.col("size") >= min_size)), ("size", seen), ("windows", left)]
    rows = [d.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("step", F.lit(name)) for name, d in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def prefiltered_fingerprints(files: DataFrame, min_size: int, algo: str = "sha256",
                             num_partitions: int | None = None) -> DataFrame:
    """J3 then F12: hash only files whose size and both 4 KiB windows occur more than once.

    Files of unique size are never opened, and files that differ within a window are read for 8 KiB.  A file
    whose windows could not be read is reported with ``ok = false`` (P9).
    """
    _, left, failed = cascade(files, min_size)
    none = F.lit(None).cast("string")
    bad = failed.select("asset_id", "path", "store", "size", none.alias("hash"), none.alias("head_hash"), none.alias("tail_hash"),
                        F.lit(algo).alias("algo"), F.lit(False).alias("ok"), "error")
    return hash_files(left, algo, num_partitions).unionByName(bad)
