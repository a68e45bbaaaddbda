"""``spark.read.format("model_headers")``: the header catalogue as a data source.

``load_headers(spark, root)`` lists the tree with tasks (``sources.listing``), deals the paths out by header bytes (files count
``min(size, HEADER_BUDGET)``) and writes them as a table of some part files; the source plans one partition per part file.
So the driver sees the names of part files, never of model files.  Read directly, ``format("model_headers").load(root)``
plans ``numPartitions`` shares without listing anything: each task lists the top of the tree and goes on
with the files and folders whose name hashes to its share.

``sections`` and ``keys`` say which rows are wanted: values of other entries are passed over, not decoded.  They are options, and
not filters that Spark pushes: Spark 4.1 keeps a Python reader with its filters for the next query on the same DataFrame, which
would then miss rows.

The rows are the long decoded table (``section`` = header / kv / tensor), ready for
``operators.catalog.summarize_decoded``.  Options: ``glob`` (default ``*.gguf``; empty for all files), ``numPartitions``, ``listing``,
``sections`` and ``keys`` (JSON lists).
"""

from __future__ import annotations

import json
import sys
import uuid
from fnmatch import fnmatchcase
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assetsweep.operators.ranking import balanced
from assetsweep.session import checkpoint_dir, ship_package
from assetsweep.sources.headers import DECODED
from assetsweep.sources.listing import list_trees

# Planning estimate of the header bytes read per file.
HEADER_BUDGET = 4 * 1024 * 1024
DEFAULT_BYTES_PER_PARTITION = 256 * 1024 * 1024
DEFAULT_PARTITIONS = 32


class _Listed(InputPartition):
    """One part file of a table of paths."""

    def __init__(self, part: str):
        super().__init__(part)
        self.part = part


class _Share(InputPartition):
    def __init__(self, k: int, n: int):
        super().__init__(k)
        self.k, self.n = k, n


def _filesystem(uri: str):
    from pyarrow import fs as pafs

    from assetsweep.sources.listing import local_path
    base = local_path(uri)
    if base is not None:
        return pafs.LocalFileSystem(), base
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.glob = options.get("glob", "*.gguf")
        self.listing = options.get("listing")
        self.n = int(options.get("numPartitions", DEFAULT_PARTITIONS))
        self.sections, self.keys = (x if x is None else frozenset(json.loads(x)) for x in (options.get("sections"), options.get("keys")))

    def partitions(self):
        if not self.listing:
            return [_Share(k, self.n) for k in range(self.n)]
        from pyarrow import fs as pafs
        fs, base = _filesystem(self.listing)
        parts = [x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.base_name.startswith("part-")]
        return [_Listed(p) for p in sorted(parts)] or [_Share(0, 0)]

    def _paths(self, partition):
        if isinstance(partition, _Listed):
            import pyarrow.parquet as pq
            fs, _ = _filesystem(self.listing)
            with pq.ParquetFile(fs.open_input_file(partition.part)) as table:
                for batch in table.iter_batches(columns=["path"]):
                    yield from batch.column(0).to_pylist()
            return
        from assetsweep.sources.listing import _walk, entries, local_path
        if not partition.n:
            return
        base = local_path(self.root)
        for is_dir, path, _, _ in entries(self.root if base is None else base):
            if crc32(path.rsplit("/", 1)[-1].encode("utf-8", "surrogateescape")) % partition.n != partition.k:
                continue
            if is_dir:
                yield from (r[3] for r in _walk(None, self.glob, path, sys.maxsize, sys.maxsize))
            elif not self.glob or fnmatchcase(path.rsplit("/", 1)[-1], self.glob):
                yield path

    def read(self, partition):
        from assetsweep.sources.headers import DEFAULT_LIMITS, READ_ERRORS, Wanted, _open_path, _row, decode_stream
        wanted = Wanted(self.sections, self.keys)
        for p in self._paths(partition):
            try:
                f, n = _open_path(p)
            except READ_ERRORS as e:
                if wanted.section("header"):
                    yield _row(p, "header", None, error=f"io: {e}")
                continue
            with f:
                yield from decode_stream(p, f, n, DEFAULT_LIMITS, wanted)


class HeaderSource(DataSource):
    @classmethod
    def name(cls):
        return "model_headers"

    def schema(self):
        return DECODED

    def reader(self, schema):
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeaderSource)


def load_headers(spark: SparkSession, root: str, glob: str | None = "*.gguf", sections: list[str] | None = None,
                 keys: list[str] | None = None, bytes_per_partition: int = DEFAULT_BYTES_PER_PARTITION) -> DataFrame:
    """The decoded headers of all files below ``root``: all rows, or those of ``sections`` and, of key/value rows, ``keys``."""
    ship_package(spark)
    register(spark)
    files = list_trees(spark, [(None, root, glob)]).select("path", F.least("size", F.lit(HEADER_BUDGET)).alias("bytes"))
    total = files.agg(F.sum("bytes")).first()[0] or 0
    tasks = int(max(spark.sparkContext.defaultParallelism, -(-total // bytes_per_partition)))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/headers-{uuid.uuid4().hex}"
    balanced(files, "bytes", tasks, [F.asc("path")]).select("path").write.parquet(folder)
    wanted = {k: json.dumps(list(v)) for k, v in (("sections", sections), ("keys", keys)) if v is not None}
    return spark.read.format("model_headers").options(listing=folder, **wanted).load()
