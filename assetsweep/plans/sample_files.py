"""Writes table rows as files for queries and tests over file trees; not part of the library's operators."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from assetsweep.session import ship_package
from assetsweep.sources.listing import local_path


def _put(root: str, path: str, content: bytes) -> None:
    base = local_path(root)
    if base is None:
        from pyarrow import fs as pafs
        fs, top = pafs.FileSystem.from_uri(root)
        with fs.open_output_stream(f"{top}/{path}", compression=None) as f:
            f.write(content)
        return
    full = f"{base}/{path}"
    os.makedirs(os.path.dirname(full), exist_ok=True)
    part = f"{full}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, full)  # a task that runs twice leaves one whole file


def write_files(rows: DataFrame, root: str) -> int:
    """Writes ``content`` of each row to ``root/path``; returns the number of files."""
    ship_package(rows.sparkSession)

    def write(batches):
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1)
            for k, p in enumerate(paths):
                _put(root, p, contents[k].as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(paths)], pa.int64())], names=["n"])

    out = rows.select("path", "content").mapInArrow(write, "n long").groupBy().sum("n").first()[0]
    return int(out or 0)
