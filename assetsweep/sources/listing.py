"""Listing of directory trees by a frontier table.

A round reads a table of directories, the frontier.  Each task walks its share of them and returns files and, once
it has seen ``SHARE`` entries of a frontier row or holds ``QUEUE`` directories of it, the directories that it
did not reach: they are the frontier of the next round.  Rounds are written to the shared folder, so a lost executor
redoes its own share only, and the driver holds one count per round and no path.

Local directories are read entry by entry and returned in pages of ``PAGE`` rows, so a flat directory of any number
of names needs the memory of one page.  Names come without size there; a second stage, dealt out by pages, asks for
size and time.  Other file systems return both with the listing of a directory, which is held as one list.

Every name counts, those that start with ``.`` or ``_`` included.  Links are not followed, except for a root itself.  A directory
that cannot be read, or is gone, has no entries; a file that is gone by the time its size is asked for is no file.  A
name that is no valid UTF-8 is listed with replacement characters, under which nothing can be opened.
"""

from __future__ import annotations

import os
import uuid
from collections import deque
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetsweep.session import checkpoint_dir, literal_table, ship_package

SHARE = 20_000
QUEUE = 2_000
PAGE = 5_000

FRONTIER = "store string, glob string, path string"
LISTED = "store string, glob string, kind string, path string, size long, mtime_ns long"
_LISTED_ARROW = pa.schema([("store", pa.string()), ("glob", pa.string()), ("kind", pa.string()), ("path", pa.string()),
                           ("size", pa.int64()), ("mtime_ns", pa.int64())])


def local_path(uri: str) -> str | None:
    """The path of a local URI or plain path, None for other file systems."""
    if uri.startswith("file:"):
        uri = uri[5:]
        while uri.startswith("//"):
            uri = uri[1:]
        return uri
    return None if "://" in uri else uri


def alternatives(glob: str | None) -> list[str] | None:
    """The patterns of a glob with ``{a,b}``; None matches every name."""
    if not glob:
        return None
    begin = glob.find("{")
    end = glob.find("}", begin)
    if begin < 0 or end < 0:
        return [glob]
    return [x for part in glob[begin + 1:end].split(",") for x in alternatives(glob[:begin] + part + glob[end + 1:])]


def _shown(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace")


def _local_entries(base: str):
    """(is a directory, path, size, time) below a local directory, or of a file itself; size and time stay open."""
    try:
        with os.scandir(base) as inside:
            for e in inside:
                if e.is_dir(follow_symlinks=False):
                    yield True, e.path, None, None
                elif e.is_file(follow_symlinks=False):
                    shown = _shown(e.path)
                    s = e.stat(follow_symlinks=False) if shown != e.path else None  # no table can hold its name
                    yield False, "file:" + shown, s and s.st_size, s and s.st_mtime_ns
    except NotADirectoryError:
        if os.path.isfile(base):
            yield False, "file:" + _shown(base), None, None
    except OSError:
        return


def _remote_entries(uri: str):
    from pyarrow import fs as pafs
    scheme, _, rest = uri.partition("://")
    arrow = f"s3://{rest}" if scheme in ("s3a", "s3n") else uri
    try:
        fs, base = pafs.FileSystem.from_uri(arrow)
        info = fs.get_file_info(base)
        infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    except (OSError, ValueError):
        return
    host = "" if scheme in ("s3", "s3a", "s3n", "gs", "gcs") else rest.split("/", 1)[0]  # a bucket is part of the path
    for x in infos:
        if x.type in (pafs.FileType.File, pafs.FileType.Directory):
            yield x.type == pafs.FileType.Directory, f"{scheme}://{host}{x.path}", x.size, x.mtime_ns


def entries(uri: str):
    base = local_path(uri)
    return _remote_entries(uri) if base is None else _local_entries(base)


def _walk(store, glob, root: str, share: int, queue: int):
    """Rows below one frontier directory: files, and the directories left over."""
    patterns, todo, seen = alternatives(glob), deque([root]), 0
    while todo:
        at = todo.popleft()
        if seen >= share and _shown(at) == at:
            yield store, glob, "dir", at, None, None
            continue
        for is_dir, path, size, mtime in entries(at):
            seen += 1
            if is_dir:
                # A name that no table can hold is walked here, whatever has been seen.
                if len(todo) < queue and seen < share or _shown(path) != path:
                    todo.append(path)
                else:
                    yield store, glob, "dir", path, None, None
            elif patterns is None or any(fnmatchcase(path.rsplit("/", 1)[-1], p) for p in patterns):
                yield store, glob, "file", path, size, mtime


def _pages(rows, page: int = PAGE):
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= page:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _LISTED_ARROW)], schema=_LISTED_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _LISTED_ARROW)], schema=_LISTED_ARROW)


def _round(share: int, queue: int):
    def walk(batches):
        for batch in batches:
            for store, glob, path in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield from _pages(_walk(store, glob, path, share, queue))
    return walk


def _sized(batches):
    """Size and time of local files; files that are gone, or no regular files any more, are left out."""
    for batch in batches:
        out = []
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if row[4] is None:
                try:
                    s = os.stat(local_path(row[3]))
                except OSError:
                    continue
                row = (*row[:4], s.st_size, s.st_mtime_ns)
            out.append(row)
        yield from _pages(out)


def _tasks(spark: SparkSession, rows: int, each: int) -> int:
    return max(1, min(-(-rows // each), 16 * spark.sparkContext.defaultParallelism))


def list_trees(spark: SparkSession, roots: list[tuple[str | None, str, str | None]], min_size: int = 1,
               share: int = SHARE, queue: int = QUEUE) -> DataFrame:
    """Regular files of at least ``min_size`` bytes below ``[(store, root, glob), ...]``.

    path, name, store, size, modificationTime; a path below two roots stands twice.  Without a glob every name counts.
    """
    ship_package(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    absolute = [(s, g, r if local_path(r) is None else os.path.abspath(local_path(r))) for s, r, g in roots]
    frontier = literal_table(spark, absolute, FRONTIER)
    n, rounds = len(roots), 0
    while n:
        found = frontier.repartition(_tasks(spark, n, 1)).mapInArrow(_round(share, queue), LISTED)
        found.write.parquet(f"{folder}/round={rounds:06d}")
        frontier = spark.read.schema(LISTED).parquet(f"{folder}/round={rounds:06d}").where("kind = 'dir'").select("store", "glob", "path")
        n, rounds = frontier.count(), rounds + 1
    if not rounds:
        return literal_table(spark, [], "path string, name string, store string, size long, modificationTime timestamp")
    files = spark.read.schema(LISTED).parquet(folder).where("kind = 'file'").select(*[x.split()[0] for x in LISTED.split(", ")])
    files = files.repartition(_tasks(spark, files.count(), PAGE)).mapInArrow(_sized, LISTED)
    return files.where(F.col("size") >= min_size).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "store", "size",
        F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)).alias("modificationTime"))
