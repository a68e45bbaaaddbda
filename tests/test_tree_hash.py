import hashlib
import os

import pytest
from pyspark.sql import functions as F

from assetsweep.functions import hashing as H
from assetsweep.plans import jobs
from assetsweep.sources import files as FS


def tree(data: bytes, range_bytes: int, fanout: int) -> str:
    """The scheme, one range after the other."""
    level = [hashlib.sha256(b"\x00" + data[k:k + range_bytes]).digest() for k in range(0, len(data), range_bytes)] or [hashlib.sha256(b"\x00").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[k:k + fanout])).digest() for k in range(0, len(level), fanout)]
    return hashlib.sha256(b"\x02" + len(data).to_bytes(8, "big") + level[0]).hexdigest()


def listed(spark, root):
    return FS.with_asset_ids(FS.list_files(spark, str(root), None, "s"))


@pytest.mark.parametrize("range_bytes, fanout", [(1000, 2), (1000, 3), (7, 1024), (10_000_000, 1024)])
def test_files_of_many_ranges(spark, tmp_path, range_bytes, fanout):
    data = {f"f{n}": os.urandom(n) for n in (1, 6, 7, 8, 999, 1000, 1001, 4096, 8192, 9001)}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in FS.hash_file_trees(listed(spark, tmp_path), range_bytes, fanout).collect()}
    assert set(rows) == set(data)
    for k, v in data.items():
        r = rows[k]
        assert r.ok and r.hash == tree(v, range_bytes, fanout) and r.algo == "sha256-tree"
        assert (r.head_hash, r.tail_hash) == (hashlib.sha256(v[:4096]).hexdigest(), hashlib.sha256(v[-4096:]).hexdigest())


def test_column_and_file_agree(spark, tmp_path):
    for n in (1, 5000, 30_000):
        (tmp_path / f"f{n}").write_bytes(os.urandom(n))
    files = {r.path: r.hash for r in FS.hash_files(listed(spark, tmp_path), "sha256-tree").collect()}
    column = spark.read.format("binaryFile").load(str(tmp_path)).select("path", H.content_hash(F.col("content"), "sha256-tree").alias("h"))
    assert {r.path: r.h for r in column.collect()} == files
    small = spark.createDataFrame([(bytearray(b"x" * 25),), (bytearray(b""),)], "p binary")
    got = [r.h for r in small.select(H.tree_hash(F.col("p"), F.octet_length("p"), 10).alias("h")).collect()]
    assert got == [tree(b"x" * 25, 10, 1024), tree(b"", 10, 1024)]


def test_one_file_of_4_gb_is_hashed_by_many_tasks(spark, tmp_path):
    """A sparse file with some content: 64 ranges of 64 MiB."""
    size, marks = 4 << 30, {0: b"begin", (64 << 20) - 2: b"cross", (3 << 30) + 5: b"inside", (4 << 30) - 3: b"end"}
    with open(tmp_path / "huge", "wb") as f:
        f.truncate(size)
        for at, x in marks.items():
            f.seek(at)
            f.write(x)
    leaves = []
    zero = hashlib.sha256(b"\x00" + bytes(H.RANGE_BYTES)).digest()
    for k in range(size // H.RANGE_BYTES):
        begin, inside = k * H.RANGE_BYTES, bytearray()
        hit = [(at, x) for at, x in marks.items() if at < begin + H.RANGE_BYTES and at + len(x) > begin]
        if hit:
            inside = bytearray(H.RANGE_BYTES)
            for at, x in hit:
                for j, b in enumerate(x):
                    if 0 <= at + j - begin < H.RANGE_BYTES:
                        inside[at + j - begin] = b
        leaves.append(hashlib.sha256(b"\x00" + inside).digest() if hit else zero)
    want = hashlib.sha256(b"\x02" + size.to_bytes(8, "big") + hashlib.sha256(b"\x01" + b"".join(leaves)).digest()).hexdigest()
    files = listed(spark, tmp_path)
    assert FS.hash_files(files, "sha256-tree").first()["hash"] == want
    # The ranges of the one file are dealt to several tasks.
    n = F.ceil(F.col("size") / H.RANGE_BYTES).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("no")).withColumn("bytes", F.lit(H.RANGE_BYTES).cast("long"))
    from assetsweep.operators.ranking import balanced
    assert balanced(ranges, "bytes", 8, [F.asc("path"), F.asc("no")]).groupBy(F.spark_partition_id()).count().count() == 8


def test_a_range_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"a" * 100)
    (tmp_path / "b").write_bytes(b"b" * 100)
    files = spark.createDataFrame(listed(spark, tmp_path).collect())
    (tmp_path / "a").unlink()
    (tmp_path / "b").write_bytes(b"b" * 101)
    rows = {r.path[-1]: r for r in FS.hash_file_trees(files, 10).collect()}
    assert not rows["a"].ok and rows["a"].error.startswith("unreadable") and rows["a"].hash is None
    assert not rows["b"].ok and rows["b"].error.startswith("changed while reading")


def test_duplicates_and_archive_by_tree(spark, tmp_path):
    for name, x in (("one/a.gguf", b"same" * 3000), ("two/b.gguf", b"same" * 3000), ("two/c.gguf", b"diff" * 3000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(x)
    stores = [("one", str(tmp_path / "one"), "*.gguf"), ("two", str(tmp_path / "two"), "*.gguf")]
    d = jobs.find_file_duplicates(spark, stores, 1, algo="sha256-tree")
    assert d.groups.first()["n_members"] == 2 and d.groups.first()["hash"] == tree(b"same" * 3000, H.RANGE_BYTES, H.FANOUT)
    files = FS.with_asset_ids(FS.scan_stores(spark, stores))
    content = spark.read.format("binaryFile").load([s[1] for s in stores]).select("path", F.col("content").alias("payload"))
    assets = files.join(content, "path").select("asset_id", "path", "name", "store", "size", "payload")
    out = jobs.archive(spark, jobs.reclaim_plan(d).removal, assets, str(tmp_path / "arc"), str(tmp_path / "kept"), algo="sha256-tree").collect()
    assert [r.result for r in out] == ["archived"]
