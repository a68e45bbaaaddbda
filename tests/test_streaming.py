"""Incremental fingerprinting: each file is hashed once, new files are picked up."""

import os
import time

from pyspark.sql import functions as F

from assetsweep.operators import duplicates as D
from assetsweep.sources import files as FS
from assetsweep.streaming import incremental as INC


def test_stream_hashes_new_files_once(spark, tmp_path):
    root = tmp_path / "land"
    root.mkdir()
    (root / "a.gguf").write_bytes(b"x" * 5000)
    (root / "b.gguf").write_bytes(b"x" * 5000)
    table, ckpt = str(tmp_path / "fp"), str(tmp_path / "ckpt")
    INC.fingerprint_stream(spark, str(root), table, ckpt).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2
    (root / "c.gguf").write_bytes(b"y" * 7000)
    (root / "d.gguf").write_bytes(b"x" * 5000)
    INC.fingerprint_stream(spark, str(root), table, ckpt).awaitTermination(120)
    fp = spark.read.parquet(table)
    assert fp.count() == 4 and fp.select("path").distinct().count() == 4
    d = D.find_duplicates(INC.latest_fingerprints(fp), min_size=1)
    assert d.groups.first()["n_members"] == 3


def test_batch_refresh_skips_unchanged(spark, tmp_path):
    root = tmp_path / "s"
    root.mkdir()
    (root / "a.gguf").write_bytes(b"1" * 100)
    (root / "b.gguf").write_bytes(b"2" * 100)
    listing = FS.with_asset_ids(FS.list_files(spark, str(root)))
    cache = INC.refresh_fingerprints(listing, None).cache()
    assert cache.count() == 2
    time.sleep(1.1)
    (root / "b.gguf").write_bytes(b"3" * 120)
    os.utime(root / "b.gguf")
    listing2 = FS.with_asset_ids(FS.list_files(spark, str(root)))
    new = INC.refresh_fingerprints(listing2, cache)
    assert [r["path"].rsplit("/", 1)[-1] for r in new.collect()] == ["b.gguf"]
    latest = INC.latest_fingerprints(cache.unionByName(new))
    assert latest.where(F.col("path").endswith("b.gguf")).first()["size"] == 120


def test_cached_file_duplicates_reuse_fingerprints(spark, tmp_path):
    from assetsweep.plans import jobs
    root = tmp_path / "s"
    root.mkdir()
    (root / "a.gguf").write_bytes(b"z" * 3000)
    (root / "b.gguf").write_bytes(b"z" * 3000)
    cache = str(tmp_path / "fpcache")
    stores = [("custom", str(root), "*.gguf")]
    d1 = jobs.find_file_duplicates_cached(spark, stores, cache, min_size=1000)
    assert d1.groups.first()["n_members"] == 2
    assert spark.read.parquet(cache).count() == 2
    time.sleep(1.1)
    (root / "c.gguf").write_bytes(b"z" * 3000)
    (root / "b.gguf").write_bytes(b"y" * 3000)
    os.utime(root / "b.gguf")
    d2 = jobs.find_file_duplicates_cached(spark, stores, cache, min_size=1000)
    # Only the new and the changed file were hashed again.
    assert spark.read.parquet(cache).count() == 4
    members = {r["path"].rsplit("/", 1)[-1] for r in d2.members().collect()}
    assert members == {"a.gguf", "c.gguf"}
