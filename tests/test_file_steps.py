"""Prefilter steps of file hashing, reports in bounded rows."""

import json

from pyspark.sql import functions as F

from assetsweep.operators import duplicates as D
from assetsweep.plans import jobs
from assetsweep.plans import report as rep
from assetsweep.sources import files as FS
from assetsweep.sources import tables


def test_only_files_alike_in_size_and_both_windows_are_hashed(spark, tmp_path):
    base = bytes(range(256)) * 80  # 20480 bytes
    files = {"a": base, "b": base, "head": b"X" + base[1:], "tail": base[:-1] + b"X", "middle": base[:10_000] + b"X" + base[10_001:],
             "other_size": base + b"!", "short1": b"abc", "short2": b"abd", "short3": b"abc"}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    listed = FS.with_asset_ids(FS.list_files(spark, str(tmp_path), None, "s"))
    seen, left, failed = FS.cascade(listed, 1)
    name = F.element_at(F.split("path", "/"), -1)
    names = lambda df: {r[0] for r in df.select(name).collect()}
    assert names(seen) == set(files) - {"other_size"} and names(left) == {"a", "b", "middle", "short1", "short3"} and failed.count() == 0
    work = {r.step: (r.files, r.bytes) for r in FS.cascade_workload(listed, 1).collect()}
    assert work == {"listed": (9, sum(map(len, files.values()))), "size": (8, 5 * 20480 + 9), "windows": (5, 3 * 20480 + 6)}
    groups = jobs.find_file_duplicates(spark, [("s", str(tmp_path), None)], 1).groups.collect()
    assert sorted((r.size_each, r.n_members) for r in groups) == [(3, 2), (20480, 2)]


def test_files_that_cannot_be_read_are_reported(spark, tmp_path):
    for k in "abc":
        (tmp_path / k).write_bytes(b"same" * 3000)
    listed = spark.createDataFrame(FS.with_asset_ids(FS.list_files(spark, str(tmp_path), None, "s")).collect())
    (tmp_path / "b").unlink()
    rows = {r.path[-1]: r for r in FS.prefiltered_fingerprints(listed, 1).collect()}
    assert set(rows) == set("abc") and [k for k, r in sorted(rows.items()) if not r.ok] == ["b"] and rows["b"].error.startswith("unreadable")


def test_report_names_the_members_of_each_group(spark):
    assets = tables.documents_assets(spark, "/root/testdata/sf0.001")
    d = D.find_duplicates(D.fingerprint_payloads(assets), min_size=1)
    stores = spark.createDataFrame([("s", "src0", False)], "kind string, root string, missing boolean")
    rows = [json.loads(r.json) for r in jobs.inventory(assets, stores).report(d).collect()]
    got = {(g["group_id"], m["asset_id"], m["path"], m["store"], m["is_keeper"]) for g in rows if g["section"] == "group" for m in g["members"]}
    want = {(r.group_id, r.asset_id, r.path, r.store, r.is_keeper) for r in d.members().collect()}
    assert got == want and len(want) > 10


def test_a_group_of_a_million_members_gives_bounded_rows(spark):
    n = 1_000_000
    i = F.col("id")
    fp = spark.range(n + 7).select(
        i.alias("asset_id"), F.concat(F.lit("/x/"), i).alias("path"), F.lit("s").alias("store"), F.lit(5).cast("long").alias("size"),
        F.when(i < n, F.lit("h")).otherwise(F.lit("k")).alias("hash"), F.lit("a").alias("head_hash"), F.lit("b").alias("tail_hash"),
        F.lit("sha256").alias("algo"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    chunks = rep.group_chunks(D.find_duplicates(fp, min_size=1), 10_000)
    rows = chunks.select("group_id", "chunk", "n_chunks", F.size("members").alias("n"), F.col("members")[0]["asset_id"].alias("first"),
                         F.array_max("members")["asset_id"].alias("last")).collect()
    big = sorted((r.chunk, r.n, r.first, r.last) for r in rows if r.group_id == 0)
    assert big == [(k, 10_000, 10_000 * k, 10_000 * k + 9_999) for k in range(100)] and {r.n_chunks for r in rows if r.group_id == 0} == {100}
    assert [(r.chunk, r.n, r.n_chunks) for r in rows if r.group_id == n] == [(0, 7, 1)]
