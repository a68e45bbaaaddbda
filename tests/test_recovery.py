"""Archive, undo, cached fingerprints and manifests after failures and on odd input."""

import shutil

import pytest
from pyspark.sql import functions as F
from test_actions import assets, payload, plan_for

from assetsweep.functions import scalars as S
from assetsweep.operators import archive as A
from assetsweep.operators import capacity as CAP
from assetsweep.operators import ranking
from assetsweep.operators import skew
from assetsweep.plans import jobs
from assetsweep.session import checkpoint_dir
from assetsweep.sources import headers as H
from assetsweep.sources import manifests as M


def two_groups(spark):
    return assets(spark, [("/x/k.bin", "ollama", payload(700, 4)), ("/y/d.bin", "loose", payload(700, 4)),
                          ("/z/other.bin", "loose", payload(300, 1))])


def test_rerun_after_a_crash_finishes_the_removal(spark, tmp_path):
    df = two_groups(spark)
    _, removal = plan_for(df)
    arc = str(tmp_path / "arc")
    jobs.archive(spark, removal, df, arc, str(tmp_path / "kept1"), now=1)
    # The first run died before kept1 was published; the same input goes to a new place.
    again = jobs.archive(spark, removal, df, arc, str(tmp_path / "kept2"), now=2).collect()
    assert [(r["status"], r["result"]) for r in again] == [("destination_exists", "archived_before")]
    assert {r["path"] for r in spark.read.parquet(str(tmp_path / "kept2")).collect()} == {"/x/k.bin", "/z/other.bin"}


def test_archive_undo_archive(spark, tmp_path):
    df = two_groups(spark)
    _, removal = plan_for(df)
    arc = str(tmp_path / "arc")
    jobs.archive(spark, removal, df, arc, str(tmp_path / "kept"), now=1)
    kept = spark.read.parquet(str(tmp_path / "kept"))
    jobs.apply_undo(spark, arc, kept, str(tmp_path / "back"), now=2)
    back = spark.read.parquet(str(tmp_path / "back"))
    assert back.count() == 3
    second = jobs.archive(spark, removal, back, arc, str(tmp_path / "kept_again"), now=3).collect()
    assert [(r["status"], r["result"]) for r in second] == [("movable", "archived")]
    live = spark.read.parquet(str(tmp_path / "kept_again")).select("path")
    status = jobs.undo(spark, arc, live).collect()
    assert [(r["from"], r["status"]) for r in status] == [("/y/d.bin", "restore")]


def test_undo_with_a_missing_run_folder(spark, tmp_path):
    df = two_groups(spark)
    _, removal = plan_for(df)
    arc = tmp_path / "arc"
    jobs.archive(spark, removal, df, str(arc), str(tmp_path / "kept"), now=1)
    gone = tmp_path / "elsewhere"
    for run in (arc / "data").glob("run=*"):
        shutil.move(str(run), str(gone))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert [r["status"] for r in jobs.undo(spark, str(arc), kept.select("path")).collect()] == ["archive_missing"]
    status = jobs.apply_undo(spark, str(arc), kept, str(tmp_path / "out"))
    assert [r["status"] for r in status.collect()] == ["archive_missing"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_kept_out_through_a_link_is_refused(spark, tmp_path):
    df = two_groups(spark)
    _, removal = plan_for(df)
    df.write.parquet(str(tmp_path / "table"))
    (tmp_path / "link").symlink_to(tmp_path / "table")
    table = spark.read.parquet(str(tmp_path / "table"))
    with pytest.raises(ValueError):
        jobs.archive(spark, removal, table, str(tmp_path / "arc"), str(tmp_path / "link"), now=1)
    assert jobs._norm_path("s3a://b/k") == jobs._norm_path("s3://b/k")


def test_cache_retries_failed_reads_and_keeps_algorithms_apart(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.gguf").write_bytes(b"x" * 2000)
    (root / "single.gguf").write_bytes(b"y" * 999)
    stores, cache = [("loose", str(root), "*.gguf")], str(tmp_path / "cache")
    assert jobs.find_file_duplicates_cached(spark, stores, cache, 1).groups.collect()[0]["n_members"] == 3
    hashed = spark.read.parquet(cache)
    assert hashed.count() == 3  # the file with a size of its own is not read
    # One row is as a failed read left it.
    broken = F.col("path").endswith("a.gguf")
    stale = hashed.withColumn("ok", ~broken).withColumn("hash", F.when(~broken, F.col("hash")))
    stale.write.parquet(str(tmp_path / "cache2"))
    again = jobs.find_file_duplicates_cached(spark, stores, str(tmp_path / "cache2"), 1)
    assert again.groups.collect()[0]["n_members"] == 3
    md5 = jobs.find_file_duplicates_cached(spark, stores, cache, 1, algo="md5").groups.collect()
    assert [(r["n_members"], len(r["hash"])) for r in md5] == [(3, 32)]


def test_manifests_with_odd_layers_paths_and_depth(spark, tmp_path):
    root = tmp_path / "my manifests"
    good = root / "registry.example" / "library" / "my model" / "v 1+a"
    good.parent.mkdir(parents=True)
    good.write_text('{"layers": [5, "text", {"digest": "sha256:aa"}, {"digest": 5}, {"digest": {"k": 1}}, {"no": 1}, null]}')
    (root / "registry.example" / "loose").write_text('{"layers": [{"digest": "sha256:bb"}]}')
    (root / "registry.example" / "library" / "bad").write_text('{"layers": ')
    rows = M.manifest_tags(M.read_manifest_files(spark, str(root))).collect()
    assert [tuple(r) for r in rows] == [("sha256-aa", "my model:v 1+a", 1)]


def test_unreadable_schemes_become_rows(spark):
    paths = spark.createDataFrame([("nosuch://bucket/x.gguf",), ("file:/no/such/file.gguf",)], "path string")
    errors = [r["error"] for r in H.headers(H.decode_paths(paths)).collect()]
    assert len(errors) == 2 and all(e.startswith("io:") for e in errors)


def test_header_limits_and_kept_items():
    from assetsweep.plans import sample_headers as SH
    data = SH.encode_header(3, [("t", "arr", ("str", [str(k) for k in range(20)])), ("n", "arr", ("u8", [1, 2, 3])),
                                ("deep", "arr", ("arr", [("arr", [("u8", [1]), ("u8", [2, 3])]), ("str", ["x"])]))], [])
    at = H.DECODED.fieldNames().index("v_arr")
    kept = [r[at] for r in H.decode_bytes("f", data)[1:]]
    assert kept[0] == [str(k) for k in range(8)] and kept[1] == [] and kept[2] == ["[[], []]", "[x]"]
    everything = [r[at] for r in H.decode_bytes("f", data, limits=H.Limits(keep_items=None, keep_fixed_items=None))[1:]]
    assert len(everything[0]) == 20 and everything[1] == ["1", "2", "3"] and everything[2] == ["[[1], [2, 3]]", "[x]"]
    error = H.DECODED.fieldNames().index("error")
    four = SH.encode_header(3, [("d", "arr", ("arr", [("arr", [("arr", [("u8", [1])])])]))], [])
    assert H.decode_bytes("f", four)[0][error].startswith("limit_levels")
    assert H.decode_bytes("f", data[:60], length=len(data))[0][error].startswith("limit_header")
    assert H.decode_bytes("f", data, limits=H.Limits(key_bytes=0))[0][error].startswith("limit_key")


def test_large_context_and_exact_division(spark):
    cat = spark.createDataFrame([(10, 1, 9_999_999, 10_000_000, 1)], "weights_bytes long, n_layers long, n_embd long, n_head long, n_head_kv long")
    big = cat.withColumn("context_length", F.lit("18446744073709551615").cast("decimal(20,0)"))
    rows = CAP.capacity_fit(big, [("d", 1, [])]).collect()
    assert rows[0]["context_tokens"] == 18446744073709551615
    one = cat.select(S.kv_cache_bytes("weights_bytes", "n_layers", "n_embd", "n_head", "n_head_kv", F.lit(1)).alias("b"))
    assert int(one.first()["b"]) == 2 * (9_999_999 // 4) * 2


def test_more_devices_than_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(CAP, "BROADCAST_DEVICES", 2)
    cat = spark.createDataFrame([(10, 1, 64, 2, 1)], "weights_bytes long, n_layers long, n_embd long, n_head long, n_head_kv long")
    devices = [(f"d{k}", 16, [1]) for k in range(5)]
    assert CAP.capacity_fit(cat, devices, [1]).count() == 5


def test_ranks_of_a_whole_table(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), (F.col("id") % 3).alias("y"))
    rows = ranking.ranked(d.repartition(9), [F.desc("y"), F.asc("x")]).collect()
    want = sorted(((r["x"], r["y"]) for r in rows), key=lambda p: (-p[1], p[0]))
    assert [(r["x"], r["y"]) for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(1, 5001))
    assert ranking.ranked(d.limit(0), [F.asc("x")]).count() == 0


def test_id_bitmap_never_loses_an_id(spark):
    wide = spark.range(20_000).withColumn("payload", F.lit("p"))
    ids = spark.range(0, 20_000, 3)
    small = dict(max_ids=0, filter_bits=1 << 15)  # nearly every bit is set
    assert skew.filter_by_ids(wide, ids, "id", keep=True, **small).count() == 6667
    assert skew.filter_by_ids(wide, ids, "id", keep=False, **small).count() == 13_333
    assert skew.filter_by_ids(wide, ids, "id", keep=False, max_ids=0).count() == 13_333


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_entries_of_a_manifest_name_their_run(spark, tmp_path):
    df = two_groups(spark)
    _, removal = plan_for(df)
    jobs.archive(spark, removal, df, str(tmp_path / "arc"), str(tmp_path / "kept"), now=1)
    entries, _ = A.manifest_entries(A.read_manifest(spark, str(tmp_path / "arc" / "manifest")))
    assert "/data/run=" in entries.first()["destination"]


def test_file_inventory_selects_models_and_can_leave_headers_out(spark, tmp_path):
    import os

    from assetsweep.plans import sample_headers as SH
    head = SH.encode_header(3, [("general.architecture", "str", "llama"), ("general.name", "str", "Named")], []) + bytes(64)
    ollama, custom = tmp_path / "ollama", tmp_path / "custom"
    ollama.mkdir()
    custom.mkdir()
    (ollama / "sha256-aa").write_bytes(head)
    (ollama / "sha256-bb").write_bytes(b"no magic here")
    (ollama / "other").write_bytes(head)
    (custom / "model.gguf").write_bytes(b"by extension")
    (custom / "big-00001-of-00002").write_bytes(b"by split name")
    (custom / "magic.bin").write_bytes(head)
    (custom / "notes.txt").write_bytes(b"notes")
    stores = [("ollama", str(ollama), None), ("custom", str(custom), None), ("custom", str(tmp_path / "none*"), None)][:2]
    found = jobs.file_inventory(spark, stores)
    rows = {r["name"]: r for r in found.assets.collect()}
    assert set(rows) == {"sha256-aa", "model.gguf", "big-00001-of-00002", "magic.bin"}
    assert rows["magic.bin"]["display_name"] == "Named" and rows["model.gguf"]["display_name"] == "model.gguf"
    assert {(r["kind"], r["files"]) for r in found.stores.collect()} == {("ollama", 1), ("custom", 3)}
    plain = jobs.file_inventory(spark, stores, no_parse=True)
    assert "architecture" not in plain.assets.columns and plain.assets.count() == 4
    assert found.report().count() == 2 + 4 + 1 and found.top(2).count() == 2
    # Two names of one file are no duplicates of each other.
    (custom / "copy.gguf").write_bytes(b"by extension")
    os.link(custom / "model.gguf", custom / "hard.gguf")
    groups = jobs.find_file_duplicates(spark, [("custom", str(custom), "*.gguf")], 1).groups.collect()
    assert [r["n_members"] for r in groups] == [2]


def test_balanced_partitions(spark):
    d = spark.range(4000).select("id", F.when(F.col("id") < 40, 1000).otherwise(1).alias("size"))
    parts = ranking.balanced(d, "size", 8, [F.asc("id")]).groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 4000 and max(r["s"] for r in parts) <= 2 * 43_960 / 8 + 1000
    assert ranking.balanced(d.limit(0), "size", 4, [F.asc("id")]).count() == 0
