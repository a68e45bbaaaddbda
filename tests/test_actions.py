"""Plan, verify, archive and undo (FIXTURES.md 5)."""

import hashlib

from pyspark.sql import functions as F

from assetsweep.operators import archive as A
from assetsweep.operators import duplicates as D
from assetsweep.operators import plan as P
from assetsweep.plans import jobs


def payload(n, seed):
    return bytes((i + seed) % 256 for i in range(n))


def assets(spark, rows):
    return spark.createDataFrame(
        [(i, path, path.rsplit("/", 1)[-1], store, len(p), p) for i, (path, store, p) in enumerate(rows)],
        "asset_id bigint, path string, name string, store string, size bigint, payload binary")


def plan_for(df):
    d = D.find_duplicates(D.fingerprint_payloads(df), min_size=1)
    removal = P.reclaim_plan(d).removal
    return d, removal


def test_dry_run_verifies_ok(spark):
    df = assets(spark, [("/x/a.bin", "loose", payload(10_000, 1)), ("/y/a2.bin", "loose", payload(10_000, 1))])
    d, removal = plan_for(df)
    v = P.verify_plan(removal, D.fingerprint_payloads(df))
    s = {r["status"]: (r["n"], r["bytes"]) for r in P.status_rollup(v).collect()}
    assert s == {"ok": (1, 10_000)}


def test_changed_content_is_skipped(spark):
    df = assets(spark, [("/x/a.bin", "loose", payload(10_000, 1)), ("/y/b.bin", "loose", payload(10_000, 1)),
                        ("/z/c.bin", "loose", payload(10_000, 1))])
    d, removal = plan_for(df)
    now = assets(spark, [("/x/a.bin", "loose", payload(10_000, 1)), ("/y/b.bin", "loose", payload(10_000, 9))])
    st = {r["asset_id"]: r["status"] for r in P.verify_plan(removal, D.fingerprint_payloads(now)).collect()}
    assert st == {1: "changed", 2: "missing"}


def test_archive_and_manifest(spark, tmp_path):
    df = assets(spark, [("/x/keep.bin", "ollama", payload(20_000, 3)), ("/y/dup.bin", "loose", payload(20_000, 3)),
                        ("/z/other.bin", "loose", payload(500, 5))])
    _, removal = plan_for(df)
    out = str(tmp_path)
    status = jobs.archive(spark, removal, df, out + "/arc", out + "/kept", now=123)
    assert [(r["asset_id"], r["status"]) for r in status.collect()] == [(1, "movable")]
    kept = spark.read.parquet(out + "/kept")
    assert sorted(r["asset_id"] for r in kept.collect()) == [0, 2]
    archived = spark.read.parquet(out + "/arc/data")
    row = archived.first()
    assert row["payload"] == payload(20_000, 3) and row["to"].endswith("/dup.bin")
    entries, bad = A.manifest_entries(A.read_manifest(spark, out + "/arc/manifest"))
    e = entries.first()
    assert e["from"] == "/y/dup.bin" and e["created_unix"] == 123
    assert e["hash"] == hashlib.sha256(row["payload"]).hexdigest()
    assert bad.count() == 0
    # Undo: the original path is free and the archive copy verifies -> restore.
    live = kept.select("path")
    st = jobs.undo(spark, out + "/arc", live).collect()
    assert [(r["from"], r["status"]) for r in st] == [("/y/dup.bin", "restore")]
    # After restoring, a second undo changes nothing (idempotent): occupied.
    restored = live.unionByName(spark.createDataFrame([("/y/dup.bin",)], "path string"))
    assert jobs.undo(spark, out + "/arc", restored).first()["status"] == "occupied"


def test_no_overwrite_when_destination_exists(spark):
    removal = spark.createDataFrame([(1, "/a/model.gguf", 10), (2, "/b/model.gguf", 10), (3, "/c/x.gguf", 10)],
                                    "asset_id bigint, path string, size bigint")
    existing = spark.createDataFrame([("x.gguf",)], "name string")
    st = A.destination_status(removal, existing, F.element_at(F.split("path", "/"), -1))
    got = {r["asset_id"]: r["status"] for r in st.collect()}
    assert got == {1: "movable", 2: "name_collision", 3: "destination_exists"}


def test_undo_occupied_and_missing(spark):
    entries = spark.createDataFrame([("/o/a", "/arc/a", 5, "h1"), ("/o/b", "/arc/b", 5, "h2"),
                                     ("/o/c", "/arc/c", 5, "h3"), ("/o/d", "/arc/d", 5, "h4")],
                                    "from string, to string, size bigint, hash string")
    live = spark.createDataFrame([("/o/a",)], "path string")
    archived = spark.createDataFrame([("/arc/a", "h1"), ("/arc/c", "zz"), ("/arc/d", "h4")], "path string, hash string")
    st = {r["from"]: r["status"] for r in A.undo_status(entries, live, archived).collect()}
    assert st == {"/o/a": "occupied", "/o/b": "archive_missing", "/o/c": "hash_mismatch", "/o/d": "restore"}


def test_manifest_bad_and_blank_lines(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    (d / "part-0.json").write_text(
        '{"created_unix": 1, "destination": "x", "entries": [{"from": "a", "to": "b", "size": 1, "hash": "h"}]}\n'
        "\n" + "this is not json at all, and it goes on for quite a while beyond sixty characters\n")
    entries, bad = A.manifest_entries(A.read_manifest(spark, str(d)))
    assert entries.count() == 1
    lines = [r["line"] for r in bad.collect()]
    assert len(lines) == 1 and len(lines[0]) == 60


def test_policy_gate_splits_groups(spark):
    rows = [(f"/s/{i}", "loose", payload(n, 0)) for i, n in enumerate([100, 100, 5000, 5000, 5000])]
    d = D.find_duplicates(D.fingerprint_payloads(assets(spark, rows)), 1)
    p = P.reclaim_plan(d, cap=1000)
    assert p.allowed.count() == 1 and p.blocked.count() == 1
    assert p.blocked_rollup().first()["blocked_bytes"] == 10_000
    assert {r["size"] for r in p.removal.collect()} == {100}
    sel = P.reclaim_plan(d, groups=d.groups.where("size_each = 5000"))
    assert sel.removal.count() == 2


def test_failed_verification_removes_nothing(spark, tmp_path):
    """Rows whose archived copy does not match the plan are neither recorded nor
    removed; verified rows of the same run still are (per-row verification)."""
    df = assets(spark, [("/x/k.bin", "ollama", payload(1000, 1)), ("/y/d.bin", "loose", payload(1000, 1)),
                        ("/p/k2.bin", "ollama", payload(800, 3)), ("/q/d2.bin", "loose", payload(800, 3))])
    _, removal = plan_for(df)
    # The plan no longer matches the content of /y/d.bin.
    wrong = removal.withColumn("hash", F.when(F.col("path") == "/y/d.bin", F.lit("0" * 64)).otherwise(F.col("hash")))
    out = tmp_path / "o"
    st = {r["path"]: r["result"] for r in jobs.archive(spark, wrong, df, str(out / "arc"), str(out / "kept"),
                                                        now=1).collect()}
    assert st == {"/y/d.bin": "changed", "/q/d2.bin": "archived"}
    kept = {r["path"] for r in spark.read.parquet(str(out / "kept")).collect()}
    assert kept == {"/x/k.bin", "/y/d.bin", "/p/k2.bin"}
    entries, _ = A.manifest_entries(A.read_manifest(spark, str(out / "arc" / "manifest")))
    assert [r["from"] for r in entries.collect()] == ["/q/d2.bin"]
    # When nothing verifies, no manifest line is written and everything is kept.
    only_wrong = removal.withColumn("hash", F.lit("0" * 64))
    out2 = tmp_path / "o2"
    res = [r["result"] for r in jobs.archive(spark, only_wrong, df, str(out2 / "arc"), str(out2 / "kept"),
                                             now=1).collect()]
    assert sorted(res) == ["changed", "changed"]
    assert not (out2 / "arc" / "manifest").exists()
    assert spark.read.parquet(str(out2 / "kept")).count() == 4


def test_undo_ignores_folders_of_failed_runs(spark, tmp_path):
    df = assets(spark, [("/x/k.bin", "ollama", payload(900, 2)), ("/y/d.bin", "loose", payload(900, 2))])
    _, removal = plan_for(df)
    out = tmp_path / "o"
    # A failed run leaves a folder with a row for the same destination.
    stray = spark.createDataFrame([(99, "/y/d.bin", str(out / "arc") + "/d.bin", 3, b"xyz", "sha256")],
                                  "asset_id bigint, from string, to string, size bigint, payload binary, algo string")
    stray.write.parquet(str(out / "arc" / "data" / "run=failed"))
    jobs.archive(spark, removal, df, str(out / "arc"), str(out / "kept"), now=5)
    live = spark.read.parquet(str(out / "kept")).select("path")
    st = jobs.undo(spark, str(out / "arc"), live).collect()
    assert [(r["from"], r["status"]) for r in st] == [("/y/d.bin", "restore")]


def test_archive_rerun_skips_moved_rows_and_refuses_input_overwrite(spark, tmp_path):
    import pytest
    df = assets(spark, [("/x/k.bin", "ollama", payload(700, 4)), ("/y/d.bin", "loose", payload(700, 4))])
    _, removal = plan_for(df)
    out = tmp_path / "o"
    first = jobs.archive(spark, removal, df, str(out / "arc"), str(out / "kept"), now=1)
    assert [r["status"] for r in first.collect()] == ["movable"]
    again = jobs.archive(spark, removal, df, str(out / "arc"), str(out / "kept"), now=2)
    assert [r["status"] for r in again.collect()] == ["destination_exists"]
    entries, _ = A.manifest_entries(A.read_manifest(spark, str(out / "arc" / "manifest")))
    assert entries.count() == 1
    src = tmp_path / "src"
    df.write.parquet(str(src))
    table = spark.read.parquet(str(src))
    with pytest.raises(ValueError):
        jobs.archive(spark, removal, table, str(out / "arc2"), str(src), now=3)


def test_apply_undo_restores_and_is_idempotent(spark, tmp_path):
    df = assets(spark, [("/x/keep.bin", "ollama", payload(2000, 6)), ("/y/dup.bin", "loose", payload(2000, 6)),
                        ("/z/other.bin", "loose", payload(300, 1))])
    _, removal = plan_for(df)
    out = tmp_path / "o"
    jobs.archive(spark, removal, df, str(out / "arc"), str(out / "kept"), now=1)
    kept = spark.read.parquet(str(out / "kept"))
    st = jobs.apply_undo(spark, str(out / "arc"), kept, str(out / "restored"))
    assert [r["status"] for r in st.collect()] == ["restore"]
    restored = spark.read.parquet(str(out / "restored"))
    rows = {r["path"]: r for r in restored.collect()}
    assert set(rows) == {"/x/keep.bin", "/y/dup.bin", "/z/other.bin"}
    assert rows["/y/dup.bin"]["payload"] == payload(2000, 6) and rows["/y/dup.bin"]["store"] == "loose"
    again = jobs.apply_undo(spark, str(out / "arc"), restored, str(out / "restored2"))
    assert [r["status"] for r in again.collect()] == ["occupied"]
    assert spark.read.parquet(str(out / "restored2")).count() == 3


def test_archive_dry_run_writes_nothing(spark, tmp_path):
    df = assets(spark, [("/x/k.bin", "ollama", payload(500, 8)), ("/y/d.bin", "loose", payload(500, 8))])
    _, removal = plan_for(df)
    out = tmp_path / "o"
    st = jobs.archive(spark, removal, df, str(out / "arc"), str(out / "kept"), now=1, dry_run=True)
    assert [r["status"] for r in st.collect()] == ["movable"]
    assert not (out / "arc").exists() and not (out / "kept").exists()


def test_hot_paths_of_destination_and_verification_joins(spark):
    rows = [(f"/s{i}/model.gguf", "loose", payload(3000, 2)) for i in range(12)] + \
           [("/t/other.gguf", "loose", payload(3000, 5)), ("/u/other.gguf", "loose", payload(3000, 5))]
    df = assets(spark, rows)
    _, removal = plan_for(df)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    base = F.element_at(F.split("path", "/"), -1)
    none = spark.createDataFrame([], "name string")
    plain = A.destination_status(removal, none, base)
    hot = A.destination_status(removal, none, base, hot_rows=2)
    assert key(plain) == key(hot)
    assert sorted(r["status"] for r in hot.collect()).count("name_collision") == 10
    cur = D.fingerprint_payloads(df)
    assert key(P.verify_plan(removal, cur)) == key(P.verify_plan(removal, cur, hot_rows=2))
