import json

import pytest
from pyspark.sql import functions as F

from assetsweep.operators import archive as A
from assetsweep.operators import duplicates as D
from assetsweep.operators import plan as P
from assetsweep.operators.commits import CommitLog
from assetsweep.plans import jobs


def assets(spark, rows):
    return spark.createDataFrame([(i, path, path.rsplit("/", 1)[-1], "s", len(p), bytearray(p)) for i, path, p in rows],
                                 "asset_id bigint, path string, name string, store string, size bigint, payload binary")


def removal_of(df):
    return P.reclaim_plan(D.find_duplicates(D.fingerprint_payloads(df), min_size=1)).removal


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() == -1 and not log.exists()
    assert log.put(0, {"kind": "a"}) and not log.put(0, {"kind": "b"})
    for k in range(1, 12):
        assert log.put(k, {"kind": "c"}) and log.latest() == k and log.latest(k - 1) == k
    assert [r.kind for r in log.records().orderBy("version").collect()] == ["a"] + ["c"] * 11
    assert sorted(json.loads(p.read_text())["version"] for p in (tmp_path / "log").glob("*.json")) == list(range(12))
    assert not list((tmp_path / "log").glob(".*part"))


def test_commit_checks_what_came_between(spark, tmp_path):
    log, calls = CommitLog(spark, str(tmp_path / "log")), []
    log.put(0, {"kind": "x"})

    def check(first, last):
        calls.append((first, last))
        if len(calls) == 1:
            log.put(last + 1, {"kind": "y"})  # another one while this one checks
        return {"run": f"try{len(calls)}"}
    assert log.commit(-1, {"kind": "z", "run": "try0"}, check) == 2
    assert calls == [(0, 0), (1, 1)]
    assert [r.run for r in log.records().where("kind = 'z'").collect()] == ["try2"]


def test_two_interleaved_runs_record_each_name_once(spark, tmp_path, monkeypatch):
    """Run B begins and commits after run A has looked and copied, before A commits."""
    a = assets(spark, [(0, "/k/keep.bin", b"x" * 50), (1, "/a/dup.bin", b"x" * 50), (2, "/a/only.bin", b"x" * 50)])
    b = assets(spark, [(10, "/k/keep2.bin", b"y" * 50), (11, "/b/dup.bin", b"y" * 50), (12, "/b/more.bin", b"y" * 50)])
    arc, put, done = str(tmp_path / "arc"), CommitLog.put, {}

    def hooked(self, version, record):
        if not done:
            done["b"] = True
            done["b"] = jobs.archive(spark, removal_of(b), b, arc, str(tmp_path / "kept_b"), now=2).collect()
        return put(self, version, record)
    monkeypatch.setattr(CommitLog, "put", hooked)
    got_a = {r.asset_id: r.result for r in jobs.archive(spark, removal_of(a), a, arc, str(tmp_path / "kept_a"), now=1).collect()}
    assert {r.asset_id: r.result for r in done["b"]} == {11: "archived", 12: "archived"}
    assert got_a == {1: "name_taken", 2: "archived"}
    entries = jobs._entries(spark, arc).collect()
    assert sorted(r["from"] for r in entries) == ["/a/only.bin", "/b/dup.bin", "/b/more.bin"] and len({r["to"] for r in entries}) == 3
    # No row is lost: what was not recorded stays in the kept table.
    assert sorted(r.asset_id for r in spark.read.parquet(str(tmp_path / "kept_a")).collect()) == [0, 1]
    assert sorted(r.asset_id for r in spark.read.parquet(str(tmp_path / "kept_b")).collect()) == [10]


def test_the_same_run_twice_at_once_removes_each_row(spark, tmp_path, monkeypatch):
    a = assets(spark, [(0, "/k/keep.bin", b"x" * 50), (1, "/a/dup.bin", b"x" * 50)])
    arc, put, done = str(tmp_path / "arc"), CommitLog.put, {}

    def hooked(self, version, record):
        if not done:
            done["other"] = True
            jobs.archive(spark, removal_of(a), a, arc, str(tmp_path / "kept1"), now=1)
        return put(self, version, record)
    monkeypatch.setattr(CommitLog, "put", hooked)
    assert [r.result for r in jobs.archive(spark, removal_of(a), a, arc, str(tmp_path / "kept2"), now=1).collect()] == ["archived_before"]
    assert len(jobs._entries(spark, arc).collect()) == 1
    for k in ("kept1", "kept2"):
        assert [r.asset_id for r in spark.read.parquet(str(tmp_path / k)).collect()] == [0]


def fake_runs(spark, arc, n):
    """``n`` committed runs of one row each, written by a few jobs."""
    run = F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 5, "0"))
    row = spark.range(n).select(
        F.col("id").alias("asset_id"), F.concat(F.lit("/x/"), F.col("id")).alias("from"), F.concat(F.lit(f"{arc}/n"), F.col("id")).alias("to"),
        F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit("s").alias("store"), F.lit(3).cast("long").alias("size"),
        F.encode(F.lpad(F.col("id").cast("string"), 3, "0"), "UTF-8").alias("payload"), F.lit("sha256").alias("algo"), run.alias("run"))
    row.repartition(4).write.partitionBy("run").parquet(f"{arc}/data")
    entry = F.struct("from", "to", "size", F.sha2("payload", 256).alias("hash"), "algo")
    line = row.select(F.to_json(F.struct(F.lit(7).alias("created_unix"), F.concat(F.lit(f"{arc}/data/run="), F.col("run")).alias("destination"),
                                         F.array(entry).alias("entries"))).alias("value"), "run")
    line.repartition(4).write.partitionBy("run").text(f"{arc}/manifest")
    log = CommitLog(spark, f"{arc}/log")
    for k in range(n):
        assert log.put(k, {"kind": "archive", "run": f"r{k:05d}"})


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    small, large = (str(tmp_path_factory.mktemp("arc") / "a") for _ in range(2))
    fake_runs(spark, small, 3)
    fake_runs(spark, large, 500)
    return small, large


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_the_plan_does_not_grow_with_the_runs(spark, many):
    small, large = many
    sizes = []
    for arc in many:
        entries = jobs._entries(spark, arc)
        rows = jobs._runs(spark, arc, entries.where("`from` = '/x/1'"))
        sizes.append([len(x.splitlines()) for df in (entries, rows) for x in plan(df)])
        assert rows.count() == 1 and "dynamicpruning" in plan(rows)[1].lower()
    assert sizes[0] == sizes[1]
    live = spark.createDataFrame([("/x/2",)], "path string")
    status = {r["from"]: r.status for r in jobs.undo(spark, large, live).collect()}
    assert len(status) == 500 and status["/x/2"] == "occupied" and set(status.values()) == {"occupied", "restore"}


def test_snapshots_hold_entries_and_what_was_undone(spark, many, tmp_path):
    small = many[0]
    live = assets(spark, [(100, "/k/l.bin", b"l")])
    jobs.apply_undo(spark, small, live.unionByName(assets(spark, [(101, "/x/0", b"0"), (102, "/x/2", b"2")])), str(tmp_path / "live"), now=9)
    before = sorted(map(tuple, jobs._entries(spark, small).collect()))
    assert [r[-1] for r in before] == [False, True, False] and [r[2] for r in before] == ["/x/0", "/x/1", "/x/2"]
    version = jobs.compact_manifest(spark, small)
    assert sorted(map(tuple, jobs._entries(spark, small).collect())) == before
    commits = CommitLog(spark, f"{small}/log").records().where(f"version = {version}").first()
    assert commits.kind == "snapshot" and commits.covers == version - 1
    # Commits after the snapshot are read on top of it.
    a = assets(spark, [(0, "/k/keep.bin", b"x" * 50), (1, "/a/dup.bin", b"x" * 50)])
    jobs.archive(spark, removal_of(a), a, small, str(tmp_path / "kept"), now=1)
    assert len(jobs._entries(spark, small).collect()) == 4
    jobs.apply_undo(spark, small, live, str(tmp_path / "live2"), now=9)
    assert {r["from"]: r.undone for r in jobs._entries(spark, small).collect()} == {"/x/0": True, "/x/1": True, "/x/2": True, "/a/dup.bin": True}


def test_lines_written_without_a_log_are_taken_over(spark, tmp_path):
    arc = str(tmp_path / "arc")
    entry = [{"from": "/a/x", "to": f"{arc}/x", "size": 1, "hash": "h", "algo": "sha256"}]
    (tmp_path / "arc" / "manifest").mkdir(parents=True)
    (tmp_path / "arc" / "manifest" / "part-0000.json").write_text(json.dumps({"created_unix": 1, "destination": f"{arc}/data/run=old", "entries": entry}) + "\n\n")
    a = assets(spark, [(0, "/k/keep.bin", b"x" * 50), (1, "/a/dup.bin", b"x" * 50)])
    jobs.archive(spark, removal_of(a), a, arc, str(tmp_path / "kept"), now=1)
    assert sorted(r["from"] for r in jobs._entries(spark, arc).collect()) == ["/a/dup.bin", "/a/x"]
    assert A.manifest_entries(A.read_manifest(spark, f"{arc}/manifest"))[0].count() == 2


def test_cached_duplicates_count_hard_links_once(spark, tmp_path):
    import os
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.gguf").write_bytes(b"z" * 20_000)
    os.link(tmp_path / "s" / "a.gguf", tmp_path / "s" / "b.gguf")
    stores = [("s", str(tmp_path / "s"), "*.gguf")]
    for _ in range(2):
        assert jobs.find_file_duplicates_cached(spark, stores, str(tmp_path / "cache"), 1).groups.count() == 0
    (tmp_path / "s" / "c.gguf").write_bytes(b"z" * 20_000)
    assert [r.n_members for r in jobs.find_file_duplicates_cached(spark, stores, str(tmp_path / "cache"), 1).groups.collect()] == [2]
