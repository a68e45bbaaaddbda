"""Duplicate detection fixtures (FIXTURES.md 1, 2) and invariants."""

import os

from pyspark.sql import functions as F

from assetsweep.operators import duplicates as D
from assetsweep.operators import inventory as I
from assetsweep.operators import plan as P
from assetsweep.sources import files as FS
from assetsweep.sources import tables


def ramp(n, mod=251):
    return bytes(i % mod for i in range(n))


def assets(spark, rows):
    return spark.createDataFrame(
        [(i, f"/s/{name}", name, store, len(p), p) for i, (name, store, p) in enumerate(rows)],
        "asset_id bigint, path string, name string, store string, size bigint, payload binary")


def groups_of(dups):
    m = dups.members().collect()
    out = {}
    for r in m:
        out.setdefault(r["group_id"], set()).add(r["path"].rsplit("/", 1)[-1])
    return sorted(out.values(), key=sorted)


def test_identical_and_near(spark):
    a = ramp(1_000_000)
    c = bytearray(a)
    c[500_000] ^= 0xFF
    df = assets(spark, [("a", "loose", a), ("b", "loose", a), ("c", "loose", bytes(c))])
    d = D.find_duplicates(D.fingerprint_payloads(df), min_size=1000)
    g = d.groups.collect()
    assert len(g) == 1 and g[0]["size_each"] == 1_000_000 and g[0]["reclaimable"] == 1_000_000
    assert groups_of(d) == [{"a", "b"}]


def test_same_ends_other_middle(spark):
    x = bytearray([7] * 100_000)
    y = bytearray(x)
    x[50_000], y[50_000] = 1, 2
    fp = D.fingerprint_payloads(assets(spark, [("x", "loose", bytes(x)), ("y", "loose", bytes(y))]))
    r = fp.collect()
    assert r[0]["head_hash"] == r[1]["head_hash"] and r[0]["tail_hash"] == r[1]["tail_hash"]
    assert r[0]["hash"] != r[1]["hash"]
    assert D.find_duplicates(fp, min_size=1).groups.count() == 0


def test_below_minimum(spark):
    fp = D.fingerprint_payloads(assets(spark, [("a", "loose", b"same"), ("b", "loose", b"same")]))
    assert D.find_duplicates(fp).groups.count() == 0          # default 8 MiB
    assert D.find_duplicates(fp, min_size=4).groups.count() == 1  # inclusive


def test_shards(spark):
    s1 = bytearray(ramp(50_000))
    s2 = bytearray(s1)
    s2[10] ^= 1
    df = assets(spark, [("m-00001-of-00002.gguf", "loose", bytes(s1)), ("m-00002-of-00002.gguf", "loose", bytes(s2))])
    fp = D.fingerprint_payloads(df)
    assert D.find_duplicates(fp, min_size=1).groups.count() == 0
    # Identical shards of one split: grouped by default (code behaviour), not with the option.
    same = I.with_name_parts(assets(spark, [("m-00001-of-00002.gguf", "loose", bytes(s1)),
                                            ("m-00002-of-00002.gguf", "loose", bytes(s1)),
                                            ("other.gguf", "loose", bytes(s1))]))
    fp2 = D.fingerprint_payloads(same, keep=("split_group",))
    assert D.find_duplicates(fp2, min_size=1).groups.first()["n_members"] == 3
    g = D.find_duplicates(fp2, min_size=1, exclude_same_split=True).groups.collect()
    assert len(g) == 1 and g[0]["n_members"] == 2


def test_keeper_prefers_managed_store(spark):
    p = ramp(10_000)
    d = D.find_duplicates(D.fingerprint_payloads(assets(spark, [("l", "loose", p), ("o", "ollama", p)])), 1)
    assert d.groups.first()["keeper_id"] == 1
    first = P.reclaim_plan(d, keep="first").removal.collect()
    assert [r["asset_id"] for r in first] == [1]


def test_hot_group_split_matches_plain_join(spark):
    p = ramp(5000)
    rows = [(f"f{i}", "loose", p) for i in range(40)] + [("u", "loose", ramp(5000, 13)), ("v", "loose", ramp(5000, 13))]
    fp = D.fingerprint_payloads(assets(spark, rows))
    plain = D.find_duplicates(fp, 1)
    hot = D.find_duplicates(fp, 1, hot_rows=5)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(plain.members()) == key(hot.members())
    assert hot.members().count() == 42


def test_invariants_on_documents(spark):
    a = tables.documents_assets(spark, "/root/testdata/sf0.001")
    d = D.find_duplicates(D.fingerprint_payloads(a), 1, managed=["src0"])
    plan = P.reclaim_plan(d)
    kept = P.kept_assets(a, plan.removal)
    assert kept.count() + plan.removal.count() == a.count()
    tot = d.totals().first()
    assert tot["reclaimable"] == plan.removal.agg(F.sum("size")).first()[0]
    assert (tot["n_groups"], tot["n_members"], tot["reclaimable"]) == (10, 21, 29443)


def test_zero_duplicate_tables(spark):
    for fn in (tables.pages_assets, tables.conversations_assets):
        assert D.find_duplicates(D.fingerprint_payloads(fn(spark, "/root/testdata/sf0.001")), 1).groups.count() == 0


def test_files_end_to_end(spark, tmp_path):
    a = ramp(1_000_000)
    c = bytearray(a)
    c[500_000] ^= 0xFF
    root = tmp_path / "store"
    (root / "sub").mkdir(parents=True)
    (root / "a.gguf").write_bytes(a)
    (root / "sub" / "b.gguf").write_bytes(a)
    (root / "c.gguf").write_bytes(bytes(c))
    (root / "gone.gguf").write_bytes(ramp(1_000_000, 7))
    (root / "gone2.gguf").write_bytes(ramp(1_000_000, 7))
    (root / "notes.txt").write_bytes(b"skip me")
    # Overlapping roots list each file once.
    files = FS.with_asset_ids(FS.scan_stores(spark, [("custom", str(root), "*.gguf"),
                                                     ("custom", str(root / "sub"), "*.gguf")]))
    assert files.count() == 5
    listed = files.cache()
    listed.count()
    os.remove(root / "gone2.gguf")
    fp = FS.prefiltered_fingerprints(listed, min_size=1000).cache()
    bad = D.quarantine(fp).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in bad] == ["gone2.gguf"]
    d = D.find_duplicates(fp, min_size=1000)
    assert groups_of(d) == [{"a.gguf", "b.gguf"}]


def test_store_walk(spark, tmp_path):
    blobs = tmp_path / "ollama" / "blobs"
    blobs.mkdir(parents=True)
    (blobs / "sha256-abc").write_bytes(b"GGUF" + bytes(64))
    (blobs / "sha256-notgguf").write_bytes(b"not a model")
    lm = tmp_path / "lm" / "org" / "repo"
    lm.mkdir(parents=True)
    (lm / "model.gguf").write_bytes(b"whatever")
    (lm / "notes.txt").write_bytes(b"skip me")
    blob_files = FS.with_magic(FS.list_files(spark, str(blobs), "sha256-*", "ollama")).where("has_magic")
    models = FS.list_files(spark, str(tmp_path / "lm"), "*.gguf", "lm_studio")
    found = {(r["store"], r["name"]) for r in blob_files.drop("has_magic").unionByName(models).collect()}
    assert found == {("ollama", "sha256-abc"), ("lm_studio", "model.gguf")}


def test_physical_ids_count_once(spark):
    p = ramp(3000)
    df = spark.createDataFrame(
        [(0, "/a/x", "loose", 3000, p, "ino1"), (1, "/b/x-link", "loose", 3000, p, "ino1"),
         (2, "/c/y", "loose", 3000, p, "ino2")],
        "asset_id bigint, path string, store string, size bigint, payload binary, physical_id string")
    fp = D.fingerprint_payloads(df, keep=("physical_id",))
    g = D.find_duplicates(fp, 1).groups.collect()
    assert len(g) == 1 and g[0]["n_members"] == 2 and g[0]["reclaimable"] == 3000


def test_edge_windows_and_file_hash_agree_with_column_hash(spark, tmp_path):
    import hashlib
    blobs = {"small": ramp(3000), "exact": ramp(4096), "big": ramp(10_000, 7)}
    df = assets(spark, [(n, "loose", b) for n, b in blobs.items()])
    col = {r["path"].rsplit("/", 1)[-1]: r for r in D.fingerprint_payloads(df).collect()}
    for n, b in blobs.items():
        (tmp_path / n).write_bytes(b)
        want_tail = b[-4096:] if len(b) > 4096 else b
        assert col[n]["hash"] == hashlib.sha256(b).hexdigest()
        assert col[n]["head_hash"] == hashlib.sha256(b[:4096]).hexdigest()
        assert col[n]["tail_hash"] == hashlib.sha256(want_tail).hexdigest()
    files = FS.with_asset_ids(FS.list_files(spark, str(tmp_path), None, "loose"))
    for r in FS.hash_files(files).collect():
        c = col[r["path"].rsplit("/", 1)[-1]]
        assert (r["size"], r["hash"], r["head_hash"], r["tail_hash"]) == \
            (c["size"], c["hash"], c["head_hash"], c["tail_hash"])


def test_find_file_duplicates_job(spark, tmp_path):
    from assetsweep.plans import jobs
    a = tmp_path / "a"
    b = tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "m.gguf").write_bytes(ramp(20_000))
    (b / "m-copy.gguf").write_bytes(ramp(20_000))
    (b / "other.gguf").write_bytes(ramp(20_000, 3))
    d = jobs.find_file_duplicates(spark, [("ollama", str(a), "*.gguf"), ("custom", str(b), "*.gguf")], 1000)
    g = d.groups.first()
    assert d.groups.count() == 1 and g["n_members"] == 2
    keeper = [r for r in d.members().collect() if r["is_keeper"]][0]
    assert keeper["store"] == "ollama"


def test_listing_keeps_hidden_names(spark, tmp_path):
    root = tmp_path / "r"
    (root / ".cache" / "x").mkdir(parents=True)
    (root / "_tmp").mkdir()
    (root / "pub").mkdir()
    (root / ".cache" / "x" / "a.gguf").write_bytes(b"1" * 10)
    (root / "_tmp" / "b.gguf").write_bytes(b"2" * 10)
    (root / "pub" / "c.gguf").write_bytes(b"3" * 10)
    (root / "pub" / "empty.gguf").write_bytes(b"")
    (root / "top.gguf").write_bytes(b"4" * 10)
    (root / "notes.txt").write_bytes(b"5" * 10)
    all_names = {r["name"] for r in FS.list_files(spark, str(root)).collect()}
    assert all_names == {"a.gguf", "b.gguf", "c.gguf", "top.gguf"}
    rows = FS.list_files(spark, str(root), None).collect()
    assert {r["name"] for r in rows} == {"a.gguf", "b.gguf", "c.gguf", "top.gguf", "notes.txt"}
    assert all(r["path"].startswith("file:/") and r["modificationTime"] is not None for r in rows)


def test_prefilter_gives_same_groups(spark):
    from assetsweep.plans import jobs
    a = tables.documents_assets(spark, "/root/testdata/sf0.001")
    key = lambda d: sorted(tuple(r) for r in d.groups.select("group_id", "n_members", "reclaimable").collect())
    assert key(jobs.find_duplicates(a, 1, prefilter=True)) == key(jobs.find_duplicates(a, 1))
