import os

import pytest

from assetsweep.plans import jobs
from assetsweep.sources import files as FS
from assetsweep.sources import listing as L


def tree(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return str(root)


def names(df, root):
    return sorted(r.path.removeprefix(f"file:{root}/") for r in df.collect())


FILES = {".cache/c.gguf": b"1", "_snap/d.gguf": b"22", "a/b/c/d/e/f.gguf": b"333", "top.gguf": b"4", "a/.hidden.gguf": b"5", "a/_x.GGUF": b"6",
         "a/empty.gguf": b"", "a/note.txt": b"7", "sp ace/q%20r+.gguf": b"8"}


def test_every_name_is_listed_with_its_size(spark, tmp_path):
    root = tree(tmp_path / "r", FILES)
    os.symlink(f"{root}/top.gguf", f"{root}/link.gguf")
    os.symlink(f"{root}/a", f"{root}/linked_dir")
    got = {r.path.removeprefix(f"file:{root}/"): (r.size, r.name, r.store) for r in L.list_trees(spark, [("s", root, "*.gguf")]).collect()}
    assert got == {k: (len(v), k.rsplit("/", 1)[-1], "s") for k, v in FILES.items() if k.endswith(".gguf") and v}
    assert names(L.list_trees(spark, [(None, root, None)], min_size=0), root) == sorted(FILES)
    assert names(L.list_trees(spark, [(None, root, "{*.txt,t*}")]), root) == ["a/note.txt", "top.gguf"]


@pytest.mark.parametrize("share, queue", [(1, 1), (2, 5), (3, 1), (7, 100)])
def test_rounds_give_the_same_tree(spark, tmp_path, share, queue):
    files = {f"d{a}/e{b}/f{c}.gguf": bytes(a + b + c + 1) for a in range(3) for b in range(3) for c in range(3)}
    files |= {f"wide/{k}.gguf": b"x" for k in range(20)}
    root = tree(tmp_path / "r", files)
    assert names(L.list_trees(spark, [(None, root, "*.gguf")], share=share, queue=queue), root) == sorted(files)


def test_roots_of_several_kinds(spark, tmp_path):
    root = tree(tmp_path / "r", FILES)
    one = [("file", f"{root}/top.gguf", None), ("gone", f"{root}/nowhere", None), ("dir", f"file://{root}/a", "*.gguf")]
    assert sorted((r.store, r.name) for r in L.list_trees(spark, one).collect()) == [("dir", ".hidden.gguf"), ("dir", "f.gguf"), ("file", "top.gguf")]
    assert L.list_trees(spark, []).collect() == []
    # A path below two roots counts once in a scan of stores, for the smallest store name.
    both = FS.scan_stores(spark, [("b", root, "*.gguf"), ("a", f"{root}/a", "*.gguf")]).collect()
    assert sorted((r.store, r.name) for r in both if r.name == "f.gguf") == [("a", "f.gguf")] and len(both) == 6


def test_a_flat_directory_of_100000_names(spark, tmp_path):
    root = tmp_path / "flat"
    root.mkdir()
    for k in range(100_000):
        os.close(os.open(f"{root}/{'_.x'[k % 3]}{k}.gguf", os.O_CREAT | os.O_WRONLY))
    with open(root / "full.gguf", "wb") as f:
        f.write(b"z")
    df = L.list_trees(spark, [(None, str(root), "*.gguf")], min_size=0)
    assert df.count() == 100_001
    # Names come in pages; the sizes are asked for by many tasks, not by the one that read the directory.
    assert df.rdd.getNumPartitions() > 1
    pages = list(L._round(L.SHARE, L.QUEUE)([L.pa.RecordBatch.from_arrays([L.pa.array([x]) for x in ("s", "*.gguf", str(root))], names=["store", "glob", "path"])]))
    assert max(p.num_rows for p in pages) == L.PAGE and sum(p.num_rows for p in pages) == 100_001


def test_names_that_are_no_text(spark, tmp_path):
    root = os.fsencode(str(tmp_path / "r"))
    os.makedirs(root + b"/bad\xff")
    for name in (b"/bad\xff/in.gguf", b"/caf\xe9.gguf", b"/good.gguf"):
        with open(root + name, "wb") as f:
            f.write(b"1")
    got = sorted(r["name"] for r in L.list_trees(spark, [(None, str(tmp_path / "r"), "*.gguf")], share=1).collect())
    assert got == ["caf\ufffd.gguf", "good.gguf", "in.gguf"]
    d = FS.hash_files(FS.with_asset_ids(FS.list_files(spark, str(tmp_path / "r")))).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.ok) for r in d) == [("caf\ufffd.gguf", False), ("good.gguf", True), ("in.gguf", False)]


def test_file_jobs_see_hidden_names(spark, tmp_path):
    root = tree(tmp_path / "r", {".cache/c.gguf": b"same" * 100, "_snap/d.gguf": b"same" * 100, "e.gguf": b"other" * 100})
    d = jobs.find_file_duplicates(spark, [("s", root, "*.gguf")], 1)
    assert [r["n_members"] for r in d.groups.collect()] == [2]
    assert jobs.file_inventory(spark, [("s", root, "*.gguf")], no_parse=True).assets.count() == 3


def test_empty_and_hidden_exports_keep_their_device(spark, tmp_path):
    from assetsweep.sources.devices import read_vram_exports
    root = tree(tmp_path / "v", {"one.csv": b"8192\n\n1024", "empty.csv": b"", "_two.csv": b"x\n-1\n 512 \r\n"})
    got = {r.device: sorted(r.vram) for r in read_vram_exports(spark, root).collect()}
    assert got == {"one": [1024 << 20, 8192 << 20], "empty": [], "_two": [512 << 20]}


def test_manifests_under_hidden_names(spark, tmp_path):
    from assetsweep.sources.manifests import read_manifest_files
    root = tree(tmp_path / "m", {"reg/lib/.m/_tag": b"{}", "reg/lib/m/a b": b"[1]"})
    assert sorted(tuple(r) for r in read_manifest_files(spark, f"file://{root}").collect()) == [("reg/lib/.m/_tag", "{}"), ("reg/lib/m/a b", "[1]")]
