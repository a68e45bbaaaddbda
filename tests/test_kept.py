import os

from assetsweep.plans import jobs
from assetsweep.plans.sample_headers import encode_header
from assetsweep.sources import files as FS
from assetsweep.sources.kept import KeptRows


def model(root, name, arch, pad=0):
    (root / name).write_bytes(encode_header(3, [("general.architecture", "str", arch), ("general.name", "str", name)], []) + b"." * pad)


def test_unchanged_files_are_not_opened_again(spark, tmp_path):
    root, kept = tmp_path / "m", str(tmp_path / "kept")
    root.mkdir()
    for k in range(6):
        model(root, f"m{k}.gguf", f"arch{k}")
    (root / "bad.gguf").write_bytes(b"no header at all")
    stores = [("s", str(root), "*.gguf")]
    show = lambda inv: {r.name: (r.architecture, r.header_name) for r in inv.assets.collect()}
    plain = show(jobs.file_inventory(spark, stores))
    assert show(jobs.file_inventory(spark, stores, kept=kept)) == plain and plain["m3.gguf"] == ("arch3", "m3.gguf")
    batches = lambda: len(os.listdir(f"{kept}/rows"))
    assert batches() == 1
    # The content goes away while size and time stay: what is known is not read again.
    for p in root.iterdir():
        s = p.stat()
        p.write_bytes(b"0" * s.st_size)
        os.utime(p, ns=(s.st_atime_ns, s.st_mtime_ns))
    assert show(jobs.file_inventory(spark, stores, kept=kept)) == plain and batches() == 1
    # A changed and a new file are read, and only they.
    model(root, "m0.gguf", "changed", pad=9)
    model(root, "new.gguf", "fresh")
    got = show(jobs.file_inventory(spark, stores, kept=kept))
    assert got == plain | {"m0.gguf": ("changed", "m0.gguf"), "new.gguf": ("fresh", "new.gguf")} and batches() == 2
    (root / "m5.gguf").unlink()
    files = FS.scan_stores(spark, stores)
    table = KeptRows(spark, kept, jobs.KEPT_HEADERS)
    before = table.rows().where("section = 'header'").count()
    jobs.compact_headers(spark, files, kept)
    assert (before, table.rows().where("section = 'header'").count()) == (9, 7)
    assert show(jobs.file_inventory(spark, stores, kept=kept)) == {k: v for k, v in got.items() if k != "m5.gguf"} and batches() == 3


def test_rows_added_while_a_snapshot_is_made_are_kept(spark, tmp_path):
    table = KeptRows(spark, str(tmp_path / "t"), spark.createDataFrame([], "path string, size long, modificationTime timestamp, v int").schema)
    assert table.rows().count() == 0
    row = lambda v: spark.createDataFrame([(f"p{v}", 1, None, v)], table.schema).withColumn("modificationTime", jobs.F.timestamp_seconds(jobs.F.lit(v)))
    for v in (1, 2, 3):
        table.add(row(v))
    write = table._write

    def slow(rows):
        run = write(rows)
        table._write = write
        table.add(row(4))  # commits before the snapshot does
        return run
    table._write = slow
    table.compact(row(1).unionByName(row(3)))
    assert sorted(r.v for r in table.rows().collect()) == [1, 3, 4]
    table.add(row(5))
    assert sorted(r.v for r in table.rows().collect()) == [1, 3, 4, 5]
