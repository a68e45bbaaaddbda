"""The usage flow shown in the README, end to end on files in a scratch folder."""

from pyspark.sql import functions as F

from assetsweep.operators import inventory as INV
from assetsweep.plans import jobs
from assetsweep.sources import files as FS
from assetsweep.plans import sample_headers as SH

GIB = 1024 ** 3


def test_readme_flow(spark, tmp_path):
    kvs = [("general.architecture", "str", "llama"), ("general.name", "str", "m"),
           ("llama.block_count", "u32", 32), ("llama.embedding_length", "u32", 4096),
           ("llama.attention.head_count", "u32", 32), ("llama.attention.head_count_kv", "u32", 8)]
    blob = SH.encode_header(3, kvs, [("w", [4096, 4096], 1)]) + bytes(5000)
    (tmp_path / "ollama").mkdir()
    (tmp_path / "custom").mkdir()
    (tmp_path / "ollama" / "m.gguf").write_bytes(blob)
    (tmp_path / "custom" / "m-copy.gguf").write_bytes(blob)
    stores = [("ollama", str(tmp_path / "ollama"), "*.gguf"), ("custom", str(tmp_path / "custom"), "*.gguf")]

    dups = jobs.find_file_duplicates(spark, stores, min_size=1000)
    plan = jobs.reclaim_plan(dups, keep="preferred", cap=GIB)
    removal = plan.removal
    assert [r["store"] for r in removal.collect()] == ["custom"]

    # Table form of the same files, with payloads, for archiving.
    files = FS.with_asset_ids(FS.scan_stores(spark, stores))
    content = spark.read.format("binaryFile").load([s[1] for s in stores]).select("path", "content")
    assets = files.join(content, "path").select("asset_id", "path", "name", "store", "size",
                                                F.col("content").alias("payload"))
    out = tmp_path / "out"
    st = jobs.archive(spark, removal, assets, str(out / "arc"), str(out / "kept"), dry_run=True)
    assert [r["status"] for r in st.collect()] == ["movable"]
    jobs.archive(spark, removal, assets, str(out / "arc"), str(out / "kept"), now=1)
    live = spark.read.parquet(str(out / "kept"))
    assert [r["status"] for r in jobs.undo(spark, str(out / "arc"), live.select("path")).collect()] == ["restore"]
    jobs.apply_undo(spark, str(out / "arc"), live, str(out / "restored"))
    assert spark.read.parquet(str(out / "restored")).count() == 2

    named = INV.with_name_parts(files)
    cat = jobs.catalog_headers(named.select("path"), from_paths=True)
    cat = jobs.with_shard_weights(cat, named)
    devices = spark.createDataFrame([("box", 16 * GIB, [8 * GIB])], "device string, ram_total bigint, vram array<bigint>")
    fit = jobs.capacity_fit(cat, devices, contexts=[8192]).collect()
    assert len(fit) == 2 and {r["note"] for r in fit} == {"fits on the largest GPU"}
