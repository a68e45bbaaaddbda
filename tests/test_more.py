"""Device exports, JSON report, labels, store summaries, top-k."""

import json

from pyspark.sql import functions as F

from assetsweep.functions import scalars as S
from assetsweep.operators import capacity as CAP
from assetsweep.operators import inventory as I
from assetsweep.plans import report as R
from assetsweep.sources import devices as DEV

GIB = 1024 ** 3


def test_vram_exports(spark, tmp_path):
    d = tmp_path / "gpu"
    d.mkdir()
    (d / "box1.csv").write_text("24576\n 8192 \n")
    (d / "box2.csv").write_text("n/a\n\n-5\n")
    vram = DEV.read_vram_exports(spark, str(d))
    got = {r["device"]: sorted(r["vram"]) for r in vram.collect()}
    assert got == {"box1": [8192 * 1024 ** 2, 24576 * 1024 ** 2], "box2": []}
    ram = spark.createDataFrame([("box1", 64 * GIB), ("box3", 0)], "device string, ram_total bigint")
    devs = DEV.devices_table(vram, ram)
    rows = {r["device"]: (r["ram_total"], r["vram"]) for r in devs.collect()}
    assert rows["box2"] == (0, []) and rows["box3"] == (0, [])
    cat = spark.createDataFrame([("m", 4_700_000_000, 32, 4096, 32, 8, None)],
                                "path string, weights_bytes bigint, n_layers bigint, n_embd bigint, "
                                "n_head bigint, n_head_kv bigint, context_length bigint")
    fit = {r["device"]: r for r in CAP.capacity_fit(cat, devs).collect()}
    assert fit["box1"]["fits_largest_gpu"] is True and fit["box1"]["context_tokens"] == 8192
    assert fit["box1"]["largest_gpu"] == 24576 * 1024 ** 2
    assert fit["box3"]["note"] == "memory unknown: cannot judge"


def test_json_report_omits_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, "t")], "id bigint, name string, tag string")
    out = str(tmp_path / "rep")
    R.write_json_report(df, out)
    texts = [p.read_text() for p in (tmp_path / "rep").glob("part-*")]
    lines = sorted((json.loads(x) for t in texts for x in lines_of(t)), key=lambda d: d["id"])
    assert lines == [{"id": 1, "name": "a"}, {"id": 2, "tag": "t"}]
    js = sorted(r["json"] for r in R.to_json_rows(df).collect())
    assert js == ['{"id":1,"name":"a"}', '{"id":2,"tag":"t"}']


def lines_of(text):
    return [x for x in text.splitlines() if x.strip()]


def test_labels(spark):
    df = spark.createDataFrame([("ollama", 8_030_261_248), ("lm_studio", None), ("other", 1)],
                               "store string, p bigint")
    got = [(r[0], r[1]) for r in df.select(S.store_label("store"), S.billions_label("p")).collect()]
    assert got == [("Ollama", "8.03B"), ("LM Studio", None), (None, "0.00B")]
    sizes = spark.createDataFrame([(1000,), (1024 * 1024 * 3 // 2,)], "s bigint")
    assert [r[0] for r in sizes.select(S.human_bytes("s")).collect()] == ["1000 B", "1.50 MB"]


def test_store_summary_boundary_and_empty(spark):
    assets = spark.createDataFrame([("/m/a/x.gguf", 10), ("/m/ab/y.gguf", 5), ("/m/a", 1)], "path string, size bigint")
    stores = spark.createDataFrame([("k", "/m/a"), ("e", "/nowhere")], "kind string, root string")
    b = {r["root"]: (r["files"], r["bytes"]) for r in I.store_summaries(assets, stores, True).collect()}
    p = {r["root"]: (r["files"], r["bytes"]) for r in I.store_summaries(assets, stores, False).collect()}
    assert b == {"/m/a": (2, 11), "/nowhere": (0, 0)}
    assert p == {"/m/a": (3, 16), "/nowhere": (0, 0)}


def test_top_rows(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 9, 9, 1, 7])], "asset_id bigint, size bigint")
    top = R.top_rows(df, [F.desc("size"), F.asc("asset_id")], 3).collect()
    assert [(r["rank"], r["asset_id"], r["n_more"]) for r in top] == [(1, 1, 2), (2, 2, 2), (3, 4, 2)]


def test_union_scans_keeps_one_row_per_path(spark):
    a = spark.createDataFrame([("/r/x", 1, "custom")], "path string, size bigint, store string")
    b = spark.createDataFrame([("/r/x", 1, "custom"), ("/r/y", 2, "custom")], "path string, size bigint, store string")
    assert I.union_scans(a, b).count() == 2


def test_shard_weights_feed_capacity(spark):
    from assetsweep.operators import inventory as INV
    assets = INV.with_name_parts(spark.createDataFrame(
        [("/m/q-00001-of-00002.gguf", 3 * GIB), ("/m/q-00002-of-00002.gguf", 2 * GIB), ("/m/solo.gguf", GIB)],
        "path string, size bigint").withColumn("name", F.lit(None).cast("string")))
    cat = spark.createDataFrame([("/m/q-00001-of-00002.gguf",), ("/m/solo.gguf",)], "path string")
    w = {r["path"]: (r["weights_bytes"], r["shards"]) for r in CAP.with_shard_weights(cat, assets).collect()}
    assert w == {"/m/q-00001-of-00002.gguf": (5 * GIB, 2), "/m/solo.gguf": (GIB, 1)}


def test_inventory_job_with_tags(spark, tmp_path):
    from assetsweep.plans import jobs
    from assetsweep.sources import files as FS
    from assetsweep.sources import manifests as MAN
    root = tmp_path / "models"
    blobs = root / "blobs"
    man = root / "manifests" / "registry.example" / "library" / "llama3"
    blobs.mkdir(parents=True)
    man.mkdir(parents=True)
    (blobs / "sha256-big").write_bytes(b"GGUF" + bytes(100))
    (blobs / "sha256-cfg").write_bytes(b"GGUF" + bytes(10))
    (man / "latest").write_text('{"schemaVersion": 2, "config": {"digest": "sha256:zzz"}, "layers": ['
                                '{"digest": "sha256:big", "mediaType": "m", "size": 104}, '
                                '{"digest": "sha256:cfg", "mediaType": "p", "size": 14}]}')
    tags = MAN.manifest_tags(MAN.read_manifest_files(spark, str(root / "manifests")))
    assert {(r["blob"], r["tag"]) for r in tags.collect()} == {("sha256-big", "llama3:latest"),
                                                              ("sha256-cfg", "llama3:latest")}
    assets = FS.list_files(spark, str(blobs), "sha256-*", "ollama")
    stores = spark.createDataFrame([("ollama", "file:" + str(root)), ("lm_studio", "file:/nowhere")],
                                   "kind string, root string")
    inv = jobs.inventory(assets, stores, tags)
    assert {(r["name"], r["tag"]) for r in inv.assets.collect()} == {("sha256-big", "llama3:latest"),
                                                                    ("sha256-cfg", "llama3:latest")}
    st = {r["kind"]: (r["files"], r["bytes"]) for r in inv.stores.collect()}
    assert st == {"ollama": (2, 118), "lm_studio": (0, 0)}
    t = inv.totals.first()
    assert (t["total_files"], t["total_bytes"]) == (2, 118)


def test_catalog_to_capacity_from_files(spark, tmp_path):
    from assetsweep.operators import inventory as INV
    from assetsweep.plans import jobs
    from assetsweep.sources import files as FS
    from assetsweep.plans import sample_headers as SH
    kvs = [("general.architecture", "str", "llama"), ("llama.block_count", "u32", 32),
           ("llama.embedding_length", "u32", 4096), ("llama.attention.head_count", "u32", 32),
           ("llama.attention.head_count_kv", "u32", 8), ("llama.context_length", "u32", 8192)]
    (tmp_path / "m-00001-of-00002.gguf").write_bytes(SH.encode_header(3, kvs, []) + bytes(1000))
    (tmp_path / "m-00002-of-00002.gguf").write_bytes(b"\0" * 3000)
    files = INV.with_name_parts(FS.list_files(spark, str(tmp_path)))
    cat = jobs.catalog_headers(files.select("path"), from_paths=True)
    cat = CAP.with_shard_weights(cat, files)
    fit = CAP.capacity_fit(cat, [("box", 64 * GIB, [24 * GIB])])
    r = fit.first()
    assert fit.count() == 1  # the second shard has no header
    assert r["weights_bytes"] == files.agg(F.sum("size")).first()[0] and r["shards"] == 2
    assert r["kv_cache_bytes"] == 1073741824 and r["note"] == "fits on the largest GPU"


def test_checkpoint_dir_when_unset_and_when_named():
    from assetsweep.session import checkpoint_dir

    class Ctx:
        master = "local[4]"

        def __init__(self, d=None):
            self.d = d

        def getCheckpointDir(self):
            return self.d

        def setCheckpointDir(self, d):
            self.d = d

    class Conf:
        def __init__(self, v):
            self.v = v

        def get(self, k, default=None):
            return self.v if k == "spark.checkpoint.dir" else default

        def set(self, k, v):
            raise AssertionError("core setting must not be changed at run time")

    class Sess:
        def __init__(self, named, ctx_dir):
            self.conf, self.sparkContext = Conf(named), Ctx(ctx_dir)

    s = Sess(None, None)
    d = checkpoint_dir(s)
    assert d and s.sparkContext.d == d                       # scratch folder, set on the context
    s = Sess("hdfs://nn/shared/ckpt", None)
    assert checkpoint_dir(s) == "hdfs://nn/shared/ckpt" and s.sparkContext.d == "hdfs://nn/shared/ckpt"
    s = Sess("hdfs://nn/shared/ckpt", "hdfs://nn/shared/ckpt/uuid")
    assert checkpoint_dir(s) == "hdfs://nn/shared/ckpt"       # already applied by Spark


def test_vram_exports_drop_overflowing_figures(spark, tmp_path):
    d = tmp_path / "gpu2"
    d.mkdir()
    (d / "odd.csv").write_text("9223372036854775807\n12.5\n1024\n")
    got = {r["device"]: r["vram"] for r in DEV.read_vram_exports(spark, str(d)).collect()}
    assert got == {"odd": [1024 * 1024 ** 2]}
