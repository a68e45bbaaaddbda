"""Scalar functions against the reference's pinned values (FIXTURES.md 2, 4, 6)."""

from pyspark.sql import functions as F

from assetsweep.functions import scalars as S

GIB = 1024 ** 3


def one(spark, col, value, ddl):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(col(F.col("v")).alias("r")).first()["r"]


def test_human_bytes(spark):
    got = [one(spark, S.human_bytes, v, "bigint") for v in (0, 512, 2048, 5 * GIB)]
    assert got == ["0 B", "512 B", "2.00 KB", "5.00 GB"]
    # The last unit is open-ended.
    assert one(spark, S.human_bytes, 2048 * 1024 ** 5, "bigint") == "2048.00 PB"


def test_split_group_key(spark):
    cases = {"Qwen2.5-7B-Instruct-Q4_K_M-00001-of-00003": "Qwen2.5-7B-Instruct-Q4_K_M",
             "plain-model": None, "bad-1-of-3": None, "bad-00001-of-3": None,
             "-00001-of-00002": "", "x-00001-of-00002\n": None,
             "a-of-b-00001-of-00002": "a-of-b", "x-\u0660\u0660\u0660\u0660\u0661-of-00002": None}
    for stem, want in cases.items():
        assert one(spark, S.split_group_key, stem, "string") == want, stem


def test_stem_and_extension(spark):
    assert one(spark, S.file_stem, "a.b.gguf", "string") == "a.b"
    assert one(spark, S.file_stem, ".hid", "string") == ".hid"
    assert one(spark, S.file_stem, "a.", "string") == "a"
    assert one(spark, S.file_stem, "a..gguf", "string") == "a."
    assert one(spark, S.file_ext, "a.", "string") == ""
    assert one(spark, S.file_ext, "a.b.gguf", "string") == "gguf"
    assert one(spark, S.file_ext, ".hid", "string") is None
    assert one(spark, S.file_ext, "noext", "string") is None


def test_manifest_tag_and_digest(spark):
    assert one(spark, S.manifest_tag, "registry/library/llama3/latest", "string") == "llama3:latest"
    assert one(spark, S.manifest_tag, "latest", "string") is None
    assert one(spark, S.digest_to_blob, "sha256:abc", "string") == "sha256-abc"


def test_quant_label(spark):
    assert one(spark, S.quant_label, 15, "bigint") == "Q4_K_M"
    assert one(spark, S.quant_label, 5, "bigint") == "unknown"
    assert one(spark, S.quant_label, None, "bigint") is None


def test_shorten_is_character_based(spark):
    assert one(spark, lambda c: S.shorten(c, 6), "äöüßéèà", "string") == "äöü…éèà"
    assert one(spark, lambda c: S.shorten(c, 10), "short", "string") == "short"


def _fit(spark, weights, layers, embd, head, kv, ctx):
    df = spark.createDataFrame([(weights, layers, embd, head, kv, ctx)],
                               "w bigint, l bigint, e bigint, h bigint, k bigint, c bigint")
    est = S.kv_cache_bytes("w", "l", "e", "h", "k", "c")
    return df.select(est.alias("kv"), S.total_estimate(F.col("w"), est).alias("total")).first()


def test_kv_formula_and_total(spark):
    r = _fit(spark, 0, 32, 4096, 32, 8, 8192)
    assert r["kv"] == 1073741824 and r["total"] == 2684354560


def test_kv_fallback(spark):
    assert _fit(spark, 4_000_000_000, None, None, None, None, 8192)["kv"] == 500_000_000


def test_head_ratio(spark):
    full = _fit(spark, 0, 32, 4096, 32, 32, 8192)["kv"]
    gqa = _fit(spark, 0, 32, 4096, 32, 8, 8192)["kv"]
    assert full / gqa == 4


def test_kv_saturates(spark):
    r = _fit(spark, 2 ** 62, 2 ** 62, 2 ** 62, 1, 2 ** 62, 2 ** 62)
    assert int(r["kv"]) == 2 ** 64 - 1 and int(r["total"]) == 2 ** 64 - 1


def test_verdicts(spark):
    weights = 4_700_000_000
    rows = [("a", 16 * GIB, [6 * GIB]), ("b", 16 * GIB, [12 * GIB]), ("c", 4 * GIB, []), ("d", 0, [])]
    df = spark.createDataFrame(rows, "device string, ram bigint, vram array<bigint>").withColumn(
        "total", S.total_estimate(F.lit(weights), F.lit(weights // 8)))
    gpu, ram, note = S.fit_verdict(F.col("total"), F.col("ram"), F.col("vram"))
    got = {r["device"]: r["note"] for r in df.select("device", note.alias("note")).collect()}
    assert got == {"a": "GPU-bound: likely CPU offload needed", "b": "fits on the largest GPU",
                   "c": "does not fit in RAM (no GPU detected)", "d": "memory unknown: cannot judge"}


def test_policy_cap_inclusive(spark):
    from assetsweep.operators.plan import row_gate
    df = spark.createDataFrame([(1, S.POLICY_SIZE_CAP), (2, S.POLICY_SIZE_CAP + 1)], "asset_id bigint, size bigint")
    ok, over = row_gate(df, S.POLICY_SIZE_CAP)
    assert [r[0] for r in ok.collect()] == [1] and [r[0] for r in over.collect()] == [2]
