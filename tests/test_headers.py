"""Header decoding fixtures (FIXTURES.md 3) on payload columns and on files."""

import struct

from assetsweep.operators import catalog as C
from assetsweep.plans import jobs
from assetsweep.plans import sample_headers as SH
from assetsweep.sources import headers as H

FULL_KVS = [("general.architecture", "str", "llama"), ("general.name", "str", "TestModel"),
            ("general.file_type", "u32", 15), ("llama.context_length", "u32", 8192),
            ("llama.block_count", "u32", 32), ("llama.embedding_length", "u32", 4096),
            ("llama.attention.head_count", "u32", 32), ("llama.attention.head_count_kv", "u32", 8),
            ("some.f64", "f64", 1.5), ("some.bool", "bool", True), ("some.u64", "u64", 2 ** 64 - 1)]
FULL_TENSORS = [("blk.0.attn_q.weight", [4096, 4096], 1), ("output.weight", [4096, 32000], 0)]


def big_array():
    b = bytearray(b"GGUF") + struct.pack("<IQQ", 1, 0, 1)
    key = b"big.array"
    b += struct.pack("<Q", len(key)) + key + struct.pack("<IIQ", 9, 4, 1_000_000) + bytes(4_000_000)
    return bytes(b)


def fixtures():
    full = SH.encode_header(3, FULL_KVS, FULL_TENSORS)
    return {
        "full": full, "big": big_array(), "bad": b"X" + full[1:], "v4": SH.encode_header(4, [], []),
        "trunc": SH.encode_header(3, [("a", "u32", 1)], [])[:-2],
        "v1": SH.encode_header(1, [("general.name", "str", "old")], []),
        "empty": SH.encode_header(3, [], []),
        "cut_array": big_array()[:-10],
        "dup": SH.encode_header(3, [("general.name", "u32", 1), ("general.name", "str", "last")], []),
    }


def check(heads, cat):
    h = {r["path"]: r for r in heads.collect()}
    assert h["bad"]["error"].startswith("bad magic")
    assert h["v4"]["error"] == "unsupported version 4"
    assert h["trunc"]["error"].startswith("truncated")
    assert h["cut_array"]["error"].startswith("truncated")
    assert h["v1"]["version"] == 1 and h["v1"]["error"] is None
    c = {r["path"]: r for r in cat.collect()}
    full = c["full"]
    assert (full["architecture"], full["name"], full["quant"]) == ("llama", "TestModel", "Q4_K_M")
    assert full["context_length"] == 8192 and full["n_layers"] == 32 and full["n_head_kv"] == 8
    assert full["tensor_elem_count"] == 4096 * 4096 + 4096 * 32000
    assert full["tensor_bytes_estimate"] == 4096 * 4096 * 2 + 4096 * 32000 * 4
    assert full["parameter_count"] == 147_849_216
    assert c["empty"]["architecture"] is None and c["empty"]["parameter_count"] is None
    assert c["big"]["version"] == 1
    assert c["dup"]["name"] == "last"
    assert set(c) == {"full", "big", "v1", "empty", "dup"}


def test_decode_payloads(spark):
    df = spark.createDataFrame(list(fixtures().items()), "path string, payload binary")
    dec = H.decode_payloads(df).cache()
    check(H.headers(dec), C.summarize(H.headers(dec), H.header_kv(dec), H.header_tensors(dec)))
    kv = {r["key"]: r for r in H.header_kv(dec).where("path = 'big'").collect()}
    assert kv["big.array"]["v_arr"] == []
    u = H.header_kv(dec).where("path = 'full' AND key = 'some.u64'").first()
    assert int(u["v_int"]) == 2 ** 64 - 1


def test_decode_files(spark, tmp_path):
    for name, data in fixtures().items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in fixtures()] +
                                  [(f"file:{tmp_path}/missing",)], "path string")
    cat = jobs.catalog_headers(paths, from_paths=True)
    names = {r["path"].rsplit("/", 1)[-1]: r for r in cat.collect()}
    assert names["full"]["quant"] == "Q4_K_M"
    heads = H.headers(H.decode_paths(paths))
    errs = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in heads.collect()}
    assert errs["missing"].startswith("io:") and errs["bad"].startswith("bad magic")


def test_string_arrays_keep_first_eight(spark):
    data = SH.encode_header(3, [("tok", "arr", ("str", [f"t{i}" for i in range(100)])),
                               ("nested", "arr", ("arr", [("str", ["a", "b"]), ("u32", [1, 2])]))], [])
    dec = H.decode_payloads(spark.createDataFrame([("x", data)], "path string, payload binary"))
    kv = {r["key"]: r["v_arr"] for r in H.header_kv(dec).collect()}
    assert kv["tok"] == [f"t{i}" for i in range(8)]
    assert kv["nested"] == ["[a, b]", "[]"]


def test_header_data_source(spark, tmp_path):
    from assetsweep.operators import catalog as CAT
    from assetsweep.sources import header_source
    for name, data in fixtures().items():
        (tmp_path / f"{name}.gguf").write_bytes(data)
    (tmp_path / "notes.txt").write_bytes(b"not listed")
    header_source.register(spark)
    dec = spark.read.format("model_headers").option("numPartitions", "7").load(str(tmp_path))
    assert dec.rdd.getNumPartitions() > 1
    cat = CAT.summarize_decoded(dec)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in cat.collect()}
    assert set(got) == {"full.gguf", "big.gguf", "v1.gguf", "empty.gguf", "dup.gguf"}
    assert got["full.gguf"]["quant"] == "Q4_K_M" and got["dup.gguf"]["name"] == "last"
