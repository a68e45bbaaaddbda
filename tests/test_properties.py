"""Property tests: hostile header bytes never escape as exceptions; saturating
u64 arithmetic matches exact integer arithmetic."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetsweep.functions import scalars as S
from assetsweep.plans import sample_headers as SH
from assetsweep.sources import headers as H

BASE = SH.encode_header(3, [("general.architecture", "str", "llama"), ("a.b", "u32", 7),
                           ("tok", "arr", ("str", ["x", "y", "z"])), ("n", "arr", ("u32", [1, 2, 3]))],
                       [("t0", [4, 5], 1), ("t1", [3], 0)])
U64_MAX = 2 ** 64 - 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(BASE) - 1), st.integers(0, 255)), max_size=6),
       st.integers(0, len(BASE)))
def test_decoder_turns_any_damage_into_rows(edits, cut):
    data = bytearray(BASE)
    for pos, val in edits:
        data[pos] = val
    rows = H.decode_bytes("f", bytes(data[:cut]))
    assert rows and rows[0][1] == "header"
    fields = H.DECODED.fieldNames()
    err = rows[0][fields.index("error")]
    if err is not None:
        assert len(rows) == 1
    else:
        assert {r[1] for r in rows[1:]} <= {"kv", "tensor"}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=64))
def test_decoder_on_random_bytes(data):
    rows = H.decode_bytes("r", b"GGUF" + data)
    assert rows[0][1] == "header"


def test_saturating_product_and_sum_match_python(spark):
    rnd = random.Random(7)
    choices = [0, 1, 2, 3, 1000, 2 ** 20, 2 ** 32 - 1, 2 ** 40, 2 ** 63 - 1, U64_MAX]
    rows = []
    for i in range(300):
        dims = [rnd.choice(choices) if rnd.random() < 0.5 else rnd.randrange(0, 2 ** 33)
                for _ in range(rnd.randrange(0, 6))]
        rows.append((i, [str(d) for d in dims], rnd.randrange(0, 40)))
    df = spark.createDataFrame(rows, "id int, dims array<string>, t int").select(
        "id", F.col("dims").cast("array<decimal(20,0)>").alias("dims"), "t")
    got = {r["id"]: (int(r["p"]), int(r["b"])) for r in df.select(
        "id", S.sat_product(F.col("dims")).alias("p"),
        S.sat_mul(S.sat_product(F.col("dims")), S.tensor_type_bytes(F.col("t"))).alias("b")).collect()}
    for i, dims, t in rows:
        prod = 1
        for d in dims:
            prod = min(prod * int(d), U64_MAX)  # saturating step by step, like the reference
        assert got[i][0] == prod, (dims, got[i][0])
        assert got[i][1] == min(prod * S.TENSOR_TYPE_BYTES.get(t, 1), U64_MAX)
