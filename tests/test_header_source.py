import io
import itertools

import pytest

from assetsweep.plans.sample_headers import encode_header
from assetsweep.sources import header_source as HS
from assetsweep.sources import headers as H

KVS = [("general.name", "str", "model é"), ("tokens", "arr", ("str", ["a", "bb", "ccc"] * 50)), ("scores", "arr", ("f32", [0.5] * 40)),
       ("nested", "arr", ("arr", [("arr", [("u8", [1, 2]), ("u8", [3])]), ("str", ["x"])])), ("general.name", "str", "last"), ("flag", "bool", True),
       ("layers", "u32", 12)]
DATA = encode_header(3, KVS, [("t.weight", [4, 5], 1), ("u.weight", [6], 0)])


def kept(rows, wanted):
    """What filtering the rows of everything afterwards gives."""
    i = H._INDEX
    return [r for r in rows if (wanted.sections is None or r[1] in wanted.sections) and (wanted.keys is None or r[i["key"]] in wanted.keys)]


@pytest.mark.parametrize("sections, keys", [*itertools.product([None, {"kv"}, {"tensor"}, {"header"}, {"kv", "header"}, set()],
                                                             [None, {"general.name"}, {"layers", "nested"}, {"gone"}])])
def test_wanted_rows_are_those_of_a_later_filter(sections, keys):
    wanted = H.Wanted(sections and frozenset(sections) if sections is not None else None, keys and frozenset(keys))
    for cut in (len(DATA), len(DATA) - 3, 200, 60, 20, 3):  # damaged files too: errors do not depend on what is wanted
        for length in (cut, len(DATA)):
            data = DATA[:cut]
            every = H.decode_stream("p", io.BytesIO(data), length, have=len(data))
            got = H.decode_stream("p", io.BytesIO(data), length, wanted=wanted, have=len(data))
            strip = lambda rows: [(*r[:-1], r[-1] and r[-1].split(":")[0]) if r[1] == "header" else r for r in rows]
            error = H._INDEX["error"]
            same = [[*r[:error], (r[error] or "").split(":")[0], *r[error + 1:]] for r in kept(every, wanted)]
            assert [[*r[:error], (r[error] or "").split(":")[0], *r[error + 1:]] for r in got] == same, strip(got)


def test_limits_hold_for_what_is_passed_over():
    only = H.Wanted(keys=frozenset({"layers"}))
    for limits in (H.Limits(array_items=39), H.Limits(array_levels=2), H.Limits(string_bytes=2)):
        every = H.decode_bytes("p", DATA, limits=limits)
        assert len(every) == 1 and every[0][H._INDEX["error"]].startswith("limit_")
        assert H.decode_stream("p", io.BytesIO(DATA), len(DATA), limits, only) == []


def test_a_filter_on_one_key_decodes_only_it(monkeypatch):
    seen, value = [], H._Cursor.value
    monkeypatch.setattr(H._Cursor, "value", lambda self, kind: seen.append(kind) or value(self, kind))
    rows = H.decode_stream("p", io.BytesIO(DATA), len(DATA), wanted=H.Wanted(keys=frozenset({"layers"})))
    assert seen == ["u32"] and [r[H._INDEX["key"]] for r in rows] == ["layers"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    for k in range(12):
        d = root / ("", "a", ".b/c")[k % 3]
        d.mkdir(parents=True, exist_ok=True)
        (d / f"_m{k}.gguf").write_bytes(encode_header(3, [*KVS, ("number", "u32", k)], []))
    (root / "note.txt").write_bytes(b"none")
    return str(root)


def test_source_plans_without_paths_and_reads_what_is_wanted(spark, tree):
    HS.register(spark)
    direct = spark.read.format("model_headers").option("numPartitions", "5").load(tree)
    listed = HS.load_headers(spark, tree, bytes_per_partition=64)
    for df in (direct, listed):
        assert df.rdd.getNumPartitions() > 1
        assert sorted(r.v_int for r in df.where("key = 'number'").collect()) == list(range(12))
        assert df.where("section = 'header' and error is null").count() == 12 and df.count() == 12 * (1 + len(KVS) + 1)
    one = HS.load_headers(spark, tree, keys=["number"])
    assert sorted(r.v_int for r in one.collect()) == list(range(12)) and one.where("section = 'header'").count() == 0
    assert HS.load_headers(spark, tree, sections=["header", "tensor"]).count() == 12
    assert HS.load_headers(spark, tree, keys=[]).count() == 0


def test_shares_are_planned_without_a_listing():
    r = HS.HeaderReader({"path": "/x", "keys": '["a"]'})
    assert [(p.k, p.n) for p in r.partitions()][:2] == [(0, 32), (1, 32)] and r.keys == frozenset({"a"}) and r.sections is None


def test_empty_tree(spark, tmp_path):
    assert HS.load_headers(spark, str(tmp_path)).count() == 0
