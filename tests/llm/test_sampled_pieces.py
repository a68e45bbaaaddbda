import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from assetsweep.llm import sampled_pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "hello world, this is text", "tab\tand\nlines\r\n", "é ü 漢字 😀😀", "▁ mark ▁▁x", "\x00\x01", "a" * 3000,
         "    indented", "mixed漢 字a", "<s></s><unk><0x0A>", "zażółć gęślą jaźń"]


@pytest.fixture(scope="module")
def m():
    return P.Model(PATH)


def test_decoding_is_lossless_and_the_library_agrees(m):
    sp = SentencePieceProcessor(model_file=PATH)
    for t, p in zip(TEXTS, m.sample(TEXTS, np.arange(len(TEXTS)).astype(np.uint64))):
        assert m.decode(p) == t
        if P.MARK not in t:
            assert sp.decode(p.tolist()) == t


def test_draws_follow_the_weights_of_all_segmentations(m):
    text = "there"
    s = P.MARK + text
    weight = {}
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(s)]
        parts = [s[a:b] for a, b in zip(at, at[1:])]
        if all(x in m.piece for x in parts):
            weight[tuple(m.piece[x] for x in parts)] = math.exp(sum(m.weight[m.piece[x]] for x in parts))
    total = sum(weight.values())
    n = 40_000
    seen = Counter(tuple(p.tolist()) for p in m.sample([text] * n, np.arange(n).astype(np.uint64)))
    assert set(seen) <= set(weight) and len(seen) > 3
    for k, w in weight.items():
        p = w / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_pieces_depend_on_the_key_only(m, spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "no key", "x"), (100, None, "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    one = {(r.doc_id, str(r.pieces)) for r in P.sample_pieces(docs.coalesce(1), PATH).collect()}
    many = P.sample_pieces(docs.repartition(7), PATH)
    got = many.collect()
    assert {(r.doc_id, str(r.pieces)) for r in got} == one and len(got) == len(rows)
    assert all(r.lossless for r in got)
    assert [r.n_pieces for r in got if r.doc_id == 100] == [None]
    back = P.decode_pieces(many, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((a, b) for a, b, _ in rows), key=str)
    other = P.sample_pieces(docs, PATH, seed=5).collect()
    assert {(r.doc_id, str(r.pieces)) for r in other} != one
    assert P.sample_pieces(docs.limit(0), PATH).collect() == []


def test_parts_of_a_long_text_give_the_pieces_of_the_whole(m):
    text = "".join(TEXTS) * 5 + "words and more words " * 400
    key = np.array([99], np.uint64)
    (whole,) = m.sample([text], key)
    for block in (1, 7, 300, 10_000):
        pieces, good = m.sample_long(text, key, block=block)
        assert good and pieces.tolist() == whole.tolist()


def test_kept_units_change_no_draw(m, monkeypatch):
    keys = np.arange(len(TEXTS)).astype(np.uint64)
    want = [p.tolist() for p in m.sample(TEXTS, keys)]
    monkeypatch.setattr(P, "STATES", 50)  # the table starts anew all the time
    fresh = P.Model(PATH)
    for k in (3, 1, 0, 2):
        assert [p.tolist() for p in fresh.sample(TEXTS[k:], keys[k:])] == want[k:]
    assert [fresh.sample([t], keys[k:k + 1])[0].tolist() for k, t in enumerate(TEXTS)] == want
    assert fresh.head.n < 50 + 4000


def test_a_long_row_among_others(m, spark, monkeypatch):
    rows = [(1, "short"), (2, "many words in a row, " * 80_000), (3, None), (4, "x" * 5000)]
    out = {r.doc_id: r for r in P.sample_pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()}
    assert all(r.lossless for r in out.values()) and len(out) == 4
    key = spark.range(2, 3).selectExpr("xxhash64(false, id) AS k").first().k % 2**64
    assert out[2].pieces == m.sample([rows[1][1]], np.array([key], np.uint64))[0].tolist()


def test_a_task_leaves_no_filtered_units_behind():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some text here", None]), pa.array([5, 6])], names=["doc_id", "text", "key"])
    kept = P.model(PATH)
    for out in P._encoder(PATH, 1.0, 17)(iter([batch, batch])):
        assert kept.head.n > 0 and out.column("lossless").to_pylist() == [True, True]
    assert kept.head.n == 0 and len(kept.reached.room) <= 1024
