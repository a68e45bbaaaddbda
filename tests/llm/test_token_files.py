import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetsweep.llm import token_files as M
from assetsweep.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from("ab,.!$'s1 \n\t\x1c\x85　é漢🙂<|endoftext|>\u00a0\u2003“…"), max_size=80)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def brute(tok, rows):
    """(doc_id, start, n_tokens, crc) by the contract, whole texts one by one."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


# ---- blocks

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400), st.sampled_from([1, 50, 90, 100]), st.sampled_from([1, 7, 64, 1024]))
def test_blocks_round_trip(values, percentile, size):
    ids = np.array(values, np.uint32)
    blocks = M.encode_blocks(ids, size, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
    assert M.decode_blocks(b"".join(blocks), starts).tolist() == values


def test_width_is_the_percentile_and_outliers_are_exceptions():
    ids = np.full(100, 1000, np.uint32) + np.arange(100, dtype=np.uint32) % 8
    ids[[3, 50]] = 4_000_000_000, 70_000
    (block,) = M.encode_blocks(ids, 100, 90)
    low, width, n, exceptions = M._BLOCK.unpack_from(block, 0)
    assert (low, width, n, exceptions) == (1000, 3, 100, 2)
    assert len(block) == M._BLOCK.size + -(-300 // 8) + 2 * 6
    assert np.frombuffer(block[-12:-8], "<u2").tolist() == [3, 50]


@pytest.mark.parametrize("group", [1, 2, 256])
def test_file_tables_and_ranges(group):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50_257, n).astype(np.uint32) for n in (1, 0, 5000, 3, 1024, 1, 70, 9000)]
    keys = [5, 6, None, -7, 8, 9, 9, 2**62]
    sink = io.BytesIO()
    sink.close = lambda: None
    w = M.TokenFileWriter(sink, block_ids=64)
    for k in range(0, 8, 2):
        w.add(keys[k:k + 2], np.array([len(x) for x in docs[k:k + 2]]), np.concatenate(docs[k:k + 2]))
    w.close()
    data = sink.getvalue()
    reads = []

    def read_at(n, at):
        reads.append((at, n))
        return data[at:at + n]

    f = M.TokenFile(read_at, len(data))
    whole = np.concatenate(docs)
    got = [ids for _, part in f.documents(group) for ids in part]
    assert [x.tolist() for x in got] == [x.tolist() for x in docs]
    assert [None if n else k for k, n in zip(f.keys.tolist(), f.null)] == keys
    for a, b in ((0, 1), (63, 65), (5000, 5000), (4000, 9000), (0, len(whole))):
        assert f.ids(a, b).tolist() == whole[a:b].tolist()
    reads.clear()
    f.ids(640, 700)  # one block, one read, no more than that block
    assert len(reads) == 1 and reads[0][1] < 64 * 4
    with pytest.raises(ValueError):
        M.TokenFile(lambda n, at: data[at:at + n], len(data) - 1)


# ---- encoding

def encoded(enc, texts, limit=M.RUN_BYTES):
    out = []
    for _, sizes, ids in M.encode_documents(enc, pa.array(texts, pa.string()), 0, limit):
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        out += [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=6), st.sampled_from([1, 5, 40, 10_000]))
def test_segments_give_the_ids_of_the_whole(plain, texts, limit):
    enc = M.encoder(PATH)
    assert enc.split
    assert encoded(enc, texts, limit) == [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_a_tokenizer_without_proof_gets_whole_texts():
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    enc, tok = M.Encoder(path), Tokenizer.from_file(path)
    assert not enc.split
    texts = ["two words", "", "  A b  C "]
    assert encoded(enc, texts, 3) == [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_known_segments_are_bounded(plain):
    enc = M.Encoder(PATH, known=50)
    for k in range(20):
        texts = [f"word{k} other{j} {k * j}" for j in range(20)]
        assert encoded(enc, texts) == [[*plain.encode(t).ids, 0] for t in texts]
        assert len(enc.key) < 50 + 80


def test_segments_begin_at_proven_places(plain):
    enc = M.Encoder(PATH)
    cut = lambda t: [t.encode()[a:b].decode() for a, b in zip(*enc.segments(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))]
    assert cut(" word.\nNext!! a  b") == [" word", ".", "\n", "Next", "!!", " a", "  b"]
    assert cut("a<|endoftext|>b don't\u00a0 x\n\ny") == ["a<|endoftext|>b", " don't\u00a0 x", "\n\ny"]
    texts = ["it's.\nIt's a\n\nb.\n c,\nd", "x<|endoftext|>\ny. don't\n've é.\nÉ! \u0300a. a\u0300.", "a\nb\nc\n", "A\nB. ſ.\x85c 漢.\n字", "don't.\n's",
             "\u2003 a\u3000 b\u1680\nc", "“quoted” words… and", "a\x1c b\x1f\nc"]
    assert encoded(enc, texts) == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_words_that_are_not_one_piece_are_encoded_singly(plain, monkeypatch):
    enc = M.Encoder(PATH)
    monkeypatch.setattr(enc, "_together", lambda *a: None)
    texts = ["some plain words here", "é漢 and more"]
    assert encoded(enc, texts) == [[*plain.encode(t).ids, 0] for t in texts]


# ---- jobs

ROWS = [(7, "seven words stand in this text, more or less"), (3, ""), (1, None), (None, "no key at all"), (None, None),
        (5, "<|endoftext|> inside  of it <|endoftext|>"), (-4, "é 漢字 🙂\n\n  x"), (2, "long " * 40_000), (6, "x" * 60_000), (9, " ")]
ROWS += [(k, f"row {k} with some words of its own, {k * 7919}") for k in range(20, 220)]


def test_files_hold_every_document_in_order(spark, plain):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, start int").repartition(5)
    files = M.write_token_files(docs, PATH, file_ids=2000, file_docs=30)
    got = [tuple(r) for r in M.report(M.read_token_files(files)).collect()]
    want = brute(plain, ROWS)
    keyed = [x for x in want if x[0] is not None]
    assert sorted(x for x in got if x[0] is not None) == sorted(keyed)
    nulls = sorted(x for x in got if x[0] is None)
    assert {(x[2], x[3]) for x in nulls} == {(x[2], x[3]) for x in want if x[0] is None}
    assert sum(x[2] for x in got) == sum(x[2] for x in want) and nulls[0][1] == sum(x[2] for x in keyed)
    rows = files.orderBy("first_id").collect()
    assert len(rows) > 5 and all(r.n_docs <= 30 and (r.n_ids <= 2000 or r.n_docs == 1) for r in rows)
    whole = np.concatenate([np.array([*plain.encode(t or "").ids, 0]) for i, t in sorted((r for r in ROWS if r[0] is not None))])
    assert M.read_range(files, 100, 3100).tolist() == whole[100:3100].tolist()


def test_a_key_that_repeats_is_dealt_to_several_tasks(spark, plain):
    rows = [(1, f"same key {k}") for k in range(4000)] + [(0, "first"), (2, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = M.write_token_files(docs, PATH)
        assert files.select("part").distinct().count() > 3
        got = sorted((r.start, r.n_tokens, r.doc_id) for r in M.report(M.read_token_files(files)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [x[2] for x in got] == [0] + [1] * 4000 + [2]
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0


def test_empty_table(spark):
    files = M.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert files.count() == 0 and M.report(M.read_token_files(files)).count() == 0 and len(M.read_range(files, 0, 5)) == 0


def test_whole_table(spark, plain):
    from assetsweep.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, sf).collect()) == sorted(brute(plain, rows))
