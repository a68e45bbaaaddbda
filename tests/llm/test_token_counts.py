import random

import public_tokenizers
import pytest

from assetsweep.llm import token_counts as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return K.tokenizer(PATH)


def texts():
    rng = random.Random(7)
    bits = ["the ", "of", " ", "  ", "\n", "\n\n", "é", "😀", "don't", "x" * 30, "12345", "!!", "<|endoftext|>", " ", " ", " a", "\t"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 500))) for _ in range(60)]
    return out + ["", " " * 3000, "a" * 3000, "ab " * 2000, "😀" * 900, "\n" * 2500, ("word " * 40 + "x" * 700) * 4]


@pytest.mark.parametrize("chunk,overlap", [(50, 10), (200, 40), (1000, 100)])
def test_chunks_give_the_ids_of_the_whole(tok, chunk, overlap):
    for t in texts():
        assert K.encode_long(tok, t, chunk, overlap) == K.encode_whole(tok, t)[0]


def test_counts_of_a_table(spark, tok):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, None, "x"), (0, "some words", "x"), (0, "some words", "x"),
                                                           (99, "long text of words, " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = K.token_report(docs, PATH).collect()
    want = [(i, len((t or "").encode()), len(K.encode_whole(tok, t or "")[0])) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert K.token_report(docs.limit(0), PATH).collect() == []
