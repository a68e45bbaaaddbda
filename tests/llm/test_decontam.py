import random

import numpy as np
import pyarrow as pa
import pytest

from assetsweep.llm import decontam as D
from assetsweep.llm import textbytes as tb


def test_suffix_order_and_search_match_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 30, rng.integers(1, 8))
        firsts = np.concatenate([[0], np.cumsum(lengths)])
        words = rng.integers(1, 5, firsts[-1]).astype(np.uint64)
        if not len(words):
            continue
        index = D.ShardIndex(words, firsts, sample=4)
        for _ in range(20):
            n = int(rng.integers(1, 6))
            phrase = rng.integers(1, 6, n).astype(np.uint64)
            row = np.concatenate([np.zeros(6 - n, np.uint64), phrase])[None, :]
            lo, hi = index.search(row, np.array([n]))
            at = sorted(index.locate(np.arange(lo[0], hi[0]))) if hi[0] > lo[0] else []
            want = [i + d for d, (a, b) in enumerate(zip(firsts[:-1], firsts[1:])) for i in range(a, b - n + 1)
                    if (words[i:i + n] == phrase).all()]
            assert at == sorted(want)


def test_word_hashes_are_by_content():
    texts = pa.array(["One two,three ÉCOLE école", None, "", "two-one", "x" * 10])
    hashes, firsts = tb.words_of(texts, D.WORD)
    assert firsts.tolist() == [0, 5, 5, 5, 7, 8]
    one, two = hashes[0], hashes[1]
    assert hashes[5] == two and hashes[6] == one and hashes[3] != hashes[4]


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % k for k in range(40)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (25, 12, 10, 4, 1, 0)] + [None]
    words = [i.split() if i else [] for i in items]
    texts = ["", None, "W1!! w2"]
    for _ in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        w = rng.choice(words)
        at = rng.randint(0, len(w))
        t[5:5] = [x.upper() for x in w[at:at + 14]]
        texts.append(", ".join(t))
    bench = spark.createDataFrame([(k, i) for k, i in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(0, "", "c"), (None, texts[5], None)],
                                 "doc_id long, text string, spans string")
    return docs, bench, words


def test_report_matches_brute_force(small):
    docs, bench, items = small
    got = D.contamination_report(docs, bench).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    brute = []
    for r in rows:
        w = [x.strip(",").lower().strip("!") for x in (r.text or "").split()]
        hit, ids = set(), set()
        for k, item in enumerate(items):
            n = min(10, len(item))
            for j in range(len(item) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == item[j:j + n]:
                        hit.update(range(i, i + n))
                        ids.add(str(k))
        brute.append((r.doc_id, len(w), len(hit), len(ids), len(hit) > 0))
    key = lambda x: tuple(str(y) for y in x)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got], key=key) == sorted(brute, key=key)


def test_shards_give_the_same_report(small):
    docs, bench, _ = small
    whole = D.find_contamination(docs.coalesce(1), bench)
    tiny = D.find_contamination(docs.coalesce(1), bench, shard_words=50)
    assert whole.collect() == tiny.collect()


def test_removal_cuts_spans_and_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é zero A b, c d e f g h i j K end", "s"), (2, None, "s"), (3, "", "s"), (4, "a b c", "s")],
                                 "doc_id long, text string, row_id string")
    out = D.remove_contamination(docs, bench)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é zero  end", 2: None, 3: "", 4: "a b c"}
    assert D.contamination_report(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.contamination_report(docs, bench.limit(0)).collect())


def test_items_with_a_null_id_are_searched(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "other words"), (3, "k l m")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f g h i j"), (None, "k l m"), (7, "a b c d e f g h i j")], "item_id long, text string")
    rows = {r.doc_id: r for r in D.contamination_report(docs, bench).collect()}
    assert (rows[1].n_hit, rows[1].n_items, rows[3].n_hit, rows[3].n_items, rows[2].n_hit) == (10, 2, 3, 1, 0)
    import hashlib
    assert rows[1].items_sha256 == hashlib.sha256(b"7").hexdigest() and rows[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[3].contaminated and D.remove_contamination(docs, bench).where("doc_id = 3").first().text == ""
