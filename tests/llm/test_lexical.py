import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assetsweep.llm import lexical as M

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Every document against every item, by the contract."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            score = sum(weight[w] * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in terms(text) if w in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, bag string").repartition(4),
            spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int"))


def got(frame):
    return sorted([tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()], key=str)


WORDS = [f"w{k}" for k in range(60)] + ["É", "漢字", "Ab9", "x"]


def collection(seed, n):
    rng = random.Random(seed)
    docs = [(k, " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(len(WORDS))], k=rng.randint(0, 40)))) for k in range(n)]
    docs += [(n + k, rng.choice(docs)[1]) for k in range(n)]  # copies: classes with several members
    docs += [(5, "again the same id"), (None, docs[3][1]), (None, None), (7777, ""), (7778, "..., --- !"), (9000, "w1 " * 20_000)]
    docs += [docs[0]] * 3
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for k in range(25)]
    return docs, items + [(None, "w1 w2"), (3, "w4 w4 w4"), (100, None), (101, ""), (102, "unknownword"), (103, "ABC, AB9;É漢字")]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_follow_the_contract(spark, seed):
    docs, items = collection(seed, 120)
    assert got(M.search(*frames(spark, docs, items))) == brute(docs, items)


def test_blocks_of_items_change_nothing(spark):
    docs, items = collection(3, 60)
    assert got(M.search(*frames(spark, docs, items), k=4, block_items=6)) == brute(docs, items, 4)


def test_a_class_is_scored_once_and_expanded_by_doc_id(spark):
    docs = [(1000 - k, "same bag of words") for k in range(300)] + [(2000 + k, "words of bag same") for k in range(300)]
    docs += [(k, f"other text {k}") for k in range(400)]
    d, items = frames(spark, docs, [(1, "bag words"), (2, "same other")])
    block = M.item_block(items.withColumn("item_no", items.item_id), "text")
    bags = M.bags(d, spark.sparkContext.broadcast(block.vocabulary))
    classes = M.bag_classes(M.with_m(bags, 1000, 3600)).collect()
    assert sorted((c["first"], c.copies) for c in classes) == [(0, 400), (701, 600)]
    assert [r[2] for r in got(M.search(d, items)) if r[0] == 1] == [701, 710, 702, 703, 704, 705, 706, 707, 708, 709]


def test_equal_hashes_are_verified(spark):
    """Bags are told apart although their hashes are forced to be equal."""
    from pyspark.sql import functions as F
    docs = [(k, "w1 w2" if k % 2 else "w1 w3") for k in range(20)]
    d, items = frames(spark, docs, [(1, "w1 w2 w3")])
    block = M.item_block(items.withColumn("item_no", items.item_id), "text")
    rows = M.with_m(M.bags(d, spark.sparkContext.broadcast(block.vocabulary)), 20, 40).withColumn("h", F.lit(7).cast("long"))
    assert sorted((c["first"], c.copies) for c in M.bag_classes(rows).collect()) == [(0, 10), (1, 10)]


def test_doubles_and_whole_numbers_score_alike():
    rng = np.random.default_rng(5)
    item, term = rng.integers(0, 30, 400), rng.integers(1, 50, 400).astype(np.uint64)
    pairs = sorted(set(zip(item.tolist(), term.tolist())))
    item, term = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.uint64)
    made = []
    for repeats in (1, 10**7):  # the second passes 2^53
        b = M.ItemBlock(item, term, np.full(len(item), repeats))
        b.weigh(np.arange(len(b.vocabulary)) * 9 + 1, 500)
        assert 0 < len(b.matrix) < len(b.vocabulary)
        row = np.repeat(np.arange(40), 12)
        t = np.concatenate([np.sort(np.random.default_rng(k).choice(len(b.vocabulary), 12, False)) for k in range(40)])
        share = 10**9 * (t % 4 + 1) // (1000 * (t % 4 + 1) + 8 * 99)
        s = b.scores(row, t, share, 40)
        want = [[sum(int(x) * int(b.value[p]) for r, w, x in zip(row, t, share) if r == d
                     for p in range(b.first[w], b.first[w + 1]) if b.item[p] == i) for i in range(len(b.items))] for d in range(3)]
        assert s[:3].tolist() == want
        made.append(b.kind)
    assert made == [np.float64, np.int64]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    out = M.search(*frames(spark, docs, items))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
