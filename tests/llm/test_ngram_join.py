import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assetsweep.llm import ngram_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def brute_roots(rows):
    """(sets, root of each row) by union-find over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    lists = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    for k, s in enumerate(sets):
        for j in {y for x in s for y in lists[x] if y > k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                up[find(j)] = find(k)
    return sets, [find(k) for k in range(len(rows))]


def brute(rows):
    """(doc_id, set size, component) of each row."""
    sets, roots = brute_roots(rows)
    least = {}
    for root, (i, _) in zip(roots, rows):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return sorted(((i, len(s), least.get(root, i) if s else i) for (i, _), s, root in zip(rows, sets, roots)), key=str)


def changed(rng, words, n):
    w = list(words)
    for _ in range(n):
        w = w or ["x"]
        at = rng.randrange(len(w))
        op = rng.random()
        if op < 0.5:
            w[at] = f"new{rng.randrange(1000)}"
        elif op < 0.75:
            del w[at]
        else:
            w.insert(at, f"ins{rng.randrange(1000)}")
    return w


def collection(seed, groups, passage=True):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    hot = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 10, 12, 14, 16, 20, 24, 40, 90, 200]))]
        if passage and g % 3 == 0:
            base[len(base) // 2:len(base) // 2] = hot
        family = [base]
        for _ in range(rng.choice([0, 0, 1, 2, 6, 25])):
            family.append(changed(rng, rng.choice(family), rng.choice([0, 1, 1, 2, 3])))
        rows += [" ".join(f) for f in family]
    rng.shuffle(rows)
    return [(k * 7 + 3, t) for k, t in enumerate(rows)]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sid string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, monkeypatch):
    rows = collection(seed, 90)
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one  TWO"), (None, rows[0][1]), (None, "lonely words"),
             (9006, rows[5][1].upper()), (rows[5][0], rows[5][1])]
    if seed == 2:  # salted lists and no broadcast of wanted texts
        monkeypatch.setattr(J, "SALT_LEVEL", 2)
        monkeypatch.setattr(J, "MAX_WANTED", 0)
    assert run(spark, rows) == brute(rows)


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_small_sets_enumerate_exactly_the_links():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(5, 18)
        a = set(rng.sample(range(30), n))
        b = set(rng.sample(sorted(a), rng.randint(max(1, n - 3), n))) | set(rng.sample(range(30, 40), rng.randint(0, 2)))
        out = {}
        for name, s in ((1, a), (2, b)):
            tokens = np.array(sorted(s), np.uint64).view(np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([tokens.tolist()], pa.list_(pa.int64()))], names=["sid", "small"])
            rows = [r for x in J._subsets(24)([batch]) for r in x.to_pylist()]
            out[name] = {r["key"]: r["smaller"] for r in rows}
        meet = any(out[1][k] or out[2][k] for k in out[1].keys() & out[2].keys())
        assert meet == (100 * len(a & b) >= 80 * len(a | b)), (a, b)


def test_bitmap_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(100, len(a))], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
        x, y = J.parity_bitmap(a), J.parity_bitmap(b)
        if len(x) > len(y):
            x, y = y, x
        while len(y) > len(x):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_boundary_weighs_subsets_against_postings():
    assert J.choose_boundary({}, 0) == 0
    assert J.choose_boundary({4: 1000}, 10) >= 4  # one subset against postings that cost more
    assert J.choose_boundary({24: 1000}, 10) < 24  # thousands of subsets against five postings


def test_one_document_of_each_component_stays(spark):
    rows = collection(5, 40) + [(8000, ""), (8001, None), (None, "a b c d e f"), (None, "other words here"), (8002, "other words here")]
    rows += [rows[0], (rows[1][0], "another text under the same id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    # One of each component, told by its root: an id that stands in two of them names both.
    sets, roots = brute_roots(rows)
    parts = {}
    for (i, t), s, root in zip(rows, sets, roots):
        parts.setdefault(("linked", root) if s else ("alone", i, t), []).append(i)
    assert len(got) == len(parts) and None in got
    least = [min((i for i in ids if i is not None), default=None) for ids in parts.values()]
    assert sorted(got, key=str) == sorted(least, key=str)
    assert J.keep_first(docs.limit(0)).collect() == [] and J.near_duplicates(docs.limit(0)).collect() == []
