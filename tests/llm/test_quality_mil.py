import zlib

import numpy as np
import pyarrow as pa
import pytest

from assetsweep.llm import quality_mil as Q

SF = "/root/testdata/sf0.01"


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = Q.AttentionMil()
    x, bounds = rng.normal(size=(9, Q.N_FEATURES)), np.array([0, 1, 5, 9])
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        z, _ = net._forward(x, bounds)
        return float(np.mean(np.logaddexp(0, z) - y * z)) + 0.5e-4 * float((net.p["W"] ** 2).sum())
    g = net.gradient(x, bounds, y, w)
    for name, a in net.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-5
            up = loss()
            a[at] = old - 1e-5
            down = loss()
            a[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6, name


def test_features_do_not_depend_on_the_batch():
    texts = ["one two three " * 60, None, "", "ÜBER!! ###", "x " * 500, "same line\n" * 30]
    alone = [np.concatenate([x for _, x, _ in Q.encode(pa.array([t], pa.string()))]) for t in texts]
    together = np.concatenate([x for _, x, _ in Q.encode(pa.array(texts))])
    assert np.allclose(np.concatenate(alone), together)
    assert [len(x) for x in alone] == [4, 1, 1, 1, 10, 2]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_contract_columns(spark, tables):
    docs, labels = tables
    got = Q.score_quality(docs, Q.train(docs, labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    test = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.7 for s in good]) > 0.9


def test_odd_tables(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "some text", "x"), (4, "word " * 60_000, None)],
                                "doc_id long, text string, score string")
    net = Q.train(docs, labels, sample=60)
    rows = Q.score_quality(odd, net).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert Q.train(docs, labels.limit(0)).constant == 0.5
    assert Q.train(docs, labels.where("quality = 1")).constant == 1.0
    assert Q.score_quality(odd.limit(0), net).collect() == []


def brute_score(net, rows):
    """Encoder, gated attention and output of one bag, passage by passage."""
    import math
    p = net.p
    dot = lambda v, m, j: sum(float(v[i]) * float(m[i][j]) for i in range(len(v)))
    hidden, weight = [], []
    for row in rows:
        x = [(float(a) - float(b)) / float(c) for a, b, c in zip(row, net.mean, net.scale)]
        h = [math.tanh(dot(x, p["W"], j) + float(p["b"][j])) for j in range(len(p["b"]))]
        gate = [math.tanh(dot(h, p["V"], j)) / (1 + math.exp(-dot(h, p["U"], j))) for j in range(len(p["w"]))]
        hidden.append(h)
        weight.append(math.exp(sum(g * float(w) for g, w in zip(gate, p["w"]))))
    z = [sum(a * h[j] for a, h in zip(weight, hidden)) / sum(weight) for j in range(len(p["c"]))]
    return 1 / (1 + math.exp(-(sum(a * float(c) for a, c in zip(z, p["c"])) + float(p["d"][0]))))


def brute_features(text):
    """Some features of each passage of 50 words, word by word."""
    import re
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    for at in range(0, max(1, len(words)), Q.PASSAGE):
        part = words[at:at + Q.PASSAGE]
        size = max(1, sum(map(len, part)))
        share = lambda keep: sum(sum(map(keep, w)) for w in part) / size
        yield (share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), share(lambda c: c >= 128),
               sum(map(len, part)) / max(1, len(part)) / 10, sum(a.lower() == b.lower() for a, b in zip(part, part[1:])) / max(1, len(part)),
               sum(len(w) <= 3 for w in part) / max(1, len(part)), len(part) / Q.PASSAGE)


def test_features_and_scores_match_plain_python():
    rng = np.random.default_rng(6)
    texts = ["", "one", "Zwei ZWEI 22 é x x", " ".join(["alpha", "beta", "beta", "Γ9", "no"][k] for k in rng.integers(0, 5, 333))]
    net = Q.AttentionMil()
    net.mean, net.scale = rng.normal(0, 0.1, Q.N_FEATURES), rng.uniform(0.5, 2, Q.N_FEATURES)
    k = len(Q._CLASSES)
    for _, x, bounds in Q.encode(pa.array(texts)):
        got = net.score(x, bounds)
        for j, text in enumerate(texts):
            rows = x[bounds[j]:bounds[j + 1]]
            want = np.array(list(brute_features(text)))
            assert np.allclose(rows[:, [0, 1, 2, 3, k, k + 2, k + 5, Q.N_STATS - 2]], want, atol=1e-6)
            assert abs(got[j] - brute_score(net, rows)) < 1e-6


def test_all_passages_train_and_a_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(k, f"good words number {k} " * 900 if k % 2 else "x$ " * 30) for k in range(40)] + [(1, "good words " * 30)] * 50,
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    seen = {}
    fit = Q.AttentionMil.fit
    try:
        Q.AttentionMil.fit = lambda self, bags, y, **kw: seen.update(n=len(bags), most=max(map(len, bags))) or fit(self, bags, y, **kw)
        Q.train(docs, labels)
    finally:
        Q.AttentionMil.fit = fit
    held = docs.select("doc_id").distinct().where(Q.held_out("doc_id")).count()
    assert seen["n"] == 40 - held and seen["most"] == 72  # 3600 words
