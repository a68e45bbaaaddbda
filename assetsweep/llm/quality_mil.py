"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole text is encoded: shares of
character classes, word lengths, repetition inside the passage and against the rest of the document, and
a hashed bag of words, through a tanh layer.  Gated attention weighs the passages,

    a = softmax(w . (tanh(h V) * sigmoid(h U))),   score = sigmoid(c . sum(a h) + d)

and all of it is learned from document labels only, by Adam in numpy.

Training takes a bounded sample: at most ``SAMPLE`` labelled documents (the smallest hashes of doc_id, so
the same on every run) that are not held out, with all of their passages; of several texts under one sampled doc_id
one is taken.  Scoring reads every passage of every document.  Labels, lang, source and doc_id are no inputs.

Plan: the sampled ids (a bounded set) are broadcast to pick their texts in one scan; the weights (some KB)
are broadcast for the scoring scan.  No shuffle of text, no state between rows.

Defined cases: null and empty texts are one empty passage; labels without a document, or null, do not
count; several labels of a document count as their maximum; with labels of one kind only, all scores are
that kind's; without labels they are 0.5; equal rows get equal scores; an empty table gives an empty
result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.llm import textbytes as tb
from assetsweep.session import ship_package

PASSAGE = 50
SAMPLE = 6000
BUCKETS = 128
HIDDEN, ATTENTION = 24, 12
THRESHOLD = 0.7
WINDOW = 5

_WORD = tb.byte_class((0x20, 0x20), (0x09, 0x0D))
_CLASSES = [
    ~tb.byte_class((0x41, 0x5A)), ~tb.byte_class((0x61, 0x7A)), ~tb.byte_class((0x30, 0x39)), ~tb.byte_class((0x80, 0xFF)),
    ~tb.byte_class(*[(ord(c), ord(c)) for c in "#*$%&<>"]), ~tb.byte_class((0x7C, 0x7C)), ~tb.byte_class((0x21, 0x21)),
    ~tb.byte_class((0x2C, 0x2C), (0x2E, 0x2E))]
N_STATS = len(_CLASSES) + 8
N_FEATURES = N_STATS + BUCKETS


def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, first passage of each text and the end)."""
    starts, ends, firsts = tb.split_words(data, offsets, _WORD)
    n_words = np.diff(firsts)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(n_passages)])
    x = np.zeros((bounds[-1], N_FEATURES), np.float32)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    passage = bounds[:-1][doc] + (np.arange(len(starts)) - firsts[:-1][doc]) // PASSAGE
    count = np.bincount(passage, minlength=bounds[-1]).astype(np.float32)
    per = np.maximum(count, 1)
    if len(starts):
        size = (ends - starts).astype(np.float32)
        n_bytes = np.maximum(np.bincount(passage, size, bounds[-1]), 1)
        for k, table in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(table[data])])
            x[:, k] = np.bincount(passage, total[ends] - total[starts], bounds[-1]) / n_bytes
        h = tb.hash_words(tb.LOWER[data], starts, ends)
        k = len(_CLASSES)
        mean = np.bincount(passage, size, bounds[-1]) / per
        x[:, k] = mean / 10
        x[:, k + 1] = np.sqrt(np.maximum(np.bincount(passage, size ** 2, bounds[-1]) / per - mean ** 2, 0)) / 10
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        x[:, k + 2] = np.bincount(passage, same, bounds[-1]) / per
        pair = tb.mix(h ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        lone = np.zeros(len(h))
        lone[np.unique(pair, return_index=True)[1]] = 1
        x[:, k + 3] = np.bincount(passage, lone, bounds[-1]) / per
        x[:, k + 4] = _repeats(h, doc, passage, bounds[-1]) / per
        x[:, k + 5] = np.bincount(passage, (ends - starts) <= 3, bounds[-1]) / per
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        bag = np.bincount(passage * BUCKETS + bucket, minlength=bounds[-1] * BUCKETS).reshape(-1, BUCKETS)
        x[:, N_STATS:] = np.sqrt(bag / per[:, None])
    x[:, N_STATS - 2] = count / PASSAGE
    x[:, N_STATS - 1] = np.repeat(np.log1p(n_words) / 8, n_passages)
    return x, bounds


def _repeats(h: np.ndarray, doc: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Words per passage that start a window of WINDOW words found before in the document."""
    if len(h) < WINDOW:
        return np.zeros(n)
    key = doc[:-WINDOW + 1].astype(np.uint64)
    for k in range(WINDOW):
        key = tb.mix(key * np.uint64(31) + h[k:len(h) - WINDOW + 1 + k])
    inside = doc[:-WINDOW + 1] == doc[WINDOW - 1:]
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    return np.bincount(passage[:len(key)], ~new & inside, n)


def encode(texts: pa.Array):
    """Blocks of (first text, features by passage, bounds of each text's passages)."""
    data, offsets = tb.utf8(texts)
    for a, b in tb.blocks(offsets):
        lo, hi = offsets[a], offsets[b]
        x, bounds = _block(data[lo:hi], offsets[a:b + 1] - lo)
        yield a, x, bounds


def _sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bounds[:-1], axis=0)


class AttentionMil:
    """Weights of encoder, gated attention and output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.p = {"W": g(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, ATTENTION), "U": g(HIDDEN, ATTENTION),
                  "w": g(ATTENTION), "c": g(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.constant: float | None = None

    def _forward(self, x, bounds):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        a = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[of])
        a /= _sum(a, bounds)[of]
        z = _sum(a[:, None] * h, bounds)
        return z @ p["c"] + p["d"][0], (h, t, s, a, z, of)

    def gradient(self, x, bounds, y, weight):
        p = self.p
        logit, (h, t, s, a, z, of) = self._forward(x, bounds)
        dl = (1 / (1 + np.exp(-logit)) - y) * weight / weight.sum()
        g = {"c": z.T @ dl, "d": np.array([dl.sum()])}
        dz = (dl[:, None] * p["c"])[of]
        da = (dz * h).sum(axis=1)
        de = a * (da - _sum(a * da, bounds)[of])
        dts = de[:, None] * p["w"]
        g["w"] = (t * s).T @ de
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["W"], g["b"] = x.T @ dh + 1e-4 * p["W"], dh.sum(axis=0)
        return g

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 4):
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 0.05
        bags = [(b - self.mean) / self.scale for b in bags]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                ids = order[at:at + batch]
                x = np.concatenate([bags[k] for k in ids])
                bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in ids])])
                step += 1
                for name, g in self.gradient(x, bounds, y[ids], np.ones(len(ids))).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= rate * 0.8 ** epoch * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        logit, _ = self._forward((x - self.mean) / self.scale, bounds)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _bags(batches):
    for batch in batches:
        for a, x, bounds in encode(batch.column(1)):
            rows = []
            for b, e in zip(bounds[:-1], bounds[1:]):
                rows.append(x[b:e].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(rows)), pa.array(rows, pa.binary()),
                                              batch.column(2).slice(a, len(rows))], names=["doc_id", "bag", "label"])


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> AttentionMil:
    """Learns from at most ``sample`` labelled documents that are not held out."""
    ship_package(docs.sparkSession)
    chosen = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most `sample` rows
    kind = T.StructType([d.schema["doc_id"], T.StructField("bag", T.BinaryType()), T.StructField("label", T.DoubleType())])
    # However often a sampled doc_id stands in the table, one bag of it comes back.
    rows = d.mapInArrow(_bags, kind).groupBy("doc_id").agg(F.min("bag").alias("bag"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.bag))
    net = AttentionMil()
    y = np.array([r.label for r in rows])
    if not len(rows) or y.min() == y.max():
        net.constant = float(y[0]) if len(rows) else 0.5
        return net
    net.fit([np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in rows], y)
    return net


def _scorer(net):
    def score(batches):
        m = net.value
        for batch in batches:
            parts = [m.score(x, bounds) for _, x, bounds in encode(batch.column(1))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return score


def score_quality(docs: DataFrame, net: AttentionMil, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship_package(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(net)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = d.mapInArrow(_scorer(weights), T.StructType([d.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
