"""Secret scan: pattern findings, and a character convolutional network over every candidate.

Base findings come from three patterns (assigned values, access keys, long hex strings).  A candidate is
any run of at least ``MIN_RUN`` characters of ``[A-Za-z0-9+/_.=-]``, with or without digits, that no base finding
overlaps.  The network sees the text around it as it stands: an embedding, one convolution, maxima over the ``BEFORE``
characters in front, the value and the ``AFTER`` characters behind, a mean over the value, a logistic output.  A value
longer than ``VIEW`` is scored in consecutive views, and its highest score counts, so no candidate is cut.

Labelled findings: a secret is the value of an assignment (group 2, not the name before it), an access key or a hex
string; any candidate is none.  A run that merely overlaps a finding is neither.  The network is trained in numpy on
all of them: each different secret, and every other candidate as often as it occurs.  A batch weighs secrets and others alike,
and among the others those with a digit and those without.  In half of them the context is blanked, so that the value alone must
tell.  A fifth, told by the hash of the finding, is held out: all of it calibrates the score of whole candidates (Platt) and sets the
threshold, the highest one that keeps ``RECALL`` of the held-out secrets, however low; ``precision`` says what it costs on
them.  With fewer than 1 / (1 - recall) held-out secrets that quantile says nothing: there is no model then and nothing is added.

Plan: one scan finds the secrets; the different ones are stored, some per thousand texts.  If enough are held out, training takes
``ROUNDS`` rounds, each over the rows of one hash class of their text, so all rounds together are one pass over every candidate.
In a round each task goes on from the same network, with batches of its own candidates and stored secrets; the networks
are averaged by their steps in one aggregate of a few thousand whole numbers.  The next scan counts the held-out findings by their
score in steps of 1 / ``GRID``; the last one finds, scores and returns the spans.  Candidates are never stored, no text is shuffled.
The convolution of a window is a sum of table rows (position, pair of characters), so scoring a
candidate costs some thirty windows of three look-ups each; its gradient is summed by position and character.

Defined cases: a null text is empty; equal rows get equal results; an empty table gives an empty result;
only the named columns are read, so others may have any name.  The network depends on how the rows are divided into partitions.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.llm import textbytes as tb
from assetsweep.llm.common import filesystem, shared_path
from assetsweep.session import ship_package

# The contract's patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "learned")

MIN_RUN = 8
BEFORE, VIEW, AFTER = 24, 40, 8
SAMPLE = 2000  # of ``labelled_sample``
RECALL = 0.98
ROUNDS = 8
OTHERS, SECRETS = 448, 64  # a batch
LEAST_STEPS = 24  # of a task in a round: few candidates are gone over again
HELD_OUT = 5  # one in so many
GRID = 256
BLOCK_CHARS = 1 << 20
LABELS = ("secret", "digits", "plain")

_UPPER_BYTE = ~tb.byte_class((0x30, 0x39), (0x41, 0x5A))
_HEX_BYTE = ~tb.byte_class((0x30, 0x39), (0x61, 0x66))


def base_findings(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret itself) by start, then kind as listed."""
    found = [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _maybe(texts: pa.Array) -> np.ndarray:
    """Texts that may hold a base finding."""
    data, offsets = tb.utf8(texts)
    out = np.zeros(len(texts), bool)
    for a, b in tb.blocks(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        for hit in (np.flatnonzero((part == 0x3D) | (part == 0x3A)), _long_runs(part, at, _HEX_BYTE, 32), _long_runs(part, at, _UPPER_BYTE, 16)):
            out[a:b] |= np.diff(np.searchsorted(hit, at)) > 0
    return out


def _long_runs(part: np.ndarray, at: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    s, e, _ = tb.split_words(part, at, table)
    return s[e - s >= least]


class Symbols:
    """A block of texts as symbols, each text between paddings, and the candidates of all of them.

    ``start`` and ``end`` are the candidates' places in ``codes``, ``text`` the number of their text.
    """

    def __init__(self, texts: list[str], base: list[list]):
        sizes = np.array([len(t) for t in texts], np.int64)
        gap = BEFORE + AFTER
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.cumsum(sizes + gap) - sizes - AFTER  # place of each text's first character
        self.codes = np.zeros(int((sizes + gap).sum()), np.uint8)
        shown = np.ones(len(self.codes), bool)
        shown[(self.first[:, None] - np.arange(1, BEFORE + 1)).reshape(-1)] = False
        shown[((self.first + sizes)[:, None] + np.arange(AFTER)).reshape(-1)] = False
        self.codes[shown] = np.take(_CODE, np.minimum(points, 127))
        inside = np.take(_RUN_CODE, self.codes)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
        start, end = edge[::2], edge[1::2]
        long = end - start >= MIN_RUN
        self.start, self.end = start[long], end[long]
        self.text = np.searchsorted(self.first, self.start, "right") - 1
        # Base findings, and the runs that they overlap.
        rows = [(k, *x[1:]) for k, found in enumerate(base) for x in found]
        self.base = np.array(rows, np.int64).reshape(-1, 5)
        self.base[:, 1:] += self.first[self.base[:, 0]][:, None]
        if len(rows):
            by = np.argsort(self.base[:, 1], kind="stable")
            begins, reach = self.base[by, 1], np.maximum.accumulate(self.base[by, 2])
            before = np.searchsorted(begins, self.end) - 1  # findings that start before the run ends
            free = (before < 0) | (reach[np.maximum(before, 0)] <= self.start)
            self.start, self.end, self.text = self.start[free], self.end[free], self.text[free]

def _blocks(batches):
    """(rows of the batch, texts, base findings) of about ``BLOCK_CHARS`` characters."""
    for batch in batches:
        column = batch.column(1)
        for a, b in tb.blocks(tb.utf8(column)[1], BLOCK_CHARS):
            part = batch.slice(a, b - a)
            texts = [t or "" for t in part.column(1).to_pylist()]
            maybe = _maybe(part.column(1))
            yield part, texts, [base_findings(t) if k else [] for t, k in zip(texts, maybe.tolist())]


def _with_digit(s: Symbols) -> np.ndarray:
    """Which candidates hold a digit."""
    digit = np.concatenate([[0], np.cumsum(_DIGIT_CODE[s.codes])])
    return digit[s.end] > digit[s.start]


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of findings with their context."""
    return tb.hash_words(codes, start - BEFORE, end + AFTER) if len(start) else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- a bounded labelled sample

def _smallest(label: list, key: np.ndarray, views: list, size: dict) -> list[tuple]:
    """Of (label, hash, symbols) the different ones with the ``size`` smallest hashes of each label."""
    out = []
    for name in LABELS:
        rows = {}
        for x, h, v in zip(label, key, views):
            if x == name:
                rows.setdefault((h, v), (name, h, v))
        out += [rows[k] for k in sorted(rows)[:size[name]]]
    return out


def _sizes(sample: int) -> dict:
    return {"secret": sample, "digits": sample // 2, "plain": sample - sample // 2}


def _sampler(sample: int):
    size = _sizes(sample)

    def pick(batches):
        held: list[tuple] = []
        bar = {x: np.uint64(2 ** 64 - 1) for x in LABELS}
        for _, texts, base in _blocks(batches):
            s = Symbols(texts, base)
            spans = [("secret", s.base[:, 3], s.base[:, 4])]
            has = _with_digit(s)
            spans += [("digits", s.start[has], s.end[has]), ("plain", s.start[~has], s.end[~has])]
            for name, a, b in spans:
                h = _hashes(s.codes, a, b)
                for k in np.flatnonzero(h <= bar[name]).tolist():
                    held.append((name, int(h[k]), (int(b[k] - a[k]), s.codes[a[k] - BEFORE:b[k] + AFTER].tobytes())))
            if len(held) > 8 * sample:
                held = _smallest(*zip(*held), size)
                for name in LABELS:
                    own = [h for x, h, _ in held if x == name]
                    if len(own) == size[name]:
                        bar[name] = np.uint64(own[-1])
        if held:
            held = _smallest(*zip(*held), size)
        yield _sample_batch(held)
    return pick


def _sample_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*[(x, h - 2 ** 63, n, v) for x, h, (n, v) in rows])) or [()] * 4
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["label", "hash", "size", "symbols"])


def _merger(sample: int):
    size = _sizes(sample)

    def merge(batches):
        held: list[tuple] = []
        for batch in batches:
            c = batch.to_pydict()
            held += [(x, h + 2 ** 63, (n, v)) for x, h, n, v in zip(c["label"], c["hash"], c["size"], c["symbols"])]
            held = _smallest(*zip(*held), size) if held else held
        yield _sample_batch(held)
    return merge


def labelled_sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple]:
    """(symbols with context, size of the value, is a secret) of different findings, in turn of label."""
    kind = "label string, hash long, size long, symbols binary"
    found = docs.mapInArrow(_sampler(size), kind)
    # Tasks return 2 * size rows at most; equal findings meet before the sample is cut for good.
    n = max(1, found.rdd.getNumPartitions() // 256)
    rows = found.repartition(n, "hash").mapInArrow(_merger(size), kind).collect()
    rows = _smallest([r.label for r in rows], [r.hash for r in rows], [(r["size"], bytes(r.symbols)) for r in rows], _sizes(size))
    out = [[(v, n, x == "secret") for x, _, (n, v) in rows if (x == "secret") == label] for label in (True, False)]
    return [x for _, x in sorted([*enumerate(out[0]), *enumerate(out[1])], key=lambda p: p[0])]


# ---------------------------------------------------------------- the network

PAD, OTHER, SYMBOLS, EMBED, WIDTH, FILTERS = 0, 1, 97, 12, 5, 24
LENGTH = BEFORE + VIEW + AFTER
HALF = WIDTH // 2
GROUPS = 4  # maxima before, inside and behind, mean inside

_CODE = np.array([k - 30 if 32 <= k < 127 else OTHER for k in range(128)], np.uint8)
_RUN_CODE = np.zeros(256, bool)
_RUN_CODE[[ord(c) - 30 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGIT_CODE = np.zeros(256, bool)
_DIGIT_CODE[ord("0") - 30:ord("9") - 29] = True


def symbols(before: str, value: str, after: str) -> tuple[bytes, int]:
    """(symbols with context, size of the value) of one finding."""
    codes = lambda x: [ord(c) - 30 if 32 <= ord(c) < 127 else OTHER for c in x]
    left = codes(before[-BEFORE:])
    right = codes(after[:AFTER])
    return bytes([PAD] * (BEFORE - len(left)) + left + codes(value) + right + [PAD] * (AFTER - len(right))), len(value)


def views(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of LENGTH symbols, sizes of the part of the value in each, first row of each finding).

    A view holds the characters before the part, the part, the characters behind it and padding.
    """
    rows, sizes, first = [], [], []
    for v, n in found:
        first.append(len(rows))
        for at in range(0, max(1, n), VIEW):
            size = min(VIEW, n - at)
            part = np.frombuffer(v, np.uint8)[at:at + BEFORE + size + AFTER]
            rows.append(np.concatenate([part, np.zeros(LENGTH - len(part), np.uint8)]))
            sizes.append(size)
    return np.array(rows, np.int16).reshape(-1, LENGTH), np.array(sizes, np.int64), np.array(first, np.int64)


class CharNet:
    """Embedding, convolution, pooling, logistic output; trained by Adam."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "conv": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, GROUPS * FILTERS), "b": np.zeros(1)}
        self.scale, self.shift, self.threshold, self.precision, self.held_out = 1.0, 0.0, 1.0, 0.0, 0

    def _masks(self, size: np.ndarray) -> list[np.ndarray]:
        """Windows wholly before the part, centred in it, and wholly behind it."""
        at = np.arange(LENGTH - WIDTH + 1)[None, :]
        end = BEFORE + size[:, None]
        return [np.broadcast_to(at <= BEFORE - WIDTH, (len(size), at.shape[1])), (at >= BEFORE - HALF) & (at < end - HALF),
                (at >= end) & (at <= end + AFTER - WIDTH)]

    def _forward(self, x: np.ndarray, size: np.ndarray):
        p, n = self.p, len(x)
        steps = LENGTH - WIDTH + 1
        e = p["embed"][x] * (x != PAD)[:, :, None]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, WIDTH * EMBED)
        h = np.maximum(cols @ p["conv"] + p["bias"], 0).reshape(n, steps, FILTERS)
        masks = self._masks(size)
        parts = [h * m[:, :, None] for m in masks]
        weight = masks[1] / np.maximum(size, 1)[:, None]
        pooled = np.concatenate([x.max(axis=1) for x in parts] + [(h * weight[:, :, None]).sum(axis=1)], axis=1)
        return pooled @ p["out"] + p["b"][0], (cols, h, pooled, weight, parts, e)

    def logits(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k:k + 512], size[k:k + 512])[0] for k in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _gradient(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict:
        z, (cols, h, pooled, weight, parts, e) = self._forward(x, size)
        n, steps = len(x), h.shape[1]
        dz = (1 / (1 + np.exp(-z)) - y) / n
        g = {"out": pooled.T @ dz, "b": np.array([dz.sum()])}
        dp = (dz[:, None] * self.p["out"]).reshape(n, GROUPS, FILTERS)
        dh = weight[:, :, None] * dp[:, None, GROUPS - 1]
        rows, f = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for k, part in enumerate(parts):
            np.add.at(dh, (rows, part.argmax(axis=1), f), dp[:, k] * (part.max(axis=1) > 0))
        dh = (dh * (h > 0)).reshape(n * steps, FILTERS)
        g["conv"], g["bias"] = cols.T @ dh, dh.sum(axis=0)
        dcols = (dh @ self.p["conv"].T).reshape(n, steps, WIDTH, EMBED)
        de = np.zeros_like(e)
        for k in range(WIDTH):
            de[:, k:k + steps] += dcols[:, :, k]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x, de * (x != PAD)[:, :, None])
        return g

    def fit(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.005, seed: int = 12) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                k = order[at:at + batch]
                t += 1
                for name, g in self._gradient(x[k], size[k], y[k]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(v[name] / (1 - 0.999 ** t)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL, n: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps on smoothed targets, then the recall-constrained threshold; ``n`` counts each row."""
        n = np.ones(len(y)) if n is None else n.astype(float)
        pos, neg = (y * n).sum(), ((1 - y) * n).sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        w = np.array([1.0, 0.0])
        a = np.column_stack([z, np.ones_like(z)])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hess = (a * (n * q * (1 - q))[:, None]).T @ a + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, a.T @ (n * (q - target)))
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(w[0]), float(w[1])
        scores, times = self.probability(z[y > 0]), n[y > 0]
        by = np.argsort(scores, kind="stable")
        self.threshold = float(scores[by][np.searchsorted(np.cumsum(times[by]), int((1 - recall) * pos), "right")]) if len(scores) else 1.0
        found = self.probability(z) >= self.threshold
        self.precision = float((y * n)[found].sum() / n[found].sum()) if found.any() else 0.0
        self.held_out = int(pos)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def score(self, found: list[tuple]) -> np.ndarray:
        """Probability of each (symbols with context, size): the highest of its views."""
        if not found:
            return np.zeros(0)
        x, size, first = views(found)
        return self.probability(np.maximum.reduceat(self.logits(x, size), first))

    def tables(self) -> np.ndarray:
        """What each symbol at each place of a window adds to its convolution."""
        embed = self.p["embed"] * (np.arange(SYMBOLS) != PAD)[:, None]
        return np.stack([embed @ self.p["conv"][k * EMBED:(k + 1) * EMBED] for k in range(WIDTH)]).astype(np.float32)

    def _pairs(self) -> list[np.ndarray]:
        """``tables`` of the first two symbols of a window, with the bias, of the next two and of the last."""
        t = self.tables()
        t[0] += self.p["bias"].astype(np.float32)
        return [(t[j][:, None] + t[j + 1]).reshape(-1, FILTERS) for j in range(0, WIDTH - 1, 2)] + [t[WIDTH - 1]]

    def _convolved(self, codes: np.ndarray, place: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """The filters of the windows that begin at ``place``, by ``_pairs()``."""
        last = WIDTH - 1
        h = np.take(pairs[-1], codes[place + last], axis=0)
        for j, table in zip(range(0, last, 2), pairs):
            h += np.take(table, codes[place + j] * np.int64(SYMBOLS) + codes[place + j + 1], axis=0)
        return np.maximum(h, 0, out=h)

    def _pooled_inside(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: list[np.ndarray]):
        """(windows, rows of each place, view of each window, first symbol of each, maxima, means) centred in codes[a:b].

        The views must come by falling size.  Windows lie place by place: a row for the first of each view, then one for the second
        of those that have it, and so on, so that maxima and sums run over whole rows.
        """
        size = b - a
        many = np.searchsorted(-size, -np.arange(int(size[0])))  # views with a window at that place
        first = np.cumsum(many) - many
        view = np.arange(int(many.sum())) - np.repeat(first, many)
        place = a[view] + np.repeat(np.arange(len(many)), many) - HALF
        h = self._convolved(codes, place, pairs)
        rows = list(zip(first.tolist(), (first + many).tolist()))
        top, total = h[:len(a)].copy(), h[:len(a)].copy()
        for i, j in rows[1:]:
            np.maximum(top[:j - i], h[i:j], out=top[:j - i])
            total[:j - i] += h[i:j]
        return h, rows, view, place, top, total / size[:, None].astype(np.float32)

    def _inside(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """What the windows centred in codes[a:b] add to the score."""
        out = self.p["out"].astype(np.float32).reshape(GROUPS, FILTERS)
        by = np.argsort(a - b, kind="stable")
        *_, top, mean = self._pooled_inside(codes, a[by], b[by], pairs)
        total = np.empty(len(a), np.float32)
        total[by] = top @ out[1] + mean @ out[3]
        return total

    def _around(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """What the windows before and behind codes[a:b] add to the score."""
        out = self.p["out"].astype(np.float32).reshape(GROUPS, FILTERS)
        total = np.zeros(len(a), np.float32)
        for group, begin, n in ((0, a - BEFORE, BEFORE - WIDTH + 1), (2, b, AFTER - WIDTH + 1)):
            h = self._convolved(codes, (begin + np.arange(n)[:, None]).reshape(-1), pairs).reshape(n, len(a), FILTERS)
            total += h.max(axis=0) @ out[group]
        return total

    def _most_around(self) -> float:
        """A bound of ``_around``: every filter at the best that any window could give it."""
        out = self.p["out"].reshape(GROUPS, FILTERS)
        top = np.maximum(self.p["bias"] + self.tables().astype(np.float64).max(axis=1).sum(axis=0), 0)
        return float(np.maximum(out[[0, 2]] * top, 0).sum())

    def score_places(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, least: float = 0.0, chunk: int = 512) -> np.ndarray:
        """The same probabilities for candidates at places of a row of symbols, by look-ups; see ``logit_places``."""
        return self.probability(self.logit_places(codes, start, end, least, chunk))

    def logit_places(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, least: float = 0.0, chunk: int = 512) -> np.ndarray:
        """The logits, before calibration, of candidates at places of a row of symbols, by look-ups.

        Equal values between equal neighbours are convolved once.  The windows around a view are left out if they could not
        lift it to the probability ``least``: what is returned for it then is a bound below ``least``.
        """
        a, b, owner = _views_of(start, end)
        n_views = np.bincount(owner, minlength=len(start))
        if not len(a):
            return np.zeros(0)
        _, example, same = np.unique(tb.hash_words(codes, a - HALF, b + HALF), return_index=True, return_inverse=True)
        pairs = self._pairs()
        z = np.concatenate([self._inside(codes, a[k], b[k], pairs) for k in (example[at:at + chunk] for at in range(0, len(example), chunk))])[same]
        z = z.astype(np.float64) + self.p["b"][0]
        best = z + self._most_around() + 1e-3  # more than rounding
        open_ = np.flatnonzero(self.probability(best) >= least) if self.scale > 0 else np.arange(len(z))
        shut = np.ones(len(z), bool)
        shut[open_] = False
        for at in range(0, len(open_), chunk):
            k = open_[at:at + chunk]
            z[k] += self._around(codes, a[k], b[k], pairs)
        z[shut] = best[shut]
        return np.maximum.reduceat(z, np.cumsum(n_views) - n_views)

    def gradient_places(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """The gradient of the weighted loss for views codes[a:b], by look-ups: windows are summed by place and symbol.

        A maximum passes its gradient to the windows that reach it only; a context of nothing but padding is the bias alone.
        """
        by = np.argsort(a - b, kind="stable")
        a, b, y, weight = a[by], b[by], y[by], weight[by]
        out, pairs = self.p["out"].astype(np.float32).reshape(GROUPS, FILTERS), self._pairs()
        h, rows, view, place, inside, mean = self._pooled_inside(codes, a, b, pairs)
        shown = np.concatenate([[0], np.cumsum(codes != PAD)])
        blank = np.maximum(self.p["bias"].astype(np.float32), 0)
        tops, around = {1: inside}, []
        for group, begin, end in ((0, a - BEFORE, a), (2, b, b + AFTER)):
            n = (BEFORE, AFTER)[group // 2] - WIDTH + 1
            some = shown[end] > shown[begin]
            at = (begin[some] + np.arange(n)[:, None]).reshape(-1)
            windows = self._convolved(codes, at, pairs).reshape(n, -1, FILTERS)
            tops[group] = np.tile(blank, (len(a), 1))
            tops[group][some] = windows.max(axis=0)
            around.append((group, n, some, at, windows))
        pooled = np.concatenate([tops[0], tops[1], tops[2], mean], axis=1)
        z = pooled.astype(np.float64) @ self.p["out"] + self.p["b"][0]
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = {"out": pooled.T.astype(np.float64) @ dz, "b": np.array([dz.sum()]), "bias": np.zeros(FILTERS)}
        sums = np.zeros((WIDTH, SYMBOLS * FILTERS))
        dz = dz.astype(np.float32)[:, None]
        for group, n, some, at, windows in around:
            top = tops[group][some]
            hit = np.flatnonzero(windows == np.where(top > 0, top, -1))
            window, f = np.divmod(hit, FILTERS)
            w = (dz[some] * out[group])[window % max(1, len(top)), f]
            g["bias"] += n * dz[~some].sum(dtype=np.float64) * out[group] * (blank > 0)
            for j in range(WIDTH):
                sums[j] += np.bincount(codes[at[window] + j] * np.int64(FILTERS) + f, w, SYMBOLS * FILTERS)
        most, each = dz * out[1], (dz / (b - a)[:, None]).astype(np.float32) * out[3]
        dh = np.empty_like(h)
        for i, j in rows:
            np.multiply(h[i:j] == inside[:j - i], most[:j - i], out=dh[i:j])
            dh[i:j] += each[:j - i]
        dh *= h > 0
        # View by view, with WIDTH - 1 rows of zeros in front of each: the windows over a symbol are WIDTH rows in a row, the last place first.
        size = b - a + WIDTH - 1
        first = np.cumsum(size) - size
        spread = np.zeros((int(size.sum()) + WIDTH - 1, FILTERS), np.float32)
        spread[(first - a + HALF)[view] + place + WIDTH - 1] = dh
        over = np.lib.stride_tricks.sliding_window_view(spread.reshape(-1), WIDTH * FILTERS)[::FILTERS]
        c = codes[np.arange(len(over)) + np.repeat(a - HALF - first, size)]
        by = np.argsort(c, kind="stable")
        last = np.cumsum(np.bincount(c, minlength=SYMBOLS)).tolist()
        over, total = over[by], np.zeros((SYMBOLS, WIDTH * FILTERS), np.float32)
        for row, i, j in zip(total, [0, *last], last):
            if i < j:
                np.add.reduce(over[i:j], axis=0, out=row)  # row after row, which ``reduceat`` does not do
        sums = sums.reshape(WIDTH, SYMBOLS, FILTERS) + total.reshape(SYMBOLS, WIDTH, FILTERS)[:, ::-1].transpose(1, 0, 2)
        g["bias"] += sums[0].sum(axis=0)  # each window once
        g["conv"], g["embed"] = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["embed"])
        sums *= (np.arange(SYMBOLS) != PAD)[:, None]
        for j in range(WIDTH):
            rows = slice(j * EMBED, (j + 1) * EMBED)
            g["conv"][rows] = self.p["embed"].T @ sums[j]
            g["embed"] += sums[j] @ self.p["conv"][rows].T
        return g


def _views_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of its candidate) of the parts of at most ``VIEW`` characters."""
    n_views = -(-(end - start) // VIEW)
    owner = np.repeat(np.arange(len(start)), n_views)
    a = start[owner] + VIEW * (np.arange(len(owner)) - np.repeat(np.cumsum(n_views) - n_views, n_views))
    return a, np.minimum(a + VIEW, end[owner]), owner


class Adam:
    def __init__(self, net: CharNet, rate: float = 0.005):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            self.net.p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)


def train(sample: list[tuple], recall: float = RECALL) -> CharNet | None:
    """A calibrated network from (symbols with context, size, is a secret); None with too few held-out secrets for ``recall``."""
    y = np.array([float(x[2]) for x in sample])
    fold = np.array([k % 10 in (2, 3) for k in range(len(sample))], bool)  # a fifth, of both labels in turn
    if not len(sample) or (1 - recall) * y[fold].sum() < 1 - 1e-9 or min((1 - y)[fold].sum(), y[~fold].sum(), (1 - y)[~fold].sum()) < 1:
        return None
    blank = np.arange(len(sample)) // 2 % 2 == 0
    shown = [(bytes(BEFORE) + v[BEFORE:BEFORE + n] + bytes(AFTER) if hide else v, n) for (v, n, _), hide in zip(sample, blank)]
    net = CharNet()
    x, size, first = views([v for v, f in zip(shown, fold) if not f])
    times = np.diff(np.append(first, len(x)))
    net.fit(x, size, np.repeat(y[~fold], times))
    # Whole candidates as the scan meets them: with their context, by their highest view.
    x, size, first = views([(v, n) for (v, n, _), f in zip(sample, fold) if f])
    net.calibrate(np.maximum.reduceat(net.logits(x, size), first), y[fold], recall)
    return net


# ---------------------------------------------------------------- training on every finding

def _secrets(batches):
    """Each secret with its context, and whether it is held out."""
    for _, texts, base in _blocks(batches):
        some = [k for k, found in enumerate(base) if found]
        s = Symbols([texts[k] for k in some], [base[k] for k in some])
        a, b = s.base[:, 3], s.base[:, 4]
        held = _hashes(s.codes, a, b) % np.uint64(HELD_OUT) == 0
        views = [s.codes[i - BEFORE:j + AFTER].tobytes() for i, j in zip(a.tolist(), b.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(views, pa.binary()), pa.array(held, pa.bool_())], names=["symbols", "held_out"])


def _joined(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends) of findings one after the other."""
    size = np.array([len(x) for x in symbols], np.int64)
    first = np.cumsum(size) - size
    return np.frombuffer(b"".join(symbols), np.uint8), first + BEFORE, first + size - AFTER


def _stream(path: str, seed: int):
    """Stored secrets for ever, file by file, shuffled in bounded groups; none if there are none."""
    store, root = filesystem(path)
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
    rng = np.random.default_rng(seed)
    while True:
        some = False
        for f in rng.permutation(len(files)).tolist():
            with store.open_input_file(files[f]) as file:
                for batch in pq.ParquetFile(file).iter_batches(4096, columns=["symbols"]):
                    rows = batch.column(0).to_pylist()
                    for k in rng.permutation(len(rows)).tolist():
                        some = True
                        yield rows[k]
        if not some:
            return


def _batch(net: CharNet, s: Symbols, has: np.ndarray, h: np.ndarray, pick: np.ndarray, secrets: list[bytes]) -> dict:
    """The gradient of one batch: the candidates ``pick`` and ``secrets``, both with half the weight."""
    own, x, y = _joined(secrets)
    hide = np.concatenate([(_hashes(own, x, y) >> np.uint64(32)) & np.uint64(1), (h[pick] >> np.uint64(32)) & np.uint64(1)]).astype(bool)
    # Symbols of this batch only, so that blanked contexts are its own.
    start, end = np.concatenate([x, s.start[pick] + len(own)]), np.concatenate([y, s.end[pick] + len(own)])
    size = end - start + BEFORE + AFTER
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(start - BEFORE - first, size)
    codes = np.where(at < len(own), own[np.minimum(at, len(own) - 1)], s.codes[np.maximum(at - len(own), 0)])
    outside = (at < np.repeat(start, size)) | (at >= np.repeat(end, size))
    codes[outside & np.repeat(hide, size)] = PAD
    a, b, owner = _views_of(first + BEFORE, first + size - AFTER)
    label = np.concatenate([np.zeros(len(x), np.int64), 2 - has[pick]])  # secrets, with digits, plain
    share = np.array([2.0, 1.0, 1.0])
    times = np.bincount(label[owner], minlength=3)
    share[1:] = share[1:] * (times[1:] > 0)
    share[1:] *= 2 / share[1:].sum()
    return net.gradient_places(codes, a, b, (label == 0)[owner].astype(float), (share / np.maximum(times, 1) / 4)[label[owner]])


def _rounder(net, path: str, turn: int):
    """Trains the broadcast network on the candidates of a task and returns its parameters, times its steps, as whole numbers."""
    def run(batches):
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng([turn, task])
        model = CharNet()
        model.p = {k: v.copy() for k, v in net.value.items()}
        adam = Adam(model, 0.005 * (1 - turn / ROUNDS))
        stream = _stream(path, int(rng.integers(1 << 31)))
        last = None

        def learn(s, has, h, own):
            for some in np.array_split(rng.permutation(own), max(1, len(own) // OTHERS)):
                adam.step(_batch(model, s, has, h, some, [x for x, _ in zip(stream, range(SECRETS))]))

        for _, texts, base in _blocks(batches):
            s = Symbols(texts, base)
            h = _hashes(s.codes, s.start, s.end)
            own = np.flatnonzero(h % np.uint64(HELD_OUT) != 0)
            if len(own):
                last = (s, _with_digit(s), h, own)
                learn(*last)
        while last and adam.t < LEAST_STEPS:
            learn(*last)
        if last:
            flat = np.concatenate([model.p[k].reshape(-1) for k in sorted(model.p)])
            whole = np.rint(flat * 2.0 ** 20).astype(np.int64) * adam.t  # sums do not depend on their order
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(whole), pa.array(np.full(len(flat), adam.t))],
                                             names=["place", "total", "steps"])
    return run


def _counter(net, held_secrets: bool):
    """Counts of held-out findings by logit, in whole steps of 1 / GRID."""
    def count(batches):
        model = net.value
        total: dict[int, int] = {}

        def add(codes, a, b):
            z = np.floor((model.logit_places(codes, a, b) - 1e-3) * GRID).astype(np.int64) if len(a) else np.zeros(0, np.int64)
            for k, n in zip(*(x.tolist() for x in np.unique(z, return_counts=True))):
                total[k] = total.get(k, 0) + n

        if held_secrets:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    add(*_joined(batch.column(0).slice(at, 4096).to_pylist()))
        else:
            for _, texts, base in _blocks(batches):
                s = Symbols(texts, base)
                held = _hashes(s.codes, s.start, s.end) % np.uint64(HELD_OUT) == 0
                add(s.codes, s.start[held], s.end[held])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([held_secrets] * len(total), pa.bool_()),
                                          pa.array(list(total.values()), pa.int64())], names=["z", "secret", "n"])
    return count


def train_on_all(docs: DataFrame, recall: float = RECALL) -> CharNet | None:
    """A calibrated network from every labelled finding of ``docs`` (row_id, text); None with too few held-out secrets for ``recall``."""
    spark = docs.sparkSession
    found = docs.mapInArrow(_secrets, "symbols binary, held_out boolean").distinct()
    path = shared_path(spark, "secrets")
    found.write.partitionBy("held_out").parquet(path)
    secrets = spark.read.schema("symbols binary, held_out boolean").parquet(path)
    times = {r["held_out"]: r["count"] for r in secrets.groupBy("held_out").count().collect()}
    if (1 - recall) * times.get(True, 0) < 1 - 1e-9 or not times.get(False):
        return None
    net = CharNet()
    names = sorted(net.p)
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(net.p)
        rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn)
        got = rows.mapInArrow(_rounder(now, f"{path}/held_out=false", turn), "place long, total long, steps long")
        got = got.groupBy("place").agg(F.sum("total").alias("total"), F.sum("steps").alias("steps")).collect()
        if got:
            flat = np.array([r["total"] / r["steps"] for r in sorted(got, key=lambda r: r["place"])]) / 2.0 ** 20
            cuts = np.cumsum([net.p[k].size for k in names])[:-1]
            net.p = {k: x.reshape(net.p[k].shape) for k, x in zip(names, np.split(flat, cuts))}
        now.unpersist()
    now = spark.sparkContext.broadcast(net)
    kind = "z long, secret boolean, n long"
    counts = docs.mapInArrow(_counter(now, False), kind).unionByName(
        secrets.where("held_out").select("symbols").mapInArrow(_counter(now, True), kind))
    rows = counts.groupBy("z", "secret").agg(F.sum("n").alias("n")).orderBy("z", "secret").collect()
    y, n = np.array([float(r["secret"]) for r in rows]), np.array([r["n"] for r in rows])
    if not (y < 1).any():
        return None
    net.calibrate(np.array([r["z"] / GRID for r in rows]), y, recall, n)
    now.unpersist()
    return net


# ---------------------------------------------------------------- the scan

def _scorer(net):
    def score(batches):
        model = net.value
        for part, texts, base in _blocks(batches):
            learned: list[list] = [[] for _ in texts]
            if model is not None:
                s = Symbols(texts, base)
                hit = model.score_places(s.codes, s.start, s.end, model.threshold) >= model.threshold
                for k, a, b in zip(s.text[hit].tolist(), s.start[hit].tolist(), s.end[hit].tolist()):
                    learned[k].append(("learned", a - int(s.first[k]), b - int(s.first[k])))
            count = lambda kind: pa.array([sum(x[0] == kind for x in row) for row in base], pa.int64())
            joined = lambda row: ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in row)
            both = [sorted([*b, *x], key=lambda s: (s[1], KINDS.index(s[0]))) for b, x in zip(base, learned)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), count("assign"), count("access"), count("hex"),
                 pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                 pa.array([joined(x) for x in both], pa.string()), pa.array([len(x) for x in learned], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"])
    return score


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int | None = None, recall: float = RECALL,
         labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, counts per base kind, base_sha256, all spans and the number of learned ones.

    The labelled findings come from the texts of ``labelled``, or of ``docs`` itself: all of them, or ``sample`` of each label if given.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).alias("row_id"), F.col(text).cast("string").alias("text"))
    source = (docs if labelled is None else labelled).select(F.col(doc_id).alias("row_id"), F.col(text).cast("string").alias("text"))
    net = spark.sparkContext.broadcast(train_on_all(source, recall) if sample is None else train(labelled_sample(source, sample), recall))
    long = T.LongType()
    schema = T.StructType([
        T.StructField("doc_id", d.schema["row_id"].dataType), T.StructField("n_assign", long), T.StructField("n_access", long),
        T.StructField("n_hex", long), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
        T.StructField("n_learned", long)])
    return d.mapInArrow(_scorer(net), schema)
