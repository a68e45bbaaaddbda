"""Words of many texts at once: splitting and 64-bit hashing over UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean byte table: true outside of ``ranges`` (both ends included)."""
    t = np.ones(256, bool)
    for a, b in ranges:
        t[a:b + 1] = False
    return t


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(texts) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges (first, last) of texts with at most ``limit`` bytes, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def split_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) of maximal runs of word bytes inside the texts."""
    mask = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    power, inverse = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _TABLE[7])


def words_of(texts: pa.Array, word: np.ndarray, spans: bool = False):
    """(hashes, first word of each text and the end[, starts, ends]) of the lower-cased words of ``texts``.

    Offsets are bytes from the start of the whole array.
    """
    data, offsets = utf8(texts)
    data = LOWER[data]
    hashes, firsts, starts, ends, n = [], [np.zeros(1, np.int64)], [], [], 0
    for a, b in blocks(offsets):
        lo, hi = offsets[a], offsets[b]
        s, e, f = split_words(data[lo:hi], offsets[a:b + 1] - lo, word)
        hashes.append(hash_words(data[lo:hi], s, e))
        firsts.append(f[1:] + n)
        n += len(s)
        if spans:
            starts.append(s + lo)
            ends.append(e + lo)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    out = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(firsts)
    return (*out, join(starts), join(ends)) if spans else out
