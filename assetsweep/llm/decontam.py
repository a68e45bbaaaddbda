"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one input partition with about ``SHARD_WORDS`` words.  Its words become
a sequence of symbols, one separator per document.  From the suffix order of that sequence come the
Burrows-Wheeler transform, held in a wavelet tree (one bit vector with popcount ranks per level), and
every ``SAMPLE``-th suffix position.  A test phrase is found by backward search: one pair of ranks per
word narrows the range of suffixes that start with the phrase.  Rows of the final range are located by
walking back to a sampled position.  Hits of all phrases are merged to removal spans per document.

Phrases are the windows of ``WINDOW`` consecutive words of each benchmark item; an item with fewer words
(but not none) is one phrase.  Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in
lower case, compared by 64-bit hashes.

Plan: one scan, no shuffle.  A shard lives only in the task that reads it, so a lost executor redoes its
own shards; the memory of a task is that of one shard, or of one document if that is longer.  The
phrases go to the executors in broadcasts of at most ``PHRASE_WORDS`` words each; a benchmark of any
size makes more of them, and each is searched in every shard.

Defined cases: null and empty texts have no words and are clean; items without words match nothing;
equal rows get equal results; equal items are each counted; items with a null id are searched like others, count as one item and
add nothing to the list of ids; an empty table of documents gives an empty
result, an empty benchmark finds nothing; extra columns are not read, their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.llm import textbytes as tb
from assetsweep.session import ship_package

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE = 8
PHRASE_WORDS = 1 << 20
WORD = tb.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class WaveletTree:
    """Ranks over a sequence of symbols below ``2 ** levels``."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.before.append(ones)
            low = s[~bit]
            self.zeros.append(len(low))
            s = np.concatenate([low, s[bit]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][at] + np.bitwise_count(self.words[k][at] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``i``, element by element."""
        low = np.zeros_like(i)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, i)
            low = np.where(one, self.zeros[k] + a, low - a)
            i = np.where(one, self.zeros[k] + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for k in range(self.levels):
            one = ((self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a = self._ones(k, i)
            i = np.where(one, self.zeros[k] + a, i - a)
            symbol = symbol * 2 + one
        return symbol


def suffix_order(symbols: np.ndarray, size: int) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    bits = max(1, int(size).bit_length())
    first = max(1, 62 // bits)  # so many symbols fit in one key
    padded = np.concatenate([symbols + 1, np.zeros(first, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(first):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rank[order] = np.repeat(head, np.diff(np.concatenate([head, [n]])))
    lone = np.zeros(n + 1, bool)
    lone[head] = True
    tied = np.flatnonzero(~(lone[:n] & np.concatenate([lone[1:n], [True]])))
    width = first
    while len(tied):
        rows = order[tied]
        pair = rank[rows] * (n + 1) + rank[np.minimum(rows + width, n)] + 1
        by = np.argsort(pair)
        rows, pair = rows[by], pair[by]
        order[tied] = rows
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        heads = tied[new]
        rank[rows] = np.repeat(heads, np.diff(np.concatenate([np.flatnonzero(new), [len(rows)]])))
        single = new & np.concatenate([new[1:], [True]])
        tied = tied[~single]
        width *= 2
    return order


class ShardIndex:
    """FM-index over the words of a shard.  ``firsts``: first word of each document, and the end."""

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray, sample: int = SAMPLE):
        lengths = np.diff(firsts)
        n_docs = len(lengths)
        self.alphabet, ids = np.unique(hashes, return_inverse=True)
        n = len(hashes) + n_docs
        doc_of_word = np.repeat(np.arange(n_docs), lengths)
        place = np.arange(len(hashes)) + doc_of_word
        ends = firsts[1:] + np.arange(n_docs)
        # Each document ends with a separator.  For the order they differ, so that no tie outlasts a document.
        ordered = np.empty(n, np.int64)
        ordered[place] = ids + n_docs
        ordered[ends] = np.arange(n_docs)
        order = suffix_order(ordered, len(self.alphabet) + n_docs)
        symbols = np.zeros(n, np.int64)
        symbols[place] = ids + 1
        starts = firsts[:-1] + np.arange(n_docs)
        self.n, self.starts = n, starts
        self.size = len(self.alphabet) + 1
        self.tree = WaveletTree(symbols[order - 1], self.size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.size))])
        keep = np.zeros(n, bool)
        keep[::sample] = True
        keep[starts] = True  # a walk never leaves its document
        kept = keep[order]
        self.sampled = np.cumsum(kept)
        self.has_sample = kept
        self.positions = order[kept]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for words that the shard does not hold."""
        if not len(self.alphabet):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, at + 1, 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search; ``phrases`` holds the words of each phrase at the end of its row."""
        symbols = self.symbols(phrases)
        width = phrases.shape[1]
        used = np.arange(width)[None, :] >= (width - lengths)[:, None]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        hi[(used & (symbols == 0)).any(axis=1)] = 0
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero(used[:, k] & (lo < hi))
            c = symbols[live, k]
            lo[live] = self.smaller[c] + self.tree.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows, by walking back to sampled ones."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.has_sample[rows])
        while len(todo):
            c = self.tree.access(rows[todo])
            rows[todo] = self.smaller[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.has_sample[rows[todo]]]
        return self.positions[self.sampled[rows] - 1] + steps


class Phrases:
    """Distinct phrases of items: words by row, lengths, and the items of each (CSR)."""

    def __init__(self, items: list, texts: pa.Array, window: int = WINDOW):
        hashes, firsts = tb.words_of(texts, WORD)
        rows, owners = [], []
        for k in range(len(items)):
            w = hashes[firsts[k]:firsts[k + 1]]
            if not len(w):
                continue
            if len(w) < window:
                w = np.concatenate([np.zeros(window - len(w), np.uint64), w])
            cut = np.lib.stride_tricks.sliding_window_view(w, window)
            rows.append(np.column_stack([np.full(len(cut), min(window, firsts[k + 1] - firsts[k]), np.uint64), cut]))
            owners.append(np.full(len(cut), k))
        table = np.concatenate(rows) if rows else np.zeros((0, window + 1), np.uint64)
        distinct, inverse = np.unique(table, axis=0, return_inverse=True)
        self.words, self.lengths = distinct[:, 1:], distinct[:, 0].astype(np.int64)
        pairs = np.unique(np.column_stack([inverse.reshape(-1), np.concatenate(owners) if owners else np.zeros(0, np.int64)]), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        self.owner = pairs[:, 1]
        self.items = items


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, element) of all elements of the ranges lo .. lo + n."""
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def scan_shard(hashes: np.ndarray, firsts: np.ndarray, groups: list[Phrases]):
    """(covered words as a boolean array, per document the list of found items)."""
    n_docs = len(firsts) - 1
    found: list[set] = [set() for _ in range(n_docs)]
    edges = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        index = ShardIndex(hashes, firsts)
        for p in groups:
            lo, hi = index.search(p.words, p.lengths)
            live = np.flatnonzero(hi > lo)
            which, rows = _expand(lo[live], hi[live] - lo[live])
            at = index.locate(rows)
            doc = np.searchsorted(index.starts, at, "right") - 1
            word = at - doc
            np.add.at(edges, word, 1)
            np.add.at(edges, word + p.lengths[live][which], -1)
            pairs = np.unique(doc * len(p.lengths) + live[which])
            for d, phrase in zip(*np.divmod(pairs, max(1, len(p.lengths)))):
                found[d].update(p.items[k] for k in p.owner[p.first[phrase]:p.first[phrase + 1]].tolist())
    return np.cumsum(edges[:-1]) > 0, found


def _shards(batches: Iterator[pa.RecordBatch], limit: int):
    held, words = [], 0
    for batch in batches:
        for a, b in _cuts(batch.column(1)):
            part = batch.slice(a, b - a)
            hashes, firsts, starts, ends = tb.words_of(part.column(1), WORD, spans=True)
            held.append((part, hashes, firsts, starts, ends))
            words += len(hashes)
            if words >= limit:
                yield held
                held, words = [], 0
    if held:
        yield held


def _cuts(texts: pa.Array):
    _, offsets = tb.utf8(texts)
    return tb.blocks(offsets, 1 << 22)


def _code_points(text: str, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte offsets of a text as code points."""
    raw = np.frombuffer(text.encode(), np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return list(zip(before[starts].tolist(), before[ends].tolist()))


def _schema(id_type) -> T.StructType:
    span = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
    return T.StructType([
        T.StructField("row_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])


def _scanner(groups, limit: int):
    def scan(batches):
        phrases = [g.value for g in groups]
        for held in _shards(batches, limit):
            hashes = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([np.diff(h[2]) for h in held])
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            hit, found = scan_shard(hashes, firsts, phrases)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[firsts[1:]] - total[firsts[:-1]]
            k = 0
            for part, _, own, starts, ends in held:
                _, offsets = tb.utf8(part.column(1))
                spans = []
                for j in range(part.num_rows):
                    if not n_hit[k + j]:
                        spans.append([])
                        continue
                    # Runs of covered words are one span each.
                    h = hit[firsts[k + j]:firsts[k + j + 1]]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], h.astype(np.int8), [0]])))
                    a = starts[own[j] + turn[::2]] - offsets[j]
                    b = ends[own[j] + turn[1::2] - 1] - offsets[j]
                    spans.append([{"s": x, "e": y} for x, y in _code_points(part.column(1)[j].as_py(), a, b)])
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes[k:k + n], pa.int64()), pa.array(n_hit[k:k + n], pa.int64()),
                    pa.array([sorted(f, key=lambda i: (i is None, i)) for f in found[k:k + n]], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                    names=["row_id", "n_words", "n_hit", "items", "spans"])
                k += n
    return scan


def phrase_groups(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW):
    """Broadcasts of phrases, each from items with about PHRASE_WORDS words (or one longer item)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + size // (PHRASE_WORDS * 6)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i").toArrow().combine_chunks()
        texts = rows.column("t").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        yield spark.sparkContext.broadcast(Phrases(rows.column("i").to_pylist(), texts, window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: row_id, n_words, n_hit, items (ids as strings, sorted) and removal spans in code points.

    ``doc_id`` names the column that is returned as ``row_id``; it may be a struct of the whole row.
    """
    ship_package(docs.sparkSession)
    groups = list(phrase_groups(benchmark))
    d = docs.select(F.col(doc_id).alias("row_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_scanner(groups, shard_words), _schema(d.schema["row_id"].dataType))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    return found.select(
        F.col("row_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all columns, the merged spans of test phrases cut out of the text.

    The scan hands the text through, so that no join is needed.  Null texts stay null.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = find_contamination(row, benchmark, "row", "text")
    t = F.col("row_id")[text]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "spans", start,
        lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.substr(t, a["at"] + 1, x["s"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1, F.length(t))))
    return found.select(*[(F.when(F.col("n_hit") > 0, cut).otherwise(t) if c == text else F.col("row_id")[c]).alias(c)
                          for c in docs.columns])


# The same report for DuckDB, with plain n-gram joins.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), p AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0))
), g AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)
), hit AS (
  SELECT rid, i, p.n, item_id FROM g JOIN p ON g.g = p.g AND g.n = p.n
), words AS (
  SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hit) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
