"""Ranked lexical search with bag deduplication: every item of a query table against all documents.

A document's bag is its vector of term counts over the vocabulary of the items.  A document scores by its bag and
by m, a whole number made from its length; so documents with the same bag and the same m form a class and score alike for every
item.  Classes are found by hash and verified (the aggregate's key holds hash, m and the bag itself), each class is scored
once, and only the classes that reach an item's ``k`` best are expanded into members, by ascending doc_id.

The ``k`` best classes by (score, smallest doc_id) hold the ``k`` best documents: a document among the best brings the smallest
doc_id of its class with it, which scores the same.

Plan: items are searched in blocks of at most ``BLOCK_ITEMS`` items and about ``BLOCK_BYTES`` of text, so what is broadcast (the
vocabulary and its postings of one block) does not grow with the number of items; each block is one pass:

1. scan: terms are hashed over UTF-8 bytes, counted per document and written as bags to the shared folder;
2. one exchange of (hash, m, bag) with map-side combine makes the classes: smallest doc_id and number of members;
3. document frequencies are summed from classes times members, per task before the exchange;
4. classes are scored in the scan of the class table, each task keeping ``k`` classes per item; the rest is a window over
   at most k rows per task and item, cut to k before its exchange;
5. the bags of the winners (k per item at most) meet the stored bags by hash in the scan; members of a class are cut to the k
   smallest ids before they move, so a class of any size moves k rows per task.

Scores are exact: sums of whole numbers below 2^53 in doubles, in 64-bit integers above.  Terms that stand in many items
and many documents are multiplied as dense columns, the others are gathered by postings; the boundary is the cheaper of both
by their frequencies and changes no result.

Terms are compared by 64-bit hashes.  Among n different words of the documents and v of a block, n * v / 2^64 false
matches are expected (about 5e-6 for 1e10 and 1e4).

Defined cases: a null text has no term; a document without terms does not count into N; a document or item without common
terms gives no row; every row of either table counts on its own, equal rows too; null doc_ids come last among equal
scores; rows with equal item_id are searched on their own; empty tables give an empty result; keys of documents are integers; only the named
columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetsweep.llm import textbytes as tb
from assetsweep.llm.common import stored
from assetsweep.session import literal_table, ship_package

K = 10
BLOCK_ITEMS = 4096
BLOCK_BYTES = 1 << 23
DENSE_CELLS = 1 << 22
SCORE_CELLS = 1 << 19

#: Word characters: digits, ASCII letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTE = tb.byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RESULT = "rank int, doc_id long, score long"


# ---------------------------------------------------------------- items

class ItemBlock:
    """Terms of a block of items: sorted hashes, and postings (item, repeats) term by term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, repeats: np.ndarray):
        """Parallel arrays of (number of the item, hash of the term, how often it stands in the item)."""
        self.vocabulary, place = np.unique(term, return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.items, self.item = np.unique(item[order], return_inverse=True)
        self.repeats = repeats[order].astype(np.int64)
        self.first = np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Weights by document frequency, and which terms go by dense columns."""
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        value = self.repeats * np.repeat(self.weight, np.diff(self.first))
        top = np.bincount(self.item, weights=value, minlength=len(self.items)).max(initial=0)
        # A term counts 1e9 * tf div (1000 * tf + 8 * m), which is below 1e6.
        self.kind = np.float64 if top * 1e6 < 2 ** 53 else np.int64
        self.value = value.astype(self.kind)
        # A gathered posting costs about as much as 125 dense cells.
        often = df / max(1, n) * np.diff(self.first)
        dense = np.flatnonzero(often * 125 > len(self.items))
        dense = dense[np.argsort(-often[dense], kind="stable")][:max(1, DENSE_CELLS // max(1, len(self.items)))]
        self.column = np.full(len(self.vocabulary), -1)
        self.column[dense] = np.arange(len(dense))
        self.matrix = np.zeros((len(dense), len(self.items)), self.kind)
        for row, t in enumerate(dense.tolist()):
            a, b = self.first[t], self.first[t + 1]
            np.add.at(self.matrix[row], self.item[a:b], self.value[a:b])

    def scores(self, row: np.ndarray, term: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` bags for all items; parallel arrays of (bag, term, share of that term)."""
        column = self.column[term]
        d = column >= 0
        bags = np.zeros((n, len(self.matrix)), self.kind)
        bags[row[d], column[d]] = share[d]
        out = bags @ self.matrix
        row, term, share = row[~d], term[~d], share[~d]
        size = self.first[term + 1] - self.first[term]
        total = np.cumsum(size)
        at = np.repeat(self.first[term] - (total - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(row, size) * len(self.items) + self.item[at]
        added = np.repeat(share, size).astype(self.kind) * self.value[at]
        if self.kind is np.float64:
            return out + np.bincount(cell, weights=added, minlength=out.size).reshape(out.shape)
        np.add.at(out.reshape(-1), cell, added)
        return out


def item_blocks(items: DataFrame, item_text: str, block_items: int, block_bytes: int):
    """(stored rows with ``item_no`` and ``block``, number of blocks)."""
    s = items.select("*", F.monotonically_increasing_id().alias("item_no"))
    s = stored(s, "lexical-items")
    size = s.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(item_text))).alias("b")).first()
    n = max(-(-size.n // block_items), -(-(size.b or 0) // block_bytes))
    return s.withColumn("block", F.pmod(F.xxhash64("item_no"), F.lit(max(1, n)))), n


def terms_of(text) -> F.Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def item_block(items: DataFrame, item_text: str) -> ItemBlock:
    """The terms of one block; ``items`` holds the rows of one block, whose size is bounded."""
    each = items.select("item_no", F.explode(terms_of(F.col(item_text))).alias("term")).groupBy("item_no", "term").count().toArrow()
    words, first = tb.words_of(each["term"].combine_chunks(), _TERM_BYTE)
    if len(words) != each.num_rows or (np.diff(first) != 1).any():
        raise ValueError("a term of an item is not one word")
    return ItemBlock(each["item_no"].to_numpy(), words, each["count"].to_numpy())


# ---------------------------------------------------------------- bags

def _bagger(vocabulary):
    def bags(batches):
        known = vocabulary.value
        for batch in batches:
            for a, b in tb.blocks(tb.utf8(batch.column(1))[1]):
                part = batch.slice(a, b - a)
                words, first = tb.words_of(part.column(1), _TERM_BYTE)
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hit = np.flatnonzero(known[at] == words)
                row = np.searchsorted(first, hit, "right") - 1
                key, tf = np.unique(row.astype(np.int64) << 32 | at[hit], return_counts=True)
                # Each bag: (term, count) pairs by term, 32 bits each.
                pairs = np.column_stack([key & 0xFFFFFFFF, tf]).astype("<u4")
                offsets = 8 * np.searchsorted(key, np.arange(part.num_rows + 1, dtype=np.int64) << 32)
                bag = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), bag], names=["doc_id", "n", "bag"])
    return bags


def bags(docs: DataFrame, vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats) and bag over a broadcast, sorted vocabulary of term hashes."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_bagger(vocabulary), "doc_id long, n long, bag binary")


def with_m(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``m`` of bags that hold a term; in decimals, so that no length overflows."""
    m = F.expr(f"25 + cast(75 * cast(n as decimal(38, 0)) * {n_docs} div {n_terms} as long)")
    return rows.where(F.octet_length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("m", "bag"))


def bag_classes(rows: DataFrame) -> DataFrame:
    """class_no, h, m, bag, first (smallest doc_id) and copies of each class; the key holds the bag, so equal hashes are verified."""
    classes = rows.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return stored(classes.withColumn("class_no", F.monotonically_increasing_id()), "lexical-classes")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bag, term, count) of a column of bags."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view("<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 8), data[:, 0], data[:, 1]


def document_frequencies(classes: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term, from classes and their members."""
    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            if batch.num_rows:
                row, term, _ = _pairs(batch.column(0))
                np.add.at(total, term, batch.column(1).to_numpy()[row])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    found = classes.select("bag", "copies").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


# ---------------------------------------------------------------- ranking

class Best:
    """The ``k`` best of every item by (score, no id, first id, class)."""

    def __init__(self, k: int, n_items: int):
        self.k, self.bar = k, np.ones(n_items)  # scores below the bar cannot enter
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(5))  # item, score, no id, first, class

    def add(self, scores: np.ndarray, none: np.ndarray, first: np.ndarray, number: np.ndarray) -> None:
        r, item = np.nonzero(scores >= self.bar)
        if not len(r):
            return
        new = item, scores[r, item].astype(np.int64), none[r], first[r], number[r]
        rows = [np.concatenate(x) for x in zip(self.rows, new)]
        order = np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        start = np.searchsorted(rows[0], rows[0])
        rank = np.arange(len(start)) - start
        self.rows = tuple(x[rank < self.k] for x in rows)
        full = rank == self.k - 1
        self.bar[rows[0][full]] = np.maximum(1, rows[1][full])


def _scorer(block, k: int):
    def score(batches):
        b = block.value
        best = Best(k, len(b.items))
        step = max(16, SCORE_CELLS // max(len(b.items), len(b.matrix), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, term, tf = _pairs(part.column(0))
                m = part.column(1).to_numpy()[row]
                share = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                none = np.asarray(part.column(2).is_null())
                best.add(b.scores(row, term, share, part.num_rows), none.astype(np.int64), part.column(2).fill_null(0).to_numpy(),
                         part.column(3).to_numpy())
        item, points, none, first, number = best.rows
        cols = [b.items[item], points, first, number]
        masks = [None, None, none.astype(bool), None]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=x) for c, x in zip(cols, masks)], names=["item_no", "score", "first", "class_no"])
    return score


def _top(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank; Spark cuts each task's rows to k before the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: ItemBlock, k: int, doc_id: str, text: str) -> DataFrame | None:
    """item_no, rank, doc_id and score for the items of one block; None if no document has a term."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary = sc.broadcast(block.vocabulary)
    found = stored(bags(docs, vocabulary, doc_id, text), "lexical-bags")
    size = found.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("terms")).first()
    if not size.terms:
        return None
    members = with_m(found, size.n, size.terms)
    classes = bag_classes(members)
    block.weigh(document_frequencies(classes, len(block.vocabulary)), size.n)
    weighed = sc.broadcast(block)
    some = classes.select("bag", "m", "first", "class_no").mapInArrow(_scorer(weighed, k), "item_no long, score long, first long, class_no long")
    order = [F.col("score").desc(), F.col("first").asc_nulls_last(), "class_no"]
    winners = stored(_top(some, ["item_no"], order, k).drop("rank", "first"), "lexical-winners")
    # At most k classes an item: the hashes of their bags, 8 bytes each, go to every task.
    numbers = winners.select("class_no").distinct()
    chosen = stored(classes.select("class_no", "h", "m", "bag").join(F.broadcast(numbers), "class_no", "left_semi"), "lexical-chosen")
    near = members.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi")
    few = _top(near.select("h", "m", "bag", "doc_id"), ["h", "m", "bag"], [F.col("doc_id").asc_nulls_last()], k).drop("rank")
    expanded = few.join(chosen, ["h", "m", "bag"]).select("class_no", "doc_id").join(winners, "class_no")
    return stored(_top(expanded, ["item_no"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
                  .select("item_no", "rank", "doc_id", "score"), "lexical-ranks")


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents with a score above 0 for each row of ``items``."""
    spark = docs.sparkSession
    ship_package(spark)
    queries = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item_text"))
    queries, n_blocks = item_blocks(queries, "item_text", block_items, block_bytes)
    out = literal_table(spark, [], f"item_no long, {RESULT}")
    for number in range(n_blocks):
        block = item_block(queries.where(F.col("block") == number), "item_text")
        ranks = _search_block(docs, block, k, doc_id, text) if len(block.vocabulary) else None
        if ranks is not None:
            out = out.unionByName(ranks)
    return out.join(queries.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH t AS (SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS w
           FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
f AS (SELECT r, w, any_value(doc_id) AS doc_id, count(*) AS tf FROM t GROUP BY r, w),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM f GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT r, 25 + ((75 * n * docs) // terms) AS m FROM d, g),
w AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
      FROM (SELECT w, count(*) AS df FROM f GROUP BY w), g),
q AS (SELECT q, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS w
      FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
s AS (SELECT q, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
             sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (w) JOIN m USING (r) JOIN w USING (w) GROUP BY q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
