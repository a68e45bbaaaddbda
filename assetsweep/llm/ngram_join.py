"""N-gram Jaccard self-join of documents, size-aware, with small sets and large sets apart.

A document's set holds its distinct 5-word shingles (64-bit hashes of lower-cased words).  Two sets of a and b
shingles link when 9 * |A n B| >= 4 * (a + b), which is a Jaccard similarity of 0.8 or more; t(a, b) is the
least such overlap.

* **One node per different set.**  Equal sets collapse first (``sid``, a 64-bit hash of the set), so copies
  never meet each other.
* **Small sets** (up to ``boundary`` shingles): every subset of t(a, b) elements is enumerated for every
  partner size.  Two sets of sizes a <= b share such a subset exactly if they link, so a bucket needs no
  check and no pairs: all its members link to its smallest-numbered set of size a.
* **Large sets**: inverted lists are scanned.  In one global order of shingles (rare ones first, by a
  count sketch over all documents, then by hash) linked sets share a shingle among their first
  a - t(a, b) + 1 ones, so only those are posted.  Positions and sizes bound the overlap, a parity bitmap
  bounds it again (the Hamming distance of the bitmaps is at most the symmetric difference), and the
  pairs that are left are compared shingle by shingle.
* **The boundary** is the size with the least estimated cost: subsets to enumerate below it, postings to
  scan above it, from the histogram of small set sizes.

Components instead of all pairs: in each list all members are first compared with the list's pivot (the
member that holds the shingle earliest).  Then, per list, members outside of the list's largest component
are compared with the members of other components.  A pair that is never compared stands in one
component already, so no link between different components is lost and groups of near copies cost a
number of comparisons near their size.

Plan: lists of frequent shingles are salted by their sketch count; aggregates and joins on shingles and
components can be split by AQE.  What is broadcast has a fixed size (the sketch levels) or a checked one
(the hashes of sets whose texts are wanted, at most ``MAX_WANTED``; above it a Bloom filter of bounded size
goes before an exact join).  Intermediate tables are written to the shared folder, where every later stage reads them.

Defined cases: a null or empty text has the empty set and links with nothing; a text of fewer than five
words has one shingle, the whole sequence; equal rows are in one component; a null doc_id takes part and
is never a component's name unless all its documents are null; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assetsweep.llm import textbytes as tb
from assetsweep.llm.common import stored
from assetsweep.operators.skew import filter_by_ids
from assetsweep.session import ship_package

SHINGLE = 5
SMALL = 24  # sets up to this size may be enumerated; the boundary is at most this
LEVEL_BITS = 22
CHUNK_BITS = 16
POSTING_COST = 4
SALT_LEVEL = 14
EARLIER = 16
MAX_WANTED = 4_000_000

_WORD = tb.byte_class((0x20, 0x20), (0x09, 0x0D))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(a, b):
    return (4 * (a + b) + 8) // 9


def shingle_sets(texts: pa.Array):
    """(row, sorted distinct shingle hashes) of each text with a word."""
    data, offsets = tb.utf8(texts)
    for a, b in tb.blocks(offsets):
        lo, hi = offsets[a], offsets[b]
        part = tb.LOWER[data[lo:hi]]
        starts, ends, firsts = tb.split_words(part, offsets[a:b + 1] - lo, _WORD)
        h = tb.hash_words(part, starts, ends)
        rolled = h.copy()
        for k in range(1, SHINGLE):
            rolled[:-k or None] = rolled[:-k or None] * _STEP + h[k:] if k < len(h) else rolled[:-k or None]
        rolled = tb.mix(rolled)
        for k in range(b - a):
            f, e = firsts[k], firsts[k + 1]
            if e - f >= SHINGLE:
                yield a + k, np.unique(rolled[f:e - SHINGLE + 1])
            elif e > f:
                whole = np.array([e - f], np.uint64)
                for w in range(f, e):
                    whole = tb.mix(whole * _STEP + h[w:w + 1])
                yield a + k, whole


def set_id(tokens: np.ndarray) -> int:
    return int(tb.mix(np.array([tb.mix(tokens).sum() + np.uint64(len(tokens))]))[0].astype(np.int64))


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles per bit; bits: the power of two that is not below the size, 64 at least."""
    bits = max(64, 1 << int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


# ------------------------------------------------------------- sets and the order of shingles

_LONGS = T.ArrayType(T.LongType())


_DESCRIBED = ["doc_id", "h", "n", "sid", "bitmap", "small", "chunk", "counts"]


def _describe(batches):
    """Per row doc_id, h, n, sid, and for the first row of a set its bitmap and (if small) its shingles; then the
    task's sketch in compressed chunks."""
    seen: set[int] = set()
    id_type = None
    sketch = np.zeros(1 << LEVEL_BITS, np.uint32)
    longs = pa.list_(pa.int64())
    for batch in batches:
        id_type = batch.schema.field(0).type
        n = np.zeros(batch.num_rows, np.int64)
        sid: list = [None] * batch.num_rows
        bitmap: list = [None] * batch.num_rows
        small: list = [None] * batch.num_rows
        for k, tokens in shingle_sets(batch.column(2)):
            n[k], sid[k] = len(tokens), set_id(tokens)
            if sid[k] not in seen:
                seen.add(sid[k])
                np.add.at(sketch, (tokens >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), 1)
                bitmap[k] = parity_bitmap(tokens)
                if len(tokens) <= SMALL:
                    small[k] = tokens.astype(np.int64)
        empty = pa.nulls(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n), pa.array(sid, pa.int64()), pa.array(bitmap, longs),
             pa.array(small, longs), empty.cast(pa.int32()), empty.cast(pa.binary())], names=_DESCRIBED)
    chunks = sketch.reshape(-1, 1 << CHUNK_BITS)
    used = np.flatnonzero(chunks.any(axis=1))
    none = pa.nulls(len(used))
    packed = [zlib.compress(np.minimum(chunks[k], 65_535).astype(np.uint16).tobytes(), 1) for k in used]
    if len(used):
        yield pa.RecordBatch.from_arrays(
            [none.cast(t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), longs, longs)]
            + [pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=_DESCRIBED)


def _levels(batches):
    """Sums the sketches chunk by chunk; level = log2 of the count, rounded down."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            add = np.frombuffer(zlib.decompress(counts.as_py()), np.uint16)
            total[chunk] = total.get(chunk, 0) + add.astype(np.uint64)
    for chunk, counts in total.items():
        level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])


def shingle_levels(described: DataFrame) -> np.ndarray:
    """log2 of each sketch counter, over all documents; its size is fixed (2 ** LEVEL_BITS bytes)."""
    rows = (described.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk")
            .mapInArrow(_levels, "chunk int, level binary").collect())
    out = np.zeros(1 << LEVEL_BITS, np.uint8)
    for r in rows:
        out[r.chunk << CHUNK_BITS:(r.chunk + 1) << CHUNK_BITS] = np.frombuffer(r.level, np.uint8)
    return out


# ------------------------------------------------------------- small sets

def partner_sizes(n: int, limit: int) -> range:
    return range((4 * n + 4) // 5, min(limit, n * 5 // 4) + 1)


def subsets_of(n: int, limit: int) -> int:
    """Subsets that a set of n shingles enumerates below the boundary ``limit``."""
    return sum(math.comb(n, least_overlap(n, b)) for b in partner_sizes(n, limit) if least_overlap(n, b) <= n)


def choose_boundary(small_counts: dict[int, int], large_postings: float) -> int:
    """The boundary with the least cost; ``large_postings`` are those of the sets above SMALL."""
    best, least = 0, None
    for x in range(SMALL + 1):
        light = sum(c * subsets_of(n, x) for n, c in small_counts.items() if n <= x)
        heavy = large_postings + sum(c * (n // 5 + 1) for n, c in small_counts.items() if 5 * n > 4 * x)
        cost = light + POSTING_COST * heavy
        if least is None or cost < least:
            best, least = x, cost
    return best


def _subsets(limit: int):
    def enumerate_subsets(batches):
        for batch in batches:
            keys, sids, smaller = [], [], []
            for sid, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tb.mix(np.array(tokens, np.int64).view(np.uint64))
                n = len(own)
                for b in partner_sizes(n, limit):
                    lo, hi = min(n, b), max(n, b)
                    t = least_overlap(lo, hi)
                    if t > n:
                        continue
                    pick = np.array(list(itertools.combinations(range(n), t)))
                    tag = np.array([lo * 1000 + hi], np.uint64)
                    keys.append(tb.mix(own[pick].sum(axis=1) + tag * _STEP).astype(np.int64))
                    sids.append(np.full(len(pick), sid))
                    smaller.append(np.full(len(pick), n == lo))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sids, smaller)],
                                                 names=["key", "sid", "smaller"])
    return enumerate_subsets


def small_links(nodes: DataFrame, boundary: int) -> DataFrame:
    """(u, v) links among sets up to the boundary: members of a subset's bucket to its first smaller set."""
    rows = nodes.where((F.col("n") > 0) & (F.col("n") <= boundary)).select("sid", "small")
    rows = stored(rows.mapInArrow(_subsets(boundary), "key long, sid long, smaller boolean"), "join-subsets")
    head = rows.groupBy("key").agg(F.min(F.when(F.col("smaller"), F.col("sid"))).alias("u"),
                                   F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    head = head.where("u is not null and lo < hi").select("key", "u")
    return rows.join(head, "key").where("sid <> u").select("u", F.col("sid").alias("v")).distinct()


# ------------------------------------------------------------- large sets

def _post(levels, least: int):
    def post(batches):
        level_of = levels.value
        seen: set[int] = set()
        for batch in batches:
            out = []
            for _, tokens in shingle_sets(batch.column(0)):
                n = len(tokens)
                if n < least:
                    continue
                sid = set_id(tokens)
                if sid in seen:
                    continue
                seen.add(sid)
                level = level_of[(tokens >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                p = n // 5 + 1
                order = np.lexsort((tokens, level))[:p] if level.max() > level.min() else np.arange(p)
                salts = np.left_shift(1, np.maximum(level[order].astype(np.int64) - SALT_LEVEL, 0))
                out.append((tokens[order].astype(np.int64), np.full(p, sid), np.full(p, n), np.arange(p),
                            np.where(salts > 1, sid % salts, -1)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                    names=["token", "sid", "n", "pos", "salt"])
    return post


def _may_link(a: str, pa_: str, b: str, pb: str) -> Column:
    """Whether sets of sizes a and b that share a shingle at positions pa_ and pb can have the least overlap."""
    return F.expr(f"{a} - {pa_} >= (4 * ({a} + {b}) + 8) div 9 and {b} - {pb} >= (4 * ({a} + {b}) + 8) div 9")


def live_postings(docs: DataFrame, levels: np.ndarray, least: int) -> DataFrame:
    """Postings of lists with at least two sets, each with its list's pivot (psid, pn, ppos)."""
    spark = docs.sparkSession
    post = docs.select("text").mapInArrow(_post(spark.sparkContext.broadcast(levels), least),
                                          "token long, sid long, n int, pos int, salt int")
    w = Window.partitionBy("token", "salt")
    d = post.select("*", F.min(F.struct("pos", "n", "sid")).over(w).alias("p"), F.min("sid").over(w).alias("lo"),
                    F.max("sid").over(w).alias("hi")).where("lo < hi or salt >= 0")
    return stored(d.select("token", "salt", "sid", "n", "pos", F.col("p.sid").alias("psid"), F.col("p.n").alias("pn"),
                           F.col("p.pos").alias("ppos")), "join-postings")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def pivot_pairs(live: DataFrame) -> DataFrame:
    """Different pairs of a set and its list's pivot; pivots of the parts of one salted list meet too."""
    star = live.where("sid <> psid").where(_may_link("n", "pos", "pn", "ppos")).select(*_pair("sid", "psid"))
    heads = live.where("salt >= 0").groupBy("token", "salt").agg(F.min(F.struct("ppos", "pn", "psid")).alias("h"))
    first = heads.groupBy("token").agg(F.min("h").alias("f"))
    across = heads.join(first, "token").where("h.psid <> f.psid").select(*_pair("h.psid", "f.psid"))
    return star.union(across).distinct()


def cross_pairs(live: DataFrame, component: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs of a list that stand in different components, outside of the list's largest one, not yet compared.

    Linked sets pass the position test at the first shingle that their prefixes share, so a pair is wanted
    only there.  Each posting knows its set's EARLIER open shingles; if two postings have one of these in
    common, their pair was made in that list and is not made again.
    """
    d = live.select("token", "sid", "n", "pos").distinct().join(component, "sid", "left")
    d = d.select("token", "sid", "n", "pos", F.coalesce("root", "sid").alias("c"))
    sizes = d.groupBy("token", "c").agg(F.count("*").alias("m"))
    top = sizes.groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("k")).where("k > 1")
    d = d.join(top.select("token", "main"), "token")
    before = Window.partitionBy("sid").orderBy("pos").rowsBetween(-EARLIER, -1)
    d = stored(d.withColumn("earlier", F.collect_list("token").over(before)), "join-open")
    a, b = d.where("c <> main").alias("a"), d.alias("b")
    on = ((F.col("a.token") == F.col("b.token")) & (F.col("a.c") != F.col("b.c"))
          & ((F.col("b.c") == F.col("b.main")) | (F.col("a.c") < F.col("b.c"))) & _may_link("a.n", "a.pos", "b.n", "b.pos")
          & ~F.arrays_overlap("a.earlier", "b.earlier"))
    pairs = a.join(b, on).select(*_pair("a.sid", "b.sid")).distinct()
    return pairs.join(tested, ["u", "v"], "left_anti")


def bitmap_filter(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps do not rule the link out."""
    d = pairs.join(nodes.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("bitmap").alias("bu")), "u")
    d = d.join(nodes.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("bitmap").alias("bv")), "v")
    d = d.where("least(nu, nv) >= (4 * (nu + nv) + 8) div 9")

    def folded(b: str, other: str) -> str:  # sizes of linked sets differ by less than two, so one fold is enough
        half = f"size({other})"
        return (f"if(size({b}) > {half}, zip_with(slice({b}, 1, {half}), slice({b}, {half} + 1, {half}), (x, y) -> x ^ y), {b})")
    apart = F.expr(f"aggregate(zip_with({folded('bu', 'bv')}, {folded('bv', 'bu')}, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)")
    return d.where(apart * 9 <= F.col("nu") + F.col("nv")).select("u", "v")


def _texts_of(batches):
    """(sid, text) of every different set that a task meets."""
    seen: set[int] = set()
    for batch in batches:
        rows, sids = [], []
        for k, tokens in shingle_sets(batch.column(0)):
            sid = set_id(tokens)
            if sid not in seen:
                seen.add(sid)
                rows.append(k)
                sids.append(sid)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), batch.column(0).take(pa.array(rows))], names=["sid", "text"])


def _compare(batches):
    for batch in batches:
        good = []
        sets: dict = {}
        for side in (2, 3):
            firsts = {}
            for k, sid in enumerate(batch.column(side - 2).to_pylist()):
                if sid not in sets:
                    firsts.setdefault(sid, k)
            ids = list(firsts)
            for k, tokens in shingle_sets(batch.column(side).take(pa.array(list(firsts.values()), pa.int64()))):
                sets[ids[k]] = tokens
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            good.append(9 * both >= 4 * (len(sets[u]) + len(sets[v])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))


def linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets link, compared shingle by shingle."""
    ids = stored(pairs.select("u").union(pairs.select("v")).distinct().toDF("sid"), "join-wanted")
    # Texts that are not wanted are dropped where they are read, by a broadcast of checked size or a filter of fixed size.
    texts = filter_by_ids(docs.select("text").mapInArrow(_texts_of, "sid long, text string"), ids, "sid", max_ids=MAX_WANTED)
    texts = stored(texts.groupBy("sid").agg(F.min("text").alias("text")), "join-texts")
    d = pairs.join(texts.withColumnsRenamed({"sid": "u", "text": "tu"}), "u")
    d = d.join(texts.withColumnsRenamed({"sid": "v", "text": "tv"}), "v").select("u", "v", "tu", "tv")
    return d.mapInArrow(_compare, "u long, v long")


# ------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(sid, root) for every end of an edge but the roots, by alternating large-star and small-star steps."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "join-edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stored(small.select("x.u", "x.v").where("u <> v").distinct(), "join-edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("sid"), F.col("v").alias("root"))
        mark = now


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, names): rows has doc_id, h (hash of the text), n, sid per document; names has per sid the
    ``first`` (no_id, doc_id, h) of its component, documents without an id last."""
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("h"), F.col(text).cast("string").alias("text"))
    long = T.LongType()
    described = stored(d.mapInArrow(_describe, T.StructType([
        d.schema["doc_id"], T.StructField("h", long), T.StructField("n", long), T.StructField("sid", long),
        T.StructField("bitmap", _LONGS), T.StructField("small", _LONGS), T.StructField("chunk", T.IntegerType()),
        T.StructField("counts", T.BinaryType())])), "join-sets")
    rows = described.where("chunk is null")
    nodes = stored(rows.where("bitmap is not null").groupBy("sid").agg(
        F.min("n").alias("n"), F.min("bitmap").alias("bitmap"), F.min("small").alias("small")), "join-nodes")
    sizes = nodes.groupBy(F.when(F.col("n") <= SMALL, F.col("n")).alias("n")).agg(
        F.count("*").alias("c"), F.sum(F.expr("n div 5 + 1")).alias("postings")).collect()
    boundary = choose_boundary({r.n: r.c for r in sizes if r.n is not None}, sum(r.postings for r in sizes if r.n is None))
    edges = small_links(nodes, boundary)
    live = live_postings(d, shingle_levels(described), (4 * (boundary + 1) + 4) // 5)
    star = stored(pivot_pairs(live), "join-pivot-pairs")
    edges = edges.union(linked(d, stored(bitmap_filter(star, nodes), "join-candidates")))
    found = components(edges)
    more = linked(d, stored(bitmap_filter(cross_pairs(live, found, star), nodes), "join-candidates"))
    found = components(found.toDF("u", "v").union(more))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    least = rows.where("sid is not null").groupBy("sid").agg(F.min(key).alias("least")).join(found, "sid", "left")
    least = least.select("sid", F.coalesce("root", "sid").alias("root"), "least")
    first = least.groupBy("root").agg(F.min("least").alias("first"))
    return rows.select("doc_id", "h", "n", "sid"), least.join(first, "root").select("sid", "root", "first")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, names = classes(docs, doc_id, text)
    out = rows.join(names, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, one document of each component: the one with the smallest doc_id.

    Documents without an id come last in their component; of rows with equal id and text one stays.
    """
    rows, names = classes(docs, doc_id, text)
    lone = rows.where("sid is null").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    keep = names.select("root", "first").distinct().select("first.*").union(lone)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keep = keep.select("no_id", name("doc_id").alias("name"), "h").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).isNull().alias("no_id"),
                      name(doc_id).alias("name"), _text_hash(text).alias("h"))
    kept = row.join(keep, ["no_id", "name", "h"], "left_semi").dropDuplicates(["no_id", "name", "h"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


# The same rows for DuckDB: all pairs that share a shingle, then a walk over the links.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT rid, count(*) AS c FROM s GROUP BY rid
), p AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * k >= 80 * (nx.c + ny.c - k)
), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), walk(rid, root) AS (
  SELECT rid, rid FROM n UNION SELECT b.y, w.root FROM walk w JOIN both_ways b ON b.x = w.rid
), least_id AS (
  SELECT w.rid, min(r.doc_id) AS component_id FROM walk w JOIN d r ON r.rid = w.root GROUP BY w.rid
)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN least_id l USING (rid)
"""
