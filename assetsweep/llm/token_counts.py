"""Token counts with overlap resynchronisation for huge documents.

Texts up to ``HUGE`` characters are encoded whole.  A longer one is encoded in chunks of ``CHUNK``
characters that overlap by ``OVERLAP``, with offsets.  In each overlap both encodings are compared: a
position where both have a token boundary, and where the boundary is *proven* not to depend on what
stands around the chunk, is where they are spliced.  If an overlap has none, it is widened to twice its
size, and at last the next chunk is merged into it, so the result never depends on the chunk size.

The proof for byte-level BPE with the usual split pattern: no alternative of the pattern has white space
after something else, so a space after a non-space always starts a new piece; the pattern looks ahead
only, so pieces on the left end there in any context and pieces on the right start there in any context;
merges never cross pieces; the special string has no space.

Plan: one scan, no shuffle; the tokenizer is loaded once per Python worker from ``path`` (a parameter; a
file that every executor has).  A batch is encoded in runs of at most ``RUN_CHARS`` characters.

Defined cases: a null text is empty and has 0 tokens; equal rows get equal counts; an empty table gives
an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.session import ship_package

HUGE = 60_000
CHUNK = 30_000
OVERLAP = 1_000
RUN_CHARS = 400_000
LIMIT = 1024

_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def space_after_text(text: str, at: int) -> bool:
    """Whether a piece boundary at ``at`` is proven: a space that follows something else."""
    return 0 < at < len(text) and text[at] == " " and not text[at - 1].isspace()


def encode_whole(tok, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    e = tok.encode(text, add_special_tokens=False)
    return e.ids, e.offsets


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP,
                proven: Callable[[str, int], bool] = space_after_text) -> list[int]:
    """Token ids of ``text``, equal to those of one call over the whole text."""
    n = len(text)

    def encoded(a: int, b: int):
        ids, offsets = encode_whole(tok, text[a:b])
        return ids, [(x + a, y + a) for x, y in offsets]

    out: list[int] = []
    # left holds the encoding of text[a:min(b + wide, n)]; tokens before `done` are already in out.
    a, b, wide, done = 0, chunk, overlap, 0
    left = encoded(a, min(b + wide, n))
    while b < n:
        c = min(b + chunk, n)
        right = encoded(b, min(c + overlap, n))
        while True:
            ends = {y for x, y in left[1] if b < y < b + wide}
            common = (x for x, _ in right[1] if b < x < b + wide and x in ends and proven(text, x))
            at = next(common, None)
            if at is not None or b + wide >= n or wide >= chunk:
                break
            wide *= 2
            left = encoded(a, min(b + wide, n))
        if at is None:  # no boundary is proven: take the next chunk into this one
            b, wide = c, overlap
            left = encoded(a, min(b + wide, n))
            continue
        out += [i for i, (x, y) in zip(*left) if x >= done and y <= at]
        done, a, b, wide, left = at, b, c, overlap, right
    out += [i for i, (x, _) in zip(*left) if x >= done]
    return out


def count_tokens(tok, texts: list[str], huge: int = HUGE) -> list[int]:
    """Counts of many texts; runs of short texts are encoded together."""
    counts = [0] * len(texts)
    run: list[int] = []
    held = 0

    def flush():
        for k, e in zip(run, tok.encode_batch_fast([texts[k] for k in run], add_special_tokens=False)):
            counts[k] = len(e.ids)
        run.clear()

    for k, text in enumerate(texts):
        if len(text) > huge:
            counts[k] = len(encode_long(tok, text))
        elif text:
            run.append(k)
            held += len(text)
            if held >= RUN_CHARS:
                flush()
                held = 0
    flush()
    return counts


def _counter(path: str):
    def count(batches):
        tok = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = count_tokens(tok, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return count


def token_report(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return d.mapInArrow(_counter(path), schema).withColumn("over_limit", F.col("n_tokens") > limit)
