"""Token ids in binary files of patched frame-of-reference blocks, in ascending key order.

A file holds the ids of consecutive documents, each closed by ``END``.  Ids are cut into blocks of ``BLOCK_IDS``,
across document borders.  A block stores its minimum and, for each id, the low bits of its distance to it.
The width is the one that ``PERCENTILE`` of the block's distances fit; the others are outliers, whose
places and high bits stand in an exception list behind the packed bits.  Tables at the end of the file
give the start of every block and the keys and starts of the documents; the footer says where they are:

    magic | block ... | keys | key is null (bits) | document starts | block starts | footer

So a range of ids is read by fetching the blocks that hold it and patching their outliers.

Encoding: texts are cut into segments where the tokenizer surely begins a piece, if it is byte-level BPE with the usual
split pattern (``splits_at_spaces`` looks; any other tokenizer gets whole texts).  That pattern has no alternative with
white space after something else, ends a run of letters at punctuation and looks ahead only, so a piece always starts there and
merges never cross it: the ids are those of the whole text.  Equal segments are encoded once per worker and kept (about
``KNOWN`` of them, then it starts anew).

Plan: one range exchange by (key, row number), sorted inside each partition; a key that repeats is dealt to
several partitions by the row number.  Tasks encode and write files under names of their own and return
a row per file; that table is stored, so only files of tasks that ended well are ever read.
The running sum over files (not documents) gives each file's first id.  Reading goes file by file, ``GROUP``
blocks at a time.  A task holds one run of texts, the tables of one file (at most ``FILE_DOCS`` documents) and one
group of blocks, or the longest document.

Defined cases: a null text is empty and has the end id alone; null keys come last; equal keys stand in the order of the
stored rows; an empty table makes no file; keys are integers; only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetsweep.llm import textbytes as tb
from assetsweep.llm.common import filesystem, shared_path, stored
from assetsweep.session import ship_package

END = 0
BLOCK_IDS = 1024
PERCENTILE = 90
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
GROUP = 256
RUN_BYTES = 1 << 21
KNOWN = 1 << 20
JOINED = 1000
TAIL = "!#$%&()*+,-./:;<=>?@[]^_{|}~"

MAGIC = b"PFORIDS1"
_BLOCK = struct.Struct("<IBHH")  # minimum, width, ids, exceptions
_FOOTER = struct.Struct("<QQQQI8s")  # ids, documents, blocks, offset of the tables, ids in a block, magic

FILES = "part int, seq int, path string, n_docs long, n_ids long"


# ---------------------------------------------------------------- blocks

def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row of 32-bit numbers, as bytes per row."""
    bits = np.unpackbits(rows.astype("<u4").view(np.uint8).reshape(*rows.shape, 4), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), n), np.uint32)
    bits = np.zeros((len(packed), n, 32), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(len(packed), n, width)
    return np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(packed), n)


def encode_blocks(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of ``block_ids`` ids, the last of the rest."""
    full = len(ids) // block_ids * block_ids
    out: list[bytes] = []
    for rows in (ids[:full].reshape(-1, block_ids), ids[full:].reshape(1, -1) if full < len(ids) else ids[:0].reshape(0, 1)):
        for at in range(0, len(rows), GROUP):
            out += _encode_rows(rows[at:at + GROUP].astype(np.uint32), percentile)
    return out


def _encode_rows(rows: np.ndarray, percentile: int) -> list[bytes]:
    if not len(rows):
        return []
    n = rows.shape[1]
    low = rows.min(axis=1)
    apart = rows - low[:, None]
    bits = np.frexp(apart.astype(np.float64))[1].astype(np.int8)  # bit lengths
    fits = max(0, -(-percentile * n // 100) - 1)
    width = np.partition(bits, fits, axis=1)[:, fits]
    outlier = bits > width[:, None]
    packed: list = [None] * len(rows)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        for k, row in zip(which.tolist(), _pack(apart[which], w)):
            packed[k] = row.tobytes()
    out = []
    for k in range(len(rows)):
        places = np.flatnonzero(outlier[k])
        high = apart[k, places] >> np.uint32(width[k])
        out.append(_BLOCK.pack(int(low[k]), int(width[k]), n, len(places)) + packed[k]
                   + places.astype("<u2").tobytes() + high.astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``data``."""
    heads = [_BLOCK.unpack_from(data, at) for at in starts]
    out: list = [None] * len(starts)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, n, _) in enumerate(heads):
        alike.setdefault((width, n), []).append(k)
    for (width, n), which in alike.items():
        size = -(-width * n // 8)
        packed = np.stack([np.frombuffer(data, np.uint8, size, starts[k] + _BLOCK.size) for k in which])
        for k, row in zip(which, _unpack(packed, width, n)):
            low, _, _, exceptions = heads[k]
            row = row.astype(np.uint32)
            if exceptions:
                at = starts[k] + _BLOCK.size + size
                places = np.frombuffer(data, "<u2", exceptions, at)
                row[places] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
            out[k] = row + np.uint32(low)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


# ---------------------------------------------------------------- files

class TokenFileWriter:
    """Appends documents; whole blocks leave memory as soon as they are full."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, percentile: int = PERCENTILE):
        self.out, self.block_ids, self.percentile = out, block_ids, percentile
        self.out.write(MAGIC)
        self.at, self.n_ids, self.n_docs = len(MAGIC), 0, 0
        self.blocks: list[int] = []
        self.rest: list[np.ndarray] = []
        self.held = 0
        self.keys: list = []
        self.starts: list = []

    def add(self, keys: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents by key and number of ids, and the ids of all of them."""
        self.keys.append(keys)
        self.starts.append(self.n_ids + np.cumsum(sizes) - sizes)
        self.n_docs += len(keys)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids * GROUP:
            self._flush(self.held // self.block_ids * self.block_ids)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for block in encode_blocks(ids[:n], self.block_ids, self.percentile):
            self.blocks.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.rest, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.held)
        keys = [k for part in self.keys for k in part]
        self.out.write(np.array([0 if k is None else k for k in keys], "<i8").tobytes())
        self.out.write(np.packbits(np.array([k is None for k in keys], bool), bitorder="little").tobytes())
        self.out.write(np.concatenate([*self.starts, [self.n_ids]]).astype("<u8").tobytes())
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(_FOOTER.pack(self.n_ids, self.n_docs, len(self.blocks), self.at, self.block_ids, MAGIC))
        self.out.close()


class TokenFile:
    """A token file by its tables.  ``read_at(n, offset)`` reads ``n`` bytes."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail = read_at(_FOOTER.size, size - _FOOTER.size) if size >= _FOOTER.size else b""
        if len(tail) != _FOOTER.size or tail[-8:] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, self.n_docs, self.n_blocks, self.end, self.block_ids, _ = _FOOTER.unpack(tail)
        nulls = -(-self.n_docs // 8)
        tables = read_at(size - _FOOTER.size - self.end, self.end)
        at = 8 * self.n_docs
        self.keys = np.frombuffer(tables, "<i8", self.n_docs)
        self.null = np.unpackbits(np.frombuffer(tables, np.uint8, nulls, at), count=self.n_docs, bitorder="little").astype(bool)
        self.starts = np.frombuffer(tables, "<u8", self.n_docs + 1, at + nulls).astype(np.int64)
        self.blocks = np.frombuffer(tables, "<u8", self.n_blocks, at + nulls + 8 * (self.n_docs + 1)).astype(np.int64)

    def _blocks(self, first: int, last: int) -> np.ndarray:
        if first >= last:
            return np.zeros(0, np.uint32)
        begin = int(self.blocks[first])
        stop = int(self.blocks[last]) if last < self.n_blocks else self.end
        return decode_blocks(self.read_at(stop - begin, begin), (self.blocks[first:last] - begin).tolist())

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b``, from the blocks that hold them alone."""
        first = a // self.block_ids
        got = self._blocks(first, min(-(-b // self.block_ids), self.n_blocks))
        return got[a - first * self.block_ids:b - first * self.block_ids]

    def documents(self, group: int = GROUP):
        """(first document, [ids, ...]) of consecutive documents; reads ``group`` blocks at a time."""
        doc, held, at = 0, np.zeros(0, np.uint32), 0  # ids from place ``at`` on
        for first in range(0, self.n_blocks, group):
            held = np.concatenate([held, self._blocks(first, min(first + group, self.n_blocks))])
            last = int(np.searchsorted(self.starts, at + len(held), "right")) - 1
            if last > doc:
                cuts = self.starts[doc:last + 1] - at
                yield doc, [held[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                held, at, doc = held[cuts[-1]:], at + int(cuts[-1]), last


# ---------------------------------------------------------------- encoding

_loaded: dict = {}

_LETTER = ~tb.byte_class((0x41, 0x5A), (0x61, 0x7A))
# White space of Unicode in one byte, and the separators that some libraries count as such.
_BLANK = ~tb.byte_class((0x09, 0x0D), (0x1C, 0x20))


def splits_at_spaces(tok) -> bool:
    """Whether a space after something else always starts a new piece with this tokenizer."""
    t = json.loads(tok.to_str())
    before = t.get("pre_tokenizer") or {}
    added = [x for x in t.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])]
    return (t.get("normalizer") is None and t["model"]["type"] == "BPE" and not t["model"].get("dropout") and not added
            and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False)


def _solid(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character which is surely no white space.

    Characters from a two- or three-byte range that holds white space count as unsure, all of them.
    """
    solid = ~_BLANK[data]
    for lead, size in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data == lead) + size - 1
        solid[at[at < len(data)]] = False
    return solid


class Encoder:
    """Ids of many texts, equal segments encoded once.

    Segments begin where the pattern surely begins a piece: at a space or line break after something else, behind a single line
    break, and at ASCII punctuation after an ASCII letter.  They are compared by 64-bit hashes.
    """

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.split = splits_at_spaces(self.tok)
        # No part of a special string counts as punctuation behind a word.
        special = {c for x in json.loads(self.tok.to_str()).get("added_tokens", []) for c in x["content"]}
        self.tail = np.zeros(256, bool)
        self.tail[[ord(c) for c in TAIL if c not in special]] = True
        self.known = known
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, np.uint64)  # hashes of segments in order
        # Ids of the segment with key[k]: flat[first[k]:first[k] + size[k]].
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of the segments of texts, and the byte behind each."""
        cut = np.zeros(len(data) + 1, bool)
        if self.split and len(data):
            solid = _solid(data)
            gap = (data == 0x20) | (data == 0x0A)
            cut[1:-1] = gap[1:] & solid[:-1]
            # A line break between two solid characters; the next one must be solid from its first byte.
            alone = np.flatnonzero(cut[:-2] & (data[:-1] == 0x0A))
            after = data[alone + 1]
            cut[alone[~_BLANK[after] & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3))] + 1] = True
            cut[1:-1] |= self.tail[data[1:]] & _LETTER[data[:-1]]
        cut[offsets[:-1]] = True
        cut[len(data)] = False
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data))

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, every: int):
        """(sizes, ids) of words that are one piece each, encoded in one call; None if some word is not.

        Words with a space in front follow each other; others (``every`` = 2) have line breaks between them.  Each word
        starts a piece, so if there are as many pieces as that makes, every word is one.
        """
        size = ends - starts
        room = size + (every - 1)
        first = np.cumsum(room) - room
        raw = np.full(int(room.sum()), 0x0A, np.uint8)
        inner = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        raw[inner] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        e = self.tok.encode(raw[:len(raw) - (every - 1)].tobytes().decode(), add_special_tokens=False)
        piece = np.array(e.word_ids, np.int64)
        if piece[-1] != every * (len(starts) - 1):
            return None
        return np.bincount(piece, minlength=every * len(starts))[::every][:len(starts)], np.array(e.ids, np.uint32)[piece % every == 0]

    def _learn(self, key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new segments, given with their hashes, and keeps their ids."""
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        high = np.concatenate([[0], np.cumsum(data >= 0x80)])
        front = (data[starts] == 0x20).astype(np.int64)
        word = ends - starts - front
        ascii_ = letters[ends] - letters[starts]
        other = high[ends] - high[starts]
        whole = (ascii_ + other == word) & (word > 0)
        for k in np.flatnonzero(whole & (other > 0)).tolist():
            whole[k] = data[starts[k] + front[k]:ends[k]].tobytes().decode().isalpha()
        sizes, order, ids = np.zeros(len(key), np.int64), [], []
        single = np.flatnonzero(~whole).tolist() if self.split else list(range(len(key)))
        for which, every in ((np.flatnonzero(whole & (front > 0)), 1), (np.flatnonzero(whole & (front == 0)), 2)) if self.split else ():
            for at in range(0, len(which), JOINED):
                part = which[at:at + JOINED]
                made = self._together(data, starts[part], ends[part], every)
                if made is None:
                    single += part.tolist()
                else:
                    sizes[part] = made[0]
                    order.append(part)
                    ids.append(made[1])
        texts = [data[starts[k]:ends[k]].tobytes().decode() for k in single]
        made = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes[single] = np.fromiter(map(len, made), np.int64, len(made))
        ids.append(np.fromiter(chain.from_iterable(made), np.uint32, int(sizes[single].sum())))
        order = np.concatenate([*order, np.array(single, np.int64)])
        first = np.zeros(len(key), np.int64)
        first[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
        self.flat = np.concatenate([self.flat, *ids])
        place = np.searchsorted(self.key, key)  # both in order
        self.key, self.first, self.size = (np.insert(x, place, y) for x, y in ((self.key, key), (self.first, first), (self.size, sizes)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids of all) of UTF-8 texts; callers bound their bytes."""
        if len(self.key) > self.known or len(self.flat) > 8 * self.known:
            self._clear()
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint32)
        starts, ends = self.segments(data, offsets)
        key, example, same = np.unique(tb.hash_words(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        new = np.flatnonzero(self.key[at] != key) if len(self.key) else np.arange(len(key))
        if len(new):
            self._learn(key[new], data, starts[example[new]], ends[example[new]])
            at = np.searchsorted(self.key, key)
        sizes, first = self.size[at][same], self.first[at][same]
        total = np.cumsum(sizes)
        ids = self.flat[np.repeat(first - (total - sizes), sizes) + np.arange(int(total[-1]))]
        passed = np.concatenate([[0], total])
        return np.diff(passed[np.searchsorted(starts, offsets)]), ids


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def parts(data: np.ndarray, split: bool, limit: int = RUN_BYTES):
    """Ranges of about ``limit`` bytes of one text that end at proven boundaries, if the tokenizer has them."""
    at = 0
    while split and len(data) - at > limit:
        look = at + limit
        stop = -1
        while stop < 0 and look < len(data):  # an ASCII character that is no white space, then a space
            window = data[look - 1:look + limit]
            hit = np.flatnonzero((window[1:] == 0x20) & ~_BLANK[window[:-1]] & (window[:-1] < 0x80))
            stop = look + int(hit[0]) if len(hit) else -1
            look += limit
        if stop < 0:
            break
        yield at, stop
        at = stop
    yield at, len(data)


def encode_documents(enc: Encoder, texts: pa.Array, end: int = END, limit: int = RUN_BYTES):
    """(first text, sizes, ids) of consecutive texts, each with its end id; a long text is encoded in parts."""
    data, offsets = tb.utf8(texts)
    for a, b in tb.blocks(offsets, limit):
        own = data[offsets[a]:offsets[b]]
        if b - a == 1 and len(own) > limit:
            ids = [enc.encode(own[x:y], np.array([0, y - x]))[1] for x, y in parts(own, enc.split, limit)]
            ids = np.concatenate([*ids, np.array([end], np.uint32)])
            yield a, np.array([len(ids)]), ids
        else:
            sizes, ids = enc.encode(own, offsets[a:b + 1] - offsets[a])
            yield a, sizes + 1, np.insert(ids, np.cumsum(sizes), end)


# ---------------------------------------------------------------- jobs

def _writer(folder: str, path: str, end: int, percentile: int, file_ids: int, file_docs: int):
    def write(batches):
        from pyspark import TaskContext
        fs, root = filesystem(folder)
        part, seq, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def closed():
            writer.close()
            row = (part, seq, f"{folder}/{name}", writer.n_docs, writer.n_ids)
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in FILES.split(", ")])

        enc = encoder(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, sizes, ids in encode_documents(enc, batch.column(1), end):
                total, at = np.cumsum(sizes), 0
                while at < len(sizes):
                    if writer is None:
                        name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.pfor"
                        writer = TokenFileWriter(fs.open_output_stream(f"{root}/{name}", compression=None), percentile=percentile)
                    # As many documents as the file has room for, one at least.
                    room = int(np.searchsorted(total, total[at] - sizes[at] + file_ids - writer.n_ids, "right"))
                    stop = min(max(at + 1, room), at + file_docs - writer.n_docs, len(sizes))
                    writer.add(keys[first + at:first + stop], sizes[at:stop], ids[total[at] - sizes[at]:total[stop - 1]])
                    at = stop
                    if writer.n_ids >= file_ids or writer.n_docs >= file_docs or at < len(sizes):
                        yield closed()
                        writer, seq = None, seq + 1
        if writer is not None:
            yield closed()
    return write


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text",
                      end: int = END, percentile: int = PERCENTILE, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the files to ``folder`` (shared by all executors); returns the stored table of files with ``first_id``.

    ``path`` is the tokenizer's file, which every executor has.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or shared_path(spark, "token-files")
    fs, root = filesystem(folder)
    fs.create_dir(root)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                    F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = stored(d.mapInArrow(_writer(folder, path, end, percentile, file_ids, file_docs), FILES), "token-file-table")
    # One row per file: the running sum is over files, not documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(group: int):
    def read(batches):
        for batch in batches:
            for name, first_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = filesystem(name)
                with fs.open_input_file(at) as f:
                    t = TokenFile(f.read_at, f.size())
                    for doc, ids in t.documents(group):
                        stop = doc + len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t.keys[doc:stop], pa.int64(), mask=t.null[doc:stop]), pa.array(t.starts[doc:stop] + first_id, pa.int64()),
                             pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])
    return read


def read_token_files(files: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    spark = files.sparkSession
    ship_package(spark)
    n = files.count()
    # Files are of like size: dealt out one by one, few to a task.
    spread = files.select("path", "first_id").repartition(max(1, min(n, 8 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(_reader(group), "doc_id long, start long, ids binary")


def read_range(files: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole sequence; only the files and blocks that hold them are fetched."""
    hit = files.where((F.col("first_id") < stop) & (F.col("first_id") + F.col("n_ids") > start)).orderBy("first_id")
    out = [np.zeros(0, np.uint32)]
    for r in hit.select("path", "first_id", "n_ids").collect():
        fs, at = filesystem(r.path)
        with fs.open_input_file(at) as f:
            out.append(TokenFile(f.read_at, f.size()).ids(max(0, start - r.first_id), min(r.n_ids, stop - r.first_id)))
    return np.concatenate(out)


def report(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents that were read back."""
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
