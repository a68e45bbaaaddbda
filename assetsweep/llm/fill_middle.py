"""Fill-in-middle transformation: texts cut at two unit ranks that an indexable skip list finds.

A unit is a word with the blanks before it, or the blanks at the end of a text.  The units of a text stand in
the lowest lane of a skip list.  A node rises to the next lane with a chance of one in ``FANOUT``, decided
by a hash of its place; the first node always rises.  Every node of every lane carries its widths: how many units
and how many code points lie between it and its successor in that lane.  A search for a rank starts in the top lane, goes
right while the accumulated unit width does not pass the rank, else down; the accumulated
code-point width is then the cut, after an expected ``FANOUT`` steps in each of log(n) lanes.

Which texts stay plain, the order of the parts and both ranks come from a hash of the seed and the row key, so
a row is cut alike in any partition.  ``restore`` rebuilds every text from output and form alone.

Plan: one scan, no shuffle.  Units are found over the UTF-8 bytes in steps of ``STEP`` bytes, so beside a text and
its output only the widths of its units are held; a batch of output holds ``BATCH_BYTES`` or one text.

Defined cases: a null text is empty; an empty text is plain with n = 0; a text that contains a sentinel is
plain, so that restoring is exact; a null key hashes as an empty string; rows with equal keys are cut at the
same ranks modulo their units; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.llm import textbytes as tb
from assetsweep.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
FANOUT = 8
STEP = 1 << 20
BATCH_BYTES = 1 << 24

_BLANK = ~tb.byte_class((0x20, 0x20), (0x09, 0x0D))


def unit_points(raw: np.ndarray, step: int = STEP) -> np.ndarray:
    """Code points of each unit of a text, given as its UTF-8 bytes."""
    ends, points = [np.zeros(1, np.int64)], 0
    for a in range(0, len(raw), step):
        part = raw[a:a + step + 1]  # one byte more, to see whether a word goes on
        size = min(step, len(raw) - a)
        blank = _BLANK[part]
        stop = ~blank[:size]
        stop[:len(part) - 1] &= blank[1:]
        passed = np.cumsum((part[:size] & 0xC0) != 0x80)
        ends.append(points + passed[stop])
        points += int(passed[-1])
    if len(raw) and _BLANK[raw[-1]]:
        ends.append(np.array([points]))
    return np.diff(np.concatenate(ends))


class SkipList:
    """Units with express lanes; lane k holds (node in the lane below, unit widths, code-point widths)."""

    def __init__(self, points: np.ndarray, fanout: int = FANOUT):
        self.n, self.points = len(points), int(points.sum())
        node = np.arange(self.n)
        units = np.ones(self.n, np.int64)
        self.lanes = [(node, units, points)]
        while len(node) > fanout:
            # Lane k looks at other bits of the hash than lane k - 1: the chances are independent.
            draw = tb.mix(node.astype(np.uint64) + np.uint64(len(self.lanes) * 0x9E3779B97F4A7C15 % (1 << 64)))
            rises = draw % np.uint64(fanout) == 0
            rises[0] = True
            down = np.flatnonzero(rises)
            if len(down) == len(node):
                break
            units, points = np.add.reduceat(units, down), np.add.reduceat(points, down)
            node = node[down]
            self.lanes.append((down, units, points))

    def reach(self, rank: int) -> int:
        """Code points before the unit of that rank; ``rank`` from 0 to the number of units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        at, done, passed = 0, 0, 0
        for down, units, points in reversed(self.lanes):
            while done < rank and done + units[at] <= rank:
                done += int(units[at])
                passed += int(points[at])
                at += 1
            if done == rank:
                break
            at = int(down[at])
        return passed


def plan(key: str, n: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """(first rank, second rank, fill-in-middle draw, order draw) of a row with ``n`` units."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100, h4 % 100


def cut(text: str, key: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """(n, form, output, prefix_chars, middle_chars) of one text."""
    widths = unit_points(np.frombuffer(text.encode(), np.uint8))
    first, second, fim, order = plan(key, len(widths), seed)
    if not text or fim >= fim_percent or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return len(widths), "plain", text, None, None
    lanes = SkipList(widths)
    a, b = lanes.reach(first), lanes.reach(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order < spm_percent:
        return lanes.n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return lanes.n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


_NAMES = ["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _transformer(seed: int, fim_percent: int, spm_percent: int):
    def transform(batches):
        for batch in batches:
            ids, texts, keys = (batch.column(k) for k in range(3))
            first, held, rows = 0, 0, []

            def made(stop):
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
                return pa.RecordBatch.from_arrays([ids.slice(first, stop - first), *cols], names=_NAMES)

            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                rows.append(cut(text, keys[k].as_py(), seed, fim_percent, spm_percent))
                held += 4 * len(text)
                if held >= BATCH_BYTES:
                    yield made(k + 1)
                    first, held, rows = k + 1, 0, []
            if rows:
                yield made(batch.num_rows)
    return transform


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), output, prefix_chars and middle_chars of every row."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                    F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"))
    long = T.LongType()
    schema = T.StructType([
        d.schema["doc_id"], T.StructField("n", long), T.StructField("form", T.StringType()), T.StructField("output", T.StringType()),
        T.StructField("prefix_chars", long), T.StructField("middle_chars", long)])
    return d.mapInArrow(_transformer(seed, fim_percent, spm_percent), schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """``rows`` with the text rebuilt from output and form; sentinels stand once each, as texts with one stay plain."""
    x = F.col(output)
    middle_at = F.locate(MIDDLE, x)

    def parts(second: str):
        at = F.locate(second, x)
        return (F.substr(x, F.lit(4), at - 4), F.substr(x, at + 3, middle_at - at - 3))

    middle = F.substr(x, middle_at + 3)
    prefix, suffix = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = parts(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return rows.withColumn(to, F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(x))


def report(rows: DataFrame) -> DataFrame:
    """The columns of ``transform`` with digests of output and restored text in place of the texts."""
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
c AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b,
             array_to_string(w[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b
                   ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
