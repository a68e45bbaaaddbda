"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

All segmentations of a text into pieces form a lattice.  Forward filtering sums the weights of the paths to
each position; backward sampling walks from the end and draws the last piece in proportion to the weight
of the paths through it, so whole segmentations are drawn with their exact probability.  The draws come
from a counter-based generator keyed by (seed, row key, unit, step): a row gives the same pieces in any
partition and batch.

Weights: the model is a merge list, whose scores are merge ranks, not log-probabilities.  A piece weighs
``1 / (rank + 2)`` (Zipf), to the power ``1 / temperature``.  A character that is no piece falls back to its
UTF-8 bytes, as the model does.

The lattice falls apart wherever no piece spans two neighbouring characters.  These units repeat a lot, so
each different one is filtered once and kept for later blocks of the task (``STATES`` positions at most, then it starts
anew), and no longer: idle workers hold no memory that other stages need.  All units of a block are sampled together, step by
step, in numpy.  Probabilities are compared as
whole multiples of 2^-32, so what is kept from earlier blocks changes no draw.

Lossless: a space is the mark U+2581, a text gets one space in front, as the model does; a mark that stands
in the text itself is written in bytes, so decoding gives back every text.

Plan: one scan, no shuffle; the model file is loaded once per worker from ``path`` (a parameter).  Texts are
sampled in blocks of ``BLOCK_CHARS`` characters.  A longer text is sampled in parts that end where a unit ends, so beside
the text and its pieces only one part is held, or the longest unit.

Defined cases: a null text has null pieces, an empty text none; equal rows get equal pieces; a null key
is a key of its own; an empty table gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetsweep.llm.textbytes import mix
from assetsweep.session import ship_package

MARK = "▁"
SEED = 17
BLOCK_CHARS = 1 << 20
STATES = 1 << 22
FALLBACK = -30.0

_loaded: dict = {}


class Grown:
    """An array that grows in place, with room for twice as much when it is full."""

    def __init__(self, kind):
        self.n, self.room = 0, np.zeros(1024, kind)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            room = np.zeros(2 * (self.n + len(x)), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(x)] = x
        self.n += len(x)

    def all(self) -> np.ndarray:
        return self.room[:self.n]


class Model:
    """Pieces of a model file, their weights, and which neighbours a piece can span."""

    def __init__(self, path: str, temperature: float = 1.0):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        self.byte = {int(names[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        if len(self.byte) != 256:
            raise ValueError(f"{path} has no byte fallback, so decoding would lose characters")
        normal = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.piece = {names[k]: k for k in normal}
        rank = sorted(normal, key=lambda k: (-sp.get_score(k), k))
        self.weight = np.full(n, -np.inf)
        self.weight[rank] = -np.log(np.arange(len(rank)) + 2) / temperature
        # Characters by class (0: no piece has it) and the pairs that stand inside some piece.
        chars = sorted({c for p in self.piece for c in p})
        index = {c: k + 1 for k, c in enumerate(chars)}
        self.chars = np.zeros(0x110000, np.int16 if len(chars) < 32_000 else np.int32)
        for k, c in enumerate(chars):
            self.chars[ord(c)] = k + 1
        self.span = np.zeros((len(chars) + 1) ** 2, bool)
        self.side = len(chars) + 1
        for p in self.piece:
            c = self.chars[[ord(x) for x in p]].astype(np.int64)
            self.span[c[:-1] * self.side + c[1:]] = True
        self.chars[0x20] = self.chars[ord(MARK)]  # a space is the mark,
        self.chars[ord(MARK)] = 0  # the mark itself goes by bytes
        # Trie of the pieces: transitions (node, class) -> node as sorted keys, and the piece that ends at a node.
        child: dict[tuple[int, int], int] = {}
        ends = [-1]
        for p, k in self.piece.items():
            node = 0
            for c in p:
                c = index[c]
                if (node, c) not in child:
                    child[node, c] = len(ends)
                    ends.append(-1)
                node = child[node, c]
            ends[node] = k
        moves = sorted((a * self.side + c, b) for (a, c), b in child.items())
        self.move_key, self.move_to = (np.array(x, np.int64) for x in zip(*moves))
        self.piece_at = np.array(ends, np.int64)
        raw = [bytes([int(names[k][3:5], 16)]) if sp.is_byte(k) else names[k].replace(MARK, " ").encode()
               if np.isfinite(self.weight[k]) else b"" for k in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.byte_piece = np.array([self.byte[k] for k in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        """Empties the table of filtered units."""
        self.unit_key = np.zeros(0, np.uint64)  # sorted, with the last state of each unit
        self.unit_end = np.zeros(0, np.int64)
        self.head = Grown(np.int32)  # first edge into each state
        self.is_start = Grown(bool)
        self.reached = Grown(np.uint32)  # edges: cumulative probability, state they come from, piece
        self.previous = Grown(np.int32)
        self.piece_of = Grown(np.int32)

    # -- lattices of units -------------------------------------------------------------------------

    def _edges(self, kind: np.ndarray, points: np.ndarray, stop: np.ndarray):
        """(first character, length, piece) of all pieces inside units; ``stop`` is the end of each character's unit.

        A character that is no piece gets the piece ``-1 - code point``, which stands for its bytes.
        """
        at, node = np.arange(len(kind)), np.zeros(len(kind), np.int64)
        out, length = [], 0
        while len(at):
            key = node * self.side + kind[at + length]
            j = np.minimum(np.searchsorted(self.move_key, key), len(self.move_key) - 1)
            known = self.move_key[j] == key
            node = self.move_to[j]
            piece = np.where(known, self.piece_at[node], -1)
            length += 1
            if length == 1:
                lone = np.flatnonzero(piece < 0)
                out.append((lone, np.ones(len(lone), np.int64), -points[lone].astype(np.int64) - 1))
            hit = piece >= 0
            out.append((at[hit], np.full(hit.sum(), length), piece[hit]))
            on = known & (at + length < stop[at])
            at, node = at[on], node[on]
        return [np.concatenate(x) for x in zip(*out)]

    def _filtered(self, kind: np.ndarray, points: np.ndarray, first: np.ndarray, size: np.ndarray):
        """Forward filtering of many units at once.

        States are positions in units (a unit of n characters has n + 1).  Returns the first edge into each
        state, which states are starts, and, sorted by state and length of the piece: the cumulative
        probability of the edges as multiples of 2^-32, the states they come from and the pieces.
        """
        unit = np.repeat(np.arange(len(first)), size)
        start, length, piece = self._edges(kind, points, np.repeat(first + size, size))
        depth = start - first[unit[start]] + length
        source = start + unit[start]
        target = source + length
        weight = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], FALLBACK)
        n_states, longest = len(kind) + len(first), int(length.max()) + 1
        total = np.full(n_states, -np.inf)
        is_start = np.zeros(n_states, bool)
        is_start[first + np.arange(len(first))] = True
        total[is_start] = 0
        by = np.argsort((depth * n_states + target) * longest + length)
        source, target, weight, piece, length, depth = (x[by] for x in (source, target, weight, piece, length, depth))
        steps = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(steps, np.append(steps[1:], len(depth))):
            x = total[source[a:b]] + weight[a:b]
            head = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            top = np.maximum.reduceat(x, head)
            runs = np.diff(np.append(head, b - a))
            total[target[a:b][head]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, runs)), head))
        # Whole multiples of 2^-32 from here on: sums are exact, whatever else stands in the block.
        share = np.floor(np.exp(total[source] + weight - total[target]) * 2.0 ** 32).astype(np.int64)
        by = np.argsort(target * longest + length)
        source, target, piece, share = source[by], target[by], piece[by], share[by]
        head = np.flatnonzero(np.diff(target, prepend=-1))
        reached = np.cumsum(share)
        reached -= np.repeat(reached[head] - share[head], np.diff(np.append(head, len(target))))
        reached = np.minimum(reached, 0xFFFFFFFF).astype(np.uint32)
        reached[np.append(head[1:], len(target)) - 1] = 0xFFFFFFFF
        first_edge = np.zeros(n_states, np.int64)
        first_edge[target[head]] = head
        return first_edge, is_start, reached, source, piece

    def _learn(self, key: np.ndarray, kind: np.ndarray, points: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Filters new units, given with their keys, and keeps them."""
        head, is_start, reached, previous, piece = self._filtered(kind, points, first, size)
        states, edges = self.head.n, self.reached.n
        self.head.add(head + edges)
        self.is_start.add(is_start)
        self.reached.add(reached)
        self.previous.add(previous + states)
        self.piece_of.add(piece)
        ends = states + first + size + np.arange(len(first))
        both = np.concatenate([self.unit_key, key])
        order = np.argsort(both, kind="stable")
        self.unit_key, self.unit_end = both[order], np.concatenate([self.unit_end, ends])[order]

    # -- blocks of texts ---------------------------------------------------------------------------

    def _units(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """First characters of the units; a part always begins one."""
        kind = self.chars[points].astype(np.int64)
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.span[kind[:-1] * self.side + kind[1:]]
        cut[begins] = True
        return np.flatnonzero(cut)

    def _ends(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last state of each unit; units not met before are filtered."""
        stop = np.append(at[1:], len(points))
        h = mix(points.astype(np.uint64) + np.uint64(0x51ED270B))
        place = np.arange(len(points)) - np.repeat(at, stop - at)
        h = mix(h ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        key = np.add.reduceat(h, at)
        if self.head.n > STATES:
            self._forget()
        where = np.minimum(np.searchsorted(self.unit_key, key), max(0, len(self.unit_key) - 1))
        new = np.flatnonzero(self.unit_key[where] != key) if len(self.unit_key) else np.arange(len(at))
        if len(new):
            fresh, example = np.unique(key[new], return_index=True)
            example = new[example]
            size = (stop - at)[example]
            first = np.cumsum(size) - size
            chars = np.repeat(at[example] - first, size) + np.arange(size.sum())
            self._learn(fresh, self.chars[points[chars]].astype(np.int64), points[chars], first, size)
            where = np.searchsorted(self.unit_key, key)
        return self.unit_end[where]

    def draw(self, points: np.ndarray, begins: np.ndarray, keys: np.ndarray, before: np.ndarray, seed: int = SEED):
        """(pieces, bounds of each part, units of each part) of parts of rows.

        ``begins`` are the first characters of the parts, which are not empty, ``before`` the units of the row before its part.
        """
        at = self._units(points, begins)
        state = self._ends(points, at)
        first_unit = np.searchsorted(at, begins)
        units = np.diff(np.append(first_unit, len(at)))
        # Draws are keyed by row, unit within the row, and step.
        own = (np.arange(len(at)) - np.repeat(first_unit - before, units)).astype(np.uint64)
        base = mix(np.repeat(mix(keys.astype(np.uint64) + np.uint64(seed)), units) + own * np.uint64(0x9E3779B97F4A7C15))
        head, is_start, reached, previous, piece_of = (x.all() for x in (self.head, self.is_start, self.reached, self.previous, self.piece_of))
        active, step = np.arange(len(at)), 0
        drawn, count = [], np.zeros(len(at), np.int64)
        while len(active):
            u = (mix(base[active] + np.uint64(step + 1)) >> np.uint64(32)).astype(np.uint32)
            u = np.minimum(u, np.uint32(0xFFFFFFFE))
            edge = head[state]
            more = np.flatnonzero(u >= reached[edge])
            while len(more):  # on to the next edge into the state
                edge[more] += 1
                more = more[u[more] >= reached[edge[more]]]
            drawn.append((active, piece_of[edge]))
            count[active] += 1
            state = previous[edge]
            on = ~is_start[state]
            active, state, step = active[on], state[on], step + 1
        last = np.cumsum(count)
        out = np.empty(last[-1], np.int64)
        for k, (who, p) in enumerate(drawn):
            out[last[who] - 1 - k] = p
        bounds = np.append(last - count, last[-1])[np.append(first_unit, len(at))]
        return *self._with_bytes(out, bounds), units

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """Pieces of each text, drawn by its key; callers bound the texts, see ``sample_long``."""
        some = [k for k, t in enumerate(texts) if t]
        out = [np.zeros(0, np.int32)] * len(texts)
        if some:
            sizes = np.array([len(texts[k]) + 1 for k in some], np.int64)
            points = np.frombuffer("".join(" " + texts[k] for k in some).encode("utf-32-le"), np.uint32)
            pieces, bounds, _ = self.draw(points, np.cumsum(sizes) - sizes, keys[some], np.zeros(len(some), np.int64), seed)
            for k, a, b in zip(some, bounds[:-1], bounds[1:]):
                out[k] = pieces[a:b]
        return out

    def sample_long(self, text: str, key: np.ndarray, seed: int = SEED, block: int = BLOCK_CHARS) -> tuple[np.ndarray, bool]:
        """The pieces of one text, drawn in parts of about ``block`` characters, and whether they decode to it."""
        text = " " + text
        a, units, out, good = 0, 0, [], True
        while a < len(text):
            b, look = min(a + block, len(text)), 64
            while b < len(text):  # on to where a unit begins
                points = np.frombuffer(text[b - 1:b + look].encode("utf-32-le"), np.uint32)
                starts = self._units(points, np.zeros(1, np.int64))
                if len(starts) > 1:
                    b += int(starts[1]) - 1
                    break
                b, look = min(b + look, len(text)), 2 * look
            points = np.frombuffer(text[a:b].encode("utf-32-le"), np.uint32)
            pieces, _, n = self.draw(points, np.zeros(1, np.int64), key, np.array([units]), seed)
            good = good and self.bytes_of(pieces).decode() == text[a:b]
            out.append(pieces)
            units += int(n[0])
            a = b
        return np.concatenate(out), good

    def _with_bytes(self, out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that stand for code points become byte pieces."""
        where = np.flatnonzero(out < 0)
        c = -out[where] - 1
        extra = np.zeros(len(out) + 1, np.int64)
        extra[where + 1] = (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        moved = np.cumsum(extra)
        wide = np.repeat(out, extra[1:] + 1)
        n = extra[where + 1]
        for k in range(4):  # byte k of those with at least k more bytes
            some = n >= k
            low = (c[some] >> (6 * (n[some] - k))) & 0x3F
            lead = (np.array([0, 0xC0, 0xE0, 0xF0])[n[some]] | (c[some] >> (6 * n[some]))) if k == 0 else low | 0x80
            wide[where[some] + moved[where[some]] + k] = self.byte_piece[lead]
        return wide.astype(np.int32), bounds + moved[bounds]

    def bytes_of(self, pieces: np.ndarray) -> bytes:
        size = self.raw_size[pieces]
        at = np.repeat(self.raw_first[pieces] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.raw[at].tobytes()

    def decode(self, pieces: np.ndarray) -> str:
        """The text of pieces of one row."""
        return self.bytes_of(pieces).decode()[1:]


def model(path: str, temperature: float = 1.0) -> Model:
    if (path, temperature) not in _loaded:
        _loaded[path, temperature] = Model(path, temperature)
    return _loaded[path, temperature]


def _runs(texts: list, limit: int):
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if held and held + n > limit:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def _encoder(path: str, temperature: float, seed: int):
    def encode(batches):
        m = model(path, temperature)
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for a, b in _runs(texts, BLOCK_CHARS):
                    part = texts[a:b]
                    if len(part) == 1 and len(part[0] or "") >= BLOCK_CHARS:
                        ids, same = m.sample_long(part[0], keys[a:b], seed)
                        pieces, good = [ids], [same]
                    else:
                        pieces = m.sample([t or "" for t in part], keys[a:b], seed)
                        good = [t is None or m.decode(p) == t for t, p in zip(part, pieces)]
                    offsets = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                    flat = pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32))
                    ids = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([t is None for t in part]))
                    n = pa.array([None if t is None else len(p) for t, p in zip(part, pieces)], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, ids, pa.array(good)],
                                                     names=["doc_id", "n_pieces", "pieces", "lossless"])
        finally:
            m._forget()
    return encode


def sample_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", temperature: float = 1.0,
                  seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces and whether decoding them gave the text back."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                    F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id)).alias("key"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("n_pieces", T.LongType()),
                           T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return d.mapInArrow(_encoder(path, temperature, seed), schema)


def decode_pieces(pieces: DataFrame, path: str, column: str = "pieces") -> DataFrame:
    """``pieces`` with a column ``text`` decoded from the piece ids."""
    ship_package(pieces.sparkSession)

    @F.pandas_udf("string")
    def decoded(ids):
        m = model(path)
        return ids.map(lambda p: None if p is None else m.decode(np.asarray(p, np.int64)))
    return pieces.withColumn("text", decoded(column))
