"""WARC archives as seekable Zstandard bundles.

A bundle file is a row of independent Zstandard frames, each holding whole WARC records (about
``FRAME_BYTES`` before compression), and a last skippable frame with the seek table: compressed and
plain size of every frame, then the footer (number of frames, descriptor, magic).  The index table maps
each record identifier to its bundle, frame and the offset inside the plain frame, so one record is read
by fetching one frame.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the largest identifier
is the response, the others are revisits that name it and carry only headers.

Plan: digests are computed in the scan; the digests that occur more than once come from a hash aggregate
with map-side combine, and are joined back (Spark broadcasts that table if its size in the shared folder
allows; else a shuffle join whose hot digests AQE splits).  Each task writes its bundles under names of
its own and returns index rows; the index table is written once, so only bundles of tasks that ended well
are ever named.  Bundles are rolled over at ``BUNDLE_BYTES``; a task holds one frame at a time.

Defined cases: a null payload is an empty one; a null url is an empty target; rows with equal identifier
and payload get a record each (all responses, or all revisits); rows with a null identifier revisit like
others and are never referred to; a record larger than a frame has a frame of its own; an empty table
makes no bundle; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetsweep.llm.common import filesystem, shared_path, stored
from assetsweep.session import ship_package

MIN_REVISIT = 1000
FRAME_BYTES = 1 << 17
BUNDLE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = ("record_id string, bundle string, frame long, frame_offset long, frame_bytes long, "
         "record_offset long, record_bytes long")
RECORD = ("record_id string, target string, record_type string, refers_to string, payload_bytes long, "
          "payload_digest string, payload binary")


class BundleWriter:
    """Appends records to frames of a seekable file; ``add`` returns (frame, offset in the frame)."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table, self.buffer, self.held, self.size = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.held
        self.buffer.append(record)
        self.held += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.table.append((len(frame), self.held))
            self.size += len(frame)
            self.buffer, self.held = [], 0

    def close(self) -> list[tuple[int, int]]:
        """Writes the seek table; returns (offset, bytes) of each frame."""
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table)
        body += struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()
        at, places = 0, []
        for n, _ in self.table:
            places.append((at, n))
            at += n
        return places


def seek_table(read_at, size: int) -> list[tuple[int, int, int]]:
    """(offset, bytes, plain bytes) of the frames, from the footer.  ``read_at(offset, n)`` reads the file."""
    frames, descriptor, magic = struct.unpack("<IBI", read_at(size - 9, 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable Zstandard file")
    entry = 12 if descriptor & 0x80 else 8
    start = size - 9 - frames * entry
    body = read_at(start, frames * entry)
    at, out = 0, []
    for k in range(frames):
        packed, plain = struct.unpack_from("<II", body, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def urn(record_id: str | None) -> str:
    return f"<urn:record:{'' if record_id is None else record_id}>"


def record_bytes(record_id, target, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(record_id)}",
        f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", target or ""),
        f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    name = lambda x: None if x is None or x == urn(None) else x[len("<urn:record:"):-1]
    revisit = field["WARC-Type"] == "revisit"
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = field["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
    if digest != stated or not revisit and len(payload) != length:
        raise ValueError(f"payload of {field['WARC-Record-ID']} differs from its digest")
    return {"record_id": name(field["WARC-Record-ID"]), "target": field["WARC-Target-URI"], "record_type": field["WARC-Type"],
            "refers_to": name(field.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": digest,
            "payload": None if revisit else payload}


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """record_id, target, payload, digest and refers_to (null: a response)."""
    d = pages.select(F.col(page_id).alias("record_id"), F.col(url).cast("string").alias("target"),
                     F.coalesce(F.col(html), F.lit("")).alias("payload"))
    d = d.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    many = (d.where(F.col("n") >= min_revisit).groupBy("digest", "n")
            .agg(F.count("*").alias("copies"), F.max("record_id").alias("first")).where("copies > 1"))
    many = stored(many.select("digest", "n", "first"), "warc-copies")
    refers = F.when(~F.col("first").eqNullSafe(F.col("record_id")), F.col("first")).cast("string")
    return d.join(many, ["digest", "n"], "left").select(
        F.col("record_id").cast("string").alias("record_id"), "target", "payload", "digest", refers.alias("refers_to"))


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches):
        fs, root = filesystem(folder)
        open_bundle = None
        rows: list[tuple] = []

        def roll():
            path = f"{root}/bundle-{uuid.uuid4().hex}.warc.zst"
            return path, BundleWriter(fs.open_output_stream(path, compression=None), frame_bytes=frame_bytes)

        def closed():
            path, writer = open_bundle
            frames = writer.close()
            name = f"{folder}/{path.rsplit('/', 1)[1]}"
            cols = list(zip(*[(i, name, k, *frames[k], at, n) for i, k, at, n in rows]))
            types = [pa.string(), pa.string(), *[pa.int64()] * 5]
            names = [x.split()[0] for x in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            for row in range(batch.num_rows):
                record_id, target, payload, digest, refers = (batch.column(k)[row].as_py() for k in range(5))
                record = record_bytes(record_id, target, payload.encode(), digest, refers)
                if open_bundle is None:
                    open_bundle = roll()
                rows.append((record_id, *open_bundle[1].add(record), len(record)))
                if open_bundle[1].size >= bundle_bytes:
                    yield closed()
                    open_bundle, rows = None, []
        if open_bundle is not None:
            yield closed()
    return write


def write_archive(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
                  html: str = "html", min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles to ``folder`` (shared by all executors) and returns the stored index table."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or shared_path(spark, "warc")
    fs, root = filesystem(folder)
    fs.create_dir(root)
    records = with_revisits(pages, page_id, url, html, min_revisit)
    return stored(records.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _reader(payloads: bool):
    def read(batches):
        zstd = zstandard.ZstdDecompressor()
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        files: dict = {}
        for batch in batches:
            out: list[dict] = []
            held = 0
            for frame in batch.to_pylist():
                if frame["bundle"] not in files:
                    for f in files.values():
                        f.close()
                    fs, path = filesystem(frame["bundle"])
                    files = {frame["bundle"]: fs.open_input_file(path)}
                plain = zstd.decompress(files[frame["bundle"]].read_at(frame["frame_bytes"], frame["frame_offset"]))
                for r in frame["records"]:
                    out.append(parse_record(plain[r["record_offset"]:r["record_offset"] + r["record_bytes"]]))
                    if not payloads:
                        out[-1]["payload"] = None
                held += len(plain)
                if held >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in zip(names, types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in zip(names, types)], names=names)
        for f in files.values():
            f.close()
    return read


def read_archive(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names (all, or any subset of its rows), each frame fetched once.

    ``payloads=False`` leaves the payloads out after their digests were checked.
    """
    ship_package(index.sparkSession)
    frames = (index.groupBy("bundle", "frame", "frame_offset", "frame_bytes")
              .agg(F.collect_list(F.struct("record_offset", "record_bytes")).alias("records")))
    frames = frames.select("bundle", "frame_offset", "frame_bytes", "records").sortWithinPartitions("bundle", "frame_offset")
    return frames.mapInArrow(_reader(payloads), RECORD)


# What the archive must hold, for DuckDB.
SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest AS k, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d LEFT JOIN m ON payload_digest = k
"""
