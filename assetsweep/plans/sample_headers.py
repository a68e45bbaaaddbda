"""Writes headers for round-trip queries and tests; not part of the library's operators."""

from __future__ import annotations

import struct

from assetsweep.sources.headers import MAGIC, SCALAR_FORMAT, TYPE_NAMES


def encode_header(version: int, kvs: list[tuple[str, str, object]],
                  tensors: list[tuple[str, list[int], int]]) -> bytes:
    """Bytes of a header with typed ``(key, type_name, value)`` entries and tensors."""
    out = bytearray(MAGIC)
    out += struct.pack("<IQQ", version, len(tensors), len(kvs))

    def put(t, v):
        if t == "str":
            b = v.encode("utf-8")
            out.extend(struct.pack("<Q", len(b)) + b)
        elif t == "arr":
            et, items = v
            out.extend(struct.pack("<IQ", TYPE_NAMES.index(et), len(items)))
            for it in items:
                put(et, it)
        else:
            out.extend(struct.pack("<" + SCALAR_FORMAT[t], v))

    for key, t, v in kvs:
        put("str", key)
        out.extend(struct.pack("<I", TYPE_NAMES.index(t)))
        put(t, v)
    for name, dims, ty in tensors:
        put("str", name)
        out.extend(struct.pack("<I", len(dims)))
        for d in dims:
            out.extend(struct.pack("<Q", d))
        out.extend(struct.pack("<IQ", ty, 0))
    return bytes(out)
