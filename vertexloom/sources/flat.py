"""Just enough of the FlatBuffers wire format to write and read size-prefixed tables.

Written front to back: a table, then what it refers to. Positions count from the size prefix, so eight-byte data are aligned if the record is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_SIZES = {"b": 1, "B": 1, "?": 1, "h": 2, "H": 2, "i": 4, "I": 4, "q": 8, "Q": 8, "f": 4, "d": 8}


class Text(str):
    """A string field."""


class Blob(bytes):
    """A vector of bytes."""


class Doubles(list):
    """A vector of doubles."""


class UInts(list):
    """A vector of 32-bit unsigned integers."""


class Tables(list):
    """A vector of tables."""


#: slot -> (format, number) for a scalar, or one of the classes above, or such a dict for a table
Table = dict


def encode(root: Table) -> bytes:
    """The size-prefixed buffer of a table, padded to a multiple of eight bytes."""
    buf = bytearray(8)
    at = _table(buf, root)
    struct.pack_into("<I", buf, 4, at - 4)
    buf.extend(bytes(-len(buf) % 8))
    struct.pack_into("<I", buf, 0, len(buf) - 4)
    return bytes(buf)


def _pad(buf: bytearray, unit: int, rest: int = 0) -> None:
    buf.extend(bytes((rest - len(buf)) % unit))


def _table(buf: bytearray, fields: Table) -> int:
    slots = max(fields, default=-1) + 1
    _pad(buf, 2)
    buf.extend(bytes((4 - len(buf) - (4 + 2 * slots)) % 8))
    vtable = len(buf)
    start = vtable + 4 + 2 * slots  # 4 modulo 8: eight-byte fields come first
    sized = sorted(((_SIZES[v[0]] if isinstance(v, tuple) else 4, s) for s, v in fields.items()), key=lambda x: (-x[0], x[1]))
    offsets, end = {}, 4
    for size, slot in sized:
        end += -end % min(size, 4) if size < 8 else 0
        offsets[slot] = end
        end += size
    buf.extend(struct.pack(f"<HH{slots}H", 4 + 2 * slots, end, *(offsets.get(s, 0) for s in range(slots))))
    buf.extend(bytes(end))
    struct.pack_into("<i", buf, start, start - vtable)
    later = []
    for slot, value in fields.items():
        if isinstance(value, tuple):
            struct.pack_into("<" + value[0], buf, start + offsets[slot], value[1])
        else:
            later.append((start + offsets[slot], value))
    for field, value in later:
        struct.pack_into("<I", buf, field, _child(buf, value) - field)
    return start


def _child(buf: bytearray, value) -> int:
    if isinstance(value, Doubles):
        _pad(buf, 8, 4)
        at = len(buf)
        buf.extend(struct.pack(f"<I{len(value)}d", len(value), *value))
        return at
    if isinstance(value, dict):
        return _table(buf, value)
    _pad(buf, 4)
    at = len(buf)
    if isinstance(value, Text):
        data = value.encode("utf-8", "replace")
        buf.extend(struct.pack("<I", len(data)) + data + b"\0")
    elif isinstance(value, Blob):
        buf.extend(struct.pack("<I", len(value)) + value)
    elif isinstance(value, UInts):
        buf.extend(struct.pack(f"<I{len(value)}I", len(value), *value))
    elif isinstance(value, Tables):
        buf.extend(struct.pack("<I", len(value)) + bytes(4 * len(value)))
        for i, t in enumerate(value):
            field = at + 4 + 4 * i
            struct.pack_into("<I", buf, field, _table(buf, t) - field)
    else:
        raise TypeError(type(value).__name__)
    return at


class Reader:
    """A table in a buffer; fields by slot."""

    __slots__ = ("buf", "at", "vtable", "slots")

    def __init__(self, buf, at: int):
        self.buf, self.at = buf, at
        self.vtable = at - struct.unpack_from("<i", buf, at)[0]
        self.slots = (struct.unpack_from("<H", buf, self.vtable)[0] - 4) // 2

    @classmethod
    def prefixed(cls, buf, at: int = 0) -> Reader:
        return cls(buf, at + 4 + struct.unpack_from("<I", buf, at + 4)[0])

    def _field(self, slot: int) -> int:
        if slot >= self.slots:
            return 0
        offset = struct.unpack_from("<H", self.buf, self.vtable + 4 + 2 * slot)[0]
        return self.at + offset if offset else 0

    def _refers(self, slot: int) -> int:
        field = self._field(slot)
        return field + struct.unpack_from("<I", self.buf, field)[0] if field else 0

    def number(self, slot: int, fmt: str, default):
        field = self._field(slot)
        return struct.unpack_from("<" + fmt, self.buf, field)[0] if field else default

    def blob(self, slot: int) -> bytes | None:
        at = self._refers(slot)
        if not at:
            return None
        n = struct.unpack_from("<I", self.buf, at)[0]
        return bytes(self.buf[at + 4 : at + 4 + n])

    def text(self, slot: int) -> str | None:
        data = self.blob(slot)
        return None if data is None else data.decode("utf-8", "replace")

    def vector(self, slot: int, dtype: str) -> list | None:
        at = self._refers(slot)
        if not at:
            return None
        n = struct.unpack_from("<I", self.buf, at)[0]
        return np.frombuffer(self.buf, dtype, n, at + 4).tolist()

    def table(self, slot: int) -> Reader | None:
        at = self._refers(slot)
        return Reader(self.buf, at) if at else None

    def tables(self, slot: int) -> Iterator[Reader] | None:
        at = self._refers(slot)
        if not at:
            return None
        n = struct.unpack_from("<I", self.buf, at)[0]
        fields = (at + 4 + 4 * i for i in range(n))
        return (Reader(self.buf, f + struct.unpack_from("<I", self.buf, f)[0]) for f in fields)
