"""Many records of a container at once, as Arrow arrays: the same values as ``codec`` gives one by one, by gathers over the bytes of a block.

All functions take the block as an array of bytes and positions in it as arrays, one per record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vertexloom.sources import codec
from vertexloom.sources.bytes import ContainerError
from vertexloom.types import Column

# The type on the wire by column type code; texts and bytes have a length before them
_WIRE = {0: "<i1", 1: "<u1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<i8", 8: "<u8", 9: "<f4", 10: "<f8"}
_ARROW = {0: pa.int8(), 1: pa.int16(), 3: pa.int16(), 4: pa.int32(), 5: pa.int32(), 6: pa.int64(), 7: pa.int64(), 8: pa.decimal128(20, 0), 9: pa.float32(), 10: pa.float64()}
_SPARSE = (11, 12, 13, 14)


def numbers(buf: np.ndarray, at: np.ndarray, dtype: str) -> np.ndarray:
    """The little-endian numbers at these positions."""
    width = np.dtype(dtype).itemsize
    if len(at) and (int(at.max()) + width > len(buf) or int(at.min()) < 0):
        raise ContainerError("a record refers to bytes beyond its end")
    return np.ascontiguousarray(buf[at[:, None] + np.arange(width)]).view(dtype)[:, 0]


def record_starts(data: bytes, count: int | None = None) -> list[int]:
    """Where each whole length-prefixed record of a block begins, and where the last ends."""
    out, at, end, read = [], 0, len(data), int.from_bytes
    while at + 4 <= end and (count is None or len(out) < count):
        after = at + 4 + read(data[at : at + 4], "little")
        if after > end:
            break
        out.append(at)
        at = after
    out.append(at)
    return out


def _gathered(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes): pieces of the block one after the other."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    if len(at) and int((at + sizes).max()) > len(buf):
        raise ContainerError("a record refers to bytes beyond its end")
    where = np.repeat(at - offsets[:-1], sizes) + np.arange(offsets[-1])
    return offsets, buf[where]


def _binary(buf: np.ndarray, at: np.ndarray, sizes: np.ndarray, present: np.ndarray, text: bool) -> pa.Array:
    sizes = np.where(present, sizes, 0)
    offsets, data = _gathered(buf, np.where(present, at, 0), sizes)
    kind = pa.string() if text else pa.binary()
    out = pa.Array.from_buffers(kind, len(sizes), [_bits(present), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    if text:
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # no UTF-8: replaced as in single values
            raw = _binary(buf, at, sizes, present, False).to_pylist()
            return pa.array([None if v is None else v.decode("utf-8", "replace") for v in raw], pa.string())
    return out


def _bits(present: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(present, bitorder="little"))


def properties(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, columns: list[Column], wanted: set[int]) -> dict[int, pa.Array]:
    """The wanted columns (by number) of property records; see ``codec.decode_properties``. All records advance by one property a round."""
    n = len(starts)
    widths = np.array([np.dtype(_WIRE[c.type]).itemsize if c.type in _WIRE else 0 if c.type in _SPARSE else -1 for c in columns], np.int64)
    at = {i: np.zeros(n, np.int64) for i in wanted}
    size = {i: np.zeros(n, np.int64) for i in wanted if columns[i].type in _SPARSE}
    have = {i: np.zeros(n, bool) for i in wanted}
    cursor = starts.astype(np.int64)
    live = np.flatnonzero(cursor + 2 <= ends)
    while len(live):
        here = cursor[live]
        which = numbers(buf, here, "<u2").astype(np.int64)
        known = which < len(columns)
        live, here, which = live[known], here[known] + 2, which[known]
        if not len(live):
            break
        width = widths[which]
        if (width < 0).any():
            c = columns[int(which[np.argmax(width < 0)])]
            raise ContainerError(f"Unsupported column type {c.type} of {c.name}")
        var = width == 0
        if var.any():
            width = width.copy()
            width[var] = numbers(buf, here[var], "<u4")
            here = here + 4 * var
        if (here + width > ends[live]).any():
            raise ContainerError("a property ends beyond its record")
        for i in np.unique(which).tolist():
            if i in at:
                m = which == i
                rows = live[m]
                at[i][rows], have[i][rows] = here[m], True
                if i in size:
                    size[i][rows] = width[m]
        cursor[live] = here + width
        live = live[cursor[live] + 2 <= ends[live]]
    return {i: _column(buf, columns[i], at[i], size.get(i), have[i]) for i in wanted}


def _column(buf: np.ndarray, column: Column, at: np.ndarray, size: np.ndarray | None, have: np.ndarray) -> pa.Array:
    if size is not None:
        return _binary(buf, at, size, have, column.type != 14)
    values = np.zeros(len(at), _WIRE[column.type])
    values[have] = numbers(buf, at[have], _WIRE[column.type])
    if column.type == 2:
        return pa.array(values != 0, pa.bool_(), mask=~have)
    if column.type == 8:
        return pa.array(values, pa.uint64(), mask=~have).cast(pa.decimal128(20, 0))
    return pa.array(values, mask=~have).cast(_ARROW[column.type])


def edges(data: bytes, starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, source, target, where the properties begin, where they end) of the edge records at ``starts`` (with the end of the last)."""
    buf = np.frombuffer(data, np.uint8)
    at = np.array(starts, np.int64)
    if len(at) > 1 and int((at[1:] - at[:-1]).min()) < 12:
        raise ContainerError("an edge record is too short")
    return buf, numbers(buf, at[:-1] + 4, "<u4").astype(np.int64), numbers(buf, at[:-1] + 8, "<u4").astype(np.int64), at[:-1] + 12, at[1:]


class Tables:
    """FlatBuffers tables at positions of a block (0: none); fields by slot."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.buf, self.at, self.there = buf, at, at > 0
        self.vtable = np.zeros(len(at), np.int64)
        self.slots = np.zeros(len(at), np.int64)
        if self.there.any():
            own = at[self.there]
            self.vtable[self.there] = own - numbers(buf, own, "<i4")
            self.slots[self.there] = (numbers(buf, self.vtable[self.there], "<u2").astype(np.int64) - 4) // 2

    def field(self, slot: int) -> np.ndarray:
        out = np.zeros(len(self.at), np.int64)
        has = np.flatnonzero(self.there & (self.slots > slot))
        offset = numbers(self.buf, self.vtable[has] + 4 + 2 * slot, "<u2").astype(np.int64)
        out[has] = np.where(offset > 0, self.at[has] + offset, 0)
        return out

    def refers(self, slot: int) -> np.ndarray:
        """Where the table or vector of a field begins, 0 for none."""
        out = self.field(slot)
        has = np.flatnonzero(out)
        out[has] += numbers(self.buf, out[has], "<u4")
        return out

    def bytes_(self, slot: int) -> np.ndarray:
        """An unsigned byte, 0 by default."""
        field = self.field(slot)
        out = np.zeros(len(field), np.int8)
        has = np.flatnonzero(field)
        out[has] = self.buf[field[has]]
        return out

    def vector(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """(where its elements begin, their number); 0 and 0 for none."""
        at = self.refers(slot)
        n = np.zeros(len(at), np.int64)
        has = np.flatnonzero(at)
        n[has] = numbers(self.buf, at[has], "<u4")
        return np.where(at > 0, at + 4, 0), n


def _lists(t: Tables, slot: int, dtype: str, kind: pa.DataType) -> pa.Array:
    at, n = t.vector(slot)
    width = np.dtype(dtype).itemsize
    offsets, data = _gathered(t.buf, at, n * width)
    values = pa.array(data.view(dtype)).cast(kind)
    return _list_array((offsets // width), values, at > 0)


def _list_array(offsets: np.ndarray, values: pa.Array, present: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.list_(values.type), len(present), [_bits(present), pa.py_buffer(offsets.astype(np.int32))], children=[values])


def _flat(t: Tables, kinds: np.ndarray) -> list[pa.Array]:
    return [pa.array(kinds, pa.int8(), mask=~t.there), *(_lists(t, s, "<f8", pa.float64()) for s in (1, 2, 3)), _lists(t, 0, "<u4", pa.int32())]


_FLAT = ["type", "xy", "z", "m", "ends"]


def _parts(t: Tables) -> tuple[np.ndarray, np.ndarray, Tables]:
    """(whether there are parts, offsets of each one's parts, the parts)."""
    at, n = t.vector(7)
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    fields = np.repeat(at - 4 * offsets[:-1], n) + 4 * np.arange(offsets[-1])
    return at > 0, offsets, Tables(t.buf, fields + numbers(t.buf, fields, "<u4"))


class Features:
    """The feature records of a block at ``starts`` (with the end of the last)."""

    def __init__(self, data: bytes, starts: list[int], header_type: int):
        self.data, self.header_type = data, header_type
        self.buf = np.frombuffer(data, np.uint8)
        self.starts = np.array(starts[:-1], np.int64)
        root = self.starts + 4
        self.table = Tables(self.buf, root + numbers(self.buf, root, "<u4"))
        self.shape = Tables(self.buf, self.table.refers(0))
        self.has_parts, self.part_offsets, self.parts = _parts(self.shape)
        self.kinds = self.shape.bytes_(6) if not header_type else np.full(len(self.starts), header_type, np.int8)

    def __len__(self) -> int:
        return len(self.starts)

    def take(self, rows: np.ndarray) -> Features:
        starts = self.starts[rows]
        return Features(self.data, [*starts.tolist(), 0], self.header_type)

    def property_columns(self, columns: list[Column], wanted: set[int]) -> dict[int, pa.Array]:
        at, n = self.table.vector(1)
        return properties(self.buf, at, at + n, columns, wanted)

    def _nested(self) -> bool:
        return bool(len(self.parts.at)) and bool((self.parts.refers(7) > 0).any())

    def _one_by_one(self) -> list[dict | None]:
        return [codec.decode_feature(self.data, s, self.header_type)[0] for s in self.starts.tolist()]

    def geometries(self, kind: pa.DataType) -> pa.Array:
        """Geometry structs. A block with parts in parts is decoded one by one."""
        if self._nested():
            return pa.array([codec.flat_parts(g) for g in self._one_by_one()], kind)
        inner = self.parts.bytes_(6)
        owner = np.repeat(self.kinds, np.diff(self.part_offsets))
        part_kinds = np.where(owner == 6, 3, inner).astype(np.int8)
        part_kind = kind.field("parts").type.value_type
        parts = pa.StructArray.from_arrays([a.cast(part_kind.field(n).type) for n, a in zip(_FLAT, _flat(self.parts, part_kinds))], fields=[part_kind.field(n) for n in _FLAT])
        whole = [*_flat(self.shape, self.kinds), _list_array(self.part_offsets, parts, self.has_parts), pa.nulls(len(self), pa.list_(pa.int32()))]
        names = [*_FLAT, "parts", "within"]
        return pa.StructArray.from_arrays([a.cast(kind.field(n).type) for n, a in zip(names, whole)], fields=[kind.field(n) for n in names], mask=pa.array(~self.shape.there))

    def boxes(self) -> np.ndarray:
        """(minx, miny, maxx, maxy) of all coordinates that are numbers, NaN without any; see ``codec.bounds``."""
        out = np.full((len(self), 4), np.nan)
        if self._nested():
            for i, g in enumerate(self._one_by_one()):
                out[i] = codec.bounds(g) or (np.nan,) * 4
            return out
        for t, of in ((self.shape, np.arange(len(self))), (self.parts, np.repeat(np.arange(len(self)), np.diff(self.part_offsets)))):
            at, n = t.vector(1)
            n = n // 2
            full = np.flatnonzero(n)
            if not len(full):
                continue
            offsets, data = _gathered(t.buf, at[full], n[full] * 16)
            xy = data.view("<f8").reshape(-1, 2)
            first = offsets[:-1] // 16
            for k, (axis, least) in enumerate(((0, True), (1, True), (0, False), (1, False))):
                fold = np.fmin if least else np.fmax
                fold.at(out[:, k], of[full], fold.reduceat(xy[:, axis], first))
        lost = np.isnan(out).any(axis=1)
        out[lost] = np.nan
        return out
