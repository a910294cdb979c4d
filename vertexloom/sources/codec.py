"""Bytes of a container to values and back: header, features, properties, graph section. No Spark here.

Layout, all little-endian: magic, header, index, features, graph section. The index is there if the header's node size is not 0, the graph section if bytes follow the last feature.
"""

from __future__ import annotations

import math
import struct
from decimal import Decimal
from functools import lru_cache

from vertexloom.sources.bytes import ContainerError
from vertexloom.sources.flat import Blob, Doubles, Reader, Tables, Text, UInts, encode
from vertexloom.types import COLUMN_NAMES, Column, GraphMeta, Meta

# The first eight bytes of a container, with and without a graph section's format
MAGIC = bytes([0x66, 0x67, 0x67, 0x01, 0x66, 0x67, 0x67, 0x00])
PLAIN_MAGIC = bytes([0x66, 0x67, 0x62, 0x03, 0x66, 0x67, 0x62, 0x00])
HEADER_MIN, HEADER_MAX = 8, 10_485_760  # sizes a header may have
DEFAULT_NODE_SIZE = 16  # of a header that does not say

_FORMATS = {0: "b", 1: "B", 2: "B", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
_TEXTUAL = (11, 12, 13)


def check_magic(data: bytes) -> None:
    """Accepts both formats whatever their version."""
    if bytes(data[:3]) not in (MAGIC[:3], PLAIN_MAGIC[:3]):
        raise ContainerError("these are not the first bytes of a container")


def check_header_size(size: int) -> None:
    if not HEADER_MIN <= size <= HEADER_MAX:
        raise ContainerError(f"a header cannot have {size} bytes")


def encode_header(meta: Meta) -> bytes:
    table: dict = {2: ("B", meta.geometry_type), 8: ("Q", meta.features_count), 9: ("H", meta.index_node_size)}
    for slot, value in ((0, meta.name), (11, meta.title), (12, meta.description), (13, meta.metadata)):
        if value is not None:
            table[slot] = Text(value)
    if meta.envelope:
        table[1] = Doubles(meta.envelope)
    if meta.columns:
        table[7] = Tables(_column(c) for c in meta.columns)
    if meta.crs:
        crs = meta.crs
        table[10] = {s: Text(crs[k]) for s, k in ((0, "org"), (2, "name"), (3, "description"), (4, "wkt"), (5, "code_string")) if crs.get(k) is not None}
        if crs.get("code"):
            table[10][1] = ("i", crs["code"])
    return encode(table)


def _column(c: Column) -> dict:
    table: dict = {0: Text(c.name), 1: ("B", c.type)}
    for slot, value in ((2, c.title), (3, c.description)):
        if value is not None:
            table[slot] = Text(value)
    for slot, value in ((4, c.width), (5, c.precision), (6, c.scale)):
        if value != -1:
            table[slot] = ("i", value)
    for slot, value, usual in ((7, c.nullable, True), (8, c.unique, False), (9, c.primary_key, False)):
        if value != usual:
            table[slot] = ("?", value)
    return table


def decode_header(buf, at: int = 0) -> Meta:
    """The header whose size prefix is at ``at``."""
    h = Reader.prefixed(buf, at)
    columns = []
    for c in h.tables(7) or ():
        name = c.text(0)
        if name is None:
            raise ContainerError("Column without a name")
        columns.append(
            Column(name, c.number(1, "B", 0), c.text(2), c.text(3), c.number(4, "i", -1), c.number(5, "i", -1), c.number(6, "i", -1), c.number(7, "?", True), c.number(8, "?", False), c.number(9, "?", False))
        )
    crs = h.table(10)
    return Meta(
        features_count=h.number(8, "Q", 0), geometry_type=h.number(2, "B", 0), index_node_size=h.number(9, "H", DEFAULT_NODE_SIZE), columns=columns, envelope=h.vector(1, "<f8"), name=h.text(0),
        crs=crs and {"org": crs.text(0), "code": crs.number(1, "i", 0), "name": crs.text(2), "description": crs.text(3), "wkt": crs.text(4), "code_string": crs.text(5)},
        title=h.text(11), description=h.text(12), metadata=h.text(13),
    )


def encode_properties(values, columns: list[Column]) -> bytes:
    """(column number, value) pairs; nulls are left out."""
    out = bytearray()
    for i, (value, column) in enumerate(zip(values, columns)):
        if value is None:
            continue
        code = column.type
        if code in _FORMATS:
            try:
                out += struct.pack("<H" + _FORMATS[code], i, int(value) if code not in (9, 10) else value)
            except (struct.error, OverflowError) as e:
                raise ContainerError(f"Value {value!r} does not fit column {column.name} of type {COLUMN_NAMES[code]}") from e
        elif code in _TEXTUAL or code == 14:
            data = bytes(value) if code == 14 else str(value).encode("utf-8", "replace")
            out += struct.pack("<HI", i, len(data)) + data
        else:
            raise ContainerError(f"Unsupported column type {code} of {column.name}")
    return bytes(out)


def decode_properties(data: bytes | None, columns: list[Column]) -> list:
    """The value of each column, None if absent. An unknown column number ends the record: its width is not known."""
    out: list = [None] * len(columns)
    at, end = 0, len(data or b"")
    while at + 2 <= end:
        (i,) = struct.unpack_from("<H", data, at)
        at += 2
        if i >= len(columns):
            break
        code = columns[i].type
        fmt = _FORMATS.get(code)
        if fmt:
            (value,) = struct.unpack_from("<" + fmt, data, at)
            at += struct.calcsize("<" + fmt)
            out[i] = bool(value) if code == 2 else Decimal(value) if code == 8 else value
        elif code in _TEXTUAL or code == 14:
            (n,) = struct.unpack_from("<I", data, at)
            raw = data[at + 4 : at + 4 + n]
            at += 4 + n
            out[i] = raw if code == 14 else raw.decode("utf-8", "replace")
        else:
            raise ContainerError(f"Unsupported column type {code} of {columns[i].name}")
    return out


def _whole(values: list | None) -> list | None:
    """Numbers for a vector: null ordinates become NaN."""
    return [math.nan if v is None else v for v in values] if values and None in values else values


def _geometry(g) -> dict:
    table: dict = {6: ("B", g["type"] or 0)}
    if g.get("parts") is not None:
        table[7] = Tables(_geometry(p) for p in g["parts"])
        return table
    for slot, name, kind in ((1, "xy", Doubles), (2, "z", Doubles), (3, "m", Doubles), (0, "ends", UInts)):
        if g.get(name) is not None:  # an empty vector stays one
            table[slot] = kind(_whole(g[name]))
    return table


@lru_cache(4096)
def _flat_form(kind: int, sizes: tuple[int | None, ...], with_properties: bool) -> tuple[bytes, tuple, int | None]:
    """(bytes, (start, format) of each vector, where the properties' size goes): a feature whose geometry has vectors of these sizes (xy, z, m, ends; None: no such vector), with zeros in them."""
    geometry: dict = {6: ("B", kind)}
    slots = ((1, Doubles, "d"), (2, Doubles, "d"), (3, Doubles, "d"), (0, UInts, "I"))
    for (slot, vector, _), n in zip(slots, sizes):
        if n is not None:
            geometry[slot] = vector([0] * n)
    data = encode({0: geometry, **({1: Blob(b"")} if with_properties else {})})
    feature = Reader.prefixed(data)
    g = feature.table(0)
    places = tuple(None if n is None else (g._refers(slot) + 4, f"<{n}{fmt}") for (slot, _, fmt), n in zip(slots, sizes))
    at = feature._refers(1) if with_properties else None
    return data if at is None else data[:at], places, at


def _encode_flat(geometry: dict, properties: bytes) -> bytes:
    """A feature without parts: features of one shape differ only in numbers and properties."""
    vectors = tuple(_whole(geometry.get(n)) for n in ("xy", "z", "m", "ends"))
    form, places, at = _flat_form(geometry["type"] or 0, tuple(None if v is None else len(v) for v in vectors), bool(properties))
    out = bytearray(form)
    for place, values in zip(places, vectors):
        if place is not None and values:
            struct.pack_into(place[1], out, place[0], *values)
    if at is not None:
        out += struct.pack("<I", len(properties)) + properties
        out += bytes(-len(out) % 8)
        struct.pack_into("<I", out, 0, len(out) - 4)
    return bytes(out)


def encode_feature(geometry: dict | None, properties: bytes) -> bytes:
    if geometry is not None and geometry.get("parts") is None:
        return _encode_flat(geometry, properties)
    table: dict = {1: Blob(properties)} if properties else {}
    if geometry is not None:
        table[0] = _geometry(nested_parts(geometry))
    return encode(table)


def _read_geometry(r: Reader, header_type: int) -> dict:
    parts = r.tables(7)
    kind = header_type or r.number(6, "B", 0)
    return {
        "type": kind, "xy": r.vector(1, "<f8"), "z": r.vector(2, "<f8"), "m": r.vector(3, "<f8"), "ends": r.vector(0, "<u4"),
        "parts": None if parts is None else [_read_geometry(p, 3 if kind == 6 else 0) for p in parts],
    }


def decode_feature(buf, at: int, header_type: int = 0) -> tuple[dict | None, bytes | None]:
    """Geometry (parts may nest) and property bytes of the feature whose size prefix is at ``at``."""
    f = Reader.prefixed(buf, at)
    g = f.table(0)
    return (None if g is None else _read_geometry(g, header_type)), f.blob(1)


def flat_parts(geometry: dict | None) -> dict | None:
    """The geometry with parts on one level, as the Spark type has them: parts of parts follow what they belong to, and ``within`` has for each part the number of the part it belongs to, -1
    for the geometry itself (null if that is so for all)."""
    if geometry is None or geometry["parts"] is None:
        return geometry
    parts: list = []
    within: list[int] = []
    nested = False
    todo = [(p, -1) for p in reversed(geometry["parts"])]
    while todo:
        p, of = todo.pop()
        if p.get("parts") is not None:
            nested = True
            todo.extend((x, len(parts)) for x in reversed(p["parts"]))
        parts.append({k: p.get(k) for k in ("type", "xy", "z", "m", "ends")})
        within.append(of)
    return {**geometry, "parts": parts, "within": within if nested else None}


def nested_parts(geometry: dict | None) -> dict | None:
    """The geometry with parts in their parts again; the reverse of ``flat_parts``."""
    within = geometry and geometry.get("within")
    if not within or geometry.get("parts") is None:
        return geometry
    parts = [{**p, "parts": [] if p["type"] in (6, 7) and p.get("xy") is None else None} for p in geometry["parts"]]
    roots: list = []
    for p, of in zip(parts, within):
        if of is None or of < 0:
            roots.append(p)
        else:
            holder = parts[of]
            if holder["parts"] is None:
                holder["parts"] = []
            holder["parts"].append(p)
    return {**geometry, "parts": roots}


def bounds(geometry: dict | None) -> tuple[float, float, float, float] | None:
    """The bounding box of all coordinates that are numbers; None without any."""
    if geometry is None:
        return None
    own = geometry.get("xy") or ()
    if len(own) == 2 and geometry.get("parts") is None:
        x, y = own
        return (x, y, x, y) if x is not None and y is not None and x == x and y == y else None
    todo, xs, ys = [geometry], [], []
    while todo:
        g = todo.pop()
        todo.extend(g.get("parts") or ())
        xy = g.get("xy") or ()
        xy = xy[: len(xy) // 2 * 2]
        xs.extend(v for v in xy[0::2] if v is not None and v == v)
        ys.extend(v for v in xy[1::2] if v is not None and v == v)
    return (min(xs), min(ys), max(xs), max(ys)) if xs and ys else None


def encode_graph_header(meta: GraphMeta) -> bytes:
    if not 0 <= meta.edge_count < 1 << 32:
        raise ContainerError("one container holds fewer than 2 ** 32 edges")
    columns = meta.columns or []
    out = bytearray(struct.pack("<IH", meta.edge_count, len(columns)))
    for c in columns:
        name = c.name.encode("utf-8")
        out += struct.pack("<H", len(name)) + name + bytes([c.type])
    return struct.pack("<I", len(out)) + bytes(out)


def decode_graph_header(buf, at: int = 0) -> tuple[GraphMeta, int]:
    """The graph header whose size is at ``at``, and where its edges begin."""
    (size,) = struct.unpack_from("<I", buf, at)
    n_edges, n_columns = struct.unpack_from("<IH", buf, at + 4)
    pos, columns = at + 10, []
    for _ in range(n_columns):
        (n,) = struct.unpack_from("<H", buf, pos)
        columns.append(Column(bytes(buf[pos + 2 : pos + 2 + n]).decode("utf-8", "replace"), buf[pos + 2 + n]))
        pos += 3 + n
    return GraphMeta(n_edges, columns or None), at + 4 + size


def encode_edge(source: int, target: int, properties: bytes) -> bytes:
    return struct.pack("<III", 8 + len(properties), source, target) + properties


def decode_edge(buf, at: int) -> tuple[int, int, bytes, int]:
    """Source, target, property bytes, and where the next edge begins."""
    size, source, target = struct.unpack_from("<III", buf, at)
    return source, target, bytes(buf[at + 12 : at + 4 + size]), at + 4 + size
