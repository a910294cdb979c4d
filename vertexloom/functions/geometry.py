"""Geometry structs as Catalyst expressions: flattening, rings, boxes, GeoJSON."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyspark.sql import types as T

from vertexloom.types import GEOMETRY, GEOMETRY_NAMES, GEOMETRY_TYPES

_NONE = "array<double>"


def as_geometry(geom: Column, kind: T.StructType) -> Column:
    """A struct column of type ``kind`` as a full geometry struct: ``within`` may be missing."""
    if "within" not in kind.names:
        geom = F.when(geom.isNotNull(), geom.withField("within", F.lit(None).cast("array<int>")))
    return geom.cast(GEOMETRY)


def type_code(name: Column) -> Column:
    """Code of a geometry type name; Unknown for an empty one, null for one that isn't known."""
    codes = F.create_map(*(F.lit(x) for pair in GEOMETRY_TYPES.items() for x in pair))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(0)).otherwise(F.try_element_at(codes, name))


def flatten_pairs(coords: Column) -> Column:
    """The first two ordinates of each position, one after the other."""
    return F.flatten(F.transform(coords, lambda p: F.slice(p, 1, 2)))


def heights(coords: Column) -> Column:
    """The third ordinate of each position that has one."""
    return F.transform(F.filter(coords, lambda p: F.size(p) > 2), lambda p: p[2])


def pairs(xy: Column, z: Column | None = None) -> Column:
    """A flat coordinate array as [[x, y], …], with z if given and not null."""
    n = F.floor(F.size(xy) / 2).cast("int")
    at = lambda a, i: F.try_element_at(a, i + 1)
    plain = lambda i: F.array(at(xy, 2 * i), at(xy, 2 * i + 1))
    each = plain if z is None else lambda i: F.when(z.isNotNull(), F.array(at(xy, 2 * i), at(xy, 2 * i + 1), at(z, i))).otherwise(plain(i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), each)).when(n == 0, F.array().cast("array<array<double>>"))


def ring_ends(lengths: Column) -> Column:
    """Running sums of ring lengths."""
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array((F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), acc), -1), F.lit(0)) + n).cast("int"))))


def deinterleave(flat: Column, stride: int) -> tuple[Column, list[Column]]:
    """(xy, further ordinates) of a flat array with ``stride`` ordinates per position."""

    def ordinate(k: int) -> Column:
        return F.filter(flat, lambda v, i: i % stride == k)

    return F.filter(flat, lambda v, i: i % stride < 2), [ordinate(k) for k in range(2, stride)]


def interleave(xy: Column, *more: Column) -> Column:
    """One flat array from xy and further ordinates."""
    n = F.floor(F.size(xy) / 2).cast("int")
    each = lambda i: F.array(F.try_element_at(xy, 2 * i + 1), F.try_element_at(xy, 2 * i + 2), *(F.try_element_at(m, i + 1) for m in more))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), each))).when(n == 0, F.array().cast(_NONE))


def layout(geom: Column) -> Column:
    """XY, XYZ, XYM or XYZM."""
    return F.concat(F.lit("XY"), F.when(geom["z"].isNotNull(), "Z").otherwise(""), F.when(geom["m"].isNotNull(), "M").otherwise(""))


def _at_least_xy(g: Column) -> Column:
    return g["type"].isin(1, 2, 3, 4, 5) & g["xy"].isNotNull()


def _flat_coordinates(g: Column) -> Column:
    """All ordinates of a geometry without parts, position by position, in its layout."""
    z, m = g["z"], g["m"]
    both, one = z.isNotNull() & m.isNotNull(), F.coalesce(z, m)
    return F.when(both, interleave(g["xy"], z, m)).when(one.isNotNull(), interleave(g["xy"], one)).otherwise(g["xy"])


def _stride(g: Column) -> Column:
    return F.lit(2) + g["z"].isNotNull().cast("int") + g["m"].isNotNull().cast("int")


def _flat_ends(g: Column) -> Column:
    stride = _stride(g)
    return F.when(F.size(g["ends"]) > 0, F.transform(g["ends"], lambda e: e * stride)).otherwise(F.array(F.size(_flat_coordinates(g))))


def laid_out(geom: Column) -> Column:
    """struct<type: string, layout: string, flat: array<double>, ends: array<int>, polygons: array<struct<flat, ends>>>: a geometry as a map library takes it.

    ``flat`` has all ordinates position by position in the layout; ``ends``, counted in ordinates, close the rings of polygons and the lines of several (one end if there are none); a multi-polygon
    has the ``polygons`` of its parts instead. Null for any other type, and for a geometry without coordinates.
    """
    name = F.try_element_at(F.create_map(*(F.lit(x) for pair in GEOMETRY_NAMES.items() for x in pair)), geom["type"].cast("int"))
    nothing, no_ends = F.lit(None).cast(_NONE), F.lit(None).cast("array<int>")
    polygons = F.transform(geom["parts"], lambda p: F.struct(_flat_coordinates(p).alias("flat"), _flat_ends(p).alias("ends")))
    first = F.try_element_at(geom["parts"], F.lit(1))
    no_polygons = F.lit(None).cast("array<struct<flat:array<double>,ends:array<int>>>")
    fields = lambda lay, flat, ends, polys: F.struct(name.alias("type"), lay.alias("layout"), flat.alias("flat"), ends.alias("ends"), polys.alias("polygons"))
    return F.when(
        _at_least_xy(geom), fields(layout(geom), _flat_coordinates(geom), F.when(geom["type"].isin(3, 5), _flat_ends(geom)).otherwise(no_ends), no_polygons)
    ).when((geom["type"] == 6) & geom["parts"].isNotNull(), fields(F.coalesce(layout(first), F.lit("XY")), nothing, no_ends, polygons))


def split_layout(flat: Column, layout_name: Column, ends: Column) -> Column:
    """struct<xy, z, m, ends>: the reverse of ``laid_out`` for flat coordinates: ordinates taken apart by layout, ends counted in positions again."""
    stride = F.length(layout_name)
    n = F.floor(F.size(flat) / stride).cast("int")
    pick = lambda k: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(flat, i * stride + k))
    some = lambda c: F.when(n > 0, c).otherwise(F.array().cast(_NONE))
    has_z = F.substring(layout_name, 3, 1) == "Z"
    has_m = F.substring(layout_name, -1, 1) == "M"
    return F.struct(
        some(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(flat, i * stride), F.get(flat, i * stride + 1))))).alias("xy"),
        F.when(has_z, some(pick(F.lit(2)))).alias("z"),
        F.when(has_m, some(pick(stride - 1))).alias("m"),
        F.transform(ends, lambda e: F.floor(e / stride).cast("int")).alias("ends"),
    )


def render_feature(geom: Column, strict: bool = True) -> Column:
    """struct<type: string, flat: array<double>, ends: array<int>, stride: int>: a geometry flattened for drawing.

    A multi-polygon is drawn as a polygon of all its rings; there is one end, that of the coordinates. A geometry without coordinates and a geometry collection can't be drawn: an error, or null
    unless ``strict``.
    """
    of_parts = F.flatten(F.transform(geom["parts"], _flat_coordinates))
    first = F.try_element_at(geom["parts"], F.lit(1))
    flat = F.when(geom["type"] == 6, of_parts).when(_at_least_xy(geom), _flat_coordinates(geom))
    stride = F.when(geom["type"] == 6, _stride(first)).otherwise(_stride(geom))
    kind = F.when(geom["type"] == 6, F.lit("Polygon")).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for pair in GEOMETRY_NAMES.items() for x in pair)), geom["type"].cast("int")))
    out = F.struct(kind.alias("type"), flat.alias("flat"), F.array(F.size(flat)).alias("ends"), stride.alias("stride"))
    drawn = F.when(flat.isNotNull(), out)
    return drawn if not strict else F.coalesce(drawn, F.raise_error(F.lit("a geometry that can't be drawn")).cast("struct<type:string,flat:array<double>,ends:array<int>,stride:int>"))


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Whether a polygon or multi-polygon holds a point, by the parity of ring edges west of it (so holes are outside, and of a shared edge one side has it); false for other types and nulls.

    Each edge counts from its lower end, inclusive, to its upper, exclusive. Rings are closed if they are not.
    """

    def crossings(xy: Column, ends: Column) -> Column:
        n = F.floor(F.size(xy) / 2).cast("int")
        cuts = F.when(F.size(ends) > 0, ends).otherwise(F.array(n))
        ring = lambda e, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)).alias("a"), e.alias("b"))

        def edge(i: Column, r: Column) -> Column:
            j = F.when(i + 1 < r["b"], i + 1).otherwise(r["a"])
            x1, y1, x2, y2 = F.get(xy, 2 * i), F.get(xy, 2 * i + 1), F.get(xy, 2 * j), F.get(xy, 2 * j + 1)
            return (((y1 <= y) & (y < y2)) | ((y2 <= y) & (y < y1))) & (x1 + (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1) < x)

        count = lambda r: F.when(r["b"] > r["a"], F.size(F.filter(F.sequence(r["a"], r["b"] - 1), lambda i: edge(i, r)))).otherwise(F.lit(0))
        return F.aggregate(F.transform(cuts, ring), F.lit(0), lambda s, r: s + count(r))

    own = F.when((geom["type"] == 3) & geom["xy"].isNotNull(), crossings(geom["xy"], geom["ends"]))
    parts = F.when((geom["type"] == 6) & geom["parts"].isNotNull(), F.aggregate(geom["parts"], F.lit(0), lambda s, p: s + F.coalesce(crossings(p["xy"], p["ends"]), F.lit(0))))
    return F.coalesce(F.coalesce(own, parts) % 2 == 1, F.lit(False))


def rings(geom: Column) -> Column:
    """The flat xy of each ring or line."""
    ends = F.when(F.size(geom["ends"]) > 0, geom["ends"]).otherwise(F.array(F.floor(F.size(geom["xy"]) / 2).cast("int")))
    return F.transform(ends, lambda e, i: F.slice(geom["xy"], F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(ends, i)) * 2 + 1, (e - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(ends, i))) * 2))


def rect_polygon(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The closed ring of a rectangle, counter-clockwise from its lower left corner; null if a bound is null or NaN: such a rectangle holds nothing."""
    whole = minx.isNotNull() & miny.isNotNull() & maxx.isNotNull() & maxy.isNotNull() & ~(F.isnan(minx) | F.isnan(miny) | F.isnan(maxx) | F.isnan(maxy))
    return F.when(whole, _ring(minx, miny, maxx, maxy))


def _ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(F.array(minx, miny), F.array(maxx, miny), F.array(maxx, maxy), F.array(minx, maxy), F.array(minx, miny))


def meets(box: Column, minx, miny, maxx, maxy, finite: bool = False) -> Column:
    """Closed boxes meet. As in comparisons of floating-point numbers proper, a NaN bound never excludes; a null box, or one with a null bound, does not meet.

    ``finite`` says that no bound is NaN: then it is a conjunction of plain comparisons, which a Parquet scan takes over. It has to be said, as the statistics of Parquet files don't tell.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    if finite:
        return (box["minx"] <= lit(maxx)) & (box["miny"] <= lit(maxy)) & (box["maxx"] >= lit(minx)) & (box["maxy"] >= lit(miny))
    apart = lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (a < b)
    out = ~(apart(lit(maxx), box["minx"]) | apart(lit(maxy), box["miny"]) | apart(box["maxx"], lit(minx)) | apart(box["maxy"], lit(miny)))
    return F.coalesce(out, F.lit(False))


def geometry_bbox(geom: Column) -> Column:
    """The box of all coordinates of a geometry struct that are numbers, parts included; null without any."""
    none = F.array().cast(_NONE)
    parts = F.flatten(F.transform(geom["parts"], lambda p: F.coalesce(p["xy"], none)))
    xy = F.concat(F.coalesce(geom["xy"], none), F.coalesce(parts, none))
    axis = lambda k: F.filter(xy, lambda v, i: (i % 2 == k) & v.isNotNull() & ~F.isnan(v))
    xs, ys = axis(0), axis(1)
    box = F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    return F.when((F.size(xs) > 0) & (F.size(ys) > 0), box)


def point_geojson(geom: Column) -> Column:
    """GeoJSON of a Point."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.concat(geom["xy"], F.coalesce(F.slice(geom["z"], 1, 1), F.array().cast(_NONE))).alias("coordinates")))


def _flat(coordinates, xy: list, z: list) -> None:
    """Positions at any depth; further ordinates than the third are dropped."""
    stack = [coordinates]
    while stack:
        c = stack.pop()
        if c and not isinstance(c[0], list):
            xy += [float(c[0]), float(c[1])]
            if len(c) > 2:
                z.append(float(c[2]))
        else:
            stack.extend(reversed(c))


def from_geojson_object(g: dict) -> dict:
    """A geometry struct (parts may nest) from a GeoJSON geometry. Heights of only some positions are filled with NaN."""
    kind = g["type"]
    out: dict = {"type": GEOMETRY_TYPES[kind], "xy": None, "z": None, "m": None, "ends": None, "parts": None, "within": None}
    if kind == "GeometryCollection":
        out["parts"] = [from_geojson_object(x) for x in g["geometries"]]
    elif kind == "MultiPolygon":
        out["parts"] = [from_geojson_object({"type": "Polygon", "coordinates": c}) for c in g["coordinates"]]
    else:
        c = g["coordinates"]
        xy: list = []
        z: list = []
        _flat(c, xy, z)
        if z and 2 * len(z) != len(xy):
            z = []
            for p in _positions(c):
                z.append(float(p[2]) if len(p) > 2 else float("nan"))
        out["xy"], out["z"] = xy, z or None
        if kind in ("Polygon", "MultiLineString") and len(c) > 1:
            end, out["ends"] = 0, []
            for ring in c:
                end += len(ring)
                out["ends"].append(end)
    return out


def _positions(c) -> Iterable[list]:
    if c and not isinstance(c[0], list):
        yield c
    else:
        for x in c:
            yield from _positions(x)


def to_geojson_object(g: dict) -> dict:
    """The GeoJSON geometry of a geometry struct; types without one have null coordinates."""
    name, parts = GEOMETRY_NAMES.get(g["type"] or 0, "Unknown"), g.get("parts")
    if name == "GeometryCollection":
        return {"type": name, "geometries": [to_geojson_object(p) for p in parts or ()]}
    if name == "MultiPolygon":
        return {"type": name, "coordinates": [to_geojson_object({**p, "type": 3})["coordinates"] for p in parts or ()]}
    xy, z = g.get("xy") or [], g.get("z")
    points = [[*xy[i : i + 2], *([z[i // 2]] if z else [])] for i in range(0, len(xy) - 1, 2)]
    if name == "Point":
        return {"type": name, "coordinates": points[0] if points else []}
    if name in ("MultiPoint", "LineString"):
        return {"type": name, "coordinates": points}
    if name in ("Polygon", "MultiLineString"):
        cuts = [0, *(g.get("ends") or [len(points)])]
        return {"type": name, "coordinates": [points[a:b] for a, b in zip(cuts, cuts[1:])]}
    return {"type": name, "coordinates": None}


#: What broken GeoJSON raises: also ordinates beyond all numbers and nesting beyond the stack
BROKEN = (ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError, OverflowError)


def from_geojson(text: Column) -> Column:
    """A geometry struct from GeoJSON text, null for null or broken text. Collections in collections and multi-polygons in them keep their places (``within``)."""

    @F.arrow_udf(GEOMETRY)
    def parse(texts: pa.Array) -> pa.Array:
        from vertexloom.operators.shred import parse as parse_json
        from vertexloom.sources.codec import flat_parts

        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else flat_parts(from_geojson_object(parse_json(t)[1])))
            except BROKEN:
                out.append(None)
        return pa.array(out, arrow_geometry())

    return parse(text)


def _points(g: Column) -> Column:
    return F.coalesce(pairs(g["xy"], F.when(F.size(g["z"]) > 0, g["z"])), F.array().cast("array<array<double>>"))


def _lines(g: Column) -> Column:
    """The positions of each ring or line."""
    points = _points(g)
    cuts = F.when(F.size(g["ends"]) > 0, g["ends"]).otherwise(F.array(F.size(points)))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1))
    return F.transform(cuts, lambda e, i: F.slice(points, start(i) + 1, F.greatest(e - start(i), F.lit(0))))


def _flat_json(g: Column) -> Column:
    """GeoJSON of a geometry without parts."""
    text = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    kind = g["type"]
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in GEOMETRY_NAMES.items() for x in pair)), kind.cast("int")), F.lit("Unknown"))
    return (
        F.when(kind == 1, text("Point", F.coalesce(F.get(_points(g), 0), F.array().cast(_NONE))))
        .when(kind == 2, text("LineString", _points(g)))
        .when(kind == 3, text("Polygon", _lines(g)))
        .when(kind == 4, text("MultiPoint", _points(g)))
        .when(kind == 5, text("MultiLineString", _lines(g)))
        .otherwise(F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":null}')))
    )


def _collection_json(geom: Column, nests: bool) -> Column:
    """GeoJSON of a collection, in the JVM. Parts are written from the last to the first, each in front of what its holder has so far."""
    parts = F.coalesce(geom["parts"], F.array().cast("array<struct<type:tinyint,xy:array<double>,z:array<double>,m:array<double>,ends:array<int>>>"))
    n = F.size(parts)
    of = (lambda i: F.coalesce(F.get(geom["within"], i), F.lit(-1))) if nests else (lambda i: F.lit(-1))
    slot = lambda i: F.when(of(i) < 0, n).otherwise(of(i))

    def step(held: Column, i: Column) -> Column:
        p, inner, holder = F.get(parts, i), F.get(held, i), F.get(parts, of(i))["type"]
        holds = F.when(p["type"] == 7, F.concat(F.lit('{"type":"GeometryCollection","geometries":['), inner, F.lit("]}")))
        holds = holds.when((p["type"] == 6) & p["xy"].isNull(), F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), inner, F.lit("]}")))
        text = holds.when(F.coalesce(holder == 6, F.lit(False)), F.to_json(_lines(p))).otherwise(_flat_json(p))
        return F.transform(held, lambda x, k: F.when(k == slot(i), F.when(x == "", text).otherwise(F.concat(text, F.lit(","), x))).otherwise(x))

    each = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    members = F.get(F.aggregate(each, F.array_repeat(F.lit(""), n + 1), step), n)
    return F.concat(F.lit('{"type":"GeometryCollection","geometries":['), members, F.lit("]}"))


def to_geojson(geom: Column, kind: T.StructType | None = None) -> Column:
    """GeoJSON text of a geometry struct, in the JVM; types without one have null coordinates. NaN ordinates are written as the text "NaN". ``kind`` is the column's type where it lacks ``within``."""
    nests = kind is None or "within" in kind.names
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.coalesce(F.transform(geom["parts"], _lines), F.array().cast("array<array<array<array<double>>>>")).alias("coordinates")))
    return F.when(geom["type"] == 6, multi).when(geom["type"] == 7, _collection_json(geom, nests)).when(geom.isNotNull(), _flat_json(geom))


def same_shape(a: Column, b: Column, deep: bool = False) -> Column:
    """Both geometries have the same type, xy, z, ends and parts; NaN equals NaN, null only null. Measures (m), which GeoJSON has no place for, aren't compared; ``within`` is if ``deep``."""
    flat = lambda g: [g[c].alias(c) for c in ("type", "xy", "z", "ends")]
    within = lambda g: [g["within"].alias("within")] if deep else []
    whole = lambda g: F.struct(*flat(g), F.transform(g["parts"], lambda p: F.struct(*flat(p))).alias("parts"), *within(g))
    return whole(a).eqNullSafe(whole(b))


def arrow_geometry() -> pa.DataType:
    flat = [("type", pa.int8()), ("xy", pa.list_(pa.float64())), ("z", pa.list_(pa.float64())), ("m", pa.list_(pa.float64())), ("ends", pa.list_(pa.int32()))]
    return pa.struct([*flat, ("parts", pa.list_(pa.struct(flat))), ("within", pa.list_(pa.int32()))])
