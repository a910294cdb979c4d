"""GeoJSON feature collections as vertices, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.functions.geometry import BROKEN, arrow_geometry, from_geojson, from_geojson_object, to_geojson
from vertexloom.operators.shred import parse, unwrap
from vertexloom.sources.codec import flat_parts
from vertexloom.types import COLUMN_TYPES, GEOMETRY, GEOMETRY_TYPES

_FEATURE = "struct<type:string,geometry:string,properties:map<string,string>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, geometry, raw): the features of the collections under ``path``, one collection a file."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return features_of(texts)


def features_of(texts: DataFrame) -> DataFrame:
    """The same from a table of (file, value)."""
    list_ = F.from_json("value", "struct<features:array<string>>")["features"]
    each = texts.select("file", F.posexplode(list_).alias("position", "raw"))
    return each.select("file", F.col("position").cast("bigint").alias("position"), F.get_json_object("raw", "$.geometry").alias("geometry"), "raw")


def _geometry(value) -> tuple[dict | None, str]:
    """(geometry struct, state) of a parsed GeoJSON geometry. A null in a collection is nothing, one object in place of its list is its one member."""
    g = unwrap(value)
    if not isinstance(g, dict):
        return None, "broken"
    if g.get("type") != "GeometryCollection":
        try:
            return flat_parts(from_geojson_object({**g, "coordinates": unwrap(g["coordinates"])})), "geometry"
        except BROKEN:
            return None, "broken"
    parts: list = []
    within: list[int] = []
    broken, found, deep = False, False, False
    todo: list = [(g, -1)]

    def add(part: dict, of: int) -> int:
        parts.append({k: part.get(k) for k in ("type", "xy", "z", "m", "ends")})
        within.append(of)
        return len(parts) - 1

    while todo:
        x, of = todo.pop()
        x = unwrap(x)
        if isinstance(x, dict) and x.get("type") == "GeometryCollection":
            members = unwrap(x.get("geometries"))
            if not isinstance(members, (list, dict)):
                broken = True
                continue
            if x is not g:
                of, deep = add({"type": GEOMETRY_TYPES["GeometryCollection"]}, of), True
            todo.extend((m, of) for m in (reversed(members) if isinstance(members, list) else [members]))
        elif x is not None:
            p, _ = _geometry(x)
            broken, found = broken or p is None, found or p is not None
            if p is not None and p["parts"] is None:
                add(p, of)
            elif p is not None:
                of, deep = add(p, of), True
                for member in p["parts"]:
                    add(member, of)
    if broken and not found:
        return None, "broken"
    return {"type": GEOMETRY_TYPES["GeometryCollection"], "xy": None, "z": None, "m": None, "ends": None, "parts": parts, "within": within if deep else None}, "partial" if broken else "geometry"


def features_in(text: str | None) -> Iterator:
    """The features, or what stands in their place, of a GeoJSON text of any wrapping."""
    todo = [unwrap(parse(text)[1])]
    while todo:
        value = unwrap(todo.pop())
        if isinstance(value, dict) and isinstance(members := unwrap(value.get("features")), (list, dict)):
            value = members if isinstance(members, list) else [members]
        if isinstance(value, list) and value:
            todo.extend(reversed(value))
        else:
            yield value


def geometries_of(text: str | None) -> Iterator[tuple[int, dict | None, str]]:
    """(position, geometry struct, state) of each feature in a GeoJSON text of any wrapping; see ``payload_geometries``."""
    for n, value in enumerate(features_in(text)):
        g, state = None, "broken"
        if isinstance(value, list) or isinstance(value, dict) and (value.get("type") == "Feature" or "geometry" in value) and value.get("geometry") is None:
            state = "none"
        elif isinstance(value, dict):
            g, state = _geometry(value.get("geometry", value))
        yield n, g, state


def payload_geometries(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, geom, state): a row per feature of GeoJSON texts, at least one per text.

    A text is a feature, a collection or list of features, or a bare geometry; a string whose content is an object or list stands for it, at any place. ``state`` is
    geometry, partial (broken members of a geometry collection are left out, the others are there), none (a feature without geometry, an empty collection) or broken (null or unparsable
    text, no GeoJSON, a geometry that isn't one or has no sound member); ``geom`` is null for the last two.
    """
    schema = pa.schema([("id", pa.int64()), ("position", pa.int32()), ("geom", arrow_geometry()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(rid, *x) for x in geometries_of(text)]
                if len(out) > 10_000:
                    yield _rows(out, schema)
                    out = []
            yield _rows(out, schema)

    return rows.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, f"id bigint, position int, geom {GEOMETRY}, state string")


def payload_properties(rows: DataFrame, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """(id, position, properties, carried columns): the properties of each feature of GeoJSON texts in any wrapping as JSON text, null where it has none; positions as in ``payload_geometries``."""
    kept = [rows.schema[c] for c in carried]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("properties", T.StringType()), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where: list[int] = []
            positions: list[int] = []
            texts: list[str | None] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, value in enumerate(features_in(text)):
                    p = unwrap(value.get("properties")) if isinstance(value, dict) else None
                    where.append(i)
                    positions.append(n)
                    texts.append(json.dumps(p) if isinstance(p, dict) else None)
            at = pa.array(where, pa.int32())
            columns = [batch.column(0).take(at), pa.array(positions, pa.int32()), pa.array(texts, pa.string()), *(batch.column(2 + k).take(at) for k in range(len(kept)))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), *carried).mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _code(kind: str) -> int:
    """Column type of a JSON value by its kind: boolean, number, text or null, anything else as Json."""
    return COLUMN_TYPES[{"BOOLEAN": "Bool", "STRING": "String", "VOID": "String", "BIGINT": "Double", "DOUBLE": "Double"}.get(kind, "Double" if kind.startswith("DECIMAL") else "Json")]


def infer_columns(rows: DataFrame, infer: str = "all") -> list[tuple[str, int]]:
    """(name, type code) of the properties.

    ``sample-first``: keys and types of the first feature of the first file, keys seen only later are lost. ``all``: every key;
    kinds that disagree become String. The driver gets one row per key.
    """
    if infer == "sample-first":
        first = rows.orderBy("file", "position").limit(1)
    elif infer == "all":
        first = rows
    else:
        raise ValueError("infer is 'all' or 'sample-first'")
    values = first.select(F.try_parse_json(F.get_json_object("raw", "$.properties")).alias("p"), F.map_keys(F.from_json(F.get_json_object("raw", "$.properties"), "map<string,string>")).alias("keys"))
    kinds = values.select("p", F.posexplode("keys").alias("at", "name"))
    expanded = kinds.select("at", "name", F.expr("try_variant_get(p, '$', 'map<string,variant>')[name]").alias("v"))
    found = expanded.groupBy("name").agg(F.min("at").alias("at"), F.collect_set(F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))).alias("kinds")).orderBy("at", "name").collect()
    out = []
    for r in found:
        codes = {_code(k) for k in r.kinds if k != "VOID"}
        out.append((r.name, COLUMN_TYPES["String"] if len(codes) != 1 else codes.pop()))
    return out


def read_geojson(spark: SparkSession, path: str, infer: str = "all") -> DataFrame:
    """(fid, geom, properties as columns) of the feature collections under ``path``; ``fid`` is the position, over files in the order of their names.

    The features' own ids are ignored. Null properties give nulls; a value that does not fit its column's type gives null.
    """
    rows = features(spark, path)
    columns = infer_columns(rows, infer)
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file").collect()  # a row per file
    starts, n = {}, 0
    for r in counts:
        starts[r.file] = n
        n += r.n
    first = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[F.col("file")] if starts else F.lit(0)
    types = {2: "boolean", 10: "double", 11: "string", 12: "string"}
    props = F.from_json(F.get_json_object("raw", "$.properties"), "map<string,string>")
    fields = [
        props[name].try_cast(types[code]).alias(name, metadata={"type": code}) if code != 11 else props[name].alias(name, metadata={"type": code}) for name, code in columns if name.lower() not in ("fid", "geom")
    ]
    return rows.select((first + F.col("position")).cast("bigint").alias("fid"), from_geojson(F.col("geometry")).alias("geom"), *fields)


def to_features(vertices: DataFrame) -> DataFrame:
    """(fid, feature): each vertex as GeoJSON text with its id and attributes; null attributes are left out, Json columns keep their structure."""
    named = [f for f in vertices.schema.fields if f.name not in ("fid", "geom", "bbox")]
    props = F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in named))) if named else F.lit("{}")
    nested = [f.name for f in named if isinstance(f.dataType, T.StringType) and (f.metadata or {}).get("type") == COLUMN_TYPES["Json"]]
    if nested:
        plain = [f for f in named if f.name not in nested]
        pieces = [F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in plain)))] if plain else []
        pieces += [F.when(F.col(f"`{n}`").isNotNull(), F.concat(F.lit(json.dumps(n)), F.lit(":"), F.col(f"`{n}`"))) for n in nested]
        inner = F.concat_ws(",", *([F.nullif(F.regexp_replace(pieces[0], r"^\{|\}$", ""), F.lit(""))] if plain else []), *pieces[len(pieces) - len(nested) :])
        props = F.concat(F.lit("{"), inner, F.lit("}"))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.col("fid").cast("string"), F.lit(',"geometry":'), F.coalesce(to_geojson(F.col("geom"), vertices.schema["geom"].dataType), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))
    return vertices.select("fid", text.alias("feature"))

