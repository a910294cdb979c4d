"""Codes and Spark types of the data model."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import NamedTuple

from pyspark.sql import types as T

# Geometry type codes (the two-dimensional WKB codes) by name
GEOMETRY_TYPES = {
    "Unknown": 0, "Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7,
    "CircularString": 8, "CompoundCurve": 9, "CurvePolygon": 10, "MultiCurve": 11, "MultiSurface": 12, "Curve": 13, "Surface": 14,
    "PolyhedralSurface": 15, "TIN": 16, "Triangle": 17,
}
GEOMETRY_NAMES = {code: name for name, code in GEOMETRY_TYPES.items()}

# Column type codes by name
COLUMN_TYPES = {
    "Byte": 0, "UByte": 1, "Bool": 2, "Short": 3, "UShort": 4, "Int": 5, "UInt": 6, "Long": 7, "ULong": 8, "Float": 9, "Double": 10,
    "String": 11, "Json": 12, "DateTime": 13, "Binary": 14,
}
COLUMN_NAMES = {code: name for name, code in COLUMN_TYPES.items()}

SPARK_TYPES: dict[int, T.DataType] = {
    0: T.ByteType(), 1: T.ShortType(), 2: T.BooleanType(), 3: T.ShortType(), 4: T.IntegerType(), 5: T.IntegerType(), 6: T.LongType(), 7: T.LongType(),
    8: T.DecimalType(20, 0), 9: T.FloatType(), 10: T.DoubleType(), 11: T.StringType(), 12: T.StringType(), 13: T.StringType(), 14: T.BinaryType(),
}

_PART = "struct<type:tinyint,xy:array<double>,z:array<double>,m:array<double>,ends:array<int>>"
GEOMETRY = f"struct<type:tinyint,xy:array<double>,z:array<double>,m:array<double>,ends:array<int>,parts:array<{_PART}>,within:array<int>>"
BBOX = "struct<minx:double,miny:double,maxx:double,maxy:double>"


def _flat_fields() -> list[T.StructField]:
    doubles = T.ArrayType(T.DoubleType())
    return [T.StructField("type", T.ByteType()), *(T.StructField(n, doubles) for n in ("xy", "z", "m")), T.StructField("ends", T.ArrayType(T.IntegerType()))]


GEOMETRY_TYPE = T.StructType([*_flat_fields(), T.StructField("parts", T.ArrayType(T.StructType(_flat_fields()))), T.StructField("within", T.ArrayType(T.IntegerType()))])
BBOX_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("minx", "miny", "maxx", "maxy")])


class Rect(NamedTuple):
    minx: float
    miny: float
    maxx: float
    maxy: float


@dataclass
class Column:
    """A column of a container, with the metadata the header can hold."""

    name: str
    type: int
    title: str | None = None
    description: str | None = None
    width: int = -1
    precision: int = -1
    scale: int = -1
    nullable: bool = True
    unique: bool = False
    primary_key: bool = False

    def spark_field(self) -> T.StructField:
        return T.StructField(self.name, SPARK_TYPES[self.type], True, {k: v for k, v in asdict(self).items() if v is not None})


@dataclass
class Meta:
    """What the header of a container says."""

    features_count: int = 0
    geometry_type: int = 0
    index_node_size: int = 0
    columns: list[Column] = field(default_factory=list)
    envelope: list[float] | None = None
    name: str | None = None
    crs: dict | None = None  # org, code, name, description, wkt, code_string
    title: str | None = None
    description: str | None = None
    metadata: str | None = None


@dataclass
class GraphMeta:
    """What the header of the graph section says; ``columns`` is None if there are none."""

    edge_count: int
    columns: list[Column] | None


def column_for(f: T.StructField) -> Column:
    """The column under which a Spark field is written: the type in its metadata if that fits, else by Spark type. Decimals beyond ULong go as text."""
    meta = f.metadata or {}
    code = meta.get("type")
    if code is None or SPARK_TYPES.get(code) != f.dataType:
        by_type = {
            T.BooleanType: 2, T.ByteType: 0, T.ShortType: 3, T.IntegerType: 5, T.LongType: 7, T.FloatType: 9, T.DoubleType: 10, T.StringType: 11, T.BinaryType: 14,
            T.TimestampType: 13, T.TimestampNTZType: 13, T.DateType: 13, T.DecimalType: 11, T.StructType: 12, T.ArrayType: 12, T.MapType: 12,
        }
        code = by_type.get(type(f.dataType))
        if code is None:
            raise ValueError(f"no column type for {f.dataType.simpleString()} of {f.name}")
    known = {k: meta[k] for k in ("title", "description", "width", "precision", "scale", "unique", "primary_key") if k in meta}
    return Column(f.name, code, nullable=f.nullable, **known)
