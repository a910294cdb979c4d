"""Queries of the graph engine, each with its SQL: scans and round trips of containers, boxes, geometry functions, graph queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom import streaming
from vertexloom.common import end_salts, salted_join, shared_path, table
from vertexloom.functions import geometry as G
from vertexloom.functions import projection as P
from vertexloom.functions.properties import build_properties, parse_properties
from vertexloom.operators import graph, proximity
from vertexloom.plans.problem_sql import FEATURE_COUNTS
from vertexloom.sources import geojson, graphs, rtree
from vertexloom.sources.bytes import filesystem
from vertexloom.sources.container import Container
from vertexloom.types import COLUMN_TYPES, GEOMETRY_TYPES, Rect, column_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the graph that is written to containers: distinct vertices, edges between two of them --------------------------------------------------------

_V = """V AS (
  SELECT fid AS id, row_number() OVER (ORDER BY fid) - 1 AS fid, name, kind, capacity, recorded_at, geom,
    list_concat(coalesce(geom.xy, []), coalesce(flatten(list_transform(geom.parts, lambda p: coalesce(p.xy, []))), [])) AS xy
  FROM (SELECT DISTINCT ON (fid) * FROM vertices WHERE fid IS NOT NULL ORDER BY fid)
), B AS (
  SELECT * EXCLUDE (xs, ys), CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_min(xs) END AS minx, CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_min(ys) END AS miny,
    CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_max(xs) END AS maxx, CASE WHEN len(xs) > 0 AND len(ys) > 0 THEN list_max(ys) END AS maxy
  FROM (SELECT *, list_filter(xy, lambda v, i: i % 2 = 1 AND NOT isnan(v)) AS xs, list_filter(xy, lambda v, i: i % 2 = 0 AND NOT isnan(v)) AS ys FROM V)
)"""
_E = """E AS (
  SELECT row_number() OVER (ORDER BY e.eid) - 1 AS eid, a.fid AS src, b.fid AS dst, e.properties, e.recorded_at
  FROM (SELECT DISTINCT ON (eid) * FROM edges WHERE eid IS NOT NULL ORDER BY eid) e JOIN V a ON a.id = e.src JOIN V b ON b.id = e.dst WHERE e.src <> e.dst
)"""
# The whole graph: stations are vertices shared by all files
_WHOLE = _V.replace(
    "* FROM vertices WHERE fid IS NOT NULL ORDER BY fid",
    "* FROM (SELECT fid, name, kind, capacity, recorded_at, geom, 0 AS shared FROM vertices UNION ALL SELECT fid, name, NULL, capacity, NULL, geom, 1 FROM stations) WHERE fid IS NOT NULL ORDER BY fid, shared",
)
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_made: dict[tuple, str] = {}


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    columns = ["name", "kind", "capacity", "recorded_at", "geom"]
    rows = table(spark, d, "vertices").where(F.col("fid").isNotNull())
    return rows.groupBy("fid").agg(F.first(F.struct(*columns)).alias("r")).select("fid", "r.*")


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    known = graph_vertices(spark, d).select("fid")
    edges = table(spark, d, "edges").where(F.col("eid").isNotNull() & (F.col("src") != F.col("dst")))
    edges = edges.groupBy("eid").agg(*(F.min(c).alias(c) for c in ("src", "dst", "properties", "recorded_at")))
    return edges.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("eid", "src", "dst", "properties", "recorded_at")


def whole_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and stations, once per ``fid`` (a vertex before a station); stations have no kind and no time of recording."""
    columns = ["name", "kind", "capacity", "recorded_at", "geom"]
    vertices = table(spark, d, "vertices").select("fid", *columns, F.lit(0).alias("_shared"))
    stations = table(spark, d, "stations").select("fid", "name", "capacity", "geom", F.lit(1).alias("_shared"))
    both = vertices.unionByName(stations, allowMissingColumns=True).where(F.col("fid").isNotNull())
    return both.groupBy("fid").agg(F.min_by(F.struct(*columns), "_shared").alias("r")).select("fid", "r.*")


def whole_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between two different existing vertices or stations, once per ``eid`` (the format has no self-loops); hot ends are salted."""
    known = table(spark, d, "vertices").select("fid").union(table(spark, d, "stations").select("fid")).where(F.col("fid").isNotNull()).distinct()
    rows = table(spark, d, "edges").where(F.col("eid").isNotNull() & (F.col("src") != F.col("dst")))
    edges = rows.groupBy("eid").agg(*(F.min(c).alias(c) for c in ("src", "dst", "properties", "recorded_at")))
    hot = end_salts(rows, ["src", "dst"])
    for end in ("src", "dst"):
        edges = salted_join(edges, known.toDF(end), end, F.col("eid"), "left_semi", salts=hot[end])
    return edges.select("eid", "src", "dst", "properties", "recorded_at")


def _folder(spark: SparkSession) -> str:
    """A fresh folder for containers, removed when the application ends."""
    folder = shared_path(spark, "containers")
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    return folder


def container(spark: SparkSession, d: str, node_size: int = 0, whole: bool = False) -> str:
    """The path of the container of the graph (or, ``whole``, of the graph with stations), written once per session and directory."""
    key = (spark.sparkContext.applicationId, d, node_size, whole)
    if key not in _made:
        path = f"{_folder(spark)}/graph.bin"
        vertices, edges = (whole_vertices, whole_edges) if whole else (graph_vertices, graph_edges)
        graphs.write_graph(vertices(spark, d), edges(spark, d), path, 4326, node_size)
        _made[key] = path
    return _made[key]


def _iso(c: str) -> Column:
    return F.col(c).cast("string")


@query(f"WITH {_V} SELECT fid, name, kind, capacity, {_ISO.format('recorded_at')} AS recorded_at, minx, miny, maxx, maxy FROM B")
def vertex_scan(spark, d):
    return graphs.read_vertices(spark, container(spark, d)).select("fid", "name", "kind", "capacity", "recorded_at", "bbox.*")


@query(f"WITH {_V}, {_E} SELECT eid, src, dst, properties, {_ISO.format('recorded_at')} AS recorded_at FROM E")
def edge_scan(spark, d):
    return graphs.read_edges(spark, container(spark, d))


@query(f"WITH {_WHOLE} SELECT fid, name, kind, capacity, {_ISO.format('recorded_at')} AS recorded_at, minx, miny, maxx, maxy FROM B")
def whole_vertex_scan(spark, d):
    return graphs.read_vertices(spark, container(spark, d, whole=True)).select("fid", "name", "kind", "capacity", "recorded_at", "bbox.*")


@query(f"WITH {_WHOLE}, {_E} SELECT eid, src, dst, properties, {_ISO.format('recorded_at')} AS recorded_at FROM E")
def whole_edge_scan(spark, d):
    """All edges between two existing ends, stations included."""
    return graphs.read_edges(spark, container(spark, d, whole=True))


@query(
    f"WITH {_V} SELECT fid, CAST(coalesce(geom.type, -1) AS BIGINT) AS type, len(geom.xy) AS n_xy, len(geom.z) AS n_z, len(geom.m) AS n_m, len(geom.ends) AS n_ends, len(geom.parts) AS n_parts, round(list_sum(list_filter(xy, lambda v: NOT isnan(v))), 8) AS total, geom.ends[1] AS first_end, CAST(list_sum(list_transform(geom.parts, lambda p: len(p.xy))) AS BIGINT) AS n_in_parts FROM V"
)
def geometry_roundtrip(spark, d):
    """Shapes survive the container: sizes of the arrays, null where they are missing and 0 where they are empty, the sum of coordinates, ends and the sizes of parts."""
    rows = graphs.read_vertices(spark, container(spark, d))
    g, none = F.col("geom"), F.array().cast("array<double>")
    size = lambda c: F.when(g[c].isNotNull(), F.size(g[c])).cast("bigint").alias(f"n_{c}")
    xy = F.concat(F.coalesce(g["xy"], none), F.coalesce(F.flatten(F.transform(g["parts"], lambda p: F.coalesce(p["xy"], none))), none))
    total = F.aggregate(F.filter(xy, lambda v: ~F.isnan(v)), F.lit(0.0), lambda a, v: a + v)
    in_parts = F.aggregate(g["parts"], F.lit(0).cast("bigint"), lambda a, p: a + F.size(p["xy"]))
    return rows.select(
        "fid", F.coalesce(g["type"], F.lit(-1)).cast("bigint").alias("type"), *(size(c) for c in ("xy", "z", "m", "ends", "parts")),
        F.when(F.size(F.filter(xy, lambda v: ~F.isnan(v))) > 0, F.round(total, 8)).alias("total"), F.get(g["ends"], 0).alias("first_end"), F.when(F.size(g["parts"]) > 0, in_parts).alias("n_in_parts"),
    )


_TYPED = """
  CAST(l_linenumber AS TINYINT) AS a_byte, CAST(l_linenumber + 200 AS SMALLINT) AS a_ubyte, l_returnflag = 'R' AS a_bool, CAST(-l_linenumber AS SMALLINT) AS a_short, CAST(l_linenumber + 60000 AS INTEGER) AS a_ushort,
  CAST(-l_quantity AS INTEGER) AS an_int, CAST(l_quantity AS BIGINT) + 4000000000 AS a_uint, l_orderkey - 9000000000000000000 AS a_long, CAST(CAST(l_orderkey AS HUGEINT) + 18000000000000000000 AS DECIMAL(20, 0)) AS a_ulong,
  CAST(l_discount AS FLOAT) AS a_float, l_extendedprice AS a_double, nullif(l_linestatus, 'O') AS a_string"""
_TYPE_CODES = {"a_byte": "Byte", "a_ubyte": "UByte", "a_bool": "Bool", "a_short": "Short", "a_ushort": "UShort", "an_int": "Int", "a_uint": "UInt", "a_long": "Long", "a_ulong": "ULong", "a_float": "Float", "a_double": "Double", "a_string": "String", "a_json": "Json", "a_time": "DateTime", "a_binary": "Binary"}


def _typed(rows: DataFrame) -> DataFrame:
    """A column of each type, tagged with its code."""
    c = F.col
    values = {
        "a_byte": c("l_linenumber").cast("tinyint"), "a_ubyte": (c("l_linenumber") + 200).cast("smallint"), "a_bool": c("l_returnflag") == "R", "a_short": (-c("l_linenumber")).cast("smallint"),
        "a_ushort": (c("l_linenumber") + 60000).cast("int"), "an_int": (-c("l_quantity")).cast("int"), "a_uint": c("l_quantity").cast("bigint") + F.lit(4000000000), "a_long": c("l_orderkey") - F.lit(9000000000000000000),
        "a_ulong": (c("l_orderkey").cast("decimal(20,0)") + F.lit("18000000000000000000").cast("decimal(20,0)")).cast("decimal(20,0)"), "a_float": c("l_discount").cast("float"), "a_double": c("l_extendedprice"),
        "a_string": F.nullif("l_linestatus", F.lit("O")), "a_json": F.to_json(F.struct(c("l_linenumber").alias("n"))), "a_time": F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), "a_binary": F.encode("l_returnflag", "UTF-8"),
    }
    return rows.select("eid", "src", "dst", *(v.alias(n, metadata={"type": COLUMN_TYPES[_TYPE_CODES[n]]}) for n, v in values.items()))


_N = "(SELECT count(*) FROM part)"
_LINES = "lines AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS eid FROM lineitem)"


def _part_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The parts as points; ids are positions in the order of keys."""
    parts = graph.renumber(table(spark, d, "part"), "p_partkey")
    x, y = F.lit(-180.0) + (F.col("p_partkey") * 7919 % 36000).cast("double") / 100, F.lit(-90.0) + (F.col("p_partkey") * 104729 % 18000).cast("double") / 100
    nothing = F.lit(None).cast("array<double>")
    geom = F.struct(F.lit(1).cast("tinyint").alias("type"), F.array(x, y).alias("xy"), nothing.alias("z"), nothing.alias("m"), F.lit(None).cast("array<int>").alias("ends"), F.lit(None).alias("parts"))
    return parts.select(F.col("row_id").alias("fid"), geom.alias("geom"), "p_name", "p_size")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """The order lines as edges between parts: source by order, target by part, both folded into 0 … number of parts - 1."""
    n = table(spark, d, "part").count()  # a number in the file's footer
    return table(spark, d, "lineitem").withColumns({"src": F.col("l_orderkey") % n, "dst": F.col("l_partkey") % n})


_FOLDED = f"folded AS (SELECT *, l_orderkey % {_N} AS src, l_partkey % {_N} AS dst FROM lineitem)"


@query(
    f"WITH folded AS (SELECT *, l_orderkey % {_N} AS src, l_partkey % {_N} AS dst FROM lineitem) SELECT src, dst, {_TYPED}, '{{\"n\":' || l_linenumber || '}}' AS a_json, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS a_time, l_returnflag AS a_binary FROM folded WHERE src <> dst"
)
def edge_roundtrip_types(spark, d):
    """A property of every type, written with edges and read back."""
    edges = _typed(_folded(spark, d).where(F.col("src") != F.col("dst")).withColumn("eid", F.lit(None).cast("bigint")))
    path = f"{_folder(spark)}/typed.bin"
    graphs.write_graph(_part_vertices(spark, d), edges, path)
    return graphs.read_edges(spark, path).drop("eid").withColumn("a_binary", F.decode("a_binary", "UTF-8"))


@query(
    "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS fid, CAST(s_nationkey AS TINYINT) AS a_byte, CAST(s_nationkey AS SMALLINT) AS a_ubyte, s_acctbal > 0 AS a_bool, s_suppkey AS a_long, s_acctbal AS a_double, s_name AS a_string, encode(s_name) AS raw, nullif(s_nationkey, 3) AS an_int FROM supplier"
)
def vertex_roundtrip_types(spark, d):
    rows = graph.renumber(table(spark, d, "supplier"), "s_suppkey")
    point = F.from_json(F.lit('{"type":1,"xy":[1.5,2.5]}'), "struct<type:tinyint,xy:array<double>,z:array<double>,m:array<double>,ends:array<int>,parts:array<struct<type:tinyint,xy:array<double>,z:array<double>,m:array<double>,ends:array<int>>>>")
    typed = rows.select(
        F.col("row_id").alias("fid"), point.alias("geom"), F.col("s_nationkey").cast("tinyint").alias("a_byte"), F.col("s_nationkey").cast("smallint").alias("a_ubyte", metadata={"type": 1}),
        (F.col("s_acctbal") > 0).alias("a_bool"), F.col("s_suppkey").alias("a_long"), F.col("s_acctbal").alias("a_double"), F.col("s_name").alias("a_string"), F.encode("s_name", "UTF-8").alias("raw"),
        F.nullif("s_nationkey", F.lit(3)).alias("an_int"),
    )
    path = f"{_folder(spark)}/typed.bin"
    graphs.write_graph(typed, None, path, index_node_size=4)
    back = graphs.read_vertices(spark, path).drop("bbox", "geom")
    return graph.renumber(back.drop("fid"), "a_long").withColumnRenamed("row_id", "fid")


@query(
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS p_name, p_size, p_retailprice FROM part"
)
def property_records(spark, d):
    """Columns to a property record and back, nulls left out."""
    rows = table(spark, d, "part").select("p_partkey", F.struct(F.when(F.col("p_size") > 25, F.col("p_name")).alias("p_name"), "p_size", "p_retailprice").alias("v"))
    columns = [column_for(f) for f in rows.schema["v"].dataType.fields]
    return rows.select("p_partkey", build_properties(F.col("v"), columns).alias("bytes")).select("p_partkey", parse_properties(F.col("bytes"), columns).alias("v")).select("p_partkey", "v.*")


@query(f"WITH {_V} SELECT count(*) AS features_count, CAST(CASE WHEN min(coalesce(geom.type, 0)) = max(coalesce(geom.type, 0)) THEN min(geom.type) ELSE 0 END AS BIGINT) AS geometry_type, CAST(0 AS BIGINT) AS index_node_size, CAST(4 AS BIGINT) AS n_columns, CAST(4326 AS BIGINT) AS crs_code FROM V")
def header_meta(spark, d):
    h = graphs.read_section(spark, container(spark, d), "header")
    big = lambda c, n: c.cast("bigint").alias(n)
    return h.select("features_count", big(F.col("geometry_type"), "geometry_type"), big(F.col("index_node_size"), "index_node_size"), big(F.size("columns"), "n_columns"), big(F.col("crs.code"), "crs_code"))


@query(f"WITH {_V}, {_E} SELECT count(*) AS edge_count, CAST(2 AS BIGINT) AS n_columns FROM E")
def graph_meta(spark, d):
    return graphs.read_section(spark, container(spark, d), "graph_header").select("edge_count", F.size("edge_columns").cast("bigint").alias("n_columns"))


@query("SELECT * FROM (VALUES ('name', 11, true), ('kind', 11, true), ('capacity', 10, true), ('recorded_at', 13, true)) t(name, type, nullable)")
def columns_meta(spark, d):
    h = graphs.read_section(spark, container(spark, d), "header")
    return h.select(F.explode("columns").alias("c")).select("c.name", F.col("c.type").cast("int").alias("type"), "c.nullable")


@query(f"WITH {_V}, {_E} SELECT (SELECT count(*) FROM V) + (SELECT count(*) FROM E) AS n_items")
def item_totals(spark, d):
    """Vertices and edges together, from the headers alone."""
    return _items(spark, container(spark, d))


def _items(spark: SparkSession, path: str) -> DataFrame:
    v = graphs.read_section(spark, path, "header").select("file", "features_count")
    return v.join(graphs.read_section(spark, path, "graph_header"), "file").select((F.col("features_count") + F.col("edge_count")).alias("n_items"))


@query(f"WITH {_WHOLE}, {_E} SELECT (SELECT count(*) FROM V) + (SELECT count(*) FROM E) AS n_items")
def whole_item_totals(spark, d):
    return _items(spark, container(spark, d, whole=True))


@query(f"WITH {_WHOLE}, {_E} SELECT count(*) AS edge_count, CAST(2 AS BIGINT) AS n_columns FROM E")
def whole_graph_meta(spark, d):
    return graphs.read_section(spark, container(spark, d, whole=True), "graph_header").select("edge_count", F.size("edge_columns").cast("bigint").alias("n_columns"))


def forget() -> None:
    """Containers are written anew when they are next asked for."""
    _made.clear()


def directory(spark: SparkSession, d: str, node_size: int = 16) -> str:
    """The path of the whole graph as a directory of containers, written once per session and directory."""
    key = (spark.sparkContext.applicationId, d, node_size, "directory")
    if key not in _made:
        path = shared_path(spark, "graph")
        graphs.write_graph_directory(whole_vertices(spark, d), whole_edges(spark, d), path, 4326, node_size)
        _made[key] = path
    return _made[key]


@query(f"WITH {_WHOLE} SELECT name, kind, capacity, {_ISO.format('recorded_at')} AS recorded_at, minx, miny, maxx, maxy FROM B")
def container_partitioned_scan(spark, d):
    """The vertices of a graph in several containers."""
    return graphs.read_vertices(spark, directory(spark, d)).select("name", "kind", "capacity", "recorded_at", "bbox.*")


@query(f"WITH {_WHOLE}, {_E} SELECT a.name AS src_name, b.name AS dst_name, E.properties, {_ISO.format('E.recorded_at')} AS recorded_at FROM E JOIN V a ON a.fid = E.src JOIN V b ON b.fid = E.dst")
def container_partitioned_edges(spark, d):
    """The edges of a graph in several containers with the names of their ends, which may lie in other files."""
    path = directory(spark, d)
    names = graphs.read_vertices(spark, path, columns=["name"]).select("fid", "name")
    rows = graph.endpoints(graphs.read_edges(spark, path), names, ["name"])
    return rows.select("src_name", "dst_name", "properties", "recorded_at")


# ---- boxes ----------------------------------------------------------------------------------------------------------------------------------------

WINDOW = Rect(-125.0, -35.0, 60.0, 48.0)


def _meets_sql(x0, y0, x1, y1, b="bbox.") -> str:
    apart = lambda a, c: f"(NOT isnan({a}) AND NOT isnan({c}) AND {a} < {c})"
    lit = lambda v: f"CAST({v} AS DOUBLE)"
    return f"coalesce(NOT ({apart(lit(x1), b + 'minx')} OR {apart(lit(y1), b + 'miny')} OR {apart(b + 'maxx', lit(x0))} OR {apart(b + 'maxy', lit(y0))}), false)"


def _boxed(spark: SparkSession, d: str, rect) -> DataFrame:
    return table(spark, d, "vertices").where(G.meets(F.col("bbox"), *rect)).select("fid", "ingested_at")


@query(f"SELECT fid, ingested_at FROM vertices WHERE {_meets_sql(*WINDOW)}")
def bbox_filter(spark, d):
    return _boxed(spark, d, WINDOW)


@query(f"SELECT fid, ingested_at FROM vertices, (SELECT bbox.minx AS x, bbox.maxy AS y FROM vertices WHERE bbox.minx < bbox.maxx AND bbox.miny < bbox.maxy AND NOT isnan(bbox.maxx) AND NOT isnan(bbox.maxy) ORDER BY fid LIMIT 1) WHERE {_meets_sql('x', 'y', 'x', 'y')}")
def bbox_point(spark, d):
    """Boxes over a point: the upper left corner of the first box that is no point itself."""
    b = F.col("bbox")
    boxes = table(spark, d, "vertices").where((b["minx"] < b["maxx"]) & (b["miny"] < b["maxy"]) & ~F.isnan(b["maxx"]) & ~F.isnan(b["maxy"]))
    r = boxes.agg(F.min_by(F.struct(b["minx"].alias("x"), b["maxy"].alias("y")), "fid").alias("r")).collect()[0].r
    return _boxed(spark, d, (r.x, r.y, r.x, r.y))


@query(f"SELECT fid, ingested_at FROM vertices, (SELECT max(bbox.maxx) AS x FROM vertices WHERE NOT isnan(bbox.maxx)) WHERE {_meets_sql('x', -1e9, 1e9, 1e9)}")
def bbox_edge_touch(spark, d):
    """Touching counts: a window that begins where the easternmost box ends."""
    x = table(spark, d, "vertices").where(~F.isnan("bbox.maxx")).agg(F.max("bbox.maxx").alias("x")).collect()[0].x
    return _boxed(spark, d, (x, -1e9, 1e9, 1e9))


@query(f"SELECT fid, ingested_at FROM vertices WHERE {_meets_sql(1e9, 1e9, 2e9, 2e9)}")
def bbox_empty(spark, d):
    return _boxed(spark, d, (1e9, 1e9, 2e9, 2e9))


@query(f"SELECT fid, ingested_at FROM (SELECT fid, ingested_at, {{'minx': CASE WHEN fid % 10 = 0 THEN CAST('NaN' AS DOUBLE) ELSE bbox.minx END, 'miny': bbox.miny, 'maxx': bbox.maxx, 'maxy': bbox.maxy}} AS bbox FROM vertices) WHERE {_meets_sql(*WINDOW)}")
def bbox_nan(spark, d):
    """A NaN bound never excludes (here the left bound of every tenth vertex)."""
    rows = table(spark, d, "vertices").withColumn("bbox", F.col("bbox").withField("minx", F.when(F.col("fid") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("bbox.minx"))))
    return rows.where(G.meets(F.col("bbox"), *WINDOW)).select("fid", "ingested_at")


_IN_WINDOW = f"WITH {_V} SELECT name, capacity, minx, miny FROM B WHERE minx <= {WINDOW.maxx} AND maxx >= {WINDOW.minx} AND miny <= {WINDOW.maxy} AND maxy >= {WINDOW.miny}"


@query(_IN_WINDOW)
def bbox_indexed(spark, d):
    """The window through the packed R-tree: only matching records are read."""
    return graphs.read_vertices(spark, container(spark, d, 16), WINDOW).select("name", "capacity", "bbox.minx", "bbox.miny")


@query(f"WITH {_V} SELECT count(*) AS n_rows, true AS no_more_records, true AS less_than_all FROM B WHERE minx <= {WINDOW.maxx} AND maxx >= {WINDOW.minx} AND miny <= {WINDOW.maxy} AND maxy >= {WINDOW.miny}")
def bbox_ranges(spark, d):
    """What the window makes tasks read: no records but those that meet it and, as NaN never excludes, perhaps some without a box; and fewer bytes than the file has."""
    path = container(spark, d, 16)
    ranges = graphs.read_section(spark, path, "ranges", **dict(zip(("minx", "miny", "maxx", "maxy"), WINDOW)), requestGap=0)
    told = ranges.agg(F.sum("n_records").alias("_n"), (F.sum("n_bytes") < Container(path).layout().end).alias("less_than_all"))
    rows = graphs.read_vertices(spark, path, WINDOW, columns=[]).agg(F.count(F.lit(1)).alias("n_rows"))
    boxless = graphs.read_vertices(spark, path, columns=[]).agg(F.count_if(F.col("bbox").isNull()).alias("_boxless"))
    return rows.join(told, F.lit(True)).join(boxless, F.lit(True)).select("n_rows", F.col("_n").between(F.col("n_rows"), F.col("n_rows") + F.col("_boxless")).alias("no_more_records"), "less_than_all")


@query(_IN_WINDOW)
def bbox_unindexed_fallback(spark, d):
    return graphs.read_vertices(spark, container(spark, d), WINDOW).select("name", "capacity", "bbox.minx", "bbox.miny")


_LEVELS = """
WITH RECURSIVE levels(height, n) AS (
  SELECT 0, (SELECT count(DISTINCT fid) FROM vertices) UNION ALL SELECT height + 1, CAST(ceil(n / 16.0) AS BIGINT) FROM levels WHERE n > 1
)"""


@query(_LEVELS + " SELECT CAST(height AS BIGINT) AS height, CAST((SELECT coalesce(sum(n), 0) FROM levels u WHERE u.height > l.height) AS BIGINT) AS first_node, n AS n_nodes FROM levels l")
def index_level_bounds(spark, d):
    """First node and size of each level of the tree over all vertices, leaves at height 0."""
    n = table(spark, d, "vertices").agg(F.count_distinct("fid").alias("n")).collect()[0].n
    rows = [(h, a, b - a) for h, (a, b) in enumerate(rtree.level_bounds(n, 16))]
    return spark.createDataFrame(rows, "height bigint, first_node bigint, n_nodes bigint")


@query(_LEVELS + " SELECT CAST(40 * sum(n) AS BIGINT) AS n_bytes FROM levels")
def index_tree_size(spark, d):
    n = table(spark, d, "vertices").agg(F.count_distinct("fid").alias("n")).collect()[0].n
    return spark.createDataFrame([(rtree.tree_bytes(n, 16),)], "n_bytes bigint")


@query(_LEVELS.replace("WITH RECURSIVE", f"WITH RECURSIVE {_V},", 1) + " SELECT CAST((SELECT max(height) FROM levels) - height AS BIGINT) AS level, n AS n_nodes, (SELECT min(minx) FROM B) AS minx, (SELECT min(miny) FROM B) AS miny, (SELECT max(maxx) FROM B) AS maxx, (SELECT max(maxy) FROM B) AS maxy FROM levels")
def index_nodes(spark, d):
    """Nodes per level of the index in the container, the root at level 0, and the box around each level, which is that of all vertices."""
    nodes = graphs.read_section(spark, container(spark, d, 16), "index").where("level IS NOT NULL")
    sides = (((F.min if s.startswith("min") else F.max)(F.when(~F.isnan(s), F.col(s)))).alias(s) for s in ("minx", "miny", "maxx", "maxy"))
    return nodes.groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count(F.lit(1)).alias("n_nodes"), *sides)


@query()
def record_lengths(spark, d):
    """Record lengths from the leaves: the next offset less the own. A window over one file's index."""
    leaves = graphs.read_section(spark, container(spark, d, 16), "index")
    low = leaves.groupBy().agg(F.max("level").alias("level"))
    rows = leaves.join(F.broadcast(low), "level").select("level", "node", F.col("offset").cast("bigint").alias("start"))
    return rows.withColumn("n_bytes", F.lead("start").over(Window.partitionBy("level").orderBy("start")) - F.col("start")).select("node", "start", "n_bytes")


@query(f"WITH {_V} SELECT count(*) AS n_records, CAST(0 AS BIGINT) AS n_out_of_place, true AS ends_before_edges FROM V")
def record_spans(spark, d):
    """Record lengths from the leaves lead from each record to the next, and the last to where the file says that the features end."""
    path = container(spark, d, 16)
    c = Container(path)
    leaves = graphs.read_section(spark, path, "index").where(F.col("level") == len(rtree.level_sizes(c.meta.features_count, 16)) - 1)
    spans = record_lengths(spark, d)
    size = c.layout().end - c.features_start
    odd = F.count_if((F.col("n_bytes") < 12) | (F.col("n_bytes") % 8 != 0))
    whole = F.coalesce(F.sum("n_bytes"), F.lit(0)) + F.lit(size) - F.max("start") == F.lit(size)
    last = F.max("start") < F.lit(size)
    return spans.agg(F.count(F.lit(1)).alias("n_records"), odd.alias("n_out_of_place"), (whole & last).alias("ends_before_edges")).join(leaves.agg(F.count(F.lit(1)).alias("_n")), F.col("_n") == F.col("n_records")).drop("_n")


@query("SELECT min(bbox.minx) AS minx, min(bbox.miny) AS miny, max(bbox.maxx) AS maxx, max(bbox.maxy) AS maxy FROM vertices WHERE NOT isnan(bbox.minx) AND NOT isnan(bbox.miny) AND NOT isnan(bbox.maxx) AND NOT isnan(bbox.maxy)")
def envelope(spark, d):
    sides = ("minx", "miny", "maxx", "maxy")
    rows = table(spark, d, "vertices").where(~(F.isnan("bbox.minx") | F.isnan("bbox.miny") | F.isnan("bbox.maxx") | F.isnan("bbox.maxy")))
    return rows.agg(*((F.min if s.startswith("min") else F.max)(f"bbox.{s}").alias(s) for s in sides))


@query("SELECT kind, CAST(CASE WHEN min(coalesce(geom.type, 0)) = max(coalesce(geom.type, 0)) THEN min(coalesce(geom.type, 0)) ELSE 0 END AS INTEGER) AS geometry_type FROM (SELECT 'vertices' AS kind, geom FROM vertices UNION ALL SELECT 'stations', geom FROM stations) GROUP BY kind")
def infer_geometry_type(spark, d):
    out = None
    for name in ("vertices", "stations"):
        one = graph.common_type(table(spark, d, name).select(F.col("geom.type").alias("type"))).select(F.lit(name).alias("kind"), "geometry_type")
        out = one if out is None else out.unionByName(one)
    return out


_DEG_X, _DEG_Y = "CASE WHEN metric THEN degrees({0} / 6378137) ELSE {0} END", "CASE WHEN metric THEN degrees(2 * atan(exp({0} / 6378137)) - pi() / 2) ELSE {0} END"
_DEGREES = ", ".join(f"{f}({(_DEG_X if n[0] == 'x' else _DEG_Y).format('bbox.' + s)}) AS {n}" for f, s, n in (("min", "minx", "x0"), ("min", "miny", "y0"), ("max", "maxx", "x1"), ("max", "maxy", "y1")))


@query(f"SELECT region_id, fid FROM (SELECT DISTINCT region_id, minx, miny, maxx, maxy FROM regions) r JOIN (SELECT fid, {_DEGREES} FROM vertices LEFT JOIN (SELECT DISTINCT file_id, true AS metric FROM file_header WHERE crs.code = 3857) USING (file_id) WHERE NOT isnan(bbox.minx) AND NOT isnan(bbox.miny) AND NOT isnan(bbox.maxx) AND NOT isnan(bbox.maxy) GROUP BY fid) ON x0 BETWEEN -180 AND 180 AND x1 BETWEEN -180 AND 180 AND y0 BETWEEN -90 AND 90 AND y1 BETWEEN -90 AND 90 AND x0 <= x1 AND y0 <= y1 AND minx <= maxx AND NOT isnan(minx) AND NOT isnan(miny) AND NOT isnan(maxx) AND NOT isnan(maxy) AND x0 <= maxx AND x1 >= minx AND y0 <= maxy AND y1 >= miny")
def spatial_join_rects(spark, d):
    """All regions against all vertex boxes in degrees: those of files in Web Mercator are projected. Boxes off the globe meet nothing."""
    sides = ("minx", "miny", "maxx", "maxy")
    rows = table(spark, d, "vertices").where(~(F.isnan("bbox.minx") | F.isnan("bbox.miny") | F.isnan("bbox.maxx") | F.isnan("bbox.maxy")))
    rows = rows.join(proximity.metric_files(table(spark, d, "file_header")), "file_id", "left")
    degrees = lambda s: F.when(F.col("metric"), (P.to_lon if s[-1] == "x" else P.to_lat)(F.col(f"bbox.{s}"))).otherwise(F.col(f"bbox.{s}"))
    boxes = rows.groupBy(F.col("fid").alias("box_id")).agg(*((F.min if s.startswith("min") else F.max)(degrees(s)).alias(s) for s in sides))
    on_globe = F.col("minx").between(-180.0, 180.0) & F.col("maxx").between(-180.0, 180.0) & F.col("miny").between(-90.0, 90.0) & F.col("maxy").between(-90.0, 90.0)
    boxes = boxes.where(on_globe)
    rects = table(spark, d, "regions").where("region_id IS NOT NULL").select(F.col("region_id").alias("rect_id"), "minx", "miny", "maxx", "maxy").distinct()
    return proximity.boxes_meet(boxes, rects).select(F.col("rect_id").alias("region_id"), F.col("box_id").alias("fid"))


# ---- geometry functions ---------------------------------------------------------------------------------------------------------------------------

_EMB = "(SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS xy FROM embeddings)"


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("xy"))


def _dot(a: Column) -> Column:
    """A number that depends on all values and their order."""
    return F.round(F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 6)


_DOT = "round(list_sum(list_transform({0}, lambda v, i: v * i)), 6)"


@query(f"SELECT vec_id, CAST(len(xy) AS BIGINT) AS n, {_DOT.format('xy')} AS total FROM {_EMB}")
def coords_flatten(spark, d):
    """Positions flattened to one array (here pairs made of it before)."""
    return _flat(spark, d).select("vec_id", G.flatten_pairs(G.pairs(F.col("xy"))).alias("f")).select("vec_id", F.size("f").cast("bigint").alias("n"), _dot(F.col("f")).alias("total"))


@query(f"SELECT vec_id, CAST(len(xy) // 2 AS BIGINT) AS n_pairs, xy[3] AS x2, xy[4] AS y2 FROM {_EMB}")
def coords_pairs(spark, d):
    return _flat(spark, d).select("vec_id", G.pairs(F.col("xy")).alias("p")).select("vec_id", F.size("p").cast("bigint").alias("n_pairs"), F.col("p")[1][0].alias("x2"), F.col("p")[1][1].alias("y2"))


@query("SELECT vec_id, CAST(label + 4 AS BIGINT) AS e1, CAST(2 * label + 9 AS BIGINT) AS e2, CAST(3 * label + 15 AS BIGINT) AS e3 FROM embeddings")
def ring_ends(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", G.ring_ends(F.array(F.col("label") + 4, F.col("label") + 5, F.col("label") + 6)).alias("e"))
    return rows.select("vec_id", *(F.col("e")[i].cast("bigint").alias(f"e{i + 1}") for i in range(3)))


@query(f"SELECT vec_id, {_DOT.format('list_filter(xy, lambda v, i: (i - 1) % 3 < 2)')} AS xy_total, {_DOT.format('list_filter(xy, lambda v, i: (i - 1) % 3 = 2)')} AS z_total FROM {_EMB}")
def deinterleave_z(spark, d):
    xy, (z,) = G.deinterleave(F.col("xy"), 3)
    return _flat(spark, d).select("vec_id", _dot(xy).alias("xy_total"), _dot(z).alias("z_total"))


@query(f"SELECT vec_id, {_DOT.format('list_filter(xy, lambda v, i: (i - 1) // 4 < len(xy) // 4)')} AS total FROM {_EMB}")
def interleave_zm(spark, d):
    """Four ordinates taken apart and put together again."""
    whole = F.slice("xy", 1, F.floor(F.size("xy") / 4).cast("int") * 4)
    xy, (z, m) = G.deinterleave(whole, 4)
    return _flat(spark, d).select("vec_id", _dot(G.interleave(xy, z, m)).alias("total"))


@query(f"SELECT vec_id, {_DOT.format('list_filter(xy, lambda v, i: (i - 1) // 3 < len(xy) // 3)')} AS total FROM {_EMB}")
def interleave_z(spark, d):
    whole = F.slice("xy", 1, F.floor(F.size("xy") / 3).cast("int") * 3)
    xy, (z,) = G.deinterleave(whole, 3)
    return _flat(spark, d).select("vec_id", _dot(G.interleave(xy, z)).alias("total"))


@query("SELECT fid, len(geom.ends) AS n_rings, geom.ends[1] * 2 AS n_first FROM vertices WHERE geom.type = 3 AND len(geom.ends) > 1")
def ring_slices(spark, d):
    """Rings of polygons cut at their ends."""
    rows = table(spark, d, "vertices").where("geom.type = 3 AND size(geom.ends) > 1").select("fid", G.rings(F.col("geom")).alias("r"))
    return rows.select("fid", F.size("r").cast("bigint").alias("n_rings"), F.size(F.col("r")[0]).alias("n_first"))


@query("SELECT fid, 'XY' || CASE WHEN geom.z IS NULL THEN '' ELSE 'Z' END || CASE WHEN geom.m IS NULL THEN '' ELSE 'M' END AS layout, count(*) AS n_rows FROM vertices WHERE geom IS NOT NULL GROUP BY ALL")
def coordinate_layout(spark, d):
    return table(spark, d, "vertices").where("geom IS NOT NULL").select("fid", G.layout(F.col("geom")).alias("layout")).groupBy("fid", "layout").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT fid, ingested_at, 'Point' AS type, geom.xy[1] AS x, geom.xy[2] AS y, geom.z[1] AS z FROM vertices WHERE geom.type = 1 AND len(geom.xy) = 2 AND NOT isnan(geom.xy[1]) AND NOT isnan(geom.xy[2])")
def geojson_point(spark, d):
    """Points to GeoJSON and its members back."""
    rows = table(spark, d, "vertices").where("geom.type = 1 AND size(geom.xy) = 2 AND NOT isnan(get(geom.xy, 0)) AND NOT isnan(get(geom.xy, 1))").select("fid", "ingested_at", G.point_geojson(F.col("geom")).alias("g"))
    at = lambda i: F.get_json_object("g", f"$.coordinates[{i}]").cast("double")
    return rows.select("fid", "ingested_at", F.get_json_object("g", "$.type").alias("type"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query()
def geojson_parse(spark, d):
    """Geometries of the raw features as structs, a row per feature; null where there is none or it is broken, as ``state`` says."""
    rows = geojson.payload_geometries(table(spark, d, "raw_features"), "raw_id", "payload")
    sizes = (F.size(f"geom.{c}").alias(f"n_{c}") for c in ("xy", "ends", "parts"))
    return rows.select(F.col("id").alias("raw_id"), "position", "state", F.col("geom.type").cast("int").alias("type"), *sizes)


@query(FEATURE_COUNTS)
def geojson_feature_counts(spark, d):
    """Features per payload, and those without a geometry."""
    rows = geojson.payload_geometries(table(spark, d, "raw_features"), "raw_id", "payload")
    return rows.groupBy(F.col("id").alias("raw_id")).agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("state") == "none").alias("n_none"))


@query("SELECT fid, count(*) AS n_rows FROM vertices WHERE geom IS NOT NULL GROUP BY fid")
def geojson_roundtrip(spark, d):
    """Geometries to GeoJSON and back; rows whose coordinates come back unchanged."""
    rows = table(spark, d, "vertices").where("geom IS NOT NULL")
    # Generated, so that the text is a column: Spark doesn't take a Python function over lambdas within lambdas.
    rows = rows.withColumn("text", F.explode(F.array(G.to_geojson(F.col("geom"), rows.schema["geom"].dataType)))).withColumn("back", G.from_geojson(F.col("text")))
    return rows.where(G.same_shape(F.col("geom"), F.col("back"))).groupBy("fid").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT fid, name, CAST(coalesce(geom.type, -1) AS INTEGER) AS type FROM (SELECT DISTINCT ON (fid) * FROM stations ORDER BY fid)")
def geojson_features(spark, d):
    """Stations as GeoJSON features and read from there again."""
    rows = table(spark, d, "stations").groupBy("fid").agg(F.first(F.struct("geom", "name", "capacity")).alias("r")).select("fid", "r.*")
    out = geojson.to_features(rows)
    code = G.type_code(F.get_json_object("feature", "$.geometry.type"))
    return out.select(F.get_json_object("feature", "$.id").cast("bigint").alias("fid"), F.get_json_object("feature", "$.properties.name").alias("name"), F.coalesce(code, F.lit(-1)).alias("type"))


_NAMES = "CASE {0} " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in GEOMETRY_TYPES.items()) + " END"
_INTERLEAVED = "flatten(list_transform(range(1, len({0}.xy) // 2 + 1), lambda i: [{0}.xy[2 * i - 1], {0}.xy[2 * i]] || CASE WHEN {0}.z IS NULL THEN [] ELSE [{0}.z[i]] END || CASE WHEN {0}.m IS NULL THEN [] ELSE [{0}.m[i]] END))"
_REAL = "list_transform({0}, lambda v: CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE v END)"
_DOT3 = "CASE WHEN len({0}) = 0 THEN 0.0 ELSE " + _DOT.replace(", 6)", ", 3)") + " END"
_STRIDE = "2 + CAST({0}.z IS NOT NULL AS INTEGER) + CAST({0}.m IS NOT NULL AS INTEGER)"


def _real_dot(a: Column) -> Column:
    real = F.transform(a, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))
    return F.round(F.aggregate(F.transform(real, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 3)


@query(
    f"SELECT fid, ingested_at, type, CAST(len(flat) AS BIGINT) AS n_flat, {_DOT3.format(_REAL.format('flat'))} AS total, CAST(stride AS INTEGER) AS stride FROM (SELECT fid, ingested_at, CASE WHEN geom.type = 6 THEN 'Polygon' ELSE {_NAMES.format('geom.type')} END AS type, CASE WHEN geom.type = 6 THEN flatten(list_transform(geom.parts, lambda p: {_INTERLEAVED.format('p')})) ELSE {_INTERLEAVED.format('geom')} END AS flat, CASE WHEN geom.type = 6 THEN {_STRIDE.format('geom.parts[1]')} ELSE {_STRIDE.format('geom')} END AS stride FROM vertices WHERE geom.type BETWEEN 1 AND 6) WHERE flat IS NOT NULL"
)
def render_features(spark, d):
    """Geometries flattened for drawing: multi-polygons as polygons, all ordinates in one array."""
    rows = table(spark, d, "vertices").select("fid", "ingested_at", G.render_feature(F.col("geom"), strict=False).alias("r")).where("r IS NOT NULL")
    return rows.select("fid", "ingested_at", "r.type", F.size("r.flat").cast("bigint").alias("n_flat"), _real_dot(F.col("r.flat")).alias("total"), F.col("r.stride").cast("int").alias("stride"))


@query(
    f"SELECT fid, ingested_at, {_NAMES.format('geom.type')} AS type, 'XY' || CASE WHEN g.z IS NULL THEN '' ELSE 'Z' END || CASE WHEN g.m IS NULL THEN '' ELSE 'M' END AS layout, CASE WHEN geom.type < 6 THEN {_DOT3.format(_REAL.format(_INTERLEAVED.format('geom')))} END AS total, CASE WHEN geom.type IN (3, 5) THEN CASE WHEN len(geom.ends) > 0 THEN geom.ends[-1] * ({_STRIDE.format('geom')}) ELSE len({_INTERLEAVED.format('geom')}) END END AS last_end, CAST(len(geom.parts) AS BIGINT) AS n_polygons FROM (SELECT *, CASE WHEN geom.type = 6 THEN {{'z': geom.parts[1].z, 'm': geom.parts[1].m}} ELSE {{'z': geom.z, 'm': geom.m}} END AS g FROM vertices WHERE geom.type BETWEEN 1 AND 6)"
)
def laid_out_geometries(spark, d):
    """Geometries put together by layout: flat coordinates, ends counted in ordinates, polygons of multi-polygons."""
    rows = table(spark, d, "vertices").select("fid", "ingested_at", G.laid_out(F.col("geom")).alias("g")).where("g IS NOT NULL")
    return rows.select("fid", "ingested_at", "g.type", "g.layout", _real_dot(F.col("g.flat")).alias("total"), F.try_element_at("g.ends", F.lit(-1)).cast("bigint").alias("last_end"), F.when(F.col("g.polygons").isNotNull(), F.size("g.polygons")).cast("bigint").alias("n_polygons"))


@query(
    f"SELECT fid, ingested_at, CAST(len(geom.xy) // 2 AS BIGINT) AS n, {_DOT3.format(_REAL.format('geom.xy'))} AS xy_total, {_DOT3.format(_REAL.format('geom.z'))} AS z_total, {_DOT3.format(_REAL.format('geom.m'))} AS m_total, geom.ends[1] AS first_end FROM vertices WHERE geom.type IN (2, 3, 5) AND len(geom.xy) > 0"
)
def layout_split(spark, d):
    """Flat coordinates taken apart again by layout, ends counted in positions."""
    g = F.col("geom")
    rows = table(spark, d, "vertices").where(g["type"].isin(2, 3, 5) & (F.size(g["xy"]) > 0)).withColumn("g", G.laid_out(g))
    own = F.when(F.size(g["ends"]) > 0, F.col("g.ends"))
    s = rows.select("fid", "ingested_at", G.split_layout(F.col("g.flat"), F.col("g.layout"), own).alias("s"))
    return s.select("fid", "ingested_at", F.floor(F.size("s.xy") / 2).alias("n"), *(_real_dot(F.col(f"s.{c}")).alias(f"{c}_total") for c in ("xy", "z", "m")), F.get("s.ends", F.lit(0)).alias("first_end"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_property(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"WITH {_V} SELECT count(*) AS n, count(name) AS n_name, count(kind) AS n_kind, count(capacity) AS n_capacity FROM V")
def null_skip(spark, d):
    """Nulls are not written and come back as nulls."""
    return graphs.read_vertices(spark, container(spark, d), columns=["name", "kind", "capacity"]).agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"n_{c}") for c in ("name", "kind", "capacity")))


# ---- projections and windows ----------------------------------------------------------------------------------------------------------------------

_MERC_Y = "greatest(-pi() * 6378137, least(pi() * 6378137, CASE WHEN {0} >= 90 THEN pi() * 6378137 WHEN {0} <= -90 THEN -pi() * 6378137 ELSE 6378137 * ln(tan(pi() / 4 + radians({0}) / 2)) END))"
_SANE = "geom.type = 1 AND geom.xy[1] BETWEEN -180 AND 180 AND geom.xy[2] BETWEEN -89 AND 89"


def _sane(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vertices").where("geom.type = 1 AND get(geom.xy, 0) BETWEEN -180 AND 180 AND get(geom.xy, 1) BETWEEN -89 AND 89")


@query(f"SELECT fid, ingested_at, round(radians(geom.xy[1]) * 6378137, 3) AS x, round({_MERC_Y.format('geom.xy[2]')}, 3) AS y FROM vertices WHERE {_SANE}")
def project_3857(spark, d):
    rows = _sane(spark, d).withColumn("geom", P.geometry_between(F.col("geom"), 4326, 3857))
    return rows.select("fid", "ingested_at", F.round(F.get("geom.xy", F.lit(0)), 3).alias("x"), F.round(F.get("geom.xy", F.lit(1)), 3).alias("y"))


_WHOLE_RECT = "minx IS NOT NULL AND miny IS NOT NULL AND maxx IS NOT NULL AND maxy IS NOT NULL AND NOT isnan(minx) AND NOT isnan(miny) AND NOT isnan(maxx) AND NOT isnan(maxy)"


@query(
    f"SELECT region_id, {', '.join(f'CASE WHEN {_WHOLE_RECT} THEN round({e}, 3) END AS {n}' for e, n in (('radians(minx) * 6378137', 'x0'), (_MERC_Y.format('miny'), 'y0'), ('radians(maxx) * 6378137', 'x1'), (_MERC_Y.format('maxy'), 'y1')))} FROM regions"
)
def extent_to_rect(spark, d):
    """Every region in Web Mercator; nulls for those with a bound that is missing or no number."""
    r = table(spark, d, "regions").select("region_id", P.extent_between(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")), 4326, 3857).alias("r"))
    return r.select("region_id", *(F.round(f"r.{c}", 3).alias(n) for c, n in (("minx", "x0"), ("miny", "y0"), ("maxx", "x1"), ("maxy", "y1"))))


_TILE = "(SELECT event_id, CAST(event_id % 12 AS BIGINT) AS z, user_id % CAST(pow(2, event_id % 12) AS BIGINT) AS x, event_id % CAST(pow(2, event_id % 12) AS BIGINT) AS y FROM events)"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("event_id") % 12
    side = F.pow(F.lit(2.0), z).cast("bigint")
    return table(spark, d, "events").select("event_id", z.alias("z"), (F.col("user_id") % side).alias("x"), (F.col("event_id") % side).alias("y"))


@query(
    f"SELECT event_id, round(-pi() * 6378137 + x * s, 2) AS minx, round(pi() * 6378137 - (y + 1) * s, 2) AS miny, round(-pi() * 6378137 + (x + 1) * s, 2) AS maxx, round(pi() * 6378137 - y * s, 2) AS maxy FROM (SELECT *, 2 * pi() * 6378137 / pow(2, z) AS s FROM {_TILE})"
)
def tile_bbox(spark, d):
    t = _tiles(spark, d)
    return t.select("event_id", *(F.round(c, 2).alias(n) for c, n in zip(P.tile_bbox(F.col("z"), F.col("x"), F.col("y")), ("minx", "miny", "maxx", "maxy"))))


@query(f"SELECT event_id, '[' || z || ',' || x || ',' || y || ']' AS tile FROM {_TILE}")
def tile_key(spark, d):
    return _tiles(spark, d).select("event_id", P.tile_key(F.col("z"), F.col("x"), F.col("y")).alias("tile"))


_TILE_RECT = P.rect_between(P.tile_rect(2, 1, 1), 3857, 4326)


@query(f"WITH {_V} SELECT fid, name FROM B WHERE minx <= {_TILE_RECT.maxx!r} AND maxx >= {_TILE_RECT.minx!r} AND miny <= {_TILE_RECT.maxy!r} AND maxy >= {_TILE_RECT.miny!r}")
def load_tile(spark, d):
    """The vertices of one map tile."""
    return graphs.load_tile(spark, container(spark, d), 2, 1, 1).select("fid", "name")


@query(f"SELECT region_id, {', '.join(f'CASE WHEN {_WHOLE_RECT} THEN {e} END AS {n}' for e, n in (('minx', 'x1'), ('miny', 'y1'), ('maxx', 'x3'), ('maxy', 'y3'), ('CAST(5 AS BIGINT)', 'n')))} FROM regions")
def rect_polygon(spark, d):
    """Regions as closed rings; nulls for those with a bound that is missing or no number."""
    r = table(spark, d, "regions").select("region_id", G.rect_polygon(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("p"))
    p = F.col("p")
    return r.select("region_id", p[0][0].alias("x1"), p[0][1].alias("y1"), p[2][0].alias("x3"), p[2][1].alias("y3"), F.when(p.isNotNull(), F.size("p")).cast("bigint").alias("n"))


# Lower limits (exclusive) of the classes and their colours, and the colour of the rest
BANDS = [(750, "#800026"), (500, "#BD0026"), (250, "#E31A1C"), (100, "#FC4E2A"), (50, "#FD8D3C"), (25, "#FEB24C"), (10, "#FED976")]
LOWEST = "#FFEDA0"


@query("SELECT fid, ingested_at, CASE " + " ".join(f"WHEN v > {n} THEN '{c}'" for n, c in BANDS) + f" ELSE '{LOWEST}' END AS color FROM (SELECT fid, ingested_at, coalesce(capacity, 0) AS v FROM vertices)")
def color_band(spark, d):
    v = F.coalesce("capacity", F.lit(0.0))
    band = F.when(v > BANDS[0][0], BANDS[0][1])
    for n, c in BANDS[1:]:
        band = band.when(v > n, c)
    return table(spark, d, "vertices").select("fid", "ingested_at", band.otherwise(LOWEST).alias("color"))


@query("SELECT fid, ingested_at, round(geom.xy[1] - 0.5, 6) AS minx, round(geom.xy[2] - 0.5, 6) AS miny, round(geom.xy[1] + 0.5, 6) AS maxx, round(geom.xy[2] + 0.5, 6) AS maxy, round(geom.xy[1] - 180 * 500000.0 / 40075017 / cos(radians(geom.xy[2])), 6) AS west FROM vertices WHERE " + _SANE)
def point_buffer_bbox(spark, d):
    """Query windows around points: by degrees and by metres."""
    rows = _sane(spark, d)
    x, y = F.get("geom.xy", F.lit(0)), F.get("geom.xy", F.lit(1))
    return rows.select("fid", "ingested_at", *(F.round(c, 6).alias(n) for c, n in zip(P.buffered(x, y, 0.5), ("minx", "miny", "maxx", "maxy"))), F.round(P.metres_around(x, y, 500_000.0)[0], 6).alias("west"))


@query("SELECT region_id, round((minx + maxx) / 2 - 0.8 * least(maxx - minx, maxy - miny) / 2, 6) AS x0, round((miny + maxy) / 2 + 0.8 * least(maxx - minx, maxy - miny) / 2, 6) AS y1 FROM regions WHERE minx < maxx AND miny < maxy AND NOT isnan(maxx) AND NOT isnan(maxy)")
def inner_square(spark, d):
    rows = table(spark, d, "regions").where("minx < maxx AND miny < maxy AND NOT isnan(maxx) AND NOT isnan(maxy)")
    x0, _, _, y1 = P.inner_square(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return rows.select("region_id", F.round(x0, 6).alias("x0"), F.round(y1, 6).alias("y1"))


@query("SELECT fid, row_number() OVER (ORDER BY fid) - 1 AS row_id FROM (SELECT DISTINCT fid FROM vertices WHERE capacity > 100)")
def renumber_rows(spark, d):
    return graph.renumber(table(spark, d, "vertices").where("capacity > 100 AND fid IS NOT NULL").select("fid").distinct(), "fid").select("fid", "row_id")


@query("SELECT fid, ingested_at, concat_ws(', ', concat_ws(' ', name, kind), CAST(file_id AS VARCHAR)) AS label FROM vertices")
def label_concat(spark, d):
    return table(spark, d, "vertices").select("fid", "ingested_at", F.concat_ws(", ", F.concat_ws(" ", "name", "kind"), F.col("file_id").cast("string")).alias("label"))


# ---- graph ----------------------------------------------------------------------------------------------------------------------------------------

_ALL = "parents AS (SELECT DISTINCT ON (fid) fid, name FROM (SELECT fid, name FROM vertices UNION ALL SELECT fid, name FROM stations) WHERE fid IS NOT NULL ORDER BY fid, name NULLS LAST)"
_WEIGHT = "TRY_CAST(json_extract_string(properties, '$.weight') AS DOUBLE)"


def _all_vertices(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "vertices").select("fid", "name").unionByName(table(spark, d, "stations").select("fid", "name"))
    return both.where("fid IS NOT NULL").groupBy("fid").agg(F.min("name").alias("name"))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").withColumn("weight", F.get_json_object("properties", "$.weight").try_cast("double"))


@query(f"WITH {_ALL} SELECT eid, ingested_at, e.src, e.dst, a.name AS src_name, b.name AS dst_name FROM edges e JOIN parents a ON a.fid = e.src JOIN parents b ON b.fid = e.dst")
def edge_endpoints(spark, d):
    """Every edge row with the names of both ends; salted, as a tenth of the rows share a source."""
    edges = table(spark, d, "edges").select("eid", "ingested_at", "src", "dst")
    return graph.endpoints(edges, _all_vertices(spark, d), ["name"]).select("eid", "ingested_at", "src", "dst", "src_name", "dst_name")


@query(f"WITH {_ALL} SELECT count(*) FILTER (WHERE src IS NULL OR src NOT IN (SELECT fid FROM parents)) AS bad_src, count(*) FILTER (WHERE dst IS NULL OR dst NOT IN (SELECT fid FROM parents)) AS bad_dst FROM edges")
def edge_validate_bounds(spark, d):
    """Edge rows whose ends are no vertex. Keys are counted first, so each is looked up once."""
    known = _all_vertices(spark, d).select(F.col("fid").alias("key"))
    out = []
    for end in ("src", "dst"):
        keys = table(spark, d, "edges").groupBy(F.col(end).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        out.append(keys.join(known, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"bad_{end}")).withColumn("one", F.lit(1)))
    return out[0].join(out[1], "one").drop("one")


@query("SELECT count(*) AS n_loops FROM edges WHERE src = dst")
def edge_self_loops(spark, d):
    return table(spark, d, "edges").where("src = dst").agg(F.count(F.lit(1)).alias("n_loops"))


@query(f"SELECT count(*) AS n_edges, count({_WEIGHT}) AS n_weights, round(sum({_WEIGHT}), 2) AS total FROM edges WHERE {_WEIGHT} IS NOT NULL AND {_WEIGHT} <> 0")
def edge_totals(spark, d):
    """Count and sum over the edges with a weight."""
    rows = _weighted(spark, d).where("weight IS NOT NULL AND weight <> 0")
    return rows.agg(F.count(F.lit(1)).alias("n_edges"), F.count("weight").alias("n_weights"), F.round(F.sum("weight"), 2).alias("total"))


@query(f"SELECT eid, ingested_at FROM edges WHERE {_WEIGHT} IS NOT NULL AND {_WEIGHT} <> 0")
def truthy_filter(spark, d):
    return _weighted(spark, d).where("weight IS NOT NULL AND weight <> 0").select("eid", "ingested_at")


@query("SELECT src AS fid, count(*) AS out_degree FROM edges WHERE src IS NOT NULL GROUP BY src")
def out_degree(spark, d):
    return graph.degrees(table(spark, d, "edges"), "src", "out_degree")


@query("SELECT dst AS fid, count(*) AS in_degree FROM edges WHERE dst IS NOT NULL GROUP BY dst")
def in_degree(spark, d):
    return graph.degrees(table(spark, d, "edges"), "dst", "in_degree")


@query("SELECT src AS fid, count(DISTINCT dst) AS n_neighbours, min(dst) AS first_neighbour FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src")
def adjacency_size(spark, d):
    return graph.neighbour_counts(table(spark, d, "edges"))


@query("SELECT src AS fid, count(DISTINCT dst) AS n_neighbours, CAST(sum(DISTINCT dst) AS BIGINT) AS total FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src")
def adjacency_lists(spark, d):
    """Lists of neighbours, those of hot vertices in pages."""
    lists = graph.adjacency(table(spark, d, "edges"), 1_000).select("fid", F.size("neighbours").alias("n"), F.aggregate("neighbours", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("t"))
    return lists.groupBy("fid").agg(F.sum("n").cast("bigint").alias("n_neighbours"), F.sum("t").alias("total"))


@query(f"WITH {_FOLDED}, pairs AS (SELECT DISTINCT src, dst FROM folded) SELECT a.src, a.dst FROM pairs a JOIN pairs b ON a.src = b.dst AND a.dst = b.src")
def bidirectional_pairs(spark, d):
    return graph.reverse_pairs(_folded(spark, d), "left_semi")


@query(f"WITH {_FOLDED}, pairs AS (SELECT DISTINCT src, dst FROM folded) SELECT a.src, a.dst FROM pairs a LEFT JOIN pairs b ON a.src = b.dst AND a.dst = b.src WHERE b.src IS NULL")
def one_way_edges(spark, d):
    return graph.reverse_pairs(_folded(spark, d), "left_anti")


@query(f"WITH {_FOLDED}, deg AS (SELECT src AS dst, count(*) AS d FROM folded GROUP BY src) SELECT src AS fid, CAST(sum(d) AS BIGINT) AS n_walks FROM folded JOIN deg USING (dst) GROUP BY src")
def hop2_neighbors(spark, d):
    return graph.two_step_walks(_folded(spark, d))


_LINKS = "links AS (SELECT DISTINCT eid, src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), pairs AS (SELECT DISTINCT src, dst FROM links)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """The ends of the edge table, once per ``eid``, edges with a null end left out. A tenth of them share a source."""
    return table(spark, d, "edges").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("eid", "src", "dst").distinct()


@query(f"WITH {_LINKS} SELECT a.src, a.dst FROM pairs a JOIN pairs b ON a.src = b.dst AND a.dst = b.src")
def edge_bidirectional_pairs(spark, d):
    return graph.reverse_pairs(_links(spark, d), "left_semi")


@query(f"WITH {_LINKS} SELECT a.src, a.dst FROM pairs a LEFT JOIN pairs b ON a.src = b.dst AND a.dst = b.src WHERE b.src IS NULL")
def edge_one_way(spark, d):
    return graph.reverse_pairs(_links(spark, d), "left_anti")


@query(f"WITH {_LINKS}, deg AS (SELECT src AS dst, count(*) AS d FROM links GROUP BY src) SELECT src AS fid, CAST(sum(d) AS BIGINT) AS n_walks FROM links JOIN deg USING (dst) GROUP BY src")
def edge_hop2_neighbors(spark, d):
    """Walks of two edges over the edge table, hot keys included."""
    return graph.two_step_walks(_links(spark, d))


@query("SELECT src AS fid, count(*) AS out_degree FROM edges WHERE src IS NOT NULL GROUP BY src ORDER BY out_degree DESC, fid LIMIT 20")
def topk_degree(spark, d):
    return graph.degrees(table(spark, d, "edges"), "src", "out_degree").orderBy(F.desc("out_degree"), "fid").limit(20)


@query(f"SELECT src, eid, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, eid) AS rank FROM (SELECT DISTINCT ON (eid) eid, src, {_WEIGHT} AS weight FROM edges ORDER BY eid) WHERE src IS NOT NULL AND weight IS NOT NULL QUALIFY rank <= 3")
def rank_edges(spark, d):
    once = _weighted(spark, d).groupBy("eid").agg(F.min("src").alias("src"), F.min("weight").alias("weight"))
    return graph.top_edges(once, 3, "weight").select("src", "eid", "weight", "rank")


@query(f"WITH {_V} SELECT least(count(*), 1001) AS n FROM V")
def limit_scan(spark, d):
    """A reader that stops after 1,001 vertices of a container: tasks beyond them aren't run."""
    return graphs.read_vertices(spark, container(spark, d), splitRecords=500).limit(1_001).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_V}, {_E} SELECT 2 * (SELECT count(*) FROM V) AS n_vertices, 2 * (SELECT count(*) FROM E) AS n_edges, (SELECT CAST(sum(src) * 2 + count(*) * (SELECT count(*) FROM V) AS BIGINT) FROM E) AS src_total")
def graph_union(spark, d):
    """A graph put behind itself: ids move, edges follow."""
    return _doubled(graphs.read_graph(spark, container(spark, d)))


def _doubled(g: graphs.GeoGraph) -> DataFrame:
    vertices, edges = graphs.union_graphs(g, g)
    n = vertices.agg(F.count(F.lit(1)).alias("n_vertices")).withColumn("one", F.lit(1))
    return n.join(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("src").alias("src_total")).withColumn("one", F.lit(1)), "one").drop("one")


@query(f"WITH {_V}, {_E} SELECT eid, src, dst FROM E")
def stream_edges(spark, d):
    """The edges of a container as a stream, run to its end."""
    return streaming.drain(streaming.stream_section(spark, container(spark, d)).select("eid", "src", "dst"))


@query(f"WITH {_V}, {_E} SELECT 'nodes' AS grp, CAST(fid AS VARCHAR) AS id, NULL AS source FROM V UNION ALL SELECT 'edges', 'e' || eid, CAST(src AS VARCHAR) FROM E")
def graph_elements(spark, d):
    """Nodes and edges as a graph viewer takes them."""
    g = graphs.read_graph(spark, container(spark, d))
    return graph.cytoscape(g.vertices, g.edges).select("grp", "id", F.get_json_object("json", "$.data.source").alias("source"))


@query(f"WITH {_WHOLE}, {_E} SELECT 2 * (SELECT count(*) FROM V) AS n_vertices, 2 * (SELECT count(*) FROM E) AS n_edges, (SELECT CAST(sum(src) * 2 + count(*) * (SELECT count(*) FROM V) AS BIGINT) FROM E) AS src_total")
def whole_graph_union(spark, d):
    return _doubled(graphs.read_graph(spark, container(spark, d, whole=True)))


@query(f"WITH {_WHOLE}, {_E} SELECT eid, src, dst FROM E")
def whole_stream_edges(spark, d):
    return streaming.drain(streaming.stream_section(spark, container(spark, d, whole=True)).select("eid", "src", "dst"))


@query(f"WITH {_WHOLE}, {_E} SELECT 'nodes' AS grp, CAST(fid AS VARCHAR) AS id, NULL AS source FROM V UNION ALL SELECT 'edges', 'e' || eid, CAST(src AS VARCHAR) FROM E")
def whole_graph_elements(spark, d):
    g = graphs.read_graph(spark, container(spark, d, whole=True))
    return graph.cytoscape(g.vertices, g.edges).select("grp", "id", F.get_json_object("json", "$.data.source").alias("source"))


def _export_sql(nodes: str, edges: str) -> str:
    return f"WITH {_WHOLE}, {_E} SELECT 'nodes' AS grp, fid AS id, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS target, name, {nodes} FROM V UNION ALL SELECT 'edges', eid, src, dst, NULL, {edges} FROM E"


_X = "CASE WHEN geom.type = 1 AND len(geom.xy) > 0 AND NOT isnan(geom.xy[1]) THEN geom.xy[1] END"


def _export(rows: DataFrame, more: dict[str, Column]) -> DataFrame:
    return rows.select("grp", "id", "source", "target", F.get_json_object("attributes", "$.name").alias("name"), *(c.alias(n) for n, c in more.items()))


def _member_x() -> Column:
    x = F.get_json_object("attributes", "$.coordinates[0]").try_cast("double")
    return F.when(~F.isnan(x), x)


@query(_export_sql(f"kind, capacity, {_X} AS x, CAST(NULL AS BIGINT) AS edge_id, CAST(NULL AS VARCHAR) AS properties", "NULL, NULL, NULL, eid, properties"))
def attributed_graph(spark, d):
    """The graph with an object of attributes for each node and edge."""
    g = graphs.read_graph(spark, container(spark, d, whole=True))
    at = lambda m: F.get_json_object("attributes", f"$.{m}")
    return _export(graph.attributed_graph(g.vertices, g.edges), {"kind": at("kind"), "capacity": at("capacity").cast("double"), "x": _member_x(), "edge_id": at("id").cast("bigint"), "properties": at("properties")})


@query(_export_sql(f"CAST(NULL AS VARCHAR) AS kind, {_X} AS x, CAST(NULL AS VARCHAR) AS properties", "NULL, NULL, properties"))
def linked_graph(spark, d):
    """The graph as nodes and links with data: names and coordinates, properties."""
    g = graphs.read_graph(spark, container(spark, d, whole=True))
    at = lambda m: F.get_json_object("attributes", f"$.{m}")
    return _export(graph.linked_graph(g.vertices, g.edges), {"kind": at("kind"), "x": _member_x(), "properties": at("properties")})
