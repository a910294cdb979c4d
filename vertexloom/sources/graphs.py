"""Reading and writing whole graphs: the library's front door to containers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.common import end_salts, salted_join, stored
from vertexloom.functions import projection
from vertexloom.functions.geometry import as_geometry, geometry_bbox, meets, render_feature
from vertexloom.sources import codec, layouts, rtree, segments
from vertexloom.sources.bytes import filesystem, list_containers
from vertexloom.sources.container import FORMAT, Container, register
from vertexloom.types import GraphMeta, Meta, Rect, column_for

BROADCAST_POSITIONS = 500_000  # up to so many vertices with integer ids (16 bytes each) are broadcast to the edges

@dataclass
class GeoGraph:
    """Vertices, edges (None without a graph section) and what the headers say."""

    vertices: DataFrame
    edges: DataFrame | None
    meta: Meta
    graph_meta: GraphMeta | None


def resolve(spark: SparkSession, path: str) -> str:
    """A path without a scheme as the session's file system has it: on a cluster that is seldom the machine's own."""
    if "://" in path or path.startswith("file:"):
        return path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return path if full.startswith("file:") else full


def _reader(spark: SparkSession, section: str, options: dict):
    register(spark)
    return spark.read.format(FORMAT).option("section", section).options(**{k: str(v) for k, v in options.items()})


def http_options(headers: dict[str, str] | None = None, nocache: bool = False) -> dict[str, str]:
    return {**{f"header.{k}": v for k, v in (headers or {}).items()}, **({"nocache": "true"} if nocache else {})}


def read_vertices(spark: SparkSession, path: str, rect: Rect | None = None, columns: list[str] | None = None, meta_fn: Callable | None = None, **options) -> DataFrame:
    """(fid, bbox, geom, attributes) of the vertices, those meeting ``rect`` if given, through the index if there is one. ``meta_fn`` gets the header first."""
    if meta_fn is not None:
        meta_fn(read_metadata(path, **options))
    if rect is not None:
        options |= dict(zip(("minx", "miny", "maxx", "maxy"), rect))
    if columns is not None:
        options["columns"] = ",".join(columns)
    return _reader(spark, "vertices", options).load(resolve(spark, path))


def read_edges(spark: SparkSession, path: str, **options) -> DataFrame:
    """(eid, src, dst, attributes); empty if there is no graph section."""
    return _reader(spark, "edges", options).load(resolve(spark, path))


def read_section(spark: SparkSession, path: str, section: str, **options) -> DataFrame:
    """The ``header``, ``graph_header`` or ``index`` as a table."""
    return _reader(spark, section, options).load(resolve(spark, path))


def read_metadata(path: str, **options) -> Meta:
    """The header alone; no record is touched. Of a directory with a manifest the header of the whole graph."""
    manifest = layouts.read_manifest(path)
    if manifest:
        return _whole_meta(path, manifest)
    return Container(path, {k.lower(): str(v) for k, v in options.items()}).meta


def _whole_meta(path: str, manifest: layouts.Manifest) -> Meta:
    """The header of the graph in a directory: that of the first file with the counts and the box of all."""
    meta = Container(f"{path.rstrip('/')}/{manifest.files[0].name}").meta if manifest.files else Meta()
    box = None
    for f in manifest.files:
        box = segments.united(box, f.envelope)
    return replace(meta, features_count=manifest.n_vertices, envelope=box)


def read_graph(spark: SparkSession, path: str, meta_fn: Callable | None = None, **options) -> GeoGraph:
    """Both tables of one container or of a directory with a manifest. ``meta_fn`` gets (Meta, GraphMeta or None) before any record is read."""
    path = resolve(spark, path)
    manifest = layouts.read_manifest(path)
    if manifest:
        meta, gm = _whole_meta(path, manifest), GraphMeta(manifest.n_edges, layouts.own_columns(manifest.edge_columns) or None) if manifest.has_edges else None
        if meta_fn is not None:
            meta_fn(meta, gm)
        return GeoGraph(read_vertices(spark, path, **options), read_edges(spark, path, **options) if gm else None, meta, gm)
    c = Container(path, {k.lower(): str(v) for k, v in options.items()})
    graph = c.graph()
    if meta_fn is not None:
        meta_fn(c.meta, graph and graph[0])
    return GeoGraph(read_vertices(spark, path, **options), read_edges(spark, path, **options) if graph else None, c.meta, graph and graph[0])


def load_extent(spark: SparkSession, path: str, extent: Rect, extent_crs: int = 3857, data_crs: int = 4326, strategy: str | Callable[[Rect], list[Rect]] = "bbox", render: bool = False, **options) -> DataFrame:
    """The vertices for a map extent: the extent is brought to the data's CRS, the geometry to the map's.

    Strategy ``all`` reads everything, ``bbox`` the extent; a function gives the rectangles (in the map's CRS, as the extent) to load for it, e.g. the tiles that cover it. A vertex that meets several
    is there once. ``render`` gives flat coordinates for drawing (``geometry.render_feature``) in place of the geometry.
    """
    if callable(strategy):
        rects = [projection.rect_between(r, extent_crs, data_crs) for r in strategy(extent)]
        sides = (min(r[0] for r in rects), min(r[1] for r in rects), max(r[2] for r in rects), max(r[3] for r in rects)) if rects else (float("inf"),) * 4
        rows = read_vertices(spark, path, Rect(*sides), **options)
        any_ = F.lit(False)
        for r in rects:
            any_ = any_ | meets(F.col("bbox"), *r)
        rows = rows.where(any_)
    else:
        rows = read_vertices(spark, path, None if strategy == "all" else projection.rect_between(extent, extent_crs, data_crs), **options)
    if render:
        flat = render_feature(F.col("geom") if extent_crs == data_crs else projection.geometry_between(F.col("geom"), data_crs, extent_crs))
        return rows.withColumn("render", flat).drop("geom")
    return rows if extent_crs == data_crs else rows.withColumn("geom", projection.geometry_between(F.col("geom"), data_crs, extent_crs))


def load_tile(spark: SparkSession, path: str, z: int, x: int, y: int, data_crs: int = 4326, **options) -> DataFrame:
    """The vertices for a map tile, in Web Mercator."""
    return load_extent(spark, path, projection.tile_rect(z, x, y), 3857, data_crs, **options)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if it has all the columns, else a ValueError naming those missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _wire(df: DataFrame, fields: list[T.StructField]) -> tuple[list, list[Column]]:
    """Container columns of the fields and the expressions that bring them to wire values."""
    columns, out = [], []
    for f in fields:
        column, value = column_for(f), F.col(f"`{f.name}`")
        if column.type == 13 and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif column.type == 12 and not isinstance(f.dataType, T.StringType):
            value = F.to_json(value)
        elif not isinstance(f.dataType, (T.BinaryType, T.BooleanType, T.NumericType, T.StringType)) or (isinstance(f.dataType, T.DecimalType) and column.type != 8):
            value = value.cast("string")
        columns.append(column)
        out.append(value.alias(f.name))
    return columns, out


def hilbert_key(x: Column, y: Column, envelope: tuple[float, float, float, float]) -> Column:
    """Position of a point along a Hilbert curve over the envelope; null for null."""
    minx, miny, maxx, maxy = envelope

    @F.arrow_udf("bigint")
    def key(xs: pa.Array, ys: pa.Array) -> pa.Array:
        scale = lambda v, lo, hi: np.clip((np.nan_to_num(v, nan=lo) - lo) / ((hi - lo) or 1.0) * 65535, 0, 65535)
        x, y = (a.to_numpy(zero_copy_only=False).astype(float) for a in (xs, ys))
        return pa.array(rtree.hilbert(scale(x, minx, maxx), scale(y, miny, maxy)), pa.int64())

    return key(x, y)


def check_edges(edges: DataFrame, n_vertices: int) -> None:
    """Raises for edges whose ends are out of range or equal; one pass, no row leaves its task."""
    src, dst = F.col("src"), F.col("dst")
    bad = lambda c: F.coalesce((c < 0) | (c >= n_vertices), F.lit(True))
    row = edges.agg(*(F.count_if(c).alias(k) for k, c in (("src", bad(src)), ("dst", bad(dst)), ("loop", src == dst)))).collect()[0]
    _raise(row.src, row.dst, row.loop, n_vertices)


def _raise(n_src: int, n_dst: int, n_loop: int, n_vertices: int) -> None:
    if n_src:
        raise codec.ContainerError(f"{n_src} edges have a source out of range (0..{n_vertices - 1})")
    if n_dst:
        raise codec.ContainerError(f"{n_dst} edges have a target out of range (0..{n_vertices - 1})")
    if n_loop:
        raise codec.ContainerError(f"{n_loop} edges lead from a vertex to itself")


def _placed(vertices: DataFrame, id_column: str, folder: str, index_node_size: int, parts: int | None) -> tuple[DataFrame, list[segments.Segment], list]:
    """((id, part, at) of every vertex, the segments, the columns): one pass that encodes the vertices in order and notes where each went. ``parts`` tasks, or as many as the size asks for."""
    columns, attributes = _wire(vertices, [f for f in vertices.schema.fields if f.name not in (id_column, "geom", "bbox")])
    rows = vertices.select(F.col(id_column).alias("_id"), as_geometry(F.col("geom"), vertices.schema["geom"].dataType).alias("_geom"), *attributes)
    order = ["_id"]
    if index_node_size:
        box = geometry_bbox(F.col("_geom"))
        e = rows.select(box.alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).collect()[0]
        envelope = tuple(0.0 if v is None else v for v in e)
        rows = rows.withColumn("_key", hilbert_key((box["minx"] + box["maxx"]) / 2, (box["miny"] + box["maxy"]) / 2, envelope))
        order = ["_key", "_id"]
    ordered = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order).drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = segments.VertexSegment(columns, folder, bool(index_node_size))
        kind = None
        for b in batches:
            ids, first = b.column(0), out.segment.n_rows
            kind = ids.type
            out.add(pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:]))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array([out.segment.part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.nulls(n, pa.string())], names=["id", "part", "at", "segment"])
        done = out.close()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([done.part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([done.to_json()])], names=["id", "part", "at", "segment"])

    schema = T.StructType([T.StructField("id", rows.schema["_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("segment", T.StringType())])
    noted = stored(ordered.mapInArrow(run, schema), "positions")
    written = [segments.Segment.from_json(r.segment) for r in noted.where("segment IS NOT NULL").select("segment").collect()]  # a row per task
    return noted.where("segment IS NULL").select("id", "part", "at"), sorted(written, key=lambda s: s.part), columns


def _edge_segments(edges: DataFrame, positions: DataFrame, end: Callable[[Column], Column], n: int, folder: str, parts: int, files: bool) -> tuple[list[segments.Segment], list]:
    """(segments, columns) of the edges. ``end`` makes of a row of ``positions`` what an edge keeps of it: a number, or with ``files`` a struct (file, at). ``parts`` tasks."""
    columns, attributes = _wire(edges, [f for f in edges.schema.fields if f.name not in ("eid", "src", "dst")])
    order = F.col("eid") if "eid" in edges.columns else F.lit(None).cast("bigint")
    rows = edges.select(order.alias("_eid"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), *attributes)
    places = positions.select("id", end(positions).alias("place"))
    small = n <= BROADCAST_POSITIONS and isinstance(positions.schema["id"].dataType, T.IntegralType)
    names = [f"`{c.name}`" for c in columns]
    spread = F.xxhash64("_eid", "_src", "_dst", *names)
    placed = rows
    hot = {} if small else end_salts(rows, ["_src", "_dst"])  # one pass for both ends
    for key, to in (("_src", "_from"), ("_dst", "_to")):
        known = places.toDF(key, to)
        placed = placed.join(F.broadcast(known), key, "left") if small else salted_join(placed, known, key, spread, "left", salts=hot[key])
    tie = ["_eid", "_from", "_to"]
    ranged = placed.repartitionByRange(parts, *tie).sortWithinPartitions(*tie, *names)
    own = [*columns, *layouts.end_columns()] if files else columns
    if files:
        here = F.spark_partition_id()
        file = lambda c: F.when(F.col(c)["file"] != here, F.col(c)["file"])
        out = ranged.select(F.col("_from")["at"].alias("_from"), F.col("_to")["at"].alias("_to"), *names, file("_from").alias("_f"), file("_to").alias("_t"), (F.col("_src") == F.col("_dst")).alias("_loop"))
    else:
        out = ranged.select("_from", "_to", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segments.EdgeSegment(own, folder)
        for b in batches:
            segment.add(b, files)
        yield pa.RecordBatch.from_arrays([pa.array([segment.close().to_json()])], names=["segment"])

    found = [segments.Segment.from_json(r.segment) for r in out.mapInArrow(run, "segment string").collect()]  # a row per task
    return sorted(found, key=lambda s: s.part), own


def _check(found: list[segments.Segment], n: int) -> None:
    _raise(*(sum(s.bad[i] for s in found) for i in range(3)), n)


def write_graph(
    vertices: DataFrame,
    edges: DataFrame | None,
    path: str,
    crs_code: int = 0,
    index_node_size: int = 0,
    id_column: str = "fid",
    allow_empty: bool = False,
    meta: Meta | None = None,
) -> GraphMeta | None:
    """Writes one container, and its layout beside it.

    ``vertices`` has a unique id, ``geom`` and attributes (a ``bbox`` column is not written); ``edges`` has ``src``, ``dst`` (ids of vertices), perhaps ``eid`` for the
    order, and attributes. Vertices are written in the order of their ids, or along a Hilbert curve if an index is wanted; their positions become the ids. An edge to
    an unknown vertex, or from a vertex to itself, is an error. ``edges=None`` writes no graph section, an empty table an empty one. ``meta`` gives title, description, metadata and crs.

    Tasks encode segments into a folder beside the target; the driver gets a row per segment, builds the index (40 bytes a vertex), writes the headers and appends the segments, since one file
    has one writer. So this form is for graphs of some GB, and holds fewer than 2 ** 32 vertices and edges; ``write_graph_directory`` writes larger ones without the driver. Up to ``BROADCAST_POSITIONS``
    vertices (counted by then) are broadcast to the edges; beyond, the edges are joined with them, hot ends salted. Nothing is visible under ``path`` before it is complete.
    """
    spark = vertices.sparkSession
    path = resolve(spark, path)
    folder = segments.staging_folder(path)
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        positions, written, columns = _placed(vertices, id_column, folder, index_node_size, parts)
        n = sum(s.n_rows for s in written)
        graph, edge_segments = None, []
        if edges is not None:
            starts = _starts(written)
            first = F.array(*(F.lit(starts.get(p, 0)).cast("bigint") for p in range(max(starts, default=0) + 1)))
            edge_segments, edge_columns = _edge_segments(edges, positions, lambda p: F.get(first, F.col("part")) + F.col("at"), n, folder, parts, False)
            _check(edge_segments, n)
            graph = GraphMeta(sum(s.n_rows for s in edge_segments), edge_columns or None)
        segments.assemble(path, written, columns, _head(meta, crs_code), index_node_size, allow_empty, graph, edge_segments, drop=True)
        return graph
    finally:
        fs, inner = filesystem(folder)
        fs.delete_dir(inner)


def _head(meta: Meta | None, crs_code: int) -> Meta:
    head = replace(meta) if meta else Meta()
    if crs_code:
        head.crs = {**(head.crs or {}), "code": crs_code}
    return head


def _starts(written: list[segments.Segment]) -> dict[int, int]:
    """The number of the first vertex of each part."""
    first, out = 0, {}
    for s in written:
        out[s.part] = first
        first += s.n_rows
    return out


def write_graph_directory(
    vertices: DataFrame, edges: DataFrame | None, path: str, crs_code: int = 0, index_node_size: int = 0, id_column: str = "fid", meta: Meta | None = None
) -> layouts.Manifest:
    """Writes a graph of any size as a directory of containers with a manifest; the tables are those of ``write_graph``, and the checks.

    One container per range of vertices (as many as Spark makes of the table's size), put together by its own task from its segments; edges are dealt over the files by ranges of their order, whatever
    their ends, so a hot vertex makes no file larger. An edge whose end lies in another file has that file's number as a further property. The driver handles a row per file and writes the manifest last, with
    which the directory is complete: files that it does not name are never read as part of the graph. Ids run on over the files.
    """
    spark = vertices.sparkSession
    path = resolve(spark, path).rstrip("/")
    fs, inner = filesystem(path)
    if fs.get_file_info(f"{inner}/{layouts.MANIFEST}").type.name != "NotFound":
        raise ValueError(f"{path} has a graph already")
    fs.create_dir(inner, recursive=True)
    folder = segments.staging_folder(f"{path}/_write")
    try:
        positions, written, columns = _placed(vertices, id_column, folder, index_node_size, None)
        written = [s for s in written if s.n_rows]
        n = sum(s.n_rows for s in written)
        found, edge_columns = [], []
        if edges is not None:
            number = {s.part: k for k, s in enumerate(written)}
            file = F.array(*(F.lit(number.get(p, -1)) for p in range(max(number, default=0) + 1)))
            found, edge_columns = _edge_segments(edges, positions, lambda p: F.struct(F.get(file, F.col("part")).alias("file"), F.col("at").alias("at")), n, folder, max(len(written), 1), True)
            _check(found, n)
        by_part = {s.part: s for s in found}
        rows = [(k, s.to_json(), by_part[k].to_json() if k in by_part else None) for k, s in enumerate(written)]
        head, with_edges = _head(meta, crs_code), edges is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import json
            from dataclasses import asdict

            for b in batches:
                for k, vertex_text, edge_text in zip(*(c.to_pylist() for c in b.columns)):
                    v = segments.Segment.from_json(vertex_text)
                    e = [segments.Segment.from_json(edge_text)] if edge_text else []
                    graph = GraphMeta(sum(s.n_rows for s in e), edge_columns or None) if with_edges else None
                    name = f"part-{k:06d}.bin"
                    made = segments.assemble(f"{path}/{name}", [v], columns, replace(head), index_node_size, True, graph, e)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([json.dumps({"name": name, "n_vertices": v.n_rows, "n_edges": graph.edge_count if graph else 0, "envelope": v.box, "layout": asdict(made)})])], names=["k", "part"])

        files = spark.createDataFrame(rows, "k bigint, vertices string, edges string").repartition(max(len(rows), 1), "k") if rows else None
        made = sorted(files.mapInArrow(run, "k bigint, part string").collect()) if files is not None else []  # a row per file
        manifest = layouts.manifest([r.part for r in made], columns, edge_columns, with_edges)
        layouts.write_manifest(path, manifest)
        return manifest
    finally:
        fs, inner = filesystem(folder)
        fs.delete_dir(inner)


def write_layouts(spark: SparkSession, path: str) -> int:
    """Makes the layouts of containers from elsewhere that have none: each file is walked once, by a task. Returns the number of layouts made."""
    path = resolve(spark, path)
    files = [(f,) for f in list_containers(path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                c = Container(f)
                if c.layout() is None:
                    layouts.write(f, c.walked(segments.SPLIT_RECORDS))
                    yield pa.RecordBatch.from_arrays([pa.array([f])], names=["file"])

    return spark.createDataFrame(files, "file string").repartition(max(len(files), 1)).mapInArrow(run, "file string").count()


def union_graphs(a: GeoGraph, b: GeoGraph) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of both, the second graph's ids moved behind the first's; columns are matched by name."""
    n, m = a.meta.features_count, a.graph_meta.edge_count if a.graph_meta else 0
    vertices = a.vertices.unionByName(b.vertices.withColumn("fid", F.col("fid") + n), allowMissingColumns=True)
    moved = None if b.edges is None else b.edges.withColumns({"eid": F.col("eid") + m, "src": F.col("src") + n, "dst": F.col("dst") + n})
    edges = moved if a.edges is None else a.edges if moved is None else a.edges.unionByName(moved, allowMissingColumns=True)
    return vertices, edges
