"""The container as a Spark data source: ``spark.read.format("geocontainer").option("section", …).load(path)``.

``path`` is a file, a directory of files or a URL. Sections: ``vertices`` (default), ``edges``, ``header``, ``graph_header``, ``index``, and ``ranges``: what a scan of the vertices with the same options
would read, a row per task (``n_records`` and ``n_bytes`` are null where they aren't known beforehand). Options:

- ``minx miny maxx maxy``: only vertices whose bounding box meets the rectangle. With an index only matching records are fetched; the exact test on the box is always made.
- ``columns``: comma-separated attributes to decode (a schema given to the reader does the same); geometry is not decoded if neither ``geom`` nor ``bbox`` is wanted.
- ``splitRecords``: records per task (default 20000); ``requestGap``: bytes between records or index nodes that are rather read than skipped (default 262144, not negative).
- ``pushdown``: with Spark's Python filter pushdown switched on, comparisons on ``bbox`` narrow the rectangle.
- ``header.<name>``, ``nocache``: for HTTP.

Planning: written containers have a layout beside them (``layouts``) with the split points of both sections, so planning reads that and no record, and a task reads its slice and the header. Files without one
are planned from their index if they have one (one leaf per split, one more for where the features end), else each is read by one task, which walks it once; ``graphs.write_layouts`` makes their layouts, in tasks.

Directories: with a manifest, as ``graphs.write_graph_directory`` leaves it, ids run on over the files and edges may lead from file to file. Without one the k-th file's ids (in the order of names) begin at k * 2 ** 33.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition

from vertexloom.sources import codec, columns as blocks, layouts, rtree, segments
from vertexloom.sources.bytes import Walker, list_containers, open_bytes
from vertexloom.sources.layouts import Layout
from vertexloom.types import BBOX_TYPE, GEOMETRY_TYPE, Column, GraphMeta, Meta, column_for

FORMAT = "geocontainer"
SPLIT_RECORDS = 20_000
REQUEST_GAP = 262_144
BLOCK_BYTES = 32 << 20  # decoded at once, unless a single record is longer
APART = 33  # bits of a record number within a file of a directory without manifest
_FIRST_READ = 2024 + rtree.NODE.itemsize * (1 + 16 + 256)  # a header and three levels of an index
_LEAVES_AT_ONCE = 4 << 20

_COLUMN = "struct<name:string,type:tinyint,title:string,description:string,width:int,precision:int,scale:int,nullable:boolean,unique:boolean,primary_key:boolean>"
_CRS = "struct<org:string,code:int,name:string,description:string,wkt:string,code_string:string>"
HEADER_SCHEMA = (
    f"file string, features_count bigint, geometry_type tinyint, index_node_size int, envelope array<double>, columns array<{_COLUMN}>, crs {_CRS}, "
    "name string, title string, description string, metadata string"
)
GRAPH_HEADER_SCHEMA = f"file string, edge_count bigint, edge_columns array<{_COLUMN}>"
RANGES_SCHEMA = "file string, first bigint, n_records bigint, start bigint, n_bytes bigint"
INDEX_SCHEMA = "level int, node bigint, minx double, miny double, maxx double, maxy double, offset decimal(20,0)"


class Container:
    """One file."""

    def __init__(self, path: str, options: dict[str, str] | None = None):
        self.path = path
        self.source = open_bytes(path, options)
        start = self.source.read(0, _FIRST_READ)
        codec.check_magic(start)
        size = int.from_bytes(start[8:12], "little")
        codec.check_header_size(size)
        if len(start) < 12 + size:
            start += self.source.read(len(start), 12 + size - len(start))
        self.meta: Meta = codec.decode_header(start, 8)
        self.index_start = 12 + size
        self.features_start = self.index_start + rtree.tree_bytes(self.meta.features_count, self.meta.index_node_size)
        self._layout: Layout | None | bool = False

    @property
    def indexed(self) -> bool:
        return self.features_start > self.index_start

    def nodes(self, first: int, end: int) -> np.ndarray:
        size = rtree.NODE.itemsize
        data = self.source.read(self.index_start + first * size, (end - first) * size)
        if len(data) < (end - first) * size:
            raise codec.ContainerError(f"{self.path} is cut short within its index")
        return np.frombuffer(data, rtree.NODE)

    def layout(self) -> Layout | None:
        """The layout beside the file, if it is there and belongs to these bytes."""
        if self._layout is False:
            self._layout = layouts.read(self.path, self.source.size, self.meta.features_count)
        return self._layout

    def leaf_offsets(self, every: int) -> list[tuple[int, int]]:
        """(number, position) of each ``every``-th feature and of the last, from the leaves of the index: records lie in their order."""
        n = self.meta.features_count
        first, end = rtree.level_bounds(n, self.meta.index_node_size)[0]
        rows = [*range(0, n, every), n - 1]
        if (end - first) * rtree.NODE.itemsize <= _LEAVES_AT_ONCE:
            offsets = self.nodes(first, end)["offset"][rows].tolist()
        else:
            offsets = [int(self.nodes(first + i, first + i + 1)["offset"][0]) for i in rows]
        return [(i, self.features_start + o) for i, o in zip(rows, offsets)]

    def walked(self, every: int = SPLIT_RECORDS) -> Layout:
        """The layout by hopping over all records, for a file that has none."""
        walker, out = Walker(self.source, self.features_start), []
        for i, at in enumerate(walker.hop(self.meta.features_count or None)):
            if i % every == 0:
                out.append((i, at))
        end = walker.at
        graph = self._graph_at(end) if self.meta.features_count else self._lone_graph()
        cuts: list[tuple[int, int]] = []
        if graph:
            walker = Walker(self.source, graph[1])
            for i, at in enumerate(walker.hop(graph[0].edge_count)):
                if i % every == 0:
                    cuts.append((i, at))
        return Layout(self.source.size or 0, self.meta.features_count, end, graph and graph[1], walker.at if graph else None, out, cuts)

    def features_end(self) -> int:
        """Where the features end: from the layout, the last leaf, or by hopping over all records. Record lengths are trusted."""
        if self.layout():
            return self.layout().end
        if self.indexed:
            last = self.leaf_offsets(1 << 60)[-1][1]
            return last + 4 + int.from_bytes(self.source.read(last, 4), "little")
        walker = Walker(self.source, self.features_start)
        for _ in walker.hop(self.meta.features_count or None):
            pass
        return walker.at

    def _lone_graph(self) -> tuple[GraphMeta, int] | None:
        """A file of unknown count has no graph section, unless it holds nothing but a graph header without edges."""
        size = self.source.size
        if self.meta.index_node_size or size is None or not 10 <= size - self.features_start <= codec.HEADER_MAX:
            return None
        head = self.source.read(self.features_start, size - self.features_start)
        alone = int.from_bytes(head[:4], "little") + 4 == len(head) and head[4:8] == bytes(4)
        return codec.decode_graph_header(head)[:1] + (size,) if alone else None

    def _graph_at(self, at: int) -> tuple[GraphMeta, int] | None:
        if self.source.size is not None and at >= self.source.size:
            return None
        start = self.source.read(at, 4096)
        size = int.from_bytes(start[:4], "little")
        if len(start) < 4 + size:
            start += self.source.read(at + len(start), 4 + size - len(start))
        if len(start) < 10 or len(start) < 4 + size:
            raise codec.ContainerError(f"{self.path} is cut short within its graph header")
        return codec.decode_graph_header(start)[0], at + 4 + size

    def graph(self) -> tuple[GraphMeta, int] | None:
        """(meta, where the edges begin), or None without a graph section."""
        return self._graph_at(self.features_end()) if self.meta.features_count else self._lone_graph()


@dataclass
class Slice(InputPartition):
    """Records of one file: ``count`` of them between the bytes ``start`` and ``stop`` (None: not known), or those listed as (number, position).

    ``base`` is added to the numbers of the records, ``home`` to the ends of edges; ``columns`` are those of the edges, None if the task has to find the graph section itself; ``bases`` names the file with the first ids of the files of a directory.
    """

    path: str
    first: int
    start: int
    count: int | None
    stop: int | None = None
    picked: list[tuple[int, int]] | None = None
    base: int = 0
    home: int = 0
    columns: list[Column] | None = None
    bases: str | None = None

    def __post_init__(self):
        super().__init__(self.first)


def _rect(options: dict[str, str]) -> tuple[float, float, float, float] | None:
    given = [options.get(k) for k in ("minx", "miny", "maxx", "maxy")]
    if all(v is None for v in given):
        return None
    inf = float("inf")
    rect = tuple(float(v) if v is not None else d for v, d in zip(given, (-inf, -inf, inf, inf)))
    if rect[0] > rect[2] or rect[1] > rect[3]:
        raise ValueError(f"a rectangle whose minimum is above its maximum: {rect}")
    return rect


def attribute_fields(columns: list[Column], taken: set[str]) -> list[T.StructField]:
    """Spark fields of container columns; a name already taken (case aside) gets ``_1``, ``_2``, …"""
    out = []
    for c in columns:
        f = c.spark_field()
        name, i = f.name, 0
        while name.lower() in taken:
            i += 1
            name = f"{f.name}_{i}"
        taken.add(name.lower())
        out.append(T.StructField(name, f.dataType, True, f.metadata))
    return out


def _each(f, items: list) -> list:
    """``f`` of every item, many at a time: it waits for storage."""
    if len(items) < 2:
        return [f(x) for x in items]
    with ThreadPoolExecutor(min(32, len(items))) as pool:
        return list(pool.map(f, items))


class GeoContainer(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _files(self) -> list[str]:
        path = self.options.get("path")
        if not path:
            raise ValueError("no path")
        return list_containers(path)

    def section(self) -> str:
        return self.options.get("section", "vertices")

    def schema(self):
        section = self.section()
        if section in ("header", "graph_header", "index", "ranges"):
            return {"header": HEADER_SCHEMA, "graph_header": GRAPH_HEADER_SCHEMA, "index": INDEX_SCHEMA, "ranges": RANGES_SCHEMA}[section]
        if section == "vertices":
            fields = [T.StructField("fid", T.LongType()), T.StructField("bbox", BBOX_TYPE), T.StructField("geom", GEOMETRY_TYPE)]
        elif section == "edges":
            fields = [T.StructField(n, T.LongType()) for n in ("eid", "src", "dst")]
        else:
            raise ValueError(f"unknown section {section}")
        fixed, seen = {f.name.lower() for f in fields}, {}
        for columns in self._columns(section):
            for f in attribute_fields(columns, set(fixed)):
                seen.setdefault(f.name.lower(), f)
        wanted = self.options.get("columns")
        names = None if wanted is None else {x.strip().lower() for x in wanted.split(",")}
        return T.StructType(fields + [f for k, f in seen.items() if names is None or k in names])

    def _columns(self, section: str) -> list[list[Column]]:
        """The columns of every file, or those in the manifest."""
        manifest = layouts.read_manifest(self.options.get("path") or "")
        if manifest:
            return [manifest.columns if section == "vertices" else layouts.own_columns(manifest.edge_columns)]

        def of(path: str) -> list[Column]:
            c = Container(path, self.options)
            if section == "vertices":
                return c.meta.columns
            graph = c.graph()
            return (graph and graph[0].columns) or []

        return _each(of, self._files())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        pushing = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingReader if pushing else ContainerReader)(self, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ContainerStream(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ContainerWriter(self, schema, overwrite)


class ContainerWriter(DataSourceArrowWriter):
    """``df.write.format("geocontainer")``: vertices in the order of the DataFrame's partitions, without edges; ids become positions. Options ``crs``, ``title``, ``description``, ``metadata``,
    ``indexNodeSize`` (the order is kept, so sort along a curve first). For graphs there is ``graphs.write_graph``."""

    def __init__(self, source: GeoContainer, schema: T.StructType, overwrite: bool):
        self.path, self.options, self.names = source.options["path"], dict(source.options), schema.names
        if "geom" not in self.names:
            raise ValueError("missing column geom")
        if not overwrite and segments.filesystem(self.path)[0].get_file_info(segments.filesystem(self.path)[1]).type.name != "NotFound":
            raise ValueError(f"{self.path} exists")
        self.fields = [f.name for f in schema.fields if f.name not in ("fid", "geom", "bbox")]
        self.columns = [column_for(schema[n]) for n in self.fields]
        self.node_size = int(source.options.get("indexnodesize", 0))
        self.folder = segments.staging_folder(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> segments.Segment:
        picked = (pa.RecordBatch.from_arrays([b.column(self.names.index(n)) for n in ("geom", *self.fields)], names=["geom", *self.fields]) for b in batches)
        out = segments.VertexSegment(self.columns, self.folder, self.node_size > 0)
        for b in picked:
            out.add(b)
        return out.close()

    def commit(self, messages: list) -> None:
        meta = Meta(**{k: self.options.get(k) for k in ("title", "description", "metadata")})
        if self.options.get("crs"):
            meta.crs = {"code": int(self.options["crs"])}
        try:
            segments.assemble(self.path, [m for m in messages if m], self.columns, meta, self.node_size, True)
        finally:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, inner = segments.filesystem(self.folder)
        if fs.get_file_info(inner).type.name != "NotFound":
            fs.delete_dir(inner)


class ContainerReader(DataSourceReader):
    def __init__(self, source: GeoContainer, schema: T.StructType):
        self.options, self.wanted, self.kind, self.path = dict(source.options), schema, source.section(), source.options.get("path")
        self.files = source._files()
        self.rect = _rect(source.options)
        self.every = int(source.options.get("splitrecords", SPLIT_RECORDS))
        self.gap = int(source.options.get("requestgap", REQUEST_GAP))
        if self.gap < 0:
            raise ValueError("requestGap must not be negative")

    def partitions(self) -> list[InputPartition]:
        manifest = layouts.read_manifest(self.path)
        if manifest and self.kind in ("vertices", "edges"):
            made = _each(lambda f: self._of_manifest(manifest, f), manifest.files)
        elif self.kind in ("vertices", "edges"):
            made = _each(self._of_file, list(enumerate(self.files)))
        elif self.kind == "ranges":
            paths = [f"{self.path.rstrip('/')}/{f.name}" for f in manifest.files] if manifest else self.files
            made = [[Slice(path, i, 0, None) for i, path in enumerate(paths)]]
        else:
            made = [[Slice(path, 0, 0, None) for path in ([f"{self.path.rstrip('/')}/{f.name}" for f in manifest.files] if manifest else self.files)]]
        return [s for slices in made for s in slices] or [Slice("", 0, 0, 0)]

    def _of_file(self, numbered: tuple[int, str]) -> list[Slice]:
        number, path = numbered
        c = Container(path, self.options)
        slices = self._edges(c) if self.kind == "edges" else self._vertices(c, c.meta.envelope)
        return [replace(s, base=number << APART, home=number << APART) for s in slices]

    def _of_manifest(self, manifest: layouts.Manifest, f: layouts.Part) -> list[Slice]:
        path = f"{self.path.rstrip('/')}/{f.name}"
        if self.kind == "edges":
            return [replace(s, base=f.first_edge, home=f.first_vertex, columns=manifest.edge_columns, bases=f"{self.path.rstrip('/')}/{layouts.BASES}") for s in self._cuts(path, f.layout.edge_splits, f.n_edges, f.layout.edges_end)]
        if self.rect is not None:
            slices = [] if _apart(self.rect, f.envelope) else self._vertices(Container(path, self.options), f.envelope)
        else:
            slices = self._cuts(path, f.layout.vertex_splits, f.n_vertices, f.layout.end)
        return [replace(s, base=f.first_vertex) for s in slices]

    def _cuts(self, path: str, splits: list[tuple[int, int]], count: int, stop: int | None) -> list[Slice]:
        """Slices of at least ``every`` records, the last aside, between split points."""
        picked: list[tuple[int, int]] = []
        for i, at in splits:
            if not picked or i - picked[-1][0] >= self.every:
                picked.append((i, at))
        ends = [*picked[1:], (count, stop)]
        return [Slice(path, i, at, j - i, end) for (i, at), (j, end) in zip(picked, ends) if j > i]

    def _vertices(self, c: Container, envelope: list[float] | None) -> list[Slice]:
        n = c.meta.features_count
        if self.rect is not None:
            if _apart(self.rect, envelope):
                return []
            if c.indexed:
                hits = rtree.search(n, c.meta.index_node_size, self.rect, c.nodes, self.gap // rtree.NODE.itemsize)
                out: list[Slice] = []
                for item, offset in zip(hits["item"].tolist(), (hits["offset"] + c.features_start).tolist()):
                    batch = out[-1].picked if out else None
                    if batch and len(batch) < self.every and offset - batch[-1][1] <= self.gap:
                        batch.append((item, offset))
                    else:
                        out.append(Slice(c.path, item, offset, None, picked=[(item, offset)]))
                return out
        layout = c.layout()
        if layout and n:
            return self._cuts(c.path, layout.vertex_splits, n, layout.end)
        if c.indexed:
            return self._cuts(c.path, c.leaf_offsets(self.every)[:-1], n, c.features_end())
        if not n and c._lone_graph():
            return []
        return [Slice(c.path, 0, c.features_start, n or None)]

    def _edges(self, c: Container) -> list[Slice]:
        layout = c.layout()
        if not (layout or c.indexed) and c.meta.features_count:
            return [Slice(c.path, 0, -1, None)]  # the task looks for them
        graph = c.graph()
        if graph is None or not graph[0].edge_count:
            return []
        meta, at = graph
        cuts = self._cuts(c.path, layout.edge_splits, meta.edge_count, layout.edges_end) if layout else [Slice(c.path, 0, at, meta.edge_count)]
        return [replace(s, columns=meta.columns or []) for s in cuts]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        if self.kind == "vertices":
            yield from read_vertices(Container(part.path, self.options), part, self.wanted, self.rect)
        elif self.kind == "edges":
            yield from read_edges(part, self.wanted, self.options)
        elif self.kind == "ranges":
            c = Container(part.path, self.options)
            rows = [{"file": s.path, "first": s.first, "n_records": len(s.picked) if s.picked else s.count, "start": s.start, "n_bytes": s.picked[-1][1] - s.start if s.picked else s.stop and s.stop - s.start} for s in self._vertices(c, c.meta.envelope)]
            yield from _batches(([row[f.name] for f in self.wanted.fields] for row in rows), _arrow(self.wanted))
        else:
            yield from read_meta(Container(part.path, self.options), self.kind, self.wanted)


def _apart(rect: tuple, envelope: list[float] | None) -> bool:
    e = envelope
    return bool(e) and len(e) == 4 and (rect[2] < e[0] or rect[3] < e[1] or rect[0] > e[2] or rect[1] > e[3])


class PushingReader(ContainerReader):
    """Narrows the rectangle by comparisons of ``bbox`` fields with numbers; Spark still tests every row."""

    def pushFilters(self, filters):
        inf = float("inf")
        low = {"minx": -inf, "miny": -inf, "maxx": inf, "maxy": inf}
        if self.rect is not None:
            low = dict(zip(low, self.rect))
        found = False
        for f in filters:
            inner, negated = (f.child, True) if type(f).__name__ == "Not" else (f, False)
            kind, at = type(inner).__name__, getattr(inner, "attribute", None)
            if at and len(at) == 2 and at[0] == "bbox" and isinstance(getattr(inner, "value", None), (int, float)):
                below = (kind in ("LessThan", "LessThanOrEqual")) != negated
                if kind in ("LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual"):
                    value = float(inner.value)
                    if below and at[1] in ("minx", "miny"):  # a box that begins before the value
                        key = "maxx" if at[1] == "minx" else "maxy"
                        low[key], found = min(low[key], value), True
                    elif not below and at[1] in ("maxx", "maxy"):
                        key = "minx" if at[1] == "maxx" else "miny"
                        low[key], found = max(low[key], value), True
            yield f
        if found:
            self.rect = tuple(low[k] for k in ("minx", "miny", "maxx", "maxy"))


class ContainerStream(DataSourceStreamReader):
    """Records of immutable containers in order; the offset is the number of slices read, so every batch can be read again. Files are planned once."""

    def __init__(self, source: GeoContainer, schema: T.StructType):
        self.inner = ContainerReader(source, schema)
        if self.inner.kind not in ("vertices", "edges"):
            raise ValueError("only vertices and edges are streams")
        self._planned: list[Slice] | None = None

    def initialOffset(self) -> dict:
        return {"file": 0, "slice": 0}

    def _slices(self) -> list[Slice]:
        if self._planned is None:
            self._planned = [p for p in self.inner.partitions() if p.path]
        return self._planned

    def latestOffset(self) -> dict:
        return {"file": 0, "slice": len(self._slices())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._slices()[start["slice"] : end["slice"]]

    def commit(self, end: dict) -> None:
        pass

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return self.inner.read(part)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _lookup(wanted: T.StructType, columns: list[Column], fixed: set[str]) -> list[tuple[str, int | None]]:
    """For each wanted field a fixed name or the number of the file's column (None: the file lacks it)."""
    own = {f.name.lower(): i for i, f in enumerate(attribute_fields(columns, set(fixed)))}
    return [(f.name.lower(), None) if f.name.lower() in fixed else ("", own.get(f.name.lower())) for f in wanted.fields]


def _blocks(source, part: Slice) -> Iterator[tuple[int, bytes, list[int]]]:
    """(number of the first record, bytes, where its records begin and the last ends): the slice in blocks of whole records."""
    at, number, left, rest = part.start, part.first, part.count, b""
    while left is None or left > 0:
        most = BLOCK_BYTES if part.stop is None else min(BLOCK_BYTES, part.stop - at)
        more = source.read(at, max(most, 0))
        at += len(more)
        data = rest + more
        starts = blocks.record_starts(data, left)
        n = len(starts) - 1
        if n:
            yield number, data, starts
            number += n
            left = None if left is None else left - n
        rest = data[starts[-1] :]
        if not more:
            if rest or left:
                raise codec.ContainerError(f"{part.path} is cut short: {left if left else 'some'} records are missing or incomplete at byte {at - len(rest)}")
            return


def _picked(source, part: Slice) -> Iterator[tuple[np.ndarray, bytes, list[int]]]:
    """(numbers, bytes, starts) of the listed records, read together with what lies between them."""
    first, last = part.picked[0][1], part.picked[-1][1]
    walker = Walker(source, last)
    end = last + len(next(iter(walker.records(1)))[1])
    data = source.read(first, end - first)
    numbers, chunks = [], []
    for item, at in part.picked:
        i = at - first
        numbers.append(item)
        chunks.append(data[i : i + 4 + int.from_bytes(data[i : i + 4], "little")])
    starts = np.cumsum([0, *(len(x) for x in chunks)]).tolist()
    yield np.array(numbers, np.int64), b"".join(chunks), starts


def read_vertices(c: Container, part: Slice, wanted: T.StructType, rect) -> Iterator[pa.RecordBatch]:
    schema = _arrow(wanted)
    places = _lookup(wanted, c.meta.columns, {"fid", "bbox", "geom"})
    names = {n for n, _ in places}
    attributes = {i for _, i in places if i is not None}
    pieces = _picked(c.source, part) if part.picked is not None else ((np.arange(i, i + len(s) - 1), d, s) for i, d, s in _blocks(c.source, part))
    for numbers, data, starts in pieces:
        found = blocks.Features(data, starts, c.meta.geometry_type)
        boxes = found.boxes() if rect is not None or "bbox" in names else None
        if rect is not None:
            apart = (rect[2] < boxes[:, 0]) | (rect[3] < boxes[:, 1]) | (rect[0] > boxes[:, 2]) | (rect[1] > boxes[:, 3])
            kept = np.flatnonzero(~apart & ~np.isnan(boxes[:, 0]))
            if not len(kept):
                continue
            found, numbers, boxes = found.take(kept), numbers[kept], boxes[kept]
        fixed: dict[str, pa.Array] = {"fid": pa.array(numbers + part.base)}
        if "bbox" in names:
            none = np.isnan(boxes[:, 0])
            sides = [pa.array(boxes[:, k].copy(), mask=none) for k in range(4)]
            fixed["bbox"] = pa.StructArray.from_arrays(sides, names=["minx", "miny", "maxx", "maxy"], mask=pa.array(none))
        if "geom" in names:
            fixed["geom"] = found.geometries(schema.field([f.name.lower() for f in wanted.fields].index("geom")).type)
        values = found.property_columns(c.meta.columns, attributes) if attributes else {}
        yield _assembled(schema, places, fixed, values, len(numbers))


def _assembled(schema: pa.Schema, places: list, fixed: dict, values: dict, n: int) -> pa.RecordBatch:
    arrays = [fixed[name] if name else pa.nulls(n, f.type) if i is None else values[i] for (name, i), f in zip(places, schema)]
    if not arrays:
        return pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))
    return pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def read_edges(part: Slice, wanted: T.StructType, options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    if part.columns is None:
        c = Container(part.path, options)
        graph = c.graph()
        if graph is None or not graph[0].edge_count:
            return
        part = replace(part, start=graph[1], count=graph[0].edge_count, columns=graph[0].columns or [])
        source = c.source
    else:
        source = open_bytes(part.path, options)
    schema = _arrow(wanted)
    columns = layouts.own_columns(part.columns) if part.bases else part.columns
    places = _lookup(wanted, columns, {"eid", "src", "dst"})
    names = {n for n, _ in places}
    attributes = {i for _, i in places if i is not None}
    other = {} if not part.bases else {end: len(columns) + k for k, end in enumerate(("src", "dst")) if end in names}
    firsts = layouts.read_bases(part.bases) if part.bases else None
    for number, data, starts in _blocks(source, part):
        buf, src, dst, begin, end = blocks.edges(data, starts)
        values = blocks.properties(buf, begin, end, part.columns, attributes | set(other.values())) if attributes or other else {}
        fixed = {"eid": pa.array(np.arange(number, number + len(src)) + part.base)}
        for name, ids in (("src", src), ("dst", dst)):
            if name in other:
                file = values[other[name]].fill_null(-1).to_numpy(zero_copy_only=False)
                fixed[name] = pa.array(ids + np.where(file < 0, part.home, firsts[np.maximum(file, 0)]))
            else:
                fixed[name] = pa.array(ids + part.home)
        yield _assembled(schema, places, fixed, values, len(src))


def _batches(rows: Iterator[list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if len(schema) else []
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def read_meta(c: Container, kind: str, wanted: T.StructType) -> Iterator[pa.RecordBatch]:
    schema, m = _arrow(wanted), c.meta
    if kind == "header":
        row = {**asdict(m), "file": c.path}
        rows = [[row[f.name] for f in wanted.fields]]
    elif kind == "graph_header":
        graph = c.graph()
        row = graph and {"file": c.path, "edge_count": graph[0].edge_count, "edge_columns": graph[0].columns and [asdict(x) for x in layouts.own_columns(graph[0].columns)]}
        rows = [[row[f.name] for f in wanted.fields]] if row else []
    else:
        rows = _index_rows(c, [f.name for f in wanted.fields])
    yield from _batches(iter(rows), schema)


def _index_rows(c: Container, names: list[str]) -> Iterator[list]:
    from decimal import Decimal

    if not c.indexed:
        return
    bounds = rtree.level_bounds(c.meta.features_count, c.meta.index_node_size)
    for level, (first, end) in enumerate(reversed(bounds)):
        for begin in range(first, end, 65_536):
            for i, node in enumerate(c.nodes(begin, min(end, begin + 65_536))):
                row = {"level": level, "node": begin + i, **{k: float(node[k]) for k in ("minx", "miny", "maxx", "maxy")}, "offset": Decimal(int(node["offset"]))}
                yield [row[n] for n in names]


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(GeoContainer)
