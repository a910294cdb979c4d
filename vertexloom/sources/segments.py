"""Segments: what the tasks of a write leave behind, and their assembly into a container."""

from __future__ import annotations

import datetime
import json
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage

from vertexloom.sources import codec, layouts, rtree
from vertexloom.sources.bytes import filesystem
from vertexloom.types import Column, GraphMeta, Meta

DEFAULT_NAME = "L1"  # fixed value: the data set name of a container that was given none
SPLIT_RECORDS = 5_000  # between two split points of a layout
_MAX = 1 << 32


@dataclass
class Segment(WriterCommitMessage):
    """A file of encoded records and what the headers must know of them; ``splits`` has (number, position) within it, ``bad`` counts edges without a source, without a target, and from a vertex to itself."""

    part: int
    file: str
    n_rows: int = 0
    n_bytes: int = 0
    type_low: int | None = None
    type_high: int | None = None
    box: list[float] | None = None
    splits: list[tuple[int, int]] = field(default_factory=list)
    bad: list[int] = field(default_factory=lambda: [0, 0, 0])

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> Segment:
        return cls(**json.loads(text))


def staging_folder(path: str) -> str:
    """A fresh folder beside the target."""
    folder = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    return folder


def wire(value, column: Column):
    """A Python value as the column type wants it: times and decimals as text, nested values as JSON."""
    if column.type in (11, 12, 13) and not isinstance(value, (str, type(None))):
        if isinstance(value, (datetime.datetime, datetime.date)):
            return value.isoformat()
        return json.dumps(value, default=str) if column.type == 12 else str(value)
    return value


class _Writer:
    """A segment in the making, under a name of this attempt's own: what lost attempts leave behind is never read."""

    def __init__(self, kind: str, columns: list[Column], folder: str):
        self.columns = columns
        part = TaskContext.get().partitionId()
        self.segment = Segment(part, f"{folder}/{kind}-{part:06d}-{uuid.uuid4().hex}")
        fs, path = filesystem(self.segment.file)
        self.out = fs.open_output_stream(path)

    def _put(self, record: bytes) -> None:
        s = self.segment
        if s.n_rows % SPLIT_RECORDS == 0:
            s.splits.append((s.n_rows, s.n_bytes))
        self.out.write(record)
        s.n_rows += 1
        s.n_bytes += len(record)


class VertexSegment(_Writer):
    """Takes batches, each a geometry column and one per attribute."""

    def __init__(self, columns: list[Column], folder: str, indexed: bool):
        super().__init__("vertices", columns, folder)
        self.kinds: set[int] = set()
        self.leaves: list[np.ndarray] = []
        self.indexed = indexed

    def add(self, batch: pa.RecordBatch) -> None:
        boxes = []
        for geometry, *values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            boxes.append((*(codec.bounds(geometry) or (math.nan,) * 4), self.segment.n_bytes))
            self._put(codec.encode_feature(geometry, codec.encode_properties([wire(v, c) for v, c in zip(values, self.columns)], self.columns)))
            self.kinds.add(geometry["type"] or 0 if geometry else 0)
        part = np.array(boxes, rtree.NODE)
        if self.indexed:
            self.leaves.append(part)
        real = part[~np.isnan(part["minx"])]
        if len(real):
            box = [float(f(real[k])) for k, f in (("minx", np.min), ("miny", np.min), ("maxx", np.max), ("maxy", np.max))]
            self.segment.box = united(self.segment.box, box)

    def close(self) -> Segment:
        self.out.close()
        s = self.segment
        s.type_low, s.type_high = min(self.kinds, default=None), max(self.kinds, default=None)
        if self.indexed:
            fs, path = filesystem(s.file + ".leaves")
            with fs.open_output_stream(path) as out:
                for part in self.leaves:
                    out.write(part.tobytes())
        return s


class EdgeSegment(_Writer):
    """Takes batches, each source, target and a column per attribute. Edges without an end, or from a vertex to itself, are counted and left out."""

    def __init__(self, columns: list[Column], folder: str):
        super().__init__("edges", columns, folder)

    def add(self, batch: pa.RecordBatch, tells_loops: bool = False) -> None:
        """``tells_loops``: a last column says whether an edge leads from a vertex to itself; positions alone don't if they lie in different files."""
        bad = self.segment.bad
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        loops = columns.pop() if tells_loops else [a == b for a, b in zip(columns[0], columns[1])]
        for loop, source, target, *values in zip(loops, *columns):
            if source is None or target is None:
                bad[0] += source is None
                bad[1] += target is None
            elif loop:
                bad[2] += 1
            else:
                self._put(codec.encode_edge(source, target, codec.encode_properties(values, self.columns)))

    def close(self) -> Segment:
        self.out.close()
        return self.segment


def united(a: list[float] | None, b: list[float] | None) -> list[float] | None:
    """The box around both."""
    return b if a is None else a if b is None else [*(min(x, y) for x, y in zip(a[:2], b[:2])), *(max(x, y) for x, y in zip(a[2:], b[2:]))]


def assemble(path: str, vertices: list[Segment], columns: list[Column], meta: Meta, index_node_size: int, allow_empty: bool, graph: GraphMeta | None = None, edges: list[Segment] = (), drop: bool = False) -> layouts.Layout:
    """Headers, index and segments into one file, which appears, after its layout, when it is complete. ``drop`` removes each segment once it is in: not for tasks, which may be tried again."""
    vertices, edges = sorted(vertices, key=lambda s: s.part), sorted(edges, key=lambda s: s.part)
    n = sum(s.n_rows for s in vertices)
    if n >= _MAX:
        raise codec.ContainerError("one container holds fewer than 2 ** 32 vertices")
    if n == 0 and not allow_empty:
        raise codec.ContainerError("no vertices, so no geometry type")
    full = [s for s in vertices if s.n_rows]
    low, high = min((s.type_low for s in full), default=0), max((s.type_high for s in full), default=0)
    meta.features_count, meta.columns, meta.name = n, columns, meta.name or DEFAULT_NAME
    meta.geometry_type = low if low == high else 0
    meta.index_node_size = index_node_size if n else 0
    meta.envelope = None
    for s in full:
        meta.envelope = united(meta.envelope, s.box)
    head = codec.MAGIC + codec.encode_header(meta)
    begin = len(head) + rtree.tree_bytes(n, meta.index_node_size)
    vertex_splits, end = _splits(vertices, begin)
    graph_head = b"" if graph is None else codec.encode_graph_header(graph)
    edge_splits, edges_end = _splits(edges, end + len(graph_head))
    layout = layouts.Layout(edges_end, n, end, None if graph is None else end + len(graph_head), None if graph is None else edges_end, vertex_splits, edge_splits)
    fs, target = filesystem(path)
    folder, slash, name = target.rpartition("/")
    unfinished = f"{folder}{slash}_{name}.{uuid.uuid4().hex}"  # hidden from readers of the folder
    with fs.open_output_stream(unfinished) as out:
        out.write(head)
        if meta.index_node_size:
            out.write(rtree.build(_leaves(vertices), index_node_size).tobytes())
        for s in vertices:
            _append(s.file, out, drop)
        out.write(graph_head)
        for s in edges:
            _append(s.file, out, drop)
    layouts.write(path, layout)
    fs.move(unfinished, target)
    return layout


def _splits(segments: list[Segment], at: int) -> tuple[list[tuple[int, int]], int]:
    """The split points of segments that lie one after the other from ``at``, and where they end."""
    out, first = [], 0
    for s in segments:
        out += [(first + i, at + p) for i, p in s.splits]
        first += s.n_rows
        at += s.n_bytes
    return out, at


def _leaves(segments: list[Segment]) -> np.ndarray:
    parts, at = [], 0
    for s in segments:
        fs, path = filesystem(s.file + ".leaves")
        with fs.open_input_file(path) as f:
            part = np.frombuffer(f.read(), rtree.NODE).copy()
        part["offset"] += at
        parts.append(part)
        at += s.n_bytes
    return np.concatenate(parts)


def _append(segment: str, out, drop: bool) -> None:
    fs, path = filesystem(segment)
    with fs.open_input_stream(path) as f:
        while block := f.read(8 << 20):
            out.write(block)
    if drop:
        fs.delete_file(path)
