"""What planning needs to know of containers, kept beside them: the layout of a file, and the manifest of a directory.

The layout of ``x.bin`` is the hidden file ``_x.bin.layout``: where the sections end and split points within them. It counts only for a file of the size and number of features that it names, so a container
may be moved or replaced without it. A directory with ``_manifest.json`` is one graph over all its files.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np

from vertexloom.sources.bytes import filesystem
from vertexloom.types import Column

MANIFEST, BASES = "_manifest.json", "_bases"
#: Further edge columns in the files of a directory: the file in which an end lies, absent for the edge's own
END_FILES = ("_src_file", "_dst_file")
_UINT = 6


@dataclass
class Layout:
    """``end``: where the features end; ``edges``, ``edges_end``: where the edges begin and end, None without a graph section; splits: (number of a record, its position)."""

    size: int
    n_features: int
    end: int
    edges: int | None
    edges_end: int | None
    vertex_splits: list[tuple[int, int]]
    edge_splits: list[tuple[int, int]]


@dataclass
class Part:
    """A file of a directory and its place in the graph."""

    name: str
    n_vertices: int
    n_edges: int
    first_vertex: int
    first_edge: int
    envelope: list[float] | None
    layout: Layout


@dataclass
class Manifest:
    columns: list[Column]
    edge_columns: list[Column]
    has_edges: bool
    files: list[Part]

    @property
    def n_vertices(self) -> int:
        return sum(f.n_vertices for f in self.files)

    @property
    def n_edges(self) -> int:
        return sum(f.n_edges for f in self.files)


def end_columns() -> list[Column]:
    return [Column(n, _UINT) for n in END_FILES]


def own_columns(columns: list[Column]) -> list[Column]:
    """Edge columns without those that name files."""
    return columns[:-2] if tuple(c.name for c in columns[-2:]) == END_FILES else columns


def layout_path(path: str) -> str:
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}_{name}.layout"


def _load(path: str) -> bytes | None:
    if path.startswith(("http://", "https://")):
        return None
    fs, inner = filesystem(path)
    try:
        with fs.open_input_stream(inner) as f:
            return f.read()
    except (FileNotFoundError, NotADirectoryError):
        return None


def _save(path: str, data: bytes) -> None:
    fs, inner = filesystem(path)
    with fs.open_output_stream(inner) as out:
        out.write(data)


def _layout(d: dict) -> Layout:
    return Layout(**{**d, "vertex_splits": [tuple(x) for x in d["vertex_splits"]], "edge_splits": [tuple(x) for x in d["edge_splits"]]})


def read(path: str, size: int | None, n_features: int) -> Layout | None:
    """The layout of a container, None if there is none or it belongs to another file."""
    data = _load(layout_path(path))
    if data is None:
        return None
    try:
        found = _layout(json.loads(data))
    except (ValueError, TypeError, KeyError):
        return None
    return found if (found.size, found.n_features) == (size, n_features) else None


def write(path: str, layout: Layout) -> None:
    _save(layout_path(path), json.dumps(asdict(layout)).encode())


def read_manifest(folder: str) -> Manifest | None:
    data = _load(f"{folder.rstrip('/')}/{MANIFEST}")
    if data is None:
        return None
    d = json.loads(data)
    files = [Part(**{**f, "layout": _layout(f["layout"])}) for f in d["files"]]
    return Manifest([Column(**c) for c in d["columns"]], [Column(**c) for c in d["edge_columns"]], d["has_edges"], files)


def manifest(parts: list[str], columns: list[Column], edge_columns: list[Column], has_edges: bool) -> Manifest:
    """The manifest of files, each told of in JSON by the task that made it, in their order."""
    files, v, e = [], 0, 0
    for text in parts:
        d = json.loads(text)
        files.append(Part(first_vertex=v, first_edge=e, **{**d, "layout": _layout(d["layout"])}))
        v, e = v + d["n_vertices"], e + d["n_edges"]
    return Manifest(columns, edge_columns, has_edges, files)


def write_manifest(folder: str, done: Manifest) -> None:
    """The first ids of the files, for tasks, and last the manifest, with which the directory counts as complete."""
    _save(f"{folder.rstrip('/')}/{BASES}", np.array([f.first_vertex for f in done.files], "<i8").tobytes())
    _save(f"{folder.rstrip('/')}/{MANIFEST}", json.dumps(asdict(done)).encode())


def read_bases(path: str) -> np.ndarray:
    """The first vertex id of each file of a directory: 8 bytes a file."""
    return np.frombuffer(_load(path) or b"", "<i8")
