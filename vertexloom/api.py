"""The library's verbs in one place: serialize and deserialize, over DataFrames instead of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vertexloom import streaming
from vertexloom.functions.projection import geometry_between, tile_key
from vertexloom.functions.properties import build_properties, parse_properties
from vertexloom.sources import graphs
from vertexloom.sources.geojson import read_geojson, to_features
from vertexloom.sources.graphs import GeoGraph, load_extent, load_tile, read_metadata, require_columns, union_graphs
from vertexloom.sources.layouts import Manifest
from vertexloom.types import COLUMN_TYPES, GEOMETRY_TYPES, Column, GraphMeta, Meta, Rect

__all__ = [
    "COLUMN_TYPES", "GEOMETRY_TYPES", "Column", "GeoGraph", "GraphMeta", "Meta", "Rect", "build_properties", "deserialize", "deserialize_edges", "deserialize_filtered", "deserialize_stream", "load_extent", "load_tile",
    "parse_properties", "read_geojson", "read_metadata", "require_columns", "serialize", "serialize_directory", "tile_key", "to_features", "union_graphs",
]


def serialize(vertices: DataFrame, path: str, edges: DataFrame | None = None, crs_code: int = 0, **options) -> GraphMeta | None:
    """Writes a graph; see ``graphs.write_graph``."""
    return graphs.write_graph(vertices, edges, path, crs_code, **options)


def serialize_directory(vertices: DataFrame, path: str, edges: DataFrame | None = None, crs_code: int = 0, **options) -> Manifest:
    """Writes a graph of any size as a directory of containers; see ``graphs.write_graph_directory``."""
    return graphs.write_graph_directory(vertices, edges, path, crs_code, **options)


def deserialize(spark: SparkSession, path: str, meta_fn: Callable | None = None, **options) -> GeoGraph:
    """Both tables and the headers of a container."""
    return graphs.read_graph(spark, path, meta_fn, **options)


def deserialize_filtered(
    spark: SparkSession, path: str, rect: Rect, meta_fn: Callable | None = None, headers: dict[str, str] | None = None, nocache: bool = False, data_crs: int = 4326, feature_crs: int | None = None
) -> DataFrame:
    """The vertices meeting a rectangle in the data's CRS, their geometry in ``feature_crs`` if given."""
    rows = graphs.read_vertices(spark, path, rect, meta_fn=meta_fn, **graphs.http_options(headers, nocache))
    return rows if feature_crs in (None, data_crs) else rows.withColumn("geom", geometry_between(rows["geom"], data_crs, feature_crs))


def deserialize_stream(spark: SparkSession, path: str, rect: Rect | None = None, section: str = "vertices", **options) -> DataFrame:
    """Vertices or edges as a streaming DataFrame; a rectangle filters always."""
    if rect is not None:
        options |= dict(zip(("minx", "miny", "maxx", "maxy"), rect))
    return streaming.stream_section(spark, path, section, **options)


def deserialize_edges(spark: SparkSession, path: str, **options) -> DataFrame:
    """The edges alone."""
    return graphs.read_edges(spark, path, **options)
