"""Graph queries over vertices (fid, …) and edges (src, dst, …), left to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.common import end_salts, materialize, salted_join
from vertexloom.functions.geometry import to_geojson
from vertexloom.types import GEOMETRY_TYPES


def endpoints(edges: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """The edges whose both ends exist, with the given vertex columns as ``src_…`` and ``dst_…``; hot vertices are salted."""
    v = lambda p: vertices.select(F.col("fid").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    spread = F.xxhash64("src", "dst")
    hot = end_salts(edges, ["src", "dst"])
    with_src = salted_join(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), v("src"), "src", F.col("dst"), salts=hot["src"])
    return salted_join(with_src.withColumn("_s", spread), v("dst"), "dst", F.col("_s"), salts=hot["dst"]).drop("_s")


def degrees(edges: DataFrame, end: str, name: str) -> DataFrame:
    """(fid, ``name``): edges per non-null key, partially aggregated before the shuffle."""
    return edges.where(F.col(end).isNotNull()).groupBy(F.col(end).alias("fid")).agg(F.count(F.lit(1)).alias(name))


def _links(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(fid, n_neighbours, first_neighbour): distinct targets of each source and the smallest. Partial states only: no list of a hot vertex is built."""
    return _links(edges).groupBy(F.col("src").alias("fid")).agg(F.count(F.lit(1)).alias("n_neighbours"), F.min("dst").alias("first_neighbour"))


def adjacency(edges: DataFrame, page: int = 100_000) -> DataFrame:
    """(fid, page, neighbours): distinct targets of each source as sorted arrays of about ``page`` at most.

    A source with more has several pages, among which its targets are dealt by hash, so that no task holds all neighbours of a hot vertex.
    """
    pairs = _links(edges)
    pages = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / page).cast("int").alias("_pages"))
    dealt = salted_join(pairs, pages, "src", F.col("dst"), counted=edges).withColumn("page", F.pmod(F.xxhash64("dst"), F.col("_pages")).cast("int"))
    return dealt.groupBy(F.col("src").alias("fid"), "page").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def reverse_pairs(edges: DataFrame, how: str) -> DataFrame:
    """Distinct (src, dst) that also (``left_semi``) or don't (``left_anti``) occur as (dst, src). The pair is the key, so a hot vertex is spread."""
    pairs = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    return pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], how)


def two_step_walks(edges: DataFrame) -> DataFrame:
    """(fid, n_walks): walks of two edges from each vertex. Targets become out-degrees first, so no walk is ever listed; hot targets are salted. Edges with a null end are no steps."""
    edges = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    onward = degrees(edges, "src", "out_degree")
    steps = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(steps, onward.select(F.col("fid").alias("dst"), "out_degree"), "dst", F.col("src"), counted=edges)
    return joined.groupBy(F.col("src").alias("fid")).agg(F.sum(F.col("n") * F.col("out_degree")).alias("n_walks"))


def top_edges(edges: DataFrame, k: int, weight: str) -> DataFrame:
    """The ``k`` heaviest edges of each source with their rank (ties by ``eid``). Each task keeps ``k`` of its own per source before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col(weight).desc(), "eid"))
    return edges.where(F.col("src").isNotNull() & F.col(weight).isNotNull()).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def common_type(types: DataFrame, column: str = "type") -> DataFrame:
    """(geometry_type): the type all rows share, else Unknown. Null types count as Unknown; no rows is an error when the result is read."""
    t = F.coalesce(F.col(column).cast("int"), F.lit(GEOMETRY_TYPES["Unknown"]))
    fold = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("no rows to take a geometry type from")).cast("int")).when(F.min(t) == F.max(t), F.min(t)).otherwise(F.lit(GEOMETRY_TYPES["Unknown"]))
    return types.agg(fold.alias("geometry_type"))


def renumber(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``row_id`` 0, 1, … in the order of a unique column. Each row gets its place from a range partition and the sizes of those before, without one task seeing all rows."""
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed)  # ranges are sampled: both uses below must see the same
    placed = placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.join(F.broadcast(before), "_part").withColumn("row_id", F.col("_before") + F.col("_at")).drop("_m", "_part", "_at", "_before")


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, id, json): elements for a graph viewer; nodes by position, edges as e<i>."""
    drop = lambda df, *names: [F.col(f"`{c}`") for c in df.columns if c not in names]
    n = nodes.select(F.lit("nodes").alias("grp"), F.col("fid").cast("string").alias("id"), F.to_json(F.struct(F.struct(F.col("fid").cast("string").alias("id"), *drop(nodes, "fid", "geom", "bbox")).alias("data"))).alias("json"))
    e = edges.select(
        F.lit("edges").alias("grp"), F.concat(F.lit("e"), F.col("eid").cast("string")).alias("id"),
        F.to_json(F.struct(F.struct(F.concat(F.lit("e"), F.col("eid").cast("string")).alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), *drop(edges, "eid", "src", "dst")).alias("data"))).alias("json"),
    )
    return n.unionByName(e)


def _members(df: DataFrame, *without: str) -> Column:
    """The columns of a row as the inside of a JSON object, nulls left out."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.regexp_replace(F.to_json(F.struct(*kept)), r"^\{|\}$", "") if kept else F.lit("")


def _object(*parts: Column) -> Column:
    """A JSON object of the insides that aren't empty; of a repeated member the last counts to its readers."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.nullif(p, F.lit("")) for p in parts)), F.lit("}"))


def _coordinates(nodes: DataFrame) -> Column:
    """The GeoJSON coordinates, null for collections and nodes without a geometry."""
    return F.concat(F.lit('"coordinates":'), F.coalesce(F.get_json_object(to_geojson(F.col("geom"), nodes.schema["geom"].dataType), "$.coordinates"), F.lit("null")))


_EXPORT = ("grp", "id", "source", "target", "attributes")


def _exported(nodes: DataFrame, node_attributes: Column, edges: DataFrame, edge_attributes: Column) -> DataFrame:
    nothing = F.lit(None).cast("bigint")
    n = nodes.select(F.lit("nodes"), F.col("fid"), nothing, nothing, node_attributes).toDF(*_EXPORT)
    return n.unionByName(edges.select(F.lit("edges"), F.col("eid"), F.col("src"), F.col("dst"), edge_attributes).toDF(*_EXPORT))


def attributed_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, id, source, target, attributes): nodes and directed edges for a library that keeps attributes as one object each, written as JSON.

    A node is named by its position and has its properties and ``coordinates``; an edge has its position as ``id`` unless a property is called so, and its properties.
    """
    edge = _object(F.concat(F.lit('"id":'), F.col("eid").cast("string")), _members(edges, "eid", "src", "dst"))
    return _exported(nodes, _object(_members(nodes, "fid", "geom", "bbox"), _coordinates(nodes)), edges, edge)


def linked_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same columns for a library of nodes and links with data: a node has its ``name`` (if there is such a column) and ``coordinates``, a link its properties alone."""
    name = _members(nodes, *(c for c in nodes.columns if c != "name"))
    return _exported(nodes, _object(name, _coordinates(nodes)), edges, _object(_members(edges, "eid", "src", "dst")))
