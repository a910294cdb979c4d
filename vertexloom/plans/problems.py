"""The queries of the general data problems (p1 to p5), each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.common import distinct_names, stored, table
from vertexloom.operators import drift, proximity, references, shred, skew
from vertexloom.plans import problem_sql
from vertexloom.sources import geojson

NEAR_M = 50.0
HOT_SHARE = 0.01


_FIELDS = ("object", "string", "number", "boolean")


def _adjacency(spark: SparkSession, d: str, tables: tuple[str, ...], nested: bool = False) -> DataFrame:
    """The stored adjacency table of objects and their scalars; with ``nested`` only of records that may hold an object below their root."""
    out = None
    for name in tables:
        id_col, text = {"edges": ("eid", "properties"), "raw_features": ("raw_id", "payload")}[name]
        rows = table(spark, d, name)
        rows = rows.where(shred.may_nest(text)) if nested else rows
        one = shred.shred(shred.keyed(rows, id_col), name, id_col, text, _FIELDS, list_scalars=False)
        out = one if out is None else out.unionByName(one)
    return stored(out, "adjacency")


_NO_ID = -(2**62)  # below: records without an id


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object below the root of its record with its parent: the links of the entity table, which is built and stored with all its fields.

    Records without an id have null as theirs. Records that hold no object below the root are passed over in the JVM.
    """
    entities = stored(shred.entity_rows(_adjacency(spark, d, ("edges", "raw_features"), nested=True)), "entities")
    found = entities.where("node > 0").select("record_table", F.when(F.col("record_id") >= _NO_ID, F.col("record_id")).alias("record_id"), F.col("path").alias("node_path"), "parent_path")
    return found.distinct()


def _entities(spark: SparkSession, d: str, tables: tuple[str, ...]) -> DataFrame:
    """The entity table with a text column per label that occurs (the driver gets a row per label); one named like a fixed column, or like another but for case, has trailing underscores."""
    adjacency = _adjacency(spark, d, tables)
    fields = sorted(r.label for r in shred.scalar_labels(adjacency).collect())
    out = shred.entity_table(shred.entity_rows(adjacency), None, {x: "string" for x in fields})
    fixed = out.columns[: len(out.columns) - len(fields)]
    return out.toDF(*fixed, *distinct_names(fields, fixed))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every object of the edge properties and the raw features, roots included, as a row with a link to its parent and its scalars as text columns.

    Records without an id stay apart under numbers far below zero.
    """
    return _entities(spark, d, ("edges", "raw_features"))


def p1_edge_entities(spark: SparkSession, d: str) -> DataFrame:
    """The objects of the edge properties with some of their fields: a flat table per entity, told apart by ``entity``, linked by the paths."""
    entities = shred.entity_rows(_adjacency(spark, d, ("edges",)))
    field = lambda label, sql_type: F.try_element_at("fields", F.lit(label)).try_cast(sql_type).alias(label)
    return entities.select(F.col("record_id").alias("eid"), "path", "parent_path", "entity", field("status", "string"), field("weight", "double"), F.size("fields").cast("bigint").alias("n_fields"))


def p1_geometry_entities(spark: SparkSession, d: str) -> DataFrame:
    """The geometry objects of the raw features as a flat table linked to their parents."""
    out = shred.entity_rows(_adjacency(spark, d, ("raw_features",))).withColumn("type", F.try_element_at("fields", F.lit("type")))
    out = out.where(F.col("entity").isin("geometry", "geometries", "$") & F.col("type").isNotNull())
    return out.select(F.col("record_id").alias("raw_id"), "path", "parent_path", "entity", "type")


def p1_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Every position of the raw features' geometries with the path of the geometry object that holds it."""
    adjacency = stored(shred.shred(shred.keyed(table(spark, d, "raw_features"), "raw_id"), "raw_features", "raw_id", "payload"), "adjacency")
    holders = adjacency.where("kind = 'object'").select("record_id", F.col("node").alias("geometry"), "path").dropDuplicates(["record_id", "geometry"])
    rows = shred.coordinate_table(adjacency).join(holders, ["record_id", "geometry"], "left")
    return rows.select(F.col("record_id").alias("raw_id"), F.col("path").alias("geometry"), "polygon", "ring", "position", "x", "y", "z")


def p1_node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Values of the edge properties by kind."""
    adjacency = shred.shred(shred.keyed(table(spark, d, "edges"), "eid").dropDuplicates(["eid"]), "edges", "eid", "properties")
    return adjacency.groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    vertices, stations = table(spark, d, "vertices"), table(spark, d, "stations")
    return references.orphan_edges(table(spark, d, "edges"), vertices, stations).unionByName(references.short_files(table(spark, d, "file_header"), vertices))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, reason and month."""
    return references.orphan_report(_orphans(spark, d))


def _locations(spark: SparkSession, d: str) -> DataFrame:
    return proximity.locations(table(spark, d, "vertices"), table(spark, d, "stations"), table(spark, d, "file_header"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    points = stored(_locations(spark, d), "points")
    near = proximity.near_pairs(points, NEAR_M).select(F.lit("near").alias("kind"), F.col("fid_a").alias("key_a"), F.col("fid_b").alias("key_b"))
    return near.unionByName(_inside(points, proximity.region_rects(table(spark, d, "regions")), "region")).unionByName(
        _inside(points.where(F.col("file_id").isNotNull()), proximity.envelopes(table(spark, d, "file_header")), "envelope")
    )


def _inside(points: DataFrame, rects: DataFrame, kind: str) -> DataFrame:
    return proximity.points_in_rects(points, rects).select(F.lit(kind).alias("kind"), F.col("rect_id").alias("key_a"), F.col("fid").alias("key_b"))


def p3_near_classes(spark: SparkSession, d: str) -> DataFrame:
    """The compact form of the near pairs: pairs of positions, each named by its smallest ``fid``; see ``p3_membership``."""
    return proximity.near_classes(stored(_locations(spark, d), "points"), NEAR_M).select("rep_a", "rep_b")


def p3_membership(spark: SparkSession, d: str) -> DataFrame:
    """The position class of every location."""
    return proximity.membership(stored(_locations(spark, d), "points")).select("fid", F.col("rep").alias("class_id"))


def p3_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Locations in the polygons of vertices."""
    polys = stored(proximity.polygons(table(spark, d, "vertices"), table(spark, d, "file_header")), "polygons")
    return proximity.points_in_polygons(stored(_locations(spark, d), "points"), polys)


def p3_region_counts(spark: SparkSession, d: str) -> DataFrame:
    """Locations per region."""
    inside = proximity.points_in_rects(_locations(spark, d), proximity.region_rects(table(spark, d, "regions")))
    return inside.groupBy(F.col("rect_id").alias("region_id")).agg(F.count(F.lit(1)).alias("n_locations"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(table(spark, d, "edges"), HOT_SHARE).select("ref_field", "ref_key")


def p4_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """Edges, distinct partners and latest time of every key."""
    return skew.key_totals(table(spark, d, "edges"))


def p4_kind_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Edges joined with all rows of their source vertex, rolled up by kind and file of the vertex, without joining rows."""
    edges = table(spark, d, "edges").select(F.col("src").alias("fid"), F.col("recorded_at"))
    vertices = table(spark, d, "vertices").select("fid", F.lower(F.trim("kind")).alias("kind"), "capacity")
    return skew.eager_join_aggregate(
        edges, vertices, ["fid"], [], ["kind"],
        [("both", "count", "", "n_rows"), ("left", "max", "recorded_at", "last_at"), ("right", "max", "capacity", "max_capacity")],
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "file_header"), table(spark, d, "graph_header"), table(spark, d, "edges"))


def p5_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """Islands of each field and type: first and last version, versions and starts after the first."""
    catalogue = drift.lifespans(drift.versions(drift.column_lists(table(spark, d, "file_header"), table(spark, d, "graph_header"))))
    return catalogue.groupBy("dataset_id", "section", "column_name", "type").agg(
        F.min("version").alias("first_version"), F.max("version").alias("last_version"), F.count(F.lit(1)).alias("n_versions"), F.sum(F.col("starts").cast("bigint")).alias("n_starts")
    ).withColumns({c: F.col(c).cast("bigint") for c in ("first_version", "last_version")})


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """The edges as one table under their oldest column names, all that no column takes in the map ``other``."""
    return drift.consistent_edges(table(spark, d, "edges"), table(spark, d, "file_header"), table(spark, d, "graph_header"))


def p5_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """The properties of the delivered features as one table, as ``p5_table`` has those of the edges."""
    headers = table(spark, d, "file_header")
    aliases = drift.aliases_of(headers, table(spark, d, "graph_header"), "feature")
    rows = geojson.payload_properties(table(spark, d, "raw_features").select("raw_id", "payload", "file_id"), "raw_id", "payload", "file_id")
    return drift.consistent_table(rows, ["id", "position", "file_id"], "properties", headers, aliases).withColumnRenamed("id", "raw_id")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """The consistent edge table in long form, counted: per data set and name how many values edges have, how many under another name, and the largest of those that are numbers."""
    headers = table(spark, d, "file_header")
    aliases = drift.aliases_of(headers, table(spark, d, "graph_header"), "edge")
    rows = drift.distinct_edges(table(spark, d, "edges"))
    cells = drift.placed_values(rows, ["eid"], "properties", headers, aliases).select("dataset_id", F.explode("values").alias("v"))
    number = F.col("v.value").try_cast("double")
    return cells.groupBy("dataset_id", F.col("v.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("v.key") != F.col("v.name")).alias("n_renamed"), F.max(F.when(~F.isnan(number), number)).alias("largest")
    )


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_entities, p1_edge_entities, p1_geometry_entities, p1_coordinates, p1_node_kinds, p2_found, p2_report, p3_found, p3_near_classes, p3_membership, p3_in_polygons, p3_region_counts, p4_found, p4_key_totals, p4_kind_rollup, p5_found, p5_lifespans, p5_table, p5_feature_table, p5_values)
}

_ORPHANS = """
WITH refs AS (
  SELECT eid AS ref_id, 'src' AS ref_field, min(src) AS ref_key, min(recorded_at) AS recorded_at, min(ingested_at) AS seen_at FROM edges GROUP BY eid
  UNION ALL
  SELECT eid, 'dst', min(dst), min(recorded_at), min(ingested_at) FROM edges GROUP BY eid
), parents AS (
  SELECT fid, min(ingested_at) AS first_seen, min(deleted_at) AS deleted
  FROM (SELECT fid, ingested_at, deleted_at FROM vertices UNION ALL SELECT fid, ingested_at, deleted_at FROM stations) GROUP BY fid
), orphans AS (
  SELECT 'edges' AS ref_table, ref_id, ref_field,
    CASE WHEN p.fid IS NULL THEN 'missing' WHEN deleted <= recorded_at THEN 'deleted' WHEN first_seen > seen_at THEN 'late' END AS reason,
    strftime(recorded_at, '%Y-%m') AS period
  FROM refs LEFT JOIN parents p ON p.fid = refs.ref_key WHERE ref_key IS NOT NULL
  UNION ALL
  SELECT 'file_header', h.file_id, 'features_count', 'missing', strftime(h.written_at, '%Y-%m')
  FROM (SELECT file_id, max(features_count) AS n, min(written_at) AS written_at FROM file_header GROUP BY file_id) h
  LEFT JOIN (SELECT file_id, count(DISTINCT fid) AS have FROM vertices GROUP BY file_id) v USING (file_id)
  WHERE h.n > coalesce(have, 0)
)
"""

_LOCATIONS = """
WITH headers AS (SELECT DISTINCT ON (file_id) file_id, crs.code AS code, envelope FROM file_header ORDER BY file_id),
placed AS (
  SELECT fid, v.file_id,
    CASE WHEN code = 3857 THEN degrees(xy[1] / 6378137) ELSE xy[1] END AS lon,
    CASE WHEN code = 3857 THEN degrees(2 * atan(exp(xy[2] / 6378137)) - pi() / 2) ELSE xy[2] END AS lat
  FROM (SELECT DISTINCT ON (fid) fid, file_id, geom.xy AS xy FROM vertices WHERE geom.type = 1 ORDER BY fid) v LEFT JOIN headers USING (file_id)
  UNION ALL
  SELECT fid, NULL, geom.xy[1], geom.xy[2] FROM (SELECT DISTINCT ON (fid) * FROM stations WHERE geom.type = 1 ORDER BY fid)
), locations AS (
  SELECT * FROM placed WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT isnan(lon) AND NOT isnan(lat) AND NOT (lon = 0 AND lat = 0)
), region_rects AS (
  SELECT DISTINCT region_id, minx, miny, maxx, maxy FROM regions
  WHERE minx IS NOT NULL AND miny IS NOT NULL AND maxx IS NOT NULL AND maxy IS NOT NULL AND NOT isnan(minx) AND NOT isnan(miny) AND NOT isnan(maxx) AND NOT isnan(maxy)
), in_region AS (
  SELECT region_id, fid FROM locations JOIN region_rects
  ON lat BETWEEN miny AND maxy AND CASE WHEN minx > maxx THEN lon >= minx OR lon <= maxx ELSE lon BETWEEN minx AND maxx END
)
"""

_CLASSES = ", classes AS (SELECT lon, lat, min(fid) AS rep FROM locations GROUP BY lon, lat)"
#: Each side of each ring of the polygons, in degrees: the last position leads back to the ring's first
_POLYGONS = """
, shapes AS (
  SELECT fid AS poly_id, coalesce(code = 3857, false) AS metric, unnest(CASE WHEN geom.type = 3 THEN [{'xy': geom.xy, 'ends': geom.ends}] ELSE list_transform(geom.parts, lambda p: {'xy': p.xy, 'ends': p.ends}) END) AS s
  FROM (SELECT DISTINCT ON (fid) fid, file_id, geom FROM vertices WHERE geom.type IN (3, 6) ORDER BY fid) LEFT JOIN headers USING (file_id)
), cut AS (
  SELECT poly_id, metric, s.xy AS xy, CASE WHEN len(s.ends) > 0 THEN s.ends ELSE [CAST(len(s.xy) // 2 AS INTEGER)] END AS ends FROM shapes WHERE s.xy IS NOT NULL
), rings AS (
  SELECT poly_id, metric, xy, unnest(list_transform(ends, lambda e, i: {'a': CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END, 'b': e})) AS r FROM cut
), steps AS (
  SELECT poly_id, metric, xy, i, CASE WHEN i + 1 < r.b THEN i + 1 ELSE r.a END AS j FROM (SELECT *, unnest(range(r.a, r.b)) AS i FROM rings)
), raw_sides AS (
  SELECT poly_id, metric, xy[2 * i + 1] AS u1, xy[2 * i + 2] AS v1, xy[2 * j + 1] AS u2, xy[2 * j + 2] AS v2 FROM steps
), sides AS (
  SELECT poly_id, CASE WHEN metric THEN degrees(u1 / 6378137) ELSE u1 END AS x1, CASE WHEN metric THEN degrees(2 * atan(exp(v1 / 6378137)) - pi() / 2) ELSE v1 END AS y1,
    CASE WHEN metric THEN degrees(u2 / 6378137) ELSE u2 END AS x2, CASE WHEN metric THEN degrees(2 * atan(exp(v2 / 6378137)) - pi() / 2) ELSE v2 END AS y2
  FROM raw_sides WHERE poly_id NOT IN (SELECT poly_id FROM raw_sides WHERE u1 IS NULL OR v1 IS NULL OR isnan(u1) OR isnan(v1))
)
"""

SQL = {
    **problem_sql.P1,
    **problem_sql.P5,
    "p2_found": _ORPHANS + "SELECT * FROM orphans WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS + "SELECT ref_table, ref_field, reason, period, count(*) AS n_refs FROM orphans WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _LOCATIONS
    + """, raw_env AS (
  SELECT file_id, CASE WHEN code = 3857 THEN [degrees(envelope[1] / 6378137), degrees(2 * atan(exp(envelope[2] / 6378137)) - pi() / 2), degrees(envelope[3] / 6378137),
    degrees(2 * atan(exp(envelope[4] / 6378137)) - pi() / 2)] ELSE envelope END AS e
  FROM headers WHERE len(envelope) = 4 AND envelope[1] IS NOT NULL AND envelope[2] IS NOT NULL AND envelope[3] IS NOT NULL AND envelope[4] IS NOT NULL
), env AS (SELECT file_id, e[1] AS minx, e[2] AS miny, e[3] AS maxx, e[4] AS maxy FROM raw_env WHERE NOT (isnan(e[1]) OR isnan(e[2]) OR isnan(e[3]) OR isnan(e[4]))),
banded AS (SELECT fid, lon, lat, CAST(floor(lat * 1000) AS BIGINT) AS band FROM locations)
SELECT 'near' AS kind, a.fid AS key_a, b.fid AS key_b FROM banded a JOIN (SELECT fid, lon, lat, unnest([band - 1, band, band + 1]) AS band FROM banded) b
  ON a.band = b.band AND a.fid < b.fid AND abs(a.lat - b.lat) < 0.0005
  AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50
UNION ALL SELECT 'region', region_id, fid FROM in_region
UNION ALL SELECT 'envelope', env.file_id, fid FROM locations l JOIN env
  ON l.file_id <> env.file_id AND lat BETWEEN miny AND maxy AND CASE WHEN minx > maxx THEN lon >= minx OR lon <= maxx ELSE lon BETWEEN minx AND maxx END""",
    "p3_near_classes": _LOCATIONS + _CLASSES + """, banded AS (SELECT rep, lon, lat, CAST(floor(lat * 1000) AS BIGINT) AS band FROM classes)
SELECT a.rep AS rep_a, b.rep AS rep_b FROM banded a JOIN (SELECT rep, lon, lat, unnest([band - 1, band, band + 1]) AS band FROM banded) b
  ON a.band = b.band AND a.rep < b.rep AND abs(a.lat - b.lat) < 0.0005
  AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50""",
    "p3_membership": _LOCATIONS + _CLASSES + " SELECT fid, rep AS class_id FROM locations JOIN classes USING (lon, lat)",
    "p3_in_polygons": _LOCATIONS + _POLYGONS + """
SELECT poly_id, fid FROM (
  SELECT poly_id, fid, count(*) FILTER (((y1 <= lat AND lat < y2) OR (y2 <= lat AND lat < y1)) AND x1 + (lat - y1) / nullif(y2 - y1, 0) * (x2 - x1) < lon) AS crossed
  FROM locations JOIN (SELECT poly_id, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM sides GROUP BY poly_id) ON lon BETWEEN bx0 AND bx1 AND lat BETWEEN by0 AND by1 JOIN sides USING (poly_id)
  GROUP BY poly_id, fid
) WHERE crossed % 2 = 1""",
    "p3_region_counts": _LOCATIONS + "SELECT region_id, count(*) AS n_locations FROM in_region GROUP BY region_id",
    "p4_found": """
WITH ends AS (SELECT 'src' AS ref_field, src AS ref_key FROM edges UNION ALL SELECT 'dst', dst FROM edges)
SELECT ref_field, ref_key FROM ends WHERE ref_key IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM edges)""",
    "p4_key_totals": """
WITH ends AS (SELECT 'src' AS ref_field, src AS ref_key, dst AS partner, recorded_at FROM edges UNION ALL SELECT 'dst', dst, src, recorded_at FROM edges)
SELECT ref_field, ref_key, count(*) AS n_edges, count(DISTINCT partner) AS n_partners, max(recorded_at) AS last_at FROM ends WHERE ref_key IS NOT NULL GROUP BY ALL""",
    "p4_kind_rollup": """
SELECT lower(trim(kind)) AS kind, count(*) AS n_rows, max(e.recorded_at) AS last_at, max(v.capacity) AS max_capacity
FROM edges e JOIN vertices v ON v.fid = e.src GROUP BY lower(trim(kind))""",
    "p5_lifespans": """
WITH files AS (SELECT file_id, min(dataset_id) AS dataset_id, min(written_at) AS written_at, first(feature_columns) FILTER (feature_columns IS NOT NULL) AS cols FROM file_header GROUP BY file_id),
graphs AS (SELECT file_id, first(edge_columns) FILTER (edge_columns IS NOT NULL) AS cols FROM graph_header GROUP BY file_id),
lists AS (
  SELECT 'feature' AS section, file_id, dataset_id, written_at, cols FROM files WHERE cols IS NOT NULL
  UNION ALL SELECT 'edge', f.file_id, dataset_id, written_at, g.cols FROM files f JOIN graphs g USING (file_id) WHERE g.cols IS NOT NULL
), numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, section ORDER BY written_at, file_id) AS version FROM lists),
fields AS (SELECT dataset_id, section, version, c.name AS column_name, CAST(arg_min(c.type, i) AS INTEGER) AS type FROM (SELECT dataset_id, section, version, unnest(cols) AS c, unnest(range(len(cols))) AS i FROM numbered) WHERE c.name IS NOT NULL GROUP BY ALL),
gaps AS (SELECT *, version - lag(version) OVER (PARTITION BY dataset_id, section, column_name, type ORDER BY version) AS gap FROM fields)
SELECT dataset_id, section, column_name, type, min(version) AS first_version, max(version) AS last_version, count(*) AS n_versions,
  CAST(sum(CASE WHEN version > 1 AND coalesce(gap, 0) <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_starts
FROM gaps GROUP BY ALL""",
}
