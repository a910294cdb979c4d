"""SQL of the problems that takes recursion: nested records and schema drift."""

# A string whose content is an object or list stands for it, up to three times over
_UNWRAP = """SELECT * EXCLUDE (v), CASE WHEN json_type(v) = 'VARCHAR' AND left(ltrim(v->>'$', ' ' || chr(9) || chr(10) || chr(13)), 1) IN ('{{', '[')
  AND json_type(TRY_CAST(v->>'$' AS JSON)) IN ('OBJECT', 'ARRAY') THEN TRY_CAST(v->>'$' AS JSON) ELSE v END AS v FROM ({0})"""


def unwrapped(query: str) -> str:
    return _UNWRAP.format(_UNWRAP.format(_UNWRAP.format(query)))


_MEMBER = "json_extract({0}, '/' || replace(replace({1}, '~', '~0'), '/', '~1'))"

#: tree: every value of both tables with its path, its nearest object's, the last key and the list positions since
TREE = f"""
WITH RECURSIVE docs AS (
  SELECT DISTINCT 'edges' AS record_table, eid AS record_id, properties AS text FROM edges UNION ALL SELECT 'raw_features', raw_id, payload FROM raw_features
), tree AS (
  SELECT record_table, record_id, '$' AS path, CAST(NULL AS VARCHAR) AS parent_path, '' AS obj_path, '$' AS entity, CAST([] AS INTEGER[]) AS positions, v
  FROM ({unwrapped("SELECT record_table, record_id, TRY_CAST(text AS JSON) AS v FROM docs WHERE json_valid(text)")})
  UNION ALL
  SELECT record_table, record_id, path, obj_path AS parent_path, obj_path, entity, positions, v
  FROM ({unwrapped(f'''
    SELECT record_table, record_id, path || '/' || k AS path, path AS obj_path, k AS entity, CAST([] AS INTEGER[]) AS positions, {_MEMBER.format("o", "k")} AS v
    FROM (SELECT record_table, record_id, path, v AS o, unnest(json_keys(v)) AS k FROM tree WHERE json_type(v) = 'OBJECT')
    UNION ALL
    SELECT record_table, record_id, path || '/' || i, obj_path, entity, list_append(positions, i), json_extract(a, '$[' || i || ']')
    FROM (SELECT record_table, record_id, path, obj_path, entity, positions, v AS a, CAST(unnest(range(CAST(json_array_length(v) AS BIGINT))) AS INTEGER) AS i FROM tree WHERE json_type(v) = 'ARRAY')
  ''')})
)
"""
_KIND = "CASE json_type({0}) WHEN 'OBJECT' THEN '{1}' WHEN 'ARRAY' THEN '{2}' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_AXIS = "CASE WHEN json_type(v, '$[{0}]') NOT IN ('BOOLEAN', 'NULL', 'OBJECT', 'ARRAY') THEN TRY_CAST(json_extract_string(v, '$[{0}]') AS DOUBLE) END"

P1 = {
    "p1_found": TREE + "SELECT DISTINCT record_table, record_id, path AS node_path, parent_path FROM tree WHERE json_type(v) = 'OBJECT' AND path <> '$'",
    "p1_node_kinds": TREE + f"SELECT {_KIND.format('v', 'object', 'list')} AS kind, count(*) AS n_nodes FROM tree WHERE record_table = 'edges' GROUP BY ALL",
    "p1_geometry_entities": TREE
    + """SELECT record_id AS raw_id, path, parent_path, entity, json_extract_string(v, '/type') AS type FROM tree
WHERE record_table = 'raw_features' AND json_type(v) = 'OBJECT' AND entity IN ('geometry', 'geometries', '$') AND json_type(v, '/type') NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p1_edge_entities": TREE
    + f"""SELECT o.record_id AS eid, o.path, o.parent_path, o.entity, max(CASE WHEN s.entity = 'status' THEN s.v->>'$' END) AS status, TRY_CAST(max(CASE WHEN s.entity = 'weight' THEN s.v->>'$' END) AS DOUBLE) AS weight, count(s.path) AS n_fields
FROM tree o LEFT JOIN tree s ON s.record_table = 'edges' AND s.record_id = o.record_id AND s.path = o.path || '/' || s.entity AND {_KIND.format('s.v', 'object', 'list')} IN ('string', 'number', 'boolean')
WHERE o.record_table = 'edges' AND json_type(o.v) = 'OBJECT' GROUP BY ALL""",
    "p1_coordinates": TREE
    + f"""SELECT raw_id, nullif(obj_path, '') AS geometry, positions[-3] AS polygon, positions[-2] AS ring, positions[-1] AS position, x, y, z FROM (
  SELECT record_id AS raw_id, obj_path, positions, {_AXIS.format(0)} AS x, {_AXIS.format(1)} AS y, {_AXIS.format(2)} AS z FROM tree WHERE record_table = 'raw_features' AND json_type(v) = 'ARRAY' AND entity = 'coordinates'
) WHERE x IS NOT NULL AND y IS NOT NULL""",
}

_MEMBERS = unwrapped("SELECT raw_id, v AS o, json_extract(v, '/features') AS v FROM features")
_LISTED = f"SELECT raw_id, o, CASE WHEN json_type(o) = 'ARRAY' THEN CAST(o AS JSON[]) WHEN json_type(o) = 'OBJECT' AND json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) WHEN json_type(o) = 'OBJECT' AND json_type(v) = 'OBJECT' THEN [v] END AS members FROM ({_MEMBERS})"
#: The features in the payloads whatever they are wrapped in, and how many say that they have no geometry
FEATURE_COUNTS = f"""
WITH RECURSIVE features AS (
  SELECT raw_id, v FROM ({unwrapped("SELECT raw_id, CASE WHEN json_valid(payload) THEN TRY_CAST(payload AS JSON) END AS v FROM raw_features")})
  UNION ALL SELECT raw_id, v FROM ({unwrapped(f"SELECT raw_id, unnest(members) AS v FROM ({_LISTED})")})
), leaves AS (
  SELECT raw_id, members IS NOT NULL OR coalesce(json_type(o) = 'OBJECT' AND (json_extract_string(o, '/type') = 'Feature' OR list_contains(json_keys(o), 'geometry')) AND coalesce(json_type(o, '/geometry'), 'NULL') = 'NULL', false) AS none
  FROM ({_LISTED}) WHERE members IS NULL OR len(members) = 0
)
SELECT raw_id, count(*) AS n_features, count(*) FILTER (none) AS n_none FROM leaves GROUP BY raw_id"""

_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\W_]+'), lambda w: w <> '')"
_FLAT = "regexp_replace(lower({0}), '[\\W_]+', '', 'g')"
_BARE = "nullif(trim(regexp_replace({0}, '( \\(rev\\.\\)| \\*)+$', '')), '')"

#: pairs: the renames of each version, the best evidence first, each name once
CHANGES = f"""
WITH RECURSIVE files AS (
  SELECT file_id, min(dataset_id) AS dataset_id, min(written_at) AS written_at, first(feature_columns) FILTER (feature_columns IS NOT NULL) AS cols FROM file_header WHERE file_id IS NOT NULL GROUP BY file_id
), graphs AS (
  SELECT file_id, first(edge_columns) FILTER (edge_columns IS NOT NULL) AS cols FROM graph_header WHERE file_id IS NOT NULL GROUP BY file_id
), lists AS (
  SELECT 'feature' AS section, file_id, dataset_id, written_at, cols FROM files WHERE cols IS NOT NULL
  UNION ALL SELECT 'edge', f.file_id, dataset_id, written_at, g.cols FROM files f JOIN graphs g USING (file_id) WHERE g.cols IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, section ORDER BY written_at, file_id) AS version FROM lists WHERE dataset_id IS NOT NULL AND written_at IS NOT NULL
), fields AS (
  SELECT dataset_id, section, version, c.name AS name, arg_min(c, i) AS c FROM (SELECT dataset_id, section, version, unnest(cols) AS c, unnest(range(len(cols))) AS i FROM numbered) WHERE c.name IS NOT NULL GROUP BY ALL
), gone AS (
  SELECT f.dataset_id, f.section, f.version + 1 AS version, f.name, f.c FROM fields f JOIN numbered n ON n.dataset_id = f.dataset_id AND n.section = f.section AND n.version = f.version + 1
  WHERE NOT EXISTS (FROM fields x WHERE x.dataset_id = f.dataset_id AND x.section = f.section AND x.name = f.name AND x.version = f.version + 1)
), come AS (
  SELECT f.* FROM fields f WHERE f.version > 1 AND NOT EXISTS (FROM fields x WHERE x.dataset_id = f.dataset_id AND x.section = f.section AND x.name = f.name AND x.version = f.version - 1)
), evidence AS (
  SELECT g.dataset_id, g.section, g.version, g.name AS g, c.name AS c, g.c.type AS gt, c.c.type AS ct, coalesce({_BARE.format('g.c.title')} = {_BARE.format('c.c.title')}, false) AS title,
    coalesce(g.c.description <> '' AND g.c.description = c.c.description, false) AS told,
    len(list_intersect({_WORDS.format('g.name')}, {_WORDS.format('c.name')})) > 0 OR ({_FLAT.format('g.name')} = {_FLAT.format('c.name')} AND {_FLAT.format('g.name')} <> '') AS near
  FROM gone g JOIN come c ON c.dataset_id = g.dataset_id AND c.section = g.section AND c.version = g.version
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, section, version
    ORDER BY title OR told DESC, CAST(title AS INTEGER) + CAST(told AS INTEGER) DESC, near DESC, gt IS DISTINCT FROM ct, g, c) AS rank
  FROM evidence WHERE title OR told OR near
), greedy AS (
  SELECT DISTINCT dataset_id, section, version, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS gs, CAST([] AS VARCHAR[]) AS cs FROM ranked
  UNION ALL
  SELECT q.dataset_id, q.section, q.version, k.rank, CASE WHEN list_contains(gs, k.g) OR list_contains(cs, k.c) THEN gs ELSE list_append(gs, k.g) END,
    CASE WHEN list_contains(gs, k.g) OR list_contains(cs, k.c) THEN cs ELSE list_append(cs, k.c) END
  FROM greedy q JOIN ranked k ON k.dataset_id = q.dataset_id AND k.section = q.section AND k.version = q.version AND k.rank = q.rank + 1
), pairs AS (
  SELECT dataset_id, section, version, unnest(gs) AS g, unnest(cs) AS c FROM (SELECT *, max(rank) OVER (PARTITION BY dataset_id, section, version) AS last FROM greedy) WHERE rank = last
)"""

P5 = {
    "p5_found": CHANGES
    + f""", declared AS (
  SELECT dataset_id, section, version, 'renamed' AS change, c AS column_name FROM pairs
  UNION ALL SELECT p.dataset_id, p.section, p.version, 'retyped', p.c FROM pairs p JOIN evidence e USING (dataset_id, section, version, g, c) WHERE e.gt IS DISTINCT FROM e.ct
  UNION ALL SELECT a.dataset_id, a.section, b.version, 'retyped', a.name FROM fields a JOIN fields b ON b.dataset_id = a.dataset_id AND b.section = a.section AND b.name = a.name AND b.version = a.version + 1 WHERE a.c.type <> b.c.type
  UNION ALL SELECT dataset_id, section, version, 'removed', name FROM gone WHERE (dataset_id, section, version, name) NOT IN (SELECT dataset_id, section, version, g FROM pairs)
  UNION ALL SELECT dataset_id, section, version, 'added', name FROM come WHERE (dataset_id, section, version, name) NOT IN (SELECT dataset_id, section, version, c FROM pairs)
), objects AS (
  SELECT file_id, v FROM ({unwrapped("SELECT file_id, TRY_CAST(properties AS JSON) AS v FROM edges WHERE file_id IS NOT NULL AND json_valid(properties)")}) WHERE json_type(v) = 'OBJECT'
), held AS (
  SELECT DISTINCT file_id, k AS column_name, {_KIND.format(_MEMBER.format('v', 'k'), 'nested', 'nested')} AS kind FROM (SELECT file_id, v, unnest(json_keys(v)) AS k FROM objects)
), listed AS (
  SELECT file_id, c.name AS column_name, min(c.type) AS type FROM (SELECT file_id, unnest(cols) AS c FROM graphs WHERE cols IS NOT NULL) WHERE c.name IS NOT NULL GROUP BY ALL
)
SELECT DISTINCT n.file_id, d.section, change, column_name FROM declared d JOIN numbered n USING (dataset_id, section, version)
UNION SELECT file_id, 'edge', 'undeclared', column_name FROM held JOIN (SELECT file_id FROM graphs WHERE cols IS NOT NULL) USING (file_id) WHERE (file_id, column_name) NOT IN (SELECT file_id, column_name FROM listed)
UNION SELECT file_id, 'edge', 'mistyped', column_name FROM held JOIN listed USING (file_id, column_name)
  WHERE kind <> 'null' AND kind <> CASE WHEN type = 2 THEN 'boolean' WHEN type IN (11, 13) THEN 'string' WHEN type = 12 THEN 'nested' WHEN type BETWEEN 0 AND 10 THEN 'number' END""",
    "p5_values": CHANGES
    + f""", names AS (
  SELECT dataset_id, name, min(version) AS version FROM fields WHERE section = 'edge' GROUP BY ALL
), links AS (
  SELECT n.dataset_id, n.name, p.g AS old FROM names n LEFT JOIN pairs p ON p.section = 'edge' AND p.dataset_id = n.dataset_id AND p.version = n.version AND p.c = n.name
), roots AS (
  SELECT dataset_id, name, name AS root, old FROM links
  UNION ALL SELECT r.dataset_id, r.name, l.name, l.old FROM roots r JOIN links l ON l.dataset_id = r.dataset_id AND l.name = r.old
), once AS (
  SELECT eid, arg_min(file_id, properties) AS file_id, min(properties) AS properties FROM edges WHERE eid IS NOT NULL AND properties IS NOT NULL GROUP BY eid
), objects AS (
  SELECT file_id, v FROM ({unwrapped("SELECT file_id, TRY_CAST(properties AS JSON) AS v FROM once WHERE json_valid(properties)")}) WHERE json_type(v) = 'OBJECT'
), cells AS (
  SELECT f.dataset_id, k, {_MEMBER.format('v', 'k')} AS v FROM (SELECT file_id, v, unnest(json_keys(v)) AS k FROM objects) o LEFT JOIN files f USING (file_id)
)
SELECT c.dataset_id, coalesce(r.root, k) AS name, count(*) AS n_values, count(*) FILTER (k <> coalesce(r.root, k)) AS n_renamed, max(CASE WHEN NOT isnan(TRY_CAST(v->>'$' AS DOUBLE)) THEN TRY_CAST(v->>'$' AS DOUBLE) END) AS largest
FROM cells c LEFT JOIN (SELECT * FROM roots WHERE old IS NULL) r ON r.dataset_id = c.dataset_id AND r.name = c.k WHERE json_type(v) <> 'NULL' GROUP BY ALL""",
}
