"""Schemas that drift between the files of a data set: a catalogue of column lifespans.

The column lists in the headers are exploded; per producer (data set and section), field and type, ``lag`` and ``lead`` over the versions cut each field's
appearances into islands, whose starts and ends are the changes. Starts and ends in the same version are paired into renames; the pairs form an alias table,
from which casts into one consistent table are generated.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.common import distinct_names, stored
from vertexloom.operators.shred import Lexeme, parse, unwrap

# Column type codes and the JSON kind each allows
TYPE_KINDS = {
    0: "number", 1: "number", 2: "boolean", 3: "number", 4: "number", 5: "number", 6: "number", 7: "number", 8: "number", 9: "number", 10: "number",
    11: "string", 12: "nested", 13: "string",
}
# Column type codes and the SQL type of a column in the consistent table
TYPE_SQL = {
    0: "tinyint", 1: "smallint", 2: "boolean", 3: "smallint", 4: "int", 5: "int", 6: "bigint", 7: "bigint", 8: "decimal(20,0)", 9: "float", 10: "double",
    11: "string", 12: "string", 13: "string", 14: "string",
}


def column_lists(file_header: DataFrame, graph_header: DataFrame) -> DataFrame:
    """(section, file_id, dataset_id, written_at, columns): both column lists of every file that has a list, once per file.

    Files without ``file_id``, ``dataset_id`` or ``written_at`` have no place in a history and are left out. Null lists are passed over, an empty list is a list.
    Of repeated headers one list is taken (they are equal).
    """
    lean = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["type"].cast("int").alias("type"), x["title"].alias("title"), x["description"].alias("description")))
    files = (
        file_header.where(F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.min("dataset_id").alias("dataset_id"), F.min("written_at").alias("written_at"), F.first("feature_columns", True).alias("cols"))
        .where(F.col("dataset_id").isNotNull() & F.col("written_at").isNotNull())
    )
    edges = graph_header.groupBy("file_id").agg(F.first("edge_columns", True).alias("ecols"))
    both = files.join(edges, "file_id", "left").select(
        "file_id", "dataset_id", "written_at",
        F.explode(F.array(F.struct(F.lit("feature").alias("section"), lean(F.col("cols")).alias("columns")), F.struct(F.lit("edge").alias("section"), lean(F.col("ecols")).alias("columns")))).alias("s"),
    )
    return both.select("s.section", "file_id", "dataset_id", "written_at", "s.columns").where(F.col("columns").isNotNull())


def edge_lists(graph_header: DataFrame) -> DataFrame:
    """(section, file_id, columns): the edge list of every file that has one, with or without a place in a history."""
    lists = graph_header.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.first("edge_columns", True).alias("columns"))
    return lists.where(F.col("columns").isNotNull()).select(F.lit("edge").alias("section"), "file_id", "columns")


def versions(lists: DataFrame) -> DataFrame:
    """Adds ``version``: 1, 2, … per data set and section in the order of ``written_at`` (ties: ``file_id``)."""
    order = Window.partitionBy("dataset_id", "section").orderBy("written_at", "file_id")
    keys = lists.select("dataset_id", "section", "file_id", "written_at").withColumn("version", F.row_number().over(order))  # the lists themselves stay where they are
    return lists.join(keys.select("section", "file_id", "version"), ["section", "file_id"])


def lifespans(versioned: DataFrame) -> DataFrame:
    """The catalogue: a row per file and column with flags where an island of its field and type starts or ends.

    (dataset_id, section, column_name, type, title, description, file_id, version, starts, ends). ``starts``: the previous version lacks the field in this type; ``ends``: the next one does. A name
    repeated in a list counts once.
    """
    last = versioned.groupBy("dataset_id", "section").agg(F.max("version").alias("last_version"))
    cols = versioned.select("dataset_id", "section", "file_id", "version", F.posexplode("columns").alias("pos", "c")).where(F.col("c.name").isNotNull())
    once = cols.groupBy("dataset_id", "section", "file_id", "version", F.col("c.name").alias("column_name")).agg(F.min(F.struct("pos", "c.type", "c.title", "c.description")).alias("c"))
    once = once.withColumn("type", F.col("c.type"))
    field = Window.partitionBy("dataset_id", "section", "column_name", "type").orderBy("version")
    gap_before, gap_after = F.col("version") - F.lag("version").over(field), F.lead("version").over(field) - F.col("version")
    return (
        once.select("dataset_id", "section", "column_name", "type", "c.title", "c.description", "file_id", "version", gap_before.alias("_b"), gap_after.alias("_a"))
        .join(last, ["dataset_id", "section"])
        .select(
            "dataset_id", "section", "column_name", "type", "title", "description", "file_id", "version",
            ((F.col("version") > 1) & (F.coalesce("_b", F.lit(0)) != 1)).alias("starts"),
            ((F.col("version") < F.col("last_version")) & (F.coalesce("_a", F.lit(0)) != 1)).alias("ends"),
        )
    )


def bare_title(title: str | None) -> str | None:
    """A title without a trailing revision mark; None if nothing is left."""
    return re.sub(r"(?: \(rev\.\)| \*)+$", "", title).strip() or None if title else None


def words(name: str) -> frozenset[str]:
    """The words of a column name, split at separators and at capitals within."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return frozenset(w for w in re.split(r"[\W_]+", spaced.lower()) if w)


def kindred(a: str, b: str) -> bool:
    """Names that share a word, or differ only in case or separators."""
    flat = lambda s: re.sub(r"[\W_]+", "", s.lower())
    return bool(words(a) & words(b)) or (flat(a) == flat(b) and flat(a) != "")


def pair_renames(gone: list[dict], come: list[dict]) -> list[tuple[str, str]]:
    """(old, new) names, each name in one pair at most: first by title or description, then kindred names; the best evidence goes first."""
    scored = []
    for g in gone:
        for c in come:
            title = bare_title(g["title"]) is not None and bare_title(g["title"]) == bare_title(c["title"])
            told = bool(g["description"]) and g["description"] == c["description"]
            near = kindred(g["column_name"], c["column_name"])
            if title or told or near:
                scored.append((-(title or told), -(title + told), -near, g["type"] != c["type"], g["column_name"], c["column_name"]))
    pairs, used_g, used_c = [], set(), set()
    for *_, g, c in sorted(scored):
        if g not in used_g and c not in used_c:
            used_g.add(g)
            used_c.add(c)
            pairs.append((g, c))
    return pairs


def declared_changes(catalogue: DataFrame) -> DataFrame:
    """(file_id, section, change, column_name, old_name, old_type, new_type, dataset_id, version): what each list changed against the one before.

    Islands give the starts and ends; those of one version, at most a list's length, meet in one Arrow batch to be paired. A field that ends in one type and starts in another is retyped (unless one of the
    codes is null), the others are paired into renames. ``change`` is added, removed, renamed or retyped; a rename with another type gives both.
    """
    side = lambda kind, shift: F.struct(F.lit(kind).alias("kind"), "column_name", "type", "title", "description", (F.col("version") + shift).alias("version"))
    marks = catalogue.select("dataset_id", "section", F.explode(F.array_compact(F.array(F.when(F.col("starts"), side("come", 0)), F.when(F.col("ends"), side("gone", 1))))).alias("m")).select("dataset_id", "section", "m.*")
    per_version = marks.groupBy("dataset_id", "section", "version").agg(F.collect_list(F.struct("kind", "column_name", "type", "title", "description")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("dataset_id", "section", "version", "change", "column_name", "old_name", "old_type", "new_type")}
            for row in batch.to_pylist():
                gone, come = ([m for m in row["marks"] if m["kind"] == k] for k in ("gone", "come"))
                stay = {g["column_name"]: g["type"] for g in gone}
                stay = {c["column_name"]: (stay[c["column_name"]], c["type"]) for c in come if c["column_name"] in stay}
                gone, come = [m for m in gone if m["column_name"] not in stay], [m for m in come if m["column_name"] not in stay]
                types_g, types_c = {g["column_name"]: g["type"] for g in gone}, {c["column_name"]: c["type"] for c in come}
                pairs = pair_renames(gone, come)
                found = [("renamed", c, g, types_g[g], types_c[c]) for g, c in pairs]
                found += [("retyped", c, g, types_g[g], types_c[c]) for g, c in pairs if types_g[g] != types_c[c]]
                found += [("retyped", n, n, a, b) for n, (a, b) in stay.items() if a is not None and b is not None]
                found += [("removed", g, g, types_g[g], None) for g in types_g if g not in {p for p, _ in pairs}]
                found += [("added", c, None, None, types_c[c]) for c in types_c if c not in {p for _, p in pairs}]
                for x in found:
                    for k, v in zip(out, (row["dataset_id"], row["section"], row["version"], *x)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))], names=list(out))

    return per_version.mapInArrow(run, "dataset_id string, section string, version int, change string, column_name string, old_name string, old_type int, new_type int")


def with_files(changes: DataFrame, versioned: DataFrame) -> DataFrame:
    """Adds the ``file_id`` whose list made each change."""
    return changes.join(versioned.select("dataset_id", "section", "version", "file_id"), ["dataset_id", "section", "version"])


def value_kinds(edges: DataFrame) -> DataFrame:
    """(file_id, column_name, kind): the kinds of JSON value that a key of ``properties`` takes in each file, each once.

    kind is boolean, number, string, nested (object or list) or null. Properties that are null, no JSON or no object have no keys; a string whose content is
    an object stands for it. Each Arrow batch is reduced to its distinct rows before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple] = set()
            keys: dict[int, set] = defaultdict(set)
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse(text)[1]
                if type(value) is str:
                    value = unwrap(value)
                if type(value) is dict:
                    keys[file_id].update([(k, type(v)) for k, v in value.items()])
            for file_id, found in keys.items():
                seen.update((file_id, k, _KINDS[t]) for k, t in found)
            cols = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["file_id", "column_name", "kind"])

    rows = edges.where(F.col("file_id").isNotNull() & F.col("properties").isNotNull()).select("file_id", "properties")
    return rows.mapInArrow(run, "file_id bigint, column_name string, kind string").distinct()


_KINDS = {bool: "boolean", int: "number", float: "number", Lexeme: "number", str: "string", dict: "nested", list: "nested", type(None): "null"}


def _allowed(type_code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in TYPE_KINDS.items() for x in pair)), type_code)


def undeclared_values(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """(file_id, section, change, column_name): keys of a file's edges that its list lacks, and listed columns holding another kind of value.

    Only files with an edge list. Columns of type Binary or of an unknown code allow any value.
    """
    listed = lists.where(F.col("section") == "edge").select("file_id", "columns")
    cols = listed.select("file_id", F.explode("columns").alias("c")).where(F.col("c.name").isNotNull()).groupBy("file_id", F.col("c.name").alias("column_name")).agg(F.min("c.type").alias("type"))
    found = value_kinds(edges).join(listed.select("file_id"), "file_id").join(cols.withColumn("_listed", F.lit(True)), ["file_id", "column_name"], "left")
    change = F.when(F.col("_listed").isNull(), "undeclared").when((F.col("kind") != "null") & (_allowed(F.col("type")) != F.col("kind")), "mistyped")
    return found.withColumn("change", change).where(F.col("change").isNotNull()).select("file_id", F.lit("edge").alias("section"), "change", "column_name").distinct()


def schema_changes(file_header: DataFrame, graph_header: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, section, change, column_name): every declared and undeclared change, each once."""
    lists = column_lists(file_header, graph_header)
    versioned = versions(lists)
    declared = with_files(declared_changes(lifespans(versioned)), versioned).select("file_id", "section", "change", "column_name")
    return declared.unionByName(undeclared_values(edges, edge_lists(graph_header))).distinct()


def alias_table(catalogue: DataFrame, changes: DataFrame, section: str = "edge") -> DataFrame:
    """(dataset_id, section, column_name, canonical, type): the one name and type under which each field of a producer is kept.

    A name that first appeared by a rename is followed to the name before, up to the oldest (its ``canonical``). Links lead to names of earlier versions, so
    there are no cycles. Types that differ over a field's life widen: numbers to double, anything else to string.
    """
    keys = ["dataset_id", "section"]
    rows = catalogue.where(F.col("section") == section)
    names = rows.groupBy(*keys, "column_name").agg(F.min("version").alias("version"), F.collect_set("type").alias("types"))
    renamed = changes.where((F.col("section") == section) & (F.col("change") == "renamed")).select(*keys, "column_name", "version", "old_name")
    linked = names.join(renamed, [*keys, "column_name", "version"], "left")
    # The names of one producer meet in one row: as many as its lists ever held.
    packed = linked.groupBy(*keys).agg(F.collect_list(F.struct("column_name", "old_name")).alias("links"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                old = {x["column_name"]: x["old_name"] for x in row["links"]}
                for name in old:
                    root = name
                    while old.get(root) is not None:
                        root = old[root]
                    out.append((*(row[k] for k in keys), name, root))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=[*keys, "column_name", "canonical"])

    roots = packed.mapInArrow(follow, "dataset_id string, section string, column_name string, canonical string")
    typed = roots.join(names.select(*keys, "column_name", "types"), [*keys, "column_name"])
    kinds = typed.groupBy(*keys, "canonical").agg(F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    numeric = F.forall("types", lambda t: t.isin(0, 1, 3, 4, 5, 6, 7, 8, 9, 10))
    wide = F.when(F.size("types") == 1, F.col("types")[0]).when(numeric, F.lit(10)).otherwise(F.lit(11))
    return typed.select(*keys, "column_name", "canonical").join(kinds.select(*keys, "canonical", wide.alias("type")), [*keys, "canonical"]).select(*keys, "column_name", "canonical", "type")


def aliases_of(file_header: DataFrame, graph_header: DataFrame, section: str) -> DataFrame:
    """The stored alias table of a section."""
    catalogue = stored(lifespans(versions(column_lists(file_header, graph_header))), "catalogue")
    return stored(alias_table(catalogue, declared_changes(catalogue), section), "aliases")


def placed_values(rows: DataFrame, keys: list[str], text_col: str, file_header: DataFrame, aliases: DataFrame) -> DataFrame:
    """(keys, dataset_id, values): the values of the JSON object in ``text_col`` under the names that hold for the row's data set (``file_id``).

    ``values`` is an array of struct<name, fit, key, value>: the canonical name, the value as text cast to the field's type (null if it can't be), the row's own key and the value as it was, in the order of
    names and, within one, of cast values, null first. Rows of unknown files and keys that no list of the data set holds keep their own names. JSON nulls are no values; of a key repeated in one object
    the last counts. A string that holds the object stands for it.
    """
    # The names of one producer meet in one row, as in the alias table.
    maps = aliases.groupBy("dataset_id").agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("canonical", "type").alias("to")))).alias("_aliases"))
    producers = file_header.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min("dataset_id").alias("dataset_id")).join(maps, "dataset_id", "left")
    # Reading the text as a member unwraps it.
    text = F.get_json_object(F.concat(F.lit('{"x":'), F.col(text_col), F.lit("}")), "$.x")
    parsed = rows.join(producers, "file_id", "left").select(*keys, "dataset_id", "_aliases", F.from_json(text, "map<string,string>").alias("_map"))
    names = F.reverse(F.map_keys("_map"))
    last = F.filter(F.reverse(F.map_entries("_map")), lambda e, i: e["value"].isNotNull() & (F.array_position(names, e["key"]) == i + 1))

    def place(e: Column) -> Column:
        to = F.try_element_at(F.col("_aliases"), e["key"])
        return F.struct(F.coalesce(to["canonical"], e["key"]).alias("name"), _cast(e["value"], to["type"]).alias("fit"), e["key"].alias("key"), e["value"].alias("value"))

    return parsed.select(*keys, "dataset_id", F.array_sort(F.transform(last, place)).alias("values"))


def consistent_table(rows: DataFrame, keys: list[str], text_col: str, file_header: DataFrame, aliases: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(keys, dataset_id, a text column per canonical name, other): the objects of ``text_col`` as one table.

    Without ``columns`` these are all canonical names of the alias table: the driver gets one row per name. Every property goes through its data set's aliases, whatever columns are asked for. Of several
    values of one field the largest text that can be cast to the field's type is kept. All that has no place in a column (keys without one, values that can't be cast, further values of a field) is in
    the map ``other`` as it was, under its own key; null there if nothing is left over. A column named like a fixed one, or like another but for case, gets trailing underscores.
    """
    if columns is None:
        columns = sorted(r.canonical for r in aliases.select("canonical").distinct().collect())
    placed = placed_values(rows, keys, text_col, file_header, aliases)
    # in the order of values the last of a name is the one to keep
    kept = lambda x, i: x["fit"].isNotNull() & ~F.get(F.col("values"), i + 1)["name"].eqNullSafe(x["name"]) & x["name"].isin(columns)
    entry = lambda k, v: lambda x: F.struct(x[k].alias("key"), x[v].alias("value"))
    split = placed.select(
        *keys, "dataset_id",
        F.map_from_entries(F.transform(F.filter("values", kept), entry("name", "fit"))).alias("_kept"),
        F.map_from_entries(F.transform(F.filter("values", lambda x, i: ~kept(x, i)), entry("key", "value"))).alias("_rest"),
    )
    names = distinct_names(columns, [*keys, "dataset_id", "other"])
    return split.select(*keys, "dataset_id", *(F.try_element_at("_kept", F.lit(c)).alias(n) for c, n in zip(columns, names)), F.when(F.size("_rest") > 0, F.col("_rest")).alias("other"))


_EDGE_KEYS = ["eid", "file_id", "src", "dst", "recorded_at"]


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once: rows with a null ``eid`` are left out; of repeated rows one is taken (they are equal), one with properties before one without."""
    row = F.struct(F.col("properties").isNull().alias("_none"), "properties", "file_id", "src", "dst", "recorded_at")
    return edges.where(F.col("eid").isNotNull()).groupBy("eid").agg(F.min(row).alias("r")).select("eid", "r.*").drop("_none")


def consistent_edges(edges: DataFrame, file_header: DataFrame, graph_header: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All edges as one table: (eid, file_id, src, dst, recorded_at, dataset_id), the canonical columns and ``other``, once per ``eid``; see ``consistent_table``."""
    aliases = aliases_of(file_header, graph_header, "edge")
    return consistent_table(distinct_edges(edges), _EDGE_KEYS, "properties", file_header, aliases, columns)


def _cast(value: Column, code: Column) -> Column:
    """The value cast to the SQL type of the code and back to text; unknown codes leave it as it is."""
    out = value
    for sql_type in dict.fromkeys(t for t in TYPE_SQL.values() if t != "string"):
        out = F.when(code.isin([c for c, t in TYPE_SQL.items() if t == sql_type]), value.try_cast(sql_type).cast("string")).otherwise(out)
    return out
