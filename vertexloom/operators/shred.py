"""Deeply nested records to flat related tables, by adjacency-table shredding.

``shred`` turns every JSON value of a text column into one row of an adjacency table (node, parent, label, ordinal, scalar); ``entity_rows`` joins the object nodes with their scalar children and
pivots these into rows linked to their parents, ``entity_table`` takes one kind of them with its fields as columns, ``coordinate_table`` does the same for lists of numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADJACENCY = (
    "record_id bigint, node int, parent int, object_parent int, label string, ordinal int, "
    "kind string, scalar string, path string, parent_path string, entity string, positions array<int>"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("object_parent", pa.int32()),
        ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("path", pa.string()), ("parent_path", pa.string()),
        ("entity", pa.string()), ("positions", pa.list_(pa.int32())),
    ]
)
_SPACE, _NUMBER = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


class Lexeme(str):
    """A number too long for the interpreter's conversion, as it is written."""


def _integer(digits: str):
    return int(digits) if len(digits) <= 4_000 else Lexeme(digits)


def _parse_deep(text: str):
    """A JSON parser with its own stack, for texts nested too deeply for the standard one. Raises ValueError."""
    end = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple[object, str | None]] = []
    i = end(0)
    while True:
        c = text[i : i + 1]
        opened = c in ("{", "[") and c != ""
        if opened:
            value, i = ({} if c == "{" else []), end(i + 1)
            key = None
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    key, i = _key(text, i, end)
                stack.append((value, key))
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif not text.startswith("-Infinity", i) and (m := _NUMBER.match(text, i)):
            s = m.group()
            value, i = (_integer(s) if s.lstrip("-").isdigit() else float(s)), m.end()
        else:
            for w, v in _WORDS.items():
                if text.startswith(w, i):
                    value, i = v, i + len(w)
                    break
            else:
                raise ValueError("no JSON value")
        while stack:
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            i = end(i)
            c = text[i : i + 1]
            if c == ",":
                i = end(i + 1)
                if isinstance(holder, dict):
                    key, i = _key(text, i, end)
                    stack[-1] = (holder, key)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("no delimiter")
            value, i = stack.pop()[0], i + 1
        else:
            if end(i) != len(text):
                raise ValueError("extra data")
            return value


def _key(text: str, i: int, end) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError("no key")
    key, i = scanstring(text, i + 1, True)
    i = end(i)
    if text[i : i + 1] != ":":
        raise ValueError("no colon")
    return key, end(i + 1)


def parse(text: str | None):
    """(True, value) or (False, None) if the text is null or no JSON. NaN and infinities are numbers; integers of any length and nesting of any depth are read."""
    if text is None:
        return False, None
    try:
        try:
            return True, json.loads(text)
        except json.JSONDecodeError:
            return False, None
        except ValueError:  # too many digits
            return True, json.loads(text, parse_int=_integer)
    except RecursionError:
        try:
            return True, _parse_deep(text)
        except ValueError:
            return False, None


def unwrap(value):
    """A string whose content is a JSON object or list stands for that; anything else for itself."""
    while isinstance(value, str) and not isinstance(value, Lexeme) and value.lstrip(" \t\n\r")[:1] in ("{", "["):
        ok, inner = parse(value)
        if not ok or not isinstance(inner, (dict, list)):
            return value
        value = inner
    return value


class _Rows:
    """Adjacency rows in the making, a list per column."""

    __slots__ = ("ids", "nodes", "parents", "objects", "labels", "ordinals", "kinds", "scalars", "paths", "parent_paths", "entities", "positions")

    def __init__(self):
        for name in self.__slots__:
            setattr(self, name, [])

    def batch(self) -> pa.RecordBatch:
        arrays = []
        for name, f in zip(self.__slots__, _ARROW):
            values = getattr(self, name)
            try:
                arrays.append(pa.array(values, f.type))
            except UnicodeEncodeError:
                arrays.append(pa.array([_clean(v) for v in values], f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def walk(rid: int | None, text: str | None, kinds: frozenset[str], list_scalars: bool, rows: _Rows) -> None:
    """Adds the adjacency rows of one text in pre-order. Scalars in lists aren't even numbered unless they are asked for."""
    ok, root = parse(text)
    if not ok:
        return
    ids, numbers, parents, objects, labels, ordinals = rows.ids.append, rows.nodes.append, rows.parents.append, rows.objects.append, rows.labels.append, rows.ordinals.append
    kind_, scalar_, path_, parent_path_, entity_, position_ = rows.kinds.append, rows.scalars.append, rows.paths.append, rows.parent_paths.append, rows.entities.append, rows.positions.append
    scalars = bool(kinds & SCALARS)
    n = 0
    # value, parent node, nearest object's node and path, label, ordinal, path, last key, list positions since
    stack: list[tuple] = [(unwrap(root), None, None, "", None, None, "$", "$", ())]
    while stack:
        value, parent, obj, obj_path, label, ordinal, path, entity, at = stack.pop()
        node, n = n, n + 1
        t = type(value)
        if t is dict:
            kind = "object"
            for k in reversed(value):
                v = value[k]
                if scalars or isinstance(v, (dict, list, str)):
                    stack.append((unwrap(v) if isinstance(v, str) else v, node, node, path, k, None, f"{path}/{k}", k, ()))
        elif t is list:
            kind = "list"
            for i in range(len(value) - 1, -1, -1):
                v = value[i]
                if list_scalars or isinstance(v, (list, dict, str)):
                    if isinstance(v, str):
                        v = unwrap(v)
                        if isinstance(v, str) and not list_scalars:
                            continue
                    stack.append((v, node, obj, obj_path, str(i), i, f"{path}/{i}", entity, (*at, i)))
        else:
            if value is None:
                kind, scalar = "null", None
            elif value is True or value is False:
                kind, scalar = "boolean", "true" if value else "false"
            elif t is str:
                kind, scalar = "string", value
            else:
                kind, scalar = "number", value if t is Lexeme else repr(value) if t is int else json.dumps(value)
            if kind in kinds:
                ids(rid), numbers(node), parents(parent), objects(obj), labels(label), ordinals(ordinal), kind_(kind), scalar_(scalar), path_(None), parent_path_(None), entity_(None), position_(None)
            continue
        if kind in kinds:
            ids(rid), numbers(node), parents(parent), objects(obj), labels(label), ordinals(ordinal), kind_(kind), scalar_(None), path_(path), parent_path_(obj_path if node else None), entity_(entity), position_(at)


SCALARS = frozenset({"string", "number", "boolean", "null"})
KINDS = frozenset({"object", "list", "string", "number", "boolean", "null"})


def keyed(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with a number far below zero, one per row, in place of each null id, so that records without one stay apart. The numbers hold within one plan only."""
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)) + F.monotonically_increasing_id()))


def shred(df: DataFrame, record_table: str, id_col: str, text_col: str, kinds: Iterable[str] = KINDS, list_scalars: bool = True) -> DataFrame:
    """The adjacency table of a JSON text column: one row per JSON value, numbered in pre-order within its record.

    ``object_parent`` and ``parent_path`` name the nearest enclosing object (null and '' if there is none; the root's parent_path is null). Objects and lists have their ``path``, the last
    key on it as ``entity`` ($ without one) and the list ``positions`` since that key; scalars have these of their parent, so null. ``kinds`` and ``list_scalars`` prune the rows before they leave Python
    (node numbers are then comparable only within this table). Null, empty and unparsable texts yield nothing; a null id is kept (``keyed`` gives such records one, which ``entity_rows`` needs);
    repeated records repeat their rows. Nothing is shuffled.
    """
    kinds = frozenset(kinds)
    src = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(text_col).cast("string").alias("text"))
    src = src.where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows()
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                walk(rid, text, kinds, list_scalars, rows)
                if len(rows.ids) > 20_000:
                    yield rows.batch()
                    rows = _Rows()
            yield rows.batch()

    return src.mapInArrow(run, ADJACENCY).select(F.lit(record_table).alias("record_table"), "*")


def _clean(s: str | None) -> str | None:
    """Lone surrogates (legal in JSON escapes, not in UTF-8) become U+FFFD."""
    if s is None or s.isascii():
        return s
    return s.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in s) else s


def may_nest(text_col: str):
    """False only for texts that can hold no object below the root: their one brace, if any, opens the text."""
    t = F.ltrim(F.col(text_col), F.lit(" \t\n\r"))
    return (F.locate("{", t, 2) > 0) | F.lower(t).contains("\\u007b")


def scalar_labels(adjacency: DataFrame) -> DataFrame:
    """(label): the keys under which objects hold a scalar other than null, each once."""
    return adjacency.where(F.col("kind").isin("string", "number", "boolean") & F.col("ordinal").isNull() & F.col("label").isNotNull()).select("label").distinct()


KEYS = ["record_table", "record_id", "node"]


def entity_rows(adjacency: DataFrame) -> DataFrame:
    """Every object as a row with its scalar children: (record_table, record_id, node, object_parent, path, parent_path, entity, fields), ``fields`` a map from label to text.

    The scalars of each parent are pivoted into one row, and object nodes joined with them: both are partitioned by record and node once, for the aggregations and the join. ``node`` and
    ``object_parent`` link the row to its parent's. Nulls are no scalars. Repeated records count once (they are equal; were they not, of two objects with one number the smaller path holds).
    ``adjacency`` is read twice: store it.
    """
    objects = adjacency.where(F.col("kind") == "object").groupBy(*KEYS).agg(F.min(F.struct("path", "parent_path", "entity", "object_parent")).alias("o"))
    scalars = adjacency.where(F.col("kind").isin("string", "number", "boolean") & F.col("ordinal").isNull() & F.col("parent").isNotNull())
    children = scalars.groupBy("record_table", "record_id", F.col("parent").alias("node")).agg(F.collect_list(F.struct("label", "scalar")).alias("_all"))
    # of several values of a label, in repeated or unequal records of one id, the largest holds
    labels = F.transform("_all", lambda f: f["label"])
    last = F.array_sort("_all")
    largest = F.filter(last, lambda f, i: ~F.coalesce(F.get(last, i + 1)["label"] == f["label"], F.lit(False)))
    once = F.when(F.size(F.array_distinct(labels)) == F.size(labels), F.col("_all")).otherwise(largest)
    children = children.select(*KEYS, F.map_from_entries(once).alias("fields"))
    nothing = F.create_map().cast("map<string,string>")
    return objects.join(children, KEYS, "left").select(*KEYS, "o.object_parent", "o.path", "o.parent_path", "o.entity", F.coalesce("fields", nothing).alias("fields"))


def entity_table(entities: DataFrame, entity: str | None, fields: dict[str, str]) -> DataFrame:
    """One kind of object as a flat table: of ``entity_rows`` those whose last key is ``entity`` (None: all), ``fields`` (label to SQL type) as columns.

    A child that is missing, null, no scalar or of another form gives null.
    """
    rows = entities if entity is None else entities.where(F.col("entity") == entity)
    pivot = [F.try_element_at("fields", F.lit(label)).try_cast(sql_type).alias(label) for label, sql_type in fields.items()]
    return rows.select(*KEYS, "object_parent", "path", "entity", *pivot)


def coordinate_table(adjacency: DataFrame, label: str = "coordinates") -> DataFrame:
    """(record_table, record_id, geometry, polygon, ring, position, x, y, z): a row per position in the lists under ``label``, linked to the object that holds them by its node.

    List positions count from 0: ``position`` within its point list, ``ring`` within its polygon or lines, ``polygon`` within several; null where the nesting isn't so deep. The numbers of a position list
    are joined with the list and pivoted by their ordinal; texts that are numbers count as such. Lists without a first and second number are no positions. Lists nested deeper keep the last three levels.
    """
    lists = adjacency.where((F.col("kind") == "list") & (F.col("entity") == label)).select(*KEYS, F.col("object_parent").alias("geometry"), "positions").dropDuplicates(KEYS)
    value = F.col("scalar").try_cast("double")
    numbers = adjacency.where(F.col("kind").isin("number", "string") & F.col("ordinal").between(0, 2))
    axis = lambda i, name: F.max(F.when(F.col("ordinal") == i, value)).alias(name)
    pivoted = numbers.groupBy("record_table", "record_id", F.col("parent").alias("node")).agg(axis(0, "x"), axis(1, "y"), axis(2, "z"))
    at = lambda k: F.try_element_at("positions", F.lit(-k))
    rows = lists.join(pivoted.where("x IS NOT NULL AND y IS NOT NULL"), KEYS)
    return rows.select("record_table", "record_id", "geometry", at(3).alias("polygon"), at(2).alias("ring"), at(1).alias("position"), "x", "y", "z")
