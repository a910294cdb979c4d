"""Property records as bytes: columns to a record and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.types import SPARK_TYPES, Column


def parse_properties(data: SparkColumn, columns: list[Column]) -> SparkColumn:
    """A struct of the columns' values from a property record; absent values and null records give nulls."""
    schema = T.StructType([T.StructField(c.name, SPARK_TYPES[c.type]) for c in columns])

    @F.arrow_udf(schema)
    def parse(records: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        from vertexloom.sources.codec import decode_properties

        rows = [dict(zip((c.name for c in columns), decode_properties(r, columns))) for r in records.to_pylist()]
        return pa.array(rows, to_arrow_type(schema))

    return parse(data)


def build_properties(values: SparkColumn, columns: list[Column]) -> SparkColumn:
    """A property record from a struct with the columns' values in their order; nulls are left out."""

    @F.arrow_udf("binary")
    def build(structs: pa.Array) -> pa.Array:
        from vertexloom.sources.codec import encode_properties

        return pa.array([None if r is None else encode_properties(list(r.values()), columns) for r in structs.to_pylist()], pa.binary())

    return build(values)
