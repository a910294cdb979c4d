"""Containers as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vertexloom.common import shared_path
from vertexloom.sources.container import FORMAT, register


def stream_section(spark: SparkSession, path: str, section: str = "edges", **options) -> DataFrame:
    """A streaming DataFrame of a container's records."""
    register(spark)
    return spark.readStream.format(FORMAT).option("section", section).options(**{k: str(v) for k, v in options.items()}).load(path)


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives its rows as a table (Parquet in ``folder``, by default one in the session's shared folder)."""
    folder = folder or shared_path(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
