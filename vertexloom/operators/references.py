"""References to records that are missing, deleted or late.

References and parent keys are co-partitioned by key, sorted and merged linearly (Spark's sort-merge join); each parent carries its validity
interval (first seen, deleted), which tells the reasons apart. Hot keys are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.common import salted_join


def parents(*tables: DataFrame) -> DataFrame:
    """(ref_key, first_seen, deleted): one row per non-null ``fid`` of the tables with its validity interval.

    Repeated rows count once: the earliest ``ingested_at`` and ``deleted_at`` hold. Nulls there mean never seen late, never deleted.
    """
    rows = None
    for t in tables:
        part = t.select(F.col("fid").alias("ref_key"), "ingested_at", "deleted_at").where(F.col("fid").isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("ref_key").agg(F.min("ingested_at").alias("first_seen"), F.min("deleted_at").alias("deleted"))


def edge_references(edges: DataFrame) -> DataFrame:
    """(ref_id, ref_field, ref_key, recorded_at, seen_at): the non-null ends of each distinct ``eid``, rows with a null ``eid`` left out."""
    once = (
        edges.where(F.col("eid").isNotNull())
        .groupBy(F.col("eid").alias("ref_id"))
        .agg(F.min("src").alias("src"), F.min("dst").alias("dst"), F.min("recorded_at").alias("recorded_at"), F.min("ingested_at").alias("seen_at"))
    )
    ends = F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("ref_key")) for f in ("src", "dst")))
    return once.select("ref_id", F.explode(ends).alias("e"), "recorded_at", "seen_at").select("ref_id", "e.ref_field", "e.ref_key", "recorded_at", "seen_at").where(F.col("ref_key").isNotNull())


def orphan_edges(edges: DataFrame, *parent_tables: DataFrame) -> DataFrame:
    """(ref_table, ref_id, ref_field, reason, period) for each end of an edge whose parent is missing, deleted or late.

    'missing': no parent has the key; else 'deleted': the parent's ``deleted_at`` <= the edge's ``recorded_at``; else 'late': the parent was
    first ingested after the edge. ``period`` is the month of ``recorded_at`` (null if that is null). Null keys are no references. With no
    parents at all every reference is missing.
    """
    known = parents(*parent_tables).withColumn("known", F.lit(True))
    keys = edges.select(F.explode(F.array("src", "dst")).alias("ref_key"))
    merged = salted_join(edge_references(edges), known, "ref_key", F.col("ref_id"), "left", hint="merge", counted=keys)
    reason = (
        F.when(F.col("known").isNull(), "missing").when(F.col("deleted") <= F.col("recorded_at"), "deleted").when(F.col("first_seen") > F.col("seen_at"), "late")
    )
    return merged.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        F.lit("edges").alias("ref_table"), "ref_id", "ref_field", "reason", F.date_format("recorded_at", "yyyy-MM").alias("period")
    )


def short_files(file_header: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same columns for each file that promises more features (``features_count``) than distinct ``fid``s arrived.

    A file without vertices has none; null and zero counts promise nothing. Of repeated headers the largest count and the earliest ``written_at`` hold.
    The distinct pairs are aggregated by both columns first, so a file with most of the rows is no hot spot.
    """
    pairs = vertices.where(F.col("fid").isNotNull()).select("file_id", "fid").distinct()
    have = pairs.groupBy("file_id").agg(F.count(F.lit(1)).alias("have"))
    promised = (
        file_header.where(F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.max("features_count").alias("promised"), F.min("written_at").alias("written_at"))
        .where(F.col("promised") > 0)
    )
    return promised.join(have, "file_id", "left").where(F.col("promised") > F.coalesce("have", F.lit(0))).select(
        F.lit("file_header").alias("ref_table"),
        F.col("file_id").alias("ref_id"),
        F.lit("features_count").alias("ref_field"),
        F.lit("missing").alias("reason"),
        F.date_format("written_at", "yyyy-MM").alias("period"),
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """References per table, field, reason and month."""
    return orphans.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count(F.lit(1)).alias("n_refs"))
