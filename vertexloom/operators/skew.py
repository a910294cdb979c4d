"""Per-key results when a few keys hold most rows: eager aggregation.

Both inputs of a join are aggregated by join key first, so that a key is one compact state per side however many rows it has; the join multiplies counts and
scales sums; a last aggregation rolls up. No task ever sees the rows of a key, only the partial states of the map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (side, operation, column, alias); side 'left' or 'right', operation sum, min or max; ('both', 'count', '', alias) counts joined rows
Aggregate = tuple[str, str, str, str]
_OPS = {"sum": F.sum, "min": F.min, "max": F.max}


def pre_aggregate(df: DataFrame, keys: Sequence[str], side: str, aggregates: Sequence[Aggregate]) -> DataFrame:
    """One compact state per key: the row count ``_n_<side>`` and the states of this side's aggregates. Null keys are a key of their own."""
    states = [_OPS[op](c).alias(f"_{alias}") for s, op, c, alias in aggregates if s == side]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n_{side}"), *states)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    group_left: Sequence[str] = (),
    group_right: Sequence[str] = (),
    aggregates: Sequence[Aggregate] = (),
    how: str = "inner",
    broadcast_right: bool = False,
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY group_left, group_right`` without joining rows.

    Equal to aggregating the plain join: counts are products, a side's sums are scaled by the other side's count, min and max pass. ``how`` is inner or
    left (an unmatched left key counts as joined to one row of nulls, as in SQL). Join columns may be grouped by. Null join keys match nothing.
    ``broadcast_right`` is for a right side whose states are bounded by definition. Group columns of the two sides must differ in name.
    """
    left_keys = list(dict.fromkeys([*on, *group_left]))
    right_keys = list(dict.fromkeys([*on, *group_right]))
    states_l = pre_aggregate(left, left_keys, "left", aggregates)
    states_r = pre_aggregate(right, right_keys, "right", aggregates)
    joined = states_l.join(F.broadcast(states_r) if broadcast_right else states_r, list(on), how)
    n_left, n_right = F.col("_n_left"), F.coalesce("_n_right", F.lit(1))
    out = []
    for side, op, _, alias in aggregates:
        state = F.col(f"_{alias}")
        if op == "count":
            out.append(F.sum(n_left * n_right).alias(alias))
        elif op == "sum":
            out.append(F.sum(state * (n_right if side == "left" else n_left)).alias(alias))
        else:
            out.append(_OPS[op](state).alias(alias))
    return joined.groupBy(*group_left, *group_right).agg(*out)


def key_ends(edges: DataFrame) -> DataFrame:
    """(ref_field, ref_key, partner, recorded_at): two rows per edge row, one for each end. Null keys stay."""
    end = lambda a, b: F.struct(F.lit(a).alias("ref_field"), F.col(a).alias("ref_key"), F.col(b).alias("partner"))
    return edges.select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e"), "recorded_at").select("e.*", "recorded_at")


def key_totals(edges: DataFrame) -> DataFrame:
    """(ref_field, ref_key, n_edges, n_partners, last_at): totals per non-null key, repeated rows included.

    The first aggregation, by both ends, serves both fields and is partitioned by both, so a hot key is spread over all tasks; the second adds up its states, per field and
    again partially in each map task. Null partners count as edges, not as partners; ``last_at`` is null if all times are.
    """
    states = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("recorded_at").alias("t"))

    def totals(field: str, partner: str) -> DataFrame:
        per = states.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("ref_key")).agg(F.sum("n").alias("n_edges"), F.count(partner).alias("n_partners"), F.max("t").alias("last_at"))
        return per.select(F.lit(field).alias("ref_field"), "ref_key", "n_edges", "n_partners", "last_at")

    return totals("src", "dst").unionByName(totals("dst", "src"))


def hot_keys(edges: DataFrame, min_share: float = 0.01) -> DataFrame:
    """(ref_field, ref_key, n_edges, n_rows): the non-null keys holding at least ``min_share`` of all rows, at most ``1 / min_share`` a field.

    By eager aggregation: both inputs, the ends and the rows of each field, become states (one per key, one per field), which are joined by field.
    """
    ends = key_ends(edges).select("ref_field", "ref_key")
    rows = ends.select("ref_field", F.lit(1).alias("_row"))
    out = eager_join_aggregate(
        ends.withColumn("_one", F.lit(1)),
        rows.groupBy("ref_field").agg(F.sum("_row").alias("n_field")),
        ["ref_field"],
        ["ref_field", "ref_key"],
        ["n_field"],
        [("left", "sum", "_one", "n_edges")],
        broadcast_right=True,  # one state a field: two
    )
    return out.where(F.col("ref_key").isNotNull() & (F.col("n_edges") >= F.col("n_field").cast("decimal(20,0)") * F.lit(Decimal(str(min_share))))).select("ref_field", "ref_key", "n_edges", F.col("n_field").alias("n_rows"))
