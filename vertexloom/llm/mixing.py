"""Mixing sources to target shares of all tokens, small sources repeated up to a cap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.common import salted_join, stored
from vertexloom.llm.tokens import VOCABULARY, token_count

SEED = 17
BROADCAST_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """A source without case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def document_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source_key, n_tokens) of every document."""
    return documents.select("doc_id", source_key(F.col("source")).alias("source_key"), token_count(F.col("text"), vocabulary).alias("n_tokens"))


def repetition_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_key, target_share, max_repeats, source_tokens, all_tokens, wanted, rate) per row of ``targets``.

    ``wanted`` is the source's share of the tokens of all documents, ``rate`` = wanted / its tokens, at most ``max_repeats``; 0 for a source without tokens or
    with a null share or cap. Documents of unlisted or null sources count in the total only. One partial aggregation: as many rows are
    shuffled as there are sources.
    """
    per = stored(sizes.groupBy("source_key").agg(F.sum("n_tokens").alias("source_tokens")), "sources")  # texts are sized once for both uses
    total = per.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).scalar()
    known = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats", source_key(F.col("source")).alias("source_key"))
    joined = known.join(per, "source_key", "left").withColumn("all_tokens", total)
    tokens = F.coalesce("source_tokens", F.lit(0))
    wanted = F.col("target_share") * F.col("all_tokens")
    rate = F.when(tokens > 0, F.least(F.col("max_repeats").cast("double"), wanted / F.nullif(tokens, F.lit(0))))
    usable = F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull()
    return joined.select(
        "source", "source_key", "target_share", "max_repeats", tokens.alias("source_tokens"), "all_tokens", wanted.alias("wanted"), F.when(usable, F.greatest(F.coalesce(rate, F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("rate")
    )


def short_sources(rates: DataFrame) -> DataFrame:
    """The sources that stay below their share although every document is used ``max_repeats`` times."""
    return rates.where(F.col("source_tokens") * F.col("max_repeats") < F.col("wanted")).select("source")


def solved(rates: DataFrame) -> DataFrame:
    """The rates with which every source that is not capped has exactly its target share of what is drawn: adds ``capped``, ``share`` and ``total``, and sets ``rate``.

    Targets are shares of their sum. Sources that fall short of their share of all tokens are ``capped``: all their documents are used ``max_repeats`` times. Together they are to have the sum of
    their targets, which fixes the ``total``: their tokens over that sum. Among them each has what it has; the reports show it. If all capped sources are without tokens, their targets
    are dropped and the others' raised in proportion (``share`` is the target that holds, 0 for those dropped); without capped sources the total is that of all documents.
    Rows without a share or cap draw nothing. The table has a row per source; store it.
    """
    usable = F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull()
    most = F.when(usable, F.col("source_tokens") * F.greatest("max_repeats", F.lit(0))).otherwise(F.lit(0))
    given = F.when(usable, F.greatest("target_share", F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rates.drop("rate").withColumns({"_most": most, "_given": given})
    rows = rows.withColumn("_share", F.coalesce(F.col("_given") / F.nullif(rows.agg(F.sum("_given")).scalar(), F.lit(0.0)), F.lit(0.0)))
    short = lambda share: F.col("_most") < F.col(share) * F.col("all_tokens")
    lost = rows.where(short("_share")).agg(F.coalesce(F.sum("_most"), F.lit(0))).scalar()
    reachable = F.when(F.col("_most") > 0, F.col("_share")).otherwise(F.lit(0.0))
    left = rows.agg(F.sum(reachable)).scalar()
    rows = rows.withColumn("share", F.when(lost == 0, F.coalesce(reachable / F.nullif(left, F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_share")))
    rows = rows.withColumn("capped", short("share"))
    capped = rows.where("capped")
    of_capped, their_share = capped.agg(F.sum("_most")).scalar(), capped.agg(F.sum("share")).scalar()
    rows = rows.withColumn("total", F.coalesce(of_capped / F.nullif(their_share, F.lit(0.0)), F.col("all_tokens").cast("double")))
    exact = F.coalesce(F.col("share") * F.col("total") / F.nullif(F.col("source_tokens").cast("double"), F.lit(0.0)), F.lit(0.0))
    rate = F.when(F.col("source_tokens") <= 0, F.lit(0.0)).when(F.col("capped"), F.col("max_repeats").cast("double")).otherwise(F.least(exact, F.col("max_repeats").cast("double")))
    return rows.withColumn("rate", F.when(usable, F.greatest(rate, F.lit(0.0))).otherwise(0.0)).drop("_most", "_given", "_share")


BUCKETS = 4_096


def _unit(seed: int) -> Column:
    """A number in [0, 1) for each document, from its id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _size_class(tokens: Column) -> Column:
    """The power of two below a size."""
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def cuts_of(classes: list[int], buckets: list[int], tokens: list[int], fraction: float) -> dict[int, float]:
    """For each size class the number below which documents have the one more copy.

    From the largest class to the smallest: each cut is the multiple of 1 / ``BUCKETS`` at which what is drawn of all classes so far comes closest to ``fraction`` of their tokens, so what a few large
    documents are off is made up for by the smaller ones.
    """
    by_class: dict[int, list[tuple[int, int]]] = {}
    for c, b, t in zip(classes, buckets, tokens):
        by_class.setdefault(c, []).append((b, t))
    out, seen, drawn = {}, 0, 0
    for c in sorted(by_class, reverse=True):
        rows = sorted(by_class[c])
        upto = np.cumsum([0, *(t for _, t in rows)])
        seen += int(upto[-1])
        k = int(np.argmin(np.abs(upto - (fraction * seen - drawn))))
        out[c] = (rows[k - 1][0] + 1) / BUCKETS if k else 0.0
        drawn += int(upto[k])
    return out


def calibrated(sizes: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``cuts`` to the rates: a map from size class to the number below which documents of that size have the one more copy.

    The fraction of the rate is the probability of that copy; the cuts lie about it, so that the tokens drawn are those wanted although a few documents may hold much of a source (``cuts_of``).
    Tokens are summed by source, size class and bucket, partially in each map task; a source has at most 64 * ``BUCKETS`` rows then, whatever its size.
    """
    known = rates.withColumn("_fraction", F.col("rate") - F.floor("rate"))
    sums = sizes.where("n_tokens > 0").groupBy("source_key", _size_class(F.col("n_tokens")).alias("c"), F.floor(_unit(seed) * BUCKETS).cast("int").alias("b")).agg(F.sum("n_tokens").cast("bigint").alias("t"))
    runs = sums.join(known.where("_fraction > 0").select("source", "source_key", "_fraction"), "source_key").select("source", "_fraction", "c", "b", "t")

    def cut(key: tuple, rows: pa.Table) -> pa.Table:
        found = cuts_of(*(rows.column(n).to_pylist() for n in ("c", "b", "t")), rows.column("_fraction")[0].as_py())
        return pa.table([pa.array([key[0].as_py()]), pa.array([list(found.items())], pa.map_(pa.int32(), pa.float64()))], names=["source", "cuts"])

    return known.join(runs.groupBy("source").applyInArrow(cut, "source string, cuts map<int, double>"), "source", "left").drop("_fraction")


def draws(sizes: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, copy, n_tokens): each document floor(rate) times, and once more with probability rate - floor(rate).

    The extra copy is decided by a hash of ``doc_id`` and ``seed``, compared with the cut of the document's size (see ``calibrated``) or, in rates without cuts, with the fraction: the same on every run
    and never over ``max_repeats``. Up to ``BROADCAST_SOURCES`` rates (counted first) are broadcast; more are joined with hot sources salted.
    """
    fraction = F.col("rate") - F.floor("rate")
    cuts = F.col("cuts") if "cuts" in rates.columns else F.lit(None).cast("map<int,double>")
    known = rates.where(F.col("rate") > 0).select("source", "source_key", "rate", cuts.alias("_cuts"))
    if known.count() <= BROADCAST_SOURCES:
        joined = sizes.join(F.broadcast(known), "source_key")
    else:
        joined = salted_join(sizes, known, "source_key", F.col("doc_id"))
    below = F.when(F.col("_cuts").isNull(), fraction).otherwise(F.coalesce(F.try_element_at("_cuts", _size_class(F.col("n_tokens"))), F.lit(0.0)))
    n = (F.floor("rate") + F.when(_unit(seed) < below, F.lit(1)).otherwise(F.lit(0))).cast("int")
    drawn = joined.withColumn("_n", n).where(F.col("_n") > 0)
    return drawn.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"), "n_tokens")


def reached_shares(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, target_share, capped, rate, drawn_tokens, reached_share) per target, sources without draws at 0. ``capped`` marks those that can't have their share of all tokens."""
    per = drawn.groupBy("source").agg(F.sum("n_tokens").alias("_t"))
    rows = rates.select("source", "target_share", "capped", "rate").join(per, "source", "left").withColumn("_all", per.agg(F.sum("_t")).scalar())
    got = F.coalesce("_t", F.lit(0))
    return rows.select("source", "target_share", "capped", "rate", got.alias("drawn_tokens"), F.coalesce(got / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("reached_share"))
