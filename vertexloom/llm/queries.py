"""The queries of the text problems (p6 to p8), each over all documents, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.common import stored, table
from vertexloom.llm import language, mixing, packing

LIMIT = "context_window"


def capacity(spark: SparkSession, d: str) -> int:
    """The capacity of the limit, the smallest of repeated rows."""
    rows = table(spark, d, "pack_limits").where(F.col("limit_name") == LIMIT).agg(F.min("capacity_tokens").alias("c")).collect()
    if rows[0].c is None:
        raise ValueError(f"no capacity for {LIMIT}")
    return rows[0].c


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    placed = packing.pack_texts(table(spark, d, "documents"), capacity(spark, d))
    return placed.where((F.col("n_pieces") > 1) & (F.col("piece") == 0)).select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text or piece with its container and offset."""
    return packing.pack_texts(table(spark, d, "documents"), capacity(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_containers(spark, d), capacity(spark, d))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document is there, pieces are whole and in order, only texts over the capacity are split, no container is over its capacity, and what it holds lies end to end."""
    most = capacity(spark, d)
    places = stored(p6_containers(spark, d), "places")
    docs = places.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("pieces"), F.count_distinct("piece").alias("different"), F.sum("n_tokens").alias("tokens"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("tokens") / most))
    texts = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("n") != F.col("pieces")) | (F.col("different") != F.col("n")) | (F.col("pieces") != needed)).alias("n_badly_split"))
    bins = places.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("end"), F.count_distinct("container_offset").alias("starts"), F.count(F.lit(1)).alias("n"))
    full = bins.agg(F.count_if(F.col("used") > most).alias("n_over_capacity"), F.count_if((F.col("used") != F.col("end")) | (F.col("starts") != F.col("n"))).alias("n_with_gaps"))
    return texts.join(full, F.lit(True))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return mixing.document_sizes(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(mixing.repetition_rates(_sizes(spark, d), table(spark, d, "mix_targets")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(sizes, rates), both stored: texts are sized once."""
    sizes = stored(_sizes(spark, d), "sizes")
    rates = stored(mixing.solved(stored(mixing.repetition_rates(sizes, table(spark, d, "mix_targets")), "rates")), "solved")
    return sizes, stored(mixing.calibrated(sizes, rates), "calibrated")


def p7_draws(spark: SparkSession, d: str) -> DataFrame:
    """The copies drawn."""
    return mixing.draws(*_mix(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    sizes, rates = _mix(spark, d)
    return mixing.reached_shares(mixing.draws(sizes, rates), rates)


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the draws: the number of targets, draws of unlisted sources or over the cap, copies that aren't numbered 1, 2, …, and sources off their target by over 2 % though not capped.

    A single document may be more than 2 % of a source: such sources are counted only if they are off by more than half of their largest document.
    """
    sizes, rates = _mix(spark, d)
    drawn = stored(mixing.draws(sizes, rates), "drawn")
    per = drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last"))
    listed = rates.select("source", "max_repeats")
    over = per.join(listed, "source", "left").agg(F.count_if(F.col("max_repeats").isNull() | (F.col("n") > F.col("max_repeats"))).alias("n_over_cap"), F.count_if(F.col("n") != F.col("last")).alias("n_misnumbered"))
    largest = sizes.groupBy("source_key").agg(F.max("n_tokens").alias("largest"))
    shares = mixing.reached_shares(drawn, rates).join(rates.select("source", "source_key", "share"), "source").join(largest, "source_key", "left")
    whole = drawn.agg(F.sum("n_tokens")).scalar()
    miss = F.abs(F.col("reached_share") - F.col("share"))
    off = ~F.col("capped") & (miss > 0.02 * F.col("share")) & (miss * whole > F.col("largest") / 2)
    told = shares.agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(off).alias("n_off_target"))
    return over.join(told, F.lit(True)).select("n_targets", "n_over_cap", "n_misnumbered", "n_off_target")


def _identified(spark: SparkSession, d: str) -> DataFrame:
    documents, languages = table(spark, d, "documents"), table(spark, d, "languages")
    return language.identify(documents, language.language_model(documents, languages))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_issues(_identified(spark, d), table(spark, d, "languages"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document."""
    return _identified(spark, d).select("doc_id", "language", "confidence")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every segment of the mixed documents."""
    mixed = _identified(spark, d).where(F.col("language") == "")
    return mixed.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the languages: every document with a letter has one, segments follow one another and differ from the next, and those of mixed texts have five lines at least."""
    found = stored(_identified(spark, d), "identified")
    s = F.col("segments")
    pairs = F.slice(F.arrays_zip(s.alias("a"), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))).alias("b")), F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    disorder = F.exists(pairs, lambda p: (p["a"]["last_line"] >= p["b"]["first_line"]) | (p["a"]["language"] == p["b"]["language"]))
    tiny = (F.size(s) > 1) & F.exists(s, lambda x: x["n_lines"] < language.SHORTEST)
    mixed = F.size(F.array_distinct(F.transform(s, lambda x: x["language"]))) > 1
    known = [r.lang_code for r in table(spark, d, "languages").where("lang_code IS NOT NULL").select("lang_code").distinct().collect()]
    strange = F.exists(s, lambda x: ~x["language"].isin(known) | ~x["confidence"].between(0.0, 1.0))
    return found.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.size(s) < 1).alias("n_without"), F.count_if(disorder).alias("n_disordered"), F.count_if(tiny).alias("n_tiny"), F.count_if(strange).alias("n_strange"),
        F.count_if(mixed != (F.col("language") == "")).alias("n_misnamed"),
    )


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_fill, p6_checks, p7_found, p7_draws, p7_shares, p7_checks, p8_found, p8_documents, p8_segments, p8_checks)}

#: Token counts and code lengths are beyond SQL; these operators are tested against brute force. SQL states what must hold of their results.
SQL: dict[str, str] = {
    "p6_checks": "SELECT count(DISTINCT doc_id) AS n_documents, CAST(0 AS BIGINT) AS n_badly_split, CAST(0 AS BIGINT) AS n_over_capacity, CAST(0 AS BIGINT) AS n_with_gaps FROM documents",
    "p7_checks": "SELECT count(*) AS n_targets, CAST(0 AS BIGINT) AS n_over_cap, CAST(0 AS BIGINT) AS n_misnumbered, CAST(0 AS BIGINT) AS n_off_target FROM mix_targets WHERE source IS NOT NULL",
    "p8_checks": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_without, CAST(0 AS BIGINT) AS n_disordered, CAST(0 AS BIGINT) AS n_tiny, CAST(0 AS BIGINT) AS n_strange, CAST(0 AS BIGINT) AS n_misnamed FROM documents WHERE regexp_matches(text, '\\p{L}')",
}
