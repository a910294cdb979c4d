"""Helpers shared by the operators: table access, heavy keys and the salted join, intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SALTS = 1024  # tasks over which one key is spread, at most
TASK_ROWS = 500_000  # rows that one task may have whatever their keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_names(names: list[str], taken: list[str]) -> list[str]:
    """The names, with trailing underscores where one is taken already, case ignored."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def heavy_keys(df: DataFrame, key: str, min_share: float) -> DataFrame:
    """(``key``, _n, _total): keys holding at least ``min_share`` of the non-null keys of ``df``, their rows and those of all keys: at most ``1 / min_share`` rows.

    One partial aggregation by key; only a key and its count per map task are shuffled. The bound follows from the definition, so the result may be collected or
    broadcast whatever the size of ``df``. Null keys are ignored; an empty input gives no rows.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.withColumn("_total", total).where(F.col("_n") >= F.col("_total") * F.lit(min_share))


def _salts(counted: list, parts: int) -> dict[int, list]:
    out: dict[int, list] = defaultdict(list)
    for value, n, total in counted:
        pieces = max(2, -(-2 * n * parts // total))
        out[min(1 << (pieces - 1).bit_length(), MOST_SALTS)].append(value)
    return dict(out)


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


def key_salts(df: DataFrame, key: str, rows: int | None = None) -> dict[int, list]:
    """Salts -> the keys that are to be spread over so many tasks.

    A key is hot if it holds at least half the rows of an even shuffle partition, so there are at most twice as many as partitions, whatever the data; it gets a salt for each such half
    that it holds, rounded up to a power of two. More partitions, as a larger cluster has, make both the threshold lower and the pieces smaller. Of at most ``TASK_ROWS`` rows no key is hot; ``rows``
    is their number, or a bound of it, if it is known, and may save the counting.
    """
    if rows is not None and rows <= TASK_ROWS:
        return {}
    parts = _parts(df.sparkSession)
    return _salts(heavy_keys(df, key, 0.5 / parts).where(F.col("_total") > TASK_ROWS).collect(), parts)


def end_salts(df: DataFrame, keys: list[str]) -> dict[str, dict[int, list]]:
    """``key_salts`` of several columns of one type in one pass over ``df``; the rows with a key are taken to be as many in each."""
    parts = _parts(df.sparkSession)
    ends = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col(k).alias("key")) for k in keys))).alias("e")).select("e.*").where(F.col("key").isNotNull())
    counts = ends.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n"))
    total = F.ceil(counts.agg(F.sum("n")).scalar() / len(keys))
    hot = counts.withColumn("total", total).where((F.col("n") >= F.col("total") * F.lit(0.5 / parts)) & (F.col("total") > TASK_ROWS)).collect()
    return {k: _salts([(r.key, r.n, r.total) for r in hot if r.which == k], parts) for k in keys}


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", hint: str | None = None, counted: DataFrame | None = None, salts: dict[int, list] | None = None, rows: int | None = None) -> DataFrame:
    """Equi-join on ``key`` whose hot keys are spread over several tasks.

    Hot keys and their salts are found first (``key_salts`` of ``counted``, by default of ``left``; ``salts`` has them if they are known, ``rows`` the number of rows). Their left rows get a salt from ``spread`` (a
    column of ``left`` that varies within a key) and their right rows are repeated once per salt. Without hot keys it is a plain join. ``how`` is inner, left, left_semi or left_anti. Null
    keys match nothing. Names other than ``key`` must differ between sides.
    """
    if salts is None:
        salts = key_salts(left if counted is None else counted, key, rows)
    if not salts:
        return left.join(right.hint(hint) if hint else right, key, how)
    n = F.lit(1)
    for pieces, keys in sorted(salts.items()):
        n = F.when(F.col(key).isin(keys), F.lit(pieces)).otherwise(n)
    lhs = left.withColumn("_salt", F.pmod(F.xxhash64(spread), n).cast("int"))
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    if hint:
        rhs = rhs.hint(hint)
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, one below the warehouse, or a temporary one (removed with the JVM) if Spark runs in this process. A cluster whose warehouse is a folder of one machine has none: a ValueError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master.startswith("local[") or sc.master == "local":
                folder = tempfile.mkdtemp(prefix="checkpoints-")
                remove_at_end(spark, folder)
            else:
                home = spark.conf.get("spark.sql.warehouse.dir")
                if home.startswith("file:") or "://" not in home:
                    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
                folder = f"{home}/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there is removed when the application ends."""
    leaf = f"{name}-{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark).rstrip('/')}/{leaf}"
    remove_at_end(spark, folder)
    return f"{folder}/{leaf}"


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Makes a folder that goes with the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only what exists can be marked
    fs.deleteOnExit(at)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, by a checkpoint in the session's shared folder. Partitions and the order within them stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder: smaller than a checkpoint, and each use reads only its columns. Partitions and order aren't kept."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
