"""Run history: a table with one row per analysis, to which runs are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.functions.numbers import quality_band

RUN_SCHEMA = (
    "id bigint, user_id bigint, filename string, original_rows bigint, cleaned_rows bigint, columns string, "
    "insights_json string, charts_json string, cleaning_json string, quality_before double, "
    "quality_after double, created_at timestamp"
)


BUCKETS = 64  # of owners
PARTS = ("owner_bucket", "batch")


def _bucket(owner: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(owner.cast("bigint")), F.lit(BUCKETS)), F.lit(0)).cast("int")


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the history. The same runs appended again replace themselves.

    Runs lie in a folder per bucket of owners and batch. A batch is named by a digest
    of its ids, and only the folders written to are replaced, so an append that is
    tried again after a failure leaves every run once.
    """
    batch = runs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id")).alias("x"))
    name = batch.select(F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in "nsx"]), 256)).first()[0][:32]
    placed = runs.withColumns({"owner_bucket": _bucket(F.col("user_id")), "batch": F.lit(name)})
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def read_runs(spark: SparkSession, path: str, owner: int | None = None) -> DataFrame:
    """The history, or one owner's part of it; for an owner only the files of their bucket are read."""
    runs = spark.read.schema(f"{RUN_SCHEMA}, owner_bucket int, batch string").parquet(path)
    if owner is not None:
        bucket = spark.range(1).select(_bucket(F.lit(owner))).first()[0]
        runs = runs.where((F.col("owner_bucket") == bucket) & (F.col("user_id") == owner))
    return runs.drop(*PARTS)


def compact_runs(spark: SparkSession, path: str, target: str) -> None:
    """Write the history to ``target`` with one batch per bucket, each run once."""
    runs = read_runs(spark, path).dropDuplicates(["id"])
    placed = runs.withColumns({"owner_bucket": _bucket(F.col("user_id")), "batch": F.lit("compacted")})
    placed.repartition("owner_bucket", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy(*PARTS).parquet(target)


def history(runs: DataFrame, owner: int | None = None, k: int = 15) -> DataFrame:
    """The newest ``k`` runs of one owner, or of every owner.

    For one owner this is a filter pushed to the files and a top-k; for all of
    them each task keeps only its newest ``k`` per owner before the shuffle.
    """
    if owner is not None:
        newest = runs.where(F.col("user_id") == owner).orderBy(F.desc("created_at"), F.desc("id")).limit(k)
    else:
        w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
        newest = runs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
    return newest.select(
        "id", "user_id", "filename", "original_rows", "cleaned_rows",
        (F.col("original_rows") - F.col("cleaned_rows")).alias("removed_rows"),
        "quality_before", "quality_after",
        quality_band(F.col("quality_after")).alias("band"),
        F.date_format("created_at", "dd MMM yyyy, HH:mm").alias("created_at"),
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs per owner."""
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"))


def fetch_run(runs: DataFrame, run_id: int, owner: int) -> DataFrame:
    """One run, only if it is the owner's."""
    return runs.where((F.col("id") == run_id) & (F.col("user_id") == owner))
