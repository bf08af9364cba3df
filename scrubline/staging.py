"""Stage tables: results written once to shared storage and read back.

Cuts lineage so that a lost executor costs a re-read, not a re-run, and keeps
the columnar layout so that later jobs read only the columns they use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="scrubline-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of its own on shared storage that nothing has been written to yet."""
    return f"{stage_dir(spark).rstrip('/')}/scrubline/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def stage_in_buckets(df: DataFrame, label: str, key: str) -> DataFrame:
    """Stage ``df`` by the shuffle partition of ``key``: joins on it move the other side alone.

    Buckets need a name in the catalogue; it goes at once, the files stay.
    """
    spark = df.sparkSession
    name, path = f"scrubline_{uuid.uuid4().hex}", new_path(spark, label)
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    staged = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return staged
