"""Tables between steps: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder if driver and executors are one process; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="readgrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """df, computed once: what follows reads the written table, whatever executors are lost, and knows its size."""
    at = f"{shared_dir(df.sparkSession)}/readgrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.readgrain_at = at
    return out


def gathered(df: DataFrame) -> DataFrame:
    """df, whose rows are a few bytes each, in as many partitions as there are cores at most, where Spark doesn't join small partitions by itself; for materialise().

    Without Hadoop's native library a local file system starts processes for the mode of each file. Until such a process runs its own
    program it shares, and counts with, all memory of its executor. What df takes to compute is dealt out as before.
    """
    conf = df.sparkSession.conf
    cores = df.sparkSession.sparkContext.defaultParallelism
    if all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "coalescePartitions.enabled")) or int(conf.get("spark.sql.shuffle.partitions")) <= cores:
        return df
    return df.repartition(cores)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote for these tables; for tables that nothing reads again, not even lazily."""
    for df in tables:
        remove(df.sparkSession, df.readgrain_at)
