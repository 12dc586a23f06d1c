"""Sinks: tables, samples and one-object reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def save_table(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition: str | None = None) -> None:
    """parquet, json or csv (with header)."""
    w = rows.write.mode(mode)
    w = w.partitionBy(partition) if partition else w
    w.option("header", True).format(kind).save(path)


def save_with_sample(rows: DataFrame, path: str, order: str, n: int = 100) -> None:
    """A table as CSV, and beside it its first n rows if it has more."""
    save_table(rows, f"{path}/all", "csv")
    if rows.limit(n + 1).count() > n:
        save_table(rows.orderBy(order).limit(n), f"{path}/sample", "csv")


def save_report(report: dict, path: str) -> None:
    """One JSON object, UTF-8, indented, through a temporary file that is then renamed. A path with a scheme is written by the active session's file systems."""
    text = json.dumps(report, ensure_ascii=False, indent=2).encode()
    if "://" not in path:
        at = Path(path)
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_suffix(at.suffix + ".part")
        part.write_bytes(text)
        part.replace(at)
        return
    spark = SparkSession.getActiveSession()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text))
    out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{part} could not be renamed")


def append_new(rows: DataFrame, done: DataFrame, keys: list[str], path: str) -> None:
    """Resume: append only rows whose keys are not done yet."""
    rows.join(done.select(*keys).distinct(), keys, "left_anti").write.mode("append").parquet(path)
