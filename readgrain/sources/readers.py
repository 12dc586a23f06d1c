"""Sources. Each returns a DataFrame and leaves filters and columns to be pushed into the scan."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """Whole JSON documents (an object or a list of objects per file)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(list(path) if not isinstance(path, str) else path)


def read_custom(spark: SparkSession, path: str, kind: str = "csv", schema: StructType | str | None = None) -> DataFrame:
    """csv (with header), tsv, json, parquet, text or excel, by name; ValueError for others."""
    reader = spark.read.schema(schema) if schema and kind != "excel" else spark.read
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    if kind == "json":
        return read_json(spark, path, schema)
    if kind in ("parquet", "text"):
        return reader.format(kind).load(path)
    if kind == "excel":
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise ValueError("reading excel needs openpyxl") from e
        import io

        import pandas as pd

        raw = spark.read.format("binaryFile").load(path).select("content").first()[0]  # one workbook: a small file by its format
        return spark.createDataFrame(pd.read_excel(io.BytesIO(raw)))
    raise ValueError(f"unknown format: {kind}")


def read_files(spark: SparkSession, directory: str, pattern: str = "*.json", exclude: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON files of a directory tree that match a glob and not another, with a column path."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    rows = (reader.schema(schema) if schema else reader).json(directory).withColumn("path", F.input_file_name())
    if exclude:
        import fnmatch

        rows = rows.filter(~F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(exclude).replace("(?s:", "(?s)").replace(r")\Z", "$").replace(r")\z", "$")))
    return rows


def union_splits(splits: Sequence[DataFrame], renames: dict[str, str] | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Splits of a corpus as one, columns renamed; optionally a seeded sample of so many rows."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    out = out.withColumnsRenamed(renames or {})
    return out if sample is None else out.orderBy(F.rand(seed)).limit(sample)


def unpivot_texts(rows: DataFrame, fields: Sequence[str], least_words: int = 0) -> DataFrame:
    """Each text field of each row as a row (field, text), blank ones left out."""
    from readgrain.functions.text import clean_ascii, n_blank_words

    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x")).select("x.*")
    return long.filter(F.col("text").isNotNull()).withColumn("text", clean_ascii(F.col("text"))).filter((F.col("text") != "") & (n_blank_words(F.col("text")) >= least_words))


def explode_answers(rows: DataFrame, question: str, answers: str) -> DataFrame:
    """One row per question and distinct non-blank answer; answers is an array."""
    return rows.select(F.col(question).alias("question"), F.explode(F.array_distinct(answers)).alias("answer")).filter(F.trim("answer") != "")


def last_wins(rows: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Of rows with one key the last by `order`: by aggregation, so a frequent key is reduced before any shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_x"))
    return best.select(*keys, f"_x.{order}", *[f"_x.{c}" for c in rest])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """A word per line, lower-cased and trimmed, distinct."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word != ''").distinct()


def concept_scores(spark: SparkSession, path: str) -> DataFrame:
    """Concept scores; the sentinels -1 and \\N are null, the last row of a concept wins."""
    rows = spark.read.csv(path, header=True).withColumn("_pos", F.monotonically_increasing_id())
    number = lambda c: F.when(F.col(c).isin("-1", "\\N"), None).otherwise(F.col(c).try_cast("double"))
    names = {"Frequency Score": "frequency", "Context Score": "context", "CUI Score": "cui_score", "Combo Score": "combo"}
    rows = rows.select("_pos", F.col("CUI").alias("cui"), *[number(f"`{a}`").alias(b) for a, b in names.items()])
    return last_wins(rows, "cui", "_pos").drop("_pos")


def word_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word ratings: lines of exactly three fields; the last of a word wins."""
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", "^﻿", ""), "\t").alias("x"), F.monotonically_increasing_id().alias("_pos")).filter(F.size("x") == 3)
    rows = rows.select("_pos", F.lower(F.col("x")[0]).alias("word"), F.col("x")[1].try_cast("double").alias("concreteness"), F.col("x")[2].try_cast("double").alias("imageability"))
    return last_wins(rows.filter("concreteness IS NOT NULL"), "word", "_pos").drop("_pos")


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """bin, raw_min, raw_max from a JSON document, as an object of bins or under bin_thresholds."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a configuration of some rows
    found = json.loads(text)
    found = found.get("bin_thresholds", found)
    return spark.createDataFrame([(int(k), float(v["raw_min"]), float(v["raw_max"])) for k, v in found.items()], "bin int, raw_min double, raw_max double")


def json_lines(col: Column, schema: str) -> Column:
    return F.from_json(col, schema)


def first_rows(rows: DataFrame, n: int = 100, order: str | None = None) -> DataFrame:
    return (rows.orderBy(order) if order else rows).limit(n)


def skip_and_limit(rows: DataFrame, order: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(order).offset(skip)
    return out if limit is None else out.limit(limit)


def keyed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A composite key column: parts joined by a colon, null as -1."""
    return rows.withColumn("key", F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in columns]))


def unkeyed(rows: DataFrame, columns: Sequence[str], key: str = "key") -> DataFrame:
    parts = F.split(key, ":")
    return rows.withColumns({c: F.nullif(F.get(parts, F.lit(i)), F.lit("-1")) for i, c in enumerate(columns)})


def positions(rows: DataFrame, partition: str, order: str) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(partition).orderBy(order)) - 1)
