"""A file stream of texts, annotated batch by batch; a row is appended only where no earlier batch has its keys, so neither restarts nor files that repeat a key repeat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def annotate_stream(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str], pattern: str = "*.parquet") -> StreamingQuery:
    """Parquet files that arrive under `source` through `transform` into `sink`, a folder per batch; of rows with equal keys (null equals null) one is kept, from the first batch that has it."""

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch).dropDuplicates(keys)
        if number > 0:  # what earlier batches wrote; this batch's own rows, if it is repeated, are replaced
            done = batch.sparkSession.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(*[f"{sink}/batch={k}" for k in range(number)])
            done = done.select(*[F.col(k).alias(f"__rg_{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"__rg_{k}"))
            rows = rows.join(done, same, "left_anti")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
