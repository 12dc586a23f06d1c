"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from readgrain.storage import forget, gathered, materialise, remove, shared_dir  # noqa: F401

#: A word of the contracts is a run of anything else than these ASCII blanks, which are those of bytes.split().
BLANK = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def count_words(text: Column) -> Column:
    """Words of a text (null: 0), without an array: each word and the blanks around it become one letter."""
    full = F.coalesce(text, F.lit(""))
    short = F.regexp_replace(full, f"[{BLANK}]*[^{BLANK}]+[{BLANK}]*", "x")
    return F.when(full.rlike(f"[^{BLANK}]"), F.length(short)).otherwise(0).cast("long")


#: Python objects of so many texts, and of so many bytes of text, are held at a time.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def slices(batch: pa.RecordBatch, text: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in consecutive parts of at most `rows` rows and, where there is more than one, about `size` bytes in column `text`."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        full = (ends[at - 1] if at else 0) + size
        n = min(rows, max(1, int(np.searchsorted(ends, full, "right")) - at))
        yield batch.slice(at, n)
        at += n


def map_texts(df: DataFrame, fn: Callable[[], Callable[[str], tuple]], schema: str, columns: list[str], keep: bool = False) -> DataFrame:
    """One row per row of df: `columns` of it, then what the function that fn() makes returns for its text (null: ""). fn() runs once per task (keep: and uses own()); Arrow batches go through one at a time, in slices, so memory is bounded by a batch and the largest text."""
    target = list(columns)
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    full = f"{head}, {schema}" if head else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            for part in slices(batch, len(target)):
                got = [each(t or "") for t in part.column(len(target)).to_pylist()]
                arrays = [part.column(i) for i in range(len(target))] + [pa.array(f, t) for f, t in zip(zip(*got, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    spark_schema = StructType.fromDDL(full)
    names = spark_schema.names
    types = [to_arrow_type(f.dataType) for f in spark_schema.fields[len(target) :]]
    return df.select(*columns, F.col("text")).mapInArrow(task(run, keep), spark_schema)


_OWN: dict = {}


def own(key: object, make: Callable):  # noqa: ANN201
    """What make() returned for this key in this worker process, which later tasks use again; of several keys only the last is kept, so a worker's memory stays bounded."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = make()
    return _OWN[key]


def task(run: Callable, keep: bool = False) -> Callable:
    """run, a function for mapInArrow, which leaves little memory behind in its worker: what another operator kept goes first (unless keep), and what was freed goes back to the system at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        if not keep:
            _OWN.clear()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return whole


class Cache(dict):
    """A dict that fills itself by fn and starts anew at `most` entries, so a worker's memory stays bounded; the answers don't depend on it."""

    def __init__(self, fn: Callable, most: int = 200_000) -> None:
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fn(key)
        return value
