"""Order statistics over whole tables without one task that sees all rows.

Distinct values are counted first and range-partitioned (Spark samples them for the borders), so each part, a cell, holds about ROWS of
them however they are distributed. Cell totals are summed up, and a window within a cell gives the number of rows below each value.
Percentile ranks, exact quantiles, quantile bins and running totals all follow from that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readgrain.storage import materialise

#: Distinct values of a cell, about, and the most cells; of more values each cell has its part.
ROWS, CELLS = 4096, 20_000


def _with_cell(counted: DataFrame, value: str) -> DataFrame:
    """counted, with an ascending cell number per value."""
    n = min(CELLS, -(-counted.count() // ROWS))
    if n <= 1:
        return counted.withColumn("_cell", F.lit(0))
    return materialise(counted.repartitionByRange(n, value).withColumn("_cell", F.spark_partition_id()), "cells")


def ranked(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct non-null value: n_rows (with it), n_before (with a smaller one) and n_total (of the group)."""
    kept = rows.select(*groups, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    counted = materialise(kept.groupBy(*groups, "_v").agg(F.count("*").alias("n_rows")), "counts")
    counted = _with_cell(counted, "_v")
    cells = counted.groupBy(*groups, "_cell").agg(F.sum("n_rows").alias("_cn"))
    by = Window.partitionBy(*groups)
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_cn").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n_total": F.sum("_cn").over(by)})
    cells = cells.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_cell").alias("_c"), "_before", "n_total")
    inside = F.coalesce(F.sum("n_rows").over(Window.partitionBy(*groups, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col("_cell") == F.col("_c")]
    both = counted.join(cells, on).withColumn("n_before", F.col("_before") + inside)
    return both.select(*groups, F.col("_v").alias(value), "n_rows", "n_before", "n_total")


def quantiles(rows: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Per group the exact quantiles q0, q1, ... of probs, with linear interpolation."""
    r = ranked(rows, value, groups)
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("n_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n_rows"))
        picks += [F.max(F.when(holds(low), F.col(value).cast("double"))).alias(f"_l{i}"), F.max(F.when(holds(high), F.col(value).cast("double"))).alias(f"_h{i}"), F.max(at - low).alias(f"_f{i}")]
    got = r.groupBy(*groups).agg(*picks)
    return got.select(*groups, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(probs))])


def percentile_ranks(rows: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """rows with their percentile, 100 times the average rank of their value over the number of rows; null for null."""
    r = ranked(rows, value).select(F.col(value).alias("_v"), ((F.col("n_before") + (F.col("n_rows") + 1) / 2) / F.col("n_total") * 100).alias(out))
    return rows.join(r, F.col(value) == F.col("_v"), "left").drop("_v")


def quantile_bins(rows: DataFrame, value: str, bins: int = 21, step: int = 5, out: str = "bin") -> DataFrame:
    """rows with a bin of `bins` by exact quantile edges, right-open, the last closed; labels 0, step, 2 step, ... Equal edges merge."""
    edges = quantiles(rows, value, [k / bins for k in range(bins + 1)]).first()
    kept: list[float] = []
    for e in edges or ():
        if e is not None and (not kept or e - kept[-1] > 1e-12):
            kept.append(e)
    inner = F.lit(kept[1:-1]).cast("array<double>")
    place = F.size(F.filter(inner, lambda e: e <= F.col(value).cast("double")))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), place * step))


def quantile_cut(rows: DataFrame, value: str, bins: int = 5, out: str = "bin") -> DataFrame:
    """rows with a bin of `bins`, right-closed, the lowest edge included."""
    edges = sorted(set(quantiles(rows, value, [k / bins for k in range(bins + 1)]).first() or ()))
    inner = F.lit(edges[1:-1]).cast("array<double>")
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value).cast("double")))))


def nth(rows: DataFrame, value: str, at: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Per group the values at ranks floor(p * n) (from 0) in ascending order, as v0, v1, ..."""
    r = ranked(rows, value, groups)
    out = []
    for i, p in enumerate(at):
        k = F.least(F.floor(F.col("n_total") * F.lit(float(p))), F.col("n_total") - 1)
        out.append(F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n_rows")), F.col(value))).alias(f"v{i}"))
    return r.groupBy(*groups).agg(*out)
