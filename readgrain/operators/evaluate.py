"""Evaluation of scores per data set and pooled, comparison of models, combinations of data sets."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrain.operators.order import ranked
from readgrain.operators.stats import number, with_stats

POOLED = "(all)"


def evaluate(rows: DataFrame, dataset: str, label: str, score: str, least: int = 10) -> DataFrame:
    """Per data set with `least` rows and both classes (0, 1), and for all of these pooled (dataset "(all)"): n, auc, cohens_d, mean_difference.

    The differences are those of class 0 minus class 1, as cohens_d() has them. Rows without a score or label don't count. Areas come from
    range-partitioned ranks, the rest from map-side sums; a hot data set is never one task's work.
    """
    r = rows.select(F.col(dataset).alias("dataset"), F.col(label).cast("int").alias("y"), number(score).alias("v")).filter("y IN (0, 1) AND v IS NOT NULL")
    fit = r.groupBy("dataset").agg(F.count("*").alias("_n"), F.count_distinct("y").alias("_k")).filter((F.col("_n") >= least) & (F.col("_k") == 2)).select("dataset")
    r = r.join(fit, "dataset", "left_semi").select(F.explode(F.array("dataset", F.lit(POOLED))).alias("dataset"), "y", "v")
    per = r.groupBy("dataset", "v").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    at = ranked(r, "v", ["dataset"]).select("dataset", "v", (F.col("n_before") + (F.col("n_rows") + 1) / 2).alias("_r"))
    a = per.join(at, ["dataset", "v"]).groupBy("dataset").agg(F.sum(F.col("_r") * F.col("p")).alias("_s"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    of = lambda f, k: f(F.when(F.col("y") == k, F.col("v")))
    m = r.groupBy("dataset").agg(F.count("*").alias("n"), (of(F.avg, 0) - of(F.avg, 1)).alias("mean_difference"), *[F.coalesce(of(F.var_samp, k), F.lit(0.0)).alias(f"_v{k}") for k in (0, 1)])
    pooled = F.sqrt(((F.col("_q") - 1) * F.col("_v0") + (F.col("_p") - 1) * F.col("_v1")) / F.greatest(F.col("_p") + F.col("_q") - 2, F.lit(1)))
    return m.join(a, "dataset").select("dataset", "n", ((F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))).alias("auc"), F.when(pooled == 0, 0.0).otherwise(F.col("mean_difference") / pooled).alias("cohens_d"), "mean_difference")


def compare_models(models: DataFrame, name: str = "penalty") -> DataFrame:
    """A row per measure with the best model: the highest auc, cohens_d, mean_difference and js_divergence, the lowest overlap_coefficient, and the best
    balance (0.7 of the normalised area, 0.3 of the share of coefficients left out). Of equals the first by name. models has a row per model."""
    high = ("auc", "cohens_d", "mean_difference", "js_divergence")
    best = lambda c, sign: F.min(F.struct((-sign * c).alias("k"), F.col(name).alias("m")))["m"]
    span = models.agg(F.min("auc").alias("_lo"), F.max("auc").alias("_hi"), F.max("non_zero_coeffs").alias("_most"))
    m = with_stats(models, span)
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    balance = 0.7 * (F.col("auc") - F.col("_lo")) / width + 0.3 * (1 - F.coalesce(F.try_divide(F.col("non_zero_coeffs"), F.col("_most")), F.lit(0.0)))
    kinds = {**{c: best(F.col(c), 1) for c in high}, "overlap_coefficient": best(F.col("overlap_coefficient"), -1), "balance": best(balance, 1)}
    one = m.agg(*[c.alias(k) for k, c in kinds.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds))).alias("measure", "best"))


def combinations(rows: DataFrame, dataset: str, names: Sequence[str], groups: Sequence[str], value: str) -> DataFrame:
    """Per combination of two data sets or more, but not all, and group: n, mean and population deviation.

    The data sets are first reduced to sums per group; only those few rows are repeated per combination. `names` are the data sets, as the
    number of combinations doubles with each.
    """
    x = number(value)
    s = rows.filter(x.isNotNull()).groupBy(dataset, *groups).agg(F.count("*").alias("n"), F.avg(x).alias("_u"), F.var_pop(x).alias("_v"))
    combos = [c for k in range(2, len(names)) for c in itertools.combinations(sorted(names), k)]
    of = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.array(*[F.lit("_vs_".join(c)) for c in combos if n in c]).cast("array<string>")) for n in names]))
    each = s.select(*groups, "n", "_u", "_v", F.explode(F.try_element_at(of, F.col(dataset))).alias("combination"))
    g = each.groupBy("combination", *groups).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("_u")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * (F.col("_v") + F.col("_u") * F.col("_u"))) / F.sum("n")).alias("_q"))
    return g.select("combination", *groups, "n", "mean", F.sqrt(F.greatest(F.col("_q") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))
