"""Statistics over numeric columns: scaling, separation of two classes, histograms, tests, outliers, correlation.

All are aggregates with a map-side part; order statistics come from readgrain.operators.order, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readgrain.operators.order import quantiles, ranked


def number(c: str) -> Column:
    """A column as a double, NaN as null."""
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with the columns of a one-row table as literals, so that what follows is a plain projection (null if the table is empty)."""
    one = stats.first()
    return rows.withColumns({f.name: F.lit(None if one is None else one[f.name]).cast(f.dataType) for f in stats.schema.fields})


def repair_infinity(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plus infinity becomes the greatest finite value, minus infinity the least; 0 if none is finite."""
    inf, aggs = float("inf"), []
    for c in columns:
        finite = F.when(F.abs(number(c)) < inf, number(c))
        aggs += [F.max(finite).alias(f"_max_{c}"), F.min(finite).alias(f"_min_{c}")]
    both = with_stats(rows, rows.agg(*aggs))
    fixed = {c: F.when(number(c) == inf, F.coalesce(F.col(f"_max_{c}"), F.lit(0.0))).when(number(c) == -inf, F.coalesce(F.col(f"_min_{c}"), F.lit(0.0))).otherwise(number(c)) for c in columns}
    return both.withColumns(fixed).select(*rows.columns)


def impute_mean(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the column's mean, 0 if all are null."""
    both = with_stats(rows, rows.agg(*[F.avg(number(c)).alias(f"_m_{c}") for c in columns]))
    return both.withColumns({c: F.coalesce(number(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).select(*rows.columns)


def _scale(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(0.0)) == 0, 1.0).otherwise(x)


def normalise(rows: DataFrame, columns: Sequence[str], how: str = "z_score") -> DataFrame:
    """z_score (population deviation), min_max or robust (median, quartile distance); a constant column is divided by 1; null stays."""
    if how == "robust":
        out = rows
        for c in columns:
            q = quantiles(rows, c, (0.25, 0.5, 0.75)).select(F.col("q1").alias("_c"), (F.col("q2") - F.col("q0")).alias("_s"))
            out = with_stats(out, q).withColumn(c, (number(c) - F.col("_c")) / _scale(F.col("_s"))).drop("_c", "_s")
        return out
    aggs = []
    for c in columns:
        if how == "z_score":
            aggs += [F.avg(number(c)).alias(f"_c_{c}"), F.stddev_pop(number(c)).alias(f"_s_{c}")]
        elif how == "min_max":
            aggs += [F.min(number(c)).alias(f"_c_{c}"), (F.max(number(c)) - F.min(number(c))).alias(f"_s_{c}")]
        else:
            raise ValueError(f"unknown normalisation: {how}")
    both = with_stats(rows, rows.agg(*aggs))
    return both.withColumns({c: (number(c) - F.col(f"_c_{c}")) / _scale(F.col(f"_s_{c}")) for c in columns}).select(*rows.columns)


def to_hundred(rows: DataFrame, value: str, out: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Min-max to 0 ... 100, with fixed bounds if given; a constant gives 50."""
    both = with_stats(rows, rows.agg(F.min(number(value)).alias("_lo"), F.max(number(value)).alias("_hi")))
    lo, hi = (F.lit(float(x)) if x is not None else F.col(c) for x, c in ((low, "_lo"), (high, "_hi")))
    return both.withColumn(out, F.when(hi == lo, 50.0).otherwise((number(value) - lo) / (hi - lo) * 100)).drop("_lo", "_hi")


def discretise(c: Column, step: int = 5) -> Column:
    """To multiples of step, halves to even."""
    return F.bround(c / step) * step


def long_form(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), number(c).alias("value")) for c in columns])).alias("x")).select(*keys, "x.metric", "x.value")


def moments(rows: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    return rows.filter(number(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(number(value)).alias("mean"), F.var_samp(number(value)).alias("var"), F.min(number(value)).alias("min"), F.max(number(value)).alias("max"))


def cohens_d(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Per metric (mean of class 0 - mean of class 1) over the pooled sample deviation; 0 if that is 0."""
    m = moments(long_form(rows, [label], columns), ["metric", label])
    of = lambda k, c: F.max(F.when(F.col(label) == k, F.col(c)))
    p = m.groupBy("metric").agg(*[of(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "mean", "var")])
    pooled = F.sqrt(((F.col("n0") - 1) * F.coalesce("var0", F.lit(0.0)) + (F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0))) / F.greatest(F.col("n0") + F.col("n1") - 2, F.lit(1)))
    return p.filter((F.col("n0") >= 2) & (F.col("n1") >= 2)).select("metric", "n0", "n1", F.when(pooled == 0, 0.0).otherwise((F.col("mean0") - F.col("mean1")) / pooled).alias("d"))


def auc(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Per metric the area under the curve of class 1 by average ranks, and turned so that it is 0.5 at least where class 1 is lower."""
    long = long_form(rows, [label], columns).filter("value IS NOT NULL")
    r = ranked(long, "value", ["metric"])
    per = long.groupBy("metric", "value").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    both = per.join(r.select("metric", "value", (F.col("n_before") + (F.col("n_rows") + 1) / 2).alias("rank")), ["metric", "value"])
    s = both.groupBy("metric").agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), F.sum("q").alias("q"), (F.sum(F.col("value") * F.col("p")) / F.sum("p") - F.sum(F.col("value") * F.col("q")) / F.sum("q")).alias("diff"))
    area = F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return s.select("metric", area.alias("auc"), F.when(F.col("diff") < 0, 1 - area).otherwise(area).alias("auc_directed"))


def youden(rows: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold (a value of score) with the greatest true minus false positive rate, the highest of equals."""
    r = rows.filter(number(score).isNotNull() & F.col(label).isNotNull())
    per = r.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    # rows of a class below a value: by the value's rank in the class, or, if the class lacks it, by its rank among all
    below = lambda rows, name: ranked(rows, score).select(F.col(score).alias("threshold"), F.col("n_before").alias(name))
    totals = r.agg(F.count_if(F.col(label) == 1).alias("all_p"), F.count_if(F.col(label) == 0).alias("all_q"))
    both = per.join(below(r, "ab"), "threshold").join(below(r.filter(F.col(label) == 1), "pb"), "threshold", "left").join(below(r.filter(F.col(label) == 0), "qb"), "threshold", "left")
    both = with_stats(both, totals)
    below_p, below_q = F.coalesce("pb", F.col("ab") - F.col("qb")), F.coalesce("qb", F.col("ab") - F.col("pb"))
    j = (F.col("all_p") - below_p) / F.col("all_p") - (F.col("all_q") - below_q) / F.col("all_q")
    best = both.filter("all_p > 0 AND all_q > 0").select("threshold", F.round(j, 12).alias("j")).groupBy().agg(F.max(F.struct("j", "threshold")).alias("x"))
    return best.select("x.threshold", "x.j")


def histograms(rows: DataFrame, label: str, columns: Sequence[str], bins: int = 100) -> DataFrame:
    """Per metric and bin (of equal width over the shared range, the last closed) the share of rows of classes 0 and 1, and the bin's width."""
    long = long_form(rows, [label], columns).filter("value IS NOT NULL")
    span = long.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)))
    h = long.join(span, "metric").groupBy("metric", place.alias("bin"), "n0", "n1", width.alias("width")).agg(F.count_if(F.col(label) == 0).alias("c0"), F.count_if(F.col(label) == 1).alias("c1"))
    return h.select("metric", "bin", "width", (F.col("c0") / F.col("n0")).alias("p0"), (F.col("c1") / F.col("n1")).alias("p1"))


def divergences(rows: DataFrame, label: str, columns: Sequence[str], bins: int = 100, eps: float = 1e-10) -> DataFrame:
    """Per metric the overlap of the two histograms (1 for a constant), Kullback-Leibler and Jensen-Shannon divergence (natural log; 0 for a constant)."""
    h = histograms(rows, label, columns, bins)
    w = F.col("width")
    flat = F.max(w) == 0
    # densities plus eps, renormalised; empty bins of both classes hold eps only
    d0, d1 = F.col("p0") / F.when(w == 0, 1.0).otherwise(w) + eps, F.col("p1") / F.when(w == 0, 1.0).otherwise(w) + eps
    h = h.withColumns({"d0": d0, "d1": d1})
    s = h.groupBy("metric").agg((F.sum("d0") + (bins - F.count("*")) * eps).alias("s0"), (F.sum("d1") + (bins - F.count("*")) * eps).alias("s1"), (bins - F.count("*")).alias("rest"))
    j = h.join(s, "metric").withColumns({"a": F.col("d0") / F.col("s0"), "b": F.col("d1") / F.col("s1")}).withColumn("m", (F.col("a") + F.col("b")) / 2)
    ra, rb = eps / F.max("s0"), eps / F.max("s1")
    rm = (ra + rb) / 2
    rest = F.max("rest")
    kl = F.sum(F.col("a") * F.ln(F.col("a") / F.col("b"))) + rest * ra * F.ln(ra / rb)
    js = (F.sum(F.col("a") * F.ln(F.col("a") / F.col("m"))) + rest * ra * F.ln(ra / rm) + F.sum(F.col("b") * F.ln(F.col("b") / F.col("m"))) + rest * rb * F.ln(rb / rm)) / 2
    return j.groupBy("metric").agg(F.when(flat, 1.0).otherwise(F.least(F.lit(1.0), F.sum(F.least("p0", "p1")))).alias("overlap"), F.when(flat, 0.0).otherwise(kl).alias("kl"), F.when(flat, 0.0).otherwise(js).alias("js"))


def iqr_outliers(rows: DataFrame, value: str, group: str, k: float = 1.5) -> DataFrame:
    """Rows outside the fences q1 - k iqr, q3 + k iqr of all rows: count and percent per group, and for all (group null)."""
    q = quantiles(rows, value, (0.25, 0.75)).select((F.col("q0") - k * (F.col("q1") - F.col("q0"))).alias("_lo"), (F.col("q1") + k * (F.col("q1") - F.col("q0"))).alias("_hi"))
    out = (number(value) < F.col("_lo")) | (number(value) > F.col("_hi"))
    flagged = with_stats(rows.select(group, value), q).withColumn("_out", out.cast("int"))
    return flagged.groupingSets([[group], []], group).agg(F.grouping(group).alias("is_total"), F.count(value).alias("n"), F.sum("_out").alias("n_outliers"), (F.sum("_out") * 100.0 / F.count(value)).alias("percent"))


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns (a before b), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(number(a), number(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def drop_correlated(matrix: DataFrame, aucs: dict[str, float], columns: Sequence[str], threshold: float = 0.7) -> tuple[list[str], dict[str, str]]:
    """Greedy, in column order: of two columns whose absolute correlation is above the threshold the one of the lower area goes. One row per pair of columns is read."""
    strong = {(r["a"], r["b"]) for r in matrix.filter(F.abs("corr") > threshold).collect()}
    gone: dict[str, str] = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if (a, b) in strong and a not in gone and b not in gone:
                lose, keep = (b, a) if aucs.get(a, 0.5) >= aucs.get(b, 0.5) else (a, b)
                gone[lose] = keep
    return [c for c in columns if c not in gone], gone


def bin_statistics(rows: DataFrame, bin_column: str, value: str) -> DataFrame:
    """Per bin: count, mean, min, max, population deviation, median and quartiles."""
    m = rows.groupBy(bin_column).agg(F.count(value).alias("n"), F.avg(number(value)).alias("mean"), F.min(number(value)).alias("min"), F.max(number(value)).alias("max"), F.stddev_pop(number(value)).alias("std"))
    q = quantiles(rows, value, (0.25, 0.5, 0.75), [bin_column]).select(F.col(bin_column).alias("_b"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    return m.join(q, m[bin_column].eqNullSafe(q["_b"]), "left").drop("_b")


def adjacent_welch(rows: DataFrame, bin_column: str, value: str) -> DataFrame:
    """Welch's t and degrees of freedom between each bin and the next, and the difference of means (a row per bin: few)."""
    m = moments(rows, [bin_column], value)
    by = Window.orderBy(bin_column)
    m = m.withColumns({c + "2": F.lead(c).over(by) for c in (bin_column, "n", "mean", "var")}).filter(F.col("n2").isNotNull() & (F.col("n") > 1) & (F.col("n2") > 1))
    a, b = F.col("var") / F.col("n"), F.col("var2") / F.col("n2")
    t = F.try_divide(F.col("mean") - F.col("mean2"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (F.col("n2") - 1))
    return m.select(F.col(bin_column).alias("bin"), F.col(bin_column + "2").alias("next_bin"), (F.col("mean2") - F.col("mean")).alias("mean_difference"), t.alias("t"), df.alias("df"))


def anova(rows: DataFrame, bin_column: str, value: str) -> DataFrame:
    """One-way F over bins, from each bin's moments."""
    m = moments(rows.filter(F.col(bin_column).isNotNull()), [bin_column], value).withColumns({"s": F.col("n") * F.col("mean")})
    total = m.agg(F.sum("n").alias("n_all"), (F.sum("s") / F.sum("n")).alias("grand"), F.count("*").alias("k"))
    both = with_stats(m, total)
    s = both.agg(F.max("n_all").alias("n_all"), F.max("k").alias("k"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ssb"), F.sum(F.coalesce("var", F.lit(0.0)) * (F.col("n") - 1)).alias("ssw"))
    return s.select((F.col("k") - 1).alias("df_between"), (F.col("n_all") - F.col("k")).alias("df_within"), F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n_all") - F.col("k"))).alias("f"))


def error_metrics(rows: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """Per group with two rows or more: mean absolute and root mean square error, correlation, R squared (0 for a constant truth)."""
    y, p = number(truth), number(guess)
    g = rows.filter(y.isNotNull() & p.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.corr(y, p).alias("corr"), F.sum((y - p) * (y - p)).alias("rss"), (F.var_pop(y) * F.count("*")).alias("tss"))
    return g.filter("n > 1").select(group, "n", "mae", "rmse", "corr", F.when(F.col("tss") == 0, 0.0).otherwise(1 - F.col("rss") / F.col("tss")).alias("r2"))


def entropy_top3(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Per group: rows, categories, entropy in bits, and the share of the three most frequent categories."""
    c = rows.groupBy(group, category).agg(F.count("*").alias("c"))
    by = Window.partitionBy(group)
    c = c.withColumns({"n": F.sum("c").over(by), "r": F.row_number().over(by.orderBy(F.desc("c"), category))})
    p = F.col("c") / F.col("n")
    return c.groupBy(group).agg(F.max("n").alias("n"), F.count("*").alias("n_categories"), F.sum(-p * F.log2(p)).alias("entropy"), F.sum(F.when(F.col("r") <= 3, p).otherwise(0.0)).alias("top3"))


def apply_formula(rows: DataFrame, intercept: float, coefficients: dict[str, float], scalers: dict[str, tuple[float, float]], out: str = "score") -> DataFrame:
    """intercept + sum of coefficient * (value - centre) / scale, as one expression."""
    score = F.lit(float(intercept))
    for c, w in coefficients.items():
        m, s = scalers.get(c, (0.0, 1.0))
        score = score + (number(c) - m) / (s or 1.0) * w
    return rows.withColumn(out, score)


def pairwise_accuracy(rows: DataFrame, pair: Sequence[str], level: str, value: str, low: str, high: str) -> DataFrame:
    """One row: pairs with both levels, those whose high level has the higher value, ties, and the share of right ones in per cent (0 without pairs). Of several rows of a level the mean counts; null values are left out."""
    of = lambda k: F.avg(F.when(F.col(level) == k, number(value)))
    p = rows.groupBy(*pair).agg(of(low).alias("_a"), of(high).alias("_b")).filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    s = p.agg(F.count("*").alias("total_pairs"), F.count_if(F.col("_b") > F.col("_a")).alias("correct_pairs"), F.count_if(F.col("_b") == F.col("_a")).alias("tied_pairs"))
    return s.withColumn("pairwise_accuracy", F.coalesce(F.try_divide(F.col("correct_pairs") * F.lit(100.0), F.col("total_pairs")), F.lit(0.0)))


def missing_report(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the numbers of rows and of null or not-a-number ones, and their share in per cent, from one pass."""
    kinds = dict(rows.dtypes)
    none = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    one = rows.agg(F.count("*").alias("_n"), *[F.count_if(none(c)).alias(f"_m{i}") for i, c in enumerate(columns)])
    long = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("n_missing")) for i, c in enumerate(columns)])).alias("x"))
    return long.select("x.column", F.col("_n").alias("n_rows"), "x.n_missing", F.coalesce(F.try_divide(F.col("x.n_missing") * F.lit(100.0), F.col("_n")), F.lit(0.0)).alias("percent_missing"))


def normality(rows: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Per group n, D'Agostino and Pearson's K2 (of skewness and kurtosis) and its p-value, exp(-K2 / 2); both null below 8 rows or without variance."""
    x = number(value)
    g = rows.filter(x.isNotNull()).groupBy(*groups).agg(F.count("*").cast("double").alias("n"), F.skewness(x).alias("_s"), (F.kurtosis(x) + 3).alias("_k"))
    n = F.col("n")
    y = F.col("_s") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    a = F.sqrt(2.0 / (w2 - 1))
    z1 = F.asinh(y / a) / F.sqrt(0.5 * F.log(w2))
    e = 3.0 * (n - 1) / (n + 1)
    v = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    b = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    c = 6.0 + 8.0 / b * (2.0 / b + F.sqrt(1 + 4.0 / (b * b)))
    d = 1 + (F.col("_k") - e) / F.sqrt(v) * F.sqrt(2.0 / (c - 4))
    z2 = (1 - 2.0 / (9 * c) - F.signum(d) * F.cbrt((1 - 2.0 / c) / F.abs(d))) / F.sqrt(2.0 / (9 * c))
    k2 = F.when((n >= 8) & F.col("_s").isNotNull() & ~F.isnan("_s"), z1 * z1 + z2 * z2)
    return g.select(*groups, n.cast("long").alias("n"), k2.alias("k2"), F.exp(-k2 / 2).alias("p_normal"))


def two_sample_test(rows: DataFrame, label: str, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Per metric the statistic of Welch's t (if normality isn't rejected in either class) or of Mann and Whitney's U of class 0, and the test's name."""
    long = long_form(rows, [label], columns)
    of = lambda k, c: F.max(F.when(F.col(label) == k, F.col(c)))
    p = normality(long, ["metric", label]).groupBy("metric").agg(of(0, "p_normal").alias("p0"), of(1, "p_normal").alias("p1"))
    m = moments(long, ["metric", label]).groupBy("metric").agg(*[of(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "mean", "var")])
    both = m.join(p, "metric").join(auc(rows, label, columns).select("metric", "auc"), "metric")
    welch = (F.col("mean0") - F.col("mean1")) / F.sqrt(F.col("var0") / F.col("n0") + F.col("var1") / F.col("n1"))
    u = (1 - F.col("auc")) * F.col("n0") * F.col("n1")
    normal = F.coalesce((F.col("p0") > alpha) & (F.col("p1") > alpha), F.lit(False))
    return both.select("metric", F.when(normal, welch).otherwise(u).alias("statistic"), F.when(normal, "ttest").otherwise("mann_whitney_u").alias("test_name"))


def mutual_information(rows: DataFrame, label: str, columns: Sequence[str], bins: int = 100) -> DataFrame:
    """Per metric the mutual information (nats) of its bin (equal width over the range, the last closed) and the label: a plug-in estimate, where the surveyed one looks at nearest neighbours with random ties."""
    long = long_form(rows, [label], columns).filter(F.col("value").isNotNull() & F.col(label).isNotNull())
    ends = long.groupBy("metric").agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.count("*").alias("_n"))
    width = (F.col("_b") - F.col("_a")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0)
    # a row per metric on one side, bins times labels rows per metric on the other
    cells = long.join(F.broadcast(ends), "metric").groupBy("metric", "_n", place.alias("_c"), F.col(label).alias("_y")).agg(F.count("*").alias("k"))
    sums = cells.withColumns({"kc": F.sum("k").over(Window.partitionBy("metric", "_c")), "ky": F.sum("k").over(Window.partitionBy("metric", "_y"))})
    return sums.groupBy("metric").agg(F.sum(F.col("k") / F.col("_n") * F.log(F.col("k") * F.col("_n") / (F.col("kc") * F.col("ky")))).alias("mutual_information"))
