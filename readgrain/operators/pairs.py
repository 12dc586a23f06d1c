"""Scores of a generated text against a reference text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readgrain.functions.text import bound


def tokens(t: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(ws: Column, n: int) -> Column:
    if n == 1:
        return ws
    grams = lambda o: F.transform(F.sequence(F.lit(1), F.greatest(F.size(o) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(o, i, n)))
    return bound(ws, lambda o: F.when(F.size(o) < n, F.array().cast("array<string>")).otherwise(grams(o)))


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings: both are sorted as one, and one fold pairs equal elements. Linear after the sort."""
    side = lambda xs, s: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(s).alias("s")))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(acc: Column, e: Column) -> Column:
        left = F.when(acc["x"].eqNullSafe(e["x"]), acc["left"]).otherwise(0)
        pair = (e["s"] == 1) & (left > 0)
        return F.struct(e["x"].alias("x"), F.when(e["s"] == 0, left + 1).when(pair, left - 1).otherwise(left).alias("left"), F.when(pair, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda acc: acc["n"])


def prf(match: Column, generated: Column, reference: Column) -> dict[str, Column]:
    p, r = F.coalesce(F.try_divide(match, generated), F.lit(0.0)), F.coalesce(F.try_divide(match, reference), F.lit(0.0))
    return {"p": p, "r": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def rouge_n(rows: DataFrame, generated: str, reference: str, n: int) -> DataFrame:
    """rows with rouge{n}_p, _r and _f1."""
    r = rows.withColumns({"_g": ngrams(tokens(F.col(generated)), n), "_r": ngrams(tokens(F.col(reference)), n)})
    r = r.withColumn("_m", common(F.col("_g"), F.col("_r")))
    return r.withColumns({f"rouge{n}_{k}": v for k, v in prf(F.col("_m"), F.size("_g"), F.size("_r")).items()}).drop("_g", "_r", "_m")


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of a whole number."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = 0
    for x in b:
        u = row | at.get(x, 0)
        row = u & ~(u - (row << 1 | 1))
    return row.bit_count()


def rouge_l(rows: DataFrame, generated: str, reference: str) -> DataFrame:
    @F.pandas_udf("int")
    def lcs(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")

    r = rows.withColumns({"_g": tokens(F.col(generated)), "_r": tokens(F.col(reference))}).withColumn("_m", lcs("_g", "_r"))
    return r.withColumns({f"rougeL_{k}": v for k, v in prf(F.col("_m"), F.size("_g"), F.size("_r")).items()}).drop("_g", "_r", "_m")


def bleu(rows: DataFrame, generated: str, reference: str, most: int = 4, out: str = "bleu") -> DataFrame:
    """Geometric mean of n-gram precisions; of orders without a match the k-th counts as 1 / (2^k * number of its n-grams); brevity penalty."""
    r = rows.withColumns({"_g": tokens(F.col(generated)), "_r": tokens(F.col(reference))})
    for n in range(1, most + 1):
        r = r.withColumns({f"_m{n}": common(ngrams(F.col("_g"), n), ngrams(F.col("_r"), n)), f"_n{n}": F.greatest(F.size("_g") - n + 1, F.lit(1))})
    empty, logs = F.lit(0), F.lit(0.0)
    for n in range(1, most + 1):
        empty = empty + F.when(F.col(f"_m{n}") == 0, 1).otherwise(0)
        p = F.when(F.col(f"_m{n}") > 0, F.col(f"_m{n}") / F.col(f"_n{n}")).otherwise(1 / (F.pow(F.lit(2.0), empty) * F.col(f"_n{n}")))
        logs = logs + F.ln(p) / most
    short = F.when(F.size("_g") >= F.size("_r"), 1.0).otherwise(F.exp(1 - F.size("_r") / F.greatest(F.size("_g"), F.lit(1))))
    score = F.when((F.size("_g") == 0) | (F.col("_m1") == 0), 0.0).otherwise(short * F.exp(logs))
    return r.withColumn(out, score).drop("_g", "_r", *[f"_{k}{n}" for n in range(1, most + 1) for k in "mn"])


def max_then_mean(rows: DataFrame, pair: str, claim: str, score: str) -> DataFrame:
    """Per pair the mean over claims of the best score over sources."""
    best = rows.groupBy(pair, claim).agg(F.max(score).alias("_b"))
    return best.groupBy(pair).agg(F.count("*").alias("n_claims"), F.avg("_b").alias("score"))


def reference_mean(rows: DataFrame, keys: list[str], score: str, how: str = "mean") -> DataFrame:
    return rows.groupBy(*keys).agg((F.avg(score) if how == "mean" else F.max(score)).alias(score))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def squared_distance_targets(scores: Column, temperature: float = 1.0, levels: int = 5) -> Column:
    """softmax over k = 1 ... levels of minus the sum of (k - score)^2 over the temperature."""
    far = lambda k: F.aggregate(scores, F.lit(0.0), lambda a, s: a + (k - s) * (k - s))
    return softmax(F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: -far(k.cast("double")) / temperature))


def histogram_targets(scores: Column, levels: int = 5) -> Column:
    near = F.transform(scores, lambda s: F.greatest(F.lit(1.0), F.least(F.lit(float(levels)), F.bround(s))))
    return softmax(F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.size(F.filter(near, lambda x: x == k)).cast("double")))


def expected_score(weights: Column) -> Column:
    return F.aggregate(F.transform(weights, lambda w, i: w * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def best_match(rows: DataFrame, pair: str, source: str, claim: str, forward: str, backward: str) -> DataFrame:
    """Per pair precision (mean over claims of the best forward score), recall (mean over sources of the best backward score) and F1; scores below 0 count 0.

    rows has a row per source and claim of a pair; the maxima are combined on the map side.
    """
    best = lambda at, score: rows.groupBy(pair, at).agg(F.greatest(F.coalesce(F.max(score), F.lit(0.0)), F.lit(0.0)).alias("_b")).groupBy(pair)
    p = best(claim, forward).agg(F.avg("_b").alias("precision"))
    r = best(source, backward).agg(F.avg("_b").alias("recall"))
    return p.join(r, pair).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def best_chain(scores: Column) -> Column:
    """Of a matrix (array of rows per source, each an array of scores per claim) the best sum of one score a source, at claims that never go back, and sources
    left out where that is better, over the number of sources; 0 for an empty matrix."""

    def row(before: Column, ms: Column) -> Column:
        first = F.array(F.lit(0.0))
        cells = F.zip_with(F.zip_with(F.slice(before, 1, F.size(ms)), F.slice(before, 2, F.size(ms)), lambda a, b: F.greatest(a, b)), ms, lambda a, m: a + m.cast("double"))
        return F.aggregate(cells, first, lambda acc, c: F.array_append(acc, F.greatest(c, F.element_at(acc, -1))))

    start = F.array_repeat(F.lit(0.0), F.size(scores[0]) + 1)
    return F.when(F.coalesce(F.size(scores), F.lit(0)) > 0, F.element_at(F.aggregate(scores, start, row), -1) / F.size(scores)).otherwise(0.0)
