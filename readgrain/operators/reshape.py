"""Keys, trees, wide and long forms, judges, resumption, grids and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_kept(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys the first by order, by aggregation."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order), *rest)).alias("_x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in rows.columns])


def qa_ids(rows: DataFrame, question: str, answer: str, order: str) -> DataFrame:
    """Distinct (question, answer) with Qi_Aj: i by first appearance of the question, j by that of the answer within it.

    The numbers of questions come from their first places by ranges (readgrain.operators.order), not from one sorted task.
    """
    from readgrain.operators.order import ranked

    pairs = rows.groupBy(question, answer).agg(F.min(order).alias("_pos"))
    per = pairs.groupBy(question).agg(F.min("_pos").alias("_first"))
    number = ranked(per, "_first").select(F.col("_first").alias("_f"), (F.col("n_before") + 1).alias("_q"))
    per = per.join(number, F.col("_first") == F.col("_f")).select(F.col(question).alias("_question"), "_q")
    both = pairs.join(per, F.col(question).eqNullSafe(F.col("_question"))).withColumn("_a", F.row_number().over(Window.partitionBy("_q").orderBy("_pos")))
    return both.select(F.format_string("Q%d_A%d", F.col("_q"), F.col("_a")).alias("sample_id"), question, answer)


def pair_rows(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """Paired samples (structs simple and expert) as two rows each."""
    return rows.select(key, F.explode(F.array(F.struct(F.lit("simple").alias("text_type"), F.col("simple").alias("x")), F.struct(F.lit("expert").alias("text_type"), F.col("expert").alias("x")))).alias("r")).select(key, "r.text_type", "r.x.*")


def tree_rows(trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A tree (original_answer, generations of variants) as rows: the original, then each variant that is not blank, with its place."""
    base = trees.select(*keys, F.lit("original").alias("text_type"), F.lit(None).cast("int").alias("gen_idx"), F.lit(None).cast("int").alias("var_idx"), F.lit(None).cast("string").alias("model_used"), F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("string").alias("complexity_level"), F.col("original_answer").alias("text"))
    g = trees.select(*keys, F.posexplode("generations").alias("gen_idx", "g"))
    v = g.select(*keys, "gen_idx", F.col("g.model_used").alias("model_used"), F.col("g.temperature").cast("double").alias("temperature"), F.posexplode("g.variants").alias("var_idx", "v"))
    v = v.select(*keys, F.lit("variant").alias("text_type"), "gen_idx", "var_idx", "model_used", "temperature", F.col("v.complexity_level").cast("string").alias("complexity_level"), F.col("v.generated_answer").alias("text"))
    return base.unionByName(v.filter(F.trim("text") != ""))


def valid_tree() -> dict[str, Column]:
    """Checks of a tree: usable (original and generations present, no mismatch, no generation without any answer) and flagged (some answer empty, or a level beyond 1 to 5)."""
    blank = lambda v: F.coalesce(F.trim(v["generated_answer"]), F.lit("")) == ""
    level = lambda v: F.regexp_extract(F.coalesce(v["complexity_level"].cast("string"), F.lit("")), "[0-9]+", 0).try_cast("int")
    g = F.col("generations")
    mismatch = F.exists(g, lambda x: F.exists(x["variants"], lambda v: F.coalesce(v["generated_answer"].contains("CONTENT_MISMATCH"), F.lit(False))))
    empty = F.exists(g, lambda x: F.forall(x["variants"], blank))
    partly = F.exists(g, lambda x: F.exists(x["variants"], lambda v: blank(v) | ~F.coalesce(level(v).between(1, 5), F.lit(False))))
    usable = F.col("question_id").isNotNull() & F.col("original_answer").isNotNull() & (F.size(g) > 0) & ~mismatch & ~empty
    return {"usable": F.coalesce(usable, F.lit(False)), "flagged": F.coalesce(partly, F.lit(False))}


def rebuild(rows: DataFrame, keys: Sequence[str], group: Sequence[str], leaf: Sequence[str]) -> DataFrame:
    """Rows back to nested form: keys -> groups -> leaves in order."""
    inner = rows.groupBy(*keys, *group).agg(F.array_sort(F.collect_list(F.struct(*leaf))).alias("variants"))
    return inner.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*group, "variants"))).alias("generations"))


def metrics_long(rows: DataFrame, keys: Sequence[str], metrics: str) -> DataFrame:
    """A map (or JSON text) of metrics as rows (metric, value); numbers only."""
    kind = dict(rows.dtypes)[metrics]
    m = F.col(metrics) if kind.startswith("map") else F.from_json(metrics, "map<string,string>")
    return rows.select(*keys, F.explode(m).alias("metric", "value")).withColumn("value", F.col("value").try_cast("double")).filter("value IS NOT NULL")


def metrics_wide(long: DataFrame, keys: Sequence[str], names: Sequence[str], how: str = "avg") -> DataFrame:
    """Rows (metric, value) as one column per name; the names are given, so no pass is needed to find them."""
    fn = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "first": F.first, "count": F.count}[how]
    return long.groupBy(*keys).agg(*[fn(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def judge_average(rows: DataFrame, keys: Sequence[str], judge: str, value: str, exclude: str | None = None) -> DataFrame:
    """The mean over judges whose name doesn't match `exclude`, where there are two or more."""
    kept = rows.filter(~F.col(judge).rlike(exclude)) if exclude else rows
    per = kept.groupBy(*keys, judge).agg(F.avg(value).alias("_v"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_judges"), F.avg("_v").alias("average")).filter("n_judges > 1")


def variants_with_originals(variants: DataFrame, originals: DataFrame, keys: Sequence[str], order: str, take: Sequence[str]) -> DataFrame:
    """Variants joined to their original; of several originals with one key the last counts."""
    last = originals.groupBy(*keys).agg(F.max(F.struct(order, *take)).alias("_o")).select(*keys, *[F.col(f"_o.{c}").alias(f"original_{c}") for c in take])
    return variants.join(last, list(keys))


def resume(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def grid(rows: DataFrame, levels: Column, name: str = "complexity_level") -> DataFrame:
    """Each row once per level."""
    return rows.withColumn(name, F.explode(levels))


def nearest(rows: DataFrame, keys: Sequence[str], value: str, target: Column, k: int, tie: str) -> DataFrame:
    """Per key the k rows nearest to a target, of equals the first."""
    by = Window.partitionBy(*keys).orderBy(F.abs(F.col(value) - target), tie)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def split_by_group(rows: DataFrame, group: str, share: float = 0.2, salt: str = "") -> DataFrame:
    """rows with split: all rows of a group on one side, by a hash of the group."""
    part = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(F.col(group).cast("string"), F.lit("")))), 1, 6), 16, 10).cast("long")
    return rows.withColumn("split", F.when(part < int(share * 16**6), "test").otherwise("train"))


def merge_configs(rows: DataFrame, first: Sequence[str], flags: Sequence[str], order: str) -> DataFrame:
    """One configuration of many: the first of each value, a disable flag only if all set it."""
    return rows.agg(*[F.min_by(c, order).alias(c) for c in first], *[F.bool_and(c).alias(c) for c in flags])


def bin_by_thresholds(rows: DataFrame, table: DataFrame, score: str, out: str = "bin") -> DataFrame:
    """rows with the bin of the closed range [raw_min, raw_max] that holds the score, the first in order of bins; null in a gap.

    The table has some rows, so it is compiled into one expression and no join is made.
    """
    bins = table.select("bin", "raw_min", "raw_max").orderBy("bin").limit(1001).collect()
    if len(bins) > 1000:
        raise ValueError("more than 1,000 ranges")
    ranges = F.array(*[F.struct(F.lit(int(b)).alias("b"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for b, x, y in bins])
    return rows.withColumn(out, F.get(F.filter(ranges, lambda r: F.col(score).between(r["x"], r["y"])), F.lit(0))["b"])
