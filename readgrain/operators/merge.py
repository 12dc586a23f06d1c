"""Merging what several runs, files and judges say about the same samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where each kind of metric keeps its configuration's name (last part of a path), and kinds without one.
CONFIG_KEYS = {
    "syntax": "spacy_model_syntax",
    "umls": "spacy_model_umls",
    "commonlit": "commonlit_model_type",
    "masked_prob": "masked_prob_model",
    "cluster": "cluster_model_path",
    "llm": "llm_model_path",
    "jargon": "jargon_pretrained_model",
}
LAST_PART = ("masked_prob", "cluster", "llm")


def subcategories(kind: Column, config: Column) -> Column:
    """The path below a kind of metric, from a map of settings; null where the kind has none or the setting is missing or empty."""
    out = F.lit(None).cast("array<string>")
    for k, key in CONFIG_KEYS.items():
        value = F.nullif(F.try_element_at(config, F.lit(key)), F.lit(""))
        value = F.element_at(F.split(value, "/"), -1) if k in LAST_PART else value
        path = F.array(F.coalesce(F.try_element_at(config, F.lit("masked_prob_method")), F.lit("random")), value) if k == "masked_prob" else F.array(value)
        out = F.when(kind == k, F.when(value.isNotNull(), path)).otherwise(out)
    return out


def dataset_of(json: Column) -> Column:
    """A file's data set: the first key of its object; null for what is no object or an empty one."""
    return F.try_element_at(F.json_object_keys(json), F.lit(1))


def write_paths(rows: DataFrame, keys: Sequence[str], path: str, order: str) -> DataFrame:
    """The writes that last: of those to one path (an array) the last, without paths below one that was written later as a whole.

    Equi-joins on the path only, so that no sample's writes meet in one task. Of writes with equal order an arbitrary one of those to the
    same path lasts, so order should be unique. A null path is the empty one; null keys are keys like others.
    """
    p = F.coalesce(F.col(path), F.array().cast("array<string>"))
    last = rows.withColumn(path, p).groupBy(*keys, path).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, path)]), order).alias("_w"))
    last = last.withColumn("_k", F.struct(*keys))  # structs with null fields are equal in a join
    above = last.select("_k", F.col(path).alias("_above"), F.col(f"_w.{order}").alias("_later"))
    prefixes = last.filter(F.size(path) > 0).select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda i: F.slice(path, 1, i))).alias("_above"))
    gone = prefixes.join(above, ["_k", "_above"]).filter(F.col("_later") > F.col(f"_w.{order}")).select("_k", path).distinct()
    return last.join(gone, ["_k", path], "left_anti").select(*keys, path, "_w.*")


def aligned_judges(rows: DataFrame, dataset: str, judge: str, position: str, kind: str, scores: Sequence[str]) -> DataFrame:
    """Per data set, position and kind of text that all judges of the data set have: the scores of all judges, in order of their names.

    A judge's repeated rows of a position count once (the least of them); rows without a data set are left out. The judges of a data set are few, so the count is broadcast only if
    Spark finds it small; the groups hold a row per judge.
    """
    n = rows.groupBy(dataset).agg(F.count_distinct(judge).alias("_n"))
    one = rows.groupBy(dataset, position, kind, judge).agg(F.min(F.struct(*scores)).alias("_s"))
    g = one.groupBy(dataset, position, kind).agg(F.sort_array(F.collect_list(F.struct(F.col(judge).alias("judge"), F.col("_s").alias("scores")))).alias("scores"))
    return g.join(n, dataset).filter(F.size("scores") == F.col("_n")).drop("_n")


def of_judges(scores: Column, names: Sequence[str]) -> Column:
    """The scores of the named judges; all of them if none is named or none matches."""
    chosen = F.filter(scores, lambda s: s["judge"].isin(list(names))) if names else scores
    return F.when(F.size(chosen) > 0, chosen).otherwise(scores)


def judged(scores: dict[str, Column]) -> Column:
    """A struct of a judgement: the scores by dimension and their mean."""
    return F.struct(F.struct(*[c.alias(n) for n, c in scores.items()]).alias("dimension_scores"), (sum(scores.values(), F.lit(0.0)) / len(scores)).alias("overall_score"))


def or_zero_mean(xs: Column) -> Column:
    """The mean of an array without its nulls, 0 if nothing is left: folds of an ensemble, sentences of a text, dimensions of a score."""
    some = F.filter(xs, lambda x: x.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(some)), F.lit(0.0))


def drop_variants(generations: Column, excluded: Column) -> Column:
    """Generations without the variants that excluded names, an array of structs g, v (places from 0). Null excludes nothing."""
    out = lambda g, i: F.filter(g["variants"], lambda v, j: ~F.exists(excluded, lambda e: (e["g"] == i) & (e["v"] == j)))
    return F.when(excluded.isNull(), generations).otherwise(F.transform(generations, lambda g, i: g.withField("variants", out(g, i))))


def complexity_levels(n: Column, seed: Column) -> Column:
    """n levels of 1 to 5: each once up to five, else 1 to 5 again and again in an order that the seed decides."""
    cyclic = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))).alias("k"), (1 + i % 5).cast("int").alias("l")))
    mixed = F.transform(F.array_sort(cyclic), lambda x: x["l"])
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= 5, F.sequence(F.lit(1), F.greatest(n, F.lit(1))).cast("array<int>")).otherwise(mixed)


def variants_or_empty(variants: Column, n: Column) -> Column:
    """Parsed variants, or n empty ones where nothing could be parsed."""
    empty = F.struct(F.lit(None).cast("string").alias("complexity_level"), F.lit("").alias("generated_answer"))
    return F.when(F.coalesce(F.size(variants), F.lit(0)) > 0, variants).otherwise(F.array_repeat(empty, n))


#: Order of a data set's categories.
CATEGORY_ORDER = {"training": 0, "training_test": 1, "evaluation": 2}


def sort_datasets(rows: DataFrame, name: str = "name", category: str = "category", parent: str = "parent") -> DataFrame:
    """rows by category, then by parent (held-out parts of training sets) or name, then by name."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_ORDER.items() for x in kv]), F.col(category)), F.lit(3))
    by = F.when(F.col(category) == "training_test", F.coalesce(F.col(parent), F.lit(""))).otherwise(F.col(name))
    return rows.orderBy(rank, by, name)


def without_outliers(rows: DataFrame, level: str, guess: str, most: float = 10) -> DataFrame:
    """Rows whose two levels are at most `most` apart; a missing level is no outlier."""
    return rows.filter(F.coalesce(F.abs(F.col(level) - F.col(guess)) <= most, F.lit(True)))


def level_histogram(rows: DataFrame, level: str, stage: str) -> DataFrame:
    """Rows per stage and level."""
    return rows.groupBy(stage, level).agg(F.count("*").alias("n"))


def numeric_where_possible(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of which every value is a number become doubles, others stay; decided in one pass over all rows."""
    texts = [c for c in columns if dict(rows.dtypes)[c] == "string"]
    if not texts:
        return rows
    bad = rows.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"_b{i}") for i, c in enumerate(texts)]).first()
    return rows.withColumns({c: F.col(c).cast("double") for i, c in enumerate(texts) if not bad[i]})


def columns_by_prefix(columns: Sequence[str], prefixes: dict[str, Sequence[str]], skip: Sequence[str] = (), rest: str = "other") -> dict[str, list[str]]:
    """Columns by the first group of which a prefix fits, the others under `rest`."""
    out: dict[str, list[str]] = {g: [] for g in (*prefixes, rest)}
    for c in columns:
        if c not in skip:
            out[next((g for g, ps in prefixes.items() if c.startswith(tuple(ps))), rest)].append(c)
    return out


def numeric_features(rows: DataFrame, skip: Sequence[str]) -> list[str]:
    """Names of the numeric columns but for those to skip."""
    return [f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") and f.name not in skip]


def by_absolute(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows from the greatest absolute value on, of equals by name."""
    return rows.orderBy(F.desc(F.abs(F.col(value))), name)


def in_groups(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """rows with epoch_order keys: groups in random order and rows in random order within, so that a sort on both keeps a group together."""
    h = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    return rows.withColumns({"group_order": h(group), "row_order": h(key)})


def first_of_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of one place and type once, in the place of the first."""
    return spans.dropDuplicates(list(keys))


def merge_near(spans: DataFrame, text: DataFrame, keys: Sequence[str], gap: int = 2) -> DataFrame:
    """Spans of one type, at most `gap` characters apart, with nothing but blanks or one hyphen between, become one; with their text.

    spans has keys, type, start, end (from 0, exclusive); text has keys and text. Spans whose trimmed text has fewer than two characters go
    first. Each span brings a slice of `gap` characters before it, so the text is joined once and isn't carried through the sort.
    """
    t = text.select(*keys, F.col("text").alias("_t"))
    s = spans.join(t, list(keys)).withColumn("text", F.expr("substring(_t, start + 1, end - start)")).filter(F.length(F.trim("text")) > 1)
    s = s.withColumn("_before", F.expr(f"substring(_t, greatest(start - {gap}, 0) + 1, least(start, {gap}))")).drop("_t")
    by = Window.partitionBy(*keys).orderBy("start", "end", "type")
    apart = F.col("start") - F.lag("end").over(by)
    between = F.when(apart > 0, F.trim(F.expr("right(_before, _gap)"))).otherwise("")
    s = s.withColumn("_gap", apart.cast("int")).withColumn("_near", (F.lag("type").over(by) == F.col("type")) & (F.col("_gap") <= gap) & between.isin("", "-"))
    s = s.withColumn("_id", F.sum(F.when(F.coalesce("_near", F.lit(False)), 0).otherwise(1)).over(by))
    m = s.groupBy(*keys, "_id").agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))
    return m.join(t, list(keys)).select(*keys, "type", "start", "end", F.expr("substring(_t, start + 1, end - start)").alias("text"))
