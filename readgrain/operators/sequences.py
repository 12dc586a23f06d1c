"""Ordered sequences: spans from tags, merging, vectors of neighbours and pairs, breakpoints, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bio_spans(rows: DataFrame, keys: Sequence[str], order: str, tag: str) -> DataFrame:
    """Spans of B-/I- tags per sequence: type, start and end position (exclusive). An I- of another type, or after none, opens a span."""
    by = Window.partitionBy(*keys).orderBy(order)
    kind = F.when(F.col(tag).rlike("^[BI]-"), F.substring(tag, 3, 1000))
    r = rows.select(*keys, F.col(order).alias("_o"), F.col(tag).alias("_t")).withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("_o")) - 1)
    by = Window.partitionBy(*keys).orderBy("_p")
    r = r.withColumn("type", F.when(F.col("_t").rlike("^[BI]-"), F.substring("_t", 3, 1000)))
    opens = F.col("type").isNotNull() & (F.col("_t").startswith("B-") | ~F.coalesce(F.lag("type").over(by) == F.col("type"), F.lit(False)))
    r = r.withColumn("_open", opens.cast("int")).withColumn("_id", F.sum("_open").over(by)).filter(F.col("type").isNotNull())
    return r.groupBy(*keys, "_id").agg(F.first("type").alias("type"), F.min("_p").alias("start"), (F.max("_p") + 1).alias("end")).drop("_id")


def merge_spans(spans: DataFrame, keys: Sequence[str], gap: int = 1) -> DataFrame:
    """Neighbouring spans of one type at most `gap` apart become one."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    near = (F.lag("type").over(by) == F.col("type")) & (F.col("start") - F.lag("end").over(by) <= gap)
    s = spans.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("_id", F.sum("_new").over(by))
    return s.groupBy(*keys, "_id").agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged")).drop("_id")


def spans_to_tags(tokens: DataFrame, spans: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """tokens (keys and positions) with a tag: B- and the type where a span starts, I- within it, else O. Of spans that overlap the first to start counts, then the longest.

    Each span is opened to its positions, so the join is by keys and position.
    """
    s = spans.filter(F.col("end") > F.col("start")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "type", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("_p"))
    s = s.groupBy(*[f"_k{i}" for i in range(len(keys))], "_p").agg(F.min(F.struct("start", (-F.col("end")).alias("e"), "type")).alias("_s"))
    on = F.col(position) == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    tag = F.when(F.col("_s").isNull(), "O").otherwise(F.concat(F.when(F.col("_s.start") == F.col(position), "B-").otherwise("I-"), F.col("_s.type")))
    return tokens.join(s, on, "left").select(*[tokens[c] for c in tokens.columns], tag.alias("tag"))


def vote(rows: DataFrame, keys: Sequence[str], order: str, tag: str) -> DataFrame:
    """Per word the most frequent B- tag, else I- tag, else O; of equals the first seen."""
    rank = F.when(F.col(tag).startswith("B-"), 2).when(F.col(tag).startswith("I-"), 1).otherwise(0)
    c = rows.groupBy(*keys, tag).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(*keys).agg(F.max_by(tag, F.struct(rank, F.col("n"), -F.col("first"))).alias("tag"))


def gap_index(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Clustering of positions: 1 / (1 + mean gap to the next); 0 for one position."""
    by = Window.partitionBy(*keys).orderBy(position)
    g = rows.withColumn("_g", F.lead(position).over(by) - F.col(position))
    return g.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_g").alias("mean_gap"), F.coalesce(1 / (1 + F.avg("_g")), F.lit(0.0)).alias("clustering"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def consecutive_cosine(rows: DataFrame, keys: Sequence[str], order: str, vector: str) -> DataFrame:
    """keys, order and the cosine with the next vector of the sequence (null for the last)."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_next", F.lead(vector).over(by)).select(*keys, order, F.when(F.col("_next").isNotNull(), cosine(F.col(vector), F.col("_next"))).alias("similarity"))


def mean_pair_cosine(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """The mean cosine of all pairs of a group, without the pairs: of unit vectors the sum of all products is the square of their sum.

    Null for fewer than two vectors. Linear in the rows, and summed on the map side.
    """
    v = F.col(vector)
    norm = F.sqrt(dot(v, v))
    unit = F.when(norm == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))
    long = rows.select(*keys, F.posexplode(unit).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_s"))
    squares = long.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(norm > 0).alias("_m"))
    return n.join(squares, list(keys)).select(*keys, "n", F.when(F.col("n") > 1, (F.col("_q") - F.col("_m")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))


def pair_cosines(rows: DataFrame, keys: Sequence[str], order: str, vector: str) -> DataFrame:
    """Cosines of all pairs i < j of a document's sentences; documents are short, so the join is within each."""
    a = rows.select(*keys, F.col(order).alias("i"), F.col(vector).alias("_a"))
    b = rows.select(*keys, F.col(order).alias("j"), F.col(vector).alias("_b"))
    return a.join(b, list(keys)).filter("i < j").select(*keys, "i", "j", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def breakpoints(rows: DataFrame, keys: Sequence[str], order: str, value: str, around: int = 1, percent: float = 0.75) -> DataFrame:
    """rows with the centred moving average of value (cut off at the ends) and whether it is below the percentile of its sequence's averages."""
    by = Window.partitionBy(*keys).orderBy(order)
    s = rows.withColumn("smoothed", F.avg(value).over(by.rowsBetween(-around, around)))
    limit = F.percentile("smoothed", F.lit(percent)).over(Window.partitionBy(*keys))
    return s.withColumn("is_break", F.col("smoothed") < limit)


def chunk_density(n_breaks: Column, n_sentences: Column) -> Column:
    """(breaks + 1) / sentences; 0 for no sentence, 1 for one."""
    return F.when(n_sentences == 0, 0.0).when(n_sentences == 1, 1.0).otherwise((n_breaks + 1) / n_sentences)


def ranked_mean_weight(rows: DataFrame, keys: Sequence[str], p: str, tie: str) -> DataFrame:
    """Sum over p in descending order of p / sqrt(rank), over the number of rows, and its negative logarithm (0 where it is not positive)."""
    by = Window.partitionBy(*keys).orderBy(F.desc(p), tie)
    r = rows.withColumn("_r", F.row_number().over(by))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col(p) / F.sqrt("_r")) / F.count("*")).alias("weighted"))
    return g.withColumn("score", F.when(F.col("weighted") > 0, -F.ln("weighted")).otherwise(0.0))


def bigram_counts(rows: DataFrame, words: Column) -> DataFrame:
    """Counts of neighbouring words."""
    w = rows.select(words.alias("_w"))
    pairs = w.select(F.explode(F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("x"))
    return pairs.groupBy("x.first", "x.second").agg(F.count("*").alias("n"))
