"""Mixing sources to target weights [native]: hash-random order within each source, distributed prefix sums, an exact cut.

Each row has a random but repeatable key, the MD5 of its id and text. Per source, the leading bits of the key are cut into about
sqrt(rows) / 4 ranges; sizes are summed per range (map side first), the range sums are prefix-summed per source, and the one range in
which the budget ends is sorted to find the row of the cut. The outcome per source is four values (epochs, cut key, words left, rows at
the cut), so the mix itself is a projection of the documents: no text is shuffled, and a source with a third of all rows is not special.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readgrain.llm.common import count_words, materialise

CYCLE = (1, 2, 3)
CAP = 3


def mix_key(doc_id: Column, text: Column) -> Column:
    """Hash-random key of a row; equal only for rows of equal id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("text")).alias("key"))


def targets(rows: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """A row per source: weight, size, and its target after water-filling: no target above cap times the size, the excess reshared by weight.

    Sorted by cap / weight, the sources at their cap are a prefix; the level of the others follows from two running sums.
    """
    per = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    per = per.withColumn("sidx", F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.lit(list(cycle)), ((F.col("sidx") - 1) % len(cycle)) + 1).cast("long"))
    ratio = F.col("source_size").cast("double") * cap / F.col("weight")
    by = Window.orderBy("ratio", "sidx")
    per = per.withColumn("ratio", ratio).withColumns(
        {
            "below": F.coalesce(F.sum(F.col("source_size") * cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "open": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total").cast("double") * share - F.col("below")) / F.col("open")
    per = per.withColumn("level", F.when(level <= F.col("ratio"), F.struct(F.col("ratio"), F.col("sidx"), level.alias("v"))))
    first = F.min("level").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("level", F.coalesce(first["v"], F.lit(float("inf"))))
    target = F.least(F.col("level") * F.col("weight"), (F.col("source_size") * cap).cast("double"))
    return per.select("source", "sidx", "weight", "rows", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def cuts(rows: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """A row per source: source_size, target, epochs (whole repeats), cut_key, cut_words and cut_rows.

    Rows with a smaller key are taken once more than `epochs`; the `cut_rows` rows of cut_key share cut_words.
    """
    per = targets(rows, cycle, share, cap)
    budget = F.floor(F.col("target")).cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    per = per.withColumns({"epochs": (budget - budget % size) / size, "rest": budget % size, "ranges": F.ceil(F.sqrt(F.col("rows").cast("double")) / 4)})
    per = materialise(per.withColumn("epochs", F.col("epochs").cast("long")), "mix-sources")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = rows.join(per.select("source", "sidx", "rest", "ranges"), rows["source"].eqNullSafe(per["source"])).select(
        "sidx", "rest", "size", "key", F.floor(place * F.col("ranges") / F.lit(2**32)).cast("long").alias("range")
    )
    sums = dealt.groupBy("sidx", "rest", "range").agg(F.sum("size").alias("words"))
    by = Window.partitionBy("sidx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by), F.lit(0)))
    ends = sums.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("sidx", "range", "before")
    inside = dealt.join(ends, ["sidx", "range"]).groupBy("sidx", "rest", "before", "key").agg(F.sum("size").alias("words"), F.count("*").alias("cut_rows"))
    run = F.sum("words").over(Window.partitionBy("sidx").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(run, F.lit(0)))
    cut = inside.filter((F.col("left") >= 0) & (F.col("left") < F.col("words"))).select("sidx", F.col("key").alias("cut_key"), F.col("left").alias("cut_words"), "cut_rows")
    return materialise(per.join(cut, "sidx", "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_rows"), "mix-cuts")


def _extra(key: Column, size: Column, of: str = "") -> Column:
    """Words of a row beyond the whole epochs; of: what stands before the names of a source's columns."""
    at, words, rows = (F.col(of + c) for c in ("cut_key", "cut_words", "cut_rows"))
    part = F.floor(words / F.greatest(rows, F.lit(1)))
    return F.when(key < at, size).when(key == at, F.least(part, size)).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, a row per row of docs; the words taken of a source add up to its target's whole part.

    Null or empty texts have size 0 and nothing is taken of them. Null sources are one source, the last. Rows of equal id and text that
    stand at the cut share what is left evenly (rounded down). An empty table gives no rows. Other columns of docs are not looked at.
    """
    rows = materialise(sized(docs), "mix-sizes")
    per = cuts(rows, cycle, share, cap)
    both = rows.join(per.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s")))
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _extra(F.col("key"), F.col("size"))).alias("taken"))


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """The mix itself: whole rows of docs, each as often as the mix takes it; the row at the cut is taken if at least half of it is within the budget."""
    rows = materialise(sized(docs), "mix-sizes")
    own = "__rg_"  # before all names that are added to those of docs
    per = cuts(rows, cycle, share, cap)
    per = per.select(*[F.col(c).alias(own + c) for c in per.columns])
    key, size = F.col(own + "key"), F.col(own + "size")
    wide = docs.withColumns({own + "key": mix_key(F.col("doc_id"), F.col("text")), own + "size": count_words(F.col("text"))}).join(per, F.col("source").eqNullSafe(F.col(own + "source")))
    once = F.when(_extra(key, size, own) * 2 >= F.greatest(size, F.lit(1)), 1).otherwise(0)
    # a row without words costs nothing: it is taken like its source's rows before the cut
    once = F.when(size == 0, F.when(F.coalesce(key < F.col(own + "cut_key"), F.lit(False)), 1).otherwise(0)).otherwise(once)
    wide = wide.withColumn(own + "n", (F.col(own + "epochs") + once).cast("int")).filter(F.col(own + "n") > 0)
    return wide.withColumn(own + "i", F.explode(F.sequence(F.lit(1), F.col(own + "n")))).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
       md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS LAST) AS sidx FROM s),
v AS (SELECT *, CAST((sidx - 1) % 3 + 1 AS BIGINT) AS weight FROM w),
r AS (SELECT *, CAST(source_size AS DOUBLE) * 3 / weight AS ratio FROM v),
p AS (SELECT *, CAST(coalesce(sum(source_size * 3) OVER (ORDER BY ratio, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS below,
       CAST(sum(weight) OVER (ORDER BY ratio, sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open,
       CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
l AS (SELECT (total - below) / open AS level FROM p WHERE (total - below) / open <= ratio ORDER BY ratio, sidx LIMIT 1),
t AS (SELECT source, source_size, least(weight * (SELECT level FROM l), CAST(source_size * 3 AS DOUBLE)) AS target FROM p),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, greatest(source_size, 1) AS whole FROM t),
k AS (SELECT source, key, sum(size) AS words, count(*) AS n FROM d GROUP BY source, key),
q AS (SELECT source, key, n, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT d.doc_id, d.size, b.source_size, b.target,
       CAST((b.budget // b.whole) * d.size + least(greatest((b.budget % b.whole - q.before) // q.n, 0), d.size) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.key = q.key
"""
