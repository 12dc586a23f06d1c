"""A store of a corpus's term counts: counting, merging, saving, loading, information content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrain.storage import materialise

#: Terms at most, and characters of each, that every executor has at hand.
FREQUENT, LONGEST = 100_000, 64
#: Characters of a word list that every executor has at hand.
AT_HAND = 16_000_000


def term_counts(terms: DataFrame, term: str = "term") -> DataFrame:
    """Counts of lower-cased terms; null is no term."""
    return terms.filter(F.col(term).isNotNull()).groupBy(F.lower(term).alias("term")).agg(F.count("*").alias("n"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """The counts of several corpora as one."""
    every = parts[0].select("term", "n")
    for p in parts[1:]:
        every = every.unionByName(p.select("term", "n"))
    return every.groupBy("term").agg(F.sum("n").alias("n"))


def totals(counts: DataFrame, top: int = 100) -> DataFrame:
    """One row: total_terms, unique_terms and the most frequent terms (of equals by term), as structs."""
    best = counts.orderBy(F.desc("n"), "term").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "term"))).alias("_b"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_terms"), F.count("*").alias("unique_terms"))
    both = n.unionByName(best, allowMissingColumns=True).agg(F.max("total_terms").alias("total_terms"), F.max("unique_terms").alias("unique_terms"), F.first("_b", ignorenulls=True).alias("_b"))
    return both.select("total_terms", "unique_terms", F.transform("_b", lambda x: F.struct(x["term"].alias("term"), (-x["k"]).alias("n"))).alias("top_terms"))


def save(counts: DataFrame, path: str) -> None:
    """Counts as Parquet, totals as one JSON line, beneath a folder that all executors reach."""
    counts.write.mode("overwrite").parquet(f"{path}/term_counts")
    totals(counts.sparkSession.read.parquet(f"{path}/term_counts")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Counts, total_terms and unique_terms."""
    m = spark.read.schema("total_terms long, unique_terms long").json(f"{path}/metadata").first()
    return spark.read.parquet(f"{path}/term_counts"), m["total_terms"], m["unique_terms"]


def information_content(n: Column, total_terms: Column, unique_terms: Column) -> Column:
    """-ln of a term's share with one added to each count; a term that isn't in the store has n null or 0."""
    return -F.ln((F.coalesce(n, F.lit(0)) + 1) / (total_terms + unique_terms))


def mean_information_content(terms: DataFrame, key: str, term: str = "term", frequent: int = FREQUENT) -> DataFrame:
    """Per key n_terms and mean_ic, the mean information content of its terms, whose counts are over all rows; null is no term.

    Frequent terms, which most rows have, are looked up in a broadcast table of so many at most. The others are joined by shuffling their rows.
    terms is read three times, which takes less than writing it.
    """
    t = terms.filter(F.col(term).isNotNull()).select(key, F.col(term).alias("term"))
    c = materialise(t.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    short = F.length("term") <= LONGEST
    by_power = c.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.count_if(short).alias("short")).collect()  # 63 rows at most
    total, kinds = sum(r["n"] for r in by_power), sum(r["kinds"] for r in by_power)
    least = 0
    while sum(r["short"] for r in by_power if r["p"] >= least) > frequent:
        least += 1
    usual = short & (F.col("n") >= 2**least)
    ic = c.withColumn("ic", information_content(F.col("n"), F.lit(total).cast("long"), F.lit(kinds).cast("long")))
    most = F.broadcast(ic.filter(usual).select("term", "ic"))
    rows = t.join(most, "term").select(key, "ic")
    if sum(r["short"] for r in by_power if r["p"] >= least) < kinds:
        rows = rows.unionByName(t.join(most, "term", "left_anti").join(ic.filter(~usual).select("term", "ic"), "term").select(key, "ic"))
    return rows.groupBy(key).agg(F.count("*").alias("n_terms"), (F.sum("ic") / F.count("*")).alias("mean_ic"))


def difficult_words(words: DataFrame, easy: DataFrame, key: str, word: str, at_hand: int = AT_HAND) -> DataFrame:
    """Per key n_words and n_difficult: words that, as they are and without a final s, are not in the list `easy`.

    The list has both forms, so one join says it; the list is broadcast if it has so many characters at most, and no word is shuffled then.
    """
    known = easy.filter(F.col(word).isNotNull()).select(F.explode(F.array(F.col(word), F.concat(word, F.lit("s")))).alias(word)).distinct()
    known = materialise(known, "easy-words").withColumn("_known", F.lit(True))
    if (known.agg(F.sum(F.length(word))).first()[0] or 0) <= at_hand:
        known = F.broadcast(known)
    return words.join(known, word, "left").groupBy(key).agg(F.count("*").alias("n_words"), F.count_if(F.col("_known").isNull()).alias("n_difficult"))
