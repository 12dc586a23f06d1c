"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

One pass over the texts gives a few counts per document. Their shares (per mille) go into histogram sketches: a value keeps its leading
seven bits, so a sketch has a bounded number of cells, an error below 1 %, and merges by adding counts. Grouping sets build the sketches
per (language, source), per language and for all at once, by map-side counting. A group's threshold is REACH times its upper-tail
quantile TAIL. A quantile of few rows says little, so each group's is drawn towards its language's by as much as DRAW rows weigh, and the
language's likewise towards that of all; this is one formula for groups of every size. A join brings the thresholds to the documents. A
document fails where its count is above what the threshold allows by more than chance explains (Z standard errors of a count).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readgrain.llm.common import documents, map_texts, materialise

#: The tail's quantile, how far beyond it the threshold is, the weight (in rows) of the wider group, and standard errors.
TAIL, REACH, DRAW, Z = 0.95, 2.0, 50, 3.0
#: Per share: its count, and what that is counted among.
SHARES = {"symbols_pm": ("n_symbols", "word_chars"), "dup_lines_pm": ("n_dup_lines", "n_lines"), "repeats_pm": ("n_repeat_words", "n_words"), "capitals_pm": ("n_capitals", "n_letters")}
LEAST_WORDS, MOST_REPEATS_PC, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that occur twice or more, the first included. Exact: windows are numbered, not hashed."""
    import numpy as np

    n = len(words)
    ids = dict.fromkeys(words)
    if n <= width or len(ids) == n:
        return 0
    for i, w in enumerate(ids):
        ids[w] = i
    a, base = np.fromiter(map(ids.__getitem__, words), np.int64, n), len(ids)
    m = n - width + 1
    if base**width < 2**63:
        code = a[:m].copy()
        for k in range(1, width):
            code = code * base + a[k : k + m]
    else:
        code = a[:m]
        for k in range(1, width):
            code = np.unique(code * base + a[k : k + m], return_inverse=True)[1]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[back] >= 2
    if not twice.any():
        return 0
    mark = np.zeros(n, bool)
    for k in range(width):
        mark[k : k + m] |= twice
    return int(mark.sum())


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals and n_letters (ASCII) of a text."""
    raw = text.encode("utf-8")
    words = raw.split()
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), len(text) - less(b" \t\n\r\x0b\x0c"), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(CAPITALS), less(LETTERS)


def shares() -> dict[str, Column]:
    return {k: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long") for k, (a, b) in SHARES.items()}


def cell(v: Column) -> Column:
    """The sketch's cell of a value: its leading seven bits."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """Cells of rows' shares: lang, source, m (place in SHARES), v (cell) and n, with g 0 per (lang, source), 1 per lang, 3 for all.

    Sketches of parts of a table add up: those of the whole are the sums of n by all other columns.
    """
    each = F.array(*[F.struct(F.lit(i).alias("m"), cell(F.col(n)).alias("v")) for i, n in enumerate(SHARES)])
    long = rows.select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.m", "x.v")
    return long.groupingSets([["m", "v", "lang", "source"], ["m", "v", "lang"], ["m", "v"]], "m", "v", "lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


def fences(cells: DataFrame, tail: float = TAIL, reach: float = REACH, draw: int = DRAW) -> DataFrame:
    """A row per (lang, source) of sketches(): _lang, _source, and a threshold per share (max_*), per mille."""
    by = Window.partitionBy("g", "lang", "source", "m")
    run = cells.withColumns({"upto": F.sum("n").over(by.orderBy("v")), "all": F.sum("n").over(by)})
    per = run.groupBy("g", "lang", "source", "m").agg(F.max("all").alias("rows"), F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * tail), F.col("v"))).alias("q"))
    wide = per.groupBy("g", "lang", "source").agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("m") == i, F.col("q"))).cast("double").alias(n) for i, n in enumerate(SHARES)])
    wide = materialise(wide, "rules-quantiles")
    own, lang = (wide.filter(F.col("g") == g) for g in (0, 1))
    every = wide.filter(F.col("g") == 3).select(F.lit(1).alias("a"), *[F.col(n).alias(f"a_{n}") for n in SHARES])
    drawn = lambda q, wider, n: (F.col(n) * F.col(q) + draw * F.col(wider)) / (F.col(n) + draw)
    lang = lang.join(every, F.col("g") == F.col("a")).select(F.col("lang").alias("l"), *[drawn(n, f"a_{n}", "rows").alias(f"l_{n}") for n in SHARES])
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l")))
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[(reach * drawn(n, f"l_{n}", "rows")).alias(f"max_{n}") for n in SHARES])


def judge(docs: DataFrame, columns: list[str], tail: float = TAIL, reach: float = REACH, draw: int = DRAW, z: float = Z) -> DataFrame:
    """`columns` of docs, the counts of measure(), the shares, their thresholds (max_*), base_failed, and kept, a row per row.

    kept is false where base_failed holds (fewer than 10 words, or over 20 % of words in repeated windows) or a count is above its
    threshold's by more than z standard errors (of a count of mean threshold + 1). A null text has no words, so it fails. Null languages
    and sources are groups of their own. Texts are read whole, whatever their length; repeated rows count as often as they stand and get
    equal results. An empty table gives no rows. `columns` must not bear the names of the results; other columns aren't read.
    """
    keep = list(dict.fromkeys([*columns, "lang", "source"]))
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_letters long"
    counted = map_texts(docs, lambda: measure, schema, keep).withColumns(shares())
    counted = counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATS_PC))
    rows = materialise(counted, "rules-counts")
    limits = materialise(fences(materialise(sketches(rows), "rules-sketches"), tail, reach, draw), "rules-fences")
    both = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    fine = ~F.col("base_failed")
    for n, (count, among) in SHARES.items():
        allowed = F.col(f"max_{n}") / 1000 * F.col(among)
        fine = fine & (F.col(count) - allowed <= z * F.sqrt(allowed + 1))
    return both.withColumn("kept", fine).drop("_lang", "_source", *[c for c in ("lang", "source") if c not in columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), ["doc_id"])
