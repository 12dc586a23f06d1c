"""Language ID by compression: the language whose dictionary compresses a text best.

Per language, a raw-content zstandard dictionary is made of whole labelled texts, a bounded sample of them. A whole text, lower-cased and
without digits and signs, goes block by block through a compressor per language, and the sizes are summed. The smallest sum wins; narrow
margins are marked as not reliable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readgrain.llm.common import documents, map_texts

#: Bounds of the sample of labelled rows: rows looked at per language, and bytes of whole texts that its dictionary holds.
SAMPLE_TEXTS, DICTIONARY = 256, 112 << 10
BLOCK = 1024
LEVEL = 6
#: ASCII letters stay, other ASCII bytes become blanks.
LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
#: A prediction whose runner-up is less than this share larger is not reliable.
MARGIN = 0.01
#: Up to so many languages have dictionaries of full size (each takes about 1 MB in a worker); of more, each has its part of that.
LANGUAGES = 200


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY) -> dict[str, bytes]:
    """The dictionaries: per language, whole training texts in order of a hash, as many as fit into `size` bytes, of the `texts` rows of the smallest hash; the shortest of these if none fits.

    The ranking reads doc_id and lang only and keeps `texts` rows per language and partition before any shuffle; then the chosen texts
    are fetched and lower-cased on the executors. Texts longer than a quarter of the dictionary are passed over where others are there,
    so that one text is not all of it. Every language that training rows have is learned. What reaches the driver is bounded by
    LANGUAGES * size bytes, or by one text a language where there are more languages than that has texts.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0))
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not langs:
        return {}
    texts, size = max(1, min(texts, LANGUAGES * texts // len(langs))), max(1, min(size, LANGUAGES * size // len(langs)))
    first = lambda rows, lang, *order: rows.withColumn("_r", F.row_number().over(Window.partitionBy(lang).orderBy(*order))).filter(F.col("_r") <= texts).drop("_r")
    ids = first(rows.select("lang", "doc_id"), "lang", F.md5(F.col("doc_id").cast("string")), "doc_id").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    # at most LANGUAGES * SAMPLE_TEXTS ids, or one a language; an id that many rows have gives its first `texts` rows again
    got = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    got = first(got.select("_lang", F.md5(F.col("_id").cast("string")).alias("a"), F.md5("text").alias("b"), F.regexp_replace(F.lower("text"), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " ").alias("part")), "_lang", "a", "b")
    by = Window.partitionBy("_lang")
    long = F.octet_length("part") + 1
    got = got.withColumns({"n": long, "fit": (long <= F.lit(max(1, size // 4))).cast("int")}).withColumn("upto", F.sum(F.col("n") * F.col("fit")).over(by.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    got = got.withColumns({"some": F.max("fit").over(by), "short": F.row_number().over(by.orderBy("n", "a", "b"))})
    kept = got.filter((F.col("some") == 1) & (F.col("fit") == 1) & (F.col("upto") <= size) | (F.col("some") == 0) & (F.col("short") == 1))
    parts: dict[str, list] = {}
    for lang, _, _, text in sorted(map(tuple, kept.select("_lang", "a", "b", "part").collect())):
        parts.setdefault(lang, []).append(text.encode("utf-8"))
    return {k: b"\n".join(parts[k]) for k in langs if k in parts}


def make_classifier(books: dict[str, bytes], margin: float = MARGIN) -> Callable[[str], tuple]:
    """A function from a text to (language, score, reliable)."""
    import math

    import zstandard as z

    langs = list(books)
    tools = []
    for k in langs:
        d = z.ZstdCompressionDict(books[k] or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        tools.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def each(text: str) -> tuple:
        if not langs or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        raw = b" ".join(text.lower().encode("utf-8").translate(LETTERS).split())
        sizes = [0] * len(langs)
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            for i, tool in enumerate(tools):
                sizes[i] += len(tool(block))
        best = min(range(len(langs)), key=sizes.__getitem__)
        least = sizes[best]
        others = [s for i, s in enumerate(sizes) if i != best]
        score = 1 / sum(math.exp(-50 * (s - least) / max(1, least)) for s in sizes)
        return langs[best], score, not others or min(others) - least >= margin * min(others)

    return each


def identify(docs: DataFrame, books: dict[str, bytes], columns: list[str], margin: float = MARGIN) -> DataFrame:
    """`columns` of docs, then lang_pred, score and reliable, a row per row.

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was learned. Ties go to the
    language with most training rows. Very long texts are compressed whole, a block at a time. reliable is false where the margin is narrow.
    """
    sent = docs.sparkSession.sparkContext.broadcast(books)
    return map_texts(docs, lambda: make_classifier(sent.value, margin), "lang_pred string, score double, reliable boolean", columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.withColumn("held_out", remainder(F.col("doc_id")) == 0)
    return identify(rows, learn(docs), ["doc_id", "held_out"])
