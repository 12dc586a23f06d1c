"""Texts as tables of sentences and tokens, and what is measured over tokens of some parts of speech: cosines, overlap, hypernymy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readgrain.functions.text import WORD
from readgrain.operators.sequences import consecutive_cosine, mean_pair_cosine, pair_cosines

SCOPES = ("1", "a", "1p", "ap")


def sentence_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sentences (what ., ! or ? and a blank end) by paragraph (line): key, paragraph, sentence (from 0 in the paragraph) and the sentence.

    Blank lines and sentences aren't counted. Null and empty texts give no rows. A text is exploded in its own task, nothing is shuffled.
    """
    kept = lambda xs: F.filter(xs, lambda s: F.trim(s) != "")
    p = docs.select(key, F.posexplode(kept(F.split(text, r"\n+"))).alias("paragraph", "_p"))
    return p.select(key, "paragraph", F.posexplode(kept(F.split("_p", r"(?<=[.!?])[ \t\r]+"))).alias("sentence", "text"))


def token_lists(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """The tokens of each sentence (words, and single characters that are neither words nor blank), in order: key, paragraph, sentence, tokens.

    Sentences without tokens vanish. Nothing is shuffled.
    """
    ts = F.regexp_extract_all(F.col("text"), F.lit(rf"{WORD}|[^ \t\n\f\r]"), F.lit(0))
    return sentences.select(key, "paragraph", "sentence", F.explode(F.filter(F.array(ts), lambda x: F.size(x) > 0)).alias("tokens"))


def token_table(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """The tokens of token_lists() as rows: key, paragraph, sentence, token (from 0 in the sentence), text."""
    return token_lists(sentences, key).select(key, "paragraph", "sentence", F.posexplode("tokens").alias("token", "text"))


def tokens_by_sentence(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """The token numbers of each sentence, in order."""
    return tokens.groupBy(key, "paragraph", "sentence").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def of_pos(tokens: DataFrame, tags: Sequence[str], pos: str = "upos", key: str = "doc_id") -> DataFrame:
    """Tokens of the given parts of speech; sentences without any vanish, the others of a paragraph are numbered anew."""
    by = Window.partitionBy(key, "paragraph").orderBy("sentence")
    return tokens.filter(F.col(pos).isin(list(tags))).withColumn("sentence", F.dense_rank().over(by) - 1)


def scoped_cosines(tokens: DataFrame, vector: str, order: str, key: str = "doc_id") -> DataFrame:
    """Per document the mean cosine of neighbouring tokens and of all pairs, in the document (overlap_1, overlap_a) and as means over its paragraphs
    with two tokens or more (overlap_1p, overlap_ap); 0 where there is no pair. All pairs are summed in closed form, not listed."""
    out = tokens.select(key).distinct()
    for scope, suffix in (([key], ""), ([key, "paragraph"], "p")):
        near = consecutive_cosine(tokens, scope, order, vector).groupBy(*scope).agg(F.avg("similarity").alias("_x"))
        every = mean_pair_cosine(tokens, scope, vector).select(*scope, F.col("mean_similarity").alias("_y"))
        one = near.join(every, scope).groupBy(key).agg(F.avg("_x").alias(f"overlap_1{suffix}"), F.avg("_y").alias(f"overlap_a{suffix}"))
        out = out.join(one, key, "left")
    return out.fillna(0.0, [f"overlap_{s}" for s in SCOPES])


def chunk_density_all_pairs(sentences: DataFrame, keys: Sequence[str], order: str, vector: str, percent: float = 0.75) -> DataFrame:
    """Per sequence n, n_breaks and density. A break is where a sentence and the next are less alike than the percentile of all pairs' similarities;
    the density is (breaks + 1) / sentences. The percentile needs all pairs of one document's sentences, which are listed within it."""
    n = sentences.groupBy(*keys).agg(F.count("*").alias("n"))
    s = sentences.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("_o"), vector)
    pairs = pair_cosines(s, keys, "_o", vector)
    limit = pairs.groupBy(*keys).agg(F.percentile("similarity", F.lit(percent)).alias("_limit"))
    b = pairs.filter("j - i = 1").join(limit, list(keys)).groupBy(*keys).agg(F.count_if(F.col("similarity") < F.col("_limit")).alias("n_breaks"))
    j = n.join(b, list(keys), "left").fillna(0, ["n_breaks"])
    return j.withColumn("density", F.when(F.col("n") == 1, 1.0).otherwise((F.col("n_breaks") + 1) / F.col("n")))


def hypernymy(tokens: DataFrame, senses: DataFrame, paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys the mean hypernymy of tokens (word, upos): of a word the mean over its senses (word, upos, synset) of the mean length of the sense's
    paths to a root (synset, length); 0 for a word without senses. Words are joined by their distinct forms, which are few beside the tokens."""
    per_sense = paths.groupBy("synset").agg(F.avg("length").alias("_l"))
    per_word = senses.dropDuplicates(["word", "upos", "synset"]).join(per_sense, "synset").groupBy("word", "upos").agg(F.avg("_l").alias("_h"))
    counted = tokens.groupBy(*keys, "word", "upos").agg(F.count("*").alias("_n"))  # before the join, so that a frequent word is a row per key
    j = counted.join(per_word, ["word", "upos"], "left")
    return j.groupBy(*keys).agg((F.sum(F.col("_n") * F.coalesce("_h", F.lit(0.0))) / F.sum("_n")).alias("hypernymy"))


def sense_similarity(pairs: DataFrame, senses: DataFrame, similarities: DataFrame, keys: Sequence[str], names: Sequence[str] = ("path", "lch", "wup")) -> DataFrame:
    """Per keys the means over pairs of tokens (word_a, upos_a, word_b, upos_b) of their senses' similarity: each of `names` as the mean over all pairs of
    senses that have one (0 without), and binary, 1 if they share a sense. similarities has synset_a, synset_b and `names`, in both orders.

    Distinct pairs of words are scored once.
    """
    at = ["word_a", "upos_a", "word_b", "upos_b"]
    counted = pairs.groupBy(*keys, *at).agg(F.count("*").alias("_n"))
    s = senses.dropDuplicates(["word", "upos", "synset"])
    a, b = (s.select(F.col("word").alias(f"word_{x}"), F.col("upos").alias(f"upos_{x}"), F.col("synset").alias(f"synset_{x}")) for x in "ab")
    each = counted.select(*at).distinct().join(a, ["word_a", "upos_a"]).join(b, ["word_b", "upos_b"]).join(similarities, ["synset_a", "synset_b"], "left")
    scored = each.groupBy(*at).agg(*[F.avg(c).alias(c) for c in names], F.max((F.col("synset_a") == F.col("synset_b")).cast("double")).alias("binary"))
    j = counted.join(scored, at, "left")
    mean = lambda c: (F.sum(F.col("_n") * F.coalesce(c, F.lit(0.0))) / F.sum("_n")).alias(c)
    return j.groupBy(*keys).agg(*[mean(c) for c in (*names, "binary")])


def mean_or_zero(scores: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Per keys the mean of each column under its new name, 0 where all are null."""
    return scores.groupBy(*keys).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in columns.items()])


def labels_to_ids(labels: Column, ids: dict[str, int], unknown: str = "O") -> Column:
    """Labels as numbers; one that isn't known counts as `unknown`."""
    m = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(ids[unknown])))
