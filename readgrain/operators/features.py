"""Feature families over annotation tables: what follows once tokens, concepts, spans or sentence vectors are there.

tokens: doc_id, i (place), head (place of the head, own place for a root), upos, tag, dep, sentence, is_word. concepts: doc_id, term (number),
n_words, cui, semtypes (array), is_lay, is_expert, and scores or null. spans: doc_id, type, start, end, text, n_words, token (place of the
first token). sentences: doc_id, paragraph, sentence, vector. Documents without rows get zeros by a left join (fill).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readgrain.operators.sequences import consecutive_cosine, gap_index, mean_pair_cosine

#: Parts of speech of each ratio.
POS = {
    "content_ratio": ("NOUN", "ADJ", "VERB", "ADV"),
    "function_ratio": ("AUX", "ADP", "DET", "CONJ", "CCONJ", "SCONJ", "PART"),
    "noun_ratio": ("NOUN", "PROPN"),
    "adjective_ratio": ("ADJ",),
    "verb_ratio": ("VERB",),
    "adverb_ratio": ("ADV",),
    "sconj_ratio": ("SCONJ",),
    "cconj_ratio": ("CCONJ",),
    "aux_ratio": ("AUX",),
}
#: Categories of spans, their groups and difficulties.
CATEGORIES = ("medical-jargon-google-easy", "medical-jargon-google-hard", "medical-name-entity", "general-complex", "general-medical-multisense", "abbr-medical", "abbr-general")
GROUPS = {"medical": CATEGORIES[:3], "general": CATEGORIES[3:5], "abbreviation": CATEGORIES[5:]}
EASY = ("medical-jargon-google-easy", "abbr-general")
#: Part of speech to the categories of the word database.
DATABASE_POS = {"NOUN": ("N",), "PROPN": ("N",), "ADJ": ("J",), "VERB": ("V", "P"), "ADV": ("A",), "ADP": ("A", "R", "C"), "DET": ("U",), "PRON": ("U",), "CCONJ": ("C",), "INTJ": ("I",)}


def ratio(a: Column, b: Column) -> Column:
    """a / b, infinite for a over 0, 0 for 0 over 0."""
    return F.when(b != 0, a / b).when(a > 0, float("inf")).otherwise(0.0)


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def fill(metrics: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per document, zeros where metrics has none."""
    names = [c for c in metrics.columns if c != key]
    return docs.select(key).distinct().join(metrics, key, "left").fillna(0, names)


def syntax_metrics(tokens: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """The 16 syntax metrics; phrases (doc_id, n_tokens) are noun phrases."""

    @F.pandas_udf("int")
    def depth(heads):  # noqa: ANN001, ANN202
        def most(h: list) -> int:
            known: dict[int, int] = {}
            for i in range(len(h)):
                path, j = [], i
                while j not in known and h[j] != j and len(path) <= len(h):
                    path.append(j)
                    j = h[j]
                d = known.setdefault(j, 0)
                for k in reversed(path):
                    d += 1
                    known[k] = d
            return max(known.values(), default=0)

        return heads.map(lambda h: most(list(h)))

    word, far = F.col("is_word"), F.col("head") != F.col("i")
    g = tokens.groupBy("doc_id").agg(
        F.count_if(word).alias("_w"), F.count_distinct("sentence").alias("_s"), *[F.count_if(word & F.col("upos").isin(*p)).alias(f"_{k}") for k, p in POS.items()],
        F.avg(F.when(far, F.abs(F.col("i") - F.col("head")))).alias("_dist"), F.count_if(F.col("dep").isin("auxpass", "nsubjpass")).alias("_pas"), F.count_if(F.col("dep") == "neg").alias("_neg"), F.count_if(F.col("tag") == "MD").alias("_mod"),
        F.count_if(F.col("head") > F.col("i")).alias("_l"), F.count_if(F.col("head") < F.col("i")).alias("_r"), F.transform(F.array_sort(F.collect_list(F.struct("i", "head"))), lambda x: x["head"]).alias("_h"),
    )
    if phrases is not None:
        g = g.join(phrases.groupBy("doc_id").agg(F.avg("n_tokens").alias("_np")), "doc_id", "left")
    else:
        g = g.withColumn("_np", F.lit(0.0))
    some = lambda c: F.when(F.col("_w") > 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return g.select(
        "doc_id", *[some(share(F.col(f"_{k}"), F.col("_w"))).alias(k) for k in POS], some(F.col("_dist")).alias("avg_dependency_distance"), some(share(F.col("_pas"), F.col("_s"))).alias("passive_ratio"), some(share(F.col("_neg"), F.col("_s"))).alias("negation_density"),
        some(share(F.col("_mod"), F.col("_w"))).alias("modal_ratio"), some(F.col("_np")).alias("avg_np_length"), some(share(F.abs(F.col("_l") - F.col("_r")), F.col("_l") + F.col("_r"))).alias("lr_asymmetry"), some(depth("_h").cast("double")).alias("embedding_depth"),
    )


def concept_metrics(concepts: DataFrame, words: DataFrame) -> DataFrame:
    """The 19 concept metrics; words has doc_id and n_words."""
    per = concepts.groupBy("doc_id", "term").agg(F.count("*").alias("m"), F.first("n_words").alias("len"), F.bool_or("is_lay").alias("lay"), F.bool_or("is_expert").alias("expert"))
    t = per.groupBy("doc_id").agg(F.count("*").alias("_n"), F.sum("m").alias("_m"), F.avg("len").alias("avg_term_length"), F.count_if("lay").alias("_lay"), F.count_if("expert").alias("_exp"), F.count_if(F.col("expert") & ~F.col("lay")).alias("_core"))
    cui = concepts.groupBy("doc_id").agg(F.count_distinct("cui").alias("_cui"))
    by = Window.partitionBy("doc_id")
    s = concepts.select("doc_id", F.explode("semtypes").alias("s")).groupBy("doc_id", "s").agg(F.count("*").alias("c")).withColumns({"n": F.sum("c").over(by), "r": F.row_number().over(by.orderBy(F.desc("c"), "s"))})
    p = F.col("c") / F.col("n")
    s = s.groupBy("doc_id").agg(F.count("*").alias("_types"), F.sum(-p * F.log2(p)).alias("semantic_diversity"), F.sum(F.when(F.col("r") <= 3, p).otherwise(0.0)).alias("top3_semtype_concentration"))
    names = ("frequency", "context", "cui_score", "combo")
    lay = concepts.join(per.filter("lay").select("doc_id", "term"), ["doc_id", "term"], "left_semi").groupBy("doc_id").agg(*[F.avg(c).alias(f"avg_{c.removesuffix('_score')}_score") for c in names])
    x = t.join(cui, "doc_id").join(s, "doc_id", "left").join(lay, "doc_id", "left").join(words.select("doc_id", F.col("n_words").alias("_w")), "doc_id")
    per100 = lambda c: share(F.col(c) * 100, F.col("_w"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return x.select(
        "doc_id", *[per100(a).alias(f"{b}_density") for a, b in (("_n", "term"), ("_lay", "lay_term"), ("_exp", "expert_term"), ("_core", "core_expert_term"), ("_types", "semantic_type"), ("_cui", "unique_concept"))], ratio(F.col("_exp"), F.col("_lay")).alias("expert_to_lay_ratio"), zero("avg_term_length"),
        share(F.col("_n"), F.col("_cui")).alias("term_repetition"), zero("semantic_diversity"), zero("top3_semtype_concentration"), share(F.col("_m"), F.col("_n")).alias("avg_matches_per_term"), *[share(F.col(a), F.col("_n")).alias(f"{b}_term_ratio") for a, b in (("_exp", "expert"), ("_lay", "lay"), ("_core", "core_expert"))],
        *[zero(f"avg_{c.removesuffix('_score')}_score") for c in names],
    )


def span_metrics(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The 29 span metrics; docs has doc_id, n_words, n_chars and n_sentences. Documents without spans get zeros."""
    s = spans.withColumn("c", F.regexp_replace("type", "^[BI]-", ""))
    n = {c: F.count_if(F.col("c") == c) for c in CATEGORIES}
    g = s.groupBy("doc_id").agg(F.count("*").alias("jargon_count"), F.count_distinct(F.lower("text")).alias("_u"), F.sum("n_words").alias("_sw"), F.sum(F.length("text")).alias("_sc"), F.avg("n_words").alias("avg_jargon_word_length"), F.avg(F.length("text")).alias("avg_jargon_char_length"), *[v.alias(k) for k, v in n.items()])
    near = gap_index(s.filter(F.col("token").isNotNull()), ["doc_id"], "token").select("doc_id", F.col("clustering").alias("jargon_clustering_index"))
    x = docs.select("doc_id", "n_words", "n_chars", "n_sentences").join(g, "doc_id", "left").join(near, "doc_id", "left").fillna(0)
    total = lambda names: sum((F.col(f"`{c}`") for c in names), F.lit(0))
    per100 = lambda c: share(c * 100, F.col("n_words"))
    spans_n, easy, hard = F.col("jargon_count"), total(EASY), total(c for c in CATEGORIES if c not in EASY)
    med, gen, abb = (total(GROUPS[k]) for k in ("medical", "general", "abbreviation"))
    entropy = F.lit(0.0)
    for c in CATEGORIES:
        p = share(F.col(f"`{c}`"), spans_n)
        entropy = entropy + F.when(p > 0, -p * F.log2(F.greatest(p, F.lit(1e-300)))).otherwise(0.0)
    return x.select(
        "doc_id", "jargon_count", per100(spans_n).alias("jargon_density"), per100(F.col("_u")).alias("unique_jargon_density"), per100(F.col("_sw")).alias("jargon_span_word_density"), share(F.col("_sc"), F.col("n_chars")).alias("jargon_char_ratio"),
        per100(med).alias("medical_density"), per100(gen).alias("general_density"), per100(abb).alias("abbreviation_density"), *[per100(F.col(f"`{c}`")).alias(c.replace("-", "_") + "_density") for c in CATEGORIES],
        per100(easy).alias("easy_density"), per100(hard).alias("hard_density"), share(easy, spans_n).alias("easy_ratio"), share(hard, spans_n).alias("hard_ratio"), ratio(hard, easy).alias("hard_to_easy_ratio"), ratio(med, gen).alias("medical_to_general_ratio"), share(abb, spans_n).alias("abbreviation_ratio"),
        F.when(spans_n > 0, 1).otherwise(0).alias("binary_jargon_presence"), share(spans_n, F.col("n_sentences")).alias("avg_sentence_jargon_density"), "avg_jargon_word_length", "avg_jargon_char_length", share(spans_n, F.col("_u")).alias("jargon_repetition"), entropy.alias("jargon_diversity"), "jargon_clustering_index",
    )


def referential_cohesion(sentences: DataFrame) -> DataFrame:
    """PCREF_1, PCREF_a over the document; PCREF_1p, PCREF_ap as means over paragraphs (those of one sentence are left out of the first and are 0 in the second)."""
    order = sentences.withColumn("_o", F.struct("paragraph", "sentence"))
    near = lambda keys: consecutive_cosine(order, keys, "_o", "vector").groupBy(*keys).agg(F.avg("similarity").alias("v"))
    every = lambda keys: mean_pair_cosine(sentences, keys, "vector").select(*keys, F.coalesce("mean_similarity", F.lit(0.0)).alias("v"))
    doc, para = ["doc_id"], ["doc_id", "paragraph"]
    mean = lambda t: t.groupBy("doc_id").agg(F.avg("v").alias("v"))
    parts = {"PCREF_1": near(doc), "PCREF_a": every(doc), "PCREF_1p": mean(near(para)), "PCREF_ap": mean(every(para))}
    out = sentences.select("doc_id").distinct()
    for name, t in parts.items():
        out = out.join(t.select("doc_id", F.col("v").alias(name)), "doc_id", "left")
    return out.fillna(0.0)


def word_ratings(tokens: DataFrame, ratings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """tokens (doc_id, word, upos) with the ratings of the word in the category of its part of speech, else of the word in any; null ratings count 0; means per document."""
    pos = F.create_map(*[x for k, v in DATABASE_POS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    r = ratings.select(F.lower("word").alias("word"), "category", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    t = tokens.select("doc_id", F.lower("word").alias("word"), F.coalesce(F.try_element_at(pos, F.col("upos")), F.array(F.lit("O"))).alias("_cats")).groupBy("doc_id", "word", "_cats").agg(F.count("*").alias("k"))
    j = t.join(r, "word").withColumn("_fit", F.array_contains("_cats", F.col("category")))
    any_fit = F.max("_fit").over(Window.partitionBy("doc_id", "word", "_cats"))
    j = j.withColumn("_any", any_fit).filter(F.col("_fit") | ~F.col("_any"))
    return j.groupBy("doc_id").agg(*[(F.sum(F.col(c) * F.col("k")) / F.sum("k")).alias(c) for c in columns])


def label_scores(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    """Per label precision, recall and F1; 0 where nothing is there."""
    g = rows.groupBy(gold, guess).agg(F.count("*").alias("n"))
    a = g.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("gold_n"), F.sum(F.when(F.col(gold) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    b = g.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guess_n"))
    x = a.join(b, "label", "full").fillna(0, ["gold_n", "guess_n", "hit"])
    p, r = share(F.col("hit"), F.col("guess_n")), share(F.col("hit"), F.col("gold_n"))
    return x.select("label", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def entity_scores(gold: DataFrame, guess: DataFrame, keys: Sequence[str] = ("doc_id", "start", "end", "type")) -> DataFrame:
    """Micro precision, recall and F1 of spans as multisets: each gold span is matched once."""
    a = gold.groupBy(*keys).agg(F.count("*").alias("a"))
    b = guess.groupBy(*keys).agg(F.count("*").alias("b"))
    x = a.join(b, list(keys), "full").fillna(0, ["a", "b"]).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.least("a", "b")).alias("m"))
    p, r = share(F.col("m"), F.col("b")), share(F.col("m"), F.col("a"))
    return x.select(p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def normalised_index(rows: DataFrame, columns: Sequence[str], weights: dict[str, float], out: str) -> DataFrame:
    """z-scores (population deviation, 0 for a constant) of all columns and their weighted sum."""
    from readgrain.operators.stats import normalise

    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return normalise(rows, columns, "z_score").withColumn(out, total)
