"""Scalar text functions as column expressions.

Words are runs of letters and digits of any script (with inner apostrophes), sentences are what full stops, question and exclamation marks
end, syllables are runs of Latin vowels. This is an annotator of its own; every formula below takes its counts as columns, so another annotator's counts can be put in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chat artefacts that cleaning strips.
ARTEFACTS = (
    "</assistant<|end_header_id|>",
    "<|endoftext|>",
    "<|im_end|>",
    "</assistant>",
    "<assistant>",
    "</human>",
    "<human>",
    "[AI]:",
    "[Human]:",
    "AI:",
    "Human:",
    "<|im_start|>",
    "<|assistant|>",
    "<|user|>",
    "<|eot_id|>",
    "<|startoftext|>",
    "<|sep|>",
)
#: Content that marks a mismatch, and placeholders.
MISMATCH = ("CONTENT_MISMATCH", "CONTENT MISMATCH", "[CONTENT_MISMATCH]", "content_mismatch", "content mismatch")
PLACEHOLDERS = (r"^\[.+\]$", r"^Unanswerable$", r"^No answers$", r"^[A-E]$", r"^\w{1,3}$")

WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿAEIOUYÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØŒÙÚÛÜÝŸ"
BLANK = r"[ \t\n\x0B\f\r]+"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row; within lambdas Spark would compute it again for each element."""
    return F.transform(F.array(value), f)[0]


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in s)


def collapse(t: Column) -> Column:
    """Runs of blanks become one, none at the ends."""
    return F.trim(F.regexp_replace(t, BLANK, " "))


def clean_artefacts(t: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(t, F.lit("")), "|".join(map(_quoted, ARTEFACTS)), ""))


def clean_ascii(t: Column, keep_paragraphs: bool = False) -> Column:
    """Other line ends become line feeds, characters beyond ASCII question marks; by default paragraphs collapse too."""
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"[^\x00-\x7F]", "?")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B]+", " "), r" ?\n[ \n]*", "\n")) if keep_paragraphs else collapse(t)


def is_problem(t: Column) -> Column:
    """A mismatch marker anywhere, or a placeholder, in any case; null is none."""
    return F.coalesce(t.rlike("(?i)" + "|".join([*map(_quoted, MISMATCH), *PLACEHOLDERS])), F.lit(False))


def strip_html(t: Column) -> Column:
    return collapse(F.regexp_replace(t, "<[^>]*>", " "))


def printable(t: Column) -> Column:
    return F.regexp_replace(strip_html(t), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]", "")


def n_blank_words(t: Column) -> Column:
    """Words between blanks."""
    return F.when(collapse(t) == "", 0).otherwise(F.size(F.split(collapse(t), " "))).cast("long")


def words(t: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(WORD), F.lit(0))


def count_matches(t: Column, pattern: str) -> Column:
    """Occurrences of a pattern, without an array of them."""
    t = F.coalesce(t, F.lit(""))
    return (F.length(F.regexp_replace(t, f"({pattern})", "$1\x00")) - F.length(t)).cast("long")


def with_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with n_words, n_sentences, n_letters, n_word_chars (all characters of words), n_syllables, n_poly (words of three syllables or more), n_mono and n_mini (three characters at most).

    A syllable is a run of vowels; every word has one at least. A text with words has one sentence at least.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_words", words(F.col(text)))
    rows = rows.withColumn("_syllables", F.transform("_words", lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit(f"[{VOWELS}]+")))))
    n = F.size("_words")
    return rows.withColumns(
        {
            "n_words": n.cast("long"),
            "n_sentences": F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), count_matches(t, "[.!?]+"))).cast("long"),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
            "n_word_chars": F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)).cast("long"),
            "n_syllables": F.aggregate("_syllables", F.lit(0), lambda a, x: a + x).cast("long"),
            "n_poly": F.size(F.filter("_syllables", lambda x: x >= 3)).cast("long"),
            "n_mono": F.size(F.filter("_syllables", lambda x: x == 1)).cast("long"),
            "n_mini": F.size(F.filter("_words", lambda w: F.length(w) <= 3)).cast("long"),
        }
    ).drop("_words", "_syllables")


def _guard(value: Column) -> Column:
    return F.when((F.col("n_words") == 0) | (F.col("n_sentences") == 0), 0.0).otherwise(value)


def formulas() -> dict[str, Column]:
    """Readability formulas over the columns of with_counts(); 0 for a text without words."""
    w, s = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("n_sentences"), F.lit(1)).cast("double")
    letters, chars, poly, mono, syl, mini = (F.col(c).cast("double") for c in ("n_letters", "n_word_chars", "n_poly", "n_mono", "n_syllables", "n_mini"))
    linsear = (w - poly + poly * 3) / s
    return {
        "flesch_reading_ease": _guard(206.835 - 1.015 * (w / s) - 84.6 * (syl / w)),
        "flesch_kincaid_grade": _guard(0.39 * (w / s) + 11.8 * (syl / w) - 15.59),
        "smog_index": _guard(1.043 * F.sqrt(poly * 30 / s) + 3.1291),
        "coleman_liau_index": _guard(0.0588 * (letters / w * 100) - 0.296 * (s / w * 100) - 15.8),
        "automated_readability_index": _guard(4.71 * (chars / w) + 0.5 * (w / s) - 21.43),
        "linsear_write_formula": _guard(F.when(linsear > 20, linsear / 2).otherwise(linsear / 2 - 2)),
        "gunning_fog": _guard(0.4 * (w / s + 100 * (poly / w))),
        "mcalpine_eflaw": _guard((w + mini) / s),
        "forcast": _guard(F.greatest(F.lit(0.0), 20 - mono / w * 15)),
        "avg_word_length": _guard(chars / w),
        "avg_sentence_length": _guard(w / s),
        "avg_syllables_per_word": _guard(syl / w),
        "percent_polysyllabic_words": _guard(poly / w * 100),
    }


GRADES = ("flesch_kincaid_grade", "gunning_fog", "smog_index", "coleman_liau_index", "automated_readability_index", "linsear_write_formula")


def text_standard() -> Column:
    """The most frequent of the truncated grades, the grades plus one, and the reading-ease band; of equals the first."""
    ease = F.col("flesch_reading_ease")
    band = F.when(ease >= 90, 5)
    for least, grade in ((80, 6), (70, 7), (60, 8), (50, 10), (40, 11), (30, 12)):
        band = band.when(ease >= least, grade)
    band = band.otherwise(13)
    whole = F.filter(F.array(*[F.when(F.col(g) > 0, F.floor(g).cast("int")) for g in GRADES]), lambda x: x.isNotNull())
    every = F.concat(whole, F.transform(whole, lambda x: x + 1), F.array(band))
    counted = F.transform(every, lambda x, i: F.struct(F.size(F.filter(every, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.array_max(counted)["x"].cast("double")


def dale_chall(difficult: Column, w: Column, s: Column) -> Column:
    share = difficult / F.greatest(w, F.lit(1)) * 100
    score = 0.1579 * share + 0.0496 * (w / F.greatest(s, F.lit(1)))
    return F.when((w == 0) | (s == 0), 0.0).when(share > 5, score + 3.6365).otherwise(score)


def spache(unfamiliar: Column, w: Column, s: Column) -> Column:
    return F.when((w == 0) | (s == 0), 0.0).otherwise(0.141 * (w / F.greatest(s, F.lit(1))) + 0.086 * (unfamiliar / F.greatest(w, F.lit(1)) * 100) + 0.839)


def _mtld(threshold: float, both: bool) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def score(batch):  # noqa: ANN001, ANN202
        import pyarrow as pa

        def one_way(codes):  # noqa: ANN001, ANN202
            seen, n, parts = set(), 0, 0
            for w in codes:
                n += 1
                seen.add(w)
                if len(seen) / n < threshold:
                    seen, n, parts = set(), 0, parts + 1
            return len(codes) / max(parts + (n > 0), 1) if codes else 0.0

        every = batch.values.dictionary_encode().indices  # equal words have equal codes; all of a batch's strings are held once
        out = []
        for a, b, there in zip(batch.offsets.to_pylist()[:-1], batch.offsets.to_pylist()[1:], batch.is_valid().to_pylist(), strict=True):
            part = every[a:b]
            codes = part.to_numpy(zero_copy_only=False).tolist() if not part.null_count else [-i if c is None else c for i, c in enumerate(part.to_pylist(), 1)]  # a null equals no other word
            out.append(None if not there else (one_way(codes) + one_way(codes[::-1])) / 2 if both else one_way(codes))
        return pa.array(out, "double")

    return score


def mtld_one_way(ws: Column, threshold: float = 0.72) -> Column:
    """Words per segment; a segment ends where the share of distinct words falls below the threshold, the rest counts as one more. Time grows with the words."""
    return _mtld(threshold, False)(ws)


def mtld(ws: Column, threshold: float = 0.72) -> Column:
    """The mean of both directions."""
    return _mtld(threshold, True)(ws)


def after_thinking(t: Column) -> Column:
    """What follows the last </think>."""
    return F.trim(F.substring_index(t, "</think>", -1))


def tag(t: Column, name: str) -> Column:
    """What stands between <name> and </name>, else from <name> to the next other tag or the end; null if there is no <name>."""
    full = F.regexp_extract(t, f"(?s)<{name}>(.*?)</{name}>", 1)
    open_ended = F.regexp_extract(t, f"(?s)<{name}>(.*?)(?:</?(?!{name}>)[A-Za-z_]+>|$)", 1)
    return F.when(t.rlike(f"(?s)<{name}>.*?</{name}>"), F.trim(full)).when(t.contains(f"<{name}>"), F.trim(open_ended))


def parse_response(t: Column) -> Column:
    """Level (digits only) and answer of a tagged response."""
    rest = after_thinking(t)
    level = tag(rest, "complexity_level")
    return F.struct(F.when(level.rlike("^[0-9]+$"), level.try_cast("int")).alias("complexity_level"), tag(rest, "generated_answer").alias("generated_answer"))


def parse_variants(t: Column) -> Column:
    """All variants of a response: blocks that start at <variant> and have both tags."""
    blocks = F.slice(F.split(after_thinking(t), "<variant>"), 2, 1_000_000)
    return F.filter(F.transform(blocks, lambda b: F.struct(tag(b, "complexity_level").alias("complexity_level"), tag(b, "generated_answer").alias("generated_answer"))), lambda v: v["complexity_level"].isNotNull() & v["generated_answer"].isNotNull())


#: Dimensions of a readability judgement and of a persona's judgement.
DIMENSIONS = ("vocabulary_complexity", "syntactic_complexity", "conceptual_density", "background_knowledge", "cognitive_load")
PERSONA_DIMENSIONS = ("understandability", "usefulness", "clarity", "relevance", "factuality")


def parse_judgement(t: Column, names: tuple[str, ...] = DIMENSIONS, default: float = 2.5) -> dict[str, Column]:
    """Scores by tag; from the first tag that is no whole number on, the default; and their mean."""
    rest, fine, out = after_thinking(t), F.lit(True), {}
    for n in names:
        raw = tag(rest, n)
        fine = fine & F.coalesce(raw.rlike("^[0-9]+$"), F.lit(False))
        out[n] = F.when(fine, raw.try_cast("double")).otherwise(F.lit(default))
    out["overall"] = sum(out.values(), F.lit(0.0)) / len(names)
    return out


def parse_scores(t: Column, names: tuple[str, ...] = PERSONA_DIMENSIONS) -> dict[str, Column]:
    """Scores 1 to 5 of a fenced JSON object, else of lines `name: digit`, of which the last counts."""
    bare = F.trim(F.regexp_replace(t, "```(?:json)?", ""))
    by_line = lambda n: F.element_at(F.filter(F.regexp_extract_all(bare, F.lit(f"(?i){n}[\"']?\\s*:\\s*([0-9])"), F.lit(1)), lambda x: x.between("1", "5")), -1)
    return {n: F.coalesce(F.get_json_object(bare, f"$.{n}").try_cast("int"), F.when(F.size(F.regexp_extract_all(bare, F.lit(f"(?i){n}"), F.lit(0))) > 0, by_line(n)).try_cast("int")) for n in names}


def split_sentences(t: Column, longer_than: int = 10) -> Column:
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])[ \t\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def sentence_pairs(sentences: Column) -> Column:
    """Each sentence with the next."""
    return F.when(F.size(sentences) < 2, sentences).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(sentences) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(sentences, i, 2))))


def split_paragraphs(t: Column, longer_than: int = 10) -> Column:
    return F.filter(F.split(t, F.when(t.contains("\n\n"), F.lit("\n\n")).otherwise(F.lit("\n"))), lambda s: F.length(F.trim(s)) > longer_than)


def chunks(items: Column, size: int) -> Column:
    """Groups of `size` items, joined by a blank."""
    return F.when(F.size(items) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.concat_ws(" ", F.slice(items, i * size + 1, size))))


def few_shot_prompt(question: Column, level: Column, examples: Column) -> Column:
    shown = F.concat_ws("\n\n", F.transform(examples, lambda e: F.format_string("Complexity: %d\nAnswer: %s", e["complexity"].cast("int"), e["response"])))
    return F.format_string("%s\n\nQuestion: %s\nComplexity: %d\nAnswer:", shown, question, level.cast("int"))


def context_ids(sample_id: Column, dataset: Column) -> dict[str, Column]:
    q, a = F.nullif(F.regexp_extract(sample_id, "(Q[0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(sample_id, "_(A[0-9]+)", 1), F.lit(""))
    return {"question_id": q, "answer_id": a, "context_id": F.concat_ws("_", dataset, q)}
