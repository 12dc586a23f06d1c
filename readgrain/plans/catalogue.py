"""The registered queries over the test tables, each thin over its operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readgrain.functions import text as T
from readgrain.operators import corpus, documents, evaluate, features, learn, merge, pairs, reshape, rules, sequences, stats
from readgrain.operators import order as O
from readgrain.sources.readers import table
from readgrain.storage import materialise, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}\p{N}]+)*')"
COUNTS_SQL = rf"""
t AS (SELECT *, {WORDS_SQL} AS ws FROM documents),
u AS (SELECT *, list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(w, '[{T.VOWELS}]+')))) AS sy FROM t),
c AS (SELECT doc_id, source, lang, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[.!?]+'))) END AS BIGINT) AS n_sentences,
  CAST(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
  CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS n_word_chars,
  CAST(coalesce(list_sum(sy), 0) AS BIGINT) AS n_syllables,
  CAST(len(list_filter(sy, lambda x: x >= 3)) AS BIGINT) AS n_poly, CAST(len(list_filter(sy, lambda x: x = 1)) AS BIGINT) AS n_mono,
  CAST(len(list_filter(ws, lambda w: length(w) <= 3)) AS BIGINT) AS n_mini FROM u),
d AS (SELECT *, CAST(greatest(n_words, 1) AS DOUBLE) AS w, CAST(greatest(n_sentences, 1) AS DOUBLE) AS s, (n_words - n_poly + n_poly * 3) / CAST(greatest(n_sentences, 1) AS DOUBLE) AS lin, n_words = 0 OR n_sentences = 0 AS none FROM c),
f AS (SELECT doc_id, source, n_words, n_sentences,
  CASE WHEN none THEN 0.0 ELSE 206.835 - 1.015 * (w / s) - 84.6 * (n_syllables / w) END AS flesch_reading_ease,
  CASE WHEN none THEN 0.0 ELSE 0.39 * (w / s) + 11.8 * (n_syllables / w) - 15.59 END AS flesch_kincaid_grade,
  CASE WHEN none THEN 0.0 ELSE 1.043 * sqrt(CAST(n_poly AS DOUBLE) * 30 / s) + 3.1291 END AS smog_index,
  CASE WHEN none THEN 0.0 ELSE 0.0588 * (n_letters / w * 100) - 0.296 * (s / w * 100) - 15.8 END AS coleman_liau_index,
  CASE WHEN none THEN 0.0 ELSE 4.71 * (n_word_chars / w) + 0.5 * (w / s) - 21.43 END AS automated_readability_index,
  CASE WHEN none THEN 0.0 WHEN lin > 20 THEN lin / 2 ELSE lin / 2 - 2 END AS linsear_write_formula,
  CASE WHEN none THEN 0.0 ELSE 0.4 * (w / s + 100 * (n_poly / w)) END AS gunning_fog,
  CASE WHEN none THEN 0.0 ELSE (w + n_mini) / s END AS mcalpine_eflaw,
  CASE WHEN none THEN 0.0 ELSE greatest(0.0, 20 - n_mono / w * 15) END AS forcast,
  CASE WHEN none THEN 0.0 ELSE n_word_chars / w END AS avg_word_length,
  CASE WHEN none THEN 0.0 ELSE w / s END AS avg_sentence_length,
  CASE WHEN none THEN 0.0 ELSE n_syllables / w END AS avg_syllables_per_word,
  CASE WHEN none THEN 0.0 ELSE n_poly / w * 100 END AS percent_polysyllabic_words FROM d)"""
FORMULAS = ("flesch_reading_ease", "flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index", "linsear_write_formula", "gunning_fog", "mcalpine_eflaw", "forcast", "avg_word_length", "avg_sentence_length", "avg_syllables_per_word", "percent_polysyllabic_words")
COLLAPSE = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_counts(table(spark, sf_dir, "documents")).withColumns(T.formulas())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of all documents: formulas, z-scores, a linear score, 0 to 100, 21 quantile bins, and a summary per bin."""
    names = ["automated_readability_index", "coleman_liau_index", "flesch_kincaid_grade"]
    docs = scored_documents(spark, sf_dir).select("doc_id", *names).join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    z = stats.normalise(materialise(docs, "flagship"), names)
    score = stats.apply_formula(z, 0.0, dict.fromkeys(names, 1 / 3), {})
    hundred = stats.to_hundred(score, "score", "normalised").withColumns({"normalised": r6("normalised")})
    hundred = materialise(hundred.select("doc_id", "quality", "normalised"), "flagship-scores")
    binned = O.quantile_bins(hundred.withColumn("discretised", stats.discretise(F.col("normalised"))), "normalised")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("normalised")).alias("mean"), F.min("normalised").alias("low"), F.max("normalised").alias("high"), F.sum(F.coalesce("quality", F.lit(0))).cast("long").alias("n_good"))


QUERIES["flagship_readability_bins"] = flagship
ORACLE_SQL["flagship_readability_bins"] = f"""WITH {COUNTS_SQL},
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
m AS (SELECT avg(automated_readability_index) a1, stddev_pop(automated_readability_index) s1, avg(coleman_liau_index) a2, stddev_pop(coleman_liau_index) s2, avg(flesch_kincaid_grade) a3, stddev_pop(flesch_kincaid_grade) s3 FROM f),
z AS (SELECT doc_id, (automated_readability_index - a1) / s1 / 3 + (coleman_liau_index - a2) / s2 / 3 + (flesch_kincaid_grade - a3) / s3 / 3 AS score FROM f, m),
h AS (SELECT doc_id, round((score - (SELECT min(score) FROM z)) / (SELECT max(score) - min(score) FROM z) * 100, 6) AS x FROM z),
e AS (SELECT quantile_cont(x, [{", ".join(f"{k}/21.0" for k in range(1, 21))}]) AS edges FROM h),
b AS (SELECT h.doc_id, x, CAST(len(list_filter(edges, lambda v: v <= x)) * 5 AS INTEGER) AS bin FROM h, e)
SELECT bin, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS low, max(x) AS high, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS n_good FROM b LEFT JOIN q USING (doc_id) GROUP BY bin"""


# cleaning and parsing


def _sql_artefacts() -> str:
    def quoted(s: str) -> str:
        return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in s)

    return "|".join(map(quoted, T.ARTEFACTS))


@query(f"SELECT doc_id, {COLLAPSE.format(f'''regexp_replace(coalesce(text, ''), '{_sql_artefacts()}', '', 'g')''')} AS text FROM documents")
def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_artefacts(F.col("text")).alias("text"))


PROBLEM_SQL = r"regexp_matches(coalesce({}, ''), '(?i)CONTENT_MISMATCH|CONTENT MISMATCH|\[CONTENT_MISMATCH\]|content_mismatch|content mismatch|^\[.+\]$|^Unanswerable$|^No answers$|^[A-E]$|^\w{{1,3}}$')"


@query(f"""WITH b AS (SELECT DISTINCT source FROM documents WHERE {PROBLEM_SQL.format("text")}),
p AS (SELECT doc_id, source, {PROBLEM_SQL.format("text")} AS bad FROM documents)
SELECT source, count(*) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS n_bad, count(*) FILTER (source NOT IN (SELECT source FROM b)) AS n_kept FROM p GROUP BY source""")
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a source is a sample, and its short documents are the originals
    kept = rules.drop_problem_samples(docs, ["source"], "text", F.col("n_chars") < 8).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_kept"))
    p = docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(T.is_problem(F.col("text"))).alias("n_bad"))
    return p.join(kept, F.col("source") == F.col("s"), "left").select("source", "n", "n_bad", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query(f"SELECT page_id, {COLLAPSE.format(chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']))} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


CLEAN_ASCII_SQL = COLLAPSE.format(r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')")


@query(f"""WITH c AS (SELECT doc_id, {CLEAN_ASCII_SQL} AS text FROM documents)
SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, count(*) AS n_copies FROM c WHERE len(string_split(text, ' ')) >= 20 GROUP BY text""")
def min_words_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.clean_ascii(F.col("text")).alias("text")).filter(T.n_blank_words(F.col("text")) >= 20)
    return c.groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


NW_SQL = f"CASE WHEN {COLLAPSE.format('text')} = '' THEN 0 ELSE len(string_split({COLLAPSE.format('text')}, ' ')) END"


@query(f"""WITH w AS (SELECT CAST({NW_SQL} AS BIGINT) AS n FROM documents), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM w)
SELECT count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS total_words, round(avg(n), 6) AS avg_words, min(n) AS min_words, max(n) AS max_words, max(CASE WHEN i = c // 2 THEN n END) AS median_words,
count(*) FILTER (n < 50) AS n_short, count(*) FILTER (n BETWEEN 50 AND 200) AS n_medium, count(*) FILTER (n > 200) AS n_long FROM r""")
def corpus_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = materialise(table(spark, sf_dir, "documents").select(T.n_blank_words(F.col("text")).alias("n")), "lengths")
    one = w.agg(F.count("*").alias("n_texts"), F.sum("n").alias("total_words"), r6(F.avg("n")).alias("avg_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"), F.count_if(F.col("n") < 50).alias("n_short"), F.count_if(F.col("n").between(50, 200)).alias("n_medium"), F.count_if(F.col("n") > 200).alias("n_long"))
    return stats.with_stats(one, O.nth(w, "n", [0.5]).withColumnRenamed("v0", "median_words"))


@query(f"""WITH w AS (SELECT source, doc_id, CAST({NW_SQL} AS BIGINT) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM w)
SELECT source, max(CASE WHEN i = 0 THEN doc_id END) AS shortest, max(CASE WHEN i = c // 2 THEN n END) AS median_words, max(CASE WHEN i = c - 1 THEN doc_id END) AS longest FROM r GROUP BY source""")
def length_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = materialise(table(spark, sf_dir, "documents").select("source", "doc_id", T.n_blank_words(F.col("text")).alias("n")), "lengths")
    ends = w.groupBy("source").agg(F.min_by("doc_id", F.struct("n", "doc_id")).alias("shortest"), F.max_by("doc_id", F.struct("n", "doc_id")).alias("longest"))
    return ends.join(O.nth(w, "n", [0.5], ["source"]).withColumnRenamed("v0", "median_words"), "source")


@query(f"WITH {COUNTS_SQL} SELECT doc_id, n_words, n_sentences, n_letters, n_word_chars, n_syllables, n_poly, n_mono, n_mini FROM c")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query(f"WITH {COUNTS_SQL} SELECT doc_id, {', '.join(f'round({n}, 6) AS {n}' for n in FORMULAS)} FROM f")
def readability_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).select("doc_id", *[r6(n).alias(n) for n in FORMULAS])


@query(f"""WITH {COUNTS_SQL},
g AS (SELECT doc_id, flesch_reading_ease AS e, list_filter([{', '.join(f'CASE WHEN {g} > 0 THEN CAST(floor({g}) AS INTEGER) END' for g in T.GRADES)}], lambda x: x IS NOT NULL) AS w FROM f),
h AS (SELECT doc_id, list_concat(w, list_transform(w, lambda x: x + 1), [CASE WHEN e >= 90 THEN 5 WHEN e >= 80 THEN 6 WHEN e >= 70 THEN 7 WHEN e >= 60 THEN 8 WHEN e >= 50 THEN 10 WHEN e >= 40 THEN 11 WHEN e >= 30 THEN 12 ELSE 13 END]) AS xs FROM g),
x AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM h), y AS (SELECT doc_id, x, count(*) AS n, min(i) AS i FROM x GROUP BY doc_id, x)
SELECT doc_id, CAST(arg_max(x, n * 1000 - i) AS DOUBLE) AS text_standard FROM y GROUP BY doc_id""")
def text_standard_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).select("doc_id", T.text_standard().alias("text_standard"))


@query(f"WITH t AS (SELECT doc_id, list_transform({WORDS_SQL}, lambda w: lower(w)) AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct, round(len(list_distinct(ws)) / greatest(len(ws), 1), 6) AS ttr FROM t")
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.words(F.col("text")), F.lower).alias("ws"))
    n, k = F.size("ws"), F.size(F.array_distinct("ws"))
    return t.select("doc_id", n.cast("long").alias("n_words"), k.cast("long").alias("n_distinct"), r6(k / F.greatest(n, F.lit(1))).alias("ttr"))


SEGMENTS = """CASE WHEN len({0}) = 0 THEN 0.0 ELSE len({0}) / (SELECT greatest(1, r.parts + CASE WHEN len(r.seen) > 0 THEN 1 ELSE 0 END) FROM (SELECT list_reduce(list_transform({0}, lambda w: {{'seen': [w], 'parts': 0}}),
 lambda a, x: CASE WHEN len(list_distinct(a.seen || x.seen)) / len(a.seen || x.seen) < 0.72 THEN {{'seen': CAST([] AS VARCHAR[]), 'parts': a.parts + 1}} ELSE {{'seen': a.seen || x.seen, 'parts': a.parts}} END, {{'seen': CAST([] AS VARCHAR[]), 'parts': 0}}) AS r)) END"""


@query(f"WITH t AS (SELECT doc_id, list_transform({WORDS_SQL}, lambda w: lower(w)) AS ws FROM documents), u AS (SELECT doc_id, ws, list_reverse(ws) AS rs FROM t) SELECT doc_id, round(({SEGMENTS.format('ws')} + {SEGMENTS.format('rs')}) / 2, 6) AS mtld FROM u")
def mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.words(F.col("text")), F.lower).alias("ws"))
    return t.select("doc_id", r6(T.mtld(F.col("ws"))).alias("mtld"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_transform({WORDS_SQL}, lambda w: lower(w))) AS term FROM documents),
c AS (SELECT term, count(*) AS n FROM t GROUP BY term), s AS (SELECT sum(n) AS total, count(*) AS kinds FROM c),
i AS (SELECT term, -ln((n + 1) / CAST(total + kinds AS DOUBLE)) AS ic FROM c, s)
SELECT doc_id, count(*) AS n_terms, round(avg(ic), 6) AS mean_ic FROM t JOIN i USING (term) GROUP BY doc_id""")
def term_frequency_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information content of terms, add-one smoothed, and its mean per document; counts are over all documents."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(T.words(F.col("text")), F.lower)).alias("term"))
    return corpus.mean_information_content(t, "doc_id").withColumn("mean_ic", r6("mean_ic"))


@query(f"""WITH easy AS (SELECT DISTINCT lower(unnest({WORDS_SQL})) AS w FROM benchmark), t AS (SELECT doc_id, lower(unnest({WORDS_SQL})) AS w FROM documents)
SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER (w NOT IN (SELECT w FROM easy) AND regexp_replace(w, 's$', '') NOT IN (SELECT w FROM easy)) AS BIGINT) AS n_difficult FROM t GROUP BY doc_id""")
def difficult_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that, as they are and without a final s, are not in the word list (the benchmark's words)."""
    easy = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(T.words(F.col("text")), F.lower)).alias("w"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(T.words(F.col("text")), F.lower)).alias("w"))
    return corpus.difficult_words(t, easy, "doc_id", "w")


@query(r"""WITH b AS (SELECT page_id, '<variant><complexity_level>' || CAST(page_id % 7 AS VARCHAR) || '</complexity_level><generated_answer> ' || url || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' </generated_answer>' END AS raw FROM pages),
r AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<think>a</think><think>b</think>' || raw ELSE raw END AS raw FROM b)
SELECT page_id, CAST(page_id % 7 AS INTEGER) AS level, trim(regexp_extract(raw, '<generated_answer>([^<]*)', 1)) AS answer FROM r""")
def tag_parse_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<variant><complexity_level>"), (F.col("page_id") % 7).cast("string"), F.lit("</complexity_level><generated_answer> "), F.col("url"), F.when(F.col("page_id") % 3 == 0, "").otherwise(" </generated_answer>"))
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<think>a</think><think>b</think>"), raw)).otherwise(raw)
    p = table(spark, sf_dir, "pages").select("page_id", T.parse_response(raw).alias("p"))
    return p.select("page_id", F.col("p.complexity_level").alias("level"), F.col("p.generated_answer").alias("answer"))


# reshaping, joins, keys


@query("""WITH c AS (SELECT event_type, event_id % 7 AS k, count(*) AS c FROM events GROUP BY ALL), n AS (SELECT *, sum(c) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, k) AS r FROM c)
SELECT event_type, CAST(max(n) AS BIGINT) AS n, count(*) AS n_categories, round(sum(-(c / n) * log2(c / n)), 6) AS entropy, round(sum(CASE WHEN r <= 3 THEN c / n ELSE 0.0 END), 6) AS top3 FROM n GROUP BY event_type""")
def class_entropy_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7).alias("k"))
    return stats.entropy_top3(e, "event_type", "k").withColumns({"entropy": r6("entropy"), "top3": r6("top3")})


@query("""WITH o AS (SELECT conv_id, arg_max(text, turn) AS original_text FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT v.conv_id, v.turn, CAST(length(v.text) AS INTEGER) AS n_variant, CAST(length(original_text) AS INTEGER) AS n_original FROM conversations v JOIN o USING (conv_id) WHERE role = 'assistant'""")
def variant_original_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    j = reshape.variants_with_originals(c.filter("role = 'assistant'"), c.filter("role = 'user'"), ["conv_id"], "turn", ["text"])
    return j.select("conv_id", "turn", F.length("text").alias("n_variant"), F.length("original_text").alias("n_original"))


@query("""WITH p AS (SELECT role AS question, text AS answer, min(conv_id * 1000 + turn) AS pos FROM conversations GROUP BY role, text),
q AS (SELECT question, min(pos) AS f FROM p GROUP BY question), n AS (SELECT question, row_number() OVER (ORDER BY f) AS q FROM q)
SELECT 'Q' || q || '_A' || row_number() OVER (PARTITION BY q ORDER BY pos) AS sample_id, question, md5(answer) AS answer FROM p JOIN n USING (question)""")
def qa_id_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return reshape.qa_ids(c, "role", "text", "pos").select("sample_id", F.col("role").alias("question"), F.md5("text").alias("answer"))


@query("""WITH g AS (SELECT conv_id, role, count(*) AS k FROM conversations GROUP BY conv_id, role)
SELECT conv_id, count(*) AS n_groups, CAST(sum(k) AS BIGINT) AS n_leaves, string_agg(role || ':' || k, ',' ORDER BY role) AS shape FROM g GROUP BY conv_id""")
def tree_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reshape.rebuild(table(spark, sf_dir, "conversations"), ["conv_id"], ["role"], ["turn", "text"])
    sizes = F.transform("generations", lambda g: F.size(g["variants"]))
    return t.select("conv_id", F.size("generations").cast("long").alias("n_groups"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long").alias("n_leaves"), F.array_join(F.transform("generations", lambda g: F.concat_ws(":", g["role"], F.size(g["variants"]).cast("string"))), ",").alias("shape"))


@query("""WITH p AS (SELECT user_id, event_type AS judge, avg(value) AS v FROM events WHERE NOT regexp_matches(event_type, '^p') GROUP BY user_id, event_type)
SELECT user_id, count(*) AS n_judges, round(avg(v), 6) AS average FROM p GROUP BY user_id HAVING count(*) > 1""")
def judge_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.judge_average(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "^p").withColumn("average", r6("average"))


@query("SELECT event_id, 'k' AS metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL")
def json_metric_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.metrics_long(table(spark, sf_dir, "events"), ["event_id"], "props")


KINDS = ("click", "view", "purchase", "signup", "error", "login", "logout", "search")


@query("SELECT user_id, " + ", ".join(f"round(avg(CASE WHEN event_type = '{k}' THEN value END), 6) AS \"{k}\"" for k in KINDS) + " FROM events GROUP BY user_id")
def metric_pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("metric"), "value")
    wide = reshape.metrics_wide(long, ["user_id"], KINDS)
    return wide.select("user_id", *[r6(k).alias(k) for k in KINDS])


@query("""SELECT conv_id, turn, level FROM conversations, (SELECT unnest(range(0, 101, 5)) AS level) WHERE role = 'user'""")
def complexity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn")
    return reshape.grid(c, F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"), F.lit(5).cast("long")), "level")


@query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1000), p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 5")
def nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.nearest(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", F.lit(1000), 5, "p_partkey").select("p_brand", "p_partkey", "rank")


@query("""SELECT conv_id, turn, CAST(length(text) % 5 + 1 AS INTEGER) AS low_clarity, CAST((length(text) + 1) % 5 + 1 AS INTEGER) AS medium_clarity, CAST((length(text) + 2) % 5 + 1 AS INTEGER) AS high_clarity FROM conversations""")
def persona_fanout_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn to three personas, a judge's text for each, parsed and brought back as columns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    f = reshape.grid(c, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("persona")) for i, p in enumerate(("low", "medium", "high"))]), "x")
    said = F.format_string("Clarity : 9 and clarity: %d", ((F.col("n") + F.col("x.i")) % 5 + 1).cast("int"))
    f = f.select("conv_id", "turn", "x.persona", T.parse_scores(said)["clarity"].alias("clarity"))
    return f.groupBy("conv_id", "turn").agg(*[F.max(F.when(F.col("persona") == p, F.col("clarity"))).alias(f"{p}_clarity") for p in ("low", "medium", "high")])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.resume(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT conv_id, turn, CASE WHEN CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 6) AS BIGINT) < 3355443 THEN 'test' ELSE 'train' END AS split FROM conversations")
def context_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.split_by_group(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", 0.2)


@query("SELECT w[i] AS first, w[i + 1] AS second, count(*) AS n FROM (SELECT string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')))) AS i FROM part) GROUP BY 1, 2")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.bigram_counts(table(spark, sf_dir, "part"), F.split("p_name", " "))


# numeric metrics

ORDERS = "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x, o_orderpriority AS g FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"), F.col("o_orderpriority").alias("g"))


LINES = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"), F.col("l_discount").cast("double").alias("c"))


@query(f"""WITH t AS ({LINES}), r AS (SELECT *, CASE WHEN a = 1 THEN CAST('inf' AS DOUBLE) WHEN a = 2 THEN CAST('-inf' AS DOUBLE) ELSE b / a END AS v FROM t)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a = 1 THEN (SELECT max(v) FROM r WHERE a > 2) WHEN a = 2 THEN (SELECT min(v) FROM r WHERE a > 2) ELSE v END, 6) AS v FROM r""")
def infinity_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("a") == 1, float("inf")).when(F.col("a") == 2, float("-inf")).otherwise(F.col("b") / F.col("a"))
    return stats.repair_infinity(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", v.alias("v")), ["v"]).withColumn("v", r6("v"))


@query("""SELECT d.doc_id, round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM documents JOIN labels USING (doc_id))), 6) AS quality FROM documents d LEFT JOIN labels USING (doc_id)""")
def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")
    return stats.impute_mean(d, ["quality"]).withColumn("quality", r6("quality"))


def _normalised(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.normalise(_lines(spark, sf_dir), ["a", "b", "c"], how).withColumns({c: r6(c) for c in "abc"})

    return run


for _how, _name, _c, _s in (("z_score", "normalize_zscore", "avg({0})", "stddev_pop({0})"), ("min_max", "normalize_minmax", "min({0})", "max({0}) - min({0})"), ("robust", "normalize_robust", "quantile_cont({0}, 0.5)", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)")):
    QUERIES[_name] = _normalised(_how)
    ORACLE_SQL[_name] = f"WITH t AS ({LINES}), s AS (SELECT {', '.join(f'{_c.format(c)} AS {c}_c, {_s.format(c)} AS {c}_s' for c in 'abc')} FROM t) SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - {c}_c) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 6) AS {c}' for c in 'abc')} FROM t, s"


@query(f"WITH t AS ({ORDERS}) SELECT o_orderkey, round((rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(*) OVER () * 100, 6) AS percentile FROM t")
def score_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.percentile_ranks(_orders(spark, sf_dir), "x").select("o_orderkey", r6("percentile").alias("percentile"))


HUNDRED = f"WITH t AS ({ORDERS}), h AS (SELECT *, round((x - (SELECT min(x) FROM t)) / (SELECT max(x) - min(x) FROM t) * 100, 6) AS y FROM t)"


def _hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.to_hundred(_orders(spark, sf_dir), "x", "y").withColumn("y", r6("y"))


@query(f"{HUNDRED} SELECT o_orderkey, y AS normalised, CAST(round_even(y / 5, 0) * 5 AS DOUBLE) AS discretised FROM h")
def score_discretize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hundred(spark, sf_dir).select("o_orderkey", F.col("y").alias("normalised"), stats.discretise(F.col("y")).alias("discretised"))


EDGES = "[" + ", ".join(f"{k}/21.0" for k in range(1, 21)) + "]"
BINS = f"e AS (SELECT quantile_cont(x, {EDGES}) AS edges FROM t), b AS (SELECT t.*, CAST(len(list_filter(edges, lambda v: v <= x)) * 5 AS INTEGER) AS bin FROM t, e)"


@query(f"WITH t AS ({ORDERS}), {BINS} SELECT o_orderkey, bin FROM b")
def score_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.quantile_bins(_orders(spark, sf_dir), "x").select("o_orderkey", "bin")


@query(f"WITH t AS ({ORDERS}), e AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS edges FROM t) SELECT o_orderkey, CAST(len(list_filter(edges, lambda v: v < x)) AS INTEGER) AS bin FROM t, e")
def score_quantile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.quantile_cut(_orders(spark, sf_dir), "x").select("o_orderkey", "bin")


def _decimals(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(f"WITH t AS ({ORDERS}) SELECT g, count(x) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3 FROM t GROUP BY g")
def bin_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.bin_statistics(_orders(spark, sf_dir), "g", "x"))


@query(f"""WITH t AS ({ORDERS}), m AS (SELECT g, count(x) AS n, avg(x) AS u, var_samp(x) AS v FROM t GROUP BY g),
l AS (SELECT *, lead(g) OVER w AS g2, lead(n) OVER w AS n2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM m WINDOW w AS (ORDER BY g))
SELECT g AS bin, g2 AS next_bin, round(u2 - u, 4) AS mean_difference, round((u - u2) / sqrt(v / n + v2 / n2), 6) AS t, round(pow(v / n + v2 / n2, 2) / (pow(v / n, 2) / (n - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM l WHERE g2 IS NOT NULL""")
def bin_adjacent_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stats.adjacent_welch(_orders(spark, sf_dir), "g", "x")
    return w.select("bin", "next_bin", F.round("mean_difference", 4).alias("mean_difference"), r6("t").alias("t"), F.round("df", 4).alias("df"))


@query(f"""WITH t AS ({ORDERS}), m AS (SELECT g, count(x) AS n, avg(x) AS u, var_samp(x) AS v FROM t GROUP BY g)
SELECT count(*) - 1 AS df_between, CAST(sum(n) AS BIGINT) - count(*) AS df_within, round((sum(n * pow(u - (SELECT avg(x) FROM t), 2)) / (count(*) - 1)) / (sum(v * (n - 1)) / (sum(n) - count(*))), 6) AS f FROM m""")
def bin_anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.anova(_orders(spark, sf_dir), "g", "x"))


@query("""SELECT CAST(grouping(o_orderpriority) AS INTEGER) AS g1, CAST(grouping(o_orderstatus) AS INTEGER) AS g2, CAST(grouping(c_mktsegment) AS INTEGER) AS g3, o_orderpriority, o_orderstatus, c_mktsegment, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (c_mktsegment))""")
def group_statistics_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = ["o_orderpriority", "o_orderstatus", "c_mktsegment"]
    return o.groupingSets([[c] for c in k], *k).agg(*[F.grouping(c).cast("int").alias(f"g{i + 1}") for i, c in enumerate(k)], F.count("*").alias("n"), F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("mean"))


#: Thresholds of the test query: closed ranges with gaps between them.
RANGES = [(5 * i, 20000.0 * i, 20000.0 * i + 19000.0) for i in range(21)]


@query(f"WITH t AS ({ORDERS}), r(bin, lo, hi) AS (VALUES {', '.join(f'({b}, {x!r}, {y!r})' for b, x, y in RANGES)}) SELECT o_orderkey, CAST(min(bin) AS INTEGER) AS bin FROM t LEFT JOIN r ON x BETWEEN lo AND hi GROUP BY o_orderkey")
def threshold_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    th = spark.createDataFrame(RANGES, "bin int, raw_min double, raw_max double")
    return reshape.bin_by_thresholds(_orders(spark, sf_dir), th, "x").select("o_orderkey", "bin")


@query("""WITH t AS (SELECT l_returnflag AS g, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) * 1500 AS p FROM lineitem)
SELECT g, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(corr(y, p), 6) AS corr, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM t GROUP BY g HAVING count(*) > 1""")
def model_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity").cast("double") * 1500).alias("p"))
    return stats.error_metrics(t, "g", "y", "p").select("g", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), r6("corr").alias("corr"), r6("r2").alias("r2"))


LABELLED = r"""l AS (SELECT quality AS y, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(length(regexp_replace(text, '[^.]+', '', 'g')) AS DOUBLE) AS n_stops FROM documents d JOIN labels USING (doc_id)),
long AS (SELECT y, 'n_chars' AS metric, n_chars AS v FROM l UNION ALL SELECT y, 'n_stops', n_stops FROM l)"""
METRICS = ["n_chars", "n_stops"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return materialise(d.select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", "[^.]+", "")).cast("double").alias("n_stops")), "labelled")


@query(f"""WITH {LABELLED}, m AS (SELECT metric, y, count(*) AS n, avg(v) AS u, var_samp(v) AS s FROM long GROUP BY metric, y)
SELECT a.metric, a.n AS n0, b.n AS n1, round((a.u - b.u) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS d FROM m a JOIN m b ON a.metric = b.metric AND a.y = 0 AND b.y = 1""")
def cohens_d_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.cohens_d(_labelled(spark, sf_dir), "y", METRICS))


@query(f"""WITH {LABELLED}, r AS (SELECT metric, y, v, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM long),
s AS (SELECT metric, sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS diff FROM r GROUP BY metric),
a AS (SELECT *, (s - p * (p + 1) / 2.0) / (p * q) AS auc FROM s) SELECT metric, round(auc, 6) AS auc, round(CASE WHEN diff < 0 THEN 1 - auc ELSE auc END, 6) AS auc_directed FROM a""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.auc(_labelled(spark, sf_dir), "y", METRICS))


@query("""WITH p AS (SELECT l_orderkey, avg(l_extendedprice) FILTER (l_returnflag = 'N') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS total_pairs, count(*) FILTER (b > a) AS correct_pairs, count(*) FILTER (b = a) AS tied_pairs, round(100.0 * count(*) FILTER (b > a) / count(*), 6) AS pairwise_accuracy FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.pairwise_accuracy(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_extendedprice", "N", "R"))


@query("""WITH j AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT unnest(['lang', 'source', 'quality', 'toxic']) AS "column", unnest([count(*) - count(lang), count(*) - count(source), count(*) - count(quality), count(*) - count(toxic)]) AS n_missing, count(*) AS n_rows FROM j)
SELECT "column", n_rows, n_missing, round(100.0 * n_missing / n_rows, 6) AS percent_missing FROM r""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return _decimals(stats.missing_report(j, ["lang", "source", "quality", "toxic"]))


@query(f"""WITH {LABELLED}, m AS (SELECT metric, y, CAST(count(*) AS DOUBLE) AS n, avg(v) AS u, var_pop(v) AS s FROM long GROUP BY metric, y),
c AS (SELECT metric, y, n, avg(pow(v - u, 3)) / pow(s, 1.5) AS g, avg(pow(v - u, 4)) / pow(s, 2) AS k FROM long JOIN m USING (metric, y) GROUP BY metric, y, n, u, s),
a AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS t, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM c),
d AS (SELECT *, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS h FROM a),
e AS (SELECT *, 1 + (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) * sqrt(2 / (h - 4)) AS f FROM d),
z AS (SELECT metric, y, n, pow(asinh(t / sqrt(2 / (w - 1))) / sqrt(0.5 * ln(w)), 2) + pow((1 - 2 / (9 * h) - sign(f) * cbrt((1 - 2 / h) / abs(f))) / sqrt(2 / (9 * h)), 2) AS k2 FROM e)
SELECT metric, y, CAST(n AS BIGINT) AS n, round(k2, 4) AS k2, round(exp(-k2 / 2), 6) AS p_normal FROM z WHERE y IS NOT NULL""")
def normality_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = stats.long_form(_labelled(spark, sf_dir).filter("y IS NOT NULL"), ["y"], METRICS)
    return stats.normality(long, ["metric", "y"]).select("metric", "y", "n", F.round("k2", 4).alias("k2"), F.round("p_normal", 6).alias("p_normal"))


@query(f"""WITH {LABELLED}, r AS (SELECT metric, y, v, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM long),
s AS (SELECT metric, sum(r) FILTER (y = 0) AS s, count(*) FILTER (y = 0) AS p FROM r GROUP BY metric) SELECT metric, round(s - p * (p + 1) / 2.0, 4) AS statistic, 'mann_whitney_u' AS test_name FROM s""")
def two_sample_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of texts are far from normal, so the rank test is what is chosen here; tests/ has the other branch."""
    return stats.two_sample_test(_labelled(spark, sf_dir), "y", METRICS).withColumn("statistic", F.round("statistic", 4))


@query(f"""WITH {LABELLED}, e AS (SELECT metric, min(v) AS a, (max(v) - min(v)) / 100 AS w, count(*) AS n FROM long GROUP BY metric),
c AS (SELECT metric, n, y, least(floor((v - a) / w), 99) AS c, count(*) AS k FROM long JOIN e USING (metric) GROUP BY ALL),
s AS (SELECT *, sum(k) OVER (PARTITION BY metric, c) AS kc, sum(k) OVER (PARTITION BY metric, y) AS ky FROM c) SELECT metric, round(sum(k / n * ln(k * n / (kc * ky))), 6) AS mutual_information FROM s GROUP BY metric""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.mutual_information(_labelled(spark, sf_dir), "y", METRICS))


@query(f"""WITH {LABELLED}, v AS (SELECT n_chars AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM l GROUP BY n_chars),
c AS (SELECT threshold, sum(p) OVER w / sum(p) OVER () - sum(q) OVER w / sum(q) OVER () AS j FROM v WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, round(j, 6) AS j FROM c ORDER BY round(j, 12) DESC, threshold DESC LIMIT 1""")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.youden(_labelled(spark, sf_dir), "y", "n_chars"))


HISTOGRAMS = f"""{LABELLED}, g AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM long GROUP BY metric), k AS (SELECT unnest(range(100)) AS bin),
h AS (SELECT long.metric, y, least(floor((v - lo) / ((hi - lo) / 100)), 99) AS bin, count(*) AS c FROM long JOIN g ON long.metric = g.metric GROUP BY ALL),
n AS (SELECT metric, y, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY metric, y),
p AS (SELECT g.metric, k.bin, (hi - lo) / 100 AS w, coalesce(a.c, 0) / na.n AS p0, coalesce(b.c, 0) / nb.n AS p1 FROM g CROSS JOIN k LEFT JOIN h a ON a.metric = g.metric AND a.bin = k.bin AND a.y = 0 LEFT JOIN h b ON b.metric = g.metric AND b.bin = k.bin AND b.y = 1
 JOIN n na ON na.metric = g.metric AND na.y = 0 JOIN n nb ON nb.metric = g.metric AND nb.y = 1)"""


@query(f"WITH {HISTOGRAMS} SELECT metric, round(least(1.0, sum(least(p0, p1))), 6) AS overlap FROM p GROUP BY metric")
def histogram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.divergences(_labelled(spark, sf_dir), "y", METRICS).select("metric", "overlap"))


@query(f"""WITH {HISTOGRAMS}, d AS (SELECT metric, p0 / w + 1e-10 AS a, p1 / w + 1e-10 AS b FROM p), s AS (SELECT metric, a / sum(a) OVER (PARTITION BY metric) AS a, b / sum(b) OVER (PARTITION BY metric) AS b FROM d)
SELECT metric, round(sum(a * ln(a / b)), 6) AS kl, round((sum(a * ln(2 * a / (a + b))) + sum(b * ln(2 * b / (a + b)))) / 2, 6) AS js FROM s GROUP BY metric""")
def kl_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.divergences(_labelled(spark, sf_dir), "y", METRICS).select("metric", "kl", "js"))


@query(f"""WITH t AS ({ORDERS}), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM t), o AS (SELECT g, CASE WHEN x < a - 0.5 * (b - a) OR x > b + 0.5 * (b - a) THEN 1 ELSE 0 END AS o FROM t, q)
SELECT g, CAST(grouping(g) AS INTEGER) AS is_total, count(*) AS n, CAST(sum(o) AS BIGINT) AS n_outliers, round(sum(o) * 100.0 / count(*), 6) AS percent FROM o GROUP BY GROUPING SETS ((g), ())""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.iqr_outliers(_orders(spark, sf_dir), "x", "g", 0.5).withColumn("is_total", F.col("is_total").cast("int")))


@query(f"WITH t AS ({LINES}) SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS corr FROM t UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM t UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM t")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(stats.correlations(_lines(spark, sf_dir), ["a", "b", "c"]))


@query(f"WITH t AS ({LINES}) SELECT l_orderkey, l_linenumber, round(0.123 + (a - 25) / 10 * 2 + (c - 0.05) / 0.02 * -1.5, 6) AS score FROM t")
def formula_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.apply_formula(_lines(spark, sf_dir), 0.123, {"a": 2.0, "c": -1.5}, {"a": (25.0, 10.0), "c": (0.05, 0.02)})
    return s.select("l_orderkey", "l_linenumber", r6("score").alias("score"))


# rules

RULES_JSON = """[{"name": "large", "logic": "AND", "filter_if_pass": false, "conditions": [{"metric": "x", "operator": ">=", "threshold": 50000},
 {"group": {"logic": "OR", "conditions": [{"metric": "x", "operator": "<", "threshold": 300000}, {"metric": "k", "operator": "==", "threshold": 0}]}}]}]"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).withColumn("k", (F.col("o_orderkey") % 3).cast("double"))


@query(f"WITH t AS ({ORDERS}) SELECT o_orderkey FROM t WHERE x >= 50000 AND (x < 300000 OR o_orderkey % 3 = 0)")
def rule_dsl_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.passing(_ruled(spark, sf_dir), rules.load_rules(RULES_JSON)).select("o_orderkey")


@query(f"WITH t AS ({ORDERS}) SELECT o_orderkey, 'odd' AS reason FROM t WHERE x > 100000 OR o_orderkey % 3 <> 0")
def rule_dsl_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.Rule("odd", filter_if_pass=True).check("x").above(100000).or_().check("k").not_equal_to(0)
    return rules.evaluate(_ruled(spark, sf_dir), [rule]).filter(F.size("reasons") > 0).select("o_orderkey", F.col("reasons")[0].alias("reason"))


@query(f"""WITH t AS ({ORDERS}) SELECT 'large' AS rule, count(*) AS initial, count(*) FILTER (NOT (x >= 50000 AND (x < 300000 OR o_orderkey % 3 = 0))) AS removed, count(*) FILTER (x >= 50000 AND (x < 300000 OR o_orderkey % 3 = 0)) AS kept FROM t
UNION ALL SELECT 'missing', count(*), count(*), 0 FROM t""")
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(_ruled(spark, sf_dir), [*rules.load_rules(RULES_JSON), rules.Rule("missing").check("no such metric").at_least(0)])


# sequences and vectors

TAGS = "CASE WHEN event_type IN ('click', 'view') THEN 'O' ELSE CASE WHEN event_id % 2 = 0 THEN 'B-' ELSE 'I-' END || event_type END"


@query(f"""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, {TAGS} AS t FROM events),
k AS (SELECT *, CASE WHEN t <> 'O' THEN substr(t, 3) END AS k FROM t), l AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY p) AS lk FROM k),
o AS (SELECT *, CASE WHEN k IS NOT NULL AND (t LIKE 'B-%' OR lk IS NULL OR lk <> k) THEN 1 ELSE 0 END AS o FROM l), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY p) AS id FROM o),
s AS (SELECT user_id, id, min(k) AS type, min(p) AS a, max(p) + 1 AS b FROM g WHERE k IS NOT NULL GROUP BY user_id, id),
n AS (SELECT *, CASE WHEN lag(type) OVER w = type AND a - lag(b) OVER w <= 1 THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a)), m AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a) AS mid FROM n)
SELECT user_id, min(type) AS type, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS "end", count(*) AS n_merged FROM m GROUP BY user_id, mid""")
def bio_span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(TAGS).alias("tag"))
    return sequences.merge_spans(sequences.bio_spans(e, ["user_id"], "event_id", "tag"), ["user_id"]).select("user_id", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n_merged")


@query(f"""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, {TAGS} AS t FROM events),
k AS (SELECT *, CASE WHEN t <> 'O' THEN substr(t, 3) END AS k FROM t), l AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY p) AS lk FROM k)
SELECT user_id, CAST(p AS INTEGER) AS position, CASE WHEN k IS NULL THEN 'O' WHEN t LIKE 'B-%' OR lk IS NULL OR lk <> k THEN 'B-' || k ELSE 'I-' || k END AS tag FROM l""")
def tags_from_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags to spans and back: what comes out are the tags, made well-formed."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(TAGS).alias("tag"))
    spans = sequences.bio_spans(e, ["user_id"], "event_id", "tag")
    by = Window.partitionBy("user_id").orderBy("event_id")
    places = e.select("user_id", (F.row_number().over(by) - 1).alias("position"))
    return sequences.spans_to_tags(places, spans, ["user_id"], "position")


@query(f"""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, {TAGS} AS t FROM events),
s AS (SELECT user_id, p, substr(t, 3) AS k, substr(t, 1, 1) = 'B' AS b FROM t WHERE t <> 'O'), n AS (SELECT count(*) AS a, count(*) FILTER (b) AS m FROM s)
SELECT 1.0 AS precision, round(m / a, 6) AS recall, round(2.0 * m / (a + m), 6) AS f1 FROM n""")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all tagged events as spans of one token, those that only a B- tag would give."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(TAGS).alias("tag")).filter("tag <> 'O'")
    s = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), F.substring("tag", 3, 100).alias("type"), "tag")
    return _decimals(features.entity_scores(s, s.filter("tag LIKE 'B-%'")))


@query("""WITH g AS (SELECT quality AS gold, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS guess, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
l AS (SELECT DISTINCT gold AS label FROM g UNION SELECT DISTINCT guess FROM g), x AS (SELECT label, (SELECT sum(n) FROM g WHERE gold = label) AS a, (SELECT sum(n) FROM g WHERE guess = label) AS b, coalesce((SELECT sum(n) FROM g WHERE gold = label AND guess = label), 0) AS h FROM l)
SELECT label, round(h / b, 6) AS precision, round(h / a, 6) AS recall, round(2 * h / (a + b), 6) AS f1 FROM x""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").cast("int").alias("gold"), F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("guess"))
    return _decimals(features.label_scores(d, "gold", "guess"), "label")


COS = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"


@query(f"""WITH n AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round({COS.format('a', 'b')} / sqrt({COS.format('a', 'a')}) / sqrt({COS.format('b', 'b')}), 6) AS similarity FROM n""")
def consecutive_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.consecutive_cosine(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding").withColumn("similarity", r6("similarity"))


@query(f"""WITH n AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), u AS (SELECT label, vec_id, list_transform(a, lambda x: x / sqrt({COS.format('a', 'a')})) AS a FROM n)
SELECT p.label, any_value(c) AS n, round(avg({COS.format('p.a', 'q.a')}), 6) AS mean_similarity FROM u p JOIN u q ON p.label = q.label AND p.vec_id < q.vec_id JOIN (SELECT label, count(*) AS c FROM u GROUP BY label) k ON k.label = p.label GROUP BY p.label""")
def all_pairs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.mean_pair_cosine(table(spark, sf_dir, "embeddings"), ["label"], "embedding").filter("n > 1").withColumn("mean_similarity", r6("mean_similarity"))


@query("""WITH s AS (SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM events)
SELECT user_id, event_id, v AS smoothed FROM s""")
def breakpoint_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sequences.breakpoints(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")
    return b.select("user_id", "event_id", r6("smoothed").alias("smoothed"))


BREAKS = "WITH s AS (SELECT user_id, event_id % 8 AS v, event_id FROM events), q AS (SELECT user_id, v, quantile_cont(v, 0.75) OVER (PARTITION BY user_id) AS q FROM s)"


@query(f"{BREAKS} SELECT user_id, count(*) AS n, count(*) FILTER (v < q) AS n_breaks, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE (count(*) FILTER (v < q) + 1) / count(*) END, 6) AS density FROM q GROUP BY user_id")
def chunk_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 8).alias("v"))
    b = sequences.breakpoints(e, ["user_id"], "event_id", "v", around=0)
    g = b.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("is_break").alias("n_breaks"))
    return g.withColumn("density", r6(sequences.chunk_density(F.col("n_breaks"), F.col("n"))))


@query("""WITH g AS (SELECT user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS g FROM events)
SELECT user_id, count(*) AS n, round(avg(g), 6) AS mean_gap, round(coalesce(1 / (1 + avg(g)), 0.0), 6) AS clustering FROM g GROUP BY user_id""")
def span_clustering_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(sequences.gap_index(table(spark, sf_dir, "events"), ["user_id"], "event_id"))


@query("""WITH r AS (SELECT l_orderkey, CAST(l_discount AS DOUBLE) + 0.01 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_discount AS DOUBLE) + 0.01 DESC, l_linenumber) AS r FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, sum(p / sqrt(r)) / count(*) AS w FROM r GROUP BY l_orderkey)
SELECT l_orderkey, n, round(w, 6) AS weighted, round(CASE WHEN w > 0 THEN -ln(w) ELSE 0.0 END, 6) AS score FROM g""")
def ranked_mean_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") + 0.01).alias("p"))
    return _decimals(sequences.ranked_mean_weight(p, ["l_orderkey"], "p", "l_linenumber"))


# pair scores

PAIR = "SELECT a.conv_id, a.turn, {0} AS g, {1} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1"
TOK = "list_filter(regexp_split_to_array(lower({0}.text), '[^a-z0-9]+'), lambda w: w <> '')"


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("generated")).join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference")), ["conv_id", "turn"])


def _rouge_sql(n: int) -> str:
    gram = "t" if n == 1 else "list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"""WITH p AS ({PAIR.format(TOK.format('a'), TOK.format('b'))}), x AS (SELECT conv_id, turn, list_transform([g, r], lambda t: {gram}) AS xs FROM p),
 g AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(xs[1]) AS w FROM x) GROUP BY ALL), r AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(xs[2]) AS w FROM x) GROUP BY ALL),
 m AS (SELECT conv_id, turn, sum(least(g.c, r.c)) AS m FROM g JOIN r USING (conv_id, turn, w) GROUP BY ALL),
 s AS (SELECT conv_id, turn, coalesce(m / nullif(len(xs[1]), 0), 0.0) AS p, coalesce(m / nullif(len(xs[2]), 0), 0.0) AS r FROM x LEFT JOIN m USING (conv_id, turn))
 SELECT conv_id, turn, round(p, 6) AS rouge{n}_p, round(r, 6) AS rouge{n}_r, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS rouge{n}_f1 FROM s"""


@query(_rouge_sql(1))
def rouge1_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(pairs.rouge_n(_turn_pairs(spark, sf_dir), "generated", "reference", 1).drop("generated", "reference"))


@query(_rouge_sql(2))
def rouge2_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(pairs.rouge_n(_turn_pairs(spark, sf_dir), "generated", "reference", 2).drop("generated", "reference"))


@query()
def rouge_l_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(pairs.rouge_l(_turn_pairs(spark, sf_dir), "generated", "reference").drop("generated", "reference"))


def _bleu_sql() -> str:
    gram = lambda n: f"list_transform(range(1, greatest(len(t) - {n - 2}, 1)), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
    orders = range(1, 5)
    counts = ", ".join(f"g{n} AS (SELECT conv_id, turn, w, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS b FROM (SELECT conv_id, turn, s, unnest({gram(n)}) AS w FROM l) GROUP BY ALL), m{n} AS (SELECT conv_id, turn, sum(least(a, b)) AS m{n} FROM g{n} GROUP BY ALL)" for n in orders)
    joins = " ".join(f"LEFT JOIN m{n} USING (conv_id, turn)" for n in orders)
    missed = lambda n: " + ".join(f"CASE WHEN coalesce(m{k}, 0) = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1))
    logs = " + ".join(f"ln(CASE WHEN coalesce(m{n}, 0) > 0 THEN m{n} / greatest(len(g) - {n - 1}, 1) ELSE 1 / (pow(2.0, {missed(n)}) * greatest(len(g) - {n - 1}, 1)) END) / 4" for n in orders)
    return f"""WITH p AS ({PAIR.format(TOK.format('a'), TOK.format('b'))}), l AS (SELECT conv_id, turn, 1 AS s, g AS t FROM p UNION ALL SELECT conv_id, turn, 2, r FROM p), {counts}
 SELECT conv_id, turn, round(CASE WHEN len(g) = 0 OR coalesce(m1, 0) = 0 THEN 0.0 ELSE CASE WHEN len(g) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / len(g)) END * exp({logs}) END, 6) AS bleu FROM p {joins}"""


@query(_bleu_sql())
def bleu_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(pairs.bleu(_turn_pairs(spark, sf_dir), "generated", "reference").drop("generated", "reference"))


@query("""WITH b AS (SELECT label, vec_id % 5 AS claim, max(CAST(embedding[1] AS DOUBLE)) AS b FROM embeddings GROUP BY label, vec_id % 5) SELECT label, count(*) AS n_claims, round(avg(b), 6) AS score FROM b GROUP BY label""")
def summac_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5).alias("claim"), F.col("embedding")[0].cast("double").alias("s"))
    return pairs.max_then_mean(e, "label", "claim", "s").withColumn("score", r6("score"))


@query("""WITH s AS (SELECT user_id, list_transform([1, 2, 3, 4, 5], lambda k: -(pow(k - (user_id % 5 + 1), 2) + pow(k - (user_id % 3 + 1), 2))) AS x FROM (SELECT DISTINCT user_id FROM events)),
e AS (SELECT user_id, list_transform(x, lambda v: exp(v)) AS e FROM s) SELECT user_id, round(list_sum(list_transform(range(1, 6), lambda k: k * e[k] / list_sum(e))), 6) AS expected, round(e[1] / list_sum(e), 6) AS p1 FROM e""")
def softmax_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    s = F.array((F.col("user_id") % 5 + 1).cast("double"), (F.col("user_id") % 3 + 1).cast("double"))
    t = u.select("user_id", pairs.squared_distance_targets(s).alias("t"))
    return t.select("user_id", r6(pairs.expected_score(F.col("t"))).alias("expected"), r6(F.col("t")[0]).alias("p1"))


# merged runs and judges, texts as tables, evaluation

WRITES = "SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN [event_type] ELSE [event_type, 'k' || CAST(event_id % 3 AS VARCHAR)] END AS path FROM events"


@query(f"""WITH w AS ({WRITES}), l AS (SELECT user_id, path, max(event_id) AS event_id FROM w GROUP BY ALL)
SELECT user_id, array_to_string(path, '/') AS path, event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.user_id = l.user_id AND len(m.path) = 1 AND len(l.path) = 2 AND m.path[1] = l.path[1] AND m.event_id > l.event_id)""")
def metric_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, F.array("event_type")).otherwise(F.array(F.col("event_type"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")))).alias("path"))
    return merge.write_paths(e, ["user_id"], "path", "event_id").select("user_id", F.concat_ws("/", "path").alias("path"), "event_id")


@query("""WITH j AS (SELECT event_type AS dataset, 'm' || CAST(user_id % 3 AS VARCHAR) AS judge, event_id % 1000 AS position, CASE WHEN event_id % 2 = 0 THEN 'simple' ELSE 'expert' END AS kind, min(value) AS v FROM events GROUP BY ALL),
n AS (SELECT dataset, count(DISTINCT judge) AS n FROM j GROUP BY dataset)
SELECT dataset, position, kind, round(avg(v), 6) AS overall, round(avg(v) FILTER (judge = 'm1'), 6) AS of_one FROM j JOIN n USING (dataset) GROUP BY dataset, position, kind, n HAVING count(*) = n""")
def judges_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("judge"), (F.col("event_id") % 1000).alias("position"), F.when(F.col("event_id") % 2 == 0, "simple").otherwise("expert").alias("kind"), "value")
    a = merge.aligned_judges(e, "dataset", "judge", "position", "kind", ["value"])
    mean = lambda s: r6(merge.or_zero_mean(F.transform(s, lambda x: x["scores"]["value"])))
    return a.select("dataset", "position", "kind", mean(F.col("scores")).alias("overall"), mean(merge.of_judges(F.col("scores"), ["m1"])).alias("of_one"))


@query("""SELECT c_custkey, array_to_string(CASE WHEN n <= 0 THEN [] WHEN n <= 5 THEN range(1, n + 1) ELSE list_transform(list_sort(list_transform(range(0, n), lambda i: {'k': md5(CAST(c_custkey AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 'l': 1 + i % 5})), lambda x: x.l) END, ',') AS levels
FROM (SELECT c_custkey, CAST(c_custkey % 12 AS INTEGER) AS n FROM customer)""")
def variant_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 12).cast("int").alias("n"))
    return c.select("c_custkey", F.concat_ws(",", merge.complexity_levels(F.col("n"), F.col("c_custkey")).cast("array<string>")).alias("levels"))


@query(f"""WITH t AS (SELECT lower(unnest({WORDS_SQL})) AS term FROM documents), c AS (SELECT term, count(*) AS n FROM t GROUP BY term), m AS (SELECT sum(n) AS total, count(*) AS kinds FROM c)
SELECT term, n, round(-ln((n + 1) / (total + kinds)), 6) AS ic FROM (SELECT * FROM c ORDER BY n DESC, term LIMIT 100), m""")
def corpus_stats_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a corpus merged from two halves: the 100 most frequent terms (the store's feature)."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("term"))
    m = materialise(corpus.merge_counts(*[corpus.term_counts(t.filter(F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)) == half)) for half in (True, False)]), "corpus")
    top = corpus.totals(m).select("total_terms", "unique_terms", F.explode("top_terms").alias("x"))
    return top.select("x.term", "x.n", r6(corpus.information_content(F.col("x.n"), F.col("total_terms"), F.col("unique_terms"))).alias("ic"))


SENTENCES = r"""p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n+'), lambda s: trim(s) <> '') AS ps FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS paragraph FROM p),
r AS (SELECT doc_id, paragraph, list_filter(string_split(regexp_replace(p, '([.!?])[ \t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS ss FROM q),
s AS (SELECT doc_id, paragraph, unnest(ss) AS text, unnest(range(0, len(ss))) AS sentence FROM r),
w AS (SELECT doc_id, paragraph, sentence, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}\p{M}\p{N}]+)*|[^ \t\n\f\r]') AS ts FROM s)"""


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(sentence AS INTEGER) AS sentence, CAST(len(ts) AS BIGINT) AS n_tokens, array_to_string(ts, ' ') AS tokens FROM w WHERE len(ts) > 0")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents.token_lists(documents.sentence_table(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return t.select("doc_id", "paragraph", "sentence", F.size("tokens").cast("long").alias("n_tokens"), F.concat_ws(" ", "tokens").alias("tokens"))


@query(f"""WITH {SENTENCES}, k AS (SELECT doc_id, paragraph, sentence, CAST(len(list_filter(ts, lambda t: length(t) >= 9)) AS BIGINT) AS n FROM w)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY sentence) - 1 AS INTEGER) AS sentence, n FROM k WHERE n > 0""")
def tokens_of_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents.token_table(documents.sentence_table(table(spark, sf_dir, "documents").select("doc_id", "text")))
    v = documents.of_pos(t.withColumn("upos", F.when(F.length("text") >= 9, "VERB").otherwise("X")), ["VERB"])
    return documents.tokens_by_sentence(v).select("doc_id", "paragraph", F.col("sentence").cast("int").alias("sentence"), F.size("tokens").cast("long").alias("n"))


VECTORS = "v AS (SELECT label AS doc_id, vec_id % 4 AS paragraph, vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), u AS (SELECT doc_id, paragraph, vec_id, list_transform(a, lambda x: x / sqrt(" + COS.format("a", "a") + ")) AS a FROM v)"


OVERLAP_SQL = f"""WITH {VECTORS}, n1 AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY vec_id) AS b FROM u), n2 AS (SELECT doc_id, paragraph, a, lead(a) OVER (PARTITION BY doc_id, paragraph ORDER BY vec_id) AS b FROM u),
a1 AS (SELECT doc_id, avg({COS.format("a", "b")}) AS x FROM n1 WHERE b IS NOT NULL GROUP BY doc_id), b1 AS (SELECT doc_id, avg(x) AS x FROM (SELECT doc_id, paragraph, avg({COS.format("a", "b")}) AS x FROM n2 WHERE b IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
pp AS (SELECT p.doc_id, p.paragraph AS pa, q.paragraph AS pb, {COS.format("p.a", "q.a")} AS x FROM u p JOIN u q ON p.doc_id = q.doc_id AND p.vec_id < q.vec_id),
a2 AS (SELECT doc_id, avg(x) AS x FROM pp GROUP BY doc_id), b2 AS (SELECT doc_id, avg(x) AS x FROM (SELECT doc_id, pa, avg(x) AS x FROM pp WHERE pa = pb GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(a1.x, 0.0), 6) AS overlap_1, round(coalesce(a2.x, 0.0), 6) AS overlap_a, round(coalesce(b1.x, 0.0), 6) AS overlap_1p, round(coalesce(b2.x, 0.0), 6) AS overlap_ap
FROM (SELECT DISTINCT doc_id FROM u) d LEFT JOIN a1 USING (doc_id) LEFT JOIN a2 USING (doc_id) LEFT JOIN b1 USING (doc_id) LEFT JOIN b2 USING (doc_id)"""


@query(OVERLAP_SQL)
def verb_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), (F.col("vec_id") % 4).alias("paragraph"), "vec_id", "embedding")
    return _decimals(documents.scoped_cosines(t, "embedding", "vec_id"))


@query(OVERLAP_SQL.replace("overlap_", "PCREF_").replace("PARTITION BY doc_id ORDER BY vec_id", "PARTITION BY doc_id ORDER BY paragraph, vec_id"))
def referential_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), (F.col("vec_id") % 4).alias("paragraph"), F.col("vec_id").alias("sentence"), F.col("embedding").alias("vector"))
    return _decimals(features.referential_cohesion(t))


@query(f"""WITH v AS (SELECT vec_id // 12 AS doc_id, vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) AS i, a FROM v),
p AS (SELECT x.doc_id, x.i, y.i AS j, {COS.format("x.a", "y.a")} / (sqrt({COS.format("x.a", "x.a")}) * sqrt({COS.format("y.a", "y.a")})) AS c FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.i < y.i),
l AS (SELECT doc_id, quantile_cont(c, 0.75) AS l FROM p GROUP BY doc_id), b AS (SELECT doc_id, count(*) FILTER (c < l) AS b FROM p JOIN l USING (doc_id) WHERE j = i + 1 GROUP BY doc_id)
SELECT doc_id, n, coalesce(b, 0) AS n_breaks, round(CASE WHEN n = 1 THEN 1.0 ELSE (coalesce(b, 0) + 1) / n END, 6) AS density FROM (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) LEFT JOIN b USING (doc_id)""")
def chunk_density_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 12).cast("long").alias("doc_id"), "vec_id", "embedding")
    return _decimals(documents.chunk_density_all_pairs(s, ["doc_id"], "vec_id", "embedding"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS word, p_size % 10 AS synset FROM part WHERE p_size > 40), l AS (SELECT p_size % 10 AS synset, avg(p_size) AS l FROM part GROUP BY ALL),
h AS (SELECT word, avg(l) AS h FROM s JOIN l USING (synset) GROUP BY ALL)
SELECT p_type AS doc_id, round(avg(coalesce(h, 0.0)), 6) AS hypernymy FROM part LEFT JOIN h ON word = p_brand GROUP BY p_type""")
def hypernymy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("synset", F.col("p_size") % 10)
    word = [F.col("p_brand").alias("word"), F.lit("NOUN").alias("upos")]
    tokens, senses, paths = p.select(F.col("p_type").alias("doc_id"), *word), p.filter("p_size > 40").select(*word, "synset"), p.select("synset", F.col("p_size").alias("length"))
    return _decimals(documents.hypernymy(tokens, senses, paths, ["doc_id"]))


@query("""WITH x AS (SELECT l_orderkey AS pair, l_suppkey % 3 AS s, l_partkey % 3 AS c, CAST(l_discount AS DOUBLE) AS f, CAST(l_tax AS DOUBLE) AS b FROM lineitem),
p AS (SELECT pair, avg(m) AS p FROM (SELECT pair, c, max(f) AS m FROM x GROUP BY ALL) GROUP BY pair), r AS (SELECT pair, avg(m) AS r FROM (SELECT pair, s, max(b) AS m FROM x GROUP BY ALL) GROUP BY pair)
SELECT pair, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM p JOIN r USING (pair)""")
def best_match_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), (F.col("l_suppkey") % 3).alias("s"), (F.col("l_partkey") % 3).alias("c"), F.col("l_discount").cast("double").alias("f"), F.col("l_tax").cast("double").alias("b"))
    return _decimals(pairs.best_match(x, "pair", "s", "c", "f", "b"))


@query("""WITH e AS (SELECT source AS dataset, quality AS y, n_chars AS v FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND quality IN (0, 1) AND n_chars IS NOT NULL),
k AS (SELECT dataset FROM e GROUP BY dataset HAVING count(*) >= 10 AND count(DISTINCT y) = 2), b AS (SELECT dataset, y, v FROM e JOIN k USING (dataset)), x AS (SELECT * FROM b UNION ALL SELECT '(all)', y, v FROM b),
r AS (SELECT dataset, y, v, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0 AS r FROM x),
m AS (SELECT dataset, count(*) AS n, sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, avg(v) FILTER (y = 0) - avg(v) FILTER (y = 1) AS d, coalesce(var_samp(v) FILTER (y = 0), 0) AS v0, coalesce(var_samp(v) FILTER (y = 1), 0) AS v1 FROM r GROUP BY dataset)
SELECT dataset, n, round((s - p * (p + 1) / 2) / (p * q), 6) AS auc, round(coalesce(d / nullif(sqrt(((q - 1) * v0 + (p - 1) * v1) / greatest(p + q - 2, 1)), 0), 0), 6) AS cohens_d, round(d, 6) AS mean_difference FROM m""")
def dataset_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return _decimals(evaluate.evaluate(d, "source", "quality", "n_chars"))


MODELS = "SELECT CAST(l_suppkey % 7 AS VARCHAR) AS penalty, avg(CAST(l_discount AS DOUBLE)) AS auc, avg(CAST(l_tax AS DOUBLE)) AS cohens_d, avg(CAST(l_quantity AS DOUBLE)) AS mean_difference, CAST(count(DISTINCT l_shipdate) AS DOUBLE) AS js_divergence, avg(CAST(l_extendedprice AS DOUBLE)) AS overlap_coefficient, CAST(count(*) AS DOUBLE) AS non_zero_coeffs FROM lineitem GROUP BY l_suppkey % 7"


@query(f"""WITH m AS ({MODELS}), s AS (SELECT min(auc) AS lo, max(auc) AS hi, max(non_zero_coeffs) AS k FROM m), b AS (SELECT m.*, 0.7 * (auc - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END + 0.3 * (1 - non_zero_coeffs / k) AS balance FROM m, s),
l AS (UNPIVOT (SELECT penalty, auc, cohens_d, mean_difference, js_divergence, -overlap_coefficient AS overlap_coefficient, balance FROM b) ON auc, cohens_d, mean_difference, js_divergence, overlap_coefficient, balance INTO NAME measure VALUE v)
SELECT measure, penalty AS best FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v DESC, penalty) AS r FROM l) WHERE r = 1""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.avg(F.col(c).cast("double"))
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("string").alias("penalty")).agg(d("l_discount").alias("auc"), d("l_tax").alias("cohens_d"), d("l_quantity").alias("mean_difference"), F.count_distinct("l_shipdate").cast("double").alias("js_divergence"), d("l_extendedprice").alias("overlap_coefficient"), F.count("*").cast("double").alias("non_zero_coeffs"))
    return evaluate.compare_models(materialise(m, "models"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""WITH n AS (SELECT unnest([{", ".join(f"'{p}'" for p in PRIORITIES)}]) AS d, unnest(range(5)) AS i), m AS (SELECT unnest(range(1, 31)) AS mask), c AS (SELECT mask, string_agg(d, '_vs_' ORDER BY d) AS combination, list(d) AS ds FROM m JOIN n ON (mask >> i) & 1 = 1 GROUP BY mask HAVING count(*) BETWEEN 2 AND 4)
SELECT combination, o_orderstatus, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean, round(stddev_pop(CAST(o_totalprice AS DOUBLE)), 4) AS std FROM orders JOIN c ON list_contains(ds, o_orderpriority) GROUP BY ALL""")
def dataset_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluate.combinations(table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES, ["o_orderstatus"], "o_totalprice")
    return g.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("""SELECT event_type, CAST(user_id % 20 AS INTEGER) AS level, count(*) AS n FROM events WHERE coalesce(abs(user_id % 20 - value) <= 10, true) GROUP BY ALL""")
def level_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).cast("int").alias("level"), "value")
    return merge.level_histogram(merge.without_outliers(e, "level", "value"), "level", "event_type")


# learning and streaming


@query()
def kmeans_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.kmeans_histogram(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query()
def logistic_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = learn.logistic_formula(_labelled(spark, sf_dir), "y", METRICS)
    return f.withColumn("coefficient", F.round("coefficient", 4))


@query()
def bootstrap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", "[^.]+", "")).cast("double").alias("n_stops"))  # before the join: no text is shuffled
    d = counts.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), *METRICS)
    return learn.bootstrap_select(d, "y", METRICS, "doc_id")


@query()
def causal_connectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from readgrain.operators.annotators import annotate

    a = annotate(table(spark, sf_dir, "conversations"), "text", ["causal"])
    return a.select("conv_id", "turn", F.col("metrics")["causal/count"].cast("long").alias("n_causal"))


@query("SELECT event_id, event_type, CAST(length(props) AS INTEGER) AS n_props FROM events")
def stream_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, each with the length of its properties; exactly once per event."""
    import uuid

    from readgrain.streaming.annotate import annotate_stream

    at = f"{shared_dir(spark)}/readgrain/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")
    q = annotate_stream(spark, sf_dir, schema, lambda b: b.select("event_id", "event_type", F.length("props").alias("n_props")), f"{at}/out", f"{at}/state", ["event_id"], "events.parquet")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")
