"""Merging of runs and judges, term stores, token tables, best matches: by hand-computed values and plain Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from readgrain.functions import text as T
from readgrain.operators import corpus, documents, evaluate, merge, pairs
from readgrain.plans import catalogue


def test_words_of_other_scripts(spark):
    r = T.with_counts(spark.createDataFrame([("L'été 1999, où vas-tu ?",), ("",), (None,), ("Привет мир",)], "text string")).drop("text").collect()
    assert [(x.n_words, x.n_letters, x.n_word_chars) for x in r] == [(5, 11, 16), (0, 0, 0), (0, 0, 0), (2, 9, 9)]
    assert r[0].n_syllables == 2 + 1 + 1 + 1 + 1


def test_subcategories_and_datasets(spark):
    rows = [("syntax", {"spacy_model_syntax": "m"}), ("llm", {"llm_model_path": "a/b/c"}), ("masked_prob", {"masked_prob_model": "x/y"}), ("masked_prob", {}), ("textstat", {}), ("umls", {"spacy_model_umls": ""}), (None, None)]
    df = spark.createDataFrame(rows, "kind string, config map<string,string>")
    assert [x[0] for x in df.select(merge.subcategories(F.col("kind"), F.col("config"))).collect()] == [["m"], ["c"], ["random", "y"], None, None, None, None]
    j = spark.createDataFrame([('{"b": 1, "a": 2}',), ("{}",), ("no",), (None,)], "j string")
    assert [x[0] for x in j.select(merge.dataset_of(F.col("j"))).collect()] == ["b", None, None, None]


def test_write_paths(spark):
    rows = [("s", ["a", "x"], 1, "old"), ("s", ["a", "x"], 2, "new"), ("s", ["b", "x"], 3, "gone"), ("s", ["b"], 4, "whole"), ("s", ["b", "y"], 5, "after"), (None, None, 6, "root"), (None, ["c", "x"], 7, "gone"), (None, ["c"], 8, "null key")]
    w = merge.write_paths(spark.createDataFrame(rows, "k string, p array<string>, o int, v string"), ["k"], "p", "o").collect()
    assert sorted((x.p, x.v) for x in w) == [([], "root"), (["a", "x"], "new"), (["b"], "whole"), (["b", "y"], "after"), (["c"], "null key")]
    assert merge.write_paths(spark.createDataFrame([], "k string, p array<string>, o int, v string"), ["k"], "p", "o").count() == 0


def test_judges(spark):
    rows = [("d", "m1", 0, "t", 1.0), ("d", "m2", 0, "t", 3.0), ("d", "m1", 1, "t", 5.0), ("e", "m1", 0, "t", None), ("d", "m2", 0, "t", 4.0)]
    a = {x.d: x for x in merge.aligned_judges(spark.createDataFrame(rows, "d string, m string, i int, k string, s double"), "d", "m", "i", "k", ["s"]).collect()}
    assert set(a) == {"d", "e"} and a["d"].i == 0 and [(s.judge, s.scores.s) for s in a["d"].scores] == [("m1", 1.0), ("m2", 3.0)]
    x = spark.range(1).select(F.expr("array(named_struct('judge', 'a', 'v', 1), named_struct('judge', 'b', 'v', 2))").alias("s"))
    got = x.select(*[F.transform(merge.of_judges(F.col("s"), n), lambda s: s["v"]).alias(f"c{i}") for i, n in enumerate(([], ["b"], ["z"]))]).first()
    assert list(got) == [[1, 2], [2], [1, 2]]
    m = spark.range(1).select(*[merge.or_zero_mean(F.expr(e)).alias(f"c{i}") for i, e in enumerate(("array(1d, null, 4d)", "array()", "cast(null as array<double>)"))]).first()
    assert list(m) == [2.5, 0.0, 0.0]
    j = spark.range(1).select(merge.judged({"p": F.lit(1.0), "q": F.lit(4.0)}).alias("j")).first().j
    assert (j.dimension_scores.q, j.overall_score) == (4.0, 2.5)


def test_variants(spark):
    df = spark.sql("SELECT array(named_struct('variants', array('a', 'b')), named_struct('variants', array('c', 'd'))) AS g, array(named_struct('g', 1, 'v', 0), named_struct('g', 9, 'v', 9)) AS e, cast(null AS array<struct<g: int, v: int>>) AS n")
    g, n = df.select(merge.drop_variants(F.col("g"), F.col("e")), merge.drop_variants(F.col("g"), F.col("n"))).first()
    assert [x.variants for x in g] == [["a", "b"], ["d"]] and [x.variants for x in n] == [["a", "b"], ["c", "d"]]
    levels = [list(x[0]) for x in spark.createDataFrame([(0,), (1,), (5,), (12,)], "n int").select(merge.complexity_levels(F.col("n"), F.lit(7))).collect()]
    assert levels[:3] == [[], [1], [1, 2, 3, 4, 5]] and sorted(levels[3]) == sorted(1 + i % 5 for i in range(12))
    v = spark.createDataFrame([("<variant><complexity_level>2</complexity_level><generated_answer>x</generated_answer></variant>",), ("nothing",)], "t string").select(merge.variants_or_empty(T.parse_variants(F.col("t")), F.lit(2)).alias("v")).collect()
    assert [(x.complexity_level, x.generated_answer) for x in v[0].v] == [("2", "x")] and [(x.complexity_level, x.generated_answer) for x in v[1].v] == [(None, "")] * 2


def test_tables_of_columns(spark):
    df = spark.createDataFrame([("1", "x", 2), (None, "3", 4)], "a string, b string, c int")
    assert dict(merge.numeric_where_possible(df, df.columns).dtypes) == {"a": "double", "b": "string", "c": "int"}
    assert merge.numeric_features(df, []) == ["c"] and merge.numeric_features(df, ["c"]) == []
    assert merge.columns_by_prefix(["rouge1", "nli_x", "id", "z"], {"relevance": ["rouge"], "factuality": ["nli"]}, ["id"]) == {"relevance": ["rouge1"], "factuality": ["nli_x"], "other": ["z"]}
    sets = spark.createDataFrame([("e1", "evaluation", None), ("t2", "training_test", "a"), ("b", "training", None), ("t1", "training_test", "b"), ("q", None, None)], "name string, category string, parent string")
    assert [x.name for x in merge.sort_datasets(sets).collect()] == ["b", "t2", "t1", "e1", "q"]
    assert [x.v for x in merge.by_absolute(spark.createDataFrame([("b", 1.0), ("a", -1.0), ("c", -3.0)], "n string, v double"), "v", "n").collect()] == [-3.0, -1.0, 1.0]
    g = merge.in_groups(spark.range(40).withColumn("g", F.col("id") % 4), "g", "id").orderBy("group_order", "row_order").collect()
    assert len(list(itertools.groupby(x.g for x in g))) == 4


def test_merge_near(spark):
    text = "heart - attack, type-2 diabetes x"
    spans = [("heart", "A"), ("attack", "A"), ("type", "A"), ("2 diabetes", "A"), ("x", "A")]
    rows = [(1, k, text.index(w), text.index(w) + len(w)) for w, k in spans[:-1]] + [(1, "A", len(text) - 1, len(text))]
    got = merge.merge_near(spark.createDataFrame(rows, "d int, type string, start int, end int"), spark.createDataFrame([(1, text)], "d int, text string"), ["d"])
    assert sorted(x.text for x in got.collect()) == ["attack", "heart", "type-2 diabetes"]
    assert sorted(x.text for x in merge.merge_near(spark.createDataFrame(rows, "d int, type string, start int, end int"), spark.createDataFrame([(1, text)], "d int, text string"), ["d"], 3).collect()) == ["heart - attack", "type-2 diabetes"]


def test_corpus_store(spark, tmp_path):
    c = corpus.term_counts(spark.createDataFrame([("A",), ("a",), ("b",), (None,)], "term string"))
    m = corpus.merge_counts(c, c)
    corpus.save(m, f"file://{tmp_path}/stats")
    counts, total, kinds = corpus.load(spark, f"file://{tmp_path}/stats")
    assert (total, kinds, {x.term: x.n for x in counts.collect()}) == (6, 2, {"a": 4, "b": 2})
    assert corpus.totals(m, 1).first().top_terms == [("a", 4)]
    empty = corpus.totals(c.limit(0)).first()
    assert (empty.total_terms, empty.unique_terms, empty.top_terms) == (0, 0, [])
    ic = spark.range(1).select(corpus.information_content(F.lit(None).cast("long"), F.lit(6), F.lit(2))).first()[0]
    assert ic == pytest.approx(math.log(8))


def test_token_tables(spark):
    d = spark.createDataFrame([(1, "One two. Three!\n\nFour five, six."), (2, ""), (3, None)], "doc_id int, text string")
    t = documents.token_table(documents.sentence_table(d))
    assert [(x.paragraph, x.sentence, x.text) for x in t.orderBy("paragraph", "sentence", "token").collect()] == [(0, 0, "One"), (0, 0, "two"), (0, 0, "."), (0, 1, "Three"), (0, 1, "!"), (1, 0, "Four"), (1, 0, "five"), (1, 0, ","), (1, 0, "six"), (1, 0, ".")]
    v = documents.of_pos(t.withColumn("upos", F.when(F.col("text").isin("Three", "six"), "VERB")), ["VERB"])
    assert sorted((x.paragraph, x.sentence) for x in v.collect()) == [(0, 0), (1, 0)]
    ids = spark.range(1).select(documents.labels_to_ids(F.array(F.lit("B-x"), F.lit("?"), F.lit(None)), {"O": 0, "B-x": 1})).first()[0]
    assert ids == [1, 0, 0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentence_tokens_stay_where_they_are(spark, tmp_path):
    """A sentence's tokens come from its own row: nothing is shuffled, and documents of the same id aren't mixed."""
    d = spark.createDataFrame([(1, "One two. Three!\n \t \nFour five, six."), (1, "One two."), (2, "\t\n"), (3, None)], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    q = catalogue.QUERIES["sentence_tokens"](spark, str(tmp_path))
    assert "Exchange" not in plan_of(q)
    assert sorted(tuple(x) for x in q.collect()) == [(1, 0, 0, 3, "One two ."), (1, 0, 0, 3, "One two ."), (1, 0, 1, 2, "Three !"), (1, 2, 0, 5, "Four five , six .")]


def test_frequent_terms_are_not_shuffled(spark):
    """Means of information content, whichever terms are at hand: all, some, none; rows of terms at hand aren't shuffled."""
    rows = [(d, w) for d, t in enumerate(("a a a b", "a b c", "d", "a e " + "x" * 80, "a b " + "x" * 80)) for w in t.split()]
    df = spark.createDataFrame([*rows, (9, None)], "doc int, term string")
    n = {w: sum(x == w for _, x in rows) for _, w in rows}
    ic = {w: -math.log((k + 1) / (len(rows) + len(n))) for w, k in n.items()}
    for frequent in (100, 2, 0):
        got = corpus.mean_information_content(df, "doc", frequent=frequent)
        assert "LeftAnti" in plan_of(got)  # the longest term is never at hand
        got = {x.doc: (x.n_terms, x.mean_ic) for x in got.collect()}
        assert got == {d: (len(ws), pytest.approx(sum(ic[w] for w in ws) / len(ws))) for d in range(5) for ws in [[w for e, w in rows if e == d]]}
    q = corpus.mean_information_content(df.filter(F.length("term") < 9), "doc")
    assert "term" not in "".join(x for x in plan_of(q).splitlines() if "Exchange hashpartitioning" in x) and "SortMergeJoin" not in plan_of(q)
    assert corpus.mean_information_content(df.filter("doc > 8"), "doc").collect() == []


def test_difficult_words_are_not_shuffled(spark):
    words = spark.createDataFrame([(d, w) for d, t in enumerate(("cat cats glass glas catss s", "dog dogs dog", "news new")) for w in t.split()], "doc int, w string")
    easy = spark.createDataFrame([("cat",), ("glass",), ("dogs",), ("new",), ("cat",), (None,)], "w string")
    want = [(0, 6, 3), (1, 3, 2), (2, 2, 0)]
    q = corpus.difficult_words(words, easy, "doc", "w")
    assert "BroadcastHashJoin" in plan_of(q) and "SortMergeJoin" not in plan_of(q)
    assert sorted(tuple(x) for x in q.collect()) == want
    assert sorted(tuple(x) for x in corpus.difficult_words(words, easy, "doc", "w", at_hand=0).collect()) == want
    assert sorted(tuple(x) for x in corpus.difficult_words(words, easy.limit(0), "doc", "w").collect()) == [(0, 6, 6), (1, 3, 3), (2, 2, 2)]


def test_sense_similarity(spark):
    senses = spark.createDataFrame([("run", "V", "s1"), ("run", "V", "s2"), ("go", "V", "s2"), ("go", "V", "s3")], "word string, upos string, synset string")
    sims = spark.createDataFrame([("s1", "s2", 0.5, 1.0), ("s2", "s2", 1.0, 2.0), ("s2", "s3", 0.0, None)], "synset_a string, synset_b string, path double, lch double")
    p = spark.createDataFrame([(1, "run", "V", "go", "V"), (1, "run", "V", "go", "V"), (2, "run", "V", "zz", "V")], "d int, word_a string, upos_a string, word_b string, upos_b string")
    got = {x.d: (x.path, x.lch, x.binary) for x in documents.sense_similarity(p, senses, sims, ["d"], ["path", "lch"]).collect()}
    assert got == {1: (0.5, 1.5, 1.0), 2: (0.0, 0.0, 0.0)}


def test_best_chain(spark):
    import random

    rng = random.Random(3)
    ms = [[[round(rng.uniform(-1, 2), 3) for _ in range(w)] for _ in range(h)] for h, w in ((1, 1), (2, 3), (4, 2), (3, 5))]

    def plain(m):
        best = [0.0] * (len(m[0]) + 1)
        for row in m:
            now = [0.0]
            for j, v in enumerate(row):
                now.append(max(best[j] + v, best[j + 1] + v, now[-1]))
            best = now
        return best[-1] / len(m)

    got = [x[0] for x in spark.createDataFrame([(m,) for m in ms], "m array<array<double>>").select(pairs.best_chain(F.col("m"))).collect()]
    assert got == pytest.approx([plain(m) for m in ms])
    none = spark.createDataFrame([([],), (None,), ([[]],)], "m array<array<double>>").select(pairs.best_chain(F.col("m"))).collect()
    assert [x[0] for x in none] == [0.0, 0.0, 0.0]


def test_evaluate_skips(spark):
    rows = [("a", i % 2, float(i)) for i in range(12)] + [("few", i % 2, 1.0) for i in range(4)] + [("one", 1, 1.0)] * 20 + [("a", None, 1.0), ("a", 1, None)]
    got = {x.dataset: x.n for x in evaluate.evaluate(spark.createDataFrame(rows, "d string, y int, s double"), "d", "y", "s").collect()}
    assert got == {"a": 12, "(all)": 12}
    assert evaluate.evaluate(spark.createDataFrame([], "d string, y int, s double"), "d", "y", "s").count() == 0


def test_save_report(spark, tmp_path):
    import json

    from readgrain.sources.writers import save_report

    for path in (f"{tmp_path}/a/r.json", f"file://{tmp_path}/b/r.json"):
        for report in ({"old": 1}, {"é": [1, None]}):
            save_report(report, path)
        with open(path.removeprefix("file://"), encoding="utf-8") as f:
            assert json.load(f) == {"é": [1, None]}
