"""Hand-computed expectations for the feature families."""

import math

from readgrain.operators import features as X


def test_syntax(spark):
    rows = [(1, 0, 1, "DET", "DT", "det", 0, True), (1, 1, 2, "NOUN", "NN", "nsubjpass", 0, True), (1, 2, 2, "VERB", "VBN", "ROOT", 0, True), (1, 3, 2, "PUNCT", ".", "punct", 0, False)]
    r = X.syntax_metrics(spark.createDataFrame(rows, "doc_id int, i int, head int, upos string, tag string, dep string, sentence int, is_word boolean")).first()
    assert math.isclose(r["content_ratio"], 2 / 3) and math.isclose(r["function_ratio"], 1 / 3) and r["passive_ratio"] == 1
    assert r["embedding_depth"] == 2 and r["avg_dependency_distance"] == 1 and math.isclose(r["lr_asymmetry"], 1 / 3)
    assert len(r) == 17


def test_concepts(spark):
    rows = [(1, 0, 1, "C1", ["a", "b"], True, True, 1.0, None, 0.5, 0.5), (1, 1, 2, "C2", ["a"], False, True, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, term int, n_words int, cui string, semtypes array<string>, is_lay boolean, is_expert boolean, frequency double, context double, cui_score double, combo double")
    r = X.concept_metrics(df, spark.createDataFrame([(1, 50)], "doc_id int, n_words int")).first()
    assert r["term_density"] == 4 and r["expert_to_lay_ratio"] == 2 and r["core_expert_term_ratio"] == 0.5 and r["avg_term_length"] == 1.5
    assert math.isclose(r["semantic_diversity"], -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))) and r["top3_semtype_concentration"] == 1
    assert r["avg_frequency_score"] == 1 and r["avg_context_score"] == 0 and len(r) == 20


def test_spans(spark):
    rows = [(1, "B-abbr-general", 0, 3, "ABC", 1, 0), (1, "general-complex", 10, 14, "word", 1, 4)]
    docs = spark.createDataFrame([(1, 50, 100, 2), (2, 0, 0, 0)], "doc_id int, n_words int, n_chars int, n_sentences int")
    got = {r["doc_id"]: r for r in X.span_metrics(spark.createDataFrame(rows, "doc_id int, type string, start int, end int, text string, n_words int, token int"), docs).collect()}
    r = got[1]
    assert r["jargon_count"] == 2 and r["jargon_density"] == 4 and r["easy_ratio"] == 0.5 and r["hard_to_easy_ratio"] == 1 and r["jargon_diversity"] == 1
    assert r["jargon_clustering_index"] == 1 / 5 and r["avg_sentence_jargon_density"] == 1 and len(r) == 30
    assert all(v == 0 for k, v in got[2].asDict().items() if k != "doc_id")


def test_cohesion_and_scores(spark):
    s = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 0, 1, [1.0, 0.0]), (1, 1, 2, [0.0, 1.0])], "doc_id int, paragraph int, sentence int, vector array<double>")
    r = X.referential_cohesion(s).first()
    assert math.isclose(r["PCREF_1"], 0.5) and math.isclose(r["PCREF_a"], 1 / 3) and math.isclose(r["PCREF_1p"], 1) and math.isclose(r["PCREF_ap"], 0.5)
    gold = spark.createDataFrame([(1, 0, 2, "x"), (1, 0, 2, "x"), (2, 0, 2, "x")], "doc_id int, start int, end int, type string")
    guess = spark.createDataFrame([(1, 0, 2, "x"), (3, 0, 2, "x")], "doc_id int, start int, end int, type string")
    e = X.entity_scores(gold, guess).first()
    assert e["precision"] == 0.5 and math.isclose(e["recall"], 1 / 3)
    lab = {r["label"]: r for r in X.label_scores(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "g string, p string"), "g", "p").collect()}
    assert lab["a"]["precision"] == 1 and lab["a"]["recall"] == 0.5 and lab["b"]["precision"] == 0.5
    t = spark.createDataFrame([(1, "Run", "VERB"), (1, "run", "NOUN")], "doc_id int, word string, upos string")
    m = spark.createDataFrame([("run", "V", 2.0), ("run", "N", 4.0), ("run", "J", 100.0)], "word string, category string, c double")
    assert X.word_ratings(t, m, ["c"]).first()["c"] == 3
