"""Hand-computed expectations for the readability operators."""

import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from readgrain.functions import text as T
from readgrain.operators import annotators, order, pairs, reshape, rules, sequences, stats


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_cleaning(spark):
    assert one(spark, "<|im_start|> Hi  there\n<human>", "string", T.clean_artefacts) == "Hi there"
    assert one(spark, None, "string", T.clean_artefacts) == ""
    assert one(spark, "é a\r\nb", "string", T.clean_ascii) == "? a b"
    assert one(spark, "a\r\nb  c", "string", lambda c: T.clean_ascii(c, keep_paragraphs=True)) == "a\nb c"
    assert one(spark, "<p>a<b>b</b></p>", "string", T.strip_html) == "a b"


@pytest.mark.parametrize(("text", "bad"), [("[x]", True), ("Unanswerable", True), ("B", True), ("ok", True), ("okay", False), ("a Content Mismatch b", True), (None, False)])
def test_placeholders(spark, text, bad):
    assert one(spark, text, "string", T.is_problem) is bad


def test_tags(spark):
    assert one(spark, "<think>x</think> y </think> z ", "string", T.after_thinking) == "z"
    assert one(spark, "<a>1</a>", "string", lambda c: T.tag(c, "a")) == "1"
    assert one(spark, "<a>1<b>2</b>", "string", lambda c: T.tag(c, "a")) == "1"
    assert one(spark, "<b>2</b>", "string", lambda c: T.tag(c, "a")) is None
    p = one(spark, "<complexity_level>3</complexity_level><generated_answer>hi", "string", T.parse_response)
    assert tuple(p) == (3, "hi")
    v = one(spark, "x<variant><complexity_level>1</complexity_level><generated_answer>a</generated_answer></variant><variant>", "string", T.parse_variants)
    assert [tuple(x) for x in v] == [("1", "a")]
    names = T.DIMENSIONS
    raw = f"<{names[0]}>4</{names[0]}><{names[1]}>high</{names[1]}><{names[2]}>5</{names[2]}>"
    j = T.parse_judgement(F.lit(raw))
    row = spark.range(1).select(*[v.alias(k) for k, v in j.items()]).first()
    assert row[0] == 4 and row[1] == 2.5 and row[2] == 2.5 and math.isclose(row["overall"], (4 + 2.5 * 4) / 5)
    s = T.parse_scores(F.lit('```json\n{"clarity": 4}\n``` usefulness: 2 Usefulness: 3'))
    row = spark.range(1).select(s["clarity"].alias("a"), s["usefulness"].alias("b"), s["relevance"].alias("c")).first()
    assert row["b"] == 3 and row["c"] is None


def test_counts_and_formulas(spark):
    df = T.with_counts(spark.createDataFrame([("The cat sat. A beautiful animal!",), ("",), (None,)], "text string")).withColumns(T.formulas())
    a, b, c = df.collect()
    assert (a["n_words"], a["n_sentences"], a["n_syllables"], a["n_poly"], a["n_mono"]) == (6, 2, 10, 2, 4)
    assert math.isclose(a["mcalpine_eflaw"], (6 + 4) / 2)
    assert math.isclose(a["flesch_kincaid_grade"], 0.39 * 3 + 11.8 * 10 / 6 - 15.59)
    assert all(b[k] == 0 and c[k] == 0 for k in T.formulas())


def test_mtld(spark):
    get = lambda ws: one(spark, ws, "array<string>", T.mtld)
    assert get(["a", "b", "c"]) == 3.0
    assert get([]) == 0.0
    assert get(["a"] * 4) == 2.0
    assert get(None) is None
    assert get([None, None, "a"]) == 3.0


def test_mtld_of_long_segments(spark):
    """A segment of any length costs no more a word: 40,000 words, of which none comes twice, in one segment."""
    import time

    row = lambda n: spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")).alias("ws"))
    assert row(10).select(T.mtld(F.col("ws"))).first()[0] == 10
    began = time.time()
    assert row(40_000).select(T.mtld(F.col("ws"))).first()[0] == 40_000
    assert time.time() - began < 5


def test_scaling(spark):
    inf = float("inf")
    rows = [r[0] for r in stats.repair_infinity(spark.createDataFrame([(inf,), (3.0,), (1.0,), (-inf,), (None,)], "x double"), ["x"]).collect()]
    assert rows == [3.0, 3.0, 1.0, 1.0, None]
    assert [r[0] for r in stats.repair_infinity(spark.createDataFrame([(inf,)], "x double"), ["x"]).collect()] == [0.0]
    assert {r[0] for r in stats.normalise(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"]).collect()} == {0.0}
    assert stats.to_hundred(spark.createDataFrame([(2.0,)], "x double"), "x", "y").first()["y"] == 50
    got = spark.createDataFrame([(2.5,), (7.5,), (12.5,)], "x double").select(stats.discretise(F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 10, 10]


def test_percentiles_and_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,), (None,)], "x double")
    assert sorted(r["percentile"] for r in order.percentile_ranks(df, "x").collect() if r["x"] is not None) == [25, 62.5, 62.5, 100]
    q = order.quantiles(spark.range(10), "id", [0.25, 0.1]).first()
    assert math.isclose(q[0], 2.25) and math.isclose(q[1], 0.9)
    import numpy as np

    xs = np.random.default_rng(1).lognormal(size=3000).round(2)
    big = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(xs)], "g int, x double")
    for r in order.quantiles(big, "x", [0.0, 0.33, 0.9, 1.0], ["g"]).collect():
        assert np.allclose(list(r)[1:], np.quantile(xs[r["g"] :: 3], [0, 0.33, 0.9, 1]))
    assert order.quantile_bins(big, "x").groupBy("bin").count().count() == 21


def test_thresholds(spark):
    th = spark.createDataFrame([(0, 0.0, 1.0), (5, 1.5, 2.0)], "bin int, raw_min double, raw_max double")
    rows = reshape.bin_by_thresholds(spark.createDataFrame([(0.0,), (1.0,), (1.2,), (-1.0,), (2.0,)], "x double"), th, "x").collect()
    assert [r["bin"] for r in rows] == [0, 0, None, None, 5]


def test_ids(spark):
    df = spark.createDataFrame([("q", "a", 0), ("q", "a", 1), ("q", "b", 2), ("r", "a", 3)], "q string, a string, pos long")
    assert {tuple(r) for r in reshape.qa_ids(df, "q", "a", "pos").collect()} == {("Q1_A1", "q", "a"), ("Q1_A2", "q", "b"), ("Q2_A1", "r", "a")}


def test_rules(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, None), (float("nan"), 5.0)], "a double, b double")
    zero = rules.load_rules('[{"name": "r", "conditions": [{"metric": "a", "operator": ">=", "threshold": 0}]}]')
    assert rules.passing(df, zero).count() == 2  # NaN fails
    inverted = rules.Rule("i", filter_if_pass=True).check("a").at_least(0)
    assert rules.passing(df, [inverted]).count() == 1  # NaN stays
    assert rules.passing(df, [rules.Rule("empty")]).count() == 3
    nested = rules.Rule("n").check("a").above(1).or_().group(rules.Group("AND", [rules.Check("b", ">", 0), rules.Check("b", "<", 2)]))
    assert rules.passing(df, [nested]).count() == 2
    why = rules.evaluate(df, [rules.Rule("low").check("a").above(1)]).collect()
    assert why[0]["reasons"] == ["low: a > 1 (actual: 0.0000)"] and why[1]["reasons"] == []
    assert rules.load_rules(__import__("json").dumps([nested.to_json()]))[0].to_json() == nested.to_json()
    r = rules.report(df, zero).first()
    assert r["initial"] == r["removed"] + r["kept"]


def test_spans(spark):
    tags = ["B-x", "I-x", "O", "I-y", "B-x", "I-y", "O", "O", "B-y"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "d int, i int, t string")
    spans = sequences.bio_spans(df, ["d"], "i", "t")
    assert sorted((r["start"], r["end"], r["type"]) for r in spans.collect()) == [(0, 2, "x"), (3, 4, "y"), (4, 5, "x"), (5, 6, "y"), (8, 9, "y")]
    m = sequences.merge_spans(spark.createDataFrame([(1, "x", 0, 2), (1, "x", 3, 4), (1, "x", 7, 8)], "d int, type string, start int, end int"), ["d"])
    assert sorted((r["start"], r["end"]) for r in m.collect()) == [(0, 4), (7, 8)]


def test_vectors(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(6, 4))
    df = spark.createDataFrame([(1, i, [float(x) for x in r]) for i, r in enumerate(v)], "d int, i int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([(u[i] @ u[j]) for i in range(6) for j in range(i)])
    assert math.isclose(sequences.mean_pair_cosine(df, ["d"], "v").first()["mean_similarity"], want)
    assert math.isclose(sequences.pair_cosines(df, ["d"], "i", "v").agg(F.avg("similarity")).first()[0], want)


def test_pair_scores(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat the mat"), ("", "a")], "g string, r string")
    a, b = pairs.rouge_l(pairs.rouge_n(df, "g", "r", 1), "g", "r").collect()
    assert math.isclose(a["rouge1_p"], 4 / 6) and a["rouge1_r"] == 1 and math.isclose(a["rougeL_p"], 4 / 6)
    assert b["rouge1_f1"] == 0
    assert math.isclose(pairs.bleu(spark.createDataFrame([("a b c d e", "a b c d e")], "g string, r string"), "g", "r").first()["bleu"], 1)


def test_separation(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "y int, x double")
    a = stats.auc(df, "y", ["x"]).first()
    assert math.isclose(a["auc"], 3.5 / 4)
    d = stats.divergences(df, "y", ["x"]).first()
    assert d["kl"] >= 0 and d["js"] <= math.log(2) + 1e-9
    c = stats.divergences(spark.createDataFrame([(0, 1.0), (1, 1.0)], "y int, x double"), "y", ["x"]).first()
    assert (c["overlap"], c["kl"], c["js"]) == (1, 0, 0)


def test_causal():
    assert annotators.CausalCounter().count("Smoke leads to harm, therefore we stop because of it.") == 3


def test_causal_reads_a_line_once():
    """The counts of the patterns as they stand, in time that grows with the text."""
    import random
    import re
    import time

    def plain(low):
        found, n = set(), 0
        for p in annotators.CAUSAL:
            for m in re.finditer(p, low):
                at = set(range(*m.span("keyword")))
                n, found = (n, found) if at & found else (n + 1, found | at)
        return n

    pieces = sorted({k for p in annotators.CAUSAL for k in re.sub(r"\(\.\+\??\)|\(\?:|\(\?P<keyword>|\.\+|[?)|]", "|", p).split("|") if k}) + ["x", " ", " ", " ", ", ", "\n", " is ", " was ", "an effect of ", "if ", "because ", "the reason for ", ", then ", "\u0130", "\r"]
    dice, counter = random.Random(5), annotators.CausalCounter()
    for _ in range(2000):
        t = "".join(dice.choice(pieces) + dice.choice(("", " ")) for _ in range(dice.randint(0, 25)))
        assert counter.count(t) == plain(t.lower()), t
    for word in ("word ", "if a ", "because a ", "the reason for ", "an effect of a "):
        began = time.time()
        assert counter.count(word * (20_000 // len(word))) == plain(word * 40)
        assert time.time() - began < 2


def test_trees(spark):
    df = spark.createDataFrame([("Q1_A1", "orig", [("m", 0.1, [("1", "a"), ("9", " ")])])], "question_id string, original_answer string, generations array<struct<model_used string, temperature double, variants array<struct<complexity_level string, generated_answer string>>>>")
    rows = reshape.tree_rows(df, ["question_id"]).collect()
    assert sorted((r["text_type"], r["text"]) for r in rows) == [("original", "orig"), ("variant", "a")]
    v = df.select(*[c.alias(k) for k, c in reshape.valid_tree().items()]).first()
    assert v["usable"] and v["flagged"]


def test_ranks_of_skewed_values(spark):
    """Cells hold about as many values each, however these are distributed, and ranks are those of sorting."""
    values = [math.exp(i / 2000) for i in range(20000)] + [1e18, float("inf"), float("-inf"), 1.0, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    counted = rows.groupBy(F.col("v").alias("_v")).agg(F.count("*").alias("n_rows"))
    sizes = [r["count"] for r in order._with_cell(counted, "_v").groupBy("_cell").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * order.ROWS
    got = {r["v"]: (r["n_before"], r["n_rows"], r["n_total"]) for r in order.ranked(rows, "v").collect()}
    want, before = {}, 0
    for v, n in sorted(collections.Counter(values).items()):
        want[v] = (before, n, len(values))
        before += n
    assert got == want


def test_two_samples(spark):
    """Normal classes get Welch's t, others the rank statistic, each against plain Python."""
    r = random.Random(5)
    rows = [(k % 2, r.gauss(k % 2, 1), r.expovariate(1) ** 3 + k % 2) for k in range(400)]
    got = {x["metric"]: (x["statistic"], x["test_name"]) for x in stats.two_sample_test(spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"]).collect()}
    a = [[x[1] for x in rows if x[0] == k] for k in (0, 1)]
    t = (statistics.mean(a[0]) - statistics.mean(a[1])) / sum(statistics.variance(v) / len(v) for v in a) ** 0.5
    u = sum((x > y) + 0.5 * (x == y) for k, _, x in rows if k == 0 for j, _, y in rows if j == 1)
    assert got["a"][1] == "ttest" and abs(got["a"][0] - t) < 1e-9 and got["b"][1] == "mann_whitney_u" and abs(got["b"][0] - u) < 1e-6


def test_multiset_intersection(spark):
    r = random.Random(2)
    rows = [([r.choice("abc") for _ in range(r.randrange(8))], [r.choice("abcd") for _ in range(r.randrange(8))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", pairs.common(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(x["n"] == sum((collections.Counter(x["a"]) & collections.Counter(x["b"])).values()) for x in got)


def test_stream_without_repeated_keys(spark, tmp_path):
    """A key that comes again in another file, or after a restart, stays one row."""
    from readgrain.streaming.annotate import annotate_stream

    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: annotate_stream(spark, source, "k long, t string", lambda b: b.withColumn("n", F.length("t")), sink, f"{tmp_path}/check", ["k"]).awaitTermination()
    for part in ([(1, "a"), (2, "bb")], [(2, "again"), (3, "ccc"), (3, "ccc")], [(1, "x"), (4, "d")]):
        spark.createDataFrame(part, "k long, t string").write.mode("append").parquet(source)
        run()
    rows = spark.read.parquet(sink).collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(1, 1), (2, 2), (3, 3), (4, 1)]
