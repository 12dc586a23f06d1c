"""Quality classifier by co-training: one classifier reads the text's content, another the page's metadata; each teaches the other.

Content: what the words, characters and lines of the text are like. Metadata: the columns beside the text (language, source, recorded
length), of which languages and sources enter by how often labelled documents with them are good. Neither view sees what the other does.
Both are logistic regressions. They start from a bounded sample of labelled documents; then, in each round, each classifier labels every
document that has no label and of which it is sure, and the other takes a Newton step on its labelled rows and all of these. A step's
sums run over all documents, as whole numbers, so they don't depend on the order of rows; what reaches the driver is one row per number of
a small matrix. At the end both are calibrated (Platt scaling) on labelled rows that neither was fitted on, their log-odds are weighed by
a last regression on the same rows, and every document is scored. The texts are read twice and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from readgrain.llm.common import documents, forget, materialise, slices, task

#: Bound of the labelled rows that are fitted on: those of the smallest hash of id and text.
LABELLED = 8000
#: Rounds, how sure a classifier must be to label a document for the other, and the weight of such a row beside a labelled one.
ROUNDS, SURE, TAUGHT = 4, 0.95, 0.5
#: Rows' worth of the average in the share of good documents of a language or source.
DRAW = 8
#: Below this the classifier rejects.
CUT = 0.5
#: Features are rounded to 1 / UNIT and clipped to +- MOST, weights of rows to 1 / STEP: sums of products of them are exact.
UNIT, MOST, STEP = 256, 8, 1024
#: Rows after which a sum leaves Python, so that it stays exact in a double.
EXACT = 1 << 20

SYMBOLS, MARKS, DIGITS, CAPITALS = b"#*$%&|<>", b"!?", b"0123456789", bytes(range(65, 91))


def content_view(text: str | None) -> list[float]:
    import operator
    from collections import Counter
    from math import log1p

    raw = (text or "").encode("utf-8")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x and not x.isspace()]
    n, size = max(1, len(words)), max(1, len(raw))
    less = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    counts = Counter(words)
    alone = sum(map(operator.eq, words, words[1:]))
    letters = sum(map(len, words)) / n
    return [
        log1p(letters), less(SYMBOLS), less(MARKS), less(DIGITS), less(CAPITALS), less(b".,;:"), log1p(len(counts)) / log1p(n), alone / n, max(counts.values(), default=0) / n, float(counts.get(b"|", 0)) / n, float(min(n, 20)) / 20,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
    ]


CONTENT = 12


def rates(rows: list) -> dict:
    """What metadata_view needs of labelled rows: numbers of good and of all documents, per language, per source and in all, and the middle length."""
    out: dict = {"all": [0, 0], "lang": {}, "source": {}, "chars": sorted(r["n_chars"] or 0 for r in rows)[len(rows) // 2] if rows else 0}
    for r in rows:
        for at in (out["all"], out["lang"].setdefault(r["lang"], [0, 0]), out["source"].setdefault(r["source"], [0, 0])):
            at[0] += r["quality"] > 0
            at[1] += 1
    return out


def metadata_view(lang: str | None, source: str | None, n_chars: int | None, known: dict, own: int | None = None) -> list[float]:
    """Features of the columns beside the text: the log-odds of good documents of its language and source, drawn towards all by DRAW rows' worth.

    Those that no labelled row has count as the average. own: the label of a row that `known` counted, which is taken out again, so
    that a row doesn't tell its own label.
    """
    from math import log, log1p

    less, one = (int(own > 0), 1) if own is not None else (0, 0)
    good, n = known["all"]
    base = (good - less + 1) / (n - one + 2)
    whole, out = log(base / (1 - base)), []
    for by, k in (("lang", lang), ("source", source)):
        g, m = known[by].get(k, (less, one))
        p = (g - less + DRAW * base) / (m - one + DRAW)
        out.append(log(p / (1 - p)) - whole)
    size = log1p(max(0, known["chars"] if n_chars is None else n_chars))
    return [*out, size, size * size, float(n_chars is None)]


class Logistic:
    """L2-regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x, y, weight=None, decay: float = 1.0) -> None:  # noqa: ANN001
        import numpy as np

        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w, ridge = np.zeros(z.shape[1]), np.r_[np.full(z.shape[1] - 1, decay), 1e-6]
        weight = np.ones(len(x)) if weight is None else weight
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            s = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
            w = w + step
            if abs(step).max() < 1e-6:
                break
        self.w = w

    def rounded(self, x):  # noqa: ANN001, ANN201
        """Standardised features and a constant, as whole multiples of 1 / UNIT."""
        import numpy as np

        z = np.rint(np.clip((x - self.mean) / self.scale, -MOST, MOST) * UNIT)
        return np.c_[z, np.full(len(z), float(UNIT))]

    def odds(self, x):  # noqa: ANN001, ANN201
        import numpy as np

        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1], -30, 30)


def with_size(docs: DataFrame) -> DataFrame:
    """docs, with a null n_chars if that column is missing."""
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def row_key(doc_id: str = "doc_id", text: str = "text"):  # noqa: ANN201
    return F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list:
    """Labelled rows: quality, hash, lang, source, n_chars and content, those of the smallest hash of id, then of id and text; `labelled` at most.

    Ids are chosen first, without texts; of rows with equal id and text one counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    there = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").join(known, "doc_id").distinct()
    some = materialise(there.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(labelled).select(F.col("doc_id").alias("_id"), "quality"), "quality-sample")
    got = with_size(docs).select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # `labelled` ids at most
    got = got.withColumn("hash", row_key()).groupBy("hash", "quality").agg(*[F.min(c).alias(c) for c in ("text", "lang", "source")], F.min("n_chars").cast("long").alias("n_chars"))
    schema = StructType.fromDDL("quality int, hash string, lang string, source string, n_chars long, content array<double>")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 0):
                views = [content_view(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(views, pa.list_(pa.float64()))], schema.names)

    rows = got.select("text", *schema.names[:-1]).mapInArrow(task(run), schema)
    return rows.orderBy("hash").limit(labelled).collect()


def measured(docs: DataFrame, known: dict, columns: list[str]) -> DataFrame:
    """`columns` of docs, then both views of each row: content (doubles) and metadata (doubles)."""
    kept = docs.select(*columns)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("__rg_content array<double>, __rg_metadata array<double>").fields])
    sent = docs.sparkSession.sparkContext.broadcast(known)
    n = len(columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, n):
                text, *beside = (part.column(n + i).to_pylist() for i in range(4))
                content = [content_view(t) for t in text]
                metadata = [metadata_view(*m, sent.value) for m in zip(*beside, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(v, pa.list_(pa.float64())) for v in (content, metadata))], schema.names)

    return with_size(docs).select(*columns, F.col("text").alias("__rg_t"), F.col("lang").alias("__rg_l"), F.col("source").alias("__rg_s"), F.col("n_chars").cast("long").alias("__rg_n")).mapInArrow(task(run), schema)


def matrix(column):  # noqa: ANN001, ANN201
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def curvature(z, model: Logistic, y, weight):  # noqa: ANN001, ANN201
    """Whole numbers: the sums of z z' s and of z r, for rows z (rounded) with labels y; s and r are the rows' curvature and residue."""
    import numpy as np

    p = 1 / (1 + np.exp(-np.clip((z / UNIT) @ model.w, -30, 30)))
    s, r = np.rint(weight * np.maximum(p * (1 - p), 1e-3) * STEP), np.rint(weight * (y - p) * STEP)
    return (z * s[:, None]).T @ z, z.T @ r


def lessons(rows: DataFrame, models: list[Logistic], sure: float) -> dict[int, tuple]:
    """Per view (number of rows that the other view is sure about, curvature, gradient), summed over all rows without label."""
    import numpy as np

    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            total: dict[int, object] = {}
            for at in range(0, batch.num_rows, EXACT):
                x = [matrix(c) for c in batch.slice(at, EXACT).columns]
                odds = [m.odds(v) for m, v in zip(sent.value, x, strict=True)]
                edge = np.log(sure / (1 - sure))
                for v in (0, 1):
                    told = abs(odds[1 - v]) >= edge
                    y, z = (odds[1 - v][told] > 0).astype(float), sent.value[v].rounded(x[v][told])
                    h, g = curvature(z, sent.value[v], y, TAUGHT)
                    part = np.concatenate([[float(told.sum())], h.ravel(), g]).astype(np.int64)
                    total[v] = total.get(v, 0) + part
            for v, part in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)], ["v", "i", "n"])

    sums = rows.select("__rg_content", "__rg_metadata").mapInArrow(task(run), "v int, i int, n long").groupBy("v", "i").agg(F.sum("n").alias("n")).collect()
    out = {}
    for v in (0, 1):
        flat, d = np.zeros(1), len(models[v].w)
        if mine := sorted((r["i"], r["n"]) for r in sums if r["v"] == v):
            flat = np.array([float(n) for _, n in mine])
            out[v] = (int(flat[0]), flat[1 : 1 + d * d].reshape(d, d), flat[1 + d * d :])
    return out


def newton(model: Logistic, z, y, more: tuple | None, decay: float = 1.0) -> None:  # noqa: ANN001
    """One Newton step on labelled rows z and what was summed over the taught ones; a step is no longer than 2 in any weight."""
    import numpy as np

    h, g = curvature(z, model, y, np.ones(len(z)))
    if more:
        h, g = h + more[1], g + more[2]
    h, g = h / (UNIT * UNIT * STEP), g / (UNIT * STEP)
    ridge = np.r_[np.full(len(g) - 1, decay), 1e-6]
    step = np.linalg.solve(h + np.diag(ridge), g - ridge * model.w)
    model.w = model.w + np.clip(step, -2, 2)


def cotrain(rows: list, others: DataFrame | None = None, rounds: int = ROUNDS, sure: float = SURE) -> dict | None:
    """The two classifiers, their calibrations and weights, from labelled rows (sample()) and the views of all rows (measured()); None if the labels are of one class."""
    import numpy as np

    y = np.array([float(r["quality"] > 0) for r in rows])
    if len(rows) < 20 or y.min() == y.max():
        return None
    held = np.arange(len(rows)) % 4 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(rows), bool)
    known = rates([r for r, h in zip(rows, held, strict=True) if not h])
    sets = [np.array([r["content"] for r in rows]), np.array([metadata_view(r["lang"], r["source"], r["n_chars"], known, None if h else r["quality"]) for r, h in zip(rows, held, strict=True)])]
    models = [Logistic(x[~held], y[~held]) for x in sets]
    taught = []
    if others is not None:
        views = materialise(measured(others, known, []), "quality-views")
        for _ in range(rounds):
            told = lessons(views, models, sure)
            taught.append([told[v][0] if v in told else 0 for v in (0, 1)])
            for v in (0, 1):
                newton(models[v], models[v].rounded(sets[v][~held]), y[~held], told.get(v))
        forget(views)
    test = held if held.any() else np.ones(len(rows), bool)
    scales = [Logistic(models[v].odds(sets[v][test])[:, None], y[test]) for v in (0, 1)]
    both = np.c_[tuple(scales[v].odds(models[v].odds(sets[v])[:, None]) for v in (0, 1))]
    return {"known": known, "models": models, "scales": scales, "last": Logistic(both[test], y[test]), "taught": taught}


def score_of(model: dict, content, metadata):  # noqa: ANN001, ANN201
    import numpy as np

    both = np.c_[tuple(s.odds(m.odds(x)[:, None]) for m, s, x in zip(model["models"], model["scales"], (content, metadata), strict=True))]
    return 1 / (1 + np.exp(-model["last"].odds(both)))


def scored(docs: DataFrame, labels: DataFrame, columns: list[str], labelled: int = LABELLED, out: str = "score") -> DataFrame:
    """`columns` of docs and a last column (out): the probability that a document is of good quality, a row per row.

    Null texts are scored as empty ones, whole texts whatever their length; null languages, sources and lengths have values of their own.
    Rows of equal columns get equal scores, and the outcome doesn't depend on how rows are partitioned. Labels that no document has, null
    ones and those of null ids are left out. Without labels of both classes every score is 1. An empty table gives an empty one. Columns
    of docs that aren't named are not read.
    """
    # labelled rows teach as themselves; that they are among all rows as well only adds what a sure classifier says about them
    model = cotrain(sample(docs, labels, labelled), docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns)
    schema = StructType([*kept.schema.fields, StructField(out, DoubleType())])
    n = len(columns)
    # a column that is asked for goes to Python once
    names = {"text": "__rg_t", "lang": "__rg_l", "source": "__rg_s", "n_chars": "__rg_n"}
    wide = with_size(docs)
    extra = [c for c in names if c not in columns]
    at = {c: columns.index(c) if c in columns else n + extra.index(c) for c in names}

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at["text"]):
                if sent.value is None:
                    s = np.ones(part.num_rows)
                else:
                    text, *beside = (part.column(at[c]).to_pylist() for c in names)
                    content = np.array([content_view(t) for t in text])
                    # rounded, as products of matrices differ in their last bits with the number of rows
                    s = np.round(score_of(sent.value, content, np.array([metadata_view(*m, sent.value["known"]) for m in zip(*beside, strict=True)])), 9)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(s)], schema.names)

    return wide.select(*columns, *[F.col(c).alias(names[c]) for c in extra]).mapInArrow(task(run), schema)


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, cut: float = CUT) -> DataFrame:
    """docs without those that the classifier rejects; all rows of docs and their columns as they are otherwise, repeated ones too.

    Null texts, languages and sources are scored as scored() says; an empty table gives an empty one.
    """
    out = "__rg_score"
    return scored(docs, read_labels(spark, sf_dir), docs.columns, out=out).filter(F.col(out) >= cut).drop(out)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(documents(spark, sf_dir), read_labels(spark, sf_dir), ["doc_id"])
    return rows.withColumn("kept", F.col("score") >= CUT)
