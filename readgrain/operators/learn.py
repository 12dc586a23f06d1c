"""Learning operators: cluster histograms, a logistic formula, bootstrap selection of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrain.operators.stats import number


def kmeans_histogram(rows: DataFrame, key: str, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    """Per key the share of its vectors in each of k clusters: key and an array of k shares."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10).fit(v)
    placed = model.transform(v).groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.col("prediction") == i).alias(f"_{i}") for i in range(k)])
    return placed.select(key, F.array(*[F.round(F.col(f"_{i}") / F.col("n"), 9) for i in range(k)]).alias("histogram"))


def logistic_formula(rows: DataFrame, label: str, columns: Sequence[str], reg: float = 0.01, elastic: float = 0.5, least: float = 1e-5) -> DataFrame:
    """Coefficients above `least` in absolute value, and the intercept, of a regularised logistic regression on z-scores (population deviation)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from readgrain.operators.stats import impute_mean, normalise

    x = normalise(impute_mean(rows.select(label, *[number(c).alias(c) for c in columns]), columns), columns)
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(x.withColumn("label", F.col(label).cast("double")))
    m = LogisticRegression(regParam=reg, elasticNetParam=elastic, standardization=False).fit(data)
    found = [("intercept", float(m.intercept))] + [(c, float(w)) for c, w in zip(columns, m.coefficients, strict=True) if abs(w) > least]
    return rows.sparkSession.createDataFrame(found, "feature string, coefficient double")


def _poisson(seeds, replicates):  # noqa: ANN001, ANN202
    """Poisson(1) weights, rows x replicates, from a hash of the row's seed and the replicate."""
    import numpy as np

    p, below = np.exp(-1.0), []
    for k in range(1, 20):
        below.append(p + (below[-1] if below else 0.0))
        p /= k
    h = seeds.view(np.uint64)[:, None] ^ ((replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of splitmix64
        h ^= h >> np.uint64(by)
        h *= np.uint64(times)
    h ^= h >> np.uint64(31)
    return np.searchsorted(np.array(below), (h >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def _sums(x, y, w, beta):  # noqa: ANN001, ANN202
    """Per replicate (last axis) the weight of class 1, of all, the logistic loss, its gradient and the upper half of its second derivatives."""
    import numpy as np

    z = x @ beta
    e = np.exp(-np.abs(z))
    loss = np.log1p(e) + np.maximum(np.where(y[:, None] == 1, -z, z), 0.0)
    p = np.where(z >= 0, 1.0, e) / (1.0 + e)
    i, j = np.triu_indices(x.shape[1])
    return np.vstack([y @ w, w.sum(0), (w * loss).sum(0), x.T @ (w * (p - y[:, None])), (x[:, i] * x[:, j]).T @ (w * p * (1.0 - p))])


def _newton_step(beta, g, h, penalty: float):  # noqa: ANN001, ANN202
    """Per replicate the minimum of the quadratic model plus penalty * |beta|, by coordinate descent; returns the step."""
    import numpy as np

    n, i, j = len(beta), *np.triu_indices(len(beta))
    full = np.empty((n, n, beta.shape[1]))
    full[i, j] = full[j, i] = h
    d, slope = np.zeros_like(beta), g.copy()  # slope: of the model at beta + d
    for _ in range(10_000):
        most = 0.0
        for k in range(n):
            a = np.maximum(full[k, k], 1e-12)
            at = beta[k] + d[k] - slope[k] / a
            step = np.sign(at) * np.maximum(np.abs(at) - penalty / a, 0.0) - beta[k] - d[k]
            d[k] += step
            slope += full[k] * step
            most = max(most, np.abs(step).max())
        if most < 1e-10:
            break
    return d


def _lasso_replicates(data: DataFrame, width: int, replicates: int, c: float):  # noqa: ANN202
    """Coefficients, width x replicates with both classes, of |beta| + c * weighted logistic loss; the intercept (last in x) is penalised too, as liblinear does.

    data has seed, y and x. A pass over it gives every replicate's loss, gradient and second derivatives at its own beta; proximal Newton
    steps, halved until the loss falls enough, are taken on the driver. Replicates that are done leave the passes.
    """
    import numpy as np

    size = 3 + width + width * (width + 1) // 2

    def look(ids, at):  # noqa: ANN001, ANN202
        sent = data.sparkSession.sparkContext.broadcast((ids, at))

        def part(batches):  # noqa: ANN001, ANN202
            import pyarrow as pa

            ids, at = sent.value
            total = np.zeros((size, len(ids)))
            for batch in batches:
                x = np.asarray(batch.column("x").flatten()).reshape(-1, width)
                y, seeds = (np.asarray(batch.column(k)) for k in ("y", "seed"))
                for low in range(0, len(y), 1000):
                    cut = slice(low, low + 1000)
                    total += _sums(x[cut], y[cut], _poisson(seeds[cut], ids), at)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        def added(batches):  # noqa: ANN001, ANN202
            import pyarrow as pa

            total = np.zeros(size * len(sent.value[0]))
            for batch in batches:
                for v in batch.column("sums").to_pylist():
                    total += np.frombuffer(v)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        got = data.mapInArrow(part, "sums binary").repartition(8).mapInArrow(added, "sums binary").collect()
        sent.destroy()
        return sum(np.frombuffer(r["sums"]) for r in got).reshape(size, len(ids))

    penalty, ids = 1.0 / c, np.arange(replicates)
    first = look(ids, np.zeros((width, replicates)))
    ids = ids[(first[0] > 0) & (first[0] < first[1])]  # without one of the classes there is nothing to fit
    if not len(ids):
        return np.zeros((width, 0))
    out, now = np.zeros((width, replicates)), first[:, ids]
    usable, beta = ids, np.zeros((width, len(ids)))
    goal, t = now[2].copy(), np.ones(len(ids))
    step = _newton_step(beta, now[3 : 3 + width], now[3 + width :], penalty)
    fell = (now[3 : 3 + width] * step).sum(0) + penalty * (np.abs(beta + step).sum(0) - np.abs(beta).sum(0))
    for _ in range(200):
        done = np.abs(step).max(0) < 1e-7
        out[:, ids[done]] = (beta + step)[:, done]
        ids, beta, step, goal, fell, t = ids[~done], beta[:, ~done], step[:, ~done], goal[~done], fell[~done], t[~done]
        if not len(ids):
            return out[:, usable]
        to = beta + t * step
        now = look(ids, to)
        reached = now[2] + penalty * np.abs(to).sum(0)
        ok = reached <= goal + 1e-4 * t * fell + 1e-12 * np.abs(goal)
        t = np.where(ok, 1.0, t / 2)
        if ok.any():
            beta[:, ok], goal[ok] = to[:, ok], reached[ok]
            g = now[3 : 3 + width, ok]
            step[:, ok] = s = _newton_step(beta[:, ok], g, now[3 + width :, ok], penalty)
            fell[ok] = (g * s).sum(0) + penalty * (np.abs(beta[:, ok] + s).sum(0) - np.abs(beta[:, ok]).sum(0))
    raise RuntimeError(f"{len(ids)} of {replicates} replicates did not converge")


def bootstrap_select(rows: DataFrame, label: str, columns: Sequence[str], key: str, replicates: int = 1000, c: float = 1.0, max_features: int | None = None) -> DataFrame:
    """Per feature the mean, deviation, 95 % interval and coefficient of variation of its L1-logistic coefficient over bootstrap replicates, whether it is selected, and its rank by absolute mean among those.

    Selected: the interval leaves out 0, and the variation is at most q75 + 1.5 IQR of those of such features. Features are z-scores over
    all rows, null is the mean; rows without a label of 0 or 1 go. A replicate weighs each row by Poisson(1) from a hash of the row, so it
    repeats; equal rows are numbered, so each has its own weight. Replicates that lack a class are left out.
    """
    import numpy as np

    from readgrain.operators.stats import impute_mean, normalise
    from readgrain.storage import materialise

    schema = "feature string, mean double, std double, low double, high double, selected boolean, cv double, rank int"
    spark, names = rows.sparkSession, [f"f{i}" for i in range(len(columns))]
    d = rows.select(F.xxhash64(key).alias("seed"), F.col(label).cast("int").alias("y"), *[number(x).alias(n) for x, n in zip(columns, names, strict=True)]).filter("y IN (0, 1)")
    once = d.groupBy("seed", "y", *names).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    plain = materialise(once.select(F.xxhash64("seed", "y", *names, "copy").alias("seed"), "y", *names), "bootstrap")
    n = plain.count()
    if not n:
        return spark.createDataFrame([], schema)
    z = normalise(impute_mean(plain, names), names)
    x = F.array(*names, F.lit(1.0)).alias("x")
    data = materialise(z.select("seed", F.col("y").cast("double").alias("y"), x).repartition(-(-n * replicates // 5_000_000), "seed"), "bootstrap")
    beta = _lasso_replicates(data, len(names) + 1, replicates, c)[:-1]
    if beta.shape[1] < 2:
        return spark.createDataFrame([], schema)
    mean, std = beta.mean(1), beta.std(1, ddof=1)
    low, high = np.percentile(beta, [2.5, 97.5], axis=1)
    cv = np.where(np.abs(mean) > 1e-10, std / np.maximum(np.abs(mean), 1e-10), np.inf)
    sure = ~((low <= 0) & (high >= 0))
    kept = cv[sure & (cv < np.inf)]
    if len(kept):
        q1, q3 = np.percentile(kept, [25, 75])
        sure &= cv <= q3 + 1.5 * (q3 - q1)
    order = sorted(np.flatnonzero(sure & (cv < np.inf)), key=lambda i: (-abs(mean[i]), columns[i]))[:max_features]
    rank = {i: k for k, i in enumerate(order, 1)}
    found = [(f, *[round(float(v[i]), 9) for v in (mean, std, low, high)], i in rank, round(float(cv[i]), 9), rank.get(i)) for i, f in enumerate(columns)]
    return spark.createDataFrame(sorted(found, key=lambda r: (r[-1] or len(columns) + 1, r[0])), schema)
