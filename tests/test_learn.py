"""Bootstrap selection by L1 logistic regressions against plain refits of resampled rows."""

import numpy as np
import pytest

from readgrain.operators import learn


def refit(x, y, c):
    """|beta| + c * logistic loss, by accelerated proximal gradient."""
    rate = 4 / (c * np.linalg.eigvalsh(x.T @ x)[-1])
    beta = ahead = np.zeros(x.shape[1])
    for k in range(3000):
        to = ahead - rate * c * (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y))
        new = np.sign(to) * np.maximum(np.abs(to) - rate, 0)
        ahead, beta, old = new + k / (k + 3) * (new - beta), new, beta
        if np.abs(new - old).max() < 1e-10:
            break
    return beta


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(5)
    a = r.normal(size=300)
    x = np.column_stack([a, a + 0.5 * r.normal(size=300), r.normal(size=300), 40 + 9 * r.normal(size=300)])
    y = (r.random(300) < 1 / (1 + np.exp(-2 * x[:, 0] + 0.15 * (x[:, 3] - 40)))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, points):
    x, y = points
    return spark.createDataFrame([(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x, strict=True))], "id long, y int, a double, b double, z double, d double")


def test_replicates_are_refits(spark, points, frame):
    x, y = points
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    seeds = np.arange(300, dtype=np.int64) * 7919
    data = spark.createDataFrame([(int(s), float(k), list(map(float, v))) for s, k, v in zip(seeds, y, z, strict=True)], "seed long, y double, x array<double>")
    got = learn._lasso_replicates(data, 5, 6, 0.1)
    w = learn._poisson(seeds, np.arange(6)).astype(int)
    for i in range(6):
        rows = np.repeat(np.arange(300), w[:, i])
        assert np.allclose(got[:, i], refit(z[rows], y[rows], 0.1), atol=1e-6)
    many = learn._poisson(np.arange(2000, dtype=np.int64), np.arange(500))
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.01 and abs(np.corrcoef(many[:, :2].T)[0, 1]) < 0.1


def test_bootstrap_select(frame, points):
    x, y = points
    rows = learn.bootstrap_select(frame, "y", ["a", "b", "z", "d"], "id", c=0.1).collect()
    got = {r["feature"]: r for r in rows}
    assert {f for f, r in got.items() if r["selected"]} == {"a", "d"}  # b says nothing beside a
    assert [(r["feature"], r["rank"]) for r in rows[:2]] == [("a", 1), ("d", 2)] and got["b"]["rank"] is None
    z, r = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))]), np.random.default_rng(1)
    want = np.array([refit(z[k], y[k], 0.1) for k in (r.integers(0, 300, 300) for _ in range(200))])
    for i, f in enumerate("abzd"):
        assert abs(got[f]["mean"] - want[:, i].mean()) < 0.05 and abs(got[f]["std"] - want[:, i].std(ddof=1)) < 0.04
    assert [r.asDict() for r in learn.bootstrap_select(frame.repartition(3), "y", ["a", "b", "z", "d"], "id", c=0.1, max_features=1).collect() if r["selected"]] == [rows[0].asDict()]


def test_bootstrap_odd(spark, frame):
    one = frame.limit(1)
    assert learn.bootstrap_select(frame.limit(0), "y", ["a"], "id").count() == learn.bootstrap_select(one, "y", ["a"], "id").count() == 0
    twice = spark.createDataFrame([(1, i % 2, float(i % 2), None) for i in range(40)] + [(None, None, 1.0, 2.0)], "id long, y int, a double, n double")
    got = {r["feature"]: r for r in learn.bootstrap_select(twice, "y", ["a", "n"], "id", replicates=100).collect()}
    assert got["a"]["selected"] and got["a"]["std"] > 0 and not got["n"]["selected"] and got["n"]["mean"] == 0
