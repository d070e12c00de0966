"""Classifiers from aggregates against plain versions on all rows."""

import numpy as np
import pytest

from cohortspark.functions import kernels as NK
from cohortspark.operators import classify as K


def table(spark, n=90, d=4, targets=3, seed=1, folds=2):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, d))
    y = (z[:, :targets] + 0.7 * rng.normal(size=(n, targets)) > 0).astype(float)
    y[:, -1] = 0.0                                                  # a label that never occurs
    rows = [("t", str(f), i, -1 if i % folds == f else 0, y[i].tolist(), z[i].tolist()) for f in range(folds) for i in range(n)]
    return spark.createDataFrame(rows, "task string, fold string, unit int, block int, y array<double>, score array<double>"), z, y


@pytest.mark.parametrize("chunk", [4096, 7])
def test_logistic_equals_a_plain_fit(spark, chunk, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", chunk)
    df, z, y = table(spark)
    fits = K.logistic_fits(df, 3, strength=0.5)
    got = {(r.fold, r.target, r.unit): r.prob for r in K.held_out_probabilities(df, fits, 3).collect()}
    assert len(got) == 3 * 90
    for f in range(2):
        tr, te = np.arange(90) % 2 != f, np.flatnonzero(np.arange(90) % 2 == f)
        for j in range(2):
            w = NK.logistic(z[tr], y[tr, j], 0.5)
            for i in te:
                assert got[str(f), j, i] == pytest.approx(1 / (1 + np.exp(-(w[0] + z[i] @ w[1:]))), abs=1e-6)
    assert max(p for (_, j, _), p in got.items() if j == 2) < 1e-12


def plain_trees(z, y, train, rounds, depth, rate=0.3, bins=32, least=5, ridge=1.0):
    b = np.minimum(bins - 1, np.floor(bins / (1 + np.exp(-1.702 * z)))).astype(int)
    m = np.clip(y[train].mean(), 1e-6, 1 - 1e-6)
    f = np.full(len(y), np.log(m / (1 - m)))
    for _ in range(rounds):
        node = np.ones(len(y), int)
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        for _ in range(depth):
            new = node * 2
            for k in np.unique(node):
                own = train & (node == k)
                best = None
                for c in range(z.shape[1]):
                    for cutp in range(bins):
                        left = own & (b[:, c] <= cutp)
                        right = own & (b[:, c] > cutp)
                        if left.sum() < least or right.sum() < least or not (own & (b[:, c] == cutp)).any():
                            continue
                        s = lambda w: g[w].sum() ** 2 / (h[w].sum() + ridge)
                        gain = round(s(left) + s(right) - s(own), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, c, cutp)
                if best:
                    new[(node == k) & (b[:, best[1]] > best[2])] += 1
            node = new
        for k in np.unique(node):
            own = train & (node == k)
            f[node == k] += rate * g[own].sum() / (h[own].sum() + ridge) if own.any() else 0.0
    return 1 / (1 + np.exp(-f))


def test_trees_equal_a_plain_version(spark):
    df, z, y = table(spark, n=80, d=3, targets=2, seed=5)
    got = {(r.fold, r.target, r.unit): r.prob for r in K.boosted_trees(df, 2, rounds=2, depth=2).collect()}
    assert len(got) == 2 * 80
    for f in range(2):
        train = np.arange(80) % 2 != f
        want = plain_trees(z, y[:, 0], train, 2, 2)
        for i in np.flatnonzero(~train):
            assert got[str(f), 0, i] == pytest.approx(want[i], abs=1e-9)


def test_balanced_accuracy_and_null(spark):
    rows = [("t", 0, 0, 0.9, 1.0), ("t", 0, 1, 0.1, 0.0), ("t", 1, 0, 0.2, 0.0), ("t", 1, 1, 0.7, 1.0), ("t", 2, 0, 0.6, 0.0), ("t", 2, 1, 0.3, 1.0)]
    d = spark.createDataFrame([(t, k, u, p, y) for t, u, k, p, y in rows], "task string, target int, unit int, prob double, truth double")
    r = K.balanced_accuracy(d, 2).collect()
    assert [(x.task, x.rep, x.n, x.classes, x.balanced_accuracy) for x in r] == [("t", 0, 3, 2, 0.75)]
    n = spark.createDataFrame([("t", i, v) for i, v in enumerate([0.5, 0.4, 0.5, 0.6])], "task string, rep int, s double")
    assert K.draw_null(n, "s").first().p == pytest.approx(0.75)


def test_empty_tables(spark):
    df, _, _ = table(spark)
    none = df.where("false")
    assert K.held_out_probabilities(none, K.logistic_fits(none, 3), 3).collect() == [] and K.boosted_trees(none, 3, rounds=1, depth=1).collect() == []
