"""The task grid: leakage, optimality, agreement with a direct fit on the whole matrix."""

import numpy as np
import pytest

from cohortspark.functions import kernels as NK
from cohortspark.operators import grid as M

N, K = 14, 30
S = M.Settings(top=12, alphas=8)


def data(seed=0):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((N, K)) < 0.3, 0, np.abs(rng.normal(1, 1, (N, K))))
    sev = rng.normal(size=N)
    y = 3 * x[:, 0] - 2 * x[:, 1] + sev + 0.1 * rng.normal(size=N)
    return x, y, sev


def frames(spark, x, y, sev):
    xd = spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j])) for i in range(N) for j in range(K) if x[i, j]], "u int, f string, v double")
    ud = spark.createDataFrame([(i, float(y[i]), float(sev[i])) for i in range(N)], "u int, y double, sev double")
    return M.feature_rows(xd, "u", "f", "v"), M.unit_table(ud, "u", "u", ["y"], ["sev"])


def direct(x, y, sev, i):
    """Whole-matrix version of one fold."""
    tr = np.arange(N) != i
    z = np.c_[np.ones(N), sev]
    bx = np.linalg.lstsq(z[tr], x[tr], rcond=None)[0]
    by = np.linalg.lstsq(z[tr], y[tr], rcond=None)[0]
    xr, yr = x - z @ bx, y - z @ by
    sel = np.argsort(-xr[tr].var(0), kind="stable")[:S.top]
    m, s = xr[tr][:, sel].mean(0), xr[tr][:, sel].std(0)
    a = (xr[:, sel] - m) / s
    at, yt = a[tr], yr[tr]
    n = len(yt)
    top = np.abs(at.T @ (yt - yt.mean())).max() / (n * S.l1)
    alphas = (top * np.geomspace(1, 1e-3, S.alphas))[:, None]
    mse = np.zeros(S.alphas)
    for b in np.array_split(np.arange(n), S.inner):
        k = np.setdiff1d(np.arange(n), b)
        mx, my = at[k].mean(0), yt[k].mean()
        w = NK.enet_path((at[k] - mx).T @ (at[k] - mx), ((at[k] - mx).T @ (yt[k] - my))[:, None], len(k), alphas)
        for j in range(S.alphas):
            mse[j] += ((yt[b] - my - (at[b] - mx) @ w[j, :, 0]) ** 2).mean()
    best = mse.argmin()
    mx = at.mean(0)
    w = NK.enet_path((at - mx).T @ (at - mx), ((at - mx).T @ (yt - yt.mean()))[:, None], n, alphas[:best + 1])[-1][:, 0]
    return (a[i] - mx) @ w + yt.mean()


def test_optimality():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 40))
    y = x[:, 0] - x[:, 3] + 0.2 * rng.normal(size=20)
    x, y = x - x.mean(0), y - y.mean()
    g, c = x.T @ x, (x.T @ y)[:, None]
    alphas = NK.alpha_grid(c, 20, 0.5, 15)
    for a, w in zip(alphas[:, 0], NK.enet_path(g, c, 20, alphas)[:, :, 0]):
        grad = (c[:, 0] - g @ w) / 20 - a * 0.5 * w
        on = w != 0
        assert np.all(np.abs(grad[~on]) <= a * 0.5 + 1e-6)
        assert np.allclose(grad[on], a * 0.5 * np.sign(w[on]), atol=1e-6)


def test_matches_whole_matrix_and_does_not_leak(spark):
    x, y, sev = data()
    got = {r.unit: r.pred for r in M.leave_out_regression(*frames(spark, x, y, sev), S)[0].collect()}
    assert len(got) == N
    for i in (0, 5, 13):
        assert got[i] == pytest.approx(direct(x, y, sev, i), abs=1e-6)
    y2 = y.copy()
    y2[5] += 1000
    again = {r.unit: r.pred for r in M.leave_out_regression(*frames(spark, x, y2, sev), S)[0].collect()}
    assert again[5] == pytest.approx(got[5], abs=1e-9)
    assert abs(again[0] - got[0]) > 1e-3


def test_chunks_do_not_change_the_fit(spark):
    x, y, sev = data(3)
    a = {r.unit: r.pred for r in M.leave_out_regression(*frames(spark, x, y, sev), S)[0].collect()}
    small = M.Settings(top=12, alphas=8, chunk=3)
    b = {r.unit: r.pred for r in M.leave_out_regression(*frames(spark, x, y, sev), small)[0].collect()}
    assert all(a[u] == pytest.approx(b[u], abs=1e-7) for u in a)


def test_logistic_converges():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=50) > 0).astype(float)
    w = NK.logistic(x, y)
    a = np.c_[np.ones(50), x]
    g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + np.r_[0, w[1:]]
    assert np.abs(g).max() < 1e-5


def test_thinning_adds_up(spark):
    d = spark.createDataFrame([(i, 5 * i + 1) for i in range(40)], "k int, cnt long")
    t = M.thin_counts(d, ["k"]).collect()
    assert len(t) == 40 and all(0 <= r.half_a <= r.cnt and r.half_a + r.half_b == r.cnt for r in t)
    assert abs(sum(r.half_a for r in t) / sum(r.cnt for r in t) - 0.5) < 0.05


def test_thinning_keeps_rows_apart(spark):
    """Every row is thinned by itself, bit by bit as the hashed words say; a row that comes twice comes twice."""
    import hashlib
    counts = [(None, 7), (1, 1), (1, 32), (1, 33), (2, 100), (2, 100), (3, None)]
    d = M.thin_counts(spark.createDataFrame(counts, "k int, cnt long"), ["k"])
    want = []
    for k, n in counts[:-1]:
        text = [("" if k is None else f"{k}|") + f"{w}|0" for w in range((n - 1) // 32 + 1)]
        bits = [int(hashlib.md5(v.encode()).hexdigest()[:8], 16) & ((1 << min(32, n - 32 * w)) - 1) for w, v in enumerate(text)]
        half = sum(b.bit_count() for b in bits)
        want.append((str(k), n, half, n - half))
    assert sorted((str(r.k), r.cnt, r.half_a, r.half_b) for r in d.collect()) == sorted(want)


def test_covariate_variants_share_their_rows(spark, monkeypatch):
    """The three variants read one written table of feature rows; their pseudobulk is not computed anew."""
    from cohortspark.plans import q_models as Q
    from cohortspark.plans.registry import REGISTRY
    made, read = [], []
    rows = spark.createDataFrame([("all", 1, "g", 1.0)], "fset string, unit long, feature string, value double")
    scores = spark.createDataFrame([("all", 0, 0.5)], "task string, target int, rho double")
    monkeypatch.setattr(Q, "xs", lambda t: made.append(t) or rows)
    monkeypatch.setattr(Q, "us", lambda t, cov: cov)
    monkeypatch.setattr(Q.M, "leave_out_regression", lambda x, u, s: read.append((x, u)) or (None, None))
    monkeypatch.setattr(Q.M, "fold_scores", lambda p, u, c: scores)
    out = REGISTRY["m23_covariate_variants"].run(None).collect()
    assert len(made) == 1 and {r.variant for r in out} == {"none", "terminal", "cumulative"}
    assert [u for _, u in read] == [(), ("score",), ("score", "n_cells")]
    assert len({x._cut_path for x, _ in read}) == 1 and read[0][0].collect() == rows.collect()


def test_clock_table_gives_the_held_out_predictions(spark):
    """Scoring the held-out units from the written fit equals the predictions made inside the fit, on both scales."""
    import numpy as np
    from cohortspark.operators import grid as M
    r = np.random.default_rng(11)
    n, k = 24, 12
    m = np.where(r.random((n, k)) < 0.3, 0.0, r.gamma(2.0, 1.0, (n, k)))
    sev = r.normal(size=n)
    day = m[:, 0] * 2 + sev + r.normal(size=n) * 0.2
    u = spark.createDataFrame([(int(i), float(day[i]), float(sev[i])) for i in range(n)], "u long, day double, sev double")
    x = spark.createDataFrame([(int(i), f"g{j}", float(m[i, j])) for i in range(n) for j in range(k) if m[i, j]], "u long, g string, v double")
    rows, units = M.feature_rows(x, "u", "g", "v"), M.unit_table(u, "u", "u", ["day"], ["sev"])
    clock, preds = M.fit_clock(rows, units, M.Settings(top=8, alphas=20))
    samples = u.selectExpr("'all' AS task", "cast(u AS string) AS fold", "u AS unit", "array(sev) AS c")
    got = {g["unit"]: g for g in clock.score(rows, samples).collect()}
    for p in preds.collect():
        assert abs(got[p["unit"]]["pred_residual"] - p["pred"]) < 1e-6
        # the day scale adds the target's own line, so the residual of the truth is the same on both
        assert abs((day[p["unit"]] - got[p["unit"]]["pred_day"]) - (p["observed"] - p["pred"])) < 1e-6


def test_kept_features_are_extra(spark):
    import numpy as np
    from cohortspark.operators import grid as M
    r = np.random.default_rng(3)
    x = spark.createDataFrame([(i, f"g{j}", float(r.gamma(2.0) * (j + 1))) for i in range(12) for j in range(10)], "u long, g string, v double")
    u = spark.createDataFrame([(i, float(r.normal())) for i in range(12)], "u long, day double")
    keep = spark.createDataFrame([("g0",), ("g1",), ("g2",)], "feature string")
    units = M.unit_table(u, "u", "u", ["day"])
    sel = M.screen(M.feature_rows(x, "u", "g", "v"), units, M._folds(units, False), M.Settings(top=3), keep).collect()
    for f in {s["fold"] for s in sel}:
        own = {s["feature"]: s["pos"] for s in sel if s["fold"] == f}
        assert len(own) == 6 and {"g0", "g1", "g2"} <= set(own) and sorted(own.values()) == list(range(6))


def problem(n=22, k=60, targets=25, seed=4):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, k)) < 0.3, 0, np.abs(rng.normal(1, 1, (n, k))))
    c = rng.normal(size=(n, 2))
    y = rng.normal(size=(n, targets)) + x[:, :1] + c[:, :1]
    return [np.concatenate([np.ones((n, 1)), c, x, y], 1)[b] for b in np.array_split(np.arange(n), 5)]


@pytest.mark.parametrize("share", [None, 0.6])
def test_batch_of_targets_equals_single_fits(share):
    """All targets solved together in the space of the rows against 25 fits one by one from cross-products."""
    parts = problem()
    t, w, b0, alpha = NK.enet_cv_rows(parts, 2, 60, 0.5, 30, share)
    for j in range(25):
        cols = np.r_[0:63, 63 + j]
        t1, w1, b1, a1 = NK.enet_cv([b[:, cols].T @ b[:, cols] for b in parts], 2, 60, 0.5, 30, share)
        assert np.abs(w[:, j] - w1[:, 0]).max() < 1e-6 and abs(b0[j] - b1[0]) < 1e-6 and alpha[j] == pytest.approx(a1[0], rel=1e-9)
        assert np.allclose(t[:, 1:61][:63], t1[:, 1:61][:63], atol=1e-9)


def test_batch_of_sets_equals_single_fits():
    parts = problem(targets=1)
    rng = np.random.default_rng(0)
    sets = np.array([np.sort(rng.choice(60, 9, replace=False)) for _ in range(12)])
    _, w, b0, alpha = NK.enet_cv_sets(parts, 2, 60, sets, 0.5, 30, None)
    for i, one in enumerate(sets):
        cols = np.r_[0:3, 3 + one, 63]
        _, w1, b1, a1 = NK.enet_cv([b[:, cols].T @ b[:, cols] for b in parts], 2, 9, 0.5, 30, None)
        assert np.abs(w[i] - w1[:, 0]).max() < 1e-6 and abs(b0[i] - b1[0]) < 1e-6 and alpha[i] == pytest.approx(a1[0], rel=1e-9)


@pytest.mark.parametrize("l1", [0.5, 1.0])
def test_sets_on_the_grid_equal_their_own_grid(spark, l1):
    """Both solvers: rows, and cross-products (a fit without a ridge part has no dual)."""
    x, y, sev = data(8)
    xr, u = frames(spark, x, y, sev)
    sets = spark.createDataFrame([(s, f"f{j:02d}") for s, own in enumerate([(0, 1, 5, 9), (2, 3, 4, 7), (11, 12, 20)]) for j in own], "set_no int, feature string")
    s = M.Settings(alphas=8, l1=l1)
    got = {(r.task, r.unit): (r.pred, r.n_nonzero) for r in M.leave_out_sets(xr, u, sets, s).collect()}
    assert len(got) == 3 * N
    one = sets.where("set_no = 1").select("feature")
    for r in M.leave_out_regression(xr.join(one, "feature", "left_semi"), u, s)[0].collect():
        assert got["1", r.unit][0] == pytest.approx(r.pred, abs=1e-6)


def test_matched_sets_keep_bins_and_fill_up(spark):
    genes = spark.createDataFrame([(i, float(i % 7) + i / 100, (i % 3) / 3) for i in range(60)], "gene_id long, mean double, detected double")
    focus = spark.createDataFrame([(i,) for i in (0, 1, 2, 10, 20, 30)], "gene_id long")
    binned = M.joint_bins(genes, 3, 2)
    bins = {r.gene_id: r.bin for r in binned.collect()}
    assert set(bins.values()) <= set(range(6)) and len(bins) == 60
    import collections
    sets = collections.defaultdict(list)
    for r in M.matched_sets(binned, focus, 20).collect():
        sets[r.set_no].append(r.gene_id)
    need = collections.Counter(bins[g] for g in sets[0])
    assert all(len(v) == len(set(v)) == 6 for v in sets.values()) and len(sets) == 21
    assert all(collections.Counter(bins[g] for g in v) == need and not set(v) & set(sets[0]) for k, v in sets.items() if k)
    # bins of one gene each cannot be matched: the sets still have their size
    alone = genes.withColumn("bin", __import__("pyspark.sql.functions", fromlist=["col"]).col("gene_id").cast("int"))
    filled = M.matched_sets(alone, focus, 3).groupBy("set_no").count().collect()
    assert {r["count"] for r in filled} == {6}


def test_in_fold_axis_does_not_see_the_held_out_unit(spark):
    x, y, sev = data(6)
    _, u = frames(spark, x, y, sev)
    u = u.withColumn("c", __import__("pyspark.sql.functions", fromlist=["x"]).expr("cast(array() as array<double>)"))

    def axis(m):
        d = spark.createDataFrame([(i, f"f{j}", float(m[i, j])) for i in range(N) for j in range(5) if m[i, j]], "u int, f string, v double")
        return {(r.fold, r.unit): (r.axis, r.held) for r in M.in_fold_axis(M.feature_rows(d, "u", "f", "v"), u, "f0", S).collect()}
    base = axis(x)
    assert len(base) == N * N and all(held == (f == str(i)) for (f, i), (_, held) in base.items())
    x2 = x.copy()
    x2[5, :5] += 50
    again = axis(x2)
    for i in range(N):
        if i != 5:
            assert again["5", i][0] == pytest.approx(base["5", i][0], abs=1e-9)      # fold 5 was fitted without unit 5
    assert abs(again["3", 0][0] - base["3", 0][0]) > 1e-3
    for f in range(N):
        tr = [i for i in range(N) if i != f]
        z = (x[:, :5] - x[tr, :5].mean(0)) / x[tr, :5].std(0)
        vec = np.linalg.svd(z[tr], full_matrices=False)[2][0]
        want = z @ vec / (z[tr] @ vec).std()
        want *= np.sign(np.cov(want[tr], x[tr, 0])[0, 1])
        assert np.allclose([base[str(f), i][0] for i in range(N)], want, atol=1e-8)


def test_in_fold_axis_is_a_written_table(spark):
    """Who joins the axis reads its rows; the family, its anchor and the components are not computed again."""
    x, y, sev = data(6)
    _, u = frames(spark, x, y, sev)
    u = u.withColumn("c", __import__("pyspark.sql.functions", fromlist=["x"]).expr("cast(array() as array<double>)"))
    d = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(N) for j in range(5) if x[i, j]], "u int, f string, v double")
    a = M.in_fold_axis(M.feature_rows(d, "u", "f", "v"), u, "f0", S)
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and a.count() == N * N


def test_map_of_many_features_stays_thin():
    """The map of a fold holds a line and a scale for each feature, not a square matrix (4,000 features: 128 MB); both ways of products agree."""
    import tracemalloc
    parts = problem(n=12, k=4000, targets=1)
    tracemalloc.start()
    t, w, b0, _ = NK.enet_cv_rows(parts, 2, 4000, 0.5, 5, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    rows = np.concatenate(parts)
    assert np.allclose(t.apply(rows)[:, 1:4001].std(0), 1.0) and np.isfinite(w).all()
    lead = NK.leading_scores_rows(parts, 2, 4000, None, 3)
    assert np.allclose((rows[:, :4003] @ lead).mean(0), 0, atol=1e-8)


def test_products_of_rows_on_demand_give_the_same_fit(monkeypatch):
    parts = problem()
    _, w, b0, alpha = NK.enet_cv_rows(parts, 2, 60, 0.5, 10, None)
    sets = np.arange(60).reshape(6, 10)
    _, ws, _, _ = NK.enet_cv_sets(parts, 2, 60, sets, 0.5, 10, None)
    monkeypatch.setattr(NK, "PAIR_VALUES", 0)
    monkeypatch.setattr(NK, "SET_VALUES", 1)
    _, w1, b1, a1 = NK.enet_cv_rows(parts, 2, 60, 0.5, 10, None)
    assert np.allclose(w, w1, atol=1e-7) and np.allclose(b0, b1, atol=1e-7) and np.allclose(alpha, a1)
    assert np.allclose(ws, NK.enet_cv_sets(parts, 2, 60, sets, 0.5, 10, None)[1], atol=1e-7)


def test_screening_hands_on_few_rows_whatever_the_tasks():
    """A bucket gives at most ``top`` features of a fold besides kept ones, equal variances by name; slabs do not change them."""
    import pandas as pd
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 1.0, (300, 9))
    x[50:200] = x[50]                                        # half of the features vary alike
    vals = pd.DataFrame([(u, f"g{j:03d}", x[j, u], j == 299) for j in range(300) for u in range(9)], columns=["unit", "feature", "value", "_keep"])
    plan = pd.DataFrame([(t, u, str(u), [float(u % 4)], False) for t in ("a", "b") for u in range(9) if t == "a" or u != 3], columns=["task", "unit", "fold", "c", "_fold"])
    plan = pd.concat([plan, plan.assign(unit=None, c=None, _fold=True)])

    def variance(j, tr):
        c = np.c_[np.ones(len(tr)), np.array(tr) % 4]
        return (x[j, tr] - c @ np.linalg.lstsq(c, x[j, tr], rcond=None)[0]).var()
    whole = pd.concat(M._adjusted_variances(vals, plan, 1, None, 20))
    for (task, fold), g in whole.groupby(["task", "fold"]):
        tr = [u for u in range(9) if u != int(fold) and (task == "a" or u != 3)]
        want = sorted(range(299), key=lambda j: (-round(variance(j, tr), 9), j))[:20]
        assert {f"g{j:03d}" for j in want} | {"g299"} == set(g["feature"]) and len(g) == 21
    old = M.SLAB_VALUES, M.FOLD_SLAB
    try:
        M.SLAB_VALUES, M.FOLD_SLAB = 9 * 40, 2
        small = pd.concat(M._adjusted_variances(vals, plan, 1, None, 20))
    finally:
        M.SLAB_VALUES, M.FOLD_SLAB = old
    both = whole.merge(small, on=["task", "fold", "feature"], how="left")
    assert np.allclose(both["var_x"], both["var_y"])


def test_screening_keeps_nulls_apart_from_what_is_no_number():
    """Values that are no number make a feature's variance no number in the tasks that hold their unit, and nowhere else."""
    import pandas as pd
    rng = np.random.default_rng(6)
    x = rng.gamma(2.0, 1.0, (30, 8))
    x[4, 7] = np.nan
    vals = pd.DataFrame([(u, f"g{j:02d}" if j != 9 else None, x[j, u], False) for j in range(30) for u in range(8)], columns=["unit", "feature", "value", "_keep"])
    plan = pd.DataFrame([(t, u, str(u), [], False) for t in ("a", "b") for u in range(8) if t == "a" or u != 7], columns=["task", "unit", "fold", "c", "_fold"])
    got = pd.concat(M._adjusted_variances(vals, pd.concat([plan, plan.assign(unit=None, c=None, _fold=True)]), 0, None, 40))
    odd = got[got["var"].isna()]
    assert set(odd["task"]) == {"a"} and set(odd["feature"]) == {"g04"} and len(odd) == 8
    plain = got[(got["task"] == "b") & (got["fold"] == "2") & (got["feature"] == "g03")]["var"].iloc[0]
    assert plain == pytest.approx(x[3, [0, 1, 3, 4, 5, 6]].var())


def test_small_feature_set_beside_a_large_one(spark, monkeypatch):
    """Buckets are made for the largest feature set; those that a small set leaves empty (its units meet no feature) give no rows and no error."""
    x, y, sev = data(3)
    xd, u = frames(spark, x, y, sev)
    both = xd.unionByName(xd.where("feature = 'f00'").selectExpr("'one' AS fset", "unit", "feature", "value"))
    units = u.unionByName(u.selectExpr("'one' AS task", "'one' AS fset", "unit", "fold", "y", "c"))
    chosen = lambda: {tuple(r) for r in M.screen(both, units, M._folds(units, False), S, None).collect()}
    whole = chosen()
    monkeypatch.setattr(M, "SCREEN_ROWS", 20)
    assert chosen() == whole and sum(r[0] == "one" for r in whole) == N


def test_sets_meet_leading_features_only(monkeypatch):
    """A set's fit takes the features that can be active, and goes on with those it missed; either way it is the fit over all of its features."""
    parts = problem()
    sets = np.stack([np.random.default_rng(i).permutation(60)[:40] for i in range(5)])
    _, w, b0, alpha = NK.enet_cv_sets(parts, 2, 60, sets, 0.5, 10, None)
    whole, met, fit = NK.dual_fit, [], NK.dual_fit
    monkeypatch.setattr(NK, "dual_fit", lambda cols, *rest: met.append(cols.k) or fit(cols, *rest))
    seen = []
    for near in (0.98, 50.0):                                # 50: nothing looks near, so the features are found by what was missed
        monkeypatch.setattr(NK, "NEAR", near)
        met.clear()
        _, w1, b1, a1 = NK.enet_cv_sets(parts, 2, 60, sets, 0.5, 10, None)
        assert np.allclose(w, w1, atol=1e-8) and np.allclose(b0, b1, atol=1e-8) and np.allclose(alpha, a1)
        seen.append((len(met), min(met), sum(met) / len(met)))
    assert seen[0][2] < 30 and seen[1][1] == 1 and seen[1][0] > seen[0][0]
    monkeypatch.setattr(NK, "dual_fit", whole)
    monkeypatch.setattr(NK, "_leading_fit", lambda cols, y, pen, ridge, start, z, least: (
        lambda t, c: (t, c, cols.cross(t, np.arange(len(y)))))(*whole(cols, y, pen, ridge, start)))
    _, w2, b2, a2 = NK.enet_cv_sets(parts, 2, 60, sets, 0.5, 10, None)
    assert np.allclose(w, w2, atol=1e-8) and np.allclose(b0, b2, atol=1e-8) and np.allclose(alpha, a2)


def test_draws_above_a_hash_cut_are_not_sorted(spark):
    """A large bin sorts few of its hashes, a draw is the first by hash all the same; copies of one gene, which stand or fall together, are drawn whole."""
    import hashlib
    focus = spark.createDataFrame([(g,) for g in range(4)], "gene_id int")
    genes = spark.createDataFrame([(g, g % 2) for g in range(900)], "gene_id int, bin int")
    got = {}
    for r in M.matched_sets(genes, focus, 6).collect():
        got.setdefault(r.set_no, set()).add(r.gene_id)
    for k in range(1, 7):
        order = sorted(range(4, 900), key=lambda g: hashlib.md5(f"{g}|{k}|0".encode()).hexdigest())
        assert got[k] == {g for b in (0, 1) for g in [g for g in order if g % 2 == b][:2]}
    # five genes, each 400 times: a cut may leave a set none of them, so all are sorted
    copies = spark.createDataFrame([(g, 0) for g in range(4)] + [(10 + g, 0) for g in range(5) for _ in range(400)], "gene_id int, bin int")
    sets = M.matched_sets(copies, focus, 30).groupBy("set_no").count().collect()
    assert len(sets) == 31 and {r["count"] for r in sets} == {4}
