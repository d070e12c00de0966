"""Ranks, tails and contrasts against hand-worked or brute-force values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import ordering as O
from cohortspark.functions import special as SP
from cohortspark.operators import association as A
from cohortspark.operators import contrast as K
from cohortspark.operators import counts as C
from cohortspark.operators import resample as R


def test_bh_ties_and_bounds(spark):
    p = [0.0, 0.01, 0.01, 0.04, 0.5, 1.0, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r.i: r.q for r in O.bh_adjust(df).collect()}
    want = np.minimum.accumulate((np.array(p) * 7 / np.arange(1, 8))[::-1])[::-1]
    assert all(math.isclose(got[i], min(1, want[i]), abs_tol=1e-12) for i in range(7))
    one = O.bh_adjust(spark.createDataFrame([(0.3,)], "p double")).first()
    assert one.q == 0.3


def test_large_midrank_equals_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), np.round(rng.normal(size=500), 1))]
    df = spark.createDataFrame(rows, "g int, v double")
    a = df.withColumn("r", O.midrank("v", ["g"])).groupBy("g", "v").agg(F.max("r").alias("r"))
    b = O.large_midrank(df, "v", ["g"], "r").groupBy("g", "v").agg(F.max("r").alias("r"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_exact_quantiles(spark):
    v = [1.0, 2.0, 2.0, 5.0, -3.0, 1e9]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    r = O.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 1.0), ("a", "b", "c", "d")).first()
    assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(v, [0, 0.25, 0.5, 1]))


def test_tails():
    assert math.isclose(SP.t_tail([2.0], [10])[0], 0.07338803477074037, rel_tol=1e-9)
    assert math.isclose(SP.normal_tail([1.959963984540054])[0], 0.05, rel_tol=1e-9)
    assert math.isclose(SP.chi2_tail([3.841458820694124], [1])[0], 0.05, rel_tol=1e-9)
    assert math.isclose(SP.binomial_sign([2], [10])[0], 0.109375, rel_tol=1e-9)
    assert math.isclose(SP.mann_whitney_exact(0, 3, 3), 0.1, rel_tol=1e-9)


def units(spark, n=12):
    rng = np.random.default_rng(0)
    rows = [(f"u{i:02d}", float(i // 2), float(rng.normal()), "AB"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "u string, day double, score double, g string"), rows


def test_sparse_spearman_counts_zeros(spark):
    u, rows = units(spark)
    vals = {"x": [0, 0, 1, 3, 0, 2, 2, 5, 0, 1, 4, 4], "flat": [0] * 12, "same": [2] * 12}
    x = spark.createDataFrame([(f, r[0], float(v)) for f, vs in vals.items() for r, v in zip(rows, vs) if v],
                              "f string, u string, value double")
    got = {r.f: r.rho for r in A.spearman_trend(x, u, "f", "u", "day", fdr=False).collect()}

    def rank(a):
        a = np.asarray(a, float)
        return np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    assert set(got) == {"x"}
    assert math.isclose(got["x"], np.corrcoef(rank(vals["x"]), rank([r[1] for r in rows]))[0, 1], abs_tol=1e-12)


def test_interaction_equals_ols(spark):
    u, rows = units(spark)
    rng = np.random.default_rng(3)
    y = np.abs(rng.normal(size=12)) + 0.1
    x = spark.createDataFrame([("f", r[0], float(v)) for r, v in zip(rows, y)], "f string, u string, value double")
    got = A.slope_interaction(x, u, "f", "u", "score", "g", ("A", "B")).first()
    s, m = np.array([r[2] for r in rows]), np.array([r[3] == "B" for r in rows], float)
    d = np.c_[np.ones(12), s - s.mean(), m, (s - s.mean()) * m]
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    sigma = ((y - d @ beta) ** 2).sum() / 8
    se = math.sqrt(np.linalg.inv(d.T @ d)[3, 3] * sigma)
    assert math.isclose(got.interaction, beta[3], abs_tol=1e-10) and math.isclose(got.se, se, rel_tol=1e-9)


def test_did_of_known_groups(spark):
    rows = [("a1", "e0"), ("a2", "e0"), ("b1", "l0"), ("b2", "l0"), ("c1", "e1"), ("c2", "e1"), ("d1", "l1"), ("d2", "l1")]
    u = spark.createDataFrame(rows, "u string, g string")
    v = {"a1": 1, "a2": 2, "b1": 3, "b2": 2, "c1": 1, "c2": 0, "d1": 5, "d2": 6}
    x = spark.createDataFrame([("f", k, float(w)) for k, w in v.items() if w], "f string, u string, value double")
    r = K.difference_in_differences(x, u, "f", "u", "g", ["e0", "l0", "e1", "l1"]).first()
    assert (r.delta_a, r.delta_b, r.did) == (1.0, 5.0, 4.0)


def test_shift_share_adds_up(spark):
    fr = spark.createDataFrame([("a", "T", 0.5), ("a", "S", 0.5), ("b", "T", 1.0)], "u string, k string, fraction double")
    ex = spark.createDataFrame([("a", "T", "g", 1.0), ("a", "S", "g", 3.0), ("b", "T", "g", 2.0)], "u string, k string, f string, value double")
    un = spark.createDataFrame([("a", -1.0), ("b", 1.0)], "u string, d double")
    r = K.shift_share(fr, ex, un, "u", "k", "f", "d").first()
    assert math.isclose(r.cov_total, (2.0 - (0.5 + 1.5)) / 2)
    assert math.isclose(r.cov_total, r.cov_comp + r.cov_intr + r.cov_inter)
    assert math.isclose(r.cov_comp, (1.5 - (0.75 + 1.5)) / 2)


def test_permutation_keeps_labels(spark):
    u, _ = units(spark)
    p = R.permuted_labels(u, "u", "score", 3, within=["g"])
    want = sorted(r.score for r in u.where("g = 'A'").collect())
    for rep in range(3):
        assert sorted(r.score for r in p.where(f"rep = {rep} and g = 'A'").collect()) == want
    again = R.permuted_labels(u.repartition(7), "u", "score", 3, within=["g"])
    assert p.exceptAll(again).count() == 0


def test_hash_positions_are_a_permutation(spark):
    d = R.hash_positions(spark.range(1000), ["id"], 2)
    assert [r.pos for r in d.where("rep = 1").orderBy("pos").collect()] == list(range(1000))


def test_dominance_counts_equal_brute_force(spark):
    """Ties in both coordinates, one value of x that a third of the points share, several strip sizes."""
    import numpy as np
    from cohortspark.operators import association as A
    r = np.random.default_rng(3)
    n = 400
    x = np.where(r.random(n) < 0.33, 0.5, np.round(r.normal(size=n), 1))
    y = np.round(r.normal(size=n), 1)
    w = r.integers(1, 4, n)
    asks = [(i, float(r.choice(x)), bool(r.random() < 0.5), float(r.choice(y)) if i % 7 else float("inf")) for i in range(300)]
    p = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)], "x double, y double, w long")
    q = spark.createDataFrame(asks, "ask long, qx double, after boolean, qy double")
    want = {i: int(w[((x <= qx) if after else (x < qx)) & (y < qy)].sum()) for i, qx, after, qy in asks}
    for strip in (None, 40, 10**6):
        assert {g.ask: g.below for g in A.dominance_counts(p, q, strip).collect()} == want


def test_prefix_below():
    import numpy as np
    from cohortspark.functions import kernels as NK
    r = np.random.default_rng(0)
    rank, weight = r.integers(0, 9, 50), r.integers(0, 5, 50)
    end, under = r.integers(0, 51, 80), r.integers(0, 10, 80)
    assert (NK.prefix_below(rank, weight, end, under) == [weight[:e][rank[:e] < u].sum() for e, u in zip(end, under)]).all()
    assert (NK.prefix_below(rank[:0], weight[:0], np.zeros(3, int), np.zeros(3, int)) == 0).all()


def test_battery_finds_what_severity_does_not_explain(spark):
    import numpy as np
    from cohortspark.operators import resample as R
    r = np.random.default_rng(2)
    rows = []
    for a in range(24):
        sev, phase = float(r.normal()), "PEAK" if a % 2 else "REM"
        for lvl in range(3):
            burden = float(r.normal())
            rows += [("only_severity", a, phase, lvl, sev, burden, 2 * sev + 0.1 * float(r.normal())),
                     ("phase", a, phase, lvl, sev, burden, sev + burden + (3.0 if phase == "PEAK" else 0.0) + 0.1 * float(r.normal())),
                     ("level", a, phase, lvl, sev, burden, sev + 2.0 * lvl + 0.1 * float(r.normal()))]
    d = spark.createDataFrame(rows, "metric string, animal int, phase string, lvl int, score double, burden double, v double")
    got = {(g.family, g.metric, g.resid_on): g for g in R.severity_battery(
        d, "metric", "v", "animal", "phase", "lvl", {"s": ["score"], "sb": ["score", "burden"]}, ("REM", "PEAK"), 200).collect()}
    assert len(got) == 12 and all(g.n == 24 for g in got.values())
    assert got["phase_gap", "phase", "sb"].q < 0.05 and got["phase_gap", "phase", "sb"].observed == pytest.approx(3, abs=0.6)
    assert got["level_trend", "level", "s"].q < 0.05 and got["level_trend", "level", "s"].observed == pytest.approx(2, abs=0.1)
    assert got["phase_gap", "only_severity", "s"].p > 0.05 and all(g.q >= g.p - 1e-12 for g in got.values())


@pytest.mark.parametrize("run", [1, 3, 4096])
def test_weighted_resamples_equal_copied_rows(spark, monkeypatch, run):
    """Every statistic on weights equals the same statistic on rows that are brought as often as they are drawn, for runs of any length."""
    monkeypatch.setattr(O, "CODE_RUN", run)
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], f"u{i:02d}", float(rng.integers(0, 6)), float(rng.normal()), int(rng.integers(0, 2)), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, u string, x double, y double, pos int, z double")
    w = R.bootstrap_weights(df, "u", 6, 7, ["k"])
    copies = w.join(df, ["k", "u"]).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("_w").cast("int"))))
    assert w.agg(F.sum("_w")).first()[0] == copies.count() == 240
    part = ["k", "rep"]
    two = df.withColumn("g", F.when(F.col("pos") == 1, "q").otherwise("p"))
    for stat in (R.rank_corr("x", "y"), R.auc_stat("pos", "x"), R.mean_gap("y", "g", "p", "q"), R.ols_slope("x", "y"), R.adjusted_gap("y", "g", "p", "q", "z")):
        a = {(r.k, r.rep): r.stat for r in stat(w.join(R.coded(two, stat, ["k"]), ["k", "u"]), part, "_w").collect()}
        b = {(r.k, r.rep): r.stat for r in stat(copies.join(two.select("k", "u", "g"), ["k", "u"]), part).collect()}
        assert a.keys() == b.keys() and len(a) == 12
        assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


@pytest.mark.parametrize("limits", [{}, {"GROUP_ROWS": 10}, {"REP_BLOCK": 3, "DRAWS": 4}])
def test_packed_resamples_equal_rows(spark, monkeypatch, limits):
    """Rank matrices of all replicates from packed blocks, from short blocks and row by row equal the statistic on copied rows; nulls and rows without a
    unit count as there."""
    for k, v in limits.items():
        monkeypatch.setattr(R, k, v)
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], f"u{i // 2:02d}" if i else None, None if i % 9 == 4 else float(rng.integers(0, 6)), float(rng.normal()), float(i % 5)) for i in range(50)]
    df = spark.createDataFrame([*rows, (None, "u99", 1.0, 1.0, 1.0)], "k string, u string, x double, y double, z double")
    w = R.bootstrap_weights(df, "u", 7, 2, ["k"])
    sets = [("x", "y"), ("y", "z", "x")]
    got = R.resampled_ranks(df, "u", sets, 7, 2, ["k"])
    for names, table in zip(sets, got):
        codes = [f"_code_{x}" for x in names]
        for drawn, want in ((False, df.withColumn("_w", F.lit(1)).withColumn("rep", F.lit(-1))), (True, w.join(df, ["k", "u"]))):
            d = R._with_codes(want, names, ["k", "rep"])
            b = {(r.k, r.rep): r.asDict() for r in A.weighted_rank_matrix(d, codes, ["k", "rep"], "_w").collect()}
            a = {(r.k, r.rep): r.asDict() for r in table.where(F.col("rep") >= 0 if drawn else F.col("rep") < 0).collect()}
            assert a.keys() == b.keys() and len(a) == (14 if drawn else 2)
            assert all(a[k].keys() == b[k].keys() and a[k][v] == pytest.approx(b[k][v], abs=1e-9) for k in a for v in a[k] if v not in ("k", "rep"))


def test_resamples_are_not_joined_row_by_row(spark, monkeypatch):
    """A rank statistic makes no row for each replicate and unit."""
    monkeypatch.setattr(R, "bootstrap_weights", lambda *a, **k: pytest.fail("weights as rows"))
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "u int, x double, y double")
    assert R.bootstrap_ci(df, "u", R.rank_corr("x", "y"), 5).first().n_reps == 5
    assert R.intervals(df.limit(0), "u", {"raw": R.rank_corr("x", "y")}, 5).first().observed is None


def test_control_genes_equal_all_pairs(spark, monkeypatch):
    """The draw by leading hashes gives the first genes of the order over all pairs, also where the cut leaves too few of them."""
    means = spark.createDataFrame([(i, float(i * 37 % 1009)) for i in range(1000)], "gene_id long, mean_log double")
    markers = means.where("gene_id % 25 = 3").select("gene_id")

    def picked():
        return sorted(map(tuple, C.control_genes(means, markers, 4, 5).collect()))
    got = picked()
    monkeypatch.setattr(C, "SPARE", -4.9)
    assert picked() == got and len(got) == 200
    bins = {m: b for m, _, b in got}
    order = {g: i for i, g in enumerate(sorted(range(1000), key=lambda g: (g * 37 % 1009, g)))}
    place = {g: max(math.ceil(i / (999 / 4)) - 1, 0) for g, i in order.items()}
    for m, b in bins.items():
        pool = [g for g in range(1000) if g % 25 != 3 and place[g] == b]
        want = sorted(pool, key=lambda g: (hashlib.md5(f"{m}|{g}|0".encode()).hexdigest(), g))[:5]
        assert sorted(want) == [g for x, g, _ in got if x == m]


def test_weighted_ranks_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, None, 2.0, 5), (2, 1.0, 3.0, 2), (3, 1.0, 4.0, 1), (4, 2.0, None, 9), (5, 3.0, 1.0, 3)], "u int, x double, y double, w int")
    d = O.rank_codes(O.rank_codes(df, "x", (), "cx"), "y", (), "cy")
    got = A.weighted_rank_corr(d, "cx", "cy", [], "w").first()
    x, y = np.array([2.0, 2, 2, 5, 5, 5]), np.array([4.5, 4.5, 6, 2, 2, 2])
    assert got.n == 6 and math.isclose(got.rho, np.corrcoef(x, y)[0, 1], rel_tol=1e-12)
    flat = A.weighted_rank_corr(d.withColumn("cx", F.lit(1)), "cx", "cy", [], "w").first()
    assert flat.rho is None
    assert R.bootstrap_ci(df.limit(0), "u", R.mean_gap("x", "u", 1, 2), 5).first().observed is None


def test_range_index_counts_every_row(spark):
    df = spark.range(0, 5000, 1, 7).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("u"), (F.col("id") % 2).alias("g"))
    got = O.range_index(df, "u", ["g"]).collect()
    for g in (0, 1):
        mine = sorted((r.u, r._idx) for r in got if r.g == g)
        assert [i for _, i in mine] == list(range(2500))
    assert {r._n for r in got} == {2500}


def test_partial_rank_corr_on_weights_equals_least_squares_on_ranks(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(30, 4)), 1)
    w = rng.integers(1, 4, 30)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(v, w))], "u int, x double, y double, a double, b double, _w int")
    full = np.repeat(v, w, axis=0)
    ranks = np.stack([(np.searchsorted(np.sort(c), c) + np.searchsorted(np.sort(c), c, "right") + 1) / 2 for c in full.T], 1)
    for given in (["a"], ["a", "b"]):
        z = np.column_stack([np.ones(len(full)), ranks[:, 2:2 + len(given)]])
        left = [r - z @ np.linalg.lstsq(z, r, rcond=None)[0] for r in ranks[:, :2].T]
        stat = R.partial_rank_corr("x", "y", given)
        got = stat(R.coded(df, stat), [], "_w").first().stat
        assert math.isclose(got, np.corrcoef(*left)[0, 1], abs_tol=1e-9)


def test_intervals_with_few_units_are_null(spark):
    rows = [("few", i, float(i), float(-i)) for i in range(4)] + [("many", i, float(i), float(i * i)) for i in range(8)] + [("flat", i, 1.0, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, u int, x double, y double")
    got = {r.k: r for r in R.intervals(df, "u", {"raw": R.rank_corr("x", "y")}, 20, ["k"]).collect()}
    assert got["few"].observed is None and got["few"].n == 4 and got["few"].ci_lo is None
    assert got["many"].observed == 1 and got["many"].n_reps == 20 and math.isclose(got["many"].ci_lo, 1)
    assert got["flat"].observed is None and got["flat"].n == 6


def test_conserved_lists_and_shared_hits(spark):
    schema = "gene_id long, rho double, q double"
    a = spark.createDataFrame([(1, 0.5, 0.01), (2, 0.2, 0.2), (3, -0.4, 0.01), (4, 0.3, 0.01), (5, 0.0, 1.0), (6, 0.6, None)], schema)
    b = spark.createDataFrame([(1, 0.1, 0.04), (2, 0.4, 0.01), (3, -0.1, 0.01), (4, -0.3, 0.01), (5, 0.9, 0.01), (7, 0.9, 0.01)], schema)
    got = [(r.direction, r.place, r.gene_id) for r in A.conserved_lists(a, b, "gene_id", "rho", 2).collect()]
    assert sorted(got) == [("down", 1, 3), ("up", 1, 1), ("up", 2, 2)]
    r = A.agreement(a, b, "gene_id", "rho", "q").first()
    assert (r.n, r.n_both, r.same_sign) == (5, 3, 0.6)
    assert "n_both" not in A.agreement(a, b, "gene_id", "rho").columns


def test_gate_takes_moments_once(spark, monkeypatch):
    """Both partial correlations of the depth gate come from one table of moments and equal the single ones."""
    rng = np.random.default_rng(5)
    units = spark.createDataFrame([(i, float(rng.normal()), float(rng.integers(0, 4)), float(rng.normal())) for i in range(12)],
                                  "animal_id int, day double, score double, n_cells double")
    rows = [(f"g{j}", i, float(rng.integers(1, 6))) for j in range(20) for i in range(12) if rng.random() < 0.7]
    rows += [("flat", i, 2.0) for i in range(12)] + [(None, i, float(i + 1)) for i in range(12)] + [("g0", 3, 9.0), ("g1", None, 1.0)]
    x = spark.createDataFrame(rows, "gene_id string, animal_id int, value double")
    one = {r.gene_id: (r.n, r.partial) for r in A.partial_trend(x, units, "gene_id", "animal_id", "day", "score", fdr=False).collect()}
    two = {r.gene_id: r.partial for r in A.partial_trend_two(x, units, "gene_id", "animal_id", "day", ("score", "n_cells")).collect()}
    calls, plain = [], A.sparse_moments
    monkeypatch.setattr(A, "sparse_moments", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {r.gene_id: r for r in A.trend_with_gate(x, units, "gene_id", "animal_id", "day", "score", "n_cells", limit=0.0).collect()}
    assert len(calls) == 1
    assert set(got) == (set(one) & set(two)) - {None} and "flat" not in got
    for g, r in got.items():
        assert r.n == one[g][0] and math.isclose(r.partial_one, one[g][1], abs_tol=1e-9)
        assert math.isclose(r.partial_two, two[g], abs_tol=1e-9) and r.partial_used == r.partial_two


def test_ranks_are_dealt_over_tasks(spark):
    """The sorts behind ranked moments keep their number of tasks; few bytes do not merge them into one."""
    units = spark.createDataFrame([(i, float(i)) for i in range(10)], "animal_id int, day double")
    x = spark.createDataFrame([(f"g{j}", i, float(i + j)) for j in range(200) for i in range(10)], "gene_id string, animal_id int, value double")
    m = A.sparse_moments(x, units, "gene_id", "animal_id", ["day"])
    assert m.select(F.spark_partition_id().alias("p")).distinct().count() > 8 and m.count() == 200
