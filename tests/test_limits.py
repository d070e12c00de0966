"""No caps, fixed grids or silent half-results: tails, ranks, neighbours, folders, pivots, functional scores."""

from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from cohortspark.functions import kernels as NK
from cohortspark.functions import special as SP


def test_tails_of_large_degrees():
    # the median of a chi-square is df (1 - 2 / (9 df))^3 to a relative 1e-9 at these sizes
    for df in (3e4, 1e6, 1e7):
        x = df * (1 - 2 / (9 * df)) ** 3
        assert abs(SP.chi2_tail(np.array([x]), np.array([df]))[0] - 0.5) < 1e-6
    # both sides of the switch of methods agree
    lo, hi = SP.gamma_upper(np.array([10000 - 1e-6, 10000 + 1e-6]), np.array([10050.0, 10050.0]))
    assert abs(lo - hi) < 1e-7
    import math
    z = np.array([0.1, 1.96, 5.0])
    assert np.allclose(SP.t_tail(z, np.full(3, 1e9)), [math.erfc(v / math.sqrt(2)) for v in z], rtol=1e-7)


def test_exact_mann_whitney_against_listing():
    for n1, n2 in ((1, 4), (3, 4), (5, 5), (2, 7)):
        us = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            big = max(u, n1 * n2 - u)
            assert abs(SP.mann_whitney_exact(u, n1, n2) - min(1, 2 * sum(x >= big for x in us) / len(us))) < 1e-12
    assert abs(SP.mann_whitney_exact(2050, 60, 60) - 0.19) < 0.01


def test_mapped_products():
    r = np.random.default_rng(0)
    a = np.c_[np.ones(20), r.normal(size=(20, 2)), r.gamma(1, 1, (20, 6)), r.normal(size=20)]
    m = a.T @ a
    t, w, _, _ = NK.enet_cv([a[i::4].T @ a[i::4] for i in range(4)], 2, 6, 0.5, 10, None)
    assert np.allclose(NK.mapped(m, t, 2), t.T @ m @ t) and w.shape == (6, 1)


def test_unsettled_fit_is_an_error(monkeypatch):
    monkeypatch.setattr(NK, "SWEEPS", 1)
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 10)) + r.normal(size=(40, 1)) * 3
    with pytest.raises(ArithmeticError):
        NK.enet_fit(x.T @ x, x.T @ (x @ r.normal(size=10)), 0.5, 0.0, np.zeros(10), 1e-12)


def test_no_shared_folder_on_a_cluster():
    from cohortspark.session import shared_folder
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError):
        shared_folder(spark)


def test_discard(spark):
    from cohortspark.session import cut, cut_paths, discard
    d = cut(spark.range(5))
    assert d.count() == 5 and d._cut_path in cut_paths()
    discard(spark, d)
    assert d._cut_path not in cut_paths()
    with pytest.raises(Exception):
        spark.read.parquet(d._cut_path)


def test_ranks_of_values_that_differ_little(spark):
    from cohortspark.functions.ordering import hex_ranks, large_midrank, ordinal
    r = np.random.default_rng(2)
    v = np.round(1e6 + r.random(20000), 7)
    v[:50], v[50:60] = 1e-9 * r.random(50), 0.0
    pdf = pd.DataFrame({"i": np.arange(len(v)), "v": v})
    got = large_midrank(spark.createDataFrame(pdf), "v").toPandas().sort_values("i")
    assert np.array_equal(got["rank"].to_numpy(), pdf["v"].rank().to_numpy())
    got = ordinal(spark.createDataFrame(pdf), "v", "i").toPandas().sort_values(["v", "i"])
    assert np.array_equal(got["ordinal"].to_numpy(), np.arange(1, len(v) + 1))
    h = spark.range(3000).selectExpr("id", "md5(cast(id as string)) AS h")
    got = hex_ranks(h, "h").toPandas().sort_values("h")
    assert np.array_equal(got["_rn"].to_numpy(), np.arange(1, 3001))


def test_neighbours_with_a_crowd_and_an_outlier(spark):
    """Half of the points in one spot, sections of very different extent, one point a billion units away."""
    from cohortspark.operators import spatial as G
    r = np.random.default_rng(5)
    xy = r.random((1200, 2)) * 100
    xy[:600] = 50 + r.random((600, 2)) * 1e-3
    xy[0] = (1e9, 1e9)
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(2, i, float(i) * 1e-6, 0.0) for i in range(40)]
    got = G.knn(spark.createDataFrame(rows, "section_id long, cell_id long, x double, y double"), 4).toPandas()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    one = got[got.section_id == 1].sort_values(["src", "nn"])
    assert np.allclose(one["dist"].to_numpy().reshape(-1, 4), want, rtol=1e-9)
    assert len(got[got.section_id == 2]) == 160


def test_pivots(spark):
    from cohortspark.operators import curves as V
    days = {"a": [0, 1, 2, 1, 0, 1, 2], "gap": [2, None, 1, None, 1, 2, 2]}
    rows = [(k, d, float(y), 10) for k, ys in days.items() for d, y in enumerate(ys) if y is not None]
    c = spark.createDataFrame(rows, "animal_id string, day int, score double, end_day int")
    found = {r["animal_id"]: [(p["day"], p["kind"]) for p in r["pivots"]] for r in V.pivots(c, 1.0, 1.0).collect()}
    assert found == {"a": [(3, "fall"), (5, "rise")], "gap": [(2, "fall"), (5, "rise")]}
    held = {r["animal_id"]: [p["day"] for p in r["pivots"]] for r in V.pivots(c, 1.0, 1.0, 2).collect()}
    # in "gap" the low days 2 and 4 are not consecutive
    assert held == {"a": [4, 6], "gap": []}


def test_functional_scores_are_conditional_means(spark):
    from cohortspark.operators import grid as M
    r = np.random.default_rng(8)
    rows = [(i, t, float(np.sin(t / 3) * a + b * t / 10 + r.normal() * 0.1)) for i, (a, b) in enumerate(r.normal(size=(30, 2)))
            for t in range(12) if r.random() < 0.8]
    d = spark.createDataFrame(rows, "animal_id long, t int, score double")
    comp = M.functional_components(d)
    got = M.functional_scores(d, comp).toPandas()
    c = comp.toPandas()
    k = int(c[c["chosen"]]["component"].max())
    phi = c[c["chosen"]].pivot(index="t", columns="component", values="phi").to_numpy()
    lam = c[c["chosen"]].groupby("component")["eigenvalue"].first().to_numpy()
    mu, noise = c.groupby("t")["mu"].first().to_numpy(), c["noise"].iloc[0]
    pdf = pd.DataFrame(rows, columns=["i", "t", "y"])
    for i, own in pdf.groupby("i"):
        p = phi[own["t"]]
        want = lam * (p.T @ np.linalg.solve((p * lam) @ p.T + noise * np.eye(len(own)), own["y"].to_numpy() - mu[own["t"]]))
        assert np.allclose(got[got["animal_id"] == i].sort_values("component")["score"].to_numpy(), want, atol=1e-8) and len(want) == k


def test_signed_rank_p(spark):
    from cohortspark.operators import contrast as K
    v = [1.2, -0.4, 2.5, 0.4, 3.1, -1.2, 0.9, 2.2, 1.2, 0.0]
    got = K.signed_rank(spark.createDataFrame([(x,) for x in v], "d double"), [], "d", p=True).collect()[0]
    nz = np.array([x for x in v if x])
    ranks = pd.Series(np.abs(nz)).rank().to_numpy()
    n, w = len(nz), min(ranks[nz > 0].sum(), ranks[nz < 0].sum())
    t = pd.Series(np.abs(nz)).value_counts().to_numpy()
    sd = np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48)
    import math
    assert got["w"] == w and abs(got["p"] - math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2))) < 1e-9


def test_short_bins_are_filled_up(spark):
    from cohortspark.operators import grid as M
    means = spark.createDataFrame([(i, float(i)) for i in range(30)], "gene_id long, mean double")
    focus = spark.createDataFrame([(i,) for i in range(20, 30)], "gene_id long")
    sets = M.matched_sets(means, focus, 4, n_bins=3).toPandas()
    assert (sets.groupby("set_no").size() == 10).all() and sets.groupby("set_no")["gene_id"].nunique().eq(10).all()


def test_panel_text_writes_runs_of_zeros(spark):
    """The text of a dense vector equals its entries joined one by one; a panel of a million genes costs a key its hits, not its entries."""
    from pyspark.sql import functions as F

    from cohortspark.operators import counts as C
    rows = [("a", 0, 1.5), ("a", 3, 2.0), ("a", 4, 0.0), ("b", 6, 0.25), ("c", 2, None), (None, 1, 1.0), ("d", 99, 1.0), ("e", 7, 3.0)]
    pb = spark.createDataFrame(rows, "k string, gene_id int, value double")
    panel = spark.createDataFrame([(g, g) for g in range(7)] + [(7, 7)], "gene_id int, pos long")
    text = lambda x: F.round(x * 1000).cast("bigint").cast("string")
    dense = C.panel_vectors(pb, panel, ["k"], 8).select(
        "k", F.size(F.filter("vector", lambda x: x > 0)), F.array_join(F.transform("vector", text), ",")).collect()
    got = C.panel_vectors(pb, panel, ["k"], 8, text=text).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in dense} and len(got) == len(dense) == 5
    wide = C.panel_vectors(pb.where("k = 'a'").crossJoin(spark.range(300)), panel, ["k", "id"], 1_000_000, text=text)
    assert "sequence" not in wide._jdf.queryExecution().analyzed().toString()
    sizes = wide.select(F.length("vector"), "n_present").distinct().collect()
    assert [tuple(r) for r in sizes] == [(2 * 1_000_000 - 1 + 3 + 3, 2)]
