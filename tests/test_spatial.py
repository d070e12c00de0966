"""Neighbours, components, clusters and hulls on small fixtures, against brute force."""

import math

import numpy as np

from cohortspark.operators import spatial as G
from cohortspark.operators.components import connected_components


def points(spark, rows):
    return spark.createDataFrame([(s, int(i), float(x), float(y)) for s, i, x, y in rows], "section_id int, cell_id long, x double, y double")


def uneven(n=300):
    """One dense blob, copies of one location, and a thin spread, in two sections that share coordinates."""
    rng = np.random.default_rng(5)
    xy = np.r_[rng.normal(0, 0.01, (n // 2, 2)), np.tile([[3.0, 3.0]], (25, 1)), rng.uniform(-100, 100, (n // 2, 2))]
    return [(s, i, x, y) for s in (0, 1) for i, (x, y) in enumerate(xy)] + [(2, 0, 1.0, 1.0), (2, 1, 2.0, 2.0)]


def brute_knn(rows, k):
    out = set()
    for s in {r[0] for r in rows}:
        p = [(i, x, y) for q, i, x, y in rows if q == s]
        for i, x, y in p:
            near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in p if j != i)[:k]
            out |= {(s, i, j, n + 1) for n, (_, j) in enumerate(near)}
    return out


def test_knn_uneven(spark):
    rows = uneven()
    got = {(r.section_id, r.src, r.dst, r.nn) for r in G.knn(points(spark, rows), 4).collect()}
    assert got == brute_knn(rows, 4)


def test_components(spark):
    e = [(0, 1, 2), (0, 2, 3), (0, 10, 11), (0, 11, 12), (0, 3, 10), (1, 1, 2), (1, 5, 6)] + [(0, 100, 100 + i) for i in range(1, 60)]
    df = spark.createDataFrame(e, "section_id int, a long, b long")
    got = {(r.section_id, r.node): r.component for r in connected_components(df, ["section_id"]).collect()}
    assert all(got[(0, n)] == 1 for n in (1, 2, 3, 10, 11, 12))
    assert got[(1, 2)] == 1 and got[(1, 6)] == 5 and got[(0, 159)] == 100
    shuffled = {(r.section_id, r.node): r.component for r in connected_components(df.repartition(5), ["section_id"]).collect()}
    assert got == shuffled


def test_long_chain(spark):
    df = spark.createDataFrame([(0, i, i + 1) for i in range(200)], "section_id int, a long, b long")
    assert {r.component for r in connected_components(df, ["section_id"]).collect()} == {0}


def test_dbscan_brute(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, x, y) for i, (x, y) in enumerate(np.r_[rng.normal(0, 2, (60, 2)), rng.normal(12, 2, (60, 2)), rng.uniform(-30, 40, (60, 2)),
                                                          np.tile([[50.0, 50.0]], (6, 1))])]
    eps, m = 2.0, 5
    near = {i: [j for _, j, a, b in rows if (x - a) ** 2 + (y - b) ** 2 <= eps * eps] for _, i, x, y in rows}
    core = {i for i, v in near.items() if len(v) >= m}
    lab = {i: i for i in core}
    moved = True
    while moved:
        moved = False
        for i in core:
            low = min(lab[j] for j in near[i] if j in core)
            if low < lab[i]:
                lab[i], moved = low, True
    for i in near:
        if i not in core:
            adj = [lab[j] for j in near[i] if j in core]
            lab[i] = min(adj) if adj else None
    got = {r.cell_id: r.lesion for r in G.dbscan(points(spark, rows), eps, m).collect()}
    assert got == lab


def test_unit_square(spark):
    rows = [(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (0, 3, 0, 1), (0, 4, 0.5, 0.5), (0, 5, 0.5, 0)]
    p = points(spark, rows)
    from pyspark.sql import functions as F
    m = p.withColumn("lesion", F.lit(7))
    s = G.lesion_shapes(m, ["section_id", "lesion"]).first()
    assert (s.area, s.perimeter, s.n_corners, s.n_cells) == (1.0, 4.0, 4, 6)
    assert math.isclose(s.compactness, math.pi / 4)
    probe = points(spark, [(0, 10, 0.5, 0.5), (0, 11, 0.5, 0.0), (0, 12, 2.0, 0.5), (0, 13, 50.0, 0.0), (1, 14, 0.5, 0.5)])
    d = {r.cell_id: r.signed_dist for r in G.signed_distance(probe, G.hull_corners(m, ["section_id", "lesion"]), 5.0, 4.0).collect()}
    assert set(d) == {10, 11, 12}
    assert math.isclose(d[10], -0.5) and abs(d[11]) < 1e-12 and math.isclose(d[12], 1.0)


def test_hull_of_many_corners(spark):
    """A hull of 1e5 corners beside hulls of 40, 3 and 2: as against every edge, with few edges a cell."""
    rng = np.random.default_rng(11)
    big, n = 1e6, 100_000
    a = 2 * np.pi * np.arange(n) / n
    b = 2 * np.pi * np.arange(40) / 40
    ring = {1: np.c_[big * np.cos(a), 0.6 * big * np.sin(a)], 2: np.c_[5e5 + 3e5 * np.cos(b), 3e5 * np.sin(b)],
            3: np.array([[0.0, 0.0], [1e5, 0.0], [0.0, 2e5]]), 4: np.array([[0.0, 0.0], [1e5, 0.0]])}
    rows = [(0, les, i, float(x), float(y)) for les, p in ring.items() for i, (x, y) in enumerate(p)]
    corners = spark.createDataFrame(rows, "section_id int, lesion int, seq int, x double, y double")
    probe = np.r_[rng.uniform(-1.2e6, 1.2e6, (120, 2)), ring[1][::9973], ring[1][::8123] * 0.9999, [[0.0, 0.0], [1.0, 0.0]], ring[2][:3]]
    cells = points(spark, [(0, i, x, y) for i, (x, y) in enumerate(probe)])
    margin = 2e5
    got = {(r.lesion, r.cell_id): r.signed_dist for r in G.signed_distance(cells, corners, margin, 2.5e5).collect()}
    want = {}
    for les in (1, 2, 3):
        p = ring[les]
        q, lo, hi = np.roll(p, -1, 0), p.min(0) - margin, p.max(0) + margin
        for i, z in enumerate(probe):
            if (z >= lo).all() and (z <= hi).all():
                v, w = q - p, z - p
                t = np.clip((v * w).sum(1) / (v * v).sum(1), 0, 1)
                d = np.sqrt((((w - t[:, None] * v) ** 2).sum(1)).min())
                want[(les, i)] = -d if (v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0] >= 0).all() else d
    assert set(got) == set(want)
    assert max(abs(abs(got[k]) - abs(want[k])) for k in want) < 1e-3
    assert all(got[k] * want[k] > 0 for k in want if abs(want[k]) > 1e-3)
    inner = cells.where("cell_id < 120").selectExpr("section_id", "1 AS lesion", "cell_id", "x", "y")
    assert G.near_edges(inner, corners).count() < 120 * 10 * G.FAN


def test_enrichment_moments_match_relabelling(spark):
    rng = np.random.default_rng(4)
    n = 9
    rows = [(0, i, *rng.uniform(0, 10, 2)) for i in range(n)]
    kinds = ["A", "A", "A", "B", "B", "B", "B", "C", "C"]
    p = points(spark, rows)
    lab = spark.createDataFrame([(0, i, k) for i, k in enumerate(kinds)], "section_id int, cell_id long, cell_type string")
    edges = G.knn(p, 2)
    e = [(r.src, r.dst) for r in edges.collect()]
    draws = [rng.permutation(kinds) for _ in range(40000)]
    got = {(r.sender, r.receiver): r for r in G.neighbourhood_enrichment(edges, p.join(lab, ["section_id", "cell_id"])).collect()}
    for (a, b), r in got.items():
        j = np.array([sum(d[s] == a and d[t] == b for s, t in e) for d in draws[:8000]])
        assert abs(j.mean() - r.expected) < 0.06
        assert abs((r.observed - r.expected) / r.z - j.std()) < 0.06 if r.z else True


def test_position_axis_of_a_large_family(spark, monkeypatch):
    """A family beyond one matrix gets the same axis from products with vectors, with repeated, null and missing rows; no table of gene pairs is made."""
    from cohortspark.operators import signaling as L
    rng = np.random.default_rng(4)
    level = rng.normal(size=90)
    rows = [(s, g, float(abs(rng.normal(1, 0.3) + (0.8 * level[s] if g < 12 else 0)))) for s in range(90) for g in range(40) if rng.random() < 0.6]
    rows += [rows[0], rows[7], (5, 3, None), (None, 2, 1.0), (4, None, 1.0), (4, 99, 1.0)]
    x = spark.createDataFrame(rows, "section_id int, gene_id long, value double")
    fam = spark.createDataFrame([(g,) for g in range(41)], "gene_id long")
    sections = spark.createDataFrame([(s, float(level[s])) for s in range(95) if s < 90] + [(200, 0.0)], "section_id int, n_cells double")

    def position():
        return {r.section_id: r.position for r in L.position_axis(x, fam, sections, "n_cells").collect()}
    want = position()
    monkeypatch.setattr(L, "DENSE_GENES", 10)
    monkeypatch.setattr(L, "AXIS_ROWS", 300)
    monkeypatch.setattr(L, "AXIS_BASIS", 6)
    monkeypatch.setattr(L, "_dense_loadings", None)
    got = position()
    assert want.keys() == got.keys() and len(got) == 91
    assert max(abs(want[s] - got[s]) for s in want) < 1e-6
