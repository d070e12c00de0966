"""Hand-made curves for onset, relapse and peak rules."""

import math

from cohortspark.operators import curves as V


def make(spark, series, end=None):
    rows = [(n, d, float(s), end if end is not None else max(x for x, _ in pts), False)
            for n, pts in series.items() for d, s in pts]
    return spark.createDataFrame(rows, "animal_id string, day int, score double, end_day int, imputed boolean")


def days(*scores):
    return list(enumerate(scores))


def as_dict(df, col):
    return {r["animal_id"]: r[col] for r in df.collect()}


def test_onset(spark):
    c = make(spark, {"blip": days(0, 1, 0, 0), "pair": days(0, 0, 1, 1, 0), "gap": [(0, 0), (1, 1), (3, 1), (4, 0)],
                     "last": days(0, 0, 0, 1), "never": days(0, 0, 0)})
    got = {r["animal_id"]: (r["onset_day"], r["onset_censored"]) for r in V.onset(c).collect()}
    assert got == {"blip": (None, False), "pair": (2, False), "gap": (None, False), "last": (3, True), "never": (None, False)}


def test_relapse_counts(spark):
    c = make(spark, {"one": days(0, 1, 2, 1, 0, 1, 2), "none": days(0, 1, 1, 1, 2, 3), "two": days(2, 0, 2, 0, 2)})
    assert as_dict(V.relapses(c), "n_relapses") == {"one": 1, "none": 0, "two": 2}


def test_relapses_need_to_hold(spark):
    c = make(spark, {"one_day": days(1, 0.5, 1, 0.5, 1), "held": days(1, 0, 0, 1, 1), "broken": [(0, 1), (1, 0), (3, 0), (4, 1), (5, 1)]})
    assert as_dict(V.relapses_sustained(c), "n_relapses_held") == {"one_day": 0, "held": 1, "broken": 0}


def test_last_peak(spark):
    c = make(spark, {"plateau": days(0, 2, 2, 0), "at_end": days(0, 1, 0, 2), "zeros": days(0, 0, 0),
                     "small": days(2, 1.75, 2, 0), "shoulder": days(0, 1, 1, 2, 0)})
    assert as_dict(V.last_peak(c), "last_peak_day") == {"plateau": 1, "at_end": 3, "zeros": None, "small": 2, "shoulder": 3}


def test_slope_needs_two_points(spark):
    c = make(spark, {"a": days(0, 1, 2), "b": [(0, 1), (9, 1)]})
    got = as_dict(V.slope_at_end(c), "slope_at_end")
    assert got["b"] is None and math.isclose(got["a"], 1.0)


def test_end_point_is_imputed(spark):
    cur = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0)], "animal_id string, day int, score double")
    ends = spark.createDataFrame([("a", 1, 9.0), ("b", 2, 3.0)], "animal_id string, end_day int, end_score double")
    got = {(r.animal_id, r.day): (r.score, r.imputed) for r in V.build_curve(cur, ends).collect()}
    assert got == {("a", 0): (1.0, False), ("a", 1): (2.0, False), ("b", 0): (1.0, False), ("b", 2): (3.0, True)}


def test_wide_sheet(spark):
    wide = spark.createDataFrame([("a", 1.0, None, 2.0)], "id string, d0 double, d1 double, d10 double")
    got = sorted((r.id, r.day, r.v) for r in V.unpivot_days(wide, ["id"], ["d0", "d1", "d10"], "v").collect())
    assert got == [("a", 0, 1.0), ("a", 10, 2.0)]


def test_identical_curves_of_a_crowd_are_dealt_by_pairs(spark, monkeypatch):
    """Brute force on curves with gaps, one of which most sections share; no task gives most of the result."""
    import random

    from pyspark.sql import functions as F
    monkeypatch.setattr(V, "SHARE_ROWS", 500)
    rng = random.Random(3)
    crowd = {d: float(d % 3) for d in range(6)}
    curves = {i: dict(crowd) if i % 4 else {d: float(rng.randrange(2)) for d in rng.sample(range(8), 6)} for i in range(240)}
    for i in range(1, 240, 10):
        curves[i].pop(rng.randrange(6))
    rows = [(i // 10, i, d, v) for i, c in curves.items() for d, v in c.items()]
    table = spark.createDataFrame(rows, "animal_id long, section_id long, day int, score double")
    probe = spark.createDataFrame([(i,) for i in range(0, 240, 3)], "section_id long")
    found = V.identical_curves(probe, table, 4).withColumn("part", F.spark_partition_id()).collect()
    want = {(i // 10, i, j // 10, j, len(both)) for i in range(0, 240, 3) for j in range(240) if i // 10 != j // 10
            for both in [curves[i].keys() & curves[j].keys()] if len(both) >= 4 and all(curves[i][d] == curves[j][d] for d in both)}
    assert len(found) == len(want) and {tuple(r)[:5] for r in found} == want
    parts = [r["part"] for r in found]
    assert max(map(parts.count, set(parts))) < len(parts) / 3


def test_animal_features_join_written_tables(spark):
    """The join of all features sorts no curve: each feature comes from a table of its own, a row for each animal."""
    series = {"a": [0, 1, 2, 1, 0, 1, 2], "b": [0, 0, 0, 0, 0, 0, 0], "c": [2, 0, 2, 0, 2, 0, 2]}
    curves = spark.createDataFrame([(n, d, float(s), 20.0 - d) for n, y in series.items() for d, s in enumerate(y)],
                                   "animal_id string, day int, score double, weight double")
    ends = spark.createDataFrame([("a", 6, 1.5), ("b", 7, 0.5), ("c", 6, 1.5), ("none", 3, None)], "animal_id string, end_day int, end_score double")
    f = V.animal_features(curves, ends)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    got = {r["animal_id"]: r for r in f.collect()}
    assert set(got) == {"a", "b", "c"}
    curve = V.build_curve(curves, ends)
    on = V.onset(curve)
    for part in (V.summary_features(curve), on, V.relapses(curve), V.relapses_sustained(curve), V.slope_at_end(curve),
                 V.trapezoid(curve, out="cumulative_score"), V.weight_features(curves, ends)):
        for r in part.where("animal_id <> 'none'").collect():
            assert all(got[r["animal_id"]][k] == r[k] for k in part.columns)
    assert got["b"]["end_imputed"] and got["b"]["disease_duration"] == 0 and got["b"]["cumulative_since_onset"] == 0
