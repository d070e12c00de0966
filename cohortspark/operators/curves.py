"""Daily curves to features.

A curve is long: (animal_id, day, score). Days are whole numbers since induction and a study has a few dozen of them,
so per-animal arrays are short; the number of animals is not bounded and is what the work is spread over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.ordering import large_midrank, midrank
from cohortspark.functions.scalars import hash_u32, ratio, sign_label
from cohortspark.operators.association import partial_r, pearson
from cohortspark.operators.resample import resampled_ranks
from cohortspark.session import cut, spread

UNIT = "animal_id"
SHARES = 32                 # tasks that one crowded point or curve is dealt over at most
SHARE_ROWS = 1 << 20        # rows of the result that one share of a curve gives


# ------------------------------------------------------------------ sources

def unpivot_days(sheet: DataFrame, ids: Sequence[str], days: Sequence[str], value: str) -> DataFrame:
    """Wide day columns ``d0 d1 ...`` to (ids, day, value); empty cells give no row."""
    long = sheet.unpivot(list(ids), list(days), "_d", value)
    return (long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
            .withColumn("day", F.substring("_d", 2, 9).cast("int")).drop("_d"))


def join_sheets(scores: DataFrame, weights: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Score and weight sheets on the same keys and day; either side may lack a day."""
    return scores.join(weights, [*ids, "day"], "full_outer")


def reconcile(left: DataFrame, right: DataFrame, alias: DataFrame, unit: str, member: str) -> DataFrame:
    """Match units of two sources (J3): matched, aliased, left only, right only.

    An alias counts only where both units hold exactly the same set of members. Set equality is tested with an
    order-free digest (count and sum of member hashes), so no member list is collected.
    """
    def digest(df, tag):
        m = df.select(unit, member).distinct()
        h = hash_u32(member)
        return m.groupBy(unit).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.sum(h).alias(f"h_{tag}"),
                                   F.sum(hash_u32(member, F.lit("second"))).alias(f"g_{tag}"))
    lf = digest(left, "l").join(alias.select(F.col("name").alias(unit), "alias"), unit, "left") \
        .withColumn("_key", F.coalesce("alias", unit))
    rt = digest(right, "r").withColumnRenamed(unit, "_key")
    j = lf.join(rt, "_key", "full_outer")
    same = (F.col("n_l") == F.col("n_r")) & (F.col("h_l") == F.col("h_r")) & (F.col("g_l") == F.col("g_r"))
    return j.select(F.coalesce(unit, "_key").alias("unit"), F.col("_key").alias("matched_to"),
                    F.when(F.col("n_r").isNull(), "left_only").when(F.col("n_l").isNull(), "right_only")
                    .when(F.col("alias").isNull(), "matched").when(same, "aliased").otherwise("alias_rejected")
                    .alias("status"), F.coalesce(same, F.lit(False)).alias("same_members"))


def _curve_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "score"))).alias("curve"))


def section_disagreements(curves: DataFrame, unit: str = UNIT, section: str = "section_id") -> DataFrame:
    """Sections whose curve deviates from the unit's modal curve, and by how much.

    The modal curve is the most frequent one (smallest on ties). Units with one section are left out.
    """
    per = _curve_key(curves, [unit, section])
    n = per.groupBy(unit, "curve").agg(F.count(F.lit(1)).alias("_n"))
    best = (n.groupBy(unit).agg(F.max("_n").alias("_n"), F.sum("_n").alias("_sections")).where("_sections > 1"))
    modal = n.join(best, [unit, "_n"]).groupBy(unit).agg(F.min("curve").alias("modal"))
    odd = per.join(modal, unit).where(F.col("curve") != F.col("modal"))
    as_map = F.map_from_entries("modal")
    diffs = F.filter(F.transform("curve", lambda p: F.abs(p["score"] - F.try_element_at(as_map, p["day"]))),
                     lambda d: d.isNotNull())
    d = odd.withColumn("_d", diffs)
    return d.select(unit, section, F.size(F.filter("_d", lambda v: v > 0)).alias("n_days_differ"),
                    F.array_max("_d").alias("max_abs_diff"),
                    F.aggregate("_d", F.lit(0.0), lambda a, v: a + v).alias("sum_abs_diff"))


def identical_curves(probe: DataFrame, curves: DataFrame, min_days: int, unit: str = UNIT,
                     section: str = "section_id") -> DataFrame:
    """Sections of other units equal to a probe section on all shared days, at least ``min_days`` of them.

    Equal curves are merged first. Two curves sharing ``min_days`` equal (day, score) points must share one of their
    ``length - min_days + 1`` rarest points, so candidates are found on those only and verified on the short arrays.
    The result has a row for each pair of equal sections, however few the rows that are joined, so its rows are dealt by
    their number, not by the bytes that go in: both growing joins are merged, as a broadcast would put the shares together again.
    """
    per = cut(_curve_key(curves, [unit, section]).where(F.size("curve") >= min_days))
    probe = probe.select(section).distinct()
    kinds = cut(per.groupBy("curve").agg(F.count(F.lit(1)).alias("_m")).withColumn("_k", F.monotonically_increasing_id()))
    own = per.join(kinds.select("curve", "_k"), "curve").select(unit, section, "_k")
    src = cut(own.join(probe, section, "left_semi"))
    points = kinds.select("_k", F.size("curve").alias("_size"), F.explode("curve").alias("_pt"))
    freq = points.groupBy("_pt").agg(F.count(F.lit(1)).alias("_f"))
    w = Window.partitionBy("_k").orderBy("_f", "_pt")
    prefix = cut(points.join(freq, "_pt").withColumn("_rn", F.row_number().over(w))
                 .where(F.col("_rn") <= F.col("_size") - (min_days - 1)).select("_k", "_pt"))
    wanted = cut(src.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")))
    # a common point meets all curves that have it: the wanted ones are dealt over tasks, the others go to each share of them
    a = prefix.join(wanted.select("_k"), "_k", "left_semi").select(F.col("_k").alias("k1"), "_pt", F.pmod(F.xxhash64("_k"), F.lit(SHARES)).alias("_s"))
    b = prefix.select(F.col("_k").alias("k2"), "_pt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias("_s"))
    pairs = spread(a, "_pt", "_s").join(b.hint("merge"), ["_pt", "_s"]).select("k1", "k2").distinct()
    pairs = spread(pairs, "k1", "k2").join(kinds.select(F.col("_k").alias("k1"), F.col("curve").alias("c1")), "k1") \
        .join(kinds.select(F.col("_k").alias("k2"), F.col("curve").alias("c2")), "k2")
    other = F.map_from_entries("c2")
    shared = F.filter(F.transform("c1", lambda p: F.when(F.map_contains_key(other, p["day"]),
                                                         p["score"] == F.try_element_at(other, p["day"]))),
                      lambda e: e.isNotNull())
    ok = cut(pairs.withColumn("_s", shared).withColumn("n_shared", F.size("_s"))
             .where((F.col("n_shared") >= min_days) & F.forall("_s", lambda e: e)).select("k1", "k2", "n_shared"))
    # a curve that takes part in many rows is dealt by shares of the sections on the probe's side
    rows = ok.join(wanted.withColumnRenamed("_k", "k1"), "k1").groupBy("k2").agg(F.sum("_m").alias("_a"))
    share = rows.join(kinds.select(F.col("_k").alias("k2"), F.col("_m").alias("_b")), "k2") \
        .select("k2", F.least(F.lit(SHARES), F.ceil(F.col("_a") * F.col("_b") / SHARE_ROWS)).cast("bigint").alias("_n"))
    ok, share = cut(ok.join(share, "k2")), cut(share)
    left = src.select(F.col(unit).alias("unit"), F.col(section).alias("section"), F.col("_k").alias("k1")).join(spread(ok, "k1", "k2"), "k1")
    left = left.withColumn("_s", F.pmod(F.xxhash64("unit", "section"), "_n")).drop("k1", "_n")
    right = own.withColumnRenamed("_k", "k2").join(share, "k2").select(
        F.col(unit).alias("other_unit"), F.col(section).alias("other_section"), "k2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_s"))
    out = spread(left, "k2", "_s").join(right.hint("merge"), ["k2", "_s"]).where(F.col("unit") != F.col("other_unit"))
    return out.select("unit", "section", "other_unit", "other_section", "n_shared")


# ------------------------------------------------------------------ curve and its features

def build_curve(curves: DataFrame, ends: DataFrame) -> DataFrame:
    """Points up to the end day; a missing end point is taken from the reference table and flagged."""
    seen = curves.join(ends, UNIT).where(F.col("day") <= F.col("end_day"))
    seen = seen.select(UNIT, "day", "score", "end_day", F.lit(False).alias("imputed"))
    lack = ends.where(F.col("end_score").isNotNull()).join(
        curves.select(UNIT, F.col("day").alias("end_day")), [UNIT, "end_day"], "left_anti")
    return seen.unionByName(lack.select(UNIT, F.col("end_day").alias("day"), F.col("end_score").alias("score"),
                                        "end_day", F.lit(True).alias("imputed")))


def onset(curve: DataFrame, threshold: float = 0.5) -> DataFrame:
    """First day at or above the threshold that holds on the next calendar day, or the last day, flagged."""
    w = Window.partitionBy(UNIT).orderBy("day")
    above = F.col("score") >= threshold
    holds = (F.lead("day").over(w) == F.col("day") + 1) & (F.lead("score").over(w) >= threshold)
    hit = curve.withColumn("_holds", F.coalesce(holds, F.lit(False)))
    qualifies = above & (F.col("_holds") | (F.col("day") == F.col("end_day")))
    day = F.when(qualifies, F.col("day"))
    return hit.groupBy(UNIT).agg(F.min(day).alias("onset_day"),
                                 F.coalesce(F.min_by(~F.col("_holds"), day), F.lit(False)).alias("onset_censored"))


def trapezoid(curve: DataFrame, since: DataFrame | None = None, out: str = "auc") -> DataFrame:
    """Area under an irregular curve, optionally from each unit's own start day."""
    d = curve
    if since is not None:
        start = [x for x in since.columns if x != UNIT][0]
        d = d.join(since.select(UNIT, F.col(start).alias("_start")), UNIT).where(F.col("day") >= F.col("_start"))
    w = Window.partitionBy(UNIT).orderBy("day")
    piece = (F.col("score") + F.lead("score").over(w)) / 2.0 * (F.lead("day").over(w) - F.col("day"))
    return d.withColumn("_p", piece).groupBy(UNIT).agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias(out))


def curve_arrays(curve: DataFrame) -> DataFrame:
    return curve.groupBy(UNIT).agg(F.array_sort(F.collect_list(F.struct("day", "score"))).alias("pts"))


def pivots(curve: DataFrame, drop: float, rise: float, hold: int = 1) -> DataFrame:
    """Turning points of each curve, in turn held falls and held rises: (unit, pivots array<day, kind>).

    A held fall after a point is the first day that closes ``hold`` consecutive calendar days, all at least ``drop`` below the
    highest score since that point; a held rise is the first that closes ``hold`` such days at least ``rise`` above the lowest.
    The search begins at the first point, and each pivot is the point from which the next one is looked for. A curve has a
    few dozen points, which one row holds.
    """
    since = "slice(y, a.at, j - a.at + 1)"
    far = {"fall": f"y[j - 1] <= array_max({since}) - {drop}D", "rise": f"y[j - 1] >= array_min({since}) + {rise}D"}

    def first(kind: str) -> str:
        held = f"forall(sequence(i - {hold - 1}, i), j -> {far[kind]})"
        return f"array_min(filter(sequence(a.at + {hold}, m), i -> d[i - 1] - d[i - {hold}] = {hold - 1} and {held}))"

    step = (f"if(a.at is null or a.at + {hold} > m, named_struct('at', cast(null as int), 'found', a.found), "
            f"transform(array(if(size(a.found) % 2 = 0, {first('fall')}, {first('rise')})), k -> named_struct('at', k, 'found', "
            "if(k is null, a.found, concat(a.found, array(k)))))[0])")
    walk = f"aggregate(sequence(1, m), named_struct('at', 1, 'found', cast(array() as array<int>)), (a, x) -> {step}, a -> a.found)"
    c = curve_arrays(curve).selectExpr(UNIT, "transform(pts, p -> p.score) AS y", "transform(pts, p -> p.day) AS d", "size(pts) AS m")
    found = c.select(UNIT, "d", F.expr(walk).alias("_i"))
    return found.selectExpr(UNIT, "transform(_i, (k, n) -> named_struct('day', d[k - 1], 'kind', if(n % 2 = 0, 'fall', 'rise'))) AS pivots")


def _rises(found: DataFrame, out: str) -> DataFrame:
    return found.select(UNIT, F.size(F.filter("pivots", lambda p: p["kind"] == "rise")).alias(out))


def relapses(curve: DataFrame, drop: float = 1.0, rise: float = 1.0) -> DataFrame:
    """Relapses (W5): rises after a fall, each of a day."""
    return _rises(pivots(curve, drop, rise), "n_relapses")


def relapses_sustained(curve: DataFrame, drop: float = 0.5, rise: float = 0.5, hold: int = 2) -> DataFrame:
    """Relapses (W6) whose falls and rises are held on ``hold`` consecutive calendar days."""
    return _rises(pivots(curve, drop, rise, hold), "n_relapses_held")


def last_peak(curve: DataFrame, prominence: float = 0.5) -> DataFrame:
    """First day of the last peak (plateaus included) with at least the given prominence.

    Both ends are padded with 0. The prominence of a peak is its height over the higher of the two lowest points
    reached before a strictly higher value (or the end) on either side.
    """
    a = curve_arrays(curve).withColumn("_y", F.expr("concat(array(0D), transform(pts, p -> p.score), array(0D))")) \
        .withColumn("_m", F.size("_y"))
    h = "_y[i - 1]"
    left = f"array_max(transform(sequence(1, i - 1), j -> if(_y[j - 1] > {h}, j, 0)))"
    right = f"array_min(transform(sequence(i + 1, _m), j -> if(_y[j - 1] > {h}, j, _m + 1)))"
    after = f"array_min(transform(sequence(i + 1, _m), j -> if(_y[j - 1] <> {h}, j, _m + 1)))"
    low_l = f"array_min(slice(_y, {left} + 1, i - {left}))"
    low_r = f"array_min(slice(_y, i, {right} - i))"
    ok = (f"filter(sequence(2, _m - 1), i -> {h} > _y[i - 2] and {after} <= _m and get(_y, {after} - 1) < {h} "
          f"and {h} - greatest({low_l}, {low_r}) >= {prominence}D)")
    return a.withColumn("_i", F.expr(f"array_max({ok})")).select(
        UNIT, F.expr("case when _i is not null then pts[_i - 2].day end").alias("last_peak_day"))


def slope_at_end(curve: DataFrame, days: int = 3) -> DataFrame:
    """OLS slope over the last ``days`` days and its direction; NULL with fewer than two points."""
    near = F.col("day") >= F.col("end_day") - (days - 1)
    g = curve.groupBy(UNIT).agg(F.count_if(near).alias("_n"),
                                F.regr_slope(F.when(near, F.col("score")), F.when(near, F.col("day"))).alias("_s"))
    s = F.when(F.col("_n") >= 2, F.col("_s"))
    return g.select(UNIT, s.alias("slope_at_end"), F.coalesce(sign_label(F.round(s, 9)), F.lit("")).alias("slope_class"))


def summary_features(curve: DataFrame) -> DataFrame:
    """Peak value and its first day, first day above zero, observed share of days."""
    return curve.groupBy(UNIT).agg(
        F.max("score").alias("peak_score"), F.min_by("day", F.struct(-F.col("score"), "day")).alias("peak_day"),
        F.min(F.when(F.col("score") > 0, F.col("day"))).alias("first_symptom_day"),
        (F.count_if(~F.col("imputed")) / (F.max("end_day") + 1).cast("double")).alias("coverage"),
        F.bool_or("imputed").alias("end_imputed"))


def weight_features(curves: DataFrame, ends: DataFrame, weight: str = "weight") -> DataFrame:
    """Baseline weight (mean of days 0-2) and lowest weight up to the end day relative to it."""
    d = curves.join(ends, UNIT)
    base = F.avg(F.when(F.col("day") <= 2, F.col(weight)))
    low = F.min(F.when(F.col("day") <= F.col("end_day"), F.col(weight)))
    return d.groupBy(UNIT).agg(base.alias("baseline"), ratio(low, base).alias("max_loss"))


def animal_features(curves: DataFrame, ends: DataFrame) -> DataFrame:
    """All curve features of each animal in one row.

    Each feature table is written once by a job of its own, so a task sorts the curves for one of them at a time; what is
    joined has a row for each animal.
    """
    curves, ends = cut(curves), cut(ends)
    curve = cut(build_curve(curves, ends))
    on = cut(onset(curve))
    f = cut(summary_features(curve)).join(on, UNIT, "left")
    for part in (trapezoid(curve, out="cumulative_score"),
                 trapezoid(curve, on.where("onset_day is not null").select(UNIT, "onset_day"), "cumulative_since_onset"),
                 relapses(curve), relapses_sustained(curve), last_peak(curve), slope_at_end(curve),
                 weight_features(curves, ends), ends.select(UNIT, "end_day")):
        f = f.join(cut(part), UNIT, "left")
    return (f.withColumn("disease_duration", F.col("end_day") - F.col("onset_day"))
            .withColumn("days_since_last_peak", F.col("end_day") - F.col("last_peak_day")).drop("last_peak_day"))


def align_at_onset(curve: DataFrame, on: DataFrame) -> DataFrame:
    """Curves on the post-onset clock."""
    return (curve.join(on.where("onset_day is not null"), UNIT).where(F.col("day") >= F.col("onset_day"))
            .select(UNIT, (F.col("day") - F.col("onset_day")).alias("t"), "score"))


# ------------------------------------------------------------------ memory

def weighted_history(curves: DataFrame, ends: DataFrame, taus: Sequence[int]) -> DataFrame:
    """Exponentially weighted sum of past scores for every time constant."""
    d = curves.join(ends, UNIT).where(F.col("day") <= F.col("end_day"))
    d = d.select(UNIT, F.col("end_day").alias("_t"), "day", "score", F.explode(F.array(*[F.lit(x) for x in taus])).alias("tau"))
    return d.groupBy(UNIT, "tau").agg(
        F.sum(F.col("score") * F.exp(-(F.col("_t") - F.col("day")) / F.col("tau").cast("double"))).alias("ewi"))


def score_at_lags(curve: DataFrame, on: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Score exactly ``lag`` days before the end, only where the lag fits into the disease duration."""
    want = (curve.groupBy(UNIT).agg(F.max("end_day").alias("end_day")).join(on, UNIT)
            .select(UNIT, "end_day", "onset_day", F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag"))
            .where(F.col("onset_day").isNotNull() & (F.col("lag") <= F.col("end_day") - F.col("onset_day")))
            .withColumn("day", F.col("end_day") - F.col("lag")))
    return want.join(curve.select(UNIT, "day", "score"), [UNIT, "day"]).select(UNIT, "lag", "score")


def lag_profile(lagged: DataFrame, units: DataFrame, program: str, severity: str, floor: int = 5) -> DataFrame:
    """Raw and severity-adjusted rank correlation of the score at each lag with a program."""
    d = lagged.join(units.select(UNIT, program, severity), UNIT)
    r = d.select("lag", midrank("score", ["lag"]).alias("_x"), midrank(program, ["lag"]).alias("_y"),
                 midrank(severity, ["lag"]).alias("_z"))
    g = r.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("raw"),
                             pearson("_x", "_z").alias("_xz"), pearson("_y", "_z").alias("_yz"))
    solid = F.col("n") >= floor
    return g.select("lag", "n", F.when(solid, F.col("raw")).alias("raw"),
                    F.when(solid, partial_r("raw", "_xz", "_yz")).alias("partial"))


def shape_contrast(profile: DataFrame, kind: str = "raw", long_from: int = 7, short_to: int = 3, floor: int = 10
                   ) -> DataFrame:
    """Mean correlation at long lags minus short lags."""
    ok = profile.where((F.col("n") >= floor) & F.col(kind).isNotNull())
    return ok.agg(F.avg(F.when(F.col("lag") >= long_from, F.col(kind))).alias("long_mean"),
                  F.avg(F.when(F.col("lag") <= short_to, F.col(kind))).alias("short_mean")) \
        .withColumn("contrast", F.col("long_mean") - F.col("short_mean"))


def memory_timescale(history: DataFrame, units: DataFrame, program: str, reps: int | None = None, seed: int = 0) -> DataFrame:
    """Time constant with the strongest rank correlation to a program (T31), smallest on ties.

    With ``reps`` the units are drawn with replacement that many times, the same for all time constants, and each replicate gives a row.
    """
    d = history.join(units.select(UNIT, program), UNIT).where(F.col(program).isNotNull() & F.col("ewi").isNotNull())
    if reps is None:
        part = []
        r = large_midrank(large_midrank(d.select("tau", "ewi", program), "ewi", ["tau"], "_x"), program, ["tau"], "_y")
        g = r.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("rho"))
    else:
        part = ["rep"]
        g = resampled_ranks(cut(d), UNIT, [("ewi", program)], reps, seed, part=["tau"], units=units)[0]
        g = g.where("rep >= 0").withColumnRenamed("r_0_1", "rho")
    best = F.struct(F.round("rho", 9), -F.col("tau"))
    return (g.where("rho is not null").groupBy(*part)
            .agg(F.max_by("tau", best).alias("tau_star"), F.max("rho").alias("rho_at_tau"), F.max("tau").alias("_last"),
                 F.max("n").alias("n"))
            .withColumn("at_scan_limit", F.col("tau_star") == F.col("_last")).drop("_last"))


# ------------------------------------------------------------------ functional surface

def covariance_surface(aligned: DataFrame, t: str = "t", y: str = "score") -> DataFrame:
    """Pairwise-complete covariance of the curve at two times, with its support.

    Each unit's short array is expanded in place to its time pairs, so no self-join is shuffled.
    """
    mean = aligned.groupBy(t).agg(F.avg(y).alias("_m"))
    d = aligned.join(mean, t).select(UNIT, t, (F.col(y) - F.col("_m")).alias("_c"))
    a = d.groupBy(UNIT).agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col("_c").alias("v"))).alias("_a"))
    p = a.select(F.explode("_a").alias("p"), "_a").select("p", F.explode("_a").alias("q"))
    return (p.groupBy(F.col("p.t").alias("t1"), F.col("q.t").alias("t2"))
            .agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col("p.v") * F.col("q.v")), F.count(F.lit(1)) - 1).alias("cov")))


def quadratic_vertex(df, part, x, y):
    """Degree-2 fit per group from power sums (T28): curvature, vertex, and whether a peak lies inside the range."""
    m = df.groupBy(*part).agg(F.avg(x).alias("_m"))
    t = F.col(x) - F.col("_m")
    d = df.join(m, list(part)).withColumn("_t", t)
    k = d.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"), F.min("_t").alias("_lo"),
                             F.max("_t").alias("_hi"), *[F.sum(F.pow("_t", F.lit(i))).alias(f"_s{i}") for i in (1, 2, 3, 4)],
                             *[F.sum(F.pow("_t", F.lit(i)) * F.col(y)).alias(f"_y{i}") for i in (0, 1, 2)])
    n, s1, s2, s3, s4 = F.col("n"), *[F.col(f"_s{i}") for i in (1, 2, 3, 4)]
    y0, y1, y2 = [F.col(f"_y{i}") for i in (0, 1, 2)]
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a = n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)
    b = n * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)
    det = F.when(det != 0, det)
    out = k.withColumn("quadratic", a / det).withColumn("_b", b / det)
    v = -F.col("_b") / (2 * F.when(F.col("quadratic") != 0, F.col("quadratic")))
    return out.select(*part, "n", "quadratic", (v + F.col("_m")).alias("vertex"),
                      ((F.col("quadratic") < 0) & (v >= F.col("_lo")) & (v <= F.col("_hi"))).alias("rise_and_fall"))
