"""Per-feature rank and linear statistics from sparse moments.

All tests over features reduce to sums over the non-zero rows of each feature plus totals over the units, which ride
along on the unit rows. The implicit zeros enter in closed form (they share one midrank, the lowest). One shuffle
ranks the non-zero rows of a feature, and the moment aggregate reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import kernels as NK
from cohortspark.functions.ordering import bh_adjust, large_midrank, midrank, top_k, weighted_midrank
from cohortspark.functions.scalars import c, clip, ratio
from cohortspark.functions.special import p_student
from cohortspark.session import cut, spread


def unit_frame(units: DataFrame, unit: str, covs: Sequence[str], by: Sequence[str] = (), ranked: bool = True
               ) -> DataFrame:
    """Units with centred covariates (or their midranks) and, on every row, the totals of the stratum."""
    w = Window.partitionBy(*by)
    base = units.select(unit, *by, *covs)
    for v in covs:
        col = midrank(v, by) if ranked else F.col(v).cast("double")
        base = base.withColumn(f"c_{v}", col)
    base = base.withColumn("n", F.count(F.lit(1)).over(w))
    for v in covs:
        base = base.withColumn(f"c_{v}", F.col(f"c_{v}") - F.avg(f"c_{v}").over(w))
    for i, v in enumerate(covs):
        for u in covs[i:]:
            base = base.withColumn(f"s_{v}_{u}", F.sum(F.col(f"c_{v}") * F.col(f"c_{u}")).over(w))
    return base.drop(*covs)


def sparse_moments(x: DataFrame, units: DataFrame, feature: str | Sequence[str], unit: str, covs: Sequence[str],
                   by: Sequence[str] = (), value: str = "value", ranked: bool = True) -> DataFrame:
    """Per feature: n, centred sum of squares ``sxx`` and cross products ``sx_<cov>``, mean ``mx`` and unit totals.

    ``x`` holds the non-zero rows (all values above 0). With ``ranked`` the values are midranks among all units of
    the stratum, zeros included.
    """
    feats = [feature] if isinstance(feature, str) else list(feature)
    part = [*by, *feats]
    u = unit_frame(units, unit, covs, by, ranked)
    j = x.select(*feats, unit, F.col(value).cast("double").alias("_x")).join(u, unit)
    if ranked:
        j = spread(j, *part)       # the sorts take more memory than the bytes that AQE merges tasks by
        nz = F.count(F.lit(1)).over(Window.partitionBy(*part))
        j = j.withColumn("_v", midrank("_x", part) + F.col("n") - nz)
    else:
        j = j.withColumn("_v", F.col("_x"))
    aggs = [F.max("n").alias("n"), F.count(F.lit(1)).alias("m"), F.sum("_v").alias("_s1"),
            F.sum(F.col("_v") * F.col("_v")).alias("_s2"),
            F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    for i, v in enumerate(covs):
        aggs += [F.sum(F.col("_v") * F.col(f"c_{v}")).alias(f"_sx_{v}"), F.sum(f"c_{v}").alias(f"_snz_{v}")]
        aggs += [F.max(f"s_{v}_{w}").alias(f"s_{v}_{w}") for w in covs[i:]]
    g = j.groupBy(*part).agg(*aggs)
    z = F.col("n") - F.col("m")
    zv = (z + 1) / F.lit(2.0) if ranked else F.lit(0.0)
    sx = F.col("_s1") + z * zv
    sxx = F.col("_s2") + z * zv * zv - sx * sx / F.col("n")
    constant = (z == 0) & (F.col("_lo") == F.col("_hi"))
    out = [*part, "n", "m", (sx / F.col("n")).alias("mx"),
           F.when(constant, F.lit(0.0)).otherwise(sxx).alias("sxx")]
    for i, v in enumerate(covs):
        # covariates are centred, so the zeros' part is zv * (0 - their sum over non-zero rows)
        out += [(F.col(f"_sx_{v}") - zv * F.col(f"_snz_{v}")).alias(f"sx_{v}")]
        out += [F.col(f"s_{v}_{w}") for w in covs[i:]]
    return g.select(*out)


def r_x(v: str) -> Column:
    """Correlation of the feature with covariate ``v``."""
    return ratio(f"sx_{v}", F.sqrt(F.col("sxx") * F.col(f"s_{v}_{v}")))


def r_cov(v: str, w: str) -> Column:
    return ratio(f"s_{v}_{w}", F.sqrt(F.col(f"s_{v}_{v}") * F.col(f"s_{w}_{w}")))


def t_of_r(r, df) -> Column:
    r = c(r)
    return r * F.sqrt(c(df) / F.greatest(F.lit(1.0) - r * r, F.lit(1e-12)))


def partial_r(rxy, rxz, ryz) -> Column:
    rxy, rxz, ryz = c(rxy), c(rxz), c(ryz)
    den = F.sqrt(F.greatest((1 - rxz * rxz) * (1 - ryz * ryz), F.lit(1e-12)))
    return (rxy - rxz * ryz) / den


def _with_fdr(df: DataFrame, family: Sequence[str]) -> DataFrame:
    return bh_adjust(df, "p", family, "q")


def spearman_trend(x: DataFrame, units: DataFrame, feature: str, unit: str, target: str, by: Sequence[str] = (),
                   value: str = "value", fdr: bool = True) -> DataFrame:
    """Spearman of every feature with a unit variable; constant features dropped."""
    m = sparse_moments(x, units, feature, unit, [target], by, value).where("sxx > 0")
    out = m.select(*by, feature, "n", r_x(target).alias("rho"))
    if not fdr:
        return out
    return _with_fdr(out.withColumn("p", p_student(t_of_r("rho", F.col("n") - 2), F.col("n") - 2)), by)


def partial_trend(x: DataFrame, units: DataFrame, feature: str, unit: str, target: str, given: str,
                  by: Sequence[str] = (), value: str = "value", ranked: bool = True, fdr: bool = True) -> DataFrame:
    """Partial Spearman (T2) or partial Pearson (T4, ``ranked=False``) with one covariate, t with n - 3."""
    out = _partial_one(sparse_moments(x, units, feature, unit, [target, given], by, value, ranked), feature, target, given, by)
    if not fdr:
        return out
    return _with_fdr(out.withColumn("p", p_student(t_of_r("partial", F.col("n") - 3), F.col("n") - 3)), by)


def _partial_one(m: DataFrame, feature: str, target: str, given: str, by: Sequence[str] = ()) -> DataFrame:
    """Partial correlation given one covariate, from moments of both."""
    out = m.where("sxx > 1e-12").select(*by, feature, "n", r_x(target).alias("r_raw"), r_x(given).alias("r_given"),
                                        r_cov(target, given).alias("r_target_given"))
    return out.withColumn("partial", partial_r("r_raw", "r_given", "r_target_given"))


def partial_trend_two(x: DataFrame, units: DataFrame, feature: str, unit: str, target: str,
                      given: tuple[str, str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Partial rank correlation given two covariates (T3): recursion of the one-covariate formula."""
    return _partial_two(sparse_moments(x, units, feature, unit, [target, *given], by, value), feature, target, given, by)


def _partial_two(m: DataFrame, feature: str, target: str, given: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Partial correlation given two covariates, from moments of all three."""
    a, b = given
    m = m.where("sxx > 0").select(*by, feature, "n", r_x(target).alias("xy"), r_x(a).alias("xa"), r_x(b).alias("xb"),
                 r_cov(target, a).alias("ya"), r_cov(target, b).alias("yb"), r_cov(a, b).alias("ab"))
    return (m.withColumn("xy_a", partial_r("xy", "xa", "ya")).withColumn("xb_a", partial_r("xb", "xa", "ab"))
            .withColumn("yb_a", partial_r("yb", "ya", "ab"))
            .select(*by, feature, "n", F.col("xy").alias("r_raw"),
                    partial_r("xy_a", "xb_a", "yb_a").alias("partial")))


def trend_with_gate(x: DataFrame, units: DataFrame, feature: str, unit: str, target: str, given: str, depth: str,
                    value: str = "value", limit: float = 0.4) -> DataFrame:
    """Technical gate (T26): where depth itself trends with the target, depth joins the covariates.

    Both partial correlations come from one table of moments, a row for each feature, which is written once.
    """
    m = cut(sparse_moments(x, units, feature, unit, [target, given, depth], (), value))
    one = _partial_one(m, feature, target, given).select(feature, "n", F.col("partial").alias("partial_one"))
    two = _partial_two(m, feature, target, (given, depth)).select(feature, F.col("partial").alias("partial_two"))
    r = midrank
    ranks = units.select(r(target).alias("_t"), r(depth).alias("_d"))
    gate = ranks.agg(F.corr("_t", "_d")).scalar()
    return (one.join(two, feature).withColumn("r_depth", gate)
            .select(feature, "n", "r_depth", "partial_one", "partial_two",
                    F.when(F.abs("r_depth") >= limit, F.col("partial_two")).otherwise(F.col("partial_one"))
                    .alias("partial_used")))


def grouped_spearman(df: DataFrame, x: str, y: str, part: Sequence[str]) -> DataFrame:
    """Spearman of two dense columns per group; constant columns give NULL."""
    t = df.select(*part, midrank(x, part).alias("_rx"), midrank(y, part).alias("_ry"))
    return t.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("rho"))


def pearson(x, y) -> Column:
    """Correlation as an aggregate, NULL (not an error) where either side is constant."""
    x, y = c(x), c(y)
    return ratio(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def weighted_rank_matrix(d: DataFrame, codes: Sequence[str], part: Sequence[str], weight: str) -> DataFrame:
    """Rank correlations of code columns where a row stands for ``weight`` equal rows: (part, n, r_i_j for columns i < j).

    Ranks of distinct codes are joined back; rows with a null code take no part, and a constant column gives nulls.
    """
    part, k = list(part), len(codes)
    for x in codes:
        d = d.where(F.col(x).isNotNull())
    d = base = d.select(*part, *codes, weight)
    for i, x in enumerate(codes):
        # measured from the middle rank, which is the mean; always from the base rows, so that the plan grows by one branch a column
        ranks = weighted_midrank(base, x, part, weight).select(*part, x, (F.col("_rank") - (F.col("_total") + 1) / 2.0).alias(f"_x{i}"))
        d = d.join(ranks, [*part, x])
    sums = [F.sum(F.col(weight) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
    g = d.groupBy(*part).agg(F.sum(weight).alias("n"), *sums)
    return g.select(*part, "n", *[ratio(f"_s{i}_{j}", F.sqrt(f"_s{i}_{i}") * F.sqrt(f"_s{j}_{j}")).alias(f"r_{i}_{j}")
                                  for i in range(k) for j in range(i + 1, k)])


def weighted_rank_corr(d: DataFrame, x: str, y: str, part: Sequence[str], weight: str) -> DataFrame:
    """Rank correlation of two code columns under weights: (part, n, rho)."""
    return weighted_rank_matrix(d, [x, y], part, weight).withColumnRenamed("r_0_1", "rho")


def feature_correlations(long: DataFrame, unit: str, feature: str, value: str) -> DataFrame:
    """Spearman matrix of features, pairwise complete (T5): equal units are joined, ranks taken per pair.

    The pair table has features^2 x units rows; features are a short fixed list here.
    """
    t = long.where(F.col(value).isNotNull())
    a = t.select(unit, F.col(feature).alias("f1"), F.col(value).alias("v1"))
    b = t.select(unit, F.col(feature).alias("f2"), F.col(value).alias("v2"))
    return grouped_spearman(a.join(b, unit), "v1", "v2", ["f1", "f2"])


def residualise(df: DataFrame, y: str, covar: str, part: Sequence[str] = (), out: str = "resid") -> DataFrame:
    """OLS residual on one covariate (T6); groups with fewer than 3 complete rows give NULL."""
    ok = F.col(y).isNotNull() & F.col(covar).isNotNull()
    w = Window.partitionBy(*part)
    yy, xx = F.when(ok, F.col(y)), F.when(ok, F.col(covar))
    slope = F.regr_slope(yy, xx).over(w)
    return df.withColumn(out, F.when(ok & (F.count(F.when(ok, 1)).over(w) >= 3),
                                     F.col(y) - F.avg(yy).over(w) - slope * (F.col(covar) - F.avg(xx).over(w))))


def leave_one_out_residual(units: DataFrame, y: str, covar: str, out: str = "resid_loo") -> DataFrame:
    """Leak-free residual: the line is fitted without the row itself, from leave-one-out sums."""
    # sums over all units are one row; the centred sums are n times the (co)variance
    whole = units.agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_ay"), F.avg(covar).alias("_ax"),
                      (F.covar_pop(covar, y) * F.count(F.lit(1))).alias("_sxy"), (F.var_pop(covar) * F.count(F.lit(1))).alias("_sxx"))
    d = units.join(F.broadcast(whole)).withColumn("_y", F.col(y) - F.col("_ay")).withColumn("_x", F.col(covar) - F.col("_ax"))
    n = F.col("_n") - 1
    sx, sy = -F.col("_x"), -F.col("_y")
    sxy, sxx = F.col("_sxy") - F.col("_x") * F.col("_y"), F.col("_sxx") - F.col("_x") * F.col("_x")
    slope = ratio(sxy - sx * sy / n, sxx - sx * sx / n)
    return (d.withColumn("_b", slope).withColumn("_mx", sx / n).withColumn("_my", sy / n)
            .withColumn(out, F.col("_y") - F.col("_my") - F.col("_b") * (F.col("_x") - F.col("_mx")))
            .drop("_x", "_y", "_b", "_mx", "_my", "_n", "_ay", "_ax", "_sxy", "_sxx"))


def variance_explained(units: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """R2 on one and on two covariates and the variance inflation factor (T7), from correlations."""
    r = units.agg(pearson(y, a).alias("ya"), pearson(y, b).alias("yb"), pearson(a, b).alias("ab"),
                  F.count(F.lit(1)).alias("n"))
    both = (F.col("ya") ** 2 + F.col("yb") ** 2 - 2 * F.col("ya") * F.col("yb") * F.col("ab")) / (1 - F.col("ab") ** 2)
    return r.select("n", (F.col("ya") ** 2).alias("r2_a"), (F.col("yb") ** 2).alias("r2_b"), both.alias("r2_both"),
                    (1 / (1 - F.col("ab") ** 2)).alias("vif"))


def slope_interaction(x: DataFrame, units: DataFrame, feature: str, unit: str, score: str, group: str,
                      levels: tuple[str, str], value: str = "value") -> DataFrame:
    """Slope of every feature on ``score`` in two groups and their difference with its t and p.

    The model is saturated in the group, so the interaction is the difference of the two within-group slopes and
    the residual variance pools both; both come from sparse moments per (group, feature).
    """
    a, b = levels
    g = sparse_moments(x, units, feature, unit, [score], [group], value, ranked=False)
    part = F.struct("n", "sxx", "mx", f"sx_{score}", f"s_{score}_{score}")
    tot = units.groupBy().agg(
        *[F.count_if(F.col(group) == lv).alias(f"n_{i}") for i, lv in enumerate(levels)],
        *[(F.var_pop(F.when(F.col(group) == lv, F.col(score)))
           * F.count_if(F.col(group) == lv)).alias(f"s_{i}") for i, lv in enumerate(levels)])
    w = (g.groupBy(feature).agg(F.max(F.when(F.col(group) == a, part)).alias("A"),
                                F.max(F.when(F.col(group) == b, part)).alias("B"))
         .withColumn("_t", tot.select(F.struct("*")).scalar()))

    def get(side, name):
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(0.0))
    ba, bb = get("A", f"sx_{score}") / F.col("_t.s_0"), get("B", f"sx_{score}") / F.col("_t.s_1")
    sse = (get("A", "sxx") - ba * get("A", f"sx_{score}")) + (get("B", "sxx") - bb * get("B", f"sx_{score}"))
    df = F.col("_t.n_0") + F.col("_t.n_1") - 4
    se = F.sqrt(F.greatest(sse / df, F.lit(0.0)) * (1 / F.col("_t.s_0") + 1 / F.col("_t.s_1")))
    out = w.select(feature, ba.alias("slope_a"), bb.alias("slope_b"), (bb - ba).alias("interaction"),
                   se.alias("se"), df.alias("df")).where("se > 1e-12")
    return out.withColumn("t", F.col("interaction") / F.col("se"))


def within_unit_slopes(long: DataFrame, levels: DataFrame, unit: str, feature: str, x: str, y: str) -> DataFrame:
    """Slope inside each unit over all its levels, then a one-sample t across units.

    ``long`` has the non-zero rows; ``levels`` lists every level ``x`` that a unit has (after any cell floor). Levels
    without a row are zeros: they add nothing to the cross product and count in the unit's mean and spread of ``x``. A unit in
    which the feature is zero everywhere has slope 0. Units with one level have no slope.
    """
    u = levels.select(unit, x).distinct().groupBy(unit).agg(F.avg(x).alias("_mx"), (F.var_pop(x) * F.count(F.lit(1))).alias("_sx"))
    u = u.where("_sx > 0")
    n = u.agg(F.count(F.lit(1))).scalar()
    cross = (F.col(x) - F.col("_mx")) * F.col(y)
    s = (long.join(levels.select(unit, x).distinct(), [unit, x], "left_semi").join(u, unit)
         .groupBy(unit, feature).agg((F.sum(cross) / F.max("_sx")).alias("slope")))
    g = s.groupBy(feature).agg(F.sum("slope").alias("_s"), F.sum(F.col("slope") * F.col("slope")).alias("_q")).withColumn("n", n)
    var = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)
    g = g.where("n > 1").select(feature, "n", (F.col("_s") / F.col("n")).alias("mean_slope"), var.alias("_v"))
    return g.withColumn("t", ratio("mean_slope", F.sqrt(F.col("_v") / F.col("n")))).drop("_v")


def agreement(a: DataFrame, b: DataFrame, feature: str, x: str, q: str | None = None, level: float = 0.05
              ) -> DataFrame:
    """Agreement of two effect tables (T24): rank correlation with its t probability, share of equal sign and, given ``q``, shared hits."""
    j = a.select(feature, F.col(x).alias("_x1"), *([F.col(q).alias("_qa")] if q else [])) \
        .join(b.select(feature, F.col(x).alias("_x2"), *([F.col(q).alias("_qb")] if q else [])), feature)
    ranks = large_midrank(large_midrank(j, "_x1", out="_ra"), "_x2", out="_rb")
    both = [F.count_if((F.col("_qa") < level) & (F.col("_qb") < level)).alias("n_both")] if q else []
    out = ranks.agg(F.count(F.lit(1)).alias("n"), pearson("_ra", "_rb").alias("rho"),
                    F.avg((F.signum("_x1") == F.signum("_x2")).cast("double")).alias("same_sign"), *both)
    return out.withColumn("p", p_student(t_of_r("rho", F.col("n") - 2), F.col("n") - 2))


def conserved_lists(a: DataFrame, b: DataFrame, feature: str, x: str, k: int) -> DataFrame:
    """The ``k`` features that rise most, and fall most, in both effect tables (T24): direction, place, feature, a, b.

    Only features whose effects have one sign in both count; they are ordered by the sum of the two, ties by feature.
    """
    j = a.select(feature, F.col(x).alias("a")).join(b.select(feature, F.col(x).alias("b")), feature)
    side = F.when((F.col("a") > 0) & (F.col("b") > 0), "up").when((F.col("a") < 0) & (F.col("b") < 0), "down")
    j = j.withColumn("direction", side).where("direction IS NOT NULL").withColumn("_s", F.round(F.abs(F.col("a") + F.col("b")), 9))
    best = top_k(j, [F.col("_s").desc(), F.col(feature)], k, ["direction"])
    w = Window.partitionBy("direction").orderBy(F.col("_s").desc(), feature)   # 2 k rows
    return best.select("direction", F.row_number().over(w).alias("place"), feature, "a", "b")


def dominance_counts(points: DataFrame, asks: DataFrame, strip: int | None = None) -> DataFrame:
    """``asks`` (ask, qx, after, qy) with ``below``: the weight of ``points`` (x, y, w) with x < qx (x <= qx if ``after``) and y < qy.

    Points and asks are range-partitioned twice, by (x, y) and by y, into as many strips as the square root of their number. An ask is
    answered by three sums: over whole x-strips and whole y-strips before it, from prefix sums of the table of strip pairs; inside its
    x-strip; and inside its y-strip over the x-strips before. Ties of x are ordered by y, so a value that a third of the points share is
    many strips. No pair of points is formed, and a task holds one strip.
    """
    spark = points.sparkSession
    inf = F.lit(float("inf"))
    rows = points.select(F.lit(None).cast("long").alias("ask"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
                         F.col("w").cast("long").alias("w"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("qy"))
    rows = rows.unionByName(asks.select(F.col("ask").cast("long").alias("ask"), F.col("qx").cast("double").alias("x"), F.when(F.col("after"), inf).otherwise(-inf).alias("y"),
                                        F.lit(0).cast("long").alias("w"), F.when(F.col("after"), 1).otherwise(-1).alias("kind"), F.col("qy").cast("double").alias("qy")))
    rows = cut(rows)
    n = rows.count()
    strips = max(1, -(-n // strip)) if strip else max(1, int(n ** 0.5) // 16)
    by_x = cut(rows.repartitionByRange(strips, "x", "y", "kind", "ask").withColumn("bx", F.spark_partition_id()))
    # second order: an ask stands before the points that equal its qy
    turned = by_x.select("ask", "bx", "w", F.coalesce("qy", "y").alias("y"), F.col("ask").isNull().cast("int").alias("kind"))
    by_y = cut(turned.repartitionByRange(strips, "y", "kind", "bx", "ask").withColumn("by", F.spark_partition_id()))

    def inside_x(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "kind"], kind="stable")
        return _answers(pdf, pdf["y"].to_numpy(float), pdf["qy"].to_numpy(float), np.arange(len(pdf)))

    def inside_y(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "kind"], kind="stable")
        b = pdf["bx"].to_numpy(float)
        return _answers(pdf, b, b, np.arange(len(pdf)))
    kind = "ask long, part long"
    one = by_x.groupBy("bx").applyInPandas(inside_x, kind)
    two = by_y.groupBy("by").applyInPandas(inside_y, kind)
    # whole strips on both sides: prefix sums over the table of strip pairs, about as many cells as points at most
    grid = by_y.groupBy("by", "bx").agg(F.sum("w").alias("w"))
    every = spark.range(strips).select(F.col("id").cast("int").alias("by")).crossJoin(spark.range(strips).select(F.col("id").cast("int").alias("bx")))
    grid = every.join(grid, ["by", "bx"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    grid = grid.withColumn("w", F.sum("w").over(Window.partitionBy("by").orderBy("bx")))
    grid = grid.withColumn("w", F.sum("w").over(Window.partitionBy("bx").orderBy("by")))
    three = by_y.where("ask IS NOT NULL AND by > 0 AND bx > 0").select("ask", (F.col("by") - 1).alias("by"), (F.col("bx") - 1).alias("bx")).join(grid, ["by", "bx"]).select("ask", F.col("w").alias("part"))
    below = one.unionByName(two).unionByName(three).groupBy("ask").agg(F.sum("part").alias("below"))
    return asks.join(below, "ask")


def _answers(pdf: pd.DataFrame, value: np.ndarray, under: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """For the asks of a strip in order: the weight of the points before them with a value under theirs."""
    ask = pdf["ask"].notna().to_numpy()
    point = ~ask
    before = np.cumsum(point)[ask]
    distinct = np.unique(value[point])
    got = NK.prefix_below(np.searchsorted(distinct, value[point]), pdf["w"].to_numpy(np.int64)[point], before, np.searchsorted(distinct, under[ask], "left"))
    return pd.DataFrame({"ask": pdf["ask"].to_numpy()[ask].astype(np.int64), "part": got})


def empirical_rank(effects: DataFrame, feature: str, effect: str, match: str, tolerance: float = 0.10,
                   wide: float = 0.15, floor: int = 100) -> DataFrame:
    """Share of features with a weaker effect, among all and among those matched on ``match``.

    The band around a feature is the difference of two dominance counts (:func:`dominance_counts`), so a band may hold all features. The
    wide band is used where the narrow one has fewer than ``floor`` features.
    """
    from cohortspark.functions.ordering import ordered_counts
    base = cut(effects.select(F.col(feature).alias(feature), F.col(match).cast("double").alias("m0"), F.abs(F.col(effect)).cast("double").alias("e0")))
    merged = cut(base.groupBy("m0", "e0").agg(F.count(F.lit(1)).alias("w")))
    inf = float("inf")
    bounds = [(0, tolerance, True, False), (1, -tolerance, False, False), (2, wide, True, False), (3, -wide, False, False),
              (4, tolerance, True, True), (5, -tolerance, False, True), (6, wide, True, True), (7, -wide, False, True)]
    # eight asks for each distinct (match, effect): both ends of both bands, for all and for weaker effects; half a billionth of slack
    # on either side keeps a feature at exactly the tolerance inside
    ends = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("m0") + F.lit(d + (5e-10 if a else -5e-10))).alias("qx"), F.lit(a).alias("after"),
                              (F.col("e0") if weak else F.lit(inf)).alias("qy")) for k, d, a, weak in bounds])
    numbered = cut(merged.select("m0", "e0", F.monotonically_increasing_id().alias("_no")))
    asks = numbered.withColumn("_e", F.explode(ends)).select((F.col("_no") * 8 + F.col("_e.k")).alias("ask"), "_e.qx", "_e.after", "_e.qy")
    got = dominance_counts(merged.select(F.col("m0").alias("x"), F.col("e0").alias("y"), "w"), asks)
    at = lambda k: F.max(F.when(F.pmod("ask", F.lit(8)) == k, F.col("below")))
    near = got.groupBy(F.floor(F.col("ask") / 8).cast("long").alias("_no")).agg(
        (at(0) - at(1)).alias("n_near"), (at(4) - at(5)).alias("k_near"), (at(2) - at(3)).alias("n_wide"), (at(6) - at(7)).alias("k_wide"))
    near = numbered.join(near, "_no").drop("_no")
    overall = ordered_counts(base, "e0").select(F.col("e0"), (F.col("_below") / F.col("_total")).alias("rank_all"))
    use_wide = F.col("n_near") < floor
    return (base.join(near, ["m0", "e0"]).join(overall, "e0")
            .select(feature, "rank_all", F.when(use_wide, F.col("n_wide")).otherwise(F.col("n_near")).alias("n_matched"),
                    F.when(use_wide, ratio("k_wide", "n_wide")).otherwise(ratio("k_near", "n_near")).alias("rank_matched")))
