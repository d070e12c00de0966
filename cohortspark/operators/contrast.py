"""Group contrasts per feature, and dense two-group effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.ordering import bh_adjust, large_midrank, midrank, ordered_counts
from cohortspark.functions.scalars import c, ratio
from cohortspark.functions.special import p_chi2, p_mann_whitney_exact, p_normal, p_sign, p_student


def level_sums(x: DataFrame, units: DataFrame, feature: str, unit: str, group: str, levels: Sequence[str],
               value: str = "value") -> DataFrame:
    """Per feature one struct ``g<i>`` per level: n (all units, zeros included), sum, sum of squares.

    One conditional aggregate over the non-zero rows; group sizes are a scalar subquery over the units.
    """
    j = x.join(units.select(unit, F.col(group).alias("_g")).where(F.col("_g").isin(list(levels))), unit)
    sizes = units.agg(F.struct(*[F.count_if(F.col(group) == lv).alias(f"n{i}") for i, lv in enumerate(levels)]))
    aggs = []
    for i, lv in enumerate(levels):
        hit = F.when(F.col("_g") == lv, F.col(value)).otherwise(0.0)
        aggs += [F.sum(hit).alias(f"_s{i}"), F.sum(hit * hit).alias(f"_q{i}")]
    g = j.groupBy(feature).agg(*aggs).withColumn("_n", sizes.scalar())
    return g.select(feature, *[F.struct(F.col(f"_n.n{i}").alias("n"), F.col(f"_s{i}").alias("s"),
                                        F.col(f"_q{i}").alias("q")).alias(f"g{i}") for i in range(len(levels))])


def mean_of(i: int) -> Column:
    return ratio(F.col(f"g{i}.s"), F.col(f"g{i}.n"))


def sse_of(i: int) -> Column:
    """Within-level sum of squares; rounding noise of a constant level is cut to 0."""
    v = F.col(f"g{i}.q") - ratio(F.col(f"g{i}.s") * F.col(f"g{i}.s"), F.col(f"g{i}.n"))
    return F.when(v > F.col(f"g{i}.q") * 1e-12, v).otherwise(0.0)


def difference_in_differences(x, units, feature, unit, group, levels: Sequence[str], fdr: bool = False) -> DataFrame:
    """(late_b - early_b) - (late_a - early_a) with the interaction t of the saturated model.

    ``levels`` = early_a, late_a, early_b, late_b.
    """
    g = level_sums(x, units, feature, unit, group, levels)
    a, b = mean_of(1) - mean_of(0), mean_of(3) - mean_of(2)
    df = sum((F.col(f"g{i}.n") for i in range(1, 4)), F.col("g0.n")) - 4
    inv = sum((ratio(F.lit(1.0), F.col(f"g{i}.n")) for i in range(1, 4)), ratio(F.lit(1.0), F.col("g0.n")))
    sse = sum((sse_of(i) for i in range(1, 4)), sse_of(0))
    out = (g.select(feature, a.alias("delta_a"), b.alias("delta_b"), (b - a).alias("did"), df.alias("df"),
                    F.sqrt(sse / df * inv).alias("se"))
           .where("se > 1e-12").withColumn("t", F.col("did") / F.col("se")))
    return bh_adjust(out.withColumn("p", p_student("t", "df")), "p") if fdr else out


def single_contrast(x, units, feature, unit, group, levels: Sequence[str]) -> DataFrame:
    """Two-group mean difference with pooled t: the single-stage comparison a DiD guards against."""
    g = level_sums(x, units, feature, unit, group, levels)
    df = F.col("g0.n") + F.col("g1.n") - 2
    se = F.sqrt((sse_of(0) + sse_of(1)) / df * (ratio(F.lit(1.0), F.col("g0.n")) + ratio(F.lit(1.0), F.col("g1.n"))))
    out = g.select(feature, (mean_of(1) - mean_of(0)).alias("diff"), se.alias("se"), df.alias("df")).where("se > 1e-12")
    return out.withColumn("t", F.col("diff") / F.col("se"))


def mann_whitney(x, units, feature, unit, group, levels: tuple[str, str], value: str = "value",
                 p: bool = False) -> DataFrame:
    """U of level a over level b per feature with tie-corrected, continuity-corrected z, AUC and mean gap.

    Zeros share the lowest midrank, so only non-zero rows are ranked.
    """
    a, b = levels
    u = units.where(F.col(group).isin(a, b)).select(unit, (F.col(group) == a).cast("int").alias("_a"))
    sizes = u.agg(F.struct(F.sum("_a").alias("na"), (F.count(F.lit(1)) - F.sum("_a")).alias("nb"))).scalar()
    j = x.join(u, unit).select(feature, "_a", F.col(value).alias("_x"))
    w = Window.partitionBy(feature, "_x")
    ties = F.count(F.lit(1)).over(w)
    j = j.withColumn("_t", ties).withColumn("_r", midrank("_x", [feature]))
    g = (j.groupBy(feature).agg(F.count(F.lit(1)).alias("_m"), F.sum("_a").alias("_ma"),
                                F.sum(F.col("_a") * F.col("_r")).alias("_ra"),
                                F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"),
                                F.sum(F.col("_a") * F.col("_x")).alias("_sa"), F.sum("_x").alias("_s"))
         .withColumn("_n", sizes))
    na, nb = F.col("_n.na"), F.col("_n.nb")
    n = na + nb
    z = n - F.col("_m")
    rank_a = F.col("_ra") + F.col("_ma") * z + (na - F.col("_ma")) * (z + 1) / 2.0
    tie = (F.col("_ties") + z * z * z - z).cast("double")
    out = g.select(feature, na.alias("na"), nb.alias("nb"), (rank_a - na * (na + 1) / 2.0).alias("u"), tie.alias("_tie"),
                   (ratio("_sa", na) - ratio(F.col("_s") - F.col("_sa"), nb)).alias("mean_diff"))
    n = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12.0 * ((n + 1) - F.col("_tie") / (n * (n - 1))))
    big = F.greatest(F.col("u"), F.col("na") * F.col("nb") - F.col("u"))
    out = out.withColumn("auc", ratio("u", F.col("na") * F.col("nb"))) \
        .withColumn("z", ratio(big - F.col("na") * F.col("nb") / 2.0 - 0.5, sd)).drop("_tie")
    return bh_adjust(out.withColumn("p", p_normal("z")), "p") if p else out


def kruskal(df: DataFrame, part: Sequence[str], group: str, x: str, p: bool = False) -> DataFrame:
    """Kruskal-Wallis H with tie correction on dense rows (T12); groups of one row are left out."""
    size = df.groupBy(*part, group).agg(F.count(F.lit(1)).alias("_k")).where("_k >= 2").drop("_k")
    d = df.where(F.col(x).isNotNull()).join(size, [*part, group])
    # equal values are merged, so neither a part nor a value is ever sorted or counted row by row
    per = d.groupBy(*part, group, x).agg(F.count(F.lit(1)).alias("_w"))
    t = ordered_counts(per, x, part, F.col("_w")).select(*part, x, "_cnt", (F.col("_below") + (F.col("_cnt") + 1) / F.lit(2.0)).alias("_r"))
    per = per.join(t, [*part, x])
    g = per.groupBy(*part, group).agg(F.sum(F.col("_r") * F.col("_w")).alias("_sr"), F.sum("_w").alias("_n"),
                                      F.sum((F.col("_cnt") * F.col("_cnt") - 1) * F.col("_w")).alias("_tie"))
    t = g.groupBy(*part).agg(F.sum(F.col("_sr") * F.col("_sr") / F.col("_n")).alias("_q"), F.sum("_n").alias("n"),
                             F.count(F.lit(1)).alias("k"), F.sum("_tie").alias("_tie"))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_tie") / (n * n * n - n))
    out = t.select(*part, "n", "k", h.alias("h"))
    return out.withColumn("p", p_chi2("h", F.col("k") - 1)) if p else out


def two_group_effects(df: DataFrame, part: Sequence[str], group: str, levels: tuple[str, str], x: str,
                      exact: bool = False) -> DataFrame:
    """Mean gap, Hedges g, U of b over a, rank-biserial on dense rows."""
    a, b = levels
    d = large_midrank(df.where(F.col(group).isin(a, b)), x, part, "_r")
    ina, inb = F.col(group) == a, F.col(group) == b
    g = d.groupBy(*part).agg(
        F.count_if(ina).alias("na"), F.count_if(inb).alias("nb"), F.avg(F.when(ina, F.col(x))).alias("mean_a"),
        F.avg(F.when(inb, F.col(x))).alias("mean_b"), F.var_pop(F.when(ina, F.col(x))).alias("_va"),
        F.var_pop(F.when(inb, F.col(x))).alias("_vb"), F.sum(F.when(inb, F.col("_r"))).alias("_rb"))
    g = g.withColumn("u", F.col("_rb") - F.col("nb") * (F.col("nb") + 1) / 2.0)
    pooled = F.sqrt((F.col("na") * F.col("_va") + F.col("nb") * F.col("_vb")) / (F.col("na") + F.col("nb") - 2))
    out = g.select(*part, "na", "nb", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("diff"), "u",
                   (2 * ratio("u", F.col("na") * F.col("nb")) - 1).alias("rank_biserial"),
                   (ratio(F.col("mean_b") - F.col("mean_a"), pooled)
                    * (1 - 3.0 / (4 * (F.col("na") + F.col("nb")) - 9))).alias("hedges_g"))
    return out.withColumn("p_exact", p_mann_whitney_exact("u", "na", "nb")) if exact else out


def signed_rank(df: DataFrame, part: Sequence[str], diff: str, p: bool = False) -> DataFrame:
    """Wilcoxon signed rank of paired differences, zeros dropped (T13, G9); ``p`` adds the two-sided normal p."""
    d = df.where((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("_a", F.abs(F.col(diff)))
    d = large_midrank(d, "_a", part, "_r")
    ties = d.groupBy(*part, "_a").agg(F.count(F.lit(1)).alias("_t")).groupBy(*part).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_tie"))
    g = d.groupBy(*part).agg(F.count(F.lit(1)).alias("n"),
                             F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
                             F.sum(F.when(F.col(diff) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus")) \
        .withColumn("w", F.least("w_plus", "w_minus"))
    if not p:
        return g
    # normal form with tie correction
    g = g.join(ties, list(part)) if part else g.withColumn("_tie", ties.select("_tie").scalar())
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_tie") / 48)
    return g.withColumn("p", p_normal(ratio(F.col("w") - n * (n + 1) / 4, sd))).drop("_tie")


def sign_test(df: DataFrame, part: Sequence[str], hit: Column) -> DataFrame:
    g = df.groupBy(*part).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("fraction", ratio("k", "n")).withColumn("p", p_sign("k", "n"))


def ordered_pair_fraction(df: DataFrame, group: str, low: str, high: str, x: str) -> DataFrame:
    """Share of (low, high) pairs with x_low < x_high (T32), from prefix counts: no pair is ever formed."""
    is_low, is_high = (F.col(group) == low).cast("bigint"), (F.col(group) == high).cast("bigint")
    d = df.where(F.col(group).isin(low, high))
    t = ordered_counts(d, x, weight=is_low)
    high_n = d.where(F.col(group) == high).groupBy(x).agg(F.count(F.lit(1)).alias("_h"))
    n = d.agg(F.struct(F.sum(is_low).alias("nl"), F.sum(is_high).alias("nh"))).scalar()
    return (t.join(high_n, x).agg(F.sum(F.col("_below") * F.col("_h")).alias("pairs_ordered"))
            .withColumn("_n", n)
            .select("pairs_ordered", ratio("pairs_ordered", F.col("_n.nl") * F.col("_n.nh")).alias("fraction")))


def bonferroni_gate(df: DataFrame, auc: str, p: str, screen: float = 0.62, level: float = 0.05) -> DataFrame:
    """Rows passing the screen, with the corrected level over all rows tested."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return (df.withColumn("n_tests", n).where(F.col(auc) >= screen)
            .withColumn("passes", F.col(p) <= F.lit(level) / F.col("n_tests")))


# ------------------------------------------------------------------ stage profiles

def stage_contrasts(x, units, feature, unit, group, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Amplitude, floor drift and peak drift from stage means.

    ``levels``: ``high`` and ``low`` lists of stages, ``floor`` (first, last) and ``peak`` (first, last).
    """
    stages = sorted({s for v in levels.values() for s in v})
    g = level_sums(x, units, feature, unit, group, stages)
    at = {s: i for i, s in enumerate(stages)}

    def pooled(names):
        s = sum((F.col(f"g{at[k]}.s") for k in names[1:]), F.col(f"g{at[names[0]]}.s"))
        n = sum((F.col(f"g{at[k]}.n") for k in names[1:]), F.col(f"g{at[names[0]]}.n"))
        return ratio(s, n)
    f0, f1 = levels["floor"]
    p0, p1 = levels["peak"]
    return g.select(feature, (pooled(list(levels["high"])) - pooled(list(levels["low"]))).alias("amplitude"),
                    (mean_of(at[f1]) - mean_of(at[f0])).alias("floor_drift"),
                    (mean_of(at[p1]) - mean_of(at[p0])).alias("peak_drift"))


def temporal_class(amplitude="amplitude", floor="floor_drift", high: float = 0.3, flat: float = 0.15,
                   up: float = 0.2) -> Column:
    """Acute / ratchet classes with the override order kept."""
    hi, rises = c(amplitude) > high, c(floor) > up
    return (F.when(hi & rises, "acute+ratchet").when(rises, "ratchet_cumulative")
            .when(hi & (c(floor) < flat), "acute_oscillating").otherwise("other"))


def trajectory_class(relapse, quiet, cut: float = 0.25) -> Column:
    """Relapse-specific, monophasic-specific or shared rise."""
    return (F.when((c(relapse) >= cut) & (c(quiet) < cut / 2), "relapse_specific")
            .when((c(quiet) >= cut) & (c(relapse) < cut / 2), "monophasic_specific")
            .when((c(relapse) >= cut) & (c(quiet) >= cut), "shared_up").otherwise("other"))


def accrual_class(day="r_day", score="r_score", accrue: float = 0.30, severe: float = 0.30) -> Column:
    """Accrual against severity from the two partial correlations (P8); accrual wins."""
    return (F.when(c(day) >= accrue, "accrual_up").when(c(day) <= -accrue, "accrual_down")
            .when(F.abs(c(score)) >= severe, "severity_oscillating").otherwise("other"))


def conserved_class(a, b, cut: float = 0.30) -> Column:
    """The same direction of trend in two cohorts."""
    return (F.when((c(a) >= cut) & (c(b) >= cut), "accrue_both").when((c(a) <= -cut) & (c(b) <= -cut), "decline_both").otherwise("other"))


def profile_correlation(x, units, feature, unit, group, levels: Sequence[str], reference) -> DataFrame:
    """Correlation of every feature's stage-mean profile with that of a reference feature."""
    g = level_sums(x, units, feature, unit, group, levels)
    prof = g.select(feature, F.array(*[mean_of(i) for i in range(len(levels))]).alias("_p"))
    ref = prof.where(F.col(feature) == reference).select("_p").scalar()

    def centred(a):
        m = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / float(len(levels))
        return F.transform(a, lambda v: v - m)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    d = prof.withColumn("_ref", ref).withColumn("_r", centred(F.col("_ref"))).withColumn("_p", centred("_p"))
    norm = F.sqrt(dot(F.col("_p"), F.col("_p")) * dot(F.col("_r"), F.col("_r")))
    return d.where(F.col(feature) != reference).where(norm > 1e-12) \
        .select(feature, (dot(F.col("_p"), F.col("_r")) / norm).alias("profile_corr"))


def shift_share(fractions: DataFrame, expression: DataFrame, units: DataFrame, unit: str, kind: str, feature: str,
                axis: str) -> DataFrame:
    """Split of a feature's covariance with ``axis`` into composition, intrinsic change and interaction.

    ``fractions`` (unit, kind, fraction), ``expression`` (unit, kind, feature, value; non-zero rows), ``units``
    (unit, axis) with ``axis`` centred over all units. A type missing in a unit takes the cohort mean of the type.
    Everything is linear, so only sums per (kind, feature) are formed; no units x kinds x features array exists.
    """
    n = units.agg(F.count(F.lit(1))).scalar()
    fr = fractions.join(units.select(unit, F.col(axis).alias("_d")), unit)
    per_kind = (fr.groupBy(kind).agg(F.count(F.lit(1)).alias("_present"), F.sum("fraction").alias("_f"),
                                     F.sum(F.col("fraction") * F.col("_d")).alias("_fd"), F.sum("_d").alias("_dp"))
                .withColumn("_n", n))
    ex = expression.join(fr, [unit, kind])
    cell = (ex.groupBy(kind, feature).agg(F.sum("value").alias("_e"), F.sum(F.col("value") * F.col("_d")).alias("_ed"),
                                          F.sum(F.col("value") * F.col("fraction") * F.col("_d")).alias("_efd"))
            .join(per_kind, kind))
    ebar = F.col("_e") / F.col("_present")
    # the axis is centred: its sum over units lacking the type is minus its sum over units having it
    g = cell.groupBy(feature).agg(
        (F.sum("_efd") / F.max("_n")).alias("cov_total"), (F.sum(ebar * F.col("_fd")) / F.max("_n")).alias("cov_comp"),
        (F.sum(F.col("_f") / F.col("_n") * (F.col("_ed") - ebar * F.col("_dp"))) / F.max("_n")).alias("cov_intr"))
    g = g.withColumn("cov_inter", F.col("cov_total") - F.col("cov_comp") - F.col("cov_intr"))
    den = F.when(F.abs("cov_total") >= 1e-9, F.col("cov_total"))
    return g.select("*", (F.col("cov_comp") / den).alias("comp_share"), (F.col("cov_intr") / den).alias("intr_share"),
                    (F.col("cov_inter") / den).alias("inter_share"))


def driver_class(comp="comp_share", intr="intr_share", cut: float = 0.6) -> Column:
    return F.when(c(comp) >= cut, "compositional").when(c(intr) >= cut, "intrinsic").otherwise("mixed")
