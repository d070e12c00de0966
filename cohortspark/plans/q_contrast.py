"""Group contrasts, stage profiles, shift-share: T9-T13, T27, T28, T32, T33, A18, A22, A24-A29, P8."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import scalars as S
from cohortspark.operators import association as A
from cohortspark.operators import contrast as K
from cohortspark.operators import counts as C
from cohortspark.operators import evaluation as E
from cohortspark.operators import selection as P
from cohortspark.plans.q_association import RANK_SQL, gauss_tail, pb, region_rank
from cohortspark.plans.registry import query


def staged(t):
    return t.animals.withColumn("group", F.concat_ws(":", "model", "stage"))


@query("t9_difference_in_differences", """
WITH g AS (SELECT gene_id, model || ':' || stage AS g, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS sse FROM pb_cov
           WHERE stage IN ('ONSET1', 'PEAK1') GROUP BY 1, 2),
w AS (SELECT gene_id, max(m) FILTER (g = 'MONO:PEAK1') - max(m) FILTER (g = 'MONO:ONSET1') AS delta_a,
             max(m) FILTER (g = 'RR:PEAK1') - max(m) FILTER (g = 'RR:ONSET1') AS delta_b, sum(n)::bigint - 4 AS df,
             sqrt(sum(sse) / (sum(n) - 4) * sum(1.0::double / n)) AS se FROM g GROUP BY 1)
SELECT gene_id, delta_a, delta_b, delta_b - delta_a AS did, df, se, (delta_b - delta_a) / se AS t FROM w WHERE se > 1e-12""",
       "delta_a delta_b did se t")
def _(t):
    return K.difference_in_differences(pb(t), staged(t), "gene_id", "animal_id", "group",
                                       ["MONO:ONSET1", "MONO:PEAK1", "RR:ONSET1", "RR:PEAK1"])


@query("t9_single_stage_trap", """
WITH g AS (SELECT gene_id, model AS g, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS sse FROM pb_cov
           WHERE stage = 'PEAK1' GROUP BY 1, 2),
w AS (SELECT gene_id, max(m) FILTER (g = 'RR') - max(m) FILTER (g = 'MONO') AS diff, sum(n)::bigint - 2 AS df,
             sqrt(sum(sse) / (sum(n) - 2) * sum(1.0::double / n)) AS se FROM g GROUP BY 1)
SELECT gene_id, diff, se, df, diff / se AS t FROM w WHERE se > 1e-12""", "diff se t")
def _(t):
    return K.single_contrast(pb(t), staged(t), "gene_id", "animal_id", "group", ["MONO:PEAK1", "RR:PEAK1"])


MWU = """
r AS (SELECT gene_id, model, value, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::double AS r,
             count(*) OVER (PARTITION BY gene_id, value) AS t FROM pb_cov),
u AS (SELECT gene_id, count(*) FILTER (model = 'RR') AS na, count(*) FILTER (model = 'MONO') AS nb,
             sum(r) FILTER (model = 'RR') - count(*) FILTER (model = 'RR') * (count(*) FILTER (model = 'RR') + 1) / 2.0::double AS u,
             sum(t * t - 1)::double AS tie, avg(value) FILTER (model = 'RR') - avg(value) FILTER (model = 'MONO') AS mean_diff
      FROM r GROUP BY 1 HAVING max(value) > 0)"""
ZED = "(greatest(u, na * nb - u) - na * nb / 2.0::double - 0.5) / nullif(sqrt(na * nb / 12.0::double * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1)))), 0)"


@query("t10_mann_whitney", f"WITH {MWU} SELECT gene_id, na, nb, u, mean_diff, u / (na * nb) AS auc, {ZED} AS z FROM u",
       "u mean_diff auc z")
def _(t):
    return K.mann_whitney(pb(t), t.animals, "gene_id", "animal_id", "model", ("RR", "MONO"))


@query("t33_bonferroni_gate", f"""
WITH {MWU} SELECT gene_id, u / (na * nb) AS auc, exp(-({ZED})) AS p, (SELECT count(*) FROM u) AS n_tests,
  exp(-({ZED})) <= 0.05::double / (SELECT count(*) FROM u) AS passes FROM u WHERE u / (na * nb) >= 0.62""", "auc p")
def _(t):
    m = K.mann_whitney(pb(t), t.animals, "gene_id", "animal_id", "model", ("RR", "MONO"))
    return K.bonferroni_gate(m.select("gene_id", "auc", F.exp(-F.col("z")).alias("p")), "auc", "p")


@query("t11_hedges_g", """
WITH r AS (SELECT s.program, a.model, s.score, rank() OVER (PARTITION BY s.program ORDER BY s.score) + (count(*) OVER (PARTITION BY s.program, s.score) - 1) / 2.0::double AS r
           FROM shared_programs s JOIN animals a USING (animal_id)),
g AS (SELECT program, count(*) FILTER (model = 'MONO') AS na, count(*) FILTER (model = 'RR') AS nb, avg(score) FILTER (model = 'MONO') AS mean_a,
             avg(score) FILTER (model = 'RR') AS mean_b, var_samp(score) FILTER (model = 'MONO') AS va, var_samp(score) FILTER (model = 'RR') AS vb,
             sum(r) FILTER (model = 'RR') AS rb FROM r GROUP BY 1)
SELECT program, na, nb, mean_a, mean_b, mean_b - mean_a AS diff, rb - nb * (nb + 1) / 2.0::double AS u,
       2 * (rb - nb * (nb + 1) / 2.0::double) / (na * nb) - 1 AS rank_biserial,
       (mean_b - mean_a) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3.0::double / (4 * (na + nb) - 9)) AS hedges_g FROM g""",
       "mean_a mean_b diff u rank_biserial hedges_g")
def _(t):
    s = C.program_scores(pb(t), t.animals, t.genes.select("program", "gene_id"))
    return K.two_group_effects(s.join(t.animals.select("animal_id", "model"), "animal_id"), ["program"], "model",
                               ("MONO", "RR"), "score")


@query("t10_exact_p")
def _(t):
    s = C.program_scores(pb(t), t.animals, t.genes.select("program", "gene_id"))
    return K.two_group_effects(s.join(t.animals.select("animal_id", "model"), "animal_id"), ["program"], "model",
                               ("MONO", "RR"), "score", exact=True).select("program", "u", "p_exact")


@query("t12_kruskal_wallis", """
WITH r AS (SELECT niche, region, cell_day, rank() OVER (PARTITION BY niche ORDER BY cell_day) + (count(*) OVER (PARTITION BY niche, cell_day) - 1) / 2.0::double AS r,
                  count(*) OVER (PARTITION BY niche, cell_day) AS t FROM cells),
g AS (SELECT niche, region, sum(r) AS s, count(*) AS n, sum(t * t - 1)::double AS tie FROM r GROUP BY 1, 2),
k AS (SELECT niche, sum(n)::bigint AS n, count(*) AS k, sum(s * s / n) AS q, sum(tie) AS tie FROM g GROUP BY 1)
SELECT niche, n, k, (12.0::double / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n::double * n * n - n)) AS h FROM k""", "h")
def _(t):
    return K.kruskal(t.cells, ["niche"], "region", "cell_day")


@query("t13_signed_rank", """
WITH d AS (SELECT animal_id, region, avg(cell_day) FILTER (niche = 'F') - avg(cell_day) FILTER (niche = 'O') AS d FROM cells GROUP BY 1, 2),
r AS (SELECT region, d, rank() OVER (PARTITION BY region ORDER BY abs(d)) + (count(*) OVER (PARTITION BY region, abs(d)) - 1) / 2.0::double AS r FROM d WHERE d <> 0)
SELECT region, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus,
       least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r GROUP BY 1""", "w_plus w_minus w")
def _(t):
    d = t.cells.groupBy("animal_id", "region").agg(
        (F.avg(F.when(F.col("niche") == "F", F.col("cell_day"))) - F.avg(F.when(F.col("niche") == "O", F.col("cell_day")))).alias("d"))
    return K.signed_rank(d, ["region"], "d")


@query("t13_signed_rank_p", f"""
WITH d AS (SELECT animal_id, region, round(avg(cell_day) FILTER (niche = 'F') - avg(cell_day) FILTER (niche = 'O'), 9) AS d FROM cells GROUP BY 1, 2),
r AS (SELECT region, d, rank() OVER (PARTITION BY region ORDER BY abs(d)) + (count(*) OVER (PARTITION BY region, abs(d)) - 1) / 2.0::double AS r FROM d WHERE d <> 0),
z AS (SELECT region, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY 1),
e AS (SELECT region, sum(t * t * t - t) AS tie FROM (SELECT region, abs(d) AS a, count(*) AS t FROM r GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT *, least(w_plus, w_minus) AS w FROM z JOIN e USING (region)),
h AS (SELECT *, (w - n * (n + 1) / 4.0::double) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - tie / 48.0::double), 0) AS zz FROM f)
SELECT region, n, w_plus, w_minus, w, CASE WHEN zz IS NOT NULL THEN {gauss_tail('zz')} END AS p FROM h""", "w_plus w_minus w p")
def _(t):
    d = t.cells.groupBy("animal_id", "region").agg(
        F.round(F.avg(F.when(F.col("niche") == "F", F.col("cell_day"))) - F.avg(F.when(F.col("niche") == "O", F.col("cell_day"))), 9).alias("d"))
    return K.signed_rank(d, ["region"], "d", p=True)


@query("t15_sign_test", """
SELECT region, count(*) FILTER (n_cells > 10) AS k, count(*) AS n, count(*) FILTER (n_cells > 10) / count(*)::double AS fraction FROM sections GROUP BY 1""",
       "fraction")
def _(t):
    return K.sign_test(t.sections, ["region"], F.col("n_cells") > 10).drop("p")


@query("t32_ordered_pair_fraction", """
SELECT count(*) FILTER (a.n_cells < b.n_cells) AS pairs_ordered, avg(CASE WHEN a.n_cells < b.n_cells THEN 1.0::double ELSE 0.0 END) AS fraction
FROM sections a JOIN sections b ON a.region = 'BUILDING' AND b.region = 'MACHINERY'""", "fraction")
def _(t):
    d = t.sections.withColumn("x", F.col("n_cells").cast("double"))
    return K.ordered_pair_fraction(d, "region", "BUILDING", "MACHINERY", "x")


STAGES = {"high": ["PEAK1"], "low": ["ONSET1", "REMISSION1"], "floor": ["ONSET1", "REMISSION1"], "peak": ["ONSET1", "PEAK1"]}
AMP = """
m AS (SELECT gene_id, avg(value) FILTER (stage = 'PEAK1') - avg(value) FILTER (stage <> 'PEAK1') AS amplitude,
             avg(value) FILTER (stage = 'REMISSION1') - avg(value) FILTER (stage = 'ONSET1') AS floor_drift,
             avg(value) FILTER (stage = 'PEAK1') - avg(value) FILTER (stage = 'ONSET1') AS peak_drift
      FROM pb_cov GROUP BY 1 HAVING max(value) > 0)"""


@query("a24_stage_contrasts", f"WITH {AMP} SELECT * FROM m", "amplitude floor_drift peak_drift")
def _(t):
    return K.stage_contrasts(pb(t), t.animals, "gene_id", "animal_id", "stage", STAGES)


@query("a24_stage_means_z", """
WITH s AS (SELECT stage, gene_id, count(*) AS n, avg(value) AS mean_value FROM pb_cov GROUP BY 1, 2)
SELECT stage, gene_id, n, mean_value, coalesce((mean_value - avg(mean_value) OVER w) / nullif(stddev_pop(mean_value) OVER w, 0), 0) AS z
FROM s WHERE gene_id IN (SELECT gene_id FROM counts) WINDOW w AS (PARTITION BY gene_id)""", "mean_value z")
def _(t):
    levels = ["ONSET1", "PEAK1", "REMISSION1"]
    g = K.level_sums(pb(t), t.animals, "gene_id", "animal_id", "stage", levels)
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"g{i}.n").alias("n"), K.mean_of(i).alias("mean_value"))
                     for i, s in enumerate(levels)])
    long = g.select("gene_id", F.explode(rows).alias("_r")).select("gene_id", "_r.*")
    return long.withColumn("z", S.zscore("mean_value", ["gene_id"]))


@query("p8_temporal_class", f"""
WITH {AMP} SELECT gene_id, CASE WHEN amplitude > 0.3 AND floor_drift > 0.2 THEN 'acute+ratchet' WHEN floor_drift > 0.2 THEN 'ratchet_cumulative'
  WHEN amplitude > 0.3 AND floor_drift < 0.15 THEN 'acute_oscillating' ELSE 'other' END AS class,
  CASE WHEN peak_drift >= 0.25 AND floor_drift < 0.125 THEN 'relapse_specific' WHEN floor_drift >= 0.25 AND peak_drift < 0.125 THEN 'monophasic_specific'
       WHEN peak_drift >= 0.25 AND floor_drift >= 0.25 THEN 'shared_up' ELSE 'other' END AS trajectory FROM m""")
def _(t):
    m = K.stage_contrasts(pb(t), t.animals, "gene_id", "animal_id", "stage", STAGES)
    return m.select("gene_id", K.temporal_class().alias("class"), K.trajectory_class("peak_drift", "floor_drift").alias("trajectory"))


@query("a25_profile_correlation", """
WITH s AS (SELECT gene_id, run_id, avg(value) AS m FROM pb_cov GROUP BY 1, 2),
k AS (SELECT a.gene_id, corr(a.m, b.m) AS r, stddev_pop(a.m) AS sa FROM s a JOIN s b ON b.gene_id = 1 AND a.run_id = b.run_id GROUP BY 1)
SELECT gene_id, r AS profile_corr FROM k WHERE gene_id <> 1 AND sa > 1e-12""", "profile_corr")
def _(t):
    runs = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return K.profile_correlation(pb(t), t.animals, "gene_id", "animal_id", "run_id", runs, 1)


SHIFT = """
f AS (SELECT animal_id, cell_type, count(*) / (sum(count(*)) OVER (PARTITION BY animal_id))::double AS fraction FROM cells GROUP BY 1, 2),
s AS (SELECT animal_id, cell_type, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2, 3),
e AS (SELECT animal_id, cell_type, gene_id, ln(1 + n / (sum(n) OVER (PARTITION BY animal_id, cell_type))::double * 10000) AS v FROM s),
ax AS (SELECT animal_id, day - avg(day) OVER () - regr_slope(day, score) OVER () * (score - avg(score) OVER ()) AS d FROM animals),
d AS (SELECT a.animal_id, k.cell_type, g.gene_id, coalesce(f.fraction, 0) AS fr, f.fraction IS NOT NULL AS present, coalesce(e.v, 0) AS v, ax.d
      FROM (SELECT DISTINCT animal_id FROM cells) a CROSS JOIN (SELECT DISTINCT cell_type FROM cells) k CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g
      JOIN ax ON ax.animal_id = a.animal_id
      LEFT JOIN f ON f.animal_id = a.animal_id AND f.cell_type = k.cell_type
      LEFT JOIN e ON e.animal_id = a.animal_id AND e.cell_type = k.cell_type AND e.gene_id = g.gene_id),
b AS (SELECT cell_type, gene_id, avg(v) FILTER (present) AS ebar, avg(fr) AS fbar FROM d GROUP BY 1, 2),
x AS (SELECT d.gene_id, sum(fr * v * d.d) / 25 AS cov_total, sum(fr * ebar * d.d) / 25 AS cov_comp,
             sum(fbar * CASE WHEN present THEN v ELSE ebar END * d.d) / 25 AS cov_intr
      FROM d JOIN b ON b.cell_type = d.cell_type AND b.gene_id = d.gene_id GROUP BY 1)"""


@query("a18_shift_share", f"""
WITH {SHIFT} SELECT gene_id, cov_total, cov_comp, cov_intr, cov_total - cov_comp - cov_intr AS cov_inter,
  cov_comp / CASE WHEN abs(cov_total) >= 1e-9 THEN cov_total END AS comp_share, cov_intr / CASE WHEN abs(cov_total) >= 1e-9 THEN cov_total END AS intr_share,
  (cov_total - cov_comp - cov_intr) / CASE WHEN abs(cov_total) >= 1e-9 THEN cov_total END AS inter_share FROM x""",
       "cov_total cov_comp cov_intr cov_inter comp_share intr_share inter_share")
def _(t):
    return _shift(t)


def _shift(t):
    fr = C.composition(t.cells, ["animal_id"], "cell_type")
    e = C.pseudobulk(t.expr, ["animal_id", "cell_type"])
    axis = A.residualise(t.animals, "day", "score", [], "axis").select("animal_id", "axis")
    return K.shift_share(fr, e, axis, "animal_id", "cell_type", "gene_id", "axis")


@query("p8_driver_class", f"""
WITH {SHIFT}, z AS (SELECT cov_comp / cov_total AS c, cov_intr / cov_total AS i FROM x WHERE cov_total > 0)
SELECT CASE WHEN c >= 0.6 THEN 'compositional' WHEN i >= 0.6 THEN 'intrinsic' ELSE 'mixed' END AS driver, count(*) AS n FROM z GROUP BY 1""")
def _(t):
    return _shift(t).where("cov_total > 0").groupBy(K.driver_class().alias("driver")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_driver_class_of_accruing_genes", f"""
WITH {SHIFT}, z AS (SELECT gene_id, cov_comp / cov_total AS c, cov_intr / cov_total AS i FROM x JOIN gene_trend USING (gene_id) WHERE cov_total > 0
  AND (rho - rho_xs * rho_ys) / sqrt(greatest((1 - rho_xs * rho_xs) * (1 - rho_ys * rho_ys), 1e-12)) >= 0.4)
SELECT CASE WHEN c >= 0.6 THEN 'compositional' WHEN i >= 0.6 THEN 'intrinsic' ELSE 'mixed' END AS driver, count(*) AS n FROM z GROUP BY 1""")
def _(t):
    """Drivers of the genes that rise with the day at equal score."""
    rising = A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False).where("partial >= 0.4").select("gene_id")
    return (_shift(t).where("cov_total > 0").join(rising, "gene_id").groupBy(K.driver_class().alias("driver")).agg(F.count(F.lit(1)).alias("n")))


@query("p8_accrual_class", """
WITH p AS (SELECT (rho - rho_xs * rho_ys) / sqrt(greatest((1 - rho_xs * rho_xs) * (1 - rho_ys * rho_ys), 1e-12)) AS d,
                  (rho_xs - rho * rho_ys) / sqrt(greatest((1 - rho * rho) * (1 - rho_ys * rho_ys), 1e-12)) AS s FROM gene_trend)
SELECT CASE WHEN d >= 0.3 THEN 'accrual_up' WHEN d <= -0.3 THEN 'accrual_down' WHEN abs(s) >= 0.3 THEN 'severity_oscillating' ELSE 'other' END AS class,
       count(*) AS n FROM p GROUP BY 1""")
def _(t):
    p = A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False)
    p = p.withColumn("r_score", A.partial_r("r_given", "r_raw", "r_target_given"))
    return p.groupBy(K.accrual_class("partial", "r_score").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_conserved_class", """
WITH r AS (SELECT model, gene_id, value, rank() OVER (PARTITION BY model, gene_id ORDER BY value) + (count(*) OVER (PARTITION BY model, gene_id, value) - 1) / 2.0::double AS x,
                  rank() OVER (PARTITION BY model, gene_id ORDER BY day) + (count(*) OVER (PARTITION BY model, gene_id, day) - 1) / 2.0::double AS y FROM pb_cov),
c AS (SELECT model, gene_id, corr(x, y) AS rho FROM r GROUP BY 1, 2 HAVING max(value) <> min(value)),
j AS (SELECT a.rho AS a, b.rho AS b FROM c a JOIN c b ON a.gene_id = b.gene_id AND a.model = 'RR' AND b.model = 'MONO')
SELECT CASE WHEN a >= 0.3 AND b >= 0.3 THEN 'accrue_both' WHEN a <= -0.3 AND b <= -0.3 THEN 'decline_both' ELSE 'other' END AS conserved, count(*) AS n FROM j GROUP BY 1""")
def _(t):
    """Genes whose trend with the day has the same direction in both cohorts."""
    s = A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", "day", by=["model"], fdr=False)
    j = s.where("model = 'RR'").select("gene_id", F.col("rho").alias("a")).join(s.where("model = 'MONO'").select("gene_id", F.col("rho").alias("b")), "gene_id")
    return j.groupBy(K.conserved_class("a", "b").alias("conserved")).agg(F.count(F.lit(1)).alias("n"))


@query("a22_eta_squared", """
SELECT count(*) AS n, 1 - sum(pow(day - m, 2)) / sum(pow(day - g, 2)) AS eta2
FROM (SELECT day, avg(day) OVER (PARTITION BY run_id) AS m, avg(day) OVER () AS g FROM animals)""", "eta2")
def _(t):
    return E.eta_squared(t.animals, "run_id", "day")


@query("a26_state_shares", """
WITH n AS (SELECT animal_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY animal_id) AS al, sum(n) FILTER (cell_type IN ('1-URGENT', '2-HIGH')) OVER (PARTITION BY animal_id) AS co FROM n)
SELECT stage, cell_type, avg(n / co::double) AS of_compartment, avg(n / al::double) AS of_all FROM c JOIN animals USING (animal_id)
WHERE cell_type IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2""", "of_compartment of_all")
def _(t):
    return E.state_shares(t.cells, "animal_id", "cell_type", ["1-URGENT", "2-HIGH"], t.animals, "stage")


CLUSTER = """
s AS (SELECT cell_type, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2),
v AS (SELECT cell_type, gene_id, ln(1 + n / (sum(n) OVER (PARTITION BY cell_type))::double * 10000) AS value FROM s),
sp AS (SELECT cell_type, gene_id, value - sum(value) OVER (PARTITION BY gene_id) / 5 AS specificity FROM v),
tp AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY specificity DESC, gene_id) AS rn FROM sp)"""


@query("a27_marker_specificity", f"""
WITH {CLUSTER}, {AMP} SELECT cell_type, count(*) AS n_genes, avg(specificity) AS mean_specificity, avg(amplitude) AS mean_amplitude, avg(floor_drift) AS mean_floor_drift
FROM tp JOIN m USING (gene_id) WHERE rn <= 30 GROUP BY 1""", "mean_specificity mean_amplitude mean_floor_drift")
def _(t):
    means = C.pseudobulk(t.expr, ["cell_type"])
    k = t.cells.select(F.count_distinct("cell_type")).scalar()
    top = E.marker_specificity(means, "cell_type", "gene_id", "value", k, 30)
    met = K.stage_contrasts(pb(t), t.animals, "gene_id", "animal_id", "stage", STAGES)
    return (top.join(met, "gene_id").groupBy("cell_type")
            .agg(F.count(F.lit(1)).alias("n_genes"), F.avg("specificity").alias("mean_specificity"),
                 F.avg("amplitude").alias("mean_amplitude"), F.avg("floor_drift").alias("mean_floor_drift")))


@query("a28_top_cluster_vs_rest", f"""
WITH {CLUSTER} SELECT gene_id, arg_max(cell_type, (value, cell_type)) AS top_cluster, max(value) AS top_mean, (sum(value) - max(value)) / 4 AS rest_mean FROM v GROUP BY 1""",
       "top_mean rest_mean")
def _(t):
    k = t.cells.select(F.count_distinct("cell_type")).scalar()
    return E.top_cluster_markers(C.pseudobulk(t.expr, ["cell_type"]), "cell_type", "gene_id", "value", k)


@query("a29_program_along_region", f"""
WITH s AS (SELECT animal_id, region, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2, 3),
v AS (SELECT animal_id, region, gene_id, ln(1 + n / (sum(n) OVER (PARTITION BY animal_id, region))::double * 10000) AS value FROM s),
p AS (SELECT animal_id, region, program, sum(value) / any_value(k) AS score FROM v JOIN genes USING (gene_id)
      JOIN (SELECT program, count(*) AS k FROM genes GROUP BY 1) USING (program) GROUP BY 1, 2, 3),
z AS (SELECT *, coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0) AS z FROM p WINDOW w AS (PARTITION BY animal_id, program))
SELECT program, region, {RANK_SQL} AS pos, count(*) AS n, avg(z) AS mean_z FROM z GROUP BY 1, 2""", "mean_z")
def _(t):
    v = C.pseudobulk(t.expr, ["animal_id", "region"]).join(t.genes.select("gene_id", "program"), "gene_id")
    k = t.genes.groupBy("program").agg(F.count(F.lit(1)).alias("k"))
    p = v.groupBy("animal_id", "region", "program").agg(F.sum("value").alias("s")).join(k, "program") \
        .select("animal_id", "region", "program", (F.col("s") / F.col("k")).alias("score"))
    return (p.withColumn("z", S.zscore("score", ["animal_id", "program"])).groupBy("program", "region")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z")).withColumn("pos", region_rank()))


@query("t28_rise_and_fall", """
WITH d AS (SELECT program, score AS v, day - avg(day) OVER () AS t, avg(day) OVER () AS m FROM (SELECT s.program, s.score, a.day FROM shared_programs s JOIN animals a USING (animal_id))),
k AS (SELECT program, count(*) AS n, any_value(m) AS m, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(v) AS y0, sum(t*v) AS y1, sum(t*t*v) AS y2,
             min(t) AS lo, max(t) AS hi FROM d GROUP BY 1),
q AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det,
             n*(s2*y2-s3*y1) - s1*(s1*y2-s2*y1) + y0*(s1*s3-s2*s2) AS da, n*(y1*s4-y2*s3) - y0*(s1*s4-s2*s3) + s2*(s1*y2-s2*y1) AS db FROM k)
SELECT program, n, da / det * 1000 AS quadratic_milli, -(db / det) / (2 * da / det) + m AS vertex, da / det < 0 AND -(db / det) / (2 * da / det) BETWEEN lo AND hi AS rise_and_fall FROM q""",
       "quadratic_milli vertex")
def _(t):
    from cohortspark.operators.curves import quadratic_vertex
    s = C.program_scores(pb(t), t.animals, t.genes.select("program", "gene_id")).drop("n_genes")
    s = s.join(t.animals.select("animal_id", "day"), "animal_id")
    return quadratic_vertex(s, ["program"], "day", "score").select(
        "program", "n", (F.col("quadratic") * 1000).alias("quadratic_milli"), "vertex", "rise_and_fall")


@query("t27_verdicts", """
SELECT gene_id, CASE WHEN abs(rho) >= 0.4 AND abs(rho_xs) < 0.2 THEN 'survives' WHEN abs(rho) >= 0.4 THEN 'partial' ELSE 'collapses' END AS verdict FROM gene_trend""")
def _(t):
    r = A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False)
    return r.select("gene_id", P.verdict([((F.abs("r_raw") >= 0.4) & (F.abs("r_given") < 0.2), "survives"),
                                          (F.abs("r_raw") >= 0.4, "partial")], "collapses").alias("verdict"))
