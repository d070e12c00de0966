"""Trend, partial correlation, regression and agreement queries: T1-T8, T14, T15, T24-T26, W1, W2, W13-W15, W18, F."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions import ordering as O
from cohortspark.functions import scalars as S
from cohortspark.functions import special as SP
from cohortspark.operators import association as A
from cohortspark.operators import counts as C
from cohortspark.plans.registry import query
from cohortspark.session import cut


def student_tail(t: str, df: str) -> str:
    """Two-sided Student t probability in SQL for whole degrees of freedom: the finite trigonometric series."""
    th = f"atan(abs({t}) / sqrt({df}::double))"
    odd = (f"2 / pi() * ({th} + CASE WHEN {df} = 1 THEN 0 ELSE sin({th}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2),"
           f" lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({th}), 2 * j + 1))), 0) END)")
    even = (f"sin({th}) * coalesce(list_sum(list_transform(range(0, {df} // 2),"
            f" lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({th}), 2 * j))), 0)")
    return f"(1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def gauss_tail(z: str) -> str:
    """Two-sided normal probability in SQL by the series of the error function."""
    a = f"greatest(abs({z}) / sqrt(2.0::double), 1e-300)"
    return f"(1 - list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln({a}) - {a} * {a} - lgamma(j + 1.5)))))"


BH = """least(1.0, min(p * n_all / rk) OVER (PARTITION BY {part} ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


T_OF_RHO = "rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-12))"


def pb(t):
    return C.pseudobulk(t.expr, ["animal_id"])


@query("t1_spearman_trend", f"""
WITH p AS (SELECT gene_id, n, rho, {student_tail('rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-12))', '(n - 2)')} AS p FROM gene_trend),
r AS (SELECT *, count(*) OVER () AS n_all, count(*) OVER (ORDER BY p) AS rk FROM p)
SELECT gene_id, n, rho, p, least(1.0, min(p * n_all / rk) OVER (ORDER BY p DESC)) AS q FROM r""", "rho p q")
def _(t):
    return A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", "day")


@query("t1_trend_per_cohort", """
WITH r AS (SELECT model, gene_id, value,
       rank() OVER (PARTITION BY model, gene_id ORDER BY value) + (count(*) OVER (PARTITION BY model, gene_id, value) - 1) / 2.0::double AS rx,
       rank() OVER (PARTITION BY model, gene_id ORDER BY day) + (count(*) OVER (PARTITION BY model, gene_id, day) - 1) / 2.0::double AS ry
FROM pb_cov)
SELECT model, gene_id, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2 HAVING max(value) <> min(value)""", "rho")
def _(t):
    return A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", "day", ["model"], fdr=False)


@query("w1_midrank_nonzero", """
SELECT animal_id, gene_id, rank() OVER (PARTITION BY gene_id ORDER BY n) + (count(*) OVER (PARTITION BY gene_id, n) - 1) / 2.0::double AS rank
FROM (SELECT animal_id, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2)""", "rank")
def _(t):
    return O.with_midrank(C.count_sums(t.expr, ["animal_id"]), "n", ["gene_id"]).select("animal_id", "gene_id", "rank")


@query("w1_midrank_large_group", """
SELECT cell_id, rank() OVER (PARTITION BY niche ORDER BY total) + (count(*) OVER (PARTITION BY niche, total) - 1) / 2.0::double AS rank
FROM (SELECT cell_id, niche, sum(cnt)::bigint AS total FROM expr GROUP BY 1, 2)""", "rank")
def _(t):
    tot = t.expr.groupBy("cell_id", "niche").agg(F.sum("cnt").cast("double").alias("total"))
    return O.large_midrank(tot, "total", ["niche"]).select("cell_id", "rank")


@query("w2_benjamini_hochberg", """
WITH p AS (SELECT cell_type, gene_id, count(*) / 3000.0::double AS p FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY cell_type) AS n_all, count(*) OVER (PARTITION BY cell_type ORDER BY p) AS rk FROM p)
SELECT cell_type, gene_id, p, least(1.0, min(p * n_all / rk) OVER (PARTITION BY cell_type ORDER BY p DESC)) AS q FROM r""", "p q")
def _(t):
    p = t.counts.join(t.cells, "cell_id").groupBy("cell_type", "gene_id").agg((F.count(F.lit(1)) / 3000.0).alias("p"))
    return O.bh_adjust(p, "p", ["cell_type"])


PARTIAL = "(rho - rho_xs * rho_ys) / sqrt(greatest((1 - rho_xs * rho_xs) * (1 - rho_ys * rho_ys), 1e-12))"


@query("t2_partial_spearman", f"""
SELECT gene_id, n, rho AS r_raw, rho_xs AS r_given, rho_ys AS r_target_given, {PARTIAL} AS partial FROM gene_trend""",
       "r_raw r_given r_target_given partial")
def _(t):
    return A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False)


@query("t2_partial_spearman_fdr", f"""
WITH s AS (SELECT gene_id, n, {PARTIAL} AS partial FROM gene_trend),
p AS (SELECT *, {student_tail('partial * sqrt((n - 3) / greatest(1 - partial * partial, 1e-12))', '(n - 3)')} AS p FROM s),
r AS (SELECT *, count(*) OVER () AS n_all, count(*) OVER (ORDER BY p) AS rk FROM p)
SELECT gene_id, partial, p, least(1.0, min(p * n_all / rk) OVER (ORDER BY p DESC)) AS q FROM r""", "partial p q")
def _(t):
    return A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score").select("gene_id", "partial", "p", "q")


def _pr(xy, xz, yz):
    return f"(({xy}) - ({xz}) * ({yz})) / sqrt((1 - ({xz}) * ({xz})) * (1 - ({yz}) * ({yz})))"


T3 = """
r AS (SELECT p.*, rank() OVER (PARTITION BY gene_id ORDER BY n_cells) + (count(*) OVER (PARTITION BY gene_id, n_cells) - 1) / 2.0::double AS rw
      FROM pb_rank p JOIN (SELECT animal_id, n_cells FROM animals) USING (animal_id)),
k AS (SELECT gene_id, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xa, corr(rx, rw) AS xb, corr(ry, rz) AS ya,
             corr(ry, rw) AS yb, corr(rz, rw) AS ab FROM r GROUP BY 1 HAVING max(value) <> min(value)),
k2 AS (SELECT gene_id, n, xy, yb AS r_depth, """ + _pr("xy", "xa", "ya") + " AS xy_a, " + _pr("xb", "xa", "ab") + " AS xb_a, " \
    + _pr("yb", "ya", "ab") + " AS yb_a FROM k)"


@query("t3_partial_two_covariates", f"WITH {T3} SELECT gene_id, n, xy AS r_raw, {_pr('xy_a', 'xb_a', 'yb_a')} AS partial FROM k2",
       "r_raw partial")
def _(t):
    return A.partial_trend_two(pb(t), t.animals, "gene_id", "animal_id", "day", ("score", "n_cells"))


@query("t26_depth_gate", f"""
WITH {T3} SELECT gene_id, n, r_depth, xy_a AS partial_one, {_pr('xy_a', 'xb_a', 'yb_a')} AS partial_two,
  CASE WHEN abs(r_depth) >= 0.4 THEN {_pr('xy_a', 'xb_a', 'yb_a')} ELSE xy_a END AS partial_used FROM k2""",
       "r_depth partial_one partial_two partial_used")
def _(t):
    return A.trend_with_gate(pb(t), t.animals, "gene_id", "animal_id", "day", "score", "n_cells")


@query("t4_partial_pearson", """
WITH k AS (SELECT gene_id, count(*) AS n, corr(value, day) AS r_raw, corr(value, score) AS r_given, corr(day, score) AS r_target_given
           FROM pb_cov GROUP BY 1 HAVING max(value) <> min(value))
SELECT *, (r_raw - r_given * r_target_given) / sqrt((1 - r_given * r_given) * (1 - r_target_given * r_target_given)) AS partial FROM k""",
       "r_raw r_given r_target_given partial")
def _(t):
    return A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", ranked=False, fdr=False)


LONG_FEATURES = """
SELECT animal_id, feature, v FROM animals UNPIVOT (v FOR feature IN (day, score, cells_d))"""


@query("t5_feature_correlation_matrix", """
WITH f AS (SELECT section_id, 'n_cells' AS feature, n_cells::double AS v FROM sections UNION ALL
  SELECT section_id, 'mean_day', avg(cell_day) FROM cells GROUP BY 1 UNION ALL
  SELECT section_id, 'n_urgent', count(*)::double FROM cells WHERE cell_type = '1-URGENT' GROUP BY 1),
j AS (SELECT a.feature AS f1, b.feature AS f2, a.v AS v1, b.v AS v2 FROM f a JOIN f b USING (section_id)),
r AS (SELECT f1, f2, rank() OVER (PARTITION BY f1, f2 ORDER BY v1) + (count(*) OVER (PARTITION BY f1, f2, v1) - 1) / 2.0::double AS r1,
             rank() OVER (PARTITION BY f1, f2 ORDER BY v2) + (count(*) OVER (PARTITION BY f1, f2, v2) - 1) / 2.0::double AS r2 FROM j)
SELECT f1, f2, count(*) AS n, corr(r1, r2) AS rho FROM r GROUP BY 1, 2""", "rho")
def _(t):
    a = t.sections.select("section_id", F.lit("n_cells").alias("feature"), F.col("n_cells").cast("double").alias("v"))
    b = t.cells.groupBy("section_id").agg(F.avg("cell_day").alias("v")).select("section_id", F.lit("mean_day").alias("feature"), "v")
    d = t.cells.where("cell_type = '1-URGENT'").groupBy("section_id").agg(F.count(F.lit(1)).cast("double").alias("v")) \
        .select("section_id", F.lit("n_urgent").alias("feature"), "v")
    return A.feature_correlations(a.unionByName(b).unionByName(d), "section_id", "feature", "v")


@query("t6_residualise", """
SELECT animal_id, model, day - avg(day) OVER w - regr_slope(day, score) OVER w * (score - avg(score) OVER w) AS resid FROM animals
WINDOW w AS (PARTITION BY model)""", "resid")
def _(t):
    return A.residualise(t.animals, "day", "score", ["model"]).select("animal_id", "model", "resid")


@query("t6_leave_one_out_residual", """
SELECT a.animal_id, a.day - regr_intercept(b.day, b.score) - regr_slope(b.day, b.score) * a.score AS resid_loo
FROM animals a JOIN animals b ON a.animal_id <> b.animal_id GROUP BY a.animal_id, a.day, a.score""", "resid_loo")
def _(t):
    return A.leave_one_out_residual(t.animals, "day", "score").select("animal_id", "resid_loo")


@query("t7_variance_explained", """
SELECT count(*) AS n, pow(corr(day, score), 2) AS r2_a, pow(corr(day, n_cells), 2) AS r2_b,
  (pow(corr(day, score), 2) + pow(corr(day, n_cells), 2) - 2 * corr(day, score) * corr(day, n_cells) * corr(score, n_cells)) / (1 - pow(corr(score, n_cells), 2)) AS r2_both,
  1 / (1 - pow(corr(score, n_cells), 2)) AS vif FROM animals""", "r2_a r2_b r2_both vif")
def _(t):
    return A.variance_explained(t.animals, "day", "score", "n_cells")


@query("t8_slope_interaction", """
WITH g AS (SELECT gene_id, model, count(*) AS n, regr_slope(value, score) AS b, regr_sxx(value, score) AS sxx,
                  regr_syy(value, score) - pow(regr_sxy(value, score), 2) / regr_sxx(value, score) AS sse FROM pb_cov GROUP BY 1, 2),
w AS (SELECT a.gene_id, a.b AS slope_a, b.b AS slope_b, b.b - a.b AS interaction, a.n + b.n - 4 AS df,
             sqrt(greatest((a.sse + b.sse) / (a.n + b.n - 4), 0) * (1 / a.sxx + 1 / b.sxx)) AS se
      FROM g a JOIN g b ON a.gene_id = b.gene_id AND a.model = 'MONO' AND b.model = 'RR')
SELECT gene_id, slope_a, slope_b, interaction, se, df, interaction / se AS t FROM w WHERE se > 1e-12""",
       "slope_a slope_b interaction se t")
def _(t):
    return A.slope_interaction(pb(t), t.animals, "gene_id", "animal_id", "score", "model", ("MONO", "RR"))


REGION_RANK = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
RANK_SQL = "CASE region " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REGION_RANK.items()) + " END"


def region_rank():
    return F.element_at(F.create_map(*[x for k, v in REGION_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("region"))


@query("t14_within_animal_slope", f"""
WITH f AS (SELECT animal_id, region FROM cells GROUP BY 1, 2 HAVING count(*) >= 50),
s AS (SELECT animal_id, region, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2, 3),
l AS (SELECT animal_id, region, sum(n)::double AS lib FROM s GROUP BY 1, 2),
v AS (SELECT f.animal_id, {RANK_SQL.replace('region', 'f.region')} AS rk, g.gene_id, ln(1 + coalesce(s.n, 0) / l.lib * 10000) AS value
      FROM f JOIN l USING (animal_id, region) CROSS JOIN (SELECT DISTINCT gene_id FROM s) g
      LEFT JOIN s ON s.animal_id = f.animal_id AND s.region = f.region AND s.gene_id = g.gene_id),
b AS (SELECT animal_id, gene_id, regr_slope(value, rk) AS slope FROM v GROUP BY 1, 2 HAVING count(DISTINCT rk) > 1)
SELECT gene_id, count(*) AS n, avg(slope) AS mean_slope, avg(slope) / nullif(stddev_samp(slope) / sqrt(count(*)), 0) AS t FROM b
GROUP BY 1 HAVING count(*) > 1""", "mean_slope t")
def _(t):
    v = C.pseudobulk(t.expr, ["animal_id", "region"]).withColumn("rk", region_rank())
    floor = t.cells.groupBy("animal_id", "region").agg(F.count(F.lit(1)).alias("k")).where("k >= 50").withColumn("rk", region_rank())
    present = v.join(floor, ["animal_id", "region"], "left_semi").select("gene_id").distinct()
    out = A.within_unit_slopes(v, floor, "animal_id", "gene_id", "rk", "value")
    # genes that are zero in every kept region have slope 0 in every animal
    missing = v.select("gene_id").distinct().join(present, "gene_id", "left_anti")
    n = floor.groupBy("animal_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1))).scalar()
    return out.unionByName(missing.select("gene_id", n.alias("n"), F.lit(0.0).alias("mean_slope"), F.lit(None).cast("double").alias("t")).where("n > 1"))


@query("t15_point_biserial", "SELECT corr(CASE WHEN model = 'RR' THEN 1.0::double ELSE 0.0 END, day) AS r FROM animals", "r")
def _(t):
    return t.animals.agg(A.pearson((F.col("model") == "RR").cast("double"), "day").alias("r"))


@query("t24_agreement_of_slopes", f"""
WITH s AS (SELECT model, gene_id, regr_slope(value, day) AS b FROM pb_cov GROUP BY 1, 2 HAVING max(value) <> min(value)),
j AS (SELECT a.b AS a, b.b AS b FROM s a JOIN s b ON a.gene_id = b.gene_id AND a.model = 'RR' AND b.model = 'MONO'),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::double AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::double AS rb FROM j),
z AS (SELECT count(*) AS n, corr(ra, rb) AS rho, avg(CASE WHEN sign(a) = sign(b) THEN 1.0::double ELSE 0.0 END) AS same_sign FROM r)
SELECT n, rho, same_sign, {student_tail(T_OF_RHO, '(n - 2)')} AS p FROM z""",
       "rho same_sign p")
def _(t):
    m = A.sparse_moments(pb(t), t.animals, "gene_id", "animal_id", ["day"], ["model"], ranked=False).where("sxx > 1e-12")
    s = m.select("model", "gene_id", S.ratio("sx_day", "s_day_day").alias("slope"))
    return A.agreement(s.where("model = 'RR'"), s.where("model = 'MONO'"), "gene_id", "slope")


COHORT_TREND = f"""
r AS (SELECT model, gene_id, value,
       rank() OVER (PARTITION BY model, gene_id ORDER BY value) + (count(*) OVER (PARTITION BY model, gene_id, value) - 1) / 2.0::double AS rx,
       rank() OVER (PARTITION BY model, gene_id ORDER BY day) + (count(*) OVER (PARTITION BY model, gene_id, day) - 1) / 2.0::double AS ry FROM pb_cov),
c AS (SELECT model, gene_id, count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r GROUP BY 1, 2 HAVING max(value) <> min(value)),
pp AS (SELECT *, round({student_tail(T_OF_RHO, '(n - 2)')}, 9) AS p FROM c),
k AS (SELECT *, count(*) OVER (PARTITION BY model) AS n_all, count(*) OVER (PARTITION BY model ORDER BY p) AS rk FROM pp),
tr AS (SELECT model, gene_id, rho, {BH.format(part='model')} AS q FROM k),
j AS (SELECT gene_id, a.rho AS a, b.rho AS b, a.q AS qa, b.q AS qb FROM tr a JOIN tr b USING (gene_id) WHERE a.model = 'RR' AND b.model = 'MONO')"""


def cohort_trends(t):
    """Trend of every gene with the day in each cohort, with q inside the cohort."""
    r = A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", "day", ["model"], fdr=False).withColumn("rho", F.round("rho", 9))
    p = r.withColumn("p", F.round(SP.p_student(A.t_of_r("rho", F.col("n") - 2), F.col("n") - 2), 9))
    q = cut(O.bh_adjust(p, "p", ["model"]))
    return q.where("model = 'RR'"), q.where("model = 'MONO'")


# a study takes 0.05; the test tables are random and no gene passes there in both cohorts, so a loose level keeps the count from being 0
SHARED_LEVEL = 0.95


@query("t24_shared_hits", f"""
WITH {COHORT_TREND}, m AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::double AS ra,
       rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::double AS rb FROM j),
z AS (SELECT count(*) AS n, corr(ra, rb) AS rho, avg(CASE WHEN sign(a) = sign(b) THEN 1.0::double ELSE 0.0 END) AS same_sign,
       count(*) FILTER (qa < {SHARED_LEVEL} AND qb < {SHARED_LEVEL}) AS n_both FROM m)
SELECT n, rho, same_sign, n_both, {student_tail(T_OF_RHO, '(n - 2)')} AS p FROM z""", "rho same_sign p")
def _(t):
    a, b = cohort_trends(t)
    return A.agreement(a, b, "gene_id", "rho", "q", SHARED_LEVEL)


@query("t24_conserved_lists", f"""
WITH {COHORT_TREND}, s AS (SELECT gene_id, a, b, CASE WHEN a > 0 THEN 'up' ELSE 'down' END AS direction, round(abs(a + b), 9) AS s FROM j WHERE a * b > 0),
o AS (SELECT direction, row_number() OVER (PARTITION BY direction ORDER BY s DESC, gene_id) AS place, gene_id, a, b FROM s)
SELECT * FROM o WHERE place <= 20""", "a b")
def _(t):
    a, b = cohort_trends(t)
    return A.conserved_lists(a, b, "gene_id", "rho", 20)


@query("t25_empirical_rank", """
WITH g AS (SELECT gene_id, round(rho, 9) AS rho, round(rho_xs, 9) AS m, round(abs(rho), 9) AS e FROM gene_trend),
near AS (SELECT a.gene_id, count(*) FILTER (abs(a.m - b.m) <= 0.01) AS n1, count(*) FILTER (abs(a.m - b.m) <= 0.01 AND b.e < a.e) AS k1,
                count(*) FILTER (abs(a.m - b.m) <= 0.02) AS n2, count(*) FILTER (abs(a.m - b.m) <= 0.02 AND b.e < a.e) AS k2
         FROM g a JOIN g b ON abs(a.m - b.m) <= 0.02 GROUP BY 1)
SELECT gene_id, (rank() OVER (ORDER BY e) - 1) / count(*) OVER ()::double AS rank_all,
       CASE WHEN n1 < 30 THEN n2 ELSE n1 END AS n_matched, CASE WHEN n1 < 30 THEN k2 / n2::double ELSE k1 / n1::double END AS rank_matched
FROM g JOIN near USING (gene_id)""", "rank_all rank_matched")
def _(t):
    r = A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False)
    r = r.select("gene_id", F.round("r_raw", 9).alias("effect"), F.round("r_given", 9).alias("match"))
    return A.empirical_rank(r, "gene_id", "effect", "match", 0.01, 0.02, 30)


# ------------------------------------------------------------------ bins, centring, scalar functions

@query("w13_joint_bins", """
WITH s AS (SELECT gene_id, sum(cnt)::double AS total, count(*)::double AS cells FROM counts GROUP BY 1),
q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.5) AS b, quantile_cont(total, 0.75) AS c, min(cells) AS lo, max(cells) AS hi FROM s)
SELECT CASE WHEN total <= a THEN 0 WHEN total <= b THEN 1 WHEN total <= c THEN 2 ELSE 3 END AS quartile,
       greatest(least(ceil((cells - lo) / (hi - lo) * 5) - 1, 4), 0)::bigint AS width_bin, count(*) AS n
FROM s, q GROUP BY 1, 2""")
def _(t):
    s = t.counts.groupBy("gene_id").agg(F.sum("cnt").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("cells"))
    q = O.exact_quantiles(s, "total", (0.25, 0.5, 0.75), ("a", "b", "c")).select(F.struct("a", "b", "c")).scalar()
    rng = s.agg(F.struct(F.min("cells").alias("lo"), F.max("cells").alias("hi"))).scalar()
    s = s.withColumn("_q", q).withColumn("_r", rng)
    return (s.select(F.when(F.col("total") <= F.col("_q.a"), 0).when(F.col("total") <= F.col("_q.b"), 1)
                     .when(F.col("total") <= F.col("_q.c"), 2).otherwise(3).alias("quartile"),
                     S.equal_width_bin("cells", "_r.lo", "_r.hi", 5).alias("width_bin"))
            .groupBy("quartile", "width_bin").agg(F.count(F.lit(1)).alias("n")))


@query("w14_tertiles", """
SELECT animal_id, CASE WHEN r <= 1 / 3.0::double THEN 'low' WHEN r <= 2 / 3.0::double THEN 'mid' ELSE 'high' END AS tertile
FROM (SELECT animal_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double) / count(*) OVER () AS r FROM animals)""")
def _(t):
    n = t.animals.agg(F.count(F.lit(1))).scalar()
    r = F.col("rank") / n
    return O.large_midrank(t.animals, "score").select("animal_id", F.when(r <= 1 / 3, "low").when(r <= 2 / 3, "mid").otherwise("high").alias("tertile"))


@query("w14_fixed_bands", """
SELECT band, count(*) AS n, avg(day) AS mean_day FROM (
  SELECT day, CASE WHEN score > 0 AND score <= 4.3 THEN 'low' WHEN score > 4.3 AND score <= 4.6 THEN 'mid' WHEN score > 4.6 AND score <= 9 THEN 'high' END AS band
  FROM animals) GROUP BY 1""", "mean_day")
def _(t):
    return (t.animals.withColumn("band", S.bin_by_edges("score", [0, 4.3, 4.6, 9], ["low", "mid", "high"]))
            .groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("day").alias("mean_day")))


@query("w15_centre_within_group", "SELECT section_id, n_cells - avg(n_cells) OVER (PARTITION BY animal_id) AS centred FROM sections", "centred")
def _(t):
    return t.sections.select("section_id", S.centre("n_cells", ["animal_id"]).alias("centred"))


@query("w18_leave_one_out_mean", "SELECT animal_id, (sum(day) OVER () - day) / (count(*) OVER () - 1) AS loo_mean FROM animals", "loo_mean")
def _(t):
    whole = t.animals.agg(F.sum("day").alias("s"), F.count(F.lit(1)).alias("n"))
    return t.animals.join(F.broadcast(whole)).select("animal_id", ((F.col("s") - F.col("day")) / (F.col("n") - 1)).alias("loo_mean"))


@query("f2_centred_log_ratio", """
WITH f AS (SELECT animal_id, cell_type, count(*) / (sum(count(*)) OVER (PARTITION BY animal_id))::double AS fraction FROM cells GROUP BY 1, 2)
SELECT animal_id, cell_type, ln(fraction + 1e-4) - avg(ln(fraction + 1e-4)) OVER (PARTITION BY animal_id) AS clr FROM f""", "clr")
def _(t):
    f = C.composition(t.cells, ["animal_id"], "cell_type")
    return f.select("animal_id", "cell_type", S.clr("fraction", ["animal_id"]).alias("clr"))


@query("f3_zscore_guarded", """
SELECT section_id, CASE WHEN stddev_pop(n_cells) OVER w = 0 THEN 0 ELSE (n_cells - avg(n_cells) OVER w) / nullif(stddev_pop(n_cells) OVER w, 0) END AS z
FROM sections WINDOW w AS (PARTITION BY animal_id, region)""", "z")
def _(t):
    return t.sections.select("section_id", S.zscore("n_cells", ["animal_id", "region"]).alias("z"))


@query("f4_fisher_transform", "SELECT gene_id, atanh(greatest(least(rho, 0.9999), -0.9999)) AS z, tanh(rho) AS back FROM gene_trend", "z back")
def _(t):
    r = A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", "day", fdr=False)
    return r.select("gene_id", S.fisher_z("rho").alias("z"), F.tanh("rho").alias("back"))


@query("f5_irregular_bins", """
SELECT bin, count(*) AS n FROM (SELECT CASE WHEN x > -1000 AND x <= -10 THEN 'core' WHEN x > -10 AND x <= 0 THEN 'rim'
  WHEN x > 0 AND x <= 10 THEN 'near' WHEN x > 10 AND x <= 1000 THEN 'far' END AS bin FROM space) GROUP BY 1""")
def _(t):
    return (t.space.select(S.bin_by_edges("x", [-1000, -10, 0, 10, 1000], ["core", "rim", "near", "far"]).alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


@query("f6_ordinal_decode", """
SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS rank FROM embeddings""")
def _(t):
    return t.raw("embeddings").select("vec_id", S.ordinal_decode("embedding").alias("rank"))


@query("f7_softmax_sigmoid", """
SELECT section_id, cell_id, exp(program - max(program) OVER w) / sum(exp(program - m)) OVER w AS weight, 1 / (1 + exp(-program)) AS prob
FROM (SELECT *, max(program) OVER (PARTITION BY section_id) AS m FROM space) WINDOW w AS (PARTITION BY section_id)""", "weight prob")
def _(t):
    return t.space.select("section_id", "cell_id", S.softmax("program", ["section_id"]).alias("weight"), S.sigmoid("program").alias("prob"))


@query("f9_tail_probabilities", f"""
SELECT gene_id, {student_tail('rho * 5', '(n - 2)')} AS p_t, exp(-rho * rho * 10) AS p_chi2_two FROM gene_trend""", "p_t p_chi2_two")
def _(t):
    r = A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", "day", fdr=False)
    return r.select("gene_id", SP.p_student(F.col("rho") * 5, F.col("n") - 2).alias("p_t"),
                    SP.p_chi2(F.col("rho") * F.col("rho") * 20, F.lit(2)).alias("p_chi2_two"))
