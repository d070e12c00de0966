"""Resampling queries: T16-T23, J7, J16, T17 variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import association as A
from cohortspark.operators import curves as V
from cohortspark.operators import resample as R
from cohortspark.plans.q_association import RANK_SQL, region_rank
from cohortspark.plans.q_curves import LAG, LAGS, curve
from cohortspark.plans.registry import query
from cohortspark.plans.twin_ctes import CTES

# units = sections, x = mean day of their cells, y = number of cells, tag = region
CTES["bag_preds"] = "SELECT section_id, min(animal_id) AS animal_id, min(region) AS region, avg(cell_day) AS pred, count(*)::double AS truth FROM cells GROUP BY 1"
H = "('0x' || substr(md5({}), 1, 8))::bigint"


def mr(x, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::double)"


def preds(t):
    return t.cells.groupBy("section_id").agg(F.min("animal_id").alias("animal_id"), F.min("region").alias("region"),
                                             F.avg("cell_day").alias("pred"), F.count(F.lit(1)).cast("double").alias("truth"))


BOOT = f"""
i AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY section_id) - 1 AS idx, count(*) OVER (PARTITION BY region) AS n FROM bag_preds),
dr AS (SELECT region, rep, idx AS slot, {H.format("region || '|' || rep || '|' || idx || '|0'")} % n AS pick FROM i, range(0, 40) r(rep)),
s AS (SELECT d.region, d.rep, i.pred, i.truth FROM dr d JOIN i ON i.region = d.region AND i.idx = d.pick),
rk AS (SELECT region, rep, {mr('pred', 'region, rep')} AS x, {mr('truth', 'region, rep')} AS y FROM s),
b AS (SELECT region, rep, corr(x, y) AS stat FROM rk GROUP BY 1, 2),
ob AS (SELECT region, corr(x, y) AS observed FROM (SELECT region, {mr('pred', 'region')} AS x, {mr('truth', 'region')} AS y FROM bag_preds) GROUP BY 1)"""


@query("t16_bootstrap_spearman", f"""
WITH {BOOT} SELECT region, any_value(observed) AS observed, count(*) AS n_reps, quantile_cont(stat, 0.025) AS ci_lo, quantile_cont(stat, 0.975) AS ci_hi, stddev_pop(stat) AS se
FROM b JOIN ob USING (region) GROUP BY 1""", "observed ci_lo ci_hi se")
def _(t):
    return R.bootstrap_ci(preds(t), "section_id", R.rank_corr("pred", "truth"), 40, ["region"])


ABOOT = f"""
i AS (SELECT *, row_number() OVER (ORDER BY animal_id) - 1 AS idx, count(*) OVER () AS n FROM animals),
dr AS (SELECT rep, idx AS slot, {H.format("rep || '|' || idx || '|0'")} % n AS pick FROM i, range(0, 2000) r(rep)),
s AS (SELECT d.rep, i.* EXCLUDE (idx, n) FROM dr d JOIN i ON i.idx = d.pick)"""


@query("t17_bootstrap_mean_gap", f"""
WITH {ABOOT}, b AS (SELECT rep, avg(day) FILTER (model = 'MONO') - avg(day) FILTER (model = 'RR') AS stat FROM s GROUP BY 1)
SELECT (SELECT avg(day) FILTER (model = 'MONO') - avg(day) FILTER (model = 'RR') FROM animals) AS observed, count(stat) AS n_reps,
       quantile_cont(stat, 0.025) AS ci_lo, quantile_cont(stat, 0.975) AS ci_hi, stddev_pop(stat) AS se FROM b WHERE stat IS NOT NULL""",
       "observed ci_lo ci_hi se")
def _(t):
    return R.bootstrap_ci(t.animals, "animal_id", R.mean_gap("day", "model", "RR", "MONO"), 2000)


@query("t17_clustered_auc", f"""
WITH {ABOOT.replace('FROM animals)', 'FROM (SELECT DISTINCT animal_id FROM bag_preds))', 1)},
x AS (SELECT s.rep, p.truth, CASE WHEN p.region = 'BUILDING' THEN 1 ELSE 0 END AS pos FROM s JOIN bag_preds p USING (animal_id)),
rk AS (SELECT rep, pos, {mr('truth', 'rep')} AS r FROM x),
b AS (SELECT rep, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2.0::double) / (sum(pos) * (count(*) - sum(pos))) AS stat FROM rk GROUP BY 1),
ob AS (SELECT (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2.0::double) / (sum(pos) * (count(*) - sum(pos))) AS observed FROM (
   SELECT CASE WHEN region = 'BUILDING' THEN 1 ELSE 0 END AS pos, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0::double AS r FROM bag_preds))
SELECT (SELECT observed FROM ob) AS observed, count(stat) AS n_reps, quantile_cont(stat, 0.025) AS ci_lo, quantile_cont(stat, 0.975) AS ci_hi, stddev_pop(stat) AS se FROM b""",
       "observed ci_lo ci_hi se")
def _(t):
    p = preds(t).withColumn("pos", (F.col("region") == "BUILDING").cast("int"))
    return R.bootstrap_ci(p, "animal_id", R.auc_stat("pos", "truth"), 2000)


@query("t18_paired_bootstrap", f"""
WITH {ABOOT},
rk AS (SELECT rep, {mr('day', 'rep')} AS x, {mr('score', 'rep')} AS y, {mr('n_cells', 'rep')} AS z FROM s),
b AS (SELECT rep, corr(x, z) - corr(y, z) AS d FROM rk GROUP BY 1),
ob AS (SELECT corr(x, z) AS a, corr(y, z) AS b FROM (SELECT rank() OVER (ORDER BY day) AS x, rank() OVER (ORDER BY score) AS y,
        rank() OVER (ORDER BY n_cells) + (count(*) OVER (PARTITION BY n_cells) - 1) / 2.0::double AS z FROM animals))
SELECT count(d) AS n_reps, avg(d) AS diff_mean, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi,
       avg(CASE WHEN d <= 0 THEN 1.0::double ELSE 0.0 END) AS frac_le_0, (SELECT a FROM ob) AS stat_a, (SELECT b FROM ob) AS stat_b FROM b""",
       "diff_mean ci_lo ci_hi frac_le_0 stat_a stat_b")
def _(t):
    return R.paired_bootstrap(t.animals, "animal_id", R.rank_corr("day", "n_cells"), R.rank_corr("score", "n_cells"), 2000)


def null_sql(stat_from, two=False):
    s, o = ("abs(stat)", "abs(observed)") if two else ("stat", "observed")
    return f"""SELECT observed, count(stat) AS n_reps, avg(stat) AS null_mean, stddev_pop(stat) AS null_sd, quantile_cont(stat, 0.05) AS q05,
  quantile_cont(stat, 0.5) AS q50, quantile_cont(stat, 0.95) AS q95, max(stat) AS null_max, (count(*) FILTER ({s} >= {o} - 1e-9) + 1) / (count(stat) + 1)::double AS p,
  count(*) FILTER (stat < observed - 1e-9) / count(stat)::double AS percentile FROM {stat_from} GROUP BY observed"""


NULLCOLS = "observed null_mean null_sd q05 q50 q95 null_max p percentile"


def deal_sql(within, reps):
    w = f"PARTITION BY {within}" if within else ""
    wr = f"PARTITION BY {within}, rep" if within else "PARTITION BY rep"
    on = f"AND i.{within} = d.{within}" if within else ""
    sel = f"{within}," if within else ""
    return f"""
i AS (SELECT *, row_number() OVER ({w} ORDER BY animal_id) AS idx FROM animals),
d AS (SELECT {sel} rep, animal_id, row_number() OVER ({wr} ORDER BY md5(animal_id || '|' || rep || '|0'), animal_id) AS idx FROM i, range(0, {reps}) r(rep)),
p AS (SELECT d.rep, d.animal_id, i.day FROM d JOIN i ON i.idx = d.idx {on})"""


@query("t19_permutation_spearman", f"""
WITH {deal_sql('', 300)},
rk AS (SELECT rep, {mr('p.day', 'rep')} AS x, {mr('a.score', 'rep')} AS y FROM p JOIN animals a USING (animal_id)),
b AS (SELECT rep, corr(x, y) AS stat, (SELECT corr(x, y) FROM (SELECT rank() OVER (ORDER BY day) AS x, rank() OVER (ORDER BY score) AS y FROM animals)) AS observed FROM rk GROUP BY 1)
{null_sql('b')}""", NULLCOLS)
def _(t):
    return R.permutation_test(t.animals.select("animal_id", "day", "score"), "animal_id", "score", "day",
                              R.rank_corr("day", "score"), 300)


@query("t19_permutation_slope_two_sided", f"""
WITH {deal_sql('', 300)},
b AS (SELECT rep, regr_slope(a.score, p.day) AS stat, (SELECT regr_slope(score, day) FROM animals) AS observed FROM p JOIN animals a USING (animal_id) GROUP BY 1)
{null_sql('b', True)}""", NULLCOLS)
def _(t):
    return R.permutation_test(t.animals.select("animal_id", "day", "score"), "animal_id", "score", "day",
                              R.ols_slope("day", "score"), 300, two_sided=True)


@query("t21_permutation_within_run", f"""
WITH {deal_sql('run_id', 300)},
rk AS (SELECT rep, {mr('p.day', 'rep')} AS x, {mr('a.score', 'rep')} AS y FROM p JOIN animals a USING (animal_id)),
b AS (SELECT rep, corr(x, y) AS stat, (SELECT corr(x, y) FROM (SELECT rank() OVER (ORDER BY day) AS x, rank() OVER (ORDER BY score) AS y FROM animals)) AS observed FROM rk GROUP BY 1)
{null_sql('b')}""", NULLCOLS)
def _(t):
    return R.permutation_test(t.animals.select("animal_id", "day", "score", "run_id"), "animal_id", "score", "day",
                              R.rank_corr("day", "score"), 300, within=["run_id"])


@query("t21_block_permutation", """
WITH z AS (SELECT section_id AS u, count(*) AS size FROM cells GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY u) AS idx FROM z),
d AS (SELECT size, rep, u, row_number() OVER (PARTITION BY size, rep ORDER BY md5(u || '|' || rep || '|0'), u) AS idx FROM i, range(0, 3) r(rep)),
m AS (SELECT d.rep, d.u, i.u AS src FROM d JOIN i ON i.size = d.size AND i.idx = d.idx),
j AS (SELECT section_id, cell_id, niche, row_number() OVER (PARTITION BY section_id ORDER BY cell_id) AS j FROM cells)
SELECT m.rep, m.u AS section_id, a.cell_id, b.niche FROM m JOIN j a ON a.section_id = m.u JOIN j b ON b.section_id = m.src AND b.j = a.j""")
def _(t):
    return R.block_permuted_labels(t.cells.select("section_id", "cell_id", "niche"), "section_id", "cell_id", "niche", 3)


@query("t20_sign_flip", f"""
WITH b0 AS (SELECT animal_id, regr_slope(n_cells, {RANK_SQL}) AS slope FROM sections GROUP BY 1 HAVING count(DISTINCT region) > 1),
b AS (SELECT rep, avg(slope * CASE WHEN {H.format("animal_id || '|' || rep || '|0'")} % 2 = 0 THEN 1.0::double ELSE -1.0 END) AS stat, (SELECT avg(slope) FROM b0) AS observed
      FROM b0, range(0, 500) r(rep) GROUP BY 1)
{null_sql('b', True)}""", NULLCOLS)
def _(t):
    s = (t.sections.withColumn("rk", region_rank()).groupBy("animal_id")
         .agg(F.regr_slope("n_cells", "rk").alias("slope"), F.count_distinct("region").alias("k")).where("k > 1"))
    return R.sign_flip_test(s, "animal_id", "slope", 500)


@query("t22_hash_positions", """
SELECT rep, section_id, row_number() OVER (PARTITION BY rep ORDER BY md5(section_id || '|' || rep || '|0'), section_id) - 1 AS pos
FROM sections, range(0, 3) r(rep)""")
def _(t):
    return R.hash_positions(t.sections, ["section_id"], 3)


RHO = f"r AS (SELECT region, count(*) AS n, corr(x, y) AS rho FROM (SELECT region, {mr('pred', 'region')} AS x, {mr('truth', 'region')} AS y FROM bag_preds) GROUP BY 1)"


@query("t23_fisher_pairs", f"""
WITH {RHO} SELECT a.region AS tag_a, b.region AS tag_b, (atanh(a.rho) - atanh(b.rho)) / sqrt(1.0::double / (a.n - 3) + 1.0::double / (b.n - 3)) AS z
FROM r a JOIN r b ON a.region < b.region""", "z")
def _(t):
    return R.compare_correlations(A.grouped_spearman(preds(t), "pred", "truth", ["region"]), "region")


@query("t23_combined_correlation", f"WITH {RHO} SELECT sum(n)::bigint AS n, tanh(sum(atanh(rho) * (n - 3)) / sum(n - 3)) AS combined FROM r", "combined")
def _(t):
    return R.combined_correlation(A.grouped_spearman(preds(t), "pred", "truth", ["region"]))


PAIRS = """
pr AS (SELECT a.animal_id AS unit_a, b.animal_id AS unit_b, a.day - b.day AS day_gap, a.score - b.score AS score_gap, (a.n_cells - b.n_cells) AS x_gap,
   CASE WHEN a.day > b.day THEN a.n_cells < b.n_cells ELSE b.n_cells < a.n_cells END AS longer_is_lower, a.n_cells = b.n_cells AS tie
 FROM animals a JOIN animals b ON a.animal_id < b.animal_id AND abs(a.score - b.score) <= 0.05 AND a.day <> b.day)"""


@query("j7_matched_pairs", f"WITH {PAIRS} SELECT * FROM pr", "day_gap score_gap")
def _(t):
    return R.matched_pairs(t.animals, "animal_id", "score", "day", "n_cells", 0.05)


@query("j7_matched_pair_summary", f"""
WITH {PAIRS} SELECT count(*) AS n_pairs, count(*) FILTER (longer_is_lower) AS k, count(*) FILTER (tie) AS ties, avg(CASE WHEN longer_is_lower THEN 1.0::double ELSE 0.0 END) AS fraction FROM pr""",
       "fraction")
def _(t):
    return R.matched_pair_summary(R.matched_pairs(t.animals, "animal_id", "score", "day", "n_cells", 0.05))


@query("j16_pick_pairs", f"""
WITH {PAIRS}
(SELECT 'example' AS role, unit_a, unit_b, day_gap, x_gap FROM pr ORDER BY abs(score_gap), abs(day_gap) DESC, unit_a, unit_b LIMIT 1) UNION ALL
(SELECT 'counterexample', unit_a, unit_b, day_gap, x_gap FROM pr WHERE abs(day_gap) >= 10 ORDER BY CASE WHEN day_gap > 0 THEN x_gap ELSE -x_gap END DESC, unit_a, unit_b LIMIT 1)""",
       "day_gap")
def _(t):
    return R.pick_pairs(R.matched_pairs(t.animals, "animal_id", "score", "day", "n_cells", 0.05))


@query("t31_memory_timescale_bootstrap", f"""
WITH u AS (SELECT animal_id, program, row_number() OVER (ORDER BY animal_id) - 1 AS idx, count(*) OVER () AS n FROM curve_units),
d AS (SELECT rep, idx AS slot, {H.format("rep || '|' || idx || '|0'")} % n AS pick FROM u, range(0, 2000) t(rep)),
s AS (SELECT d.rep, h.tau, h.ewi, u.program FROM d JOIN u ON u.idx = d.pick JOIN curve_history h USING (animal_id)),
r AS (SELECT rep, tau, {mr('ewi', 'rep, tau')} AS x, {mr('program', 'rep, tau')} AS y FROM s),
g AS (SELECT rep, tau, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1, 2)
SELECT rep, arg_max(tau, (round(rho, 9), -tau)) AS tau_star, max(rho) AS rho_at_tau, max(n) AS n, arg_max(tau, (round(rho, 9), -tau)) = max(tau) AS at_scan_limit FROM g GROUP BY 1""",
       "rho_at_tau")
def _(t):
    return V.memory_timescale(V.weighted_history(t.curves, t.curve_ends, range(1, 31)), t.curve_units, "program", 2000)


@query("g11_beyond_severity", f"""
WITH r AS (SELECT s.section_id, s.animal_id, s.region, a.stage, s.n_cells - avg(s.n_cells) OVER () - regr_slope(s.n_cells, a.score) OVER () * (a.score - avg(a.score) OVER ()) AS resid
           FROM sections s JOIN animals a USING (animal_id)),
an AS (SELECT animal_id, avg(resid) AS resid, min(stage) AS stage FROM r GROUP BY 1),
sl AS (SELECT animal_id, regr_slope(resid, {RANK_SQL}) AS slope FROM r GROUP BY 1 HAVING count(DISTINCT region) > 1)
SELECT (SELECT avg(resid) FILTER (stage = 'PEAK1') - avg(resid) FILTER (stage = 'REMISSION1') FROM an) AS peak_minus_rest, (SELECT avg(slope) FROM sl) AS mean_slope,
       (SELECT count(*) FROM sl) AS n_animals""", "peak_minus_rest mean_slope")
def _(t):
    d = t.sections.join(t.animals.select("animal_id", "stage", "score"), "animal_id").withColumn("n_cells", F.col("n_cells").cast("double"))
    r = A.residualise(d, "n_cells", "score")
    an = r.groupBy("animal_id").agg(F.avg("resid").alias("resid"), F.min("stage").alias("stage"))
    gap = R.mean_gap("resid", "stage", "REMISSION1", "PEAK1")(an, [])
    sl = (r.withColumn("rk", region_rank()).groupBy("animal_id").agg(F.regr_slope("resid", "rk").alias("slope"), F.count_distinct("region").alias("k"))
          .where("k > 1"))
    return sl.agg(F.avg("slope").alias("mean_slope"), F.count(F.lit(1)).alias("n_animals")) \
        .withColumn("peak_minus_rest", gap.select("stat").scalar())


@query("g15_spread_against_day", f"""
WITH q AS (SELECT animal_id, count(*) AS n, stddev_samp(n_cells) AS sd, quantile_cont(n_cells, 0.75) - quantile_cont(n_cells, 0.25) AS iqr, max(n_cells) - min(n_cells) AS rng FROM sections GROUP BY 1),
l AS (SELECT 'sd' AS stat, sd AS v, day FROM q JOIN animals USING (animal_id) UNION ALL SELECT 'iqr', iqr, day FROM q JOIN animals USING (animal_id) UNION ALL SELECT 'range', rng, day FROM q JOIN animals USING (animal_id))
SELECT stat, count(*) AS n, corr(x, y) AS rho FROM (SELECT stat, {mr('v', 'stat')} AS x, {mr('day', 'stat')} AS y FROM l) GROUP BY 1""", "rho")
def _(t):
    from cohortspark.operators import counts as C
    s = C.spread(t.sections, ["animal_id"], "n_cells").join(t.animals.select("animal_id", "day"), "animal_id")
    rows = F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).cast("double").alias("v")) for k in ("sd", "iqr", "range")])
    long = s.select("day", F.explode(rows).alias("_r")).select("day", "_r.*")
    return A.grouped_spearman(long, "v", "day", ["stat"])


@query("g15_cohort_spread_adjusted", f"""
WITH q AS (SELECT animal_id, stddev_samp(n_cells) AS sd FROM sections GROUP BY 1 HAVING count(*) > 1),
i AS (SELECT q.animal_id, sd, day, CASE model WHEN 'RR' THEN 1.0::double WHEN 'MONO' THEN 0.0 END AS g, row_number() OVER (ORDER BY q.animal_id) - 1 AS idx, count(*) OVER () AS n FROM q JOIN animals USING (animal_id)),
dr AS (SELECT rep, idx AS slot, {H.format("rep || '|' || idx || '|0'")} % n AS pick FROM i, range(0, 2000) r(rep)),
m AS (SELECT rep, var_pop(g) AS gg, var_pop(day) AS cc, covar_pop(g, day) AS gc, covar_pop(g, sd) AS gy, covar_pop(day, sd) AS cy FROM dr JOIN i ON i.idx = dr.pick GROUP BY 1),
b AS (SELECT (gy * cc - cy * gc) / (gg * cc - gc * gc) AS stat FROM m WHERE gg * cc - gc * gc > 1e-9 * gg * cc),
o AS (SELECT var_pop(g) AS gg, var_pop(day) AS cc, covar_pop(g, day) AS gc, covar_pop(g, sd) AS gy, covar_pop(day, sd) AS cy FROM i)
SELECT (SELECT (gy * cc - cy * gc) / (gg * cc - gc * gc) FROM o) AS observed, count(*) AS n_reps, quantile_cont(stat, 0.025) AS ci_lo, quantile_cont(stat, 0.975) AS ci_hi, stddev_pop(stat) AS se FROM b""",
       "observed ci_lo ci_hi se")
def _(t):
    """Spread inside animals, one cohort against the other at equal day; animals are drawn with replacement."""
    from cohortspark.operators import counts as C
    s = C.spread(t.sections, ["animal_id"], "n_cells").where("sd IS NOT NULL").select("animal_id", "sd").join(t.animals.select("animal_id", "day", "model"), "animal_id")
    return R.bootstrap_ci(s, "animal_id", R.adjusted_gap("sd", "model", "MONO", "RR", "day"), 2000)


@query("g15_within_animal_rank", f"""
WITH s AS (SELECT section_id, animal_id, model, truth AS size, pred AS age FROM bag_preds JOIN animals USING (animal_id)),
a AS (SELECT model, animal_id, corr(x, y) AS rho FROM (SELECT *, {mr('size', 'animal_id')} AS x, {mr('age', 'animal_id')} AS y FROM s) GROUP BY 1, 2 HAVING count(*) >= 4),
c AS (SELECT model, round(size - avg(size) OVER (PARTITION BY animal_id), 9) AS size, round(age - avg(age) OVER (PARTITION BY animal_id), 9) AS age FROM s),
p AS (SELECT model, corr(x, y) AS pooled FROM (SELECT model, {mr('size', 'model')} AS x, {mr('age', 'model')} AS y FROM c) GROUP BY 1)
SELECT model, count(rho) AS n_animals, median(rho) AS median_rho, avg(CASE WHEN rho > 0 THEN 1.0::double ELSE 0.0 END) FILTER (rho IS NOT NULL) AS positive_share, any_value(pooled) AS pooled_rho
FROM a JOIN p USING (model) GROUP BY 1""", "median_rho positive_share pooled_rho")
def _(t):
    """Size against date inside animals: median of the animals' rank correlations, and the pooled one of animal-centred values."""
    d = preds(t).join(t.animals.select("animal_id", "model"), "animal_id")
    own = A.grouped_spearman(d, "truth", "pred", ["model", "animal_id"]).where("n >= 4 AND rho IS NOT NULL")
    g = own.groupBy("model").agg(F.count(F.lit(1)).alias("n_animals"), F.percentile("rho", F.lit(0.5)).alias("median_rho"),
                                 F.avg((F.col("rho") > 0).cast("double")).alias("positive_share"))
    mean = d.groupBy("animal_id").agg(F.avg("truth").alias("_t"), F.avg("pred").alias("_p"))
    c = d.join(mean, "animal_id").withColumn("_t", F.round(F.col("truth") - F.col("_t"), 9)).withColumn("_p", F.round(F.col("pred") - F.col("_p"), 9))
    # whole cohorts are ranked from merged values
    ranked = A.large_midrank(A.large_midrank(c, "_t", ["model"], "_rt"), "_p", ["model"], "_rp")
    return g.join(ranked.groupBy("model").agg(A.pearson("_rt", "_rp").alias("pooled_rho")), "model")


@query("t21_block_test", f"""
WITH l AS (SELECT animal_id || ':' || region AS bag, animal_id, any_value(model) AS model, avg(cell_day) AS v FROM cells JOIN animals USING (animal_id) GROUP BY region, animal_id),
z AS (SELECT animal_id AS u, count(*) AS size FROM l GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY u) AS idx FROM z),
d AS (SELECT size, rep, u, row_number() OVER (PARTITION BY size, rep ORDER BY md5(u || '|' || rep || '|0'), u) AS idx FROM i, range(0, 300) r(rep)),
m AS (SELECT d.rep, d.u, i.u AS src FROM d JOIN i ON i.size = d.size AND i.idx = d.idx),
j AS (SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY bag) AS j FROM l),
n AS (SELECT m.rep, avg(a.v) FILTER (x.model = 'RR') - avg(a.v) FILTER (x.model = 'MONO') AS stat FROM m JOIN j a ON a.animal_id = m.u JOIN j x ON x.animal_id = m.src AND x.j = a.j GROUP BY 1),
o AS (SELECT avg(v) FILTER (model = 'RR') - avg(v) FILTER (model = 'MONO') AS observed FROM l)
SELECT any_value(observed) AS observed, count(stat) AS n_reps, (count(*) FILTER (abs(stat) >= abs(observed) - 1e-9) + 1) / (count(stat) + 1)::double AS p FROM n, o WHERE stat IS NOT NULL""", "observed p")
def _(t):
    """Gap between two labels over bags (animal, region), labels exchanged by whole animals."""
    b = t.cells.groupBy("animal_id", "region").agg(F.avg("cell_day").alias("v")).join(t.animals.select("animal_id", "model"), "animal_id")
    b = b.withColumn("bag", F.concat_ws(":", "animal_id", "region"))
    return R.block_permutation_test(b, "animal_id", "bag", "model", R.mean_gap("v", "model", "MONO", "RR"), ["v"], 300).select("observed", "n_reps", "p")


def _drawn(units, by, reps):
    """Units of a group drawn with replacement: one row for each draw, all columns of the unit."""
    part, on = (f"PARTITION BY {by} ", f"AND i.{by} = d.{by}") if by else ("", "")
    key, text = (f"{by}, ", f"{by} || '|' || ") if by else ("", "")
    draw = H.format(text + "rep || '|' || idx || '|0'")
    return f"""
i AS (SELECT *, row_number() OVER ({part}ORDER BY animal_id) - 1 AS idx, count(*) OVER ({part.strip()}) AS n FROM {units}),
d AS (SELECT {key}rep, {draw} % n AS pick FROM i, range(0, {reps}) r(rep)),
s AS (SELECT d.rep, i.* EXCLUDE (idx, n) FROM d JOIN i ON i.idx = d.pick {on} UNION ALL SELECT -1, * EXCLUDE (idx, n) FROM i)"""


def _partial(xy, xz, yz):
    return f"(({xy}) - ({xz}) * ({yz})) / sqrt(greatest((1 - ({xz}) * ({xz})) * (1 - ({yz}) * ({yz})), 1e-12))"


def _spread(by):
    """Replicate -1 holds the units as they are."""
    key = f"{by}, " if by else ""
    return f"""SELECT {key}statistic, max(n) AS n, max(stat) FILTER (rep < 0) AS observed, count(stat) FILTER (rep >= 0) AS n_reps,
  quantile_cont(stat, 0.025) FILTER (rep >= 0) AS ci_lo, quantile_cont(stat, 0.975) FILTER (rep >= 0) AS ci_hi FROM st WHERE isfinite(stat) GROUP BY {key}statistic"""


@query("t30_lag_intervals", f"""
WITH {LAG}, u AS (SELECT lag, animal_id, score, program, severity FROM l JOIN curve_units USING (animal_id)), {_drawn("u", "lag", 1000)},
rk AS (SELECT rep, lag, {mr('score', 'lag, rep')} AS x, {mr('program', 'lag, rep')} AS y, {mr('severity', 'lag, rep')} AS z FROM s),
g AS (SELECT lag, rep, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM rk GROUP BY 1, 2),
k AS (SELECT lag, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 5),
st AS (SELECT lag, rep, n, 'raw' AS statistic, xy AS stat FROM g JOIN k USING (lag) UNION ALL SELECT lag, rep, n, 'partial', {_partial('xy', 'xz', 'yz')} FROM g JOIN k USING (lag))
{_spread('lag')}""", "observed ci_lo ci_hi")
def _(t):
    c = curve(t)
    rows = V.score_at_lags(c, V.onset(c), LAGS).join(t.curve_units, "animal_id").select("lag", "animal_id", "score", "program", "severity")
    stats = {"raw": R.rank_corr("score", "program"), "partial": R.partial_rank_corr("score", "program", ["severity"])}
    return R.intervals(rows, "animal_id", stats, 1000, ["lag"]).where("observed IS NOT NULL")


_XY_A, _XB_A, _YB_A = _partial('xy', 'xa', 'ya'), _partial('xb', 'xa', 'ab'), _partial('yb', 'ya', 'ab')


@query("t26_gate_intervals", f"""
WITH u AS (SELECT c.animal_id, c.program, c.severity, e.end_day, e.days FROM curve_units c JOIN (SELECT animal_id, max(end_day) AS end_day, sum(score) AS days FROM curve GROUP BY 1) e USING (animal_id)),
{_drawn("u", "", 1000)},
rk AS (SELECT rep, {mr('program', 'rep')} AS x, {mr('end_day', 'rep')} AS y, {mr('severity', 'rep')} AS a, {mr('days', 'rep')} AS b FROM s),
g AS (SELECT rep, corr(x, y) AS xy, corr(x, a) AS xa, corr(y, a) AS ya, corr(x, b) AS xb, corr(y, b) AS yb, corr(a, b) AS ab FROM rk GROUP BY 1),
k AS (SELECT count(*) AS n FROM u),
st AS (SELECT rep, n, 'day' AS statistic, xy AS stat FROM g, k UNION ALL SELECT rep, n, 'day_given_severity', {_XY_A} FROM g, k
  UNION ALL SELECT rep, n, 'severity_given_day', {_partial('xa', 'xy', 'ya')} FROM g, k
  UNION ALL SELECT rep, n, 'day_given_severity_and_depth', {_partial(_XY_A, _XB_A, _YB_A)} FROM g, k)
{_spread('')}""", "observed ci_lo ci_hi")
def _(t):
    # the sum of a curve's scores stands for the depth
    ends = curve(t).groupBy("animal_id").agg(F.max("end_day").alias("end_day"), F.sum("score").alias("days"))
    rows = t.curve_units.select("animal_id", "program", "severity").join(ends, "animal_id")
    stats = {"day": R.rank_corr("program", "end_day"), "day_given_severity": R.partial_rank_corr("program", "end_day", ["severity"]),
             "severity_given_day": R.partial_rank_corr("program", "severity", ["end_day"]),
             "day_given_severity_and_depth": R.partial_rank_corr("program", "end_day", ["severity", "days"])}
    return R.intervals(rows, "animal_id", stats, 1000)
