"""Curve queries: J3-J6, W3-W11, A17, A19, T29-T31, S4."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import curves as V
from cohortspark.plans.registry import query

LAGS = [0, 1, 2, 3, 5, 7, 10, 14, 18, 22]


def curve(t):
    return V.build_curve(t.curves, t.curve_ends)


@query("w8_build_curve", "SELECT animal_id, day, score, end_day, imputed FROM curve", "score")
def _(t):
    return curve(t)


@query("w3_onset", "SELECT * FROM curve_onset")
def _(t):
    return V.onset(curve(t))


@query("a17_area_under_curve", """
SELECT animal_id, coalesce(sum((score + s2) / 2 * (d2 - day)), 0) AS auc FROM (
  SELECT *, lead(score) OVER w AS s2, lead(day) OVER w AS d2 FROM curve WINDOW w AS (PARTITION BY animal_id ORDER BY day)) GROUP BY 1""", "auc")
def _(t):
    return V.trapezoid(curve(t))


@query("a17_area_since_onset", """
SELECT animal_id, coalesce(sum((score + s2) / 2 * (d2 - day)), 0) AS auc FROM (
  SELECT c.*, lead(score) OVER w AS s2, lead(day) OVER w AS d2 FROM curve c JOIN curve_onset o USING (animal_id) WHERE day >= onset_day
  WINDOW w AS (PARTITION BY animal_id ORDER BY day)) GROUP BY 1""", "auc")
def _(t):
    c = curve(t)
    return V.trapezoid(c, V.onset(c).where("onset_day is not null").select("animal_id", "onset_day"))


def turning_points(step: str, held: bool, out: str) -> str:
    """Relapses from turning points: for every start the extremes up to each later point, the first far point, then a walk
    from turning point to turning point."""
    again = " AND lag(ok_{k}) OVER w AND day - lag(day) OVER w = 1" if held else ""
    return f"""WITH RECURSIVE g AS (
  SELECT a.animal_id, a.rn AS s, b.rn AS i, b.day, b.score, max(b.score) OVER v AS hi, min(b.score) OVER v AS lo
  FROM curve_ranked a JOIN curve_ranked b ON a.animal_id = b.animal_id AND b.rn >= a.rn WINDOW v AS (PARTITION BY a.animal_id, a.rn ORDER BY b.rn)),
o AS (SELECT *, i > s AND score <= hi - {step} AS ok_f, i > s AND score >= lo + {step} AS ok_r FROM g),
h AS (SELECT animal_id, s, i, ok_f{again.format(k="f")} AS fall, ok_r{again.format(k="r")} AS rise FROM o WINDOW w AS (PARTITION BY animal_id, s ORDER BY i)),
nx AS (SELECT animal_id, s, min(i) FILTER (fall) AS fall, min(i) FILTER (rise) AS rise FROM h GROUP BY 1, 2),
p AS (SELECT DISTINCT animal_id, 1::bigint AS at, 0 AS k FROM curve_ranked
  UNION ALL SELECT p.animal_id, CASE WHEN k % 2 = 0 THEN fall ELSE rise END, k + 1 FROM p JOIN nx ON nx.animal_id = p.animal_id AND nx.s = p.at
  WHERE CASE WHEN k % 2 = 0 THEN fall ELSE rise END IS NOT NULL)
SELECT animal_id, (max(k) // 2)::bigint AS {out} FROM p GROUP BY 1"""


R1 = turning_points("1", False, "n_relapses")


@query("w5_relapse_count", R1)
def _(t):
    return V.relapses(curve(t))


W6 = turning_points("0.5", True, "n_relapses_held")


@query("w6_relapse_count_held", W6)
def _(t):
    return V.relapses_sustained(curve(t))


@query("w4_last_peak", """
WITH y AS (SELECT animal_id, rn + 1 AS i, day, score AS v FROM curve_ranked UNION ALL
           SELECT DISTINCT animal_id, 1, NULL, 0.0::double FROM curve_ranked UNION ALL
           SELECT animal_id, max(rn) + 2, NULL, 0.0::double FROM curve_ranked GROUP BY 1),
k AS (SELECT a.animal_id, a.i, a.day, a.v, coalesce(max(b.i) FILTER (b.i < a.i AND b.v > a.v), 0) AS l,
             coalesce(min(b.i) FILTER (b.i > a.i AND b.v > a.v), max(b.i) + 1) AS r,
             min(b.i) FILTER (b.i > a.i AND b.v <> a.v) AS nx, max(b.v) FILTER (b.i = a.i - 1) AS pv
      FROM y a JOIN y b ON a.animal_id = b.animal_id WHERE a.day IS NOT NULL GROUP BY 1, 2, 3, 4),
p AS (SELECT k.animal_id, k.i, k.day, k.v - greatest(min(b.v) FILTER (b.i > k.l AND b.i <= k.i), min(b.v) FILTER (b.i >= k.i AND b.i < k.r)) AS prom,
             k.v > k.pv AND max(b.v) FILTER (b.i = k.nx) < k.v AS cand
      FROM k JOIN y b ON b.animal_id = k.animal_id GROUP BY k.animal_id, k.i, k.day, k.v, k.pv, k.nx)
SELECT a.animal_id, (SELECT arg_max(day, i) FROM p WHERE p.animal_id = a.animal_id AND cand AND prom >= 0.5) AS last_peak_day
FROM (SELECT DISTINCT animal_id FROM curve) a""")
def _(t):
    return V.last_peak(curve(t))


@query("w7_slope_at_end", """
SELECT animal_id, CASE WHEN count(*) FILTER (day >= end_day - 2) >= 2 THEN regr_slope(score, day) FILTER (day >= end_day - 2) END AS slope_at_end,
  CASE WHEN count(*) FILTER (day >= end_day - 2) < 2 THEN '' WHEN round(regr_slope(score, day) FILTER (day >= end_day - 2), 9) > 0 THEN 'ascending'
       WHEN round(regr_slope(score, day) FILTER (day >= end_day - 2), 9) < 0 THEN 'descending' ELSE 'plateau' END AS slope_class
FROM curve GROUP BY 1""", "slope_at_end")
def _(t):
    return V.slope_at_end(curve(t))


@query("w9_summary_features", """
SELECT animal_id, max(score) AS peak_score, arg_min(day, (-score, day)) AS peak_day, min(day) FILTER (score > 0) AS first_symptom_day,
       count(*) FILTER (NOT imputed) / (max(end_day) + 1)::double AS coverage, bool_or(imputed) AS end_imputed FROM curve GROUP BY 1""",
       "peak_score coverage")
def _(t):
    return V.summary_features(curve(t))


@query("w9_weight_features", """
SELECT animal_id, avg(weight) FILTER (day <= 2) AS baseline, min(weight) FILTER (day <= end_day) / avg(weight) FILTER (day <= 2) AS max_loss
FROM curves JOIN curve_ends USING (animal_id) GROUP BY 1""", "baseline max_loss")
def _(t):
    return V.weight_features(t.curves, t.curve_ends)


@query("w9_animal_features")
def _(t):
    return V.animal_features(t.curves, t.curve_ends)


@query("w10_align_at_onset", "SELECT animal_id, t, score FROM curve_aligned", "score")
def _(t):
    c = curve(t)
    return V.align_at_onset(c, V.onset(c))


@query("w11_weighted_history", "SELECT animal_id, tau, ewi FROM curve_history", "ewi")
def _(t):
    return V.weighted_history(t.curves, t.curve_ends, range(1, 31))


LAGSQL = ", ".join(f"({x})" for x in LAGS)
LAG = f"""
l AS (SELECT o.animal_id, lag::bigint AS lag, c.score FROM (SELECT DISTINCT animal_id, end_day FROM curve) e JOIN curve_onset o USING (animal_id),
      (VALUES {LAGSQL}) v(lag) JOIN curve c ON c.animal_id = o.animal_id AND c.day = e.end_day - lag WHERE onset_day IS NOT NULL AND lag <= e.end_day - onset_day)"""


@query("j6_score_at_lags", f"WITH {LAG} SELECT * FROM l", "score")
def _(t):
    c = curve(t)
    return V.score_at_lags(c, V.onset(c), LAGS)


PROFILE = f"""{LAG},
r AS (SELECT lag, rank() OVER (PARTITION BY lag ORDER BY score) + (count(*) OVER (PARTITION BY lag, score) - 1) / 2.0::double AS x,
             rank() OVER (PARTITION BY lag ORDER BY program) + (count(*) OVER (PARTITION BY lag, program) - 1) / 2.0::double AS y,
             rank() OVER (PARTITION BY lag ORDER BY severity) + (count(*) OVER (PARTITION BY lag, severity) - 1) / 2.0::double AS z FROM l JOIN curve_units USING (animal_id)),
g AS (SELECT lag, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY 1),
pr AS (SELECT lag, n, CASE WHEN n >= 5 THEN xy END AS raw, CASE WHEN n >= 5 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END AS partial FROM g)"""


@query("t30_lag_profile", f"WITH {PROFILE} SELECT * FROM pr", "raw partial")
def _(t):
    c = curve(t)
    return V.lag_profile(V.score_at_lags(c, V.onset(c), LAGS), t.curve_units, "program", "severity")


@query("t29_shape_contrast", f"""
WITH {PROFILE}, m AS (SELECT avg(raw) FILTER (lag >= 7) AS long_mean, avg(raw) FILTER (lag <= 3) AS short_mean FROM pr WHERE n >= 10)
SELECT *, long_mean - short_mean AS contrast FROM m""", "long_mean short_mean contrast")
def _(t):
    c = curve(t)
    return V.shape_contrast(V.lag_profile(V.score_at_lags(c, V.onset(c), LAGS), t.curve_units, "program", "severity"))


@query("t31_memory_timescale", """
WITH r AS (SELECT tau, rank() OVER (PARTITION BY tau ORDER BY ewi) + (count(*) OVER (PARTITION BY tau, ewi) - 1) / 2.0::double AS x,
                  rank() OVER (PARTITION BY tau ORDER BY program) + (count(*) OVER (PARTITION BY tau, program) - 1) / 2.0::double AS y
           FROM curve_history JOIN curve_units USING (animal_id)),
g AS (SELECT tau, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1)
SELECT arg_max(tau, (round(rho, 9), -tau)) AS tau_star, max(rho) AS rho_at_tau, max(n) AS n, arg_max(tau, (round(rho, 9), -tau)) = max(tau) AS at_scan_limit FROM g""",
       "rho_at_tau")
def _(t):
    return V.memory_timescale(V.weighted_history(t.curves, t.curve_ends, range(1, 31)), t.curve_units, "program")


@query("a19_covariance_surface", """
WITH c AS (SELECT animal_id, t, score - avg(score) OVER (PARTITION BY t) AS v FROM curve_aligned)
SELECT a.t AS t1, b.t AS t2, count(*) AS n, sum(a.v * b.v) / nullif(count(*) - 1, 0) AS cov FROM c a JOIN c b USING (animal_id) GROUP BY 1, 2""", "cov")
def _(t):
    c = curve(t)
    return V.covariance_surface(V.align_at_onset(c, V.onset(c)))


J4 = """
k AS (SELECT animal_id, section_id, list((day, score) ORDER BY day) AS curve_key FROM section_curves GROUP BY 1, 2),
n AS (SELECT animal_id, curve_key, count(*) AS n FROM k GROUP BY 1, 2),
m AS (SELECT animal_id, arg_max(curve_key, n) AS modal FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY animal_id ORDER BY n DESC, curve_key) = 1) GROUP BY 1),
rep AS (SELECT k.animal_id, min(k.section_id) AS rep FROM k JOIN m ON m.animal_id = k.animal_id AND m.modal = k.curve_key GROUP BY 1),
odd AS (SELECT k.animal_id, k.section_id, r.rep FROM k JOIN m USING (animal_id) JOIN rep r USING (animal_id) WHERE k.curve_key <> m.modal),
dis AS (SELECT o.animal_id, o.section_id, count(*) FILTER (a.score <> b.score) AS n_days_differ, max(abs(a.score - b.score)) AS max_abs_diff, coalesce(sum(abs(a.score - b.score)), 0) AS sum_abs_diff
        FROM odd o LEFT JOIN section_curves a ON a.section_id = o.section_id LEFT JOIN section_curves b ON b.section_id = o.rep AND b.day = a.day GROUP BY 1, 2)"""


@query("j4_section_disagreements", f"WITH {J4} SELECT * FROM dis", "max_abs_diff sum_abs_diff")
def _(t):
    return V.section_disagreements(t.section_curves)


@query("j5_identical_curves", f"""
WITH {J4}
SELECT a.animal_id AS unit, a.section_id AS section, b.animal_id AS other_unit, b.section_id AS other_section, count(*) AS n_shared
FROM section_curves a JOIN section_curves b ON a.day = b.day AND a.animal_id <> b.animal_id
WHERE a.section_id IN (SELECT section_id FROM dis) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4 AND bool_and(a.score = b.score)""")
def _(t):
    return V.identical_curves(V.section_disagreements(t.section_curves), t.section_curves, 4)


@query("j3_reconcile_sources", """
WITH l AS (SELECT DISTINCT event_type AS u, user_id AS m FROM events WHERE value > 20),
r AS (SELECT DISTINCT CASE WHEN event_type = 'click' THEN 'CLICK' WHEN event_type = 'view' THEN 'VIEW' ELSE event_type END AS u, user_id AS m FROM events WHERE value > 20 OR event_type = 'view'),
al(name, alias) AS (VALUES ('click', 'CLICK'), ('view', 'VIEW')),
ls AS (SELECT u, list(m ORDER BY m) AS s FROM l GROUP BY 1), rs AS (SELECT u, list(m ORDER BY m) AS s FROM r GROUP BY 1),
j AS (SELECT ls.u, coalesce(al.alias, ls.u) AS k, al.alias, ls.s FROM ls LEFT JOIN al ON al.name = ls.u)
SELECT coalesce(j.u, rs.u) AS unit, coalesce(j.k, rs.u) AS matched_to,
       CASE WHEN rs.s IS NULL THEN 'left_only' WHEN j.s IS NULL THEN 'right_only' WHEN j.alias IS NULL THEN 'matched' WHEN j.s = rs.s THEN 'aliased' ELSE 'alias_rejected' END AS status,
       coalesce(j.s = rs.s, false) AS same_members FROM j FULL JOIN rs ON j.k = rs.u""")
def _(t):
    e = t.raw("events")
    left = e.where("value > 20").select(F.col("event_type").alias("u"), F.col("user_id").alias("m"))
    ren = F.when(F.col("event_type") == "click", "CLICK").when(F.col("event_type") == "view", "VIEW").otherwise(F.col("event_type"))
    right = e.where("value > 20 or event_type = 'view'").select(ren.alias("u"), F.col("user_id").alias("m"))
    alias = e.select("event_type").distinct().where("event_type in ('click', 'view')") \
        .select(F.col("event_type").alias("name"), F.upper("event_type").alias("alias"))
    return V.reconcile(left, right, alias, "u", "m")


@query("s4_unpivot_day_sheet", "SELECT animal_id, day, score FROM curves", "score")
def _(t):
    last = t.curves.agg(F.max("day")).first()[0]        # a sheet has as many columns as the study has days
    days = [f"d{i}" for i in range((last or 0) + 1)]
    wide = (t.curves.withColumn("_c", F.concat(F.lit("d"), "day")).groupBy("animal_id").pivot("_c", days)
            .agg(F.first("score")))
    return V.unpivot_days(wide, ["animal_id"], days, "score").select("animal_id", "day", "score")
