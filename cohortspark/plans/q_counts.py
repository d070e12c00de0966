"""Count-level queries: A1-A9, A11-A16, A33, A36, M20, P3, P6, P7, P11-P14, S13."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.ordering import top_k
from cohortspark.operators import counts as C
from cohortspark.operators import selection as P
from cohortspark.plans.registry import query
from cohortspark.plans.tables import Tables

PROGRAM = "Brand#13"
SECOND = "Brand#7"


@query("a1_pseudobulk", """
SELECT s.animal_id, s.gene_id, s.n, ln(1 + s.n / l.lib::double * 10000) AS value
FROM (SELECT animal_id, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2) s
JOIN (SELECT animal_id, sum(cnt)::bigint AS lib FROM expr GROUP BY 1) l USING (animal_id)""", "value")
def _(t: Tables):
    return C.pseudobulk(t.expr, ["animal_id"]).select("animal_id", "gene_id", "n", "value")


@query("a2_pseudobulk_two_keys", """
SELECT s.animal_id, s.cell_type, s.gene_id, s.n, ln(1 + s.n / l.lib::double * 10000) AS value
FROM (SELECT animal_id, cell_type, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2, 3) s
JOIN (SELECT animal_id, cell_type, sum(cnt)::bigint AS lib FROM expr GROUP BY 1, 2) l USING (animal_id, cell_type)""",
       "value")
def _(t):
    return C.pseudobulk(t.expr, ["animal_id", "cell_type"]).select("animal_id", "cell_type", "gene_id", "n", "value")


@query("a2_roll_up_from_sections", """
SELECT s.animal_id, s.gene_id, s.n, ln(1 + s.n / l.lib::double * 10000) AS value
FROM (SELECT animal_id, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2) s
JOIN (SELECT animal_id, sum(cnt)::bigint AS lib FROM expr GROUP BY 1) l USING (animal_id)""", "value")
def _(t):
    by_section = C.count_sums(t.expr, ["animal_id", "region"])
    return C.roll_up(by_section, ["animal_id"]).select("animal_id", "gene_id", "n", "value")


@query("a3_composition", """
SELECT animal_id, cell_type, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY animal_id)::double AS fraction
FROM cells GROUP BY 1, 2""", "fraction")
def _(t):
    return C.composition(t.cells, ["animal_id"], "cell_type")


@query("a4_crosstab", """
SELECT cell_type, region, count(*) FILTER (niche = 'F') AS "F", count(*) FILTER (niche = 'O') AS "O",
       count(*) FILTER (niche = 'P') AS "P" FROM cells GROUP BY 1, 2""")
def _(t):
    return C.crosstab(t.cells, ["cell_type", "region"], "niche", ["F", "O", "P"])


@query("a5_detection", """
SELECT gene_id, count(*) AS n_pos, (SELECT count(*) FROM cells) AS n_cells,
       count(*) / (SELECT count(*) FROM cells)::double AS detected,
       sum(cnt)::bigint / (SELECT count(*) FROM cells)::double AS mean_count
FROM counts JOIN cells USING (cell_id) GROUP BY 1""", "detected mean_count")
def _(t):
    return C.detection(t.counts.join(t.cells, "cell_id"), t.cells)


@query("a5_detection_by_type", """
SELECT cell_type, gene_id, count(*) AS n_pos, any_value(k.n_cells) AS n_cells, count(*) / any_value(k.n_cells)::double AS detected,
       sum(cnt)::bigint / any_value(k.n_cells)::double AS mean_count
FROM counts JOIN cells USING (cell_id) JOIN (SELECT cell_type, count(*) AS n_cells FROM cells GROUP BY 1) k USING (cell_type)
GROUP BY 1, 2""", "detected mean_count")
def _(t):
    return C.detection(t.counts.join(t.cells, "cell_id"), t.cells, ["cell_type"])


@query("a6_mean_log_expression", """
SELECT v.animal_id, v.gene_id, sum(v) AS sum_log, any_value(n_cells) AS n_cells, sum(v) / any_value(n_cells) AS mean_log
FROM (SELECT animal_id, gene_id, ln(1 + cnt / (sum(cnt) OVER (PARTITION BY cell_id))::double * 10000) AS v
      FROM counts JOIN cells USING (cell_id)) v
JOIN (SELECT animal_id, count(*) AS n_cells FROM cells GROUP BY 1) k USING (animal_id) GROUP BY 1, 2""",
       "sum_log mean_log")
def _(t):
    return C.mean_log_expression(t.counts.join(t.cells, "cell_id"), t.cells, ["animal_id"], ["cell_id"])


@query("a7_marker_positive_sections", f"""
SELECT section_id, count(*) AS n_cells, avg(CASE WHEN k >= 1 THEN 1.0::double ELSE 0.0 END) AS frac_pos,
       CASE WHEN avg(CASE WHEN k >= 1 THEN 1.0::double ELSE 0.0 END) >= 0.2 THEN 'F' ELSE 'M' END AS call
FROM (SELECT c.section_id, c.cell_id, count(DISTINCT g.gene_id) AS k
      FROM cells c LEFT JOIN (SELECT counts.cell_id, gene_id FROM counts JOIN genes USING (gene_id)
                              WHERE program = '{PROGRAM}') g ON g.cell_id = c.cell_id GROUP BY 1, 2)
GROUP BY 1""", "frac_pos")
def _(t):
    markers = t.genes.where(F.col("program") == PROGRAM)
    flagged = C.marker_positive(t.counts, t.cells, markers, ["cell_id"], 1)
    return C.positive_fraction(flagged, ["section_id"], 0.2, "F", "M")


@query("a8_collapse_types", """
WITH s AS (SELECT niche, cell_type, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2, 3),
l AS (SELECT niche, cell_type, sum(n)::double AS lib FROM s GROUP BY 1, 2),
k AS (SELECT niche, cell_type, count(*) AS n_cells FROM cells GROUP BY 1, 2),
d AS (SELECT k.niche, k.cell_type, k.n_cells, g.gene_id, ln(1 + coalesce(s.n, 0) / l.lib * 10000) AS value
      FROM k JOIN l USING (niche, cell_type) JOIN (SELECT DISTINCT niche, gene_id FROM s) g USING (niche)
      LEFT JOIN s ON s.niche = k.niche AND s.cell_type = k.cell_type AND s.gene_id = g.gene_id)
SELECT niche, gene_id, sum(value * n_cells) / sum(n_cells) AS wmean FROM d GROUP BY 1, 2""",
       "wmean")
def _(t):
    pb = C.pseudobulk(t.expr, ["niche", "cell_type"])
    n = t.cells.groupBy("niche", "cell_type").agg(F.count(F.lit(1)).alias("n_cells"))
    return C.collapse(pb, n, ["niche"], ["cell_type"], "value", "n_cells")


@query("a9_weighted_position", """
SELECT animal_id, sum(n_cells * pos) / sum(n_cells) AS wmean
FROM (SELECT section_id, animal_id, count(*) AS n_cells, avg(cell_day) AS pos FROM cells GROUP BY 1, 2) GROUP BY 1""",
       "wmean")
def _(t):
    sec = t.cells.groupBy("section_id", "animal_id").agg(F.count(F.lit(1)).alias("n_cells"),
                                                         F.avg("cell_day").alias("pos"))
    return C.weighted_mean(sec, ["animal_id"], "pos", "n_cells")


@query("a10_spread", """
SELECT region, count(n_cells) AS n, avg(n_cells) AS mean, stddev_samp(n_cells) AS sd, min(n_cells) AS lo,
       max(n_cells) AS hi, quantile_cont(n_cells, 0.25) AS q25, median(n_cells) AS median,
       quantile_cont(n_cells, 0.75) AS q75, quantile_cont(n_cells, 0.75) - quantile_cont(n_cells, 0.25) AS iqr,
       max(n_cells) - min(n_cells) AS range FROM sections GROUP BY 1""", "mean sd q25 median q75 iqr")
def _(t):
    return C.spread(t.sections, ["region"], "n_cells")


@query("a11_mixed_groups", """
SELECT section_id, count(DISTINCT niche) AS n_labels, min(niche) AS first_label, max(niche) AS last_label
FROM cells GROUP BY 1 HAVING count(DISTINCT niche) > 1""")
def _(t):
    return C.mixed_groups(t.cells, ["section_id"], "niche")


@query("a12_modal_value", """
SELECT section_id, cell_type AS modal, n AS n_modal FROM (
  SELECT section_id, cell_type, count(*) AS n,
         row_number() OVER (PARTITION BY section_id ORDER BY count(*) DESC, cell_type) AS rn
  FROM cells GROUP BY 1, 2) WHERE rn = 1""")
def _(t):
    return C.modal(t.cells, ["section_id"], "cell_type")


@query("a13_constant_columns", """
SELECT section_id, min(animal_id) AS animal_id, min(region) AS region, min(niche) AS niche,
       min(animal_id) = max(animal_id) AND min(region) = max(region) AND min(niche) = max(niche) AS is_constant
FROM cells GROUP BY 1""")
def _(t):
    return C.constant_per_key(t.cells, ["section_id"], ["animal_id", "region", "niche"])


@query("a14_program_scores", """
SELECT program, animal_id, (SELECT count(*) FROM genes g JOIN (SELECT gene_id FROM pb_dense GROUP BY 1
                                                               HAVING max(value) <> min(value)) v USING (gene_id)
                            WHERE g.program = s.program) AS n_genes, score
FROM shared_programs s""", "score")
def _(t):
    pb = C.pseudobulk(t.expr, ["animal_id"])
    return C.program_scores(pb, t.animals, t.genes.select("program", "gene_id"))


A15 = f"""
m AS (SELECT gene_id, sum(v) / (SELECT count(*) FROM cells) AS mean_log FROM (
        SELECT gene_id, ln(1 + cnt / (sum(cnt) OVER (PARTITION BY cell_id))::double * 10000) AS v FROM counts) GROUP BY 1),
r AS (SELECT gene_id, mean_log, row_number() OVER (ORDER BY mean_log, gene_id) AS r, count(*) OVER () AS n FROM m),
b AS (SELECT gene_id, greatest(ceil((r - 1) / ((n - 1) / 25.0::double)) - 1, 0)::bigint AS bin FROM r),
mk AS (SELECT gene_id AS marker, bin FROM b JOIN genes USING (gene_id) WHERE program = '{PROGRAM}'),
pool AS (SELECT gene_id, bin FROM b JOIN genes USING (gene_id) WHERE program <> '{PROGRAM}'),
pick AS (SELECT marker, gene_id, bin, row_number() OVER (PARTITION BY marker ORDER BY md5(marker || '|' || gene_id || '|0'), gene_id) AS rn
         FROM mk JOIN pool USING (bin))"""


@query("a15_control_genes", f"WITH {A15} SELECT marker, gene_id, bin FROM pick WHERE rn <= 50")
def _(t):
    n = t.cells.agg(F.count(F.lit(1))).scalar()
    means = _gene_means(t, n)
    return C.control_genes(means, t.genes.where(F.col("program") == PROGRAM))


def _gene_means(t, n):
    from cohortspark.functions.scalars import log_cp10k
    v = t.counts.withColumn("_lib", C.cell_library(t.counts, ["cell_id"]))
    return v.groupBy("gene_id").agg((F.sum(log_cp10k("cnt", "_lib"))).alias("_s")) \
        .select("gene_id", (F.col("_s") / n).alias("mean_log"))


@query("a15_marker_minus_control", f"""
WITH {A15},
ctl AS (SELECT DISTINCT gene_id FROM pick WHERE rn <= 50),
v AS (SELECT animal_id, gene_id, sum(v) / any_value(k.n_cells) AS mean_log FROM (
        SELECT animal_id, gene_id, ln(1 + cnt / (sum(cnt) OVER (PARTITION BY cell_id))::double * 10000) AS v
        FROM counts JOIN cells USING (cell_id)) JOIN (SELECT animal_id, count(*) AS n_cells FROM cells GROUP BY 1) k USING (animal_id)
      GROUP BY 1, 2)
SELECT animal_id, sum(CASE WHEN mk.marker IS NOT NULL THEN mean_log ELSE 0 END) / (SELECT count(*) FROM genes WHERE program = '{PROGRAM}')
       - sum(CASE WHEN ctl.gene_id IS NOT NULL THEN mean_log ELSE 0 END) / (SELECT count(*) FROM ctl) AS score
FROM v LEFT JOIN mk ON mk.marker = v.gene_id LEFT JOIN ctl ON ctl.gene_id = v.gene_id GROUP BY 1""", "score")
def _(t):
    n = t.cells.agg(F.count(F.lit(1))).scalar()
    markers = t.genes.where(F.col("program") == PROGRAM)
    controls = C.control_genes(_gene_means(t, n), markers)
    per_animal = C.mean_log_expression(t.counts.join(t.cells, "cell_id"), t.cells, ["animal_id"], ["cell_id"])
    return C.marker_minus_control(per_animal, markers, controls, ["animal_id"])


@query("a16_gini", """
SELECT animal_id, count(*) AS n, sum((2 * rn - n - 1) * n_cells)::double / (count(*) * sum(n_cells)) AS gini
FROM (SELECT animal_id, n_cells, row_number() OVER (PARTITION BY animal_id ORDER BY n_cells) AS rn,
             count(*) OVER (PARTITION BY animal_id) AS n FROM sections) GROUP BY 1""", "gini")
def _(t):
    return C.gini(t.sections, ["animal_id"], "n_cells")


@query("a33_cells_per_unit", """
SELECT cell_type, median(n) AS median, min(n) AS lo, max(n) AS hi, count(*) FILTER (n >= 100) AS n_at_floor,
       count(*) FILTER (n >= 100) >= 20 AS in_sweep
FROM (SELECT a.animal_id, k.cell_type, count(c.cell_id) AS n FROM (SELECT DISTINCT animal_id FROM cells) a
      CROSS JOIN (SELECT DISTINCT cell_type FROM cells) k
      LEFT JOIN cells c ON c.animal_id = a.animal_id AND c.cell_type = k.cell_type GROUP BY 1, 2) GROUP BY 1""", "median")
def _(t):
    return C.cells_per_unit(t.cells, "animal_id", "cell_type", 100, 20)


@query("a36_gene_set_cell_score", f"""
SELECT cell_id, coalesce(sum(cnt) FILTER (program = '{PROGRAM}'), 0)::bigint AS n_set, sum(cnt)::bigint AS lib,
       ln(1 + coalesce(sum(cnt) FILTER (program = '{PROGRAM}'), 0) / sum(cnt)::double * 10000) AS score
FROM counts JOIN genes USING (gene_id) GROUP BY 1""", "score")
def _(t):
    return C.gene_set_cell_score(t.counts, t.genes.where(F.col("program") == PROGRAM), ["cell_id"])


@query("m20_variable_genes", """
SELECT gene_id, mean, variance, variance / mean AS dispersion FROM (
  SELECT gene_id, sum(value) / 25 AS mean, sum(value * value) / 25 - (sum(value) / 25) * (sum(value) / 25) AS variance
  FROM pb_dense GROUP BY 1) ORDER BY variance / mean DESC, gene_id LIMIT 200""", "mean variance dispersion")
def _(t):
    n = t.animals.agg(F.count(F.lit(1))).scalar()
    return C.variable_genes(C.pseudobulk(t.expr, ["animal_id"]), n, 200)


@query("p3_align_panel", f"""
WITH panel AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS pos FROM genes WHERE program IN ('{PROGRAM}', '{SECOND}')),
s AS (SELECT section_id, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2),
v AS (SELECT s.*, ln(1 + n / (sum(n) OVER (PARTITION BY section_id))::double * 10000) AS value FROM s),
hit AS (SELECT section_id, list(pos ORDER BY pos) AS places, list(round(value * 1000000)::bigint ORDER BY pos) AS seen FROM v JOIN panel USING (gene_id) GROUP BY 1)
SELECT section_id, len(places) AS n_present, array_to_string(list_transform(range((SELECT count(*) FROM panel)), lambda i: coalesce(seen[list_position(places, i)], 0)), ',') AS vector
FROM hit""")
def _(t):
    """One dense vector a section in panel order, as a list of millionths."""
    from pyspark.sql import Window
    genes = t.genes.where(F.col("program").isin(PROGRAM, SECOND))
    panel = genes.select("gene_id", (F.row_number().over(Window.orderBy("gene_id")) - 1).alias("pos"))
    size = genes.count()   # one number; the panel of a fitted model is a fixed list
    return C.panel_vectors(C.pseudobulk(t.expr, ["section_id"]), panel, ["section_id"], size,
                           text=lambda x: F.round(x * 1000000).cast("bigint").cast("string"))


@query("p3_missing_genes", f"""
WITH p AS (SELECT gene_id FROM genes WHERE program = '{PROGRAM}')
SELECT section_id, (SELECT count(*) FROM p) - count(DISTINCT p.gene_id) AS n_missing FROM expr LEFT JOIN p USING (gene_id) GROUP BY 1""")
def _(t):
    return C.missing_per_key(t.genes.where(F.col("program") == PROGRAM), t.expr, ["section_id"])


@query("s13_profile_columns", """
SELECT column_name, level, n FROM (
  SELECT 'niche' AS column_name, niche AS level, count(*) AS n FROM cells GROUP BY 2 UNION ALL
  SELECT 'region', region, count(*) FROM cells GROUP BY 2 UNION ALL
  SELECT 'cell_type', cell_type, count(*) FROM cells GROUP BY 2)""")
def _(t):
    return P.level_counts(t.cells, ["niche", "region", "cell_type", "section_id"], 30)


@query("s13_candidate_keys", """
SELECT 'section_id' AS column_name, count(DISTINCT section_id) AS n_distinct, count(*) / count(DISTINCT section_id)::double AS mean_rows,
       (SELECT median(n) FROM (SELECT count(*) AS n FROM cells GROUP BY section_id)) AS median_rows FROM cells UNION ALL
SELECT 'animal_id', count(DISTINCT animal_id), count(*) / count(DISTINCT animal_id)::double,
       (SELECT median(n) FROM (SELECT count(*) AS n FROM cells GROUP BY animal_id)) FROM cells UNION ALL
SELECT 'niche', count(DISTINCT niche), count(*) / count(DISTINCT niche)::double,
       (SELECT median(n) FROM (SELECT count(*) AS n FROM cells GROUP BY niche)) FROM cells""", "mean_rows median_rows")
def _(t):
    return P.candidate_keys(t.cells, ["section_id", "animal_id", "niche"])


@query("p1_cohort_filter", "SELECT animal_id, model, day, score FROM animals WHERE model = 'RR' AND day IS NOT NULL AND score IS NOT NULL",
       "day score")
def _(t):
    return P.cohort(t.animals, "model", "RR", ["day", "score"]).select("animal_id", "model", "day", "score")


DISPUTED = """SELECT section_id, min(animal_id) AS animal_id FROM cells GROUP BY 1 HAVING count(*) >= 18"""


@query("p2_exclude_sections", f"SELECT section_id, animal_id, n_cells FROM sections WHERE section_id NOT IN (SELECT section_id FROM ({DISPUTED}))")
def _(t):
    bad = t.sections.where("n_cells >= 18")
    return P.apply_section_mode(t.sections, bad, "exclude").select("section_id", "animal_id", "n_cells")


@query("p2_reassign_sections", f"""
SELECT s.section_id, coalesce(24 - d.animal_id, s.animal_id) AS animal_id, n_cells FROM sections s
LEFT JOIN ({DISPUTED}) d ON d.section_id = s.section_id""")
def _(t):
    new = t.sections.where("n_cells >= 18").select("section_id", (24 - F.col("animal_id")).alias("new_animal_id"))
    return P.apply_section_mode(t.sections, new, "reassign").select("section_id", "animal_id", "n_cells")


@query("p4_gene_set_include", f"SELECT gene_id, sum(cnt)::bigint AS n FROM counts WHERE gene_id IN (SELECT gene_id FROM genes WHERE program IN ('{PROGRAM}', '{SECOND}')) GROUP BY 1")
def _(t):
    gs = t.genes.where(F.col("program").isin(PROGRAM, SECOND))
    return P.keep_genes(t.counts, gs, exclude=False).groupBy("gene_id").agg(F.sum("cnt").alias("n"))


@query("p4_gene_set_exclude", f"SELECT gene_id, sum(cnt)::bigint AS n FROM counts WHERE gene_id NOT IN (SELECT gene_id FROM genes WHERE program IN ('{PROGRAM}', '{SECOND}')) GROUP BY 1")
def _(t):
    gs = t.genes.where(F.col("program").isin(PROGRAM, SECOND))
    return P.keep_genes(t.counts, gs, exclude=True).groupBy("gene_id").agg(F.sum("cnt").alias("n"))


@query("p5_gene_family", f"SELECT gene_id, symbol FROM genes WHERE regexp_matches(symbol, '^(red|small) ') OR program = '{PROGRAM}'")
def _(t):
    named = t.genes.where(F.col("program") == PROGRAM).select("gene_id")
    return P.gene_family(t.genes, "symbol", "^(red|small) ", named).select("gene_id", "symbol")


@query("p6_minimum_support", """
SELECT region, niche, animal_id, count(*) AS n FROM cells GROUP BY 1, 2, 3 HAVING count(*) >= 25""")
def _(t):
    return P.min_support(t.cells, ["region", "niche", "animal_id"], 25)


@query("p6_every_unit_supported", """
SELECT cell_type, niche FROM (SELECT cell_type, niche, animal_id, count(*) AS n FROM cells GROUP BY 1, 2, 3)
GROUP BY 1, 2 HAVING bool_and(n >= 25) AND count(*) = (SELECT count(DISTINCT animal_id) FROM cells)""")
def _(t):
    return P.every_unit_supported(t.cells, ["cell_type", "niche"], "animal_id", 25)


@query("p7_non_constant_features", """
SELECT gene_id FROM pb_dense GROUP BY 1 HAVING max(value) <> min(value)""")
def _(t):
    n = t.animals.agg(F.count(F.lit(1))).scalar()
    return P.drop_constant(C.pseudobulk(t.expr, ["animal_id"]), "gene_id", n).select("gene_id")


@query("p9_ordinal_rank", """
SELECT cell_id, niche, CASE niche WHEN 'O' THEN 0 WHEN 'P' THEN 1 END::bigint AS rank FROM cells WHERE niche IN ('O', 'P')""")
def _(t):
    return P.ordinal_rank(t.cells, "niche", ["O", "P"]).select("cell_id", "niche", "rank")


@query("p10_phase_from_stage", """
SELECT animal_id, CASE WHEN stage IN ('PEAK1') THEN 'peak' WHEN starts_with(stage, 'ONSET') THEN 'onset' ELSE 'rest' END AS phase
FROM animals""")
def _(t):
    return P.phase(t.animals, "stage", {"peak": ["PEAK1"]}, {"onset": "ONSET"}).select("animal_id", "phase")


@query("p11_dummies", """
SELECT animal_id, (run_id = 'AMERICA')::bigint AS "run_AMERICA", (run_id = 'ASIA')::bigint AS "run_ASIA",
       (run_id = 'EUROPE')::bigint AS "run_EUROPE", (run_id = 'MIDDLE EAST')::bigint AS "run_MIDDLE EAST" FROM animals""")
def _(t):
    return P.dummies(t.animals.select("animal_id", "run_id"), "run_id", "run_").drop("run_id")


@query("p12_alias_and_slide", """
SELECT animal_id, coalesce(a.alias, animal_name) AS atlas_name, split_part(animal_name, '_', 2) AS slide FROM animals
LEFT JOIN (SELECT 'REGION_' || r_regionkey AS alias, 'NATION_' || r_regionkey AS name FROM region) a ON a.name = animal_name""")
def _(t):
    al = t.raw("region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey")).alias("name"),
                                F.concat(F.lit("REGION_"), F.col("r_regionkey")).alias("alias"))
    return P.apply_alias(t.animals, al, "animal_name", "atlas_name") \
        .select("animal_id", "atlas_name", F.split("animal_name", "_")[1].alias("slide"))


@query("p13_module_labels", """
SELECT module, count(*) AS n_genes, sum(n)::bigint AS total FROM genes JOIN (SELECT gene_id, sum(cnt) AS n FROM counts GROUP BY 1) USING (gene_id) GROUP BY 1""")
def _(t):
    sums = C.count_sums(t.counts, [])
    return P.label_genes(sums, t.genes.select("gene_id", "module")).groupBy("module") \
        .agg(F.count(F.lit(1)).alias("n_genes"), F.sum("n").alias("total"))


@query("p14_shared_stages", """
SELECT animal_id, stage, run_id FROM animals WHERE stage IN (
  SELECT stage FROM animals GROUP BY 1 HAVING count(DISTINCT run_id) = (SELECT count(DISTINCT run_id) FROM animals))""")
def _(t):
    return P.shared_levels(t.animals, "stage", "run_id").select("animal_id", "stage", "run_id")


@query("w16_cap_rows_per_group", """
SELECT section_id, cell_id FROM (
  SELECT section_id, cell_id, row_number() OVER (PARTITION BY section_id ORDER BY md5(section_id || '|' || cell_id || '|0')) AS rn
  FROM cells) WHERE rn <= 5""")
def _(t):
    from cohortspark.functions.ordering import cap_rows
    return cap_rows(t.cells, ["section_id"], ["cell_id"], 5).select("section_id", "cell_id")


@query("w16_head_slice", """
SELECT section_id, cell_id FROM (SELECT section_id, cell_id, row_number() OVER (PARTITION BY section_id ORDER BY cell_id) AS rn
  FROM cells) WHERE rn <= 5""")
def _(t):
    from cohortspark.functions.ordering import cap_rows
    return cap_rows(t.cells, ["section_id"], ["cell_id"], 5, seed=None).select("section_id", "cell_id")


@query("w16_stratified_fraction", """
SELECT cell_type, cell_id FROM (
  SELECT cell_type, cell_id, row_number() OVER (PARTITION BY cell_type ORDER BY md5(cell_type || '|' || cell_id || '|0')) AS rn,
         greatest(1, round(count(*) OVER (PARTITION BY cell_type) * 0.25::double)) AS take FROM cells) WHERE rn <= take""")
def _(t):
    from cohortspark.functions.ordering import stratified_fraction
    return stratified_fraction(t.cells, ["cell_type"], ["cell_id"], 0.25).select("cell_type", "cell_id")


@query("w20_split_units", """
SELECT animal_id, CASE WHEN row_number() OVER (ORDER BY md5(animal_id || '|0')) <= greatest(1, round(count(*) OVER () * 0.25::double))
       THEN 'val' ELSE 'train' END AS split FROM animals""")
def _(t):
    from cohortspark.functions.ordering import split_units
    return split_units(t.animals, "animal_id", 0.25)


@query("w17_largest_gap_split", """
SELECT model, gap, threshold FROM (
  SELECT model, nxt - score AS gap, (score + nxt) / 2 AS threshold,
         row_number() OVER (PARTITION BY model ORDER BY nxt - score DESC, score) AS rn
  FROM (SELECT model, score, lead(score) OVER (PARTITION BY model ORDER BY score) AS nxt FROM animals) WHERE nxt IS NOT NULL)
WHERE rn = 1""", "gap threshold")
def _(t):
    from cohortspark.functions.ordering import largest_gap_split
    return largest_gap_split(t.animals, "score", ["model"])


@query("w12_both_ends", """
(SELECT animal_id, score, 'low' AS "end" FROM animals ORDER BY score, animal_id LIMIT 5) UNION ALL
(SELECT animal_id, score, 'high' AS "end" FROM animals ORDER BY score DESC, animal_id LIMIT 5)""", "score")
def _(t):
    from cohortspark.functions.ordering import both_ends
    return both_ends(t.animals.select("animal_id", "score"), "score", "animal_id", 5)


@query("w12_top_genes_per_type", """
SELECT cell_type, gene_id, n FROM (SELECT cell_type, gene_id, n, row_number() OVER (PARTITION BY cell_type ORDER BY n DESC, gene_id) AS rn
  FROM (SELECT cell_type, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2)) WHERE rn <= 30""")
def _(t):
    return top_k(C.count_sums(t.expr, ["cell_type"]), [F.col("n").desc(), F.col("gene_id")], 30, ["cell_type"])
