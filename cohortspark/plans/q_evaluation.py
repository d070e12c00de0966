"""Prediction tables, sets and joins: A20, A21, A23, A30, A31, A34, A35, U1-U5, S12, S14-S16, J1, J2, J12, J13, M19, W19."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import association as A
from cohortspark.operators import counts as C
from cohortspark.operators import evaluation as E
from cohortspark.plans.q_association import pb
from cohortspark.plans.registry import query
from cohortspark.plans.twin_ctes import CTES

# ordinal truth and prediction per cell: status rank and a rank read off the priority
CTES["ordinal"] = """
SELECT region, cell_id, section_id, animal_id, cell_type, CASE niche WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS truth,
       least(substr(cell_type, 1, 1)::bigint // 2, 2) AS pred, cell_day FROM cells"""


def ordinal(t):
    truth = F.when(F.col("niche") == "F", 0).when(F.col("niche") == "O", 1).otherwise(2)
    pred = F.least(F.floor(F.substring("cell_type", 1, 1).cast("int") / 2), F.lit(2))
    return t.cells.withColumn("truth", truth).withColumn("pred", pred)


@query("a20_confusion", "SELECT region, truth, pred, count(*) AS n FROM ordinal GROUP BY 1, 2, 3")
def _(t):
    return E.confusion(ordinal(t), ["region"], "truth", "pred")


@query("a20_class_scores", """
WITH k AS (SELECT region, truth, count(*) AS n, count(*) FILTER (truth = pred) AS hit, sum(abs(truth - pred)) AS err FROM ordinal GROUP BY 1, 2)
SELECT region, sum(n)::bigint AS n, sum(hit) / sum(n)::double AS accuracy, avg(hit / n::double) AS balanced_accuracy, sum(err) / sum(n)::double AS mae FROM k GROUP BY 1""",
       "accuracy balanced_accuracy mae")
def _(t):
    return E.class_scores(ordinal(t), ["region"], "truth", "pred")


@query("a21_auc_by_region", """
WITH r AS (SELECT region, (truth = 2)::bigint AS p, rank() OVER (PARTITION BY region ORDER BY cell_day) + (count(*) OVER (PARTITION BY region, cell_day) - 1) / 2.0::double AS r FROM ordinal)
SELECT region, sum(p)::bigint AS n_pos, (count(*) - sum(p))::bigint AS n_neg, (sum(p * r) - sum(p) * (sum(p) + 1) / 2.0::double) / (sum(p) * (count(*) - sum(p))) AS auc FROM r GROUP BY 1""", "auc")
def _(t):
    d = ordinal(t).select("region", (F.col("truth") == 2).alias("pos"), F.col("cell_day").cast("double").alias("s"))
    return E.auc(d, ["region"], "pos", "s")


COEF = "coef AS (SELECT gene_id, CASE WHEN abs(rho) >= 0.3 THEN rho ELSE 0 END AS coef FROM gene_trend), coef2 AS (SELECT gene_id, CASE WHEN abs(rho_xs) >= 0.3 THEN rho_xs ELSE 0 END AS coef FROM gene_trend)"


def coefs(t, target):
    r = A.spearman_trend(pb(t), t.animals, "gene_id", "animal_id", target, fdr=False)
    return r.select("gene_id", F.when(F.abs("rho") >= 0.3, F.col("rho")).otherwise(0.0).alias("coef"))


@query("a23_block_mass", f"""
WITH {COEF}, r AS (SELECT gene_id, coef, row_number() OVER (ORDER BY round(abs(coef), 12) DESC, gene_id) AS rk FROM coef WHERE coef <> 0)
SELECT module, count(*) AS n_genes, sum(abs(coef)) / (SELECT sum(abs(coef)) FROM r) AS mass, min(rk) AS first_rank FROM r JOIN genes USING (gene_id) GROUP BY 1""", "mass")
def _(t):
    c = coefs(t, "day").withColumn("coef", F.round("coef", 12))
    return E.block_mass(c, t.genes, "gene_id", "coef", "module")


@query("a23_coefficient_overlap", f"""
WITH {COEF} SELECT count(*) AS n_overlap, count(*) FILTER (sign(a.coef) = sign(b.coef)) AS n_same_sign FROM coef a JOIN coef2 b USING (gene_id) WHERE a.coef <> 0 AND b.coef <> 0""")
def _(t):
    return E.coefficient_overlap(coefs(t, "day"), coefs(t, "score"), "gene_id", "coef")


CTES["attn"] = """
SELECT c.*, model, o_totalprice / sum(o_totalprice) OVER (PARTITION BY section_id) AS weight, ln(o_totalprice) AS score
FROM cells c JOIN orders ON o_orderkey = cell_id JOIN (SELECT animal_id, model FROM animals) USING (animal_id)"""


def scored(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("cell_id"), F.log("o_totalprice").alias("score"))
    return t.cells.join(o, "cell_id").join(t.animals.select("animal_id", "model"), "animal_id")


@query("a30_attention_enrichment", """
WITH p AS (SELECT section_id, model, cell_type, sum(weight) AS a, count(*) AS n FROM attn GROUP BY 1, 2, 3),
f AS (SELECT *, n / (sum(n) OVER (PARTITION BY section_id))::double AS fr FROM p)
SELECT f.model, cell_type, sum(a) / any_value(b.k) AS attention, sum(fr) / any_value(b.k) AS composition FROM f
JOIN (SELECT model, count(DISTINCT section_id) AS k FROM attn GROUP BY 1) b USING (model) GROUP BY 1, 2""", "attention composition")
def _(t):
    w = E.attention_weights(scored(t), "section_id", "score")
    return E.attention_enrichment(w, "section_id", "cell_type", "model", "weight")


@query("a31_bag_pooling", """
SELECT section_id, count(*) AS n_cells, sum(weight * cell_day) AS cell_day_attn, avg(cell_day) AS cell_day_mean, sum(weight * score) AS score_attn, avg(score) AS score_mean FROM attn GROUP BY 1""",
       "cell_day_attn cell_day_mean score_attn score_mean")
def _(t):
    return E.pool_bags(scored(t), "section_id", "score", ["cell_day", "score"])


@query("a34_training_weights", """
WITH s AS (SELECT *, CASE WHEN region IN ('BUILDING', 'FURNITURE') THEN 'val' ELSE 'train' END AS split FROM sections)
SELECT section_id, 1.0::double / count(*) OVER (PARTITION BY animal_id) AS sample_weight,
       (n_cells - (SELECT avg(n_cells) FROM s WHERE split = 'train')) / (SELECT stddev_pop(n_cells) FROM s WHERE split = 'train') AS y_std FROM s""", "sample_weight y_std")
def _(t):
    s = t.sections.withColumn("split", F.when(F.col("region").isin("BUILDING", "FURNITURE"), "val").otherwise("train"))
    return E.training_weights(s, "animal_id", "n_cells", "split").select("section_id", "sample_weight", "y_std")


@query("a35_ensemble", """
SELECT animal_id, avg(p) * 2 + 10 AS pred, count(*) AS n_seeds FROM (SELECT animal_id, cell_type, avg(cell_day) AS p FROM cells GROUP BY 1, 2) GROUP BY 1""", "pred")
def _(t):
    return E.ensemble(t.cells, "animal_id", "cell_type", "cell_day", 10.0, 2.0)


@query("s12_merge_seed_lists", """
WITH l AS (SELECT animal_id, niche, string_agg(cell_day::varchar, ';') AS seeds FROM cells GROUP BY 1, 2)
SELECT animal_id, avg(p::double) AS pred, count(*) AS n_seeds FROM (SELECT animal_id, unnest(string_split(seeds, ';')) AS p FROM l) GROUP BY 1""", "pred")
def _(t):
    rows = t.cells.groupBy("animal_id", "niche").agg(F.concat_ws(";", F.collect_list(F.col("cell_day").cast("string"))).alias("seeds"))
    return E.merge_seed_lists(rows, ["animal_id"], "seeds")


@query("s14_check_against_stored", """
WITH a AS (SELECT region, avg(cell_day) AS v FROM cells GROUP BY 1), b AS (SELECT region, avg(cell_day) AS v FROM cells WHERE niche <> 'F' GROUP BY 1)
SELECT region, a.v AS got, b.v AS expected, coalesce(abs(a.v - b.v) <= 5, false) AS ok FROM a FULL JOIN b USING (region)""", "got expected")
def _(t):
    a = t.cells.groupBy("region").agg(F.avg("cell_day").alias("v"))
    b = t.cells.where("niche <> 'F'").groupBy("region").agg(F.avg("cell_day").alias("v"))
    return E.check_against(a, b, ["region"], "v", 5.0)


@query("s16_sensitivity_table", """
WITH a AS (SELECT region, niche, avg(cell_day) AS v FROM cells GROUP BY 1, 2),
b AS (SELECT region, niche, avg(cell_day) AS v FROM cells JOIN (SELECT section_id FROM cells GROUP BY 1 HAVING count(*) < 15) USING (section_id) GROUP BY 1, 2)
SELECT region, niche, a.v AS default_value, b.v AS variant_value, b.v - a.v AS change FROM a JOIN b USING (region, niche)""", "default_value variant_value change")
def _(t):
    a = t.cells.groupBy("region", "niche").agg(F.avg("cell_day").alias("v"))
    keep = t.sections.where("n_cells < 15").select("section_id")
    b = t.cells.join(keep, "section_id", "left_semi").groupBy("region", "niche").agg(F.avg("cell_day").alias("v"))
    return E.side_by_side(a, b, ["region", "niche"], "v")


@query("s15_animal_table", """
SELECT a.animal_id, model, stage, day, score, (SELECT count(*) FROM sections s WHERE s.animal_id = a.animal_id) AS n_sections, f.fraction AS urgent_fraction, l.lib
FROM animals a LEFT JOIN (SELECT animal_id, count(*) FILTER (cell_type = '1-URGENT') / count(*)::double AS fraction FROM cells GROUP BY 1) f USING (animal_id)
LEFT JOIN (SELECT animal_id, sum(cnt)::bigint AS lib FROM expr GROUP BY 1) l USING (animal_id)""", "day score urgent_fraction")
def _(t):
    n = t.sections.groupBy("animal_id").agg(F.count(F.lit(1)).alias("n_sections"))
    f = C.composition(t.cells, ["animal_id"], "cell_type").where("cell_type = '1-URGENT'").select("animal_id", F.col("fraction").alias("urgent_fraction"))
    lib = t.expr.groupBy("animal_id").agg(F.sum("cnt").alias("lib"))
    base = t.animals.select("animal_id", "model", "stage", "day", "score")
    return base.join(n, "animal_id", "left").join(f, "animal_id", "left").join(lib, "animal_id", "left")


@query("u1_stack_cohorts", "SELECT animal_id, model, score FROM animals WHERE model = 'RR' UNION ALL SELECT animal_id, model, score FROM animals WHERE model = 'MONO'", "score")
def _(t):
    a = t.animals.select("animal_id", "model", "score")
    return E.stack_cohorts(a.where("model = 'RR'"), a.where("model = 'MONO'"))


MEMBERS = "mem AS (SELECT DISTINCT gene_id, niche AS s FROM counts JOIN cells USING (cell_id) WHERE cnt >= 40)"


def members(t):
    return t.counts.where("cnt >= 40").join(t.cells, "cell_id").select("gene_id", F.col("niche").alias("s")).distinct()


@query("u2_set_overlaps", f"""
WITH {MEMBERS}, z AS (SELECT s, count(*) AS n FROM mem GROUP BY 1)
SELECT a.s AS set_a, b.s AS set_b, count(*) AS n_both, count(*) / (max(za.n) + max(zb.n) - count(*))::double AS jaccard
FROM mem a JOIN mem b ON a.gene_id = b.gene_id AND a.s < b.s JOIN z za ON za.s = a.s JOIN z zb ON zb.s = b.s GROUP BY 1, 2""", "jaccard")
def _(t):
    return E.set_overlaps(members(t), "gene_id", "s")


@query("u5_exclusive_intersections", f"""
WITH {MEMBERS} SELECT b AS bitmap, count(*) AS n FROM (SELECT gene_id, sum(CASE s WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END)::bigint AS b FROM mem GROUP BY 1) GROUP BY 1""")
def _(t):
    return E.set_partition(members(t), "gene_id", "s", ["F", "O", "P"])


@query("u3_raw_vs_adjusted", """
WITH a AS (SELECT gene_id FROM gene_trend WHERE abs(rho) >= 0.4), b AS (SELECT gene_id FROM gene_trend WHERE abs((rho - rho_xs * rho_ys) / sqrt((1 - rho_xs * rho_xs) * (1 - rho_ys * rho_ys))) >= 0.4)
SELECT coalesce(a.gene_id, b.gene_id) AS gene_id, CASE WHEN a.gene_id IS NOT NULL AND b.gene_id IS NOT NULL THEN 'both' WHEN b.gene_id IS NULL THEN 'only_first' ELSE 'only_second' END AS membership
FROM a FULL JOIN b ON a.gene_id = b.gene_id""")
def _(t):
    r = A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False)
    return E.set_algebra(r.where("abs(r_raw) >= 0.4"), r.where("abs(partial) >= 0.4"), "gene_id")


@query("u4_ordered_union", """
WITH l AS (SELECT n_regionkey AS list_no, c_custkey AS pos, c_mktsegment || c_nationkey AS item FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT item, min((list_no, pos)).list_no::bigint AS list_no, min((list_no, pos)).pos AS pos FROM (SELECT item, {'list_no': list_no, 'pos': pos} AS p, list_no, pos FROM l) GROUP BY 1""".replace(
    "min((list_no, pos)).list_no", "min(p).list_no").replace("min((list_no, pos)).pos", "min(p).pos"))
def _(t):
    cu, n = t.raw("customer"), t.raw("nation")
    rows = cu.join(n, cu.c_nationkey == n.n_nationkey).select(
        F.col("n_regionkey").alias("list_no"), F.col("c_custkey").alias("pos"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("item"))
    return E.ordered_union(rows, "item", "list_no", "pos")


@query("j1_enrich_sections", "SELECT s.section_id, s.n_cells, a.model, a.stage, a.day FROM sections s JOIN animals a USING (animal_id)", "day")
def _(t):
    return t.sections.join(t.animals.select("animal_id", "model", "stage", "day"), "animal_id").drop("animal_id", "region")


@query("j2_gene_table_join", """
SELECT g.gene_id, g.rho, g.rho_xs, p.module, s.n FROM gene_trend g JOIN genes p USING (gene_id) JOIN (SELECT gene_id, sum(cnt)::bigint AS n FROM counts GROUP BY 1) s USING (gene_id)""",
       "rho rho_xs")
def _(t):
    r = A.partial_trend(pb(t), t.animals, "gene_id", "animal_id", "day", "score", fdr=False)
    r = r.select("gene_id", F.col("r_raw").alias("rho"), F.col("r_given").alias("rho_xs"))
    return r.join(t.genes.select("gene_id", "module"), "gene_id").join(C.count_sums(t.counts, []), "gene_id")


@query("j13_align_predictions", """
WITH p AS (SELECT cell_type AS arm, animal_id, avg(cell_day) AS pred FROM cells WHERE NOT (cell_type = '2-HIGH' AND region = 'BUILDING') GROUP BY 1, 2 UNION ALL
           SELECT 'partial', animal_id, avg(cell_day) FROM cells JOIN (SELECT animal_id, model FROM animals) USING (animal_id) WHERE model = 'RR' GROUP BY 2)
SELECT arm, animal_id, pred FROM p WHERE arm IN (SELECT arm FROM p GROUP BY 1 HAVING count(*) = 25)""", "pred")
def _(t):
    p = t.cells.where("not (cell_type = '2-HIGH' and region = 'BUILDING')").groupBy(F.col("cell_type").alias("arm"), "animal_id").agg(F.avg("cell_day").alias("pred"))
    half = t.cells.join(t.animals.where("model = 'RR'").select("animal_id"), "animal_id", "left_semi") \
        .groupBy("animal_id").agg(F.avg("cell_day").alias("pred")).select(F.lit("partial").alias("arm"), "animal_id", "pred")
    return E.align_predictions(p.unionByName(half), "animal_id", "arm", "pred", t.animals)


@query("m19_region_baseline", """
WITH g AS (SELECT animal_id AS fold, region, sum((niche = 'F')::bigint) AS s, count(*) AS n FROM cells GROUP BY 1, 2)
SELECT fold, region, (sum(s) OVER w - s + 1) / (sum(n) OVER w - n + 2)::double AS prob FROM g WINDOW w AS (PARTITION BY region)""", "prob")
def _(t):
    d = t.cells.select(F.col("animal_id").alias("fold"), "region", (F.col("niche") == "F").cast("int").alias("y"))
    return E.region_baseline(d, "fold", "region", "y")
