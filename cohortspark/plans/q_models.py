"""Model queries on the task grid: M1-M18, M22-M25. Fits have no SQL twin; M6, M7 and the tests' brute force do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.operators import counts as C
from cohortspark.operators import curves as V
from cohortspark.operators import evaluation as E
from cohortspark.operators import grid as M
from cohortspark.operators import resample as R
from cohortspark.plans.q_association import pb
from cohortspark.plans.registry import query
from cohortspark.plans.twin_ctes import CTES
from cohortspark.session import cut

S = M.Settings()                       # 1000 features, 50 penalties
NULL = M.Settings(keep_coef=1)         # the same for permuted targets


def xs(t, keys=("animal_id",), feature_set=None, source=None):
    v = C.pseudobulk(source if source is not None else t.expr, list(keys))
    return M.feature_rows(v, "animal_id", "gene_id", "value", feature_set)


def us(t, target="day", cov=("score",), fold="animal_id"):
    return M.unit_table(t.animals, "animal_id", fold, [target], list(cov))


def named(df):
    return df.withColumnRenamed("unit", "animal_id")


@query("m1_leave_one_out_clock")
def _(t):
    preds, _c = M.leave_out_regression(xs(t), us(t), S)
    return named(preds).drop("task", "target")


@query("m1_clock_without_covariate")
def _(t):
    preds, _c = M.leave_out_regression(xs(t), us(t, cov=()), S)
    return named(preds).drop("task", "target")


@query("m2_clock_with_kept_columns")
def _(t):
    kept = t.genes.where(F.col("program") == "Brand#13").select(F.col("gene_id").alias("feature"))
    preds, _c = M.leave_out_regression(xs(t), us(t), S, keep=kept)
    return named(preds).drop("task", "target")


@query("m3_clock_audit")
def _(t):
    u = us(t)
    preds, _c = M.leave_out_regression(xs(t), u, S)
    return M.fold_scores(preds, u, True)


@query("m4_composition_components_as_covariates")
def _(t):
    from cohortspark.functions.scalars import clr
    f = C.composition(t.cells, ["animal_id"], "cell_type").withColumn("v", clr("fraction", ["animal_id"]))
    w = f.groupBy("animal_id").pivot("cell_type", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.first("v")).na.fill(0.0)
    names = [f"k{i}" for i in range(5)]
    u = t.animals.join(w.toDF("animal_id", *names), "animal_id")
    grid = M.unit_table(u, "animal_id", "animal_id", ["day"], names)
    preds, _c = M.leave_out_regression(xs(t), grid, M.Settings(covariate_share=0.8))
    return named(preds).drop("task", "target")


@query("m4_position_inside_the_fold")
def _(t):
    """The clock adjusted for severity and for a position that each fold reads off one gene family on its training animals."""
    v = cut(pb(t).select("animal_id", "gene_id", "value"))     # read by the family, its anchor and the clock
    family = v.join(t.genes.where(F.col("program") == "Brand#13").select("gene_id"), "gene_id", "left_semi")
    rows = M.feature_rows(family, "animal_id", "gene_id", "value")
    anchor = t.genes.where(F.col("program") == "Brand#13").agg(F.min("gene_id").cast("string")).first()[0]
    axis = M.in_fold_axis(rows, us(t, cov=()), anchor, S)
    preds, _c = M.leave_out_regression(M.feature_rows(v, "animal_id", "gene_id", "value"), M.with_in_fold_covariate(us(t), axis), S)
    return named(preds).drop("task", "target")


@query("m4_several_scores_as_covariates")
def _(t):
    """Severity and three program scores of the animal together as covariates."""
    programs = ["Brand#11", "Brand#12", "Brand#13"]
    v = pb(t).join(t.genes.select("gene_id", "program"), "gene_id").where(F.col("program").isin(programs))
    w = v.groupBy("animal_id").pivot("program", programs).agg(F.sum("value")).na.fill(0.0).toDF("animal_id", "s0", "s1", "s2")
    grid = M.unit_table(t.animals.join(w, "animal_id"), "animal_id", "animal_id", ["day"], ["score", "s0", "s1", "s2"])
    preds, _c = M.leave_out_regression(xs(t), grid, S)
    return named(preds).drop("task", "target")


@query("m5_full_fit_coefficients")
def _(t):
    _p, coefs = M.leave_out_regression(xs(t), us(t, fold=None), S, full_fit=True)
    return coefs.select("feature", "coef")


@query("m5_fitted_clock")
def _(t):
    """The clock of all animals as a table: chosen features on the scale of the data, and the line as rows of their own."""
    clock, _p = M.fit_clock(xs(t), us(t, fold=None), S, full_fit=True)
    line = clock.lines.select(F.posexplode("line").alias("i", "weight")).select(
        F.when(F.col("i") == 0, "(intercept)").otherwise(F.concat(F.lit("(covariate "), F.col("i"), F.lit(")"))).alias("feature"), "weight")
    return clock.weights.select("feature", "coef", "weight", "sd").unionByName(line, allowMissingColumns=True)


def section_rows(t, source=None, value="value"):
    v = source if source is not None else C.pseudobulk(t.expr, ["section_id"])
    return v.select(F.col("section_id").alias("unit"), F.col("gene_id").cast("string").alias("feature"), F.col(value).alias("value"))


def section_samples(t, fold):
    a = t.animals.select("animal_id", F.col("score").cast("double").alias("score"))
    return t.sections.select("section_id", "animal_id").join(a, "animal_id").select(
        F.lit("all").alias("task"), fold.alias("fold"), F.col("section_id").alias("unit"), F.array("score").alias("c"))


@query("m6_fold_clock_sections")
def _(t):
    """Sections dated by the clock that never saw their animal, on the residual and on the day scale."""
    clock, _p = M.fit_clock(xs(t), us(t), S)
    got = clock.score(section_rows(t), section_samples(t, F.col("animal_id").cast("string")))
    return got.select(F.col("unit").alias("section_id"), F.col("fold").cast("bigint").alias("animal_id"), "n_hits", "pred_residual", "pred_day")


@query("m7_fold_clock_noise")
def _(t):
    """Measurement noise of these dates: half the difference between binomial halves of the counts."""
    from cohortspark.functions.scalars import log_cp10k
    clock, _p = M.fit_clock(xs(t), us(t), S)
    h = M.thin_counts(C.count_sums(t.expr, ["section_id"]).withColumnRenamed("n", "cnt"), ["section_id", "gene_id"])
    w = Window.partitionBy("section_id")
    h = h.select("section_id", "gene_id", log_cp10k("half_a", F.sum("half_a").over(w)).alias("va"), log_cp10k("half_b", F.sum("half_b").over(w)).alias("vb"))
    halves = section_rows(t, h, "va").withColumn("half", F.lit("a")).unionByName(section_rows(t, h, "vb").withColumn("half", F.lit("b")))
    samples = section_samples(t, F.col("animal_id").cast("string")).withColumn("half", F.explode(F.array(F.lit("a"), F.lit("b"))))
    got = clock.score(halves, samples, extra=["half"])
    return got.groupBy(F.col("unit").alias("section_id")).agg(
        (F.abs(F.sum(F.when(F.col("half") == "a", F.col("pred_residual")).otherwise(-F.col("pred_residual")))) / 2).alias("noise"))


@query("m24_fitted_transfer")
def _(t):
    """A clock of one cohort's animals scores the sections of both: rank correlation with the animal's day."""
    from cohortspark.operators.association import grouped_spearman
    own = t.animals.where("model = 'RR'")
    u = M.unit_table(own, "animal_id", None, ["day"], ["score"])
    clock, _p = M.fit_clock(xs(t), u, S, full_fit=True)
    got = clock.score(section_rows(t), section_samples(t, F.lit("")))
    j = got.withColumnRenamed("unit", "section_id").join(t.sections, "section_id").join(t.animals.select("animal_id", "model", "day"), "animal_id")
    return grouped_spearman(j.withColumn("pred", F.round("pred_day", 9)), "pred", "day", ["model"])


CTES["frozen"] = "SELECT gene_id, (weight - 900) / 1000 AS beta, 1.0::double + gene_size / 50.0::double AS mean, 0.5::double + gene_size / 100.0::double AS sd FROM genes WHERE program IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')"


def frozen(t):
    g = t.genes.where(F.col("program").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4"))
    return g.select("gene_id", ((F.col("weight") - 900) / 1000).alias("beta"), (1.0 + F.col("gene_size") / 50.0).alias("mean"),
                    (0.5 + F.col("gene_size") / 100.0).alias("sd"))


SEC_PB = """
s AS (SELECT section_id, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2),
v AS (SELECT s.*, ln(1 + n / (sum(n) OVER (PARTITION BY section_id))::double * 10000) AS value FROM s)"""


@query("m6_score_frozen_model", f"""
WITH {SEC_PB}, h AS (SELECT section_id, gene_id, beta * value / sd AS part FROM v JOIN frozen USING (gene_id))
SELECT section_id, count(part) AS n_hits, coalesce(sum(part), 0) + (SELECT sum(-beta * mean / sd) FROM frozen) AS pred FROM sections LEFT JOIN h USING (section_id) GROUP BY 1""", "pred")
def _(t):
    return M.score_frozen(C.pseudobulk(t.expr, ["section_id"]), frozen(t), t.sections, ["section_id"])


THIN = """
th AS (SELECT section_id, gene_id, cnt, sum(bit_count((('0x' || substr(md5(section_id || '|' || gene_id || '|' || w || '|0'), 1, 8))::bigint & ((1::bigint << least(32, cnt - w * 32)::int) - 1))))::bigint AS half_a
       FROM (SELECT section_id, gene_id, sum(cnt)::bigint AS cnt FROM expr GROUP BY 1, 2), range(0, 40) r(w) WHERE w * 32 < cnt GROUP BY 1, 2, 3)"""


@query("m7_binomial_halves", f"WITH {THIN} SELECT *, cnt - half_a AS half_b FROM th")
def _(t):
    s = C.count_sums(t.expr, ["section_id"]).withColumnRenamed("n", "cnt")
    return M.thin_counts(s, ["section_id", "gene_id"])


@query("m7_measurement_noise", f"""
WITH {THIN}, a AS (SELECT section_id, gene_id, ln(1 + half_a / (sum(half_a) OVER (PARTITION BY section_id))::double * 10000) AS va,
   ln(1 + (cnt - half_a) / (sum(cnt - half_a) OVER (PARTITION BY section_id))::double * 10000) AS vb FROM th)
SELECT section_id, coalesce(abs(sum(d)) / 2, 0) AS noise FROM sections LEFT JOIN (SELECT section_id, beta * (va - vb) / sd AS d FROM a JOIN frozen USING (gene_id)) USING (section_id) GROUP BY 1""", "noise")
def _(t):
    from cohortspark.functions.scalars import log_cp10k
    s = C.count_sums(t.expr, ["section_id"]).withColumnRenamed("n", "cnt")
    h = M.thin_counts(s, ["section_id", "gene_id"])
    w = Window.partitionBy("section_id")
    h = h.select("section_id", "gene_id", log_cp10k("half_a", F.sum("half_a").over(w)).alias("va"), log_cp10k("half_b", F.sum("half_b").over(w)).alias("vb"))
    j = h.join(frozen(t), "gene_id").groupBy("section_id").agg(F.sum(F.col("beta") * F.col("va") / F.col("sd")).alias("a"),
                                                               F.sum(F.col("beta") * F.col("vb") / F.col("sd")).alias("b"))
    # a section without a gene of the model scores the same constant in both halves
    return t.sections.select("section_id").join(j, "section_id", "left").select(
        "section_id", F.coalesce(F.abs(F.col("a") - F.col("b")) / 2, F.lit(0.0)).alias("noise"))


@query("m8_leave_one_run_out")
def _(t):
    preds, _c = M.leave_out_regression(xs(t), us(t, fold="run_id"), S)
    return named(preds).drop("task", "target")


@query("m9_component_logistic_auc")
def _(t):
    a = t.animals.withColumn("y", (F.col("model") == "RR").cast("int"))
    u = M.unit_table(a, "animal_id", "animal_id", ["y"], ["score"])
    p = M.leave_out_classification(xs(t), u, 5, S)
    genes = E.auc(p.withColumn("pos", F.col("truth") == 1.0), ["task"], "pos", "prob").drop("task").withColumn("arm", F.lit("components"))
    # the same folds with severity as the only feature
    sev = M.feature_rows(t.animals.select("animal_id", F.lit("score").alias("g"), F.col("score").alias("v")), "animal_id", "g", "v")
    q = M.leave_out_classification(sev, M.unit_table(a, "animal_id", "animal_id", ["y"]), 1, S)
    return genes.unionByName(E.auc(q.withColumn("pos", F.col("truth") == 1.0), ["task"], "pos", "prob").drop("task").withColumn("arm", F.lit("severity")))


@query("m9_auc_permutation_null")
def _(t):
    """The AUC of the components arm against 200 permutations of the label over animals, all of them columns of one fit."""
    from cohortspark.operators import classify as K
    a = t.animals.select("animal_id", "score", (F.col("model") == "RR").cast("double").alias("y"))
    u = M.permuted_targets(a, "animal_id", "y", 200).select(F.lit("all").alias("task"), F.lit("all").alias("fset"), F.col("animal_id").alias("unit"),
                                                           F.col("animal_id").cast("string").alias("fold"), "y", F.array("score").alias("c"))
    p = M.leave_out_classification(xs(t), u, 5, S)
    got = E.auc(p.withColumn("pos", F.col("truth") == 1.0), ["task", "target"], "pos", "prob").withColumnRenamed("target", "rep")
    return K.draw_null(got, "auc").drop("task")


def perm_units(t, reps, within=()):
    p = M.permuted_targets(t.animals.select("animal_id", "day", "score", "run_id"), "animal_id", "day", reps, within=within)
    return p.select(F.lit("all").alias("task"), F.lit("all").alias("fset"), F.col("animal_id").alias("unit"),
                    F.col("animal_id").cast("string").alias("fold"), "y", F.array("score").alias("c"))


@query("m10_clock_permutation_null")
def _(t):
    u = perm_units(t, 1000)
    preds, _c = M.leave_out_regression(xs(t), u, NULL)
    return M.null_of_first(M.fold_scores(preds, u, True)).drop("task")


def by_type(t):
    """One feature set and one task per cell type."""
    kinds = t.cells.select(F.col("cell_type").alias("k")).distinct()
    x = xs(t, ("animal_id", "cell_type"), "cell_type")
    return x, kinds


@query("m11_null_of_the_maximum")
def _(t):
    x, kinds = by_type(t)
    k = kinds.agg(F.collect_list("k")).scalar()   # the types of a study
    u = perm_units(t, 200).withColumn("fset", F.explode(k)).withColumn("task", F.col("fset"))
    preds, _c = M.leave_out_regression(x, u, NULL)
    return M.max_null(M.fold_scores(preds, u, True))


def sweep_units(t, kinds, fold="animal_id"):
    k = kinds.agg(F.collect_list("k")).scalar()
    return us(t, fold=fold).withColumn("fset", F.explode(k)).withColumn("task", F.col("fset"))


@query("m14_compartment_sweep")
def _(t):
    x, kinds = by_type(t)
    u = sweep_units(t, kinds)
    preds, _c = M.leave_out_regression(x, u, S)
    return M.fold_scores(preds, u, True).withColumnRenamed("task", "compartment").drop("target")


@query("m12_nested_selection")
def _(t):
    x, kinds = by_type(t)
    k = kinds.agg(F.collect_list("k")).scalar()
    ids = t.animals.agg(F.collect_list("animal_id")).scalar()
    # inner: within the training animals of each outer fold, five groups by hash
    inner = (t.animals.select("animal_id", "day", "score", F.explode(ids).alias("outer")).where("animal_id <> outer")
             .withColumn("k", F.explode(k)).withColumn("task", F.concat_ws("|", "outer", "k")))
    from cohortspark.functions.scalars import hash_u32
    inner = inner.withColumn("g", hash_u32("animal_id", "outer") % 5)
    u = M.unit_table(inner, "animal_id", "g", ["day"], ["score"], "task", "k")
    preds, _c = M.leave_out_regression(x, u, S)
    sc = M.fold_scores(preds, u, True).withColumn("outer", F.split("task", "\\|")[0].cast("bigint")).withColumn("k", F.split("task", "\\|")[1])
    pick = sc.groupBy("outer").agg(F.max_by("k", F.struct(F.coalesce("rho", F.lit(-2.0)), "k")).alias("chosen"), F.max("rho").alias("inner_rho"))
    outer = sweep_units(t, kinds)
    op, _c = M.leave_out_regression(x, outer, S)
    return (op.withColumnRenamed("task", "chosen").join(pick.withColumnRenamed("outer", "unit"), ["unit", "chosen"])
            .select(F.col("unit").alias("animal_id"), "chosen", "inner_rho", "pred", "observed"))


def gene_pool(t):
    """(gene_id, mean, detected): mean value over animals and the share of cells with a count."""
    v = pb(t)
    n = t.animals.agg(F.count(F.lit(1))).scalar()
    cells = t.cells.agg(F.count(F.lit(1))).scalar()
    seen = t.expr.groupBy("gene_id").agg((F.count_distinct("cell_id") / cells).alias("detected"))
    return v.groupBy("gene_id").agg((F.sum("value") / n).alias("mean")).join(seen, "gene_id")


@query("m13_gene_set_null")
def _(t):
    """500 sets drawn from all genes and 500 matched on expression and detection against one program, on the clock's own folds."""
    focus = t.genes.where(F.col("program") == "Brand#13")
    pool = gene_pool(t)
    out = None
    for arm in ("random", "matched"):
        sets = M.matched_sets(M.joint_bins(pool), focus, 500, matched=arm == "matched")
        preds = M.leave_out_sets(xs(t), us(t), sets.withColumnRenamed("gene_id", "feature"), S)
        u = us(t).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(500)))).withColumn("task", F.col("task").cast("string"))
        got = M.set_null(M.fold_scores(preds, u, True)).withColumn("arm", F.lit(arm))
        out = got if out is None else out.unionByName(got)
    return out


@query("m13_joint_sets", """
WITH m AS (SELECT gene_id, sum(value) / 25 AS mean FROM pb_dense GROUP BY 1 HAVING sum(value) > 0),
dt AS (SELECT gene_id, count(DISTINCT cell_id) AS c FROM expr GROUP BY 1),
e AS (SELECT quantile_cont(mean, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM m),
b AS (SELECT gene_id, program = 'Brand#13' AS f, len(list_filter(e.e, lambda v: v < mean)) * 5
        + ((row_number() OVER (ORDER BY c, gene_id) - 1) * 5) // count(*) OVER () AS bin FROM m JOIN dt USING (gene_id) JOIN genes USING (gene_id), e),
need AS (SELECT bin, count(*) AS need FROM b WHERE f GROUP BY 1),
have AS (SELECT bin, count(*) AS have FROM b WHERE NOT f GROUP BY 1),
short AS (SELECT sum(greatest(0, need - coalesce(have, 0))) AS short FROM need LEFT JOIN have USING (bin)),
d AS (SELECT s AS set_no, gene_id, bin, row_number() OVER (PARTITION BY s, bin ORDER BY md5(gene_id || '|' || s || '|0')) AS r FROM b, range(1, 6) t(s) WHERE NOT f),
c AS (SELECT set_no, gene_id FROM d JOIN need USING (bin) WHERE r <= need),
l AS (SELECT s AS set_no, gene_id, row_number() OVER (PARTITION BY s ORDER BY md5(gene_id || '|' || s || '|0')) AS r
      FROM b, range(1, 6) t(s) WHERE NOT f AND NOT EXISTS (SELECT 1 FROM c WHERE c.set_no = s AND c.gene_id = b.gene_id))
SELECT 0::bigint AS set_no, gene_id FROM b WHERE f UNION ALL SELECT set_no, gene_id FROM c
UNION ALL SELECT set_no, gene_id FROM l, short WHERE r <= short""")
def _(t):
    return M.matched_sets(M.joint_bins(gene_pool(t)), t.genes.where(F.col("program") == "Brand#13"), 5)


@query("m13_matched_sets", """
WITH m AS (SELECT gene_id, sum(value) / 25 AS mean FROM pb_dense GROUP BY 1),
e AS (SELECT quantile_cont(mean, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM m),
b AS (SELECT gene_id, program = 'Brand#13' AS f, len(list_filter(e.e, lambda v: v < mean)) AS bin FROM m JOIN genes USING (gene_id), e),
d AS (SELECT s AS set_no, gene_id, bin, row_number() OVER (PARTITION BY s, bin ORDER BY md5(gene_id || '|' || s || '|0')) AS r FROM b, range(1, 6) t(s) WHERE NOT f)
SELECT 0::bigint AS set_no, gene_id FROM b WHERE f UNION ALL SELECT set_no, gene_id FROM d JOIN (SELECT bin, count(*) AS need FROM b WHERE f GROUP BY 1) k USING (bin) WHERE r <= need""")
def _(t):
    n = t.animals.agg(F.count(F.lit(1))).scalar()
    means = pb(t).groupBy("gene_id").agg((F.sum("value") / n).alias("mean"))
    return M.matched_sets(means, t.genes.where(F.col("program") == "Brand#13"), 5)


@query("m15_block_conditions")
def _(t):
    v = pb(t).join(t.genes.select("gene_id", "module"), "gene_id")
    cond = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("module") != "ECONOMY", F.lit("without_economy")),
                                             F.when(F.col("module") == "ECONOMY", F.lit("only_economy")))))
    x = M.feature_rows(v.withColumn("condition", cond), "animal_id", "gene_id", "value", "condition")
    u = us(t).withColumn("fset", F.explode(F.array(F.lit("all"), F.lit("without_economy"), F.lit("only_economy")))).withColumn("task", F.col("fset"))
    preds, _c = M.leave_out_regression(x, u, S)
    return M.fold_scores(preds, u, True).withColumnRenamed("task", "condition").drop("target")


@query("m16_baseline_ladder")
def _(t):
    """Arms (severity only, composition, pseudobulk) on the same folds with intervals and Fisher z between arms."""
    sev = t.animals.select("animal_id", F.lit("score").alias("gene_id"), F.col("score").alias("value"), F.lit("severity").alias("arm"))
    comp = C.composition(t.cells, ["animal_id"], "cell_type").select("animal_id", F.col("cell_type").alias("gene_id"), F.col("fraction").alias("value"), F.lit("composition").alias("arm"))
    full = pb(t).select("animal_id", F.col("gene_id").cast("string"), "value", F.lit("pseudobulk").alias("arm"))
    x = M.feature_rows(sev.unionByName(comp).unionByName(full), "animal_id", "gene_id", "value", "arm")
    u = us(t, cov=()).withColumn("fset", F.explode(F.array(*[F.lit(a) for a in ("severity", "composition", "pseudobulk")]))).withColumn("task", F.col("fset"))
    preds, _c = M.leave_out_regression(x, u, S)
    sc = M.fold_scores(preds, u, False)
    ci = R.bootstrap_ci(preds.select("task", "unit", "pred", "observed"), "unit", R.rank_corr("pred", "observed"), 100, ["task"]).drop("observed")
    # Fisher z of every arm against the composition arm, on the same number of animals
    base = sc.where("task = 'composition'").select(F.col("rho").alias("_r0"), F.col("n").alias("_n0"))
    from cohortspark.functions.scalars import fisher_z
    z = (fisher_z("rho", 0.999) - fisher_z("_r0", 0.999)) / F.sqrt(1 / (F.col("n") - 3) + 1 / (F.col("_n0") - 3))
    out = sc.join(ci, "task").join(F.broadcast(base)).withColumn("z_vs_composition", z)
    return out.drop("target", "_r0", "_n0").withColumnRenamed("task", "arm")


@query("m17_learning_curve")
def _(t):
    d = M.learning_curve_units(t.animals.select("animal_id", "day", "score"), "animal_id", [0.4, 0.7, 1.0], 3)
    u = M.unit_table(d, "animal_id", "fold", ["day"], ["score"], "task")
    preds, _c = M.leave_out_regression(xs(t), u, S)
    part = F.split("task", "\\|")
    p = preds.withColumn("fraction", part[0].cast("double")).withColumn("draw", part[1].cast("int"))
    from cohortspark.operators.association import grouped_spearman
    each = grouped_spearman(p, "pred", "observed", ["fraction", "draw"])
    return each.groupBy("fraction").agg(F.count("rho").alias("n_draws"), F.avg("rho").alias("rho_mean"), F.stddev_samp("rho").alias("rho_sd"),
                                        F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"))


REGIONS = 5                            # bags of an animal: its sections pooled by region


def batch_bags(t):
    """Bags (animal, region) with the codes of two labels, and their non-zero rows."""
    v = C.pseudobulk(t.expr, ["animal_id", "region"]).withColumn("bag", F.concat_ws(":", "animal_id", "region"))
    b = t.sections.select("animal_id", "region").distinct().join(t.animals.select("animal_id", "run_id", "model"), "animal_id")
    runs = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    run = F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run_id")).cast("int") - 1
    b = b.select(F.concat_ws(":", "animal_id", "region").alias("bag"), "animal_id", "region", "model", run.alias("run_code"), (F.col("model") == "RR").cast("int").alias("model_code"))
    return v, b


def batch_units(t, bags, reps, classes=5):
    """Strata x labels as tasks: observed codes and ``reps`` exchanges of whole animals, folds by animal."""
    from cohortspark.functions.scalars import hash_u32
    from cohortspark.operators import classify as K
    strata = [("all", F.lit(True), ("run_code", "model_code")), ("RR", F.col("model") == "RR", ("run_code",)), ("MONO", F.col("model") == "MONO", ("run_code",)),
              ("building", F.col("region") == "BUILDING", ("model_code",))]
    out = None
    for name, which, labels in strata:
        own = bags.where(which)
        for label in labels:
            code = F.array(F.col(label))
            d = own.withColumn("code", code)
            if reps:
                null = R.block_permuted_labels(own, "animal_id", "bag", label, reps).groupBy("bag").agg(
                    F.transform(F.array_sort(F.collect_list(F.struct("rep", label))), lambda e: e[label]).alias("_null"))
                d = own.join(null, "bag").withColumn("code", F.concat(code, "_null"))
            d = K.class_targets(d, classes).select(F.lit(f"{name}|{label}").alias("task"), F.lit("all").alias("fset"), F.col("bag").alias("unit"),
                                                   (hash_u32("animal_id", F.lit("fold")) % 5).cast("string").alias("fold"), "y", F.array().cast("array<double>").alias("c"))
            out = d if out is None else out.unionByName(d)
    return out


@query("m18_batch_classification")
def _(t):
    """Which run or model a bag comes from, by stratum, held out by animal: balanced accuracy of the logistic arm against 200 exchanges
    of whole animals."""
    from cohortspark.operators import classify as K
    v, bags = batch_bags(t)
    units = batch_units(t, bags, 200)
    p = M.leave_out_classification(M.feature_rows(v, "bag", "gene_id", "value"), units, 10, S, strength=0.1)
    sc = K.balanced_accuracy(p, 5)
    first = sc.where("rep = 0").select("task", "n", "classes")
    part = F.split("task", "\\|")
    return K.draw_null(sc, "balanced_accuracy").join(first, "task").withColumn("stratum", part[0]).withColumn("label", part[1]).drop("task")


@query("m18_batch_trees")
def _(t):
    """Tree arm of the same strata and folds: boosted trees on the components, observed labels."""
    from cohortspark.operators import classify as K
    v, bags = batch_bags(t)
    scores = M.component_scores(M.feature_rows(v, "bag", "gene_id", "value"), batch_units(t, bags, 0), 10, S)
    part = F.split("task", "\\|")
    return K.balanced_accuracy(K.boosted_trees(scores, 5), 5).withColumn("stratum", part[0]).withColumn("label", part[1]).drop("task", "rep")


@query("m18_exchanged_labels", """
WITH b AS (SELECT DISTINCT animal_id, region FROM sections),
l AS (SELECT animal_id || ':' || region AS bag, animal_id, run_id FROM b JOIN animals USING (animal_id)),
z AS (SELECT animal_id AS u, count(*) AS size FROM l GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY u) AS idx FROM z),
d AS (SELECT size, rep, u, row_number() OVER (PARTITION BY size, rep ORDER BY md5(u || '|' || rep || '|0'), u) AS idx FROM i, range(0, 200) r(rep)),
m AS (SELECT d.rep, d.u, i.u AS src FROM d JOIN i ON i.size = d.size AND i.idx = d.idx),
j AS (SELECT animal_id, bag, run_id, row_number() OVER (PARTITION BY animal_id ORDER BY bag) AS j FROM l)
SELECT m.rep, a.animal_id, a.bag, x.run_id FROM m JOIN j a ON a.animal_id = m.u JOIN j x ON x.animal_id = m.src AND x.j = a.j""")
def _(t):
    """The label design of the null: whole animals change places inside a class of equally many bags."""
    b = t.sections.select("animal_id", "region").distinct().join(t.animals.select("animal_id", "run_id"), "animal_id")
    b = b.select("animal_id", F.concat_ws(":", "animal_id", "region").alias("bag"), "run_id")
    return R.block_permuted_labels(b, "animal_id", "bag", "run_id", 200)


@query("m21_cell_components")
def _(t):
    """Components of cells fitted on training sections, applied to all; centred first since Spark's PCA does not."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    w = t.space_expr.groupBy("section_id", "cell_id").pivot("gene_id", list(range(8, 64))).agg(F.sum("cnt"))
    w = w.toDF("section_id", "cell_id", *[f"g{i}" for i in range(56)])
    w = t.space.select("section_id", "cell_id").join(w, ["section_id", "cell_id"], "left").na.fill(0)   # cells without a marker are zeros
    d = VectorAssembler(inputCols=[f"g{i}" for i in range(56)], outputCol="raw").transform(w)
    from cohortspark.functions.ordering import split_units
    d = d.join(split_units(t.space, "section_id", 0.3), "section_id")
    train = d.where("split = 'train'")
    sc = StandardScaler(inputCol="raw", outputCol="v", withMean=True, withStd=False).fit(train)
    m = PCA(k=3, inputCol="v", outputCol="pc").fit(sc.transform(train))
    from pyspark.ml.functions import vector_to_array
    out = m.transform(sc.transform(d)).withColumn("a", vector_to_array("pc"))
    # the sign of a component is arbitrary
    return out.select("section_id", "cell_id", *[F.abs(F.col("a")[i]).alias(f"pc{i + 1}_abs") for i in range(3)])


def aligned(t):
    c = V.build_curve(t.curves, t.curve_ends)
    return V.align_at_onset(c, V.onset(c))


@query("m22_functional_components")
def _(t):
    return M.functional_components(aligned(t)).drop("mu", "noise")


@query("m22_functional_summary")
def _(t):
    """Per component: share, clipped mass of the surface, mass on days with little support, chosen or not, noise."""
    return M.functional_summary(M.functional_components(aligned(t)))


@query("m22_functional_scores")
def _(t):
    a = aligned(t)
    return M.functional_scores(a, M.functional_components(a))


@query("m22_correspondence")
def _(t):
    """Rank correlation of each component's scores with known curve features: length, mean score, peak."""
    from cohortspark.operators.association import grouped_spearman
    a = aligned(t)
    known = a.groupBy("animal_id").agg(F.max("t").alias("length"), F.avg("score").alias("mean_score"), F.max("score").alias("peak"))
    long = known.select("animal_id", F.expr("stack(3, 'length', cast(length as double), 'mean_score', mean_score, 'peak', peak) as (known, v)"))
    return grouped_spearman(M.functional_scores(a, M.functional_components(a)).join(long, "animal_id"), "score", "v", ["component", "known"])


@query("m23_covariate_variants")
def _(t):
    """The clock without adjustment, adjusted for the terminal score, and for a cumulative burden."""
    out, x = None, cut(xs(t))   # the rows are the same in all variants
    for name, cov in (("none", ()), ("terminal", ("score",)), ("cumulative", ("score", "n_cells"))):
        u = us(t, cov=cov)
        preds, _c = M.leave_out_regression(x, u, S)
        s = M.fold_scores(preds, u, bool(cov)).withColumn("variant", F.lit(name)).drop("task", "target")
        out = s if out is None else out.unionByName(s)
    return out


@query("m24_transfer_scores", f"""
WITH {SEC_PB}, h AS (SELECT section_id, beta * value / sd AS part FROM v JOIN frozen USING (gene_id)),
p AS (SELECT section_id, round(coalesce(sum(part), 0), 9) AS pred FROM sections LEFT JOIN h USING (section_id) GROUP BY 1),
r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY pred) + (count(*) OVER (PARTITION BY region, pred) - 1) / 2.0::double AS x,
      rank() OVER (PARTITION BY region ORDER BY n_cells) + (count(*) OVER (PARTITION BY region, n_cells) - 1) / 2.0::double AS y FROM p JOIN sections USING (section_id))
SELECT region, count(*) AS n, corr(x, y) AS rho FROM r GROUP BY 1""", "rho")
def _(t):
    from cohortspark.operators.association import grouped_spearman
    p = M.score_frozen(C.pseudobulk(t.expr, ["section_id"]), frozen(t), t.sections, ["section_id"])
    # equal scores of sections without a hit must stay equal whatever the order of the sums
    p = p.withColumn("pred", F.round("pred", 9))
    return grouped_spearman(p.join(t.sections, "section_id"), "pred", "n_cells", ["region"])


@query("m25_coefficient_check")
def _(t):
    kept = t.genes.where(F.col("program") == "Brand#13").select(F.col("gene_id").alias("feature"))
    _p, coefs = M.leave_out_regression(xs(t), us(t), S, keep=kept)
    c = coefs.join(kept.select(F.col("feature").cast("string"), F.lit(1).alias("k")), "feature", "left")
    g = c.groupBy("fold").agg(F.count(F.lit(1)).alias("n_nonzero"), F.count("k").alias("n_kept_nonzero"),
                              (F.sum(F.when(F.col("k") == 1, F.abs("coef")).otherwise(0.0)) / F.sum(F.abs("coef"))).alias("kept_mass"))
    # a fold that chose no feature has its row too
    folds = t.animals.select(F.col("animal_id").cast("string").alias("fold"))
    return folds.join(g, "fold", "left").na.fill(0, ["n_nonzero", "n_kept_nonzero"])
