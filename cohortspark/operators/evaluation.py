"""Prediction tables: metrics, pooling, ensembles, set overlaps, source merging (A20-A23, A26-A31, A34, A35, U, S)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.ordering import large_midrank, ordinal, top_k
from cohortspark.functions.scalars import c, ratio, softmax


def confusion(df: DataFrame, part: Sequence[str], true: str, pred: str) -> DataFrame:
    return df.groupBy(*part, true, pred).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, part: Sequence[str], true: str, pred: str) -> DataFrame:
    """Accuracy, balanced accuracy and mean absolute error of integer ranks (A20), from the confusion table."""
    m = confusion(df, part, true, pred)
    per = m.groupBy(*part, true).agg(F.sum("n").alias("_n"),
                                     F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("_hit"),
                                     F.sum(F.abs(F.col(true) - F.col(pred)) * F.col("n")).alias("_err"))
    return per.groupBy(*part).agg(F.sum("_n").alias("n"), ratio(F.sum("_hit"), F.sum("_n")).alias("accuracy"),
                                  F.avg(F.col("_hit") / F.col("_n")).alias("balanced_accuracy"),
                                  ratio(F.sum("_err"), F.sum("_n")).alias("mae"))


def auc(df: DataFrame, part: Sequence[str], positive, score: str) -> DataFrame:
    """AUC by rank sum (A21). Ranks come from merged score values, so a group may be of any size."""
    d = large_midrank(df.withColumn("_pos", c(positive).cast("int")), score, part, "_r")
    g = d.groupBy(*part).agg(F.sum("_pos").alias("n_pos"), (F.count(F.lit(1)) - F.sum("_pos")).alias("n_neg"),
                             F.sum(F.col("_pos") * F.col("_r")).alias("_s"))
    u = F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return g.select(*part, "n_pos", "n_neg", ratio(u, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def eta_squared(df: DataFrame, factor: str, x: str) -> DataFrame:
    """Share of variance between the levels of a factor (A22), from one grouped aggregate."""
    g = df.groupBy(factor).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))
    t = g.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_m")).alias("_s"),
              F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_q"), F.sum(F.col("_n") * F.col("_v")).alias("_w"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    return t.select("n", ratio(between, between + F.col("_w")).alias("eta2"))


def block_mass(coefs: DataFrame, blocks: DataFrame, gene: str, coef: str, block: str) -> DataFrame:
    """Share of absolute coefficient mass per block, its size, and the rank of its first gene."""
    r = ordinal(coefs.where(F.col(coef) != 0).withColumn("_size", -F.abs(F.col(coef))), "_size", gene, out="_rank")
    total = r.agg(F.sum(F.abs(F.col(coef)))).scalar()
    return (r.join(blocks.select(gene, block), gene).groupBy(block)
            .agg(F.count(F.lit(1)).alias("n_genes"), (F.sum(F.abs(F.col(coef))) / total).alias("mass"),
                 F.min("_rank").alias("first_rank")))


def coefficient_overlap(a: DataFrame, b: DataFrame, gene: str, coef: str) -> DataFrame:
    """Shared non-zero genes and how many keep their sign."""
    j = a.where(F.col(coef) != 0).select(gene, F.col(coef).alias("_a")) \
        .join(b.where(F.col(coef) != 0).select(gene, F.col(coef).alias("_b")), gene)
    return j.agg(F.count(F.lit(1)).alias("n_overlap"),
                 F.count_if(F.signum("_a") == F.signum("_b")).alias("n_same_sign"))


def state_shares(cells: DataFrame, unit: str, state: str, compartment: Sequence[str], units: DataFrame, stage: str
                 ) -> DataFrame:
    """Share of each state of a compartment and of all cells, averaged over units by stage."""
    n = cells.groupBy(unit, state).agg(F.count(F.lit(1)).alias("_n"))
    inside = F.col(state).isin(list(compartment))
    w = Window.partitionBy(unit)
    n = (n.withColumn("_all", F.sum("_n").over(w))
         .withColumn("_comp", F.sum(F.when(inside, F.col("_n")).otherwise(0)).over(w)).where(inside))
    per = n.join(units.select(unit, stage), unit)
    size = units.groupBy(stage).agg(F.count(F.lit(1)).alias("_units"))
    has = (cells.where(inside).select(unit).distinct().join(units.select(unit, stage), unit)
           .groupBy(stage).agg(F.count(F.lit(1)).alias("_with")))
    return (per.groupBy(stage, state).agg(F.sum(F.col("_n") / F.col("_comp")).alias("_c"),
                                          F.sum(F.col("_n") / F.col("_all")).alias("_a"))
            .join(size, stage).join(has, stage)
            .select(stage, state, ratio("_c", "_with").alias("of_compartment"), ratio("_a", "_units").alias("of_all")))


def marker_specificity(means: DataFrame, cluster: str, gene: str, value: str, n_clusters, k: int = 30) -> DataFrame:
    """Cluster mean minus the mean over clusters, top ``k`` per cluster (A27); absent pairs are zeros."""
    m = means.withColumn("specificity",
                         F.col(value) - F.sum(value).over(Window.partitionBy(gene)) / n_clusters)
    return top_k(m.select(cluster, gene, "specificity"), [F.col("specificity").desc(), F.col(gene)], k, [cluster])


def top_cluster_markers(means: DataFrame, cluster: str, gene: str, value: str, n_clusters) -> DataFrame:
    """Per gene: its top cluster, the mean there and the mean over the rest (A28); absent pairs are zeros."""
    g = means.groupBy(gene).agg(F.max_by(cluster, F.struct(F.col(value), F.col(cluster))).alias("top_cluster"),
                                F.max(value).alias("top_mean"), F.sum(value).alias("_s"))
    return g.select(gene, "top_cluster", "top_mean",
                    ratio(F.col("_s") - F.col("top_mean"), n_clusters - 1).alias("rest_mean"))


def attention_enrichment(cells: DataFrame, bag: str, cluster: str, label: str, weight: str) -> DataFrame:
    """Attention mass and plain composition per cluster and class, averaged over bags."""
    per = cells.groupBy(bag, label, cluster).agg(F.sum(weight).alias("_a"), F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_f", F.col("_n") / F.sum("_n").over(Window.partitionBy(bag)))
    bags = cells.groupBy(label).agg(F.count_distinct(bag).alias("_bags"))
    return (per.groupBy(label, cluster).agg(F.sum("_a").alias("_a"), F.sum("_f").alias("_f")).join(bags, label)
            .select(label, cluster, (F.col("_a") / F.col("_bags")).alias("attention"),
                    (F.col("_f") / F.col("_bags")).alias("composition")))


def attention_weights(cells: DataFrame, bag: str, score: str, out: str = "weight") -> DataFrame:
    """Softmax over a bag as two combining aggregates and a join: a huge bag is never sorted into one task."""
    top = cells.groupBy(bag).agg(F.max(score).alias("_m"))
    e = cells.join(top, bag).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    tot = (cells.join(top, bag).groupBy(bag).agg(F.sum(F.exp(F.col(score) - F.col("_m"))).alias("_t")))
    return e.join(tot, bag).withColumn(out, F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def pool_bags(cells: DataFrame, bag: str, score: str, features: Sequence[str]) -> DataFrame:
    """Softmax-weighted and plain mean of features per bag (A31), from combining sums only."""
    top = cells.groupBy(bag).agg(F.max(score).alias("_m"))
    e = F.exp(F.col(score) - F.col("_m"))
    aggs = [F.count(F.lit(1)).alias("n_cells")]
    for f in features:
        aggs += [(F.sum(e * F.col(f)) / F.sum(e)).alias(f"{f}_attn"), F.avg(f).alias(f"{f}_mean")]
    return cells.join(top, bag).groupBy(bag).agg(*aggs)


def training_weights(sections: DataFrame, unit: str, y: str, split: str, train: str = "train") -> DataFrame:
    """Row weight 1 / sections of the unit, target standardised on training rows only."""
    n = F.count(F.lit(1)).over(Window.partitionBy(unit))
    stats = sections.where(F.col(split) == train).agg(F.struct(F.avg(y).alias("m"), F.stddev_pop(y).alias("s"))).scalar()
    return (sections.withColumn("_t", stats).withColumn("sample_weight", F.lit(1.0) / n)
            .withColumn("y_std", ratio(F.col(y) - F.col("_t.m"), F.col("_t.s"))).drop("_t"))


def ensemble(preds: DataFrame, unit: str, seed: str, pred: str, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """Section predictions to unit mean per seed, then mean over seeds, rescaled."""
    per = preds.groupBy(unit, seed).agg(F.avg(pred).alias("_p"))
    return per.groupBy(unit).agg((F.avg("_p") * sd + mean).alias("pred"), F.count(F.lit(1)).alias("n_seeds"))


def merge_seed_lists(rows: DataFrame, keys: Sequence[str], seeds: str) -> DataFrame:
    """Per-seed prediction lists ``a;b;c`` from several files merged to mean and count."""
    x = rows.select(*keys, F.explode(F.split(seeds, ";")).alias("_p")).where(F.trim("_p") != "")
    return x.groupBy(*keys).agg(F.avg(F.col("_p").cast("double")).alias("pred"), F.count(F.lit(1)).alias("n_seeds"))


def check_against(recomputed: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Recomputed value against a stored one within a tolerance (S14); missing on either side fails."""
    j = recomputed.select(*keys, F.col(value).alias("got")).join(
        stored.select(*keys, F.col(value).alias("expected")), list(keys), "full_outer")
    return j.withColumn("ok", F.coalesce(F.abs(F.col("got") - F.col("expected")) <= tol, F.lit(False)))


def side_by_side(default: DataFrame, variant: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same metric from two runs next to each other."""
    return (default.select(*keys, F.col(value).alias("default_value"))
            .join(variant.select(*keys, F.col(value).alias("variant_value")), list(keys))
            .withColumn("change", F.col("variant_value") - F.col("default_value")))


def align_predictions(arms: DataFrame, unit: str, arm: str, pred: str, cohort: DataFrame) -> DataFrame:
    """Predictions of arms that cover the whole cohort, on identical units."""
    n = cohort.agg(F.count(F.lit(1))).scalar()
    j = arms.join(cohort.select(unit), unit)
    full = j.groupBy(arm).agg(F.count_distinct(unit).alias("_k")).where(F.col("_k") == n).select(arm)
    return j.join(full, arm, "left_semi").select(arm, unit, pred)


# ------------------------------------------------------------------ sets of genes

def set_partition(members: DataFrame, item: str, name: str, order: Sequence[str]) -> DataFrame:
    """Exclusive intersections of k sets (U5): membership bitmap per item, counted."""
    bit = F.element_at(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(1 << i))]), F.col(name))
    m = members.where(F.col(name).isin(list(order))).groupBy(item).agg(F.bit_or(bit).alias("bitmap"))
    return m.groupBy("bitmap").agg(F.count(F.lit(1)).alias("n"))


def set_overlaps(members: DataFrame, item: str, name: str) -> DataFrame:
    """Pairwise intersection and Jaccard (U2, U5). An item lists its sets once and emits its set pairs."""
    m = members.select(item, name).distinct()
    size = m.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    a, b = m.withColumnRenamed(name, "set_a"), m.withColumnRenamed(name, "set_b")
    both = a.join(b, item).where("set_a < set_b").groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("n_both"))
    return (both.join(size.select(F.col(name).alias("set_a"), F.col("_n").alias("_na")), "set_a")
            .join(size.select(F.col(name).alias("set_b"), F.col("_n").alias("_nb")), "set_b")
            .select("set_a", "set_b", "n_both", ratio("n_both", F.col("_na") + F.col("_nb") - F.col("n_both"))
                    .alias("jaccard")))


def set_algebra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Where each key occurs: both, only the first, only the second."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(
        b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return j.select(key, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both")
                    .when(F.col("_a").isNotNull(), "only_first").otherwise("only_second").alias("membership"))


def ordered_union(lists: DataFrame, item: str, list_no: str, pos: str) -> DataFrame:
    """De-duplicated union of lists in order of first appearance (U4)."""
    return lists.groupBy(item).agg(F.min(F.struct(list_no, pos)).alias("_f")).select(item, "_f.*")


def stack_cohorts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of cohorts with the same columns asserted."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError(f"cohorts differ: {a.dtypes} vs {b.dtypes}")
    return a.unionByName(b)


def wiring(scores: DataFrame, adjacency: DataFrame, q: float = 0.05, z: float = 2.0) -> DataFrame:
    """Significant ligand-receptor rows on adjacent cluster pairs, sender not receiver."""
    adj = adjacency.where(F.col("z") >= z).select("sender", "receiver", F.col("z").alias("adjacency_z"))
    return scores.where((F.col("q") <= q) & (F.col("sender") != F.col("receiver"))).join(adj, ["sender", "receiver"])


def softmax_by(df: DataFrame, x: str, part: Sequence[str], out: str) -> DataFrame:
    """Softmax inside small groups (class probabilities of one row)."""
    return df.withColumn(out, softmax(x, part))


def region_baseline(rows: DataFrame, fold: str, region: str, label: str, prior: float = 1.0) -> DataFrame:
    """Out-of-fold class rate per region (M19): leave-fold-out counts by subtraction, lightly smoothed."""
    g = rows.groupBy(fold, region).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(region)
    return g.select(fold, region, ((F.sum("_s").over(w) - F.col("_s") + prior)
                                   / (F.sum("_n").over(w) - F.col("_n") + 2 * prior)).alias("prob"))
