"""Aggregates over sparse counts.

``expr`` is long and sparse: an absent (cell, gene) row is a zero. Sums need no zeros; everything that does (means,
detection rates, ranks, standard scores) takes its denominator or its zero part from the table of cells or units, so
no keys x genes grid is ever built for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.ordering import exact_quantiles, ordered_counts, ordinal, top_k
from cohortspark.functions.scalars import c, hash_key, log_cp10k, ratio
from cohortspark.session import cut


def count_sums(expr: DataFrame, keys: Sequence[str], gene: str = "gene_id", count: str = "cnt") -> DataFrame:
    """Summed counts per key and gene; combined map-side, so the shuffle carries keys x genes, not cells x genes."""
    return expr.groupBy(*keys, gene).agg(F.sum(count).alias("n"))


def normalise(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Library size of each key over the full panel, then log1p CP10k."""
    lib = F.sum("n").over(Window.partitionBy(*keys))
    return sums.withColumn("lib", lib).withColumn("value", log_cp10k("n", "lib"))


def pseudobulk(expr: DataFrame, keys: Sequence[str], gene: str = "gene_id", count: str = "cnt") -> DataFrame:
    """log1p CP10k of summed counts (A1, A2, G13). Non-zero rows only; zeros stay implicit."""
    return normalise(count_sums(expr, keys, gene, count), keys)


def roll_up(sums: DataFrame, keys: Sequence[str], gene: str = "gene_id") -> DataFrame:
    """Coarser pseudobulk from finer sums (section level to animal level) without a second scan of the counts."""
    return normalise(sums.groupBy(*keys, gene).agg(F.sum("n").alias("n")), keys)


def panel_vectors(pb: DataFrame, panel: DataFrame, keys: Sequence[str], size: int, gene: str = "gene_id",
                  value: str = "value", text: Callable[[Column], Column] | None = None) -> DataFrame:
    """Align to a fixed panel (P3): one dense array per key in panel order, absent genes 0, extra genes dropped.

    ``panel`` holds (gene, pos) with pos 0..size-1; a key none of whose genes is in the panel gets no row. With ``text``, the text of
    an entry, the vector is a list of all its entries divided by commas, in which the zeros between two present genes are written as
    one run; ``n_present`` counts the entries above 0.
    """
    hit = pb.join(panel, gene)
    m = F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), F.col(value))))
    found = hit.groupBy(*keys).agg(m.alias("_m"))
    if text is None:
        return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                                               lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector"))
    seen = F.filter(F.map_entries("_m"), lambda e: e["value"].isNotNull() & e["key"].between(0, size - 1))
    zero = text(F.lit(0.0))
    zeros = lambda n: F.repeat(F.concat(zero, F.lit(",")), n)
    place = lambda i: F.coalesce(F.get("_e", i)["key"], F.lit(-1))
    parts = F.transform("_e", lambda e, i: F.concat(zeros(e["key"] - place(i - 1) - 1), text(e["value"])))
    rest = F.lit(size - 1) - place(F.size("_e") - 1)
    tail = F.when(rest > 0, F.array(F.concat(zeros(rest - 1), zero))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("_e", F.array_sort(seen)).select(
        *keys, F.size(F.filter("_e", lambda e: e["value"] > 0)).alias("n_present"), F.array_join(F.concat(parts, tail), ",").alias("vector"))


def missing_genes(panel: DataFrame, present: DataFrame, gene: str = "gene_id") -> DataFrame:
    return panel.join(present.select(gene).distinct(), gene, "left_anti")


def missing_per_key(panel: DataFrame, counts: DataFrame, keys: Sequence[str], gene: str = "gene_id") -> DataFrame:
    """How many panel genes each key has no count of (P3); keys without any of them lack the whole panel."""
    size = panel.select(gene).distinct().agg(F.count(F.lit(1))).scalar()
    hit = counts.join(panel.select(gene).distinct().withColumn("_in", F.lit(1)), gene, "left")
    return hit.groupBy(*keys).agg((size - F.count_distinct(F.when(F.col("_in") == 1, F.col(gene)))).alias("n_missing"))


def composition(cells: DataFrame, keys: Sequence[str], category: str | Sequence[str]) -> DataFrame:
    """Cells and fraction per category inside each key (A3)."""
    cats = [category] if isinstance(category, str) else list(category)
    n = cells.groupBy(*keys, *cats).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", ratio("n", F.sum("n").over(Window.partitionBy(*keys))))


def crosstab(df: DataFrame, row: str | Sequence[str], column: str, levels: Sequence[str]) -> DataFrame:
    """Counts by row and column level, absent pairs 0 (A4). Levels are passed, so no extra job finds them."""
    rows = [row] if isinstance(row, str) else list(row)
    return df.groupBy(*rows).pivot(column, list(levels)).agg(F.count(F.lit(1))).na.fill(0)


def detection(counts: DataFrame, cells: DataFrame, group: Sequence[str] = (), gene: str = "gene_id",
              cell: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Share of cells with at least one count and mean count per gene (A5); denominators come from ``cells``.

    ``counts`` has one row per non-zero (cell, gene) and carries the group columns.
    """
    hit = counts.groupBy(*group, gene).agg(F.count(F.lit(1)).alias("n_pos"), F.sum("cnt").alias("total"))
    if group:
        n = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("n_cells"))
        hit = hit.join(n, list(group))
    else:
        hit = hit.withColumn("n_cells", cells.agg(F.count(F.lit(1))).scalar())
    return hit.select(*group, gene, "n_pos", "n_cells", ratio("n_pos", "n_cells").alias("detected"),
                      ratio("total", "n_cells").alias("mean_count"))


def cell_library(expr: DataFrame, cell: Sequence[str]) -> Column:
    return F.sum("cnt").over(Window.partitionBy(*cell))


def mean_log_expression(expr: DataFrame, cells: DataFrame, keys: Sequence[str], cell: Sequence[str],
                        gene: str = "gene_id") -> DataFrame:
    """Mean over cells of per-cell log1p CP10k (A6); cells without the gene count as 0."""
    per_cell = (expr.withColumn("_lib", cell_library(expr, cell))
                .withColumn("_v", log_cp10k("cnt", "_lib")))
    n = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
    return (per_cell.groupBy(*keys, gene).agg(F.sum("_v").alias("sum_log"))
            .join(n, list(keys)).withColumn("mean_log", ratio("sum_log", "n_cells")))


def marker_positive(expr: DataFrame, cells: DataFrame, markers: DataFrame, cell: Sequence[str], at_least: int,
                    gene: str = "gene_id") -> DataFrame:
    """Cells with counts in at least ``at_least`` distinct marker genes."""
    hits = (expr.join(markers.select(gene).distinct(), gene, "left_semi")
            .groupBy(*cell).agg(F.count_distinct(gene).alias("n_markers")))
    return (cells.join(hits, list(cell), "left")
            .withColumn("positive", F.coalesce(F.col("n_markers"), F.lit(0)) >= at_least).drop("n_markers"))


def positive_fraction(flagged: DataFrame, keys: Sequence[str], threshold: float, above: str, below: str,
                      flag: str = "positive") -> DataFrame:
    """Share of flagged cells per key and the call made from it."""
    g = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"),
                                   F.avg(F.col(flag).cast("double")).alias("frac_pos"))
    return g.withColumn("call", F.when(F.col("frac_pos") >= threshold, above).otherwise(below))


def weighted_mean(df: DataFrame, keys: Sequence[str], value, weight, out: str = "wmean") -> DataFrame:
    """sum(w x) / sum(w)."""
    return df.groupBy(*keys).agg(ratio(F.sum(c(value) * c(weight)), F.sum(c(weight))).alias(out))


def collapse(values: DataFrame, weights: DataFrame, keys: Sequence[str], parts: Sequence[str], value: str, weight: str,
             gene: str = "gene_id", out: str = "wmean") -> DataFrame:
    """Weighted mean over the parts of a key (A8): types collapsed into compartments by their cells.

    ``values`` has the non-zero rows (keys, parts, gene); ``weights`` every part of every key. The divisor is the whole
    weight of the key, so a part without the gene counts as 0.
    """
    total = weights.groupBy(*keys).agg(F.sum(weight).alias("_all"))
    got = values.join(weights.select(*keys, *parts, weight), [*keys, *parts])
    return (got.groupBy(*keys, gene).agg(F.sum(c(value) * c(weight)).alias("_s")).join(total, list(keys))
            .select(*keys, gene, ratio("_s", "_all").alias(out)))


def spread(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, sample sd, min, max, quartiles, IQR, range (A10)."""
    q = exact_quantiles(df, x, (0.25, 0.5, 0.75), ("q25", "median", "q75"), keys).drop("n")
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
                              F.min(x).alias("lo"), F.max(x).alias("hi"))
    return (g.join(q, list(keys), "left").withColumn("iqr", F.col("q75") - F.col("q25"))
            .withColumn("range", F.col("hi") - F.col("lo")))


def mixed_groups(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Keys holding more than one label."""
    return (df.groupBy(*keys).agg(F.count_distinct(label).alias("n_labels"), F.min(label).alias("first_label"),
                                  F.max(label).alias("last_label")).where("n_labels > 1"))


def modal(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Most frequent value, smallest on ties (A12); merged by value first, so no group is held as a list."""
    n = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.max("n").alias("n"))
    return n.join(best, [*keys, "n"]).groupBy(*keys).agg(F.min(x).alias("modal"), F.max("n").alias("n_modal"))


def constant_per_key(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The single value of each column per key with a flag that it really is single."""
    aggs = [F.min(x).alias(x) for x in cols]
    same = F.lit(True)
    for x in cols:
        same = same & F.coalesce(F.min(x) == F.max(x), F.lit(True))
    return df.groupBy(*keys).agg(*aggs, same.alias("is_constant"))


def program_scores(pb: DataFrame, units: DataFrame, programs: DataFrame, unit: str = "animal_id",
                   gene: str = "gene_id", ddof: int = 0) -> DataFrame:
    """Mean over a program's genes of the z-score across units (A14), computed without the zero rows.

    A zero contributes ``-mean/sd``; summing that constant over all genes of a program first leaves only
    ``sum(x / sd)`` over non-zero rows. Genes without spread are left out.
    """
    x = pb.join(units.select(unit), unit, "left_semi")
    sd_n = F.col("_n") - ddof
    var = (F.col("_sxx") - F.col("_sx") * F.col("_sx") / F.col("_n")) / sd_n
    mom = (x.groupBy(gene).agg(F.sum("value").alias("_sx"), F.sum(F.col("value") * F.col("value")).alias("_sxx"))
           .withColumn("_n", units.agg(F.count(F.lit(1))).scalar())
           .select(gene, (F.col("_sx") / F.col("_n")).alias("_mean"),
                   F.sqrt(F.greatest(var, F.lit(0.0))).alias("_sd"))
           .where("_sd > 1e-9"))
    member = programs.join(mom, gene)
    base = member.groupBy("program").agg(F.count(F.lit(1)).alias("n_genes"),
                                         F.sum(-F.col("_mean") / F.col("_sd")).alias("_base"))
    hits = (x.join(member, gene).groupBy("program", unit)
            .agg(F.sum(F.col("value") / F.col("_sd")).alias("_hit")))
    # the list of programs is short; it rides along as one array so that units without any hit get a row too
    listed = base.agg(F.collect_list(F.struct("program", "n_genes", "_base"))).scalar()
    grid = units.select(unit, F.explode(listed).alias("_p")).select(unit, "_p.*")
    return (grid.join(hits, ["program", unit], "left")
            .select("program", unit, "n_genes",
                    ((F.col("_base") + F.coalesce(F.col("_hit"), F.lit(0.0))) / F.col("n_genes")).alias("score")))


SPARE = 90.0      # pairs beyond the wanted ones that are expected below the cut of control_genes
DEALS = 16        # parts that the markers of a bin are dealt into


def control_genes(means: DataFrame, markers: DataFrame, n_bins: int = 25, per_marker: int = 50, seed: int = 0,
                  gene: str = "gene_id", value: str = "mean_log") -> DataFrame:
    """Expression-matched control genes (A15): for every marker up to ``per_marker`` non-marker genes of its bin.

    Bins are equal-width on the rank of the mean, right-closed. The draw is by hash order of (marker, gene). Every pair of a bin is hashed,
    but only those whose hash begins below a cut, a little over ``per_marker`` of them, are kept and ordered; markers that the
    cut leaves with too few are drawn again from all pairs.
    """
    n = means.agg(F.count(F.lit(1))).scalar()
    ranked = ordinal(means, value, gene, out="_r")
    width = (F.col("_n") - 1) / F.lit(float(n_bins))
    binned = cut(ranked.withColumn("_n", n)
                 .withColumn("bin", F.greatest(F.ceil((F.col("_r") - 1) / width) - 1, F.lit(0)).cast("int"))
                 .select(gene, "bin"))
    mk = binned.join(markers.select(gene).distinct(), gene).select(F.col(gene).alias("marker"), "bin")
    pool = binned.join(markers.select(gene).distinct(), gene, "left_anti")
    size = pool.groupBy("bin").agg(F.count(F.lit(1)).alias("_size"))
    share = F.least((per_marker + SPARE) / F.col("_size"), F.lit(1.0))
    mk = mk.join(size.select("bin", "_size", F.lpad(F.lower(F.hex(F.floor(share * F.lit(4294967295.0)))), 8, "0").alias("_cut")), "bin")
    mk = mk.withColumn("_deal", F.pmod(F.xxhash64("marker"), F.lit(DEALS)).cast("int"))
    dealt = pool.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    h = hash_key("marker", gene, F.lit(seed))

    def pick(m: DataFrame, below: bool) -> DataFrame:
        pairs = m.hint("merge").join(dealt, ["bin", "_deal"])
        pairs = pairs.where(F.substring(h, 1, 8) <= F.col("_cut")) if below else pairs
        return top_k(pairs.select("marker", gene, "bin"), [h, F.col(gene)], per_marker, ["marker"]).select("marker", gene, "bin")
    first = cut(pick(mk, True))
    enough = first.groupBy("marker").agg(F.count(F.lit(1)).alias("_k"))
    short = mk.join(enough, "marker", "left").where(F.coalesce("_k", F.lit(0)) < F.least(F.col("_size"), F.lit(per_marker))).drop("_k")
    return first.join(short.select("marker"), "marker", "left_anti").unionByName(pick(short, False)).select("marker", gene, "bin")


def marker_minus_control(values: DataFrame, markers: DataFrame, controls: DataFrame, keys: Sequence[str],
                         value: str = "mean_log", gene: str = "gene_id") -> DataFrame:
    """Mean over markers minus mean over the distinct control genes; absent rows are zeros."""
    mk = markers.select(gene).distinct().withColumn("_w", F.lit(1.0))
    ct = controls.select(gene).distinct().withColumn("_w", F.lit(0.0))
    members = mk.unionByName(ct)
    n_m = mk.agg(F.count(F.lit(1))).scalar()
    n_c = ct.agg(F.count(F.lit(1))).scalar()
    g = values.join(members, gene).groupBy(*keys).agg(
        F.sum(F.when(F.col("_w") == 1.0, F.col(value)).otherwise(0.0)).alias("_m"),
        F.sum(F.when(F.col("_w") == 0.0, F.col(value)).otherwise(0.0)).alias("_c"))
    return g.select(*keys, (F.col("_m") / n_m - F.col("_c") / n_c).alias("score"))


def gini(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Gini index of group sizes (A16); NULL for an all-zero group."""
    # rows of one value share their mean rank, so merged values give the same sum
    t = ordered_counts(df, x, keys)
    part = (2 * F.col("_below") + F.col("_cnt") - F.col("_total")) * F.col("_cnt") * F.col(x)
    return t.groupBy(*keys).agg(F.max("_total").alias("n"), ratio(F.sum(part), F.max("_total") * F.sum(F.col("_cnt") * F.col(x))).alias("gini"))


def gene_set_cell_score(expr: DataFrame, genes: DataFrame, cell: Sequence[str], gene: str = "gene_id") -> DataFrame:
    """Per cell: log1p CP10k of the summed counts of a gene set."""
    flag = expr.join(genes.select(gene).distinct().withColumn("_in", F.lit(1)), gene, "left")
    return (flag.groupBy(*cell).agg(F.sum(F.when(F.col("_in") == 1, F.col("cnt")).otherwise(0)).alias("n_set"),
                                    F.sum("cnt").alias("lib"))
            .withColumn("score", log_cp10k("n_set", "lib")))


def cells_per_unit(cells: DataFrame, unit: str, kind: str, floor: int, share: int) -> DataFrame:
    """Cells per unit by type over all units, absent pairs 0 (A33): median, min, max, units at or above ``floor``.

    The zeros of absent pairs enter through the number of units: a type seen in m of n units has n - m zeros, which
    come first in the order the median is read from.
    """
    n = cells.groupBy(unit, kind).agg(F.count(F.lit(1)).alias("n"))
    n_units = cells.select(F.count_distinct(unit).alias("k")).scalar()
    w = Window.partitionBy(kind).orderBy("n", unit)
    r = (n.withColumn("_units", n_units).withColumn("_seen", F.count(F.lit(1)).over(Window.partitionBy(kind)))
         .withColumn("_r", F.row_number().over(w) + F.col("_units") - F.col("_seen")))
    lo, hi = F.floor((F.col("_units") + 1) / 2), F.ceil((F.col("_units") + 1) / 2)
    g = r.groupBy(kind).agg(
        (F.coalesce(F.max(F.when(F.col("_r") == lo, F.col("n"))), F.lit(0)) / F.lit(2.0)
         + F.coalesce(F.max(F.when(F.col("_r") == hi, F.col("n"))), F.lit(0)) / F.lit(2.0)).alias("median"),
        F.when(F.max("_seen") < F.max("_units"), F.lit(0)).otherwise(F.min("n")).alias("lo"),
        F.max("n").alias("hi"), F.count_if(F.col("n") >= floor).alias("n_at_floor"))
    return g.withColumn("in_sweep", F.col("n_at_floor") >= share)


def variable_genes(values: DataFrame, n_units, k: int, gene: str = "gene_id", value: str = "value",
                   by: str = "dispersion") -> DataFrame:
    """Top ``k`` genes by variance, or variance over mean; the zero rows enter through ``n_units``."""
    m = F.sum(value) / F.col("_n")
    v = F.sum(F.col(value) * F.col(value)) / F.col("_n") - m * m
    g = (values.withColumn("_n", n_units).groupBy(gene, "_n").agg(m.alias("mean"), v.alias("variance")).drop("_n")
         .withColumn("dispersion", ratio("variance", "mean")))
    return top_k(g, [F.col(by).desc(), F.col(gene)], k)
