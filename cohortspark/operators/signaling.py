"""Ligand-receptor tests and the section position axis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.ordering import bh_adjust
from cohortspark.functions.scalars import ratio
from cohortspark.operators.resample import hash_positions
from cohortspark.session import cut


def relabel(cells: DataFrame, ids, kind: str, reps: int, seed: int = 0) -> DataFrame:
    """Type labels dealt anew to all cells per replicate: (rep, ids, kind).

    Only the label totals matter, so a cell's hash position is looked up in the cumulative totals (a short array).
    """
    n = cells.groupBy(kind).agg(F.count(F.lit(1)).alias("_k"))
    cum = n.withColumn("_hi", F.sum("_k").over(Window.orderBy(kind)))
    table = cum.agg(F.array_sort(F.collect_list(F.struct(F.col("_hi"), F.col(kind).alias("v"))))).scalar()
    pos = hash_positions(cells, ids, reps, seed).withColumn("_t", table)
    return pos.select("rep", *ids, F.expr("filter(_t, e -> e._hi > pos)[0].v").alias(kind))


def ligand_receptor(expr: DataFrame, cells: DataFrame, pairs: DataFrame, ids, kind: str, reps: int, seed: int = 0,
                    min_fraction: float = 0.01, fdr: bool = False) -> DataFrame:
    """Mean of ligand in the sender and receptor in the receiver against relabelled cells.

    ``expr`` (ids, gene_id, value; non-zero rows), ``pairs`` (ligand, receptor). Only genes named in a pair are read.
    Pairs of types in which both genes are detected in at least ``min_fraction`` of cells are tested; p is the share
    of replicates at least as large.
    """
    genes = pairs.select(F.col("ligand").alias("gene_id")).union(pairs.select(F.col("receptor"))).distinct()
    x = expr.join(genes, "gene_id", "left_semi")
    size = cells.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
    obs = (x.join(cells.select(*ids, kind), list(ids)).groupBy(kind, "gene_id")
           .agg(F.sum("value").alias("_s"), F.count(F.lit(1)).alias("_m")).join(size, kind)
           .select(kind, "gene_id", (F.col("_s") / F.col("_n")).alias("mean"), (F.col("_m") / F.col("_n")).alias("frac")))
    null = (x.join(relabel(cells, ids, kind, reps, seed), list(ids)).groupBy("rep", kind, "gene_id").agg(F.sum("value").alias("_s"))
            .join(size, kind).select("rep", kind, "gene_id", (F.col("_s") / F.col("_n")).alias("mean")))

    def side(df, gene, who, tag, extra=()):
        return df.select(*extra, F.col("gene_id").alias(gene), F.col(kind).alias(who), F.col("mean").alias(f"_{tag}"),
                         *([F.col("frac").alias(f"_f{tag}")] if "frac" in df.columns else []))
    seen = (pairs.join(side(obs, "ligand", "sender", "l"), "ligand").join(side(obs, "receptor", "receiver", "r"), "receptor")
            .where((F.col("_fl") > min_fraction) & (F.col("_fr") > min_fraction))
            .select("ligand", "receptor", "sender", "receiver", ((F.col("_l") + F.col("_r")) / 2).alias("mean_expr")))
    grid = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    d = (grid.join(side(null, "ligand", "sender", "l", ["rep"]), ["rep", "ligand", "sender"], "left")
         .join(side(null, "receptor", "receiver", "r", ["rep"]), ["rep", "receptor", "receiver"], "left"))
    dealt = (F.coalesce("_l", F.lit(0.0)) + F.coalesce("_r", F.lit(0.0))) / 2
    out = (d.groupBy("ligand", "receptor", "sender", "receiver", "mean_expr")
           .agg(ratio(F.count_if(dealt >= F.col("mean_expr") - 1e-12), F.lit(reps)).alias("p")))
    return bh_adjust(out, "p") if fdr else out


DENSE_GENES = 1000          # family size up to which its moments are one matrix
AXIS_ROWS = 250_000         # rows of sections that a task multiplies at once
AXIS_BASIS = 48             # directions kept by the search for an axis; as many as a third are carried over a restart
AXIS_STEPS = 20_000         # steps after which a search counts as failed


def position_axis(values: DataFrame, genes: DataFrame, sections: DataFrame, orient: str, section: str = "section_id"
                  ) -> DataFrame:
    """First principal component of a gene family over sections, oriented to rise with ``orient``.

    ``genes`` is a named family. The gene x gene moment table of up to ``DENSE_GENES`` genes is a Spark aggregate, and only that small
    table reaches the eigenproblem. A larger family has no such table: its axis is searched by products of the moments with a vector, each
    of them a pass over the rows of the sections. Scores come from a join with the loadings.
    """
    x = cut(values.join(genes.select("gene_id"), "gene_id", "left_semi").select(section, "gene_id", "value"))
    n = sections.agg(F.count(F.lit(1))).first()[0]
    n_genes = x.select(F.count_distinct("gene_id")).first()[0]
    load = cut(_dense_loadings(x, n, section) if n_genes <= DENSE_GENES else _searched_loadings(x, n, n_genes, section))
    shift = load.agg(F.sum(F.col("loading") * F.col("centre"))).scalar()
    raw = (sections.join(x.join(load, "gene_id").groupBy(section).agg(F.sum(F.col("value") * F.col("loading")).alias("_p")),
                         section, "left")
           .withColumn("_p", F.coalesce("_p", F.lit(0.0)) - shift))
    sign = raw.agg(F.when(F.covar_pop("_p", orient) < 0, -1.0).otherwise(1.0)).scalar()
    return raw.withColumn("position", F.col("_p") * sign).drop("_p")


def _dense_loadings(x: DataFrame, n: int, section: str) -> DataFrame:
    """(gene_id, loading, centre) from the moments of all pairs of genes."""
    packed = x.groupBy(section).agg(F.collect_list(F.struct("gene_id", "value")).alias("_v"))
    prod = (packed.select(F.explode("_v").alias("p"), "_v").select("p", F.explode("_v").alias("q"))
            .groupBy(F.col("p.gene_id").alias("g1"), F.col("q.gene_id").alias("g2"))
            .agg(F.sum(F.col("p.value") * F.col("q.value")).alias("s")))
    sums = x.groupBy("gene_id").agg(F.sum("value").alias("t"))
    cov = (prod.join(sums.select(F.col("gene_id").alias("g1"), F.col("t").alias("t1")), "g1")
           .join(sums.select(F.col("gene_id").alias("g2"), F.col("t").alias("t2")), "g2").withColumn("n", F.lit(n)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["g1"].unique())
        at = {g: i for i, g in enumerate(ids)}
        k = float(pdf["n"].iloc[0])
        mean = np.zeros(len(ids))
        mean[[at[g] for g in pdf["g1"]]] = pdf["t1"] / k
        m = np.zeros((len(ids), len(ids)))
        m[[at[g] for g in pdf["g1"]], [at[g] for g in pdf["g2"]]] = pdf["s"] / k
        m -= np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(m), 1e-12, None))
        _, vec = np.linalg.eigh(m / np.outer(sd, sd))
        return pd.DataFrame({"gene_id": ids, "loading": vec[:, -1] / sd, "centre": mean})
    return cov.groupBy(F.lit(0).alias("_one")).applyInPandas(solve, "gene_id bigint, loading double, centre double")


def _searched_loadings(x: DataFrame, n: int, n_genes: int, section: str) -> DataFrame:
    """The same without the moments: (gene_id, loading, centre) from products of the sections' rows with vectors.

    A block holds all rows of its sections, and a product is the sum of the blocks' products. The driver keeps ``AXIS_BASIS`` vectors
    of the family and their products, and finds the leading axis of their span; what the axis lacks to be an eigenvector is the next
    direction, until nothing is lacking.
    """
    spark = x.sparkSession
    place = cut(x.select("gene_id").where("gene_id IS NOT NULL").distinct()
                .withColumn("_pos", F.row_number().over(Window.orderBy("gene_id")) - 1))   # a family fits a window partition
    rows = x.where("value IS NOT NULL").join(place, "gene_id").select(F.col(section).alias("_s"), F.col("_pos").cast("int"), F.col("value").cast("double"))
    blocks = max(1, -(-rows.count() // AXIS_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own, _ = pd.factorize(pdf["_s"], use_na_sentinel=False)
        cell, at = np.unique(own * np.int64(n_genes) + pdf["_pos"].to_numpy(np.int64), return_inverse=True)
        value = np.bincount(at, pdf["value"].to_numpy(float))
        return pd.DataFrame({"row": [(cell // n_genes).astype(np.int32).tobytes()], "gene": [(cell % n_genes).astype(np.int32).tobytes()], "value": [value.tobytes()]})
    packed = cut(rows.withColumn("_b", F.pmod(F.xxhash64("_s"), F.lit(blocks))).groupBy("_b").applyInPandas(pack, "row binary, gene binary, value binary"))

    def over_blocks(product):
        """Sum over all blocks of ``product(section numbers, gene places, values)``, an array."""
        def run(batches):
            total = None
            for pdf in batches:
                for row, gene, value in zip(pdf["row"], pdf["gene"], pdf["value"]):
                    part = product(np.frombuffer(row, np.int32), np.frombuffer(gene, np.int32), np.frombuffer(value))
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"part": [total.tobytes()]})
        total = 0.0
        for r in packed.mapInPandas(run, "part binary").collect():       # an array for each task
            total = total + np.frombuffer(r["part"])
        return total
    sums = over_blocks(lambda row, gene, value: np.concatenate([np.bincount(gene, value, n_genes), np.bincount(gene, value * value, n_genes)]))
    mean = sums[:n_genes] / n
    sd = np.sqrt(np.clip(sums[n_genes:] / n - mean * mean, 1e-12, None))

    def correlate(v):
        u = v / sd
        got = over_blocks(lambda row, gene, value: np.bincount(gene, value * np.bincount(row, value * u[gene])[row], n_genes))
        return (got / n - mean * (mean @ u)) / sd
    vec = leading_axis(correlate, n_genes)
    found = spark.createDataFrame(pd.DataFrame({"_pos": np.arange(n_genes), "loading": vec / sd, "centre": mean}), "_pos int, loading double, centre double")
    return place.join(found, "_pos").select(F.col("gene_id").cast("bigint"), "loading", "centre")


def leading_axis(product, size: int, tol: float = 1e-10) -> np.ndarray:
    """Unit eigenvector of the largest eigenvalue of a symmetric map, from products with vectors alone (Lanczos with thick restarts)."""
    new = np.random.default_rng(0).normal(size=size)
    base, image = np.zeros((0, size)), np.zeros((0, size))
    for _ in range(AXIS_STEPS):
        for _ in range(2):
            new = new - (base @ new) @ base
        new /= np.linalg.norm(new)
        base, image = np.vstack([base, new]), np.vstack([image, product(new)])
        inner = base @ image.T
        root, vec = np.linalg.eigh((inner + inner.T) / 2)
        axis = vec[:, -1] @ base
        new = vec[:, -1] @ image - root[-1] * axis
        if np.linalg.norm(new) <= tol * max(abs(root[-1]), abs(root[0])) or len(base) == size:
            return axis
        if len(base) >= AXIS_BASIS:
            lead = vec[:, -(AXIS_BASIS // 3):].T
            base, image = lead @ base, lead @ image
    raise ArithmeticError("a position axis did not settle")
