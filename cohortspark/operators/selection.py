"""Filters, labels and profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.ordering import exact_quantiles
from cohortspark.functions.scalars import ratio


def cohort(units: DataFrame, column: str, level: str, finite: Sequence[str]) -> DataFrame:
    """Units of one cohort with the named columns present."""
    keep = F.col(column) == level
    for x in finite:
        keep = keep & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    return units.where(keep)


def apply_section_mode(sections: DataFrame, disputed: DataFrame, mode: str, section: str = "section_id",
                       owner: str = "animal_id") -> DataFrame:
    """Drop disputed sections, or hand them to ``new_<owner>``."""
    if mode == "exclude":
        return sections.join(disputed.select(section), section, "left_anti")
    if mode == "reassign":
        return (sections.join(disputed.select(section, f"new_{owner}"), section, "left")
                .withColumn(owner, F.coalesce(f"new_{owner}", owner)).drop(f"new_{owner}"))
    raise ValueError(f"unknown mode {mode}")


def keep_genes(df: DataFrame, gene_set: DataFrame, exclude: bool, gene: str = "gene_id") -> DataFrame:
    """Gene-set include / exclude before selection."""
    return df.join(gene_set.select(gene).distinct(), gene, "left_anti" if exclude else "left_semi")


def gene_family(genes: DataFrame, symbol: str, pattern: str, named: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Genes whose symbol matches a pattern, or which are listed by name (P5)."""
    listed = named.select(gene).distinct().withColumn("_listed", F.lit(True))
    return (genes.join(listed, gene, "left")
            .where(F.col(symbol).rlike(pattern) | F.col("_listed").isNotNull()).drop("_listed"))


def min_support(df: DataFrame, keys: Sequence[str], floor: int) -> DataFrame:
    """Groups with at least ``floor`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor)


def every_unit_supported(df: DataFrame, keys: Sequence[str], unit: str, floor: int) -> DataFrame:
    """Groups in which every unit of the table has at least ``floor`` rows."""
    n_units = df.select(F.count_distinct(unit)).scalar()
    per = df.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("n"))
    return (per.groupBy(*keys).agg(F.bool_and(F.col("n") >= floor).alias("_all"), F.count(F.lit(1)).alias("_k"))
            .where(F.col("_all") & (F.col("_k") == n_units)).select(*keys))


def drop_constant(values: DataFrame, feature: str, n_units, value: str = "value") -> DataFrame:
    """Features that vary over units (P7); values are non-zero rows, so an absent row counts as a different value."""
    g = values.groupBy(feature).agg(F.count(F.lit(1)).alias("_m"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return g.where((F.col("_lo") != F.col("_hi")) | (F.col("_m") < n_units)).select(feature)


def ordinal_rank(df: DataFrame, label: str, order: Sequence[str], out: str = "rank") -> DataFrame:
    """Ordinal label to rank by the declared order; rows with another label are dropped."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)) - 1
    return df.where(F.col(label).isin(list(order))).withColumn(out, rank)


def phase(df: DataFrame, stage: str, sets: dict[str, Sequence[str]], prefixes: dict[str, str], rest: str = "rest"
          ) -> DataFrame:
    """Phase from explicit stage sets, then from prefixes (P10)."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, stages in sets.items():
        out = out.when(F.col(stage).isin(list(stages)), name)
    for name, prefix in prefixes.items():
        out = out.when(F.col(stage).startswith(prefix), name)
    return df.withColumn("phase", out.otherwise(rest))


def dummies(df: DataFrame, column: str, prefix: str, most: int = 1000) -> DataFrame:
    """0/1 columns for the sorted levels, first level dropped (P11). More than ``most`` levels are an error: they would be
    as many columns, and such a column is no design factor."""
    levels = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return df.select("*", *[(F.col(column) == lv).cast("int").alias(f"{prefix}{lv}") for lv in levels[1:]])


def apply_alias(df: DataFrame, alias: DataFrame, name: str, out: str) -> DataFrame:
    """Rename through an alias table (name, alias); other names stay."""
    return (df.join(alias.select(F.col("name").alias(name), "alias"), name, "left")
            .withColumn(out, F.coalesce("alias", name)).drop("alias"))


def label_genes(df: DataFrame, labels: DataFrame, gene: str = "gene_id", default: str = "other") -> DataFrame:
    """Module of a gene (or lineage of a cluster), ``default`` where unlisted."""
    col = [x for x in labels.columns if x != gene][0]
    return df.join(labels, gene, "left").withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def shared_levels(df: DataFrame, level: str, across: str) -> DataFrame:
    """Rows whose level occurs in every group of ``across``."""
    n = df.select(F.count_distinct(across)).scalar()
    ok = df.groupBy(level).agg(F.count_distinct(across).alias("_k")).where(F.col("_k") == n).select(level)
    return df.join(ok, level, "left_semi")


def level_counts(df: DataFrame, columns: Sequence[str], max_levels: int) -> DataFrame:
    """Value counts of every column with at most ``max_levels`` levels (S13), from one unpivoted scan."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("string").alias("level")) for x in columns])
    n = (df.select(F.explode(pairs).alias("_p")).select("_p.*")
         .groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n")))
    few = n.groupBy("column_name").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= max_levels)
    return n.join(few.select("column_name"), "column_name", "left_semi")


def candidate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values and rows per value of candidate key columns."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("string").alias("level")) for x in columns])
    n = (df.select(F.explode(pairs).alias("_p")).select("_p.*")
         .groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n")))
    med = exact_quantiles(n, "n", (0.5,), ("median_rows",), ["column_name"]).drop("n")
    return (n.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"),
                                         ratio(F.sum("n"), F.count(F.lit(1))).alias("mean_rows"))
            .join(med, "column_name"))


def verdict(rules, default: str):
    """First matching rule names the outcome."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise(default)
