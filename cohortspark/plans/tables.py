"""The cohort data model laid over the test tables.

cell = order, gene = part, count = quantity, section = customer, animal = nation, cell type = order priority, niche =
order status, region of a section = market segment. Daily curves come from ``events``; coordinates, marker counts and
spatial cell types from ``embeddings``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE_UNIT = 100.0        # coordinate units per embedding unit
SPACE_SIDE = 128.0        # side of the coarsest grid cell
MARKER_DIMS = (8, 64)     # embedding positions read as marker counts: all that are no coordinate, type or flag


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ------------------------------------------------------------------ counts
    @cached_property
    def cells(self) -> DataFrame:
        o, cu = self.raw("orders"), self.raw("customer")
        return (o.join(cu, o.o_custkey == cu.c_custkey)
                .select(F.col("c_nationkey").cast("bigint").alias("animal_id"),
                        F.col("o_custkey").alias("section_id"), F.col("o_orderkey").alias("cell_id"),
                        F.col("o_orderpriority").alias("cell_type"), F.col("o_orderstatus").alias("niche"),
                        F.col("c_mktsegment").alias("region"),
                        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
                        .alias("cell_day")))

    @cached_property
    def counts(self) -> DataFrame:
        """(cell_id, gene_id, cnt), one row per non-zero entry."""
        return (self.raw("lineitem")
                .groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"))
                .agg(F.sum("l_quantity").cast("bigint").alias("cnt")))

    @cached_property
    def expr(self) -> DataFrame:
        """Counts with the cell's keys. Only the columns a query uses are read."""
        li = self.raw("lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"),
                                         F.col("l_quantity").cast("bigint").alias("cnt"))
        return li.join(self.cells, "cell_id")

    @cached_property
    def sections(self) -> DataFrame:
        return (self.cells.groupBy("section_id").agg(F.min("animal_id").alias("animal_id"),
                                                     F.min("region").alias("region"),
                                                     F.count(F.lit(1)).alias("n_cells")))

    @cached_property
    def animals(self) -> DataFrame:
        n, r, cu = self.raw("nation"), self.raw("region"), self.raw("customer")
        score = cu.groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("score"))
        day = self.cells.groupBy("animal_id").agg(F.avg("cell_day").alias("day"), F.count(F.lit(1)).alias("n_cells"))
        pos = F.percent_rank().over(Window.orderBy("day"))
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .join(score, n.n_nationkey == score.c_nationkey)
                .join(day, n.n_nationkey == day.animal_id)
                .select("animal_id", F.col("n_name").alias("animal_name"),
                        F.when(F.col("n_regionkey") >= 3, "MONO").otherwise("RR").alias("model"),
                        F.col("r_name").alias("run_id"), "score", "day", "n_cells",
                        F.when(pos < 0.34, "ONSET1").when(pos < 0.67, "PEAK1").otherwise("REMISSION1")
                        .alias("stage")))

    @cached_property
    def genes(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"),
                                       F.col("p_brand").alias("program"), F.col("p_type").alias("module"),
                                       F.col("p_retailprice").alias("weight"), F.col("p_size").alias("gene_size"))

    # ------------------------------------------------------------------ curves
    @cached_property
    def curves(self) -> DataFrame:
        """(animal_id, day, score, weight): scores in half steps from 0 to 5."""
        return (self.raw("events")
                .groupBy(F.col("user_id").alias("animal_id"),
                         F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
                .agg(F.least(F.floor(F.max("value") / 25) * F.lit(0.5), F.lit(5.0)).alias("score"),
                     F.max("value").alias("weight")))

    @cached_property
    def curve_ends(self) -> DataFrame:
        """(animal_id, end_day, end_score): one terminal row per curve, the day after a missing last day included."""
        return (self.raw("events").groupBy(F.col("user_id").alias("animal_id"))
                .agg((F.max(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))).alias("last"),
                     F.count(F.lit(1)).alias("n"))
                .select("animal_id", (F.col("last") + F.when(F.col("n") >= 67, 1).otherwise(0)).alias("end_day"),
                        F.when(F.col("n") >= 67, 1.5).otherwise(0.5).alias("end_score")))

    # ------------------------------------------------------------------ space
    @cached_property
    def space(self) -> DataFrame:
        """Cells with coordinates: section = label, type from the signs of two positions, flag from a third."""
        e = F.col("embedding")
        return (self.raw("embeddings")
                .select(F.col("label").cast("bigint").alias("section_id"), F.col("vec_id").alias("cell_id"),
                        (e[0].cast("double") * SPACE_UNIT).alias("x"), (e[1].cast("double") * SPACE_UNIT).alias("y"),
                        F.concat(F.lit("T"), F.when(e[2] > 0, "1").otherwise("0"),
                                 F.when(e[3] > 0, "1").otherwise("0")).alias("cell_type"),
                        (e[4] > 0).alias("flagged"), (e[5].cast("double") * SPACE_UNIT).alias("program")))

    @cached_property
    def space_expr(self) -> DataFrame:
        """(section_id, cell_id, gene_id, cnt) for spatial cells: positive parts of a block of positions."""
        lo, hi = MARKER_DIMS
        return (self.raw("embeddings")
                .select(F.col("label").cast("bigint").alias("section_id"), F.col("vec_id").alias("cell_id"),
                        F.posexplode("embedding").alias("gene_id", "v"))
                .where((F.col("gene_id") >= lo) & (F.col("gene_id") < hi))
                .withColumn("cnt", F.floor(F.col("v").cast("double") * SPACE_UNIT).cast("bigint"))
                .where("cnt > 0").select("section_id", "cell_id", F.col("gene_id").cast("bigint"), "cnt"))

    # ------------------------------------------------------------------ several curves per animal
    @cached_property
    def section_curves(self) -> DataFrame:
        """Weekly curves of users grouped into animals of ten: sections of one animal often share a curve."""
        return (self.raw("events")
                .groupBy(F.floor(F.col("user_id") / 10).alias("animal_id"), F.col("user_id").alias("section_id"),
                         F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
                         .cast("int").alias("day"))
                .agg((F.floor(F.max("value") / 250) * F.lit(0.5)).alias("score")))

    @cached_property
    def curve_units(self) -> DataFrame:
        """(animal_id, program, severity) per curve animal."""
        return (self.raw("events").groupBy(F.col("user_id").alias("animal_id"))
                .agg(F.avg("value").alias("program"), F.stddev_pop("value").alias("severity")))
