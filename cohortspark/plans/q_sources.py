"""Readers and writers on the given tables: each query writes a table to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortspark.plans.registry import query
from cohortspark.session import shared_folder
from cohortspark.sources import tables as S


def folder(t) -> str:
    return f"{shared_folder(t.spark)}/source-{uuid.uuid4().hex}"


def cell_rows(t):
    return t.cells.select(F.col("section_id").cast("string"), F.col("cell_id").cast("string"), F.col("animal_id").cast("string"), "cell_type", "niche")


def count_rows(t):
    return t.expr.select(F.col("section_id").cast("string"), F.col("cell_id").cast("string"), F.col("gene_id").cast("int"), F.col("cnt").cast("int"))


@query("s1_selected_columns", "SELECT cell_id::varchar AS cell_id, animal_id::varchar AS animal_id, cell_type FROM cells")
def _(t):
    """Named columns of the cell table under the fixed schema, one of them under another name in the file."""
    path = folder(t)
    cell_rows(t).withColumnRenamed("animal_id", "sample_name").write.parquet(path)
    return S.read_table(t.spark, path, "cells", {"animal_id": "sample_name"}, ["cell_id", "animal_id", "cell_type"])


@query("s2_scan_counts", "SELECT section_id::varchar AS section_id, count(*) AS n, sum(cnt)::bigint AS total FROM (SELECT l_partkey, l_quantity::bigint AS cnt, section_id FROM lineitem JOIN cells ON l_orderkey = cell_id) GROUP BY 1")
def _(t):
    """Counts in eight partitions, scanned once for sums."""
    path = folder(t)
    S.write_partitioned(count_rows(t).withColumn("region", F.col("section_id").cast("bigint") % 8), path, "region")
    d = S.read_table(t.spark, path, "expr", select=["section_id", "cnt"])
    return d.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"))


@query("s3_metadata_only", "SELECT section_id::varchar AS section_id, min(animal_id)::varchar AS animal_id, count(*) AS n_cells FROM cells GROUP BY 1")
def _(t):
    """Sections from the cell table alone; counts are never opened."""
    path = folder(t)
    cell_rows(t).write.parquet(path)
    d = S.read_table(t.spark, path, "cells", select=["section_id", "animal_id"])
    return d.groupBy("section_id").agg(F.min("animal_id").alias("animal_id"), F.count(F.lit(1)).alias("n_cells"))


@query("s5_semicolon_metadata", "SELECT animal_id::varchar AS sample_id, animal_name AS sample_name, stage, round(score, 6) AS score FROM animals", "score")
def _(t):
    path = folder(t)
    d = t.animals.select(F.col("animal_id").cast("string").alias("sample_id"), F.col("animal_name").alias("sample_name"), "stage", F.round("score", 6).alias("score"))
    S.write_csv(d, path, ";")
    return S.read_csv(t.spark, path, "sample_id string, sample_name string, stage string, score double", ";")


@query("s6_csv_curves", "SELECT animal_id, day, score FROM curves", "score")
def _(t):
    path = folder(t)
    S.write_csv(t.curves.select("animal_id", "day", "score"), path)
    return S.read_csv(t.spark, path, "animal_id bigint, day bigint, score double")


@query("s7_cached_table", "SELECT niche, cell_type, count(*) AS n FROM cells GROUP BY 1, 2")
def _(t):
    """A derived table that is built by the first call and only read by the second."""
    path = folder(t)

    def build():
        return t.cells.groupBy("niche", "cell_type").agg(F.count(F.lit(1)).alias("n"))

    def never():
        raise AssertionError("the table is there already")

    S.load_or_build(t.spark, path, build)
    return S.load_or_build(t.spark, path, never)


@query("s8_json_results", "SELECT region, count(*) AS n_sections, sum(n_cells)::bigint AS n_cells FROM sections GROUP BY 1")
def _(t):
    path = folder(t)
    S.write_json(t.sections.groupBy("region").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_cells").alias("n_cells")), path)
    return t.spark.read.schema("region string, n_sections bigint, n_cells bigint").json(path)


@query("s9_partitioned_counts", "SELECT animal_id, count(*) AS n, sum(l_quantity)::bigint AS total FROM lineitem JOIN cells ON l_orderkey = cell_id GROUP BY 1")
def _(t):
    """Counts written partitioned by animal and summed up by the partition column."""
    path = folder(t)
    d = t.expr.select("animal_id", F.col("cell_id").cast("string"), "gene_id", "cnt")
    S.write_partitioned(d, path, "animal_id", files_per_key=2)
    return t.spark.read.parquet(path).groupBy(F.col("animal_id").cast("bigint").alias("animal_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"))


@query("s10_resume_from_log", "SELECT section_id, animal_id FROM sections WHERE region NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')")
def _(t):
    """Tasks that an append-only log does not have yet, after batches of results from three regions."""
    path = folder(t)
    tasks = t.sections.select("section_id", "animal_id", "region")
    for region in ("AUTOMOBILE", "BUILDING"):
        S.append_results(tasks.where(F.col("region") == region).select("section_id"), path)
    S.append_results(S.pending(tasks, path, "section_id").where("region = 'FURNITURE'").select("section_id"), path)
    return S.pending(tasks, path, "section_id").select("section_id", "animal_id")


@query("s11_published_table", "SELECT run_id, count(*) AS n, sum(n_cells)::bigint AS n_cells FROM animals GROUP BY 1")
def _(t):
    """A half-written folder (files, but no mark of a finished write) is rebuilt, not read."""
    path = folder(t)
    t.animals.limit(1).select("run_id", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("n_cells")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return S.load_or_build(t.spark, path, lambda: t.animals.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_cells").alias("n_cells")))
