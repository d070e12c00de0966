"""Fixed schemas, readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}[k])
                         for n, k in (f.split(":") for f in spec.split())])


SCHEMAS = {
    "cells": _schema("section_id:s cell_id:s animal_id:s x:d y:d cell_type:s cell_subtype:s cluster:s niche:s niche_state:s "
                     "total_counts:i n_genes:i cell_area:d"),
    "expr": _schema("section_id:s cell_id:s gene_id:i cnt:i"),
    "genes": _schema("gene_id:i symbol:s ensembl:s"),
    "sections": _schema("section_id:s animal_id:s capture_region_id:s region:s n_cells:l"),
    "animals": _schema("animal_id:s model:s stage:s condition:s sex:s day:d score:d run_id:s run_date:s"),
    "curves": _schema("animal_id:s day:i score:d weight:d"),
    "edges": _schema("section_id:s src:s dst:s dist:d"),
    "animal_meta": _schema("sample_id:s sample_name:s stage:s condition:s day_of_sacrifice:d score_sacrifice:d region:s sex:s model:s"),
}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the sources; Spark would sort it last and let it poison sums."""
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def read_table(spark: SparkSession, path: str, table: str, columns: dict[str, str] | None = None,
               select: Sequence[str] | None = None) -> DataFrame:
    """Parquet table under its fixed schema.

    ``columns`` maps our names to the names in the file. Only ``select`` is read; filters on the result reach the scan,
    and one on ``section_id`` prunes files where the table is partitioned by it.
    """
    schema = SCHEMAS[table]
    names = columns or {}
    want = list(select) if select else schema.fieldNames()
    on_disk = T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in schema.fields if f.name in want])
    df = spark.read.schema(on_disk).parquet(path)
    return nan_to_null(df.select(*[F.col(names.get(n, n)).alias(n) for n in want]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Delimited table with a header and a given schema, no inference pass (S5, S6). ``sep=';'`` for animal metadata."""
    return nan_to_null(spark.read.schema(schema).option("header", True).option("sep", sep).option("nanValue", "nan").csv(path))


def read_day_sheet(spark: SparkSession, path: str, ids: Sequence[str], value: str, sep: str = ",") -> DataFrame:
    """Wide sheet ``d0 d1 ...`` to long rows; dashes in section ids become underscores."""
    from cohortspark.operators.curves import unpivot_days
    with_header = spark.read.option("header", True).option("sep", sep).csv(path)   # header only; values stay text
    days = [c for c in with_header.columns if c[:1] == "d" and c[1:].isdigit()]
    d = with_header.select(*[F.regexp_replace(i, "-", "_").alias(i) for i in ids], *[F.col(x).try_cast("double").alias(x) for x in days])
    return unpivot_days(d, ids, days, value)


def assert_same_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """Two sheets must list the same sections."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    if x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count():
        raise ValueError(f"sheets differ in {list(keys)}")


def write_partitioned(df: DataFrame, path: str, by: str = "section_id", files_per_key: int = 1) -> None:
    """Parquet by section (S9). A large section is split over ``files_per_key`` tasks instead of one."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
    df.repartition(F.col(by), salt).write.mode("overwrite").partitionBy(by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Derived table: read if a finished write is there, else build and write it.

    The commit protocol leaves ``_SUCCESS`` only after the whole write, so a half-written table is rebuilt.
    """
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending(tasks: DataFrame, log_path: str, key: str) -> DataFrame:
    """Tasks that have no row in the append-only result log yet."""
    spark = tasks.sparkSession
    if not _exists(spark, log_path):
        return tasks
    return tasks.join(spark.read.parquet(log_path).select(key).distinct(), key, "left_anti")


def append_results(results: DataFrame, log_path: str) -> None:
    results.write.mode("append").parquet(log_path)
