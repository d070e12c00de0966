"""Session helper and the settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# AQE picks join sides from measured sizes (hints stand only on sides of bounded size), splits skewed
# shuffle partitions and merges small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "cohortspark") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return (b.config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a ``local`` master, whose one process sees every file it writes, may go without: it gets a scratch folder of
    its own. Elsewhere a missing setting is an error, since executors would write to their own disks.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write a reused or iterated table to the shared folder and read it back.

    This ends the lineage, survives executor loss, and computes the table once. The table stays until :func:`discard`, or
    until the folder's owner clears it after the job.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _cut_paths.append(path)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition small but compute-heavy groups over all cores; AQE would merge them by their size in bytes."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


_cut_paths: list[str] = []


def cut_paths() -> list[str]:
    """Paths of the tables that :func:`cut` has written and nobody has discarded, oldest first."""
    return list(_cut_paths)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables of :func:`cut` (or their paths) from the shared folder, once nothing reads them any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_cut_path", None)
        if path in _cut_paths:
            _cut_paths.remove(path)
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_with_digest(df: DataFrame, *cols: str) -> tuple[DataFrame, tuple]:
    """:func:`cut`, with row count and an order-free digest observed while writing, so no second scan is needed."""
    seen = Observation()
    h = F.xxhash64(*cols)
    d = df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1000003).alias("s"))
    out = cut(d)
    got = seen.get
    return out, (got["n"], got["x"], got["s"])
