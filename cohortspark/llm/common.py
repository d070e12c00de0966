"""Helpers shared by the operators of this subpackage: the documents table, text slices for NumPy, distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.session import cut, discard

SPACE = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, so further columns of the input cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes of text (or one longer row): (first, end, bytes, offsets of the rows).

    A null text is empty. The bytes are a view of the Arrow buffer; nothing is copied for each row.
    """
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end
    # a worker lives through many tasks: hand back what earlier batches took
    pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def stable_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the columns, the same whenever a lost task runs again."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def dense_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, weight: str | None = None,
                block_rows: int = 1000, max_blocks: int = 20000) -> DataFrame:
    """A gapless number from 0 within each key (with ``weight``: the sum of the weights before the row).

    The rows of a key are dealt into hash blocks of about ``block_rows`` (larger ones beyond ``max_blocks`` of a key); a
    window runs inside a block, and the totals of the blocks are summed up over the short table of blocks. A key that holds a third of all rows thus becomes many
    blocks. ``df`` is read twice, so it should be a written table.
    """
    keys, order = list(keys), list(order)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    per_key = per_key.select(*keys, F.least(F.lit(max_blocks), F.ceil(F.col("_rows") / block_rows)).cast("int").alias("_blocks"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    d = df.alias("a").join(per_key.alias("b"), cond).select("a.*", "_blocks")
    d = d.withColumn("_block", F.pmod(stable_hash(*[F.col(c) for c in order]), F.col("_blocks")).cast("int"))
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    blocks = d.groupBy(*keys, "_block").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    cond = F.col("a._block") == F.col("b._block")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return (d.alias("a").join(blocks.alias("b"), cond)
            .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_offset") + F.col("_inside")).alias(rank)))


__all__ = ["SPACE", "cut", "dense_ranks", "discard", "documents", "only", "ragged", "stable_hash", "text_slices", "uniform"]
