"""Exact deduplication by content sort (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import SPACE, cut, discard

HOT_ROWS = 1000


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Classes of equal texts: (id, keep_id, group_size, kept, text_sha256, carried columns).

    ``carry`` names further columns to take along, the text as it is among them if wanted.

    Texts are equal when identical after every run of the six ASCII white-space characters is one space; a null text is
    empty. One row per input row; of a class, the row with the smallest id is kept (a null id comes first, and of
    repeated rows exactly one is kept). An empty table gives an empty result.

    The rows are dealt into ranges by sampled splitters over the first 64 characters of the normalised text and its
    64-bit hash, sorted by the whole text inside each range, and told apart by comparing whole neighbouring texts (the
    window below starts a new run where the text differs from the row before). The splitters are short, so what the
    driver samples is bounded. A text with over ``hot_rows`` copies (or 1/10,000 of all rows, whichever is more, so at
    most 10,000 texts) is dealt into several runs; the heads of these runs are merged at the end.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_raw"),
                      *[F.col(f"`{c}`").alias(f"_c_{i}") for i, c in enumerate(carry) if c != text_col])
    norm = F.regexp_replace(F.coalesce("_raw", F.lit("")), SPACE, " ")
    table = raw.withColumn("_norm", norm)
    if text_col in carry:      # the texts as they are travel once; their normal form is made again behind the shuffle
        table = table.withColumn("_text_as_is", F.col("_raw"))
    table = cut(table.withColumn("_hash", F.xxhash64("_norm")).withColumn("_head", F.substring("_norm", 1, 64)).drop("_raw", *(["_norm"] if text_col in carry else [])))

    counts = table.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = table.agg(F.count(F.lit(1)).alias("_all"))
    # at most 10,000 rows by construction, so this side is always small
    hot = (counts.join(F.broadcast(total)).where(F.col("_n") > F.greatest(F.lit(hot_rows), F.col("_all") / 10000))
           .select(F.col("_hash").alias("_hot"), F.ceil(F.col("_n") / hot_rows).cast("int").alias("_runs")))
    hot = cut(hot)
    salted = (table.join(F.broadcast(hot), F.col("_hash") == F.col("_hot"), "left")
              .withColumn("_salt", F.when(F.col("_runs").isNotNull(), F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.col("_runs"))
                                          ).otherwise(F.lit(0)).cast("int")).drop("_hot"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.repartitionByRange(parts, "_head", "_hash", "_salt")
    if text_col in carry:
        dealt = dealt.withColumn("_norm", F.regexp_replace(F.coalesce("_text_as_is", F.lit("")), SPACE, " "))
    run = Window.partitionBy("_head", "_hash", "_salt", "_norm")
    first = run.orderBy(F.col("_id").asc_nulls_first())
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ["_text_as_is" if c == text_col else f"_c_{i}" for i, c in enumerate(carry)]
    sorted_ = dealt.select("_id", "_hash", "_salt", *carried, (F.col("_runs").isNotNull()).alias("_split"),
                           F.first("_id").over(whole).alias("_keep"), F.count(F.lit(1)).over(whole).alias("_size"),
                           F.row_number().over(first).alias("_place"), F.sha2("_norm", 256).alias("_sha"),
                           F.when((F.row_number().over(first) == 1) & F.col("_runs").isNotNull(), F.col("_norm")).alias("_text"))
    if not hot.take(1):
        return sorted_.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
                              (F.col("_place") == 1).alias("kept"), F.col("_sha").alias("text_sha256"), *[F.col(x).alias(c) for x, c in zip(carried, carry)])
    sorted_ = cut(sorted_)
    discard(spark, table)

    # the runs of a hot text: at most 10,000 texts, each with one head for a run
    heads = sorted_.where("_split AND _place = 1")
    order = F.struct(F.col("_keep").isNotNull().alias("n"), F.col("_keep").alias("k"), F.col("_salt").alias("s"))
    merged = (heads.groupBy("_text").agg(F.min(order).alias("_least"), F.sum("_size").alias("_all"), F.first("_sha").alias("_s"))
              .select("_s", F.col("_least.k").alias("_k"), F.col("_least.s").alias("_ks"), "_all"))
    out = sorted_.join(F.broadcast(merged), F.col("_split") & (F.col("_sha") == F.col("_s")), "left")
    split = F.col("_split")
    return out.select(F.col("_id").alias(id_col), F.when(split, F.col("_k")).otherwise(F.col("_keep")).alias("keep_id"),
                      F.when(split, F.col("_all")).otherwise(F.col("_size")).cast("long").alias("group_size"),
                      ((F.col("_place") == 1) & (~split | (F.col("_salt") == F.col("_ks")))).alias("kept"),
                      F.col("_sha").alias("text_sha256"), *[F.col(x).alias(c) for x, c in zip(carried, carry)])


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of every class of equal texts, all columns as they are."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    kept = content_sort(d, own[id_col], own[text_col], tuple(x for c, x in own.items() if c != id_col)).where("kept")
    return kept.select(*[F.col(x).alias(c) for c, x in own.items()])
