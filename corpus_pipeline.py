"""A corpus pipeline over the documents table: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept; its result is written as
Parquet and read again as the next one's ``docs``. All stages but the last return the columns of ``docs`` as they came. Every stage
takes empty tables (and gives empty ones), null, empty and very long texts, nulls in any column, repeated rows and further
columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import exact, forest, langid, packing, passages
from cohortspark.llm.common import cut, documents
from cohortspark.llm.queries import tokenizer_path
from cohortspark.session import cut_paths, discard

# No stage but the second can be said in SQL: the run is tested against a brute-force version.
ORACLE_SQL = None


_done: list[str] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Tables that a stage leaves in the shared folder are deleted when the next one begins: its result has been written by
    then. Tables that ``docs`` itself reads stay."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _done:
            read = docs.inputFiles()
            discard(spark, *[p for p in _done if not any(p.split("/")[-1] in f for f in read)])
            _done.clear()
        before = set(cut_paths())
        out = fn(spark, docs, sf_dir)
        _done.extend(p for p in cut_paths() if p not in before)
        return out
    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-parsing entropy (operator 1): rows whose text is in none of the languages that the labelled rows teach go
    (null texts, texts without a letter, texts that need more bits a letter than labelled texts of their language do)."""
    return langid.accepted(docs, *langid.fit_bounds(docs))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Content sort (operator 10): of equal texts the row with the smallest id stays."""
    return exact.without_copies(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """LSH forest (operator 9): of documents whose sets of five-word shingles are linked by a similarity of 0.8 or more
    the one with the smallest id stays."""
    dropped = forest.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compact windows (operator 4): passages of 50 words or more that near-copy a passage of a document with a smaller id
    are cut out of the text; no document goes."""
    return passages.without_passages(docs, passages.repeated_passages(docs))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Minimum bin slack (operator 2): token pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
