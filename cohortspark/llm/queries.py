"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import bitslices, chat, exact, forest, idfiles, langid, lexical, packing, passages, resampling, sentencepieces, sharding, simhash
from cohortspark.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {"op6_tool_calls": chat.SQL, "op9_lsh_forest": forest.sql(2), "op10_content_sort": exact.SQL,
                              "op11_batch_concatenation": resampling.SQL, "op12_block_max_search": lexical.SQL, "op13_bit_slices": bitslices.SQL}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    samples = langid.fit(docs.where(~held_out))
    got = langid.predict(docs, samples)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


@query
def op2_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_edits(documents(spark, sf_dir))


@query
def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


@query
def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


@query
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.link_calls(calls, results, chat.tool_schemas(spark))


@query
def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    folder = idfiles.fresh_folder(spark)
    idfiles.write_ids(documents(spark, sf_dir), folder, path, end_id=2)
    return idfiles.read_ids(spark, folder, path, with_ids=False)


@query
def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(documents(spark, sf_dir))


@query
def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, sf_dir), width=2)


@query
def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_sort(documents(spark, sf_dir))


@query
def op11_batch_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_draw(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op13_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
