"""Token-id files: one zstandard frame for each document, a shared trained dictionary, an offset index.

A store is a folder with two Parquet tables, so any file system that Spark can write will do and a lost task is simply
written again:

- ``blocks``: up to ``BLOCK_DOCS`` documents in ascending id order: ``part``, ``block`` (number inside the part),
  ``first_id``/``last_id`` (their statistics prune a look-up to one row group), ``dict_sha256``, ``start`` (ids of the part
  before the block), ``index`` (one int64 triple for each document: frame offset, frame bytes, ids) and ``payload`` (the
  frames end to end);
- ``dictionary``: ``sha256`` and the bytes of the dictionary that every frame needs.

Ids are little-endian unsigned 16-bit where the vocabulary allows, else 32-bit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import text_slices, uniform
from cohortspark.llm.tokens import crc, encoder
from cohortspark.session import shared_folder

SAMPLE_DOCS = 2000          # bound of the sample that the dictionary is trained on
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 64 << 10
BLOCK_DOCS = 1024
BLOCK_BYTES = 4 << 20
LEVEL = 3


def _width(path: str) -> str:
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, keeps_space: bool, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from at most SAMPLE_DOCS texts (chosen by a hash of the id, their first SAMPLE_CHARS characters).

    With too little text to train on, the serialized sample itself serves as a raw-content dictionary.
    """
    import zstandard
    n = docs.count()
    share = min(1.0, 2.0 * SAMPLE_DOCS / max(1, n))
    rows = (docs.where(uniform(F.col(f"`{id_col}`"), F.lit(31)) < share)
            .select(F.xxhash64(F.col(f"`{id_col}`"), F.lit(5)).alias("h"), F.substring(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 1, SAMPLE_CHARS).alias("t"))
            .orderBy("h", "t").limit(SAMPLE_DOCS).collect())
    dtype, encode, samples = _width(tokenizer), encoder(tokenizer, keeps_space), []
    for r in rows:
        raw = r["t"].encode()
        ids, _ = encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        samples.append(ids.astype(dtype).tobytes())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes):
    import zstandard
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True), zstandard.ZstdDecompressor(dict_data=d))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, keeps_space: bool = False, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` and writes a store in ascending id order.

    Texts are dealt into id ranges before they are encoded, so encoding runs once. Null ids come first; rows with equal
    ids follow each other in the order of a hash of their texts (so one id with very many rows is dealt out too). An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    dtype = _width(tokenizer)
    dictionary = train_dictionary(docs, tokenizer, keeps_space, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("_h")]
    src = (src.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
           .select("id", "text", F.spark_partition_id().alias("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (pack, _) = encoder(tokenizer, keeps_space), _codec(dictionary)
        block, before, part, id_type = 0, 0, 0, None
        frames, index, ids_held, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, frames, index, ids_held, held
            at = np.array(index, "<i8")
            columns = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids_held[0]], id_type), pa.array([ids_held[-1]], id_type),
                       pa.array([digest]), pa.array([before], pa.int64()), pa.array([int(at[:, 2].sum())], pa.int64()),
                       pa.array([ids_held], pa.list_(id_type)), pa.array([at.tobytes()], pa.binary()), pa.array([b"".join(frames)], pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, ["part", "block", "first_id", "last_id", "dict_sha256", "start", "n_ids", "ids", "index", "payload"])
            block, before = block + 1, before + int(at[:, 2].sum())
            frames, index, ids_held, held = [], [], [], 0
            return out

        for batch in batches:
            id_type = batch.column("id").type
            names = batch.column("id").to_pylist()
            part = batch.column("part")[0].as_py() if len(names) else part
            for first, end, data, offsets in text_slices(batch, "text"):
                ids, bounds = encode(data, offsets)
                for k in range(end - first):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id))
                    frame = pack.compress(own.astype(dtype).tobytes())
                    index.append((held, len(frame), len(own)))
                    frames.append(frame)
                    ids_held.append(names[first + k])
                    held += len(frame)
                    if len(frames) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                        yield flush()
        if frames:
            yield flush()

    schema = (f"part int, block int, first_id {kind}, last_id {kind}, dict_sha256 string, start long, n_ids long, ids array<{kind}>, "
              "index binary, payload binary")
    src.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row["bytes"])
    if hashlib.sha256(raw).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is damaged")
    return raw


def read_ids(spark: SparkSession, path: str, tokenizer: str, where: Column | None = None, id_col: str = "doc_id",
             with_ids: bool = True) -> DataFrame:
    """Reads a store back: (id, start, n_tokens, ids_crc32[, ids]); ``start`` counts the ids of all documents before.

    ``where`` is a condition on ``first_id`` and ``last_id``; it reaches the Parquet scan, so one document costs one block,
    and of that block only the wanted frames need be unpacked (see :func:`read_document`).
    """
    dtype, dictionary = _width(tokenizer), _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["first_id"].dataType.simpleString()
    # one short row for each part: the ids before it
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if where is not None:
        blocks = blocks.where(where)
    blocks = blocks.join(F.broadcast(sums), F.col("part") == F.col("p"))
    blocks = blocks.select((F.col("start") + F.col("before")).alias("start"), "dict_sha256", "ids", "index", "payload")
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = _codec(dictionary)
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("dict_sha256")[i].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                names = batch.column("ids")[i].values
                index = np.frombuffer(batch.column("index")[i].as_py(), "<i8").reshape(-1, 3)
                payload = memoryview(batch.column("payload")[i].as_buffer())
                starts = batch.column("start")[i].as_py() + np.cumsum(index[:, 2]) - index[:, 2]
                own = [np.frombuffer(unpack.decompress(payload[a:a + b]), dtype).astype("<u4") for a, b, _ in index]
                if [len(x) for x in own] != index[:, 2].tolist():
                    raise ValueError("a frame does not hold the ids that its index says")
                columns = [names, pa.array(starts, pa.int64()), pa.array(index[:, 2], pa.int64()), pa.array([crc(x) for x in own], pa.int64())]
                columns += [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return blocks.mapInArrow(run, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def read_document(spark: SparkSession, path: str, tokenizer: str, doc_id) -> list[list[int]]:
    """Ids of the documents with this id (repeated ids give several), unpacking their frames alone."""
    dtype, dictionary = _width(tokenizer), _dictionary(spark, path)
    _, unpack = _codec(dictionary)
    out = []
    at = F.lit(doc_id)
    hits = spark.read.parquet(f"{path}/blocks").where((F.col("first_id") <= at) & (F.col("last_id") >= at))
    hits = hits.select("part", "block", F.posexplode("ids").alias("pos", "id"), "index", "payload").where(F.col("id") == at)
    for r in hits.orderBy("part", "block", "pos").toLocalIterator():
        a, b, _ = np.frombuffer(r["index"], "<i8").reshape(-1, 3)[r["pos"]]
        out.append(np.frombuffer(unpack.decompress(bytes(r["payload"][a:a + b])), dtype).tolist())
    return out


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
