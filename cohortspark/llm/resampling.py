"""Importance resampling towards a target distribution: hashed n-gram gains, exponential-noise scores, a top draw."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import cut, only

# fixed values of the contract: what is no word character, in lower-cased text; bytes of longer characters are word bytes
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\x00"
JOINED_BYTES = 2 << 20
LONG_WORD = 64                         # bytes; longer words are hashed one by one

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))


def joined_batches(batch: pa.RecordBatch, column: str, limit: int = JOINED_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows as one lower-cased byte string with a separator between texts: (first, end, joined, start of each text).

    A run has at most about ``limit`` bytes, or is one longer text. A null text is empty. Only A-Z are lower-cased.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, end, SEPARATOR.join(texts[first:end]).lower(), np.concatenate([[0], ends[first:end - 1] - before])
        first = end


def crc_of_spans(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running (not yet inverted) CRC-32 ``state`` of each span carried on over its bytes, all spans side by side."""
    size = ends - starts
    out = state.copy()
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -LONG_WORD, "left"):]
    s, at, left = out[order], starts[order], size[order]
    live = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), "right")     # how many spans have byte i
    for i, n in enumerate(live):
        if not n:
            break
        s[:n] = _CRC[(s[:n] ^ data[at[:n] + i]) & np.uint32(255)] ^ (s[:n] >> np.uint32(8))
    out[order] = s
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def gram_buckets(joined: bytes, text_starts: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``size`` words inside one text, and the number of words of each row.

    One regex pass finds the words of all texts; ``searchsorted`` on the starts of the texts says whose they are and masks the
    runs that would cross from one text into the next.
    """
    spans = np.fromiter(chain.from_iterable(m.span() for m in WORD.finditer(joined)), np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    row = np.searchsorted(text_starts, starts, "right") - 1
    data = np.frombuffer(joined, np.uint8)
    state = crc_of_spans(np.full(len(row), 0xFFFFFFFF, np.uint32), data, starts, ends)
    rows, hashes = [row], [state ^ np.uint32(0xFFFFFFFF)]
    for n in range(2, size + 1):
        # a run of n words is the run of n - 1 words, a space, and the next word
        state = state[:-1] if len(state) else state
        last = np.arange(len(state)) + n - 1
        state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = crc_of_spans(state, data, starts[last], ends[last])
        inside = row[:len(state)] == row[last]
        rows.append(row[:len(state)][inside])
        hashes.append(state[inside] ^ np.uint32(0xFFFFFFFF))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64), np.bincount(row, minlength=len(text_starts))


def bucket_counts(texts: DataFrame, text_col: str, size: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task sends each bucket once."""
    def count(frames):
        total = np.zeros(buckets, np.int64)
        for batch in frames:
            for _, _, joined, starts in joined_batches(batch, "text"):
                total += np.bincount(gram_buckets(joined, starts, size, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])
    return only(texts, text=text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): 1000 times the smoothed log ratio of a bucket's share in the target and in the corpus, rounded down.

    Every bucket has a row, seen or not. ``corpus`` and ``target`` as from :func:`bucket_counts`.
    """
    totals = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_S")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_T")))
    every = (spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
             .join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"]).crossJoin(totals))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("_S") + buckets)) / ((d("s") + 1) * (d("_T") + buckets))
    return every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def document_weights(docs: DataFrame, gain: Sequence[int], id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of the gains of each document's features."""
    table, buckets = np.asarray(gain, float), len(gain)
    d = only(docs, _id=id_col, text=text_col)
    kind = d.schema["_id"].dataType.simpleString()

    def weigh(frames):
        for batch in frames:
            for first, end, joined, starts in joined_batches(batch, "text"):
                row, bucket, words = gram_buckets(joined, starts, size, buckets)
                n = end - first
                # sums of whole numbers below 2^53 are exact in doubles
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, n), pa.array(words), pa.array(np.bincount(row, minlength=n)),
                     pa.array(np.bincount(row, weights=table[bucket], minlength=n).astype(np.int64))], ["_id", "n_words", "n_features", "weight"])
    return d.mapInArrow(weigh, f"_id {kind}, n_words long, n_features long, weight long")


def _places(scored: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``scored`` with ``_place``, a number from 1 in the given order: ranges by sampled splitters, a window inside each range,
    and the row counts of the ranges before it."""
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(scored.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))          # one row a range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.withColumn("_inside", inside).join(before, "_range").withColumn("_place", F.col("_before") + F.col("_inside"))


def importance_draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", size: int = 1,
                    buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents without replacement, the likelier the more their words look like the target's.

    Returns (id, n_features, weight, score, rank), one row for each row of ``docs``. Words are runs of digits, letters and characters
    beyond ASCII, A-Z lower-cased; features are all runs of 1 to ``size`` words of the whole text, repeats counted, in hashed buckets.
    The score is the weight plus noise that depends on seed and id only, so the highest scores are a draw with probability in proportion
    to ``exp(weight / 1000)``. Of the rows with at least ``least_words`` words, ``percent`` of a hundred (rounded down) are drawn and
    numbered from 1 by score, equal scores by id; all others have a null rank.

    A null or empty text has no features, weight 0 and no rank. A null id takes the noise of an empty id and comes before other ids of its
    score. Repeated rows are drawn each on their own. A very long text is read whole; it is one slice. An empty ``docs`` gives an empty
    result, an empty ``target`` gains that are all of the corpus's making. Further columns are not read.

    What goes through the driver is one number for each bucket. The texts are read twice; between, nothing but counts is kept.
    """
    spark = docs.sparkSession
    corpus = cut(bucket_counts(docs, text_col, size, buckets))
    wanted = cut(bucket_counts(target, target_text, size, buckets))
    gain = [r["gain"] for r in sorted(gains(spark, corpus, wanted, buckets).collect(), key=lambda r: r["bucket"])]   # ``buckets`` rows
    d = document_weights(docs, gain, id_col, text_col, size)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    d = d.withColumn("score", F.col("weight") + noise).withColumn("_short", F.col("n_words") < least_words)
    # written once, so that finding the splitters does not read the texts again; the row number only parts rows that agree in all else
    d = _places(cut(d.withColumn("_row", F.monotonically_increasing_id())), [F.col("_short"), F.col("score").desc(), F.col("_id").asc_nulls_first(), F.col("_row")])
    drawn = d.agg(F.floor(F.count_if(~F.col("_short")) * percent / F.lit(100)).alias("_drawn"))
    return d.crossJoin(drawn).select(F.col("_id").alias(id_col), "n_features", "weight", "score",
                                     F.when(F.col("_place") <= F.col("_drawn"), F.col("_place")).cast("long").alias("rank"))


# the CRC-32 of the distinct words bit by bit and byte by byte; everything else as the operator's docstring says
SQL = r"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT doc_id, unnest(words) AS word FROM w),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM (SELECT word FROM u UNION ALL SELECT word FROM q))),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM spelt, crc_table),
s AS (SELECT bucket, count(*) AS s FROM u JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM q JOIN hashed USING (word) GROUP BY 1),
g AS (SELECT b.bucket, floor(1000 * ln(((coalesce(t.t, 0) + 1)::double * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::double) / ((coalesce(s.s, 0) + 1)::double * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::double)))::bigint AS gain
      FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
wt AS (SELECT doc_id, sum(gain)::bigint AS weight FROM u JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM w LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
