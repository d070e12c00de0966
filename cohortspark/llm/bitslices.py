"""Exact top-k inner products over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import cut, only, stable_hash

BLOCK_ROWS = 1 << 16       # rows of one index block: a bitmap of them has 8 KB
QUERY_ROWS = 1 << 13       # queries that one task takes over a block
COARSE = 128               # low slices are left out as long as they can add up to this part of the whole range at most


# ------------------------------------------------------------------ bitmap arithmetic

def bitmaps(values: np.ndarray) -> np.ndarray:
    """Slices of non-negative whole numbers, least significant first: (bits, 64-bit words of rows)."""
    bits = int(values.max()).bit_length() if len(values) else 0
    words = -(-len(values) // 64)
    out = np.zeros((bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((values >> b) & 1 == 1, bitorder="little")
        out[b, :len(packed)] = packed
    return out.view(np.uint64)


def add_up(columns: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum of bitmaps given by their power of two, as one slice for each power: full adders of three bitmaps, then a half adder."""
    columns = defaultdict(list, {w: list(c) for w, c in columns.items()})
    out = {}
    while columns:
        w = min(columns)
        column = columns.pop(w)
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            odd = a ^ b
            columns[w + 1].append((a & b) | (odd & c))
            column.append(odd ^ c)
        if len(column) == 2:
            a, b = column
            columns[w + 1].append(a & b)
            column = [a ^ b]
        out[w] = column[0]
    return out


def kth_largest(slices: dict[int, np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows`` (a bitmap), decided from the most significant slice downward; 0 with fewer rows."""
    value, tied, left = 0, rows, k
    if int(np.bitwise_count(rows).sum()) < k:
        return 0
    for w in sorted(slices, reverse=True):
        ones = tied & slices[w]
        n = int(np.bitwise_count(ones).sum())
        if n >= left:
            tied, value = ones, value | (1 << w)
        else:
            left -= n
            tied = tied & ~slices[w]
    return value


def at_least(slices: dict[int, np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Which of ``rows`` have a sum of ``value`` or more."""
    if value <= 0:
        return rows
    top = max([value.bit_length() - 1, *slices])
    above, tied = np.zeros_like(rows), rows
    none = np.zeros_like(rows)
    for w in range(top, min([0, *slices]) - 1, -1):
        s = slices.get(w, none)
        if value >> w & 1:
            tied = tied & s
        else:
            above = above | (tied & s)
            tied = tied & ~s
    return above | tied


def set_rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """One block of the index: for each position the smallest value and the slices of what is above it."""

    def __init__(self, vec_ids: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.vec_ids, self.low = vec_ids, low
        ends = np.cumsum(bits)
        self.slices = [slices[e - b:e] for e, b in zip(ends, bits)]
        self.inverse = [~s for s in self.slices]
        words = -(-len(vec_ids) // 64)
        valid = np.zeros(words * 8, np.uint8)
        packed = np.packbits(np.ones(len(vec_ids), bool), bitorder="little")
        valid[:len(packed)] = packed
        self.valid = valid.view(np.uint64)
        # the rows themselves, read back from their slices, for the boundary
        self.rows = np.zeros((len(vec_ids), len(low)), np.int64) + low
        for d, s in enumerate(self.slices):
            for b in range(len(s)):
                self.rows[:, d] += np.unpackbits(s[b].view(np.uint8), bitorder="little", count=len(vec_ids)).astype(np.int64) << b

    def top(self, query: np.ndarray, k: int, coarse: int = COARSE) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best rows, equal scores by id.

        A component times a slice is a bitmap for each set bit of the component; a negative component takes the inverted slices, which
        only moves all sums by the same amount. The bitmaps are added from a power of two on below which all of them together are at most
        a ``coarse``-th of the whole range. Rows that this rest could lift to the k-th best are the boundary: their sums are made exactly.
        """
        columns: dict[int, list[np.ndarray]] = defaultdict(list)
        for d in np.flatnonzero(query[:len(self.low)]):
            size = abs(int(query[d]))
            for c, s in enumerate(self.slices[d] if query[d] > 0 else self.inverse[d]):
                for b in range(size.bit_length()):
                    if size >> b & 1:
                        columns[b + c].append(s)
        whole = sum(len(c) << w for w, c in columns.items())
        rest = 0
        for w in sorted(columns):
            if (rest + (len(columns[w]) << w)) * coarse > whole:
                break
            rest += len(columns.pop(w)) << w
        sums = add_up(columns)
        bound = kth_largest(sums, self.valid, k)
        near = set_rows(at_least(sums, self.valid, bound - rest))
        near = near[near < len(self.vec_ids)]
        width = min(len(query), len(self.low))
        score = self.rows[near][:, :width] @ query[:width]
        best = np.lexsort((self.vec_ids[near], -score))[:k]
        return self.vec_ids[near][best], score[best]


# ------------------------------------------------------------------ on Spark

def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): every component times ``scale`` rounded down, of the rows that take part, one for each id."""
    x = F.col("_x")
    number = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    d = only(vectors, vec_id=id_col, _x=vector_col).where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, number))
    # rows that share an id are one row, the smallest vector; the smallest is combined before the shuffle
    return d.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("int")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _best(found: DataFrame, key: str, other: str, k: int, spread: int = 64) -> DataFrame:
    """The k highest scores of each key: first within hash parts of the key, then among what is left of them."""
    order = [F.col("score").desc(), F.col(other)]
    part = Window.partitionBy(key, "_part").orderBy(*order)
    d = found.withColumn("_part", F.pmod(stable_hash(F.col(other)), F.lit(spread))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k).drop("_part", "_r")


def bit_sliced_index(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, vec_ids, low, bits, slices): one row for each block of about ``BLOCK_ROWS`` rows of (vec_id, v), dealt by a hash of the id."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        size = max(map(len, pdf["v"]))
        m = np.zeros((len(pdf), size), np.int64)           # missing positions of shorter vectors count as 0
        for i, v in enumerate(pdf["v"]):
            m[i, :len(v)] = v
        low = m.min(axis=0) if size else np.zeros(0, np.int64)
        parts = [bitmaps(m[:, d] - low[d]) for d in range(size)]
        slices = np.concatenate(parts) if parts else np.zeros((0, 1), np.uint64)
        return pd.DataFrame({"block": [key[0]], "vec_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "low": [low.tobytes()],
                             "bits": [np.array([len(p) for p in parts], np.int64).tobytes()], "slices": [slices.tobytes()]})
    d = rows.withColumn("block", F.pmod(stable_hash(F.col("vec_id")), F.lit(blocks)).cast("int"))
    return d.groupBy("block").applyInPandas(build, "block int, vec_ids binary, low binary, bits binary, slices binary")


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
                       block_rows: int = BLOCK_ROWS, coarse: int = COARSE) -> DataFrame:
    """The k rows with the highest inner product for each query row: (query_id, rank, vec_id, score).

    Components are ``floor(scale * x)``, scores whole-number inner products. Queries are the rows whose id is divisible by ``every``,
    candidates all rows but the query's own; equal scores go to the smaller id. Every row is in the index and the result is exact.

    A row takes no part if its vector is null or has a null or non-finite component, or its id is null. Rows that share an id are one row,
    the smallest of their vectors. In vectors of different lengths missing positions count as 0; an empty vector scores 0. A component must
    fit 32 bits once scaled (an error otherwise, as Spark's casts give). Empty tables give empty results; with fewer candidates than k a
    query has fewer rows. Further columns are not read.

    Equal vectors are one vector to a search: of each at most ``k + 1`` rows, those with the smallest ids, can be among the best, so the
    others leave before anything is dealt out, and each distinct query is searched once. The index has a row for each block of rows; a task
    takes a block and a part of the queries, so it holds 9 bits a component and nothing of other blocks.
    """
    spark = vectors.sparkSession
    rows = cut(whole_vectors(vectors, id_col, vector_col, scale))
    first = Window.partitionBy("v").orderBy("vec_id")
    kept = cut(rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r"))
    queries = rows.where(F.col("vec_id") % every == 0)
    distinct = cut(queries.groupBy("v").agg(F.min("vec_id").alias("query")))
    blocks = max(1, -(-kept.count() // block_rows))
    parts = max(1, -(-distinct.count() // QUERY_ROWS), -(-2 * spark.sparkContext.defaultParallelism // blocks))
    index = cut(bit_sliced_index(kept, blocks))
    asked = (distinct.withColumn("part", F.pmod(stable_hash(F.col("query")), F.lit(parts)).cast("int"))
             .withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(key, block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "vec_id": [], "score": []}
        if len(block) and len(own):
            r = block.iloc[0]
            vec_ids = np.frombuffer(r["vec_ids"], np.int64)
            words = -(-len(vec_ids) // 64)
            b = Block(vec_ids, np.frombuffer(r["low"], np.int64), np.frombuffer(r["bits"], np.int64), np.frombuffer(r["slices"], np.uint64).reshape(-1, words))
            for query, v in zip(own["query"], own["v"]):
                who, score = b.top(np.asarray(v, np.int64), k + 1, coarse)
                out["query"] += [query] * len(who)
                out["vec_id"] += who.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out)
    n = blocks * parts
    found = (held.repartition(n, "block", "part").groupBy("block", "part").cogroup(asked.repartition(n, "at", "part").groupBy("at", "part"))
             .applyInPandas(search, "query long, vec_id long, score long"))
    found = cut(_best(found, "query", "vec_id", k + 1).drop("rank"))
    # back from distinct vectors to query rows; a row is no candidate of its own
    own = queries.join(distinct, "v").select(F.col("vec_id").alias("query_id"), "query").join(found, "query").where("vec_id <> query_id")
    out = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH r AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(x::double * 256))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint AS score FROM r q, r WHERE q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score FROM s) WHERE rank <= 5
"""


__all__: Sequence[str] = ["Block", "add_up", "at_least", "bit_sliced_index", "bitmaps", "kth_largest", "top_inner_products", "whole_vectors"]
