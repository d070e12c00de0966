"""Ranked lexical search: an inverted index of shards with block maxima, searched by Block-Max MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import cut, discard, only, ragged, stable_hash, text_slices
from cohortspark.llm.units import LOWER

# fixed values of the contract: term characters and the constants of the score
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, LENGTH_FACTOR, LENGTH_SHARE = 1_000_000_000, 8, 75

SHARD_BYTES = 16 << 20     # text of a shard, or one longer document
BLOCK = 128                # postings of a block
WINDOW = 512               # documents that are scored side by side
ITEMS = 256                # items that one task searches for

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ------------------------------------------------------------------ terms and postings, whole slices at a time

def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the rows of a slice, dictionary-encoded, and the number of terms of each row. A term never crosses a row."""
    inside = _TERM_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    # term bytes alone are the concatenation of all terms
    at = np.concatenate([np.cumsum(inside)[starts] - 1, [inside.sum()]])
    letters = LOWER[data[inside]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters))
    return words.dictionary_encode(), np.bincount(row, minlength=len(offsets) - 1)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of whole numbers (seven bits a byte, the top bit says that more follow), and where each ends."""
    size = np.ones(len(values), np.int64)
    for b in range(1, 5):
        size += values >> (7 * b) > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for b in range(5):
        more = size > b
        out[ends[more] - size[more] + b] = (values[more] >> (7 * b) & 127) | np.where(size[more] > b + 1, 128, 0)
    return out, ends


def unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def impact(tf: np.ndarray, n: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """What one occurrence list entry adds for each unit of term weight, in whole numbers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * all_docs) // max(1, all_terms)
    return (UNIT * tf) // (1000 * tf + LENGTH_FACTOR * m)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


INDEX = ("shard long, term string, n_docs long, last array<int>, top array<long>, at array<long>, data binary, doc_ids array<long>, sizes array<long>")
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int64()), ("last", pa.list_(pa.int32())), ("top", pa.list_(pa.int64())),
                    ("at", pa.list_(pa.int64())), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def shard_rows(shard: int, doc_ids: np.ndarray, words: list[pa.Array], counts: np.ndarray, all_docs: int, all_terms: int) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard: one with the documents (ids ascending, terms of each), one for each term with its blocks.

    A block holds ``BLOCK`` postings (document, occurrences) as differences in variable-length bytes; ``last`` is its last document,
    ``top`` the greatest impact in it, ``at`` where its bytes start (one entry more than blocks).
    """
    order = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes = counts[order]
    none = pa.nulls(1)
    yield pa.RecordBatch.from_arrays([pa.array([shard]), none.cast(pa.string()), pa.array([len(order)]), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.int64())),
                                      none.cast(pa.list_(pa.int64())), none.cast(pa.binary()), pa.array([doc_ids[order]], pa.list_(pa.int64())),
                                      pa.array([sizes], pa.list_(pa.int64()))], schema=_ARROW)
    coded = pa.chunked_array(words).unify_dictionaries().combine_chunks() if len(words) > 1 else words[0]
    if not len(coded):
        return
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
    key, tf = np.unique(codes * len(order) + np.repeat(place, counts), return_counts=True)
    term, doc = key // len(order), key % len(order)
    top = impact(tf, sizes[doc], all_docs, all_terms)
    lists = np.concatenate([np.flatnonzero(np.diff(term, prepend=-1)), [len(key)]])
    n_docs = np.diff(lists)
    n_blocks = -(-n_docs // BLOCK)
    nth = ragged(np.zeros(len(n_blocks), np.int64), n_blocks)
    starts = np.repeat(lists[:-1], n_blocks) + BLOCK * nth
    ends = np.minimum(starts + BLOCK, np.repeat(lists[1:], n_blocks))
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    raw, stops = packed(np.stack([gap, tf], 1).ravel())
    block_ends = stops[2 * ends - 1]
    list_ends = block_ends[np.cumsum(n_blocks) - 1]
    list_starts = np.concatenate([[0], list_ends[:-1]])
    block_starts = np.concatenate([[0], block_ends[:-1]]) - np.repeat(list_starts, n_blocks)
    bounds = np.concatenate([[0], np.cumsum(n_blocks)])
    wide = np.insert(block_starts, bounds[1:], list_ends - list_starts)          # one entry more for each list
    for a in range(0, len(n_docs), 20000):
        b = min(a + 20000, len(n_docs))
        part, n = slice(bounds[a], bounds[b]), b - a
        byte = np.concatenate([list_starts[a:b], list_ends[b - 1:b]])
        data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((byte - byte[0]).astype(np.int32)), pa.py_buffer(raw[byte[0]:byte[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), names.take(pa.array(term[lists[:-1]][a:b])), pa.array(n_docs[a:b]),
             _lists(doc[ends - 1][part], bounds[a:b + 1] - bounds[a], pa.int32()),
             _lists(np.maximum.reduceat(top, starts)[part], bounds[a:b + 1] - bounds[a], pa.int64()),
             _lists(wide[bounds[a] + a:bounds[b] + b], bounds[a:b + 1] - bounds[a] + np.arange(n + 1), pa.int64()),
             data, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=_ARROW)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms) of (doc_id, text)."""
    def count(frames):
        n = total = 0
        for batch in frames:
            for _, _, data, offsets in text_slices(batch, "text"):
                per_row = terms_per_row(data, offsets)
                n, total = n + int((per_row > 0).sum()), total + int(per_row.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])
    r = docs.mapInArrow(count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return int(r["n"] or 0), int(r["total"] or 0)


def terms_per_row(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    inside = _TERM_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    first[rows] = inside[rows]
    sums = np.concatenate([[0], np.cumsum(first)])
    return np.diff(sums[offsets])


def inverted_index(docs: DataFrame, all_docs: int, all_terms: int) -> DataFrame:
    """Index of all terms of all documents (doc_id, text): rows of :func:`shard_rows`. A shard is a run of rows of one task."""
    def build(frames):
        shard = TaskContext.get().partitionId() << 24
        ids, words, counts, size = [], [], [], 0
        for batch in frames:
            own = batch.column("doc_id").to_numpy()
            for first, end, data, offsets in text_slices(batch, "text"):
                if ids and size + len(data) > SHARD_BYTES:
                    yield from shard_rows(shard, np.concatenate(ids), words, np.concatenate(counts), all_docs, all_terms)
                    shard, ids, words, counts, size = shard + 1, [], [], [], 0
                coded, n = terms_of(data, offsets)
                ids.append(own[first:end])
                words.append(coded)
                counts.append(n)
                size += len(data)
        if ids:
            yield from shard_rows(shard, np.concatenate(ids), words, np.concatenate(counts), all_docs, all_terms)
    return docs.mapInArrow(build, INDEX)


# ------------------------------------------------------------------ search

class Lists:
    """The lists of one shard that a block of items asks for; a block is unpacked at its first use."""

    def __init__(self, rows: pd.DataFrame, sizes: np.ndarray, all_docs: int, all_terms: int):
        self.last = [np.asarray(v, np.int64) for v in rows["last"]]
        self.top = [np.asarray(v, np.int64) for v in rows["top"]]
        self.at = [np.asarray(v, np.int64) for v in rows["at"]]
        self.data = [np.frombuffer(v, np.uint8) for v in rows["data"]]
        self.sizes, self.all_docs, self.all_terms = sizes, all_docs, all_terms
        self.opened: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block b of list i."""
        if (i, b) not in self.opened:
            v = unpacked(self.data[i][self.at[i][b]:self.at[i][b + 1]]).reshape(-1, 2)
            docs = np.cumsum(v[:, 0])
            self.opened[i, b] = docs, impact(v[:, 1], self.sizes[docs], self.all_docs, self.all_terms)
        return self.opened[i, b]


def best_documents(lists: Lists, wanted: np.ndarray, weight: np.ndarray, n_docs: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best of a shard for one item with the lists ``wanted`` and their weights: Block-Max MaxScore.

    Lists are ordered by the most that they can add. Those whose bounds together do not pass the k-th score so far are not essential: no
    document that only they hold can still get in. The documents of the essential lists in a window are scored; then the other lists,
    the strongest first, first reject candidates by the maximum of the block that would hold them, and only blocks with a candidate left
    are unpacked. Documents come in ascending order, so one that only equals the k-th score comes too late.
    """
    bound = weight * np.array([lists.top[i].max() for i in wanted], np.int64)
    order = np.argsort(bound, kind="stable")
    wanted, weight, sums = wanted[order], weight[order], np.cumsum(bound[order])
    best_doc, best_score, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for lo in range(0, n_docs, window):
        hi = min(lo + window, n_docs)
        essential = int(np.searchsorted(sums, least, "right"))
        if essential == len(wanted):
            break
        score = np.zeros(hi - lo, np.int64)
        for i, w in zip(wanted[essential:], weight[essential:]):
            last = lists.last[i]
            for b in range(int(np.searchsorted(last, lo)), min(len(last), int(np.searchsorted(last, hi - 1)) + 1)):
                docs, parts = lists.block(i, b)
                a, z = np.searchsorted(docs, (lo, hi))
                score[docs[a:z] - lo] += w * parts[a:z]
        doc = np.flatnonzero(score) + lo
        score = score[doc - lo]
        for j in range(essential - 1, -1, -1):
            i, w = wanted[j], weight[j]
            last = lists.last[i]
            b = np.searchsorted(last, doc)
            held = b < len(last)
            most = np.where(held, w * lists.top[i][np.minimum(b, len(last) - 1)], 0)
            live = score + most + (sums[j - 1] if j else 0) > least
            doc, score, b, held = doc[live], score[live], b[live], held[live]
            for one in np.unique(b[held]):
                docs, parts = lists.block(i, int(one))
                a, z = np.searchsorted(b, (one, one + 1))         # candidates ascend, so their blocks do
                at = np.minimum(np.searchsorted(docs, doc[a:z]), len(docs) - 1)
                score[a:z] += np.where(docs[at] == doc[a:z], w * parts[at], 0)
        live = score > least
        doc, score = np.concatenate([best_doc, doc[live]]), np.concatenate([best_score, score[live]])
        top = np.lexsort((doc, -score))[:k]
        best_doc, best_score = doc[top], score[top]
        if len(top) == k:
            least = int(best_score[-1])
    return best_doc, best_score


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times) of the items, by the same rule as the documents' terms."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = only(items, item=id_col, text=text_col).where("item IS NOT NULL")
    return d.select("item", F.explode(F.regexp_extract_all(low, F.lit(PATTERN), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The k best documents for each item: (item_id, rank, doc_id, score), exact, equal scores by ascending id, scores above 0 only.

    Terms are runs of digits, letters and characters beyond ASCII of the whole text, only A-Z lower-cased. The score is that of the
    module's fixed values: a term's rarity times a whole-number impact of its occurrences and the document's length, repeats of a term in
    an item counted.

    A null or empty text has no terms: such a document is in no list and not counted, such an item has no rows. Rows with a null id cannot
    be named and take no part. Repeated document ids are documents of their own; rows that share an item id are one item. A very long text
    is a shard of its own. Empty tables give empty results. Further columns are not read.

    Two passes over the texts: counts of documents and terms, then the index of all terms, written as a table. A search reads the lists of
    the items' terms only. A task searches one shard for up to ``ITEMS`` items and hands on k documents for each; these heaps are merged
    in two steps.
    """
    d = only(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    all_docs, all_terms = corpus_size(d)
    index = cut(inverted_index(d, all_docs, all_terms))
    asked = cut(item_terms(items, item_col, item_text))
    kind = items.schema[item_col].dataType.simpleString()
    parts = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    part = F.pmod(stable_hash(F.col("item")), F.lit(parts)).cast("int")

    lists = index.where("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
    df = lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * all_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    uses = (asked.withColumn("part", part).join(df.select("term", weight.alias("w")), "term")
            .groupBy("term", "part").agg(F.collect_list(F.struct("item", (F.col("times") * F.col("w")).alias("w"))).alias("uses")))
    asked_lists = lists.drop("doc_ids", "sizes").join(uses, "term")
    shards = index.where("term IS NULL").select(F.col("shard").alias("in_shard"), "doc_ids", "sizes").withColumn("in_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(key, rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = {"item": [], "doc_id": [], "score": []}
        if len(rows) and len(shard):
            sizes = np.asarray(shard["sizes"].iloc[0], np.int64)
            ids = np.asarray(shard["doc_ids"].iloc[0], np.int64)
            here = Lists(rows, sizes, all_docs, all_terms)
            of_item: dict = {}
            for i, uses_ in enumerate(rows["uses"]):
                for u in uses_:
                    if u["w"]:
                        of_item.setdefault(u["item"], []).append((i, u["w"]))
            for item, own in of_item.items():
                own = np.array(own, np.int64)
                doc, score = best_documents(here, own[:, 0], own[:, 1], len(ids), k)
                found["item"] += [item] * len(doc)
                found["doc_id"] += ids[doc].tolist()
                found["score"] += score.tolist()
        return pd.DataFrame(found)
    got = asked_lists.groupBy("shard", "part").cogroup(shards.groupBy("in_shard", "in_part")).applyInPandas(search, f"item {kind}, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id")]
    got = got.withColumn("_p", F.pmod(stable_hash(F.col("doc_id")), F.lit(64)))
    got = got.withColumn("_r", F.row_number().over(Window.partitionBy("item", "_p").orderBy(*order))).where(F.col("_r") <= k)
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return got.select(F.col("item").alias(item_col), F.col("rank").cast("int"), "doc_id", "score")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS all_docs, sum(n)::bigint AS all_terms FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * any_value(all_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, g GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * all_docs) // all_terms))))::bigint AS score
      FROM q JOIN df USING (t) JOIN tf USING (t) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""


__all__ = ["best_documents", "corpus_size", "discard", "inverted_index", "ranked_search"]
