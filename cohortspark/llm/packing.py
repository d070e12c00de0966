"""Best-fit packing by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, dense_ranks, text_slices
from cohortspark.llm.tokens import crc, encoder

CAPACITY = 2048
END_ID = 0


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: (doc_id, row, piece, start, length, ids_crc32[, ids]).

    Ids come from the tokenizers library plus one end id, so a null or empty text has one token. A text of more than
    ``capacity`` ids is cut into pieces of that length, of which the first may be shorter.
    """
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch, "text"):
                ids, bounds = encode(data, offsets)
                rows, cols = [], ([], [], [], [], [])
                for k in range(end - first):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(END_ID))
                    n = len(own)
                    head = n % capacity or capacity
                    cuts = [0, *range(head, n + 1, capacity)] if n > capacity else [0, n]
                    for i in range(len(cuts) - 1):
                        part = own[cuts[i]:cuts[i + 1]]
                        rows.append(first + k)
                        for col, v in zip(cols, (i, cuts[i], len(part), crc(part), part.tobytes() if with_ids else None)):
                            col.append(v)
                arrays = [ids_of.take(pa.array(rows, pa.int64())), *[pa.array(c, f.type) for c, f in zip(cols, fields)]]
                names = ["doc_id", *[f.name for f in fields]]
                if with_ids:
                    arrays.append(pa.array(cols[4], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return src.mapInArrow(run, schema)


def _fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, from those available) whose sum is the largest that fits ``room``.

    Bit i of ``reach`` says whether a sum of i can be made. Longer lengths come first, so short ones stay for later bins;
    the sums before each item are kept to trace one combination back.
    """
    reach, steps, mask, full = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | (reach << length)) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach & full:
                break
        if reach & full:
            break
    left, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            out.append(length)
            left -= length
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in each) for ``histogram`` (length -> pieces).

    Minimum bin slack: the longest piece left opens a bin, and the fullest feasible combination of the other lengths joins
    it. The same combination stays best while its lengths last, so it is taken as often as they allow; each step uses up
    a length. The plan has at most one step for each length and slack, however many pieces there are.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        own = [top, *_fullest({k: v for k, v in left.items() if v}, capacity - top)]
        left[top] += 1
        need = {x: own.count(x) for x in set(own)}
        times = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        out.append((times, own))
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to rows with a ``length`` of 1 to ``capacity``: gapless places in as few sequences as
    it can. ``parts`` is read several times, so it should be a written table.

    The histogram of lengths (at most ``capacity`` numbers) is all that the driver sees; minimum bin slack turns it into
    bin patterns. Pieces are numbered within their length, and a range of these numbers belongs to one place of a
    pattern. Numbering is done in hash blocks, so a length that a third of the pieces share is many blocks.
    """
    spark = parts.sparkSession
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, used, base = [], {}, 0
    for times, lengths in plan(histogram, capacity):
        at = 0
        for x in lengths:
            r = used.get(x, 0)
            slots.append((x, r, r + times, base - r, at))
            used[x] = r + times
            at += x
        base += times
    # a place of a pattern: at most `capacity` lengths times the steps of the plan, whatever the number of pieces
    table = spark.createDataFrame(slots, "_len long, _from long, _to long, _shift long, _at long")
    keys = [c for c in parts.columns if c != "length"]
    ranked = dense_ranks(parts, ["length"], keys, "_rank")
    one = ranked.join(F.broadcast(table), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return one.select(*parts.columns, (F.col("_rank") + F.col("_shift")).alias("sequence_id"), F.col("_at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    An empty table gives no rows; repeated rows are packed each on its own; null ids are kept.
    """
    return pack(cut(pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>), each of at most ``capacity`` ids."""
    parts = pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    got = packed.join(parts, ["doc_id", "piece", "ids_crc32"]).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int64).tolist() for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return got.mapInArrow(run, "sequence_id long, ids array<int>")
