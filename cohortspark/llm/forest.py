"""Near-duplicate documents by an LSH forest over MinHash, with links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import cut, discard, text_slices
from cohortspark.llm.units import LOWER, distinct_sorted, mix, shingle_hashes, span_hashes, words
from cohortspark.operators.components import connected_components

WIDTH = 5
SIMILARITY = 0.8
MISS = 1e-6                # chance that a pair at the threshold shares no region, and that its sketch looks too different
DEPTH = 4
DEEPER = (6, 9)
CROWD = 64                 # a region with more entries is opened at greater depths
BLOCK = 1024               # entries of a region that one side of a comparison holds


def trees_for(depth: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """How many sorted orders make a pair at the threshold agree on ``depth`` values in one of them, but for ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-similarity**depth))


def sketch_floor(size: int, similarity: float = SIMILARITY) -> float:
    """Share of equal sketch bytes that a pair at the threshold falls below about once in a million."""
    return similarity - 4.9 * math.sqrt(similarity * (1 - similarity) / size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, and bounds. A-Z count as a-z."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    return distinct_sorted(*shingle_hashes(span_hashes(low, starts, ends), first, width))


def _over_rows(op, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``op.reduceat`` over non-empty rows; empty rows give 0."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = op.reduceat(values, bounds[full])
    return out


def features(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, keys, deeper, sketch): set size, 128-bit digest of the set, region keys of every tree at the base
    depth, the same at the deeper ones, one byte of each MinHash value."""
    trees = trees_for(DEPTH, similarity)
    size = trees * DEPTH
    factors = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                sets, bounds = shingle_sets(data, offsets, width)
                n = np.diff(bounds)
                least = np.stack([_over_rows(np.minimum, sets * f, bounds) for f in factors]) if len(n) else np.empty((size, 0), np.uint64)
                levels = []
                for depth in (DEPTH, *DEEPER):
                    tree = np.empty((trees, len(n)), np.uint64)
                    for t in range(trees):
                        key = np.full(len(n), t + 1000 * depth, np.uint64)
                        for j in range(depth):
                            key = mix(key + least[(t * DEPTH + j) % size])
                        tree[t] = key
                    levels.append(tree)
                sketch = (mix(least) & np.uint64(255)).astype(np.uint8).T.copy()
                d1, d2 = _over_rows(np.add, mix(sets ^ np.uint64(0x1234567)), bounds), _over_rows(np.add, mix(sets ^ np.uint64(0x89ABCDEF01)), bounds)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[0], pa.int32()), pa.array(np.ascontiguousarray(x.T).view(np.int64).ravel()))
                         for x in (levels[0], np.concatenate(levels[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *lists,
                     pa.array([x.tobytes() for x in sketch], pa.binary())], ["id", "n", "d1", "d2", "keys", "deeper", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, keys array<long>, deeper array<long>, sketch binary")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sizes and sketches allow the similarity."""
    small = sets.select("id", "n", "sketch")
    d = (pairs.join(small.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
         .join(small.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
         .where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9).select("a", "b", "sa", "sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = (x == y).mean(axis=1) >= sketch_floor(x.shape[1], similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    kind = sets.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"a {kind}, b {kind}")


def full_sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the named documents: the sorted distinct 64-bit shingle hashes of the whole text."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # rows that repeat an id repeat its text
    own = own.join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch, "text"):
                sets, bounds = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([sets[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())],
                                                 ["id", "set"])

    return own.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, set binary").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose full sets (id, set) have the similarity."""
    d = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
         .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb"))
    parts = round(similarity * 10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                keep.append(0 < 10000 * both >= parts * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    kind = sets.schema["id"].dataType.simpleString()
    return d.mapInArrow(run, f"a {kind}, b {kind}")


def _links_of_cell(left: list[tuple], right: list[tuple], same: bool, similarity: float) -> list[tuple]:
    """Links between the components of rows (id, comp, n, set): a forest, so at most one fewer than components.

    Intersection sizes are a product of two 0/1 tables over the shingles that several rows have, a few columns at a time.
    """
    rows = left if same else left + right
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    n = np.array([r[2] for r in rows])
    comps = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.concatenate([start, [len(values)]]))
    column = np.repeat(np.where(times > 1, np.cumsum(times > 1) - 1, -1), times)
    shared = column >= 0
    column, owner = column[shared], owner[shared]
    k = len(left)
    both = np.zeros((k, k if same else len(right)), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        table = np.zeros((len(rows), width), np.float32)
        table[owner[a:b], column[a:b] - lo] = 1
        both += table[:k] @ (table[:k] if same else table[k:]).T
    both = np.rint(both).astype(np.int64)
    n1, n2 = n[:k], n[:k] if same else n[k:]
    c1, c2 = comps[:k], comps[:k] if same else comps[k:]
    linked = (10000 * both >= round(similarity * 10000) * (n1[:, None] + n2[None, :] - both)) & (c1[:, None] != c2[None, :])
    # from rows to components, then a spanning forest breadth first: each newly reached component gets one link
    names = [r[1] for r in rows]
    first = np.unique(comps, return_index=True)[1]
    at = np.nonzero(linked)
    joined = np.zeros((len(first), len(first)), bool)
    joined[c1[at[0]], c2[at[1]]] = True
    joined |= joined.T
    fresh, out = joined.any(axis=1), []
    while fresh.any():
        edge = np.flatnonzero(fresh)[:1]
        fresh[edge] = False
        while len(edge):
            reached = np.flatnonzero(joined[edge].any(axis=0) & fresh)
            out += [(names[first[edge[i]]], names[first[j]]) for i, j in zip(joined[np.ix_(edge, reached)].argmax(axis=0), reached)]
            fresh[reached] = False
            edge = reached
    return out


def _search_regions(rows: DataFrame, similarity: float, kind: str) -> DataFrame:
    """Links (a, b) between the names of different components inside regions, by comparing full sets block by block.

    ``rows``: (key, held, id, comp, n, set, minor). A region of at most BLOCK rows is one cell. In a larger one the rows outside
    its largest component are its minor rows; each block of BLOCK minor rows meets every block of the region, and members of
    the largest component are never compared with each other. A task holds two blocks, whatever the size of the region.
    """
    per = rows.where(F.col("held") > BLOCK).groupBy("key").agg(F.ceil(F.sum(F.col("minor").cast("int")) / BLOCK).cast("int").alias("m"),
                                                               F.ceil(F.sum((~F.col("minor")).cast("int")) / BLOCK).cast("int").alias("g"))
    d = rows.join(per, "key", "left").withColumn("own", F.when(F.col("minor"), F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), "m"))
                                                              ).otherwise(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), "g"))).cast("int"))
    # cells (i, j): minor block i against minor block j >= i, or against block j - m of the largest component
    cell = F.expr("""CASE WHEN m IS NULL THEN array(named_struct('i', 0, 'j', 0, 'side', 0))
        WHEN minor THEN concat(transform(sequence(0, m - 1), x -> named_struct('i', least(own, x), 'j', greatest(own, x), 'side', IF(x < own, 1, 0))),
                               transform(sequence(0, g - 1), x -> named_struct('i', own, 'j', m + x, 'side', 0)))
        ELSE transform(sequence(0, m - 1), x -> named_struct('i', x, 'j', m + own, 'side', 1)) END""")
    cells = d.select("key", "id", "comp", "n", "set", F.explode(cell).alias("cell"))
    cells = cells.select("key", "cell.i", "cell.j", "cell.side", "id", "comp", "n", "set")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, type_ = None, ([], []), None

        def links() -> list[tuple]:
            if at is None or not sides[0]:
                return []
            same = at[1] == at[2]
            return _links_of_cell(sides[0], sides[1], same, similarity) if same or sides[1] else []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], type_), pa.array([max(x) for x in found], type_)], ["a", "b"])

        for batch in batches:
            type_, found = batch.column("id").type, []
            for key, i, j, side, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if at != (key, i, j):
                    found += links()
                    at, sides = (key, i, j), ([], [])
                sides[side].append(row)
            yield batch_of(found)
        if at is not None:
            yield batch_of(links())

    return cells.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): components of documents whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more; of each component the smallest id is kept.

    Words are runs of anything but the six ASCII white-space characters, with A-Z as a-z. A text with fewer than ``width``
    words has its whole sequence as the only shingle; a null or empty text has none, links with nothing and is kept. Rows
    with a null id take part in nothing and are kept. Rows that repeat an id should repeat its text. Shingles are 64-bit
    hashes. An empty table gives an empty result.

    1. Equal sets are one entry (128-bit digest), so copies cost nothing further.
    2. Each entry has a place in each sorted signature order; entries that share the first DEPTH values there are a region.
       The number of orders follows from the depth so that a pair at the threshold misses every shared region once in a
       million. Members meet the smallest id of their region. In a region of over CROWD entries, those that are like none
       of the smallest ids are opened at greater depths, where they meet entries with a longer common prefix. Pairs whose sizes or sketches forbid a link are left
       out, the others are confirmed on full sets and make a first set of components.
    3. Regions that still hold several components are searched through on full sets, block by block, for links between
       components (:func:`_search_regions`). So every pair that shares a region is either in one component already or has
       been tested; no bucket is capped, and no task lists pairs. Regions with the same members are searched once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    feats = cut(features(docs, width, similarity, id_col, text_col))
    full = feats.where("n > 0")
    classes = cut(full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")))
    sets = cut(full.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"]).dropDuplicates(["id"])
               .select("id", "n", "keys", "deeper", "sketch"))
    rows = sets.select(F.explode("keys").alias("key"), "id")
    regions = rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1")
    met = cut(rows.join(regions, "key"))          # entries that share a region with another one
    pairs = met.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    first = cut(_alike(pairs.distinct(), sets, similarity))
    # entries of crowded regions that are like none of the smallest ids there look for partners at greater depths
    settled = first.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    crowd = met.where(F.col("held") > CROWD).select("id").distinct().join(settled, "id", "left_anti")
    deep = sets.join(crowd, "id", "left_semi").select(F.explode("deeper").alias("key"), "id")
    inner = deep.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1")
    deeper = deep.join(inner, "key").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    first = first.unionByName(_alike(deeper.distinct(), sets, similarity)).distinct()
    whole = cut(full_sets(docs, met.select("id").distinct(), width, id_col, text_col))
    links = cut(confirm(first, whole, similarity))
    comps = cut(connected_components(links))

    # regions that hold several components
    named = met.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "held", "id", F.coalesce("component", "id").alias("comp"))
    named = cut(named)
    mixed = (named.groupBy("key", "held").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                              F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("lo <> hi"))
    mixed = mixed.groupBy("x", "y", "held").agg(F.min("key").alias("key")).select("key")
    inside = region_rows = cut(named.join(mixed, "key"))
    tally = inside.where(F.col("held") > BLOCK).groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = tally.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    inside = inside.join(main, "key", "left").withColumn("minor", F.coalesce(F.col("comp") != F.col("main"), F.lit(True)))
    # an entry meets its set once, with the list of its regions (one for each order at most), and only then goes to each of them
    listed = inside.groupBy("id", "comp").agg(F.collect_list(F.struct("key", "held", "minor")).alias("at"))
    listed = listed.join(sets.select("id", "n"), "id").join(whole, "id")
    inside = listed.select("id", "comp", "n", "set", F.explode("at").alias("at")).select("at.key", "at.held", "id", "comp", "n", "set", "at.minor")
    more = cut(_search_regions(inside, similarity, kind))
    discard(docs.sparkSession, sets, met, whole, named, region_rows)
    if more.take(1):
        comps = cut(connected_components(links.unionByName(more)))

    member = feats.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    out = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    out = out.withColumn("kept", F.col(id_col) == F.col("component_id"))
    lone = docs.where(F.col(f"`{id_col}`").isNull()).select(F.col(f"`{id_col}`").alias(id_col), F.lit(None).cast("long").alias("n_shingles"),
                                                           F.lit(None).cast(kind).alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(lone)


def sql(width: int = 2) -> str:
    """The same components by all pairs that share a shingle, in DuckDB; for widths of 2."""
    if width != 2:
        raise ValueError("written for pairs of words")
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
k AS (SELECT s.doc_id, s.g, n.n FROM s JOIN shared USING (g) JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS common
      FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n),
e AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (total - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id AND r.c < u.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
