"""SimHash fingerprints and an exact search within a Hamming radius (native: DataFrame functions only)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.common import SPACE, cut

BITS = 128
LANE = 21                     # bits of a counter; three counters share one long
BLOCK_TERMS = 100_000         # terms counted in one set of lanes: 16 * 100,000 stays under 2**21
MAX_WEIGHT = 16
_SPREAD = 1 | 1 << 20 | 1 << 40
_ONES = 1 | 1 << 21 | 1 << 42


def fingerprints(texts: DataFrame, key_cols: list[str], text_col: str, bits: int = BITS, out: str = "fingerprint") -> DataFrame:
    """(keys, fingerprint as ``bits / 4`` lower-case hex digits) of whole texts; keys are unique.

    Terms are pairs of neighbouring words (lower-cased; runs of anything but the six ASCII white-space characters), a text of
    one word has that word; each occurrence votes with its length in characters, 16 at most, so the frequent short words
    weigh little. Bit i is set where the weight of the terms whose hash has bit i exceeds half of all weight. A null or
    empty text has no votes and the fingerprint 0; equal texts have equal fingerprints.

    Three 21-bit counters are added up in one long: multiplying three hash bits by ``1 + 2**20 + 2**40`` and masking puts
    them 21 bits apart. A text gives one partial row for each task and block of terms, so long texts do not meet.
    """
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    halves = range(bits // 64)
    w = texts.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key_cols)],
                     F.split(F.trim(F.lower(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACE, " "))), " ").alias("_w"))
    keys = [f"_k{i}" for i in range(len(key_cols))]
    pairs = F.arrays_zip(F.col("_w").alias("a"), F.slice(F.col("_w"), F.lit(2), F.greatest(F.lit(1), F.size("_w") - 1)).alias("b"))
    t = w.select(*keys, F.posexplode(pairs).alias("_pos", "_t"))
    a, b = F.col("_t.a"), F.col("_t.b")
    # the last word of a longer text starts no pair; an empty text keeps its one empty word, which has no weight
    t = t.where(b.isNotNull() | (F.col("_pos") == 0))
    hashes = [F.xxhash64(a, F.coalesce(b, F.lit("")), F.lit(h)).alias(f"_h{h}") for h in halves]
    t = t.select(*keys, F.expr(f"_pos div {BLOCK_TERMS}").alias("_block"),
                 F.least(F.lit(MAX_WEIGHT), F.length(a) + F.coalesce(F.length(b), F.lit(0))).cast("long").alias("_weight"), *hashes)
    lanes = {}
    for h in halves:
        for k in range(0, 64, 3):
            three = F.shiftrightunsigned(F.col(f"_h{h}"), k).bitwiseAND(F.lit(7 if k < 63 else 1))
            lanes[h, k] = F.sum((three * F.lit(_SPREAD)).bitwiseAND(F.lit(_ONES)) * F.col("_weight")).alias(f"_s{h}_{k}")
    by_block = t.groupBy(*keys, "_block").agg(F.sum("_weight").alias("_all"), *lanes.values())
    sums = [F.sum(F.shiftright(F.col(f"_s{h}_{i - i % 3}"), LANE * (i % 3)).bitwiseAND(F.lit((1 << LANE) - 1))).alias(f"_b{h}_{i}")
            for h in halves for i in range(64)]
    one = by_block.groupBy(*keys).agg(F.sum("_all").alias("_all"), *sums)
    digits = []
    for h in halves:
        value = F.lit(0).cast("long")
        for i in range(64):
            value = value.bitwiseOR(F.when(2 * F.col(f"_b{h}_{i}") > F.col("_all"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        digits.append(F.lpad(F.lower(F.hex(value)), 16, "0"))
    return one.select(*[F.col(k).alias(c) for k, c in zip(keys, key_cols)], F.concat(*digits).alias(out))


def _words(fp: Column, bits: int) -> list[Column]:
    """The fingerprint as longs of 32 bits each."""
    return [F.conv(F.substring(fp, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(bits // 32)]


def distance(a: Column, b: Column, bits: int = BITS) -> Column:
    """Hamming distance of two fingerprints."""
    out = F.lit(0)
    for x, y in zip(_words(a, bits), _words(b, bits)):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """1 minus the share of differing bits."""
    return 1.0 - distance(a, b, bits) / float(bits)


def within_radius(queries: DataFrame, stored: DataFrame, radius: int, id_col: str = "doc_id", fp_col: str = "fingerprint",
                  bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """Every pair (query_fp, stored_fp, distance) of distinct fingerprints within ``radius``, exactly.

    Fingerprints are cut into ``blocks`` parts (default ``radius + 2``). Within the radius at least ``blocks - radius``
    parts agree, so one table for each choice of that many parts, keyed by them, holds every pair. Equal fingerprints
    are one entry, so copies cost nothing; ids are found by joining the fingerprints with ``stored``.
    """
    blocks = blocks or radius + 2
    nibbles = bits // 4
    edges = [round(i * nibbles / blocks) for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        d = df.select(F.col(f"`{fp_col}`").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = [F.struct(F.lit(n).alias("t"), F.concat(*[F.substring(name, edges[i] + 1, edges[i + 1] - edges[i]) for i in parts]).alias("p"))
                for n, parts in enumerate(tables)]
        return d.select(name, F.explode(F.array(*keys)).alias("_key"))

    pairs = keyed(queries, "query_fp").join(keyed(stored, "stored_fp"), "_key")
    d = distance(F.col("query_fp"), F.col("stored_fp"), bits)
    return pairs.withColumn("distance", d).where(F.col("distance") <= radius).select("query_fp", "stored_fp", "distance").distinct()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch_rows: int = 2000,
              max_stretches: int = 65536) -> DataFrame:
    """(_id, _pos, _text, _next_id, _next_pos, _next): every text (null: empty) and its successor in ascending order of
    ids; after the last comes the first. Null ids come first, rows with equal ids follow each other by text, and ``_pos``
    tells them apart.

    The order is cut into stretches of about ``stretch_rows`` rows (more where that would give over ``max_stretches``): 4096
    equal ranges of ids are counted, and crowded ones get finer stretches. The smallest id of each stretch is thus a short
    broadcast table. The row that has it is sent to the stretch before as well, so one shuffle of the texts is enough.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    ids = docs.select(F.col(f"`{id_col}`").alias("_id"))
    ends = ids.agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = int(ends["lo"] or 0), int(ends["hi"] or 0)
    rows = max(stretch_rows, ends["n"] // max_stretches)
    coarse = max(1, -(-(hi - lo + 1) // 4096))
    at = F.expr(f"coalesce((_id - {lo}L) div {coarse}L, -1L)")
    sizes = ids.groupBy(at.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))           # at most 4097 rows
    sizes = sizes.select("_c", F.greatest(F.lit(1), F.expr(f"cast({coarse} as decimal(20)) * {rows} div _n")).cast("long").alias("_w"))

    def stretch(df: DataFrame) -> DataFrame:
        df = df.withColumn("_c", at).join(F.broadcast(sizes), "_c")
        return df.withColumn("_f", F.expr(f"coalesce((_id - {lo}L - _c * {coarse}L) div _w, 0L)")).drop("_w")

    heads = stretch(ids).groupBy("_c", "_f").agg(F.min("_id").alias("_least"))       # at most max_stretches + 4097 rows
    order = Window.partitionBy(F.lit(0)).orderBy("_c", "_f")
    ring = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct("_c", "_f")).over(order), F.last(F.struct("_c", "_f")).over(ring))
    heads = cut(heads.select("_c", "_f", "_least", before.alias("_before")))
    sent = stretch(d).join(F.broadcast(heads), ["_c", "_f"])
    here = F.struct("_c", "_f", F.lit(False).alias("tail"))
    back = F.struct(F.col("_before._c").alias("_c"), F.col("_before._f").alias("_f"), F.lit(True).alias("tail"))
    sent = sent.select("_id", "_text", F.explode(F.when(F.col("_id").eqNullSafe(F.col("_least")), F.array(here, back)).otherwise(F.array(here))).alias("_to"))
    sent = sent.select("_id", "_text", F.col("_to._c").alias("_c"), F.col("_to._f").alias("_f"), F.col("_to.tail").alias("_tail"))
    w = Window.partitionBy("_c", "_f").orderBy("_tail", F.col("_id").asc_nulls_first(), "_text")
    full = sent.select("_id", F.row_number().over(w).alias("_pos"), "_text", "_tail", F.lead("_id").over(w).alias("_next_id"),
                       F.when(F.lead("_tail").over(w), F.lit(1)).otherwise(F.row_number().over(w) + 1).alias("_next_pos"), F.lead("_text").over(w).alias("_next"))
    return full.where(~F.col("_tail")).drop("_tail")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last quarter (rounded down, in code points) gives
    way to the first as many code points of the next document: (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)."""
    n = F.char_length("_text")
    quarter = F.expr("char_length(_text) div 4").cast("int")
    d = with_next(docs, id_col, text_col)
    d = d.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), (n - quarter).cast("int")), F.substring(F.col("_next"), F.lit(1), quarter)))
    meta = ["_id", "_pos", "_next_id", "_next_pos", "_n", "_sha"]
    both = d.select("_id", "_pos", "_next_id", "_next_pos", n.cast("long").alias("_n"), F.unhex(F.sha2("_edited", 256)).alias("_sha"),
                    F.posexplode(F.array("_text", "_edited")).alias("_which", "_t"))
    prints = cut(fingerprints(both, [*meta, "_which"], "_t", bits))
    own = prints.where("_which = 0")
    edited = prints.where("_which = 1").select(F.col("_id").alias("_i"), F.col("_pos").alias("_p"), F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("_id").alias("_i2"), F.col("_pos").alias("_p2"), F.col("fingerprint").alias("_after"))
    out = (own.join(edited, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_pos") == F.col("_p")))
           .join(after, F.col("_next_id").eqNullSafe(F.col("_i2")) & (F.col("_next_pos") == F.col("_p2"))))
    fp = F.col("fingerprint")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.lower(F.hex("_sha")).alias("edited_sha256"), fp,
                      "edited_fingerprint", likeness(fp, F.col("edited_fingerprint"), bits).alias("near_edited"),
                      likeness(fp, F.col("_after"), bits).alias("near_next"))
