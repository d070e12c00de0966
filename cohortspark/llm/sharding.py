"""Balanced label propagation: documents with equal texts move to one shard while the bytes of the shards stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortspark.llm.common import cut, dense_ranks, discard, uniform

STILL = 2                  # rounds in which no small group moves, after which the labels have settled
LARGE_SHARE = 200          # a row of over 1/200 of a shard's bytes is placed on its own
OVERHEAD = 16


def _propagate(linked: DataFrame, loads: dict[int, int], cap: float, seed: int) -> DataFrame:
    """One round over (_row, _size, _group, _shard): the same rows with their new shards, ``_go`` on those of small groups that moved."""
    spark = linked.sparkSession
    table = spark.createDataFrame(sorted(loads.items()), "_shard int, _load long")
    votes = linked.groupBy("_group", "_shard").agg(F.sum("_size").alias("_bytes"))
    every = votes.groupBy("_group").agg(F.sum("_bytes").alias("_all"), F.count(F.lit(1)).alias("_spread")).where("_spread > 1")
    split = cut(votes.join(every, "_group").join(F.broadcast(table), "_shard").drop("_load", "_spread").withColumn("_room", F.greatest(F.lit(0.0), F.lit(cap) - F.element_at(
        F.create_map(*[F.lit(x) for kv in sorted(loads.items()) for x in kv]), F.col("_shard")))))
    # a large group (over a twentieth of the cap) moves row by row, a smaller one as a whole
    large = F.col("_all") > cap / 20
    fits = F.when(large, F.col("_room") > cap / 20).otherwise(F.col("_room") >= F.col("_all") - F.col("_bytes"))
    # the goal is the shard with most of the group's bytes among those that hold what must move; a fixed draw breaks ties
    own = F.max(F.when(fits, F.struct(F.col("_bytes").alias("b"), uniform(F.col("_group"), F.col("_shard"), F.lit(seed)).alias("u"), F.col("_shard").alias("s"), F.col("_room").alias("r"))))
    goal = split.groupBy("_group", "_all").agg(own.alias("_g"))
    # a small group that none of its own shards can hold goes to any shard that has room for all of it
    rooms = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(max(0.0, cap - b)).alias("r")) for s, b in sorted(loads.items())])
    wide = F.filter(rooms, lambda e: e["r"] >= F.col("_all"))
    other = F.when(~large & (F.size(wide) > 0), F.get(wide, F.floor(uniform(F.col("_group"), F.lit(seed + 1)) * F.size(wide)).cast("int")))
    goal = goal.withColumn("_o", other).where("_g IS NOT NULL OR _o IS NOT NULL").select(
        "_group", F.coalesce("_g.s", "_o.s").alias("_to"), F.coalesce("_g.r", "_o.r").alias("_room"), F.coalesce("_g.b", F.lit(0)).alias("_there"),
        (F.col("_all") - F.coalesce("_g.b", F.lit(0))).alias("_away"), large.alias("_large"))
    # quota: the bytes that want to enter a shard share its room by a fixed draw, so what enters keeps near its mean; what leaves is room
    # of the next round
    wanted = goal.groupBy("_to").agg(F.sum("_away").alias("_want"))
    goal = goal.join(F.broadcast(wanted), "_to").withColumn("_p", F.least(F.lit(1.0), 0.8 * F.col("_room") / F.greatest(F.lit(1), F.col("_want")))).drop("_want", "_room")
    mine = split.select("_group", "_shard", F.col("_bytes").alias("_here"))
    moved = linked.join(goal, "_group", "left").join(mine, ["_group", "_shard"], "left")
    draw = F.when(F.col("_large"), uniform(F.col("_row"), F.lit(seed))).otherwise(uniform(F.col("_group"), F.lit(seed)))
    go = F.col("_to").isNotNull() & (F.col("_to") != F.col("_shard")) & (~F.col("_large") | (F.col("_there") >= F.col("_here"))) & (draw < F.col("_p"))
    go = F.coalesce(go, F.lit(False))
    return moved.select("_row", "_size", "_group", F.when(go, F.col("_to")).otherwise(F.col("_shard")).alias("_shard"), (go & ~F.col("_large")).alias("_go"))


def _loads(df: DataFrame, shards: int) -> dict[int, int]:
    """Bytes by shard: one short row for each shard."""
    got = {r["_shard"]: r["_b"] for r in df.groupBy("_shard").agg(F.sum("_size").alias("_b")).collect()}
    return {s: int(got.get(s, 0)) for s in range(shards)}


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``: sizes of shards are near equal.

    Size is the UTF-8 bytes of the text (null: none) plus 16. Rows with equal texts are linked; a null text equals the
    empty text. Ids may be null or repeated; each row gets its own slot. An empty table gives an empty result.

    1. Rows with a link start in a shard by hash. In each round a split group votes by bytes: its goal is the shard with most of its
       bytes among those with room for the rest (a small group without one goes to any shard with room for all of it), and its
       other rows move there under a quota. Rounds go on until no group that can be whole moves any more; groups of over a
       twentieth of a shard gather row by row meanwhile, in shards with that much room. Rounds are joins of short rows (id, size,
       group, shard), written to the shared folder.
    2. Linked rows may fill each shard up to the mean. If a round overshot, the surplus share of that shard's rows is released by
       a fixed draw.
    3. Rows without a link (and released ones) fill up. Those of over 1/200 of a shard are at most 200 for each shard and
       go one by one, largest first, to the emptiest shard; the others are laid end to end in hash order, and each shard
       takes the stretch that it lacks, so it ends within 1/100 of the mean.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"),
                       F.crc32(text.cast("binary")).alias("_crc"), F.md5(text.cast("binary")).alias("_group"))
    # repeated rows get a number of their own, so every row is a node
    same = Window.partitionBy("_id", "_group").orderBy("_size")
    base = base.withColumn("_row", F.xxhash64(F.col("_id"), F.col("_group"), F.row_number().over(same)))
    base = cut(base)
    groups = base.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    base = base.join(groups, "_group").withColumn("_linked", F.col("_n") > 1).drop("_n")
    base = cut(base)
    sums = base.agg(F.sum("_size").alias("a"), F.sum(F.when(F.col("_linked"), F.col("_size"))).alias("l")).first()
    total, in_links = int(sums["a"] or 0), int(sums["l"] or 0)
    mean = total / shards
    cap = mean

    linked = cut(base.where("_linked").select("_row", "_size", "_group")
                 .withColumn("_shard", F.floor(uniform(F.col("_row"), F.lit(99)) * shards).cast("int")))
    held = _loads(linked, shards) if in_links else dict.fromkeys(range(shards), 0)
    still = seed = 0
    while in_links and still < STILL:
        before, linked = linked, cut(_propagate(linked, held, cap, 2 * seed))
        discard(spark, before)
        seed += 1
        still = 0 if linked.where("_go").limit(1).count() else still + 1
        held = _loads(linked, shards)
    linked = linked.drop("_go") if in_links else linked
    for i in range(20):
        over = {s: (b - mean) / b for s, b in held.items() if b > mean}
        if not over:
            break
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in over.items() for x in kv]), F.col("_shard")), F.lit(0.0))
        linked = cut(linked.where(uniform(F.col("_row"), F.lit(1000 + i)) >= F.least(F.lit(1.0), 1.1 * share + 1e-6)))
        held = _loads(linked, shards)

    free = cut(base.select("_row", "_size").join(linked.select("_row"), "_row", "left_anti"))
    # at most 200 rows for each shard can be this large
    large = [(r["_row"], r["_size"]) for r in free.where(F.col("_size") > mean / LARGE_SHARE).collect()]
    placed = []
    for row, size in sorted(large, key=lambda x: (-x[1], x[0])):
        to = min(held, key=lambda s: (held[s], s))
        held[to] += size
        placed.append((row, to))
    small = dense_ranks(free.where(F.col("_size") <= mean / LARGE_SHARE).withColumn("_all", F.lit(0)), ["_all"], ["_row"], "_before", "_size")
    # fill to one level: the level that the rest of the bytes reaches over the shards as they stand
    rest = total - sum(held.values())
    level, below = mean, sorted(held.values())
    for k in range(shards, 0, -1):
        level = (rest + sum(below[:k])) / k
        if below[k - 1] <= level:
            break
    edges, at = [], 0.0
    for s in range(shards):
        at += max(0.0, level - held[s])
        edges.append(at)
    # the shard of a stretch: how many edges lie at or before the row (an array of one number for each shard)
    stretch = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("_before").cast("double"))), F.lit(shards - 1))
    fits = [F.struct("_row", stretch.cast("int").alias("_shard"))]
    small = small.select(*[f.alias("x") for f in fits]).select("x.*")
    placed_df = spark.createDataFrame(placed, T.StructType([T.StructField("_row", T.LongType()), T.StructField("_shard", T.IntegerType())]))
    where = linked.select("_row", "_shard").unionByName(small).unionByName(placed_df)
    full = cut(base.drop("_linked", "_group").join(where, "_row"))
    ranked = dense_ranks(full, ["_shard"], ["_row"], "_slot")
    return ranked.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                         F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
