"""Bootstrap and permutation nulls as replicate tables.

A design is a DataFrame: one row per (replicate, unit), drawn by a shared hash so that any engine gets the same design
and a lost executor recomputes the same rows. Statistics are ordinary grouped aggregates with ``rep`` as one more key,
so replicates spread over the cluster like any other group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.ordering import midrank, ordered_counts, range_index, weighted_midrank
from cohortspark.functions.scalars import c, fisher_z, hash_key, hash_sign, hash_u32, ratio
from cohortspark.operators.association import partial_r, pearson, weighted_rank_corr, weighted_rank_matrix
from cohortspark.session import cut, spread


def _reps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")


def index_units(units: DataFrame, unit: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct units with a 0-based index and the number of units per group."""
    return range_index(units.select(*by, unit).distinct(), unit, by)


def bootstrap_weights(rows: DataFrame, unit: str, reps: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """How often each unit is drawn in each of ``reps`` resamples with replacement: (by, rep, unit, _w), units drawn at least once.

    A group of n units draws n slots; the unit of a slot comes from a hash of (group, replicate, slot).
    """
    by = list(by)
    idx = index_units(rows, unit, by)
    draw = idx.select(*by, "_n", F.col("_idx").alias("slot"), _reps(reps)).select(
        *by, "rep", (hash_u32(*by, "rep", "slot", F.lit(seed)) % F.col("_n")).alias("_idx"))
    times = draw.groupBy(*by, "rep", "_idx").agg(F.count(F.lit(1)).alias("_w"))
    return cut(times.join(idx.select(*by, unit, "_idx"), [*by, "_idx"]).select(*by, "rep", unit, "_w"))


def permuted_labels(units: DataFrame, unit: str, label: str, reps: int, seed: int = 0, by: Sequence[str] = (),
                    within: Sequence[str] = ()) -> DataFrame:
    """Labels re-dealt among units, optionally only inside ``within`` groups: (by, rep, unit, label)."""
    part = [*by, *within]
    idx = (units.select(*part, unit, label)
           .withColumn("_idx", F.row_number().over(Window.partitionBy(*part).orderBy(unit))))
    deal = (idx.select(*part, unit, _reps(reps))
            .withColumn("_idx", F.row_number().over(
                Window.partitionBy(*part, "rep").orderBy(hash_key(unit, "rep", F.lit(seed)), unit))))
    return deal.join(idx.select(*part, "_idx", label), [*part, "_idx"]).select(*part, "rep", unit, label)


def hash_positions(rows: DataFrame, ids: Sequence[str], reps: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """0-based position of every row in a hash order, per replicate, for groups of any size.

    The order is cut into 65,536 slices by the leading hash digits, so a task orders that part of a group; positions are counted inside a slice and slice
    totals are added on, so no task orders a whole group.
    """
    d = rows.select(*by, *ids, _reps(reps)).withColumn("_h", hash_key(*ids, "rep", F.lit(seed)))
    d = d.withColumn("_s", F.substring("_h", 1, 4))
    part = [*by, "rep"]
    tot = d.groupBy(*part, "_s").agg(F.count(F.lit(1)).alias("_k"))
    tot = tot.withColumn("_off", F.sum("_k").over(Window.partitionBy(*part).orderBy("_s")) - F.col("_k")).drop("_k")
    inside = F.row_number().over(Window.partitionBy(*part, "_s").orderBy("_h", *ids))
    return (d.withColumn("_in", inside).join(tot, [*part, "_s"])
            .select(*by, "rep", *ids, (F.col("_in") - 1 + F.col("_off")).alias("pos")))


def block_permuted_labels(rows: DataFrame, unit: str, member: str, label: str, reps: int, seed: int = 0) -> DataFrame:
    """Whole label blocks move between units with equally many members.

    Member j of a unit takes the label of member j of the unit dealt to it.
    """
    pos = rows.withColumn("_j", F.row_number().over(Window.partitionBy(unit).orderBy(member)))
    size = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("_size"))
    deal = permuted_labels(size.withColumn("_from", F.col(unit)), unit, "_from", reps, seed, within=["_size"])
    src = pos.select(F.col(unit).alias("_from"), "_j", label)
    return deal.join(pos.select(unit, member, "_j"), unit).join(src, ["_from", "_j"]).select("rep", unit, member, label)


# ------------------------------------------------------------------ statistics per replicate

# A statistic is called with rows and grouping columns. With ``weight`` each row stands for that many equal rows; values named in
# ``stat.ranked`` then come as codes (:func:`coded`), so no replicate copies rows or sorts values.

def coded(rows: DataFrame, stat, by: Sequence[str] = ()) -> DataFrame:
    """The rows with a rank code for each value that the statistic ranks."""
    return _with_codes(rows, getattr(stat, "ranked", ()), by)


def _with_codes(rows: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    base = rows
    for x in names:   # merged by sort: a table of codes is as long as the rows, which no driver should hold for a broadcast
        codes = ordered_counts(base, x, by).select(*by, x, F.col("_below").alias(f"_code_{x}"))
        rows = rows.join(codes.hint("merge"), [*by, x], "left")
    return rows


def _weighted(weight: str | None):
    """Aggregates (mean, covariance) of rows, or of rows with whole-number weights; rows with a null do not count."""
    if weight is None:
        return F.avg, lambda x, y: F.covar_pop(x, y)

    def total(ok, v):
        return F.sum(F.when(ok, F.col(weight) * v))

    def mean(x):
        return ratio(total(c(x).isNotNull(), c(x)), total(c(x).isNotNull(), F.lit(1)))

    def covar(x, y):
        ok = c(x).isNotNull() & c(y).isNotNull()
        n = total(ok, F.lit(1))
        return ratio(total(ok, c(x) * c(y)) - ratio(total(ok, c(x)) * total(ok, c(y)), n), n)
    return mean, covar


def rank_corr(x: str, y: str) -> Callable[..., DataFrame]:
    def stat(d: DataFrame, part: Sequence[str], weight: str | None = None) -> DataFrame:
        if weight is not None:
            return weighted_rank_corr(d, f"_code_{x}", f"_code_{y}", part, weight).withColumnRenamed("rho", "stat").drop("n")
        r = d.select(*part, midrank(x, part).alias("_x"), midrank(y, part).alias("_y"))
        return r.groupBy(*part).agg(pearson("_x", "_y").alias("stat"))
    stat.ranked = (x, y)
    stat.of_ranks = F.col("r_0_1")
    return stat


def partial_rank_corr(x: str, y: str, given: Sequence[str]) -> Callable[..., DataFrame]:
    """Rank correlation of two values at equal ranks of one or two others."""
    names = [x, y, *given]
    of_ranks = partial_r("r_0_1", "r_0_2", "r_1_2")
    if len(names) == 4:
        of_ranks = partial_r(of_ranks, partial_r("r_0_3", "r_0_2", "r_2_3"), partial_r("r_1_3", "r_1_2", "r_2_3"))

    def stat(d: DataFrame, part: Sequence[str], weight: str | None = None) -> DataFrame:
        if weight is None:
            d, weight = coded(d, stat, part).withColumn("_w", F.lit(1)), "_w"
        r = weighted_rank_matrix(d, [f"_code_{v}" for v in names], part, weight)
        return r.select(*part, of_ranks.alias("stat"))
    if len(names) not in (3, 4):
        raise ValueError("one or two covariates")
    stat.ranked = tuple(names)
    stat.of_ranks = of_ranks
    return stat


def mean_gap(x: str, group: str, a: str, b: str) -> Callable[..., DataFrame]:
    def stat(d: DataFrame, part: Sequence[str], weight: str | None = None) -> DataFrame:
        mean = _weighted(weight)[0]
        return d.groupBy(*part).agg((mean(F.when(F.col(group) == b, F.col(x))) - mean(F.when(F.col(group) == a, F.col(x)))).alias("stat"))
    return stat


def ols_slope(x: str, y: str) -> Callable[..., DataFrame]:
    def stat(d: DataFrame, part: Sequence[str], weight: str | None = None) -> DataFrame:
        covar = _weighted(weight)[1]
        d = d.where(F.col(x).isNotNull() & F.col(y).isNotNull()) if weight else d
        return d.groupBy(*part).agg(ratio(covar(x, y), covar(x, x)).alias("stat"))
    return stat


def auc_stat(positive: str, score: str) -> Callable[..., DataFrame]:
    def stat(d: DataFrame, part: Sequence[str], weight: str | None = None) -> DataFrame:
        if weight is None:
            r = d.withColumn("_r", midrank(score, part)).withColumn("_p", F.col(positive).cast("int"))
            g = r.groupBy(*part).agg(F.sum("_p").alias("_a"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_p") * F.col("_r")).alias("_s"))
        else:   # values with their positives are enough
            v = weighted_midrank(d, f"_code_{score}", part, weight, [F.sum(F.col(positive).cast("int") * F.col(weight)).alias("_pos")])
            g = v.groupBy(*part).agg(F.sum("_pos").alias("_a"), F.sum("_cnt").alias("_n"), F.sum(F.col("_pos") * F.col("_rank")).alias("_s"))
        b = F.col("_n") - F.col("_a")
        return g.select(*part, ratio(F.col("_s") - F.col("_a") * (F.col("_a") + 1) / 2.0, F.col("_a") * b).alias("stat"))
    stat.ranked = (score,)
    return stat


# ------------------------------------------------------------------ rank matrices of all replicates

REP_BLOCK = 64              # replicates that a task takes at a time
DRAWS = 1 << 16             # draws of one row
GROUP_ROWS = 1 << 22        # rows of a group that a task ranks; longer groups go row by row through weighted_rank_matrix
BLOCK_ROWS = 1 << 24        # rows of all groups on the same draws that a task reads


def _drawn_weights(idx: DataFrame, by: Sequence[str], reps: int, seed: int) -> DataFrame:
    """The draws of :func:`bootstrap_weights`, packed: (by, _block, rep, _n, _w), where _w holds a whole number for each unit in their order."""
    size = idx.select(*by, "_n").distinct().select(*by, "_n", _reps(reps))
    runs = spread(size, *by, "rep").select("*", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / DRAWS).cast("int"))).alias("_run"))
    first = F.col("_run").cast("bigint") * DRAWS
    picks = F.transform(F.sequence(first, F.least(first + DRAWS, F.col("_n")) - 1),
                        lambda slot: (hash_u32(*by, "rep", slot, F.lit(seed)) % F.col("_n")).cast("int"))
    d = runs.select(*by, "rep", F.floor(F.col("rep") / REP_BLOCK).cast("int").alias("_block"), F.col("_n").cast("int").alias("_n"), "_run", picks.alias("_picks"))
    kept = (*by, "_block", "rep", "_n")
    schema = T.StructType([*[d.schema[x] for x in kept], T.StructField("_w", T.BinaryType())])

    def count(batches):   # the runs of a replicate follow each other
        w = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = row["_n"][0].as_py()
                if row["_run"][0].as_py() == 0:
                    w = np.zeros(n, np.int64)
                w += np.bincount(row["_picks"].flatten().to_numpy(), minlength=n)
                if (row["_run"][0].as_py() + 1) * DRAWS >= n:
                    held = w.astype(np.uint8 if w.max() < 256 else np.uint32).tobytes()
                    yield pa.RecordBatch.from_arrays([*[row[x] for x in kept], pa.array([held], pa.binary())], names=schema.names)
    return d.mapInArrow(count, schema)


def _weights_at(held: pa.Scalar, n: int, at: np.ndarray) -> np.ndarray:
    """Weights of the rows of units ``at``; a row without a unit has none."""
    raw = held.as_buffer()
    w = np.append(np.frombuffer(raw, np.uint8 if raw.size == n else np.uint32), 0)
    return w[at].astype(float)


def _rank_products(sets: Sequence[Sequence[int]], codes: Sequence[np.ndarray], full: Sequence[np.ndarray | None], w: np.ndarray) -> list[float | None]:
    """For each set of code arrays the summed weight and the correlations of their weighted midranks, pair by pair; rows without a code count in none."""
    out, seen = [], {}
    for names, ok in zip(sets, full):
        v = w if ok is None else w * ok
        total = v.sum()
        dev = []
        for i in names:
            if (i, id(ok)) not in seen:
                count = np.bincount(codes[i], weights=v)
                seen[i, id(ok)] = (2 * np.cumsum(count) - count - total)[codes[i]]   # twice the distance from the mean rank
            dev.append(seen[i, id(ok)])
        s = [[float(np.dot(v * a, b)) for b in dev] for a in dev]
        out.append(float(total))
        for i, j in combinations(range(len(names)), 2):
            down = math.sqrt(s[i][i]) * math.sqrt(s[j][j])
            out.append(s[i][j] / down if down else None)
    return out


def resampled_ranks(rows: DataFrame, unit: str, sets: Sequence[Sequence[str]], reps: int, seed: int = 0, by: Sequence[str] = (),
                    part: Sequence[str] | None = None, units: DataFrame | None = None) -> list[DataFrame]:
    """For each set of values their weighted rank matrix in every resample: (part, rep, n, r_i_j), replicate -1 being the rows as they are.

    Units are drawn as in :func:`bootstrap_weights`, from ``units`` or the rows, inside groups ``by``; ranks are taken inside groups ``part``
    (``by`` and more, if given). Values are coded once. Codes of a group and weights of a replicate are packed to a few bytes a row, and a
    task takes a block of replicates: each is a count by code and a running sum, so no replicate is shuffled or sorted row by row. Groups of
    more than GROUP_ROWS rows are ranked by :func:`weighted_rank_matrix`, in which no task holds a group.
    """
    by, part = list(by), list(by if part is None else part)
    names = sorted({x for s in sets for x in s})
    idx = index_units(rows if units is None else units, unit, by)
    d = rows.select(*dict.fromkeys([*part, unit, *names]))
    d = cut(_with_codes(d, names, part).join(idx.select(*by, unit, F.col("_idx").cast("int").alias("_at")).hint("merge"), [*by, unit], "left")
            .select(*part, unit, "_at", *[f"_code_{x}" for x in names]))
    for x in part:
        d = d.where(F.col(x).isNotNull())
    sizes = d.groupBy(*part).agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.groupBy(*by).agg(F.max("_k").alias("_k"), F.sum("_k").alias("_all")).agg(F.max("_k"), F.max("_all")).first()
    if (sizes[0] or 0) > GROUP_ROWS or (sizes[1] or 0) > BLOCK_ROWS:
        once = d.withColumn("_w", F.lit(1).cast("bigint")).withColumn("rep", F.lit(-1))
        w = bootstrap_weights(rows if units is None else units, unit, reps, seed, by)
        both = once.unionByName(w.join(d, [*by, unit]).select(*once.columns))
        return [cut(weighted_rank_matrix(both, [f"_code_{x}" for x in s], [*part, "rep"], "_w")) for s in sets]
    code = [f"_code_{x}" for x in names]
    keys = d.select(*part).schema.fields
    packed = T.StructType([*keys, T.StructField("_at", T.BinaryType()), *[T.StructField(x, T.BinaryType()) for x in code]])

    def pack(table: pa.Table) -> pa.Table:
        head = [table[x].slice(0, 1) for x in part]
        return pa.table([*head, *[pa.array([pc.fill_null(table[x], -1).to_numpy().astype(np.int32).tobytes()], pa.binary()) for x in ("_at", *code)]],
                        names=packed.names)

    blocks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // REP_BLOCK))).alias("_block")
    groups = d.withColumn("_g", F.lit(0)).groupBy("_g", *part).applyInArrow(pack, packed).select("*", blocks)
    on = [*by, "_block"]
    right = groups.select(*[F.col(x).alias(f"{x}_r") for x in on], *[x for x in groups.columns if x not in on or x in part])
    where = [[names.index(x) for x in s] for s in sets]
    values = [f"_s{k}_{v}" for k, s in enumerate(sets) for v in ("n", *[f"r_{i}_{j}" for i, j in combinations(range(len(s)), 2)])]
    schema = T.StructType([*keys, T.StructField("rep", T.IntegerType()), *[T.StructField(x, T.DoubleType()) for x in values]])

    def ranked(drawn: pa.Table, held: pa.Table) -> pa.Table:
        found, at_rows = [], []
        for g in range(held.num_rows):
            at = np.frombuffer(held["_at"][g].as_py(), np.int32)
            codes = [np.frombuffer(held[x][g].as_py(), np.int32) for x in code]
            full = [None if all((codes[i] >= 0).all() for i in s) else np.logical_and.reduce([codes[i] >= 0 for i in s]) for s in where]
            codes = [np.maximum(x, 0) for x in codes]
            jobs = [(drawn["rep"][r].as_py(), r) for r in range(drawn.num_rows)]
            if held["_block_r"][g].as_py() == 0:
                jobs.append((-1, None))
            for rep, r in jobs:
                w = np.ones(len(at)) if r is None else _weights_at(drawn["_w"][r], drawn["_n"][r].as_py(), at)
                found.append(_rank_products(where, codes, full, w))
                at_rows.append((g, rep))
        take = pa.array([g for g, _ in at_rows], pa.int64())
        return pa.table([*[held[x].take(take) for x in part], pa.array([r for _, r in at_rows], pa.int32()),
                         *[pa.array([f[k] for f in found], pa.float64()) for k in range(len(values))]], names=schema.names)

    left = spread(_drawn_weights(idx, by, reps, seed), *on)
    got = cut(left.groupBy(*on).cogroup(spread(right, *[f"{x}_r" for x in on]).groupBy(*[f"{x}_r" for x in on])).applyInArrow(ranked, schema))
    return [got.where(F.col(f"_s{k}_n") > 0).select(*part, "rep", F.col(f"_s{k}_n").cast("bigint").alias("n"),
                                                    *[F.col(f"_s{k}_r_{i}_{j}").alias(f"r_{i}_{j}") for i, j in combinations(range(len(s)), 2)])
            for k, s in enumerate(sets)]


def _resampled(rows: DataFrame, unit: str, stats: Sequence, reps: int, seed: int, by: Sequence[str]) -> list[tuple[DataFrame, DataFrame]]:
    """For each statistic its observed value and its values on the same resamples of units."""
    by = list(by)
    ranks = [s for s in stats if hasattr(s, "of_ranks")]
    sets = list(dict.fromkeys(s.ranked for s in ranks))
    matrix = dict(zip(sets, resampled_ranks(rows, unit, sets, reps, seed, by))) if sets else {}
    weights = bootstrap_weights(rows, unit, reps, seed, by) if len(ranks) < len(stats) else None
    out = []
    for stat in stats:
        if hasattr(stat, "of_ranks"):
            r = matrix[stat.ranked].select(*by, "rep", stat.of_ranks.alias("stat"))
            seen = r.where("rep < 0").select(*by, "stat")
            out.append((seen if by else seen.agg(F.max("stat").alias("stat")), r.where("rep >= 0")))   # one row without groups
            continue
        d = coded(rows, stat, by)
        d = cut(d) if getattr(stat, "ranked", ()) else d
        out.append((stat(d.withColumn("_w", F.lit(1)), by, "_w"), stat(weights.join(d, [*by, unit]), [*by, "rep"], "_w")))
    return out


def bootstrap_ci(rows: DataFrame, unit: str, stat, reps: int, by: Sequence[str] = (), seed: int = 0,
                 level: float = 0.95) -> DataFrame:
    """Observed statistic, percentile interval and spread over resamples; degenerate resamples drop out.

    Units are drawn with replacement and enter as weights, so a resample costs one short row for each unit it holds and copies no row of it.
    """
    by = list(by)
    obs, boot = _resampled(cut(rows), unit, [stat], reps, seed, by)[0]
    lo, hi = (1 - level) / 2, (1 + level) / 2
    ci = boot.where("stat is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reps"), F.percentile("stat", F.lit(lo)).alias("ci_lo"),
        F.percentile("stat", F.lit(hi)).alias("ci_hi"), F.stddev_pop("stat").alias("se"))
    obs = obs.withColumnRenamed("stat", "observed")
    if by:
        return obs.join(ci, by)
    return obs.withColumn("_ci", ci.select(F.struct("*")).scalar()).select("observed", "_ci.*")


def intervals(rows: DataFrame, unit: str, stats: dict[str, Callable[..., DataFrame]], reps: int, by: Sequence[str] = (), seed: int = 0,
              level: float = 0.95, floor: int = 5) -> DataFrame:
    """Several statistics on the same resamples: (by, statistic, n, observed, n_reps, ci_lo, ci_hi).

    ``n`` counts the units that contribute to a group; with fewer than ``floor`` of them observed value and interval are null.
    """
    by, rows = list(by), cut(rows)
    lo, hi = F.lit((1 - level) / 2), F.lit((1 + level) / 2)
    out = None
    for name, (obs, boot) in zip(stats, _resampled(rows, unit, list(stats.values()), reps, seed, by)):
        obs = obs.select(*by, F.lit(name).alias("statistic"), F.col("stat").alias("observed"))
        boot = boot.where("stat IS NOT NULL").groupBy(*by).agg(F.count("stat").alias("n_reps"), F.percentile("stat", lo).alias("ci_lo"), F.percentile("stat", hi).alias("ci_hi"))
        both = obs.join(boot, by, "left") if by else obs.crossJoin(boot)   # one row each without groups
        out = both if out is None else out.unionByName(both)
    n = rows.groupBy(*by).agg(F.count_distinct(unit).alias("n"))
    out = out.join(n, by) if by else out.crossJoin(n)
    solid = F.col("n") >= floor
    return out.select(*by, "statistic", "n", *[F.when(solid, F.col(v)).alias(v) for v in ("observed", "n_reps", "ci_lo", "ci_hi")])


def paired_bootstrap(rows: DataFrame, unit: str, stat_a, stat_b, reps: int, seed: int = 0, level: float = 0.95
                     ) -> DataFrame:
    """Difference of two statistics on the same resamples."""
    (obs_a, boot_a), (obs_b, boot_b) = _resampled(cut(rows), unit, [stat_a, stat_b], reps, seed, [])
    both = (boot_a.withColumnRenamed("stat", "_a").join(boot_b.withColumnRenamed("stat", "_b"), "rep")
            .withColumn("_d", F.col("_a") - F.col("_b")).where("_d is not null"))
    g = both.agg(F.count(F.lit(1)).alias("n_reps"), F.avg("_d").alias("diff_mean"),
                 F.percentile("_d", F.lit((1 - level) / 2)).alias("ci_lo"),
                 F.percentile("_d", F.lit((1 + level) / 2)).alias("ci_hi"),
                 F.avg((F.col("_d") <= 0).cast("double")).alias("frac_le_0"))
    return g.select("*", obs_a.select("stat").scalar().alias("stat_a"), obs_b.select("stat").scalar().alias("stat_b"))


def null_summary(null: DataFrame, observed: DataFrame, by: Sequence[str] = (), add_one: bool = True,
                 two_sided: bool = False) -> DataFrame:
    """Mean, sd, quantiles, p and percentile of an observed statistic in its null."""
    by = list(by)
    o = observed.withColumnRenamed("stat", "observed")
    if by:
        j = null.join(o, by)
    else:
        j = null.withColumn("observed", o.select("observed").scalar())
    s, ob = (F.abs("stat"), F.abs("observed")) if two_sided else (F.col("stat"), F.col("observed"))
    # ties with the observed value count as at least as extreme; 1e-9 absorbs summation-order noise
    hits, n = F.count_if(s >= ob - 1e-9), F.count("stat")
    p = (hits + 1) / (n + 1) if add_one else hits / n
    return j.groupBy(*by, "observed").agg(
        n.alias("n_reps"), F.avg("stat").alias("null_mean"), F.stddev_pop("stat").alias("null_sd"),
        F.percentile("stat", F.lit(0.05)).alias("q05"), F.percentile("stat", F.lit(0.5)).alias("q50"),
        F.percentile("stat", F.lit(0.95)).alias("q95"), F.max("stat").alias("null_max"), p.alias("p"),
        (F.count_if(F.col("stat") < F.col("observed") - 1e-9) / n).alias("percentile"))


def permutation_test(units: DataFrame, unit: str, x: str, label: str, stat, reps: int, seed: int = 0,
                     by: Sequence[str] = (), within: Sequence[str] = (), **kw) -> DataFrame:
    """Statistic of ``x`` against re-dealt labels."""
    deal = permuted_labels(units, unit, label, reps, seed, by, within)
    rows = deal.join(units.select(*by, unit, x), [*by, unit])
    null = stat(rows, [*by, "rep"]).where("stat is not null")
    return null_summary(null, stat(units, list(by)), by, **kw)


def sign_flip_test(slopes: DataFrame, unit: str, value: str, reps: int, seed: int = 0, by: Sequence[str] = ()
                   ) -> DataFrame:
    """Mean of unit slopes against random sign flips, two-sided."""
    d = slopes.select(*by, unit, value, _reps(reps))
    null = d.groupBy(*by, "rep").agg(F.avg(F.col(value) * hash_sign(unit, "rep", F.lit(seed))).alias("stat"))
    obs = slopes.groupBy(*by).agg(F.avg(value).alias("stat"))
    return null_summary(null, obs, by, two_sided=True)


def compare_correlations(rhos: DataFrame, tag: str, rho: str = "rho", n: str = "n") -> DataFrame:
    """Fisher z of every pair of datasets in a short result table."""
    a = rhos.select(F.col(tag).alias("tag_a"), F.col(rho).alias("_ra"), F.col(n).alias("_na"))
    b = rhos.select(F.col(tag).alias("tag_b"), F.col(rho).alias("_rb"), F.col(n).alias("_nb"))
    se = F.sqrt(F.lit(1.0) / (F.col("_na") - 3) + F.lit(1.0) / (F.col("_nb") - 3))
    return a.join(b, F.col("tag_a") < F.col("tag_b")) \
        .select("tag_a", "tag_b", ((fisher_z("_ra") - fisher_z("_rb")) / se).alias("z"))


def combined_correlation(bands: DataFrame, rho: str = "rho", n: str = "n", floor: int = 4) -> DataFrame:
    """Inverse-variance combination of band correlations."""
    ok = bands.where((F.col(n) >= floor) & F.col(rho).isNotNull())
    return ok.agg(F.sum(n).alias("n"), F.tanh(F.sum(fisher_z(rho, 0.999) * (F.col(n) - 3)) / F.sum(F.col(n) - 3)).alias("combined"))


def matched_pairs(units: DataFrame, unit: str, score: str, day: str, x: str, tol: float) -> DataFrame:
    """Pairs of units with nearly equal score and different day, longer one having the lower ``x``.

    A band join on score buckets of width ``tol`` (own and next), so only neighbouring buckets meet. Returns one row
    per pair; units are animals of one study.
    """
    u = units.select(F.col(unit).alias("u"), F.col(score).alias("s"), F.col(day).alias("d"), F.col(x).alias("x"))
    u = u.withColumn("b", F.floor(F.col("s") / tol))
    a = u.select(*[F.col(k).alias(f"{k}1") for k in ("u", "s", "d", "x")],
                 F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("b"))
    j = a.join(u, "b").where((F.col("u1") < F.col("u")) & (F.abs(F.col("s1") - F.col("s")) <= tol) & (F.col("d1") != F.col("d")))
    hit = F.when(F.col("d1") > F.col("d"), F.col("x1") < F.col("x")).otherwise(F.col("x") < F.col("x1"))
    return j.select(F.col("u1").alias("unit_a"), F.col("u").alias("unit_b"), (F.col("d1") - F.col("d")).alias("day_gap"),
                    (F.col("s1") - F.col("s")).alias("score_gap"), (F.col("x1") - F.col("x")).alias("x_gap"),
                    hit.alias("longer_is_lower"), (F.col("x1") == F.col("x")).alias("tie"))


def matched_pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("longer_is_lower").alias("k"),
                     F.count_if("tie").alias("ties"), F.avg(F.col("longer_is_lower").cast("double")).alias("fraction"))


def pick_pairs(pairs: DataFrame) -> DataFrame:
    """Best example (smallest score gap, then largest day gap) and counterexample (largest rise, >= 10 days)."""
    ex = pairs.orderBy(F.abs("score_gap"), F.abs("day_gap").desc(), "unit_a", "unit_b").limit(1).withColumn("role", F.lit("example"))
    rise = F.when(F.col("day_gap") > 0, F.col("x_gap")).otherwise(-F.col("x_gap"))
    ct = (pairs.where(F.abs("day_gap") >= 10).orderBy(rise.desc(), "unit_a", "unit_b").limit(1)
          .withColumn("role", F.lit("counterexample")))
    return ex.unionByName(ct).select("role", "unit_a", "unit_b", "day_gap", "x_gap")


# ------------------------------------------------------------------ batteries of metrics

def adjusted_residuals(rows: DataFrame, metric: str, value: str, designs: dict[str, Sequence[str]]) -> DataFrame:
    """Residuals of each metric on one or two covariates for every named design: the rows with ``resid_on`` and ``resid``.

    The fits are sums over the rows of a metric, joined back; a covariate without spread of its own takes no part.
    """
    out = None
    for name, covs in designs.items():
        a = F.col(covs[0])
        b = F.col(covs[1]) if len(covs) > 1 else F.lit(0.0)
        y = F.col(value)
        m = rows.groupBy(metric).agg(F.avg(y).alias("_y"), F.avg(a).alias("_a"), F.avg(b).alias("_b"), F.var_pop(a).alias("_aa"), F.var_pop(b).alias("_bb"),
                                     F.covar_pop(a, b).alias("_ab"), F.covar_pop(a, y).alias("_ay"), F.covar_pop(b, y).alias("_by"))
        det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
        two = det > 1e-12 * F.col("_aa") * F.col("_bb")
        m = m.withColumn("_sa", F.when(two, (F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab")) / det).otherwise(F.coalesce(ratio("_ay", "_aa"), F.lit(0.0))))
        m = m.withColumn("_sb", F.when(two, (F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab")) / det).otherwise(F.lit(0.0)))
        d = rows.join(m.select(metric, "_y", "_a", "_b", "_sa", "_sb"), metric)
        d = d.withColumn("resid", y - F.col("_y") - F.col("_sa") * (a - F.col("_a")) - F.col("_sb") * (b - F.col("_b"))).withColumn("resid_on", F.lit(name))
        d = d.drop("_y", "_a", "_b", "_sa", "_sb")
        out = d if out is None else out.unionByName(d)
    return out


def severity_battery(rows: DataFrame, metric: str, value: str, unit: str, phase: str, level: str, designs: dict[str, Sequence[str]],
                     phases: tuple[str, str], reps: int, seed: int = 0) -> DataFrame:
    """Tests of many metrics beyond severity (G11): (family, metric, resid_on, n, observed, p, q).

    Residuals of section rows are averaged to units. ``phase_gap``: mean of the second phase minus the first, against labels re-dealt among
    units. ``level_trend``: mean slope of a unit's residuals over its levels, against random signs of the slopes. One deal and one set of
    signs serve all metrics, so a replicate is one more key; p is two-sided, q by Benjamini-Hochberg inside a family.
    """
    by = [metric, "resid_on"]
    r = adjusted_residuals(rows, metric, value, designs)
    per_unit = r.groupBy(*by, unit).agg(F.avg("resid").alias("resid"), F.min(phase).alias(phase)).where(F.col(phase).isin(*phases))
    gap = mean_gap("resid", phase, *phases)
    deal = permuted_labels(rows.select(unit, phase).where(F.col(phase).isin(*phases)).distinct(), unit, phase, reps, seed)
    null = gap(deal.join(per_unit.drop(phase), unit), [*by, "rep"]).where("stat IS NOT NULL")
    sizes = per_unit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    first = null_summary(null, gap(per_unit, by), by, two_sided=True).join(sizes, by).withColumn("family", F.lit("phase_gap"))
    slopes = r.groupBy(*by, unit).agg(F.regr_slope("resid", level).alias("slope"), F.count_distinct(level).alias("_k")).where("_k > 1")
    counts = slopes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    second = sign_flip_test(slopes, unit, "slope", reps, seed, by).join(counts, by).withColumn("family", F.lit("level_trend"))
    keep = ["family", *by, "n", "observed", "p"]
    both = first.select(*keep).unionByName(second.select(*keep))
    from cohortspark.functions.ordering import bh_adjust
    return bh_adjust(both, "p", ["family"])


def adjusted_gap(y: str, group: str, a: str, b: str, at: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Difference of group ``b`` from ``a`` in ``y`` at equal ``at``: the group term of a line with both."""
    def stat(d: DataFrame, part: Sequence[str], weight: str | None = None) -> DataFrame:
        covar = _weighted(weight)[1]
        g = F.when(F.col(group) == b, 1.0).when(F.col(group) == a, 0.0)
        m = d.withColumn("_g", g).where("_g IS NOT NULL").groupBy(*part).agg(
            covar("_g", "_g").alias("_gg"), covar(at, at).alias("_cc"), covar("_g", at).alias("_gc"), covar("_g", y).alias("_gy"), covar(at, y).alias("_cy"))
        det = F.col("_gg") * F.col("_cc") - F.col("_gc") * F.col("_gc")
        return m.select(*part, F.when(det > 1e-9 * F.col("_gg") * F.col("_cc"), (F.col("_gy") * F.col("_cc") - F.col("_cy") * F.col("_gc")) / det).alias("stat"))
    return stat


def block_permutation_test(rows: DataFrame, unit: str, member: str, label: str, stat, x: Sequence[str], reps: int, seed: int = 0) -> DataFrame:
    """A statistic of the rows against labels whose whole blocks change places between units of one size (T21), two-sided p."""
    deal = block_permuted_labels(rows, unit, member, label, reps, seed)
    null = stat(deal.join(rows.select(unit, member, *x), [unit, member]), ["rep"]).where("stat IS NOT NULL")
    return null_summary(null, stat(rows, []), two_sided=True)
