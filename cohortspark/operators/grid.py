"""Leave-group-out regression and classification as a grid of Spark tasks.

A grid row is (task, fold). A task names its units, targets and covariates, and the feature set it reads; permutations
are extra targets of one task, conditions and gene sets are extra tasks. The held-out group of a fold is the units
carrying its id; all other units of the task train it.

No task receives a data matrix. Feature screening deals the features into buckets that meet the units (training sums = all minus the fold's
own). Rows of the selected features are turned, chunk of units by chunk, into cross-products over
[1, covariates, features, targets] per inner CV block; those add up, and the fit needs nothing else: adjustment,
scaling, inner CV, the path and the prediction are linear algebra on at most ``top + covariates + targets`` columns,
however many units there are. Every fitted transform is thereby inside its fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import kernels as NK
from cohortspark.session import cut, spread as _spread


SCREEN_ROWS = 500_000       # rows of one feature set that a screening task reads
SLAB_VALUES = 1 << 21       # features by units that it holds as a matrix
FOLD_SLAB = 256             # folds that it takes side by side


@dataclass(frozen=True)
class Settings:
    top: int = 1000             # features kept per fold by training variance
    l1: float = 0.5
    alphas: int = 50
    inner: int = 5              # inner CV blocks, contiguous in unit order
    covariate_share: float | None = None   # None: all covariates; else leading components up to this variance share
    chunk: int = 256            # units per cross-product task
    batch: int = 250            # targets (or feature sets) solved together
    keep_coef: int | None = None    # leading targets whose coefficients are kept; permuted targets need none


def unit_table(units: DataFrame, unit: str, fold: str | None, targets: Sequence[str], covariates: Sequence[str] = (),
               task: str | None = None, feature_set: str | None = None) -> DataFrame:
    """Units in grid form: task, fset, unit, fold (NULL = trains everywhere), y and c arrays."""
    lit = lambda x, v: F.col(x).cast("string") if x else F.lit(v)
    arr = lambda cols: (F.array(*[F.col(x).cast("double") for x in cols]) if cols
                        else F.array().cast("array<double>"))
    return units.select(lit(task, "all").alias("task"), lit(feature_set, "all").alias("fset"), F.col(unit).alias("unit"),
                        lit(fold, None).alias("fold") if fold else F.lit(None).cast("string").alias("fold"),
                        arr(targets).alias("y"), arr(covariates).alias("c"))


def feature_rows(x: DataFrame, unit: str, feature: str, value: str, feature_set: str | None = None) -> DataFrame:
    return x.select((F.col(feature_set).cast("string") if feature_set else F.lit("all")).alias("fset"),
                    F.col(unit).alias("unit"), F.col(feature).cast("string").alias("feature"), F.col(value).cast("double").alias("value"))


def _folds(units: DataFrame, full_fit: bool) -> DataFrame:
    f = units.where("fold is not null").select("task", "fold").distinct()
    if full_fit:
        f = f.unionByName(units.select("task", F.lit("").alias("fold")).distinct())
    return f


def screen(x: DataFrame, units: DataFrame, folds: DataFrame, s: Settings, keep: DataFrame | None) -> DataFrame:
    """(task, fold, feature, pos): the ``top`` features by adjusted training variance; kept ones come first.

    Features are dealt into buckets; a bucket meets the units of its feature set, so sums of a feature for all tasks and folds are products
    of its rows with the design, and training sums are the total minus the fold's own part. A bucket hands on its own ``top`` features of
    each fold, so neither folds nor tasks multiply the rows that travel.
    """
    p = _width(units, "c")
    # a null adds nothing to a sum; what is not a number does
    x = x.where("unit IS NOT NULL AND fset IS NOT NULL").select("fset", "unit", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
    if keep is not None:
        x = x.join(keep.select(F.col("feature").cast("string"), F.lit(True).alias("_keep")).distinct(), "feature", "left")
    else:
        x = x.withColumn("_keep", F.lit(None).cast("boolean"))
    rows = x.groupBy("fset").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-rows // SCREEN_ROWS))
    x = x.select("fset", F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("int").alias("bucket"), "unit", "feature", "value", F.coalesce("_keep", F.lit(False)).alias("_keep"))
    # the design of a feature set: its units, and the folds of its tasks as rows without a unit
    units = units.where("fset IS NOT NULL AND task IS NOT NULL")
    design = units.select("fset", "task", "unit", "fold", F.transform("c", lambda e: F.coalesce(e, F.lit(0.0))).alias("c"), F.lit(False).alias("_fold"))
    design = design.unionByName(units.select("fset", "task").distinct().join(folds, "task").select("fset", "task", "fold", F.lit(True).alias("_fold")), allowMissingColumns=True)
    design = design.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    share, top = s.covariate_share, s.top

    def variance(key, vals: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vals) and len(plan):
            out = list(_adjusted_variances(vals, plan, p, share, top))
        cols = ["task", "fold", "feature", "var"]
        return pd.concat(out).astype({c: object for c in cols[:3]}) if out else _no_rows(*cols)
    keys = ["fset", "bucket"]
    ranked = _paired(_spread(x, *keys), design, keys).applyInPandas(variance, "task string, fold string, feature string, var double")
    if keep is not None:
        ranked = ranked.join(keep.select(F.col("feature").cast("string"), F.lit(True).alias("_keep")), "feature", "left")
    else:
        ranked = ranked.withColumn("_keep", F.lit(None).cast("boolean"))
    # kept features come on top of the ``top`` screened ones and use up none of their places
    ranked = ranked.where("var > 1e-12 or _keep").withColumn("_keep", F.coalesce("_keep", F.lit(False)))
    w = Window.partitionBy("task", "fold", "_keep").orderBy(F.round("var", 12).desc(), "feature")
    ranked = ranked.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= s.top) | F.col("_keep"))
    w = Window.partitionBy("task", "fold").orderBy(F.col("_keep").desc(), "_r")
    return ranked.withColumn("pos", F.row_number().over(w) - 1).select("task", "fold", "feature", "pos")


def _adjusted_variances(vals: pd.DataFrame, plan: pd.DataFrame, p: int, share: float | None, top: int):
    """Frames (task, fold, feature, var) of the features of one bucket that can be among the ``top`` of a fold, and of the kept ones.

    Rows of a unit that repeats count as often as it does, for features and for units.
    """
    own = ~plan["_fold"].to_numpy(bool)
    index = pd.Index(plan["unit"][own].dropna().unique())
    at = index.get_indexer(vals["unit"])
    vals, at = vals[at >= 0], at[at >= 0]
    code, names = pd.factorize(vals["feature"].astype(object), use_na_sentinel=False)
    nameless = np.asarray(pd.isna(names))
    kept = np.zeros(len(names), bool)
    kept[code[vals["_keep"].to_numpy(bool)]] = True
    v = vals["value"].to_numpy(float)
    order = np.argsort(code, kind="stable")
    code, at, v = code[order], at[order], v[order]
    odd = ~np.isfinite(v)
    v[odd] = 0.0
    width = len(index)
    step = max(1, SLAB_VALUES // max(1, width))
    tasks = []
    for task, d in plan[own].groupby("task", sort=False):
        c = np.array([np.zeros(p) if e is None else e for e in d["c"]], float).reshape(len(d), p)
        f = plan["fold"][(plan["task"] == task).to_numpy() & ~own].drop_duplicates().tolist()
        place = {k: i for i, k in enumerate(f)}
        tasks.append((task, f, np.array([place.get(k, -1) for k in d["fold"]], int), index.get_indexer(d["unit"]), c))
    for lo in range(0, len(names), step):
        hi = min(lo + step, len(names))
        a, b = np.searchsorted(code, [lo, hi])
        flat = (code[a:b] - lo) * width + at[a:b]
        cells = lambda w: np.bincount(flat, w, (hi - lo) * width).reshape(hi - lo, width)
        m1, m2, seen, wild = cells(v[a:b]), cells(v[a:b] ** 2), cells(None), cells(odd[a:b])
        for task, f, fold, unit, c in tasks:
            known = unit >= 0
            columns = np.concatenate([np.ones((len(unit), 1)), c], axis=1)

            def sums(which, groups):
                """Per feature and group of units: sums of x, x^2 and x c."""
                w = np.zeros((1 + p, width, groups.max(initial=0) + 1))
                np.add.at(w, (slice(None), unit[which], groups), columns[which].T)
                return np.stack([m1 @ w[0], m2 @ w[0], *[m1 @ w[1 + i] for i in range(p)]])
            whole = sums(known, np.zeros(known.sum(), int))
            alive = (seen[:, np.unique(unit[known])] > 0).any(axis=1)
            whole[:, (wild[:, np.unique(unit[known])] > 0).any(axis=1)] = np.nan
            u_all = columns.T @ columns
            for first in range(0, len(f), FOLD_SLAB):
                some = f[first:first + FOLD_SLAB]
                inside = (fold >= first) & (fold < first + len(some))
                held = np.zeros((2 + p, hi - lo, len(some)))
                if (inside & known).any():
                    part = sums(inside & known, fold[inside & known] - first)
                    held[:, :, :part.shape[2]] = part
                held[:, nameless[lo:hi]] = 0.0
                train = whole - held
                for j, name in enumerate(some):
                    mine = columns[fold == first + j]
                    u = u_all - mine.T @ mine
                    n = u[0, 0]
                    if n <= 0:
                        continue
                    s1, var = train[0, :, j], train[1, :, j] - train[0, :, j] ** 2 / n
                    if p:
                        cov = u[1:, 1:] - np.outer(u[0, 1:], u[0, 1:]) / n
                        sx = train[2:, :, j].T - np.outer(s1 / n, u[0, 1:])
                        if p == 1:
                            var = var if cov[0, 0] <= 0 else var - sx[:, 0] ** 2 / cov[0, 0]
                        else:
                            basis = NK.covariate_basis(cov / n, share)
                            if basis.shape[1]:
                                proj = sx @ basis
                                var = var - np.einsum("ij,ij->i", proj, np.linalg.solve(basis.T @ cov @ basis, proj.T).T)
                    var = np.maximum(var, 0) / n
                    pick = np.flatnonzero(alive & (_leading(np.where(kept[lo:hi], 0.0, var), names[lo:hi], top) | kept[lo:hi]))
                    yield pd.DataFrame({"task": task, "fold": name, "feature": names[lo:hi][pick], "var": var[pick]})


def _leading(var: np.ndarray, names, top: int) -> np.ndarray:
    """Which features can be among the ``top`` by variance rounded to 12 digits, ties by name."""
    able = ~(var <= 1e-12)
    if able.sum() <= top:
        return able
    v = np.where(np.isnan(var), np.inf, var)
    least = np.partition(v, len(v) - top)[len(v) - top]
    sure, near = v > least + 2e-12, np.flatnonzero(np.abs(v - least) <= 2e-12) if np.isfinite(least) else np.flatnonzero(v == least)
    if len(near) and (v[near] == v[near[0]]).all() and not pd.isna(names[near]).any():
        near = near[np.argsort(np.asarray(names[near], object), kind="stable")][:max(0, top - int(sure.sum()))]
    sure[near] = True
    return sure & able


def _width(units: DataFrame, col: str) -> int:
    """Length of an array column: one number from one row."""
    r = units.select(F.size(col)).first()
    return int(r[0]) if r else 0


def _blocks(units: DataFrame, folds: DataFrame, s: Settings) -> DataFrame:
    """(task, fold, unit, block, chunk): contiguous inner CV blocks of the training units, -1 for held-out ones."""
    r = (units.withColumnRenamed("fold", "_own").join(folds, "task")
         .withColumn("_out", F.coalesce(F.col("_own") == F.col("fold"), F.lit(False))))
    w = Window.partitionBy("task", "fold", "_out").orderBy("unit")
    n = F.count(F.lit(1)).over(Window.partitionBy("task", "fold", "_out"))
    i = F.row_number().over(w) - 1
    k = F.least(F.lit(s.inner), n)
    base = F.floor(n / k)
    extra = n - base * k
    cutp = extra * (base + 1)
    block = F.when(i < cutp, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - cutp) / F.greatest(base, F.lit(1))))
    chunk = F.floor(i / F.lit(s.chunk))
    return r.select("task", "fset", "fold", "unit", F.when(F.col("_out"), -1).otherwise(block).cast("int").alias("block"),
                    F.when(F.col("_out"), -1 - chunk).otherwise(chunk).cast("int").alias("chunk"), "y", "c")


PRODUCTS = "task string, fold string, block int, k int, size int, data binary"


def cross_products(x: DataFrame, blocks: DataFrame, sel: DataFrame) -> DataFrame:
    """Cross-products over [1, C, X, Y] per (task, fold, inner block), and raw rows of held-out units
    (negative block: their chunk).

    Rows of one (task, fold, chunk of units) meet in a task: at most ``chunk`` units by ``top`` features.
    """
    width = sel.groupBy("task", "fold").agg((F.max("pos") + 1).alias("k"))
    own = sel.join(blocks.select("task", "fset").distinct(), "task")
    rows = (x.join(own, ["fset", "feature"]).join(blocks.select("task", "fset", "fold", "unit", "chunk"), ["task", "fold", "fset", "unit"])
            .select("task", "fold", "chunk", "unit", "pos", "value"))
    base = (blocks.join(width, ["task", "fold"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
            .select("task", "fold", "chunk", "unit", "block", "k", "y", "c"))

    def build(key, vals: pd.DataFrame, us: pd.DataFrame) -> pd.DataFrame:
        if not len(us):
            return _no_rows("task", "fold", "block", "k", "size", "data")
        us = us.sort_values("unit").reset_index(drop=True)
        k = int(us["k"].iloc[0])
        c = np.array(us["c"].tolist(), float).reshape(len(us), -1)
        y = np.array(us["y"].tolist(), float).reshape(len(us), -1)
        m = np.zeros((len(us), k))
        if len(vals):
            at = pd.Series(np.arange(len(us)), index=us["unit"])
            m[at.loc[vals["unit"]].to_numpy(), vals["pos"].to_numpy(int)] = vals["value"].to_numpy(float)
        a = np.concatenate([np.ones((len(us), 1)), c, m, y], axis=1)
        out = []
        for b in np.unique(us["block"]):
            part = a[(us["block"] == b).to_numpy()]
            # fewer units than columns: the rows themselves are the shorter message, and are multiplied where they arrive
            mat = part if b < 0 or len(part) < part.shape[1] else part.T @ part
            out.append((key[0], key[1], int(b) if b >= 0 else int(key[2]), k, mat.shape[1], np.ascontiguousarray(mat).tobytes()))
        return pd.DataFrame(out, columns=["task", "fold", "block", "k", "size", "data"])
    keys = ["task", "fold", "chunk"]
    return _paired(rows, base, keys).applyInPandas(build, PRODUCTS)


def _no_rows(*cols: str) -> pd.DataFrame:
    """No row, ready for any result type: columns of float64, as empty lists give them, cannot become text or arrays in Arrow."""
    return pd.DataFrame({c: [] for c in cols}, dtype=object)


def _paired(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Cogroup of two frames derived from the same tables; the right keys are renamed so that they are told apart."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"{k}_r").withColumn(f"{k}_r", F.col(f"{k}_r"))
    r = r.select(*[F.col(c).alias(c) for c in r.columns])
    return left.groupBy(*keys).cogroup(r.groupBy(*[f"{k}_r" for k in keys]))


def _unpack(pdf: pd.DataFrame, l1: float = 1.0):
    """(inner blocks, rows of held-out units, features, whether the blocks are rows).

    A fold of few training units whose blocks all came as rows stays that way, for the solvers that work in as many unknowns as rows;
    otherwise every block is its cross-products. Both give the same fit.
    """
    size, k = int(pdf["size"].iloc[0]), int(pdf["k"].iloc[0])
    parts: dict[int, list[np.ndarray]] = {}
    held = []
    for b, d in zip(pdf["block"], pdf["data"]):
        m = np.frombuffer(d).reshape(-1, size)
        if b < 0:
            held.append((-b, m))
        else:
            parts.setdefault(b, []).append(m)
    mats = [m for ms in parts.values() for m in ms]
    by_rows = l1 < 1 and all(len(m) < size for m in mats) and sum(map(len, mats)) <= NK.ROWS
    join = np.concatenate if by_rows else (lambda ms: sum(m.T @ m if len(m) < size else m for m in ms))
    return [join(parts[b]) for b in sorted(parts)], (
        np.concatenate([m for _, m in sorted(held, key=lambda e: e[0])]) if held else np.zeros((0, size))), k, by_rows


def _held_units(blocks: DataFrame) -> DataFrame:
    return (blocks.where("block < 0").groupBy("task", "fold")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("chunk") * -1, "unit"))), lambda e: e["unit"]).alias("units")))


def _fit_grid(x: DataFrame, units: DataFrame, s: Settings, keep: DataFrame | None, full_fit: bool):
    """Fits of every (task, fold, target) as one row each, with the held-out units and the feature names of a fold."""
    units = cut(units)
    x = cut(x)
    folds = _folds(units, full_fit)
    sel = cut(screen(x, units, folds, s, keep))
    blocks = cut(_blocks(units, folds, s))
    p, n_t = _width(units, "c"), _width(units, "y")
    prod = cross_products(x, blocks, sel)
    batches = F.explode(F.sequence(F.lit(0), F.lit((n_t - 1) // s.batch))).alias("batch")
    prod = prod.select("*", batches)
    held = _held_units(blocks)
    names = sel.groupBy("task", "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature"))), lambda e: e["feature"]).alias("names"))
    unit_type = units.schema["unit"].dataType.simpleString()

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        task, fold, batch = key
        blk, rows, k, by_rows = _unpack(pdf, s.l1)
        lo, hi = batch * s.batch, min((batch + 1) * s.batch, n_t)
        cols = np.r_[0:1 + p + k, 1 + p + k + lo:1 + p + k + hi]
        blk = [b[:, cols] if by_rows else b[np.ix_(cols, cols)] for b in blk]
        rows = rows[:, cols]
        solve = NK.enet_cv_rows if by_rows else NK.enet_cv
        t, w, b0, alpha = solve(blk, p, k, s.l1, s.alphas, s.covariate_share)
        t = NK.RowMap.of(t, p)
        adj = t.apply(rows)
        adj[~np.isfinite(rows).all(axis=1)] = np.nan         # such a unit has no adjusted value at all
        pred = adj[:, 1:1 + k] @ w + b0
        # the map is linear in [1, C, X]: the model on the scale of the data is a weight for each feature and one line
        inverse = t.scale[:k]
        line = t.line[:, 1:1 + k] @ w
        line[0] += b0
        full = lambda j, v: v.tolist() if s.keep_coef is None or lo + j < s.keep_coef else []
        return pd.DataFrame([{
            "task": task, "fold": fold, "target": int(lo + j), "pred": pred[:, j].tolist(), "observed": adj[:, 1 + k + j].tolist(),
            "coef": full(j, w[:, j]), "n_nonzero": int((w[:, j] != 0).sum()), "alpha": float(alpha[j]), "weight": full(j, w[:, j] * inverse),
            "sd": full(j, 1 / inverse), "line": line[:, j].tolist(), "target_line": (-t.line[:, 1 + k + j]).tolist()} for j in range(hi - lo)])
    fitted = cut(_spread(prod, "task", "fold", "batch").groupBy("task", "fold", "batch").applyInPandas(
        fit, "task string, fold string, target int, pred array<double>, observed array<double>, coef array<double>, "
             "n_nonzero int, alpha double, weight array<double>, sd array<double>, line array<double>, target_line array<double>"))
    return fitted, held, names, unit_type


def _predictions(fitted: DataFrame, held: DataFrame, unit_type: str) -> DataFrame:
    return (fitted.where("fold <> ''").join(held, ["task", "fold"])
            .select("task", "fold", "target", "n_nonzero", "alpha",
                    F.explode(F.arrays_zip("units", "pred", "observed")).alias("_z"))
            .select("task", "fold", "target", F.col("_z.units").cast(unit_type).alias("unit"), F.col("_z.pred").alias("pred"),
                    F.col("_z.observed").alias("observed"), "n_nonzero", "alpha"))


def _coefficients(fitted: DataFrame, names: DataFrame) -> DataFrame:
    return (fitted.where("size(coef) > 0").join(names, ["task", "fold"])
            .select("task", "fold", "target", F.explode(F.arrays_zip("names", "coef", "weight", "sd")).alias("_z"))
            .select("task", "fold", "target", F.col("_z.names").alias("feature"), F.col("_z.coef").alias("coef"),
                    F.col("_z.weight").alias("weight"), F.col("_z.sd").alias("sd"))
            .where("coef <> 0"))


def leave_out_regression(x: DataFrame, units: DataFrame, s: Settings = Settings(), keep: DataFrame | None = None,
                         full_fit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Elastic-net predictions of held-out units and coefficients, for every (task, fold, target).

    ``x`` from :func:`feature_rows`, ``units`` from :func:`unit_table`. With covariates, features and targets are
    adjusted on the training units; ``observed`` is the held-out target adjusted by the training fit. Returns
    (predictions: task, fold, target, unit, pred, observed, n_nonzero, alpha) and (coefficients: task, fold, target,
    feature, coef); ``full_fit`` adds fold '' trained on all units.
    """
    fitted, held, names, unit_type = _fit_grid(x, units, s, keep, full_fit)
    return _predictions(fitted, held, unit_type), _coefficients(fitted, names).drop("weight", "sd")


def leave_out_sets(x: DataFrame, units: DataFrame, sets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Held-out predictions of one clock for each feature set (M13): (task = set_no, fold, target, unit, pred, observed, n_nonzero, alpha).

    ``sets`` has (set_no, feature); ``units`` one task with one target. The rows of a fold are built once over the union of all sets'
    features; a set is a list of positions in it. The sets of one size are fitted as a batch. Sets are taken whole, nothing is screened.
    """
    units, x = cut(units), cut(x)
    folds = _folds(units, False)
    p = _width(units, "c")
    sets = cut(sets.select("set_no", F.col("feature").cast("string")))
    # a gene panel's numbering; the panel fits a window partition as elsewhere
    place = cut(sets.select("feature").distinct().withColumn("pos", F.row_number().over(Window.orderBy("feature")) - 1))
    n_batches = max(1, -(-sets.select("set_no").distinct().count() // s.batch))
    lists = sets.join(place, "feature").groupBy("set_no").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    lists = lists.withColumn("batch", F.pmod(F.xxhash64("set_no"), F.lit(n_batches)).cast("int"))
    blocks = cut(_blocks(units, folds, s))
    prod = cross_products(x.join(place.select("feature"), "feature", "left_semi"), blocks, folds.crossJoin(place))
    batches = lambda df: df.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    prod = batches(prod)
    held = _held_units(blocks)
    lists = folds.crossJoin(lists)
    kind = sets.schema["set_no"].dataType.simpleString()

    def fit(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(own):
            blk, rows, k, by_rows = _unpack(pdf, s.l1)
            at = [np.asarray(v, int) for v in own["at"]]
            for size in sorted({len(v) for v in at}):
                of_size = [i for i, v in enumerate(at) if len(v) == size]
                pos = np.stack([at[i] for i in of_size])
                if by_rows:
                    t, w, b0, alpha = NK.enet_cv_sets(blk, p, k, pos, s.l1, s.alphas, s.covariate_share)
                    adj = t.apply(rows)
                    adj[~np.isfinite(rows).all(axis=1)] = np.nan
                    pred = np.stack([adj[:, 1 + one] @ v for one, v in zip(pos, w)]) + b0[:, None]
                    observed = [adj[:, 1 + k]] * len(pos)
                else:
                    fits = []
                    for one in pos:
                        cols = np.r_[0:1 + p, 1 + p + one, 1 + p + k]
                        t, w1, b1, a1 = NK.enet_cv([b[np.ix_(cols, cols)] for b in blk], p, size, s.l1, s.alphas, s.covariate_share)
                        adj = rows[:, cols] @ t
                        fits.append((w1[:, 0], a1[0], adj[:, 1:1 + size] @ w1[:, 0] + b1[0], adj[:, 1 + size]))
                    w, alpha, pred, observed = (list(v) for v in zip(*fits))
                out += [{"set_no": own["set_no"].iloc[i], "task": key[0], "fold": key[1], "target": 0, "pred": list(pred[j]), "observed": list(observed[j]),
                         "n_nonzero": int((w[j] != 0).sum()), "alpha": float(alpha[j])} for j, i in enumerate(of_size)]
        return pd.DataFrame(out, columns=["set_no", "task", "fold", "target", "pred", "observed", "n_nonzero", "alpha"])
    keys = ["task", "fold", "batch"]
    fitted = cut(_paired(_spread(prod, *keys), lists, keys).applyInPandas(
        fit, f"set_no {kind}, task string, fold string, target int, pred array<double>, observed array<double>, n_nonzero int, alpha double"))
    z = F.explode(F.arrays_zip("units", "pred", "observed")).alias("_z")
    got = fitted.join(held, ["task", "fold"]).select("set_no", "fold", "target", "n_nonzero", "alpha", z)
    return got.select(F.col("set_no").cast("string").alias("task"), "fold", "target", F.col("_z.units").cast(units.schema["unit"].dataType.simpleString()).alias("unit"),
                      F.col("_z.pred").alias("pred"), F.col("_z.observed").alias("observed"), "n_nonzero", "alpha")


@dataclass(frozen=True)
class Clock:
    """Fitted clocks of all (task, fold, target), ready to score other samples.

    ``weights``: (task, fold, target, feature, coef, weight, sd) of the chosen features, ``weight`` being the coefficient on the
    scale of the data. ``lines``: (task, fold, target, line, target_line, n_nonzero, alpha): ``line`` = intercept and one number for
    each covariate of the prediction, ``target_line`` the same of the target's own covariate fit. Both are plain tables: write
    them to keep a clock.
    """

    weights: DataFrame
    lines: DataFrame

    def score(self, x: DataFrame, samples: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Scores of ``samples`` (task, fold, unit, c): (task, fold, target, unit, n_hits, pred_residual, pred_day).

        ``fold`` names the clock of each sample, such as the one that left out its animal; ``c`` holds the covariates. ``x``
        has the non-zero rows (unit, feature, value); a sample without any chosen feature gets its line. On the residual
        scale the prediction is what the covariates do not explain; on the day scale they are added again.
        """
        keys = [*extra, "task", "fold", "unit"]
        hits = (samples.select(*keys).join(x.select(*extra, "unit", "feature", "value"), [*extra, "unit"])
                .join(self.weights.select("task", "fold", "target", "feature", "weight"), ["task", "fold", "feature"])
                .groupBy(*keys, "target").agg(F.sum(F.col("weight") * F.col("value")).alias("_h"), F.count(F.lit(1)).alias("n_hits")))
        d = samples.join(self.lines, ["task", "fold"]).join(hits, [*keys, "target"], "left")
        covs = F.concat(F.array(F.lit(1.0)), F.col("c").cast("array<double>"))
        dot = lambda a: F.aggregate(F.zip_with(a, covs, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        d = d.withColumn("pred_residual", F.coalesce("_h", F.lit(0.0)) + dot(F.col("line")))
        return d.select(*keys, "target", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "pred_residual",
                        (F.col("pred_residual") + dot(F.col("target_line"))).alias("pred_day"))


def fit_clock(x: DataFrame, units: DataFrame, s: Settings = Settings(), keep: DataFrame | None = None,
              full_fit: bool = False) -> tuple[Clock, DataFrame]:
    """The fitted clocks of :func:`leave_out_regression` and its held-out predictions."""
    fitted, held, names, unit_type = _fit_grid(x, units, s, keep, full_fit)
    lines = fitted.select("task", "fold", "target", "line", "target_line", "n_nonzero", "alpha")
    return Clock(_coefficients(fitted, names), lines), _predictions(fitted, held, unit_type)


def component_scores(x: DataFrame, units: DataFrame, components: int, s: Settings = Settings()) -> DataFrame:
    """(task, fold, unit, block, y, score): every unit of every fold on the leading components of that fold's training units.

    Held-out units have a negative block. Components come from the cross-products; a second pass projects the chunks, so what follows sees
    ``components`` numbers per unit.
    """
    units = cut(units)
    x = cut(x)
    folds = _folds(units, False)
    sel = cut(screen(x, units, folds, s, None))
    blocks = cut(_blocks(units, folds, s))
    p, n_t = _width(units, "c"), _width(units, "y")

    def axes(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blk, _, k, by_rows = _unpack(pdf, s.l1)
        cols = slice(0, 1 + p + k)
        lead = NK.leading_scores_rows if by_rows else NK.leading_scores
        t = lead([b[:, cols] if by_rows else b[cols, cols] for b in blk], p, k, s.covariate_share, components)
        return pd.DataFrame([(key[0], key[1], k, t.shape[1], np.ascontiguousarray(t).tobytes())],
                            columns=["task", "fold", "k", "d", "axes"])
    proj = cut(cross_products(x, blocks, sel).groupBy("task", "fold")
               .applyInPandas(axes, "task string, fold string, k int, d int, axes binary"))
    own = sel.join(blocks.select("task", "fset").distinct(), "task")
    rows = (x.join(own, ["fset", "feature"]).join(blocks.select("task", "fset", "fold", "unit", "chunk"), ["task", "fold", "fset", "unit"])
            .select("task", "fold", "chunk", "unit", "pos", "value"))
    base = blocks.join(proj, ["task", "fold"]).select("task", "fold", "chunk", "unit", "block", "y", "c", "k", "d", "axes")
    unit_type = units.schema["unit"].dataType.simpleString()

    def score(key, vals: pd.DataFrame, us: pd.DataFrame) -> pd.DataFrame:
        us = us.sort_values("unit").reset_index(drop=True)
        if not len(us):
            return _no_rows("task", "fold", "unit", "block", "y", "score")
        k, d = int(us["k"].iloc[0]), int(us["d"].iloc[0])
        t = np.frombuffer(us["axes"].iloc[0]).reshape(-1, d)
        c = np.array(us["c"].tolist(), float).reshape(len(us), -1)
        m = np.zeros((len(us), k))
        if len(vals):
            at = pd.Series(np.arange(len(us)), index=us["unit"])
            m[at.loc[vals["unit"]].to_numpy(), vals["pos"].to_numpy(int)] = vals["value"].to_numpy(float)
        z = np.concatenate([np.ones((len(us), 1)), c, m], axis=1) @ t
        return pd.DataFrame({"task": key[0], "fold": key[1], "unit": us["unit"], "block": us["block"], "y": us["y"], "score": z.tolist()})
    keys = ["task", "fold", "chunk"]
    scores = _paired(rows, base, keys).applyInPandas(
        score, f"task string, fold string, unit {unit_type}, block int, y array<double>, score array<double>")

    return scores


def leave_out_classification(x: DataFrame, units: DataFrame, components: int = 10, s: Settings = Settings(),
                             strength: float = 1.0) -> DataFrame:
    """Held-out class probabilities from logistic regression on in-fold components (M9, M18): (task, fold, target, unit, prob, truth).

    Targets are 0/1 columns (one per class for several classes, or one per label draw), all fitted from the same sums.
    """
    from cohortspark.operators.classify import held_out_probabilities, logistic_fits
    scores = cut(component_scores(x, units, components, s))
    n_t = _width(units, "y")
    return held_out_probabilities(scores, logistic_fits(scores, n_t, strength), n_t)


def in_fold_axis(family: DataFrame, units: DataFrame, anchor: str, s: Settings = Settings()) -> DataFrame:
    """(task, fold, unit, held, axis): first component of a gene family, fitted on each fold's training units and applied to all (M4).

    ``family`` has the rows of the family's genes (:func:`feature_rows`), ``units`` the grid without covariates. The sign is that of the
    covariance with the ``anchor`` gene over the training units (positive where there is none), so axes of folds point the same way.
    The family is written once; the anchor is read off that table, and so are the axes off theirs, whoever joins them.
    """
    family = cut(family)
    sc = cut(component_scores(family, units, 1, s).select("task", "fold", "unit", (F.col("block") < 0).alias("held"), F.coalesce(F.get("score", F.lit(0)), F.lit(0.0)).alias("_s")))
    a = family.where(F.col("feature") == anchor).select("unit", F.col("value").alias("_a"))
    d = sc.join(a, "unit", "left").withColumn("_a", F.coalesce("_a", F.lit(0.0)))
    sign = d.where("NOT held").groupBy("task", "fold").agg(F.when(F.covar_pop("_s", "_a") < 0, -1.0).otherwise(1.0).alias("_d"))
    return cut(d.join(sign, ["task", "fold"]).select("task", "fold", "unit", "held", (F.col("_s") * F.col("_d")).alias("axis")))


def with_in_fold_covariate(units: DataFrame, axis: DataFrame) -> DataFrame:
    """Grid units with the axis of their fold as one more covariate (M4): every fold becomes a task of its own, since its covariates are."""
    j = units.withColumnRenamed("fold", "_own").join(axis, ["task", "unit"])
    return j.select(F.concat_ws("|", "task", "fold").alias("task"), "fset", "unit", F.when(F.col("held"), F.col("fold")).alias("fold"), "y",
                    F.concat("c", F.array("axis")).alias("c"))


# ------------------------------------------------------------------ designs on the grid

def permuted_targets(units: DataFrame, unit: str, y: str, reps: int, seed: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """Observed target (index 0) and ``reps`` re-dealt ones as one array per unit."""
    from cohortspark.operators.resample import permuted_labels
    null = permuted_labels(units, unit, y, reps, seed, within=within).groupBy(unit).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rep", F.col(y).alias("v")))), lambda e: e["v"].cast("double")).alias("_null"))
    return units.join(null, unit).withColumn("y", F.concat(F.array(F.col(y).cast("double")), "_null")).drop("_null")


def fold_scores(preds: DataFrame, units: DataFrame, covariate: bool) -> DataFrame:
    """Spearman and R2 of predictions against the full-data target residual, per (task, target); null-fold counts.

    ``units`` in grid form; with ``covariate`` the reference target is adjusted on its first covariate over all units.
    """
    from cohortspark.operators.association import grouped_spearman, residualise
    y = units.select("task", "unit", F.posexplode("y").alias("target", "truth"),
                     (F.col("c")[0] if covariate else F.lit(0.0)).alias("_c"))
    if covariate:
        y = residualise(y, "truth", "_c", ["task", "target"], "truth_adj")
    else:
        y = y.withColumn("truth_adj", F.col("truth"))
    j = preds.join(y.select("task", "unit", "target", "truth_adj"), ["task", "unit", "target"])
    rho = grouped_spearman(j, "pred", "truth_adj", ["task", "target"])
    err = F.col("pred") - F.col("truth_adj")
    r2 = j.groupBy("task", "target").agg((1 - F.sum(err * err) / (F.var_pop("truth_adj") * F.count(F.lit(1)))).alias("r2"),
                                         F.avg(err).alias("bias"), F.count_if(F.col("n_nonzero") == 0).alias("zero_feature_folds"),
                                         F.avg("n_nonzero").alias("mean_nonzero"))
    return rho.join(r2, ["task", "target"])


def max_null(scores: DataFrame) -> DataFrame:
    """Observed best over tasks against the permutation distribution of the best."""
    best = scores.groupBy("target").agg(F.max("rho").alias("best"), F.max_by("task", "rho").alias("best_task"))
    obs = best.where("target = 0").agg(F.struct(F.first("best").alias("b"), F.first("best_task").alias("t"))).scalar()
    n = best.where("target > 0").withColumn("_o", obs)
    return n.groupBy(F.col("_o.t").alias("best_task"), F.col("_o.b").alias("observed")).agg(
        F.count(F.lit(1)).alias("n_reps"), F.avg("best").alias("null_mean"), F.percentile("best", F.lit(0.95)).alias("q95"),
        ((F.count_if(F.col("best") >= F.col("_o.b") - 1e-9) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def null_of_first(scores: DataFrame) -> DataFrame:
    """Target 0 against targets 1.. per task."""
    o = scores.where("target = 0").select("task", F.col("rho").alias("observed"))
    return scores.where("target > 0").join(o, "task").groupBy("task", "observed").agg(
        F.count("rho").alias("n_reps"), F.avg("rho").alias("null_mean"), F.percentile("rho", F.lit(0.95)).alias("q95"),
        ((F.count_if(F.col("rho") >= F.col("observed") - 1e-9) + 1) / (F.count("rho") + 1)).alias("p"))


def joint_bins(genes: DataFrame, n_mean: int = 10, n_detected: int = 5) -> DataFrame:
    """``genes`` (gene_id, mean, detected) with ``bin``: equal-sized bins of mean expression crossed with bins of detection.

    Means fall between exact quantiles; detection, a share with many ties, is cut by its rank with ties by gene.
    """
    from cohortspark.functions.ordering import exact_quantiles
    names = [f"e{i}" for i in range(1, n_mean)]
    edges = exact_quantiles(genes, "mean", [i / n_mean for i in range(1, n_mean)], names).select(F.array(*names)).scalar()
    r = F.row_number().over(Window.orderBy("detected", "gene_id")) - 1                  # a gene panel fits a window partition
    n = genes.agg(F.count(F.lit(1))).scalar()
    d = genes.withColumn("_e", edges).withColumn("_r", r)
    return d.select(*genes.columns, (F.size(F.expr("filter(_e, v -> v < mean)")) * n_detected
                                     + F.floor(F.col("_r") * n_detected / n)).cast("int").alias("bin"))


def matched_sets(means: DataFrame, focus: DataFrame, n_sets: int, n_bins: int = 10, seed: int = 0, matched: bool = True
                 ) -> DataFrame:
    """Random gene sets of the size of ``focus``, optionally with its distribution over bins.

    The bins are a column ``bin`` of ``means`` if it has one (:func:`joint_bins`), else exact quantiles of the mean. A set draws, in every
    bin, as many non-focus genes as the focus set has there, by hash order. Where a bin has too few, the set is filled up from the other
    genes by the same order, so every set has the size of ``focus`` (as far as there are genes). ``matched=False`` draws from all genes.
    """
    from cohortspark.functions.ordering import exact_quantiles
    from cohortspark.functions.scalars import hash_key
    if not matched:
        binned = means.withColumn("bin", F.lit(0))
    elif "bin" in means.columns:
        binned = means
    else:
        qs = [i / n_bins for i in range(1, n_bins)]
        names = [f"e{i}" for i in range(1, n_bins)]
        e = exact_quantiles(means, "mean", qs, names).select(F.array(*names)).scalar()
        binned = means.withColumn("_e", e).withColumn("bin", F.size(F.expr("filter(_e, v -> v < mean)"))).drop("_e")
    binned = cut(binned)
    inside = binned.join(focus.select("gene_id"), "gene_id", "left_semi")
    need = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("_need"))
    pool = binned.join(focus.select("gene_id"), "gene_id", "left_anti")
    w = Window.partitionBy("set_no", "bin").orderBy("_h")
    bins = cut(need.join(pool.groupBy("bin").agg(F.count(F.lit(1)).alias("_have")), "bin", "left").withColumn("_have", F.coalesce("_have", F.lit(0))))
    short, whole = bins.agg(F.sum(F.greatest(F.lit(0), F.col("_need") - F.col("_have"))), F.sum(F.least("_need", "_have"))).first()
    draw = (_spread(pool, "gene_id").join(bins, "bin").select("gene_id", "_need", "_have", "bin", F.explode(F.sequence(F.lit(1), F.lit(n_sets))).alias("set_no"))
            .withColumn("_h", hash_key("gene_id", "set_no", F.lit(seed))))
    first = lambda df: df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_need")).select("set_no", "gene_id")
    # only hashes that can be among the first of a bin are sorted: ten deviations more than it needs; a draw that still lacks one sorts all
    share = F.least(F.lit(1.0), (F.col("_need") + 10 * F.sqrt("_need") + 50) / F.greatest("_have", F.lit(1)))
    chosen = cut(first(draw.where((share >= 1) | (F.substring("_h", 1, 8) < F.lower(F.lpad(F.hex((share * 2 ** 32).cast("bigint")), 8, "0"))))))
    if chosen.count() < (whole or 0) * n_sets:
        chosen = first(draw)
    if short:
        sets = F.explode(F.sequence(F.lit(1), F.lit(n_sets))).alias("set_no")
        left = pool.select("gene_id", sets).join(chosen, ["set_no", "gene_id"], "left_anti")
        v = Window.partitionBy("set_no").orderBy(hash_key("gene_id", "set_no", F.lit(seed)))
        chosen = chosen.unionByName(left.withColumn("_r", F.row_number().over(v)).where(F.col("_r") <= short).select("set_no", "gene_id"))
    return inside.select(F.lit(0).alias("set_no"), "gene_id").unionByName(chosen)


def set_null(scores: DataFrame) -> DataFrame:
    """Focus set (task '0') against the drawn sets (M13): where its rho lies, with the folds that chose no feature."""
    seen = scores.where("task = '0'").select(F.col("rho").alias("observed"), F.col("zero_feature_folds").alias("observed_zero_folds"))
    # one row with the observed value beside every drawn set
    null = scores.where("task <> '0'").crossJoin(seen)
    q = lambda v: F.percentile("rho", F.lit(v))
    over = F.count_if(F.col("rho") >= F.col("observed") - 1e-9)
    return null.groupBy("observed", "observed_zero_folds").agg(
        F.count("rho").alias("n_sets"), F.avg("rho").alias("null_mean"), F.stddev_pop("rho").alias("null_sd"), q(0.05).alias("q05"), q(0.5).alias("q50"),
        q(0.95).alias("q95"), (F.count_if(F.col("rho") < F.col("observed") - 1e-9) / F.count("rho")).alias("below_share"), ((over + 1) / (F.count("rho") + 1)).alias("p"),
        F.count_if(F.col("zero_feature_folds") > 0).alias("sets_with_zero_fold"))


def learning_curve_units(units: DataFrame, unit: str, fractions: Sequence[float], draws: int, seed: int = 0) -> DataFrame:
    """Training subsets per (fraction, draw, held-out unit) (M17): columns task, held, role plus the unit columns."""
    from cohortspark.functions.scalars import hash_key
    held = units.select(F.col(unit).alias("held"),
                        F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pool = units.agg(F.collect_list(unit)).scalar()   # the unit ids of a study
    g = held.withColumn("_u", pool).select("held", "fraction", "draw", F.explode("_u").alias(unit))
    w = Window.partitionBy("held", "fraction", "draw", F.col(unit) == F.col("held")).orderBy(hash_key(unit, "held", "draw", F.lit(seed)))
    n = F.count(F.lit(1)).over(Window.partitionBy("held", "fraction", "draw", F.col(unit) == F.col("held")))
    g = (g.withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
         .where((F.col(unit) == F.col("held")) | (F.col("_r") <= F.greatest(F.lit(3), F.round(F.col("_n") * F.col("fraction"))))))
    g = g.withColumn("task", F.concat_ws("|", F.col("fraction"), F.col("draw"), F.col("held")))
    return g.withColumn("fold", F.when(F.col(unit) == F.col("held"), F.col("held").cast("string"))) \
        .select("task", "fraction", "draw", "fold", unit).join(units, unit)


def score_frozen(x: DataFrame, model: DataFrame, units: DataFrame, keys: Sequence[str], feature: str = "gene_id", value: str = "value",
                 intercept: float = 0.0) -> DataFrame:
    """Apply a fitted linear model (feature, beta, mean, sd) to new samples (M6, M24); absent genes are zeros.

    The zeros' part ``-beta mean / sd`` is a constant of the model, so only non-zero rows are joined. Every row of ``units``
    gets a score; without any gene of the model it is that constant.
    """
    base = model.agg(F.sum(-F.col("beta") * F.col("mean") / F.col("sd"))).scalar()
    hit = x.join(model, feature).groupBy(*keys).agg(F.sum(F.col("beta") * F.col(value) / F.col("sd")).alias("_h"),
                                                    F.count(F.lit(1)).alias("n_hits"))
    every = units.select(*keys).distinct().join(hit, list(keys), "left")
    return every.select(*keys, F.coalesce("n_hits", F.lit(0)).alias("n_hits"), (F.coalesce("_h", F.lit(0.0)) + base + F.lit(intercept)).alias("pred"))


def thin_counts(expr: DataFrame, keys: Sequence[str], seed: int = 0, count: str = "cnt") -> DataFrame:
    """Binomial halves of every count (M7): the bits set among the first ``cnt`` bits of a hashed stream.

    Two columns, ``half_a`` and ``half_b``, adding up to the count. One 32-bit word covers 32 counts. A row is thinned by
    itself, so nothing is kept but the row; rows with the same keys and count thin alike.
    """
    from cohortspark.functions.scalars import hash_u32
    words = F.sequence(F.lit(0), F.floor((F.col(count) - 1) / 32).cast("int"))

    def ones(w):
        bits = F.least(F.lit(32), F.col(count) - w * 32).cast("int")
        mask = (F.pow(F.lit(2.0), bits) - 1).cast("bigint")
        return F.bit_count(hash_u32(*keys, w, F.lit(seed)).bitwiseAND(mask)).cast("bigint")
    half = F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s + ones(w))
    return (expr.where(F.col(count).isNotNull()).select(*keys, count, half.alias("half_a"))
            .withColumn("half_b", F.col(count) - F.col("half_a")))


COMPONENT_ROWS = ("component int, t int, phi double, eigenvalue double, share double, chosen boolean, support long, mu double, noise double, "
                  "clipped double")


def functional_components(aligned: DataFrame, max_k: int = 3, least_fit: int = 5, share: float = 0.90) -> DataFrame:
    """Eigenfunctions of the pairwise covariance of curves aligned at onset (M22): one row for each component and day.

    The days run up to the last one with ``least_fit`` curves. Negative eigenvalues are clipped (``clipped``: their part of
    the absolute sum). ``chosen`` marks the leading components: as many as explain ``share``, ``max_k`` at most. ``noise`` is
    the variance on the diagonal that the chosen ones leave, 0.001 at least. The surface has a row for each pair of days, a few
    dozen in a study, so one task solves it.
    """
    from cohortspark.operators.curves import covariance_surface
    days = aligned.groupBy("t").agg(F.count("score").alias("support"), F.avg("score").alias("mu"))
    last = days.where(F.col("support") >= least_fit).agg(F.max("t").alias("_last"))
    days = days.join(F.broadcast(last), F.col("t") <= F.col("_last")).drop("_last")
    kept = aligned.join(days.select("t"), "t", "left_semi")
    surface = covariance_surface(kept).select("t1", "t2", "cov")
    info = days.select(F.col("t").alias("t1"), F.lit(-1).alias("t2"), F.col("mu").alias("cov"), F.col("support"))
    rows = surface.select(F.col("t1").cast("int"), F.col("t2").cast("int"), "cov", F.lit(0).cast("long").alias("support")).unionByName(
        info.select(F.col("t1").cast("int"), "t2", "cov", "support"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        by_day = pdf[pdf["t2"] == -1].set_index("t1").sort_index()
        n = len(by_day)
        table = pdf[pdf["t2"] != -1].pivot(index="t1", columns="t2", values="cov").reindex(index=by_day.index, columns=by_day.index).fillna(0.0).to_numpy()
        surface = (table + table.T) / 2
        roots, axes = np.linalg.eigh(surface)
        positive, axes = np.maximum(roots[::-1], 0.0), axes[:, ::-1]
        # the trace is the sum of all roots, so the negative ones weigh what the positive ones have too much
        trace, gross = float(np.trace(surface)), max(float(positive.sum()), 1e-300)
        clipped = (gross - trace) / (2 * gross - trace)
        # enough components: the first number of them that leaves at most 1 - share of the positive part
        left = gross - np.cumsum(positive)
        enough = min(max_k, n, 1 + int((left > (1 - share) * gross).sum()))
        # axes have length one, so what they take from the diagonal is their roots
        noise = max((trace - float(positive[:enough].sum())) / n, 0.001)
        axes = axes * np.where(axes.sum(axis=0) < 0, -1.0, 1.0)
        made = [pd.DataFrame({"component": c + 1, "t": by_day.index, "phi": axes[:, c], "eigenvalue": positive[c], "share": positive[c] / gross,
                              "chosen": c < enough, "support": by_day["support"].to_numpy(), "mu": by_day["cov"].to_numpy(), "noise": noise,
                              "clipped": max(clipped, 0.0)}) for c in range(min(max_k, n))]
        return pd.concat(made) if made else pd.DataFrame(columns=[c.split()[0] for c in COMPONENT_ROWS.split(", ")])
    return rows.groupBy(F.lit(0).alias("_one")).applyInPandas(solve, COMPONENT_ROWS)


def functional_summary(components: DataFrame, least_interpret: int = 15, warn: float = 0.10) -> DataFrame:
    """Per component: explained share, whether chosen, the loading on days with under ``least_interpret`` curves, noise, and
    whether the clipped mass asks for another method (M22)."""
    thin = F.when(F.col("support") < least_interpret, F.col("phi") * F.col("phi")).otherwise(0.0)
    return components.groupBy("component").agg(F.max("share").alias("share"), F.bool_and("chosen").alias("chosen"), F.sum(thin).alias("tail_mass"),
                                              F.max("noise").alias("noise"), F.max("clipped").alias("clipped"),
                                              (F.max("clipped") > warn).alias("fallback"), F.max("t").alias("last_day"))


def functional_scores(aligned: DataFrame, components: DataFrame, unit: str = "animal_id") -> DataFrame:
    """Scores of each curve on the chosen components from the days it has.

    The conditional mean given the points needs only two sums over a curve's days, of phi phi' and of phi r: the scores solve
    ``(sum phi phi' + noise / eigenvalue) x = sum phi r``, K equations for K components, however long the curve is.
    """
    basis = components.where("chosen").groupBy("t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "phi"))), lambda e: e["phi"]).alias("phi"), F.first("mu").alias("mu"))
    ridge = components.where("chosen").select("component", (F.col("noise") / F.greatest(F.col("eigenvalue"), F.lit(1e-12))).alias("r")).distinct()
    ridge = ridge.agg(F.array_sort(F.collect_list(F.struct("component", "r"))).alias("_a")).select(F.transform("_a", lambda e: e["r"]).alias("ridge"))
    d = aligned.where("score IS NOT NULL").join(basis, "t").select(unit, "phi", (F.col("score") - F.col("mu")).alias("r"))
    i = d.select(unit, F.posexplode("phi").alias("i", "a"), "phi", "r")
    sums = i.select(unit, "i", "a", "r", F.posexplode("phi").alias("j", "b")).groupBy(unit, "i", "j").agg(
        F.sum(F.col("a") * F.col("b")).alias("pp"), F.sum(F.col("a") * F.col("r")).alias("pr"))
    one = sums.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("i", "j", "pp", "pr"))).alias("s")).join(F.broadcast(ridge))
    kind = aligned.schema[unit].dataType.simpleString()

    def solve(frames):
        for pdf in frames:
            out = []
            for key, s, r in zip(pdf[unit], pdf["s"], pdf["ridge"]):
                k = len(r)
                m = np.array([e["pp"] for e in s]).reshape(k, k) + np.diag(r)
                x = np.linalg.solve(m, np.array([e["pr"] for e in s]).reshape(k, k)[:, 0])
                out += [(key, c + 1, float(v)) for c, v in enumerate(x)]
            yield pd.DataFrame(out, columns=[unit, "component", "score"])
    return one.mapInPandas(solve, f"{unit} {kind}, component int, score double")
