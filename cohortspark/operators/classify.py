"""Classifiers fitted from aggregates (M9, M18): penalised logistic regression and boosted trees over folds, classes and label draws.

Both see rows (task, fold, unit, block, y, score) of :func:`cohortspark.operators.grid.component_scores`: a negative block is held out, ``y``
is an array with one 0/1 label for each target, ``score`` the row's components. Observed and permuted labels, and the classes of a label,
are targets side by side. No task holds a whole fold: tasks turn chunks of rows into sums, and only sums meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import kernels as NK
from cohortspark.operators.grid import _no_rows, _paired
from cohortspark.session import cut, discard

CHUNK = 4096               # rows that one task turns into sums
ROUNDS = 100               # Newton steps after which a fit counts as failed; six to ten are usual
FIXED = 35.0               # intercept of a target with only one kind of label

STATE = "task string, fold string, base binary, step binary, size binary, loss binary, gap double"


def _state_row(task, fold, base, step, size, loss, gap) -> pd.DataFrame:
    return pd.DataFrame({"task": [task], "fold": [fold], "base": [base.tobytes()], "step": [step.tobytes()], "size": [size.tobytes()],
                         "loss": [loss.tobytes()], "gap": [float(gap)]})


def logistic_fits(scores: DataFrame, n_targets: int, strength: float = 1.0, tol: float = 1e-7) -> DataFrame:
    """L2-penalised logistic regressions of every (task, fold, target) by damped Newton steps: (task, fold, base, ...), ``base`` holding
    the coefficients (targets, 1 + components), intercept first and unpenalised.

    A step is one job: chunks of training rows give loss, gradient and Hessian of all targets at once, their sums give the next step. A step
    that made a target's loss grow is halved. Targets with only one kind of label keep a fixed intercept of that sign.
    """
    train = cut(scores.where("block >= 0").select("task", "fold", "unit", "y", "score"))
    sizes = train.groupBy("task", "fold").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("score")).alias("_d"))
    sizes = sizes.withColumn("_chunks", F.ceil(F.col("_n") / CHUNK).cast("int"))
    chunked = cut(train.join(sizes.select("task", "fold", "_chunks"), ["task", "fold"])
                  .withColumn("chunk", F.pmod(F.xxhash64("unit"), F.col("_chunks")).cast("int")).drop("_chunks", "unit"))
    places = cut(sizes.select("task", "fold", "_d", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk")))

    def start(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                w = np.zeros((n_targets, 1 + int(r[2])))
                yield _state_row(r[0], r[1], w, w, np.ones(n_targets), np.full(n_targets, np.inf), np.inf)
    state = cut(sizes.select("task", "fold", F.col("_d").cast("int")).mapInPandas(start, STATE))

    def partial(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame({"task": [], "fold": [], "sums": []})
        z = np.array(rows["score"].tolist(), float).reshape(len(rows), -1)
        a = np.c_[np.ones(len(z)), z]
        y = np.array(rows["y"].tolist(), float).reshape(len(rows), -1)
        base, step = (np.frombuffer(own[c].iloc[0]).reshape(n_targets, -1) for c in ("base", "step"))
        w = base + np.frombuffer(own["size"].iloc[0])[:, None] * step
        eta = a @ w.T
        mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
        loss = np.logaddexp(0, eta).sum(0) - (y * eta).sum(0)
        i, j = np.triu_indices(a.shape[1])
        hess = (mu * (1 - mu)).T @ (a[:, i] * a[:, j])
        sums = np.concatenate([loss[:, None], y.sum(0)[:, None], np.full((n_targets, 1), len(y)), (mu - y).T @ a, hess], axis=1)
        return pd.DataFrame({"task": [key[0]], "fold": [key[1]], "sums": [sums.tobytes()]})

    def advance(key, parts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(b).reshape(n_targets, -1) for b in parts["sums"])
        base, step = (np.frombuffer(own[c].iloc[0]).reshape(n_targets, -1).copy() for c in ("base", "step"))
        size, best = np.frombuffer(own["size"].iloc[0]).copy(), np.frombuffer(own["loss"].iloc[0]).copy()
        m = base.shape[1]
        pen = np.r_[0.0, np.full(m - 1, 1.0 / strength)]
        w = base + size[:, None] * step
        loss = sums[:, 0] + 0.5 * (pen * w * w).sum(1)
        one_kind = (sums[:, 1] == 0) | (sums[:, 1] == sums[:, 2])
        worse = (loss > best + 1e-10 * np.maximum(1, np.abs(best))) & ~one_kind & (size > 1e-6)
        i, j = np.triu_indices(m)
        hess = np.empty((n_targets, m, m))
        hess[:, i, j] = hess[:, j, i] = sums[:, 3 + m:]
        grad = sums[:, 3:3 + m] + pen * w
        fresh = -np.linalg.solve(hess + np.diag(pen + 1e-9), grad[:, :, None])[:, :, 0]
        ok = ~worse
        base[ok], step[ok], size[ok], best[ok] = w[ok], fresh[ok], 1.0, loss[ok]
        size[worse] /= 2
        base[one_kind], step[one_kind] = 0.0, 0.0
        base[one_kind, 0] = np.where(sums[one_kind, 1] == 0, -FIXED, FIXED)
        gap = np.abs(size[:, None] * step).max(1)
        return _state_row(key[0], key[1], base, step, size, best, gap.max())
    for _ in range(ROUNDS):
        sums = _paired(chunked, places.join(state, ["task", "fold"]), ["task", "fold", "chunk"]).applyInPandas(
            partial, "task string, fold string, sums binary")
        new = cut(_paired(sums, state, ["task", "fold"]).applyInPandas(advance, STATE))
        discard(state.sparkSession, state)
        state = new
        if (state.agg(F.max("gap")).first()[0] or 0.0) < tol:        # one number; no fold, no gap
            return state
    raise ArithmeticError("a logistic fit did not settle")


def held_out_probabilities(scores: DataFrame, fits: DataFrame, n_targets: int) -> DataFrame:
    """(task, fold, target, unit, prob, truth) of the held-out rows."""
    kind = scores.schema["unit"].dataType.simpleString()
    rows = scores.where("block < 0").select("task", "fold", "unit", "y", "score", F.col("block").alias("chunk"))
    own = rows.select("task", "fold", "chunk").distinct().join(fits.select("task", "fold", "base"), ["task", "fold"])

    def apply(key, pdf: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(fit):
            return _no_rows("task", "fold", "target", "unit", "prob", "truth")
        z = np.array(pdf["score"].tolist(), float).reshape(len(pdf), -1)
        w = np.frombuffer(fit["base"].iloc[0]).reshape(n_targets, -1)
        prob = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(z)), z] @ w.T, -500, 500)))
        y = np.array(pdf["y"].tolist(), float).reshape(len(pdf), -1)
        n = len(pdf)
        return pd.DataFrame({"task": key[0], "fold": key[1], "target": np.tile(np.arange(n_targets), n), "unit": np.repeat(pdf["unit"].to_numpy(), n_targets),
                             "prob": prob.ravel(), "truth": y.ravel()})
    return _paired(rows, own, ["task", "fold", "chunk"]).applyInPandas(
        apply, f"task string, fold string, target int, unit {kind}, prob double, truth double")


# ------------------------------------------------------------------ boosted trees

def boosted_trees(scores: DataFrame, n_targets: int, rounds: int = 8, depth: int = 2, rate: float = 0.3, bins: int = 32, least: int = 5,
                  ridge: float = 1.0) -> DataFrame:
    """(task, fold, target, unit, prob, truth) of held-out rows from trees boosted on the logistic loss, all fits side by side.

    Components have unit spread in the training rows, so a fixed rising map (``bins`` steps of a logistic curve) bins them without a pass.
    A level of a tree is one aggregate of gradients by (fit, node, component, bin); prefix sums over the bins give the best cut of each
    node, with at least ``least`` training rows on either side. Held-out rows run along and count in no sum. Built-in functions only.
    """
    keys = ["task", "fold", "target"]
    d = scores.select("task", "fold", "unit", (F.col("block") >= 0).alias("_train"), "y",
                      F.transform("score", lambda v: F.least(F.lit(bins - 1), F.floor(bins / (1 + F.exp(-1.702 * v)))).cast("int")).alias("_bins"))
    d = d.select("task", "fold", "unit", "_train", "_bins", F.posexplode("y").alias("target", "_y")).where(F.col("target") < n_targets)
    rate0 = d.where("_train").groupBy(*keys).agg(F.avg("_y").alias("_m"))
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_m")))
    d = cut(d.join(rate0, keys).withColumn("_f", F.log(share / (1 - share))).drop("_m").withColumn("_node", F.lit(1)))
    p = 1 / (1 + F.exp(-F.col("_f")))
    for _ in range(rounds):
        for _ in range(depth):
            t = d.where("_train").withColumn("_g", F.col("_y") - p).withColumn("_h", p * (1 - p))
            cells = t.select(*keys, "_node", "_g", "_h", F.posexplode("_bins").alias("_c", "_b")).groupBy(*keys, "_node", "_c", "_b").agg(
                F.sum("_g").alias("_g"), F.sum("_h").alias("_h"), F.count(F.lit(1)).alias("_n"))
            part = Window.partitionBy(*keys, "_node", "_c")
            left = part.orderBy("_b")
            cells = cells.select("*", *[F.sum(c).over(left).alias(f"l{c}") for c in ("_g", "_h", "_n")], *[F.sum(c).over(part).alias(f"a{c}") for c in ("_g", "_h", "_n")])
            gain = (F.pow("l_g", F.lit(2.0)) / (F.col("l_h") + ridge) + F.pow(F.col("a_g") - F.col("l_g"), F.lit(2.0)) / (F.col("a_h") - F.col("l_h") + ridge)
                    - F.pow("a_g", F.lit(2.0)) / (F.col("a_h") + ridge))
            cells = cells.withColumn("_gain", F.round(gain, 9)).where((F.col("l_n") >= least) & (F.col("a_n") - F.col("l_n") >= least) & (F.col("_gain") > 0))
            # the best cut; equal gains go to the first component and bin
            best = cells.groupBy(*keys, "_node").agg(F.max(F.struct("_gain", (-F.col("_c")).alias("c"), (-F.col("_b")).alias("b"))).alias("_best"))
            best = best.select(*keys, "_node", (-F.col("_best.c")).alias("_cut_c"), (-F.col("_best.b")).alias("_cut_b"))
            right = (F.element_at("_bins", F.coalesce(F.col("_cut_c"), F.lit(0)) + 1) > F.col("_cut_b")).cast("int")
            new = cut(d.join(best, [*keys, "_node"], "left").withColumn("_node", F.col("_node") * 2 + F.coalesce(right, F.lit(0))).drop("_cut_c", "_cut_b"))
            discard(d.sparkSession, d)
            d = new
        leaf = d.where("_train").groupBy(*keys, "_node").agg((rate * F.sum(F.col("_y") - p) / (F.sum(p * (1 - p)) + ridge)).alias("_v"))
        d = d.join(leaf, [*keys, "_node"], "left").withColumn("_f", F.col("_f") + F.coalesce("_v", F.lit(0.0))).drop("_v").withColumn("_node", F.lit(1))
        d = cut(d)
    return d.where("NOT _train").select(*keys, "unit", p.alias("prob"), F.col("_y").alias("truth"))


# ------------------------------------------------------------------ scores of labels

def class_targets(labels: DataFrame, classes: int, code: str = "code") -> DataFrame:
    """(unit columns, y): one-hot labels of every draw; target = draw * classes + class. ``code`` is an array of class codes by draw."""
    hot = F.flatten(F.transform(code, lambda v: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (v == k).cast("double"))))
    return labels.withColumn("y", hot)


def balanced_accuracy(probs: DataFrame, classes: int) -> DataFrame:
    """(task, rep, n, classes, balanced_accuracy): mean recall over the classes that occur, of the most probable class."""
    d = probs.withColumn("rep", F.floor(F.col("target") / classes).cast("int")).withColumn("_k", F.col("target") % classes)
    each = d.groupBy("task", "rep", "unit").agg(F.max(F.struct(F.round("prob", 9).alias("p"), (-F.col("_k")).alias("k"))).alias("_best"),
                                                F.max_by("_k", "truth").alias("_true"))
    recall = each.groupBy("task", "rep", "_true").agg(F.count(F.lit(1)).alias("_n"), F.avg((-F.col("_best.k") == F.col("_true")).cast("double")).alias("_r"))
    return recall.groupBy("task", "rep").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("classes"), F.avg("_r").alias("balanced_accuracy"))


def draw_null(scores: DataFrame, stat: str) -> DataFrame:
    """Draw 0 against draws 1.. of each task: observed, null mean and 95 % point, p = (1 + hits) / (1 + draws)."""
    seen = scores.where("rep = 0").select("task", F.col(stat).alias("observed"))
    return scores.where("rep > 0").join(seen, "task").groupBy("task", "observed").agg(
        F.count(stat).alias("n_reps"), F.avg(stat).alias("null_mean"), F.percentile(stat, F.lit(0.95)).alias("q95"),
        ((F.count_if(F.col(stat) >= F.col("observed") - 1e-9) + 1) / (F.count(stat) + 1)).alias("p"))


def plain_logistic(z: np.ndarray, y: np.ndarray, strength: float) -> np.ndarray:
    """The same fit from all rows at once; for tests and small uses."""
    return NK.logistic(z, y, strength)
