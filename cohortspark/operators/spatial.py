"""Spatial joins and lesion geometry.

Coordinates are comparable inside a section only, so ``section_id`` is an equality key of every join here. A section
may hold any share of all cells: work is spread over grid cells of a section, not over sections.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.ordering import exact_quantiles, top_k
from cohortspark.functions.scalars import ratio
from cohortspark.operators.components import connected_components
from cohortspark.session import cut

SEC, CELL = "section_id", "cell_id"


def dist2(x1, y1, x2, y2) -> Column:
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return dx * dx + dy * dy


# ------------------------------------------------------------------ k nearest neighbours

LEVELS = (12, 18, 24, 30)


def _depth(points: DataFrame, room: int) -> int:
    """The least of LEVELS at which no grid cell holds more than ``room`` distinct locations (else the last): a small
    job that runs while the plan is built, as the depth is part of it."""
    loc = points.select(SEC, "_gx", "_gy", "x", "y").distinct()
    lv = loc.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in LEVELS])))
    n = lv.groupBy(SEC, "_lv", F.expr(f"shiftright(_gx, {LEVELS[-1]} - _lv)"), F.expr(f"shiftright(_gy, {LEVELS[-1]} - _lv)")).agg(F.count(F.lit(1)).alias("n"))
    most = {r["_lv"]: r["m"] for r in n.groupBy("_lv").agg(F.max("n").alias("m")).collect()}
    return next((v for v in LEVELS if most.get(v, 0) <= room), LEVELS[-1])


def knn(points: DataFrame, k: int) -> DataFrame:
    """Exact k nearest neighbours inside a section, self excluded, ties by cell id: (section, src, dst, dist, nn).

    Adaptive grid: each section's own bounding square is halved as often as its most crowded spot needs (:func:`_depth`). A point searches from the deepest grid cell around
    it that holds more than ``k`` points; those points lie within that cell's diagonal, so only grid cells of the
    same level touching that radius can hold neighbours. Search cells are thus small where points are dense and large
    where they are sparse, and a point is offered to at most a few hundred others per level however uneven the
    section is. Points at one location keep only their ``k + 1`` smallest ids as candidates (ties go by id, so no
    other can be a neighbour). ``row_number <= k`` is limited per task before the final shuffle.
    """
    p = points.select(SEC, CELL, F.col("x").cast("double"), F.col("y").cast("double"))
    box = p.groupBy(SEC).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"),
                             (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * 1.000001 + 1e-9).alias("_side"))
    finest = LEVELS[-1]
    p = p.join(box, SEC)
    p = p.withColumns({g: F.least(F.floor((F.col(x) - F.col(o)) / F.col("_side") * float(2 ** finest)), F.lit(2 ** finest - 1))
                       for g, x, o in (("_gx", "x", "_x0"), ("_gy", "y", "_y0"))})
    levels = _depth(p, 4 * (k + 1))
    p = p.select(SEC, CELL, "x", "y", "_side", "_x0", "_y0", F.shiftright("_gx", finest - levels).alias("_gx"),
                 F.shiftright("_gy", finest - levels).alias("_gy"))
    cand = top_k(p, [F.col(CELL)], k + 1, [SEC, "x", "y"])

    def at_level(df):
        lv = df.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        return (lv.withColumn("_cx", F.expr(f"shiftright(_gx, {levels} - _lv)"))
                .withColumn("_cy", F.expr(f"shiftright(_gy, {levels} - _lv)")))
    cells = cand.groupBy(SEC, "_gx", "_gy").agg(F.count(F.lit(1)).alias("_n"))
    nodes = at_level(cells).groupBy(SEC, "_lv", "_cx", "_cy").agg(F.sum("_n").alias("_n")).where(F.col("_n") > k)
    deepest = (at_level(cells).join(nodes.drop("_n"), [SEC, "_lv", "_cx", "_cy"])
               .groupBy(SEC, "_gx", "_gy").agg(F.max("_lv").alias("_lv")))
    q = (p.join(deepest, [SEC, "_gx", "_gy"], "left")
         .withColumn("_lv", F.coalesce("_lv", F.lit(0)))
         .withColumn("_s", F.col("_side") / F.pow(F.lit(2.0), F.col("_lv"))))
    # a section with at most k other points searches its single level-0 cell whole
    r = F.col("_s") * (math.sqrt(2.0) * 1.0000001)
    lo_x, hi_x = (F.col("x") - r - F.col("_x0")) / F.col("_s"), (F.col("x") + r - F.col("_x0")) / F.col("_s")
    lo_y, hi_y = (F.col("y") - r - F.col("_y0")) / F.col("_s"), (F.col("y") + r - F.col("_y0")) / F.col("_s")
    top = F.pow(F.lit(2.0), F.col("_lv")) - 1

    def span(lo, hi):
        return F.sequence(F.greatest(F.floor(lo), F.lit(0)).cast("bigint"), F.least(F.floor(hi), top).cast("bigint"))
    q = (q.withColumn("_r2", r * r).withColumn("_cx", F.explode(span(lo_x, hi_x)))
         .withColumn("_cy", F.explode(span(lo_y, hi_y))))
    near_x = F.greatest(F.col("_x0") + F.col("_cx") * F.col("_s") - F.col("x"),
                        F.col("x") - F.col("_x0") - (F.col("_cx") + 1) * F.col("_s"), F.lit(0.0))
    near_y = F.greatest(F.col("_y0") + F.col("_cy") * F.col("_s") - F.col("y"),
                        F.col("y") - F.col("_y0") - (F.col("_cy") + 1) * F.col("_s"), F.lit(0.0))
    q = (q.where(near_x * near_x + near_y * near_y <= F.col("_r2"))
         .select(SEC, "_lv", "_cx", "_cy", F.col(CELL).alias("src"), "x", "y"))
    c = at_level(cand).select(SEC, "_lv", "_cx", "_cy", F.col(CELL).alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = q.join(c, [SEC, "_lv", "_cx", "_cy"]).where("src <> dst").withColumn("_d", dist2("x", "y", "x2", "y2"))
    w = Window.partitionBy(SEC, "src").orderBy("_d", "dst")
    return (j.select(SEC, "src", "dst", "_d").withColumn("nn", F.row_number().over(w)).where(F.col("nn") <= k)
            .select(SEC, "src", "dst", F.sqrt("_d").alias("dist"), "nn"))


# ------------------------------------------------------------------ radius joins

def _grid(df: DataFrame, side: float) -> DataFrame:
    return df.withColumn("_gx", F.floor(F.col("x") / side)).withColumn("_gy", F.floor(F.col("y") / side))


def _ring(df: DataFrame, reach: int) -> DataFrame:
    around = F.sequence(F.lit(-reach), F.lit(reach))
    return (df.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
            .withColumn("_gx", F.col("_gx") + F.col("_dx")).withColumn("_gy", F.col("_gy") + F.col("_dy"))
            .drop("_dx", "_dy"))


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (src of left, dst of right) inside a section at most ``radius`` apart (J9), by grid buckets."""
    a = _ring(_grid(left, radius), 1).select(SEC, "_gx", "_gy", F.col(CELL).alias("src"), "x", "y")
    b = _grid(right, radius).select(SEC, "_gx", "_gy", F.col(CELL).alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = a.join(b, [SEC, "_gx", "_gy"]).withColumn("_d", dist2("x", "y", "x2", "y2"))
    return d.where(F.col("_d") <= radius * radius).select(SEC, "src", "dst", F.sqrt("_d").alias("dist"))


def neighbour_counts(points: DataFrame, radius: float) -> DataFrame:
    """Points within ``radius`` of every point, itself included. Pairs are counted per location, never listed."""
    loc = points.groupBy(SEC, "x", "y").agg(F.count(F.lit(1)).alias("_w"))
    a = _ring(_grid(loc, radius), 1).select(SEC, "_gx", "_gy", "x", "y")
    b = _grid(loc, radius).select(SEC, "_gx", "_gy", F.col("x").alias("x2"), F.col("y").alias("y2"), "_w")
    n = (a.join(b, [SEC, "_gx", "_gy"]).where(dist2("x", "y", "x2", "y2") <= radius * radius)
         .groupBy(SEC, "x", "y").agg(F.sum("_w").alias("n_near")))
    return points.join(n, [SEC, "x", "y"])


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Density clusters inside each section (G4): (section, cell, core, lesion); noise has a NULL lesion.

    A lesion is named by its smallest core cell. A border cell joins the smallest adjacent lesion (visit order would
    be arbitrary). The grid side is eps / sqrt 2, so points of one grid cell are always neighbours: a cell with
    ``min_samples`` points is core throughout and connected without forming a pair, and links between two cells are
    settled from their bounding boxes where possible. Point pairs are formed only for thin cells and undecided links.
    """
    side = eps / math.sqrt(2.0)
    e2 = eps * eps
    p = _grid(points.select(SEC, CELL, "x", "y"), side)
    full = p.groupBy(SEC, "_gx", "_gy").agg(F.count(F.lit(1)).alias("_n"))
    p = p.join(full, [SEC, "_gx", "_gy"])
    thin = p.where(F.col("_n") < min_samples)
    # thin points: neighbours are counted over locations of the 5 x 5 surrounding cells
    loc = p.groupBy(SEC, "_gx", "_gy", "x", "y").agg(F.count(F.lit(1)).alias("_w")) \
        .select(SEC, "_gx", "_gy", F.col("x").alias("x2"), F.col("y").alias("y2"), "_w")
    near = (_ring(thin.select(SEC, CELL, "x", "y", "_gx", "_gy"), 2).join(loc, [SEC, "_gx", "_gy"])
            .where(dist2("x", "y", "x2", "y2") <= e2).groupBy(SEC, CELL).agg(F.sum("_w").alias("_deg")))
    core = (p.join(near, [SEC, CELL], "left")
            .withColumn("core", (F.col("_n") >= min_samples) | (F.coalesce("_deg", F.lit(0)) >= min_samples)).drop("_deg", "_n"))
    core = cut(core)   # read six times below
    cores = core.where("core").drop("core")
    box = cores.groupBy(SEC, "_gx", "_gy").agg(F.min(CELL).alias("rep"), F.min("x").alias("xl"), F.max("x").alias("xh"),
                                               F.min("y").alias("yl"), F.max("y").alias("yh"))
    names = ["rep", "xl", "xh", "yl", "yh"]
    other = box.select(SEC, "_gx", "_gy", *[F.col(v).alias(f"{v}2") for v in names])
    link = _ring(box.withColumn("_hx", F.col("_gx")).withColumn("_hy", F.col("_gy")), 2) \
        .join(other, [SEC, "_gx", "_gy"]).where("rep < rep2")
    gap_x = F.greatest(F.col("xl2") - F.col("xh"), F.col("xl") - F.col("xh2"), F.lit(0.0))
    gap_y = F.greatest(F.col("yl2") - F.col("yh"), F.col("yl") - F.col("yh2"), F.lit(0.0))
    far_x = F.greatest(F.col("xh2") - F.col("xl"), F.col("xh") - F.col("xl2"))
    far_y = F.greatest(F.col("yh2") - F.col("yl"), F.col("yh") - F.col("yl2"))
    link = link.where(gap_x * gap_x + gap_y * gap_y <= e2)
    sure = link.where(far_x * far_x + far_y * far_y <= e2).select(SEC, F.col("rep").alias("a"), F.col("rep2").alias("b"))
    open_ = link.where(far_x * far_x + far_y * far_y > e2)

    def edge_of(v, lo, hi):
        return F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    cl = cores.dropDuplicates([SEC, "x", "y"]).select(SEC, "_gx", "_gy", "x", "y")
    # of each undecided pair only points that reach the other side's box take part
    left = open_.select(SEC, F.col("_hx"), F.col("_hy"), "_gx", "_gy", "rep", "rep2", "xl2", "xh2", "yl2", "yh2") \
        .join(cl.select(SEC, F.col("_gx").alias("_hx"), F.col("_gy").alias("_hy"), "x", "y"), [SEC, "_hx", "_hy"])
    ex, ey = edge_of("x", "xl2", "xh2"), edge_of("y", "yl2", "yh2")
    left = left.where(ex * ex + ey * ey <= e2)
    hit = (left.join(cl.select(SEC, "_gx", "_gy", F.col("x").alias("x2"), F.col("y").alias("y2")), [SEC, "_gx", "_gy"])
           .where(dist2("x", "y", "x2", "y2") <= e2).select(SEC, F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct())
    cc = connected_components(sure.unionByName(hit), [SEC])
    boxed = box.select(SEC, "_gx", "_gy", "rep").join(cc.withColumnRenamed("node", "rep"), [SEC, "rep"], "left") \
        .withColumn("lesion", F.coalesce("component", "rep"))
    core_cells = cores.join(boxed.select(SEC, "_gx", "_gy", "lesion"), [SEC, "_gx", "_gy"])
    rim = core.where("not core").drop("core")
    cores_loc = core_cells.groupBy(SEC, "_gx", "_gy", "x", "y").agg(F.min("lesion").alias("lesion")) \
        .select(SEC, "_gx", "_gy", F.col("x").alias("x2"), F.col("y").alias("y2"), "lesion")
    border = (_ring(rim, 2).join(cores_loc, [SEC, "_gx", "_gy"]).where(dist2("x", "y", "x2", "y2") <= e2)
              .groupBy(SEC, CELL).agg(F.min("lesion").alias("lesion")))
    return cut(core_cells.select(SEC, CELL, F.lit(True).alias("core"), "lesion")
            .unionByName(rim.join(border, [SEC, CELL], "left").select(SEC, CELL, F.lit(False).alias("core"), "lesion")))


# ------------------------------------------------------------------ graphs

def subgraph(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Edges between flagged cells, both directions, once each."""
    f = flagged.select(SEC, CELL)
    e = (edges.join(f.withColumnRenamed(CELL, "src"), [SEC, "src"], "left_semi")
         .join(f.withColumnRenamed(CELL, "dst"), [SEC, "dst"], "left_semi").select(SEC, "src", "dst"))
    return e.unionByName(e.select(SEC, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def graph_lesions(edges: DataFrame, flagged: DataFrame, min_size: int = 20) -> DataFrame:
    """Connected groups of flagged cells with at least ``min_size`` members."""
    e = subgraph(edges, flagged).where("src < dst").select(SEC, F.col("src").alias("a"), F.col("dst").alias("b"))
    cc = connected_components(e, [SEC])
    size = cc.groupBy(SEC, "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return cc.join(size, [SEC, "component"]).select(SEC, F.col("node").alias(CELL), F.col("component").alias("lesion"), "size")


def audit_edges(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of edges joining two sections, for a stored graph keyed by cell only (G1)."""
    a = cells.select(F.col(CELL).alias("src"), F.col(SEC).alias("_s1"))
    b = cells.select(F.col(CELL).alias("dst"), F.col(SEC).alias("_s2"))
    j = edges.select("src", "dst").join(a, "src").join(b, "dst")
    return j.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("_s1") != F.col("_s2")).alias("n_cross"),
                 F.avg((F.col("_s1") != F.col("_s2")).cast("double")).alias("cross_fraction"))


# ------------------------------------------------------------------ hulls

def _monotone_chain(pts: list) -> list:
    """Corners of the convex hull, counter-clockwise, collinear points dropped."""
    pts = sorted(set(pts))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                    - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return half(pts) + half(pts[::-1])


def hull_corners(members: DataFrame, key: Sequence[str]) -> DataFrame:
    """Convex hull corners per group in order: (key, seq, x, y).

    The hull of partial hulls is the hull of the whole, so each Arrow batch first keeps its own corners; only those
    are shuffled. A group of any size reaches its final task as a short list.
    """
    key = list(key)
    src = members.select(*key, F.col("x").cast("double"), F.col("y").cast("double"))
    schema = src.schema

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, g in pdf.groupby(key, sort=False):
            for x, y in _monotone_chain(list(zip(g["x"], g["y"]))):
                out.append((*k, x, y))
        return pd.DataFrame(out, columns=[*key, "x", "y"])

    def partial(batches):
        for pdf in batches:
            yield corners(pdf)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        out = corners(pdf)
        out.insert(len(key), "seq", range(len(out)))
        return out
    part = src.mapInPandas(partial, schema)
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:len(key)])
    return part.groupBy(*key).applyInPandas(final, f"{named}, seq int, x double, y double")


def hull_edges(corners: DataFrame, key: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("seq")
    whole = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return corners.select(*key, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"),
                          F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("bx"),
                          F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("by"))


def lesion_shapes(members: DataFrame, key: Sequence[str], lymphoid: Column | None = None) -> DataFrame:
    """Cells, centroid, hull area and perimeter, density, compactness 4 pi A / P^2 and a type share."""
    key = list(key)
    e = hull_edges(hull_corners(members, key), key)
    geo = e.groupBy(*key).agg((F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2.0).alias("area"),
                              F.sum(F.sqrt(dist2("ax", "ay", "bx", "by"))).alias("perimeter"), F.count(F.lit(1)).alias("n_corners"))
    flag = F.lit(0.0) if lymphoid is None else lymphoid.cast("double")
    g = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
                                  F.avg(flag).alias("type_fraction"))
    return (g.join(geo, key).withColumn("density", ratio("n_cells", "area"))
            .withColumn("compactness", ratio(4 * math.pi * F.col("area"), F.col("perimeter") * F.col("perimeter"))))


def nearest_lesion(shapes: DataFrame, lesion: str = "lesion") -> DataFrame:
    """Distance between centroids of each lesion and its nearest neighbour in the section (G6), NULL if alone.

    Reuses the nearest-neighbour join, so a section with very many lesions forms no lesion x lesion table.
    """
    shapes = cut(shapes)   # one row per lesion
    p = shapes.select(SEC, F.col(lesion).alias(CELL), F.col("cx").alias("x"), F.col("cy").alias("y"))
    nn = knn(p, 1).select(SEC, F.col("src").alias(lesion), F.col("dist").alias("nearest"))
    return shapes.join(nn, [SEC, lesion], "left")


FAN = 32   # edges, or chords over runs of edges, that a cell meets at once


def _segment_d2(x, y, ax, ay, bx, by) -> Column:
    """Squared distance of a point to a segment."""
    vx, vy, wx, wy = bx - ax, by - ay, x - ax, y - ay
    t = F.greatest(F.least((wx * vx + wy * vy) / (vx * vx + vy * vy + 1e-12), F.lit(1.0)), F.lit(0.0))
    px, py = wx - t * vx, wy - t * vy
    return px * px + py * py


def hull_chords(corners: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """Chords over runs of ``size`` edges: (key, block, ax, ay, bx, by, sag), ``sag`` being how far the run leaves its chord."""
    key = list(key)
    block = F.floor(F.col("seq") / size)
    c = hull_edges(corners.where(F.col("seq") % size == 0), key).withColumn("block", block).drop("seq")
    run = corners.select(*key, block.alias("block"), "x", "y").join(c, [*key, "block"])
    off = F.sqrt(_segment_d2(*(F.col(n) for n in ("x", "y", "ax", "ay", "bx", "by"))))
    return run.groupBy(*key, "block", "ax", "ay", "bx", "by").agg(F.max(off).alias("sag"))


def near_edges(cand: DataFrame, corners: DataFrame, lesion: str = "lesion") -> DataFrame:
    """Candidate cells with the edges of their hull that can be nearest: ``cand`` and ax, ay, bx, by.

    ``cand`` has (section, lesion, cell, x, y). A run of edges lies within its sag of its chord, so the distance to the run is that to
    the chord, more or less the sag. A cell starts with at most FAN chords over the whole hull, keeps the runs that can
    hold the nearest edge and goes down into them; sags shrink with the square of the length, so a few runs stay at every level, however
    many corners there are. The slack covers the guard against edges without length. Hulls of up to FAN corners are read directly.
    """
    key = [SEC, lesion]
    counts = corners.groupBy(*key).agg(F.count(F.lit(1)).alias("_k"))
    most, depth = counts.agg(F.max("_k")).first()[0] or 0, 1
    while FAN ** depth < most:
        depth += 1
    top = F.lit(depth)
    for level in range(depth - 1, 0, -1):
        top = F.when(F.col("_k") <= FAN ** level, level).otherwise(top)
    tops = counts.select(*key, top.alias("_top"))
    slack = 1e-6

    def bounds(c):
        d = F.sqrt(_segment_d2(F.col("x"), F.col("y"), c["ax"], c["ay"], c["bx"], c["by"]))
        return F.struct(c["block"].alias("block"), (d - c["sag"]).alias("lo"), (d + c["sag"]).alias("hi"))

    def starts(level):
        return cand.join(tops.where(F.col("_top") == level).drop("_top"), key).withColumn("_block", F.lit(0).cast("long"))

    below = None
    for level in range(depth, 1, -1):
        kids = (hull_chords(corners, key, FAN ** (level - 1)).groupBy(*key, F.floor(F.col("block") / FAN).alias("_block"))
                .agg(F.collect_list(F.struct("block", "ax", "ay", "bx", "by", "sag")).alias("_kids")))

        def met(rows):
            return (rows.join(kids, [*key, "_block"]).withColumn("_runs", F.transform("_kids", bounds)).drop("_kids", "_block")
                    .withColumn("_hi", F.array_min(F.transform("_runs", lambda c: c["hi"]))))
        runs = met(starts(level))      # one row a cell: its bound is its own
        if below is not None:
            w = Window.partitionBy(*key, CELL)
            runs = runs.unionByName(met(below).withColumn("_hi", F.min("_hi").over(w)))
        below = (runs.withColumn("_run", F.explode(F.filter("_runs", lambda c: c["lo"] <= F.col("_hi") * (1 + 1e-9) + slack)))
                 .withColumn("_block", F.col("_run.block")).drop("_runs", "_hi", "_run"))
    last = starts(1) if below is None else starts(1).unionByName(below)
    e = hull_edges(corners, key).withColumn("_block", F.floor(F.col("seq") / FAN)).drop("seq")
    return last.join(e, [*key, "_block"]).drop("_block")


def signed_distance(cells: DataFrame, corners: DataFrame, margin: float, bucket: float, lesion: str = "lesion"
                    ) -> DataFrame:
    """Signed distance of cells to lesion hulls, negative inside, for cells within the padded box.

    A hull's padded bounding box is cut into ``bucket`` grid cells for an equality join; plain range predicates would
    plan as a nested loop. A cell then meets only edges that can be nearest (``near_edges``). It is inside if it is on the
    inner side of those: a cell outside of a convex hull is on the outer side of a nearest edge.
    Lesions with fewer than three corners have no inside and get no row.
    """
    key = [SEC, lesion]
    corners = cut(corners)
    box = corners.groupBy(*key).agg((F.min("x") - margin).alias("xl"), (F.max("x") + margin).alias("xh"),
                                    (F.min("y") - margin).alias("yl"), (F.max("y") + margin).alias("yh"),
                                    F.count(F.lit(1)).alias("_k")).where("_k >= 3")

    def span(lo, hi):
        return F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))
    tiles = box.withColumn("_gx", F.explode(span("xl", "xh"))).withColumn("_gy", F.explode(span("yl", "yh")))
    c = _grid(cells, bucket)
    cand = c.join(tiles, [SEC, "_gx", "_gy"]).where("x >= xl and x <= xh and y >= yl and y <= yh").select(SEC, lesion, CELL, "x", "y")
    x, y, ax, ay, bx, by = (F.col(n) for n in ("x", "y", "ax", "ay", "bx", "by"))
    g = (near_edges(cand, corners, lesion).withColumn("_d2", _segment_d2(x, y, ax, ay, bx, by))
         .withColumn("_in", (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
         .groupBy(SEC, lesion, CELL).agg(F.sqrt(F.min("_d2")).alias("_d"), F.bool_and("_in").alias("_in")))
    return g.select(SEC, lesion, CELL, F.when(F.col("_in"), -F.col("_d")).otherwise(F.col("_d")).alias("signed_dist"))


def nearest_signed(signed: DataFrame) -> DataFrame:
    """Each cell keeps its smallest signed distance."""
    return signed.groupBy(SEC, CELL).agg(F.min("signed_dist").alias("signed_dist"))


def radial_profile(signed: DataFrame, cells: DataFrame, edges: Sequence[float], value: str, flag: str,
                   by: Sequence[str] = ()) -> DataFrame:
    """Mean program and flagged share by distance bin [e_i, e_i+1)."""
    i = F.lit(None).cast("int")
    for n in range(len(edges) - 2, -1, -1):
        i = F.when((F.col("signed_dist") >= float(edges[n])) & (F.col("signed_dist") < float(edges[n + 1])), n).otherwise(i)
    d = signed.join(cells.select(SEC, CELL, value, flag, *by), [SEC, CELL]).withColumn("bin", i).where("bin is not null")
    return d.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"),
                                     F.avg(F.col(flag).cast("double")).alias("flag_fraction"))


def core_rim(signed: DataFrame, cells: DataFrame, value: str, core: float, rim: float, floor: int = 5,
             lesion: str = "lesion") -> DataFrame:
    """Core minus rim mean per lesion where both hold at least ``floor`` cells."""
    d = signed.join(cells.select(SEC, CELL, value), [SEC, CELL])
    inn = F.col("signed_dist") < core
    out = (F.col("signed_dist") >= 0) & (F.col("signed_dist") < rim)
    g = d.groupBy(SEC, lesion).agg(F.count_if(inn).alias("n_core"), F.count_if(out).alias("n_rim"),
                                   (F.avg(F.when(inn, F.col(value))) - F.avg(F.when(out, F.col(value)))).alias("core_minus_rim"))
    return g.where((F.col("n_core") >= floor) & (F.col("n_rim") >= floor))


def compartments(signed: DataFrame, cuts: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Overlapping compartments by signed distance, one row per (cell, compartment).

    A cut ``(lo, hi)`` means lo < d <= hi; None is open.
    """
    names = []
    for name, (lo, hi) in cuts.items():
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (F.col("signed_dist") > lo)
        if hi is not None:
            ok = ok & (F.col("signed_dist") <= hi)
        names.append(F.when(ok, F.lit(name)))
    return signed.withColumn("compartment", F.explode(F.array_compact(F.array(*names))))


def section_summary(sections: DataFrame, lesions: DataFrame, total: str = "n_cells", size: str = "size") -> DataFrame:
    """Lesion count, burden, sizes, largest share, Gini and fragmentation per section, zeros where none."""
    w = Window.partitionBy(SEC).orderBy(size)
    n = F.count(F.lit(1)).over(Window.partitionBy(SEC))
    g = (lesions.withColumn("_g", (2 * F.row_number().over(w) - n - 1) * F.col(size)).groupBy(SEC)
         .agg(F.count(F.lit(1)).alias("lesion_count"), F.sum(size).alias("_cells"), F.avg(size).alias("mean_size"),
              F.max(size).alias("max_size"), F.sum("_g").alias("_g")))
    j = sections.select(SEC, total).join(g, SEC, "left")
    z = lambda v: F.coalesce(v, F.lit(0.0))
    return j.select(SEC, F.coalesce("lesion_count", F.lit(0)).alias("lesion_count"), z(ratio("_cells", total)).alias("burden"),
                    z(F.col("mean_size")).alias("mean_size"), F.coalesce("max_size", F.lit(0)).alias("max_size"),
                    z(ratio("max_size", "_cells")).alias("largest_fraction"),
                    z(ratio("_g", F.col("lesion_count") * F.col("_cells"))).alias("gini"),
                    z(ratio("lesion_count", "_cells")).alias("fragmentation"))


# ------------------------------------------------------------------ density segmentation

def bin_counts(cells: DataFrame, side: float, flag: str) -> DataFrame:
    g = _grid(cells, side).withColumnRenamed("_gx", "bin_x").withColumnRenamed("_gy", "bin_y")
    return g.groupBy(SEC, "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("n_pos"))


def smooth_bins(bins: DataFrame, side: float, sigma: float, cols: Sequence[str], reach: float = 4.0) -> DataFrame:
    """Separable Gaussian smoothing of sparse bins: two passes of an offset table along each axis.

    The kernel is cut at ``reach`` sigmas and normalised; bins outside the data hold 0.
    """
    r = int(reach * sigma / side + 0.5)
    wts = [math.exp(-0.5 * (k * side / sigma) ** 2) for k in range(-r, r + 1)]
    tot = sum(wts)
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / tot).alias("w")) for k, w in zip(range(-r, r + 1), wts)])
    d = bins
    for axis in ("bin_x", "bin_y"):
        other = "bin_y" if axis == "bin_x" else "bin_x"
        d = (d.withColumn("_o", F.explode(table))
             .groupBy(SEC, (F.col(axis) + F.col("_o.k")).alias(axis), other)
             .agg(*[F.sum(F.col(c) * F.col("_o.w")).alias(c) for c in cols]))
    return d


def density_scores(cells: DataFrame, side: float, sigma: float, flag: str, tissue_floor: float) -> DataFrame:
    """Tissue bins with smoothed densities, positive share, and robust z of the positive density."""
    s = smooth_bins(bin_counts(cells, side, flag), side, sigma, ["n", "n_pos"]).where(F.col("n") >= tissue_floor)
    med = exact_quantiles(s, "n_pos", (0.5,), ("_med",), [SEC]).select(SEC, "_med")
    s = s.join(med, SEC).withColumn("_dev", F.abs(F.col("n_pos") - F.col("_med")))
    mad = exact_quantiles(s, "_dev", (0.5,), ("_mad",), [SEC]).select(SEC, "_mad")
    return s.join(mad, SEC).select(SEC, "bin_x", "bin_y", F.col("n").alias("density"), F.col("n_pos").alias("pos_density"),
                                   ratio("n_pos", "n").alias("pos_fraction"),
                                   ratio(F.col("n_pos") - F.col("_med"), 1.4826 * F.col("_mad")).alias("z"))


def segment_lesions(cells: DataFrame, side: float, sigma: float, flag: str, tissue_floor: float, z: float = 2.5,
                    bin_fraction: float = 0.15, lesion_fraction: float = 0.2, min_bins: int = 1, margin: float = 50.0
                    ) -> tuple[DataFrame, DataFrame]:
    """Lesion bins (8-neighbour groups of dense, positive bins) and the cells in or near them.

    Returns (bins: section, bin_x, bin_y, lesion) and (cells: section, cell, lesion, in_mask). A lesion is named by the
    smallest code of its bins. Holes are not filled and masks are not smoothed; both belonged to an outside library.
    """
    tissue = cut(density_scores(cells, side, sigma, flag, tissue_floor))
    hot = tissue.where((F.col("z") >= z) & (F.col("pos_fraction") >= bin_fraction))
    # one whole number for a bin, in the order of (x, y); a bin outside 32 bits is an error, not another bin
    edge = 2**31
    fits = (F.col("bin_x") >= -edge) & (F.col("bin_x") < edge) & (F.col("bin_y") >= -edge) & (F.col("bin_y") < edge)
    code = F.when(fits, F.col("bin_x") * F.lit(2**32) + F.col("bin_y") + edge).otherwise(
        F.raise_error(F.lit("a bin lies outside 32-bit indices: use a larger bin side")).cast("bigint"))
    hot = hot.select(SEC, "bin_x", "bin_y", code.alias("node"))
    e = _ring(hot.select(SEC, F.col("bin_x").alias("_gx"), F.col("bin_y").alias("_gy"), F.col("node").alias("a")), 1) \
        .join(hot.select(SEC, F.col("bin_x").alias("_gx"), F.col("bin_y").alias("_gy"), F.col("node").alias("b")), [SEC, "_gx", "_gy"]) \
        .where("a < b").select(SEC, "a", "b")
    cc = connected_components(e, [SEC])
    lab = hot.join(cc, [SEC, "node"], "left").select(SEC, "bin_x", "bin_y", F.coalesce("component", "node").alias("lesion"))
    located = _grid(cells, side).withColumnRenamed("_gx", "bin_x").withColumnRenamed("_gy", "bin_y")
    inside = located.join(lab, [SEC, "bin_x", "bin_y"])
    bins = lab.groupBy(SEC, "lesion").agg(F.count(F.lit(1)).alias("n_bins"))
    frac = inside.groupBy(SEC, "lesion").agg(F.avg(F.col(flag).cast("double")).alias("pos_fraction"))
    keep = bins.join(frac, [SEC, "lesion"]).where((F.col("n_bins") >= min_bins) & (F.col("pos_fraction") >= lesion_fraction))
    lab = cut(lab.join(keep.select(SEC, "lesion"), [SEC, "lesion"], "left_semi"))
    reach = int(margin / side)
    offsets = [(dx, dy, dx * dx + dy * dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)
               if (dx * dx + dy * dy) * side * side <= margin * margin]
    table = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(d).alias("d2")) for a, b, d in offsets])
    near = (lab.withColumn("_o", F.explode(table))
            .select(SEC, (F.col("bin_x") + F.col("_o.dx")).alias("bin_x"), (F.col("bin_y") + F.col("_o.dy")).alias("bin_y"),
                    F.struct(F.col("_o.d2").alias("d2"), F.col("lesion").alias("lesion")).alias("_k"))
            .groupBy(SEC, "bin_x", "bin_y").agg(F.min("_k").alias("_k")))
    # the margin covers tissue bins only; mask bins are tissue by construction
    unit = near.join(tissue.select(SEC, "bin_x", "bin_y"), [SEC, "bin_x", "bin_y"], "left_semi") \
        .select(SEC, "bin_x", "bin_y", F.col("_k.lesion").alias("lesion"), (F.col("_k.d2") == 0).alias("in_mask"))
    return lab, located.join(unit, [SEC, "bin_x", "bin_y"]).select(SEC, CELL, "lesion", "in_mask")


def lesion_table(assigned: DataFrame, cells: DataFrame, flag: str, bins: DataFrame, side: float) -> DataFrame:
    """Area, cells, cells in the mask and positive share per lesion."""
    area = bins.groupBy(SEC, "lesion").agg((F.count(F.lit(1)) * F.lit(side * side)).alias("area"))
    g = (assigned.join(cells.select(SEC, CELL, flag), [SEC, CELL]).groupBy(SEC, "lesion")
         .agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("in_mask").alias("n_cells_mask"),
              F.avg(F.col(flag).cast("double")).alias("pos_fraction")))
    return g.join(area, [SEC, "lesion"])


# ------------------------------------------------------------------ neighbourhoods

def neighbourhood_means(edges: DataFrame, cells: DataFrame, values: DataFrame, k: int, kind: str = "cell_type"
                        ) -> DataFrame:
    """Mean over the cells of a type of their neighbours' mean expression (G16, NB).

    Edges are summed to weights (neighbour, type) before the expression is joined, so no per-cell neighbour matrix
    exists.
    """
    t = cells.select(SEC, F.col(CELL).alias("src"), kind)
    w = edges.join(t, [SEC, "src"]).groupBy(SEC, F.col("dst").alias(CELL), kind).agg(F.count(F.lit(1)).alias("_w"))
    n = cells.groupBy(SEC, kind).agg(F.count(F.lit(1)).alias("n_cells"))
    s = (w.join(values, [SEC, CELL]).groupBy(SEC, kind, "gene_id").agg(F.sum(F.col("_w") * F.col("value")).alias("_s")))
    return s.join(n, [SEC, kind]).select(SEC, kind, "gene_id", (F.col("_s") / (F.col("n_cells") * k)).alias("nb"))


def neighbourhood_contrast(edges: DataFrame, cells: DataFrame, values: DataFrame, k: int, kind: str = "cell_type"
                           ) -> DataFrame:
    """Mean absolute difference between a cell and its neighbourhood per type (G16, DISC); absent rows are zeros."""
    nb = (edges.join(values.withColumnRenamed(CELL, "dst"), [SEC, "dst"]).groupBy(SEC, F.col("src").alias(CELL), "gene_id")
          .agg((F.sum("value") / k).alias("_nb")))
    d = values.select(SEC, CELL, "gene_id", F.col("value").alias("_own")).join(nb, [SEC, CELL, "gene_id"], "full_outer")
    z = F.abs(F.coalesce("_own", F.lit(0.0)) - F.coalesce("_nb", F.lit(0.0)))
    n = cells.groupBy(SEC, kind).agg(F.count(F.lit(1)).alias("n_cells"))
    return (d.withColumn("_z", z).join(cells.select(SEC, CELL, kind), [SEC, CELL]).groupBy(SEC, kind, "gene_id")
            .agg(F.sum("_z").alias("_z")).join(n, [SEC, kind])
            .select(SEC, kind, "gene_id", (F.col("_z") / F.col("n_cells")).alias("disc")))


def neighbourhood_enrichment(edges: DataFrame, cells: DataFrame, kind: str = "cell_type") -> DataFrame:
    """Type-type edge counts against random relabelling of all cells (G17), with the exact permutation moments.

    Mean and variance of a join count under relabelling depend only on the edge pairs that are the same, reversed,
    share a node, or are disjoint; those totals come from node degrees. One pass replaces a thousand relabellings.
    """
    t1 = cells.select(SEC, F.col(CELL).alias("src"), F.col(kind).alias("sender"))
    t2 = cells.select(SEC, F.col(CELL).alias("dst"), F.col(kind).alias("receiver"))
    obs = edges.join(t1, [SEC, "src"]).join(t2, [SEC, "dst"]).groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("observed"))
    deg = (edges.select(SEC, F.col("src").alias(CELL), F.lit(1).alias("o"), F.lit(0).alias("i"))
           .unionByName(edges.select(SEC, F.col("dst").alias(CELL), F.lit(0).alias("o"), F.lit(1).alias("i")))
           .groupBy(SEC, CELL).agg(F.sum("o").alias("o"), F.sum("i").alias("i")))
    back = edges.select(SEC, F.col("src").alias("dst"), F.col("dst").alias("src"))
    rec = edges.select(SEC, "src", "dst").join(back, [SEC, "src", "dst"], "left_semi").agg(F.count(F.lit(1))).scalar()
    tot = deg.agg(F.struct(F.sum("o").alias("w"), F.sum(F.col("o") * F.col("o")).alias("oo"),
                           F.sum(F.col("i") * F.col("i")).alias("ii"), F.sum(F.col("o") * F.col("i")).alias("oi"))).scalar()
    n = cells.agg(F.count(F.lit(1))).scalar()
    size = cells.groupBy(kind).agg(F.count(F.lit(1)).cast("double").alias("_k"))
    g = (obs.join(size.select(F.col(kind).alias("sender"), F.col("_k").alias("na")), "sender")
         .join(size.select(F.col(kind).alias("receiver"), F.col("_k").alias("nb")), "receiver")
         .withColumn("_t", tot).withColumn("_r", rec.cast("double")).withColumn("n", n.cast("double")))
    W, same = F.col("_t.w").cast("double"), F.col("sender") == F.col("receiver")
    s_out, s_in = F.col("_t.oo") - W, F.col("_t.ii") - W
    cross = 2 * (F.col("_t.oi") - F.col("_r"))
    apart = W * W - W - F.col("_r") - s_out - s_in - cross
    na, nb, n = F.col("na"), F.col("nb"), F.col("n")
    f2, f3 = n * (n - 1), n * (n - 1) * (n - 2)
    f4 = f3 * (n - 3)
    mean = F.when(same, W * na * (na - 1) / f2).otherwise(W * na * nb / f2)
    same2 = ((W + F.col("_r")) * na * (na - 1) / f2 + (s_out + s_in + cross) * na * (na - 1) * (na - 2) / f3
             + apart * na * (na - 1) * (na - 2) * (na - 3) / f4)
    diff2 = (W * na * nb / f2 + s_out * na * nb * (nb - 1) / f3 + s_in * na * (na - 1) * nb / f3
             + apart * na * (na - 1) * nb * (nb - 1) / f4)
    g = g.withColumn("expected", mean).withColumn("_v", F.when(same, same2).otherwise(diff2) - mean * mean)
    return g.select("sender", "receiver", "observed", "expected",
                    ratio(F.col("observed") - F.col("expected"), F.sqrt(F.greatest("_v", F.lit(0.0)))).alias("z"))


def adjacency_lookup(enrichment: DataFrame, expected: DataFrame) -> DataFrame:
    """Predicted adjacencies next to the observed z and whether the sign agrees."""
    return (expected.join(enrichment.select("sender", "receiver", "z"), ["sender", "receiver"], "left")
            .withColumn("agrees", F.coalesce(F.signum("z") == F.signum("expected_sign"), F.lit(False))))


def densest_windows(cells: DataFrame, flag: str, radius: float, half: float) -> DataFrame:
    """Per section the flagged cell with most flagged cells within ``radius`` and a window around it.

    The window is clipped to the section's extent; cells inside are counted and their flagged share taken.
    """
    flagged = cells.where(F.col(flag))
    n = neighbour_counts(flagged.select(SEC, CELL, "x", "y"), radius)
    best = n.groupBy(SEC).agg(F.max("n_near").alias("n_near"), F.min_by(F.struct("x", "y"), F.struct(-F.col("n_near"), F.col(CELL))).alias("_p"),
                              F.min_by(CELL, F.struct(-F.col("n_near"), F.col(CELL))).alias("centre_cell"))
    ext = cells.groupBy(SEC).agg(*[f(v).alias(f"{v}{s}") for v in ("x", "y") for f, s in ((F.min, "0"), (F.max, "1"))])
    win = best.join(ext, SEC)
    for v in ("x", "y"):
        win = (win.withColumn(f"_{v}l", F.greatest(F.col(f"_p.{v}") - half, F.col(f"{v}0")))
               .withColumn(f"_{v}h", F.least(F.col(f"_p.{v}") + half, F.col(f"{v}1"))))
    j = cells.join(win, SEC).where("x >= _xl and x <= _xh and y >= _yl and y <= _yh")
    return j.groupBy(SEC).agg(F.min("centre_cell").alias("centre_cell"), F.max("n_near").alias("n_near"),
                              F.count(F.lit(1)).alias("n_window"), F.avg(F.col(flag).cast("double")).alias("flag_fraction"))
