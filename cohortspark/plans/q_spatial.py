"""Spatial queries: J8-J12, G1-G21, W19."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.scalars import log_cp10k
from cohortspark.operators import association as A
from cohortspark.operators import contrast as K
from cohortspark.operators import counts as C
from cohortspark.operators import evaluation as E
from cohortspark.operators import signaling as L
from cohortspark.operators import spatial as G
from cohortspark.plans.q_association import gauss_tail, pb
from cohortspark.plans.registry import query
from cohortspark.plans.twin_ctes import CTES

EPS, MIN_SAMPLES, MARGIN = 10.0, 4, 15.0
EDGES = [-1000.0, -5.0, 0.0, 5.0, 10.0, 15.0]


def lesions(t):
    """Density clusters of flagged cells with their coordinates."""
    flagged = t.space.where("flagged")
    d = G.dbscan(flagged, EPS, MIN_SAMPLES).where("lesion is not null")
    return d.join(t.space, ["section_id", "cell_id"]).select("section_id", "lesion", "cell_id", "x", "y", "cell_type")


def signed(t):
    corners = G.hull_corners(lesions(t), ["section_id", "lesion"])
    return G.signed_distance(t.space, corners, MARGIN, 32.0)


def values(t):
    e = t.space_expr.withColumn("_lib", C.cell_library(t.space_expr, ["section_id", "cell_id"]))
    return e.select("section_id", "cell_id", "gene_id", log_cp10k("cnt", "_lib").alias("value"))


@query("j8_knn", "SELECT section_id, src, dst, dist, nn FROM knn6", "dist")
def _(t):
    return G.knn(t.space, 6)


@query("j9_radius_join", """
SELECT a.section_id, a.cell_id AS src, b.cell_id AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist FROM space a JOIN space b
ON a.section_id = b.section_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 25""", "dist")
def _(t):
    return G.within_radius(t.space, t.space, 5.0)


@query("g1_edge_audit", """
SELECT count(*) AS n_edges, count(*) FILTER (a.section_id <> b.section_id) AS n_cross, avg(CASE WHEN a.section_id <> b.section_id THEN 1.0::double ELSE 0.0 END) AS cross_fraction
FROM (SELECT src, dst FROM knn6 UNION ALL SELECT vec_id, vec_id + 1 FROM embeddings) e JOIN space a ON a.cell_id = e.src JOIN space b ON b.cell_id = e.dst""", "cross_fraction")
def _(t):
    stored = t.raw("embeddings").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    return G.audit_edges(G.knn(t.space, 6).select("src", "dst").unionByName(stored), t.space)


@query("g2_flagged_subgraph", "SELECT section_id, a AS src, b AS dst FROM fk_edge")
def _(t):
    return G.subgraph(G.knn(t.space, 6), t.space.where("flagged"))


@query("g3_graph_lesions", "WITH RECURSIVE z AS (SELECT * FROM fk_cells WHERE size >= 5) SELECT section_id, cell_id, lesion, size FROM z")
def _(t):
    return G.graph_lesions(G.knn(t.space, 6), t.space.where("flagged"), 5)


@query("g4_density_clusters", "WITH RECURSIVE z AS (SELECT * FROM db_cells) SELECT section_id, cell_id, core, lesion FROM z")
def _(t):
    return G.dbscan(t.space.where("flagged"), EPS, MIN_SAMPLES)


SHAPE = """
h AS (SELECT section_id, lesion, abs(sum(ax * ey - ex * ay)) / 2 AS area, sum(sqrt(pow(ax - ex, 2) + pow(ay - ey, 2))) AS perimeter, count(*) AS n_corners FROM lesion_hull GROUP BY 1, 2),
g AS (SELECT section_id, lesion, count(*) AS n_cells, avg(x) AS cx, avg(y) AS cy, avg(CASE WHEN cell_type = 'T11' THEN 1.0::double ELSE 0.0 END) AS type_fraction FROM lesion_cells GROUP BY 1, 2),
sh AS (SELECT section_id, lesion, n_cells, cx, cy, type_fraction, area, perimeter, n_corners, n_cells / area AS density, 4 * pi() * area / (perimeter * perimeter) AS compactness FROM g JOIN h USING (section_id, lesion))"""


@query("g5_lesion_shapes", f"WITH RECURSIVE {SHAPE} SELECT * FROM sh", "cx cy type_fraction area perimeter density compactness")
def _(t):
    return G.lesion_shapes(lesions(t), ["section_id", "lesion"], F.col("cell_type") == "T11")


@query("g6_nearest_lesion", f"""
WITH RECURSIVE {SHAPE} SELECT a.section_id, a.lesion, (SELECT min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) FROM sh b WHERE b.section_id = a.section_id AND b.lesion <> a.lesion) AS nearest FROM sh a""", "nearest")
def _(t):
    return G.nearest_lesion(G.lesion_shapes(lesions(t), ["section_id", "lesion"])).select("section_id", "lesion", "nearest")


@query("g7_signed_distance", "WITH RECURSIVE z AS (SELECT * FROM lesion_signed) SELECT section_id, lesion, cell_id, signed_dist FROM z", "signed_dist")
def _(t):
    return signed(t)


@query("w19_smallest_signed_distance", "WITH RECURSIVE z AS (SELECT section_id, cell_id, min(signed_dist) AS signed_dist FROM lesion_signed GROUP BY 1, 2) SELECT * FROM z", "signed_dist")
def _(t):
    return G.nearest_signed(signed(t))


BIN = "CASE WHEN signed_dist < -5 THEN 0 WHEN signed_dist < 0 THEN 1 WHEN signed_dist < 5 THEN 2 WHEN signed_dist < 10 THEN 3 WHEN signed_dist < 15 THEN 4 END"
# corners lie on their own hull: rounding keeps the two engines' zero distances on one side of the bin edge
RS = "(SELECT section_id, lesion, cell_id, round(signed_dist, 6) + 0.0 AS signed_dist FROM lesion_signed)"


@query("g8_radial_profile", f"""
WITH RECURSIVE z AS (SELECT cell_type, {BIN} AS bin, program, flagged FROM {RS} JOIN space USING (section_id, cell_id))
SELECT cell_type, bin, count(*) AS n, avg(program) AS mean_value, avg(flagged::int::double) AS flag_fraction FROM z WHERE bin IS NOT NULL GROUP BY 1, 2""", "mean_value flag_fraction")
def _(t):
    s = signed(t).withColumn("signed_dist", F.round("signed_dist", 6))
    return G.radial_profile(s, t.space, EDGES, "program", "flagged", ["cell_type"])


@query("g8_core_minus_rim", f"""
WITH RECURSIVE z AS (SELECT section_id, lesion, count(*) FILTER (signed_dist < -2) AS n_core, count(*) FILTER (signed_dist >= 0 AND signed_dist < 10) AS n_rim,
  avg(program) FILTER (signed_dist < -2) - avg(program) FILTER (signed_dist >= 0 AND signed_dist < 10) AS core_minus_rim FROM {RS} JOIN space USING (section_id, cell_id) GROUP BY 1, 2)
SELECT * FROM z WHERE n_core >= 3 AND n_rim >= 3""", "core_minus_rim")
def _(t):
    s = signed(t).withColumn("signed_dist", F.round("signed_dist", 6))
    return G.core_rim(s, t.space, "program", -2.0, 10.0, 3)


@query("g9_radial_position_contrast", f"""
WITH RECURSIVE z AS (SELECT section_id, cell_type, avg(d) AS m FROM (SELECT section_id, cell_id, min(signed_dist) AS d FROM {RS} GROUP BY 1, 2) JOIN space USING (section_id, cell_id) GROUP BY 1, 2),
p AS (SELECT section_id, max(m) FILTER (cell_type = 'T11') - max(m) FILTER (cell_type = 'T00') AS d FROM z GROUP BY 1),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::double AS r FROM p WHERE d <> 0)
SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r""",
       "w_plus w_minus w")
def _(t):
    s = G.nearest_signed(signed(t).withColumn("signed_dist", F.round("signed_dist", 6)))
    m = s.join(t.space, ["section_id", "cell_id"]).groupBy("section_id").agg(
        (F.avg(F.when(F.col("cell_type") == "T11", F.col("signed_dist"))) - F.avg(F.when(F.col("cell_type") == "T00", F.col("signed_dist")))).alias("d"))
    return K.signed_rank(m, [], "d")


@query("g9_radial_position_p", f"""
WITH RECURSIVE z AS (SELECT section_id, cell_type, avg(d) AS m FROM (SELECT section_id, cell_id, min(signed_dist) AS d FROM {RS} GROUP BY 1, 2) JOIN space USING (section_id, cell_id) GROUP BY 1, 2),
p AS (SELECT section_id, round(max(m) FILTER (cell_type = 'T11') - max(m) FILTER (cell_type = 'T00'), 9) AS d FROM z GROUP BY 1),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::double AS r FROM p WHERE d <> 0),
y AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM r),
e AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT abs(d) AS a, count(*) AS t FROM r GROUP BY 1)),
f AS (SELECT *, least(w_plus, w_minus) AS w FROM y, e),
h AS (SELECT *, (w - n * (n + 1) / 4.0::double) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - tie / 48.0::double), 0) AS zz FROM f)
SELECT n, w_plus, w_minus, w, CASE WHEN zz IS NOT NULL THEN {gauss_tail('zz')} END AS p FROM h""", "w_plus w_minus w p")
def _(t):
    s = G.nearest_signed(signed(t).withColumn("signed_dist", F.round("signed_dist", 6)))
    m = s.join(t.space, ["section_id", "cell_id"]).groupBy("section_id").agg(
        F.round(F.avg(F.when(F.col("cell_type") == "T11", F.col("signed_dist"))) - F.avg(F.when(F.col("cell_type") == "T00", F.col("signed_dist"))), 9).alias("d"))
    return K.signed_rank(m, [], "d", p=True)


CTES["lesion_sizes"] = "SELECT DISTINCT section_id, lesion, size FROM fk_cells WHERE size >= 5"


@query("g10_section_summary", """
WITH RECURSIVE n AS (SELECT section_id, count(*) AS n_cells FROM space GROUP BY 1),
g AS (SELECT section_id, count(*) AS k, sum(size)::bigint AS c, avg(size) AS mean_size, max(size) AS max_size, sum((2 * rn - m - 1) * size) AS gs FROM (
   SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY size) AS rn, count(*) OVER (PARTITION BY section_id) AS m FROM lesion_sizes) GROUP BY 1)
SELECT section_id, coalesce(k, 0) AS lesion_count, coalesce(c / n_cells::double, 0) AS burden, coalesce(mean_size, 0) AS mean_size, coalesce(max_size, 0) AS max_size,
  coalesce(max_size / c::double, 0) AS largest_fraction, coalesce(gs / (k * c)::double, 0) AS gini, coalesce(k / c::double, 0) AS fragmentation FROM n LEFT JOIN g USING (section_id)""",
       "burden mean_size largest_fraction gini fragmentation")
def _(t):
    les = G.graph_lesions(G.knn(t.space, 6), t.space.where("flagged"), 5).select("section_id", "lesion", "size").distinct()
    n = t.space.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_cells"))
    return G.section_summary(n, les)


SIDE, SIGMA, TISSUE = 4.0, 6.0, 0.02


def kernel_sql():
    import math
    r = int(4 * SIGMA / SIDE + 0.5)
    w = [math.exp(-0.5 * (k * SIDE / SIGMA) ** 2) for k in range(-r, r + 1)]
    return ", ".join(f"({k}, {x / sum(w)!r}::double)" for k, x in zip(range(-r, r + 1), w))


CTES["tissue_bins"] = f"""
SELECT section_id, bin_x, bin_y, n AS density, np AS pos_density, np / n AS pos_fraction, (np - med) / nullif(1.4826 * median(abs(np - med)) OVER (PARTITION BY section_id), 0) AS z
FROM (SELECT *, median(np) OVER (PARTITION BY section_id) AS med FROM (
  SELECT section_id, bin_x + a.k AS bin_x, bin_y + b.k AS bin_y, sum(n * a.w * b.w) AS n, sum(np * a.w * b.w) AS np
  FROM (SELECT section_id, floor(x / {SIDE})::bigint AS bin_x, floor(y / {SIDE})::bigint AS bin_y, count(*) AS n, count(*) FILTER (flagged) AS np FROM space GROUP BY 1, 2, 3),
       (VALUES {kernel_sql()}) a(k, w), (VALUES {kernel_sql()}) b(k, w) GROUP BY 1, 2, 3) WHERE n >= {TISSUE})"""


@query("g12_density_scores", "SELECT * FROM tissue_bins", "density pos_density pos_fraction z")
def _(t):
    return G.density_scores(t.space, SIDE, SIGMA, "flagged", TISSUE)


CTES["hot_bins"] = "SELECT section_id, bin_x, bin_y, bin_x * 4294967296 + bin_y + 2147483648 AS node FROM tissue_bins WHERE z >= 2.5 AND pos_fraction >= 0.15"
CTES["hot_reach"] = """
SELECT section_id, bin_x, bin_y, node AS lesion FROM hot_bins UNION SELECT h.section_id, h.bin_x, h.bin_y, r.lesion FROM hot_reach r JOIN hot_bins h
ON h.section_id = r.section_id AND abs(h.bin_x - r.bin_x) <= 1 AND abs(h.bin_y - r.bin_y) <= 1"""
CTES["mask_all"] = "SELECT section_id, bin_x, bin_y, min(lesion) AS lesion FROM hot_reach GROUP BY 1, 2, 3"
CTES["binned"] = f"SELECT *, floor(x / {SIDE})::bigint AS bin_x, floor(y / {SIDE})::bigint AS bin_y FROM space"
CTES["mask_bins"] = """
SELECT m.* FROM mask_all m JOIN (SELECT m.section_id, m.lesion FROM mask_all m JOIN binned b USING (section_id, bin_x, bin_y) GROUP BY 1, 2 HAVING avg(b.flagged::int) >= 0.2) k USING (section_id, lesion)"""
CTES["assigned"] = f"""
SELECT b.section_id, b.cell_id, arg_min(m.lesion, (pow(b.bin_x - m.bin_x, 2) + pow(b.bin_y - m.bin_y, 2), m.lesion)) AS lesion, min(pow(b.bin_x - m.bin_x, 2) + pow(b.bin_y - m.bin_y, 2)) = 0 AS in_mask
FROM binned b JOIN mask_bins m ON m.section_id = b.section_id AND (pow(b.bin_x - m.bin_x, 2) + pow(b.bin_y - m.bin_y, 2)) * {SIDE * SIDE} <= 64
JOIN tissue_bins t ON t.section_id = b.section_id AND t.bin_x = b.bin_x AND t.bin_y = b.bin_y GROUP BY 1, 2"""


def segmented(t):
    return G.segment_lesions(t.space, SIDE, SIGMA, "flagged", TISSUE, margin=8.0)


@query("g12_segment_lesions", "WITH RECURSIVE z AS (SELECT * FROM assigned) SELECT section_id, cell_id, lesion, in_mask FROM z")
def _(t):
    return segmented(t)[1]


@query("g13_lesion_table", f"""
WITH RECURSIVE z AS (SELECT section_id, a.lesion, count(*) AS n_cells, count(*) FILTER (in_mask) AS n_cells_mask, avg(flagged::int::double) AS pos_fraction FROM assigned a JOIN space USING (section_id, cell_id) GROUP BY 1, 2)
SELECT z.*, (SELECT count(*) * {SIDE * SIDE}::double FROM mask_bins m WHERE m.section_id = z.section_id AND m.lesion = z.lesion) AS area FROM z""", "pos_fraction area")
def _(t):
    bins, cells = segmented(t)
    return G.lesion_table(cells, t.space, "flagged", bins, SIDE)


@query("g13_lesion_pseudobulk", """
WITH RECURSIVE s AS (SELECT section_id, lesion, gene_id, sum(cnt)::bigint AS n FROM assigned JOIN space_expr USING (section_id, cell_id) GROUP BY 1, 2, 3)
SELECT *, ln(1 + n / (sum(n) OVER (PARTITION BY section_id, lesion))::double * 10000) AS value FROM s""", "value")
def _(t):
    _, cells = segmented(t)
    return C.pseudobulk(t.space_expr.join(cells, ["section_id", "cell_id"]), ["section_id", "lesion"]).drop("lib")


@query("a37_lesion_burden_by_section", f"""
WITH RECURSIVE z AS (SELECT section_id, count(DISTINCT lesion) AS n_lesions, count(*) * {SIDE * SIDE}::double AS area FROM mask_bins GROUP BY 1),
tb AS (SELECT section_id, count(*) * {SIDE * SIDE}::double AS tissue FROM tissue_bins GROUP BY 1)
SELECT section_id, coalesce(n_lesions, 0) AS n_lesions, coalesce(area, 0) / tissue AS area_fraction FROM tb LEFT JOIN z USING (section_id)""", "area_fraction")
def _(t):
    bins, _cells = segmented(t)
    les = bins.groupBy("section_id").agg(F.count_distinct("lesion").alias("n_lesions"), F.count(F.lit(1)).alias("_b"))
    tis = G.density_scores(t.space, SIDE, SIGMA, "flagged", TISSUE).groupBy("section_id").agg(F.count(F.lit(1)).alias("_t"))
    return tis.join(les, "section_id", "left").select("section_id", F.coalesce("n_lesions", F.lit(0)).alias("n_lesions"),
                                                      (F.coalesce("_b", F.lit(0)) / F.col("_t")).alias("area_fraction"))


def burden(t):
    bins, _cells = segmented(t)
    les = bins.groupBy("section_id").agg(F.count_distinct("lesion").alias("n_lesions"), F.count(F.lit(1)).alias("mask"))
    tis = G.density_scores(t.space, SIDE, SIGMA, "flagged", TISSUE).groupBy("section_id").agg(F.count(F.lit(1)).alias("tissue"))
    return tis.join(les, "section_id", "left").na.fill(0)


# an animal of the spatial tables is four sections; its first one stands in for untreated controls
UNIT_SQL = "section_id // 4"


@query("a37_lesion_burden_by_animal", f"""
WITH RECURSIVE z AS (SELECT section_id, count(DISTINCT lesion) AS n_lesions, count(*) AS mask FROM mask_bins GROUP BY 1),
b AS (SELECT section_id, count(*) AS tissue FROM tissue_bins GROUP BY 1),
s AS (SELECT {UNIT_SQL} AS animal_id, section_id, coalesce(n_lesions, 0) AS n_lesions, coalesce(mask, 0) AS mask, tissue FROM b LEFT JOIN z USING (section_id))
SELECT animal_id, count(*) AS n_sections, sum(n_lesions)::bigint AS n_lesions, sum(n_lesions) / count(*) AS per_section, sum(mask) / sum(tissue) AS area_fraction,
       (SELECT sum(n_lesions) / count(*) FROM s WHERE animal_id = (SELECT min(animal_id) FROM s)) AS control_per_section FROM s GROUP BY 1""", "per_section area_fraction control_per_section")
def _(t):
    """Lesions per section and share of tissue by animal, beside the rate in control animals (false positives)."""
    s = burden(t).withColumn("animal_id", F.floor(F.col("section_id") / 4))
    first = s.agg(F.min("animal_id").alias("_first"))
    control = s.join(F.broadcast(first), F.col("animal_id") == F.col("_first")).agg((F.sum("n_lesions") / F.count(F.lit(1))).alias("control_per_section"))
    g = s.groupBy("animal_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n_lesions").alias("n_lesions"), (F.sum("n_lesions") / F.count(F.lit(1))).alias("per_section"),
                                   (F.sum("mask") / F.sum("tissue")).alias("area_fraction"))
    return g.join(F.broadcast(control))


@query("g14_compartments", f"""
WITH RECURSIVE d AS (SELECT section_id, cell_id, min(signed_dist) AS d FROM {RS} GROUP BY 1, 2),
c AS (SELECT section_id, cell_id, 'lesion' AS compartment FROM d WHERE d <= 0 UNION ALL SELECT section_id, cell_id, 'outside' FROM d WHERE d > 0 UNION ALL SELECT section_id, cell_id, 'far' FROM d WHERE d > 5),
s AS (SELECT compartment, gene_id, sum(cnt)::bigint AS n FROM c JOIN space_expr USING (section_id, cell_id) GROUP BY 1, 2)
SELECT *, ln(1 + n / (sum(n) OVER (PARTITION BY compartment))::double * 10000) AS value FROM s""", "value")
def _(t):
    s = G.nearest_signed(signed(t).withColumn("signed_dist", F.round("signed_dist", 6)))
    c = G.compartments(s, {"lesion": (None, 0.0), "outside": (0.0, None), "far": (5.0, None)})
    return C.pseudobulk(t.space_expr.join(c, ["section_id", "cell_id"]), ["compartment"]).drop("lib")


@query("g16_neighbourhood_means", """
SELECT k.section_id, c.cell_type, v.gene_id, sum(v.value) / (any_value(n.n) * 6) AS nb FROM knn6 k JOIN space c ON c.section_id = k.section_id AND c.cell_id = k.src
JOIN space_value v ON v.section_id = k.section_id AND v.cell_id = k.dst JOIN (SELECT section_id, cell_type, count(*) AS n FROM space GROUP BY 1, 2) n ON n.section_id = k.section_id AND n.cell_type = c.cell_type GROUP BY 1, 2, 3""", "nb")
def _(t):
    return G.neighbourhood_means(G.knn(t.space, 6), t.space, values(t), 6)


@query("g16_neighbourhood_contrast", """
WITH nb AS (SELECT k.section_id, k.src AS cell_id, v.gene_id, sum(v.value) / 6 AS nb FROM knn6 k JOIN space_value v ON v.section_id = k.section_id AND v.cell_id = k.dst GROUP BY 1, 2, 3),
d AS (SELECT section_id, cell_id, gene_id, abs(coalesce(v.value, 0) - coalesce(nb.nb, 0)) AS z FROM space_value v FULL JOIN nb USING (section_id, cell_id, gene_id))
SELECT d.section_id, c.cell_type, d.gene_id, sum(z) / any_value(n.n) AS disc FROM d JOIN space c USING (section_id, cell_id)
JOIN (SELECT section_id, cell_type, count(*) AS n FROM space GROUP BY 1, 2) n ON n.section_id = d.section_id AND n.cell_type = c.cell_type GROUP BY 1, 2, 3""", "disc")
def _(t):
    return G.neighbourhood_contrast(G.knn(t.space, 6), t.space, values(t), 6)


CTES["enrich"] = """
SELECT sender, receiver, observed, expected, (observed - expected) / nullif(sqrt(greatest(m2 - expected * expected, 0)), 0) AS z FROM (
 SELECT o.*, CASE WHEN sender = receiver THEN w * na * (na - 1) / (n * (n - 1)) ELSE w * na * nb / (n * (n - 1)) END AS expected,
  CASE WHEN sender = receiver THEN (w + r) * na * (na - 1) / (n * (n - 1)) + (so + si + cr) * na * (na - 1) * (na - 2) / (n * (n - 1) * (n - 2)) + (w * w - w - r - so - si - cr) * na * (na - 1) * (na - 2) * (na - 3) / (n * (n - 1) * (n - 2) * (n - 3))
  ELSE w * na * nb / (n * (n - 1)) + so * na * nb * (nb - 1) / (n * (n - 1) * (n - 2)) + si * na * (na - 1) * nb / (n * (n - 1) * (n - 2)) + (w * w - w - r - so - si - cr) * na * (na - 1) * nb * (nb - 1) / (n * (n - 1) * (n - 2) * (n - 3)) END AS m2
 FROM (SELECT a.cell_type AS sender, b.cell_type AS receiver, count(*) AS observed FROM knn6 k JOIN space a ON a.section_id = k.section_id AND a.cell_id = src JOIN space b ON b.section_id = k.section_id AND b.cell_id = dst GROUP BY 1, 2) o
 JOIN (SELECT cell_type AS sender, count(*)::double AS na FROM space GROUP BY 1) USING (sender) JOIN (SELECT cell_type AS receiver, count(*)::double AS nb FROM space GROUP BY 1) USING (receiver),
 (SELECT sum(o)::double AS w, (sum(o * o) - sum(o))::double AS so, (sum(i * i) - sum(o))::double AS si, 2 * (sum(o * i) - any_value(r))::double AS cr, any_value(r)::double AS r FROM
   (SELECT c.cell_id, (SELECT count(*) FROM knn6 WHERE src = c.cell_id) AS o, (SELECT count(*) FROM knn6 WHERE dst = c.cell_id) AS i, (SELECT count(*) FROM knn6 a JOIN knn6 b ON a.src = b.dst AND a.dst = b.src) AS r FROM space c)),
 (SELECT count(*)::double AS n FROM space))"""


@query("g17_neighbourhood_enrichment", "SELECT * FROM enrich", "expected z")
def _(t):
    return G.neighbourhood_enrichment(G.knn(t.space, 6), t.space)


@query("g19_adjacency_lookup", """
WITH x AS (SELECT DISTINCT a.cell_type AS sender, b.cell_type AS receiver, CASE WHEN a.cell_type = b.cell_type THEN 1 ELSE -1 END AS expected_sign FROM space a JOIN space b ON a.section_id = b.section_id)
SELECT x.*, e.z, coalesce(sign(e.z) = sign(expected_sign), false) AS agrees FROM x LEFT JOIN enrich e USING (sender, receiver)""", "z")
def _(t):
    k = t.space.select("section_id", "cell_type").distinct()
    x = (k.withColumnRenamed("cell_type", "sender").join(k.withColumnRenamed("cell_type", "receiver"), "section_id")
         .select("sender", "receiver").distinct()
         .withColumn("expected_sign", F.when(F.col("sender") == F.col("receiver"), 1).otherwise(-1)))
    return G.adjacency_lookup(G.neighbourhood_enrichment(G.knn(t.space, 6), t.space), x)


CTES["lr_pairs"] = "SELECT a.gene_id AS ligand, b.gene_id AS receptor FROM (SELECT DISTINCT gene_id FROM space_expr) a JOIN (SELECT DISTINCT gene_id FROM space_expr) b ON b.gene_id = a.gene_id + 1"
CTES["lr_scores"] = """
SELECT s.ligand, s.receptor, s.sender, s.receiver, s.mean_expr, count(*) FILTER ((coalesce(l.mean, 0) + coalesce(r.mean, 0)) / 2 >= s.mean_expr - 1e-12) / 20.0::double AS p
FROM (SELECT p.*, a.cell_type AS sender, b.cell_type AS receiver, (a.mean + b.mean) / 2 AS mean_expr FROM lr_pairs p JOIN lr_obs a ON a.gene_id = ligand JOIN lr_obs b ON b.gene_id = receptor WHERE a.frac > 0.3 AND b.frac > 0.3) s
CROSS JOIN range(0, 20) t(rep) LEFT JOIN lr_null l ON l.rep = t.rep AND l.gene_id = s.ligand AND l.cell_type = s.sender
LEFT JOIN lr_null r ON r.rep = t.rep AND r.gene_id = s.receptor AND r.cell_type = s.receiver GROUP BY 1, 2, 3, 4, 5"""
CTES["lr_fdr"] = """
SELECT *, least(1.0, min(p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q
FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM lr_scores)"""
CTES["lr_obs"] = """
SELECT cell_type, gene_id, sum(value) / any_value(n) AS mean, count(*) / any_value(n)::double AS frac FROM space_value JOIN space USING (section_id, cell_id)
JOIN (SELECT cell_type, count(*) AS n FROM space GROUP BY 1) USING (cell_type) GROUP BY 1, 2"""
CTES["lr_null"] = """
SELECT p.rep, k.cell_type, v.gene_id, sum(v.value) / any_value(k.n) AS mean
FROM (SELECT rep, section_id, cell_id, row_number() OVER (PARTITION BY rep ORDER BY md5(section_id || '|' || cell_id || '|' || rep || '|0'), section_id, cell_id) - 1 AS pos FROM space, range(0, 20) t(rep)) p
JOIN (SELECT cell_type, n, sum(n) OVER (ORDER BY cell_type) AS hi FROM (SELECT cell_type, count(*) AS n FROM space GROUP BY 1)) k ON p.pos < k.hi AND p.pos >= k.hi - k.n
JOIN space_value v ON v.section_id = p.section_id AND v.cell_id = p.cell_id GROUP BY 1, 2, 3"""


def lr(t, fdr=False):
    g = t.space_expr.select("gene_id").distinct()
    pairs = g.select(F.col("gene_id").alias("ligand"), (F.col("gene_id") + 1).alias("receptor")) \
        .join(g.select(F.col("gene_id").alias("receptor")), "receptor", "left_semi").select("ligand", "receptor")
    return L.ligand_receptor(values(t), t.space, pairs, ["section_id", "cell_id"], "cell_type", 20, min_fraction=0.3, fdr=fdr)


@query("g18_ligand_receptor", "SELECT * FROM lr_scores", "mean_expr p")
def _(t):
    return lr(t)


@query("j12_wiring", """
SELECT s.ligand, s.receptor, s.sender, s.receiver, s.mean_expr, s.q, e.z AS adjacency_z FROM lr_fdr s JOIN enrich e ON e.sender = s.sender AND e.receiver = s.receiver
WHERE q <= 0.2 AND s.sender <> s.receiver AND e.z >= -1""", "mean_expr q adjacency_z")
def _(t):
    s = lr(t, fdr=True).drop("p")
    adj = G.neighbourhood_enrichment(G.knn(t.space, 6), t.space).select("sender", "receiver", "z")
    return E.wiring(s, adj, 0.2, -1.0)


@query("g20_position_axis")
def _(t):
    fam = t.genes.where(F.col("program") == "Brand#13").select("gene_id")
    return L.position_axis(C.pseudobulk(t.expr, ["section_id"]), fam, t.sections, "n_cells")


@query("g21_densest_window", """
WITH n AS (SELECT a.section_id, a.cell_id, a.x, a.y, count(*) AS n_near FROM flag_cells a JOIN flag_cells b ON a.section_id = b.section_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 144 GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY n_near DESC, cell_id) = 1),
e AS (SELECT section_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM space GROUP BY 1)
SELECT s.section_id, any_value(b.cell_id) AS centre_cell, any_value(b.n_near) AS n_near, count(*) AS n_window, avg(s.flagged::int::double) AS flag_fraction FROM space s JOIN b USING (section_id) JOIN e USING (section_id)
WHERE s.x BETWEEN greatest(b.x - 10, x0) AND least(b.x + 10, x1) AND s.y BETWEEN greatest(b.y - 10, y0) AND least(b.y + 10, y1) GROUP BY 1""", "flag_fraction")
def _(t):
    return G.densest_windows(t.space, "flagged", 12.0, 10.0)


METRICS = ["lesion_count", "burden", "mean_size", "max_size", "largest_fraction", "gini", "fragmentation"]
# sections of the spatial tables as pairs of one animal: first and second level; every other animal is at its peak
_LONG = " UNION ALL ".join(f"SELECT section_id, '{m}' AS metric, {m}::double AS v FROM g10" for m in METRICS)
_RESID = """SELECT metric, '{name}' AS resid_on, animal_id, phase, lvl, v - y0 - sa * (score - a0) - sb * (flagged - b0) AS resid FROM l JOIN (
  SELECT metric, avg(v) AS y0, avg(score) AS a0, avg(flagged) AS b0, {sa} AS sa, {sb} AS sb FROM l GROUP BY 1) USING (metric)"""
_DET = "(var_pop(score) * var_pop(flagged) - covar_pop(score, flagged) * covar_pop(score, flagged))"


@query("g11_lesion_battery", f"""
WITH RECURSIVE g10 AS (SELECT section_id, coalesce(k, 0) AS lesion_count, coalesce(c / n_cells::double, 0) AS burden, coalesce(mean_size, 0) AS mean_size, coalesce(max_size, 0) AS max_size,
  coalesce(max_size / c::double, 0) AS largest_fraction, coalesce(gs / (k * c)::double, 0) AS gini, coalesce(k / c::double, 0) AS fragmentation
  FROM (SELECT section_id, count(*) AS n_cells FROM space GROUP BY 1) LEFT JOIN (
    SELECT section_id, count(*) AS k, sum(size)::bigint AS c, avg(size) AS mean_size, max(size) AS max_size, sum((2 * rn - m - 1) * size) AS gs FROM (
      SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY size) AS rn, count(*) OVER (PARTITION BY section_id) AS m FROM lesion_sizes) GROUP BY 1) USING (section_id)),
sv AS (SELECT section_id // 2 AS animal_id, avg(program) AS score FROM space GROUP BY 1),
l AS (SELECT metric, v, section_id // 2 AS animal_id, CASE WHEN (section_id // 2) % 2 = 0 THEN 'PEAK' ELSE 'REM' END AS phase, section_id % 2 AS lvl, score, flagged
      FROM ({_LONG}) JOIN (SELECT section_id, avg(flagged::int) AS flagged FROM space GROUP BY 1) USING (section_id) JOIN sv ON sv.animal_id = section_id // 2),
r AS ({_RESID.format(name='severity', sa='covar_pop(score, v) / var_pop(score)', sb='0.0::double')} UNION ALL
      {_RESID.format(name='severity+burden', sa=f'(covar_pop(score, v) * var_pop(flagged) - covar_pop(flagged, v) * covar_pop(score, flagged)) / {_DET}',
                     sb=f'(covar_pop(flagged, v) * var_pop(score) - covar_pop(score, v) * covar_pop(score, flagged)) / {_DET}')}),
an AS (SELECT metric, resid_on, animal_id, avg(resid) AS resid, min(phase) AS phase FROM r GROUP BY 1, 2, 3),
u AS (SELECT DISTINCT animal_id, phase FROM an),
i AS (SELECT *, row_number() OVER (ORDER BY animal_id) AS idx FROM u),
d AS (SELECT rep, animal_id, row_number() OVER (PARTITION BY rep ORDER BY md5(animal_id || '|' || rep || '|0'), animal_id) AS idx FROM u, range(0, 2000) t(rep)),
dl AS (SELECT d.rep, d.animal_id, i.phase FROM d JOIN i USING (idx)),
n1 AS (SELECT metric, resid_on, rep, avg(resid) FILTER (dl.phase = 'PEAK') - avg(resid) FILTER (dl.phase = 'REM') AS stat FROM an JOIN dl USING (animal_id) GROUP BY 1, 2, 3),
o1 AS (SELECT metric, resid_on, count(*) AS n, avg(resid) FILTER (phase = 'PEAK') - avg(resid) FILTER (phase = 'REM') AS observed FROM an GROUP BY 1, 2),
sl AS (SELECT metric, resid_on, animal_id, regr_slope(resid, lvl) AS slope FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT lvl) > 1),
n2 AS (SELECT metric, resid_on, rep, avg(slope * CASE WHEN ('0x' || substr(md5(animal_id || '|' || rep || '|0'), 1, 8))::bigint % 2 = 0 THEN 1.0::double ELSE -1.0 END) AS stat FROM sl, range(0, 2000) t(rep) GROUP BY 1, 2, 3),
o2 AS (SELECT metric, resid_on, count(*) AS n, avg(slope) AS observed FROM sl GROUP BY 1, 2),
b AS (SELECT 'phase_gap' AS family, * FROM o1 JOIN n1 USING (metric, resid_on) UNION ALL SELECT 'level_trend', * FROM o2 JOIN n2 USING (metric, resid_on)),
p AS (SELECT family, metric, resid_on, n, observed, (count(*) FILTER (abs(stat) >= abs(observed) - 1e-9) + 1) / (count(*) + 1)::double AS p FROM b GROUP BY ALL),
k AS (SELECT *, p * count(*) OVER (PARTITION BY family) / count(*) OVER (PARTITION BY family ORDER BY p) AS cand FROM p)
SELECT family, metric, resid_on, n, observed, p, least(1.0::double, min(cand) OVER (PARTITION BY family ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM k""", "observed p q")
def _(t):
    """Every lesion metric beyond severity, and beyond severity and inflamed share: phase gap and trend over levels, p and q."""
    from cohortspark.operators import resample as R
    les = G.graph_lesions(G.knn(t.space, 6), t.space.where("flagged"), 5).select("section_id", "lesion", "size").distinct()
    n = t.space.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("flagged").cast("int")).alias("flagged"))
    s = G.section_summary(n.drop("flagged"), les).join(n.select("section_id", "flagged"), "section_id").withColumn("animal_id", F.floor(F.col("section_id") / 2))
    score = t.space.groupBy(F.floor(F.col("section_id") / 2).alias("animal_id")).agg(F.avg("program").alias("score"))
    long = s.join(score, "animal_id").unpivot(["section_id", "animal_id", "score", "flagged"], [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "v")
    long = long.withColumn("phase", F.when(F.col("animal_id") % 2 == 0, "PEAK").otherwise("REM")).withColumn("lvl", F.col("section_id") % 2)
    return R.severity_battery(long, "metric", "v", "animal_id", "phase", "lvl", {"severity": ["score"], "severity+burden": ["score", "flagged"]}, ("REM", "PEAK"), 2000)
