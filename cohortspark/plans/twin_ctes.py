"""SQL twins of the shared tables. A CTE is pulled in when its name occurs in a statement."""

CTES: dict[str, str] = {}

CTES["cells"] = """
SELECT c.c_nationkey::bigint AS animal_id, o.o_custkey AS section_id, o.o_orderkey AS cell_id,
       o.o_orderpriority AS cell_type, o.o_orderstatus AS niche, c.c_mktsegment AS region,
       date_diff('day', date '1992-01-01', o.o_orderdate::date)::bigint AS cell_day
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

CTES["counts"] = """
SELECT l_orderkey AS cell_id, l_partkey AS gene_id, sum(l_quantity)::bigint AS cnt FROM lineitem GROUP BY 1, 2"""

CTES["expr"] = """SELECT cells.*, counts.gene_id, counts.cnt FROM counts JOIN cells USING (cell_id)"""

CTES["sections"] = """
SELECT section_id, min(animal_id) AS animal_id, min(region) AS region, count(*) AS n_cells
FROM cells GROUP BY section_id"""

CTES["animals"] = """
SELECT animal_id, animal_name, model, run_id, score, day, n_cells,
       CASE WHEN pos < 0.34 THEN 'ONSET1' WHEN pos < 0.67 THEN 'PEAK1' ELSE 'REMISSION1' END AS stage
FROM (SELECT d.animal_id, n_name AS animal_name, CASE WHEN n_regionkey >= 3 THEN 'MONO' ELSE 'RR' END AS model,
             r_name AS run_id, s.score, d.day, d.n_cells, percent_rank() OVER (ORDER BY d.day) AS pos
      FROM nation JOIN region ON n_regionkey = r_regionkey
      JOIN (SELECT c_nationkey, avg(c_acctbal) / 1000 AS score FROM customer GROUP BY 1) s ON s.c_nationkey = n_nationkey
      JOIN (SELECT animal_id, avg(cell_day) AS day, count(*) AS n_cells FROM cells GROUP BY 1) d
        ON d.animal_id = n_nationkey)"""

CTES["genes"] = """
SELECT p_partkey AS gene_id, p_name AS symbol, p_brand AS program, p_type AS module, p_retailprice AS weight,
       p_size AS gene_size FROM part"""

CTES["curves"] = """
SELECT user_id AS animal_id, date_diff('day', date '2024-01-01', ts::date)::bigint AS day,
       least(floor(max(value) / 25) * 0.5::double, 5.0::double) AS score, max(value) AS weight
FROM events GROUP BY 1, 2"""

CTES["curve_ends"] = """
SELECT user_id AS animal_id, (max(date_diff('day', date '2024-01-01', ts::date))
       + CASE WHEN count(*) >= 67 THEN 1 ELSE 0 END)::bigint AS end_day,
       CASE WHEN count(*) >= 67 THEN 1.5::double ELSE 0.5::double END AS end_score
FROM events GROUP BY 1"""

CTES["space"] = """
SELECT label::bigint AS section_id, vec_id AS cell_id, embedding[1]::double * 100.0::double AS x,
       embedding[2]::double * 100.0::double AS y,
       'T' || (CASE WHEN embedding[3] > 0 THEN '1' ELSE '0' END) || (CASE WHEN embedding[4] > 0 THEN '1' ELSE '0' END)
         AS cell_type,
       embedding[5] > 0 AS flagged, embedding[6]::double * 100.0::double AS program
FROM embeddings"""

CTES["space_expr"] = """
SELECT section_id, cell_id, gene_id, cnt FROM (
  SELECT label::bigint AS section_id, vec_id AS cell_id, (i - 1)::bigint AS gene_id,
         floor(embedding[i]::double * 100.0::double)::bigint AS cnt
  FROM embeddings, range(9, 65) t(i)) WHERE cnt > 0"""

# ---- derived tables used by several statements

# log1p CP10k pseudobulk by animal, every animal x gene pair present (zeros are data)
CTES["pb_dense"] = """
SELECT a.animal_id, g.gene_id, ln(1 + coalesce(s.n, 0) / l.lib::double * 10000) AS value
FROM (SELECT DISTINCT animal_id FROM cells) a CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g
LEFT JOIN (SELECT animal_id, gene_id, sum(cnt)::bigint AS n FROM expr GROUP BY 1, 2) s
  ON s.animal_id = a.animal_id AND s.gene_id = g.gene_id
JOIN (SELECT animal_id, sum(cnt)::bigint AS lib FROM expr GROUP BY 1) l ON l.animal_id = a.animal_id"""

# the same with animal covariates
CTES["pb_cov"] = """SELECT pb_dense.*, model, run_id, stage, score, day FROM pb_dense JOIN animals USING (animal_id)"""

# midranks of value, day and score per gene over all animals
CTES["pb_rank"] = """
SELECT animal_id, gene_id, value,
       rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::double AS rx,
       rank() OVER (PARTITION BY gene_id ORDER BY day) + (count(*) OVER (PARTITION BY gene_id, day) - 1) / 2.0::double AS ry,
       rank() OVER (PARTITION BY gene_id ORDER BY score) + (count(*) OVER (PARTITION BY gene_id, score) - 1) / 2.0::double AS rz
FROM pb_cov"""

CTES["gene_trend"] = """
SELECT gene_id, corr(rx, ry) AS rho, corr(rx, rz) AS rho_xs, corr(ry, rz) AS rho_ys, count(*) AS n
FROM pb_rank GROUP BY gene_id HAVING max(value) <> min(value)"""

CTES["shared_programs"] = """
SELECT program, animal_id, avg(z) AS score FROM (
  SELECT g.program, p.animal_id, (p.value - avg(p.value) OVER (PARTITION BY p.gene_id))
         / nullif(stddev_pop(p.value) OVER (PARTITION BY p.gene_id), 0) AS z
  FROM pb_dense p JOIN genes g USING (gene_id)) GROUP BY 1, 2"""

# 6 nearest cells inside a section, ties by cell id
CTES["knn6"] = """
SELECT section_id, src, dst, dist, nn FROM (
  SELECT a.section_id, a.cell_id AS src, b.cell_id AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist,
         row_number() OVER (PARTITION BY a.section_id, a.cell_id
                            ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), b.cell_id) AS nn
  FROM space a JOIN space b ON a.section_id = b.section_id AND a.cell_id <> b.cell_id) WHERE nn <= 6"""

CTES["section_curves"] = """
SELECT floor(user_id / 10)::bigint AS animal_id, user_id AS section_id,
       floor(date_diff('day', date '2024-01-01', ts::date) / 7)::bigint AS day, floor(max(value) / 250) * 0.5::double AS score
FROM events GROUP BY 1, 2, 3"""

CTES["curve_units"] = """SELECT user_id AS animal_id, avg(value) AS program, stddev_pop(value) AS severity FROM events GROUP BY 1"""

CTES["curve"] = """
SELECT c.animal_id, c.day, c.score, e.end_day, false AS imputed FROM curves c JOIN curve_ends e USING (animal_id) WHERE c.day <= e.end_day
UNION ALL SELECT e.animal_id, e.end_day, e.end_score, e.end_day, true FROM curve_ends e
WHERE NOT EXISTS (SELECT 1 FROM curves c WHERE c.animal_id = e.animal_id AND c.day = e.end_day)"""

CTES["curve_onset"] = """
SELECT animal_id, min(day) FILTER (q) AS onset_day, coalesce(arg_min(NOT holds, day) FILTER (q), false) AS onset_censored FROM (
  SELECT *, score >= 0.5 AND (holds OR day = end_day) AS q FROM (
    SELECT *, coalesce(lead(day) OVER w = day + 1 AND lead(score) OVER w >= 0.5, false) AS holds FROM curve
    WINDOW w AS (PARTITION BY animal_id ORDER BY day))) GROUP BY 1"""

CTES["curve_aligned"] = """
SELECT animal_id, day - onset_day AS t, score FROM curve JOIN curve_onset USING (animal_id) WHERE day >= onset_day"""

CTES["curve_ranked"] = """SELECT *, row_number() OVER (PARTITION BY animal_id ORDER BY day) AS rn FROM curve"""

CTES["curve_history"] = """
SELECT c.animal_id, tau::bigint AS tau, sum(c.score * exp(-(e.end_day - c.day) / tau::double)) AS ewi
FROM curves c JOIN curve_ends e USING (animal_id), range(1, 31) r(tau) WHERE c.day <= e.end_day GROUP BY 1, 2"""

# ---- flagged cells, density clusters, hulls by definition (an ordered pair with every other member on its left)
CTES["flag_cells"] = "SELECT * FROM space WHERE flagged"

CTES["db_near"] = """
SELECT a.section_id, a.cell_id AS a, b.cell_id AS b FROM flag_cells a JOIN flag_cells b
  ON a.section_id = b.section_id AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 100"""

CTES["db_core"] = "SELECT section_id, a AS cell_id FROM db_near GROUP BY 1, 2 HAVING count(*) >= 4"

CTES["db_reach"] = """
SELECT section_id, cell_id, cell_id AS lesion FROM db_core UNION
SELECT r.section_id, n.b, r.lesion FROM db_reach r JOIN db_near n ON n.section_id = r.section_id AND n.a = r.cell_id
JOIN db_core c ON c.section_id = n.section_id AND c.cell_id = n.b"""

CTES["db_cells"] = """
SELECT f.section_id, f.cell_id, c.cell_id IS NOT NULL AS core, CASE WHEN c.cell_id IS NOT NULL THEN k.lesion ELSE
   (SELECT min(r.lesion) FROM db_near n JOIN db_reach r ON r.section_id = n.section_id AND r.cell_id = n.b WHERE n.section_id = f.section_id AND n.a = f.cell_id) END AS lesion
FROM flag_cells f LEFT JOIN db_core c ON c.section_id = f.section_id AND c.cell_id = f.cell_id
LEFT JOIN (SELECT section_id, cell_id, min(lesion) AS lesion FROM db_reach GROUP BY 1, 2) k ON k.section_id = f.section_id AND k.cell_id = f.cell_id"""

CTES["lesion_cells"] = """
SELECT d.section_id, d.lesion, d.cell_id, s.x, s.y, s.cell_type FROM db_cells d JOIN space s ON s.section_id = d.section_id AND s.cell_id = d.cell_id WHERE lesion IS NOT NULL"""

CTES["lesion_hull"] = """
SELECT a.section_id, a.lesion, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM lesion_cells a JOIN lesion_cells b
  ON a.section_id = b.section_id AND a.lesion = b.lesion AND a.cell_id <> b.cell_id
JOIN lesion_cells c ON c.section_id = a.section_id AND c.lesion = a.lesion
GROUP BY a.section_id, a.lesion, a.cell_id, b.cell_id, a.x, a.y, b.x, b.y
HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= -1e-9 AND count(*) >= 3"""

CTES["lesion_signed"] = """
SELECT section_id, lesion, cell_id, CASE WHEN bool_and((ex - ax) * (y - ay) - (ey - ay) * (x - ax) >= -1e-9) THEN -1 ELSE 1 END
  * sqrt(min(pow(x - ax - t * (ex - ax), 2) + pow(y - ay - t * (ey - ay), 2))) AS signed_dist
FROM (SELECT s.section_id, s.cell_id, h.lesion, s.x, s.y, h.ax, h.ay, h.ex, h.ey,
             greatest(least(((s.x - h.ax) * (h.ex - h.ax) + (s.y - h.ay) * (h.ey - h.ay)) / (pow(h.ex - h.ax, 2) + pow(h.ey - h.ay, 2) + 1e-12), 1), 0) AS t
      FROM space s JOIN lesion_hull h ON h.section_id = s.section_id
      JOIN (SELECT section_id, lesion, min(ax) - 15 AS xl, max(ax) + 15 AS xh, min(ay) - 15 AS yl, max(ay) + 15 AS yh FROM lesion_hull GROUP BY 1, 2) q
        ON q.section_id = h.section_id AND q.lesion = h.lesion AND s.x BETWEEN xl AND xh AND s.y BETWEEN yl AND yh)
GROUP BY 1, 2, 3"""

# connected groups of flagged cells in the 6-nearest-neighbour graph
CTES["fk_edge"] = """
SELECT DISTINCT section_id, a, b FROM (
  SELECT k.section_id, src AS a, dst AS b FROM knn6 k JOIN flag_cells f ON f.section_id = k.section_id AND f.cell_id = src JOIN flag_cells g ON g.section_id = k.section_id AND g.cell_id = dst
  UNION ALL SELECT k.section_id, dst, src FROM knn6 k JOIN flag_cells f ON f.section_id = k.section_id AND f.cell_id = src JOIN flag_cells g ON g.section_id = k.section_id AND g.cell_id = dst)"""
CTES["fk_reach"] = """
SELECT section_id, a AS cell_id, a AS lesion FROM fk_edge UNION SELECT r.section_id, e.b, r.lesion FROM fk_reach r JOIN fk_edge e ON e.section_id = r.section_id AND e.a = r.cell_id"""
CTES["fk_cells"] = """
SELECT section_id, cell_id, lesion, count(*) OVER (PARTITION BY section_id, lesion) AS size FROM (SELECT section_id, cell_id, min(lesion) AS lesion FROM fk_reach GROUP BY 1, 2)"""

CTES["space_value"] = """
SELECT section_id, cell_id, gene_id, ln(1 + cnt / (sum(cnt) OVER (PARTITION BY section_id, cell_id))::double * 10000) AS value FROM space_expr"""
