"""SQL (DuckDB) for the grid queries."""

from __future__ import annotations

PART = """px AS (SELECT p_partkey AS id, (p_partkey // 50)::INT AS y, (p_partkey % 50)::INT AS x, (p_size % 4)::INT AS label,
  (floor(p_retailprice)::BIGINT % 256) / 255.0::DOUBLE AS r, ((floor(p_retailprice)::BIGINT // 3) % 256) / 255.0::DOUBLE AS g, ((p_size * 5) % 256) / 255.0::DOUBLE AS b FROM part)"""
_LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_F = "CASE WHEN {0} > pow(6.0/29, 3) THEN cbrt({0}) ELSE {0} / (3 * pow(6.0/29, 2)) + 4.0/29 END"
LAB = PART + f""",
lin AS (SELECT *, {_LIN.format('r')} AS lr, {_LIN.format('g')} AS lg, {_LIN.format('b')} AS lb FROM px),
xyz AS (SELECT *, (0.4124564::DOUBLE * lr + 0.3575761::DOUBLE * lg + 0.1804375::DOUBLE * lb) / 0.95047 AS tx, 0.2126729::DOUBLE * lr + 0.7151522::DOUBLE * lg + 0.0721750::DOUBLE * lb AS ty,
  (0.0193339::DOUBLE * lr + 0.1191920::DOUBLE * lg + 0.9503041::DOUBLE * lb) / 1.08883 AS tz FROM lin),
ff AS (SELECT *, {_F.format('tx')} AS fx, {_F.format('ty')} AS fy, {_F.format('tz')} AS fz FROM xyz),
lab AS (SELECT id, y, x, label, r, g, b, 116 * fy - 16 AS cl, 500 * (fx - fy) AS ca, 200 * (fy - fz) AS cb FROM ff)"""
PALETTE = LAB + """, pal AS (SELECT (round(b * 51)::INT % 16)::INT AS idx, round(avg(cl), 6) AS l, round(avg(ca), 6) AS a, round(avg(cb), 6) AS b FROM lab GROUP BY 1),
pp AS (SELECT p.idx AS i, q.idx AS j, p.l AS l1, p.a AS a1, p.b AS b1, q.l AS l2, q.a AS a2, q.b AS b2 FROM pal p, pal q)"""
DE00 = PALETTE + """,
s1 AS (SELECT *, (sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2 AS cm FROM pp),
s2 AS (SELECT *, 1.5 - 0.5 * sqrt(pow(cm,7) / (pow(cm,7) + pow(25.0,7))) AS g FROM s1),
s3 AS (SELECT *, a1*g AS x1, a2*g AS x2 FROM s2),
s4 AS (SELECT *, sqrt(x1*x1+b1*b1) AS c1, sqrt(x2*x2+b2*b2) AS c2 FROM s3),
s5 AS (SELECT *, CASE WHEN c1=0 THEN 0 ELSE (degrees(atan2(b1,x1)) + 360) % 360 END AS h1, CASE WHEN c2=0 THEN 0 ELSE (degrees(atan2(b2,x2)) + 360) % 360 END AS h2 FROM s4),
s6 AS (SELECT *, CASE WHEN c1*c2=0 THEN 0 WHEN h2-h1>180 THEN h2-h1-360 WHEN h2-h1<-180 THEN h2-h1+360 ELSE h2-h1 END AS dh,
  CASE WHEN c1*c2=0 THEN h1+h2 WHEN abs(h1-h2)<=180 THEN (h1+h2)/2 WHEN h1+h2<360 THEN (h1+h2+360)/2 ELSE (h1+h2-360)/2 END AS h FROM s5),
s7 AS (SELECT *, 2*sqrt(c1*c2)*sin(radians(dh)/2) AS bh, (l1+l2)/2 AS lm, (c1+c2)/2 AS cc,
  1-0.17*cos(radians(h-30))+0.24*cos(radians(2*h))+0.32*cos(radians(3*h+6))-0.2*cos(radians(4*h-63)) AS t FROM s6),
s8 AS (SELECT *, (l2-l1)/(1+0.015*pow(lm-50,2)/sqrt(20+pow(lm-50,2))) AS kl, (c2-c1)/(1+0.045*cc) AS kc, bh/(1+0.015*cc*t) AS kh,
  -2*sqrt(pow(cc,7)/(pow(cc,7)+pow(25.0,7)))*sin(radians(60*exp(-pow((h-275)/25,2)))) AS rt FROM s7),
de AS (SELECT i, j, round(sqrt(kl*kl+kc*kc+kh*kh+rt*kc*kh), 6) AS de FROM s8)"""
COMPONENTS = PART + """,
ed AS (SELECT p.id AS a, q.id AS b FROM px p JOIN px q ON p.label = q.label AND ((q.id = p.id + 1 AND q.y = p.y) OR q.id = p.id + 50)),
ee AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
cc(id, c) AS (SELECT id, id FROM px UNION SELECT e.b, cc.c FROM cc JOIN ee e ON e.a = cc.id),
lo AS (SELECT id, min(c) AS c FROM cc GROUP BY id),
rg AS (SELECT px.*, (dense_rank() OVER (ORDER BY c) - 1)::INT AS region FROM px JOIN lo USING (id)),
rc AS (SELECT region, arg_min(label, id)::INT AS label, count(*) AS area, min(y) AS r0, min(x) AS c0, max(y) AS r1, max(x) AS c1, arg_min(y, id) AS seed_y, arg_min(x, id) AS seed_x, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM rg GROUP BY region),
nb AS (SELECT p.id, p.region AS a, q.region AS b FROM rg p JOIN rg q ON (q.id = p.id + 1 AND q.y = p.y) OR q.id = p.id + 50),
re AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS w FROM nb WHERE a <> b GROUP BY 1, 2),
sy AS (SELECT a AS region, b AS near, w FROM re UNION ALL SELECT b, a, w FROM re),
bo AS (SELECT region, sum((y = 0)::INT + (x = 0)::INT + (y = (SELECT max(y) FROM px))::INT + (x = 49)::INT)::BIGINT AS border FROM rg GROUP BY region),
pe AS (SELECT bo.region, border, (border + coalesce((SELECT sum(w) FROM sy WHERE sy.region = bo.region), 0))::BIGINT AS perimeter FROM bo)"""
ORDERS = """oc AS (SELECT o_orderkey AS id, (o_orderkey // 150)::INT AS y, (o_orderkey % 150)::INT AS x, substr(o_orderpriority, 1, 1)::INT - 1 AS label FROM orders)"""
BOXES = """bx AS (SELECT p_partkey AS id, (p_partkey * 37) % 500 AS x0, (p_partkey * 91) % 700 AS y0, (p_partkey * 37) % 500 + p_size % 7 AS x1, (p_partkey * 91) % 700 + p_size % 5 AS y1 FROM part)"""
RINGS = BOXES + """,
pt AS (SELECT id, 0 AS ord, x0::DOUBLE AS x, y0::DOUBLE AS y FROM bx UNION ALL SELECT id, 1, x1 + 1, y0 FROM bx UNION ALL SELECT id, 2, x1 + 2, y1 + 3 FROM bx UNION ALL SELECT id, 3, x0, y1 + 1 FROM bx)"""
STATS = """st AS (SELECT sqrt(pow(stddev_pop((r-g)*255),2)+pow(stddev_pop(((r+g)/2-b)*255),2)) + 0.3*sqrt(pow(avg((r-g)*255),2)+pow(avg(((r+g)/2-b)*255),2)) AS colorfulness,
  avg(cl) AS mean_l, stddev_pop(cl) AS std_l, avg(ca) AS mean_a, stddev_pop(ca) AS std_a, avg(cb) AS mean_b, stddev_pop(cb) AS std_b, avg(sqrt(ca*ca+cb*cb)) AS saturation FROM lab)"""
HIST = """hi AS (SELECT least(63, floor(greatest(0.0, least(100.0, cl)) / 100 * 64))::INT AS bin, count(*) AS n FROM lab GROUP BY 1),
en AS (SELECT -sum(p * log2(p)) AS entropy_bits FROM (SELECT n / (sum(n) OVER ())::DOUBLE AS p FROM hi))"""
SOBEL = """of AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)), mx AS (SELECT max(y) AS h, max(x) AS w FROM lab),
aq AS (SELECT id, dy, dx, CASE WHEN y + dy < 0 THEN -(y + dy) WHEN y + dy > h THEN 2 * h - y - dy ELSE y + dy END AS ty, CASE WHEN x + dx < 0 THEN -(x + dx) WHEN x + dx > w THEN 2 * w - x - dx ELSE x + dx END AS tx FROM lab, of, mx),
gr AS (SELECT aq.id, sum(dx * (2 - abs(dy)) * cl / 100) AS gx, sum(dy * (2 - abs(dx)) * cl / 100) AS gy FROM aq JOIN lab ON lab.y = ty AND lab.x = tx GROUP BY 1),
so AS (SELECT avg((sqrt(gx*gx+gy*gy) > 0.1)::INT::DOUBLE) AS edge_density FROM gr)"""
_BACK = "CASE WHEN {0} > 6.0/29 THEN {0}*{0}*{0} ELSE 3 * pow(6.0/29, 2) * ({0} - 4.0/29) END"


def _inverse_row(k: int) -> str:
    from gridloom.functions.color import XYZ_TO_RGB

    a, b, c = XYZ_TO_RGB[k]
    return f"greatest(0.0, {a!r}::DOUBLE * vx + {b!r}::DOUBLE * vy + {c!r}::DOUBLE * vz)"


_GAMMA = "greatest(0.0, least(1.0, CASE WHEN {0} <= 0.0031308 THEN 12.92 * {0} ELSE 1.055 * pow({0}, 1 / 2.4::DOUBLE) - 0.055 END))"
_STATS_COLUMNS = "colorfulness mean_l std_l mean_a std_a mean_b std_b saturation".split()
_WEIGHTS = "(VALUES ('fidelity', 0.3::DOUBLE), ('geometry', 0.25), ('printability', 0.15), ('color', 0.15), ('speed', 0.1), ('efficiency', 0.05)) w(name, weight)"

SQL = {
    "px_srgb_to_lab": f"WITH {LAB} SELECT y, x, round(cl, 6) AS lab_l, round(ca, 6) AS lab_a, round(cb, 6) AS lab_b FROM lab",
    "px_lab_roundtrip": f"""WITH {LAB}, f2 AS (SELECT y, x, (cl + 16) / 116 + ca / 500 AS f0, (cl + 16) / 116 AS f1, (cl + 16) / 116 - cb / 200 AS f2 FROM lab),
      b1 AS (SELECT y, x, ({_BACK.format('f0')}) * 0.95047 AS vx, {_BACK.format('f1')} AS vy, ({_BACK.format('f2')}) * 1.08883 AS vz FROM f2),
      b2 AS (SELECT y, x, {_inverse_row(0)} AS vr, {_inverse_row(1)} AS vg, {_inverse_row(2)} AS vb FROM b1),
      b3 AS (SELECT y, x, {_GAMMA.format('vr')} AS r2, {_GAMMA.format('vg')} AS g2, {_GAMMA.format('vb')} AS b2 FROM b2)
      SELECT y, x, round(r2, 6) AS r2, round(g2, 6) AS g2, round(b2, 6) AS b2, CASE WHEN 0.299 * r2 + 0.587 * g2 + 0.114 * b2 > 0.55 THEN 'black' ELSE 'white' END AS ink FROM b3""",
    "delta_e76_table": f"WITH {PALETTE} SELECT i, j, round(sqrt(pow(l1-l2,2)+pow(a1-a2,2)+pow(b1-b2,2)), 6) AS de FROM pp",
    "delta_e00_table": f"WITH {DE00} SELECT i, j, de FROM de",
    "palette_gate": f"WITH {DE00} SELECT min(de) AS separation, CASE WHEN min(de) < 7 THEN 'fatal' WHEN min(de) < 12 THEN 'warning' ELSE 'pass' END AS severity FROM de WHERE i <> j",
    "image_stats": f"WITH {LAB}, {STATS} SELECT 'grid' AS image, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STATS_COLUMNS) + " FROM st",
    "luminance_hist": f"WITH {LAB}, {HIST} SELECT bin, n FROM hi",
    "entropy_bits": f"WITH {LAB}, {HIST} SELECT 'grid' AS image, round(entropy_bits, 6) AS entropy_bits FROM en",
    "sobel_edge_density": f"WITH {LAB}, {SOBEL} SELECT 'grid' AS image, round(edge_density, 6) AS edge_density FROM so",
    "auto_tune": f"""WITH {LAB}, {STATS}, {HIST}, {SOBEL} SELECT 'grid' AS image, greatest(8, least(30, round_even(6 + 0.12 * colorfulness + 6 * edge_density + 0.8 * entropy_bits, 0)::INT))::INT AS n_colors,
      CASE WHEN edge_density > 0.25 THEN 3 WHEN edge_density < 0.05 THEN 1 END AS smooth_passes FROM st, en, so""",
    "stride_sample": "WITH s AS (SELECT greatest(1, count(*) // 77) AS step FROM part) SELECT p_partkey FROM part, s WHERE p_partkey % step = 0 AND p_partkey < step * 77",
    "nearest_center_assign": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
      d AS (SELECT vec_id, k, sum(pow(v - (i = k)::INT, 2)) AS d FROM e, range(8) r(k) GROUP BY 1, 2) SELECT vec_id, arg_min(k, (d, k))::INT AS centre FROM d GROUP BY 1""",
    "class_means_renumber": f"""WITH {LAB}, m AS (SELECT label AS old, count(*) AS n, round(avg(cl), 6) AS lab_l, round(avg(ca), 6) AS lab_a, round(avg(cb), 6) AS lab_b FROM lab GROUP BY 1)
      SELECT *, (row_number() OVER (ORDER BY n DESC, lab_l, lab_a, lab_b) - 1)::INT AS label FROM m""",
    "modal_filter_1": f"""WITH {ORDERS}, of AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
      v AS (SELECT p.y, p.x, p.label, q.label AS cand, count(*) AS n FROM oc p, of JOIN oc q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3, 4)
      SELECT y, x, cand AS label FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, (cand <> label)::INT, cand) AS k FROM v) WHERE k = 1""",
    "crack_edges": f"""WITH {ORDERS}, e AS (SELECT y, x, label, 'r' AS dir, 0 AS dy, 1 AS dx FROM oc UNION ALL SELECT y, x, label, 'd', 1, 0 FROM oc
      UNION ALL SELECT y, -1, -1, 'r', 0, 1 FROM oc WHERE x = 0 UNION ALL SELECT -1, x, -1, 'd', 1, 0 FROM oc WHERE y = 0)
      SELECT e.y, e.x, dir FROM e LEFT JOIN oc q ON q.y = e.y + dy AND q.x = e.x + dx WHERE e.label <> coalesce(q.label, -1)""",
    "junctions": f"""WITH RECURSIVE {COMPONENTS}, h AS (SELECT max(y) AS h, max(x) AS w FROM rg), v AS (SELECT unnest(range((SELECT h + 2 FROM h)))::INT AS v), u AS (SELECT unnest(range((SELECT w + 2 FROM h)))::INT AS u),
      s AS (SELECT v, u, coalesce(region, -1) AS region FROM v, u, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx) LEFT JOIN rg ON rg.y = v - dy AND rg.x = u - dx)
      SELECT v, u FROM s GROUP BY v, u HAVING count(DISTINCT region) >= 3 OR count(*) FILTER (WHERE region >= 0) = 1""",
    "component_map": f"WITH RECURSIVE {COMPONENTS} SELECT y, x, region FROM rg",
    "components_count": f"WITH RECURSIVE {COMPONENTS} SELECT count(*) AS n FROM rc",
    "region_records": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM rc",
    "region_edges": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM re",
    "region_perimeter": f"WITH RECURSIVE {COMPONENTS} SELECT * FROM pe",
    "boundary_identity": f"""WITH RECURSIVE {COMPONENTS}, t AS (SELECT sum(perimeter) AS sides, sum(border)::BIGINT AS border FROM pe),
      k AS (SELECT (count(*) + (SELECT border FROM t))::BIGINT AS cracks FROM nb WHERE a <> b) SELECT cracks, border, sides = 2 * cracks - border AS holds FROM k, t""",
    "fill_holes": f"""WITH RECURSIVE {COMPONENTS}, h AS (SELECT region, min(near) AS near FROM sy GROUP BY region HAVING count(*) = 1),
      g AS (SELECT h.region, n.label FROM h JOIN rc USING (region) JOIN bo USING (region) JOIN rc n ON n.region = h.near WHERE border = 0 AND rc.area <= 3)
      SELECT y, x, coalesce(g.label, rg.label) AS label FROM rg LEFT JOIN g USING (region)""",
    "area_opening": f"""WITH RECURSIVE {COMPONENTS}, k AS (SELECT s.region, s.near, row_number() OVER (PARTITION BY s.region ORDER BY (n.area < 4)::INT, w DESC, abs(o.label - n.label), n.label, s.near) AS k
      FROM sy s JOIN rc o ON o.region = s.region JOIN rc n ON n.region = s.near WHERE o.area < 4), one AS (SELECT region, near FROM k WHERE k = 1),
      walk(region, pos, path) AS (SELECT region, near, [region] FROM one UNION ALL SELECT w.region, o.near, list_append(w.path, w.pos) FROM walk w JOIN one o ON o.region = w.pos WHERE NOT list_contains(w.path, w.pos)),
      fin AS (SELECT region, pos FROM walk WHERE pos NOT IN (SELECT region FROM one))
      SELECT y, x, coalesce(n.label, rg.label)::INT AS label FROM rg LEFT JOIN fin USING (region) LEFT JOIN rc n ON n.region = fin.pos""",
    "region_topk_area": f"WITH RECURSIVE {COMPONENTS} SELECT region, area FROM (SELECT region, area, row_number() OVER (ORDER BY area DESC, region) AS k, count(*) OVER () AS n FROM rc) WHERE k <= ceil(n * 0.5)",
    "palette_compact": f"WITH {ORDERS} SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS new, count(*) AS coverage FROM oc GROUP BY label",
    "size_distribution": f"""WITH RECURSIVE {COMPONENTS} SELECT label, count(*) AS n, min(area) AS low, max(area) AS high, round(avg(area), 6) AS mean, round(stddev_pop(area), 6) AS std,
      round(quantile_cont(area, 0.1), 6) AS p10, round(quantile_cont(area, 0.5), 6) AS median, round(quantile_cont(area, 0.9), 6) AS p90 FROM rc GROUP BY label""",
    "compactness": f"WITH RECURSIVE {COMPONENTS} SELECT region, round(4 * pi() * area / (perimeter * perimeter), 6) AS compactness, round(least(area::DOUBLE, pi() * pow(2 * area / perimeter::DOUBLE, 2)), 6) AS compact_area FROM rc JOIN pe USING (region)",
    "bbox_range_join": f"WITH {BOXES} SELECT p.id AS a, q.id AS b FROM bx p JOIN bx q ON p.id < q.id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1",
    "ring_shoelace": f"""WITH {RINGS}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pt WINDOW w AS (PARTITION BY id ORDER BY ord))
      SELECT id, round(sum(x * ny - nx * y) / 2, 6) AS area, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 6) AS perimeter FROM n GROUP BY id""",
    "curvature_energy": f"""WITH {RINGS}, d AS (SELECT *, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy FROM pt WINDOW w AS (PARTITION BY id ORDER BY ord)),
      e AS (SELECT *, lead(ux) OVER w AS vx, lead(uy) OVER w AS vy FROM d WINDOW w AS (PARTITION BY id ORDER BY ord)), t AS (SELECT *, atan2(ux * vy - uy * vx, ux * vx + uy * vy) AS t FROM e)
      SELECT id, round(sum(CASE WHEN abs(degrees(t)) <= 120 THEN t * t END) / nullif(sum(sqrt(ux * ux + uy * uy)), 0), 6) AS energy FROM t GROUP BY id""",
    "bezier_flatten": f"""WITH {BOXES}, s AS (SELECT id, k, k / 4.0::DOUBLE AS t, x0, y0, x0 + 3 AS xb, y0 - 2 AS yb, x1 + 1 AS xc, y1 + 4 AS yc, x1, y1 FROM bx, range(5) r(k))
      SELECT id, k::INT AS k, round(pow(1-t,3)*x0 + 3*(1-t)*(1-t)*t*xb + 3*(1-t)*t*t*xc + t*t*t*x1, 6) AS x, round(pow(1-t,3)*y0 + 3*(1-t)*(1-t)*t*yb + 3*(1-t)*t*t*yc + t*t*t*y1, 6) AS y FROM s""",
    "font_fit": """SELECT p_partkey, round(2 * greatest(p_size / 2.0::DOUBLE - 0.8, 0) / sqrt(pow(len(p_size::VARCHAR) * 0.636, 2) + 0.729 * 0.729), 6) AS font,
      CASE WHEN p_size <= 36 THEN substr('1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZ', p_size, 1) END AS code FROM part""",
    "letterbox": f"WITH {PART} SELECT y, x, round(36 + 2 * x * 5.4::DOUBLE, 6) AS pt_x, round(36 + (720 - 540) / 2.0::DOUBLE + 2 * y * 5.4::DOUBLE, 6) AS pt_y FROM px",
    "legend_layout": f"WITH {PALETTE} SELECT idx, ((idx % 3) * 94 + 64)::DOUBLE AS chip_x, ((idx // 3) * 30)::DOUBLE AS chip_y, substr('1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZ', idx + 1, 1) AS code FROM pal",
    "regression_check": """WITH n AS (SELECT o_orderstatus, round(avg(o_totalprice), 6) AS value FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY 1), b AS (SELECT o_orderstatus, round(avg(o_totalprice), 6) AS base FROM orders WHERE year(o_orderdate) < 1995 GROUP BY 1)
      SELECT o_orderstatus, value, CASE WHEN o_orderstatus = 'F' THEN value BETWEEN 1000 AND 250000 WHEN base IS NULL THEN true WHEN base = 0 THEN abs(value) <= 0.001 ELSE abs((value - base) / base) <= 0.001 END AS passed FROM n LEFT JOIN b USING (o_orderstatus)""",
    "engine_score": f"""SELECT p_partkey, round(100 * exp(sum(weight * ln(greatest(1e-12, least(1.0, (p_size + len(p_name)) / 100.0::DOUBLE + len(name) / 50.0::DOUBLE))))), 6) AS score FROM part, {_WEIGHTS} GROUP BY p_partkey""",
    "arc_sides": f"WITH RECURSIVE {COMPONENTS}, o AS (SELECT -1 AS left_region, region AS right_region, border AS w FROM bo WHERE border > 0) SELECT * FROM o UNION ALL SELECT a, b, w FROM re",
    "config_resolve": "SELECT * FROM (VALUES ('easy', 5.0::DOUBLE, 8, 100000, 64), ('medium', 3.5, 16, 100000, 64), ('hard', 2.5, 24, 100000, 64), ('dense', 1.5, 17, 100000, 64), ('partial', 1.5, 17, 100000, 64)) t(preset, d_min_mm, n_colors, sample_px, hash_length)",
    "lloyd_step": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
      d AS (SELECT vec_id, k, sum(pow(v - (i = k)::INT, 2)) AS d FROM e, range(8) r(k) GROUP BY 1, 2), c AS (SELECT vec_id, arg_min(k, (d, k))::INT AS centre FROM d GROUP BY 1)
      SELECT centre, i::INT AS dim, count(*) AS n, round(avg(v), 6) AS mean FROM c JOIN e USING (vec_id) GROUP BY 1, 2""",
    "distance_transform": f"""WITH {PART}, f AS (SELECT y AS near_y, x AS near_x FROM px WHERE label = 0),
      d AS (SELECT id, y, x, near_y, near_x, (y - near_y) * (y - near_y) + (x - near_x) * (x - near_x) AS d2 FROM px, f)
      SELECT y, x, round(sqrt(d2), 6) AS d, near_y, near_x FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, near_y, near_x) = 1""",
    "dilate_mask": f"""WITH {PART} SELECT p.y, p.x, EXISTS (SELECT 1 FROM px q WHERE q.r > 0.9 AND abs(q.y - p.y) + abs(q.x - p.x) <= 2) AS grown FROM px p""",
    "resize_area": f"""WITH {PART}, s AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM px),
      t AS (SELECT h, w, greatest(1, round_even(h * least(1.0::DOUBLE, 20.0::DOUBLE / greatest(h, w)), 0))::INT AS th, greatest(1, round_even(w * least(1.0::DOUBLE, 20.0::DOUBLE / greatest(h, w)), 0))::INT AS tw FROM s),
      i AS (SELECT y.v AS y, i.v AS ty, least((i.v + 1) * h, (y.v + 1) * th) - greatest(i.v * h, y.v * th) AS n FROM t, (SELECT DISTINCT y AS v FROM px) y, (SELECT unnest(range((SELECT th FROM t))) AS v) i),
      j AS (SELECT x.v AS x, j.v AS tx, least((j.v + 1) * w, (x.v + 1) * tw) - greatest(j.v * w, x.v * tw) AS n FROM t, (SELECT DISTINCT x AS v FROM px) x, (SELECT unnest(range((SELECT tw FROM t))) AS v) j)
      SELECT ty::INT AS y, tx::INT AS x, round(sum(r * i.n * j.n) / sum(i.n * j.n), 6) AS r, round(sum(g * i.n * j.n) / sum(i.n * j.n), 6) AS g, round(sum(b * i.n * j.n) / sum(i.n * j.n), 6) AS b
      FROM px JOIN i ON i.y = px.y AND i.n > 0 JOIN j ON j.x = px.x AND j.n > 0 GROUP BY ALL""",
    "ssim": f"""WITH {PART}, v AS (SELECT y, x, round(r * 255) AS a, round(g * 255) AS b FROM px),
      q AS (SELECT p.y, p.x, avg(o.a) AS ma, avg(o.b) AS mb, var_samp(o.a) AS va, var_samp(o.b) AS vb, covar_samp(o.a, o.b) AS c, count(*) AS n
        FROM v p JOIN v o ON abs(o.y - p.y) <= 3 AND abs(o.x - p.x) <= 3 GROUP BY p.y, p.x)
      SELECT round(avg((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))), 6) AS ssim FROM q WHERE n = 49""",
}
