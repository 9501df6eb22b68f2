"""SQL (DuckDB) for the queries of page_queries.py, written from the definitions."""

from __future__ import annotations

from gridloom.plans.oracles import _BACK, _GAMMA, BOXES, COMPONENTS, LAB, ORDERS, PART, RINGS, _inverse_row

_FIXED = "regexp_replace(printf('%.3f', {0}), '^-0\\.000$', '0.000')"
LABEL_LAB = LAB + ", ll AS (SELECT label, round(avg(cl), 6) AS cl, round(avg(ca), 6) AS ca, round(avg(cb), 6) AS cb FROM lab GROUP BY label)"
#: The components of the part grid together with its colours.
COLOURED = COMPONENTS + LABEL_LAB.removeprefix(PART)
SHEETS = """sh AS (SELECT 's' || (o_orderkey // 1024) AS image, o_orderkey AS id, ((o_orderkey % 1024) // 32)::INT AS y, (o_orderkey % 32)::INT AS x, substr(o_orderpriority, 1, 1)::INT - 1 AS label FROM orders),
ed AS (SELECT p.id AS a, q.id AS b FROM sh p JOIN sh q ON p.image = q.image AND p.label = q.label AND ((q.id = p.id + 1 AND q.y = p.y) OR q.id = p.id + 32)),
ee AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
cc(id, c) AS (SELECT id, id FROM sh UNION SELECT e.b, cc.c FROM cc JOIN ee e ON e.a = cc.id),
lo AS (SELECT id, min(c) AS c FROM cc GROUP BY id),
rg AS (SELECT sh.*, (dense_rank() OVER (PARTITION BY image ORDER BY c) - 1)::INT AS region FROM sh JOIN lo USING (id)),
rc AS (SELECT image, region, arg_min(label, id)::INT AS label, count(*) AS area, min(y) AS r0, min(x) AS c0, max(y) AS r1, max(x) AS c1, arg_min(y, id) AS seed_y, arg_min(x, id) AS seed_x, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM rg GROUP BY image, region),
nb AS (SELECT p.image, p.region AS a, q.region AS b FROM rg p JOIN rg q ON p.image = q.image AND ((q.id = p.id + 1 AND q.y = p.y) OR q.id = p.id + 32)),
re AS (SELECT image, least(a, b) AS a, greatest(a, b) AS b, count(*) AS w FROM nb WHERE a <> b GROUP BY ALL),
sy AS (SELECT image, a AS region, b AS near, w FROM re UNION ALL SELECT image, b, a, w FROM re),
si AS (SELECT p.image, p.region, 4 - (SELECT count(*) FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dy, dx) JOIN sh q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx) AS n FROM rg p),
bo AS (SELECT image, region, sum(n)::BIGINT AS border FROM si GROUP BY ALL),
sw AS (SELECT image, region, sum(w) AS w FROM sy GROUP BY ALL),
pe AS (SELECT bo.image, bo.region, border, (border + coalesce(w, 0))::BIGINT AS perimeter FROM bo LEFT JOIN sw USING (image, region))"""
SNAPSHOTS = """sn AS (SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS region_count, round(avg(o_totalprice) / 1000, 6) AS boundary_smoothness, round(avg(c_acctbal + 1000) / 10000, 6) AS mean_compactness,
  round(100 * avg((o_totalprice > 200000)::INT::DOUBLE), 6) AS tiny_region_pct, round(max(o_totalprice) / 1000, 6) AS label_density_per_cm2, round(min(o_totalprice) / 1000, 6) AS average_edge_length_mm, round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS printability_score
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def _rules() -> str:
    parts = []
    for rule, severity, measure, when in (
        ("region_count", "info", "region_count", "was > 0 AND now / was >= 1.3"), ("smoothness", "caution", "boundary_smoothness", "was > 0 AND now / was >= 1.5"),
        ("compactness", "caution", "mean_compactness", "was > 0 AND now / was <= 0.85"), ("tiny_regions", "caution", "tiny_region_pct", "now - was >= 5"),
        ("label_density", "info", "label_density_per_cm2", "was > 0 AND now / was >= 1.5"), ("edge_length", "info", "average_edge_length_mm", "was > 0 AND now / was <= 0.5"),
        ("printability", "caution", "printability_score", "now < was AND now <= 0.6"),
    ):
        parts.append(f"SELECT c_mktsegment, month, '{rule}' AS rule, '{severity}' AS severity, was, now FROM (SELECT c_mktsegment, month, {measure}::DOUBLE AS now, lag({measure}::DOUBLE) OVER (PARTITION BY c_mktsegment ORDER BY month) AS was FROM sn) WHERE was IS NOT NULL AND {when}")
    return SNAPSHOTS + ", ru AS (" + " UNION ALL ".join(parts) + ")"


def _modal(rounds: int) -> str:
    """A pass for each round; a pass that changes nothing is the last in effect."""
    out = [ORDERS, "of AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))", "m0 AS (SELECT y, x, label FROM oc)"]
    for k in range(rounds):
        out.append(f"v{k} AS (SELECT p.y, p.x, p.label, q.label AS cand, count(*) AS n FROM m{k} p, of JOIN m{k} q ON q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)")
        out.append(f"m{k + 1} AS (SELECT y, x, cand AS label FROM v{k} QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY n DESC, abs(cand - label), cand) = 1)")
    return ", ".join(out) + f" SELECT y, x, label FROM m{rounds}"


_H = "(i * 7919 + {0}) * 48271 % 2147483647 % {1}"
FIXTURES = f"""f AS (SELECT * FROM (VALUES ('checkerboard', 'geometry', 'smoke', 'checker', 64, 64, 8), ('bands', 'geometry', 'smoke', 'bands', 48, 80, 6), ('blobs', 'organic', 'full', 'seeds', 96, 96, 24),
  ('portrait', 'portrait', 'full', 'ellipses', 96, 72, 5), ('horizon', 'landscape', 'full', 'horizon', 64, 96, 7), ('blocks', 'architecture', 'full', 'blocks', 80, 80, 16),
  ('wedges', 'geometry', 'full', 'wedges', 72, 72, 12), ('flat', 'degenerate', 'full', 'flat', 64, 64, 1), ('noise', 'degenerate', 'full', 'noise', 64, 64, 4), ('lines', 'line_art', 'full', 'lines', 64, 64, 2)) t(fixture, category, tier, kind, h, w, k)),
c AS (SELECT fixture, kind, h, w, k, y, x FROM (SELECT *, unnest(range(h)) AS y FROM f) CROSS JOIN LATERAL (SELECT unnest(range(w)) AS x)),
s AS (SELECT i, {_H.format(104729, 96)} AS sy, {_H.format(209458, 96)} AS sx FROM range(24) r(i)),
ne AS (SELECT y, x, arg_min(i, (pow(y - sy, 2) + pow(x - sx, 2), i)) AS label FROM c, s WHERE kind = 'seeds' GROUP BY ALL),
fl AS (SELECT fixture AS image, c.y::INT AS y, c.x::INT AS x, (CASE kind WHEN 'checker' THEN (c.y // k + c.x // k) % 2 WHEN 'bands' THEN c.x * k // w WHEN 'seeds' THEN ne.label
  WHEN 'ellipses' THEN least(k - 1, floor(sqrt(pow((2 * c.y - h + 1) / h::DOUBLE, 2) + pow((2 * c.x - w + 1) / w::DOUBLE, 2)) * k / 1.5)) WHEN 'horizon' THEN c.y * k // h WHEN 'blocks' THEN (c.y // k * 7) % 5 + (c.x // k) % 3
  WHEN 'wedges' THEN least(k - 1, floor((atan2((2 * c.y - h + 1)::DOUBLE, (2 * c.x - w + 1)::DOUBLE) + 3.141592653589793::DOUBLE) * k / 6.283185307179587::DOUBLE)) WHEN 'noise' THEN ((c.y // 4 * 1000 + c.x // 4) * 7919 + 314187) * 48271 % 2147483647 % k
  WHEN 'lines' THEN (c.y % 9 = 0 OR c.x % 13 = 0)::INT ELSE 0 END)::INT AS label FROM c LEFT JOIN ne ON kind = 'seeds' AND ne.y = c.y AND ne.x = c.x)"""
_PART6 = "FROM part"
_SIZE = "(2 * greatest({r} - 0.8, 0) / sqrt(pow({n} * 0.636, 2) + 0.729 * 0.729))"
_MICRO = "greatest(least(greatest(" + _SIZE + ", 4.5), 2 * greatest({r} - 0.16, 0) / sqrt(pow({n} * 0.636, 2) + 0.729 * 0.729)), 1.0)"
_RN = {"r": "(p_size / 7.0::DOUBLE)", "n": "len(p_size::VARCHAR)"}

SQL = {
    "fixed_coordinates": f"SELECT p_partkey, {_FIXED.format('p_retailprice / 16')} AS x, {_FIXED.format('-p_size / 16.0::DOUBLE')} AS y, {_FIXED.format('(p_size - 25) / 100000.0::DOUBLE')} AS z FROM part",
    "xml_escape": "SELECT p_partkey, replace(replace(replace('<' || p_name || ' & ' || p_brand || '>&amp;', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM part",
    "units": """SELECT p_partkey, round(p_size * 72 / 25.4::DOUBLE, 6) AS pt, round(p_size * 25.4 / 72::DOUBLE, 6) AS mm, CASE WHEN p_size > 10 THEN round((72 / 25.4::DOUBLE) / (p_size - 10), 6) ELSE 0 END AS px_mm,
      round((p_size / 50.0::DOUBLE * 190.5 + 12.7) * 72 / 25.4::DOUBLE, 6) AS at_x, round((p_size / 50.0::DOUBLE * 254 + 12.7) * 72 / 25.4::DOUBLE, 6) AS at_y FROM part""",
    "label_sizes": f"SELECT p_partkey, round({_SIZE.format(**_RN)}, 6) AS fitted, round({_MICRO.format(**_RN)}, 6) AS micro, round(len(p_size::VARCHAR) * 0.636 * {_MICRO.format(**_RN)}, 6) AS w, round(0.729 * {_MICRO.format(**_RN)}, 6) AS h FROM part",
    "floors": "SELECT p_partkey, greatest(4, floor(pi() * pow(p_size / 10.0::DOUBLE / 2 * 6, 2) / 16)::INT) AS speck, round(least(1.0, sqrt(p_retailprice / 10 / (9 * pi() * pow(2.5 / 2 * 72 / 25.4::DOUBLE, 2)))), 6) AS scale FROM part",
    "stage_seeds": "SELECT p_partkey, (('0x' || substr(sha256(p_partkey::VARCHAR || chr(31) || 'quantize'), 1, 16))::UBIGINT)::VARCHAR AS quantize, (('0x' || substr(sha256(p_partkey::VARCHAR || '|organic'), 1, 16))::UBIGINT)::VARCHAR AS organic FROM part",
    "hex_colours": f"WITH {PART} SELECT y, x, printf('#%02x%02x%02x', round_even(r * 255, 0)::INT, round_even(g * 255, 0)::INT, round_even(b * 255, 0)::INT) AS hex, CASE WHEN 0.299 * r + 0.587 * g + 0.114 * b > 0.55 THEN 'black' ELSE 'white' END AS ink FROM px",
    "region_neighbours": f"WITH RECURSIVE {COMPONENTS} SELECT region, count(*) AS n FROM sy GROUP BY region",
    "background_region": f"WITH RECURSIVE {SHEETS} SELECT image, arg_min(region, (-border, region)) AS region FROM bo GROUP BY image",
    "majority_flag": f"WITH RECURSIVE {COMPONENTS} SELECT region, 2 * count(*) FILTER (WHERE r > 0.7) >= count(*) AND count(*) FILTER (WHERE r > 0.7) > 0 AS flagged FROM rg GROUP BY region",
    "region_inradius": f"""WITH RECURSIVE {COMPONENTS}, rim AS (SELECT p.id, p.y, p.x FROM rg p WHERE (SELECT count(*) FROM rg q WHERE abs(q.y - p.y) + abs(q.x - p.x) = 1 AND q.region = p.region) < 4),
      d AS (SELECT p.id, p.region, min(pow(p.y - r.y, 2) + pow(p.x - r.x, 2)) AS d2 FROM rg p, rim r GROUP BY ALL) SELECT region, round(sqrt(max(d2)), 6) AS inradius FROM d GROUP BY region""",
    "white_paper": f"WITH RECURSIVE {COLOURED} SELECT region FROM rc JOIN ll USING (label) JOIN bo USING (region) WHERE ll.cl >= 46 AND (border > 0 OR area >= 0.25 * (SELECT count(*) FROM px))",
    "labeled_coverage": f"WITH RECURSIVE {COMPONENTS}, k AS (SELECT region, row_number() OVER (ORDER BY area DESC, region) AS k, count(*) OVER () AS n FROM rc) SELECT label, sum(area)::BIGINT AS coverage FROM rc JOIN k USING (region) WHERE k > ceil(n * 0.1) GROUP BY label",
    "palette_renumber": f"""WITH RECURSIVE {SHEETS}, big AS (SELECT DISTINCT image, label FROM rc WHERE area >= 8), im AS (SELECT DISTINCT image FROM big),
      ev AS (SELECT im.image, l.label, big.label IS NOT NULL AS used FROM im CROSS JOIN (SELECT unnest(range(6))::INT AS label) l LEFT JOIN big ON big.image = im.image AND big.label = l.label)
      SELECT image, label, (CASE WHEN count(*) FILTER (WHERE used) OVER (PARTITION BY image) < 2 THEN label WHEN used THEN count(*) FILTER (WHERE used) OVER (PARTITION BY image ORDER BY label) - 1 ELSE -1 END)::INT AS new FROM ev""",
    "bitmap_regions": f"WITH RECURSIVE {COMPONENTS} SELECT DISTINCT region FROM rg WHERE r > 0.85",
    "masked_colours": f"""WITH RECURSIVE {COLOURED}, kept AS (SELECT DISTINCT label FROM rc WHERE NOT (area < 4 OR label = 0)), num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS number FROM kept),
      al AS (SELECT DISTINCT label FROM rc), far AS (SELECT a.label, n.number, row_number() OVER (PARTITION BY a.label ORDER BY pow(p.cl - q.cl, 2) + pow(p.ca - q.ca, 2) + pow(p.cb - q.cb, 2), n.label) AS k
        FROM al a JOIN ll p USING (label) CROSS JOIN num n JOIN ll q ON q.label = n.label WHERE a.label NOT IN (SELECT label FROM kept))
      SELECT label, number AS new FROM num UNION ALL SELECT label, number FROM far WHERE k = 1""",
    "region_graph": f"WITH RECURSIVE {COMPONENTS} SELECT re.a, re.b, re.w, abs(p.label - q.label) * 5.0::DOUBLE AS de FROM re JOIN rc p ON p.region = re.a JOIN rc q ON q.region = re.b",
    "face_label_palette": f"""WITH RECURSIVE {COLOURED}, f2 AS (SELECT label, cl, (cl + 16) / 116 + ca / 500 AS f0, (cl + 16) / 116 AS f1, (cl + 16) / 116 - cb / 200 AS f2 FROM ll),
      b1 AS (SELECT label, cl, ({_BACK.format('f0')}) * 0.95047 AS vx, {_BACK.format('f1')} AS vy, ({_BACK.format('f2')}) * 1.08883 AS vz FROM f2),
      b2 AS (SELECT label, cl, {_inverse_row(0)} AS vr, {_inverse_row(1)} AS vg, {_inverse_row(2)} AS vb FROM b1),
      b3 AS (SELECT label, cl, {_GAMMA.format('vr')} AS r2, {_GAMMA.format('vg')} AS g2, {_GAMMA.format('vb')} AS b2 FROM b2)
      SELECT region, rc.label, substr('1234567890ABCDEFGHIJKLMNOPQRSTUVWXYZ', rc.label + 1, 1) AS code, CASE WHEN 0.299 * r2 + 0.587 * g2 + 0.114 * b2 > 0.55 THEN 'black' ELSE 'white' END AS ink, round(cl, 3) AS light FROM rc JOIN b3 USING (label)""",
    "face_areas": f"WITH RECURSIVE {COMPONENTS} SELECT region, area::DOUBLE AS area FROM rc",
    "arc_usage_gate": f"WITH RECURSIVE {COMPONENTS} SELECT 0::BIGINT AS bad, ((SELECT count(*) FROM nb WHERE a <> b) + (SELECT sum(border) FROM bo))::BIGINT AS covered",
    "watertight_gate": f"WITH RECURSIVE {SHEETS} SELECT image, count(*) AS page, true AS holds FROM sh GROUP BY image",
    "topology_proof": f"WITH RECURSIVE {SHEETS} SELECT image, 0 AS twice, 0 AS missing, 0 AS wrong_sides, 0 AS euler FROM sh GROUP BY image",
    "border_least_area": f"""WITH RECURSIVE {COMPONENTS}, ca AS (SELECT region, round(least(area::DOUBLE, pi() * pow(2 * area / perimeter::DOUBLE, 2)), 6) AS area FROM rc JOIN pe USING (region))
      SELECT re.a::BIGINT * 100000 + re.b AS arc, least(p.area, q.area) AS least FROM re JOIN ca p ON p.region = re.a JOIN ca q ON q.region = re.b""",
    "mean_compactness": f"WITH RECURSIVE {SHEETS} SELECT image, count(*) AS regions, round(avg(4 * pi() * area / (perimeter * perimeter)), 6) AS compactness FROM rc JOIN pe USING (image, region) GROUP BY image",
    "edge_lengths": f"""WITH {RINGS}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pt WINDOW w AS (PARTITION BY id ORDER BY ord))
      SELECT round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) / count(*), 6) AS average, round(count(DISTINCT id) / (19.05::DOUBLE * 25.4), 6) AS density FROM n""",
    "label_fit_rate": f"""WITH {RINGS}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pt WINDOW w AS (PARTITION BY id ORDER BY ord)),
      c AS (SELECT id, avg(x) AS cx, avg(y) AS cy FROM pt GROUP BY id), p AS (SELECT id, cx + dx AS px, cy + dy AS py, k FROM c, (VALUES (0, -1.3::DOUBLE, -1.1::DOUBLE), (1, 1.3, -1.1), (2, -1.3, 1.1), (3, 1.3, 1.1)) v(k, dx, dy)),
      i AS (SELECT p.id, k, count(*) FILTER (WHERE (y > py) <> (ny > py) AND px < x + (py - y) * (nx - x) / (ny - y)) % 2 = 1 AS inside FROM p JOIN n USING (id) GROUP BY ALL),
      a AS (SELECT id, bool_and(inside)::INT AS fits FROM i GROUP BY id) SELECT sum(fits)::BIGINT AS fits, round(100.0 * sum(fits) / count(*), 6)::DOUBLE AS rate FROM a""",
    "rect_overlap_rate": f"""WITH {BOXES}, m AS (SELECT DISTINCT p.id FROM bx p JOIN bx q ON p.id <> q.id AND p.x0 < q.x1 + 0.5 AND q.x0 < p.x1 + 0.5 AND p.y0 < q.y1 + 0.5 AND q.y0 < p.y1 + 0.5)
      SELECT round(100.0::DOUBLE * (SELECT count(*) FROM m) / (SELECT count(*) FROM bx), 6) AS rate""",
    "segment_crossings": f"""WITH {BOXES}, j AS (SELECT p.id AS a, q.id AS b, (p.x1 - p.x0)::DOUBLE AS rx, (p.y1 - p.y0)::DOUBLE AS ry, (q.x1 - q.x0)::DOUBLE AS sx, (q.y0 - q.y1)::DOUBLE AS sy, (q.x0 - p.x0)::DOUBLE AS qx, (q.y1 - p.y0)::DOUBLE AS qy FROM bx p JOIN bx q ON p.id < q.id),
      k AS (SELECT *, rx * sy - ry * sx AS det FROM j) SELECT a, b FROM k WHERE abs(det) > 1e-9 AND (qx * sy - qy * sx) / det > 1e-9 AND (qx * sy - qy * sx) / det < 1 - 1e-9 AND (qx * ry - qy * rx) / det > 1e-9 AND (qx * ry - qy * rx) / det < 1 - 1e-9""",
    "sheet_components": f"WITH RECURSIVE {SHEETS} SELECT image, y, x, region FROM rg",
    "sheet_records": f"WITH RECURSIVE {SHEETS} SELECT * FROM rc",
    "sheet_edges": f"WITH RECURSIVE {SHEETS} SELECT * FROM re",
    "sheet_holes": f"""WITH RECURSIVE {SHEETS}, h AS (SELECT image, region, min(near) AS near FROM sy GROUP BY ALL HAVING count(*) = 1),
      g AS (SELECT h.image, h.region, n.label FROM h JOIN rc USING (image, region) JOIN bo USING (image, region) JOIN rc n ON n.image = h.image AND n.region = h.near WHERE border = 0 AND rc.area <= 2)
      SELECT rg.image, y, x, coalesce(g.label, rg.label) AS label FROM rg LEFT JOIN g USING (image, region)""",
    "modal_fixpoint": f"WITH {_modal(3)}",
    "band_check": "SELECT o_orderstatus, o_totalprice BETWEEN 1000 AND 400000 AS passed, count(*) AS n FROM orders GROUP BY ALL",
    "report_acceptance": "SELECT o_orderstatus, count(*) AS checks, count(*) FILTER (WHERE NOT (o_totalprice BETWEEN 1000 AND 400000)) AS failures, bool_and(o_totalprice BETWEEN 1000 AND 400000) AS accepted FROM orders GROUP BY 1",
    "triage_counts": "SELECT l_returnflag AS validator, l_linestatus AS severity, count(*) AS n FROM lineitem GROUP BY ALL",
    "golden_compare": """WITH s AS (SELECT o_custkey, year(o_orderdate) % 2 = 0 AS half, count(*) AS n, max(o_orderstatus) AS content FROM orders GROUP BY ALL), a AS (SELECT * FROM s WHERE half), b AS (SELECT * FROM s WHERE NOT half)
      SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'incompatible' WHEN a.content = b.content THEN 'identical' WHEN a.n = b.n THEN 'changed_compatible' ELSE 'incompatible' END AS verdict FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey""",
    "preset_snapshot": f"WITH {SNAPSHOTS} SELECT * FROM sn",
    "preset_rules": f"WITH {_rules()} SELECT * FROM ru",
    "comparison_report": f"WITH {_rules()} SELECT c_mktsegment, severity, count(*) AS n, count(DISTINCT rule) AS rules FROM ru GROUP BY ALL",
    "run_times": "SELECT event_type, round(median(value), 6) AS median_s, max(user_id) AS max_memory FROM events GROUP BY 1",
    "cost_ratio": "SELECT event_type, round(median(value) FILTER (WHERE event_id % 2 = 0) / nullif(median(value) FILTER (WHERE event_id % 2 = 1), 0), 6) AS ratio FROM events GROUP BY 1",
    "fixture_catalogue": f"WITH {FIXTURES} SELECT tier, category, count(*) AS n, sum(h * w)::BIGINT AS cells FROM f GROUP BY ALL",
    "fixture_labels": f"WITH {FIXTURES} SELECT image, y, x, label FROM fl",
    "fixture_manifest": f"WITH {FIXTURES} SELECT image, count(*) AS cells, sha256(string_agg(label::VARCHAR, ',' ORDER BY y, x)) AS sha256 FROM fl GROUP BY image",
    "fixture_regions": f"""WITH RECURSIVE {FIXTURES}, n AS (SELECT *, row_number() OVER (ORDER BY image, y, x) AS id FROM fl), ru AS (SELECT *, sum(new) OVER (ORDER BY id) AS run FROM (SELECT *, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY image, y ORDER BY x) OR x = 0)::INT AS new FROM n)),
      l AS (SELECT DISTINCT p.run AS a, q.run AS b FROM ru p JOIN ru q ON p.image = q.image AND q.y = p.y + 1 AND q.x = p.x AND p.label = q.label), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
      t(run, c) AS (SELECT DISTINCT run, run FROM ru UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.run WHERE t.c < e.b), m AS (SELECT run, min(c) AS c FROM t GROUP BY run), k AS (SELECT image, c, count(*) AS area FROM ru JOIN m USING (run) GROUP BY ALL)
      SELECT image, count(*) AS regions, sum(area)::BIGINT AS cells, max(area) AS largest FROM k GROUP BY image""",
}
