"""DuckDB SQL for the queries of the library."""

from __future__ import annotations

from terracell.plans.fixtures import GRID_A, GRID_B, GRID_SMALL, PERIODS

EPS = "2.220446049250313e-16::DOUBLE"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ITEMS = f"items AS (SELECT {KEYS}, l_quantity, l_extendedprice, l_discount, (l_partkey % 97) * 0.5::DOUBLE AS x, (l_suppkey % 53) * 0.25::DOUBLE AS y FROM lineitem)"
RP = f"([{', '.join(f'{p}::DOUBLE' for p in PERIODS)}])[(l_linenumber % 7 + 1)::INT]"
EXPOSURE = f"""e AS (SELECT l_partkey % 500 AS edge, l_suppkey % 5 AS region, l_returnflag AS hazard, l_linestatus AS scenario, {RP} AS rp,
  1 / {RP} AS probability, l_quantity / 16 AS depth, (l_partkey % 64 + 1)::DOUBLE AS length, l_quantity AS damage FROM lineitem)"""


def _inverse(grid, x: str, y: str) -> tuple[str, str]:
    a = grid.affine.inverse()
    return f"({a.a}::DOUBLE * ({x}) + {a.b}::DOUBLE * ({y}) + {a.c}::DOUBLE)", f"({a.d}::DOUBLE * ({x}) + {a.e}::DOUBLE * ({y}) + {a.f}::DOUBLE)"


def _cells(grid) -> str:
    u, v = _inverse(grid, f"x + {EPS}", f"y + {EPS}")
    inside = f"floor({u}) >= 0 AND floor({u}) < {grid.width} AND floor({v}) >= 0 AND floor({v}) < {grid.height}"
    return f"{ITEMS}, cells AS (SELECT *, CASE WHEN {inside} THEN floor({u})::BIGINT ELSE -1 END AS index_i, CASE WHEN {inside} THEN floor({v})::BIGINT ELSE -1 END AS index_j FROM items)"


def _raster(grid, name: str = "raster", turn: int = 0) -> str:
    return f"""{name} AS (SELECT id % {grid.width} AS i, id // {grid.width} AS j, (((id % {grid.width}) * 7 + (id // {grid.width}) * 13 + {turn}) % 321)::DOUBLE AS value
  FROM range({grid.width * grid.height}) t(id) WHERE id % 7 <> 3)"""


#: Orders with two points at least, as segments p to q, numbered; and their line.
LINES = f"""{ITEMS}, pts AS (SELECT l_orderkey, x, y, row_number() OVER w AS rn, lead(x) OVER w AS x1, lead(y) OVER w AS y1, count(*) OVER (PARTITION BY l_orderkey) AS n FROM items
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, x, y)),
seg AS (SELECT l_orderkey, rn - 1 AS s, rn = n - 1 AS last, x AS x0, y AS y0, x1, y1 FROM pts WHERE n >= 2 AND x1 IS NOT NULL)"""


def _cuts(grid, bounded: bool = False) -> str:
    """Adds ``c`` (segments in cell coordinates) and ``ts`` (distinct crossings of each segment)."""
    (u0, v0), (u1, v1) = _inverse(grid, "x0", "y0"), _inverse(grid, "x1", "y1")
    (ui, vi), (uj, vj) = _inverse(grid, f"x0 + {EPS}", f"y0 + {EPS}"), _inverse(grid, f"x1 + {EPS}", f"y1 + {EPS}")
    keep = f"AND u0 + t * (u1 - u0) BETWEEN -1e-9 AND {grid.width + 1e-9} AND v0 + t * (v1 - v0) BETWEEN -1e-9 AND {grid.height + 1e-9}" if bounded else ""
    family = lambda w: f"SELECT *, unnest(CASE WHEN {w}0 <> {w}1 THEN generate_series(ceil(least({w}0, {w}1))::BIGINT, floor(greatest({w}0, {w}1))::BIGINT) ELSE [] END) AS k, '{w}' AS f FROM c WHERE NOT same"
    return f"""{LINES}, c AS (SELECT *, {u0} AS u0, {v0} AS v0, {u1} AS u1, {v1} AS v1, floor({ui}) = floor({uj}) AND floor({vi}) = floor({vj}) AS same FROM seg),
levels AS ({family("u")} UNION ALL {family("v")}),
t AS (SELECT *, CASE WHEN f = 'u' THEN (k - u0) / (u1 - u0) ELSE (k - v0) / (v1 - v0) END AS t FROM levels),
ts AS (SELECT l_orderkey, s, last, round(t, 10) AS r, min(t) AS t FROM t WHERE t > 0 AND t <= 1 {keep} GROUP BY ALL)"""


def _pieces(grid, bounded: bool, more: str = "") -> str:
    return f"""WITH {_cuts(grid, bounded)}, n AS (SELECT l_orderkey, count(*) AS n FROM ts WHERE NOT (last AND r >= 1) GROUP BY l_orderkey),
len AS (SELECT l_orderkey, sum(hypot_(x1 - x0, y1 - y0)) AS length FROM seg GROUP BY l_orderkey)
SELECT len.l_orderkey, coalesce(n, 0) + 1 AS n_pieces, round(length, 6) AS length{more} FROM len LEFT JOIN n ON len.l_orderkey = n.l_orderkey""".replace("hypot_(x1 - x0, y1 - y0)", "sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)")


def _curve(points, x: str) -> str:
    low, high = min(d for _, d in points), max(d for _, d in points)
    out = f"CASE WHEN isnan({x}) THEN {x} WHEN {x} < {points[0][0]} THEN {low} WHEN {x} > {points[-1][0]} THEN {high}"
    for (a, p), (b, q) in zip(points, points[1:]):
        out += f" WHEN {x} <= {b} THEN {p}::DOUBLE + ({x} - {a}) / ({b} - {a})::DOUBLE * ({q}::DOUBLE - {p}::DOUBLE)"
    return out + " END"


def _ead(source: str, value: str = "damage", threshold: float | None = None, out: str = "ead") -> str:
    """CTE body of the trapezoid over probability for each edge and hazard of ``source``."""
    cut = f"WHERE probability < {threshold}" if threshold else ""
    return f"""SELECT g.edge, g.hazard, coalesce(a.v, 0.0) AS {out} FROM (SELECT DISTINCT edge, hazard FROM {source}) g LEFT JOIN (
  SELECT edge, hazard, CASE WHEN count(*) = 1 THEN max(0.5 * probability * {value}) ELSE sum((probability - pp) * ({value} + dd) / 2) END AS v FROM (
    SELECT *, lag(probability) OVER w AS pp, lag({value}) OVER w AS dd FROM {source} {cut} WINDOW w AS (PARTITION BY edge, hazard ORDER BY probability)) GROUP BY edge, hazard
) a ON g.edge = a.edge AND g.hazard = a.hazard"""


BOXES = "boxes AS (SELECT s_suppkey, s_suppkey % 40 + 0.5::DOUBLE AS xmin, s_suppkey % 9 + 0.25::DOUBLE AS ymin, s_suppkey % 40 + 0.5::DOUBLE + 1 + s_suppkey % 5 AS xmax, s_suppkey % 9 + 0.25::DOUBLE + 0.5::DOUBLE + s_suppkey % 4 AS ymax FROM supplier)"
REGIONS = "regions AS (SELECT n_nationkey, (n_nationkey % 5) * 10.0::DOUBLE AS xmin, (n_nationkey // 5) * 3.0::DOUBLE AS ymin, (n_nationkey % 5) * 10.0::DOUBLE + 8 AS xmax, (n_nationkey // 5) * 3.0::DOUBLE + 2.5::DOUBLE AS ymax FROM nation)"
NODES = "nodes AS (SELECT c_custkey, ((c_custkey * 7) % 97) * 0.5::DOUBLE AS x, ((c_custkey * 5) % 53) * 0.25::DOUBLE AS y FROM customer)"
ASKED = "asked AS (SELECT p_partkey, (p_partkey % 89) * 0.5::DOUBLE AS x, (p_partkey % 47) * 0.25::DOUBLE AS y FROM part)"
NEAREST = f"{NODES}, {ASKED}, near AS (SELECT p_partkey, arg_min(c_custkey, (d, c_custkey)) AS c_custkey, min(d) AS distance FROM (SELECT p_partkey, c_custkey, sqrt((a.x - n.x) ** 2 + (a.y - n.y) ** 2) AS d FROM asked a, nodes n) GROUP BY p_partkey)"
ARCS = """edges AS (SELECT n_nationkey AS edge_id, n_nationkey AS u, (n_nationkey + 1) % 25 AS v, (1 + (n_nationkey * 7) % 5)::DOUBLE AS w FROM nation
  UNION ALL SELECT n_nationkey + 100, n_nationkey, (n_nationkey + 5) % 25, (2 + (n_nationkey * 3) % 7)::DOUBLE FROM nation WHERE n_nationkey % 3 = 0)"""


def _relax(sources: str, rounds: int, edges: str = "edges") -> str:
    """One CTE a round: ``r{rounds}`` has ``source, node, cost``."""
    out = f"arcs AS (SELECT u, v, w FROM {edges} UNION ALL SELECT v, u, w FROM {edges}), r0 AS (SELECT source, source AS node, 0.0::DOUBLE AS cost FROM ({sources}))"
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM r{k} UNION ALL SELECT source, v, cost + w FROM r{k} JOIN arcs ON node = u) GROUP BY ALL)"
    return out


def _simpson() -> str:
    from terracell.operators.risk import simpson_weights

    order = sorted(PERIODS, reverse=True)
    return " + ".join(f"({w!r}::DOUBLE) * coalesce(sum(damage) FILTER (rp = {p}), 0)" for p, w in zip(order, simpson_weights([1 / p for p in order])))


PRESENT = """options(kind, i, r, p) AS (VALUES ('four_lane', 1000000.0::DOUBLE, 2000.0::DOUBLE, 51000.0::DOUBLE), ('two_lane', 500000.0, 1000.0, 33000.0), ('unpaved', 20000.0, 800.0, 9000.0)),
years AS (SELECT y, 1.0::DOUBLE / pow(1.03::DOUBLE, y) AS f FROM range(61) t(y)),
present AS (SELECT kind, sum(CASE WHEN y = 0 THEN i ELSE 0 END) AS initial_cost_usd_per_km, sum(f * r) AS routine_usd_per_km, sum(CASE WHEN y > 0 AND y % 5 = 0 THEN f * p ELSE 0 END) AS periodic_usd_per_km FROM options, years GROUP BY kind)"""
ROADS = "CASE WHEN depth <= 0.5 THEN 40 * depth WHEN depth <= 1 THEN 30 * depth + 5 ELSE 10 * depth + 25 END"
UP, DOWN = ((0, 0), (40, 0.1), (80, 0.2), (120, 1)), ((10, 0.9), (20, 0.5), (40, 0.25))

ORACLE_SQL = {
    "cell_index_points": f"WITH {_cells(GRID_B)} SELECT {KEYS}, index_i, index_j FROM cells",
    "cell_boxes": f"""SELECT i * {GRID_B.height} + j AS cell, i, j, 2.0::DOUBLE * i AS xmin, 14.0::DOUBLE - 2 * (j + 1) AS ymin, 2.0::DOUBLE * (i + 1) AS xmax, 14.0::DOUBLE - 2 * j AS ymax
FROM range({GRID_B.width}) a(i), range({GRID_B.height}) b(j)""",
    "cell_numbers": f"""WITH {_cells(GRID_A)} SELECT index_i + index_j * {GRID_A.width} AS cell, index_j AS "row", index_i AS "column", count(*) AS n, sum(x - 4 * index_i) AS off_x, sum(y - 4 * index_j) AS off_y FROM cells WHERE index_i >= 0 GROUP BY ALL""",
    "raster_lookup": f"WITH {_cells(GRID_A)}, {_raster(GRID_A)} SELECT {KEYS}, value FROM cells LEFT JOIN raster ON index_i = i AND index_j = j",
    "raster_lookup_multi": f"""WITH {_cells(GRID_A)}, {_raster(GRID_A)}, {_raster(GRID_A, "raster2", 100)} SELECT {KEYS}, a.value AS river, b.value AS coast FROM cells
LEFT JOIN raster a ON index_i = a.i AND index_j = a.j LEFT JOIN raster2 b ON index_i = b.i AND index_j = b.j""",
    "cell_damage": f"""WITH {_cells(GRID_A)}, {_raster(GRID_A)} SELECT index_i AS i, index_j AS j, round(coalesce(sum(({_curve(UP, "value")}) * l_quantity), 0), 4) AS loss
FROM cells LEFT JOIN raster ON index_i = i AND index_j = j WHERE index_i >= 0 GROUP BY ALL""",
    "grid_dense_sum": f"""WITH {_cells(GRID_B)}, s AS (SELECT index_i AS i, index_j AS j, sum(l_quantity) AS v FROM cells WHERE index_i >= 0 GROUP BY ALL)
SELECT b.j, a.i, coalesce(v, -99.0::DOUBLE) AS value FROM range({GRID_B.width}) a(i) CROSS JOIN range({GRID_B.height}) b(j) LEFT JOIN s ON s.i = a.i AND s.j = b.j""",
    "grid_int_sum": f"""WITH {_cells(GRID_A)}, s AS (SELECT index_i AS i, index_j AS j, sum(l_discount) AS v FROM cells WHERE index_i >= 0 GROUP BY ALL)
SELECT b.j, a.i, cast(trunc(coalesce(v, 0)) AS INT) AS value FROM range({GRID_A.width}) a(i) CROSS JOIN range({GRID_A.height}) b(j) LEFT JOIN s ON s.i = a.i AND s.j = b.j""",
    "pixel_points": f"WITH {_raster(GRID_B)} SELECT row_number() OVER (ORDER BY j, i) - 1 AS id, 2 * (i + 0.5::DOUBLE) AS x, 14 - 2 * (j + 0.5::DOUBLE) AS y, value FROM raster WHERE value > 20",
    "split_line_pieces": _pieces(GRID_A, False, ", coalesce(n, 0)::INT AS last"),
    "split_line_bounded": _pieces(GRID_SMALL, True),
    "split_line_cells": f"""WITH {_cuts(GRID_B)}, bounds AS (SELECT l_orderkey, s, t FROM ts WHERE r < 1 UNION ALL SELECT l_orderkey, s, unnest([0.0::DOUBLE, 1.0]) FROM seg),
runs AS (SELECT l_orderkey, s, t, lead(t) OVER (PARTITION BY l_orderkey, s ORDER BY t) AS t1 FROM bounds),
mid AS (SELECT x0 + (t + r.t1) / 2 * (x1 - x0) + {EPS} AS x, y0 + (t + r.t1) / 2 * (y1 - y0) + {EPS} AS y, (r.t1 - t) * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM runs r JOIN seg USING (l_orderkey, s) WHERE r.t1 IS NOT NULL)
SELECT floor({_inverse(GRID_B, "x", "y")[0]})::BIGINT AS i, floor({_inverse(GRID_B, "x", "y")[1]})::BIGINT AS j, count(*) AS n, round(sum(len), 4) AS length FROM mid WHERE len > 0 GROUP BY 1, 2""",
    "polygon_cell_area": f"""WITH {BOXES}, p AS (SELECT s_suppkey, i, j, (least(xmax, 4.0 * (i + 1)) - greatest(xmin, 4.0 * i)) AS w, (least(ymax, 4.0 * (j + 1)) - greatest(ymin, 4.0 * j)) AS h
FROM boxes, range({GRID_A.width}) a(i), range({GRID_A.height}) b(j)) SELECT s_suppkey, i, j, round(w * h, 6) AS area FROM p WHERE w > 0 AND h > 0""",
    "curve_single": f"""WITH t AS (SELECT {KEYS}, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE ELSE l_quantity * 4 - 20 END AS x FROM lineitem)
SELECT {KEYS}, l_extendedprice, round({_curve(UP, "x")}, 6) AS up, round({_curve(DOWN, "x")}, 6) AS down FROM t""",
    "curve_catalogue": f"""WITH p AS (SELECT 'C' || k AS curve_id, (5 * n + k)::DOUBLE AS x0, round(least(1.0::DOUBLE, 0.07::DOUBLE * n * (k + 1)), 4) AS d0 FROM range(4) a(k), range(9) b(n)),
s AS (SELECT *, lead(x0) OVER w AS x1, lead(d0) OVER w AS d1 FROM p WINDOW w AS (PARTITION BY curve_id ORDER BY x0)), m AS (SELECT curve_id, min(x0) AS low, max(x0) AS high, min(d0) AS least, max(d0) AS most FROM p GROUP BY 1),
t AS (SELECT {KEYS}, l_extendedprice, l_quantity AS x, 'C' || (l_partkey % 5) AS curve_id FROM lineitem)
SELECT {KEYS}, l_extendedprice, t.curve_id, round(CASE WHEN m.curve_id IS NULL THEN NULL WHEN x < low THEN least WHEN x >= high THEN most ELSE d0 + (x - x0) / (x1 - x0) * (d1 - d0) END, 6) AS damage
FROM t LEFT JOIN m ON t.curve_id = m.curve_id LEFT JOIN s ON t.curve_id = s.curve_id AND x0 <= x AND x < x1""",
    "curve_transform_clip": """SELECT * FROM (VALUES ('up', 0.0::DOUBLE, 0.1::DOUBLE), ('up', 40, 0.2), ('up', 80, 0.3), ('up', 115, 1), ('up', 120, 1),
('down', 0, 0), ('down', 40, 0), ('down', 80, 0.1), ('down', 120, 0.9), ('twice', 0, 0), ('twice', 40, 0.2), ('twice', 80, 0.4), ('twice', 95, 1), ('twice', 120, 1),
('wide', 0, 0), ('wide', 80, 0.1), ('wide', 160, 0.2), ('wide', 240, 1), ('moved', -5, 0), ('moved', 35, 0.1), ('moved', 75, 0.2), ('moved', 115, 1)) t(name, intensity, damage)""",
    "curve_interpolate": f"""WITH t AS (SELECT l_quantity / 4 AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT x, n, round({_curve(((0, 0), (5, 0.3), (10, 0.9)), "x")}, 6) AS damage FROM t""",
    "road_damage_v1": f"WITH {EXPOSURE}, t AS (SELECT depth, count(*) AS n FROM e GROUP BY 1) SELECT depth, n, round(least(100, 1.5 * ({ROADS})), 6) AS percent FROM t",
    "road_damage_v2": f"""WITH {EXPOSURE}, t AS (SELECT depth, (['paved', 'unpaved', 'track'])[(region % 3 + 1)::INT] AS surface, count(*) AS n FROM e GROUP BY ALL)
SELECT depth, surface, n, round(CASE WHEN surface = 'track' THEN NULL ELSE least(100, 1.2 * CASE surface
  WHEN 'paved' THEN CASE WHEN depth <= 0.1 THEN 0 WHEN depth <= 0.25 THEN 100.0 / 15 * (depth - 0.1) WHEN depth <= 0.5 THEN 4 * depth WHEN depth <= 0.75 THEN 12 * depth - 4 ELSE 20 * depth - 10 END
  ELSE CASE WHEN depth <= 0.1 THEN 10 * depth WHEN depth <= 0.25 THEN 10.0::DOUBLE / 15 * (100 * depth + 5) WHEN depth <= 0.5 THEN 120 * depth - 10 WHEN depth <= 1 THEN 80 * depth + 10 ELSE 20 * depth + 70 END END) END, 6) AS percent FROM t""",
    "damage_cost": f"""WITH {EXPOSURE} SELECT region, CASE WHEN region < 2 THEN 1 ELSE 2 END AS condition_cost,
round(sum(0.01::DOUBLE * least(100, {ROADS}) * 7.5 * length * (CASE WHEN region < 3 THEN 1e3 ELSE 1e6 END * length / 7.5) / 1e6), 2) AS cost FROM e GROUP BY ALL""",
    "cost_by_terrain": f"""WITH {EXPOSURE}, t AS (SELECT (['Expressway', 'National roads', 'Provincial roads', 'Boulevard', 'Other roads', 'Bridge', 'Path'])[(edge % 7 + 1)::INT] AS asset_type, (edge % 8)::INT AS road_class,
  CASE WHEN region % 2 = 0 THEN ' Flat ' ELSE 'mountain' END AS terrain, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT *, CASE WHEN asset_type = 'Expressway' OR road_class = 1 THEN 0 WHEN asset_type = 'National roads' OR road_class = 2 THEN 1 WHEN road_class = 3 THEN 2 WHEN asset_type = 'Provincial roads' OR road_class = 4 THEN 3
  WHEN asset_type = 'Boulevard' OR road_class = 5 THEN 4 WHEN asset_type = 'Other roads' OR road_class = 6 THEN 5 END AS row, CASE WHEN terrain = 'mountain' OR asset_type = 'Bridge' THEN 5 ELSE 0 END AS more FROM t)
SELECT asset_type, road_class, terrain, n, round(CASE WHEN row IS NOT NULL THEN 1.25::DOUBLE * (10 * (row + 1) + more) / (20 - 2 * row) WHEN asset_type = 'Bridge' THEN 1.25::DOUBLE * 65 / 20 ELSE 1.25::DOUBLE * 10 / 10 END, 6) AS cost_per_area FROM k""",
    "ead_trapezoid": f"WITH {EXPOSURE}, p AS (SELECT edge, hazard, probability, sum(damage) AS damage FROM e GROUP BY ALL), a AS ({_ead('p')}) SELECT edge, hazard, round(ead, 6) AS ead FROM a",
    "ead_trapezoid_threshold": f"WITH {EXPOSURE}, p AS (SELECT edge, hazard, probability, sum(damage) AS damage FROM e GROUP BY ALL), a AS ({_ead('p', threshold=0.05)}) SELECT edge, hazard, round(ead, 6) AS ead FROM a",
    "ead_simpson_pivot": f"WITH {EXPOSURE} SELECT edge, scenario, round({_simpson()}, 6) AS ead FROM e GROUP BY ALL",
    "ead_pipeline": f"""WITH {EXPOSURE}, p AS (SELECT edge, hazard, probability, sum(damage * 0.5) AS low, sum(damage) AS high, max(length) AS length FROM e GROUP BY ALL),
a AS ({_ead("p", "low", out="ead_low")}), b AS ({_ead("p", "high", out="ead_high")}), z AS (SELECT edge, max(length) AS length FROM p GROUP BY 1)
SELECT a.edge, a.hazard, round(ead_low, 6) AS ead_low, round(ead_high, 6) AS ead_high, round(ead_high / length, 6) AS ead_per_length FROM a JOIN b ON a.edge = b.edge AND a.hazard = b.hazard JOIN z ON a.edge = z.edge""",
    "exposure_minmax_scenario": f"WITH {EXPOSURE} SELECT edge, hazard, scenario, min(depth) AS min_depth, max(length) AS max_length, sum(damage) AS sum_damage FROM e GROUP BY ALL",
    "exposure_two_level": f"WITH {EXPOSURE}, s AS (SELECT edge, rp, sum(length) AS v FROM e GROUP BY ALL) SELECT edge, max(v) AS exposed_length FROM s GROUP BY 1",
    "exposure_by_region": f"WITH {EXPOSURE} SELECT region, hazard, sum(length) AS sum_length, round(avg(length), 6) AS mean_length, count(*) AS n FROM e GROUP BY ROLLUP (region, hazard)",
    "exposure_sum_by_others": f"WITH {EXPOSURE} SELECT edge, hazard, rp, sum(length) AS length FROM e GROUP BY ALL",
    "exposure_describe": f"""WITH {EXPOSURE} SELECT count(depth) AS n, round(avg(depth), 6) AS mean, round(stddev_samp(depth), 6) AS std, round(min(depth), 6) AS "min", round(quantile_cont(depth, 0.25), 6) AS q25, round(quantile_cont(depth, 0.5), 6) AS q50, round(quantile_cont(depth, 0.75), 6) AS q75, round(max(depth), 6) AS "max" FROM e""",
    "exposure_cdf": f"WITH {EXPOSURE} SELECT DISTINCT hazard, depth, round(cume_dist() OVER (PARTITION BY hazard ORDER BY depth), 9) AS cdf FROM e",
    "exposure_trend": f"WITH {EXPOSURE} SELECT hazard, round(regr_slope(length, depth), 6) AS slope, round(regr_intercept(length, depth), 6) AS intercept, count(*) AS n FROM e GROUP BY 1",
    "exposure_ratio": f"WITH {EXPOSURE} SELECT sum(length) AS total, sum(CASE WHEN depth >= 1.5 THEN length ELSE 0 END) AS deep, round(sum(CASE WHEN depth >= 1.5 THEN length ELSE 0 END) / sum(length) * 100, 6) AS percent FROM e",
    "melt_hazards": f"""WITH t AS (SELECT {KEYS}, l_extendedprice, CASE WHEN l_quantity > 30 THEN l_quantity - 30 END AS river, CASE WHEN l_quantity % 2 = 0 THEN l_quantity / 4 END AS coast, l_quantity - 25 AS surge FROM lineitem)
SELECT * FROM (UNPIVOT t ON river, coast, surge INTO NAME key VALUE depth_m) WHERE depth_m > 0""",
    "pivot_return_period": f"WITH {EXPOSURE} SELECT region, hazard, {', '.join(f'coalesce(sum(damage) FILTER (rp = {p}), 0.0::DOUBLE) AS rp{p:g}' for p in PERIODS)} FROM e GROUP BY ALL",
    "scenario_key_parse": r"""WITH k AS (SELECT CASE WHEN l_linenumber = 3 THEN 'other' ELSE 'floodmaps-v2-inun' || CASE WHEN l_linenumber % 2 = 0 THEN 'river' ELSE 'coast' END || '_rcp' || (l_linenumber % 3) || 'p5_wtsub_2050_rp'
  || lpad((l_suppkey % 9 * 100 + 2)::VARCHAR, 4, '0') || CASE WHEN l_linenumber > 5 THEN '_5-all' ELSE '-all' END END AS key FROM lineitem), g AS (SELECT key, count(*) AS n FROM k GROUP BY 1),
m AS (SELECT *, 'floodmaps-v2-(\w+)_([^_]+)_([^_]+)_([^_]+)_rp([^-]+)-all' AS p FROM g)
SELECT key, n, nullif(regexp_extract(key, p, 1), '') AS hazard, nullif(regexp_extract(key, p, 2), '') AS rcp, nullif(regexp_extract(key, p, 3), '') AS sub, nullif(regexp_extract(key, p, 4), '') AS epoch,
  try_cast(ltrim(replace(nullif(regexp_extract(key, p, 5), ''), '_', '.'), '0') AS DOUBLE) AS rp FROM m""".replace("regexp_extract(key, p,", r"regexp_extract(key, 'floodmaps-v2-(\w+)_([^_]+)_([^_]+)_([^_]+)_rp([^-]+)-all',"),
    "layer_key_format": f"WITH {EXPOSURE} SELECT DISTINCT hazard, scenario, region, 'hazard:' || hazard || '|region:' || region || '|scenario:' || scenario AS key, 'p' AS bare FROM e",
    "label_parse": "SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' (m/s) ' ELSE ' ' END AS label, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'm/s' END AS unit FROM nation",
    "npv_costs": f"""WITH {PRESENT} SELECT kind, round(initial_cost_usd_per_km, 4) AS initial_cost_usd_per_km, round(routine_usd_per_km, 4) AS routine_usd_per_km, round(periodic_usd_per_km, 4) AS periodic_usd_per_km,
round(initial_cost_usd_per_km + routine_usd_per_km + periodic_usd_per_km, 4) AS total_cost_usd_per_km FROM present""",
    "benefit_cost": f"""WITH {PRESENT}, {EXPOSURE}, r AS (SELECT edge, (['four_lane', 'two_lane', 'unpaved'])[(edge % 3 + 1)::INT] AS kind, sum(length) AS l, sum(damage) AS d FROM e GROUP BY ALL),
c AS (SELECT edge, r.kind, (initial_cost_usd_per_km + routine_usd_per_km + periodic_usd_per_km) / 1e3 * l AS cost, d * (SELECT sum(f) FROM years) AS benefit FROM r JOIN present p ON r.kind = p.kind)
SELECT edge, kind, round(cost, 3) AS cost, round(benefit, 3) AS benefit, round(benefit / cost, 5) AS bcr FROM c""",
    "semi_exposed": f"WITH {EXPOSURE} SELECT p_partkey, p_partkey % 500 AS edge FROM part WHERE p_partkey % 500 IN (SELECT edge FROM e WHERE depth > 3)",
    "anti_unmatched": "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "left_multi_key": f"""WITH {EXPOSURE}, a AS (SELECT edge, hazard, sum(length) AS length FROM e GROUP BY ALL), b AS (SELECT edge, hazard, sum(damage) AS damage FROM e WHERE rp = 2 GROUP BY ALL)
SELECT a.edge, a.hazard, length, coalesce(damage, 0) AS damage FROM a LEFT JOIN b ON a.edge = b.edge AND a.hazard = b.hazard""",
    "hazard_file_attributes": """WITH f AS (SELECT n_nationkey, n_nationkey % 3 * 10 + 10 AS rp, n_nationkey % 4 AS low FROM nation)
SELECT 'flood_1in' || rp || '_' || low || '-' || (low + 1) || '_x' AS file_name, n_nationkey, low::INT AS min_hazard, (low + 1)::INT AS max_hazard, CASE WHEN rp < 30 THEN 'fluvial' END AS hazard_type, CASE rp WHEN 10 THEN 0.1::DOUBLE WHEN 20 THEN 0.05 END AS probability FROM f""",
    "within_region": f"WITH {ITEMS}, {REGIONS} SELECT n_nationkey, count(*) AS n FROM items JOIN regions ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY 1",
    "exposed_points": f"WITH {ITEMS}, {BOXES} SELECT DISTINCT x, y FROM items WHERE EXISTS (SELECT 1 FROM boxes WHERE x >= xmin AND x < xmax AND y >= ymin AND y < ymax)",
    "nearest_node": f"WITH {NEAREST} SELECT p_partkey, c_custkey, round(distance, 6) AS distance FROM near",
    "contain_else_nearest": f"""WITH {NEAREST}, {REGIONS}, hit AS (SELECT p_partkey, min(n_nationkey) AS k FROM asked JOIN regions ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY 1)
SELECT near.p_partkey, coalesce(k, c_custkey + 1000) AS n_nationkey FROM near LEFT JOIN hit ON near.p_partkey = hit.p_partkey""",
    "edge_polygon_clip_length": f"""WITH {LINES}, {REGIONS}, k AS (SELECT n_nationkey, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len,
  greatest(0, CASE WHEN x1 <> x0 THEN least((xmin - x0) / (x1 - x0), (xmax - x0) / (x1 - x0)) WHEN x0 BETWEEN xmin AND xmax THEN 0 ELSE 2 END, CASE WHEN y1 <> y0 THEN least((ymin - y0) / (y1 - y0), (ymax - y0) / (y1 - y0)) WHEN y0 BETWEEN ymin AND ymax THEN 0 ELSE 2 END) AS t0,
  least(1, CASE WHEN x1 <> x0 THEN greatest((xmin - x0) / (x1 - x0), (xmax - x0) / (x1 - x0)) WHEN x0 BETWEEN xmin AND xmax THEN 1 ELSE -1 END, CASE WHEN y1 <> y0 THEN greatest((ymin - y0) / (y1 - y0), (ymax - y0) / (y1 - y0)) WHEN y0 BETWEEN ymin AND ymax THEN 1 ELSE -1 END) AS t1 FROM seg, regions)
SELECT n_nationkey, count(*) AS n, round(sum((t1 - t0) * len), 4) AS length FROM k WHERE t0 <= t1 AND (t1 - t0) * len > 0 GROUP BY 1""",
    "planar_length": f"WITH {LINES} SELECT l_orderkey, round(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)), 6) AS length FROM seg GROUP BY 1",
    "haversine_length": f"""WITH {LINES}, h AS (SELECT l_orderkey, sin(radians(y1 - y0) / 2) ** 2 + cos(radians(y0)) * cos(radians(y1)) * sin(radians(x1 - x0) / 2) ** 2 AS a FROM seg)
SELECT l_orderkey, round(sum(2 * 6371 * atan2(sqrt(a), sqrt(1 - a))), 4) AS km FROM h GROUP BY 1""",
    "polygon_area_centroid": f"""WITH {BOXES}, p AS (SELECT s_suppkey, (xmax - xmin) * (ymax - ymin) AS a, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, 0.25 * 0.125 AS h, xmin + 0.375 AS hx, ymin + 0.3125 AS hy FROM boxes)
SELECT s_suppkey, round(a - h, 6) AS area, round((a * cx - h * hx) / (a - h), 6) AS x, round((a * cy - h * hy) / (a - h), 6) AS y FROM p""",
    "layer_bounds": f"WITH {LINES} SELECT min(least(x0, x1)) AS xmin, min(least(y0, y1)) AS ymin, max(greatest(x0, x1)) AS xmax, max(greatest(y0, y1)) AS ymax FROM seg",
    "shortest_path_cost": f"WITH {ARCS}, {_relax('SELECT n_nationkey AS source FROM nation', 24)} SELECT source::BIGINT AS source, node::BIGINT AS destination, cost FROM r24",
    "shortest_path_rounds": f"WITH {ARCS}, {_relax('SELECT n_nationkey AS source FROM nation', 4)} SELECT source::BIGINT AS source, node::BIGINT AS node, cost FROM r4",
    "od_path_sums": f"""WITH {ARCS}, {_relax("SELECT n_nationkey AS source FROM nation", 24)} SELECT n_nationkey::BIGINT AS origin, ((n_nationkey * 3 + 2) % 25)::BIGINT AS destination, (n_nationkey % 2)::BIGINT AS goods, cost
FROM nation JOIN r24 ON source = n_nationkey AND node = (n_nationkey * 3 + 2) % 25""",
    "route_with_failures": f"""WITH {ARCS}, ok AS (SELECT * FROM edges WHERE edge_id NOT IN (0, 3, 103, 112)), {_relax("SELECT n_nationkey AS source FROM nation", 24, "ok")}
SELECT s.n_nationkey::BIGINT AS source, d.n_nationkey::BIGINT AS destination, cost FROM nation s CROSS JOIN nation d LEFT JOIN r24 ON source = s.n_nationkey AND node = d.n_nationkey""",
    "topology_nodes": f"""WITH {LINES}, ends AS (SELECT l_orderkey, arg_min((x0, y0), s) AS a, arg_max((x1, y1), s) AS b FROM seg GROUP BY 1),
n AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS node_id FROM (SELECT a AS p FROM ends UNION SELECT b FROM ends))
SELECT l_orderkey, a.node_id AS from_node, b.node_id AS to_node FROM ends JOIN n a ON ends.a = a.p JOIN n b ON ends.b = b.p""",
    "match_regions": f"""WITH {LINES}, {REGIONS}, b AS (SELECT l_orderkey, min(least(x0, x1)) AS x0, min(least(y0, y1)) AS y0, max(greatest(x0, x1)) AS x1, max(greatest(y0, y1)) AS y1 FROM seg GROUP BY 1),
inside AS (SELECT l_orderkey, min(n_nationkey) AS k FROM b JOIN regions ON (x0 + x1) / 2 >= xmin AND (x0 + x1) / 2 < xmax AND (y0 + y1) / 2 >= ymin AND (y0 + y1) / 2 < ymax GROUP BY 1),
met AS (SELECT l_orderkey, min(n_nationkey) AS k FROM b JOIN regions ON x0 <= xmax AND x1 >= xmin AND y0 <= ymax AND y1 >= ymin GROUP BY 1)
SELECT b.l_orderkey, coalesce(inside.k, met.k) AS n_nationkey FROM b LEFT JOIN inside ON b.l_orderkey = inside.l_orderkey LEFT JOIN met ON b.l_orderkey = met.l_orderkey""",
}


PLACES = f"{ITEMS}, places AS (SELECT DISTINCT x, y FROM items)"
SHEET = "sheet AS (SELECT n_nationkey AS depth, n_nationkey * 0.03125::DOUBLE AS A, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 0.015625::DOUBLE END AS B FROM nation), points AS (SELECT 'A' AS curve_id, depth::DOUBLE AS intensity, A AS damage FROM sheet UNION ALL SELECT 'B', depth::DOUBLE, B FROM sheet WHERE B IS NOT NULL)"


def _inside(x0: str, y0: str, x1: str, y1: str) -> str:
    """The share of a segment of ``seg`` that a box holds."""

    def span(a: str, b: str, low: str, high: str) -> tuple[str, str]:
        t, u = f"({low} - {a}) / ({b} - {a})", f"({high} - {a}) / ({b} - {a})"
        still = f"{a} BETWEEN {low} AND {high}"
        return f"CASE WHEN {a} <> {b} THEN least({t}, {u}) WHEN {still} THEN 0 ELSE 2 END", f"CASE WHEN {a} <> {b} THEN greatest({t}, {u}) WHEN {still} THEN 1 ELSE -1 END"

    (a, b), (c, d) = span("x0", "x1", x0, x1), span("y0", "y1", y0, y1)
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {b}, {d}) - greatest(0::DOUBLE, {a}, {c}))"


def _meets(grid) -> str:
    (u0, v0), (u1, v1) = _inverse(grid, "x0", "y0"), _inverse(grid, "x1", "y1")

    def span(a: str, b: str, high: int) -> tuple[str, str]:
        still = f"{a} BETWEEN 0 AND {high}"
        return f"CASE WHEN {a} <> {b} THEN least((0 - {a}) / ({b} - {a}), ({high} - {a}) / ({b} - {a})) WHEN {still} THEN 0 ELSE 2 END", f"CASE WHEN {a} <> {b} THEN greatest((0 - {a}) / ({b} - {a}), ({high} - {a}) / ({b} - {a})) WHEN {still} THEN 1 ELSE -1 END"

    (a, b), (c, d) = span(u0, u1, grid.width), span(v0, v1, grid.height)
    return f"greatest(0, {a}, {c}) <= least(1, {b}, {d})"


TURN = "((x1 - x0) * 12.0::DOUBLE - (y1 - y0) * 20.0::DOUBLE)"
ORACLE_SQL |= {
    "split_line_index": f"""WITH {_cuts(GRID_A)}, bounds AS (SELECT l_orderkey, s, t FROM ts WHERE r < 1 UNION ALL SELECT l_orderkey, s, unnest([0.0::DOUBLE, 1.0]) FROM seg),
runs AS (SELECT l_orderkey, s, t, lead(t) OVER (PARTITION BY l_orderkey, s ORDER BY t) AS t1 FROM bounds),
ended AS (SELECT DISTINCT l_orderkey, s + 1 AS s FROM ts WHERE r >= 1),
marked AS (SELECT r.l_orderkey, r.s, t, r.t1, CASE WHEN t > 0 OR e.s IS NOT NULL THEN 1 ELSE 0 END AS cut FROM runs r LEFT JOIN ended e ON e.l_orderkey = r.l_orderkey AND e.s = r.s WHERE r.t1 IS NOT NULL),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY l_orderkey ORDER BY s, t) AS piece FROM marked),
placed AS (SELECT n.l_orderkey, piece, x0 + t * (x1 - x0) AS xa, x0 + n.t1 * (x1 - x0) AS xb, y0 + t * (y1 - y0) AS ya, y0 + n.t1 * (y1 - y0) AS yb, (n.t1 - t) * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM numbered n JOIN seg USING (l_orderkey, s)),
box AS (SELECT l_orderkey, piece, (least(min(xa), min(xb)) + greatest(max(xa), max(xb))) / 2 + {EPS} AS x, (least(min(ya), min(yb)) + greatest(max(ya), max(yb))) / 2 + {EPS} AS y, sum(len) AS len FROM placed GROUP BY ALL),
cell AS (SELECT floor({_inverse(GRID_A, "x", "y")[0]})::BIGINT AS i, floor({_inverse(GRID_A, "x", "y")[1]})::BIGINT AS j, len FROM box),
held AS (SELECT CASE WHEN i BETWEEN 0 AND {GRID_A.width - 1} AND j BETWEEN 0 AND {GRID_A.height - 1} THEN i ELSE -1 END AS index_i, CASE WHEN i BETWEEN 0 AND {GRID_A.width - 1} AND j BETWEEN 0 AND {GRID_A.height - 1} THEN j ELSE -1 END AS index_j, len FROM cell)
SELECT index_i, index_j, round(sum(len), 4) AS length FROM held GROUP BY 1, 2 HAVING round(sum(len), 4) > 0""",
    "segment_facts": f"""WITH {LINES}, f AS (SELECT *, ((10.0::DOUBLE - x0) * 12.0::DOUBLE - (0.1::DOUBLE - y0) * 20.0::DOUBLE) / nullif({TURN}, 0) AS t, ((10.0::DOUBLE - x0) * (y1 - y0) - (0.1::DOUBLE - y0) * (x1 - x0)) / nullif({TURN}, 0) AS u FROM seg)
SELECT coalesce(t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1, false) AS crosses, {_meets(GRID_SMALL)} AS meets, count(*) AS n, round(sum(atan2(x1 - x0, y1 - y0)), 4) AS bearing, sum((x0 + x1) / 2) AS mx FROM f GROUP BY 1, 2""",
    "single_cell_numbers": f"WITH {_cells(GRID_B)} SELECT index_i + index_j * {GRID_B.width} AS cell, count(*) AS n FROM cells WHERE index_i >= 0 GROUP BY 1",
    "grids_of_extents": "SELECT w AS cell_width, ceil(48 / w)::BIGINT AS width, ceil(13 / (w / 2))::BIGINT AS height, 0.5::DOUBLE AS x, 0.25::DOUBLE AS y FROM (VALUES (1.0::DOUBLE), (2.0), (5.0), (7.0)) t(w)",
    "almost_equal_values": """WITH v AS (SELECT (l_extendedprice * 0.1::DOUBLE) * 3 AS x, l_extendedprice * 0.3::DOUBLE AS y, l_extendedprice * 0.3::DOUBLE + 1e-6::DOUBLE AS z FROM lineitem)
SELECT abs(x - y) <= pow(2::DOUBLE, -52) * abs(x + y) * 3 OR abs(x - y) < pow(2::DOUBLE, -1022) AS near, x = y AS same, abs(x - z) <= pow(2::DOUBLE, -52) * abs(x + z) * 3 OR abs(x - z) < pow(2::DOUBLE, -1022) AS far, count(*) AS n FROM v GROUP BY 1, 2, 3""",
    "consecutive_distinct": """WITH v AS (SELECT l_orderkey, (l_quantity % 3)::INT AS v, row_number() OVER w AS n, lag((l_quantity % 3)::INT) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_quantity % 3)::INT))
SELECT l_orderkey, string_agg(v::VARCHAR, ',' ORDER BY n) AS kept FROM v WHERE before IS NULL OR before <> v GROUP BY 1""",
    "points_in_extent": f"WITH {ITEMS} SELECT x BETWEEN 0 AND 24 AND y BETWEEN 0 AND 8 AS inside, count(*) AS n FROM items GROUP BY 1",
    "rounded_lines": f"WITH {ITEMS}, v AS (SELECT l_orderkey, round_even(x, 1) AS x, round_even(y, 1) AS y, count(*) OVER (PARTITION BY l_orderkey) AS n FROM items) SELECT l_orderkey, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM v WHERE n >= 2 GROUP BY 1",
    "triangle_points": f"WITH {PLACES}, {BOXES} SELECT s_suppkey, count(*) AS n FROM places JOIN boxes ON x >= xmin AND y >= ymin AND y < ymax AND x < xmax + (y - ymin) * ((xmin - xmax) / (ymax - ymin)) GROUP BY 1",
    "triangle_box_points": f"WITH {PLACES}, {BOXES} SELECT x, y FROM places WHERE EXISTS (SELECT 1 FROM boxes WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax)",
    "first_polygon": f"WITH {PLACES}, {BOXES} SELECT x, y, (SELECT min(s_suppkey) FROM boxes WHERE x >= xmin AND x < xmax AND y >= ymin AND y < ymax) AS s_suppkey FROM places",
    "pruned_places": f"WITH {PLACES}, {BOXES}, e AS (SELECT min(xmin) AS a, min(ymin) AS b, max(xmax) AS c, max(ymax) AS d FROM boxes WHERE s_suppkey <= 3) SELECT x, y FROM places, e WHERE x BETWEEN a AND c AND y BETWEEN b AND d",
    "edge_l_shape_length": f"""WITH {LINES}, l AS (SELECT n_nationkey, (n_nationkey % 5) * 10.0::DOUBLE + 0.1::DOUBLE AS a, (n_nationkey // 5) * 3.0::DOUBLE + 0.1::DOUBLE AS b FROM nation),
k AS (SELECT n_nationkey, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * ({_inside("a", "b", "(a + 8)", "(b + 1)")} + {_inside("a", "(b + 1)", "(a + 3)", "(b + 2.5::DOUBLE)")}) AS len FROM seg, l)
SELECT n_nationkey, round(sum(len), 4) AS length FROM k GROUP BY 1 HAVING sum(len) > 0""",
    "triangle_cell_total": f"WITH {BOXES} SELECT s_suppkey, round((xmax - xmin) * (ymax - ymin) / 2, 6) AS area FROM boxes WHERE s_suppkey % 9 < 8",
    "triangle_area_centroid": f"WITH {BOXES} SELECT s_suppkey, round((xmax - xmin) * (ymax - ymin) / 2, 6) AS area, round(xmin + (xmax - xmin) / 3, 6) AS x, round(ymin + (ymax - ymin) / 3, 6) AS y FROM boxes",
    "split_point_cells": f"WITH {_cells(GRID_A)}, {_cells(GRID_B).partition(', cells AS ')[2].join(['b AS ', ''])} SELECT {', '.join('a.' + k for k in KEYS.split(', '))}, a.index_i AS i_0, a.index_j AS j_0, b.index_i AS i_1, b.index_j AS j_1 FROM cells a POSITIONAL JOIN b",
    "reprojected_point_cells": f"""WITH {PLACES}, m AS (SELECT x, y, radians(x) * 6378137 AS east, ln(tan(pi() / 4 + radians(y) / 2)) * 6378137 AS north FROM places), c AS (SELECT *, floor((east + 12345) / 100000)::BIGINT AS i, floor((north + 54321) / 100000)::BIGINT AS j FROM m)
SELECT x, y, CASE WHEN i BETWEEN 0 AND 59 AND j BETWEEN 0 AND 19 THEN i ELSE -1 END AS i_0, CASE WHEN i BETWEEN 0 AND 59 AND j BETWEEN 0 AND 19 THEN j ELSE -1 END AS j_0, round(east, 3) AS east, round(north, 3) AS north, x AS back_x, y AS back_y FROM c""",
    "exploded_parts": f"WITH {ITEMS} SELECT l_orderkey, count(*) AS n, sum(x) AS x, sum(y) AS y FROM items GROUP BY 1",
    "merged_lines": "SELECT s_suppkey, n, length FROM supplier, (VALUES (4::INT, 3.0::DOUBLE), (2, 2.0)) t(n, length)",
    "curve_sheet": f"WITH {SHEET} SELECT curve_id, row_number() OVER (PARTITION BY curve_id ORDER BY intensity) - 1 AS point_index, intensity, damage FROM points",
    "catalogue_tables": f"WITH {SHEET} SELECT curve_id, 'vulnerability' AS curve_type, count(*) AS n, max(damage) AS most FROM points WHERE curve_id = 'A' GROUP BY 1",
    "available_by_name": "SELECT n_nationkey::VARCHAR AS curve_id, n_name AS hazard_name FROM nation WHERE n_name ILIKE '%1%'",
    "path_edges": f"""WITH {ARCS}, p AS (SELECT n_nationkey AS key, unnest([0, 1, 2]) AS step, unnest([n_nationkey, (n_nationkey + 1) % 25, (n_nationkey + 2) % 25]) AS p, unnest([(n_nationkey + 1) % 25, (n_nationkey + 2) % 25, (n_nationkey + 9) % 25]) AS q FROM nation)
SELECT key::BIGINT AS key, step::BIGINT AS step, min(edge_id)::BIGINT AS edge_id FROM p LEFT JOIN edges ON least(u, v) = least(p, q) AND greatest(u, v) = greatest(p, q) GROUP BY 1, 2""",
    "sample_sizes": "SELECT n, k, CASE WHEN k > n THEN 0 ELSE (factorial(n::INT) // (factorial(k::INT) * factorial((n - k)::INT)))::BIGINT END AS ways FROM range(11) a(n), range(12) b(k)",
    "yearly_factors": "SELECT (2020 + y)::INT AS year, y::INT AS year_from_start, round(1.0::DOUBLE / pow(1.03::DOUBLE, y), 9) AS factor FROM range(31) t(y)",
    "id_numbers": "SELECT s_suppkey, s_suppkey::BIGINT AS number, NULL::BIGINT AS none FROM supplier",
}
