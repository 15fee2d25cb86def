"""The queries of the library over the star schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import geometry as g
from terracell.functions.grid import GridDefinition, apply_indices, cell_number, grid_boxes, offset_in_cell, point_indices, ravel, unravel
from terracell.operators import costs, curves, network, raster, risk, routing, spatial_join, split
from terracell.plans import fixtures as fx
from terracell.plans.fixtures import GRID_A, GRID_B, GRID_SMALL, PERIODS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CURVE = curves.PiecewiseLinearCurve([(0, 0), (40, 0.1), (80, 0.2), (120, 1)])
FALLING = curves.PiecewiseLinearCurve([(10, 0.9), (20, 0.5), (40, 0.25)])


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _cells(spark, d, grid, *more):
    rows = fx.item_points(spark, d, *more)
    i, j = point_indices(grid, g.point(F.col("x"), F.col("y")))
    return rows.select("*", i.alias("index_i"), j.alias("index_j"))


# Grid


@query
def cell_index_points(spark, d):
    return _cells(spark, d, GRID_B).select(*KEYS, "index_i", "index_j")


@query
def cell_boxes(spark, d):
    return grid_boxes(spark, GRID_B)


@query
def cell_numbers(spark, d):
    rows = _cells(spark, d, GRID_A).where("index_i >= 0")
    flat = ravel(F.col("index_j"), F.col("index_i"), GRID_A.width, GRID_A.height)
    ox, oy = offset_in_cell(GRID_A, F.col("x"), F.col("y"))
    rows = rows.select("l_orderkey", flat.alias("cell"), ox.alias("off_x"), oy.alias("off_y"))
    row, column = unravel(F.col("cell"), GRID_A.width)
    return rows.groupBy("cell", row.alias("row"), column.alias("column")).agg(F.count(F.lit(1)).alias("n"), F.sum("off_x").alias("off_x"), F.sum("off_y").alias("off_y"))


# Raster


@query
def raster_lookup(spark, d):
    return raster.lookup(_cells(spark, d, GRID_A), raster.band(fx.raster(spark, GRID_A))).select(*KEYS, "value")


@query
def raster_lookup_multi(spark, d):
    both = fx.raster(spark, GRID_A, "river").unionByName(fx.raster(spark, GRID_A, "coast", 100))
    names = raster.column_names([("river", [1]), ("coast", [1])])
    return raster.lookup_wide(_cells(spark, d, GRID_A), both, names).select(*KEYS, "river", "coast")


@query
def cell_damage(spark, d):
    rows = raster.lookup(_cells(spark, d, GRID_A, "l_quantity"), raster.band(fx.raster(spark, GRID_A)))
    rows = rows.withColumn("loss", CURVE.damage_fraction(F.col("value")) * F.col("l_quantity"))
    return raster.rasterise(rows, "loss", GRID_A).select("i", "j", _r(F.col("value"), 4).alias("loss"))


@query
def grid_dense_sum(spark, d):
    return raster.rasterise_dense(_cells(spark, d, GRID_B, "l_quantity"), "l_quantity", GRID_B, fill=-99.0)


@query
def grid_int_sum(spark, d):
    rows = _cells(spark, d, GRID_A, "l_discount")
    return raster.rasterise_dense(rows, "l_discount", GRID_A, dtype="int")


@query
def pixel_points(spark, d):
    p = raster.pixel_points(raster.band(fx.raster(spark, GRID_B)), GRID_B, 20.0)
    return p.select("id", "x", "y", "value")


# Cutting


@query
def split_line_pieces(spark, d):
    p = split.split_lines(fx.order_lines(spark, d), GRID_A, geometry="line")
    return p.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pieces"), _r(F.sum(g.planar_length(F.col("line")))).alias("length"), F.max("split").alias("last"))


@query
def split_line_index(spark, d):
    p = split.split_lines(fx.order_lines(spark, d), GRID_A, geometry="line")
    p = apply_indices(p, GRID_A, "line")
    return p.groupBy("index_i", "index_j").agg(_r(F.sum(g.planar_length(F.col("line"))), 4).alias("length")).where("length > 0")


@query
def split_line_cells(spark, d):
    p = split.segment_pieces(fx.order_lines(spark, d), GRID_B, ["l_orderkey"], geometry="line")
    return p.where("length > 0").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("length"), 4).alias("length"))


@query
def split_line_bounded(spark, d):
    p = split.split_lines(fx.order_lines(spark, d), GRID_SMALL, bounded=True, geometry="line")
    return p.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pieces"), _r(F.sum(g.planar_length(F.col("line")))).alias("length"))


@query
def split_two_grids(spark, d):
    p = split.split_for_grids(fx.order_lines(spark, d), [GRID_A, GRID_B], geometry="line")
    p = p.withColumn("len", g.planar_length(F.col("line"))).where("len > 0")
    return p.groupBy("i_0", "j_0", "i_1", "j_1").agg(_r(F.sum("len"), 4).alias("length"))


@query
def polygon_cell_area(spark, d):
    p = apply_indices(split.split_polygons(fx.supplier_boxes(spark, d), GRID_A, "polygon"), GRID_A, "polygon", "polygon")
    return p.select("s_suppkey", F.col("index_i").alias("i"), F.col("index_j").alias("j"), _r(g.polygon_area(F.col("polygon"))).alias("area"))


# Curves


@query
def curve_single(spark, d):
    x = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity") * 4 - 20)
    rows = table(spark, d, "lineitem").select(*KEYS, "l_extendedprice", x.alias("x"))
    return rows.select(*KEYS, "l_extendedprice", _r(CURVE.damage_fraction(F.col("x"))).alias("up"), _r(FALLING.damage_fraction(F.col("x"))).alias("down"))


def _catalogue(spark):
    points = [(f"C{k}", n, float(5 * n + k), round(min(1.0, 0.07 * n * (k + 1)), 4)) for k in range(4) for n in range(9)]
    return spark.createDataFrame(points, "curve_id string, point_index int, intensity double, damage double")


@query
def curve_catalogue(spark, d):
    rows = table(spark, d, "lineitem").select(*KEYS, "l_extendedprice", "l_quantity", F.concat(F.lit("C"), (F.col("l_partkey") % 5).cast("string")).alias("curve_id"))
    return curves.evaluate(rows, _catalogue(spark), "l_quantity").select(*KEYS, "l_extendedprice", "curve_id", _r(F.col("damage")).alias("damage"))


@query
def curve_transform_clip(spark, d):
    made = {"up": CURVE.translate_y(0.1), "down": CURVE.translate_y(-0.1), "twice": CURVE.scale_y(2), "wide": CURVE.scale_x(2), "moved": CURVE.translate_x(-5)}
    rows = [(n, x, y) for n, c in made.items() for x, y in c.points]
    return spark.createDataFrame(rows, "name string, intensity double, damage double").select("name", _r(F.col("intensity")).alias("intensity"), _r(F.col("damage")).alias("damage"))


@query
def curve_interpolate(spark, d):
    a, b = curves.PiecewiseLinearCurve([(0, 0), (10, 1)]), curves.PiecewiseLinearCurve([(0, 0), (5, 0.1), (10, 0.8)])
    c = curves.PiecewiseLinearCurve.interpolate(a, b, 0.5)
    return table(spark, d, "lineitem").groupBy((F.col("l_quantity") / 4).alias("x")).agg(F.count(F.lit(1)).alias("n")).select("x", "n", _r(c.damage_fraction(F.col("x"))).alias("damage"))


# Costs


@query
def road_damage_v1(spark, d):
    return fx.exposure(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("n")).select("depth", "n", _r(costs.road_damage(F.col("depth"), 1.5)).alias("percent"))


@query
def road_damage_v2(spark, d):
    rows = fx.exposure(spark, d).select("depth", F.element_at(F.array(F.lit("paved"), F.lit("unpaved"), F.lit("track")), (F.col("region") % 3 + 1).cast("int")).alias("surface")).groupBy("depth", "surface").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("depth", "surface", "n", _r(costs.road_damage_by_surface(F.col("depth"), F.col("surface"), 1.2)).alias("percent"))


@query
def damage_cost(spark, d):
    e = fx.exposure(spark, d)
    asset = F.when(F.col("region") < 3, "road").otherwise("bridge")
    area = costs.cost_per_area(F.col("length"), F.lit(7.5), asset)
    cost = costs.direct_damage(costs.road_damage(F.col("depth")), F.lit(7.5), F.col("length"), area)
    return e.groupBy("region", costs.cost_by_condition(F.when(F.col("region") < 2, "paved").otherwise("x")).alias("condition_cost")).agg(_r(F.sum(cost / 1e6), 2).alias("cost"))


@query
def cost_by_terrain(spark, d):
    types = ["Expressway", "National roads", "Provincial roads", "Boulevard", "Other roads", "Bridge", "Path"]
    roads = fx.exposure(spark, d).select(
        F.element_at(F.array(*map(F.lit, types)), (F.col("edge") % 7 + 1).cast("int")).alias("asset_type"), (F.col("edge") % 8).cast("int").alias("road_class"),
        F.when(F.col("region") % 2 == 0, " Flat ").otherwise("mountain").alias("terrain"),
    ).groupBy("asset_type", "road_class", "terrain").agg(F.count(F.lit(1)).alias("n"))
    names = ["Expressway", "National  2x Carriageway", "National  1x Carriageway", "Provincial", "District", "Commune"]
    rates = spark.createDataFrame([(n, t, 10.0 * (k + 1) + (5 if t == "mountain" else 0), 20.0 - 2 * k) for k, n in enumerate(names) for t in ("flat", "mountain")], "asset string, terrain string, basic_cost double, design_width double")
    return costs.cost_by_terrain(roads, rates, 1.25, national=True).select("asset_type", "road_class", "terrain", "n", _r(F.col("cost_per_area")).alias("cost_per_area"))


# Risk


def _by_probability(spark, d):
    return fx.exposure(spark, d).groupBy("edge", "hazard", "probability").agg(F.sum("damage").alias("damage"))


@query
def ead_trapezoid(spark, d):
    return risk.expected_damage(_by_probability(spark, d), ["edge", "hazard"], "probability", "damage").select("edge", "hazard", _r(F.col("ead")).alias("ead"))


@query
def ead_trapezoid_threshold(spark, d):
    return risk.expected_damage(_by_probability(spark, d), ["edge", "hazard"], "probability", "damage", threshold=0.05).select("edge", "hazard", _r(F.col("ead")).alias("ead"))


@query
def ead_simpson_pivot(spark, d):
    wide = risk.pivot_periods(fx.exposure(spark, d), ["edge", "scenario"], "rp", "damage", list(PERIODS))
    return risk.expected_damage_simpson(wide, list(PERIODS)).select("edge", "scenario", _r(F.col("ead")).alias("ead"))


@query
def ead_pipeline(spark, d):
    """Sums by probability, integrals of both ends, joined and projected."""
    e = fx.exposure(spark, d).groupBy("edge", "hazard", "probability").agg(F.sum(F.col("damage") * 0.5).alias("low"), F.sum("damage").alias("high"), F.max("length").alias("length"))
    low, high = (risk.expected_damage(e, ["edge", "hazard"], "probability", c, f"ead_{c}") for c in ("low", "high"))
    size = e.groupBy("edge").agg(F.max("length").alias("length"))
    out = low.join(high, ["edge", "hazard"], "left").join(size, "edge", "left")
    return out.select("edge", "hazard", _r(F.col("ead_low")).alias("ead_low"), _r(F.col("ead_high")).alias("ead_high"), _r(F.col("ead_high") / F.col("length")).alias("ead_per_length"))


@query
def exposure_minmax_scenario(spark, d):
    return risk.summarise(fx.exposure(spark, d), ["edge", "hazard", "scenario"], "depth", "length", "damage")


@query
def exposure_two_level(spark, d):
    return risk.two_level(fx.exposure(spark, d), ["edge"], "rp", "length", "exposed_length")


@query
def exposure_by_region(spark, d):
    return risk.by_region(fx.exposure(spark, d), ["region", "hazard"], "length").select("region", "hazard", "sum_length", _r(F.col("mean_length")).alias("mean_length"), "n")


@query
def exposure_sum_by_others(spark, d):
    return risk.sum_by_others(fx.exposure(spark, d).select("edge", "hazard", "rp", "length"), "length")


@query
def exposure_describe(spark, d):
    out = risk.describe(fx.exposure(spark, d), "depth")
    return out.select(*(c if c == "n" else _r(F.col(c)).alias(c) for c in out.columns))


@query
def exposure_cdf(spark, d):
    return risk.empirical_cdf(fx.exposure(spark, d), "depth", ["hazard"]).select("hazard", "depth", _r(F.col("cdf"), 9).alias("cdf"))


@query
def exposure_trend(spark, d):
    return risk.trend(fx.exposure(spark, d), ["hazard"], "depth", "length").select("hazard", _r(F.col("slope")).alias("slope"), _r(F.col("intercept")).alias("intercept"), "n")


@query
def exposure_ratio(spark, d):
    e = fx.exposure(spark, d)
    total, deep = F.sum("length"), F.sum(F.when(F.col("depth") >= 1.5, F.col("length")).otherwise(0.0))
    return e.agg(total.alias("total"), deep.alias("deep"), _r(deep / total * 100).alias("percent"))


@query
def melt_hazards(spark, d):
    q = F.col("l_quantity")
    nothing = F.lit(float("nan"))
    rows = table(spark, d, "lineitem").select(*KEYS, "l_extendedprice", F.when(q > 30, q - 30).otherwise(nothing).alias("river"), F.when(q % 2 == 0, q / 4).alias("coast"), (q - 25).alias("surge"))
    return risk.melt(rows, [*KEYS, "l_extendedprice"], ["river", "coast", "surge"])


@query
def pivot_return_period(spark, d):
    return risk.pivot_periods(fx.exposure(spark, d), ["region", "hazard"], "rp", "damage", list(PERIODS))


@query
def scenario_key_parse(spark, d):
    n = F.col("l_linenumber")
    key = F.concat(F.lit("floodmaps-v2-inun"), F.when(n % 2 == 0, "river").otherwise("coast"), F.lit("_rcp"), (n % 3).cast("string"), F.lit("p5_wtsub_2050_rp"), F.lpad((F.col("l_suppkey") % 9 * 100 + 2).cast("string"), 4, "0"), F.when(n > 5, "_5-all").otherwise("-all"))
    keys = table(spark, d, "lineitem").select(F.when(n == 3, F.lit("other")).otherwise(key).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    pattern = r"floodmaps-v2-(\w+)_([^_]+)_([^_]+)_([^_]+)_rp([^-]+)-all"
    out = keys.select("*", *risk.scenario_columns(F.col("key"), pattern, ["hazard", "rcp", "sub", "epoch", "rp_text"]))
    return out.select("key", "n", "hazard", "rcp", "sub", "epoch", risk.period_number(F.col("rp_text")).alias("rp"))


@query
def layer_key_format(spark, d):
    rows = fx.exposure(spark, d).select("hazard", "scenario", "region", F.lit("p").alias("path")).distinct()
    return rows.select("hazard", "scenario", "region", risk.layer_key(["scenario", "hazard", "region"]).alias("key"), risk.layer_key([]).alias("bare"))


@query
def label_parse(spark, d):
    labels = table(spark, d, "nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit(" (m/s) ")).otherwise(F.lit(" "))).alias("label"))
    return labels.select("label", curves.parse_label(F.col("label"))["name"].alias("name"), curves.parse_label(F.col("label"))["unit"].alias("unit"))


OPTIONS = (("four_lane", 1000000.0, 2000.0, 51000.0), ("two_lane", 500000.0, 1000.0, 33000.0), ("unpaved", 20000.0, 800.0, 9000.0))


def _present(spark):
    options = spark.createDataFrame(OPTIONS, "kind string, initial_cost_usd_per_km double, routine_usd_per_km double, periodic_usd_per_km double")
    return risk.present_costs(options, 2020, 2080, 3.0)


@query
def npv_costs(spark, d):
    out = _present(spark)
    return out.select("kind", *(_r(F.col(c), 4).alias(c) for c in out.columns[1:]))


@query
def benefit_cost(spark, d):
    e = fx.exposure(spark, d)
    kind = F.element_at(F.array(*(F.lit(o[0]) for o in OPTIONS)), (F.col("edge") % 3 + 1).cast("int"))
    roads = e.groupBy("edge", kind.alias("kind")).agg(F.sum("length").alias("flood_length_m"), F.sum("damage").alias("ead_usd"))
    out = risk.benefit_cost(roads, _present(spark), risk.total_discount(2020, 2080, 3.0))
    return out.select("edge", "kind", _r(F.col("total_adaptation_cost_usd"), 3).alias("cost"), _r(F.col("total_adaptation_benefit_usd"), 3).alias("benefit"), _r(F.col("bcr"), 5).alias("bcr"))


# Relational joins


@query
def semi_exposed(spark, d):
    deep = fx.exposure(spark, d).where("depth > 3").select("edge").distinct()
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 500).alias("edge"))
    return parts.join(deep, "edge", "left_semi").select("p_partkey", "edge")


@query
def anti_unmatched(spark, d):
    used = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(used, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query
def left_multi_key(spark, d):
    e = fx.exposure(spark, d).groupBy("edge", "hazard").agg(F.sum("length").alias("length"))
    low = fx.exposure(spark, d).where("rp = 2").groupBy("edge", "hazard").agg(F.sum("damage").alias("damage"))
    return e.join(low, ["edge", "hazard"], "left").na.fill(0.0, subset=["damage"])


@query
def hazard_file_attributes(spark, d):
    n = F.col("n_nationkey")
    files = table(spark, d, "nation").select(F.concat(F.lit("flood_1in"), (n % 3 * 10 + 10).cast("string"), F.lit("_"), (n % 4).cast("string"), F.lit("-"), (n % 4 + 1).cast("string"), F.lit("_x")).alias("file_name"), n)
    hazards = spark.createDataFrame([("flood_1in10", "fluvial", 0.1), ("flood_1in20", "fluvial", 0.05)], "file_name string, hazard_type string, probability double")
    return risk.hazard_attributes(files, hazards)


# Spatial joins


@query
def within_region(spark, d):
    p = fx.item_points(spark, d).select(*KEYS, g.point(F.col("x"), F.col("y")).alias("point"))
    hit = spatial_join.points_in_polygons(p, fx.regions(spark, d), 4.0)
    return hit.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query
def exposed_points(spark, d):
    p = fx.item_points(spark, d).select("x", "y").distinct().select(F.concat_ws("/", "x", "y").alias("id"), "x", "y", g.point(F.col("x"), F.col("y")).alias("point"))
    return spatial_join.exposed_points(p, fx.supplier_boxes(spark, d), 2.0, "id").select("x", "y")


def _nodes(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("c_custkey"), g.point(((k * 7) % 97) * 0.5, ((k * 5) % 53) * 0.25).alias("node"))


def _asked(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", g.point((k % 89) * 0.5, (k % 47) * 0.25).alias("point"))


@query
def nearest_node(spark, d):
    out = spatial_join.nearest(_asked(spark, d), _nodes(spark, d), "p_partkey", "c_custkey", 2.0)
    return out.select("p_partkey", "c_custkey", _r(F.col("distance")).alias("distance"))


@query
def contain_else_nearest(spark, d):
    nodes = _nodes(spark, d).select((F.col("c_custkey") + 1000).alias("n_nationkey"), "node")
    regions = fx.regions(spark, d).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "polygon")
    return spatial_join.within_else_nearest(_asked(spark, d), regions, nodes, "p_partkey", "n_nationkey", 2.0).select("p_partkey", "n_nationkey")


@query
def edge_polygon_clip_length(spark, d):
    lines = fx.order_lines(spark, d)
    segments = lines.select("l_orderkey", F.posexplode(g.pairs(F.col("line"))).alias("seg", "s")).select("l_orderkey", "seg", F.array("s.p", "s.q").alias("line"))
    pairs = spatial_join.edges_in_polygons(segments, fx.regions(spark, d), 4.0)
    return pairs.where("length > 0").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("length"), 4).alias("length"))


@query
def match_regions(spark, d):
    out = spatial_join.match_regions(fx.order_lines(spark, d), fx.regions(spark, d), "l_orderkey", "n_nationkey", 4.0)
    return out.select("l_orderkey", "n_nationkey")


# Measures


@query
def planar_length(spark, d):
    return fx.order_lines(spark, d).select("l_orderkey", _r(g.planar_length(F.col("line"))).alias("length"))


@query
def haversine_length(spark, d):
    return fx.order_lines(spark, d).select("l_orderkey", _r(g.haversine_length(F.col("line")), 4).alias("km"))


@query
def polygon_area_centroid(spark, d):
    k = F.col("s_suppkey")
    hole = g.box_polygon(k % 40 + 0.75, k % 9 + 0.5, k % 40 + 1.0, k % 9 + 0.625)
    p = fx.supplier_boxes(spark, d).select("s_suppkey", F.concat("polygon", hole).alias("polygon"))
    c = g.polygon_centroid(F.col("polygon"))
    return p.select("s_suppkey", _r(g.polygon_area(F.col("polygon"))).alias("area"), _r(c["x"]).alias("x"), _r(c["y"]).alias("y"))


@query
def layer_bounds(spark, d):
    b = g.line_bounds(F.col("line"))
    return fx.order_lines(spark, d).agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


@query
def segment_facts(spark, d):
    s = fx.order_lines(spark, d).select(F.explode(g.pairs(F.col("line"))).alias("s"))
    p, q = F.col("s.p"), F.col("s.q")
    a, b = g.point(F.lit(10.0), F.lit(0.1)), g.point(F.lit(30.0), F.lit(12.1))
    facts = s.select(g.segments_cross(p, q, a, b).alias("crosses"), g.bearing(p, q).alias("b"), g.midpoint(p, q)["x"].alias("mx"), split.segment_meets_grid(p, q, GRID_SMALL).alias("meets"))
    return facts.groupBy("crosses", "meets").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("b"), 4).alias("bearing"), F.sum("mx").alias("mx"))


# Networks


@query
def shortest_path_cost(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pairs = network.od_pairs(nodes, nodes)
    return routing.shortest_paths(pairs, fx.nation_edges(spark, d)).select("source", "destination", "cost")


@query
def shortest_path_rounds(spark, d):
    sources = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    return routing.costs_by_rounds(sources, fx.nation_edges(spark, d), 4)


@query
def od_path_sums(spark, d):
    edges = fx.nation_edges(spark, d).withColumns({"length": F.lit(1.0), "toll": (F.col("edge_id") % 4).cast("double")})
    k = F.col("n_nationkey").cast("long")
    points = table(spark, d, "nation").select(k.alias("origin"), ((k * 3 + 2) % 25).alias("destination"), (k % 2).alias("goods"))
    return routing.od_assembly(points, edges, "weight", ["weight"]).select("origin", "destination", "goods", F.col("sum_weight").alias("cost"))


@query
def route_with_failures(spark, d):
    edges = fx.nation_edges(spark, d)
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    failed = edges.where("edge_id in (0, 3, 103, 112)").select("edge_id")
    pairs = network.od_pairs(nodes, nodes)
    return routing.route_with_failures(edges, failed, pairs, drop=True).select("source", "destination", "cost")


@query
def topology_nodes(spark, d):
    nodes, edges = network.topology(fx.order_lines(spark, d), "l_orderkey")
    return edges.select("l_orderkey", "from_node", "to_node")


@query
def failure_samples(spark, d):
    edges = fx.nation_edges(spark, d)
    samples = routing.failure_samples(edges, 20, 5, seed=1)
    return routing.sampled_routes(edges, samples, 0, 12).select("sample", "cost", F.size("path").alias("n_edges"))


# Operators one by one


@query
def single_cell_numbers(spark, d):
    rows = _cells(spark, d, GRID_B).where("index_i >= 0")
    return rows.groupBy(cell_number(GRID_B, F.col("index_i"), F.col("index_j")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query
def grids_of_extents(spark, d):
    made = [GridDefinition.from_extent(0.5, 0.25, 48.5, 13.25, w, w / 2, "EPSG:32630") for w in (1.0, 2.0, 5.0, 7.0)]
    return spark.createDataFrame([(g_.transform[0], g_.width, g_.height, g_.transform[2], g_.transform[5]) for g_ in made], "cell_width double, width long, height long, x double, y double")


@query
def almost_equal_values(spark, d):
    p = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").select(((p * 0.1) * 3).alias("x"), (p * 0.3).alias("y"), (p * 0.3 + 1e-6).alias("z"))
    return rows.groupBy(g.almost_equal(F.col("x"), F.col("y")).alias("near"), (F.col("x") == F.col("y")).alias("same"), g.almost_equal(F.col("x"), F.col("z")).alias("far")).agg(F.count(F.lit(1)).alias("n"))


@query
def consecutive_distinct(spark, d):
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") % 3).cast("int").alias("v"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(step)).alias("s"))
    return rows.select("l_orderkey", F.array_join(g.drop_repeats(F.col("s.v")).cast("array<string>"), ",").alias("kept"))


@query
def points_in_extent(spark, d):
    inside = split.point_in_extent(g.point(F.col("x"), F.col("y")), GRID_SMALL)
    return fx.item_points(spark, d).groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query
def rounded_lines(spark, d):
    line = g.round_line(F.col("line"), 1)
    total = lambda c: F.aggregate(line, F.lit(0.0), lambda a, p: a + p[c])
    return fx.order_lines(spark, d).select("l_orderkey", _r(total("x"), 4).alias("x"), _r(total("y"), 4).alias("y"))


@query
def triangle_points(spark, d):
    hit = spatial_join.points_in_polygons(fx.places(spark, d), fx.triangles(spark, d), 2.0)
    return hit.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query
def triangle_box_points(spark, d):
    return spatial_join.exposed_points(fx.places(spark, d), fx.triangles(spark, d), 2.0, "id", bbox_only=True).select("x", "y")


@query
def first_polygon(spark, d):
    boxes = fx.supplier_boxes(spark, d).withColumn("key", F.col("s_suppkey"))
    return spatial_join.first_match(fx.places(spark, d), boxes, 2.0, "id", "s_suppkey", "key").select("x", "y", "s_suppkey")


@query
def pruned_places(spark, d):
    few = fx.triangles(spark, d).where("s_suppkey <= 3")
    kept = spatial_join.prune_by_extent(fx.places(spark, d), spatial_join.point_box(F.col("point")), few, g.polygon_bounds(F.col("polygon")))
    return kept.select("x", "y")


@query
def edge_l_shape_length(spark, d):
    s = fx.order_lines(spark, d).select("l_orderkey", F.posexplode(g.pairs(F.col("line"))).alias("seg", "s"))
    pairs = spatial_join.edges_in_polygons(s.select("l_orderkey", "seg", F.array("s.p", "s.q").alias("line")), fx.l_shapes(spark, d), 4.0)
    return pairs.groupBy("n_nationkey").agg(_r(F.sum("length"), 4).alias("length"))


@query
def triangle_cell_total(spark, d):
    inside = fx.triangles(spark, d).where("s_suppkey % 40 < 40 and s_suppkey % 9 < 8")
    p = split.split_polygons(inside, GRID_A, "polygon")
    return p.groupBy("s_suppkey").agg(_r(F.sum(g.polygon_area(F.col("polygon")))).alias("area"))


@query
def triangle_area_centroid(spark, d):
    c = g.polygon_centroid(F.col("polygon"))
    return fx.triangles(spark, d).select("s_suppkey", _r(g.polygon_area(F.col("polygon"))).alias("area"), _r(c["x"]).alias("x"), _r(c["y"]).alias("y"))


@query
def split_point_cells(spark, d):
    rows = fx.item_points(spark, d).select(*KEYS, g.point(F.col("x"), F.col("y")).alias("geometry"))
    return split.split_for_grids(split.split_points(rows), [GRID_A, GRID_B], "point").select(*KEYS, "i_0", "j_0", "i_1", "j_1")


@query
def reprojected_point_cells(spark, d):
    grid = GridDefinition("EPSG:3857", 60, 20, (100000.0, 0, -12345.0, 0, 100000.0, -54321.0))
    rows = fx.places(spark, d).withColumnRenamed("point", "geometry")
    rows = split.split_for_grids(rows, [grid], "point", "EPSG:4326")
    p = g.reproject_geometry(g.point(F.col("x"), F.col("y")), "point", "EPSG:4326", "EPSG:3857")
    return rows.select("x", "y", "i_0", "j_0", _r(p["x"], 3).alias("east"), _r(p["y"], 3).alias("north"), _r(F.col("geometry")["x"]).alias("back_x"), _r(F.col("geometry")["y"]).alias("back_y"))


@query
def exploded_parts(spark, d):
    rows = fx.item_points(spark, d).groupBy("l_orderkey").agg(F.collect_list(g.point(F.col("x"), F.col("y"))).alias("geometry"))
    rows = split.prepare_points(rows)
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("geometry.x").alias("x"), F.sum("geometry.y").alias("y"))


@query
def merged_lines(spark, d):
    k = F.col("s_suppkey")
    p = [g.point(k + x, k + y) for x, y in ((0, 0), (1, 0), (1, 1), (2, 1), (7, 7), (9, 7))]
    parts = F.array(F.array(p[2], p[3]), F.array(p[1], p[0]), F.array(p[4], p[5]), F.array(p[1], p[2]))
    rows = split.prepare_lines(table(spark, d, "supplier").select("s_suppkey", parts.alias("geometry")))
    return rows.select("s_suppkey", F.size("geometry").alias("n"), _r(g.planar_length(F.col("geometry"))).alias("length"))


def _sheet(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("string").alias("depth"), (k * 0.03125).cast("string").alias("A"), F.when(k % 3 == 0, "n/a").otherwise((k * 0.015625).cast("string")).alias("B"), F.lit("").alias("C"))


@query
def curve_sheet(spark, d):
    return curves.curve_points(_sheet(spark, d), "depth", ["A", "B", "C"]).select("curve_id", F.col("point_index").cast("long").alias("point_index"), "intensity", "damage")


@query
def catalogue_tables(spark, d):
    metadata = spark.createDataFrame([("A", "vulnerability"), ("B", "fragility"), ("C", "vulnerability"), ("D", "vulnerability")], "curve_id string, curve_type string")
    kept, points = curves.build_catalogue(metadata, curves.curve_points(_sheet(spark, d), "depth", ["A", "B", "C"]), ["vulnerability"])
    return kept.join(points, "curve_id").groupBy("curve_id", "curve_type").agg(F.count(F.lit(1)).alias("n"), F.max("damage").alias("most"))


@query
def available_by_name(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("curve_id"), F.col("n_name").alias("hazard_name"))
    return curves.available_curves(rows, hazard_name="1").select("curve_id", "hazard_name")


@query
def path_edges(spark, d):
    k = F.col("n_nationkey").cast("long")
    paths = table(spark, d, "nation").select(k.alias("key"), F.array(k, (k + 1) % 25, (k + 2) % 25, (k + 9) % 25).alias("nodes"))
    return network.edges_of_path(paths, fx.nation_edges(spark, d), "key").select("key", F.col("step").cast("long").alias("step"), "edge_id")


@query
def sample_sizes(spark, d):
    return spark.createDataFrame([(n, k, risk.n_choose_k(n, k)) for n in range(11) for k in range(12)], "n long, k long, ways long")


@query
def yearly_factors(spark, d):
    return risk.discount_factors(spark, 2020, 2050, 3.0).select("year", "year_from_start", _r(F.col("factor"), 9).alias("factor"))


@query
def id_numbers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", network.id_number(F.concat(F.lit("roade_"), F.col("s_suppkey").cast("string"))).alias("number"), network.id_number(F.lit("roade_x")).alias("none"))
