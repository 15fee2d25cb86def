"""Networks from lines: nodes, edges, topology, and edges of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.functions import geometry as g
from terracell.functions.expr import pairs


def end_points(edges: DataFrame, line: str = "line") -> DataFrame:
    """Distinct end points ``x, y``."""
    ends = F.explode(F.array(F.element_at(line, 1), F.element_at(line, -1)))
    return edges.select(ends.alias("p")).select("p.x", "p.y").distinct()


def number_rows(df: DataFrame, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """Adds consecutive numbers from 0 in an order, without bringing all rows to one task.

    The first column is a number. Its quantiles cut the rows in parts, which are counted, and rows
    are numbered within their part; equal values are in one part, so every run agrees.
    """
    cuts = sorted(set(df.approxQuantile(order[0], [k / parts for k in range(1, parts)], 0.01)))
    part = F.lit(0)
    for k, cut in enumerate(cuts):
        part = F.when(F.col(order[0]) > cut, F.lit(k + 1)).otherwise(part)
    rows = df.withColumn("_part", part)
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # parts rows
    base, offset = 0, F.lit(0).cast("long")
    for k in sorted(counts):
        offset = F.when(F.col("_part") == k, F.lit(base).cast("long")).otherwise(offset)
        base += counts[k]
    return rows.withColumn(name, (offset + F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1).cast("long")).drop("_part")


def topology(edges: DataFrame, key: str, line: str = "line", digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``node_id, x, y`` and edges with ``from_node, to_node``. Nodes are numbered in order of place."""
    e = edges.withColumn(line, g.round_line(F.col(line), digits)) if digits is not None else edges
    ends = end_points(e, line)
    nodes = number_rows(ends, ["x", "y"], "node_id").select("node_id", "x", "y")
    at = lambda name: nodes.select(F.col("node_id").alias(name), F.col("x").alias("_x"), F.col("y").alias("_y"))
    out = e
    for name, k in (("from_node", 1), ("to_node", -1)):
        end = F.element_at(line, k)
        out = out.withColumns({"_px": end["x"], "_py": end["y"]})
        out = out.join(at(name), (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")), "left").drop("_px", "_py", "_x", "_y")
    return nodes, out


def split_at_nodes(edges: DataFrame, key: str, line: str = "line", tolerance: float = 0.0, size: float = 1.0) -> DataFrame:
    """Lines cut at the end points of other lines that lie on them (within ``tolerance``), with ``split``."""
    from terracell.operators.spatial_join import point_box, tile_join

    nodes = end_points(edges, line).select(g.point(F.col("x"), F.col("y")).alias("_node"))
    segments = edges.select(key, F.posexplode(pairs(F.col(line))).alias("_seg", "_s"))
    box = F.struct(*((f(F.col("_s.p")[c], F.col("_s.q")[c]) + F.lit(s * tolerance)).alias(n) for n, f, c, s in (("xmin", F.least, "x", -1), ("ymin", F.least, "y", -1), ("xmax", F.greatest, "x", 1), ("ymax", F.greatest, "y", 1))))
    p, q, n = F.col("_s.p"), F.col("_s.q"), F.col("_node")
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    t = F.try_divide((n["x"] - p["x"]) * dx + (n["y"] - p["y"]) * dy, dx * dx + dy * dy)
    off = F.hypot(n["x"] - p["x"] - t * dx, n["y"] - p["y"] - t * dy)
    hits = tile_join(segments, nodes, box, point_box(n), size).withColumn("_t", t).where((F.col("_t") > 0) & (F.col("_t") <= 1) & (off <= tolerance))
    cuts = hits.groupBy(key, "_seg").agg(F.array_sort(F.collect_set(F.struct("_t", "_node"))).alias("_cuts"))
    flagged = segments.join(cuts, [key, "_seg"], "left")
    none = F.array().cast(f"array<struct<at:{g.POINT},cut:boolean>>")
    inner = F.transform(F.filter("_cuts", lambda c: c["_t"] < 1), lambda c: F.struct(c["_node"].alias("at"), F.lit(True).alias("cut")))
    at_end = F.coalesce(F.exists("_cuts", lambda c: c["_t"] == 1), F.lit(False))
    part = F.concat(F.coalesce(inner, none), F.array(F.struct(q.alias("at"), at_end.alias("cut"))))
    stream = flagged.select(key, "_seg", part.alias("_part")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_seg", "_part"))).alias("_parts"))
    joined = edges.join(stream, key)
    whole = F.concat(F.array(F.struct(F.element_at(line, 1).alias("at"), F.lit(False).alias("cut"))), F.flatten(F.col("_parts._part")))
    bounds = F.expr("filter(sequence(0, size(_w) - 1), i -> i = 0 or i = size(_w) - 1 or _w[i].cut)")
    pieces = F.transform(pairs(F.col("_bounds")), lambda s: F.transform(F.slice(F.col("_w"), s["p"] + 1, s["q"] - s["p"] + 1), lambda v: v["at"]))
    joined = joined.withColumn("_w", whole).withColumn("_bounds", bounds)
    return joined.select(*[c for c in edges.columns if c != line], F.posexplode(pieces).alias("split", line))


def link_near(nodes: DataFrame, distance: float, node_id: str = "node_id") -> DataFrame:
    """Straight edges between different nodes within a distance, each once: ``from_node, to_node, line``."""
    from terracell.operators.spatial_join import tile_join

    p, q = g.point(F.col("x"), F.col("y")), g.point(F.col("x2"), F.col("y2"))
    a = nodes.select(F.col(node_id).alias("from_node"), "x", "y")
    b = nodes.select(F.col(node_id).alias("to_node"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    box = lambda s, r: F.struct((s["x"] - r).alias("xmin"), (s["y"] - r).alias("ymin"), (s["x"] + r).alias("xmax"), (s["y"] + r).alias("ymax"))
    near = tile_join(a, b, box(p, distance / 2), box(q, distance / 2), max(distance, 1e-9), (F.col("from_node") < F.col("to_node")) & (g.length(p, q) <= distance))
    return near.select("from_node", "to_node", F.array(p, q).alias("line"))


def edges_of_path(paths: DataFrame, edges: DataFrame, key: str, path: str = "nodes", edge: str = "edge_id") -> DataFrame:
    """Node paths to edges in order: ``key, step, edge_id``; of parallel edges the least id."""
    steps = paths.select(key, F.posexplode(pairs(F.col(path))).alias("step", "s"))
    u, v = F.least("s.p", "s.q"), F.greatest("s.p", "s.q")
    lookup = edges.groupBy(F.least("from_node", "to_node").alias("_u"), F.greatest("from_node", "to_node").alias("_v")).agg(F.min(edge).alias(edge))
    return steps.join(lookup, (u == F.col("_u")) & (v == F.col("_v")), "left").select(key, "step", edge)


def od_pairs(sources: DataFrame, destinations: DataFrame) -> DataFrame:
    """Every source with every destination: ``source, destination``. The result is that product."""
    return sources.select(F.col(sources.columns[0]).alias("source")).crossJoin(destinations.select(F.col(destinations.columns[0]).alias("destination")))


def id_number(column: Column, prefix: int = 6) -> Column:
    """The number behind an id's prefix."""
    return F.substr(column, F.lit(prefix + 1)).try_cast("long")
