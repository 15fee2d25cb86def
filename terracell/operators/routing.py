"""Shortest paths on undirected networks ``edge_id, from_node, to_node, weight``.

Ties are settled in the same way everywhere: least cost, then fewest edges, then the smallest
sequence of edge ids. A graph whose edges number at most ``BROADCAST_EDGES`` is sent to the
executors, and every task answers the pairs of some sources; larger graphs are relaxed by joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_EDGES = 2_000_000


class Graph:
    """Adjacency of a graph, built once in each worker."""

    def __init__(self, edges: list[tuple]) -> None:
        self.at: dict = {}
        for edge, u, v, w in edges:
            if w < 0:
                raise ValueError("weights can't be negative")
            self.at.setdefault(u, []).append((v, w, edge))
            if u != v:
                self.at.setdefault(v, []).append((u, w, edge))

    def paths(self, source, wanted: set) -> dict:
        """The best path of each reachable target: ``(cost, edges)``."""
        found: dict = {}
        heap: list = [(0.0, 0, (), source)]
        left = set(wanted)
        while heap and left:
            cost, n, path, u = heapq.heappop(heap)
            if u in found:
                continue
            found[u] = (cost, path)
            left.discard(u)
            for v, w, edge in self.at.get(u, ()):
                if v not in found:
                    heapq.heappush(heap, (cost + w, n + 1, (*path, edge), v))
        return {t: found[t] for t in wanted if t in found}


def shortest_paths(pairs: DataFrame, edges: DataFrame, weight: str = "weight", drop_infinite: bool = False, limit: int = BROADCAST_EDGES) -> DataFrame:
    """``source, destination`` to these with ``cost`` and ``path`` (edge ids in order).

    A pair without a path, or of equal nodes, has an empty path; its cost is null, or 0. Infinite
    weights are used only if there is no other way, or not at all.
    """
    spark = pairs.sparkSession
    e = edges.select("edge_id", "from_node", "to_node", F.col(weight).cast("double").alias("w"))
    if drop_infinite:
        e = e.where(F.col("w") < float("inf"))
    rows = e.limit(limit + 1).collect()
    edge, node = e.schema["edge_id"].dataType.simpleString(), pairs.schema["source"].dataType.simpleString()
    out = f"source {node}, destination {node}, cost double, path array<{edge}>"
    if len(rows) > limit:
        return relaxed_paths(pairs, e.withColumnRenamed("w", "weight"))
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
    built: dict = {}

    def run(table: pa.Table) -> pa.Table:
        graph = built.get("g")
        if graph is None:
            graph = built["g"] = Graph(shared.value)
        source = table.column("source")[0].as_py()
        wanted = table.column("destination").to_pylist()
        best = graph.paths(source, {d for d in wanted if d is not None})
        cost = [best[d][0] if d in best else None for d in wanted]
        path = [list(best[d][1]) if d in best else [] for d in wanted]
        kinds = pa.schema([("source", table.schema.field("source").type), ("destination", table.schema.field("destination").type), ("cost", pa.float64()), ("path", pa.list_(pa.int64() if edge == "bigint" else pa.int32() if edge == "int" else pa.string()))])
        return pa.table([table.column("source"), table.column("destination"), cost, path], schema=kinds)

    # destinations of a source are dealt to tasks, so that a source with very many isn't one group
    dealt = pairs.select("source", "destination").withColumn("_part", F.pmod(F.xxhash64("destination"), F.lit(8)))
    return dealt.groupBy("source", "_part").applyInArrow(lambda t: run(t.select(["source", "destination"])), out)


def costs_by_rounds(sources: DataFrame, edges: DataFrame, rounds: int, weight: str = "weight") -> DataFrame:
    """Least costs with at most ``rounds`` edges from each source, by joins only: ``source, node, cost``."""
    both = edges.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.col(weight).cast("double").alias("w"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.min("w").alias("w"))
    now = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"))
    for _ in range(rounds):
        step = now.join(both, now["node"] == both["u"]).select("source", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        now = now.unionByName(step).groupBy("source", "node").agg(F.min("cost").alias("cost"))
    return now


def relaxed_paths(pairs: DataFrame, edges: DataFrame, every: int = 2) -> DataFrame:
    """The same as :func:`shortest_paths` for graphs that are not sent around: joins until nothing improves.

    State is written by ``checkpoint`` to the session's shared folder.
    """
    spark = pairs.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from terracell.sources.shared import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
    arcs = edges.select("edge_id", F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.col("weight").cast("double").alias("w"))
    arcs = arcs.unionByName(arcs.where("u <> v").select("edge_id", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    kind = edges.schema["edge_id"].dataType.simpleString()
    state = pairs.select("source").distinct().select("source", F.col("source").alias("node"), F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("n"), F.array().cast(f"array<{kind}>").alias("path")).alias("best"))
    state = state.withColumn("fresh", F.lit(True)).checkpoint()
    while True:
        step = state.where("fresh").join(arcs, F.col("node") == F.col("u"))
        step = step.select("source", F.col("v").alias("node"), F.struct((F.col("best.cost") + F.col("w")).alias("cost"), (F.col("best.n") + 1).alias("n"), F.concat("best.path", F.array("edge_id")).alias("path")).alias("new"))
        step = step.groupBy("source", "node").agg(F.min("new").alias("new"))
        joined = state.select("source", "node", "best").join(step, ["source", "node"], "full")
        better = F.col("best").isNull() | (F.col("new") < F.col("best"))
        state = joined.select("source", "node", F.when(better & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("best")).alias("best"), F.coalesce(better & F.col("new").isNotNull(), F.lit(False)).alias("fresh")).checkpoint()
        if state.where("fresh").isEmpty():
            break
    none = F.array().cast(f"array<{kind}>")
    hit = state.select(F.col("source").alias("_s"), F.col("node").alias("_d"), "best")
    out = pairs.join(hit, (F.col("source") == F.col("_s")) & (F.col("destination") == F.col("_d")), "left")
    return out.select("source", "destination", F.col("best.cost").alias("cost"), F.coalesce(F.col("best.path"), none).alias("path"))


def path_sums(paths: DataFrame, edges: DataFrame, criteria: list[str]) -> DataFrame:
    """Sums of edge attributes along each path; an empty path sums to 0."""
    keys = ["source", "destination"]
    steps = paths.select(*keys, F.explode("path").alias("edge_id")).join(edges.select("edge_id", *criteria), "edge_id")
    sums = steps.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in criteria))
    return paths.join(sums, keys, "left").na.fill(0, subset=criteria)


def od_assembly(points: DataFrame, edges: DataFrame, weight: str, criteria: list[str]) -> DataFrame:
    """Paths and sums of origin-destination rows, solved once for each distinct pair and joined back.

    Pairs without a path are left out.
    """
    pairs = points.select(F.col("origin").alias("source"), F.col("destination")).distinct()
    paths = shortest_paths(pairs, edges, weight).where("cost is not null")
    done = path_sums(paths, edges, criteria)
    done = done.select(F.col("source").alias("origin"), "destination", "path", F.col("cost").alias("least_cost"), *(F.col(c).alias(f"sum_{c}") for c in criteria))
    return points.join(done, ["origin", "destination"])


def simple_edges(edges: DataFrame) -> DataFrame:
    """Of parallel edges only the one with the greatest id."""
    ends = [F.least("from_node", "to_node").alias("_u"), F.greatest("from_node", "to_node").alias("_v")]
    kept = edges.groupBy(*ends).agg(F.max("edge_id").alias("edge_id")).select("edge_id")
    return edges.join(kept, "edge_id", "left_semi")


def route_with_failures(edges: DataFrame, failed: DataFrame, pairs: DataFrame, weight: str = "weight", drop: bool = False) -> DataFrame:
    """Paths when some edges fail: they are used only if there is no other way, or not at all."""
    gone = failed.select("edge_id", F.lit(True).alias("_gone")).distinct()
    e = simple_edges(edges).join(gone, "edge_id", "left")
    e = e.withColumn(weight, F.when(F.col("_gone"), F.lit(float("inf"))).otherwise(F.col(weight))).drop("_gone")
    return shortest_paths(pairs, e, weight, drop_infinite=drop)


def failure_samples(edges: DataFrame, samples: int, size: int, seed: int = 0) -> DataFrame:
    """``sample, edge_id``: for each sample the ``size`` edges with the smallest hashes, the same in every run."""
    from pyspark.sql import Window as W

    total = edges.count()
    share = min(1.0, (size + 8 * size**0.5 + 20) / max(total, 1))  # enough of them with hardly any to spare
    dice = F.xxhash64("edge_id", "sample", F.lit(seed))
    rows = edges.select("edge_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).withColumn("_d", dice)
    few = rows.where(F.pmod("_d", F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    low = F.pmod(F.col("_d"), F.lit(1 << 30))
    return few.withColumn("_r", F.row_number().over(W.partitionBy("sample").orderBy(low, "edge_id"))).where(F.col("_r") <= size).select("sample", "edge_id")


def sampled_routes(edges: DataFrame, failures: DataFrame, source, destination, weight: str = "weight") -> DataFrame:
    """``sample, cost, path`` of one pair under each sample of failed edges."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in simple_edges(edges).select("edge_id", "from_node", "to_node", F.col(weight).cast("double")).limit(BROADCAST_EDGES + 1).collect()])
    if len(shared.value) > BROADCAST_EDGES:
        raise ValueError("the graph is too large to be sent to the executors")
    kind = edges.schema["edge_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost, path = [], []
            for gone in b.column("gone").to_pylist():
                out = set(gone)
                graph = Graph([(e, u, v, float("inf") if e in out else w) for e, u, v, w in shared.value])
                best = graph.paths(source, {destination}).get(destination)
                cost.append(best[0] if best else None)
                path.append(list(best[1]) if best else [])
            yield pa.RecordBatch.from_arrays([b.column("sample"), pa.array(cost, pa.float64()), pa.array(path, b.schema.field("gone").type)], ["sample", "cost", "path"])

    return failures.groupBy("sample").agg(F.collect_list("edge_id").alias("gone")).mapInArrow(run, f"sample int, cost double, path array<{kind}>")


__all__ = ["Graph", "costs_by_rounds", "failure_samples", "od_assembly", "path_sums", "relaxed_paths", "route_with_failures", "sampled_routes", "shortest_paths", "simple_edges"]
