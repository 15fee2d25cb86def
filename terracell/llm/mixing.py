"""Mixing sources to target weights.

Every source is cut into hashed blocks. Whole passes over a source and, for what remains of its
target, a prefix of its permuted blocks give each source an exact quota of block draws; a
splitting tree then parts the quotas among output shards: in each node the draws are ranked by a
seeded hash and cut at the left child's capacity, which draws the vector of source counts from
the multivariate hypergeometric distribution. The last block of a source is cut at a hash, so
that the decision for a document depends on its source, its hash and a small plan only.

Nothing that grows with the documents is ordered as a whole. Block sums are aggregated
before any shuffle; a source that holds a third of all rows is spread over its blocks.

Defined results: null text has size 0; null source is a source of its own, last in order; rows
of equal id and text are told apart only by their number, so that as many are taken as come nearest; a source without words has target 0;
an empty table gives no rows. Extra columns are kept by :func:`mixed_rows` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terracell.llm.shared import free_name, materialise, n_words_of

BLOCKS, SHARDS, SEED, CAP, WEIGHTS = 256, 16, 7, 3, (1, 2, 3)
#: Parts that equal rows at a cut are counted by, and ranges that draws are ranked in.
PARTS, PART_BITS = 256, 8


def place_of(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The place of a document in the permutation of its source. Only rows of equal id and text share one."""
    return F.xxhash64(doc_id, text, F.lit(seed))


def block_of(place: Column) -> Column:
    return F.pmod(F.shiftright(place, 40), F.lit(BLOCKS)).cast("int")


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` to these and ``target``: shares by weight, filled up to the caps."""
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("double").alias("w"), (cap * F.col("source_size")).cast("double").alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    rows = rows.select("*", level.alias("level"))
    full = F.col("level") * F.col("w") >= F.col("cap")
    rest = F.min(F.when(~full, F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(every)["level"]
    return rows.select("source", "source_size", F.when(full, F.col("cap")).otherwise(rest * F.col("w")).alias("target"))


def sized_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    place = place_of(F.col("doc_id"), F.col("text"), seed)
    return docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), place.alias("place"), block_of(place).alias("block"))


def split_tree(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds ``shard``: block draws are parted over a binary tree, node by node.

    A draw's rank in its node is its rank among those whose hash begins alike, after the counts of
    the lower beginnings, so no task ranks a whole node.
    """
    draws, level = draws.withColumn("shard", F.lit(0)), 0
    while (1 << level) < shards:
        draws = draws.withColumn("dice", F.xxhash64("source", "block", "copy", F.lit(seed), F.lit(level)))
        draws = draws.withColumn("part", F.shiftright("dice", 64 - PART_BITS))
        counts = draws.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        node = W.partitionBy("shard")
        lower = F.coalesce(F.sum("n").over(node.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("shard", "part", lower.alias("lower"), F.sum("n").over(node).alias("all"))
        rank = F.col("lower") + F.row_number().over(W.partitionBy("shard", "part").orderBy("dice", F.col("source"), "block", "copy"))
        draws = draws.join(counts, ["shard", "part"])
        right = rank > F.ceil(F.col("all") / 2)
        draws, level = draws.select("source", "block", "copy", (F.col("shard") * 2 + right.cast("int")).alias("shard")), level + 1
    return draws


def mix_plan(sized: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``source, block, source_size, target, passes, cut, tie, shards`` for every block.

    ``passes``: how often the whole block is taken. ``cut``: null, or the greatest place that is
    taken once more. ``tie``: null, or the place of several equal rows of which some are. ``shards``: the shard of each draw, whole passes first.
    """
    blocks = materialise(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    order = W.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block").rowsBetween(W.unboundedPreceding, -1)
    b = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "block", "words", "source_size", "target", "whole", "rest")
    b = b.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    b = b.withColumn("again", ((F.col("before") + F.col("words") <= F.col("rest")) & (F.col("words") > 0)).cast("int"))
    b = materialise(
        b.withColumn("edge", F.when((F.col("again") == 0) & (F.col("before") < F.col("rest")) & (F.col("words") > 0), F.col("rest") - F.col("before"))),
        "mix-quotas",
    )
    # In the one block of each source that is cut, places are taken in order up to what is nearest to the rest.
    edges = b.where("edge is not null").select("source", "block", "edge")
    cut = sized.alias("s").join(edges.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.block") == F.col("e.block")))
    cut = cut.select("s.source", "s.block", "edge", "place", "size").groupBy("source", "block", "edge", "place").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Of equal rows as many are taken as come nearest; a place is taken whole if all of its rows are.
    some = F.when(F.col("size") > 0, F.floor((F.col("edge") - F.col("before")) * F.col("rows") / F.col("size") + F.lit(0.5))).when(F.col("before") <= F.col("edge"), F.col("rows")).otherwise(0)
    cut = cut.withColumn("before", before).withColumn("some", some).where("some > 0")
    whole, part = F.when(F.col("some") >= F.col("rows"), F.col("place")), F.when(F.col("some") < F.col("rows"), F.struct("place", "some"))
    cut = cut.groupBy("source", "block").agg(F.max(whole).alias("cut"), F.min(part).alias("tie"))
    draws = b.withColumn("draws", F.col("whole") + F.col("again") + F.col("edge").isNotNull().cast("int")).where("draws > 0")
    draws = draws.select("source", "block", F.explode(F.expr("sequence(0, cast(draws - 1 as int))")).alias("copy"))
    draws = split_tree(draws, shards, seed).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("draws"))
    plan = b.alias("b")
    for name, side in (("c", cut), ("d", draws)):
        plan = plan.join(side.alias(name), F.col("b.source").eqNullSafe(F.col(f"{name}.source")) & (F.col("b.block") == F.col(f"{name}.block")), "left")
    return materialise(
        plan.select("b.source", "b.block", "source_size", "target", (F.col("whole") + F.col("again")).cast("long").alias("passes"), "cut", "tie", F.coalesce(F.col("draws.shard"), F.array().cast("array<int>")).alias("shards")),
        "mix-plan",
    )


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``row, place, size`` and ``source`` with ``plan`` (their block's) and ``times``. The plan has sources x BLOCKS rows."""
    p = plan.select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), F.struct("source_size", "target", "passes", "cut", "tie", "shards").alias("plan"))
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("plan_source")) & (block_of(F.col("place")) == F.col("plan_block")), "left").drop("plan_source", "plan_block")
    once_more = F.coalesce((F.col("place") <= F.col("plan.cut")).cast("long"), F.lit(0))
    done = lambda df, more: df.withColumn("times", F.col("plan.passes") + more)
    if plan.where("tie is not null").isEmpty():
        return done(joined, once_more)
    # Equal rows: parts of them are counted, and each part takes its share of the rows that are taken.
    tied = F.coalesce(F.col("place") == F.col("plan.tie.place"), F.lit(False))
    same = ["source", "place"]
    ties = materialise(joined.where(tied).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "mix-ties")
    counts = ties.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy(*same).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(F.col("source").alias("n_source"), F.col("place").alias("n_place"), F.col("part").alias("n_part"), "earlier")
    ties = ties.join(counts, F.col("source").eqNullSafe(F.col("n_source")) & (F.col("place") == F.col("n_place")) & (F.col("part") == F.col("n_part")))
    nth = F.col("earlier") + F.row_number().over(W.partitionBy(*same, "part").orderBy("size"))
    ties = done(ties, (nth <= F.col("plan.tie.some")).cast("long")).select(*rows.columns, "plan", "times")
    return done(joined.where(~tied), once_more).select(*rows.columns, "plan", "times").unionByName(ties)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, shards``."""
    sized = materialise(sized_rows(docs, seed), "mix-sized")
    rows = _with_plan(sized, mix_plan(sized, shards, seed))
    return rows.select(
        "doc_id", "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"),
        (F.col("size") * F.col("times")).alias("taken"),
        F.slice(F.col("plan.shards"), F.lit(1), F.col("times").cast("int")).alias("shards"),
    )


def mixed_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with ``_shard`` and ``_at``, its place in the shard.

    Where the table has columns of these names, those of the mix have an underscore more.
    """
    sized = materialise(sized_rows(docs, seed), "mix-sized")
    given = docs.select(F.struct("*").alias("row"), "source", place_of(F.col("doc_id"), F.col("text"), seed).alias("place"), F.lit(0).alias("size"))
    rows = _with_plan(given, mix_plan(sized, shards, seed)).where("times > 0")
    rows = rows.select("row", "place", F.posexplode(F.slice(F.col("plan.shards"), F.lit(1), F.col("times").cast("int"))).alias("copy", "shard"))
    at = F.xxhash64("place", "copy", "shard", F.lit(seed))
    return rows.select("row.*", F.col("shard").alias(free_name(docs.columns, "_shard")), at.alias(free_name(docs.columns, "_at")))


def shuffle_locally(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix with each shard's rows in one run of the output, in random order."""
    return rows.repartitionByRange(shards, "_shard", "_at").sortWithinPartitions("_shard", "_at").drop("_at")
