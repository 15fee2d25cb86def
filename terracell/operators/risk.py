"""Expected annual damages, scenario summaries, costs and benefits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expected_damage(df: DataFrame, group: list[str], probability: str, damage: str, out: str = "ead", threshold: float = 0.0) -> DataFrame:
    """Trapezoid integral of damage over probability for each group.

    With a threshold only smaller probabilities count. A single point counts half of its rectangle,
    none counts 0; every group of the input is in the result. Null groups are left out.
    """
    rows = df.where(" and ".join(f"`{g}` is not null" for g in group)).select(*group, F.col(probability).cast("double").alias("_p"), F.col(damage).cast("double").alias("_d"))
    use = (F.col("_p") < threshold) if threshold > 0 else F.lit(True)
    order = W.partitionBy(*group, "_use").orderBy("_p", "_d")
    rows = rows.withColumn("_use", use)
    area = (F.col("_p") - F.lag("_p").over(order)) * (F.col("_d") + F.lag("_d").over(order)) / 2
    rows = rows.withColumn("_area", area)
    n, single = F.sum(F.col("_use").cast("int")), F.max(F.when(F.col("_use"), F.col("_p") * F.col("_d") / 2))
    return rows.groupBy(*group).agg(F.when(n == 0, F.lit(0.0)).when(n == 1, single).otherwise(F.sum(F.when(F.col("_use"), F.col("_area")))).alias(out))


def simpson_weights(x: list[float]) -> list[float]:
    """Weights of the composite Simpson rule on uneven points; an odd last interval is corrected, two points are a trapezoid."""
    n, w = len(x), [0.0] * len(x)
    if n < 2:
        return w
    if n == 2:
        return [(x[1] - x[0]) / 2] * 2
    h = [b - a for a, b in zip(x, x[1:])]
    for k in range(0, (n - 1) // 2 * 2, 2):
        a, b = h[k], h[k + 1]
        w[k] += (a + b) / 6 * (2 - b / a)
        w[k + 1] += (a + b) ** 3 / (6 * a * b)
        w[k + 2] += (a + b) / 6 * (2 - a / b)
    if (n - 1) % 2:
        a, b = h[-2], h[-1]
        w[-1] += (2 * b * b + 3 * a * b) / (6 * (a + b))
        w[-2] += (b * b + 3 * a * b) / (6 * a)
        w[-3] -= b**3 / (6 * a * (a + b))
    return w


def expected_damage_simpson(wide: DataFrame, periods: list[float], prefix: str = "rp", out: str = "ead") -> DataFrame:
    """Adds the Simpson integral over columns ``rp<period>`` with probabilities ``1 / period``; null counts as 0."""
    order = sorted(periods, reverse=True)
    weights = simpson_weights([1 / p for p in order])
    value = F.lit(0.0)
    for p, w in zip(order, weights):
        value = value + F.lit(w) * F.coalesce(F.col(f"{prefix}{p:g}").cast("double"), F.lit(0.0))
    return wide.withColumn(out, value)


def pivot_periods(df: DataFrame, group: list[str], period: str, value: str, periods: list[float], prefix: str = "rp") -> DataFrame:
    """Sums for each return period as columns; a period without rows is 0."""
    p = F.col(period).cast("double")
    return df.groupBy(*group).agg(*(F.coalesce(F.sum(F.when(p == float(k), F.col(value))), F.lit(0.0)).alias(f"{prefix}{k:g}") for k in periods))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "key", value: str = "depth_m", positive: bool = True) -> DataFrame:
    """Wide hazards to long; rows without exposure are left out before and after."""
    clean = df.select(*ids, *(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns))
    if positive:
        clean = clean.where(F.greatest(*(F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)) > 0)
    long = clean.unpivot(ids, columns, name, value)
    return long.where(F.col(value) > 0) if positive else long


def summarise(df: DataFrame, group: list[str], low: str, high: str, total: str | None = None) -> DataFrame:
    """Least, greatest and (if asked) sum over each group."""
    aggregates = [F.min(low).alias(f"min_{low}"), F.max(high).alias(f"max_{high}")]
    return df.groupBy(*group).agg(*aggregates, *([F.sum(total).alias(f"sum_{total}")] if total else []))


def two_level(df: DataFrame, group: list[str], period: str, value: str, out: str) -> DataFrame:
    """Sums within a period, then the greatest of them."""
    return df.groupBy(*group, period).agg(F.sum(value).alias("_s")).groupBy(*group).agg(F.max("_s").alias(out))


def sum_by_others(df: DataFrame, value: str) -> DataFrame:
    """Sum of one column by all others; rows with a null among those are left out."""
    others = [c for c in df.columns if c != value]
    return df.na.drop(subset=others).groupBy(*others).agg(F.sum(value).alias(value))


def by_region(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Sum and mean over all levels of a hierarchy, with its totals."""
    return df.rollup(*levels).agg(F.sum(value).alias(f"sum_{value}"), F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles."""
    quartiles = [F.percentile(column, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), *quartiles, F.max(column).alias("max"))


def empirical_cdf(df: DataFrame, column: str, group: list[str]) -> DataFrame:
    """Adds ``cdf``: the share of the group's rows with at most the row's value.

    Equal values are counted before anything is ordered.
    """
    counts = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*group).orderBy(column)
    every = W.partitionBy(*group)
    return counts.select(*group, column, (F.sum("_n").over(order) / F.sum("_n").over(every)).alias("cdf"))


def trend(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Least squares line of each group."""
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def n_choose_k(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


# Adaptation


def discount_factors(spark: SparkSession, start: int, end: int, rate_percent: float) -> DataFrame:
    """``year, year_from_start, factor`` for every year, both ends included."""
    years = spark.range(start, end + 1).select(F.col("id").cast("int").alias("year"), (F.col("id") - start).cast("int").alias("year_from_start"))
    return years.withColumn("factor", F.lit(1.0) / F.pow(F.lit(1 + rate_percent / 100), F.col("year_from_start")))


def total_discount(start: int, end: int, rate_percent: float) -> float:
    return math.fsum((1 + rate_percent / 100) ** -(y - start) for y in range(start, end + 1))


def present_costs(options: DataFrame, start: int, end: int, rate_percent: float, every: int = 5) -> DataFrame:
    """Present value of initial, routine and periodic costs per km of each kind of option.

    Initial costs fall in the first year, routine costs in all, periodic ones in every fifth but the first.
    """
    # the years are a fixed, small list: an explode, not a join
    years = F.explode(F.sequence(F.lit(0), F.lit(end - start)))
    rows = options.select("*", years.alias("_y")).withColumn("_f", F.lit(1.0) / F.pow(F.lit(1 + rate_percent / 100), F.col("_y")))
    due = (F.col("_y") > 0) & (F.col("_y") % every == 0)
    out = rows.groupBy("kind").agg(
        F.sum(F.when(F.col("_y") == 0, F.col("initial_cost_usd_per_km")).otherwise(0.0)).alias("initial_cost_usd_per_km"),
        F.sum(F.col("_f") * F.col("routine_usd_per_km")).alias("routine_usd_per_km"),
        F.sum(F.when(due, F.col("_f") * F.col("periodic_usd_per_km")).otherwise(0.0)).alias("periodic_usd_per_km"),
    )
    return out.withColumn("total_cost_usd_per_km", F.col("initial_cost_usd_per_km") + F.col("routine_usd_per_km") + F.col("periodic_usd_per_km"))


def benefit_cost(roads: DataFrame, costs: DataFrame, discount: float) -> DataFrame:
    """Adds costs of adapting the flooded length, the benefit of avoided damage, and their ratio."""
    out = roads.join(costs.select("kind", "total_cost_usd_per_km"), "kind")
    cost, benefit = F.col("total_cost_usd_per_km") / 1e3 * F.col("flood_length_m"), F.col("ead_usd") * F.lit(discount)
    return out.withColumns({"total_adaptation_cost_usd": cost, "total_adaptation_benefit_usd": benefit}).withColumn("bcr", F.try_divide("total_adaptation_benefit_usd", "total_adaptation_cost_usd"))


# Keys


def scenario_columns(key: Column, pattern: str, names: list[str]) -> list[Column]:
    """The groups of a pattern in a scenario key as columns; null where it isn't found."""
    return [F.nullif(F.regexp_extract(key, pattern, k + 1), F.lit("")).alias(n) for k, n in enumerate(names)]


def period_number(text: Column) -> Column:
    """``00250`` or ``0_5`` as a number."""
    return F.ltrim(F.replace(text, F.lit("_"), F.lit(".")), F.lit("0")).try_cast("double")


def layer_key(columns: list[str]) -> Column:
    """``a:1|b:2`` from metadata columns in order of their names; the path if there are none."""
    if not columns:
        return F.col("path")
    return F.concat_ws("|", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in sorted(columns)))


def hazard_attributes(files: DataFrame, hazards: DataFrame) -> DataFrame:
    """Scenario attributes of hazard files, by the part of their name around ``1in``, and the thresholds in it."""
    stem = F.regexp_extract("file_name", r"([^_]+_[^_]*1in[^_]*)", 1)
    low, high = (F.regexp_extract("file_name", r"(\d+)-(\d+)", k).try_cast("int") for k in (1, 2))
    keyed = files.select("*", stem.alias("_stem"), low.alias("min_hazard"), high.alias("max_hazard"))
    return keyed.join(hazards.withColumnRenamed("file_name", "_stem"), "_stem", "left").drop("_stem")
