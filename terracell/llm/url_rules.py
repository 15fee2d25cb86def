"""URL filters: curated rules first, mined association rules for the rest.

Curated rules (host, path prefix, verdict) decide the URLs they fit. Those verdicts are the
labels: Spark's FP-growth mines combinations of URL tokens that imply a verdict. Rules pruned by
support and confidence are kept in an inverted index from each rule's rarest token to the rule;
a URL looks its tokens up, and the surest rule whose tokens it holds gives the verdict.

FP-growth returns at most ``2 ** tokens / MIN_SUPPORT`` itemsets, whatever the number of rows.
Up to ``MAX_LITERAL`` rules are compiled into the plan, so that judging a URL needs no shuffle;
more rules are joined on the token, once for each distinct token set.

Defined results: a URL that is null or has no ``://`` has an empty host and path, no tokens and
the default verdict; repeated rows are judged each; with no labelled rows no rule is mined; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MAX_LITERAL, DEFAULT = 0.05, 0.9, 1000, "allow"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path``; it fits the host and its subdomains where the path starts alike."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as ``struct<text, verdict>``, or null."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: domain suffixes, subdomain labels, path segments, extension, query keys."""
    labels = F.when(host == "", F.array().cast("array<string>")).otherwise(F.split(host, r"\."))
    suffix = F.transform(F.array(*(F.lit(n) for n in (1, 2, 3))), lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")))
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, r"[0-9]+", "#")))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&", -1)
    keys = F.transform(F.filter(query, lambda q: q != ""), lambda q: F.concat(F.lit("query:"), F.substring_index(q, "=", 1)))
    every = F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(suffix, segments, keys))
    return F.array_distinct(every)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens, label`` to rules ``tokens, label, confidence, support``."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "tokens array<string>, label string, confidence double, support double")
    if labelled.isEmpty():
        return empty
    mark = "label="
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    said = F.element_at("consequent", 1)
    return model.associationRules.where(said.startswith(mark) & ~F.exists("antecedent", lambda t: t.startswith(mark))).select(
        F.sort_array("antecedent").alias("tokens"), F.substr(said, F.lit(len(mark) + 1)).alias("label"), "confidence", "support"
    )


def _best(rules: Column) -> Column:
    """The surest rule: confidence, then support, then fewest tokens, then by name."""
    ranked = F.transform(rules, lambda r: F.struct(r["confidence"], r["support"], -F.size(r["tokens"]), r["label"].alias("label"), r["tokens"]))
    return F.array_max(ranked)["label"]


def judge_by_rules(rows: DataFrame, rules: DataFrame, max_literal: int = MAX_LITERAL) -> DataFrame:
    """Adds ``mined``: the label of the surest rule whose tokens a row's ``tokens`` hold, or null."""
    known = rules.limit(max_literal + 1).collect()
    if not known:
        return rows.withColumn("mined", F.lit(None).cast("string"))
    holds = lambda tokens, r: F.size(F.array_except(r["tokens"], tokens)) == 0
    if len(known) <= max_literal:
        uses: dict[str, int] = {}
        for r in known:
            for t in r["tokens"]:
                uses[t] = uses.get(t, 0) + 1
        index: dict[str, list[Column]] = {}
        for r in sorted(known, key=lambda r: (r["tokens"], r["label"])):
            rarest = min(r["tokens"], key=lambda t: (uses[t], t))
            literal = F.struct(F.array(*map(F.lit, r["tokens"])).alias("tokens"), F.lit(r["label"]).alias("label"), F.lit(r["confidence"]).alias("confidence"), F.lit(r["support"]).alias("support"))
            index.setdefault(rarest, []).append(literal)
        lookup = F.create_map(*(c for t, found in index.items() for c in (F.lit(t), F.array(*found))))
        none = F.slice(F.array(next(iter(index.values()))[0]), 1, 0)
        found = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.element_at(lookup, t), none)))
        return rows.withColumn("mined", _best(F.filter(found, lambda r: holds(F.col("tokens"), r))))
    sets = rows.select("tokens").distinct()
    ruled = rules.select(F.element_at("tokens", 1).alias("token"), F.struct("tokens", "label", "confidence", "support").alias("rule"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(ruled, "token").where(holds(F.col("tokens"), F.col("rule")))
    best = F.max(F.struct("rule.confidence", "rule.support", -F.size("rule.tokens"), "rule.label", "rule.tokens"))["label"]
    return rows.join(hits.groupBy("tokens").agg(best.alias("mined")), "tokens", "left")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page."""
    url = F.col("url")
    host, path = host_and_path(url)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    fits = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", fits.alias("fits"), tokens_of(url, F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(rows.where("fits is not null").select("tokens", F.col("fits.verdict").alias("label")), min_support, min_confidence)
    judged = judge_by_rules(rows, mined)
    return judged.select("page_id", "host", "path", F.col("fits.text").alias("rule"), F.coalesce(F.col("fits.verdict"), F.col("mined"), F.lit(default)).alias("verdict"))
