"""Rules on columns and their profiles: which need the concept graph, and how much of it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.quantiles import value_at_rank

#: Patterns of names that need no look-up, abbreviations, generic words and plain words.
SKIPPED = [
    r"^id$", r".*_id$", r".*id$", r".*_at$", r".*_date$", r".*_time$", r"^created.*$", r"^updated.*$", r"^deleted.*$", r"^timestamp$",
    r"^uuid$", r"^index$", r"^row_?num(ber)?$", r"^key$", r"^pk$", r"^fk$", r"^is_.*$", r"^has_.*$", r"^can_.*$", r"^should_.*$",
    r"^_.*$", r"^__.*$", r"^year$", r"^month$", r"^day$", r"^hour$", r"^minute$", r"^second$",
]
ABBREVIATIONS = ["vol", "temp", "qty", "amt", "val", "desc", "num", "cnt", "pct", "avg", "min", "max", "dt", "ts", "yr", "mo", "cat", "src", "dst", "txn", "acc", "bal", "ref"]
ANCHORS = ["price", "rate", "value", "score", "amount", "level", "status", "type", "category", "name", "code", "number", "date", "time", "count", "total", "average", "percent"]
PLAIN = [
    "id", "name", "date", "time", "year", "month", "day", "hour", "minute", "second", "email", "phone", "address", "city", "state", "country",
    "zip", "latitude", "longitude", "url", "image", "file", "path", "description", "notes", "created", "updated", "deleted", "active", "enabled",
]
#: How clear a type is, for the router.
CLARITY = {"datetime": 0.40, "date": 0.40, "time": 0.35, "email": 0.40, "url": 0.40, "phone": 0.35, "currency": 0.35, "percentage": 0.30, "integer": 0.20, "float": 0.15, "boolean": 0.35, "string": 0.10, "object": 0.10, "unknown": 0.0}
#: Dollars for a million tokens, in and out; other models count 1 and 3.
PRICES = {"gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.00, 30.00), "gpt-3.5-turbo": (0.50, 1.50), "claude-opus-4": (15.00, 75.00), "claude-sonnet-4": (3.00, 15.00), "claude-haiku-4": (0.25, 1.25)}

#: Models that count as dear.
EXPENSIVE = ["gpt-4o", "gpt-4-turbo", "claude-opus-4"]


def classify_columns(columns: DataFrame, skipped: Sequence[str] = SKIPPED, abbreviations: Sequence[str] = ABBREVIATIONS, anchors: Sequence[str] = ANCHORS, plain: Sequence[str] = PLAIN) -> DataFrame:
    """column_name, problem, confidence from the name, and where given unique_ratio and code_share (share of entity codes in samples).

    The patterns of names that are skipped, abbreviations, anchors and plain names may be replaced or added to.
    """
    name = F.lower(F.trim("column_name"))
    ratio = F.col("unique_ratio") if "unique_ratio" in columns.columns else F.lit(0.0)
    codes = F.col("code_share") if "code_share" in columns.columns else F.lit(0.0)
    skip = reduce(Column.__or__, [name.rlike(p if p.startswith("^") else "^" + p) for p in skipped])
    holds = reduce(Column.__or__, [F.contains(name, F.lit(w)) for w in anchors])
    rules = [
        (skip, "skip_kg", 0.95), (name.isin(list(abbreviations)), "abbreviation", 0.85), ((F.length(name) <= 4) & ~name.isin(list(plain)), "abbreviation", 0.70),
        ((ratio > 0.8) & (codes >= 0.5), "entity_linking", 0.80), (name.isin(list(anchors)), "domain_anchoring", 0.75), (holds, "domain_anchoring", 0.65),
    ]
    out = F.when(*_case(rules[0]))
    for r in rules[1:]:
        out = out.when(*_case(r))
    result = out.otherwise(F.struct(F.lit("semantic_search").alias("problem"), F.lit(0.60).alias("confidence")))
    return columns.select("column_name", result.alias("r")).select("column_name", "r.problem", "r.confidence", (F.col("r.problem") != "skip_kg").alias("query_kg"))


def _case(rule: tuple[Column, str, float]) -> tuple[Column, Column]:
    return rule[0], F.struct(F.lit(rule[1]).alias("problem"), F.lit(rule[2]).alias("confidence"))


def route(profiles: DataFrame, samples: int = 3, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """column_name, confidence, policy, max_concepts from column profiles: clear columns need fewer concepts."""
    clear = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CLARITY.items() for x in kv]), F.col("data_type")), F.lit(0.05))
    quality = F.when(F.col("null_rate") < 0.05, 0.15).when(F.col("null_rate") < 0.20, 0.075).otherwise(0.0)
    unique = F.when((F.col("unique_ratio") > 0.01) & (F.col("unique_ratio") < 0.90), 0.10).otherwise(0.0)
    shape = F.when(F.coalesce("mean", "median", "std", "min", "max").isNotNull(), 0.15).otherwise(0.0)
    seen = F.when(F.col("total_count") - F.col("null_count") >= samples, 0.10).otherwise(0.0)
    span = F.when(F.col("min").isNotNull() & F.col("max").isNotNull(), 0.05).otherwise(0.0)
    scored = profiles.withColumn("confidence", F.round(F.least(F.lit(1.0), clear + quality + unique + shape + seen + span), 6))
    policy = F.when(F.col("confidence") > high, "MINIMAL").when(F.col("confidence") < low, "FULL").otherwise("STANDARD")
    return scored.select("column_name", "confidence", policy.alias("policy"), F.when(policy == "MINIMAL", 1).when(policy == "FULL", 3).otherwise(2).alias("max_concepts"))


def with_cost(calls: DataFrame) -> DataFrame:
    """Calls (model, input_tokens, output_tokens, ...) with cost_usd."""
    price = lambda i, default: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[i])]), F.col("model")), F.lit(default))
    return calls.withColumn("cost_usd", F.col("input_tokens") / 1e6 * price(0, 1.0) + F.col("output_tokens") / 1e6 * price(1, 3.0))


def cost_summary(calls: DataFrame) -> DataFrame:
    """component, model, calls, tokens, cost, hit rate: by component, by model, and over all (nulls), in one pass."""
    c = with_cost(calls)
    figures = [F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.avg(F.when(F.col("cached"), 1.0).otherwise(0.0)).alias("hit_rate")]
    return c.groupingSets([[F.col("component")], [F.col("model")], []], "component", "model").agg(*figures)


def recommendations(summary: DataFrame) -> DataFrame:
    """component, model, advice from a cost summary: few cache hits, dear models, long prompts, and a component with most of the cost."""
    whole = summary.where("component is null and model is null").select(F.col("calls").alias("all_calls"), F.col("tokens").alias("all_tokens"), F.col("cost_usd").alias("all_cost"), F.col("hit_rate").alias("all_hits"))
    s = summary.crossJoin(F.broadcast(whole))  # one row
    total = F.col("component").isNull() & F.col("model").isNull()
    advice = F.array_compact(F.array(
        F.when(total & (F.col("all_hits") < 0.3) & (F.col("all_calls") > 10), "low cache hit rate"),
        F.when(total & (F.col("all_tokens") > 3000 * F.col("all_calls")), "high average tokens per call"),
        F.when(F.col("model").isin(*EXPENSIVE) & (F.col("calls") > 5), "consider a cheaper model"),
        F.when((F.col("component") == "semantic_profiler") & (F.col("cost_usd") > F.col("all_cost") * 0.5), "use batch processing"),
    ))
    return s.select("component", "model", F.explode(advice).alias("advice"))


def unexpired(entries: DataFrame, now: Column, hours: float) -> DataFrame:
    """Cache entries no older than ``hours``."""
    return entries.where(F.col("ts").cast("timestamp").cast("double") >= now.cast("timestamp").cast("double") - hours * 3600)


def need_graph(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns to look up in the graph, and columns to skip."""
    return classified.where("query_kg"), classified.where("not query_kg")


def injected(matches: DataFrame, routed: DataFrame) -> DataFrame:
    """Of the matches (column_name, concept, score) of each column as many of the best as its route allows."""
    w = Window.partitionBy("column_name").orderBy(F.desc("score"), "concept")
    ranked = matches.join(routed.select("column_name", "max_concepts"), "column_name").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.col("max_concepts")).drop("max_concepts")


def cache_key(*parts: Column) -> Column:
    """The key of a cache entry: the MD5 of its parts."""
    return F.md5(F.concat_ws("\x1f", *parts))


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (key, value, ts) with new ones in the place of older ones with their key."""
    return entries.unionByName(new).groupBy("key").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "value")).alias("e")).select("key", "e.*")


def evicted(entries: DataFrame, most_bytes: int, share: float = 0.2) -> DataFrame:
    """Entries (key, value, ts) without the oldest if all together are larger than ``most_bytes``: up to the time at which a fifth, one at least, is reached.

    That time is found exactly by counting entries in ever narrower spans of time, so entries are never sorted in one task.
    """
    # a time without zone is counted as it is: in a zone, hours could come twice
    ntz = entries.schema["ts"].dataType.typeName() == "timestamp_ntz"
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if ntz else F.unix_micros(F.col("ts").cast("timestamp"))
    size, n = entries.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)), F.count(ts)).collect()[0]  # one row
    if size <= most_bytes:
        return entries
    if not n:
        return entries.where("false")
    return entries.where(ts > value_at_rank(entries, ts, max(1, math.ceil(Decimal(str(share)) * n))))


def cache_statistics(accesses: DataFrame) -> DataFrame:
    """cache, hits, misses, hit_rate from accesses (cache, hit)."""
    a = accesses.groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return a.withColumn("hit_rate", F.col("hits") / (F.col("hits") + F.col("misses")))
