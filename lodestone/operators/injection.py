"""Which matched concepts are worth telling a model: tiers, pruning, conflicts with the data, and strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import case_chain, contains_any

#: Names of concepts that any model knows.
COMMON = [
    "year", "month", "day", "date", "time", "hour", "minute", "second", "week", "quarter", "timestamp", "datetime", "period",
    "id", "name", "title", "label", "code", "key", "index", "number", "identifier", "uuid", "guid",
    "country", "region", "city", "state", "province", "address", "location", "area", "zone", "territory",
    "count", "total", "sum", "average", "mean", "median", "max", "min", "percent", "percentage", "ratio", "rate", "proportion",
    "status", "type", "category", "class", "group", "flag", "active", "enabled", "disabled", "valid", "invalid",
    "description", "comment", "note", "notes", "text", "content", "message", "remark", "summary",
    "file", "path", "url", "link", "image", "photo", "document", "user", "username", "email", "phone", "password", "role",
    "size", "length", "width", "height", "weight", "quantity", "amount", "value", "price", "cost", "score", "level",
]
#: Words of domain terms, and words of names that tell entities.
TERMS = [
    "revenue", "profit", "margin", "ebitda", "roi", "roe", "eps", "market_cap", "volatility", "dividend", "yield",
    "open", "high", "low", "close", "volume", "adj_close", "bid", "ask", "spread", "return",
    "esg", "environmental", "social", "governance", "carbon", "emission", "sustainability", "renewable",
    "latency", "throughput", "bandwidth", "cpu", "gpu", "memory",
    "diagnosis", "treatment", "dosage", "symptom", "patient", "icu", "hospital", "mortality", "incidence", "prevalence",
    "hypothesis", "experiment", "variable", "control", "sample",
]
ENTITIES = ["ticker", "symbol", "stock", "company", "organization", "brand", "product", "sku", "isin", "cusip", "lei"]
#: Endings that are cut off a name, one after the other.
ENDINGS = ["_id", "_name", "_code", "_type", "_date", "_time", "s"]
#: Words of which a concept's name must hold at least one other to be worth telling.
GENERIC = [
    "id", "identifier", "key", "code", "index", "number", "serial", "uuid", "guid", "hash",
    "date", "time", "timestamp", "year", "month", "day", "hour", "minute", "second", "week", "quarter", "period",
    "name", "label", "title", "description", "comment", "note", "text", "string", "value", "type", "category", "class", "group", "status", "state", "flag", "tag",
    "count", "total", "sum", "amount", "quantity", "size", "length", "width", "height", "weight",
    "country", "city", "region", "location", "address", "zip", "postal", "latitude", "longitude", "boolean", "true", "false", "yes", "no",
    "record", "row", "column", "field", "entry", "item", "data", "information", "result", "output", "input",
]
#: Words of domains, of which a column and its concept must share one.
DOMAINS = {
    "temporal": ["date", "time", "year", "month", "day", "hour", "timestamp", "period", "duration"],
    "geographic": ["country", "city", "region", "province", "address", "location", "lat", "lon", "line"],
    "financial": ["price", "amount", "revenue", "profit", "cost", "market", "stock", "balance", "open", "high", "low", "close", "vol", "ticker", "dividend"],
    "biological": ["species", "genus", "gene", "protein", "organism", "cell"],
    "demographic": ["age", "gender", "race", "ethnicity", "education", "income"],
    "meteorology": ["weather", "climate", "temperature", "pressure", "humidity", "wind", "precipitation", "storm", "hurricane", "system", "forecast"],
}
PLACES = ["line", "border", "coast", "ocean", "sea"]
#: What a word of a concept lets expect of its column, in the order in which they are tried: word, types, kind, least, most.
EXPECTED = [
    ("price", ["float64", "int64", "float"], "numeric", None, None), ("amount", ["float64", "int64", "float"], "numeric", None, None),
    ("rate", ["float64", "float"], "numeric", None, None), ("percentage", ["float64", "float"], "numeric", 0.0, 100.0),
    ("count", ["int64", "int"], "numeric", None, None), ("year", ["int64", "int"], "numeric", 1900.0, 2100.0), ("age", ["int64", "float64"], "numeric", 0.0, 150.0),
    ("name", ["object", "str", "string"], "text", None, None), ("description", ["object", "str", "string"], "text", None, None),
    ("code", ["object", "str", "string"], "text", None, None), ("category", ["object", "str", "string"], "text", None, None),
    ("date", ["datetime64", "object"], "datetime", None, None), ("timestamp", ["datetime64", "int64"], "datetime", None, None),
    ("flag", ["bool", "int64"], "boolean", None, None), ("active", ["bool", "int64"], "boolean", None, None),
]
#: The names that expectations use for the data types of profiles.
NUMPY = {"integer": "int64", "float": "float64", "boolean": "bool", "datetime": "datetime64", "string": "object"}


def bare_name(c: Column) -> Column:
    """The name without endings and underscores; an ending is cut only if something is left."""
    for ending in ENDINGS:
        c = F.regexp_replace(c, f"(?s)(?<=.){ending}$", "")
    return F.translate(c, "_", "")


def tier(c: Column, common: Sequence[str] = COMMON, entities: Sequence[str] = ENTITIES, terms: Sequence[str] = TERMS) -> Column:
    """tier_0: common sense, tier_2: entities, tier_1: domain terms, else unknown; the lists may be replaced."""
    name = F.lower(F.trim(c))
    return case_chain([(name.isin(list(common)) | bare_name(name).isin(list(common)), "tier_0"), (contains_any(name, list(entities)), "tier_2"), (contains_any(name, list(terms)), "tier_1")], "unknown")


def tier_filter(matches: DataFrame, **lists: Sequence[str]) -> DataFrame:
    """matches (display_name, score, ...) with tier, should_inject, injection_weight and filter_reason; ``lists`` as ``tier`` takes them."""
    score = F.coalesce("score", F.lit(0.0))
    known = matches.withColumn("tier", tier(F.col("display_name"), **lists))
    weight = F.when(F.col("tier") == "tier_0", 0.0).when(F.col("tier") == "tier_1", 0.8).when(F.col("tier") == "tier_2", 1.0).when(score > 0.7, F.least(F.lit(1.0), score)).otherwise(0.5)
    keep = F.when(F.col("tier") == "tier_0", False).when(F.col("tier") == "unknown", score > 0.5).otherwise(True)
    reason = case_chain([
        (F.col("tier") == "tier_0", "Common sense concept (LLM already knows)"), (F.col("tier") == "tier_1", "Domain-specific term (valuable)"),
        (F.col("tier") == "tier_2", "Entity linking candidate (high value)"),
    ], F.format_string("Unknown concept (score-based: %.2f)", score))
    return known.withColumns({"should_inject": keep, "injection_weight": weight, "filter_reason": reason})


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(F.trim(c)), "_-", "  "), r"\s+"), lambda x: x != "")


def has_domain_attributes() -> Column:
    """Whether a concept has attributes of a domain: metadata (JSON) with a subdomain, unit, expected type, parent or a domain of its own."""
    told = lambda path: F.coalesce(F.get_json_object("metadata", path), F.lit("")) != ""
    own = ~F.lower(F.coalesce(F.get_json_object("metadata", "$.domain"), F.lit(""))).isin("", "general", "common")
    return told("$.subdomain") | told("$.unit") | told("$.expected_data_type") | own | told("$.hierarchy.parent")


def novelty(definition: Column, aliases: Column) -> Column:
    """0 to 0.95 for names of several words, long definitions, aliases and attributes of a domain."""
    n_words = F.size(F.filter(F.split(F.col("display_name"), r"\s+"), lambda x: x != ""))
    by_name = F.when(n_words >= 3, 30).when(n_words == 2, 15).otherwise(0)
    by_text = F.when(F.length(definition) > 50, 30).when(F.length(definition) > 20, 15).otherwise(0)
    by_alias = F.when(F.size(aliases) >= 2, 20).when(F.size(aliases) == 1, 10).otherwise(0)
    return (by_name + by_text + by_alias + F.when(has_domain_attributes(), 20).otherwise(0)) / 100


def prune(matches: DataFrame, least_novelty: float = 0.3, generic_score: float = 0.9, generic_words: Sequence[str] = GENERIC) -> DataFrame:
    """matches (id, display_name, definition, aliases, metadata, score) with generic, novelty and keep."""
    definition, aliases = F.coalesce("definition", F.lit("")), F.coalesce("aliases", F.array().cast("array<string>"))
    words = F.array(*map(F.lit, generic_words))
    only = lambda c: (F.size(name_tokens(F.col(c))) > 0) & (F.size(F.array_except(name_tokens(F.col(c)), words)) == 0)
    generic = only("display_name") | only("id")
    obvious = (F.coalesce("score", F.lit(0.0)) >= generic_score) & ~has_domain_attributes()
    scored = matches.withColumns({"generic": generic, "novelty": novelty(definition, aliases)})
    return scored.withColumn("keep", ~F.col("generic") & ~obvious & (F.col("novelty") >= least_novelty))


def domains_of(c: Column) -> Column:
    """The domains of which the text holds a word, letter case ignored; _ counts as a letter."""
    return F.array_compact(F.array(*[F.when(c.rlike(r"(?i)\b(" + "|".join(words) + r")\b"), d) for d, words in DOMAINS.items()]))


def expectation(concept: Column, expected: Sequence[tuple] = EXPECTED) -> Column:
    """What the concept lets expect: word, types, kind, low, high; of an equal word, else of the first that it contains; else null."""
    made = [F.struct(F.lit(w).alias("word"), F.array(*map(F.lit, types)).alias("types"), F.lit(kind).alias("kind"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")) for w, types, kind, low, high in expected]
    return case_chain([(concept == e[0], m) for e, m in zip(expected, made, strict=True)] + [(F.contains(concept, F.lit(e[0])), m) for e, m in zip(expected, made, strict=True)])


def _conflict(condition: Column, kind: str, penalty: int, reason: str) -> Column:
    return F.when(condition, F.struct(F.lit(penalty).alias("percent"), F.lit(kind).alias("type"), F.lit(reason).alias("reason")))


def conflicts(matches: DataFrame, strict: bool = False, expected: Sequence[tuple] = EXPECTED) -> DataFrame:
    """matches with has_conflict, conflict_type, resolution, penalty, reason and adjusted_score.

    Input: display_name, score, and of the column's profile column_name, data_type, min, max, unique_count, unique_ratio, skewness.
    Types of profiles are taken under the names that expectations use. Penalties add up to 1 at most; above 0.5, or ``strict``, a match is
    rejected, above 0.2 its score is lowered.
    """
    concept, column = F.lower("display_name"), F.lower("column_name")
    m = matches.withColumns({"_hint": expectation(concept, expected), "_type": F.coalesce(case_chain([(F.col("data_type") == k, v) for k, v in NUMPY.items()]), "data_type", F.lit("unknown"))})
    hint, lo, hi = F.col("_hint"), F.col("min"), F.col("max")
    fits = F.exists(hint["types"], lambda t: F.contains(F.col("_type"), t))
    outside = (lo < hint["low"] * 0.5) | (hi > hint["high"] * 2)
    of_column, of_concept = domains_of(column), domains_of(concept)
    both = (F.size(of_column) > 0) & (F.size(of_concept) > 0)
    drift = both & F.array_contains(of_column, "temporal") & F.array_contains(of_concept, "geographic") & contains_any(concept, PLACES) & ~contains_any(column, PLACES)
    found = F.array_compact(F.array(
        _conflict(hint.isNotNull() & ~fits, "type_mismatch", 30, "data type is not the expected one"),
        F.coalesce(_conflict(outside, "range_violation", 30, "values lie outside the expected range"), _conflict((hint["word"] == "count") & (lo < 0), "range_violation", 20, "a count is negative")),
        F.coalesce(
            _conflict((hint["kind"] == "boolean") & (F.col("unique_count") > 3), "distribution_conflict", 25, "too many values for a flag"),
            _conflict((hint["word"] == "code") & (F.col("unique_ratio") < 0.5), "distribution_conflict", 20, "too few values for an identifier"),
            _conflict((hint["word"] == "price") & (F.col("skewness") < -1), "distribution_conflict", 15, "prices are skewed to the left"),
        ),
        F.coalesce(_conflict(drift, "domain_mismatch", 40, "concept has marks of a place"), _conflict(both & ~F.arrays_overlap(of_column, of_concept), "domain_mismatch", 50, "column and concept share no domain")),
        F.coalesce(
            _conflict(F.contains(concept, F.lit("years of schooling")) & (lo > 1900) & (hi < 2100), "semantic_conflict", 40, "values look like calendar years"),
            _conflict(F.contains(concept, F.lit("age")) & ((hi > 150) | (lo < 0)), "semantic_conflict", 40, "no human age"),
        ),
    ))
    m = m.withColumn("_found", found)
    total = F.least(F.lit(100), F.aggregate("_found", F.lit(0), lambda a, x: a + x["percent"]))
    # of equal penalties the first found counts
    worst = F.aggregate("_found", F.struct(F.lit(0).alias("percent"), F.lit("none").alias("type")), lambda a, x: F.when(x["percent"] > a["percent"], F.struct(x["percent"].alias("percent"), x["type"].alias("type"))).otherwise(a))
    m = m.withColumns({"_total": total, "has_conflict": F.size("_found") > 0, "conflict_type": worst["type"]})
    resolution = F.when(~F.col("has_conflict"), "accept").when((F.col("_total") > 50) | F.lit(strict), "reject").when(F.col("_total") > 20, "downweight").otherwise("accept")
    m = m.withColumns({"resolution": resolution, "penalty": F.col("_total") / 100, "reason": F.array_join(F.transform("_found", lambda x: x["reason"]), "; ")})
    adjusted = F.when(F.col("resolution") == "reject", 0.0).when(F.col("resolution") == "downweight", F.col("score") * (1 - F.col("penalty"))).otherwise(F.col("score"))
    return m.withColumn("adjusted_score", adjusted).drop("_hint", "_type", "_found", "_total")


def ranked_matches(matches: DataFrame, strict: bool = False) -> DataFrame:
    """matches with conflicts, filtered (rejected ones) and rank: within each column the best adjusted score first, of equal ones the better score before, then the name."""
    order = Window.partitionBy("column_name").orderBy(F.desc("adjusted_score"), F.desc("score"), "display_name")
    return conflicts(matches, strict).withColumns({"filtered": F.col("resolution") == "reject", "rank": F.row_number().over(order)})


def strengths(matches: DataFrame, exact: float = 0.9, related: float = 0.7, contextual: float = 0.5) -> DataFrame:
    """matches with conflicts, and semantic_strength from the score less the penalty; rejected ones are uncertain."""
    m = conflicts(matches).withColumn("lowered_score", F.col("score") * (1 - F.col("penalty")))
    strength = F.when(F.col("resolution") == "reject", "UNCERTAIN").when(F.col("lowered_score") >= exact, "EXACT").when(F.col("lowered_score") >= related, "RELATED").when(F.col("lowered_score") >= contextual, "CONTEXTUAL").otherwise("UNCERTAIN")
    return m.withColumn("semantic_strength", strength)


def summary(labelled: DataFrame, column: str, score: str | None = None) -> DataFrame:
    """label, n, share [, mean_score] of each label of classified rows."""
    extra = [F.avg(score).alias("mean_score")] if score else []
    counts = labelled.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"), *extra)
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")
