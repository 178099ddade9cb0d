"""Profiles and matches made small for prompts, and answers of models cut out, mended and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of compression; the higher, the less is kept.
NONE, LIGHT, BALANCED, AGGRESSIVE = range(4)
#: Words of column names that hint at a type.
NUMBER_WORDS = [
    "amount", "price", "cost", "revenue", "profit", "salary", "wage", "count", "number", "num", "total", "sum", "avg", "mean", "rate",
    "ratio", "percent", "score", "index", "quantity", "qty", "volume", "weight", "height", "width", "length", "area", "size", "age",
    "latitude", "longitude", "lat", "lng", "lon",
]
TIME_WORDS = ["date", "time", "year", "month", "day", "timestamp", "datetime", "created", "updated", "modified", "born", "start", "end"]


def cut_text(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def type_hint(name: Column) -> Column:
    """float64, datetime or string from the words of a name."""
    words = F.split(F.translate(F.lower(name), "_-", "  "), " ")
    holds = lambda hints: F.arrays_overlap(words, F.array(*map(F.lit, hints)))
    return F.when(holds(NUMBER_WORDS), "float64").when(holds(TIME_WORDS), "datetime").otherwise("string")


def compressed_profiles(profiles: DataFrame, level: int = BALANCED) -> DataFrame:
    """column_name, stats: what a level keeps of each profile (with samples), as a struct that JSON writes without nulls."""
    numeric = F.col("data_type").isin("integer", "float")
    kept = ["min", "max", "mean"] + (["std", "median"] if level < BALANCED else [])
    most = {NONE: None, LIGHT: 10, BALANCED: 5, AGGRESSIVE: 2}[level]
    samples = F.col("samples") if most is None else F.slice("samples", 1, most)
    rounded = [F.when(numeric, F.col(c) if level == NONE else F.bround(c, 2)).alias(c) for c in kept]
    return profiles.select("column_name", F.struct("column_name", "data_type", "null_count", "null_rate", "unique_count", "unique_ratio", *rounded, samples.alias("sample_values")).alias("stats"))


def compressed_matches(matches: DataFrame, level: int = BALANCED) -> DataFrame:
    """column_name, knowledge_graph: what a level keeps of each match, or null.

    matches: column_name, status, display_name, score, strength, tier, should_inject, description, aliases.
    """
    strength, tight = F.coalesce("strength", F.lit("CONTEXTUAL")), level >= AGGRESSIVE
    strong = strength.isin("EXACT", "RELATED")
    exact, related = cut_text(F.col("description"), 100 if tight else 300), cut_text(F.col("description"), 80 if tight else 150)
    other = cut_text(F.col("description"), 100) if level < BALANCED else F.lit(None).cast("string")
    told = F.when(strength == "EXACT", exact).when(strength == "RELATED", related).otherwise(other)
    none = F.lit(None).cast("string")

    def made(concept: Column, label: Column, tier: Column, description: Column, aliases: Column) -> Column:
        return F.struct(concept.alias("concept"), label.alias("strength"), F.bround(F.coalesce("score", F.lit(0.0)), 2).alias("score"), tier.alias("tier"), F.nullif(description, F.lit("")).alias("description"), aliases.alias("aliases"))

    no_aliases = F.lit(None).cast("array<string>")
    full = made(F.col("display_name"), strength, F.col("tier"), told, F.when(strong & (F.size("aliases") > 0), F.slice("aliases", 1, 5)))
    doubtful = made(F.coalesce("display_name", F.lit("unknown")), F.lit("UNCERTAIN"), none, F.lit("low confidence - use with caution"), no_aliases)
    gone = F.col("status").isin("no_match", "error", "skipped", "filtered") | ~F.coalesce("should_inject", F.lit(True))
    uncertain = F.when(F.lit(level < BALANCED), doubtful)
    out = F.when(gone, None).when(F.col("status") == "uncertain", uncertain).when(F.lit(tight) & ~strong, None).otherwise(full)
    return matches.select("column_name", out.alias("knowledge_graph"))


def prompt_batches(profiles: DataFrame, matches: DataFrame, level: int = BALANCED, per_batch: int = 20) -> DataFrame:
    """batch, prompt: columns (with place) dealt into batches, each a JSON list of what the level keeps of them."""
    kept = compressed_profiles(profiles, level).join(profiles.select("column_name", "place"), "column_name").join(compressed_matches(matches, level), "column_name", "left")
    entry = F.struct("place", F.struct(F.col("column_name").alias("column"), "stats", "knowledge_graph").alias("e"))
    rows = kept.groupBy(F.floor(F.col("place") / per_batch).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return rows.select("batch", F.to_json(F.transform("l", lambda x: x["e"])).alias("prompt"))


def extracted_json(c: Column) -> Column:
    """The JSON object in an answer: of a fence marked as JSON, else of any fence, else from the first to the last brace; null if none."""
    tries = [r"(?s)```json\s*(\{.*?\})\s*```", r"(?s)```\s*(\{.*?\})\s*```", r"(?s)(\{.*\})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in tries])


def extracted_array(c: Column) -> Column:
    """The JSON list in an answer, fences cut off; null if none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit(""))


def mended_json(c: Column, quotes: bool = False) -> Column:
    """From the first brace on, without commas before closing brackets, missing closing braces put in; ``quotes``: single quotes made double."""
    start = F.regexp_extract(c, r"(?s)(\{.*)", 1)
    last = F.regexp_extract(start, r"(?s)(\{.*\})", 1)
    count = lambda x, ch: F.length(x) - F.length(F.translate(x, ch, ""))
    whole = F.when((last != "") & (count(last, "{") == count(last, "}")), last).otherwise(F.concat(start, F.repeat(F.lit("}"), F.greatest(F.lit(0), count(start, "{") - count(start, "}")))))
    tidy = F.regexp_replace(whole, r",(\s*[}\]])", "$1")
    return F.nullif(F.translate(tidy, "'", '"') if quotes else tidy, F.lit(""))


#: What is looked at in an answer, by the column that holds it on the way.
PARTS = {
    "_profiles": "$.semantic_profiles", "_ufd": "$.ufd", "_sfd": "$.sfd", "_title": "$.ufd.title", "_core": "$.ufd.core_description.text",
    "_summary": "$.sfd.summary", "_metadata": "$.sfd.schema_metadata",
}


def validated(answers: DataFrame) -> DataFrame:
    """answers (id, answer, expected_columns) with json, problems (phrases) and valid."""
    # each step is a column of its own, so that a row's answer is cut out, parsed and, only if that fails, mended and parsed again once
    a = answers.withColumn("_cut", extracted_json(F.col("answer"))).withColumn("_parsed", F.try_parse_json("_cut"))
    a = a.withColumn("_mended", F.when(F.col("_parsed").isNull(), mended_json(F.col("answer")))).withColumn("_again", F.try_parse_json("_mended"))
    a = a.withColumn("json", F.when(F.col("_parsed").isNotNull(), F.col("_cut")).when(F.col("_again").isNotNull(), F.col("_mended"))).withColumn("_value", F.coalesce("_parsed", "_again"))
    a = a.withColumns({name: F.try_variant_get("_value", path, "string") for name, path in PARTS.items()})
    part = lambda path: F.col(next(name for name, p in PARTS.items() if p == path))
    empty = lambda path: F.coalesce(part(path), F.lit("")).isin("", "{}", "[]")
    profiles = F.coalesce(F.size(F.json_object_keys(part("$.semantic_profiles"))), F.lit(0))
    problems = F.array_compact(F.array(
        F.when(F.col("json").isNull(), "no JSON object"),
        *[F.when(part(f"$.{k}").isNull(), f"Missing top-level key: {k}") for k in ("semantic_profiles", "ufd", "sfd")],
        F.when(profiles != F.col("expected_columns"), "semantic_profiles count mismatch"), F.when(empty("$.ufd.title"), "UFD missing title"),
        F.when(empty("$.ufd.core_description.text"), "UFD missing core_description.text"), F.when(empty("$.sfd.summary"), "SFD missing summary"),
        F.when(empty("$.sfd.schema_metadata"), "SFD missing schema_metadata"),
    ))
    return a.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0).drop("_cut", "_parsed", "_mended", "_again", "_value", *PARTS)


def markdown(descriptions: DataFrame) -> DataFrame:
    """id, markdown of descriptions (id, summary, tags, core, synonyms, related, columns: list of column_name, concept_name, semantic_type, confidence, description)."""
    listed = lambda c: F.array_join(c, ", ")
    row = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["column_name"], x["concept_name"], x["semantic_type"], x["confidence"].cast("string"), x["description"]), F.lit(" |\n"))
    text = F.concat(
        F.lit("### Summary\n"), "summary", F.lit("\n\n### Domain Tags\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "),
        F.lit("\n\n### Keywords\n**Core**: "), listed("core"), F.lit("\n\n**Synonyms**: "), listed("synonyms"), F.lit("\n\n**Related**: "), listed("related"),
        F.lit("\n\n### Schema Metadata\n| Column | Concept | Type | Conf. | Description |\n|--------|---------|------|-------|-------------|\n"), F.array_join(F.transform("columns", row), ""),
    )
    return descriptions.select("id", text.alias("markdown"))
