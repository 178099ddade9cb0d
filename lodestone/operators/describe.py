"""From a table to its description: profiles, matches with concepts, what is worth telling of them, prompts, answers and their check."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import concepts as c
from lodestone.operators import details, extraction, generation, injection, prompts, relationships, rules
from lodestone.operators.profile import data_type


class Description(NamedTuple):
    """What was found of each column (columns), matches that are told, prompts (batch, prompt), answers with problems, and templates."""

    columns: DataFrame
    matches: DataFrame
    prompts: DataFrame
    answers: DataFrame | None
    users: DataFrame
    search: DataFrame


def extract(df: DataFrame, name: str, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, aliases and evidence of a table's columns."""
    p = details.full_profile(df, order)
    return extraction.concepts_of(p, name), extraction.aliases_of(p, name), extraction.evidence_of(p, details.sample_values(df, df.columns), name)


def matched_columns(profiles: DataFrame, known: DataFrame, aliases: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Matches of the columns that need a concept, with tier, conflicts and strength; others have the status skipped or no_match.

    known: id, display_name, definition. The best matches are told up to what the route of their column allows.
    """
    codes = details.code_shares(profiles.select("column_name", F.posexplode("samples").alias("p", "value")).select("column_name", (F.col("p") + 1).alias("place"), "value"))
    kinds = rules.classify_columns(profiles.join(codes, "column_name", "left").withColumn("code_share", F.coalesce("code_share", F.lit(0.0))))
    need, skip = rules.need_graph(kinds)
    found = c.match_columns(need.select("column_name"), known, aliases)
    told = found.join(known.select(F.col("id").alias("concept_id"), "display_name", "definition"), "concept_id", "left").withColumn("score", F.col("score") / 100)
    # rules on conflicts ask for the profile of the column
    asked = told.where("concept_id is not null").join(profiles.select("column_name", "data_type", "min", "max", "unique_count", "unique_ratio", "skewness"), "column_name")
    judged = injection.strengths(injection.tier_filter(asked))
    listed = aliases.groupBy("concept_id").agg(F.array_sort(F.collect_set("alias_text")).alias("aliases"))
    full = judged.join(listed, "concept_id", "left").select(
        "column_name", F.when(F.col("resolution") == "reject", "filtered").otherwise("matched").alias("status"), "concept_id", "display_name", "score", F.col("semantic_strength").alias("strength"),
        "tier", "should_inject", F.col("definition").alias("description"), "aliases",
    )
    bare = lambda rows, status: rows.select("column_name", F.lit(status).alias("status"))
    return full.unionByName(bare(told.where("concept_id is null"), "no_match"), allowMissingColumns=True).unionByName(bare(skip, "skipped"), allowMissingColumns=True)


def describe(df: DataFrame, name: str, order: list[str], known: DataFrame, aliases: DataFrame, model: generation.Model | None = None, level: int = prompts.BALANCED) -> Description:
    """All steps over one table; without a model the templates stand alone.

    The profile and the matches, a row for each column, are cached, as every step reads them.
    """
    p = details.full_profile(df, order).cache()
    matches = matched_columns(p, known, aliases).cache()
    batches = prompts.prompt_batches(p, matches, level)
    answers = None
    if model is not None:
        asked = generation.generate(batches.select(F.col("batch").alias("id"), "prompt"), model)
        sizes = p.groupBy(F.floor(F.col("place") / 20).cast("int").alias("id")).agg(F.count(F.lit(1)).alias("expected_columns"))
        answers = prompts.validated(asked.join(sizes, "id"))
    rows = p.select(F.lit(name).alias("dataset"), "place", "column_name", F.col("semantic_type").alias("domain"))
    users = generation.user_descriptions(rows)
    words = matches.where("status = 'matched'").select(F.lit(name).alias("dataset"), F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("keyword"))
    return Description(p, matches, batches, answers, users, generation.search_descriptions(users, words))


def relations(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """What hierarchies, foreign keys and dependencies say of each column of a table."""
    numeric = [f.name for f in df.schema.fields if data_type(f.dataType) in ("integer", "float")]
    return relationships.column_relations(profiles.select("column_name"), *relationships.detect(df, profiles, numeric))
