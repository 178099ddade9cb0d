"""Concepts, aliases and evidence from column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import case_chain, contains_any, identifier

#: The kind of concept of each semantic type; all others are dimensions.
KINDS = {"metric": "metric", "ratio": "metric", "count": "metric", "numerical": "numerical", "identifier": "identifier", "temporal": "temporal", "spatial": "spatial", "categorical": "categorical"}
#: Words of a column's name that tell its domain, in the order in which they are tried.
DOMAIN_WORDS = [
    ("finance", ["revenue", "profit", "sales", "income", "earnings", "cash", "asset", "liability", "equity", "dividend", "margin"]),
    ("healthcare", ["patient", "diagnosis", "treatment", "symptom", "disease", "hospital", "doctor", "medicine", "health"]),
    ("education", ["student", "grade", "course", "school", "teacher", "education"]),
]


def dataset_id(name: str) -> Column:
    return F.concat(F.lit("ds_"), F.substring(F.md5(F.lit(name)), 1, 8))


def concept_kind(semantic_type: Column) -> Column:
    return case_chain([(semantic_type == k, v) for k, v in KINDS.items()], "dimension")


def concepts_of(profiles: DataFrame, dataset: str) -> DataFrame:
    """id, canonical_name, concept_type, domain, definition, data_type, unit, range_min, range_max, tags, confidence, source.

    profiles: column_name, data_type, semantic_type, unit, min, max.
    """
    name, source = identifier(F.col("column_name")), dataset_id(dataset)
    domain = case_chain([(contains_any(F.lower("column_name"), words), d) for d, words in DOMAIN_WORDS], "general")
    kind = concept_kind(F.col("semantic_type"))
    measured = F.coalesce(F.concat(F.lit(", measured in "), F.col("unit")), F.lit(""))
    told = F.concat(F.lit("A "), F.col("semantic_type"), F.lit(" field representing "), F.col("column_name"), measured, F.lit(". Data type: "), F.col("data_type"), F.lit("."))
    return profiles.select(
        F.concat(name, F.lit("_"), source).alias("id"), name.alias("canonical_name"), kind.alias("concept_type"), domain.alias("domain"), told.alias("definition"),
        "data_type", "unit", F.col("min").alias("range_min"), F.col("max").alias("range_max"), F.array("semantic_type", domain, kind).alias("tags"), F.lit(0.8).alias("confidence"), source.alias("source"),
    )


def aliases_of(profiles: DataFrame, dataset: str) -> DataFrame:
    """concept_id, alias_text, alias_type, confidence: the name of each column, and without what stands in parentheses."""
    name = F.col("column_name")
    bare = F.trim(F.regexp_replace(name, r"\([^)]*\)", ""))
    own = F.struct(name.alias("alias_text"), F.lit("exact_synonym").alias("alias_type"), F.lit(1.0).alias("confidence"))
    variant = F.when((bare != name) & (bare != ""), F.struct(bare.alias("alias_text"), F.lit("case_variant").alias("alias_type"), F.lit(0.9).alias("confidence")))
    concept = F.concat(identifier(name), F.lit("_"), dataset_id(dataset))
    return profiles.select(concept.alias("concept_id"), F.explode(F.array_compact(F.array(own, variant))).alias("a")).select("concept_id", "a.*")


def evidence_of(profiles: DataFrame, samples: DataFrame, dataset: str) -> DataFrame:
    """concept_id, dataset_id, column_name, evidence_type, sample_values, statistics, semantics, confidence for each column."""
    concept, source = F.concat(identifier(F.col("column_name")), F.lit("_"), dataset_id(dataset)), dataset_id(dataset)
    listed = samples.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sample_values"))
    return profiles.join(listed, "column_name", "left").select(
        concept.alias("concept_id"), source.alias("dataset_id"), "column_name", F.lit("statistical_profile").alias("evidence_type"), F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        F.struct("mean", "std", "min", "max", "median").alias("statistics"), F.struct("semantic_type", "data_type", "unit").alias("semantics"), F.lit(0.8).alias("confidence"),
    )
