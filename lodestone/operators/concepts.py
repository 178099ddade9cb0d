"""The concept graph as tables, and the cascade that matches column names to concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalized_name
from lodestone.operators.retrieval import dense
from lodestone.operators.similarity import similar_pairs


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, of each key the one of ``new`` with the largest ``seq``, else the existing one; seq goes."""
    both = existing.withColumns({"_new": F.lit(0)}).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("seq"))
    return both.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_new", "seq")


def add_aliases(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new).dropDuplicates(["alias_text", "concept_id"])


def parents(edges: DataFrame, ids: DataFrame, kind: str = "is_a") -> DataFrame:
    """id, parent: the targets of edges of a kind from each id."""
    return ids.join(edges.where(F.col("relationship_type") == kind), F.col("id") == F.col("source_concept_id")).select("id", F.col("target_concept_id").alias("parent"))


def children(edges: DataFrame, ids: DataFrame, kind: str = "is_a") -> DataFrame:
    return ids.join(edges.where(F.col("relationship_type") == kind), F.col("id") == F.col("target_concept_id")).select("id", F.col("source_concept_id").alias("child"))


def keyword_search(concepts: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Concepts whose name or definition holds the query, whatever the case; the first k by id."""
    return concepts.where(F.col("display_name").ilike(f"%{query}%") | F.col("definition").ilike(f"%{query}%")).orderBy("id").limit(k)


def direct_links(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Edges with both ends among the matched ids."""
    m = matched.select("id").distinct()
    both = edges.join(m.withColumnRenamed("id", "source_concept_id"), "source_concept_id", "left_semi").join(m.withColumnRenamed("id", "target_concept_id"), "target_concept_id", "left_semi")
    return both.select("source_concept_id", "relationship_type", "target_concept_id")


def anchors(edges: DataFrame, matched: DataFrame, k: int = 3) -> DataFrame:
    """target_concept_id, links of targets that two or more matched concepts share, the most linked first."""
    m = matched.select(F.col("id").alias("source_concept_id")).distinct()
    counts = edges.join(m, "source_concept_id", "left_semi").groupBy("target_concept_id").agg(F.count(F.lit(1)).alias("links"))
    return counts.where("links >= 2").orderBy(F.desc("links"), "target_concept_id").limit(k)


def expanded_keywords(edges: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """id, keywords: each concept's aliases, its parents and their aliases, its children and related concepts, in order."""
    up = parents(edges, ids)
    parts = [
        ids.join(aliases, F.col("id") == F.col("concept_id")).select("id", F.col("alias_text").alias("keyword")),
        up.select("id", F.col("parent").alias("keyword")),
        up.join(aliases, F.col("parent") == F.col("concept_id")).select("id", F.col("alias_text").alias("keyword")),
        children(edges, ids).select("id", F.col("child").alias("keyword")),
        parents(edges, ids, "related_to").select("id", F.col("parent").alias("keyword")),
    ]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.union(p)
    return merged.groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def _by_name(rows: DataFrame, name: Column, concept: str, out: str) -> DataFrame:
    """norm, ``out``, first: of each normalised name the concept of its last row by ``seq`` (else by id), and when the name came first."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    named = rows.select(normalized_name(name).alias("norm"), F.col(concept).alias(out), seq.cast("long").alias("seq"))
    return named.where("norm is not null").groupBy("norm").agg(F.max(F.struct("seq", out))[out].alias(out), F.min("seq").alias("first"))


def match_columns(columns: DataFrame, concepts: DataFrame, aliases: DataFrame, least: float = 95.0, vectors: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """column_name, concept_id, method, score: exact name, else alias, else fuzzy name, else fuzzy alias, else nearest vector; null where none.

    A concept's name is its canonical_name, else its display_name, else its id. Where several rows have one name or alias the last by ``seq`` counts, a
    column that both tables may have; without it the one with the largest id. The fuzzy step sees only the columns that are left and finds
    similar names by a join on segments (``similar_pairs``); of equal scores the name that came first wins, then the smaller id; a name under half or over twice as
    long is no match, and the aliases are tried then. With ``vectors`` (id, vector) of concepts
    and a vector for each column, columns still left take the concept with the nearest one, of cosine ``threshold`` or more.
    """
    c = columns.select("column_name", normalized_name(F.col("column_name")).alias("norm"))
    given = [F.nullif(F.col(n), F.lit("")) for n in ("canonical_name", "display_name") if n in concepts.columns]
    names = _by_name(concepts, F.coalesce(*given, F.col("id").cast("string")), "id", "concept_id")
    other = _by_name(aliases, F.col("alias_text"), "concept_id", "alias_id")
    exact = c.join(names.drop("first"), "norm", "left").join(other.drop("first"), "norm", "left")
    hit = exact.where("concept_id is not null or alias_id is not null").select("column_name", F.coalesce("concept_id", "alias_id").alias("concept_id"), F.when(F.col("concept_id").isNotNull(), "exact").otherwise("alias").alias("method"), F.lit(100.0).alias("score"))
    rest = exact.where("concept_id is null and alias_id is null").select("column_name", "norm")
    pool = names.select("norm", "concept_id", "first", F.lit(0).alias("level")).union(other.select("norm", "alias_id", "first", F.lit(1))).withColumnRenamed("norm", "b")
    near = similar_pairs(rest.select(F.col("norm").alias("a")), pool.select("b"), least).join(pool, "b")
    best = Window.partitionBy("a", "level").orderBy(F.desc("score"), "first", "concept_id")
    lengths = [F.length("a"), F.length("b")]
    near = near.withColumn("rn", F.row_number().over(best)).where((F.col("rn") == 1) & (F.least(*lengths) * 2 >= F.greatest(*lengths)))
    found = near.groupBy("a").agg(F.min(F.struct("level", "concept_id", "score")).alias("m"))
    fuzzy = rest.join(found, F.col("norm") == F.col("a")).select("column_name", "m.concept_id", F.lit("fuzzy").alias("method"), "m.score")
    if vectors is not None:
        left = rest.join(fuzzy, "column_name", "left_anti").join(columns.select("column_name", "vector"), "column_name")
        near = dense(vectors.select(F.col("id").alias("doc_id"), "vector"), left.select(F.col("column_name").alias("query_id"), "vector"), 1).where(F.col("score") >= threshold)
        fuzzy = fuzzy.union(near.select(F.col("query_id").alias("column_name"), F.col("doc_id").cast("string").alias("concept_id"), F.lit("semantic").alias("method"), "score"))
    none = rest.join(fuzzy, "column_name", "left_anti").select("column_name", F.lit(None).cast("string").alias("concept_id"), F.lit("no_match").alias("method"), F.lit(0.0).alias("score"))
    return hit.union(fuzzy).union(none)
