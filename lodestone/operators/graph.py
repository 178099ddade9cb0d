"""The concept graph: what goes into it from records, its tables, figures, and search by alias and vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import concepts as c
from lodestone.operators.retrieval import dense
from lodestone.sources.buckets import BucketTable

RECORD = """seq long, id string, concept_id string, display_name string, canonical_name string, definition string, domain string, metadata string, aliases array<string>,
    relations array<struct<target: string, type: string, confidence: double, evidence: string>>, parent string"""
CONCEPT = ["id", "display_name", "canonical_name", "definition", "domain", "metadata"]


def rows_of(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, aliases and edges of records (RECORD); those without an id are left out, seq tells the order.

    A display name defaults to the id, a kind of relation to related_to, its confidence to 0. A parent, of the record or its metadata,
    is an is_a edge of confidence 0.5 to its name in lower case with underscores.
    """
    r = records.withColumn("id", F.coalesce(F.nullif("concept_id", F.lit("")), F.nullif("id", F.lit("")))).where("id is not null")
    found = r.select("seq", "id", F.coalesce("display_name", "id").alias("display_name"), "canonical_name", F.coalesce("definition", F.lit("")).alias("definition"), "domain", "metadata")
    aliases = r.select(F.explode("aliases").alias("alias_text"), F.col("id").alias("concept_id"))
    edges = r.select("seq", F.col("id").alias("source_concept_id"), F.explode("relations").alias("x")).where("coalesce(x.target, '') <> ''").select(
        "seq", "source_concept_id", F.coalesce("x.type", F.lit("related_to")).alias("relationship_type"), F.col("x.target").alias("target_concept_id"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), F.col("x.evidence").alias("evidence"),
    )
    parent = F.coalesce(F.nullif(F.get_json_object("metadata", "$.hierarchy.parent"), F.lit("")), F.nullif("parent", F.lit("")))
    up = r.select("seq", F.col("id").alias("source_concept_id"), F.lit("is_a").alias("relationship_type"), F.replace(F.lower(parent), F.lit(" "), F.lit("_")).alias("target_concept_id"), F.lit(0.5).alias("confidence"), F.lit("inferred from legacy hierarchy metadata").alias("evidence"))
    return found, aliases, edges.unionByName(up.where("target_concept_id is not null"))


def upsert_concepts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' concepts, of each id the last, then of each canonical name that is not null the last; new ones (with seq) come after existing ones."""
    both = existing.withColumns({"_new": F.lit(0), "seq": F.lit(0).cast("long")}).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("seq"), "id"))
    by_id = both.withColumn("_n", last("id")).where("_n = 1")
    # concepts without a canonical name are told apart by their id, so nulls don't gather in one group
    name = F.coalesce(F.concat(F.lit("n:"), "canonical_name"), F.concat(F.lit("i:"), "id"))
    return by_id.withColumn("_name", name).withColumn("_n", last("_name")).where("_n = 1").drop("_n", "_name", "_new", "seq")


def upsert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' edges, of each source, kind and target the last."""
    old = existing.withColumn("seq", F.lit(0).cast("long")) if "seq" not in existing.columns else existing
    return c.upsert(old, new, ["source_concept_id", "relationship_type", "target_concept_id"])


class ConceptGraph:
    """Tables of concepts, aliases, edges and vectors below a folder, each in hash buckets of its keys: a change rewrites the buckets it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.stores = {name: BucketTable(spark, f"{self.path}/{name}", schema, self.KEYS[name], buckets) for name, schema in self.SCHEMAS.items()}

    SCHEMAS = {
        "concepts": "id string, display_name string, canonical_name string, definition string, domain string, metadata string",
        "aliases": "alias_text string, concept_id string",
        "edges": "source_concept_id string, relationship_type string, target_concept_id string, confidence double, evidence string",
        "vectors": "id string, vector array<double>",
    }
    KEYS = {"concepts": ["id"], "aliases": ["alias_text", "concept_id"], "edges": ["source_concept_id", "relationship_type", "target_concept_id"], "vectors": ["id"]}

    def table(self, name: str) -> DataFrame:
        """The last version of a table."""
        return self.stores[name].read()

    def concept(self, ids: DataFrame) -> DataFrame:
        """The concepts of ids (id): a join of keys."""
        return self.table("concepts").join(ids.select("id").distinct(), "id", "left_semi")

    def vector(self, ids: DataFrame) -> DataFrame:
        """The vectors of ids (id)."""
        return self.table("vectors").join(ids.select("id").distinct(), "id", "left_semi")

    def add(self, records: DataFrame) -> dict[str, set[int]]:
        """Add or update concepts with their aliases and edges from records. Gives the buckets rewritten of each table.

        Of concepts with one id, and then with one canonical name, the last stays; one held before gives way to a new one of its canonical name.
        """
        found, aliases, edges = rows_of(records)
        store = self.stores["concepts"]
        new = upsert_concepts(store.read().limit(0), found).select(*CONCEPT)
        named = new.where("canonical_name is not null").select("canonical_name", F.col("id").alias("_id"))
        touched = store.upsert(new)
        displaced = store.read().join(named, "canonical_name").where("id <> _id").select("id")
        return {"concepts": touched | store.delete(displaced), "aliases": self.stores["aliases"].upsert(aliases.distinct()), "edges": self.stores["edges"].upsert(edges)}

    def add_vectors(self, vectors: DataFrame) -> None:
        """Add vectors (id, vector) at length 1; an id that is there already is replaced."""
        from lodestone.operators.generation import unit_vector

        self.stores["vectors"].upsert(vectors.select("id", unit_vector(F.col("vector").cast("array<double>")).alias("vector")))

    def index(self, encoder, rebuild: bool = False) -> None:
        """Vectors of "name. definition" of each concept; nothing is done if there are vectors, unless ``rebuild``."""
        from lodestone.operators.generation import encode

        store = self.stores["vectors"]
        if not store.versions() or rebuild:
            texts = self.table("concepts").select("id", F.concat_ws(". ", "display_name", "definition").alias("text"))
            store.delete(store.read().join(texts, "id", "left_anti").select("id"))
            store.upsert(encode(texts, encoder).select("id", "vector"))

    def search(self, queries: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
        """query_id, id, score, method: concepts that have the query's text as alias (score 1), then the nearest vectors; each concept once."""
        return search_concepts(queries, self.table("aliases"), self.table("vectors"), k, threshold)

    def with_aliases(self) -> DataFrame:
        """Concepts with the list of their aliases."""
        listed = self.table("aliases").groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_set("alias_text")).alias("aliases"))
        return self.table("concepts").join(listed, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))

    def statistics(self) -> DataFrame:
        return table_sizes({name: self.table(name) for name in self.SCHEMAS})


def search_concepts(queries: DataFrame, aliases: DataFrame, vectors: DataFrame, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """query_id, id, score, method, rank for queries (query_id, text, vector): equal aliases, letter case ignored, at score 1, and nearest vectors."""
    a = aliases.select(F.lower(F.trim("alias_text")).alias("_t"), F.col("concept_id").alias("id"))
    exact = queries.select("query_id", F.lower(F.trim("text")).alias("_t")).join(a, "_t").select("query_id", "id", F.lit(1.0).alias("score"), F.lit("alias").alias("method"))
    near = dense(vectors.select(F.col("id").alias("doc_id"), "vector"), queries.select("query_id", "vector").where("vector is not null"), k).where(F.col("score") >= threshold)
    both = exact.unionByName(near.select("query_id", F.col("doc_id").alias("id"), "score", F.lit("vector").alias("method")))
    best = both.groupBy("query_id", "id").agg(F.max(F.struct("score", F.when(F.col("method") == "alias", 1).otherwise(0).alias("p"), "method")).alias("m"))
    w = Window.partitionBy("query_id").orderBy(F.desc("m.p"), F.round("m.score", 9).desc(), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "m.score", "m.method", "rank")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """store, n of each table."""
    parts = [t.agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def related_concepts(edges: DataFrame, concepts: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """id, related_id, display_name, relationship_type, rank: the first ``k`` targets of edges from each id, by kind and id."""
    met = ids.select("id").join(edges, F.col("id") == F.col("source_concept_id")).join(concepts.select(F.col("id").alias("related_id"), "display_name"), F.col("target_concept_id") == F.col("related_id"))
    w = Window.partitionBy("id").orderBy("relationship_type", "related_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "related_id", "display_name", "relationship_type", "rank")
