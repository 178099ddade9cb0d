"""Readers of retrieval benchmarks and concept lexicons, as DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key, the last in the file."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_line"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_line")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").withColumn("_line", F.monotonically_increasing_id())


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text from lines of an id, a tab and the text."""
    parts = F.split("value", "\t", 2)
    rows = _lines(spark, path).where(F.size(parts) == 2).select(F.trim(parts[0]).alias("query_id"), F.trim(parts[1]).alias("text"), "_line")
    return _last(rows, ["query_id"])


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance from white-space columns: the first, the second, the last (L0 to L2 or a number)."""
    parts = F.split(F.trim("value"), r"\s+")
    label = F.element_at(parts, -1)
    rel = F.when(label.isin("L0", "L1", "L2"), F.substring(label, 2, 1).cast("int")).otherwise(F.try_to_number(label, F.lit("S999")).cast("int"))
    rows = _lines(spark, path).where(F.size(parts) >= 3).select(parts[0].alias("query_id"), parts[1].alias("doc_id"), rel.alias("relevance"), "_line").where("relevance is not null")
    return _last(rows, ["query_id", "doc_id"])


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """id and the given fields of JSON lines, also compressed; broken lines are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "doc_id", "dataset_id", "_id") if c in rows.columns]
    if not ids:
        return rows.limit(0).withColumn("id", F.lit(None).cast("string"))
    return rows.withColumn("id", F.coalesce(*ids)).where("id is not null")


def read_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts (id, display_name, definition, domain) and aliases (alias_text, concept_id) from JSON maps of terms."""
    kind = "map<string, struct<definition: string, canonical_name: string, display_name: string, domain: string, aliases: array<string>>>"
    terms = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("term", "e"))
    ids = F.replace(F.lower("term"), F.lit(" "), F.lit("_"))
    concepts = terms.select(ids.alias("id"), F.coalesce("e.display_name", "term").alias("display_name"), F.coalesce("e.definition", F.lit("")).alias("definition"), F.col("e.domain").alias("domain"))
    aliases = terms.select(F.explode("e.aliases").alias("alias_text"), ids.alias("concept_id")).distinct()
    return concepts, aliases


def index_text(docs: DataFrame, fields: list[list[str]]) -> DataFrame:
    """id, text: of each list of fields the first that is not empty, joined by spaces."""
    parts = [F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in docs.columns]) for names in fields if any(c in docs.columns for c in names)]
    return docs.select("id", F.concat_ws(" ", *parts).alias("text"))


class Benchmark(NamedTuple):
    """Queries (query_id, text), judgments (query_id, doc_id, relevance) and datasets (id, ...), and whether relevance is graded."""

    name: str
    queries: DataFrame
    qrels: DataFrame
    datasets: DataFrame | None
    graded: bool

    def relevant(self, least: int = 1) -> DataFrame:
        """Judgments of at least that relevance."""
        return self.qrels.where(F.col("relevance") >= least)

    def statistics(self) -> DataFrame:
        """num_queries, num_datasets, num_judgments, relevance_type: one row."""
        datasets = self.datasets.count() if self.datasets is not None else 0
        counts = self.queries.agg(F.count(F.lit(1)).alias("num_queries")).crossJoin(self.qrels.agg(F.count(F.lit(1)).alias("num_judgments")))  # one row each
        return counts.select("num_queries", F.lit(datasets).alias("num_datasets"), "num_judgments", F.lit("graded" if self.graded else "binary").alias("relevance_type"))


def read_json_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text from a JSON list of {query_id or id, query_text or query}, or a JSON map of ids to texts."""
    whole = spark.read.text(path, wholetext=True)
    entry = "array<struct<query_id: string, id: string, query_text: string, query: string>>"
    listed = whole.where(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", entry)).alias("e")).select(F.coalesce("e.query_id", "e.id").alias("query_id"), F.coalesce("e.query_text", "e.query").alias("text"))
    mapped = whole.where(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string, string>")).alias("query_id", "text"))
    return listed.where("coalesce(query_id, '') <> '' and coalesce(text, '') <> ''").union(mapped)


def read_csv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance from CSV with a header: topic, relevance (a number, or true, yes, relevant), document."""
    rows = spark.read.csv(path, header=True).withColumn("_line", F.monotonically_increasing_id())
    topic, label, document = (F.trim(F.col(f"`{c}`")) for c in rows.columns[:3])
    relevance = F.coalesce(label.try_cast("int"), F.lower(label).isin("true", "yes", "relevant").cast("int"))
    return _last(rows.where(document.isNotNull()).select(topic.alias("query_id"), document.alias("doc_id"), relevance.alias("relevance"), "_line"), ["query_id", "doc_id"])


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """id, title, description, path of the JSON and CSV files of a folder; a CSV file has its name as title."""
    meta = "struct<title: string, name: string, dataset_name: string, description: string, notes: string, content: string, text: string>"
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    e = files.withColumn("e", F.from_json("value", meta)).where("e is not null")
    bare = F.regexp_replace("file", r"\.[^.]*$", "")
    first = lambda *names: F.coalesce(*[F.nullif(F.col(f"e.{n}"), F.lit("")) for n in names])
    described = e.select(bare.alias("id"), first("title", "name", "dataset_name").alias("title"), first("description", "notes", "content", "text").alias("description"), "path")
    tables = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.regexp_extract("path", r"([^/]*)\.csv$", 1).alias("id"), "path")
    return described.unionByName(tables.select("id", F.initcap(F.translate("id", "_", " ")).alias("title"), F.lit(None).cast("string").alias("description"), "path"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def restricted(benchmark: Benchmark, kind: str = "csv", min_relevant: int = 5, min_total: int = 10) -> Benchmark:
    """Datasets with a resource of the format, judgments of these, and queries that still have judgments enough."""
    from lodestone.operators.evaluation import judged_enough, with_format

    docs, qrels = with_format(benchmark.datasets.withColumnRenamed("id", "doc_id"), benchmark.qrels, kind)
    qrels = judged_enough(qrels, min_relevant, min_total)
    return benchmark._replace(datasets=docs.withColumnRenamed("doc_id", "id"), qrels=qrels, queries=benchmark.queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"))


def load_graded(spark: SparkSession, folder: str, name: str = "graded", min_relevant: int = 5, min_total: int = 10, csv_only: bool = False, judged_only: bool = False) -> Benchmark:
    """topics.tsv, qrels.txt and collection.jsonl (or .jsonl.bz2) of a folder, with queries that have judgments enough.

    ``csv_only`` keeps datasets with a CSV resource and filters queries again by what is left of their judgments; ``judged_only`` keeps datasets that
    some judgment names.
    """
    from lodestone.operators.evaluation import judged_enough

    qrels = judged_enough(read_qrels(spark, f"{folder}/qrels.txt"), min_relevant, min_total)
    queries = read_topics(spark, f"{folder}/topics.tsv").join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    found = [p for p in (f"{folder}/collection.jsonl", f"{folder}/collection.jsonl.bz2") if _exists(spark, p)]
    benchmark = Benchmark(name, queries, qrels, read_collection(spark, found[0]) if found else None, True)
    if csv_only and found:
        benchmark = restricted(benchmark, "csv", min_relevant, min_total)
    if judged_only and found:
        named = benchmark.qrels.select(F.col("doc_id").alias("id")).distinct()
        benchmark = benchmark._replace(datasets=benchmark.datasets.join(named, "id", "left_semi"))
    return benchmark


def load_binary(spark: SparkSession, folder: str, name: str = "binary") -> Benchmark | None:
    """The first of each kind of file that the folder has; None without queries or judgments."""
    first = lambda names: next((f"{folder}/{n}" for n in names if _exists(spark, f"{folder}/{n}")), None)
    queries, qrels = first(["queries.json", "queries.tsv", "topics.tsv"]), first(["qrels.csv", "qrels.txt", "qrels.tsv", "relevance.csv"])
    if queries is None or qrels is None:
        return None
    asked = read_json_queries(spark, queries) if queries.endswith(".json") else read_topics(spark, queries)
    head = "\n".join(r["value"] for r in spark.read.text(qrels).limit(1024).collect())[:1024]  # the first 1,024 characters
    commas = "," in head
    judged = read_csv_qrels(spark, qrels) if commas else read_qrels(spark, qrels)
    datasets = first(["datasets", "collection", "documents"])
    return Benchmark(name, asked, judged, read_datasets(spark, datasets) if datasets else None, False)


def load_benchmark(spark: SparkSession, name: str, folder: str, **options) -> Benchmark | None:
    """The benchmark of a folder by the kind that its name begins with."""
    if name.startswith("ntcir"):
        return load_graded(spark, folder, name, **options)
    if name.startswith("ecir"):
        return load_binary(spark, folder, name, **options)
    raise ValueError(f"no benchmark is named {name}")
