"""A BM25 index on disk: postings in buckets of terms and in blocks with their greatest weight, so that a search leaves out blocks that can't reach the top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import search_tokens
from lodestone.operators.retrieval import K1, B, scored, terms_asked, tokenized

#: Postings in a block, documents in a shard, tokens that a part of a bucket has on average at most, documents scored together.
BLOCK, SHARD, PART, CHUNK = 128, 1 << 18, 1 << 18, 4096


class TextIndex:
    """Tables below a folder: ``figures``, ``terms`` (term, df, idf, bound) and ``blocks`` by bucket of terms (term, head, most, held, doc_ids, weights).

    A weight is the part of a term's score in a document that doesn't depend on the query. Documents are dealt into shards; in each a term's postings
    are cut into blocks of ``BLOCK`` from the largest weight on, the first of which is the head, so a frequent term is spread over many tasks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, docs: DataFrame, tokens: Callable[[Column], Column] = search_tokens, buckets: int = 64) -> None:
        """Index documents (doc_id, text) that have tokens; texts are cut once for the postings and once for their lengths.

        Tokens are shuffled once, to the part of a bucket that counts them and cuts their blocks; there are as many parts as the tokens need.
        """
        cut = tokenized(docs, tokens).select("doc_id", "t", F.size("t").alias("dl"))
        some = F.when(F.col("dl") > 0, F.col("dl"))
        cut.agg(F.count(some).alias("n"), F.avg(some).alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/figures")
        figures = self._table("figures").first()  # one row
        n, avgdl = figures["n"], figures["avgdl"] or 1.0
        parts, shards = max(1, -(-int(n * avgdl) // (buckets * PART))), max(1, -(-n // SHARD))
        shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        place = ["bucket", "part"]
        dealt = cut.select("doc_id", "dl", shard, F.explode("t").alias("term")).select("*", bucket, F.pmod(F.xxhash64("term", "shard", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), buckets * parts // 4)
        p = dealt.repartition(tasks, *place).groupBy(*place, "term", "shard", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
        order = Window.partitionBy(*place, "term", "shard").orderBy(F.desc("weight"), "doc_id")
        p = p.withColumn("weight", weight).withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
        blocks = p.groupBy(*place, "term", "shard", "block").agg(F.max("weight").alias("most"), F.collect_list(F.struct("doc_id", "weight")).alias("x"))
        blocks = blocks.select("bucket", "term", (F.col("block") == 0).alias("head"), "most", F.size("x").alias("held"), F.col("x.doc_id").alias("doc_ids"), F.col("x.weight").alias("weights"))
        blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks")

        idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        terms = self.spark.read.schema(blocks.schema).parquet(f"{self.path}/blocks").groupBy("bucket", "term").agg(F.sum("held").alias("df"), F.max("most").alias("bound"))
        terms.select("term", "bucket", "df", idf.alias("idf"), "bound").write.mode("overwrite").parquet(f"{self.path}/terms")

    def _asked(self, queries: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
        """query_id, term, bucket, factor, bound of the terms that the index holds; a word that repeats in a query counts each time."""
        asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        factor = F.col("idf") * F.col("qtf")
        return asked.join(self._table("terms"), "term").select("query_id", "term", "bucket", factor.alias("factor"), (factor * F.col("bound")).alias("bound"))

    def needed_blocks(self, queries: DataFrame, k: int = 10, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
        """Blocks met by each query's terms that can hold a document of its best ``k``: query_id, factor, doc_ids, weights.

        The heads of a query's terms give scores that documents have at least; the k-th largest is a score to reach. A block can be left out if its
        greatest weight and the bounds of the query's other terms don't reach it: then no document in it does. A document that
        reaches it is in none of the blocks left out, so its score is whole.
        """
        asked = self._asked(queries, tokens)
        met = self._met(asked).join(asked, ["bucket", "term"]).join(self._reach(queries, k, tokens), "query_id")
        return met.where(F.col("most") * F.col("factor") + F.col("total") - F.col("bound") >= F.col("reach") - 1e-6).select("query_id", "factor", "doc_ids", "weights")

    def _met(self, asked: DataFrame) -> DataFrame:
        """Blocks of the buckets that hold terms asked for."""
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as the index has at most
        return self._table("blocks").where(F.col("bucket").isin(buckets))

    def _reach(self, queries: DataFrame, k: int, tokens: Callable[[Column], Column]) -> DataFrame:
        """query_id, reach, total: the score to reach for a query's best ``k``, 0 if its heads hold fewer, and the most that its terms can give together."""
        asked = self._asked(queries, tokens)
        known = self._met(asked).where("head").join(asked, ["bucket", "term"]).select("query_id", "factor", F.explode(F.arrays_zip("doc_ids", "weights")).alias("x"))
        known = known.groupBy("query_id", F.col("x.doc_ids").alias("doc_id")).agg(F.sum(F.col("factor") * F.col("x.weights")).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        reach = known.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("reach"))
        return asked.groupBy("query_id").agg(F.sum("bound").alias("total")).join(reach, "query_id")

    def search(self, queries: DataFrame, k: int = 10, tokens: Callable[[Column], Column] = search_tokens, least: float = 0.0) -> DataFrame:
        """query_id, doc_id, score, rank, as ``bm25`` gives them for the documents indexed; documents aren't read.

        A block that some query needs is read once and scored for all of them: what it adds to the others' scores is theirs.
        """
        asked, reach = self._asked(queries, tokens), self._reach(queries, k, tokens)
        least_weight = (F.col("reach") - 1e-6 - F.col("total") + F.col("bound")) / F.col("factor")
        floors = asked.join(reach, "query_id").groupBy("bucket", "term").agg(F.min(least_weight).alias("floor"))
        needed = self._met(asked).join(floors, ["bucket", "term"]).where(F.col("most") >= F.col("floor"))
        weights = needed.select("term", F.explode(F.arrays_zip("doc_ids", "weights")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), "term", F.col("x.weights").alias("w"))
        members, bags = terms_asked(queries, tokens)
        factors = bags.join(self._table("terms"), "term").select("asks", "term", (F.col("idf") * F.col("qtf")).alias("x"))
        return scored(members, factors, weights, self._table("figures").first()["n"], k, least, chunk=CHUNK)
