"""A vector index on disk: inverted lists by nearest centroid, of which a search reads the nearest, or all that can hold a result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.retrieval import top

SAMPLE, ROUNDS, CHUNK, QUERIES = 20_000, 12, 8192, 512


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _centroids(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors; a centroid without vectors is put on the one farthest from its own."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centers.T
        own, score = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        for j in np.flatnonzero(np.bincount(own, minlength=len(centers)) == 0):
            sums[j] = sample[score.argmin()]
            score[score.argmin()] = np.inf
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


class VectorIndex:
    """Tables below a folder: ``lists`` (list, centroid, reach, n) and ``vectors`` (doc_id, v) in a folder for each list; vectors have length 1.

    Centroids are fitted to a sample of ``SAMPLE`` vectors; every vector is indexed. reach: the widest angle between a centroid and a vector of its list.
    Null, empty, zero and non-finite vectors, and those of another length than the commonest, are near nothing and left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, lists: int | None = None, seed: int = 7) -> None:
        """Index vectors (doc_id, vector); by default one list for each 1,000 vectors, from 8 to 4,096."""
        v = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("v")).where("size(v) > 0")
        v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
        sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        self.lists = 0
        if sizes is None:
            return
        v = v.where(F.size("v") == sizes["d"])
        count = lists or min(4096, max(8, sizes["n"] // 1000))
        drawn = v.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / sizes["n"]))).limit(2 * SAMPLE).select("v").collect()  # bounded
        centers = _centroids(_unit(np.array([r[0] for r in drawn])), count, seed)
        schema = f"doc_id {v.schema['doc_id'].dataType.simpleString()}, v array<double>, list int, angle double"

        def deal(batches):
            for batch in batches:
                x = _unit(np.stack(batch["v"].to_list()))
                near = x @ centers.T
                own = near.argmax(axis=1)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "v": list(x), "list": own.astype("int32"), "angle": np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))})

        dealt = v.mapInPandas(deal, schema)
        # a list with very many vectors is written by several tasks
        dealt.repartition("list", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/vectors")
        held = self.spark.read.parquet(f"{self.path}/vectors").groupBy("list").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("n"))
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, centroid array<double>")
        known.join(held, "list").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists")

    def _lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = self.spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()  # 4,096 at most
        return np.array([r["list"] for r in rows]), np.array([r["centroid"] for r in rows]), np.array([r["reach"] for r in rows]), np.array([r["n"] for r in rows])

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """query_id, doc_id, score, rank by cosine from the ``probes`` lists nearest to each query (query_id, vector); only their folders are read.

        ``exact``: then also all lists that can hold a nearer vector than the k-th found: a vector of a list is no nearer to
        the query than the angle to the centroid less the list's reach. The result is that of comparing all vectors.
        """
        numbers, centers, reach, _ = self._lists()
        ids = queries.schema["query_id"].dataType.simpleString()
        q = queries.select("query_id", F.col("vector").cast("array<double>").alias("v")).where((F.size("v") == centers.shape[1]) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))

        def first(batches):
            for batch in batches:
                x = _unit(np.stack(batch["v"].to_list()))
                near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": batch["query_id"], "v": list(x), "lists": [numbers[row].astype("int32") for row in near]})

        probed = q.mapInPandas(first, f"query_id {ids}, v array<double>, lists array<int>")
        found = self._nearest(probed, k, ids)
        if exact:
            far = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-1.0).alias("least"))

            def more(batches):
                for batch in batches:
                    x = np.stack(batch["v"].to_list())
                    angle = np.arccos(np.clip(x @ centers.T, -1, 1)) - reach
                    open_ = np.cos(np.clip(angle, 0, np.pi)) >= batch["least"].to_numpy()[:, None] - 1e-7
                    seen = [set(row) for row in batch["lists"]]
                    yield pd.DataFrame({"query_id": batch["query_id"], "v": batch["v"], "lists": [np.array([n for n in numbers[o] if n not in s], "int32") for o, s in zip(open_, seen, strict=True)]})

            rest = probed.join(far, "query_id", "left").na.fill({"least": -1.0}).mapInPandas(more, f"query_id {ids}, v array<double>, lists array<int>")
            found = found.unionByName(self._nearest(rest, k, ids))
        return top(found.select("query_id", "doc_id", "score"), k)

    def probes_for(self, k: int = 10, least: float = 0.95, sample: int = 256) -> int:
        """The fewest lists to probe so that ``least`` of the ``k`` nearest of ``sample`` indexed vectors, searched exactly, lie in them.

        Of random vectors that is most of the lists; where vectors lie in clusters, a few.
        """
        numbers, centers, _, _ = self._lists()
        held = self.spark.read.parquet(f"{self.path}/vectors")
        drawn = held.orderBy(F.xxhash64("doc_id", F.lit(11))).limit(sample).select(F.col("doc_id").alias("query_id"), F.col("v").alias("vector"))
        found = self.search(drawn, k, exact=True).select("query_id", "doc_id").join(held.select("doc_id", "list"), "doc_id").join(drawn, "query_id")
        rows = found.select("vector", "list").collect()  # k for each of the sample
        near = np.argsort(-(np.array([r["vector"] for r in rows]) @ centers.T), axis=1, kind="stable")
        places = (numbers[near] == np.array([r["list"] for r in rows])[:, None]).argmax(axis=1)
        return int(np.sort(places)[min(len(places) - 1, int(np.ceil(least * len(places))) - 1)]) + 1

    def _nearest(self, probed: DataFrame, k: int, ids: str) -> DataFrame:
        """The best of each query in each piece of the lists it probes: queries and vectors of a list meet in blocks of bounded size."""
        pairs = probed.select("query_id", F.col("v").alias("x"), F.explode("lists").alias("list"))
        lists = [r[0] for r in pairs.select("list").distinct().collect()]
        held = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("list").isin(lists)).select("doc_id", "v", "list")
        numbers, _, _, sizes = self._lists()
        pieces = F.create_map(*[F.lit(int(x)) for n, m in zip(numbers, sizes, strict=True) for x in (n, -(-int(m) // CHUNK))])
        counts = {r["list"]: r["n"] for r in pairs.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        blocks = F.create_map(*[F.lit(int(x)) for n in lists for x in (n, -(-counts[n] // QUERIES))]) if lists else F.create_map(F.lit(-1), F.lit(1))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.element_at(m, F.col("list")) - 1))
        left = pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.element_at(blocks, F.col("list"))).cast("int")).withColumn("piece", every(pieces))
        right = held.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.element_at(pieces, F.col("list"))).cast("int")).withColumn("block", every(blocks))
        docs = held.schema["doc_id"].dataType.simpleString()

        def nearest(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(asked) and len(near):
                scores = np.stack(asked["x"].to_list()) @ np.stack(near["v"].to_list()).T
                names, take = near["doc_id"].to_numpy(), min(k, len(near))
                for query, row in zip(asked["query_id"], scores, strict=True):
                    least = np.partition(row, len(row) - take)[len(row) - take]
                    at = np.flatnonzero(row >= least - 1e-8)
                    best = sorted(zip(-np.round(row[at], 9), names[at], row[at], strict=True))[:k]
                    found += [(query, doc, float(score)) for _, doc, score in best]
            return pd.DataFrame(found, columns=["query_id", "doc_id", "score"])

        met = left.groupBy("list", "block", "piece").cogroup(right.groupBy("list", "block", "piece")).applyInPandas(nearest, f"query_id {ids}, doc_id {docs}, score double")
        return top(met, k).select("query_id", "doc_id", "score")
