"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes vectors.

Fitted on a bounded sample: its neighbour graph is cut into equal parts, and a small network learns which part a
vector's neighbours are in. Where parts would be too large, each is cut again by a graph and a network of its own, fitted in a
task for each part, so the number of parts grows with the vectors. All vectors are then put in their most probable part,
queries in several, and the vectors of those parts are ranked by their exact cosine.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, ordered_hash, release


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by cosine."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 1024):
        sims = x[lo : lo + 1024] @ x.T
        sims[np.arange(len(sims)), lo + np.arange(len(sims))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-sims, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(near: np.ndarray, levels: int, seed: int) -> np.ndarray:
    """Parts 0 to 2 ** levels - 1 of equal size, by halving the graph: a spectral order cut in the middle, then swaps that cut fewer edges."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    parts, rng = np.zeros(n, np.int64), np.random.default_rng(seed)
    for level in range(levels):
        same = parts[a] == parts[b]
        u, v = np.concatenate([a[same], b[same]]), np.concatenate([b[same], a[same]])
        degree = np.maximum(np.bincount(u, minlength=n), 1)
        sizes = np.maximum(np.bincount(parts, minlength=1 << level), 1)
        x = rng.standard_normal(n)
        for _ in range(60):  # the slowest mode of averaging within each part
            x = (x + np.bincount(u, x[v], minlength=n) / degree) / 2
            x -= (np.bincount(parts, x, minlength=1 << level) / sizes)[parts]
            x /= np.sqrt(np.bincount(parts, x * x, minlength=1 << level) / sizes + 1e-30)[parts]
        order = np.lexsort((x, parts))
        begins = np.concatenate([[0], np.cumsum(np.bincount(parts, minlength=1 << level))])[:-1]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        half = (place - begins[parts] >= (sizes[parts] + 1) // 2).astype(np.int64)
        for _ in range(6):
            gain = np.bincount(u, np.where(half[u] != half[v], 1, -1), minlength=n)
            for p in range(1 << level):
                own = np.flatnonzero(parts == p)
                left, right = (own[half[own] == s] for s in (0, 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                swap = int((gain[left[:m]] + gain[right[:m]] > 2).sum() // 2)
                half[left[:swap]], half[right[:swap]] = 1, 0
        parts = parts * 2 + half
    return parts


class Router:
    """A network of one hidden layer; its outputs are the probabilities that a vector's neighbours are in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int, rounds: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * (1 / hidden) ** 0.5, np.zeros(target.shape[1])]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(rounds):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[at] @ self.w[0] * x.shape[1] ** 0.5 + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                d = (p - target[at]) / len(at)
                dh = (d @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[at].T @ dh * x.shape[1] ** 0.5, dh.sum(0), h.T @ d, d.sum(0))):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    self.w[i] -= 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x @ self.w[0] * x.shape[1] ** 0.5 + self.w[1], 0)
        return self._soft(h @ self.w[2] + self.w[3])


def fit(sample: np.ndarray, levels: int, near: int, recall: float, seed: int) -> tuple[Router, int]:
    """The router, and how many parts to search so that ``recall`` of the sample's own 5 nearest are found; sample: unit rows."""
    graph = neighbours(sample, near)
    parts = balanced_parts(graph, levels, seed)
    target = np.zeros((len(sample), 1 << levels))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), parts[graph].ravel()), 1 / (graph.shape[1] + 1))
    target[np.arange(len(sample)), parts] += 1 / (graph.shape[1] + 1)
    # the last fifth is not trained on: it tells how many parts to search
    trained = max(1, len(sample) * 4 // 5)
    router = Router(sample[:trained], target[:trained], hidden=64, rounds=40, seed=seed)
    p = router.probabilities(sample)
    home = p.argmax(axis=1)
    asked = np.arange(trained, len(sample)) if trained < len(sample) else np.arange(len(sample))
    ranks = np.argsort(np.argsort(-p[asked], axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(ranks, home[neighbours(sample, 5)[asked]], axis=1)
    probes = next((m for m in range(1, 1 << levels) if (needed < m).mean() >= recall), 1 << levels)
    return router, probes


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of rows that take part: of the most common length, finite throughout, not zero; repeated rows once."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("vector", lambda x: x != 0)).select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    top = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    v = v.where(F.size("vector") == top[0]["n"]) if top else v
    return v.dropDuplicates(["vec_id", "vector"])


class Tree:
    """Routers by the number of their node in their level; a node without one has a single child."""

    def __init__(self, fan: int):
        self.fan, self.levels = fan, []

    def add(self, routers: dict[int, tuple[Router | None, int]]) -> None:
        self.levels.append(routers)

    def route(self, x: np.ndarray, best_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the leaves they are sent to: the most probable one, or all that the routers' probes reach."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        for routers in self.levels:
            new_rows, new_nodes = [], []
            for node in np.unique(nodes).tolist():
                at = rows[nodes == node]
                router, probes = routers.get(node, (None, 1))
                if router is None:
                    children = np.zeros((len(at), 1), np.int64)
                else:
                    children = np.argsort(-router.probabilities(x[at]), axis=1, kind="stable")[:, : 1 if best_only else probes]
                new_rows.append(np.repeat(at, children.shape[1]))
                new_nodes.append((node * self.fan + children).ravel())
            rows, nodes = np.concatenate(new_rows), np.concatenate(new_nodes)
        return rows, nodes


def _levels_of(rows: int) -> int:
    """How often a sample of so many rows can be halved; 128 rows a part tell enough."""
    return max(0, int(math.log2(max(1, rows // 128))))


def _routed(vectors: DataFrame, tree: Tree, best_only: bool) -> DataFrame:
    """vec_id, vector, part: a row for each leaf that a vector is sent to."""
    held = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if len(batch):
                rows, leaves = held.value.route(unit(np.stack(batch["vector"].to_list())), best_only)
                yield batch.iloc[rows].assign(part=leaves)

    return vectors.select("vec_id", "vector").mapInPandas(run, "vec_id long, vector array<double>, part long")


def learned_tree(vectors: DataFrame, sample_rows: int, recall: float, leaf_rows: int, seed: int) -> Tree:
    """Routers down to parts of about ``leaf_rows`` vectors, each fitted on at most ``sample_rows`` vectors of its node."""
    total = vectors.count()
    rows = vectors.orderBy(ordered_hash("vec_id", seed), "vec_id").limit(sample_rows).toPandas()
    levels = _levels_of(len(rows))
    tree = Tree(1 << levels)
    if not levels:
        return tree
    depth = max(1, math.ceil(math.log(max(1.0, total / leaf_rows)) / math.log(tree.fan) - 1e-9))
    each = recall ** (1 / depth)
    tree.add({0: fit(unit(np.stack(rows["vector"].to_list())), levels, 10, each, seed)})

    def fit_node(key, batch):
        sample = unit(np.stack(batch["vector"].to_list()))
        own = _levels_of(len(sample))
        made = fit(sample, min(levels, own), 10, each, seed) if own else (None, 1)
        return pd.DataFrame({"node": [key[0]], "router": [pickle.dumps(made)]})

    for _ in range(depth - 1):
        placed = cut(_routed(vectors, tree, True), "ann-nodes")
        first = Window.partitionBy("part").orderBy(ordered_hash("vec_id", seed), "vec_id")
        some = placed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample_rows)
        fitted = cut(some.select("part", "vector").groupBy("part").applyInPandas(fit_node, "node long, router binary"), "ann-routers")
        tree.add({r["node"]: pickle.loads(r["router"]) for r in fitted.toLocalIterator()})  # one for each part, of fixed size
        release(placed, fitted)
    return tree


def search(vectors: DataFrame, is_query: str, k: int = 5, sample_rows: int = 4096, recall: float = 0.985, leaf_rows: int = 65_536, seed: int = 3, chunk: int = 4096, queries_at_once: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (SQL over vec_id) selects, the ``k`` nearest found of all other rows.

    Nearness is the cosine in double precision on the vectors as they are; ties go to the smaller vec_id. Null, zero or
    non-finite vectors, null vec_ids, and vectors of another than the most common length, take no part. Repeated rows count once. A vec_id with
    several vectors takes part with each, and the best score of any of them counts. With fewer candidates than ``k`` all are
    given; an empty table gives no rows. The index is fitted on
    ``sample_rows`` vectors at most for each node of the tree, those with the least hashes of vec_id, and holds every row. Of rows with the same
    vector the k + 1 with the least vec_ids can be among the nearest, so only these go on; it loses none, and a vector that a
    third of all rows have costs what one row does. A part's vectors are dealt into chunks, its queries into blocks, so
    no task holds a whole part.
    """
    v = cut(usable(vectors), "ann-usable")
    first = Window.partitionBy("vector").orderBy("vec_id")
    unlike = cut(v.withColumn("same", F.row_number().over(first)).where(F.col("same") <= k + 1).drop("same"), "ann-unlike")
    tree = learned_tree(unlike, sample_rows, recall, leaf_rows, seed)
    homes = cut(_routed(unlike, tree, True), "ann-homes")
    asked = cut(_routed(v.where(F.expr(is_query)), tree, False), "ann-queries")
    release(v, unlike)
    chunks = homes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    blocks = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / queries_at_once).cast("int").alias("blocks"))
    plan = F.broadcast(cut(chunks.join(blocks, "part"), "ann-plan"))  # a row for each part

    def deal(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own_n)).cast("int").alias(own)
        return df.join(plan, "part").select("part", "vec_id", "vector", mine, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))

    left = deal(asked, "block", "blocks", "chunk", "chunks").select("part", "chunk", "block", F.lit(True).alias("asks"), "vec_id", "vector")
    right = deal(homes, "chunk", "chunks", "block", "blocks").select("part", "chunk", "block", F.lit(False).alias("asks"), "vec_id", "vector")

    def nearest(both: pd.DataFrame) -> pd.DataFrame:
        q, c = both[both["asks"]], both[~both["asks"]]
        found = []
        if len(q) and len(c):
            ids, cx = c["vec_id"].to_numpy(), np.stack(c["vector"].to_list())
            cn, cu = np.sqrt((cx * cx).sum(axis=1)), unit(cx)
            take = min(len(c), k + 1)
            for query_id, x in zip(q["vec_id"].to_numpy(), q["vector"], strict=True):
                rough = cu @ (x / np.sqrt((x * x).sum()))
                least = np.partition(rough, len(rough) - take)[len(rough) - take]
                at = np.flatnonzero(rough >= least - 1e-9)  # ties and rounding are settled on the exact score
                at = at[ids[at] != query_id]
                score = (cx[at] * x).sum(axis=1) / (cn[at] * np.sqrt((x * x).sum()))
                best = np.lexsort((ids[at], -score))[:k]
                found += [(query_id, ids[at[i]], score[i]) for i in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = left.union(right).groupBy("part", "chunk", "block").applyInPandas(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
