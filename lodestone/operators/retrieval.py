"""BM25 and dense retrieval for batches of queries, and their fusion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lodestone.functions.text import search_tokens

K1, B = 1.5, 0.75
#: Queries whose scores with a chunk of vectors are held together.
AT_ONCE = 128


def tokenized(docs: DataFrame, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """doc_id, t (tokens) of documents (doc_id, text) that have text."""
    return docs.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", tokens(F.col("text")).alias("t"))


def corpus_figures(docs: DataFrame, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """n, avgdl of documents with tokens: one row."""
    return tokenized(docs, tokens).where(F.size("t") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl"))


def terms_asked(queries: DataFrame, tokens: Callable[[Column], Column] = search_tokens) -> tuple[DataFrame, DataFrame]:
    """Members (query_id, asks) and terms (asks, term, qtf): queries with the same words, each as often, ask the same and are searched once."""
    counted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    bags = counted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("bag"))
    spelled = F.transform("bag", lambda x: F.concat_ws(":", F.length(x["term"]).cast("string"), x["term"], x["qtf"].cast("string")))
    bags = bags.withColumn("asks", F.sha2(F.array_join(spelled, ","), 256))
    terms = bags.groupBy("asks").agg(F.first("bag").alias("bag")).select("asks", F.explode("bag").alias("x")).select("asks", "x.term", "x.qtf")
    return bags.select("query_id", "asks"), terms


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, tokens: Callable[[Column], Column] = search_tokens, least: float = 0.0, block: int = 1024, chunk: int = 4096) -> DataFrame:
    """query_id, doc_id, score, rank for all queries (query_id, text) at once; only documents with a score above ``least``.

    Tokens of documents meet the distinct terms of the queries, which Spark broadcasts if their size allows, before they are grouped, so only
    what matches is shuffled. Corpus figures are a single row. Words that repeat in a query count each time. Queries that ask the same are scored once.
    """
    members, asked = terms_asked(queries, tokens)
    split = tokenized(docs, tokens).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    p = split.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    figures = corpus_figures(docs, tokens).first()  # one row
    if not figures["n"]:
        figures = {"n": 0, "avgdl": 1.0}  # there are no postings then
    idf = F.ln((F.lit(figures["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(figures["avgdl"])))
    factors = asked.join(df, "term").select("asks", "term", (idf * F.col("qtf")).alias("x"))
    return scored(members, factors, p.select("doc_id", "term", weight.alias("w")), figures["n"], k, least, block, chunk)


def scored(members: DataFrame, factors: DataFrame, weights: DataFrame, n: int, k: int, least: float = 0.0, block: int = 1024, chunk: int = 4096) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` best of ``n`` documents for each query, from members (query_id, asks), factors (asks, term, x) and weights (doc_id, term, w)."""
    blocks = max(1, -(-members.select("asks").distinct().count() // block))
    scores = products(factors, weights.where("doc_id is not null"), blocks, max(1, -(-n // chunk)), k, max(least, 0.0))
    # pandas would make doubles of ids among which are nulls; texts without id are one document of each query
    nameless = factors.join(weights.where("doc_id is null"), "term").groupBy(F.col("asks").alias("query_id"), "doc_id").agg(F.sum(F.col("x") * F.col("w")).alias("score"))
    best = top(scores.unionByName(nameless.where(F.col("score") > least)), k).withColumnRenamed("query_id", "asks")
    return members.join(best, "asks").select("query_id", "doc_id", "score", "rank")


def products(factors: DataFrame, weights: DataFrame, blocks: int, chunks: int, k: int, least: float) -> DataFrame:
    """query_id, doc_id, score above ``least``: sums over terms of factors (asks, term, x) times weights (doc_id, term, w), the ``k`` best of each query in each chunk of documents.

    Queries are dealt into ``blocks`` and documents into ``chunks``; each meets each once, ``AT_ONCE`` queries at a time, as in ``dense``.
    """
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = factors.select("asks", "term", "x", deal("asks", blocks).alias("block"), every(chunks).alias("chunk"))
    right = weights.select("doc_id", "term", "w", deal("doc_id", chunks).alias("chunk"), every(blocks).alias("block"))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            at, names = pd.factorize(asked["asks"])
            place, ids = pd.factorize(held["doc_id"], use_na_sentinel=False)
            weight = held["w"].to_numpy()
            # a document has a term once, or once for each length if texts share its id
            postings = {t: (place[i], weight[i], len(np.unique(place[i])) == len(i)) for t, i in held.groupby("term", sort=False).indices.items()}
            take = min(k, len(ids))
            for first in range(0, len(names), AT_ONCE):
                some = asked[(at >= first) & (at < first + AT_ONCE)]
                scores = np.zeros((min(AT_ONCE, len(names) - first), len(ids)))
                for query, term, x in zip(at[some.index] - first, some["term"], some["x"], strict=True):
                    if term in postings:
                        docs, w, once = postings[term]
                        if once:
                            scores[query, docs] += x * w
                        else:
                            np.add.at(scores[query], docs, x * w)
                for query, row in enumerate(scores):
                    bound = np.partition(row, len(row) - take)[len(row) - take]
                    near = np.flatnonzero((row >= bound - 1e-8) & (row > least))
                    best = sorted(zip(-np.round(row[near], 9), ids[near], row[near], strict=True))[:k]
                    found += [(names[first + query], doc_id, float(score)) for _, doc_id, score in best]
        return pd.DataFrame(found, columns=["query_id", "doc_id", "score"])

    kind = weights.schema["doc_id"].dataType.simpleString()
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(nearest, f"query_id string, doc_id {kind}, score double")


def index_statistics(docs: DataFrame, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """documents, avg_doc_length, vocabulary: one row."""
    terms = tokenized(docs, tokens).select(F.explode("t").alias("term")).distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    return corpus_figures(docs, tokens).crossJoin(F.broadcast(terms)).select(F.col("n").alias("documents"), F.col("avgdl").alias("avg_doc_length"), "vocabulary")  # one row each


def top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, chunk: int = 8192) -> DataFrame:
    """query_id, doc_id, score, rank by cosine: the ``k`` nearest vectors (doc_id, vector) of each query (query_id, vector), all vectors searched.

    Queries are dealt into blocks and vectors into chunks of bounded size; each meets each once, ``AT_ONCE`` queries at a time, and the k best of a query in
    a chunk go on. Null, empty and zero vectors, and vectors of another length than the query's, are not near anything.
    """
    # floats are dealt as they are and widened, exactly, where they meet
    plain = lambda x: F.col("vector") if x.schema["vector"].dataType == ArrayType(FloatType()) else F.col("vector").cast("array<double>")
    v = vectors.select("doc_id", plain(vectors).alias("v")).where("size(v) > 0")
    q = queries.select("query_id", plain(queries).alias("v")).where("size(v) > 0")
    blocks, chunks = (max(1, -(-x.count() // size)) for x, size in ((q, block), (v, chunk)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("query_id", "v", deal("query_id", blocks).alias("block"), every(chunks).alias("chunk"), F.size("v").alias("d"))
    right = v.select("doc_id", "v", deal("doc_id", chunks).alias("chunk"), every(blocks).alias("block"), F.size("v").alias("d"))
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *v.schema.fields]}

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            x, y = (np.stack(side["v"].to_list()).astype(np.float64) for side in (asked, held))
            lengths, ids, take = np.linalg.norm(y, axis=1), held["doc_id"].to_numpy(), min(k, len(held))
            for at in range(0, len(x), AT_ONCE):
                some = x[at : at + AT_ONCE]
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = some @ y.T
                    scores /= np.linalg.norm(some, axis=1)[:, None] * lengths
                scores[~np.isfinite(scores)] = -np.inf
                for query_id, row in zip(asked["query_id"].iloc[at : at + AT_ONCE], scores, strict=True):
                    least = np.partition(row, len(row) - take)[len(row) - take]
                    near = np.flatnonzero((row >= least - 1e-8) & (row > -np.inf))
                    best = sorted(zip(-np.round(row[near], 9), ids[near], row[near], strict=True))[:k]
                    found += [(query_id, doc_id, float(score)) for _, doc_id, score in best]
        return pd.DataFrame(found, columns=["query_id", "doc_id", "score"])

    met = left.groupBy("d", "block", "chunk").cogroup(right.groupBy("d", "block", "chunk")).applyInPandas(nearest, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    return top(met, k)


def fuse_ranks(runs: list[tuple[DataFrame, float]], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (constant + rank) over runs (query_id, doc_id, rank)."""
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("score")) for r, w in runs]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.union(p)
    return top(merged.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), k)


def fuse_signals(signals: DataFrame) -> DataFrame:
    """Signals (column_name, signal, concept, score, weight, confidence) as one score a concept, how strong the match is, and a reason that names its kinds of signals."""
    fused = signals.groupBy("column_name", "concept").agg((F.sum(F.col("score") * F.col("weight") * F.col("confidence")) / F.sum("weight")).alias("score"), F.count(F.lit(1)).alias("signals"), F.array_sort(F.collect_set("signal")).alias("_kinds"))
    strength = F.when((F.col("score") >= 0.85) & (F.col("signals") >= 2), "EXACT").when(F.col("score") >= 0.6, "RELATED").otherwise("CONTEXTUAL")
    listed = lambda mark: F.array_join("_kinds", mark)
    n = F.size("_kinds")
    reason = F.when(n >= 3, F.concat(F.lit("Multi-signal match: "), listed(", "))).when(n == 2, F.concat(F.lit("Cross-validated: "), listed(" + "))).when(n == 1, F.concat(F.lit("Single signal: "), listed(""))).otherwise("No signal")
    return fused.withColumns({"strength": strength, "reason": reason}).drop("_kinds")
