"""Ranking metrics for whole runs, experiments over fields, and tests between methods."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import search_tokens
from lodestone.operators.retrieval import K1, B, bm25, scored, terms_asked

CUTOFFS = (1, 5, 10, 20)
METRICS = ("ndcg", "precision", "recall", "rr", "ap")


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, graded: bool = False, linear: bool = False) -> DataFrame:
    """query_id, ndcg, precision, recall, rr, ap for each query of ``qrels`` (query_id, doc_id, relevance).

    run: query_id, doc_id, rank from 1. The ideal order is that of the retrieved list, or with ``graded`` that of all
    judgments, with gains 2 ** relevance - 1, or the relevance itself with ``linear``. Queries with nothing retrieved have 0 throughout.
    """
    judged = run.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("relevance", F.lit(0)))
    judged = judged.withColumn("rel", F.when(F.col("rel") > 0, F.col("rel") if graded else F.lit(1)).otherwise(0))
    gain = lambda c: c.cast("double") if linear else F.pow(F.lit(2.0), c) - 1
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    by_rel = Window.partitionBy("query_id").orderBy(F.desc("rel"))
    j = judged.withColumns({"hits": F.sum((F.col("rel") > 0).cast("int")).over(by_rank), "ideal": F.row_number().over(by_rel)})
    discounted = lambda place: F.sum(F.when(F.col(place) <= k, gain(F.col("rel")) / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    per = j.groupBy("query_id").agg(
        discounted("rank").alias("dcg"), discounted("ideal").alias("own_ideal"),
        F.count_if((F.col("rel") > 0) & (F.col("rank") <= k)).alias("found"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    all_rel = qrels.withColumn("rel", F.greatest("relevance", F.lit(0))).withColumn("ideal", F.row_number().over(by_rel))
    of = all_rel.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("relevant"), discounted("ideal").alias("full_ideal"))
    both = of.join(per, "query_id", "left")
    ideal = F.col("full_ideal") if graded else F.col("own_ideal")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id", zero(F.when(ideal > 0, F.col("dcg") / ideal)).alias("ndcg"), zero(F.col("found") / k).alias("precision"),
        zero(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant"))).alias("recall"), zero(1 / F.col("first")).alias("rr"),
        zero(F.when(F.col("relevant") > 0, F.col("precisions") / F.col("relevant"))).alias("ap"),
    )


def metrics_at(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, graded: bool = False, experiments: Sequence[str] | None = None) -> DataFrame:
    """[experiment,] k, queries, ndcg, precision, recall, mrr, map: means over all judged queries for each cut-off, of ``experiments`` side by side if the run has that column.

    All cut-offs and experiments come from one pass over the run: each query's sums for every cut-off are columns of one aggregate. Metrics are those of ``ranking_metrics``.
    """
    by = [] if experiments is None else ["experiment"]
    judged = run.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("relevance", F.lit(0)))
    judged = judged.withColumn("rel", F.when(F.col("rel") > 0, F.col("rel") if graded else F.lit(1)).otherwise(0))
    by_rel = lambda *c: Window.partitionBy(*c, "query_id").orderBy(F.desc("rel"))
    j = judged.withColumns({"hits": F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy(*by, "query_id").orderBy("rank")), "ideal": F.row_number().over(by_rel(*by))})
    gain = lambda place, k: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    per = j.groupBy(*by, "query_id").agg(
        *[x for k in cutoffs for x in (gain("rank", k).alias(f"dcg{k}"), gain("ideal", k).alias(f"own{k}"), F.count_if((F.col("rel") > 0) & (F.col("rank") <= k)).alias(f"found{k}"))],
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    of = qrels.withColumn("rel", F.greatest("relevance", F.lit(0))).withColumn("ideal", F.row_number().over(by_rel()))
    of = of.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("relevant"), *[gain("ideal", k).alias(f"full{k}") for k in cutoffs])
    if by:
        of = of.withColumn("experiment", F.explode(F.array(*map(F.lit, experiments))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = F.col("relevant") > 0
    at = []
    for k in cutoffs:
        ideal = F.col(f"full{k}" if graded else f"own{k}")
        at.append(F.struct(F.lit(k).alias("k"), zero(F.when(ideal > 0, F.col(f"dcg{k}") / ideal)).alias("ndcg"), zero(F.col(f"found{k}") / k).alias("precision"), zero(F.when(some, F.col(f"found{k}") / F.col("relevant"))).alias("recall")))
    rows = of.join(per, [*by, "query_id"], "left").select(*by, zero(1 / F.col("first")).alias("rr"), zero(F.when(some, F.col("precisions") / F.col("relevant"))).alias("ap"), F.explode(F.array(*at)).alias("x")).select(*by, "x.*", "rr", "ap")
    return rows.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(n) for c, n in (("ndcg", "ndcg"), ("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("ap", "map"))])


def experiment_documents(datasets: DataFrame, methods: dict[str, tuple[list[str], str | None]], descriptions: DataFrame | None = None) -> DataFrame:
    """experiment, doc_id, text: what each method indexes of each dataset, from one pass.

    datasets: id and any of title, description, columns (array); descriptions: id, method, ufd, sfd. A method names its fields in order (title, description, columns, ufd, sfd)
    and whose descriptions it takes; the fields that a dataset has are joined by spaces. Datasets known from descriptions only
    are indexed too; those without text are not.
    """
    d = datasets.withColumnRenamed("id", "doc_id")
    if descriptions is not None:
        told = descriptions.groupBy(F.col("id").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("ufd", "sfd")))).alias("told"))
        d = d.join(told, "doc_id", "full")
    own = {"title": F.col("title"), "description": F.col("description"), "columns": F.array_join("columns", " ") if "columns" in datasets.columns else F.lit(None)}

    def part(field: str, source: str | None):
        if field in ("ufd", "sfd"):
            return F.try_element_at("told", F.lit(source))[field]
        return own[field]

    texts = [F.struct(F.lit(name).alias("experiment"), F.concat_ws(" ", *[F.nullif(part(f, source), F.lit("")) for f in fields]).alias("text")) for name, (fields, source) in methods.items()]
    return d.select("doc_id", F.explode(F.array(*texts)).alias("x")).select("x.experiment", "doc_id", "x.text").where(F.trim("text") != "")


def run_matrix(documents: DataFrame, queries: DataFrame, qrels: DataFrame, experiments: Sequence[str], path: str, cutoffs: tuple[int, ...] = CUTOFFS, graded: bool = False, tokens=search_tokens) -> DataFrame:
    """experiment, k, queries, documents and metrics of BM25 for all experiments (experiment, doc_id, text) and cut-offs at once.

    Texts are cut once, into an index below ``path``; lengths, frequencies and scores of all experiments come from it in one plan with
    the experiment as a column, summed in blocks of queries and chunks of documents. Five times as many documents as the largest cut-off are retrieved; only queries with judgments count.
    """
    asked = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    judged = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    documents.select("experiment", "doc_id", tokens(F.col("text")).alias("t")).write.mode("overwrite").parquet(path)
    spark = documents.sparkSession
    index = spark.read.parquet(path).where(F.size("t") > 0)
    found = index.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avgdl")).collect()  # a row for each experiment
    figures = F.broadcast(spark.createDataFrame(found, "experiment string, n long, avgdl double"))
    members, asks = terms_asked(asked, tokens)
    split = index.select("experiment", "doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    p = split.join(asks.select("term").distinct(), "term", "left_semi").groupBy("experiment", "term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")).join(figures, "experiment")
    df = p.groupBy("experiment", "n", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # a query of each experiment asks for words of that experiment only, so all are scored together
    own = F.concat_ws(":", F.length("experiment").cast("string"), "experiment", "term").alias("term")
    of = F.concat("asks", "experiment").alias("asks")
    factors = asks.join(df, "term").select(of, own, (idf * F.col("qtf")).alias("x"))
    held = members.crossJoin(F.broadcast(figures.select("experiment"))).select(F.struct("experiment", "query_id").alias("query_id"), of)
    best = scored(held, factors, p.select("doc_id", own, weight.alias("w")), max([r["n"] for r in found], default=0), 5 * max(cutoffs))
    run = best.select("query_id.experiment", "query_id.query_id", "doc_id", "score", "rank")
    return metrics_at(run, judged, cutoffs, graded, experiments).join(figures.select("experiment", F.col("n").alias("documents")), "experiment", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


def comparison_table(results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, references: DataFrame | None = None) -> DataFrame:
    """method, num_queries, ndcg_<k> for each cut-off, map, mrr, is_reference: a row for each experiment, rounded half to even at 4 digits.

    references: rows of values cited from elsewhere (method, num_queries and some of the figures), put in as they are.
    """
    figure = lambda k: F.bround(F.max(F.when(F.col("k") == k, F.col("ndcg"))), 4).alias(f"ndcg_{k}")
    rows = results.groupBy(F.col("experiment").alias("method")).agg(F.max("queries").alias("num_queries"), *[figure(k) for k in cutoffs], F.bround(F.max("map"), 4).alias("map"), F.bround(F.max("mrr"), 4).alias("mrr")).withColumn("is_reference", F.lit(False))
    return rows if references is None else rows.unionByName(references.withColumn("is_reference", F.lit(True)), allowMissingColumns=True)


def run_experiment(docs: DataFrame, queries: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, graded: bool = False) -> DataFrame:
    """Metrics of BM25 over documents (doc_id, text), retrieving five times as many as the largest cut-off, for queries that have judgments."""
    asked = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    judged = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    return metrics_at(bm25(docs, asked, 5 * max(cutoffs)), judged, cutoffs, graded)


def comparison(experiments: dict[str, DataFrame]) -> DataFrame:
    """experiment, k, queries and metrics of several experiments, rounded half to even at 4 digits."""
    parts = [m.select(F.lit(name).alias("experiment"), "k", "queries", *[F.bround(c, 4).alias(c) for c in ("ndcg", "precision", "recall", "mrr", "map")]) for name, m in experiments.items()]
    return reduce(DataFrame.union, parts)


def relevance_distribution(qrels: DataFrame) -> DataFrame:
    """relevance, n of judgments, 0 to 2 also where there is none."""
    counts = qrels.groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))
    levels = qrels.sparkSession.range(3).select(F.col("id").cast("int").alias("relevance"))
    return levels.join(counts, "relevance", "full").select("relevance", F.coalesce("n", F.lit(0)).alias("n"))


def judged_only(docs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Documents that some query has a judgment of."""
    return docs.join(qrels.select("doc_id").distinct(), "doc_id", "left_semi")


def with_format(docs: DataFrame, qrels: DataFrame, kind: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Documents of which any resource (data: array of structs with data_format) has the format, and the judgments of these."""
    kept = docs.where(F.exists("data", lambda x: F.lower(F.trim(x["data_format"])) == kind))
    return kept, qrels.join(kept.select("doc_id"), "doc_id", "left_semi")


def paired_t(scores: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean_difference, t of two score columns over the same queries; t is null where all differences are equal."""
    d = F.col(a) - F.col(b)
    return scores.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))


def wilcoxon(scores: DataFrame, a: str, b: str, ranges: int = 256) -> DataFrame:
    """n, statistic, tie_term: the smaller sum of signed ranks of the differences that are not zero, ties with their mean rank.

    Sizes of differences are cut into ranges at approximate quantiles; ranks are those inside a range plus the counts of the ranges
    before, so no task ranks all sizes. tie_term: the sum of t ** 3 - t over groups of ties.
    """
    d = scores.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").groupBy("d").agg(F.count(F.lit(1)).alias("m")).withColumn("size", F.round(F.abs("d"), 12))
    sizes = d.groupBy("size").agg(F.sum("m").alias("ties"), F.sum(F.when(F.col("d") > 0, F.col("m")).otherwise(0)).alias("plus"))
    bounds = sizes.agg(F.percentile_approx("size", [i / ranges for i in range(1, ranges)], 10 * ranges)).collect()[0][0] or []  # one row of fixed size
    bounds = sorted(set(bounds))
    spot = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col("size"))) if bounds else F.lit(0)
    sizes = sizes.withColumn("range", spot)
    sums = sizes.groupBy("range").agg(F.sum("ties").alias("n"))
    sums = sums.withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    inside = F.coalesce(F.sum("ties").over(Window.partitionBy("range").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("inside", inside).join(F.broadcast(sums.select("range", "earlier")), "range")
    ranked = ranked.withColumn("mean_rank", F.col("earlier") + F.col("inside") + (F.col("ties") + 1) / 2)
    plus, minus = F.sum(F.col("mean_rank") * F.col("plus")), F.sum(F.col("mean_rank") * (F.col("ties") - F.col("plus")))
    ties = F.col("ties").cast("double")
    return ranked.agg(F.coalesce(F.sum("ties"), F.lit(0)).alias("n"), F.least(plus, minus).alias("statistic"), F.coalesce(F.sum(ties * ties * ties - ties), F.lit(0.0)).alias("tie_term"))


def _wilcoxon_p(n: int, statistic: float, tie_term: float) -> float:
    """Two-sided: exact for up to 50 differences without ties, else by the normal approximation with the correction for ties."""
    if n == 0:
        return 1.0
    if n <= 50 and tie_term == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for i in range(1, n + 1):
            for s in range(len(ways) - 1, i - 1, -1):
                ways[s] += ways[s - i]
        return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return math.erfc(abs(statistic - n * (n + 1) / 4) / spread / math.sqrt(2))


def _t_p(n: int, t: float) -> float:
    """Two-sided probability of Student's t with n - 1 degrees of freedom, by the continued fraction of the incomplete beta function."""
    a, b = (n - 1) / 2, 0.5
    x = (n - 1) / (n - 1 + t * t)
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + term * d or 1e-300), 1 + term / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def significance(scores: DataFrame, a: str, b: str, test: str = "wilcoxon") -> DataFrame:
    """n, statistic, p_value, significant_005, significant_001, mean_a, mean_b, mean_diff (b - a): one row.

    With less than 3 pairs the result is neutral: 0, 1, false. The sums are Spark's; only the row of them goes through Python.
    """
    pairs = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    found = wilcoxon(pairs, a, b) if test == "wilcoxon" else paired_t(pairs, a, b).select("n", F.col("t").alias("statistic"), F.lit(0.0).alias("tie_term"))

    @F.pandas_udf("double")
    def p(n: pd.Series, statistic: pd.Series, ties: pd.Series) -> pd.Series:
        one = (lambda n, s, t: _wilcoxon_p(int(n), s, t)) if test == "wilcoxon" else (lambda n, s, t: _t_p(int(n), s) if n > 1 and s == s else 1.0)
        return pd.Series([one(*x) for x in zip(n, statistic.fillna(0.0), ties, strict=True)])

    enough = F.col("pairs") >= 3
    out = means.crossJoin(F.broadcast(found)).withColumn("p_value", F.when(enough, p("n", F.coalesce("statistic", F.lit(0.0)), "tie_term")).otherwise(1.0))  # one row each
    zero = lambda c: F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return out.select(
        F.col("pairs").alias("n"), zero(F.col("statistic").cast("double")).alias("statistic"), "p_value", (F.col("p_value") < 0.05).alias("significant_005"), (F.col("p_value") < 0.01).alias("significant_001"),
        zero(F.col("mean_a")).alias("mean_a"), zero(F.col("mean_b")).alias("mean_b"), zero(F.col("mean_b") - F.col("mean_a")).alias("mean_diff"),
    )


def pairwise_significance(scores: DataFrame, methods: list[str], test: str = "wilcoxon") -> DataFrame:
    """pair and the result of ``significance`` for each two methods, columns of scores by query."""
    return reduce(DataFrame.union, [significance(scores, a, b, test).select(F.lit(f"{a}_vs_{b}").alias("pair"), "*") for a, b in combinations(methods, 2)])


def judged_enough(qrels: DataFrame, min_relevant: int = 5, min_total: int = 10) -> DataFrame:
    """Judgments of queries that have ``min_total`` or more, ``min_relevant`` of them relevant."""
    kept = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevance") >= 1).alias("r")).where((F.col("n") >= min_total) & (F.col("r") >= min_relevant))
    return qrels.join(kept.select("query_id"), "query_id", "left_semi")
