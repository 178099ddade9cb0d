"""One query for each operator over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import concepts, evaluation, profile, retrieval, rules, sketches, textindex, topics, vectorindex
from lodestone.sources.profiles import ProfileStore
from lodestone.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(digits: int, df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(6, df, *columns)


LINEITEM = {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(median(CAST({c} AS DOUBLE)), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM lineitem" for c, k in LINEITEM.items()))
def profile_basic_lineitem(spark, sf_dir):
    p = profile.profile(t(spark, sf_dir, "lineitem").select(*LINEITEM), exact=True)
    return rounded(4, p.select("column_name", "data_type", "total_count", "null_count", "unique_count", "mean", "std", "min", "max", "q25", "median", "q75"), "mean", "std", "q25", "median", "q75")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def profile_moments(spark, sf_dir):
    return r6(profile.profile(t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")).select("column_name", "skewness", "kurtosis"), "skewness", "kurtosis")


_LINES = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
_LINE_NUMBERS = _LINES[:-1]
_NEAR = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, "
    + (f"round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(skewness(CAST({c} AS DOUBLE)), 4) AS skewness, round(kurtosis(CAST({c} AS DOUBLE)), 4) AS kurtosis" if c in _LINE_NUMBERS else "NULL AS mean, NULL AS std, NULL AS min, NULL AS max, NULL AS skewness, NULL AS kurtosis")
    + f", TRUE AS unique_near, {'TRUE' if c in _LINE_NUMBERS else 'NULL'} AS median_near, TRUE AS top_near FROM lineitem" for c in _LINES
)


def _near(found, df):
    """Figures from states, and whether those from sketches are within their error of exact ones, counted here."""
    counted = [sketches.value_counts(df, c).agg(F.count(F.lit(1)).alias("u"), F.max("m").alias("most")).select(F.lit(c).alias("c"), "u", "most") for c in _LINES]
    exact = reduce(DataFrame.union, counted)
    ranks = [F.struct(F.lit(c).alias("name"), F.avg((F.col(c) < F.col(f"_{c}")).cast("double")).alias("under"), F.avg((F.col(c) <= F.col(f"_{c}")).cast("double")).alias("upto")) for c in _LINE_NUMBERS]
    medians = found.where("median is not null").groupBy().agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(f"_{c}") for c in _LINE_NUMBERS])
    placed = df.crossJoin(F.broadcast(medians)).agg(*ranks).select(F.inline(F.array(*[F.col(x) for x in df.crossJoin(medians).agg(*ranks).columns])))  # medians: one row
    met = found.join(exact, F.col("column_name") == F.col("c")).join(placed, F.col("column_name") == F.col("name"), "left")
    near = {"unique_near": F.abs(F.col("unique_count") - F.col("u")) <= 0.03 * F.col("u"), "median_near": F.when(F.col("median").isNotNull(), (F.col("under") <= 0.54) & (F.col("upto") >= 0.46)), "top_near": F.col("top_count").between(F.col("most") - F.col("off"), F.col("most"))}
    out = met.withColumns(near).select("column_name", "total_count", "null_count", "mean", "std", "min", "max", "skewness", "kurtosis", *near)
    return rounded(4, out, "mean", "std", "skewness", "kurtosis")


@query(_NEAR)
def profile_merged_states(spark, sf_dir):
    """States of two halves of a table, kept, then merged."""
    where = scratch_path(spark, "profile-states")
    df = t(spark, sf_dir, "lineitem").select(*_LINES)
    halves = df.withColumn("half", F.col("l_orderkey") % 2)
    sketches.column_states(halves, _LINES, by=["half"]).drop("half").write.parquet(where)  # merging reads them several times
    return _near(sketches.profile_of_states(sketches.merge_states(spark.read.parquet(where))), df)


@query(_NEAR)
def profile_files(spark, sf_dir):
    """States of the files of a table, of which one comes later and alone is read then."""
    where = scratch_path(spark, "profile-files")
    df, store = t(spark, sf_dir, "lineitem").select(*_LINES), ProfileStore(spark, where + "/states")
    df.where("l_orderkey % 3 <> 0").write.parquet(where + "/table")
    store.refresh(where + "/table")
    df.where("l_orderkey % 3 = 0").write.mode("append").parquet(where + "/table")
    return _near(store.profile(where + "/table"), df)


_MOMENTS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS kind, CAST(count({c}) AS DOUBLE) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, skewness({c}) AS s1, kurtosis({c}) AS s2, kurtosis_pop({c}) AS g2, skewness({c}) * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1)) AS g1 FROM {tb}" for c, k, tb in (("value", "float", "events"), ("p_retailprice", "float", "part"), ("p_size", "integer", "part")))


@query(f"""WITH m AS ({_MOMENTS}), a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y0, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, 3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v,
6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM m), b AS (SELECT *, asinh((CASE WHEN y0 = 0 THEN 1 ELSE y0 END) / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS aa, (g2 + 3 - e) / sqrt(v) AS x FROM a),
c AS (SELECT *, 1 + x * sqrt(2 / (aa - 4)) AS d FROM b), k AS (SELECT *, z1 * z1 + power(((1 - 2 / (9 * aa)) - sign(d) * cbrt((1 - 2 / aa) / abs(d))) / sqrt(2 / (9 * aa)), 2) AS k2 FROM c)
SELECT column_name, CASE WHEN n < 8 THEN 'insufficient_data' WHEN k2 < -2 * ln(0.05) THEN 'gaussian' WHEN abs(s1) < 0.5 AND s2 < -1 THEN 'uniform' WHEN abs(s1) > 2 THEN 'zipf_like' WHEN s2 < -0.5 AND abs(s1) < 1 THEN 'bimodal' WHEN s1 > 1 THEN 'skewed_right' WHEN s1 < -1 THEN 'skewed_left' ELSE 'non_gaussian' END AS distribution_type,
CASE WHEN lo >= 0 AND hi <= 1 THEN 'ratio_or_probability' WHEN lo >= 0 AND hi <= 100 THEN 'possible_percentage' WHEN lo < 0 THEN 'signed_value_profit_loss_or_delta' WHEN kind = 'integer' AND hi > 1000000 THEN 'large_positive_possibly_monetary' WHEN kind = 'integer' AND hi > 100 THEN 'positive_integer_possibly_count' WHEN hi > 10000 THEN 'large_positive_possibly_monetary' END AS value_range_semantics,
CASE column_name WHEN 'p_retailprice' THEN 'metric' ELSE 'numerical' END AS semantic_type FROM k""")
def profile_distribution(spark, sf_dir):
    p = profile.profile(t(spark, sf_dir, "events").select("value")).union(profile.profile(t(spark, sf_dir, "part").select("p_retailprice", "p_size")))
    return p.select("column_name", "distribution_type", "value_range_semantics", "semantic_type")


@query("""WITH v AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY column_name) AS total FROM c)
SELECT column_name, value, n, round(n / total, 6) AS share, rank FROM r WHERE rank <= 5""")
def profile_top_values(spark, sf_dir):
    return r6(profile.top_values(t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]), "share")


@query("""SELECT column_name, bool_or(total > unique_count) IS NOT TRUE AS unique_values, bool_and(lo >= 0) AS non_negative, bool_and(lo > 0) AS positive FROM (
SELECT 'c_custkey' AS column_name, count(*) AS total, count(DISTINCT c_custkey) AS unique_count, min(c_custkey) AS lo FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey), min(c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', count(*), count(DISTINCT c_acctbal), min(c_acctbal) FROM customer) GROUP BY column_name""")
def profile_constraints(spark, sf_dir):
    return profile.profile(t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), exact=True).select("column_name", "unique_values", "non_negative", "positive")


def _fd(table: str, a: str, b: str) -> str:
    return f"SELECT '{a}' AS determinant, '{b}' AS dependent, round(avg(n), 6) AS mean_distinct, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_share, avg(n) < 1.05 AND count(*) > 2 AS holds FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM {table} GROUP BY {a})"


@query(" UNION ALL ".join([_fd("nation", "n_nationkey", "n_regionkey"), _fd("nation", "n_regionkey", "n_nationkey"), _fd("nation", "n_name", "n_regionkey")]))
def rel_functional_dependency(spark, sf_dir):
    pairs = [("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey"), ("n_name", "n_regionkey")]
    return r6(profile.functional_dependencies(t(spark, sf_dir, "nation"), pairs), "mean_distinct", "single_share")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST(regr_count({a}, {b}) AS BIGINT) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def rel_correlation(spark, sf_dir):
    return r6(profile.correlations(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r")


_PART = {"p_partkey": True, "p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True}
_PART_PAIRS = [(a, b) for i, a in enumerate(_PART) for b in list(_PART)[i + 1 :]]


@query(
    " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, 'correlation' AS type, round_even(r, 3) AS weight FROM (SELECT corr({a}, {b}) AS r, regr_count({a}, {b}) AS n FROM part) WHERE n > 5 AND abs(r) > 0.5" for a, b in _PART_PAIRS if _PART[a] and _PART[b])
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', '{b}', 'functional_dependency', 1.0 FROM (SELECT count(DISTINCT {b}) AS n FROM part WHERE {a} IS NOT NULL GROUP BY {a}) HAVING avg(n) < 1.05 AND count(*) > 2" for a, b in _PART_PAIRS)
)
def rel_related_columns(spark, sf_dir):
    return profile.related_columns(t(spark, sf_dir, "part").select(*_PART))


@query("""SELECT round(avg(abs(y - (p + q))) / (avg(abs(y)) + 1e-10), 6) AS sum_error, round(avg(abs(y - (p - q))) / (avg(abs(y)) + 1e-10), 6) AS difference_error,
round(avg(abs(y - p * q)) / (avg(abs(y)) + 1e-10), 6) AS product_error, least(avg(abs(y - (p + q))), avg(abs(y - (p - q))), avg(abs(y - p * q))) / (avg(abs(y)) + 1e-10) < 0.1 AS derived
FROM (SELECT l_extendedprice AS y, l_quantity AS p, l_tax AS q FROM lineitem)""")
def rel_derived_column(spark, sf_dir):
    return r6(profile.derived_column(t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_tax"), "sum_error", "difference_error", "product_error")


def _edges(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source_concept_id"), F.lit("is_a").alias("relationship_type"), F.col("r_name").alias("target_concept_id"))


@query("SELECT n_name AS id, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def kg_parents(spark, sf_dir):
    return concepts.parents(_edges(spark, sf_dir), t(spark, sf_dir, "nation").select(F.col("n_name").alias("id")))


@query("SELECT r_name AS id, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey")
def kg_children(spark, sf_dir):
    return concepts.children(_edges(spark, sf_dir), t(spark, sf_dir, "region").select(F.col("r_name").alias("id")))


@query("SELECT r_name AS target_concept_id, count(*) AS links FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) >= 2 ORDER BY links DESC, r_name LIMIT 3")
def kg_anchors(spark, sf_dir):
    return concepts.anchors(_edges(spark, sf_dir), t(spark, sf_dir, "nation").select(F.col("n_name").alias("id")))


@query("SELECT p_partkey AS id, p_name AS display_name, p_type AS definition FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%' ORDER BY p_partkey LIMIT 3")
def kg_keyword_search(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("display_name"), F.col("p_type").alias("definition"))
    return concepts.keyword_search(parts, "an")


@query("""WITH n AS (SELECT o_custkey AS id, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1),
o AS (SELECT o_custkey AS id, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1) SELECT coalesce(n.id, o.id) AS id, coalesce(n.priority, o.priority) AS priority FROM n FULL JOIN o ON n.id = o.id""")
def kg_upsert(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.struct("o_orderdate", "o_orderkey").alias("seq"), "o_orderdate")
    old, new = (rows.where(c).drop("o_orderdate") for c in ("o_orderdate < timestamp'1998-01-01 00:00:00'", "o_orderdate >= timestamp'1998-01-01 00:00:00'"))
    return concepts.upsert(concepts.upsert(old.limit(0), old, ["id"]).withColumn("seq", F.lit(None).cast(rows.schema["seq"].dataType)), new, ["id"])


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
_BM25 = f"""d AS (SELECT doc_id, {_TOKENS} AS toks FROM documents WHERE trim(coalesce(text, '')) <> ''),
p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d WHERE len(toks) > 0), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM tf JOIN q USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


def _bm25(spark, sf_dir, k=10):
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(t(spark, sf_dir, "documents").select("doc_id", "text"), asked, k)


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return r6(_bm25(spark, sf_dir), "score")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_index(spark, sf_dir):
    """The same from an index that is built first; the search reads no documents."""
    index = textindex.TextIndex(spark, scratch_path(spark, "bm25"))
    index.build(t(spark, sf_dir, "documents").select("doc_id", "text"))
    return r6(index.search(t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10), "score")


_DENSE = "v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"


def _vectors(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return r6(retrieval.dense(*_vectors(spark, sf_dir)), "score")


_REL = "qr AS (SELECT i.item_id AS query_id, l.doc_id, l.quality + 0 AS relevance FROM labels l JOIN benchmark i ON l.doc_id % 40 = i.item_id)"


@query(f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v) WHERE rank <= 10")
def vector_index(spark, sf_dir):
    """The nearest vectors from an index of inverted lists in its exact mode."""
    index = vectorindex.VectorIndex(spark, scratch_path(spark, "vectors"))
    vectors, queries = _vectors(spark, sf_dir)
    index.build(vectors)
    return r6(index.search(queries, 10, exact=True), "score")


@query("SELECT count(*) AS queries, 10 * count(*) AS wanted, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """Whether nine tenths of what comparing all vectors finds is in the lists probed, as many as a sample of vectors asks for."""
    index = vectorindex.VectorIndex(spark, scratch_path(spark, "vectors"))
    vectors, queries = _vectors(spark, sf_dir)
    index.build(vectors, lists=16)
    found, wanted = index.search(queries, 10, probes=index.probes_for(10)).select("query_id", "doc_id"), retrieval.dense(vectors, queries, 10).select("query_id", "doc_id")
    met = wanted.join(found.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))



def _qrels(spark, sf_dir):
    labels, items = t(spark, sf_dir, "labels"), t(spark, sf_dir, "benchmark")
    return labels.join(items, F.col("doc_id") % 40 == F.col("item_id")).select(F.col("item_id").alias("query_id"), "doc_id", F.col("quality").alias("relevance"))


@query(f"""WITH {_BM25}, {_REL},
j AS (SELECT r.query_id, rank, CASE WHEN coalesce(relevance, 0) > 0 THEN 1 ELSE 0 END AS rel FROM ranked r LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 100),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS ideal FROM j),
m AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg,
 sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS found, min(CASE WHEN rel > 0 THEN rank END) AS first, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS precisions FROM h GROUP BY query_id),
n AS (SELECT query_id, sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS relevant FROM qr GROUP BY query_id)
SELECT query_id, round(coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0), 6) AS ndcg, round(coalesce(found / 10, 0), 6) AS precision,
 round(coalesce(CASE WHEN relevant > 0 THEN found / relevant END, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(CASE WHEN relevant > 0 THEN precisions / relevant END, 0), 6) AS ap
FROM n LEFT JOIN m USING (query_id)""")
def eval_binary(spark, sf_dir):
    return r6(evaluation.ranking_metrics(_bm25(spark, sf_dir, 100), _qrels(spark, sf_dir), 10), "ndcg", "precision", "recall", "rr", "ap")


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def eval_ttest(spark, sf_dir):
    return r6(evaluation.paired_t(t(spark, sf_dir, "lineitem"), "l_discount", "l_tax"), "mean_difference", "t")


@query("""WITH d AS (SELECT round(abs(l_discount - l_tax), 12) AS size, l_discount > l_tax AS plus FROM lineitem WHERE l_discount - l_tax <> 0),
s AS (SELECT size, count(*) AS ties, count(*) FILTER (plus) AS p FROM d GROUP BY size),
r AS (SELECT *, coalesce(sum(ties) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ties + 1) / 2 AS mean_rank FROM s)
SELECT CAST(sum(ties) AS BIGINT) AS n, CAST(least(sum(mean_rank * p), sum(mean_rank * (ties - p))) AS DOUBLE) AS statistic FROM r""")
def eval_wilcoxon(spark, sf_dir):
    return evaluation.wilcoxon(t(spark, sf_dir, "lineitem"), "l_discount", "l_tax").drop("tie_term")


@query("SELECT query_id, doc_id, relevance FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (relevance >= 1) OVER w AS r FROM (SELECT i.item_id AS query_id, l.doc_id, l.quality AS relevance FROM labels l JOIN benchmark i ON l.doc_id % 40 = i.item_id) WINDOW w AS (PARTITION BY query_id)) WHERE n >= 10 AND r >= 5")
def bench_query_filter(spark, sf_dir):
    return evaluation.judged_enough(_qrels(spark, sf_dir))


_SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '')"
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@query(f"""WITH q AS (SELECT doc_id, {_SENT} AS s, {_WORDS} AS w FROM documents),
m AS (SELECT doc_id, s, w, list_sum(list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')))) / len(s) AS mean FROM q)
SELECT doc_id, round(CASE WHEN len(w) > 0 AND len(s) > 0 THEN greatest(0.0, least(1.0, (206.835 - 1.015 * (len(w) / len(s)) - 84.6 * (floor(len(w) * 1.5) / len(w))) / 100)) ELSE 0 END, 6) AS readability,
round(CASE WHEN len(w) > 0 AND len(s) > 0 THEN least(1.0, (CASE WHEN mean BETWEEN 15 AND 25 THEN 1.0 ELSE 0.8 END + len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)) / 2) ELSE 0 END, 6) AS fluency FROM m""")
def quality_text(spark, sf_dir):
    return r6(text.with_quality(t(spark, sf_dir, "documents")).select("doc_id", "readability", "fluency"), "readability", "fluency")


@query("""WITH c AS (SELECT event_type AS component, CASE user_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model, event_id % 1000 AS i, user_id % 500 AS o, event_id % 4 = 0 AS cached FROM events),
p AS (SELECT *, i / 1e6 * CASE model WHEN 'gpt-4o' THEN 2.5 WHEN 'gpt-4o-mini' THEN 0.15 ELSE 1 END + o / 1e6 * CASE model WHEN 'gpt-4o' THEN 10 WHEN 'gpt-4o-mini' THEN 0.6 ELSE 3 END AS cost FROM c)
SELECT component, model, count(*) AS calls, CAST(sum(i + o) AS BIGINT) AS tokens, round(CAST(sum(cost) AS DOUBLE), 6) AS cost_usd, round(avg(CASE WHEN cached THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM p GROUP BY GROUPING SETS ((component), (model), ())""")
def cost_summary(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    model = F.when(F.col("user_id") % 3 == 0, "gpt-4o").when(F.col("user_id") % 3 == 1, "gpt-4o-mini").otherwise("other")
    calls = e.select(F.col("event_type").alias("component"), model.alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 500).alias("output_tokens"), (F.col("event_id") % 4 == 0).alias("cached"))
    return r6(rules.cost_summary(calls), "cost_usd", "hit_rate")


_TOPIC_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
_WORD_ROWS = ", ".join(f"('{w}', '{d}', {i})" for i, (d, words) in enumerate(topics.DOMAINS.items()) for w in words)


@query(f"""WITH c AS (SELECT table_name AS dataset, lower(column_name) AS name FROM information_schema.columns WHERE table_name IN {_TOPIC_TABLES}),
p AS (SELECT dataset, unnest(list_append(string_split(replace(name, '-', '_'), '_'), name)) AS word FROM c), n AS (SELECT dataset, count(*) AS size FROM c GROUP BY dataset),
k(word, domain, place) AS (VALUES {_WORD_ROWS}), f AS (SELECT dataset, domain, place, count(*) AS found FROM p JOIN k USING (word) GROUP BY ALL)
SELECT dataset, domain, round(found / size, 6) AS score, row_number() OVER (PARTITION BY dataset ORDER BY found / size DESC, place) AS rank FROM f JOIN n USING (dataset)""")
def topic_domains(spark, sf_dir):
    names = [(name, f.name) for name in _TOPIC_TABLES for f in t(spark, sf_dir, name).schema.fields]
    return r6(topics.domain_scores(spark.createDataFrame(names, "dataset string, column_name string")), "score")
