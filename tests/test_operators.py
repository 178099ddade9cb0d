import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import concepts, evaluation, profile, retrieval, rules, topics
from lodestone.sources import benchmarks
from lodestone.streaming import usage


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_profile_with_nulls_and_constants(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, float("nan"), "x"), (3, 4.0, "x")], "order_id int, price double, label string")
    p = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert (p["order_id"]["unique_count"], p["order_id"]["semantic_type"], p["order_id"]["unique_values"]) == (3, "identifier", True)
    assert (p["price"]["null_count"], p["price"]["mean"], p["price"]["semantic_type"]) == (1, 3.0, "metric")
    assert (p["label"]["unique_count"], p["label"]["mean"], p["label"]["semantic_type"]) == (1, None, "categorical")


def test_profile_of_empty_table(spark):
    p = profile.profile(spark.createDataFrame([], "a int, b string")).collect()
    assert sorted((r["column_name"], r["total_count"], r["null_rate"]) for r in p) == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "x int, y int")
    assert profile.correlations(df, ["x", "y"]).collect()[0]["r"] is None


def test_indel_ratio(spark):
    df = spark.createDataFrame([("customer id", "customer ids"), ("", ""), ("a", "")], "a string, b string")
    got = [r[0] for r in df.select(text.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([100 * 22 / 23, 100.0, 0.0])


def test_cascade(spark):
    c = spark.createDataFrame([("Total Revenue",), ("turnover",), ("the annual consolidated revenues",), ("zzz",)], "column_name string")
    k = spark.createDataFrame([("rev", "total_revenue"), ("r2", "total revenue"), ("con", "the annual consolidated revenue")], "id string, display_name string")
    a = spark.createDataFrame([("Turnover", "rev")], "alias_text string, concept_id string")
    got = {r["column_name"]: (r["concept_id"], r["method"]) for r in concepts.match_columns(c, k, a).collect()}
    assert got == {"Total Revenue": ("r2", "exact"), "turnover": ("rev", "alias"), "the annual consolidated revenues": ("con", "fuzzy"), "zzz": (None, "no_match")}


def test_upsert_keeps_last(spark):
    old = spark.createDataFrame([("c", "Old", 0), ("d", "D", 0)], "id string, v string, seq int")
    new = spark.createDataFrame([("c", "A", 1), ("c", "New", 2)], "id string, v string, seq int")
    assert rows(concepts.upsert(old, new, ["id"]), "id") == [("c", "New"), ("d", "D")]


def test_graph(spark):
    e = spark.createDataFrame([("revenue", "is_a", "metric"), ("cost", "is_a", "metric"), ("revenue", "related_to", "sales")], "source_concept_id string, relationship_type string, target_concept_id string")
    ids = spark.createDataFrame([("revenue",), ("cost",)], "id string")
    assert rows(concepts.parents(e, ids), "id") == [("cost", "metric"), ("revenue", "metric")]
    assert rows(concepts.anchors(e, ids), "links") == [("metric", 2)]
    a = spark.createDataFrame([("income", "revenue"), ("measure", "metric")], "alias_text string, concept_id string")
    got = {r["id"]: r["keywords"] for r in concepts.expanded_keywords(e, a, ids).collect()}
    assert got["revenue"] == ["income", "measure", "metric", "sales"]


def test_bm25_against_plain(spark):
    docs = {1: "the cat sat", 2: "the dog the dog", 3: " "}
    d = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    q = spark.createDataFrame([(7, "dog dog cat")], "query_id int, text string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(d, q).collect()}
    idf, avg = math.log((2 - 1 + 0.5) / 1.5 + 1), 3.5
    norm = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({1: idf * norm(1, 3), 2: 2 * idf * norm(2, 4)})


def test_ranking_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("q", "d", 4)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "c", 1), ("none", "x", 1)], "query_id string, doc_id string, relevance int")
    got = {r["query_id"]: r for r in evaluation.ranking_metrics(run, qrels, 4).collect()}
    assert (got["q"]["precision"], got["q"]["rr"]) == (0.5, 1.0)
    assert got["q"]["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert got["none"]["ndcg"] == 0.0


def test_completeness(spark):
    df = spark.createDataFrame([("This dataset includes revenue and profit.",), ("",)], "text string")
    got = [r[0] for r in df.select(text.completeness(F.col("text"), ["revenue", "profit", "margin"])).collect()]
    assert got == pytest.approx([2 / 3, 0.0])


def test_rules(spark):
    c = spark.createDataFrame([("customer_id",), ("qty",), ("xyz",), ("unit_price",), ("sentiment",), ("humidity",)], "column_name string")
    got = {r["column_name"]: r["problem"] for r in rules.classify_columns(c).collect()}
    assert got == {"customer_id": "skip_kg", "qty": "abbreviation", "xyz": "abbreviation", "unit_price": "domain_anchoring", "sentiment": "domain_anchoring", "humidity": "semantic_search"}  # the rule looks for substrings: sen-time-nt


def test_sources(spark, tmp_path):
    (tmp_path / "topics.tsv").write_text("q1\tfirst\n\nq2\tsecond\twith tab\nq1\tlast\n")
    assert rows(benchmarks.read_topics(spark, str(tmp_path / "topics.tsv")), "query_id") == [("q1", "last"), ("q2", "second\twith tab")]
    (tmp_path / "qrels").write_text("q1 d1 L2\nq1 d2 0\nq1 d3 bad\n")
    assert rows(benchmarks.read_qrels(spark, str(tmp_path / "qrels")), "doc_id") == [("q1", "d1", 2), ("q1", "d2", 0)]
    (tmp_path / "x.json").write_text('{"Net Income": {"definition": "d", "aliases": ["profit"]}}')
    found, aliases = benchmarks.read_lexicon(spark, str(tmp_path / "x.json"))
    assert found.collect()[0]["id"] == "net_income" and rows(aliases, "alias_text") == [("profit", "net_income")]


def test_cost_stream(spark, tmp_path):
    calls = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'x' AS component, 'gpt-4o' AS model, 1000000L AS input_tokens, 0L AS output_tokens")
    calls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = usage.cost_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("costs").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("costs").collect()[0]["cost_usd"] == pytest.approx(2.5)


def test_topics(spark):
    c = spark.createDataFrame([("s", "Price"), ("s", "net-profit"), ("s", "zip"), ("s", "rent"), ("o", "foo"), ("n", None)], "dataset string, column_name string")
    got = [(r["dataset"], r["domain"], r["score"]) for r in topics.domain_scores(c).orderBy("rank").collect()]
    assert got == [("s", "real_estate", 1.0), ("s", "finance", 0.75)]
    assert rows(topics.topics(c), "dataset") == [("n", "general", []), ("o", "general", []), ("s", "real_estate", ["Real Estate Data", "Finance Data"])]
    assert topics.topics(c.limit(0)).count() == 0


def test_benchmark_folders(spark, tmp_path):
    import bz2
    import json

    f = tmp_path / "binary"
    (f / "datasets").mkdir(parents=True)
    (f / "queries.json").write_text(json.dumps([{"query_id": 1, "query_text": "one"}, {"id": "2", "query": "two"}, {"id": "3"}]))
    (f / "qrels.csv").write_text("topic,relevance,document\n1,relevant,d1\n1,0,d2\n2,3,d1\n")
    (f / "datasets" / "my_table.csv").write_text("a,b\n1,2\n")
    (f / "datasets" / "x.json").write_text('{"name": "X", "notes": "n"}')
    b = benchmarks.load_benchmark(spark, "ecir", str(f))
    assert rows(b.queries, "query_id") == [("1", "one"), ("2", "two")] and rows(b.qrels, "query_id", "doc_id") == [("1", "d1", 1), ("1", "d2", 0), ("2", "d1", 3)]
    assert rows(b.datasets.select("id", "title", "description"), "id") == [("my_table", "My Table", None), ("x", "X", "n")]
    assert b.relevant().count() == 2 and b.statistics().collect()[0]["relevance_type"] == "binary"
    assert benchmarks.load_benchmark(spark, "ecir", str(tmp_path)) is None
    (f / "queries2.json").write_text('{"7": "seven"}')
    assert rows(benchmarks.read_json_queries(spark, str(f / "queries2.json")), "query_id") == [("7", "seven")]
    g = tmp_path / "graded"
    g.mkdir()
    (g / "topics.tsv").write_text("q1\tfirst\nq2\tsecond\n")
    (g / "qrels.txt").write_text("".join(f"q1 d{i} L{1 + i % 2}\n" for i in range(10)) + "q2 d1 L2\n")
    (g / "collection.jsonl.bz2").write_bytes(bz2.compress(b'{"id": "", "doc_id": "d1"}\nbroken\n{"_id": "d2"}\n'))
    n = benchmarks.load_benchmark(spark, "ntcir", str(g))
    assert rows(n.queries, "query_id") == [("q1", "first")] and n.qrels.count() == 10 and sorted(r["id"] for r in n.datasets.collect()) == ["d1", "d2"]
    with pytest.raises(ValueError, match="no benchmark"):
        benchmarks.load_benchmark(spark, "other", "x")


def test_tables_and_settings(spark, tmp_path):
    from lodestone.sources import tables

    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,\n')
    assert rows(tables.read_table(spark, str(tmp_path / "t.csv")), "a") == [(1, "x, y"), (2, None)]
    assert tables.settings({"fuzzy_least": 90.0}).fuzzy_least == 90.0
    tables.write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(TypeError):
        tables.settings({"unknown": 1})


def test_profile_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, CAST(id AS DOUBLE) AS v FROM range(4)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = usage.profile_by_window(stream, "v").writeStream.outputMode("complete").format("memory").queryName("profiles").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("profiles").collect()[0]
    assert (r["n"], r["nulls"], r["min"], r["max"], r["mean"]) == (4, 0, 0.0, 3.0, 1.5)
