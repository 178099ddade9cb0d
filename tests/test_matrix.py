"""Experiments side by side, running context, list-wise rerank, and tables given as arguments."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import title_case
from lodestone.operators import evaluation, injection, reasoning, retrieval, rules


def test_matrix_equals_single_experiments(spark, tmp_path):
    rows = [(str(i), f"title {i % 3}", f"text word{i % 5} word{i % 7}", ["c1", f"col{i % 4}"]) for i in range(60)]
    datasets = spark.createDataFrame(rows, "id string, title string, description string, columns array<string>")
    told = spark.createDataFrame([("1", "m", "word1 word2", "s"), ("900", "m", "word1", "")], "id string, method string, ufd string, sfd string")
    queries = spark.createDataFrame([("q1", "word1"), ("q2", "title word2"), ("q3", "col1"), ("q4", "unjudged")], "query_id string, text string")
    qrels = spark.createDataFrame([("q1", "1", 2), ("q1", "900", 1), ("q1", "6", 0), ("q2", "2", 1), ("q3", "77", 1)], "query_id string, doc_id string, relevance int")
    methods = {"all": (["title", "description"], None), "columns": (["columns"], None), "made": (["title", "ufd"], "m"), "none": (["sfd"], "other")}
    documents = evaluation.experiment_documents(datasets, methods, told).cache()
    assert documents.where("experiment = 'made' and doc_id = '900'").first()["text"] == "word1" and documents.where("experiment = 'none'").count() == 0
    for graded in (True, False):
        found = evaluation.run_matrix(documents, queries, qrels, list(methods), f"{tmp_path}/i{graded}", (1, 5), graded)
        for name in ("all", "columns", "made"):
            one = evaluation.run_experiment(documents.where(F.col("experiment") == name).select("doc_id", "text"), queries, qrels, (1, 5), graded)
            singles = {k: evaluation.ranking_metrics(retrieval.bm25(documents.where(F.col("experiment") == name).select("doc_id", "text"), queries.where("query_id <> 'q4'"), 25), qrels, k, graded).agg(F.avg("ndcg"), F.avg("ap")).first() for k in (1, 5)}
            mine = {r["k"]: r for r in found.where(F.col("experiment") == name).collect()}
            assert {r["k"]: pytest.approx((r["ndcg"], r["recall"], r["mrr"])) for r in one.collect()} == {k: (r["ndcg"], r["recall"], r["mrr"]) for k, r in mine.items()}
            assert {k: pytest.approx(tuple(v)) for k, v in singles.items()} == {k: (r["ndcg"], r["map"]) for k, r in mine.items()}
        assert {(r["k"], r["queries"], r["ndcg"], r["documents"]) for r in found.where("experiment = 'none'").collect()} == {(1, 3, 0.0, 0), (5, 3, 0.0, 0)}
    table = evaluation.comparison_table(found, (1, 5), spark.createDataFrame([("cited", 0.7)], "method string, ndcg_5 double"))
    assert {(r["method"], r["is_reference"]) for r in table.collect()} == {*[(m, False) for m in methods], ("cited", True)}


def test_only_columns_before_count(spark):
    columns = spark.createDataFrame([("t", i, c, "float", ["1", "2"]) for i, c in enumerate(["open", "x1", "stock", "close", "volume"])], "dataset string, place int, column_name string, data_type string, samples array<string>")
    matched = spark.createDataFrame([("t", "stock", "c1", 0.9), ("t", "x1", None, 0.0)], "dataset string, column_name string, concept_id string, score double")
    texts = spark.createDataFrame([("t", "stock", "stock market price")], "dataset string, column_name string, text string")
    got = {r["column_name"]: (r["source"], r["domain"], r["concept_id"]) for r in reasoning.with_running_context(matched, columns, texts).collect()}
    assert got == {"open": ("no_match", None, None), "x1": ("no_match", None, None), "stock": ("matched", None, "c1"), "close": ("context_inference", "Finance", "inferred_close"), "volume": ("context_inference", "Finance", "inferred_volume")}


def test_listwise_answers_are_joined_by_id(spark):
    columns = spark.createDataFrame([(c, "string", ["v"]) for c in "abc"], "column_name string, data_type string, samples array<string>")
    rows = [(c, f"{c}{i}", f"name {i}", None, ["x"], 0.9 - i / 10) for c in "abc" for i in range(5)]
    candidates = spark.createDataFrame(rows, "column_name string, id string, display_name string, definition string, aliases array<string>, score double")

    def model(prompts):
        out = []
        for p in prompts:
            c = p.split("Column: `")[1][0]
            good = json.dumps([{"concept_id": f"{c}2", "match_score": 0.95, "justification": "fits"}, {"concept_id": f"{c}2", "match_score": 0.99}, {"concept_id": "zz", "match_score": 1}])
            out.append({"a": f"```json\n{good}\n```", "b": "no list", "c": "[{broken]"}[c])
        return out

    got = {}
    for r in reasoning.rerank_listwise(columns, candidates, model).orderBy("column_name", "rank").collect():
        got.setdefault(r["column_name"], []).append((r["id"], round(r["rerank_score"], 3)))
    assert got["a"] == [("a2", 0.99), ("a0", 0.9), ("a1", 0.8), ("a3", 0.6), ("a4", 0.5)]
    assert got["b"] == [("b0", 0.9), ("b1", 0.8), ("b2", 0.7), ("b3", 0.6), ("b4", 0.5)] and [x for x, _ in got["c"]] == ["c0", "c1", "c2", "c3", "c4"]


def test_tables_as_arguments_and_reasons(spark):
    df = spark.createDataFrame([("foo",), ("kwh_total",)], "column_name string")
    assert {r["column_name"]: r["problem"] for r in rules.classify_columns(df, skipped=["^foo$"], abbreviations=["kwh_total"]).collect()} == {"foo": "skip_kg", "kwh_total": "abbreviation"}
    named = spark.createDataFrame([("widget", 0.9)], "display_name string, score double")
    assert injection.tier_filter(named, common=["widget"]).first()["tier"] == "tier_0"
    pair = spark.createDataFrame([("widget", "c", "string", None, None, 1, 0.1, None, 0.9), ("gadget", "c", "string", None, None, 1, 0.1, None, 0.8)], "display_name string, column_name string, data_type string, min double, max double, unique_count int, unique_ratio double, skewness double, score double")
    assert injection.conflicts(pair, expected=[("widget", ["int"], None, None, None)]).where("display_name = 'widget'").first()["conflict_type"] == "type_mismatch"
    assert [r["display_name"] for r in injection.ranked_matches(pair).orderBy("rank").collect()] == ["widget", "gadget"]
    signals = spark.createDataFrame([("c", s, "k", 0.9, 0.5, 0.9) for s in ("b", "a", "a")], "column_name string, signal string, concept string, score double, weight double, confidence double")
    assert retrieval.fuse_signals(signals).first()["reason"] == "Cross-validated: a + b"
    assert spark.createDataFrame([("o'neil 3rd_big ÉTÉ",)], "x string").select(title_case(F.col("x"))).first()[0] == "O'Neil 3Rd_Big Été"


def test_matrix_makes_no_row_for_each_term_query_and_document(spark, tmp_path):
    documents = spark.createDataFrame([("a", i, f"ring w{i % 3}") for i in range(30)] + [("b", i, f"w{i % 2}") for i in range(9)], "experiment string, doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1 ring"), (2, "ring W1"), (3, "w0")], "query_id long, text string")
    qrels = spark.createDataFrame([(1, 1, 1), (2, 4, 1), (3, 3, 1)], "query_id long, doc_id long, relevance int")
    out = evaluation.run_matrix(documents, queries, qrels, ["a", "b"], f"{tmp_path}/i", (1, 5))
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["experiment"], r["k"]): (r["documents"], round(r["mrr"], 6)) for r in out.collect()}
    assert got == {("a", 1): (30, round((1 + 1 / 2 + 1 / 2) / 3, 6)), ("a", 5): (30, round((1 + 1 / 2 + 1 / 2) / 3, 6)), ("b", 1): (9, round(1 / 3, 6)), ("b", 5): (9, round(1 / 3, 6))}
