"""Details, relationships, extraction and matching rules on small tables."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import concepts, details, evaluation, extraction, generation, graph, injection, profile, prompts, reasoning, relationships, retrieval, rules


def one(df):
    return df.collect()[0].asDict()


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_formats_and_resolutions(spark):
    df = spark.createDataFrame([(i, f"a{i}@x.org", f"2020-0{1 + i}-01", None, "12345") for i in range(3)], "k int, mail string, first string, nothing string, zip string")
    first = details.heads(df, ["mail", "first", "nothing", "zip"], 20, ["k"])
    assert {r["column_name"]: r["value_pattern"] for r in details.value_formats(first).collect()} == {"mail": "email", "first": "phone", "zip": "zip_code"}
    found = by(details.resolutions(first), "column_name")
    assert found["first"]["resolution"] == "month" and found["mail"]["resolution"] is None
    assert details.heads(df.limit(0), ["mail"], 5, ["k"]).count() == 0


def test_constraints(spark):
    df = spark.createDataFrame([(1, 0, 5.0, "a"), (2, 1, None, "a")], "id int, flag int, share_code double, label string")
    c = by(details.constraints(profile.profile(df)), "column_name")
    assert (c["id"]["primary_key_candidate"], c["id"]["foreign_key_candidate"]) == (True, False)
    assert (c["flag"]["boolean_encoded"], c["flag"]["description"]) == (True, "Binary value (0 or 1)")
    assert (c["share_code"]["nullable"], c["share_code"]["foreign_key_candidate"], c["share_code"]["range"]) == (True, True, "between_0_and_100")
    texts = by(details.constraint_texts(details.constraints(profile.profile(df))), "column_name")
    assert texts["id"]["constraints"] == ["NOT NULL", "UNIQUE", "PRIMARY KEY (candidate)", "CHECK (value >= 0)", "CHECK (Value must be between 0 and 100 (possibly percentage))"]


def test_cases(spark, tmp_path):
    cases = spark.createDataFrame([("age", "Age", "integer", 0.5, 0.1), ("fare", "Price", "float", 0.9, 2.0)], "case_name string, label string, data_type string, unique_ratio double, skewness double")
    details.write_cases(cases, str(tmp_path / "cases"))
    (tmp_path / "list.json").write_text("[" + ",".join(r["value"] for r in spark.read.text(str(tmp_path / "cases")).collect()) + "]")
    read = details.read_cases(spark, str(tmp_path / "list.json"))
    q = spark.createDataFrame([("x", "integer", 0.4, 0.1)], "column_name string, data_type string, unique_ratio double, skewness double")
    assert one(details.nearest_cases(q, read)) == {"column_name": "x", "label": "Age", "case_name": "age", "distance": 0.06, "rank": 1}


def test_hierarchies_and_summary(spark):
    df = spark.createDataFrame([("DE", "Bonn", 1), ("DE", "Ulm", 2), ("FR", "Nice", 3), ("FR", "Lyon", 3)], "country string, city string, city_id int")
    p = profile.profile(df, exact=True).join(details.column_types(df).select("column_name", "place"), "column_name")
    h = relationships.named_hierarchies(p)
    assert h.count() == 0  # city has more values than city_id
    h = relationships.named_hierarchies(p.where("column_name <> 'city_id'"))
    assert (one(h)["type"], one(h)["columns"]) == ("geographic", ["country", "city"])
    keys = relationships.foreign_keys(p)
    assert by(keys, "column_name")["city_id"]["confidence"] == 1.0 and "potential_reference_column_exists" in by(keys, "column_name")["city_id"]["reasons"]
    none = spark.createDataFrame([], relationships.DEPENDENCY)
    s = by(relationships.column_relations(p.select("column_name"), h, keys, none), "column_name")
    assert (s["city"]["parent"], s["country"]["children"], s["city_id"]["related"]) == ("country", "city", "city")
    assert relationships.inferred_hierarchies(df.limit(0), p.limit(0)).count() == 0


def test_dependencies(spark):
    df = spark.createDataFrame([(10.0, 4.0, 6.0), (8.0, 5.0, 3.0), (9.0, 9.0, 0.0)], "revenue double, cost double, profit double")
    d = {(r["to_column"], r["relation_type"]): r for r in relationships.dependencies(df, df.columns).collect()}
    assert d["profit", "profit"]["from_columns"] == ["revenue", "cost"] and d["profit", "profit"]["verified"] and d["profit", "profit"]["confidence"] == 0.75


def test_extraction(spark):
    p = spark.createDataFrame([("Total Revenue (USD)", "float", "metric", "currency", 1.0, 9.0)], "column_name string, data_type string, semantic_type string, unit string, min double, max double")
    c = one(extraction.concepts_of(p, "x"))
    assert c["canonical_name"] == "total_revenue_usd" and c["domain"] == "finance" and c["definition"] == "A metric field representing Total Revenue (USD), measured in currency. Data type: float."
    assert sorted((r["alias_text"], r["confidence"]) for r in extraction.aliases_of(p, "x").collect()) == [("Total Revenue", 0.9), ("Total Revenue (USD)", 1.0)]


def test_graph_store(spark, tmp_path):
    g = graph.ConceptGraph(spark, str(tmp_path / "kg"))
    record = lambda *rows: spark.createDataFrame(list(rows), graph.RECORD)
    g.add(record((1, "rev", None, None, "revenue", "d", "finance", '{"hierarchy": {"parent": "Big Metric"}}', ["Income", "Income"], [("cost", None, None, None), ("", "x", 1.0, None)], None), (2, None, None, "no id", None, None, None, None, None, None, None)))
    g.add(record((1, "rev2", None, "Revenue", "revenue", None, None, None, ["Turnover"], None, None), (2, "a", None, "A", None, None, None, None, None, None, None), (3, "b", None, "B", None, None, None, None, None, None, "Top")))
    assert sorted(r["id"] for r in g.table("concepts").collect()) == ["a", "b", "rev2"]  # a canonical name stands once, nulls stand apart
    assert sorted((r["source_concept_id"], r["relationship_type"], r["target_concept_id"], r["confidence"]) for r in g.table("edges").collect()) == [("b", "is_a", "top", 0.5), ("rev", "is_a", "big_metric", 0.5), ("rev", "related_to", "cost", 0.0)]
    encoder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    g.index(encoder)
    g.add_vectors(spark.createDataFrame([("a", [3.0, 4.0])], "id string, vector array<double>"))
    assert by(g.table("vectors"), "id")["a"]["vector"] == pytest.approx([0.6, 0.8])
    q = spark.createDataFrame([(1, " turnover ", [3.0, 4.0])], "query_id int, text string, vector array<double>")
    found = g.search(q, 2).orderBy("rank").collect()
    assert [(r["id"], r["method"]) for r in found] == [("rev2", "alias"), ("a", "vector")]
    assert by(g.statistics(), "store")["aliases"]["n"] == 2 and by(g.with_aliases(), "id")["rev2"]["aliases"] == ["Turnover"]


def test_tiers_and_conflicts(spark):
    m = spark.createDataFrame([("Order Date", 0.9), ("EBITDA margin", 0.9), ("ticker", 0.1), ("humidity", 0.4), ("humidity", 0.75)], "display_name string, score double")
    got = [(r["tier"], r["should_inject"], r["injection_weight"]) for r in injection.tier_filter(m).collect()]
    assert got == [("unknown", True, 0.9), ("tier_1", True, 0.8), ("tier_2", True, 1.0), ("unknown", False, 0.5), ("unknown", True, 0.75)]
    assert [r[0] for r in spark.createDataFrame([("customer_ids",), ("name",), ("s",)], "n string").select(injection.bare_name(F.col("n"))).collect()] == ["customerid", "name", "s"]


def test_reasoning(spark):
    c = spark.createDataFrame([("d", "Open"), ("d", "high"), ("d", "LOW "), ("d", "close"), ("e", "x")], "dataset string, column_name string")
    m = spark.createDataFrame([("d", 1, "a", "finance"), ("d", 2, "b", "finance"), ("e", 1, "a", None)], "dataset string, ordinal int, concept_id string, domain string")
    e = spark.createDataFrame([("a", "is_a", "p"), ("b", "is_a", "p"), ("a", "uses", "b")], "source_concept_id string, relationship_type string, target_concept_id string")
    k = spark.createDataFrame([("a", "A"), ("b", "B"), ("p", "P")], "id string, display_name string")
    got = by(reasoning.dataset_context(c, m, e, k), "dataset")
    assert got["d"]["pattern"] == "Financial_OHLC_TimeSeries" and got["d"]["internal_links"] == ["A --[uses]--> B"] and [tuple(a) for a in got["d"]["anchors"]] == [("P", 2)]
    assert got["e"]["status"] == "insufficient_data" and got["e"]["anchors"] is None


def test_context_fallback_and_rerank(spark):
    columns = spark.createDataFrame([("d", "premium", "float", ["1"]), ("d", "known", "float", ["1"])], "dataset string, column_name string, data_type string, samples array<string>")
    matched = spark.createDataFrame([("d", "known", "c1", 0.9)], "dataset string, column_name string, concept_id string, score double")
    texts = spark.createDataFrame([("d", "known", "patient health")], "dataset string, column_name string, text string")
    got = by(reasoning.with_context(matched, columns, texts), "column_name")
    assert (got["premium"]["concept_id"], got["premium"]["score"], got["known"]["source"]) == ("inferred_premium", 0.75, "matched")
    cand = spark.createDataFrame([("x", "q", str(i), "t" * i, i / 10) for i in range(5)], "column_name string, query string, id string, text string, score double")
    assert [r["id"] for r in reasoning.rerank(cand).orderBy("rank").collect()] == ["4", "3", "2", "1", "0"]

    @F.pandas_udf("double")
    def shorter(q, t):
        return -t.str.len().astype(float)

    assert [r["id"] for r in reasoning.rerank(cand, scorer=shorter, first=3).orderBy("rank").collect()] == ["0", "1", "2"]


def test_prompts(spark):
    a = spark.createDataFrame([
        (1, 'ok ```json\n{"semantic_profiles": {"a": 1}, "ufd": {"title": "t", "core_description": {"text": "x"}}, "sfd": {"summary": "s", "schema_metadata": [1]}}\n```', 1),
        (2, '{"semantic_profiles": {"a": 1,}, "ufd": {"title": ""', 1), (3, "none", 0)], "id int, answer string, expected_columns int")
    got = by(prompts.validated(a), "id")
    assert got[1]["valid"] and not got[2]["valid"] and "UFD missing title" in got[2]["problems"] and got[3]["json"] is None
    p = spark.createDataFrame([(0, "c", "float", 0, 0.0, 3, 1.0, 1.234, 2.0, 1.5, 0.1, 1.5, ["1", "2", "3"])], "place int, column_name string, data_type string, null_count int, null_rate double, unique_count int, unique_ratio double, min double, max double, mean double, std double, median double, samples array<string>")
    m = spark.createDataFrame([("c", "matched", "C", 0.876, "EXACT", None, None, "d" * 400, ["x"])], "column_name string, status string, display_name string, score double, strength string, tier string, should_inject boolean, description string, aliases array<string>")
    text = one(prompts.prompt_batches(p, m, prompts.AGGRESSIVE))["prompt"]
    assert '"sample_values":["1","2"]' in text and '"score":0.88' in text and "d" * 100 + "..." in text and '"std"' not in text
    assert one(spark.createDataFrame([("x [1, 2] y",)], "t string").select(prompts.extracted_array(F.col("t")).alias("a")))["a"] == "[1, 2]"
    d = spark.createDataFrame([(1, "s", ["t"], ["a"], ["b"], [], [("c", "C", "metric", 0.9, "d")])], "id int, summary string, tags array<string>, core array<string>, synonyms array<string>, related array<string>, columns array<struct<column_name: string, concept_name: string, semantic_type: string, confidence: double, description: string>>")
    assert "| c | C | metric | 0.9 | d |" in one(prompts.markdown(d))["markdown"]


def test_generation(spark):
    calls = []

    def failing(prompts):
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        generation.with_retries(failing, tries=3, wait=0.0)(["x"])
    assert len(calls) == 3
    echo = lambda texts: [t.upper() for t in texts]
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, prompt string")
    assert {r["id"]: r["answer"] for r in generation.generate(p.where("prompt is not null"), generation.first_that_answers([(2.0, echo), (1.0, failing)])).collect()} == {1: "A", 2: "A"}
    u = generation.user_descriptions(spark.createDataFrame([("my_set", 0, "a", "x"), ("my_set", 1, "b", "x")], "dataset string, place int, column_name string, domain string"))
    assert one(u)["description"] == "My Set holds 2 columns: a, b."
    k = spark.createDataFrame([("my_set", "z"), ("my_set", "y"), ("my_set", "z")], "dataset string, keyword string")
    assert one(generation.search_descriptions(u, k))["text"] == "My Set holds 2 columns: a, b. y z"


def test_significance(spark):
    values = [(i, 0.1 * i, 0.1 * i + (0.05 if i % 3 else -0.02 * i)) for i in range(12)]
    df = spark.createDataFrame(values, "q int, a double, b double")
    t = one(evaluation.significance(df, "a", "b", "ttest"))
    assert evaluation._t_p(12, 2.201) == pytest.approx(0.05, abs=1e-4) and evaluation._t_p(31, 2.042) == pytest.approx(0.05, abs=2e-4)
    assert 0 < t["p_value"] <= 1 and t["n"] == 12
    assert evaluation._wilcoxon_p(10, 8, 0.0) == pytest.approx(0.048828125) and evaluation._wilcoxon_p(5, 0, 0.0) == 0.0625
    few = one(evaluation.significance(df.limit(2), "a", "b"))
    assert (few["p_value"], few["statistic"], few["significant_005"]) == (1.0, 0.0, False)
    same = one(evaluation.significance(df.withColumn("b", F.col("a")), "a", "b"))
    assert same["p_value"] == 1.0
    pairs = evaluation.pairwise_significance(df.withColumn("c", F.col("a") + 1), ["a", "b", "c"])
    assert sorted(r["pair"] for r in pairs.collect()) == ["a_vs_b", "a_vs_c", "b_vs_c"]


def test_wilcoxon_over_ranges(spark):
    import random

    rng = random.Random(1)
    values = [(rng.choice([-3.0, -1.0, 0.0, 0.5, 1.0, 2.0]) + rng.choice([0, rng.random()]),) for _ in range(300)]
    got = one(evaluation.wilcoxon(spark.createDataFrame(values, "a double").withColumn("b", F.lit(0.0)), "a", "b", ranges=7))
    d = sorted((round(abs(x), 12), x) for (x,) in values if x)
    ranks = {}
    for size in {s for s, _ in d}:
        at = [i + 1 for i, (s, _) in enumerate(d) if s == size]
        ranks[size] = sum(at) / len(at)
    plus = sum(ranks[s] for s, x in d if x > 0)
    assert got["n"] == len(d) and got["statistic"] == pytest.approx(min(plus, len(d) * (len(d) + 1) / 2 - plus))


def test_linear_gain(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2)], "query_id string, doc_id string, relevance int")
    import math

    assert one(evaluation.ranking_metrics(run, qrels, 2, graded=True, linear=True))["ndcg"] == pytest.approx(1 / math.log2(3))


def test_dense_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((80, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(100, [0.0] * 6), (101, None), (102, [1.0])], "doc_id int, vector array<double>")
    q = v.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), "vector")
    got = retrieval.dense(v, q, 4, block=2, chunk=9).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(5):
        mine = [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        assert mine == np.argsort(-(u @ u[i]))[:4].tolist()


def test_fuzzy_threshold_is_the_parameter(spark):
    c = spark.createDataFrame([("custmer name",)], "column_name string")
    k = spark.createDataFrame([("c", "customer name")], "id string, display_name string")
    a = spark.createDataFrame([], "alias_text string, concept_id string")
    assert one(concepts.match_columns(c, k, a, least=90.0))["method"] == "fuzzy" and one(concepts.match_columns(c, k, a, least=97.0))["method"] == "no_match"


def test_caches_and_costs(spark):
    e = spark.sql("SELECT 'a' AS key, 'x' AS value, timestamp'2024-01-01' AS ts UNION ALL SELECT 'a', 'y', timestamp'2024-01-02' UNION ALL SELECT 'b', 'zzz', timestamp'2024-01-03'")
    kept = rules.put(e.limit(0), e)
    assert {r["key"]: r["value"] for r in kept.collect()} == {"a": "y", "b": "zzz"}
    assert [r["key"] for r in rules.evicted(kept, 3).collect()] == ["b"] and rules.evicted(kept, 100).count() == 2
    calls = spark.createDataFrame([("semantic_profiler", "gpt-4o", 4000, 10, False)] * 11, "component string, model string, input_tokens long, output_tokens long, cached boolean")
    advice = {r["advice"] for r in rules.recommendations(rules.cost_summary(calls)).collect()}
    assert advice == {"low cache hit rate", "high average tokens per call", "consider a cheaper model", "use batch processing"}
    routed = spark.createDataFrame([("c", 1)], "column_name string, max_concepts int")
    m = spark.createDataFrame([("c", "x", 0.5), ("c", "y", 0.9)], "column_name string, concept string, score double")
    assert [r["concept"] for r in rules.injected(m, routed).collect()] == ["y"]
    need, skip = rules.need_graph(rules.classify_columns(spark.createDataFrame([("id",), ("mood",)], "column_name string")))
    assert [r["column_name"] for r in need.collect()] == ["mood"] and [r["column_name"] for r in skip.collect()] == ["id"]


def test_describe(spark, tmp_path):
    from lodestone.operators import describe

    df = spark.createDataFrame([(i, 10.0 + i, "AB" if i % 2 else "CD") for i in range(6)], "row_no int, revenue double, tag string")
    known = spark.createDataFrame([("rev", "revenue", "Money that came in"), ("t", "Label", "A label")], "id string, display_name string, definition string")
    aliases = spark.createDataFrame([("tag", "t"), ("income", "rev")], "alias_text string, concept_id string")
    good = '{"semantic_profiles": {"a": 1, "b": 1, "c": 1}, "ufd": {"title": "t", "core_description": {"text": "x"}}, "sfd": {"summary": "s", "schema_metadata": [1]}}'
    d = describe.describe(df, "my_set", ["row_no"], known, aliases, model=lambda p: [good for _ in p])
    m = by(d.matches, "column_name")
    assert (m["revenue"]["status"], m["revenue"]["tier"], m["revenue"]["aliases"]) == ("matched", "tier_1", ["income"]) and m["tag"]["display_name"] == "Label"
    p = one(d.prompts)["prompt"]
    assert p.count('"column"') == 3 and '"concept":"revenue"' in p and '"concept":"Label"' not in p  # common words are not told
    assert one(d.answers)["valid"] and "income" in one(d.search)["text"] and one(d.users)["title"] == "My Set"
    c = by(d.columns, "column_name")
    assert c["tag"]["samples"] == sorted(["AB", "CD"], key=lambda v: __import__("hashlib").md5(f"7:{v}".encode()).hexdigest()) and c["revenue"]["constraints"]["not_null"]
    concepts_found, aliases_found, evidence = describe.extract(df, "my_set", ["row_no"])
    assert (concepts_found.count(), aliases_found.count(), evidence.count()) == (3, 3, 3)
    assert describe.relations(df, details.full_profile(df, ["row_no"], exact=True)).count() == 3


def test_table_cache(spark, tmp_path):
    from lodestone.sources.cache import TableCache

    c = TableCache(spark, str(tmp_path / "cache"), hours=24)
    assert c.entries().count() == 0
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    c.put(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), at(1))
    c.put(spark.createDataFrame([("a", "3")], "key string, value string"), at(3))
    assert {r["key"]: r["value"] for r in c.entries(at(3)).collect()} == {"a": "3"}
    hits, misses = c.lookup(spark.createDataFrame([("a",), ("z",)], "key string"), at(2))
    assert [r["value"] for r in hits.collect()] == ["3"] and [r["key"] for r in misses.collect()] == ["z"]
    c.clear()
    assert c.entries().count() == 0


def test_code_shares_and_semantic_step(spark):
    s = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(["AB1", "XY", "12", "long text", "x"])], "column_name string, place int, value string")
    assert one(details.code_shares(s))["code_share"] == 0.6
    c = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, -1.0])], "column_name string, vector array<double>")
    k = spark.createDataFrame([("c1", "x"), ("c2", "y")], "id string, display_name string")
    v = spark.createDataFrame([("c1", [2.0, 0.1]), ("c2", [0.0, 1.0])], "id string, vector array<double>")
    got = by(concepts.match_columns(c, k, spark.createDataFrame([], "alias_text string, concept_id string"), vectors=v), "column_name")
    assert (got["q"]["concept_id"], got["q"]["method"], got["r"]["method"]) == ("c1", "semantic", "no_match")
