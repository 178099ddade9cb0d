"""What failed on larger tables: each query's answer stays whole, and its work grows with the input only."""

from pyspark.sql import functions as F

from lodestone.operators import retrieval


def test_equal_queries_are_scored_once(spark):
    docs = spark.createDataFrame([(i, f"ring w{i % 7} " + "steel " * (i % 3)) for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, ["ring steel w1", "w1 Steel ring", "ring ring steel w1", "none"][i % 4]) for i in range(40)], "query_id long, text string")
    members, asked = retrieval.terms_asked(queries)
    assert members.count() == 40 and asked.select("asks").distinct().count() == 3  # the order of words doesn't count, how often one is there does
    found = {}
    for r in retrieval.bm25(docs, queries, 3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 9)))
    assert len(found) == 30 and all(len(x) == 3 for x in found.values())
    alone = retrieval.bm25(docs, queries.where("query_id < 3"), 3).orderBy("rank").collect()
    for q, rows in found.items():
        assert sorted(rows) == [(r["rank"], r["doc_id"], round(r["score"], 9)) for r in alone if r["query_id"] == (q % 4 if q % 4 != 1 else 1)]


def test_dense_search_holds_few_scores_at_once(spark):
    import inspect

    from lodestone.operators.retrieval import AT_ONCE, dense

    sizes = {n: p.default for n, p in inspect.signature(dense).parameters.items()}
    assert AT_ONCE * sizes["chunk"] <= 1 << 21  # scores; a worker held a block's, 2^26
    vectors = spark.range(700).select(F.col("id").alias("doc_id"), F.array(*[F.sin(F.col("id") * i + i).cast("float") for i in range(1, 9)]).alias("vector"))
    queries = vectors.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id")
    key = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in df.collect()}
    doubles = queries.withColumn("vector", F.col("vector").cast("array<double>"))
    want = key(dense(vectors, doubles, 3))
    assert len(want) == 1050 and want == key(dense(vectors, queries, 3, block=50, chunk=90))
    assert all(want[q, 1][1] == 1.0 for q, _ in want)  # the query itself, or its equal


def test_eviction_is_exact_among_close_times(spark):
    from lodestone.operators import quantiles, rules

    micros = F.expr("case when id < 299990 then 1704067200000000 + (id * 7919) % 299993 else 253402300799000000 - id end")
    entries = spark.range(300_000).select(F.col("id").alias("key"), F.lit("x" * 9).alias("value"), F.timestamp_micros(micros).alias("ts"))
    times = sorted(r[0] for r in entries.select(F.unix_micros("ts")).collect())
    for share in (0.2, 0.37, 0.999991):
        last = times[max(1, -int(-share * 300_000 // 1)) - 1]
        assert quantiles.value_at_rank(entries, F.unix_micros("ts"), -int(-share * 300_000 // 1)) == last
        assert rules.evicted(entries, 1000, share).count() == sum(x > last for x in times)
    ntz = entries.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert rules.evicted(ntz, 1000).count() == rules.evicted(entries, 1000).count() == 240_000
    assert quantiles.value_at_rank(spark.createDataFrame([(-(2**63),), (2**63 - 1,), (None,), (5,)], "v long"), F.col("v"), 2) == 5


def test_all_trusted_documents_count_beyond_what_is_broadcast(spark):
    from lodestone.llm import ngram_quality as Q

    docs = spark.createDataFrame([(i if i % 50 else None, f"the river w{i % 11} flows", "en" if i % 3 else None) for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    few, all_ = (Q.with_parts(docs, labels, most) for most in (7, 10**6))
    want = sorted(map(tuple, all_.collect()), key=str)
    assert sum(r[3] > 0 for r in want) == 293 and sorted(map(tuple, few.collect()), key=str) == want
    rows = lambda most: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in Q.quality(docs, labels, 0.9, most_trusted=most).collect()), key=str)
    assert rows(7) == rows(10**6)


def test_bm25_in_blocks_against_plain(spark):
    import math

    texts = [(2**60 + i % 45, f"ring w{i % 7} " + "steel " * (i % 5)) for i in range(60)] + [(None, "steel ring"), (None, "steel steel w1"), (1, " "), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(i, f"ring ring w{i % 9} steel") for i in range(12)] + [(99, "nothing"), (100, None)]
    rows = [(d, x.split()) for d, x in texts if x and x.split()]
    n, mean = len(rows), sum(len(x) for _, x in rows) / len(rows)
    tf = {}
    for d, x in rows:
        for w in x:
            tf[d, len(x), w] = tf.get((d, len(x), w), 0) + 1
    df = {w: sum(key[2] == w for key in tf) for w in {key[2] for key in tf}}
    want = {}
    for q, x in asked:
        score = {}
        for (d, dl, w), m in tf.items():
            idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
            score[d] = score.get(d, 0) + idf * m * 2.5 / (m + 1.5 * (0.25 + 0.75 * dl / mean)) * (x or "").split().count(w)
        best = sorted((-round(s, 9), -1 if d is None else d) for d, s in score.items() if s > 0)[:9]
        want |= {(q, r): (d, -s) for r, (s, d) in enumerate(best, 1)}
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for sizes in ({}, {"block": 2, "chunk": 7}):
        got = retrieval.bm25(docs, queries, 9, **sizes).collect()
        assert {(r["query_id"], r["rank"]): (-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in got} == want


def test_states_count_values_as_they_are(spark):
    from lodestone.operators.sketches import column_states

    rows = [(1, "NaN", 0.0, [1]), (1, "NaN", -0.0, None), (2, "x", float("nan"), [1]), (2, "NaN", None, [2])]
    df = spark.createDataFrame(rows, "part int, s string, z double, m array<int>")
    states = column_states(df, ["s", "z", "m"])
    assert {(r[0], x["value"], x["m"]) for r in states.select("column_name", "frequent").collect() for x in r[1]} == {("s", "NaN", 3), ("s", "x", 1), ("z", "0.0", 2), ("m", "[1]", 2), ("m", "[2]", 1)}
    plan = column_states(df, ["s", "z"], by=["part"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # each row was made one of strings for each column


def test_profile_queries_keep_states_and_count_once(spark, tmp_path):
    from lodestone.plans.queries import QUERIES

    for name in ("profile_merged_states", "profile_files"):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("hll_sketch_agg") == 0  # states are read, not made again by each use of them
        assert out.count() == 6


def test_answers_are_parsed_once(spark):
    from lodestone.operators import prompts

    good = '{"semantic_profiles": {"c": {}}, "ufd": {"title": "t", "core_description": {"text": "x"}}, "sfd": {"summary": "s", "schema_metadata": [1]}}'
    odd = {
        1: good, 2: "```json\n" + good + "\n```", 3: "Here: " + good[:-1], 4: good.replace('"s"', "{ }").replace("[1]", "[ ]"), 5: '{"semantic_profiles": [1], "ufd": null, "sfd": "text"}', 6: "no", 7: None, 8: "{} ```",
        9: '{"semantic_profiles": "{\\"a\\": 1}", "ufd": [{"title": "t"}], "sfd": {"summary": 0, "schema_metadata": {"x": null}}}', 10: good.replace('"x"', "null"), 11: "```\n" + good[:-2] + ",}\n``` }", 12: "[" + good + "]",
    }
    d = spark.createDataFrame([(k, v, 1) for k, v in odd.items()], "id int, answer string, expected_columns int")
    out = prompts.validated(d)
    assert out.columns == ["id", "answer", "expected_columns", "json", "problems", "valid"]
    got = {r["id"]: r["problems"] for r in out.collect()}
    none, core, title = "no JSON object", "UFD missing core_description.text", "UFD missing title"
    gone = ["Missing top-level key: semantic_profiles", "Missing top-level key: ufd", "Missing top-level key: sfd"]
    rest = [title, core, "SFD missing summary", "SFD missing schema_metadata"]
    count = "semantic_profiles count mismatch"
    assert [got[i] for i in (1, 2, 3, 4, 10)] == [[], [], [], rest[2:], [core]]
    assert got[5] == [gone[1], count, *rest] and got[9] == [title, core]
    assert got[6] == got[7] == [none, *gone, count, *rest] and got[8] == [*gone, count, *rest]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") <= 4 and "get_json_object" not in plan.lower()


def test_dependencies_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    from lodestone.operators import profile

    df = spark.range(900).select("id", (F.col("id") % 30).alias("a"), (F.col("id") % 10).alias("b"), F.when(F.col("id") > 5, F.lit("x")).alias("c")).coalesce(1)
    pairs = [("id", "a"), ("a", "b"), ("b", "a"), ("c", "b"), ("b", "c")]
    want = sorted(map(tuple, profile.functional_dependencies(df, pairs).collect()))
    assert {r[:2] for r in want if r[4]} == {("id", "a"), ("a", "b"), ("b", "c")}
    monkeypatch.setattr(profile, "PAIRS", 300)
    out = profile.functional_dependencies(df, pairs)
    assert sorted(map(tuple, out.collect())) == want
    assert "RoundRobinPartitioning(15)" in out._jdf.queryExecution().executedPlan().toString().replace("roundrobinp", "RoundRobinP")
