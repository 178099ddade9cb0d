"""Bucketed tables, the concept graph on them, and benchmark files as a data source."""

import bz2
import json

import pytest

from lodestone.operators.graph import RECORD, ConceptGraph
from lodestone.sources.benchmarks import Benchmark, restricted
from lodestone.sources.buckets import BucketTable
from lodestone.sources.formats import last_of, register


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "id string, v long", ["id"], buckets=8)
    assert table.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v long, seq long")
    table.upsert(rows(*[(f"k{i}", i, i) for i in range(100)], ("k1", -1, 500)))
    before, old = table._version()[1]["folders"], table.read()
    touched = table.upsert(rows(("k7", 70, 1), ("k7", 71, 2)))
    after = table._version()[1]["folders"]
    assert len(touched) == 1 and sum(before[b] != after[b] for b in before) == 1
    now = {r["id"]: r["v"] for r in table.read().collect()}
    assert (len(now), now["k7"], now["k1"]) == (100, 71, -1)
    assert {r["id"]: r["v"] for r in old.collect()}["k7"] == 7 and table.read(0).where("id = 'k7'").first()["v"] == 7
    assert len(table.delete(rows(("k7", 0, 0), ("absent", 0, 0)))) <= 2 and table.read().count() == 99
    table.vacuum()
    assert len(table.versions()) == 1 and table.read().count() == 99 and BucketTable(spark, f"{tmp_path}/t", "id string, v long", ["id"]).buckets == 8


def test_a_writer_that_comes_second_starts_again(spark, tmp_path):
    first, second = (BucketTable(spark, f"{tmp_path}/t", "id string, v long", ["id"], buckets=2) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v long")
    first.upsert(rows(("a", 1)))
    commit, tries = second._commit, []

    def late(number, folders):
        if not tries:
            tries.append(number)
            first.upsert(rows(("b", 2)))
        return commit(number, folders)

    second._commit = late
    second.upsert(rows(("c", 3)))
    assert {(r["id"], r["v"]) for r in second.read().collect()} == {("a", 1), ("b", 2), ("c", 3)} and second.versions() == [0, 1, 2]


def test_graph_gives_way_to_new_canonical_names(spark, tmp_path):
    graph = ConceptGraph(spark, f"{tmp_path}/g", buckets=4)
    record = lambda seq, name, canonical: (seq, name, None, name.upper(), canonical, "", None, None, [f"alias {name}"], [("z", None, None, None)], "Big Thing")
    graph.add(spark.createDataFrame([record(1, "a", "one"), record(2, "b", "two"), record(3, "c", "one")], RECORD))
    assert {r["id"] for r in graph.table("concepts").collect()} == {"b", "c"}
    touched = graph.add(spark.createDataFrame([record(1, "d", "two")], RECORD))
    assert {r["id"] for r in graph.table("concepts").collect()} == {"c", "d"} and len(touched["concepts"]) <= 2
    assert graph.concept(spark.createDataFrame([("c",), ("c",), ("x",)], "id string")).count() == 1
    graph.index(lambda texts: [[float(len(x)), 1.0] for x in texts])
    assert {r["id"] for r in graph.vector(spark.createDataFrame([("c",), ("d",)], "id string")).collect()} == {"c", "d"}


def test_benchmark_files_as_a_data_source(spark, tmp_path):
    register(spark)
    (tmp_path / "topics.tsv").write_text("q1\tsome  text\nbroken line\nq2\tété\r\n\nq1\tlast one\n" + "".join(f"x{i}\t{'w' * (i % 50)}\n" for i in range(2000)), encoding="utf-8")
    read = lambda kind, name, **o: spark.read.format("benchmark").options(kind=kind, path=f"{tmp_path}/{name}", **o).load()
    for size in ("1000000", "777"):
        rows = read("topics", "topics.tsv", splitBytes=size)
        assert rows.count() == 2003 and {r["query_id"]: r["text"] for r in last_of(rows, "query_id").where("query_id like 'q%'").collect()} == {"q1": "last one", "q2": "été"}
    assert read("topics", "topics.tsv", splitBytes="777").rdd.getNumPartitions() > 10
    with pytest.raises(Exception, match="broken line"):
        read("topics", "topics.tsv", mode="FAILFAST").count()
    (tmp_path / "qrels.txt").write_text("q1 d1 L2\nq1 d1 0 1\nq1 d2\nq2 d2 x\nq2\td3\tL0\n")
    got = last_of(read("qrels", "qrels.txt"), "query_id", "doc_id").collect()
    assert {(r["query_id"], r["doc_id"], r["relevance"]) for r in got} == {("q1", "d1", 1), ("q2", "d3", 0)}
    (tmp_path / "qrels.csv").write_text('topic,relevance,document\nt1,yes,"a, b"\nt1,2,c\nt1,no\n')
    assert {(r["query_id"], r["doc_id"], r["relevance"]) for r in read("csv_qrels", "qrels.csv").collect()} == {("t1", "a, b", 1), ("t1", "c", 2)}
    lines = [json.dumps({"id": f"d{i}", "title": f"T{i}", "notes": "n", "data": [{"data_format": "CSV" if i % 2 else "xml"}]}) for i in range(50)] + ["{broken", '{"title": "no id"}', "[1]"]
    (tmp_path / "c.jsonl.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    found = read("collection", "c.jsonl.bz2")
    assert found.count() == 50 and found.where("id = 'd3'").first()["description"] == "n"
    qrels = spark.createDataFrame([("q1", f"d{i}", 1) for i in range(20)] + [("q2", f"d{i}", 1) for i in range(0, 20, 2)], "query_id string, doc_id string, relevance int")
    queries = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query_id string, text string")
    left = restricted(Benchmark("b", queries, qrels, found.drop("at"), True))
    assert [r["query_id"] for r in left.queries.collect()] == ["q1"] and left.qrels.count() == 10 and left.datasets.count() == 25
