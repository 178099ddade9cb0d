"""The text and vector indexes against searches over all documents and vectors."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.retrieval import bm25, dense
from lodestone.operators.textindex import TextIndex
from lodestone.operators.vectorindex import VectorIndex


def test_text_index_skips_blocks_and_equals_bm25(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{min(299, int(rng.expovariate(0.02)))}" for _ in range(9000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)) + ["the"] * rng.randrange(1, 4))) for i in range(1500)] + [(9001, None), (9002, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the w1 w2"), (2, "w150 the the"), (3, "nowhere"), (4, "w0"), (5, None), (6, "the")], "query_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/index")
    index.build(docs)
    key = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in df.collect()}
    docs.unpersist()
    for k in (1, 10):
        assert key(index.search(queries, k)) == key(bm25(docs, queries, k))
    met = spark.read.parquet(f"{tmp_path}/index/blocks").where("term = 'the'").count()
    assert index.needed_blocks(queries.where("query_id = 6"), 10).count() < met / 2


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(8)
    centers = [[rng.gauss(0, 3) for _ in range(12)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 1) for c in rng.choice(centers)]) for i in range(1200)]
    odd = [(5001, None), (5002, []), (5003, [0.0] * 12), (5004, [float("nan")] * 12), (5005, [1.0] * 3), (5006, rows[0][1])]
    return spark.createDataFrame([*rows, *odd], "doc_id long, vector array<double>")


def test_vector_index(spark, tmp_path, vectors):
    queries = vectors.where("doc_id % 60 = 0 or doc_id > 5000").withColumnRenamed("doc_id", "query_id")
    index = VectorIndex(spark, f"{tmp_path}/index")
    index.build(vectors, lists=24)
    held = spark.read.parquet(f"{tmp_path}/index/vectors")
    assert held.count() == 1201
    key = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in df.collect()}
    want = key(dense(held.select("doc_id", F.col("v").alias("vector")), queries, 10))
    assert key(index.search(queries, 10, probes=1, exact=True)) == want
    probes = index.probes_for(10)
    found = key(index.search(queries, 10, probes=probes))
    hits = {(q, d) for (q, _), (d, _) in found.items()} & {(q, d) for (q, _), (d, _) in want.items()}
    assert probes < 24 and len(hits) >= 0.9 * len(want)


def test_text_index_shuffles_postings_once(spark, tmp_path, monkeypatch):
    from lodestone.operators import textindex

    monkeypatch.setattr(textindex, "SHARD", 300)
    monkeypatch.setattr(textindex, "PART", 100)
    monkeypatch.setattr(textindex, "CHUNK", 128)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices([f"w{int(rng.expovariate(0.05))}" for _ in range(60)], k=rng.randrange(1, 40))) + " the") for i in range(1100)]
    rows += [(None, "the w1"), (None, "w2 the the"), (7, "the w3"), (7, rows[7][1]), (9001, None), (9002, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the w1 w2"), (2, "w3 the the"), (3, "nowhere"), (4, "W1 the w2"), (5, "w1 w2 the")], "query_id long, text string")
    index = TextIndex(spark, f"{tmp_path}/index")
    index.build(docs)
    key = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 6)) for r in df.collect()}
    for k in (1, 10, 2000):
        assert key(index.search(queries, k)) == key(bm25(docs, queries, k))
    held = spark.read.parquet(f"{tmp_path}/index/blocks")
    assert held.where("term = 'the' and head").count() == 4 and held.where("size(doc_ids) > 128 or size(doc_ids) <> held").count() == 0
    assert not (tmp_path / "index" / "postings").exists()  # postings were written and shuffled four times more
