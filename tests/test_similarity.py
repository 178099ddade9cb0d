"""The similarity join against all pairs, and the matching cascade on it."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import _common_length
from lodestone.operators.concepts import match_columns
from lodestone.operators.similarity import similar_pairs


def ratio(a, b):
    return 200 * _common_length(a, b) / (len(a) + len(b))


@pytest.mark.parametrize("least", [60, 80, 95, 100])
def test_equal_to_all_pairs(spark, least):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    left = [word(rng.randrange(14)) for _ in range(70)] + [word(40) for _ in range(12)] + ["", "x", "x"]
    right = left[:30] + [w[: len(w) // 2] + rng.choice("abz") + w[rng.randrange(len(w) + 1) :] for w in left] + [w[1:] + "b" for w in left[-14:]]
    got = similar_pairs(spark.createDataFrame([(w,) for w in [*left, None]], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), least).collect()
    want = {(a, b): ratio(a, b) for a in set(left) for b in set(right) if a and b and a != b and ratio(a, b) >= least}
    assert {(r["a"], r["b"]): pytest.approx(r["score"]) for r in got} == want


def test_cascade_takes_names_in_order_and_the_last_of_one_name(spark):
    known = spark.createDataFrame([(1, "c1", "Net Sales", "Revenue"), (2, "c2", "", "Customer Name"), (3, "c3", None, None), (4, "c4", "net sales", "x")], "seq long, id string, canonical_name string, display_name string")
    aliases = spark.createDataFrame([(1, "turnover figure", "c1"), (2, "Turnover Figure", "c2")], "seq long, alias_text string, concept_id string")
    columns = spark.createDataFrame([("NET  sales",), ("revenue",), ("customer nam",), ("C3",), ("turnover figure",), ("turnover figures",), ("",)], "column_name string")
    found = match_columns(columns, known, aliases, least=90)
    got = {r["column_name"]: (r["concept_id"], r["method"]) for r in found.collect()}
    assert got == {"NET  sales": ("c4", "exact"), "revenue": (None, "no_match"), "customer nam": ("c2", "fuzzy"), "C3": ("c3", "exact"), "turnover figure": ("c2", "alias"), "turnover figures": ("c2", "fuzzy"), "": (None, "no_match")}


def test_cascade_has_no_nested_loop(spark):
    columns = spark.range(50).select(F.concat(F.lit("column number "), "id").alias("column_name"))
    known = spark.range(50).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("column nmber "), "id").alias("display_name"))
    plan = match_columns(columns, known, known.select(F.col("display_name").alias("alias_text"), F.col("id").alias("concept_id")))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
