"""Exact quantiles by selection, mergeable states, and profiles that read new files only."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.profile import distinct_counts, functional_dependencies, profile, related_columns
from lodestone.operators.quantiles import exact_quantiles
from lodestone.operators.sketches import column_states, merge_states, profile_of_states
from lodestone.sources.profiles import ProfileStore


@pytest.mark.parametrize(("few", "accuracy"), [(1_000_000, 1000), (40, 30)])
def test_quantiles_are_exact(spark, few, accuracy):
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.choice([1, 1, 1, 1, 2, 9]), float("nan") if i % 3 else float(i), None, 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "normal double, tied long, some double, none double, one int")
    got = {r["column_name"]: r["q"] for r in exact_quantiles(df, {c: F.col(c) for c in df.columns}, (0.0, 0.25, 0.5, 0.9, 1.0), few, accuracy).collect()}
    for i, c in enumerate(df.columns):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        want = np.quantile(values, (0.0, 0.25, 0.5, 0.9, 1.0)).tolist() if values else [None] * 5
        assert got[c] == (pytest.approx(want) if values else want), c
    assert exact_quantiles(df.limit(0), {"tied": F.col("tied")}).collect()[0]["q"] == [None] * 3


def test_exact_profile_has_no_percentile(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", -0.0), (2, None, float("nan"))], "k long, s string, z double")
    plan = profile(df, exact=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    assert {r[0]: r[1] for r in distinct_counts(df).collect()} == {"k": 2, "s": 1, "z": 1}


def test_merged_states_equal_one_pass(spark):
    rng = random.Random(2)
    rows = [(i % 3, rng.gauss(100, 5), rng.choice("aab") if i % 7 else None, 5.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "part int, x double, s string, same double")
    columns = ["x", "s", "same"]
    of = lambda states: {r["column_name"]: r for r in profile_of_states(states).collect()}
    states = column_states(df, columns, by=["part"])
    steps = merge_states(merge_states(states.where("part < 2").drop("part")).unionByName(states.where("part = 2").drop("part")))
    one, merged, twice = of(column_states(df, columns)), of(merge_states(states.drop("part"))), of(steps)
    exact = {r["column_name"]: r for r in profile(df.select(*columns)).collect()}
    for c in columns:
        for found in (one[c], merged[c], twice[c]):
            for k in ("total_count", "null_count", "mean", "std", "min", "max", "skewness", "kurtosis"):
                assert found[k] == (exact[c][k] if exact[c][k] is None else pytest.approx(exact[c][k], abs=1e-9)), (c, k)
            assert found["unique_count"] == pytest.approx(exact[c]["unique_count"], rel=0.03)
        assert merged[c]["top_value"] == one[c]["top_value"] and merged[c]["off"] >= 0
    below = sum(r[1] <= merged["x"]["median"] for r in rows) / len(rows)
    assert below == pytest.approx(0.5, abs=0.03)
    assert column_states(df.limit(0), columns, by=["part"]).count() == 0


def test_only_new_files_are_read(spark, tmp_path):
    table, store = f"{tmp_path}/table", ProfileStore(spark, f"{tmp_path}/states")
    df = spark.range(900).select("id", (F.col("id") % 5).cast("string").alias("s"))
    df.where("id < 600").repartition(3).write.parquet(table)
    assert store.refresh(table) == 3 and store.refresh(table) == 0
    df.where("id >= 600").coalesce(1).write.mode("append").parquet(table)
    assert store.refresh(table) == 1
    got = {r["column_name"]: r for r in store.profile(table).collect()}
    assert (got["id"]["total_count"], got["id"]["mean"], got["id"]["max"], got["s"]["unique_count"], got["s"]["top_count"]) == (900, 449.5, 899.0, 5, 180)
    df.where("id >= 700").coalesce(1).write.mode("overwrite").parquet(table)
    assert {r["column_name"]: r["total_count"] for r in store.profile(table).collect()} == {"id": 200, "s": 200}
    store.vacuum(table)
    assert store.states().select("file").distinct().count() == 1 and store.refresh(table) == 0


def test_dependencies_and_relations(spark):
    rows = [(i, i % 10, (i % 10) // 2, float(i) * 2, "k" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, digit int, half int, twice double, s string")
    got = {(r["determinant"], r["dependent"]): (r["mean_distinct"], r["holds"]) for r in functional_dependencies(df, [("digit", "half"), ("half", "digit"), ("s", "id")]).collect()}
    assert got == {("digit", "half"): (1.0, True), ("half", "digit"): (2.0, False), ("s", "id"): (45.0, False)}
    found = {(r["source"], r["target"], r["type"]): r["weight"] for r in related_columns(df).collect()}
    assert found["id", "twice", "correlation"] == 1.0 and ("digit", "half", "functional_dependency") in found and ("half", "twice", "functional_dependency") not in found
    assert ("id", "twice", "correlation") not in {(r["source"], r["target"], r["type"]) for r in related_columns(df.limit(5)).collect()}
