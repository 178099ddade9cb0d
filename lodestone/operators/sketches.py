"""Profiles from mergeable states: counts, moments, distinct-value and quantile sketches and frequent values of each column, kept and merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.profile import data_type

#: log2 of the registers of a distinct-value sketch (off by 1.04 / sqrt of them), size of a quantile sketch (ranks off by about 1.33 %), frequent values kept.
REGISTERS, RANKS, FREQUENT = 14, 200, 1000
#: Columns whose figures are aggregated in one pass.
TOGETHER = 2
STATE = ["n", "present", "sum1", "mean", "m2", "m3", "m4", "min", "max", "hll", "kll", "frequent", "dropped"]


def column_states(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One state for each group of ``by`` and each column: ``by``, column_name, data_type and what ``merge_states`` can add up.

    present counts values that are neither null nor NaN. Numbers have mean and central sums of powers 2 to 4, least and largest value and a KLL sketch. Every column
    has an HLL sketch of the hashes of its values, and its ``FREQUENT`` most frequent values with their counts; dropped is the most that a
    value left out can have had, so counts are off by that at most.
    ``TOGETHER`` columns are aggregated in a pass that reads no others: with more the generated code is too long to be compiled. Values are counted
    as they are, in a pass over each column, and only counted ones become strings.
    """
    fields = {f.name: f for f in df.schema.fields if f.name not in by}
    names = list(columns) if columns is not None else list(fields)
    per: list[Column] = []
    for i, name in enumerate(names):
        kind = data_type(fields[name].dataType)
        c = F.col(f"`{name}`")
        if kind == "float":
            c = F.when(~F.isnan(c.cast("double")), c)
        number = c.cast("double") if kind in ("integer", "float") else F.lit(None).cast("double")
        count = F.count(c)
        v = F.var_pop(number)
        per.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"), F.count(F.lit(1)).alias("n"), count.alias("present"), F.sum(number).alias("sum1"), F.avg(number).alias("mean"),
            (v * count).alias("m2"), (F.skewness(number) * F.pow(v, 1.5) * count).alias("m3"), ((F.kurtosis(number) + 3) * v * v * count).alias("m4"), F.min(number).alias("min"), F.max(number).alias("max"),
            F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), REGISTERS).alias("hll"), F.kll_sketch_agg_double(number, RANKS).alias("kll"),
        ).alias(f"c{i}"))
    passes = []
    for at in range(0, len(names), TOGETHER):
        some = range(at, min(at + TOGETHER, len(names)))
        passes.append(df.groupBy(*by).agg(*[per[i] for i in some]).select(*by, F.inline(F.array(*[f"c{i}" for i in some]))))
    states = reduce(DataFrame.union, passes)
    # a constant column has no shape: its higher sums are 0
    states = states.withColumns({m: F.when(F.col("m2") == 0, F.lit(0.0)).otherwise(F.col(m)) for m in ("m3", "m4")})
    counts = reduce(DataFrame.union, [value_counts(df, name, by) for name in names])
    return _with_frequent(states, counts, [*by, "column_name"])


def value_counts(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, column_name, value (string), m: how often each value of a column is there; nulls and NaN don't count, -0.0 is 0.0."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    c = c.cast("string") if data_type(kind) == "unknown" else c  # not all of these can be grouped
    kept = df.where(~F.isnan(c) & c.isNotNull() if floating else c.isNotNull()).select(*by, c.alias("_value"))
    counts = kept.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("m"))
    return counts.select(*by, F.lit(name).alias("column_name"), F.col("_value").cast("string").alias("value"), "m")


def _with_frequent(states: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``states`` with the ``FREQUENT`` largest of ``counts`` (keys, value, m) of each; the first ones of each task are chosen before they are shuffled."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc("m"), "value")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FREQUENT + 1)
    top = ranked.groupBy(*keys).agg(F.collect_list(F.when(F.col("place") <= FREQUENT, F.struct("value", "m"))).alias("frequent"), F.coalesce(F.max(F.when(F.col("place") > FREQUENT, F.col("m"))), F.lit(0)).alias("cut"))
    met = states.alias("s").join(top.alias("t"), [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left")
    before = F.col("s.dropped") if "dropped" in states.columns else F.lit(0)
    empty = F.array().cast("array<struct<value:string,m:bigint>>")
    return met.select("s.*", F.coalesce("t.frequent", empty).alias("frequent"), (before + F.coalesce("t.cut", F.lit(0))).cast("long").alias("total_dropped")).drop("dropped").withColumnRenamed("total_dropped", "dropped")


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States merged to one for each group of ``by`` and each column; in any order and any number of steps the result is that of one pass within the sketches' error.

    Central sums are merged about the common mean. A value that a state left out may have been dropped there, so what was dropped adds up.
    """
    keys = [*by, "column_name"]
    totals = states.groupBy(*keys).agg(F.sum("present").alias("all_present"), F.sum("sum1").alias("all_sum"))
    met = states.alias("s").join(totals.alias("t"), [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("s.*", "t.all_present", "t.all_sum")
    n, d = F.col("present"), F.col("mean") - F.col("all_sum") / F.col("all_present")
    second = F.col("m2") + n * d * d
    third = F.col("m3") + 3 * d * F.col("m2") + n * d * d * d
    fourth = F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d
    merged = met.groupBy(*keys).agg(
        F.first("data_type").alias("data_type"), F.sum("n").alias("n"), F.sum("present").alias("present"), F.sum("sum1").alias("sum1"), (F.sum("sum1") / F.sum(F.when(F.col("sum1").isNotNull(), n))).alias("mean"),
        F.sum(second).alias("m2"), F.sum(third).alias("m3"), F.sum(fourth).alias("m4"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll", RANKS).alias("kll"), F.sum("dropped").cast("long").alias("dropped"),
    )
    counts = states.select(*keys, F.inline("frequent")).groupBy(*keys, "value").agg(F.sum("m").alias("m"))
    return _with_frequent(merged, counts, keys)


def profile_of_states(states: DataFrame) -> DataFrame:
    """column_name, data_type, total_count, null_count, unique_count, mean, std, min, max, q25, median, q75, skewness, kurtosis, top_value, top_count, off.

    The figures of ``profile`` from states; unique_count and quartiles within the sketches' error, top_count too small by ``off`` at most.
    """
    from lodestone.functions.moments import corrected_kurtosis, corrected_skewness

    n = F.col("present")
    quartile = lambda q: F.when((n > 0) & F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.lit(q)))
    skew = F.when(F.col("m2") > 0, F.sqrt(n.cast("double")) * F.col("m3") / F.pow("m2", 1.5))
    kurt = F.when(F.col("m2") > 0, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3)
    first = F.get("frequent", F.lit(0))
    return states.withColumns({"g1": skew, "g2": kurt}).select(
        "column_name", "data_type", F.col("n").alias("total_count"), (F.col("n") - n).alias("null_count"), F.hll_sketch_estimate("hll").alias("unique_count"), "mean", F.sqrt(F.try_divide(F.col("m2"), n - 1)).alias("std"), "min", "max",
        quartile(0.25).alias("q25"), quartile(0.5).alias("median"), quartile(0.75).alias("q75"), corrected_skewness(n, F.col("g1")).alias("skewness"), corrected_kurtosis(n, F.col("g2")).alias("kurtosis"),
        first["value"].alias("top_value"), first["m"].alias("top_count"), F.col("dropped").alias("off"),
    )
