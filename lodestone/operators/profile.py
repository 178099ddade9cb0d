"""Column profiles: one pass of aggregates for all columns of a table, then one row a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.moments import corrected_kurtosis, corrected_skewness, distribution
from lodestone.operators.quantiles import exact_quantiles

#: Columns whose plain figures are aggregated in one pass.
TOGETHER = 4
#: Pairs of columns whose correlations are taken in one pass.
CORRELATED = 2
#: Pairs of values that a task makes of its rows for functional dependencies.
PAIRS = 1 << 20
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
BROKEN = (T.FloatType, T.DoubleType, T.DecimalType)
#: The words of a column's name that tell its semantic type, in the order in which they are tried.
SEMANTIC_WORDS = [
    ("identifier", ["id", "key", "code", "number"]),
    ("temporal", ["date", "time", "year", "month", "day"]),
    ("spatial", ["city", "country", "state", "location", "address"]),
    ("metric", ["revenue", "profit", "sales", "amount", "price", "cost"]),
    ("ratio", ["rate", "ratio", "percentage", "%", "margin"]),
    ("count", ["count", "number", "quantity"]),
]


def data_type(kind: T.DataType) -> str:
    if isinstance(kind, WHOLE):
        return "integer"
    if isinstance(kind, BROKEN):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string" if isinstance(kind, T.StringType) else "unknown"


def semantic_type(name: str, kind: str) -> Column:
    """From words in the name, else text with few distinct values, else numbers; over the columns of a profile."""
    lower = name.lower()
    for label, found in SEMANTIC_WORDS:
        if any(w in lower for w in found):
            return F.lit(label)
    if kind == "string":
        return F.when(F.col("unique_count") < F.col("total_count") * 0.5, "categorical").otherwise("general")
    return F.lit("numerical" if kind in ("integer", "float") else "general")


def _present(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def distinct_counts(df: DataFrame) -> DataFrame:
    """column_name, n_unique: the exact number of distinct values of every column, from one pass; nulls and NaN don't count.

    Values go on as 128 bits of hash with their column's number, and tasks drop repeated ones before anything is shuffled.
    """
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = _present(f.name, f.dataType)
        c = c + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c  # -0.0 is 0.0
        parts.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))))
    found = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "i int, column_name string")
    return names.join(found, "i", "left").select("column_name", F.coalesce("n", F.lit(0)).alias("n_unique"))


def _sketched(df: DataFrame) -> DataFrame:
    """column_name, n_unique, q of every column by sketches of bounded size, in one pass: distinct values off by 1 %, quartiles by a summary."""
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = _present(f.name, f.dataType)
        numeric = data_type(f.dataType) in ("integer", "float")
        q = F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75], 10000) if numeric else F.lit(None).cast("array<double>")
        hashed = F.when(c.isNotNull(), F.xxhash64(c))
        structs.append(F.struct(F.lit(f.name).alias("column_name"), F.hll_sketch_estimate(F.hll_sketch_agg(hashed, 14)).alias("n_unique"), q.alias("q")).alias(f"c{i}"))
    return df.agg(*structs).select(F.inline(F.array(*[f"c{i}" for i in range(len(structs))])))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each column: counts, distinct values, moments, quartiles, shape, type and constraints.

    Columns are aggregated with partial sums, ``TOGETHER`` in a pass that reads no other columns: with more the generated code is too long to be compiled.
    Distinct values (1 % off) and quartiles come from sketches of bounded size in one more pass. ``exact`` counts distinct
    values by their hashes in one pass (``distinct_counts``), and selects quartiles between brackets (``exact_quantiles``), so no task
    holds all values of a column.
    """
    fields = df.schema.fields
    structs = []
    for f in fields:
        kind, c = data_type(f.dataType), _present(f.name, f.dataType)
        numeric = c.cast("double") if kind in ("integer", "float") else None
        number = (lambda make, x=numeric: make(x) if x is not None else F.lit(None).cast("double"))
        structs.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(kind).alias("data_type"),
            F.count(F.lit(1)).alias("total_count"), (F.count(F.lit(1)) - F.count(c)).alias("null_count"),
            number(F.avg).alias("mean"), number(F.stddev_samp).alias("std"), number(F.min).alias("min"), number(F.max).alias("max"),
            number(F.skewness).alias("g1"), number(F.kurtosis).alias("g2"),
            (F.avg(F.length(c)) if kind == "string" else F.lit(None).cast("double")).alias("avg_length"),
        ))
    passes = []
    for at in range(0, len(structs), TOGETHER):
        some = structs[at : at + TOGETHER]
        passes.append(df.agg(*[s.alias(f"c{i}") for i, s in enumerate(some)]).select(F.inline(F.array(*[f"c{i}" for i in range(len(some))]))))
    rows = reduce(DataFrame.union, passes)
    if exact:
        numbers = {f.name: F.col(f"`{f.name}`").cast("double") for f in fields if data_type(f.dataType) in ("integer", "float")}
        more = distinct_counts(df).join(exact_quantiles(df, numbers), "column_name", "left")
    else:
        more = _sketched(df)
    rows = rows.join(F.broadcast(more), "column_name").withColumnRenamed("n_unique", "unique_count")  # a row for each column
    meaning = F.coalesce(*[F.when(F.col("column_name") == f.name, semantic_type(f.name, data_type(f.dataType))) for f in fields])
    n = F.col("total_count") - F.col("null_count")
    ratio = F.coalesce(F.try_divide("unique_count", "total_count"), F.lit(0.0))
    return rows.select(
        "column_name", "data_type", meaning.alias("semantic_type"), "total_count", "null_count",
        F.coalesce(F.try_divide("null_count", "total_count"), F.lit(0.0)).alias("null_rate"), "unique_count", ratio.alias("unique_ratio"),
        "mean", "std", "min", "max", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"),
        corrected_skewness(n, F.col("g1")).alias("skewness"), corrected_kurtosis(n, F.col("g2")).alias("kurtosis"),
        F.when(F.col("mean").isNotNull(), distribution(n, F.col("g1"), F.col("g2"))).alias("distribution_type"), "avg_length",
        (F.col("null_count") > 0).alias("nullable"), (F.col("unique_count") == F.col("total_count")).alias("unique_values"),
        F.coalesce(F.col("min") >= 0, F.lit(False)).alias("non_negative"), F.coalesce(F.col("min") > 0, F.lit(False)).alias("positive"),
        range_semantics().alias("value_range_semantics"),
    )


def range_semantics() -> Column:
    lo, hi, whole = F.col("min"), F.col("max"), F.col("data_type") == "integer"
    return (
        F.when(lo.isNull(), None)
        .when((lo >= 0) & (hi <= 1), "ratio_or_probability")
        .when((lo >= 0) & (hi <= 100), "possible_percentage")
        .when(lo < 0, "signed_value_profit_loss_or_delta")
        .when(whole & (hi > 1_000_000), "large_positive_possibly_monetary")
        .when(whole & (hi > 100), "positive_integer_possibly_count")
        .when(hi > 10_000, "large_positive_possibly_monetary")
    )


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value (string) of the named columns."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column_name, value, n, share, rank: the k most frequent values of each column, ties to the smaller value."""
    counts = long_form(df, columns).where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)  # tasks keep their first k
    totals = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
    totals = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("total")) for i, c in enumerate(columns)])))
    return ranked.join(F.broadcast(totals), "column_name").select("column_name", "value", "n", (F.col("n") / F.col("total")).alias("share"), "rank")  # a total for each column


def default_values(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """column_name, value, share of columns that one value dominates."""
    return top_values(df, columns, 1).where(F.col("share") > least).select("column_name", "value", "share")


def functional_dependencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """determinant, dependent, mean_distinct, single_share, holds for each pair: how many values of b a value of a has.

    All pairs are counted in one pass: each row gives every pair's two values as 128 bits of hash, repeated ones go in the tasks, and
    distinct ones are counted by a's value. Rows are dealt to tasks that get about ``PAIRS`` pairs each, whatever the files' sizes. Rows without a value of a don't count, nor do missing values of b.
    """
    hashed = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))
    parts = [F.when(F.col(a).isNotNull(), F.struct(F.lit(i).alias("i"), hashed(F.col(a)).alias("a"), F.when(F.col(b).isNotNull(), hashed(F.col(b))).alias("b"))) for i, (a, b) in enumerate(pairs)]
    tasks = -(-df.count() * len(pairs) // PAIRS)
    if tasks > 1:  # a task holds the distinct pairs of its rows
        df = df.select(*dict.fromkeys(c for pair in pairs for c in pair)).repartition(tasks)
    values = df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*").distinct()
    groups = values.groupBy("i", "a").agg(F.count("b").alias("n"))
    found = groups.groupBy("i").agg(F.avg("n").alias("mean_distinct"), F.avg((F.col("n") == 1).cast("double")).alias("single_share"), F.count(F.lit(1)).alias("groups"))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, determinant string, dependent string")
    holds = F.coalesce((F.col("mean_distinct") < 1.05) & (F.col("groups") > 2), F.lit(False))
    return names.join(found, "i", "left").select("determinant", "dependent", "mean_distinct", "single_share", holds.alias("holds"))


def related_columns(df: DataFrame, columns: list[str] | None = None, strong: float = 0.5, few: int = 5) -> DataFrame:
    """source, target, type, weight: pairs of columns, each in the table's order, that are correlated or of which the first determines the second.

    correlation: two numeric columns with more than ``few`` rows that have both and a correlation beyond ``strong`` either way; weight is it, rounded half to even at 3 digits.
    functional_dependency: of more than two values of the first each has 1.05 values of the second at most on average; weight 1. Distinct counts
    by sketches take one pass, which settle pairs that are clearly none (a bound 10 % off); exact counts of the rest take one more.
    """
    kinds = {f.name: data_type(f.dataType) for f in df.schema.fields}
    names = list(columns) if columns is not None else df.columns
    numeric = [c for c in names if kinds[c] in ("integer", "float", "boolean")]
    found = []
    if len(numeric) > 1:
        figures = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if kinds[c] != "boolean" else F.col(f"`{c}`").cast("int").cast("double").alias(c) for c in numeric])
        r = correlations(figures, numeric)
        found.append(r.where((F.col("n") > few) & (F.abs("r") > strong)).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("correlation").alias("type"), F.bround("r", 3).alias("weight")))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if pairs:
        count = lambda *c: F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c[0]).isNotNull() & F.col(c[-1]).isNotNull(), F.xxhash64(*c)), 14))
        rough = df.agg(*[count(c).alias(f"s{i}") for i, c in enumerate(names)], *[count(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        open_ = [(a, b) for i, (a, b) in enumerate(pairs) if rough[f"p{i}"] <= 1.05 * 1.1 * rough[f"s{names.index(a)}"] + 1]
        if open_:
            held = functional_dependencies(df, open_).where("holds")
            found.append(held.select(F.col("determinant").alias("source"), F.col("dependent").alias("target"), F.lit("functional_dependency").alias("type"), F.lit(1.0).alias("weight")))
    return reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], "source string, target string, type string, weight double")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r for each pair of numeric columns, over the n rows where both have values; null where a side is constant.

    ``CORRELATED`` pairs take one pass that reads their columns only: with more the generated code is too long to be compiled.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    structs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("r")))
    passes = []
    for at in range(0, len(structs), CORRELATED):
        some = structs[at : at + CORRELATED]
        passes.append(df.agg(*[s.alias(f"p{i}") for i, s in enumerate(some)]).select(F.inline(F.array(*[f"p{i}" for i in range(len(some))]))))
    return reduce(DataFrame.union, passes)


def derived_column(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """Mean residual of target against a + b, a - b and a * b, as shares of its mean size, and whether one is below 0.1."""
    y, p, q = (F.col(c).cast("double") for c in (target, a, b))
    size = F.avg(F.abs(y)) + 1e-10
    out = df.agg(*[(F.avg(F.abs(y - v)) / size).alias(n) for n, v in (("sum_error", p + q), ("difference_error", p - q), ("product_error", p * q))])
    return out.withColumn("derived", F.least("sum_error", "difference_error", "product_error") < 0.1)
