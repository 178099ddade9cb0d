"""What names, first values and ranges of columns tell: units, formats, resolutions of time, keys, checks and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import case_chain, matches_any
from lodestone.operators.profile import data_type, profile

#: Patterns that tell a unit, in the order in which they are tried; letter case is ignored.
UNITS = [
    ("currency", [r"\$", "USD", "EUR", "GBP", "CNY", "¥"]),
    ("percentage", ["%", "percent"]),
    ("time", ["year", "month", "day", "hour", "minute", "second"]),
    ("distance", ["km", "mile", "meter", "foot"]),
    ("weight", ["kg", "pound", "gram"]),
]
#: Formats of values, in the order in which they are tried; letter case is ignored.
FORMATS = [
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("url", r"^https?://[^\s]+$"),
    ("phone", r"^[\+]?[\d\s\-\(\)]{7,15}$"),
    ("ip_address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("uuid", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("currency_code", r"^[A-Z]{3}$"),
    ("zip_code", r"^\d{5}(-\d{4})?$"),
    ("hex_color", r"^#[0-9a-fA-F]{6}$"),
]
#: Words of a name that tell its resolution of time, in the order in which they are tried.
RESOLUTIONS = ["year", "quarter", "month", "week", "day", "hour", "minute"]
#: Patterns of the names of primary and of foreign keys.
PRIMARY_KEYS = [r"^id$", r"^.*_id$", r"^pk_.*$", r"^primary_key$", r"^.*_key$"]
FOREIGN_KEYS = [r"^.*_id$", r"^.*_key$", r"^fk_.*$", r"^.*_code$", r"^.*_ref$"]
#: Structural labels of data types.
STRUCTURAL = {"integer": "Integer", "float": "Float", "boolean": "Boolean", "datetime": "DateTime"}


def column_types(df: DataFrame) -> DataFrame:
    """place, column_name, data_type, structural_type of each column, from the schema alone."""
    rows = [(i, f.name, kind := data_type(f.dataType), STRUCTURAL.get(kind, "Text")) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, column_name string, data_type string, structural_type string")


def heads(df: DataFrame, columns: list[str], n: int, order: list[str]) -> DataFrame:
    """column_name, place, value (string): the first ``n`` values of each column that are not null, in the order named.

    Each column is a top-n of its own, so no column is sorted whole.
    """

    def one(c: str) -> DataFrame:
        first = df.where(F.col(c).isNotNull()).orderBy(*order).limit(n).select(F.col(c).cast("string").alias("value"), *[F.col(o).alias(f"_{i}") for i, o in enumerate(order)])
        place = F.row_number().over(Window.orderBy(*[f"_{i}" for i in range(len(order))]))  # n rows at most
        return first.select(F.lit(c).alias("column_name"), place.alias("place"), "value")

    return reduce(DataFrame.union, [one(c) for c in columns])


def sample_values(df: DataFrame, columns: list[str], n: int = 10, seed: int = 7) -> DataFrame:
    """column_name, place, value: ``n`` distinct values of each column with the least seeded hashes, the same in each run."""

    def one(c: str) -> DataFrame:
        values = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value")).distinct()
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("value")))
        first = values.withColumn("_key", key).orderBy("_key").limit(n)
        return first.select(F.lit(c).alias("column_name"), F.row_number().over(Window.orderBy("_key")).alias("place"), "value")  # n rows at most

    return reduce(DataFrame.union, [one(c) for c in columns])


def inferred_types(types: DataFrame, first_values: DataFrame) -> DataFrame:
    """column_name, inferred_type: the data type, or date_string for a text column whose first value is a time."""
    first = first_values.where("place = 1").select("column_name", F.try_to_timestamp("value").alias("t"))
    dated = (F.col("data_type") == "string") & F.col("t").isNotNull()
    return types.join(first, "column_name", "left").select("column_name", F.when(dated, "date_string").otherwise(F.col("data_type")).alias("inferred_type"))


def unit_of(c: Column) -> Column:
    return case_chain([(matches_any(c, [f"(?i){p}" for p in patterns]), unit) for unit, patterns in UNITS])


def units(columns: DataFrame, first_values: DataFrame) -> DataFrame:
    """column_name, unit: from the name, else from the first of a text column's first values that tells one, else null."""
    told = first_values.withColumn("unit", unit_of(F.col("value"))).where("unit is not null").groupBy("column_name").agg(F.min_by("unit", "place").alias("value_unit"))
    return columns.join(told, "column_name", "left").select("column_name", F.coalesce(unit_of(F.col("column_name")), "value_unit").alias("unit"))


def value_formats(first_values: DataFrame) -> DataFrame:
    """column_name, value_pattern: the first format that more than half of a text column's first values have."""
    shares = [F.avg(F.trim("value").rlike(f"(?i){p}").cast("double")) for _, p in FORMATS]
    return first_values.groupBy("column_name").agg(case_chain([(s > 0.5, name) for s, (name, _) in zip(shares, FORMATS, strict=True)]).alias("value_pattern"))


def resolution_of_name(c: Column) -> Column:
    return case_chain([(F.contains(F.lower(c), F.lit(w)), w) for w in RESOLUTIONS])


def resolutions(first_values: DataFrame) -> DataFrame:
    """column_name, resolution of columns of times, from the first ten of their first values (text, all of which must be times)."""
    t = first_values.withColumn("t", F.try_to_timestamp("value"))
    some = lambda c: F.bool_or(F.when(F.col("place") <= 10, c != 0))
    ones = lambda c: F.bool_and(F.when(F.col("place") <= 10, c == 1))
    per = t.groupBy("column_name").agg(
        F.count("value").alias("n"), F.count("t").alias("parsed"), some(F.hour("t")).alias("hours"), some(F.minute("t")).alias("minutes"),
        some(F.second("t")).alias("seconds"), ones(F.dayofmonth("t")).alias("firsts"), ones(F.month("t")).alias("januaries"),
    )
    timed = F.col("hours") | F.col("minutes") | F.col("seconds")
    by_day = F.when(F.col("firsts") & F.col("januaries"), "year").when(F.col("firsts"), "month").otherwise("day")
    by_time = F.when(F.col("seconds"), "timestamp").when(F.col("minutes"), "minute").otherwise("hour")
    label = F.when(F.col("parsed") < F.col("n"), None).when(F.col("n") < 2, "unknown").when(timed, by_time).otherwise(by_day)
    return per.select("column_name", label.alias("resolution"))


def temporal_resolutions(profiles: DataFrame, first_values: DataFrame) -> DataFrame:
    """column_name, temporal_resolution: from the name, else the first values of times and texts, else whole numbers that look like years."""
    years = (F.col("data_type") == "integer") & F.col("min").between(1900, 2100) & F.col("max").between(1900, 2100)
    from_values = F.when(F.col("data_type").isin("datetime", "string"), F.col("resolution")).when(years, "year")
    return profiles.join(resolutions(first_values), "column_name", "left").select("column_name", F.coalesce(resolution_of_name(F.col("column_name")), from_values).alias("temporal_resolution"))


def constraints(profiles: DataFrame) -> DataFrame:
    """column_name and the constraints that a profile allows: nullable, not_null, unique, keys by name, ranges and their descriptions."""
    name = F.lower("column_name")
    unique = (F.col("unique_count") == F.col("total_count")) & (F.col("total_count") > 0)
    primary = unique & (F.col("null_count") == 0) & matches_any(name, PRIMARY_KEYS)
    lo, hi = F.col("min"), F.col("max")
    binary = (F.col("data_type") == "integer") & (lo >= 0) & (hi <= 1)
    span = F.when((lo >= 0) & (hi <= 1), "between_0_and_1").when((lo >= 0) & (hi <= 100), "between_0_and_100").when((lo >= 0) & (hi <= 1_000_000), "positive_bounded")
    told = (
        F.when(binary, "Binary value (0 or 1)").when(span == "between_0_and_1", "Value must be between 0 and 1 (ratio/probability)")
        .when(span == "between_0_and_100", "Value must be between 0 and 100 (possibly percentage)")
        .when(span == "positive_bounded", F.concat(F.lit("Value must be between 0 and "), F.floor(hi).cast("long")))
    )
    return profiles.select(
        "column_name", (F.col("null_count") > 0).alias("nullable"), (F.col("null_count") == 0).alias("not_null"), unique.alias("unique"),
        primary.alias("primary_key_candidate"), (matches_any(name, FOREIGN_KEYS) & (name != "id") & ~primary).alias("foreign_key_candidate"),
        F.coalesce(lo >= 0, F.lit(False)).alias("non_negative"), F.coalesce(lo > 0, F.lit(False)).alias("positive"), span.alias("range"),
        F.coalesce(binary, F.lit(False)).alias("boolean_encoded"), told.alias("description"),
    )


def constraint_texts(found: DataFrame) -> DataFrame:
    """column_name, constraints: the constraints of each column as a list of phrases; columns without any are left out."""
    phrases = F.array(
        F.when(F.col("not_null"), "NOT NULL"), F.when(F.col("unique"), "UNIQUE"), F.when(F.col("primary_key_candidate"), "PRIMARY KEY (candidate)"),
        F.when(F.col("foreign_key_candidate"), "FOREIGN KEY (candidate)"), F.when(F.col("non_negative"), "CHECK (value >= 0)"),
        F.when(F.col("range").isNotNull(), F.concat(F.lit("CHECK ("), F.col("description"), F.lit(")"))),
    )
    return found.select("column_name", F.array_compact(phrases).alias("constraints")).where(F.size("constraints") > 0)


def fingerprints(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """column_name, data_type, unique_ratio (of values that are not null), null_rate, mean, std, skewness, kurtosis, avg_length, is_id_like.

    Moments are of the population and 0 where a column is not numeric or holds two values at most; is_id_like: the first value of a column that is
    not numeric holds a digit and a letter.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        kind, x = data_type(kinds[c]), F.col(c)
        x = F.when(~F.isnan(x), x) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else x
        number, n = x.cast("double") if kind in ("integer", "float") else F.lit(None).cast("double"), F.count(x)
        shaped = lambda m, n=n: F.when(n > 2, F.coalesce(m, F.lit(0.0))).otherwise(0.0)
        length = F.avg(F.length(x.cast("string"))) if kind not in ("integer", "float") else F.lit(0.0)
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.coalesce(F.try_divide(F.count_distinct(x), n), F.lit(0.0)).alias("unique_ratio"),
            F.coalesce(F.try_divide(F.count(F.lit(1)) - n, F.count(F.lit(1))), F.lit(0.0)).alias("null_rate"), F.coalesce(F.avg(number), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_samp(number), F.lit(0.0)).alias("std"), shaped(F.skewness(number)).alias("skewness"), shaped(F.kurtosis(number)).alias("kurtosis"),
            F.coalesce(length, F.lit(0.0)).alias("avg_length"),
        ))
    rows = df.agg(*[s.alias(f"c{i}") for i, s in enumerate(structs)]).select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    first = heads(df, columns, 1, order).select("column_name", (F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-zA-Z]")).alias("mixed"))
    mixed = F.when(F.col("data_type").isin("integer", "float"), False).otherwise(F.coalesce("mixed", F.lit(False)))
    return rows.join(first, "column_name", "left").withColumn("is_id_like", mixed.cast("int")).drop("mixed")


def code_shares(samples: DataFrame) -> DataFrame:
    """column_name, code_share: how many of a column's first ten sample values look like codes, over all its samples.

    A code has 2 to 6 characters, no space, and is upper case, lower case or digits throughout.
    """
    v = F.col("value")
    code = F.length(v).between(2, 6) & ~F.contains(v, F.lit(" ")) & ((v.rlike(r"\p{Lu}") & (F.upper(v) == v)) | (v.rlike(r"\p{Ll}") & (F.lower(v) == v)) | v.rlike(r"^\d+$"))
    return samples.groupBy("column_name").agg((F.count_if(code & (F.col("place") <= 10)) / F.count(F.lit(1))).alias("code_share"))


def full_profile(df: DataFrame, order: list[str], exact: bool = False) -> DataFrame:
    """A row for each column with all that is known of it: figures, types, unit, format, resolution, samples, and its constraints as a struct.

    ``order``: columns that put the rows in the order in which first values are taken.
    """
    p = profile(df, exact)
    types = column_types(df)
    names = df.columns
    first = heads(df, names, 20, order)
    texts = types.where("data_type = 'string'").select("column_name")
    of_texts = first.join(F.broadcast(texts), "column_name", "left_semi")
    times = first.join(F.broadcast(types.where("data_type in ('string', 'datetime')").select("column_name")), "column_name", "left_semi")
    checks = constraints(p)
    samples = sample_values(df, names).groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))
    parts = [
        types.select("column_name", "place", "structural_type"), inferred_types(types, first), units(types.select("column_name"), of_texts.where("place <= 5")), value_formats(of_texts),
        temporal_resolutions(p, times), samples, checks.select("column_name", F.struct(*[c for c in checks.columns if c != "column_name"]).alias("constraints")),
    ]
    out = p
    for part in parts:
        out = out.join(part, "column_name", "left")
    return out.withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def nearest_cases(queries: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """column_name, label, case_name, distance, rank: the ``k`` labelled cases of the same data type that are nearest to each fingerprint.

    cases: case_name, label, data_type, unique_ratio, skewness. The library is small; Spark broadcasts it if its size allows.
    """
    c = cases.select("label", "case_name", "data_type", F.col("unique_ratio").alias("u"), F.col("skewness").alias("s"))
    distance = F.round(F.abs(F.col("u") - F.col("unique_ratio")) * 0.6 + F.abs(F.col("s") - F.col("skewness")) * 0.4, 4)
    met = queries.join(c, "data_type").withColumn("distance", distance)
    w = Window.partitionBy("column_name").orderBy("distance", "case_name", "label")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column_name", "label", "case_name", "distance", "rank")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_name, label, data_type, unique_ratio, skewness from a JSON list of labelled fingerprints."""
    schema = "array<struct<fingerprint: struct<col_name: string, data_type: string, stats: struct<unique_ratio: double, skewness: double>>, label: string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("c")).select("c.*")
    return rows.select(F.col("fingerprint.col_name").alias("case_name"), "label", "fingerprint.data_type", "fingerprint.stats.unique_ratio", "fingerprint.stats.skewness")


def write_cases(cases: DataFrame, path: str) -> None:
    """Labelled fingerprints as lines of JSON; a folder may be appended to."""
    nested = F.struct(F.col("case_name").alias("col_name"), "data_type", F.struct("unique_ratio", "skewness").alias("stats"))
    cases.select(nested.alias("fingerprint"), "label").write.mode("append").json(path)
