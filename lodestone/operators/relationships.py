"""Relationships between columns: hierarchies, foreign keys, dependencies, and what they say of each column."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import matches_any
from lodestone.operators.profile import correlations

#: Words of the levels of each kind of hierarchy, from the most general level on.
LEVELS = {
    "geographic": ["continent", "country", "region", "state", "province", "city", "district", "zip"],
    "temporal": ["year", "quarter", "month", "week", "day", "hour"],
    "organizational": ["company", "department", "division", "team", "employee"],
    "product": ["category", "subcategory", "product", "sku", "variant"],
}
#: Patterns of names of identifiers.
IDENTIFIERS = [r"^.*_id$", r"^.*_key$", r"^id_.*$", r"^key_.*$", r"^.*_code$", r"^.*_num(ber)?$"]
#: Words of derived columns and of what they derive from.
FINANCIAL = {
    "revenue": ["sales", "income", "price", "quantity"],
    "profit": ["revenue", "cost", "expense"],
    "margin": ["profit", "revenue"],
    "total": ["subtotal", "tax", "shipping", "discount"],
    "net": ["gross", "tax", "deduction"],
}
HIERARCHY = "type string, columns array<string>, confidence double, method string, description string"
DEPENDENCY = "from_columns array<string>, to_column string, relation_type string, correlation double, confidence double, method string, verified boolean"


def named_hierarchies(profiles: DataFrame) -> DataFrame:
    """Columns (place, column_name, unique_count) whose names are levels of one kind, if no level has more values than the next."""
    known = [(kind, level, word) for kind, words in LEVELS.items() for level, word in enumerate(words)]
    words = F.broadcast(profiles.sparkSession.createDataFrame(known, "type string, level int, word string"))  # the fixed words above
    met = profiles.join(words, F.contains(F.lower("column_name"), F.col("word")))
    path = met.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("level", "place", "column_name", "unique_count"))).alias("p")).where(F.size("p") >= 2)
    rising = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.col("p")[i - 1]["unique_count"] <= F.col("p")[i]["unique_count"])
    told = F.concat(F.initcap("type"), F.lit(" hierarchy detected"))
    return path.where(rising).select("type", F.col("p.column_name").alias("columns"), F.lit(0.85).alias("confidence"), F.lit("pattern_based").alias("method"), told.alias("description"))


def inferred_hierarchies(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs of columns with few values of which the first tells the second for over 80 % of its values, and has fewer.

    Both have less than 100 values, so the sets of pairs of values are small; all are gathered in one pass.
    """
    few = profiles.where((F.col("unique_ratio") < 0.5) & (F.col("unique_count") < 100)).orderBy("place").collect()  # a row for each column
    sizes = {r["column_name"]: r["unique_count"] for r in few}
    pairs = [(a, b) for a, b in combinations(sizes, 2) if sizes[a] < sizes[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], HIERARCHY)
    seen = df.agg(*[F.collect_set(F.when(F.col(a).isNotNull(), F.struct(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = seen.select(F.explode(F.array(*[F.struct(F.array(F.lit(a), F.lit(b)).alias("columns"), F.col(f"p{i}").alias("values")) for i, (a, b) in enumerate(pairs)])).alias("x"))
    values = rows.select("x.columns", F.explode("x.values").alias("v")).groupBy("columns", "v.a").agg(F.count("v.b").alias("n"))
    share = values.groupBy("columns").agg(F.avg((F.col("n") == 1).cast("double")).alias("share")).where("share > 0.8")
    told = F.concat(F.lit("Each value in '"), F.col("columns")[0], F.lit("' maps to consistent values in '"), F.col("columns")[1], F.lit("'"))
    return share.select(F.lit("data_inferred").alias("type"), "columns", F.lit(0.7).alias("confidence"), F.lit("cardinality_based").alias("method"), told.alias("description"))


def hierarchies(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Both kinds; a pair of columns that a named hierarchy has as its columns is left out."""
    named = named_hierarchies(profiles)
    inferred = inferred_hierarchies(df, profiles)
    same = F.array_sort(inferred["columns"]) == F.array_sort(named["columns"])
    return named.union(inferred.join(named, same, "left_anti"))


def foreign_keys(profiles: DataFrame, least: float = 0.6) -> DataFrame:
    """column_name, confidence, reasons, data_type, unique_ratio, null_rate of columns that look like references, in tenths of confidence."""
    name = F.lower("column_name")
    others = F.collect_list("column_name").over(Window.partitionBy(F.lit(1)))  # a row for each column; the profile is made once
    base = F.expr("substring(column_name, 1, length(column_name) - 3)")
    refers = F.endswith("column_name", F.lit("_id")) & F.exists("all_names", lambda x: (x != F.col("column_name")) & F.contains(F.lower(x), base))
    checks = [
        (matches_any(name, IDENTIFIERS), 4, "name_pattern_match"), (F.col("data_type").isin("integer", "string"), 2, "appropriate_data_type"),
        (F.col("unique_ratio") > 0.3, 2, "high_cardinality"), (F.col("null_rate") < 0.3, 1, "low_null_rate"), (refers, 1, "potential_reference_column_exists"),
    ]
    tenths = sum((F.when(c, w).otherwise(0) for c, w, _ in checks), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, _, r in checks]))
    scored = profiles.withColumn("all_names", others).select("column_name", tenths.alias("tenths"), reasons.alias("reasons"), "data_type", F.bround("unique_ratio", 3).alias("unique_ratio"), F.bround("null_rate", 3).alias("null_rate"))
    return scored.where(F.col("tenths") >= round(least * 10)).select("column_name", (F.col("tenths") / 10).alias("confidence"), "reasons", "data_type", "unique_ratio", "null_rate")


def financial_dependencies(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Columns whose names tell that they derive from others, verified if their two inputs add up, subtract or multiply to them."""
    found = []
    for word, inputs in FINANCIAL.items():
        for target in [c for c in df.columns if word in c.lower()]:
            sources = [c for w in inputs for c in df.columns if w in c.lower() and c != target]
            if sources:
                found.append((word, target, sources))
    checks = []
    for i, (_, target, sources) in enumerate(found):
        if len(sources) == 2 and {target, *sources} <= set(numeric):
            y, p, q = (F.col(c).cast("double") for c in (target, *sources))
            size = F.avg(F.abs(y)) + 1e-10
            checks.append(F.coalesce(F.least(*[F.avg(F.abs(y - v)) / size for v in (p + q, p - q, p * q)]) < 0.1, F.lit(False)).alias(f"v{i}"))
        else:
            checks.append(F.max(F.lit(False)).alias(f"v{i}"))
    if not found:
        return df.sparkSession.createDataFrame([], DEPENDENCY)
    rows = [
        F.struct(F.array(*map(F.lit, sources)).alias("from_columns"), F.lit(target).alias("to_column"), F.lit(word).alias("relation_type"), F.lit(None).cast("double").alias("correlation"),
                 F.when(F.col(f"v{i}"), 0.75).otherwise(0.6).alias("confidence"), F.lit("pattern_based").alias("method"), F.col(f"v{i}").alias("verified"))
        for i, (word, target, sources) in enumerate(found)
    ]
    return df.agg(*checks).select(F.inline(F.array(*rows)))


def correlation_dependencies(df: DataFrame, numeric: list[str], least: float = 0.85) -> DataFrame:
    """Pairs of numeric columns whose correlation is at least ``least`` in size."""
    if len(numeric) < 2:
        return df.sparkSession.createDataFrame([], DEPENDENCY)
    r = correlations(df, numeric).where(F.abs("r") >= least)
    return r.select(F.array("a").alias("from_columns"), F.col("b").alias("to_column"), F.lit("correlation").alias("relation_type"), F.bround("r", 3).alias("correlation"), F.least(F.lit(0.95), F.abs("r")).alias("confidence"), F.lit("correlation_based").alias("method"), F.lit(True).alias("verified"))


def dependencies(df: DataFrame, numeric: list[str]) -> DataFrame:
    return financial_dependencies(df, numeric).union(correlation_dependencies(df, numeric))


def column_relations(columns: DataFrame, of_levels: DataFrame, keys: DataFrame, derived: DataFrame) -> DataFrame:
    """column_name, parent, children, hierarchy, related, depends_on, depended_by of each column, from hierarchies, foreign keys and dependencies.

    Of several hierarchies with a column the first by type and columns counts. related: for a foreign key, the columns of
    hierarchies that hold its name without _id, _key and _code.
    """
    spots = of_levels.select("type", "columns", F.posexplode("columns").alias("at", "column_name"))
    first = spots.groupBy("column_name").agg(F.min(F.struct("type", "columns", "at")).alias("h")).select("column_name", "h.columns", "h.at")
    parent = F.when(F.col("at") > 0, F.get("columns", F.col("at") - 1))
    below = F.nullif(F.array_join(F.slice("columns", F.col("at") + 2, F.size("columns")), ", "), F.lit(""))
    placed = first.select("column_name", parent.alias("parent"), below.alias("children"), F.array_join("columns", " -> ").alias("hierarchy"))
    base = F.lower(F.regexp_replace("column_name", "_id|_key|_code", ""))
    members = of_levels.select(F.explode("columns").alias("member")).distinct()
    near = keys.select("column_name").join(members, F.contains(F.lower("member"), base) & (F.col("member") != F.col("column_name")))
    related = near.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_set("member")), ", ").alias("related"))
    # of several dependencies of one column the strongest tells what it depends on
    inputs = derived.groupBy(F.col("to_column").alias("column_name")).agg(F.array_join(F.max_by("from_columns", F.struct("confidence", "from_columns")), ", ").alias("depends_on"))
    outputs = derived.select(F.explode("from_columns").alias("column_name"), "to_column").groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_set("to_column")), ", ").alias("depended_by"))
    out = columns.select("column_name")
    for part in (placed, related, inputs, outputs):
        out = out.join(part, "column_name", "left")
    return out


def schema_structure(dataset: str, of_levels: DataFrame, keys: DataFrame, derived: DataFrame, constraints: DataFrame) -> DataFrame:
    """One row: the dataset's hierarchies, foreign keys, dependencies and constraints as lists of structs, for a description of its schema."""
    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))  # a row for each column or pair of columns

    parts = [
        listed(of_levels.withColumnRenamed("columns", "path"), "hierarchies", "type", "path", "confidence", "description"),
        listed(keys.withColumnRenamed("column_name", "column"), "foreign_keys", "column", "confidence", "unique_ratio", "null_rate"),
        listed(derived, "dependencies", "from_columns", "to_column", "relation_type", "confidence", "verified"),
        listed(constraints, "constraints", "column_name", "constraints"),
    ]
    out = keys.sparkSession.range(1).select(F.lit(dataset).alias("dataset"))
    for part in parts:
        out = out.crossJoin(F.broadcast(part))
    return out


def detect(df: DataFrame, profiles: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hierarchies, foreign keys and dependencies of a table, from its profile (with place) and its data."""
    return hierarchies(df, profiles), foreign_keys(profiles), dependencies(df, numeric)
