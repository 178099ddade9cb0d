"""Queries over columns: types, units, formats, keys, fingerprints, relationships and extraction, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import details, extraction, profile, relationships
from lodestone.plans.queries import query, r6, rounded, t
from lodestone.sources.scratch import scratch_path

ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(cases, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def match(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted(pattern)})"


_KIND = "CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'integer' WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'float' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime' WHEN data_type = 'VARCHAR' THEN 'string' ELSE 'unknown' END"
_COLUMNS = f"c AS (SELECT table_name AS dataset, ordinal_position - 1 AS place, column_name, {_KIND} AS data_type FROM information_schema.columns WHERE table_name IN {ALL})"


def all_columns(spark, sf_dir):
    out = None
    for name in ALL:
        one = details.column_types(t(spark, sf_dir, name)).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_COLUMNS} SELECT dataset, CAST(place AS INT) AS place, column_name, data_type, CASE data_type WHEN 'integer' THEN 'Integer' WHEN 'float' THEN 'Float' WHEN 'datetime' THEN 'DateTime' ELSE 'Text' END AS structural_type FROM c")
def profile_types(spark, sf_dir):
    return all_columns(spark, sf_dir)


@query("""SELECT 'o_orderkey' AS column_name, 'integer' AS inferred_type UNION ALL SELECT 'day', (SELECT CASE WHEN try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL THEN 'date_string' ELSE 'string' END FROM orders ORDER BY o_orderkey LIMIT 1)
UNION ALL SELECT 'o_orderpriority', (SELECT CASE WHEN try_cast(o_orderpriority AS TIMESTAMP) IS NOT NULL THEN 'date_string' ELSE 'string' END FROM orders ORDER BY o_orderkey LIMIT 1)""")
def profile_inferred_types(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    return details.inferred_types(details.column_types(o), details.heads(o, ["day", "o_orderpriority"], 1, ["o_orderkey"]))


_HEADS = "(SELECT '{c}' AS column_name, row_number() OVER (ORDER BY {o}) AS place, CAST({c} AS VARCHAR) AS value FROM (SELECT {c}, {o} FROM {t} WHERE {c} IS NOT NULL ORDER BY {o} LIMIT {n}))"


def heads_sql(table: str, columns, n: int, order: str) -> str:
    return " UNION ALL ".join(_HEADS.format(c=c, o=order, t=table, n=n) if c != order else _HEADS.format(c=c, o=order, t=table, n=n).replace(f"SELECT {c}, {order} FROM", f"SELECT {c} FROM") for c in columns)


def unit_sql(c: str) -> str:
    return case([(" OR ".join(match(c, "(?i)" + p) for p in patterns), quoted(u)) for u, patterns in details.UNITS])


@query(f"""WITH h AS ({heads_sql("part", ["p_name", "p_brand", "p_type"], 5, "p_partkey")}), n AS (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice', 'weight_kg', 'discount_percent', 'price in USD']) AS column_name),
v AS (SELECT column_name, arg_min(u, place) AS u FROM (SELECT *, {unit_sql("value")} AS u FROM h) WHERE u IS NOT NULL GROUP BY column_name)
SELECT column_name, coalesce({unit_sql("column_name")}, u) AS unit FROM n LEFT JOIN v USING (column_name)""")
def profile_units(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    names = spark.createDataFrame([(c,) for c in [*part.columns, "weight_kg", "discount_percent", "price in USD"]], "column_name string")
    return details.units(names, details.heads(part, ["p_name", "p_brand", "p_type"], 5, ["p_partkey"]))


@query(" UNION ALL ".join(f"(SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY k) AS INT) AS place, value FROM (SELECT DISTINCT {c} AS value, md5('7:' || {c}) AS k FROM {tb} WHERE {c} IS NOT NULL ORDER BY k LIMIT 10))" for tb, c in (("part", "p_name"), ("orders", "o_orderpriority"))))
def profile_samples(spark, sf_dir):
    return details.sample_values(t(spark, sf_dir, "part"), ["p_name"]).union(details.sample_values(t(spark, sf_dir, "orders"), ["o_orderpriority"]))


@query(f"""WITH h AS ({heads_sql("pages", ["url"], 20, "page_id")} UNION ALL {heads_sql("customer", ["c_name", "c_mktsegment"], 20, "c_custkey")})
SELECT column_name, {case([(f"avg(CASE WHEN {match('trim(value)', '(?i)' + p)} THEN 1.0 ELSE 0.0 END) > 0.5", quoted(n)) for n, p in details.FORMATS])} AS value_pattern FROM h GROUP BY column_name""")
def profile_value_pattern(spark, sf_dir):
    first = details.heads(t(spark, sf_dir, "pages"), ["url"], 20, ["page_id"]).union(details.heads(t(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], 20, ["c_custkey"]))
    return details.value_formats(first)


@query(f"""WITH h AS ({heads_sql("orders", ["o_orderdate"], 20, "o_orderkey")} UNION ALL {heads_sql("events", ["ts", "event_type"], 20, "event_id")}), p AS (SELECT *, try_cast(value AS TIMESTAMP) AS x FROM h),
f AS (SELECT column_name, count(*) AS n, count(x) AS parsed, bool_or(hour(x) <> 0) FILTER (place <= 10) AS hh, bool_or(minute(x) <> 0) FILTER (place <= 10) AS mm, bool_or(second(x) <> 0) FILTER (place <= 10) AS ss,
bool_and(day(x) = 1) FILTER (place <= 10) AS d1, bool_and(month(x) = 1) FILTER (place <= 10) AS m1 FROM p GROUP BY column_name)
SELECT column_name, CASE WHEN parsed < n THEN NULL WHEN n < 2 THEN 'unknown' WHEN hh OR mm OR ss THEN CASE WHEN ss THEN 'timestamp' WHEN mm THEN 'minute' ELSE 'hour' END WHEN d1 AND m1 THEN 'year' WHEN d1 THEN 'month' ELSE 'day' END AS temporal_resolution FROM f
UNION ALL SELECT 'order_year', 'year' UNION ALL SELECT 'o_season', (SELECT CASE WHEN min(year(o_orderdate)) >= 1900 AND max(year(o_orderdate)) <= 2100 THEN 'year' END FROM orders)""")
def profile_temporal_resolution(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("order_year"), F.year("o_orderdate").alias("o_season"))
    events = t(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    first = details.heads(orders, ["o_orderdate"], 20, ["o_orderkey"]).union(details.heads(events, ["ts", "event_type"], 20, ["event_id"]))
    profiles = profile.profile(orders.drop("o_orderkey")).union(profile.profile(events.drop("event_id")))
    return details.temporal_resolutions(profiles, first)


def _profile_sql(table: str, columns: dict[str, str], name: str = "p") -> str:
    """A row for each column: total, nulls, distinct values, extremes and type."""
    parts = []
    for c, kind in columns.items():
        lo, hi = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if kind in ("integer", "float") else ("NULL::DOUBLE", "NULL::DOUBLE")
        parts.append(f"SELECT {quoted(c)} AS column_name, {quoted(kind)} AS data_type, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS uniques, {lo} AS lo, {hi} AS hi FROM {table}")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


ORDERS = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string"}
_PK = " OR ".join(match("lower(column_name)", p) for p in details.PRIMARY_KEYS)
_FK = " OR ".join(match("lower(column_name)", p) for p in details.FOREIGN_KEYS)
_CHECKED = f"""{_profile_sql("(SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderkey % 2 AS flag, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS share FROM orders)", {"order_id": "integer", "customer_id": "integer", "o_orderstatus": "string", "o_totalprice": "float", "flag": "integer", "share": "float"})},
b AS (SELECT *, uniques = total AND total > 0 AS u, data_type = 'integer' AND lo >= 0 AND hi <= 1 AS bin, CASE WHEN lo >= 0 AND hi <= 1 THEN 'between_0_and_1' WHEN lo >= 0 AND hi <= 100 THEN 'between_0_and_100' WHEN lo >= 0 AND hi <= 1000000 THEN 'positive_bounded' END AS r FROM p),
k AS (SELECT *, u AND nulls = 0 AND ({_PK}) AS pk FROM b)"""


def _checked(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 2).alias("flag"), ((F.col("o_orderkey") % 11).cast("double") / 10).alias("share"))
    return details.constraints(profile.profile(o, exact=True))


@query(f"""WITH {_CHECKED} SELECT column_name, nulls > 0 AS nullable, nulls = 0 AS not_null, u AS "unique", pk AS primary_key_candidate, ({_FK}) AND lower(column_name) <> 'id' AND NOT pk AS foreign_key_candidate, coalesce(lo >= 0, false) AS non_negative, coalesce(lo > 0, false) AS positive, r AS "range", coalesce(bin, false) AS boolean_encoded,
CASE WHEN bin THEN 'Binary value (0 or 1)' WHEN r = 'between_0_and_1' THEN 'Value must be between 0 and 1 (ratio/probability)' WHEN r = 'between_0_and_100' THEN 'Value must be between 0 and 100 (possibly percentage)' WHEN r = 'positive_bounded' THEN 'Value must be between 0 and ' || CAST(floor(hi) AS BIGINT) END AS description FROM k""")
def profile_check_ranges(spark, sf_dir):
    return _checked(spark, sf_dir)


_FPRINT = """SELECT '{c}' AS column_name, '{k}' AS data_type, count(DISTINCT {c}) / count({c}) AS unique_ratio, (count(*) - count({c})) / count(*) AS null_rate, {mean} AS mean, {std} AS std, {g1} AS skewness, {g2} AS kurtosis, {length} AS avg_length,
(SELECT CAST({mixed} AS INT) FROM (SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY {o} LIMIT 1)) AS is_id_like FROM {t}"""


def fingerprint_sql(table: str, columns: dict[str, str], order: str) -> str:
    parts = []
    for c, kind in columns.items():
        number = kind in ("integer", "float")
        m = f"(SELECT avg(CAST({c} AS DOUBLE)) FROM {table})"
        parts.append(_FPRINT.format(
            c=c, k=kind, t=table, o=order, mean=f"avg(CAST({c} AS DOUBLE))" if number else "0.0", std=f"stddev_samp(CAST({c} AS DOUBLE))" if number else "0.0",
            g1=f"avg(power({c} - {m}, 3)) / power(avg(power({c} - {m}, 2)), 1.5)" if number else "0.0", g2=f"avg(power({c} - {m}, 4)) / power(avg(power({c} - {m}, 2)), 2) - 3" if number else "0.0",
            length="0.0" if number else f"avg(length({c}))", mixed="false" if number else "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-zA-Z]')",
        ))
    return " UNION ALL ".join(parts)


PART = {"p_name": "string", "p_brand": "string", "p_size": "integer", "p_retailprice": "float"}
SUPPLIER = {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"}
_SHAPE = ["unique_ratio", "null_rate", "mean", "std", "skewness", "kurtosis", "avg_length"]


@query(f"SELECT column_name, data_type, {', '.join(f'round(CAST({c} AS DOUBLE), 4) AS {c}' for c in _SHAPE)}, is_id_like FROM ({fingerprint_sql('part', PART, 'p_partkey')})")
def fingerprint_columns(spark, sf_dir):
    return rounded(4, details.fingerprints(t(spark, sf_dir, "part"), list(PART), ["p_partkey"]), *_SHAPE)


@query(f"""WITH q AS ({fingerprint_sql('part', PART, 'p_partkey')}), c AS ({fingerprint_sql('supplier', SUPPLIER, 's_suppkey')}),
d AS (SELECT q.column_name, 'case of ' || c.column_name AS label, c.column_name AS case_name, round(abs(c.unique_ratio - q.unique_ratio) * 0.6 + abs(c.skewness - q.skewness) * 0.4, 4) AS distance FROM q JOIN c USING (data_type))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY distance, case_name, label) AS INT) AS rank FROM d) WHERE rank <= 3""")
def case_nearest(spark, sf_dir):
    cases = details.fingerprints(t(spark, sf_dir, "supplier"), list(SUPPLIER), ["s_suppkey"]).select(F.col("column_name").alias("case_name"), F.concat(F.lit("case of "), "column_name").alias("label"), "data_type", "unique_ratio", "skewness")
    return details.nearest_cases(details.fingerprints(t(spark, sf_dir, "part"), list(PART), ["p_partkey"]), cases)


def _placed(df, exact=True):
    return profile.profile(df, exact=exact).join(details.column_types(df).select("column_name", "place"), "column_name")


_LEVELED = "(SELECT CAST(year(o_orderdate) AS INT) AS order_year, strftime(o_orderdate, '%Y-%m') AS order_month, strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_orderkey % 10 AS a, CASE WHEN o_orderkey % 10 = 0 THEN 100 + o_orderkey % 50 ELSE o_orderkey % 10 END AS b FROM orders)"


def _leveled(spark, sf_dir):
    o, k = t(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(F.year("o_orderdate").alias("order_year"), F.date_format("o_orderdate", "yyyy-MM").alias("order_month"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"), (k % 10).alias("a"), F.when(k % 10 == 0, 100 + k % 50).otherwise(k % 10).alias("b"))


_LEVELS = ["order_year", "order_month", "order_day", "a", "b"]


@query(f"""WITH x AS (SELECT * FROM {_LEVELED}), u AS (SELECT {', '.join(f'count(DISTINCT {c}) AS {c}' for c in _LEVELS)}, count(*) AS n FROM x),
g AS ({' UNION ALL '.join(f"SELECT '{p},{q}' AS columns, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS share, (SELECT {p} < {q} AND {p} < 100 AND {q} < 100 AND {p} < n * 0.5 AND {q} < n * 0.5 FROM u) AS few FROM (SELECT {p}, count(DISTINCT {q}) AS n FROM x GROUP BY {p})" for i, p in enumerate(_LEVELS) for q in _LEVELS[i + 1:])})
SELECT 'temporal' AS type, 'order_year,order_month,order_day' AS columns, 0.85 AS confidence, 'pattern_based' AS method FROM u WHERE order_year <= order_month AND order_month <= order_day
UNION ALL SELECT 'data_inferred', columns, 0.7, 'cardinality_based' FROM g WHERE share > 0.8 AND few""")
def rel_hierarchy(spark, sf_dir):
    df = _leveled(spark, sf_dir)
    return relationships.hierarchies(df, _placed(df)).select("type", F.array_join("columns", ",").alias("columns"), "confidence", "method")


_ID = " OR ".join(match("lower(column_name)", p) for p in relationships.IDENTIFIERS)
_LINE = {"order_id": "integer", "part_key": "integer", "order_note": "string", "l_quantity": "float", "l_shipdate": "datetime"}
_LINES = "(SELECT l_orderkey AS order_id, l_partkey AS part_key, l_returnflag AS order_note, l_quantity, l_shipdate FROM lineitem)"


def _lines(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_key"), F.col("l_returnflag").alias("order_note"), "l_quantity", "l_shipdate")


@query(f"""WITH {_profile_sql(_LINES, _LINE)}, s AS (SELECT *, CASE WHEN {_ID} THEN 4 ELSE 0 END + CASE WHEN data_type IN ('integer', 'string') THEN 2 ELSE 0 END + CASE WHEN uniques / total > 0.3 THEN 2 ELSE 0 END + CASE WHEN nulls / total < 0.3 THEN 1 ELSE 0 END + CASE WHEN column_name = 'order_id' THEN 1 ELSE 0 END AS tenths FROM p)
SELECT column_name, tenths / 10 AS confidence, data_type, round(uniques / total, 3) AS unique_ratio, round(nulls / total, 3) AS null_rate FROM s WHERE tenths >= 6""")
def rel_fk_candidates(spark, sf_dir):
    return relationships.foreign_keys(profile.profile(_lines(spark, sf_dir), exact=True)).drop("reasons")


_MONEY = "(SELECT l_extendedprice AS subtotal, l_tax AS tax, l_extendedprice + l_tax AS total, l_quantity AS gross, l_quantity * 0.5 AS net_weight FROM lineitem)"


def _money(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("subtotal"), F.col("l_tax").alias("tax"), (F.col("l_extendedprice") + F.col("l_tax")).alias("total"), F.col("l_quantity").alias("gross"), (F.col("l_quantity") * 0.5).alias("net_weight"))


_MONEY_COLUMNS = ["subtotal", "tax", "total", "gross", "net_weight"]


@query(f"""WITH x AS (SELECT * FROM {_MONEY}), v AS (SELECT least(avg(abs(total - (subtotal + tax))), avg(abs(total - (subtotal - tax))), avg(abs(total - subtotal * tax))) / (avg(abs(total)) + 1e-10) < 0.1 AS total_ok,
least(avg(abs(net_weight - (gross + tax))), avg(abs(net_weight - (gross - tax))), avg(abs(net_weight - gross * tax))) / (avg(abs(net_weight)) + 1e-10) < 0.1 AS net_ok FROM x),
r AS ({' UNION ALL '.join(f"SELECT '{p}' AS a, '{q}' AS b, corr({p}, {q}) AS r FROM x" for i, p in enumerate(_MONEY_COLUMNS) for q in _MONEY_COLUMNS[i + 1:])})
SELECT 'tax' AS from_columns, 'subtotal' AS to_column, 'total' AS relation_type, CAST(NULL AS DOUBLE) AS correlation, 0.6 AS confidence, false AS verified
UNION ALL SELECT 'subtotal,tax', 'total', 'total', NULL, CASE WHEN total_ok THEN 0.75 ELSE 0.6 END, total_ok FROM v
UNION ALL SELECT 'gross,tax', 'net_weight', 'net', NULL, CASE WHEN net_ok THEN 0.75 ELSE 0.6 END, net_ok FROM v
UNION ALL SELECT a, b, 'correlation', round(r, 3), round(least(0.95, abs(r)), 6), true FROM r WHERE abs(r) >= 0.85""")
def rel_dependencies(spark, sf_dir):
    found = relationships.dependencies(_money(spark, sf_dir), _MONEY_COLUMNS)
    return r6(found.select(F.array_join("from_columns", ",").alias("from_columns"), "to_column", "relation_type", "correlation", "confidence", "verified"), "confidence")


@query("""WITH r(column_name, parent, children, hierarchy) AS (VALUES ('order_year', NULL, 'order_month, order_day', 'order_year -> order_month -> order_day'), ('order_month', 'order_year', 'order_day', 'order_year -> order_month -> order_day'),
('order_day', 'order_month', NULL, 'order_year -> order_month -> order_day')), h AS (SELECT count(DISTINCT year(o_orderdate)) <= count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS ok FROM orders)
SELECT c.column_name, r.parent, r.children, r.hierarchy, CASE WHEN c.column_name = 'order_id' THEN 'order_day, order_month, order_year' END AS related, CASE WHEN c.column_name = 'total' THEN 'subtotal, tax' END AS depends_on, CASE WHEN c.column_name IN ('subtotal', 'tax') THEN 'total' END AS depended_by
FROM (SELECT unnest(['order_year', 'order_month', 'order_day', 'order_id', 'subtotal', 'tax', 'total']) AS column_name) c LEFT JOIN (SELECT * FROM r, h WHERE ok) r USING (column_name)""")
def rel_column_summary(spark, sf_dir):
    o = _leveled(spark, sf_dir).select("order_year", "order_month", "order_day")
    names = spark.createDataFrame([(c,) for c in ("order_year", "order_month", "order_day", "order_id", "subtotal", "tax", "total")], "column_name string")
    money = _money(spark, sf_dir).select("subtotal", "tax", "total")
    derived = relationships.financial_dependencies(money, money.columns).where("to_column = 'total'")
    keys = relationships.foreign_keys(profile.profile(_lines(spark, sf_dir), exact=True)).where("column_name = 'order_id'")
    return relationships.column_relations(names, relationships.named_hierarchies(_placed(o)), keys, derived)


def semantic_sql(kinds: dict[str, str]) -> str:
    whens = [(" OR ".join(f"contains(lower(column_name), {quoted(w)})" for w in words), quoted(label)) for label, words in profile.SEMANTIC_WORDS]
    return case([*whens, ("data_type = 'string' AND uniques < total * 0.5", "'categorical'"), ("data_type IN ('integer', 'float')", "'numerical'")], "'general'")


_DOMAIN = case([(" OR ".join(f"contains(lower(column_name), {quoted(w)})" for w in words), quoted(d)) for d, words in extraction.DOMAIN_WORDS], "'general'")
_CONCEPTS = f"""{_profile_sql("orders", ORDERS)}, s AS (SELECT *, {semantic_sql(ORDERS)} AS semantic, {unit_sql("column_name")} AS unit, lower(column_name) || '_ds_' || substr(md5('orders'), 1, 8) AS id FROM p)"""


def _concept_profiles(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    p = profile.profile(orders, exact=True)
    return p.join(details.units(p.select("column_name"), details.heads(orders, ["o_orderstatus"], 5, ["o_orderkey"])), "column_name")


@query(f"""WITH {_CONCEPTS} SELECT id, lower(column_name) AS canonical_name, {case([(f"semantic = {quoted(k)}", quoted(v)) for k, v in extraction.KINDS.items()], "'dimension'")} AS concept_type, {_DOMAIN} AS domain,
'A ' || semantic || ' field representing ' || column_name || coalesce(', measured in ' || unit, '') || '. Data type: ' || data_type || '.' AS definition, lo AS range_min, hi AS range_max, 0.8 AS confidence FROM s""")
def schema_concepts(spark, sf_dir):
    return extraction.concepts_of(_concept_profiles(spark, sf_dir), "orders").select("id", "canonical_name", "concept_type", "domain", "definition", "range_min", "range_max", "confidence")


@query(f"""WITH {_CONCEPTS} SELECT id AS concept_id, column_name AS alias_text, 'exact_synonym' AS alias_type, 1.0 AS confidence FROM s UNION ALL SELECT 'total_price_usd_ds_' || substr(md5('orders'), 1, 8), 'Total Price (USD)', 'exact_synonym', 1.0
UNION ALL SELECT 'total_price_usd_ds_' || substr(md5('orders'), 1, 8), 'Total Price', 'case_variant', 0.9""")
def schema_aliases(spark, sf_dir):
    names = _concept_profiles(spark, sf_dir).select("column_name").union(spark.createDataFrame([("Total Price (USD)",)], "column_name string"))
    return extraction.aliases_of(names, "orders")


@query(f"""WITH {_CONCEPTS}, v AS (SELECT DISTINCT o_orderpriority AS value, md5('7:' || o_orderpriority) AS k FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY k LIMIT 10), l AS (SELECT string_agg(value, ',' ORDER BY k) AS samples FROM v)
SELECT id AS concept_id, column_name, CASE WHEN column_name = 'o_orderpriority' THEN samples ELSE '' END AS samples, semantic AS semantic_type, lo AS min, hi AS max FROM s CROSS JOIN l""")
def schema_evidence(spark, sf_dir):
    found = extraction.evidence_of(_concept_profiles(spark, sf_dir), details.sample_values(t(spark, sf_dir, "orders"), ["o_orderpriority"]), "orders")
    return found.select("concept_id", "column_name", F.array_join("sample_values", ",").alias("samples"), "semantics.semantic_type", "statistics.min", "statistics.max")


@query(f"""WITH {_CHECKED} SELECT column_name, array_to_string(list_filter([CASE WHEN nulls = 0 THEN 'NOT NULL' END, CASE WHEN u THEN 'UNIQUE' END, CASE WHEN pk THEN 'PRIMARY KEY (candidate)' END, CASE WHEN ({_FK}) AND NOT pk THEN 'FOREIGN KEY (candidate)' END,
CASE WHEN lo >= 0 THEN 'CHECK (value >= 0)' END, CASE WHEN r IS NOT NULL THEN 'CHECK (' || CASE WHEN bin THEN 'Binary value (0 or 1)' WHEN r = 'between_0_and_1' THEN 'Value must be between 0 and 1 (ratio/probability)' WHEN r = 'between_0_and_100' THEN 'Value must be between 0 and 100 (possibly percentage)' ELSE 'Value must be between 0 and ' || CAST(floor(hi) AS BIGINT) END || ')' END], lambda x: x IS NOT NULL), '; ') AS constraints FROM k""")
def sfd_structure(spark, sf_dir):
    found = details.constraint_texts(_checked(spark, sf_dir))
    lines, where = _lines(spark, sf_dir), scratch_path(spark, "profile")
    profile.profile(lines, exact=True).write.parquet(where)  # a row for each column, read by both
    of_lines = spark.read.parquet(where)
    placed = of_lines.join(details.column_types(lines).select("column_name", "place"), "column_name")
    whole = relationships.schema_structure("orders", relationships.named_hierarchies(placed), relationships.foreign_keys(of_lines), relationships.dependencies(_money(spark, sf_dir), _MONEY_COLUMNS), found)
    return whole.select(F.explode("constraints").alias("c")).select("c.column_name", F.array_join("c.constraints", "; ").alias("constraints"))
