"""Queries over concepts and matches: graph, cascade, rules, signals, prompts, evaluation and caches, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import concepts, describe, details, evaluation, generation, graph, injection, profile, prompts, reasoning, retrieval, rules, topics
from lodestone.plans.columns import ALL, _COLUMNS, all_columns, case, heads_sql, match, quoted
from lodestone.plans.queries import _BM25, _bm25, _qrels, _REL, _TOKENS as _SPLIT, query, r6, t
from lodestone.sources.scratch import scratch_path


def words_sql(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def holds(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


# graph

_RECORDS = """r AS (SELECT c_custkey AS seq, 'c' || (c_custkey % 100) AS id, c_name AS display_name, CASE WHEN c_custkey % 3 = 0 THEN 'canon' || (c_custkey % 7) END AS canonical_name, c_mktsegment AS domain, 'Parent ' || (c_custkey % 5) AS parent, 't' || (c_custkey % 9) AS target FROM customer)"""


def _records(spark, sf_dir):
    k = F.col("c_custkey")
    name = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    return t(spark, sf_dir, "customer").select(
        k.alias("seq"), name("c", 100).alias("id"), F.lit(None).cast("string").alias("concept_id"), F.col("c_name").alias("display_name"), F.when(k % 3 == 0, name("canon", 7)).alias("canonical_name"),
        F.lit("").alias("definition"), F.col("c_mktsegment").alias("domain"), F.lit(None).cast("string").alias("metadata"), F.array("c_mktsegment", F.upper("c_name")).alias("aliases"),
        F.array(F.struct(name("t", 9).alias("target"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("evidence"))).alias("relations"), name("Parent ", 5).alias("parent"),
    )


@query(f"""WITH {_RECORDS}, o AS (SELECT s_suppkey AS seq, 'c' || (s_suppkey % 50) AS id, s_name AS display_name, 'canon' || (s_suppkey % 7) AS canonical_name FROM supplier),
b AS (SELECT 0 AS n, 0 AS seq, id, display_name, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM o) WHERE k = 1 UNION ALL SELECT 1, seq, id, display_name, canonical_name FROM r),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, seq DESC, id) AS k FROM b) WHERE k = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY coalesce('n:' || canonical_name, 'i:' || id) ORDER BY n DESC, seq DESC, id) AS j FROM i) SELECT id, display_name, canonical_name FROM c WHERE j = 1""")
def kg_concepts_upsert(spark, sf_dir):
    k = F.col("s_suppkey")
    old = t(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (k % 50).cast("string")).alias("id"), F.col("s_name").alias("display_name"), F.concat(F.lit("canon"), (k % 7).cast("string")).alias("canonical_name"), k.alias("seq"))
    old = concepts.upsert(old.limit(0).select("id", "display_name", "canonical_name", "seq"), old, ["id"])
    new, _, _ = graph.rows_of(_records(spark, sf_dir))
    existing = old.select("id", "display_name", "canonical_name", F.lit("").alias("definition"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("metadata"))
    return graph.upsert_concepts(existing, new).select("id", "display_name", "canonical_name")


@query(f"WITH {_RECORDS} SELECT DISTINCT alias_text, id AS concept_id FROM (SELECT id, domain AS alias_text FROM r UNION ALL SELECT id, upper(display_name) FROM r UNION ALL SELECT 'c1', 'BUILDING')")
def kg_alias_dedupe(spark, sf_dir):
    _, aliases, _ = graph.rows_of(_records(spark, sf_dir))
    return concepts.add_aliases(spark.createDataFrame([("BUILDING", "c1")], "alias_text string, concept_id string"), aliases)


@query(f"""WITH {_RECORDS} SELECT DISTINCT id AS source_concept_id, 'related_to' AS relationship_type, target AS target_concept_id, 0.0 AS confidence FROM r UNION SELECT id, 'is_a', replace(lower(parent), ' ', '_'), 0.5 FROM r""")
def kg_edge_upsert(spark, sf_dir):
    _, _, edges = graph.rows_of(_records(spark, sf_dir))
    old = edges.limit(0).drop("seq").withColumn("seq", F.lit(0).cast("long")).select(*edges.columns)
    return graph.upsert_edges(old, edges).select("source_concept_id", "relationship_type", "target_concept_id", "confidence")


@query(f"WITH {_RECORDS} SELECT 'concepts' AS store, count(*) AS n FROM r UNION ALL SELECT 'edges', 2 * count(*) FROM r UNION ALL SELECT 'aliases', 2 * count(*) FROM r")
def kg_statistics(spark, sf_dir):
    c, a, e = graph.rows_of(_records(spark, sf_dir))
    return graph.table_sizes({"concepts": c, "edges": e, "aliases": a})


def _nations(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    e = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source_concept_id"), F.lit("is_a").alias("relationship_type"), F.col("r_name").alias("target_concept_id"))
    more = n.select(F.col("n_name").alias("source_concept_id"), F.lit("related_to").alias("relationship_type"), F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("target_concept_id"))
    c = n.select(F.col("n_name").alias("id"), F.initcap("n_name").alias("display_name")).union(r.select("r_name", F.initcap("r_name")))
    return e.union(more), c


_NATIONS = """e AS (SELECT n_name AS s, 'is_a' AS k, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'related_to', 'NATION_' || ((n_nationkey + 1) % 25) FROM nation),
c AS (SELECT n_name AS id, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS display_name FROM nation UNION ALL SELECT r_name, upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) FROM region WHERE r_name NOT LIKE '% %' UNION ALL SELECT r_name, 'Middle East' FROM region WHERE r_name = 'MIDDLE EAST')"""


@query(f"WITH {_NATIONS} SELECT s AS id, o AS related_id, display_name, k AS relationship_type, CAST(rank AS INT) AS rank FROM (SELECT s, o, k, display_name, row_number() OVER (PARTITION BY s ORDER BY k, o) AS rank FROM e JOIN c ON c.id = o) WHERE rank <= 5")
def kg_related(spark, sf_dir):
    e, c = _nations(spark, sf_dir)
    return graph.related_concepts(e, c, t(spark, sf_dir, "nation").select(F.col("n_name").alias("id")))


@query(f"WITH {_NATIONS} SELECT s AS source_concept_id, k AS relationship_type, o AS target_concept_id FROM e WHERE s IN (SELECT n_name FROM nation) AND o IN (SELECT n_name FROM nation)")
def kg_links(spark, sf_dir):
    return concepts.direct_links(_nations(spark, sf_dir)[0], t(spark, sf_dir, "nation").select(F.col("n_name").alias("id")))


@query(f"""WITH {_NATIONS}, a(alias_text, id) AS (VALUES ('Dark continent', 'AFRICA'), ('Old world', 'EUROPE'), ('zero', 'NATION_0')), i AS (SELECT n_name AS id FROM nation), p AS (SELECT i.id, o FROM i JOIN e ON s = i.id AND k = 'is_a'),
x AS (SELECT i.id, alias_text AS w FROM i JOIN a USING (id) UNION SELECT id, o FROM p UNION SELECT p.id, alias_text FROM p JOIN a ON a.id = p.o UNION SELECT i.id, s FROM i JOIN e ON o = i.id AND k = 'is_a' UNION SELECT i.id, o FROM i JOIN e ON s = i.id AND k = 'related_to')
SELECT id, string_agg(w, ',' ORDER BY w) AS keywords FROM (SELECT DISTINCT * FROM x) GROUP BY id""")
def kg_expand_keywords(spark, sf_dir):
    e, _ = _nations(spark, sf_dir)
    a = spark.createDataFrame([("Dark continent", "AFRICA"), ("Old world", "EUROPE"), ("zero", "NATION_0")], "alias_text string, concept_id string")
    return concepts.expanded_keywords(e, a, t(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))).select("id", F.array_join("keywords", ",").alias("keywords"))


_VOTES = "m AS (SELECT c_nationkey AS dataset, c_custkey AS ordinal, CASE WHEN c_custkey % 10 = 0 THEN 'Uncategorized' WHEN c_custkey % 10 > 1 THEN c_mktsegment END AS domain FROM customer)"


@query(f"WITH {_VOTES} SELECT CAST(dataset AS VARCHAR) AS dataset, domain, votes FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY votes DESC, f) AS n FROM (SELECT dataset, domain, count(*) AS votes, min(ordinal) AS f FROM m WHERE domain <> 'Uncategorized' GROUP BY ALL)) WHERE n = 1")
def kg_domain_consensus(spark, sf_dir):
    k = F.col("c_custkey") % 10
    m = t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("dataset"), F.col("c_custkey").alias("ordinal"), F.when(k == 0, "Uncategorized").when(k > 1, F.col("c_mktsegment")).alias("domain"))
    return reasoning.domain_consensus(m)


@query(f"""WITH {_NATIONS}, d AS (SELECT r_name AS dataset, n_name AS concept FROM nation JOIN region ON n_regionkey = r_regionkey), l AS (SELECT dataset, s, k, o FROM d JOIN e ON s = concept),
i AS (SELECT l.dataset, string_agg(cs.display_name || ' --[' || k || ']--> ' || co.display_name, '|' ORDER BY cs.display_name || ' --[' || k || ']--> ' || co.display_name) AS links FROM l JOIN d ON d.dataset = l.dataset AND d.concept = l.o JOIN c cs ON cs.id = s JOIN c co ON co.id = o GROUP BY l.dataset),
a AS (SELECT dataset, string_agg(name || ':' || strength, '|' ORDER BY n) AS anchors FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY strength DESC, name) AS n FROM (SELECT dataset, o, min(display_name) AS name, count(*) AS strength FROM l JOIN c ON c.id = o GROUP BY dataset, o HAVING count(*) >= 2)) WHERE n <= 3 GROUP BY dataset)
SELECT r_name AS dataset, CASE WHEN (SELECT count(*) FROM d WHERE d.dataset = r_name) >= 2 THEN 'success' ELSE 'insufficient_data' END AS status, a.anchors, i.links AS internal_links FROM region LEFT JOIN a ON a.dataset = r_name LEFT JOIN i ON i.dataset = r_name""")
def kg_dataset_context(spark, sf_dir):
    e, c = _nations(spark, sf_dir)
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    of = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    columns = of.select(F.col("r_name").alias("dataset"), F.col("n_name").alias("column_name"))
    matches = of.select(F.col("r_name").alias("dataset"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("concept_id"), F.lit(None).cast("string").alias("domain"))
    found = reasoning.dataset_context(columns, matches, e, c)
    return found.select("dataset", "status", F.array_join(F.transform("anchors", lambda x: F.concat(x["name"], F.lit(":"), x["strength"])), "|").alias("anchors"), F.array_join("internal_links", "|").alias("internal_links"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), a AS (SELECT query_id, query_id + 1 AS id FROM q WHERE query_id + 1 IN (SELECT vec_id FROM embeddings)),
n AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM q, embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM n),
b AS (SELECT query_id, id, 1.0 AS score, 1 AS p FROM a UNION ALL SELECT query_id, id, score, 0 FROM k WHERE r <= 5 AND score >= 0.0), m AS (SELECT query_id, id, max(score) AS score, arg_max(p, score) AS p FROM b GROUP BY query_id, id)
SELECT query_id, id, round(score, 6) AS score, CASE WHEN p = 1 THEN 'alias' ELSE 'vector' END AS method, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, round(score, 9) DESC, id) AS rank FROM m) WHERE rank <= 5""")
def kg_search(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("Concept "), (F.col("vec_id") + 1).cast("string")).alias("text"), F.col("embedding").alias("vector"))
    aliases = e.select(F.concat(F.lit("CONCEPT "), F.col("vec_id").cast("string")).alias("alias_text"), F.col("vec_id").alias("concept_id"))
    return r6(graph.search_concepts(queries, aliases, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5), "score")


# rules

_NAME = "lower(trim(column_name))"
_SKIP = " OR ".join(match(_NAME, p if p.startswith("^") else "^" + p) for p in rules.SKIPPED)
_ANCHOR = holds(_NAME, rules.ANCHORS)


def _ruled(yields) -> str:
    return case([(f"({_SKIP})", yields[0]), (f"{_NAME} IN {words_sql(rules.ABBREVIATIONS)}", yields[1]), (f"length({_NAME}) <= 4 AND {_NAME} NOT IN {words_sql(rules.PLAIN)}", yields[2]), (f"{_NAME} IN {words_sql(rules.ANCHORS)}", yields[3]), (_ANCHOR, yields[4])], yields[5])


_LABELS = ["'skip_kg'", "'abbreviation'", "'abbreviation'", "'domain_anchoring'", "'domain_anchoring'", "'semantic_search'"]


@query(f"WITH {_COLUMNS} SELECT column_name, {_ruled(_LABELS)} AS problem, CAST({_ruled(['0.95', '0.85', '0.70', '0.75', '0.65', '0.60'])} AS DOUBLE) AS confidence, {_ruled(_LABELS)} <> 'skip_kg' AS query_kg FROM c")
def rule_classify(spark, sf_dir):
    return rules.classify_columns(all_columns(spark, sf_dir).select("column_name"))


@query(f"WITH {_COLUMNS}, k AS (SELECT {_ruled(_LABELS)} AS label FROM c) SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share FROM k GROUP BY label")
def rule_summary(spark, sf_dir):
    return r6(injection.summary(rules.classify_columns(all_columns(spark, sf_dir).select("column_name")), "problem"), "share")


_PART = {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "float"}
_ROUTES = " UNION ALL ".join(f"SELECT {quoted(c)} AS column_name, {rules.CLARITY[k]} AS clear, count(DISTINCT {c}) / count(*) AS u, (count(*) - count({c})) / count(*) AS nulls, count({c}) AS n, {int(k != 'string')} AS number FROM part" for c, k in _PART.items())


@query(f"""WITH p AS ({_ROUTES}), s AS (SELECT column_name, CAST(round(least(1.0, clear + CASE WHEN nulls < 0.05 THEN 0.15 WHEN nulls < 0.2 THEN 0.075 ELSE 0 END + CASE WHEN u > 0.01 AND u < 0.9 THEN 0.1 ELSE 0 END + number * 0.2 + CASE WHEN n >= 3 THEN 0.1 ELSE 0 END), 6) AS DOUBLE) AS confidence FROM p)
SELECT column_name, confidence, CASE WHEN confidence > 0.8 THEN 'MINIMAL' WHEN confidence < 0.5 THEN 'FULL' ELSE 'STANDARD' END AS policy, CASE WHEN confidence > 0.8 THEN 1 WHEN confidence < 0.5 THEN 3 ELSE 2 END AS max_concepts FROM s""")
def rule_route(spark, sf_dir):
    return rules.route(profile.profile(t(spark, sf_dir, "part"), exact=True))


_TOPIC_WORDS = ", ".join(f"({quoted(w)})" for d in topics.DOMAINS.values() for w in d)
_CONCEPT_NAMES = f"n AS (SELECT DISTINCT w AS display_name FROM (VALUES {_TOPIC_WORDS}) v(w) UNION SELECT DISTINCT column_name FROM c UNION SELECT unnest(['Order Date', 'cities', 'user_id', 'Stock Ticker', 'countries', 'adj_close']))"
_SCORE = "round(length(display_name) % 10 / 10, 1)"
_BARE = "lower(trim(display_name))"
for _ending in injection.ENDINGS:
    _BARE = f"regexp_replace({_BARE}, '(.){_ending}$', '\\1')"
_TIER = case([(f"lower(trim(display_name)) IN {words_sql(injection.COMMON)} OR replace({_BARE}, '_', '') IN {words_sql(injection.COMMON)}", "'tier_0'"), (holds("lower(trim(display_name))", injection.ENTITIES), "'tier_2'"), (holds("lower(trim(display_name))", injection.TERMS), "'tier_1'")], "'unknown'")


def _named(spark, sf_dir):
    words = [(w,) for d in topics.DOMAINS.values() for w in d] + [(w,) for w in ("Order Date", "cities", "user_id", "Stock Ticker", "countries", "adj_close")]
    names = spark.createDataFrame(words, "display_name string").union(all_columns(spark, sf_dir).select("column_name")).distinct()
    return names.withColumn("score", F.round(F.length("display_name") % 10 / 10, 1))


@query(f"""WITH {_COLUMNS}, {_CONCEPT_NAMES}, s AS (SELECT display_name, {_SCORE} AS score, {_TIER} AS tier FROM n)
SELECT display_name, tier, CASE WHEN tier = 'tier_0' THEN false WHEN tier = 'unknown' THEN score > 0.5 ELSE true END AS should_inject, CAST(CASE tier WHEN 'tier_0' THEN 0.0 WHEN 'tier_1' THEN 0.8 WHEN 'tier_2' THEN 1.0 ELSE CASE WHEN score > 0.7 THEN least(1.0, score) ELSE 0.5 END END AS DOUBLE) AS injection_weight FROM s""")
def rule_tier(spark, sf_dir):
    return injection.tier_filter(_named(spark, sf_dir)).select("display_name", "tier", "should_inject", "injection_weight")


_TOKENS = "list_filter(regexp_split_to_array(translate(lower(trim({c})), '_-', '  '), '\\s+'), lambda x: x <> '')"
_ONLY = "(len({x}) > 0 AND len(list_filter({x}, lambda y: y NOT IN " + words_sql(injection.GENERIC) + ")) = 0)"
_GENERIC = f"({_ONLY.format(x=_TOKENS.format(c='display_name'))} OR {_ONLY.format(x=_TOKENS.format(c='id'))})"


@query(f"""WITH {_COLUMNS}, {_CONCEPT_NAMES}, m AS (SELECT 'x_' || display_name AS id, display_name, repeat('d', length(display_name) * 4) AS definition, length(display_name) % 3 AS aliases, length(display_name) % 2 = 0 AS attributes, {_SCORE} AS score FROM n),
v AS (SELECT *, {_GENERIC} AS generic, (CASE WHEN len(regexp_split_to_array(display_name, '\\s+')) >= 3 THEN 30 WHEN len(regexp_split_to_array(display_name, '\\s+')) = 2 THEN 15 ELSE 0 END + CASE WHEN length(definition) > 50 THEN 30 WHEN length(definition) > 20 THEN 15 ELSE 0 END
+ CASE WHEN aliases >= 2 THEN 20 WHEN aliases = 1 THEN 10 ELSE 0 END + CASE WHEN attributes THEN 20 ELSE 0 END) / 100 AS novelty FROM m) SELECT display_name, generic, novelty, NOT generic AND NOT (score >= 0.9 AND NOT attributes) AND novelty >= 0.3 AS keep FROM v""")
def rule_prune(spark, sf_dir):
    n = F.length("display_name")
    m = _named(spark, sf_dir).select(
        F.concat(F.lit("x_"), "display_name").alias("id"), "display_name", F.repeat(F.lit("d"), n * 4).alias("definition"), F.array_repeat(F.lit("a"), n % 3).alias("aliases"),
        F.when(n % 2 == 0, F.lit('{"unit": "kg"}')).otherwise(F.lit('{"domain": "general"}')).alias("metadata"), "score",
    )
    return injection.prune(m).select("display_name", "generic", "novelty", "keep")


_PAIRED = """m(display_name, column_name, data_type, min, max, unique_count, unique_ratio, skewness, score) AS (VALUES ('Price', 'p_retailprice', 'float', 1.0, 9.0, 50, 0.5, 0.1, 0.9), ('price', 'name', 'string', NULL, NULL, 50, 0.5, NULL, 0.95),
('percentage', 'share', 'float', 0.0, 500.0, 9, 0.1, 0.0, 0.8), ('count', 'n', 'integer', -3.0, 9.0, 9, 0.1, 0.0, 0.8), ('Active flag', 'is_on', 'integer', 0.0, 7.0, 8, 0.1, 0.0, 0.7), ('product code', 'sku', 'string', NULL, NULL, 3, 0.01, NULL, 0.6),
('price', 'p', 'float', 0.0, 9.0, 3, 0.2, -2.0, 0.92), ('coast line', 'year', 'integer', 1990.0, 2000.0, 9, 0.1, 0.0, 0.9), ('stock market', 'city', 'string', NULL, NULL, 9, 0.1, NULL, 0.9), ('Years of Schooling', 'school', 'integer', 1950.0, 2001.0, 9, 0.1, 0.0, 0.8),
('age', 'age', 'integer', -1.0, 40.0, 40, 0.2, 0.0, 0.8), ('humidity', 'wind', 'float', 0.0, 1.0, 9, 0.2, 0.0, 0.55), ('Average', 'x', 'integer', 0.0, 1.0, 2, 0.1, 0.0, 0.4))"""
_TYPE = "CASE data_type WHEN 'integer' THEN 'int64' WHEN 'float' THEN 'float64' WHEN 'boolean' THEN 'bool' WHEN 'datetime' THEN 'datetime64' WHEN 'string' THEN 'object' ELSE data_type END"


def _hint(i: int) -> str:
    make = lambda v: "NULL" if v is None else f"[{', '.join(map(quoted, v))}]" if isinstance(v, list) else quoted(v) if isinstance(v, str) else str(v)
    return case([(f"c = {quoted(e[0])}", make(e[i])) for e in injection.EXPECTED] + [(f"contains(c, {quoted(e[0])})", make(e[i])) for e in injection.EXPECTED])


def _domains(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {match(c, '(?i)' + chr(92) + 'b(' + '|'.join(w) + ')' + chr(92) + 'b')} THEN {quoted(d)} END" for d, w in injection.DOMAINS.items()) + "], lambda x: x IS NOT NULL)"


_CONFLICTS = f"""{_PAIRED}, h AS (SELECT *, lower(display_name) AS c, lower(column_name) AS n, {_TYPE} AS ty FROM m), w AS (SELECT *, {_hint(0)} AS word, {_hint(1)} AS types, {_hint(2)} AS kind, {_hint(3)} AS low, {_hint(4)} AS high, {_domains('n')} AS dn, {_domains('c')} AS dc FROM h),
f AS (SELECT *, CASE WHEN word IS NOT NULL AND len(list_filter(types, lambda x: contains(ty, x))) = 0 THEN 30 END AS f1, CASE WHEN min < low * 0.5 OR max > high * 2 THEN 30 WHEN word = 'count' AND min < 0 THEN 20 END AS f2,
CASE WHEN kind = 'boolean' AND unique_count > 3 THEN 25 WHEN word = 'code' AND unique_ratio < 0.5 THEN 20 WHEN word = 'price' AND skewness < -1 THEN 15 END AS f3,
CASE WHEN len(dn) > 0 AND len(dc) > 0 AND list_contains(dn, 'temporal') AND list_contains(dc, 'geographic') AND {holds('c', injection.PLACES)} AND NOT {holds('n', injection.PLACES)} THEN 40 WHEN len(dn) > 0 AND len(dc) > 0 AND NOT list_has_any(dn, dc) THEN 50 END AS f4,
CASE WHEN contains(c, 'years of schooling') AND min > 1900 AND max < 2100 THEN 40 WHEN contains(c, 'age') AND (max > 150 OR min < 0) THEN 40 END AS f5 FROM w),
g AS (SELECT *, least(100, coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) + coalesce(f4, 0) + coalesce(f5, 0)) AS total, greatest(coalesce(f1, 0), coalesce(f2, 0), coalesce(f3, 0), coalesce(f4, 0), coalesce(f5, 0)) AS worst FROM f),
k AS (SELECT *, total / 100 AS penalty, CASE WHEN total > 50 THEN 'reject' WHEN total > 20 THEN 'downweight' ELSE 'accept' END AS resolution,
CASE WHEN worst = 0 THEN 'none' WHEN f1 = worst THEN 'type_mismatch' WHEN f2 = worst THEN 'range_violation' WHEN f3 = worst THEN 'distribution_conflict' WHEN f4 = worst THEN 'domain_mismatch' ELSE 'semantic_conflict' END AS conflict_type FROM g)"""


def _pairs(spark, sf_dir):
    rows = [
        ("Price", "p_retailprice", "float", 1.0, 9.0, 50, 0.5, 0.1, 0.9), ("price", "name", "string", None, None, 50, 0.5, None, 0.95), ("percentage", "share", "float", 0.0, 500.0, 9, 0.1, 0.0, 0.8), ("count", "n", "integer", -3.0, 9.0, 9, 0.1, 0.0, 0.8),
        ("Active flag", "is_on", "integer", 0.0, 7.0, 8, 0.1, 0.0, 0.7), ("product code", "sku", "string", None, None, 3, 0.01, None, 0.6), ("price", "p", "float", 0.0, 9.0, 3, 0.2, -2.0, 0.92), ("coast line", "year", "integer", 1990.0, 2000.0, 9, 0.1, 0.0, 0.9),
        ("stock market", "city", "string", None, None, 9, 0.1, None, 0.9), ("Years of Schooling", "school", "integer", 1950.0, 2001.0, 9, 0.1, 0.0, 0.8), ("age", "age", "integer", -1.0, 40.0, 40, 0.2, 0.0, 0.8), ("humidity", "wind", "float", 0.0, 1.0, 9, 0.2, 0.0, 0.55),
        ("Average", "x", "integer", 0.0, 1.0, 2, 0.1, 0.0, 0.4),
    ]
    return spark.createDataFrame(rows, "display_name string, column_name string, data_type string, min double, max double, unique_count int, unique_ratio double, skewness double, score double")


@query(f"WITH {_CONFLICTS} SELECT display_name, column_name, total > 0 AS has_conflict, conflict_type, resolution, CAST(penalty AS DOUBLE) AS penalty, CAST(round(CASE resolution WHEN 'reject' THEN 0.0 WHEN 'downweight' THEN score * (1 - penalty) ELSE score END, 6) AS DOUBLE) AS adjusted_score FROM k")
def rule_conflict(spark, sf_dir):
    return r6(injection.conflicts(_pairs(spark, sf_dir)).select("display_name", "column_name", "has_conflict", "conflict_type", "resolution", "penalty", "adjusted_score"), "adjusted_score")


@query(f"WITH {_CONFLICTS}, l AS (SELECT *, score * (1 - penalty) AS s FROM k) SELECT display_name, column_name, CAST(round(s, 6) AS DOUBLE) AS lowered_score, CASE WHEN resolution = 'reject' THEN 'UNCERTAIN' WHEN s >= 0.9 THEN 'EXACT' WHEN s >= 0.7 THEN 'RELATED' WHEN s >= 0.5 THEN 'CONTEXTUAL' ELSE 'UNCERTAIN' END AS semantic_strength FROM l")
def rule_strength(spark, sf_dir):
    return r6(injection.strengths(_pairs(spark, sf_dir)).select("display_name", "column_name", "lowered_score", "semantic_strength"), "lowered_score")


_PAIR_COLUMNS = [("lineitem", "l_quantity", "float"), ("lineitem", "l_extendedprice", "float"), ("lineitem", "l_discount", "float"), ("lineitem", "l_returnflag", "string"), ("part", "p_retailprice", "float"), ("part", "p_size", "integer"), ("part", "p_brand", "string"), ("customer", "c_acctbal", "float"), ("orders", "o_orderdate", "datetime"), ("events", "value", "float")]
_PAIR_CONCEPTS = [("Price", 0.95), ("Percentage", 0.8), ("Count", 0.75), ("Active flag", 0.7), ("Product code", 0.6), ("age", 0.9), ("Average", 0.5)]


def _pair_sql() -> str:
    rows = []
    for table, c, kind in _PAIR_COLUMNS:
        number = f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" if kind in ("float", "integer") else "NULL::DOUBLE AS min, NULL::DOUBLE AS max"
        shape = f"skewness(CAST({c} AS DOUBLE))" if kind in ("float", "integer") else "NULL::DOUBLE"
        rows.append(f"SELECT '{c}' AS column_name, '{kind}' AS data_type, {number}, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) / count(*) AS unique_ratio, {shape} AS skewness FROM {table}")
    concepts_ = ", ".join(f"({quoted(n)}, {s})" for n, s in _PAIR_CONCEPTS)
    return f"m AS (SELECT k.display_name, p.*, CAST(k.score AS DOUBLE) AS score FROM ({' UNION ALL '.join(rows)}) p, (VALUES {concepts_}) k(display_name, score))"


_REAL_CONFLICTS = _CONFLICTS.replace(_PAIRED, _pair_sql())


def _table_pairs(spark, sf_dir):
    """Profiles of columns of the tables, each with a few concepts that it may be taken for."""
    found = None
    for table in dict.fromkeys(x for x, _, _ in _PAIR_COLUMNS):
        p = profile.profile(t(spark, sf_dir, table).select(*[c for x, c, _ in _PAIR_COLUMNS if x == table]), exact=True)
        p = p.select("column_name", "data_type", "min", "max", "unique_count", "unique_ratio", "skewness")
        found = p if found is None else found.union(p)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("display_name"), F.lit(s).alias("score")) for n, s in _PAIR_CONCEPTS]))
    return found.withColumn("x", named).select("x.display_name", *found.columns, "x.score")


@query(f"""WITH {_REAL_CONFLICTS}, a AS (SELECT *, CAST(CASE resolution WHEN 'reject' THEN 0.0 WHEN 'downweight' THEN score * (1 - penalty) ELSE score END AS DOUBLE) AS adjusted FROM k)
SELECT display_name, column_name, total > 0 AS has_conflict, conflict_type, resolution, CAST(penalty AS DOUBLE) AS penalty, round(adjusted, 6) AS adjusted_score, resolution = 'reject' AS filtered, CAST(row_number() OVER (PARTITION BY column_name ORDER BY adjusted DESC, score DESC, display_name) AS INT) AS rank FROM a""")
def rule_conflict_tables(spark, sf_dir):
    """Conflicts between concepts and the profiles of columns of the given tables, and the order that is left."""
    return r6(injection.ranked_matches(_table_pairs(spark, sf_dir)).select("display_name", "column_name", "has_conflict", "conflict_type", "resolution", "penalty", "adjusted_score", "filtered", "rank"), "adjusted_score")


@query(f"WITH {_REAL_CONFLICTS}, l AS (SELECT *, score * (1 - penalty) AS s FROM k) SELECT display_name, column_name, CAST(round(s, 6) AS DOUBLE) AS lowered_score, CASE WHEN resolution = 'reject' THEN 'UNCERTAIN' WHEN s >= 0.9 THEN 'EXACT' WHEN s >= 0.7 THEN 'RELATED' WHEN s >= 0.5 THEN 'CONTEXTUAL' ELSE 'UNCERTAIN' END AS semantic_strength FROM l")
def rule_strength_tables(spark, sf_dir):
    return r6(injection.strengths(_table_pairs(spark, sf_dir)).select("display_name", "column_name", "lowered_score", "semantic_strength"), "lowered_score")


@query("""WITH v AS (SELECT 'orders' AS dataset, 'o_orderstatus' AS column_name, 'string' AS data_type, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS s, NULL AS lo, NULL AS hi FROM orders
UNION ALL SELECT 'orders', 'order_id', 'integer', NULL, min(o_orderkey), max(o_orderkey) FROM orders UNION ALL SELECT 'part', 'p_size', 'integer', NULL, min(p_size), max(p_size) FROM part
UNION ALL SELECT 'customer', 'c_acctbal', 'float', NULL, min(c_acctbal), max(c_acctbal) FROM customer),
d(dataset, domain) AS (VALUES ('orders', 'E-commerce'), ('customer', 'E-commerce')),
n AS (SELECT v.*, coalesce(domain, 'General') AS domain, array_to_string(list_transform(string_split(lower(translate(column_name, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS readable FROM v LEFT JOIN d USING (dataset))
SELECT dataset, column_name, 'inferred_' || column_name AS id, CASE WHEN column_name = 'order_id' AND domain = 'E-commerce' THEN 'Unique identifier for a purchase order' ELSE readable || ' - a ' || data_type || ' field' || CASE WHEN data_type = 'string' THEN ' (possible values: ' || array_to_string(s, ', ') || ')' ELSE printf(' (typical range: %.2f to %.2f)', CAST(lo AS DOUBLE), CAST(hi AS DOUBLE)) END END AS definition,
domain, CAST(CASE WHEN column_name = 'order_id' AND domain = 'E-commerce' THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence FROM n""")
def match_inferred_tables(spark, sf_dir):
    """Definitions of columns without a match from their values in the given tables."""
    orders, part, customer = (t(spark, sf_dir, n) for n in ("orders", "part", "customer"))
    values = lambda df, dataset, name, kind, c: df.agg((F.array_sort(F.collect_set(c)) if kind == "string" else F.array(F.min(c).cast("string"), F.max(c).cast("string"))).alias("samples")).select(F.lit(dataset).alias("dataset"), F.lit(name).alias("column_name"), F.lit(kind).alias("data_type"), "samples")
    columns = values(orders, "orders", "o_orderstatus", "string", "o_orderstatus").union(values(orders, "orders", "order_id", "integer", "o_orderkey")).union(values(part, "part", "p_size", "integer", "p_size")).union(values(customer, "customer", "c_acctbal", "float", "c_acctbal"))
    told = all_columns(spark, sf_dir).where("dataset in ('orders', 'part', 'customer')").select("dataset", F.when(F.col("dataset") == "part", F.col("column_name")).otherwise(F.concat("column_name", F.lit(" of a customer order"))).alias("text"))
    found = reasoning.inferred_concepts(columns, reasoning.context_domains(told))
    return found.select("dataset", "column_name", "id", "definition", "domain", "confidence")


_SETS = {"prices": ["Open", "High", "low", " close", "x"], "health": ["charges", "bmi", "smoker"], "shop": ["order_id", "customer_id", "price"], "series": ["date", "a", "b"], "bare": ["date", "a"]}


@query(f"""WITH {_COLUMNS}, d AS (SELECT dataset, column_name FROM c UNION ALL SELECT * FROM (VALUES {', '.join(f"({quoted(k)}, {quoted(v)})" for k, vs in _SETS.items() for v in vs)})), g AS (SELECT dataset, list(lower(trim(column_name))) AS n FROM d GROUP BY dataset)
SELECT dataset, CASE WHEN list_has_all(n, ['open', 'high', 'low', 'close']) THEN 'Financial_OHLC_TimeSeries' WHEN len(list_intersect(n, {list(reasoning.INSURANCE)})) >= 3 THEN 'Healthcare_Insurance_Underwriting' WHEN len(list_intersect(n, {list(reasoning.ORDERS)})) >= 3 THEN 'E-commerce_Transaction'
WHEN list_has_any(n, {list(reasoning.TIMES)}) AND len(list_filter(n, lambda x: x NOT IN {words_sql(reasoning.TIMES)})) >= 2 THEN 'Generic_TimeSeries' END AS pattern FROM g""")
def rule_pattern(spark, sf_dir):
    made = spark.createDataFrame([(k, v) for k, vs in _SETS.items() for v in vs], "dataset string, column_name string")
    return reasoning.dataset_patterns(all_columns(spark, sf_dir).select("dataset", "column_name").union(made))


@query(f"""WITH {_COLUMNS}, w AS (SELECT dataset, string_agg(lower(column_name), ' ') AS x FROM c GROUP BY dataset), k AS (SELECT dataset, {', '.join('(' + ' + '.join(f'CAST(contains(x, {quoted(v)}) AS INT)' for v in words) + f') AS s{i}' for i, words in enumerate(reasoning.CONTEXTS.values()))} FROM w)
SELECT dataset, CASE WHEN greatest(s0, s1, s2) < 2 THEN NULL WHEN s0 = greatest(s0, s1, s2) THEN 'Healthcare' WHEN s1 = greatest(s0, s1, s2) THEN 'Finance' ELSE 'E-commerce' END AS domain FROM k""")
def match_context_domain(spark, sf_dir):
    return reasoning.context_domains(all_columns(spark, sf_dir).select("dataset", F.col("column_name").alias("text")))


@query("""SELECT * FROM (VALUES ('shop', 'order_id', 'inferred_order_id', 'Unique identifier for a purchase order', 'E-commerce', 0.75), ('shop', 'unit_weight', 'inferred_unit_weight', 'Unit Weight - a float field (typical range: 1.50 to 22.00)', 'E-commerce', 0.6),
('plain', 'color', 'inferred_color', 'Color - a string field (possible values: blue, red)', 'General', 0.6)) v(dataset, column_name, id, definition, domain, confidence)""")
def match_inferred(spark, sf_dir):
    columns = spark.createDataFrame([("shop", "order_id", "integer", ["1"]), ("shop", "unit_weight", "float", ["22", "1.5"]), ("plain", "color", "string", ["red", "blue", "red"])], "dataset string, column_name string, data_type string, samples array<string>")
    domains = reasoning.context_domains(spark.createDataFrame([("shop", "customer order checkout"), ("plain", "nothing")], "dataset string, text string"))
    return reasoning.inferred_concepts(columns, domains).select("dataset", "column_name", "id", "definition", "domain", "confidence")


_SIGNAL_HEADS = heads_sql("customer", ["c_mktsegment"], 20, "c_custkey") + " UNION ALL " + heads_sql("pages", ["url"], 20, "page_id")


@query(f"""WITH h AS ({_SIGNAL_HEADS}), f AS ({' UNION ALL '.join(f"SELECT column_name, {quoted(n)} AS concept, 0.9 AS score, 0.9 AS confidence, 'sample_values' AS signal FROM h GROUP BY column_name HAVING avg(CASE WHEN {match('value', p)} THEN 1.0 ELSE 0.0 END) > 0.7" for n, p in reasoning.SAMPLE_FORMATS)}
UNION ALL SELECT column_name, 'Ticker Symbol', 0.85, 0.8, 'sample_values' FROM h GROUP BY column_name HAVING avg(length(value)) BETWEEN 2 AND 6 AND bool_and(regexp_matches(value, '^[A-Z]+$')) FILTER (place <= 10)
UNION ALL SELECT 'c_mktsegment', 'category', 0.7, 0.7, 'stats_pattern' FROM customer HAVING count(DISTINCT c_mktsegment) / count(*) < 0.1 UNION ALL SELECT 'url', 'identifier', 0.7, 0.7, 'stats_pattern' FROM pages HAVING count(DISTINCT url) / count(*) > 0.9
UNION ALL SELECT unnest(['c_mktsegment', 'url']), 'financial metric', 0.6, 0.6, 'dataset_context' UNION ALL SELECT 'c_mktsegment', 'category', 0.8, 0.9, 'kg_match'),
w AS (SELECT *, CASE WHEN column_name = 'url' THEN CASE signal WHEN 'sample_values' THEN 0.45 WHEN 'kg_match' THEN 0.4 ELSE 0.05 END ELSE CASE signal WHEN 'kg_match' THEN 0.6 ELSE 0.1 END END AS weight FROM f),
g AS (SELECT column_name, concept, sum(score * weight * confidence) / sum(weight) AS score, count(*) AS signals FROM w GROUP BY ALL)
SELECT column_name, concept, CAST(round(score, 6) AS DOUBLE) AS score, signals, CASE WHEN score >= 0.85 AND signals >= 2 THEN 'EXACT' WHEN score >= 0.6 THEN 'RELATED' ELSE 'CONTEXTUAL' END AS strength FROM g""")
def fuse_signals(spark, sf_dir):
    customer, pages = t(spark, sf_dir, "customer"), t(spark, sf_dir, "pages")
    first = details.heads(customer, ["c_mktsegment"], 20, ["c_custkey"]).union(details.heads(pages, ["url"], 20, ["page_id"]))
    profiles = profile.profile(customer.select("c_mktsegment"), exact=True).union(profile.profile(pages.select("url"), exact=True))
    kg = spark.createDataFrame([("c_mktsegment", "category", 0.8)], "column_name string, concept string, score double")
    problems = spark.createDataFrame([("c_mktsegment", "semantic_search"), ("url", "entity_linking")], "column_name string, problem string")
    return r6(reasoning.match_signals(first, profiles, kg, problems, "ESG report"), "score").select("column_name", "concept", "score", "signals", "strength")


_PARTS = "k AS (SELECT lower(p_name) AS norm, CAST(max(p_partkey) AS VARCHAR) AS id, min(p_partkey) AS seq FROM part GROUP BY 1)"


@query(f"""WITH {_PARTS}, x AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name AS column_name FROM x UNION ALL SELECT 'alias of ' || p_name FROM x UNION ALL SELECT 'the very long descriptive concept name of ' || p_name || 's' FROM x UNION ALL SELECT 'zzz' || p_name FROM x UNION ALL SELECT 'shown as ' || p_name FROM x),
n AS (SELECT norm, id, seq FROM k UNION ALL SELECT 'the very long descriptive concept name of ' || norm, id, seq FROM k), a AS (SELECT 'alias of ' || norm AS norm, id, seq FROM k), l AS (SELECT column_name, lower(column_name) AS norm FROM c),
e AS (SELECT column_name, l.norm, n.id AS nid, a.id AS aid FROM l LEFT JOIN n USING (norm) LEFT JOIN a ON a.norm = l.norm), p AS (SELECT norm, id, seq, 0 AS level FROM n UNION ALL SELECT norm, id, seq, 1 FROM a),
f AS (SELECT column_name, p.id, p.level, p.seq, 100.0 * (1 - levenshtein(e.norm, p.norm) / (length(e.norm) + length(p.norm))) AS score FROM e JOIN p ON nid IS NULL AND aid IS NULL AND abs(length(e.norm) - length(p.norm)) = 1 AND levenshtein(e.norm, p.norm) = 1),
b AS (SELECT column_name, id, score FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY level, score DESC, seq, id) AS r FROM f WHERE score >= 95) WHERE r = 1)
SELECT e.column_name, coalesce(nid, aid, b.id) AS concept_id, CASE WHEN nid IS NOT NULL THEN 'exact' WHEN aid IS NOT NULL THEN 'alias' WHEN b.id IS NOT NULL THEN 'fuzzy' ELSE 'no_match' END AS method, CAST(round(CASE WHEN coalesce(nid, aid) IS NOT NULL THEN 100.0 ELSE coalesce(b.score, 0.0) END, 6) AS DOUBLE) AS score FROM e LEFT JOIN b USING (column_name)""")
def match_cascade(spark, sf_dir):
    names = t(spark, sf_dir, "part").select("p_name").distinct()
    long = "the very long descriptive concept name of "
    made = [F.col("p_name"), F.concat(F.lit("alias of "), "p_name"), F.concat(F.lit(long), "p_name", F.lit("s")), F.concat(F.lit("zzz"), "p_name"), F.concat(F.lit("shown as "), "p_name")]
    columns = names.select(F.explode(F.array(*made)).alias("column_name"))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("id"), "p_name")
    known = rows.select("seq", "id", F.lit("").alias("canonical_name"), F.col("p_name").alias("display_name")).union(rows.select("seq", "id", F.concat(F.lit(long), "p_name"), F.concat(F.lit("shown as "), "p_name")))
    aliases = rows.select("seq", F.concat(F.lit("alias of "), "p_name").alias("alias_text"), F.col("id").alias("concept_id"))
    return r6(concepts.match_columns(columns, known, aliases), "score")


_CONTEXT_TABLES = ("orders", "lineitem", "customer", "part")
_CONTEXT_KEYS = ("price", "cust", "disc", "order")
_CONTEXT_TEXT = "the {} of a customer order"


@query(f"""WITH {_COLUMNS}, x AS (SELECT dataset, place, column_name, data_type, {' OR '.join(f"contains(column_name, '{k}')" for k in _CONTEXT_KEYS)} AS hit FROM c WHERE dataset IN {_CONTEXT_TABLES}),
k(domain, i, word) AS (VALUES {', '.join(f"({quoted(d)}, {i}, {quoted(w)})" for i, (d, ws) in enumerate(reasoning.CONTEXTS.items()) for w in ws)}),
w AS (SELECT a.dataset, a.column_name, k.domain, k.i, count(DISTINCT word) AS n FROM x a JOIN x b ON a.dataset = b.dataset AND b.place < a.place AND b.hit JOIN k ON contains('the ' || b.column_name || ' of a customer order', word) GROUP BY ALL),
d AS (SELECT dataset, column_name, domain FROM (SELECT *, row_number() OVER (PARTITION BY dataset, column_name ORDER BY n DESC, i) AS r FROM w WHERE n >= 2) WHERE r = 1)
SELECT x.dataset, CAST(place AS INT) AS place, x.column_name, CASE WHEN hit THEN 'concept_' || x.column_name WHEN domain IS NOT NULL THEN 'inferred_' || x.column_name END AS concept_id,
CAST(CASE WHEN hit THEN 0.9 WHEN domain IS NOT NULL THEN 0.6 END AS DOUBLE) AS score, CASE WHEN hit THEN 'matched' WHEN domain IS NOT NULL THEN 'context_inference' ELSE 'no_match' END AS source, domain FROM x LEFT JOIN d USING (dataset, column_name)""")
def match_running_context(spark, sf_dir):
    """Columns of four tables in order; those with certain names are matched, the others inferred from the matches before them."""
    found = []
    for name in _CONTEXT_TABLES:
        df = t(spark, sf_dir, name)
        samples = details.sample_values(df, df.columns).groupBy("column_name").agg(F.array_sort(F.collect_set("value")).alias("samples"))
        found.append(details.column_types(df).select(F.lit(name).alias("dataset"), "place", "column_name", "data_type").join(samples, "column_name", "left"))
    columns = found[0]
    for other in found[1:]:
        columns = columns.unionByName(other)
    hit = text.contains_any(F.col("column_name"), list(_CONTEXT_KEYS))
    matched = columns.where(hit).select("dataset", "column_name", F.concat(F.lit("concept_"), "column_name").alias("concept_id"), F.lit(0.9).alias("score"))
    told = matched.select("dataset", "column_name", F.concat(F.lit("the "), "column_name", F.lit(" of a customer order")).alias("text"))
    return reasoning.with_running_context(matched, columns, told)


def _by_size(prompts: list[str]) -> list[str]:
    """A model that can be computed: it scores a concept by the last digits of its id, and leaves out the second one of each list."""
    import json
    import re

    answers = []
    for prompt in prompts:
        ids = [x for i, x in enumerate(re.findall(r"ID: `(\d+)`", prompt)) if i != 1]
        answers.append("```json\n" + json.dumps([{"concept_id": x, "match_score": int(x) % 100 / 100, "justification": f"for {x}"} for x in ids]) + "\n```")
    return answers


@query("""WITH p AS (SELECT p_brand AS column_name, CAST(p_partkey AS VARCHAR) AS id, p_retailprice / 10000 AS score FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY score DESC, id) AS place FROM p),
s AS (SELECT *, CASE WHEN place IN (1, 3) THEN CAST(id AS BIGINT) % 100 / 100.0 END AS told FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY CAST(place > 3 AS INT), CASE WHEN place <= 3 THEN -coalesce(told, 0) END, place) AS o, coalesce(told, score) AS r FROM s)
SELECT column_name, id, round(r, 6) AS rerank_score, CASE WHEN told IS NOT NULL THEN 'for ' || id END AS justification, CAST(row_number() OVER (PARTITION BY column_name ORDER BY r DESC, o) AS INT) AS rank FROM o""")
def rerank_listwise(spark, sf_dir):
    """Parts as candidates of their brands; the three best of each brand are judged in one question."""
    parts = t(spark, sf_dir, "part")
    columns = parts.groupBy(F.col("p_brand").alias("column_name")).agg(F.lit("string").alias("data_type"), F.array(F.min("p_type")).alias("samples"))
    candidates = parts.select(F.col("p_brand").alias("column_name"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("display_name"), F.col("p_type").alias("definition"), F.array("p_name").alias("aliases"), (F.col("p_retailprice") / 10000).alias("score"))
    return r6(reasoning.rerank_listwise(columns, candidates, _by_size).select("column_name", "id", "rerank_score", "justification", "rank"), "rerank_score")


# retrieval and evaluation

@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM documents WHERE trim(coalesce(text, '')) <> '')
SELECT count(*) AS documents, round(avg(len(t)), 6) AS avg_doc_length, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM d)) AS vocabulary FROM d WHERE len(t) > 0""")
def bm25_stats(spark, sf_dir):
    return r6(retrieval.index_statistics(t(spark, sf_dir, "documents")), "avg_doc_length")


from lodestone.plans.queries import _BM25  # noqa: E402

_GRADED = f"""{_BM25}, {_REL}, j AS (SELECT r.query_id, rank, greatest(coalesce(relevance, 0), 0) AS rel FROM ranked r LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 100),
h AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j),
m AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (power(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 AND rel > 0 THEN 1 ELSE 0 END) AS found, min(CASE WHEN rel > 0 THEN rank END) AS first, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS precisions FROM h GROUP BY query_id),
n AS (SELECT query_id, sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN i <= 10 THEN (power(2, greatest(relevance, 0)) - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS i FROM qr) GROUP BY query_id),
g AS (SELECT query_id, coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0) AS ndcg, coalesce(found / 10, 0) AS precision, coalesce(CASE WHEN relevant > 0 THEN found / relevant END, 0) AS recall, coalesce(1 / first, 0) AS rr, coalesce(CASE WHEN relevant > 0 THEN precisions / relevant END, 0) AS ap FROM n LEFT JOIN m USING (query_id))"""


@query(f"WITH {_GRADED} SELECT query_id, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ap, 6) AS ap FROM g")
def eval_graded(spark, sf_dir):
    return r6(evaluation.ranking_metrics(_bm25(spark, sf_dir, 100), _qrels(spark, sf_dir), 10, graded=True), "ndcg", "precision", "recall", "rr", "ap")


@query(f"WITH {_GRADED} SELECT 'bm25' AS experiment, 10 AS k, count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(ap), 4) AS map FROM g".replace("rank <= 100", "rank <= 50"))
def eval_experiment(spark, sf_dir):
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return evaluation.comparison({"bm25": evaluation.run_experiment(t(spark, sf_dir, "documents").select("doc_id", "text"), asked, _qrels(spark, sf_dir), (10,), graded=True)})


_METHODS = {"original": (["title", "description"], None), "title_only": (["title"], None), "described": (["title", "ufd"], "short")}
_AT = (1, 5, 10, 20)
_MATRIX = f"""{_REL}, x AS (SELECT doc_id, source || ' ' || lang AS title, text, 'a text in ' || lang || ' from ' || source AS ufd FROM documents),
e AS (SELECT 'original' AS experiment, doc_id, concat_ws(' ', nullif(title, ''), nullif(text, '')) AS text FROM x UNION ALL SELECT 'title_only', doc_id, title FROM x UNION ALL SELECT 'described', doc_id, concat_ws(' ', title, ufd) FROM x),
d AS (SELECT experiment, doc_id, {_SPLIT} AS toks FROM e WHERE trim(text) <> ''), p AS (SELECT experiment, doc_id, len(toks) AS dl, unnest(toks) AS term FROM d), tf AS (SELECT experiment, doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT experiment, count(*) AS n, avg(len(toks)) AS avgdl FROM d WHERE len(toks) > 0 GROUP BY experiment), df AS (SELECT experiment, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_SPLIT}) AS term FROM benchmark WHERE item_id IN (SELECT query_id FROM qr)) GROUP BY ALL),
sc AS (SELECT experiment, query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM tf JOIN q USING (term) JOIN df USING (experiment, term) JOIN s USING (experiment) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0),
j AS (SELECT experiment, r.query_id, rank, CASE WHEN coalesce(relevance, 0) > 0 THEN 1 ELSE 0 END AS rel FROM r LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 100),
h AS (SELECT *, sum(rel) OVER (PARTITION BY experiment, query_id ORDER BY rank) AS hits, row_number() OVER (PARTITION BY experiment, query_id ORDER BY rel DESC) AS ideal FROM j),
ks AS (SELECT unnest([1, 5, 10, 20]) AS k),
m AS (SELECT experiment, query_id, k, sum(CASE WHEN rank <= k THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= k THEN rel / log2(ideal + 1) ELSE 0 END) AS idcg, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS found, min(CASE WHEN rel > 0 THEN rank END) AS first, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS precisions FROM h, ks GROUP BY ALL),
n AS (SELECT query_id, sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS relevant FROM qr GROUP BY query_id),
g AS (SELECT s.experiment, ks.k, s.n AS documents, coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0) AS ndcg, coalesce(found / ks.k, 0) AS precision, coalesce(CASE WHEN relevant > 0 THEN found / relevant END, 0) AS recall, coalesce(1 / first, 0) AS rr, coalesce(CASE WHEN relevant > 0 THEN precisions / relevant END, 0) AS ap
  FROM n CROSS JOIN s CROSS JOIN ks LEFT JOIN m ON m.query_id = n.query_id AND m.experiment = s.experiment AND m.k = ks.k),
x2 AS (SELECT experiment, k, count(*) AS queries, max(documents) AS documents, avg(ndcg) AS ndcg, avg(precision) AS precision, avg(recall) AS recall, avg(rr) AS mrr, avg(ap) AS map FROM g GROUP BY experiment, k)"""


def _matrix(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    datasets = d.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("description"))
    short = d.select(F.col("doc_id").alias("id"), F.lit("short").alias("method"), F.concat(F.lit("a text in "), "lang", F.lit(" from "), "source").alias("ufd"), F.lit("").alias("sfd"))
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    documents = evaluation.experiment_documents(datasets, _METHODS, short)
    return evaluation.run_matrix(documents, asked, _qrels(spark, sf_dir), list(_METHODS), scratch_path(spark, "experiments"), _AT)


@query(f"WITH {_MATRIX} SELECT experiment, k, queries, documents, round(ndcg, 6) AS ndcg, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(map, 6) AS map FROM x2")
def eval_matrix(spark, sf_dir):
    """Three methods at four cut-offs over one index."""
    return r6(_matrix(spark, sf_dir), "ndcg", "precision", "recall", "mrr", "map")


@query(f"WITH {_MATRIX} SELECT experiment AS method, max(queries) AS num_queries, {', '.join(f'round_even(max(CASE WHEN k = {k} THEN ndcg END), 4) AS ndcg_{k}' for k in (1, 5, 10, 20))}, round_even(max(map), 4) AS map, round_even(max(mrr), 4) AS mrr, FALSE AS is_reference FROM x2 GROUP BY experiment UNION ALL SELECT 'cited', 32, NULL, NULL, NULL, 0.725, NULL, NULL, TRUE")
def eval_comparison(spark, sf_dir):
    """The matrix as a table of methods, beside a value cited from elsewhere."""
    cited = spark.createDataFrame([("cited", 32, 0.725)], "method string, num_queries long, ndcg_20 double")
    return evaluation.comparison_table(_matrix(spark, sf_dir), _AT, cited)


@query(f"WITH {_REL}, c AS (SELECT relevance, count(*) AS n FROM qr GROUP BY 1) SELECT CAST(l AS INT) AS relevance, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2]) AS l) LEFT JOIN c ON relevance = l")
def bench_relevance_distribution(spark, sf_dir):
    return evaluation.relevance_distribution(_qrels(spark, sf_dir))


@query("SELECT d.doc_id, n_chars FROM documents d WHERE doc_id IN (SELECT l.doc_id FROM labels l JOIN benchmark i ON l.doc_id % 40 = i.item_id)")
def bench_judged_only(spark, sf_dir):
    return evaluation.judged_only(t(spark, sf_dir, "documents").select("doc_id", "n_chars"), _qrels(spark, sf_dir))


@query("WITH d AS (SELECT page_id, 'page ' || page_id AS title, [CASE page_id % 3 WHEN 0 THEN ' CSV' WHEN 1 THEN 'json' ELSE 'xml' END, 'txt'] AS f FROM pages) SELECT page_id AS doc_id, title FROM d WHERE len(list_filter(f, lambda x: lower(trim(x)) = 'csv')) > 0")
def bench_csv_only(spark, sf_dir):
    k = F.col("page_id")
    kind = lambda c: F.struct(c.alias("data_format"))
    d = t(spark, sf_dir, "pages").select(k.alias("doc_id"), F.concat(F.lit("page "), k.cast("string")).alias("title"), F.array(kind(F.when(k % 3 == 0, " CSV").when(k % 3 == 1, "json").otherwise("xml")), kind(F.lit("txt"))).alias("data"))
    kept, _ = evaluation.with_format(d, d.select(F.lit("q").alias("query_id"), "doc_id", F.lit(1).alias("relevance")))
    return kept.select("doc_id", "title")


@query("SELECT page_id AS id, concat_ws(' ', nullif(trim(url), ''), nullif(trim(html), '')) AS text FROM pages")
def bench_index_text(spark, sf_dir):
    from lodestone.sources.benchmarks import index_text

    d = t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("").alias("title"), F.col("url").alias("name"), F.col("html").alias("description"))
    return index_text(d, [["title", "name"], ["description", "notes"]])


@query("SELECT count(*) AS n, CAST(round(avg(l_discount), 6) AS DOUBLE) AS mean_a, round(avg(l_tax), 6) AS mean_b, round(avg(l_tax) - avg(l_discount), 6) AS mean_diff, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS statistic, abs(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*)))) > 1.96 AS significant_005 FROM lineitem")
def eval_significance(spark, sf_dir):
    found = evaluation.significance(t(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "ttest")
    return r6(found.select("n", "mean_a", "mean_b", "mean_diff", F.round("statistic", 4).alias("statistic"), "significant_005"), "mean_a", "mean_b", "mean_diff")


_VECTOR_RUN = "v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v)"


@query(f"""WITH {_VECTOR_RUN}, o AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 9) DESC, b.vec_id) AS rank FROM (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) a, LATERAL (SELECT vec_id, list_cosine_similarity(CAST(embedding[1:16] AS DOUBLE[]), a.e) AS s FROM embeddings) b),
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM r WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM o WHERE rank <= 50), g AS (SELECT query_id, doc_id, CAST(sum(s) AS DOUBLE) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM g) WHERE rank <= 10""")
def rrf_hybrid(spark, sf_dir):
    """Two retrievers over the same vectors: whole ones, and their first 16 dimensions."""
    e = t(spark, sf_dir, "embeddings")
    runs = []
    for c in (F.col("embedding"), F.slice("embedding", 1, 16)):
        runs.append(retrieval.dense(e.select(F.col("vec_id").alias("doc_id"), c.alias("vector")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), c.alias("vector")), 50))
    return r6(retrieval.fuse_ranks([(runs[0], 1.0), (runs[1], 0.5)]), "score")


@query(f"""WITH {_BM25}, v AS (SELECT i.item_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b),
w AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM v),
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM ranked WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM w WHERE rank <= 50), g AS (SELECT query_id, doc_id, CAST(sum(s) AS DOUBLE) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM g) WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    """BM25 over the documents' texts and dense search over the vectors of the same ids, fused by rank; an item's vector is the one of its id."""
    e, items = t(spark, sf_dir, "embeddings"), t(spark, sf_dir, "benchmark")
    asked = items.join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = retrieval.dense(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), asked, 50)
    return r6(retrieval.fuse_ranks([(_bm25(spark, sf_dir, 50), 1.0), (near, 0.5)]), "score")


# text, prompts, generation, caches

_COMPLETE = "(CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT)) / 2"


@query(f"""WITH c AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '\\S+')) AS w, len(regexp_extract_all(text, '[^.!?\\s][^.!?]*')) AS s, len(regexp_extract_all(text, '[^\\s.!?]+')) AS i, len(list_distinct(regexp_extract_all(lower(text), '\\S+'))) AS d, len(regexp_extract_all(text, '[.!?]+')) + 1 AS raw FROM conversations),
q AS (SELECT *, CASE WHEN w > 0 AND s > 0 THEN greatest(0.0, least(1.0, (206.835 - 1.015 * (w / s) - 84.6 * (floor(w * 1.5) / w)) / 100)) ELSE 0 END AS readability, CASE WHEN w > 0 AND s > 0 THEN least(1.0, (CASE WHEN i / s BETWEEN 15 AND 25 THEN 1.0 ELSE 0.8 END + d / w) / 2) ELSE 0 END AS fluency, CASE WHEN coalesce(length(text), 0) > 0 THEN {_COMPLETE} ELSE 0 END AS completeness FROM c)
SELECT conv_id, turn, coalesce(w, 0) AS n_words, coalesce(raw, 1) AS n_sentences, CAST(round(completeness, 6) AS DOUBLE) AS completeness, CAST(round((readability + fluency + completeness) / 3, 6) AS DOUBLE) AS overall FROM q""")
def quality_overall(spark, sf_dir):
    scored = text.with_quality(t(spark, sf_dir, "conversations"), expected=["the", "und"])
    return r6(scored.select("conv_id", "turn", F.col("n_words").cast("long").alias("n_words"), F.col("n_sentences").cast("long").alias("n_sentences"), "completeness", "overall"), "completeness", "overall")


_MATCHED = """m AS (SELECT 'col' || page_id AS column_name, CASE page_id % 6 WHEN 0 THEN 'no_match' WHEN 1 THEN 'uncertain' ELSE 'matched' END AS status, 'Concept ' || page_id AS display_name, page_id % 100 / 100 AS score, CASE page_id % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'RELATED' ELSE 'CONTEXTUAL' END AS strength, page_id % 11 <> 0 AS should_inject, html AS description FROM pages)"""


@query(f"""WITH {_MATCHED}, k AS (SELECT *, NOT (status = 'no_match' OR NOT should_inject OR status = 'uncertain') AS ok, CASE strength WHEN 'EXACT' THEN 300 WHEN 'RELATED' THEN 150 END AS n FROM m)
SELECT column_name, CASE WHEN ok THEN display_name END AS concept, CASE WHEN ok THEN strength END AS strength, CASE WHEN ok THEN nullif(CASE WHEN n IS NULL THEN NULL WHEN length(description) > n THEN substr(description, 1, n) || '...' ELSE description END, '') END AS description FROM k""")
def prompt_compress(spark, sf_dir):
    k = F.col("page_id")
    m = t(spark, sf_dir, "pages").select(
        F.concat(F.lit("col"), k.cast("string")).alias("column_name"), F.when(k % 6 == 0, "no_match").when(k % 6 == 1, "uncertain").otherwise("matched").alias("status"), F.concat(F.lit("Concept "), k.cast("string")).alias("display_name"),
        (k % 100 / 100).alias("score"), F.when(k % 4 == 0, "EXACT").when(k % 4 == 1, "RELATED").otherwise("CONTEXTUAL").alias("strength"), F.lit(None).cast("string").alias("tier"), (k % 11 != 0).alias("should_inject"), F.col("html").alias("description"), F.array(F.lit("a")).alias("aliases"),
    )
    return prompts.compressed_matches(m).select("column_name", "knowledge_graph.concept", "knowledge_graph.strength", "knowledge_graph.description")


@query("""WITH a AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Sure! ```json' || chr(10) || props || chr(10) || '``` done' WHEN 1 THEN 'text ' || props || ' more' WHEN 2 THEN '```' || props || '```' ELSE 'nothing here' END AS answer, props FROM events) SELECT id, CASE WHEN id % 4 < 3 THEN props END AS json FROM a""")
def json_extract(spark, sf_dir):
    k, p = F.col("event_id"), F.col("props")
    answer = F.when(k % 4 == 0, F.concat(F.lit("Sure! ```json\n"), p, F.lit("\n``` done"))).when(k % 4 == 1, F.concat(F.lit("text "), p, F.lit(" more"))).when(k % 4 == 2, F.concat(F.lit("```"), p, F.lit("```"))).otherwise("nothing here")
    return t(spark, sf_dir, "events").select(k.alias("id"), prompts.extracted_json(answer).alias("json"))


_HINTED = case([("len(list_intersect(w, " + str(list(prompts.NUMBER_WORDS)) + ")) > 0", "'float64'"), ("len(list_intersect(w, " + str(list(prompts.TIME_WORDS)) + ")) > 0", "'datetime'")], "'string'")


@query(f"WITH {_COLUMNS}, s AS (SELECT column_name, string_split(translate(lower(column_name), '_-', '  '), ' ') AS w FROM c) SELECT column_name, {_HINTED} AS type FROM s")
def prompt_type_hint(spark, sf_dir):
    return all_columns(spark, sf_dir).select("column_name", prompts.type_hint(F.col("column_name")).alias("type"))


@query(f"""WITH {_COLUMNS}, d AS (SELECT dataset, count(*) AS n, string_agg(column_name, ', ' ORDER BY place) AS names FROM c GROUP BY dataset) SELECT dataset, upper(substr(dataset, 1, 1)) || substr(dataset, 2) AS title, upper(substr(dataset, 1, 1)) || substr(dataset, 2) || ' holds ' || n || ' columns: ' || names || '.' AS description FROM d""")
def ufd_template(spark, sf_dir):
    c = all_columns(spark, sf_dir).select("dataset", "place", "column_name", F.col("data_type").alias("domain"))
    return generation.user_descriptions(c).drop("tags")


_CALLS = "e AS (SELECT md5(concat_ws(chr(31), event_type, CAST(user_id % 50 AS VARCHAR))) AS key, props AS value, ts FROM events)"


@query(f"WITH {_CALLS}, k AS (SELECT key, max(ts) AS ts FROM e GROUP BY key) SELECT key, ts FROM k WHERE epoch(ts) >= epoch(TIMESTAMP '2024-02-01 00:00:00') - 168 * 3600")
def cache_ttl(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(rules.cache_key(F.col("event_type"), (F.col("user_id") % 50).cast("string")).alias("key"), F.col("props").alias("value"), "ts")
    return rules.unexpired(rules.put(e.limit(0), e), F.lit("2024-02-01 00:00:00").cast("timestamp"), 168).select("key", "ts")


@query("WITH c AS (SELECT quantile_disc(ts, 0.2) AS q FROM events) SELECT event_id AS key FROM events, c WHERE ts > q")
def cache_evict(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("props").alias("value"), "ts")
    return rules.evicted(e, 1000).select("key")


@query("SELECT event_type AS cache, count(*) FILTER (event_id % 4 = 0) AS hits, count(*) FILTER (event_id % 4 <> 0) AS misses, round(count(*) FILTER (event_id % 4 = 0) / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def cache_stats(spark, sf_dir):
    return r6(rules.cache_statistics(t(spark, sf_dir, "events").select(F.col("event_type").alias("cache"), (F.col("event_id") % 4 == 0).alias("hit"))), "hit_rate")


@query("WITH c AS (SELECT o_orderstatus AS v FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE 'y' END FROM orders WHERE false) SELECT 'flag' AS column_name, 'y' AS value, round(avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END), 6) AS share FROM orders HAVING avg(CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END) > 0.8")
def profile_default(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise("y").alias("flag"))
    return r6(profile.default_values(o, ["o_orderstatus", "flag"]), "share")


@query(f"""WITH s AS (SELECT 'p_brand' AS column_name, row_number() OVER (ORDER BY k) AS place, v AS value FROM (SELECT DISTINCT p_brand AS v, md5('7:' || p_brand) AS k FROM part WHERE p_brand IS NOT NULL ORDER BY k LIMIT 10)
UNION ALL SELECT 'o_orderstatus', row_number() OVER (ORDER BY k), v FROM (SELECT DISTINCT o_orderstatus || 'X' AS v, md5('7:' || o_orderstatus || 'X') AS k FROM orders WHERE o_orderstatus IS NOT NULL ORDER BY k LIMIT 10))
SELECT column_name, round(avg(CASE WHEN length(value) BETWEEN 2 AND 6 AND NOT contains(value, ' ') AND ((regexp_matches(value, '[A-Z]') AND upper(value) = value) OR (regexp_matches(value, '[a-z]') AND lower(value) = value) OR regexp_matches(value, '^[0-9]+$')) AND place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS code_share FROM s GROUP BY column_name""")
def rule_code_share(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.concat("o_orderstatus", F.lit("X")).alias("o_orderstatus"))
    return r6(details.code_shares(details.sample_values(t(spark, sf_dir, "part"), ["p_brand"]).union(details.sample_values(o, ["o_orderstatus"]))), "code_share")


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), n AS (SELECT 'column ' || q.vec_id AS column_name, CAST(e.vec_id AS VARCHAR) AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS s, e.vec_id AS k FROM q, embeddings e WHERE e.vec_id % 50 <> 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY round(s, 9) DESC, k) AS r FROM n) WHERE r = 1) SELECT column_name, CASE WHEN s >= 0.5 THEN id END AS concept_id, CASE WHEN s >= 0.5 THEN 'semantic' ELSE 'no_match' END AS method, round(CASE WHEN s >= 0.5 THEN s ELSE 0.0 END, 6) AS score FROM b""")
def match_semantic(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    columns = e.where("vec_id % 50 = 0").select(F.concat(F.lit("column "), F.col("vec_id").cast("string")).alias("column_name"), F.col("embedding").alias("vector"))
    names = spark.createDataFrame([], "id string, display_name string")
    found = concepts.match_columns(columns, names, spark.createDataFrame([], "alias_text string, concept_id string"), vectors=e.where("vec_id % 50 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), threshold=0.5)
    return r6(found, "score")


@query("""SELECT * FROM (VALUES ('o_orderkey', 'no_match', NULL), ('o_custkey', 'no_match', NULL), ('o_orderstatus', 'matched', 'Order status'), ('o_totalprice', 'matched', 'O Totalprice'), ('o_orderdate', 'no_match', NULL), ('o_orderpriority', 'no_match', NULL)) v(column_name, status, concept)""")
def describe_table(spark, sf_dir):
    known = spark.createDataFrame([("status", "Order status", "State of an order"), ("total", "O Totalprice", "Sum of an order")], "id string, display_name string, definition string")
    aliases = spark.createDataFrame([("o_orderstatus", "status"), ("o_totalprice", "total")], "alias_text string, concept_id string")
    found = describe.describe(t(spark, sf_dir, "orders"), "orders", ["o_orderkey"], known, aliases)
    return found.matches.select("column_name", "status", F.col("display_name").alias("concept"))


_CONCEPT_TOKENS = "regexp_extract_all(lower(translate(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-', '  ')), '\\w+')"


@query(f"""WITH c AS (SELECT p_partkey AS doc_id, replace(p_name, ' ', '_') || ' ' || p_brand || 'Type' || p_type AS text FROM part), d AS (SELECT doc_id, {_CONCEPT_TOKENS} AS t FROM c), q AS (SELECT s_suppkey AS query_id, unnest(['small', 'Type', 'ring', 'ring']) AS term FROM supplier WHERE s_suppkey % 10 = 0),
k AS (SELECT query_id, lower(term) AS term, count(*) AS qtf FROM q GROUP BY ALL), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM tf JOIN k USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0.01) WHERE rank <= 5""")
def bm25_concepts(spark, sf_dir):
    """Names in snake and camel case, with the tokens of concepts."""
    docs = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.translate("p_name", " ", "_"), F.lit(" "), "p_brand", F.lit("Type"), "p_type").alias("text"))
    asked = t(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("query_id"), F.lit("small Type ring_ring").alias("text"))
    return r6(retrieval.bm25(docs, asked, 5, tokens=text.concept_tokens, least=0.01), "score")


@query("""SELECT event_id AS id, event_id % 4 < 2 AS valid, CASE event_id % 4 WHEN 2 THEN 'UFD missing title' WHEN 3 THEN 'semantic_profiles count mismatch' ELSE '' END AS problems FROM events""")
def json_validate(spark, sf_dir):
    k = F.col("event_id")
    title = F.when(k % 4 == 2, "").otherwise("t")
    body = F.concat(F.lit('{"semantic_profiles": {"c": '), "props", F.lit('}, "ufd": {"title": "'), title, F.lit('", "core_description": {"text": "x"}}, "sfd": {"summary": "s", "schema_metadata": [1]}'))
    answer = F.when(k % 4 == 1, F.concat(F.lit("Here it is: "), body)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("}\n```")))  # the former lacks its last brace
    a = t(spark, sf_dir, "events").select(k.alias("id"), answer.alias("answer"), F.when(k % 4 == 3, 2).otherwise(1).alias("expected_columns"))
    return prompts.validated(a).select("id", "valid", F.array_join("problems", "; ").alias("problems"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_type, CAST(p_size AS VARCHAR) AS s FROM part) SELECT p_partkey AS id, '### Summary' || chr(10) || p_name || chr(10) || chr(10) || '### Domain Tags' || chr(10) || '`' || p_type || '`' || chr(10) || chr(10) || '### Keywords' || chr(10) || '**Core**: ' || p_name || chr(10) || chr(10) || '**Synonyms**: ' || chr(10) || chr(10) || '**Related**: a, b' || chr(10) || chr(10) ||
'### Schema Metadata' || chr(10) || '| Column | Concept | Type | Conf. | Description |' || chr(10) || '|--------|---------|------|-------|-------------|' || chr(10) || '| p_size | Size | count | 0.8 | ' || s || ' |' || chr(10) AS markdown FROM p""")
def sfd_markdown(spark, sf_dir):
    column = F.struct(F.lit("p_size").alias("column_name"), F.lit("Size").alias("concept_name"), F.lit("count").alias("semantic_type"), F.lit(0.8).alias("confidence"), F.col("p_size").cast("string").alias("description"))
    d = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("summary"), F.array("p_type").alias("tags"), F.array("p_name").alias("core"), F.array().cast("array<string>").alias("synonyms"), F.array(F.lit("a"), F.lit("b")).alias("related"), F.array(column).alias("columns"))
    return prompts.markdown(d)
