"""One query for each operator, with production parameters over its whole table, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import repair_sql
from lodestone.llm.shared import new_path, table

SHARDS = 16
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = (3, 1, 2), 1.5, 2.0


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.warc import round_trip

    records = round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, size=5)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.learned_partitions import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_dedup import drop_frequent_lines

    return drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, least=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ngram_quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_files import read_token_files, write_token_files

    out = new_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), out, end_id=0)
    return read_token_files(manifest, out)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.main_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.conversations import damage, repair, repair_report

    conversations = table(spark, sf_dir, "conversations")
    return repair_report(repair(damage(conversations)), conversations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_near_dedup": op2_near_dedup,
        "op3_mixing": op3_mixing,
        "op4_token_counts": op4_token_counts,
        "op5_learned_partitions": op5_learned_partitions,
        "op6_sharding": op6_sharding,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality": op8_quality,
        "op9_token_files": op9_token_files,
        "op10_decontamination": op10_decontamination,
        "op11_main_text": op11_main_text,
        "op12_divergence": op12_divergence,
        "op13_conversations": op13_conversations,
    }


_KEY = "md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))"

ORACLE_SQL = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS original FROM p GROUP BY h),
b AS (SELECT page_id, octet_length(payload) AS payload_bytes, original, h FROM p JOIN o USING (h)),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda j:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST(('0x' || substr(h, CAST(g * 5 + 1 AS INT), 5)) AS BIGINT) >> (15 - 5 * j)) & 31 AS INT) + 1]), '')), '') AS digest FROM b)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM d""",
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op3_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, {_KEY} AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT arg_min(level, cap / weight) AS free_level FROM l WHERE cap / weight >= level),
t AS (SELECT source, source_size, CASE WHEN cap / weight < level OR free_level IS NULL THEN cap ELSE least(cap, free_level * weight) END AS target FROM l CROSS JOIN f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken FROM p""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT key FROM (SELECT DISTINCT r, key FROM l WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(k.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k.key IS NULL), '') AS kept
  FROM l LEFT JOIN k ON l.key = k.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d USING (r)""",
    # Of the given pages, each of which has one article element of headings and paragraphs.
    "op11_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, count(o.term) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term GROUP BY ALL),
p AS (SELECT *, 1 + (1000000000 * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
l AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM l),
x AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(((s.p - t.p) * (s.p - t.p)) // t.p), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p s ON s.lang = a.lang AND s.source = a.source LEFT JOIN p t ON t.lang = b.lang AND t.source = b.source AND t.term = s.term GROUP BY ALL),
y AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM x UNION ALL SELECT lang, source, 'term' AS part, item, value FROM y),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM z)
SELECT lang, source, part, item, value, rank FROM f WHERE part = 'pair' OR rank <= 200""",
    "op13_conversations": repair_sql.SQL,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE_SQL.items() if k in queries()}
