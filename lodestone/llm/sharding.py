"""Proportional stratified interleaving: shards that all match the mixture of sources, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import buckets_for, cut, hash_bucket, ordered_hash


def _numbered(df: DataFrame, groups: list[str], range_column: str, order: list[Column], name: str) -> DataFrame:
    """df with ``number``, the row's number from 1 in each group by (range, order): a number inside its range plus the rows of ranges before.

    Ranges hold a bounded share of the rows whatever the groups, so no task sorts a whole group.
    """
    counts = df.groupBy(*groups, range_column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(w.orderBy(range_column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumns({"rows_before": before, "rows_in_group": F.sum("n").over(w)})
    starts = cut(starts.select(*[F.col(c).alias(f"s_{c}") for c in [*groups, range_column]], "rows_before", "rows_in_group"), name)
    inside = F.row_number().over(Window.partitionBy(*groups, range_column).orderBy(*order))
    match = F.lit(True)
    for c in [*groups, range_column]:
        match = match & F.col(c).eqNullSafe(F.col(f"s_{c}")) if c in groups else match & (F.col(c) == F.col(f"s_{c}"))
    numbered = df.withColumn("inside", inside).join(starts, match)
    return numbered.withColumn("number", F.col("rows_before") + F.col("inside")).drop("inside", "rows_before", *[f"s_{c}" for c in [*groups, range_column]])


def shard(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """A row for each input row: doc_id, source, size, text_crc32, shard, slot.

    Rows are ranked within their source in the order of a seeded hash of doc_id (ties: doc_id, size, checksum); row r
    of c gets the fraction (2r - 1) / 2c. All rows are put in the order of the fraction (ties: source, null last, then
    the hash and so on) and row i of N, from 0, goes to shard i * shards div N. So shards differ by at most one row, and
    any stretch of the order, thus each shard, holds each source in proportion. ``slot`` counts a shard's rows from 0.
    size: UTF-8 bytes of the text plus 1 (null: 1). text_crc32: of the text's UTF-8 (null: 0). Repeated rows are
    placed each, also those that repeat a doc_id or have none; a null source is a source of its own; an empty table gives no rows.
    Equal texts are rows like any other: the mixture of each shard needs them dealt like the rest, so a group of equal texts, which
    may be a third of all rows, is spread over the shards.
    """
    rows = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), ordered_hash("doc_id", seed).alias("key"),
    )
    rows = cut(rows, "shard")
    total = rows.count()
    buckets = min(buckets_for(total), 16384)  # the sum over all ranges is one task's work
    ties = [F.col(c) for c in ("key", "doc_id", "size", "text_crc32")]
    ranked = _numbered(rows.withColumn("range", hash_bucket(F.col("key"), buckets)), ["source"], "range", ties, "shard-ranks")
    fraction = (2 * F.col("number") - 1).cast("double") / (2 * F.col("rows_in_group")).cast("double")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "key", fraction.alias("fraction"))
    ranked = cut(ranked.withColumn("stretch", F.floor(F.col("fraction") * buckets).cast("long")), "shard-fractions")
    placed = _numbered(ranked, [], "stretch", [F.col("fraction"), F.col("source").asc_nulls_last(), *ties], "shard-stretches")
    index = F.col("number") - 1
    placed = placed.withColumns({"shard": F.expr(f"(number - 1) * {shards} div {max(total, 1)}")})
    # the first row of shard s is the least i with i * shards >= s * N
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (index - first).cast("long").alias("slot"))
