"""Mixing sources to target weights: hash-random order, distributed prefix sums, cuts at exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import buckets_for, cut, free_names, hash_bucket, ordered_hash, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets per source from a table (source, source_size): ``share`` of all sizes, dealt by weight.

    Weights repeat over the sources in code-point order, null last. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above. In closed form: with sources in the order of
    cap / weight, those before the first whose cap is not below the level left to it are at their cap.
    The table has a row for each source, so its windows over all rows stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.element_at(deal, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("level", (F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))) / F.sum("weight").over(onward))
    t = t.withColumn("at_cap", F.col("cap") / F.col("weight") < F.col("level"))
    level = F.min(F.when(~F.col("at_cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    t = t.withColumn("free_level", level)
    target = F.when(F.col("at_cap") | F.col("free_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free_level") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, size: Column | None = None, whole_documents: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """What a mix takes of each document: doc_id, source, size, source_size, target, taken, and the columns named in ``carry``.

    Documents of a source are in the order of a seeded hash of doc_id (ties: doc_id, size, then the carried columns). With a budget B, its
    target rounded, and S its size, each is taken B div S times whole; then the order is walked and the first B mod S
    words are taken again, so the sums are exact. The document at the cut gives part of its words; with
    ``whole_documents`` it is taken whole if at least half of it lies before the cut.

    ``size``: words of the text by default (null: 0). Documents of size 0 are taken 0 times; a null source is a
    source of its own, last in order. Repeated rows, and rows that repeat a doc_id or have none, count each; reruns agree. An
    empty table gives no rows.
    Ranges of the hash, uniform whatever the source, take the place of sampled range partitions: a source with a third
    of all rows is spread over all of them, and only a sum for each source and range is gathered.
    """
    rows = docs.select("doc_id", "source", *carry, (word_count() if size is None else size).cast("long").alias("size"), ordered_hash("doc_id", seed).alias("key"))
    rows = cut(rows, "mix")
    rows = rows.withColumn("range", hash_bucket(F.col("key"), buckets_for(rows.count())))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most).withColumnRenamed("source", "t")
    starts = sums.join(targets, F.col("source").eqNullSafe(F.col("t"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "before", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside")
    part = F.when(F.col("left") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole_documents else F.greatest(F.lit(0), F.least("size", "left"))
    return (
        placed.withColumns({"budget": budget, "epochs": epochs})
        .withColumn("left", left)
        .select("doc_id", "source", *carry, "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, as often as a mix of whole documents takes them.

    A row is known by a hash of all its columns, so rows without doc_id, or that repeat one, keep their own counts, and rows of one
    doc_id and size have an order.
    """
    row, key, mark, copy, times = free_names(docs, "row", "id", "mark", "copy", "times")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    taken = mix(keyed.select("doc_id", "source", "text", F.col(row).alias("_row")), weights, share, most, seed, whole_documents=True, carry=["_row"])
    often = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    counts = taken.select(F.col("_row").alias(mark), F.col("doc_id").alias(key), often.alias(times)).groupBy(mark, key).agg(F.sum(times).alias(times), F.count(F.lit(1)).alias("rows"))
    counts = cut(counts.where(F.col(times) > 0), "mix-times")
    same = (F.col(row) == F.col(mark)) & docs["doc_id"].eqNullSafe(F.col(key))
    once = keyed.join(counts.where("rows = 1").drop("rows"), same)
    if counts.where("rows > 1").limit(1).count():  # rows alike in all columns: one stands for all
        again = keyed.join(counts.where("rows > 1").drop("rows"), same)
        once = once.unionByName(again.dropDuplicates([row, key]))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
