"""Streams: costs of calls, and figures of a growing table, by windows of event time. These go beyond batch use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rules import with_cost


def cost_by_window(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, component, calls, cost of a stream (or table) of calls with event time ``ts``."""
    w = with_cost(calls).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "component")
    return w.agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd")).select(F.col("w.start").alias("start"), "component", "calls", "cost_usd")


def profile_by_window(rows: DataFrame, column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, nulls, extremes and moments of one column in each window; all are merged from partial sums."""
    c = F.col(column).cast("double")
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).select(F.col("w.start").alias("start"), "n", "nulls", "min", "max", "mean", "std")
