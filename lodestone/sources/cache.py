"""A cache of values by key, as a table of entries that is only appended to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import rules

ENTRY = "key string, value string, ts timestamp"


class TableCache:
    """Entries (key, value, ts) below a folder; of entries with one key the latest counts. Profiles, matches, metadata and answers go in as JSON."""

    def __init__(self, spark: SparkSession, path: str, hours: float = 168.0):
        self.spark, self.path, self.hours = spark, path, hours

    def _filesystem(self):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def entries(self, now: Column | None = None) -> DataFrame:
        """Entries that are not older than the cache keeps them."""
        fs, target = self._filesystem()
        rows = self.spark.read.schema(ENTRY).parquet(self.path) if fs.exists(target) else self.spark.createDataFrame([], ENTRY)
        return rules.unexpired(rules.put(rows.limit(0), rows), F.current_timestamp() if now is None else now, self.hours)

    def put(self, rows: DataFrame, ts: Column | None = None) -> None:
        """Add rows (key, value)."""
        rows.select("key", "value", (F.current_timestamp() if ts is None else ts).alias("ts")).write.mode("append").parquet(self.path)

    def lookup(self, wanted: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The rows of ``wanted`` (key, ...) with their cached value, and those that the cache lacks."""
        held = self.entries(now).select("key", "value")
        return wanted.join(held, "key"), wanted.join(held.select("key"), "key", "left_anti")

    def clear(self) -> None:
        fs, target = self._filesystem()
        fs.delete(target, True)
