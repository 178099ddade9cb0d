"""Profiles of tables of files, kept as a state for each file and column, so that only files not seen before are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.sketches import column_states, merge_states, profile_of_states

_KEY = "{}_metadata.file_path, _metadata.file_size, unix_micros(_metadata.file_modification_time))"
_KEYS = [_KEY.format("xxhash64(") + " AS _a", _KEY.format("xxhash64(1, ") + " AS _b"]
_FILE = "sha2(concat_ws('|', _metadata.file_path, _metadata.file_size, unix_micros(_metadata.file_modification_time)), 256)"


class ProfileStore:
    """States of files below a folder, each under a fingerprint of the file's path, length and time of change.

    ``profile`` lists the files of a table, reads those whose fingerprint the store lacks, adds their states, and merges the states of all
    files the table has now; states of files that went or changed are left aside until ``vacuum``. States only ever are added in whole files,
    so a job that fails on the way is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _root(self):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _generations(self) -> list[str]:
        """Folders of states that were written whole."""
        fs, root = self._root()
        if not fs.exists(root):
            return []
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().toString() for s in fs.listStatus(root) if fs.exists(make(s.getPath(), "_SUCCESS")))

    def states(self) -> DataFrame | None:
        """All states: file, column_name and what ``merge_states`` takes; of a file written twice one."""
        found = self._generations()
        return self.spark.read.parquet(*found).dropDuplicates(["file", "column_name"]) if found else None

    def files(self, table: str) -> DataFrame:
        """file (fingerprint), path of the Parquet files that a table has now; their contents aren't read."""
        return self._listed(table).selectExpr(f"{_FILE} AS file", "path")

    def _listed(self, table: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table)

    def refresh(self, table: str) -> int:
        """Read the files of a table that the store lacks; gives their number. Their paths, no rows, pass through the driver."""
        files, states = self.files(table), self.states()
        new = files if states is None else files.join(states.select("file").distinct(), "file", "left_anti")
        paths = [r["path"] for r in new.select("path").collect()]
        if paths:
            schema = self.spark.read.parquet(table).schema
            # rows are grouped by two hashes of what the fingerprint is of, which cost less for each row
            rows = self.spark.read.schema(schema).parquet(*paths).selectExpr("*", *_KEYS)
            known = self._listed(table).selectExpr(f"{_FILE} AS file", *_KEYS)
            generation = len(self._generations())
            column_states(rows, by=["_a", "_b"]).join(known, ["_a", "_b"]).drop("_a", "_b").write.mode("overwrite").parquet(f"{self.path}/g{generation:06d}")
        return len(paths)

    def profile(self, table: str) -> DataFrame:
        """The profile of a table from the states of its files, after a ``refresh``."""
        self.refresh(table)
        states = self.states()
        return profile_of_states(merge_states(states.join(self.files(table).select("file"), "file", "left_semi").drop("file")))

    def vacuum(self, *tables: str) -> None:
        """Keep the states of files of these tables only, in one new folder."""
        states = self.states()
        if states is None:
            return
        kept = self.files(tables[0])
        for table in tables[1:]:
            kept = kept.union(self.files(table))
        old = self._generations()
        states.join(kept.select("file").distinct(), "file", "left_semi").write.mode("overwrite").parquet(f"{self.path}/g{len(old):06d}")
        fs, _ = self._root()
        for path in old:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
