"""A keyed table in hash buckets: an upsert rewrites the buckets it touches, and readers see one version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BucketTable:
    """Rows of a schema, one for each key, below a folder: ``data`` holds folders of buckets, ``versions`` small files that name each bucket's folder.

    A version is committed by creating its file, which fails if another writer made one of that number first; the upsert then
    runs again on the newer version. Folders are never changed, so a reader of an older version goes on reading it; ``vacuum`` deletes
    those that the last versions don't name. ``buckets`` is fixed when the table is born: a bucket should hold what a task can sort.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets = self._version()[1].get("buckets", buckets)

    def _fs(self):
        root = self._hadoop(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        fs, root = self._fs(), self._hadoop(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()) if fs.exists(root) else []

    def _version(self, number: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        if not known:
            return -1, {}
        number = known[-1] if number is None else number
        text = self.spark.read.text(f"{self.path}/versions/{number:08d}", wholetext=True).first()[0]
        return number, json.loads(text)

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of a version, the last by default."""
        folders = list(self._version(number)[1].get("folders", {}).values())
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _commit(self, number: int, folders: dict[str, str]) -> bool:
        fs = self._fs()
        target, made = self._hadoop(f"{self.path}/versions/{number:08d}"), self._hadoop(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(made, target):
            fs.delete(made, False)
            return False
        return True

    def _rewrite(self, touched: set[int], rows_of) -> set[int]:
        """Write the touched buckets anew from ``rows_of(their rows now)`` and commit; again if another writer came first."""
        while True:
            number, held = self._version()
            folders = held.get("folders", {})
            old = [folders[str(b)] for b in touched if str(b) in folders]
            now = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in old]) if old else self.spark.createDataFrame([], self.schema)
            run = uuid.uuid4().hex
            columns = now.columns
            rows_of(now).select(*columns).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{run}")
            made = {s.getPath().getName().split("=")[1]: f"{run}/{s.getPath().getName()}" for s in self._fs().listStatus(self._hadoop(f"{self.path}/data/{run}")) if "=" in s.getPath().getName()}
            kept = {b: f for b, f in folders.items() if int(b) not in touched}
            if self._commit(number + 1, kept | made):
                return touched

    def touched_by(self, keyed: DataFrame) -> set[int]:
        """The buckets that these keys fall in: as many as the table has at most."""
        return {r[0] for r in keyed.select(self._bucket().alias("b")).distinct().collect()}

    def upsert(self, new: DataFrame) -> set[int]:
        """Put in rows; of each key the one with the largest ``seq``, if there is such a column, replaces the one held. Gives the buckets rewritten."""
        seq = F.col("seq") if "seq" in new.columns else F.lit(0)
        order = Window.partitionBy(*self.keys).orderBy(F.desc("_new"), F.desc("_seq"))

        def merged(now: DataFrame) -> DataFrame:
            both = now.withColumns({"_new": F.lit(0), "_seq": F.lit(0).cast("long")}).unionByName(new.withColumns({"_new": F.lit(1), "_seq": seq.cast("long")}).drop("seq"))
            return both.withColumn("_n", F.row_number().over(order)).where("_n = 1")

        touched = self.touched_by(new)
        return self._rewrite(touched, merged) if touched else touched

    def delete(self, keys: DataFrame) -> set[int]:
        """Take out the rows of these keys. Gives the buckets rewritten."""
        touched = self.touched_by(keys)
        return self._rewrite(touched, lambda now: now.join(keys.select(*self.keys).distinct(), self.keys, "left_anti")) if touched else touched

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` versions, and the folders that these don't name; no reader may be on an older one."""
        known = self.versions()
        named = {f.split("/")[0] for n in known[-keep:] for f in self._version(n)[1]["folders"].values()}
        fs = self._fs()
        for n in known[:-keep]:
            fs.delete(self._hadoop(f"{self.path}/versions/{n:08d}"), False)
        for s in fs.listStatus(self._hadoop(f"{self.path}/data")):
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
