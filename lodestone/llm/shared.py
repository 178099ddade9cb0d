"""Tables and files in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and Spark runs in one process, as in local
tests, a folder under the local temporary directory is used. What ``cut`` writes stays until ``remove`` or ``release``
is called; operators release the tables that their result doesn't read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; no two calls get the same."""
    return f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost executor costs no rerun."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def small(table: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table of a few short columns, marked for broadcast if it has ``most_rows`` at most; beyond that joins shuffle."""
    return F.broadcast(table) if table.count() <= most_rows else table


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote, once all that was made from them is written itself."""
    for table in tables:
        if table is not None and (path := getattr(table, "scratch_path", None)):
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder once nothing reads it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def uri_filesystem(uri: str):
    """The pyarrow filesystem and the path in it, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def ordered_hash(key: str, seed: int) -> Column:
    """A seeded hash of a column as 32 hex digits, null taken as the string 'null'; SQL engines give the same digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def hash_bucket(digits: Column, buckets: int) -> Column:
    """The range, of ``buckets`` (a power of two up to 65536) equal ranges of the hash, that ``digits`` falls in."""
    return F.floor(F.conv(F.substring(digits, 1, 4), 16, 10).cast("long") * F.lit(buckets) / F.lit(65536)).cast("long")


def buckets_for(rows: int, rows_per_bucket: int = 50_000, least: int = 256) -> int:
    """A power of two so that a uniform hash puts about ``rows_per_bucket`` rows in each range, at most 65536."""
    return min(65536, max(least, 1 << max(0, (max(rows, 1) // rows_per_bucket)).bit_length()))


def word_count(text: str = "text") -> Column:
    """Number of runs of bytes other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that ``df`` doesn't have, whatever the case: each given one behind as many underscores as that takes."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs run within send Python batches of ``rows`` rows at most; whole texts in Spark's 10,000 fill both the executor and its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def tidy(run):
    """A function on a task's batches that, when it has put out its last one, gives the memory it freed back to the system.

    Workers are used again by later tasks and stages; without this, each keeps the most it ever held.
    """

    def wrapped(batches):
        import ctypes
        import sys

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def keep_rows(docs: DataFrame, decider, rows: int = 1000) -> DataFrame:
    """The rows of ``docs``, with all columns as they are, for which ``decider()(record batch)`` gives true; it gets ``rows`` rows at a time at most."""

    def run(batches):
        import pyarrow as pa

        decide = decider()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                some = batch.slice(lo, rows)
                yield some.filter(pa.array(decide(some), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
