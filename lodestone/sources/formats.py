"""Files of retrieval benchmarks as a Spark data source: ``spark.read.format("benchmark")`` reads them in byte ranges, one task each."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "topics": "query_id string, text string, at long",
    "qrels": "query_id string, doc_id string, relevance int, at long",
    "csv_qrels": "query_id string, doc_id string, relevance int, at long",
    "collection": "id string, title string, description string, data array<struct<data_format:string>>, at long",
}
TRUE_WORDS = {"true", "yes", "relevant"}


class Malformed(ValueError):
    """A line that isn't of its kind."""


def _topic(line: str) -> tuple:
    parts = line.split("\t", 1)
    if len(parts) < 2:
        raise Malformed(line)
    return parts[0].strip(), parts[1].strip()


def _judgment(line: str) -> tuple:
    parts = line.split()
    try:
        label = parts[-1]
        return parts[0], parts[1], int(label[1]) if label in ("L0", "L1", "L2") else int(label) if len(parts) > 2 else int("")
    except (ValueError, IndexError):
        raise Malformed(line) from None


def _csv_judgment(line: str) -> tuple:
    parts = [x.strip() for x in next(csv.reader([line]))]
    if len(parts) < 3 or not parts[2]:
        raise Malformed(line)
    return parts[0], parts[2], int(parts[1]) if parts[1].lstrip("+-").isdigit() else int(parts[1].lower() in TRUE_WORDS)


def _dataset(line: str) -> tuple:
    try:
        d = json.loads(line)
        name = next(str(d[k]) for k in ("id", "doc_id", "dataset_id", "_id") if d.get(k) not in (None, ""))
    except (ValueError, AttributeError, StopIteration):
        raise Malformed(line) from None
    first = lambda *keys: next((str(d[k]) for k in keys if d.get(k)), None)
    data = [{"data_format": x.get("data_format")} for x in d.get("data") or () if isinstance(x, dict)]
    return name, first("title", "name", "dataset_name"), first("description", "notes", "content", "text"), data


PARSERS = {"topics": _topic, "qrels": _judgment, "csv_qrels": _csv_judgment, "collection": _dataset}


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int, order: int):
        self.uri, self.start, self.end, self.order = uri, start, end, order


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.path, self.mode = options["kind"], options["path"], options.get("mode", "DROPMALFORMED").upper()
        self.size = int(options.get("splitbytes", 32 << 20))

    def partitions(self) -> list[_Range]:
        """Ranges of about ``splitBytes`` of each file; compressed files are one range each."""
        from pyarrow import fs

        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else sorted((x for x in system.get_file_info(fs.FileSelector(path)) if x.is_file), key=lambda x: x.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        out: list[_Range] = []
        for x in found:
            step = x.size if x.path.endswith((".bz2", ".gz")) else self.size
            out += [_Range(prefix + x.path, lo, min(lo + step, x.size), len(out)) for lo in range(0, x.size, max(1, step))]
        return out or [_Range(self.path, 0, 0, 0)]

    def _lines(self, part: _Range) -> Iterator[tuple[int, str]]:
        """Lines that begin in the range, each with its place in the file."""
        system, path = _filesystem(part.uri)
        if part.end <= part.start:
            return
        with io.BufferedReader(system.open_input_file(path), 1 << 20) as f:
            if path.endswith((".bz2", ".gz")):
                for at, line in enumerate((bz2 if path.endswith(".bz2") else gzip).open(f)):
                    yield at, line.decode("utf-8", "replace")
                return
            f.seek(max(0, part.start - 1))
            at = part.start
            if part.start:  # a line that began before belongs to the range before
                at = part.start - 1 + len(f.readline())
            while at < part.end and (line := f.readline()):
                yield at, line.decode("utf-8", "replace")
                at += len(line)

    def read(self, part: _Range) -> Iterator[tuple]:
        parse = PARSERS[self.kind]
        for at, line in self._lines(part):
            line = line.rstrip("\r\n")
            if not line.strip() or (self.kind == "csv_qrels" and at == 0):  # a header
                continue
            try:
                yield (*parse(line), part.order << 40 | at - (0 if "bz2" in part.uri else part.start))
            except Malformed:
                if self.mode == "FAILFAST":
                    raise


class BenchmarkSource(DataSource):
    """Options: ``kind`` (topics, qrels, csv_qrels or collection), ``mode`` (DROPMALFORMED leaves broken lines out, FAILFAST raises), ``splitBytes``.

    Column ``at`` orders lines as the files have them; where a key comes again, ``last_of`` keeps the last.
    """

    @classmethod
    def name(cls) -> str:
        return "benchmark"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BenchmarkSource)


def last_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the last in the files."""
    from pyspark.sql import functions as F

    others = [c for c in rows.columns if c not in (*keys, "at")]
    return rows.groupBy(*keys).agg(F.max(F.struct("at", *others)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])
