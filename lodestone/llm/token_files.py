"""Token ids as flat binary files, with 64-bit document offsets, written and read by tasks.

Format. For each part: ``<name>.bin``, all ids one after the other as unsigned little-endian integers of 16 bits
(32 if the vocabulary needs it), and ``<name>.idx``, little-endian 64-bit integers: n, then n document ids with a
row of n flags for null ids, then n + 1 offsets, in ids, from the part's start. A manifest table lists the parts that
count, in the order of their documents, each with its base: the ids in all parts before. Documents are in ascending
order of doc_id, nulls first. A document's ids start at base + offset. Files of tasks that were run twice are not in
the manifest, so they are never read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.pretokens import PieceIds
from lodestone.llm.shared import uri_filesystem

_encoders: dict[tuple, PieceIds] = {}
WRITTEN = "task int, piece int, file string, width int, n_docs long, n_tokens long"


def _encoder(path: str, cache_entries: int) -> PieceIds:
    key = (path, cache_entries)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceIds(path, cache_entries)
    return _encoders[key]


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 0, parts: int | None = None, cache_entries: int = 500_000, part_tokens: int = 1 << 28, part_docs: int = 100_000) -> DataFrame:
    """Encode each text (null: empty), append ``end_id``, write the files below ``out`` and return the manifest.

    Rows are range-partitioned and sorted by (doc_id, hash of the text), so a doc_id that repeats does not gather in
    one task; all rows are kept. A part that exceeds ``part_tokens`` ids is followed by another of the same task. There are as
    many tasks as shuffle partitions, or as ``part_docs`` rows each need. An empty table gives an empty manifest.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // part_docs), 1)
    kind = "<u2" if width == 2 else "<u4"
    end = np.array([end_id], kind).tobytes()

    def write(batches):
        from pyspark import TaskContext

        fs, root = uri_filesystem(out)
        fs.create_dir(root, recursive=True)
        encoder, task = _encoder(path, cache_entries), TaskContext.get().partitionId()
        part, held, rows, file = 0, 0, [], None
        ids, nulls, lengths = [], [], []

        def close():
            file.close()
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<i8")]).astype("<i8")
            with fs.open_output_stream(f"{root}/{name}.idx") as idx:
                idx.write(b"".join([np.array([len(ids)], "<i8").tobytes(), np.array(ids, "<i8").tobytes(), np.array(nulls, "<i8").tobytes(), offsets.tobytes()]))
            rows.append((task, part, name, width, len(ids), int(offsets[-1])))

        for batch in batches:
            for doc_id, own in zip(batch["doc_id"].tolist(), encoder.of_texts(batch["text"].tolist()), strict=True):
                if file is None:
                    name = f"{task:06d}-{part:04d}-{uuid.uuid4().hex}"
                    file = fs.open_output_stream(f"{root}/{name}.bin")
                blob = own.astype(kind).tobytes() + end
                file.write(blob)
                missing = doc_id is None
                ids.append(0 if missing else int(doc_id))
                nulls.append(int(missing))
                lengths.append(len(blob) // width)
                held += lengths[-1]
                if held >= part_tokens:
                    close()
                    part, held, file, ids, nulls, lengths = part + 1, 0, None, [], [], []
        if file is not None:
            close()
        yield pd.DataFrame(rows, columns=["task", "piece", "file", "width", "n_docs", "n_tokens"]).astype({"task": "int32", "piece": "int32", "file": object, "width": "int32", "n_docs": "int64", "n_tokens": "int64"})

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    placed = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # doc_id travels as a string: pandas would turn a long column with nulls into doubles
    written = placed.select(F.col("doc_id").cast("string"), "text").mapInPandas(write, WRITTEN)
    written.write.parquet(f"{out}/written")
    listed = spark.read.schema(WRITTEN).parquet(f"{out}/written")
    before = Window.orderBy("task", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    listed.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def read_token_files(manifest: DataFrame, root: str, with_ids: bool = False) -> DataFrame:
    """A row for each document in the files that ``manifest`` lists: doc_id, start, n_tokens, ids_crc32 [, ids].

    Parts are memory-mapped where the folder is local to the reader, else read by ranges.
    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        import pyarrow as pa

        fs, base_dir = uri_filesystem(root)

        def opened(name):
            return pa.memory_map(f"{base_dir}/{name}") if fs.type_name == "local" else fs.open_input_file(f"{base_dir}/{name}")

        for batch in batches:
            for file, width, n, base in zip(batch["file"], batch["width"], batch["n_docs"], batch["base"], strict=True):
                with opened(f"{file}.idx") as f:
                    head = np.frombuffer(f.read_buffer(), "<i8")
                doc_ids, nulls, offsets = head[1 : n + 1], head[n + 1 : 2 * n + 1], head[2 * n + 1 : 3 * n + 2]
                with opened(f"{file}.bin") as f:
                    for lo in range(0, n, 2048):
                        hi = min(n, lo + 2048)
                        f.seek(int(offsets[lo]) * int(width))
                        flat = np.frombuffer(f.read_buffer(int(offsets[hi] - offsets[lo]) * int(width)), "<u2" if width == 2 else "<u4").astype("<u4")
                        cuts = offsets[lo : hi + 1] - offsets[lo]
                        view = memoryview(flat).cast("B")
                        out = {
                            "doc_id": pd.array(doc_ids[lo:hi], dtype="Int64"),
                            "start": base + offsets[lo:hi],
                            "n_tokens": np.diff(cuts),
                            "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                        }
                        out["doc_id"][nulls[lo:hi] == 1] = pd.NA
                        if with_ids:
                            out["ids"] = [flat[a:b].astype("int64") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        yield pd.DataFrame(out)

    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInPandas(read, schema)
