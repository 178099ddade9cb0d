"""Removal of lines that many documents share, reversible as documents come and go.

The exact state is a table of reference counts: for each line key (a 128-bit hash, in two longs) the number of
documents that hold it. Documents added or deleted give a table of deltas, which is summed into it. For the pass over
the texts, the keys at or above the threshold go into cuckoo filters, one for each shard of the key space; the exact
table also tells which other known keys a filter would take by mistake, and these go along as exceptions. So the pass
decides each line exactly where it reads the text, and no text is shuffled. Filters and exceptions are broadcast behind
a check of their size; beyond it the lines' keys are joined with the exact table instead.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cuckoo import CuckooFilter
from lodestone.llm.shared import cut, release

FILTERS = "shard int, buckets long, filter binary"
_WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z in lower case; other bytes are left."""
    return line.strip(_WHITE).lower()


def _hashed(text: str | None, least: int) -> list[tuple[int, int] | None]:
    import xxhash

    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line_key(line)
        if len(key) < least or (least > 1 and len(key.decode()) < least):
            out.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(key)
            out.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF))
    return out


def _longs(pairs) -> np.ndarray:
    return np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)


class LineState(NamedTuple):
    """What line dedup knows of a corpus: exact counts, the filters of frequent keys, and what they were made with."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    least: int


def reference_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """hi, lo, docs: for each line key of ``least`` code points or more, the number of documents (rows) that hold it."""

    def keys(batches):
        for batch in batches:
            counts: dict[tuple[int, int], int] = {}
            for text in batch["text"]:
                for pair in set(_hashed(text, least)):
                    if pair is not None:
                        counts[pair] = counts.get(pair, 0) + 1
            found = _longs(list(counts))
            yield pd.DataFrame({"hi": found[:, 0], "lo": found[:, 1], "docs": np.fromiter(counts.values(), np.int64, len(counts))})

    return docs.select("text").mapInPandas(keys, "hi long, lo long, docs long").groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


def updated_counts(counts: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None, least: int = 1) -> DataFrame:
    """The table of counts after documents came and went; a key that no document holds any longer is gone."""
    parts = [counts]
    if added is not None:
        parts.append(reference_counts(added, least))
    if deleted is not None:
        parts.append(reference_counts(deleted, least).withColumn("docs", -F.col("docs")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("hi", "lo").agg(F.sum("docs").alias("docs")).where("docs > 0")


def build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """A cuckoo filter of the keys at or above ``min_docs`` for each shard of the key space."""

    def build(key, batch):
        made = CuckooFilter.of(batch["hi"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "filter": [made.table.tobytes()]})

    frequent = counts.where(F.col("docs") >= min_docs).select("hi", F.pmod("lo", F.lit(shards)).cast("int").alias("shard")).distinct()
    return frequent.groupBy("shard").applyInPandas(build, FILTERS)


def updated_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """Filters after the counts changed: keys that crossed ``min_docs`` are inserted or deleted in their shard only."""
    old = before.where(F.col("docs") >= min_docs).select("hi", "lo", F.lit(-1).alias("sign"))
    new = after.where(F.col("docs") >= min_docs).select("hi", "lo", F.lit(1).alias("sign"))
    # filters hold hi alone, so a change counts only if no other key with this hi stays on its side
    moved = old.union(new).withColumn("shard", F.pmod("lo", F.lit(shards)).cast("int")).groupBy("shard", "hi").agg(F.max("sign").alias("now"), F.min("sign").alias("was")).where("now = was")

    def change(key, held, moves):
        if not len(held):
            made = CuckooFilter.of(moves.loc[moves["now"] == 1, "hi"].to_numpy())
        else:
            made = CuckooFilter(int(held["buckets"][0]), np.frombuffer(held["filter"][0], np.uint16).reshape(-1, 4).copy())
            if len(moves):
                made.delete(moves.loc[moves["now"] == -1, "hi"].to_numpy())
                if not made.insert(moves.loc[moves["now"] == 1, "hi"].to_numpy()):
                    return pd.DataFrame({"shard": [key[0]], "buckets": [0], "filter": [None]})  # full: made anew below
        return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "filter": [made.table.tobytes()]})

    changed = cut(filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, FILTERS), "line-filters")
    full = changed.where("filter is null").select("shard")
    if not full.limit(1).count():
        return changed
    anew = after.withColumn("_s", F.pmod("lo", F.lit(shards)).cast("int")).join(full, F.col("_s") == F.col("shard"), "left_semi").drop("_s")
    return changed.where("filter is not null").unionByName(build_filters(anew, min_docs, shards))


def line_state(docs: DataFrame, min_docs: int = 10, least: int = 1) -> LineState:
    """The state of a corpus, written to the shared folder."""
    counts = cut(reference_counts(docs, least), "line-counts")
    shards = max(1, counts.where(F.col("docs") >= min_docs).count() // 50_000)
    return LineState(counts, cut(build_filters(counts, min_docs, shards), "line-filters"), shards, min_docs, least)


def updated_state(state: LineState, added: DataFrame | None = None, deleted: DataFrame | None = None) -> LineState:
    """The state after documents came and went: counts are summed up, and only keys that crossed ``min_docs`` are inserted or deleted.

    ``deleted`` holds the rows as they were added. Deleting what was added gives the state as it was before.
    """
    counts = cut(updated_counts(state.counts, added, deleted, state.least), "line-counts")
    filters = cut(updated_filters(state.filters, state.counts, counts, state.min_docs, state.shards), "line-filters")
    return state._replace(counts=counts, filters=filters)


def _kept(text: str | None, drop: list[bool]) -> str:
    return "\n".join(line for line, gone in zip((text or "").split("\n"), drop, strict=True) if not gone)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, state: LineState | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, kept_sha256 for each row of ``docs`` (doc_id, text; others ignored).

    Lines are split at ``\\n`` only; a null or empty text is one empty line. A line whose key has ``least`` or more code
    points and is in ``min_docs`` or more documents goes, in every document and every time. Each row counts as a
    document, also where rows or doc_ids repeat or are null; within a row a key counts once. The rest is joined by ``\\n``; if
    nothing is left the kept text is empty. ``state``: the corpus to hold lines against, by default ``docs`` itself.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    state = state or line_state(docs, min_docs, least)
    counts, shards, min_docs, least = state.counts, state.shards, state.min_docs, state.least
    frequent = counts.where(F.col("docs") >= min_docs)
    docs = docs.select(F.col("doc_id").cast("string"), "text")
    schema = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
    if (state.filters.agg(F.sum(F.octet_length("filter"))).collect()[0][0] or 0) > broadcast_bytes:  # one row
        return _drop_by_join(docs, frequent, least, schema)
    held = {r["shard"]: (r["buckets"], bytes(r["filter"])) for r in state.filters.toLocalIterator()}
    tables = spark.sparkContext.broadcast(held)

    def mistaken(batches):
        look = _Lookup(tables.value, shards)
        for batch in batches:
            hit = look.hits(batch["hi"].to_numpy(), batch["lo"].to_numpy())
            yield batch.loc[hit, ["hi", "lo"]]

    exceptions = cut(counts.where(F.col("docs") < min_docs).select("hi", "lo").mapInPandas(mistaken, "hi long, lo long"), "line-exceptions")
    if exceptions.count() * 16 > broadcast_bytes:
        return _drop_by_join(docs, frequent, least, schema)
    wrong = spark.sparkContext.broadcast(_sorted_pairs(exceptions.toPandas()))  # two arrays of longs, bounded just above
    release(exceptions)

    def drop(batches):
        look = _Lookup(tables.value, shards)
        for batch in batches:
            hashed = [_hashed(t, least) for t in batch["text"]]
            flat = _longs([p or (0, 0) for h in hashed for p in h])
            hit = look.hits(flat[:, 0], flat[:, 1])
            hit[hit] = ~_among(flat[hit], wrong.value)
            out, at = [], 0
            for doc_id, text, h in zip(batch["doc_id"], batch["text"], hashed, strict=True):
                gone = [bool(hit[at + i]) and p is not None for i, p in enumerate(h)]
                at += len(h)
                kept = _kept(text, gone)
                out.append((None if doc_id is None else int(doc_id), len(h), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
            yield _frame(out)

    return docs.mapInPandas(drop, schema)


def _sorted_pairs(pairs: pd.DataFrame) -> np.ndarray:
    """Pairs of longs as rows of bytes in sorted order."""
    both = np.ascontiguousarray(pairs[["hi", "lo"]].to_numpy(np.int64)).view("V16").ravel()
    return np.sort(both.view([("hi", "i8"), ("lo", "i8")]), order=["hi", "lo"])


def _among(pairs: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Which rows (hi, lo) are among the sorted pairs."""
    out = np.zeros(len(pairs), bool)
    if len(wrong):
        first, last = np.searchsorted(wrong["hi"], pairs[:, 0], "left"), np.searchsorted(wrong["hi"], pairs[:, 0], "right")
        for i in np.flatnonzero(last > first):
            out[i] = pairs[i, 1] in wrong["lo"][first[i] : last[i]]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    doc_id, n_lines, n_dropped, kept, sha = zip(*rows, strict=True) if rows else ((),) * 5
    return pd.DataFrame({"doc_id": pd.array(doc_id, dtype="Int64"), "n_lines": n_lines, "n_dropped": n_dropped, "kept_text": kept, "kept_sha256": sha}).astype({"n_lines": "int64", "n_dropped": "int64"})


class _Lookup:
    """All shards' filters; each look-up asks only the key's own."""

    def __init__(self, held: dict[int, tuple[int, bytes]], shards: int):
        self.filters = {s: CuckooFilter(n, np.frombuffer(b, np.uint16).reshape(-1, 4)) for s, (n, b) in held.items()}
        self.shards = shards

    def hits(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        if len(hi):
            shard = np.mod(lo.astype(np.int64), self.shards)
            for s in np.unique(shard):
                if (f := self.filters.get(int(s))) is not None:
                    mine = shard == s
                    out[mine] = f.contains(hi[mine].view(np.uint64) if hi.dtype == np.int64 else hi[mine])
        return out


def _drop_by_join(docs: DataFrame, frequent: DataFrame, least: int, schema: str) -> DataFrame:
    """The same where the filters are too large to broadcast: each row's distinct keys are joined with the exact table."""

    def keys(batches):
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                found = _longs([p for p in set(_hashed(text, least)) if p is not None])
                yield pd.DataFrame({"row": row, "hi": found[:, 0], "lo": found[:, 1]})

    def drop(batches):
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(batch["doc_id"], batch["text"], batch["gone"], strict=True):
                known = {(g["hi"], g["lo"]) for g in gone} if gone is not None else set()
                pairs = _hashed(text, least)
                signed = [tuple(int(x) for x in _longs([p])[0]) if p else None for p in pairs]
                flags = [s is not None and s in known for s in signed]
                kept = _kept(text, flags)
                out.append((None if doc_id is None else int(doc_id), len(pairs), sum(flags), kept, hashlib.sha256(kept.encode()).hexdigest()))
            yield _frame(out)

    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()), "line-rows")
    found = rows.select("row", "text").mapInPandas(keys, "row long, hi long, lo long").join(frequent.select("hi", "lo"), ["hi", "lo"])
    gone = found.groupBy("row").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))
    return rows.join(gone, "row", "left").select("doc_id", "text", "gone").mapInPandas(drop, schema)
