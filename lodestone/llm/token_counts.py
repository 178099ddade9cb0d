"""Token counts of documents by a two-tier lookup, without shuffling a single pre-token."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.pretokens import PretokenEncoder

_encoders: dict[tuple, PretokenEncoder] = {}


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = 2_000, entries: int = 32_768) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in about ``sample_docs`` documents.

    Fitted on a bounded sample, as it only speeds up the count: a pre-token that is missing here is encoded where it
    occurs. Each task keeps its ``entries`` most frequent pre-tokens, so what reaches the driver is bounded by both.
    """
    rows = docs.count()
    if not rows:
        return {}

    def tasks(batches):
        encoder, seen = PretokenEncoder(path, len, sum), Counter()
        if encoder.cuttable:
            for batch in batches:
                for text in batch["text"].dropna():
                    encoder.value(text)
                    for word in text.replace("\n", " ").split(" "):
                        core = word.rstrip(".,;:!?")
                        if core.isalpha():
                            seen[" " + core] += 1
        top = seen.most_common(entries)
        yield pd.DataFrame({"pretoken": [k for k, _ in top], "n": [n for _, n in top]}).astype({"pretoken": object, "n": "int64"})

    counts = docs.select("text").sample(min(1.0, sample_docs / rows), seed=17).mapInPandas(tasks, "pretoken string, n long")
    top = counts.groupBy("pretoken").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pretoken").limit(entries).toPandas()
    encoder = PretokenEncoder(path, len, sum)
    return {k: encoder.pretokens[k] for k in top["pretoken"]}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, cache_entries: int = 250_000, frequent: dict[str, int] | None = None) -> DataFrame:
    """Number of tokens of each text, as the tokenizers or sentencepiece library counts them without special tokens.

    Input: ``doc_id`` and ``text``; other columns are ignored. Output, a row for each input row (repeated rows
    included): doc_id (null stays null), n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``). A null text counts as an empty one.
    An empty table gives no rows.
    The first tier is a broadcast table of at most 32,768 frequent pre-tokens, the second a cache in each Python
    worker of at most ``cache_entries`` entries in each of two generations. Nothing is shuffled.
    ``path``: a .json file of tokenizers or a .model file of sentencepiece, readable at that path on all executors.
    """
    if not path.endswith(".model") and frequent is None:
        frequent = frequent_lengths(docs, path)
    tier = docs.sparkSession.sparkContext.broadcast(frequent or {})

    def count(batches):
        if path.endswith(".model"):
            value = _pieces(path)
        else:
            key = (path, cache_entries)
            encoder = _encoders.get(key)
            if encoder is None:
                _encoders.clear()
                encoder = _encoders[key] = PretokenEncoder(path, len, sum, tier.value, cache_entries)
            value = encoder.value
        for batch in batches:
            tokens = [value(t) if t is not None else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": tokens})

    # doc_id travels as a string: pandas would turn a long column with nulls into doubles
    sized = docs.select(F.col("doc_id").cast("string"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = sized.mapInPandas(count, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast("long"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text, num_threads=1))
