"""Text expressions, all built-in functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_chain(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [c.rlike(p) for p in patterns])


def search_tokens(c: Column) -> Column:
    """Tokens of benchmark texts: lower case, cut at white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def concept_tokens(c: Column) -> Column:
    """Tokens of concept texts: camelCase, _ and - are cut, lower case, word characters only."""
    spaced = F.translate(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "_-", "  ")
    return F.regexp_extract_all(F.lower(spaced), F.lit(r"(?U)(\w+)"), F.lit(1))


def normalized_name(c: Column) -> Column:
    """Names as they are matched: lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"\s+", " "))


def identifier(c: Column) -> Column:
    """Names as they go into ids: no punctuation, spaces as _, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)[^\w\s]", "")), r"\s+", "_"))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after, whatever separates the runs."""
    cut = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(cut, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def sentence_count(c: Column) -> Column:
    """Parts between runs of . ! and ? that hold more than white space."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^.!?\s][^.!?]*")), F.lit(0))


def readability(n_words: Column, n_sentences: Column) -> Column:
    """Flesch reading ease with 1.5 syllables a word, put in 0 to 1; 0 without words or sentences."""
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (F.floor(n_words * 1.5) / n_words)
    return F.when((n_words > 0) & (n_sentences > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100))).otherwise(0.0)


def fluency(n_words: Column, n_sentences: Column, in_sentences: Column, n_distinct: Column) -> Column:
    """Mean of a sentence-length score (1 for 15 to 25 words on average, else 0.8) and the share of distinct words."""
    length = F.when((in_sentences / n_sentences).between(15, 25), 1.0).otherwise(0.8)
    value = F.least(F.lit(1.0), (length + n_distinct / n_words) / 2)
    return F.when((n_sentences > 0) & (n_words > 0), value).otherwise(0.0)


def with_quality(df: DataFrame, column: str = "text", expected: list[str] | None = None) -> DataFrame:
    """df with n_words, n_sentences (raw parts, also empty ones), readability, fluency [, completeness], overall.

    Each count is taken once; overall is the mean of the scores.
    """
    c = F.col(column)
    counted = df.withColumns({
        "n_words": word_count(c), "_s": sentence_count(c), "_in": F.coalesce(F.regexp_count(c, F.lit(r"[^\s.!?]+")), F.lit(0)),
        "_d": F.coalesce(F.size(F.array_distinct(words(F.lower(c)))), F.lit(0)), "n_sentences": F.coalesce(F.regexp_count(c, F.lit(r"[.!?]+")), F.lit(0)) + 1,
    })
    scores = {"readability": readability(F.col("n_words"), F.col("_s")), "fluency": fluency(F.col("n_words"), F.col("_s"), F.col("_in"), F.col("_d"))}
    if expected is not None:
        scores["completeness"] = completeness(c, expected)
    scored = counted.withColumns(scores).drop("_s", "_in", "_d")
    return scored.withColumn("overall", sum((F.col(n) for n in scores), F.lit(0.0)) / len(scores))


def completeness(c: Column, expected: list[str]) -> Column:
    """Share of the expected elements that the text contains, whatever the case; 0 for empty texts or expectations."""
    if not expected:
        return F.lit(0.0)
    found = sum((F.contains(F.lower(c), F.lit(e.lower())).cast("int") for e in expected), F.lit(0))
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, found / len(expected)).otherwise(0.0)


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; the row of the table is the bits of one number."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    for ch in b:
        met = row & places.get(ch, 0)
        row = (row + met) | (row - met)
    return len(a) - (row & (1 << len(a)) - 1).bit_count()


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length of both): 100 for equal texts, also empty ones; null where one is null.

    Spark has no function for it, and nested array functions take the cube of the length; batches go through Python.
    """

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 200.0 * _common_length(p, q) / (len(p) + len(q)) if p or q else 100.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
