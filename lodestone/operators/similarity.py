"""Similarity join of strings by the ratio of insertions and deletions, through an index of segments met by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import indel_ratio


def _edits(a: Column, b: Column, least: float) -> Column:
    """The most insertions and deletions between strings of lengths ``a`` and ``b`` of ratio ``least``; it is odd or even as their sum is."""
    most = F.floor((a + b) * (100 - least) / 100 + 1e-9).cast("int")
    return (most - F.pmod(most - a - b, F.lit(2))).cast("int")


def _part(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of part ``i`` of a string cut into ``parts`` as equal as can be, the longer ones last."""
    base, longer = F.floor(length / parts).cast("int"), F.pmod(length, parts)
    late = i - (parts - longer)
    return i * base + F.greatest(F.lit(0), late), base + (late >= 0).cast("int")


def _lengths(n: Column, least: float) -> Column:
    """The lengths that a string of ratio ``least`` to one of length ``n`` can have."""
    share = least / (200 - least)
    return F.sequence(F.greatest(F.lit(1), F.ceil(n * share - 1e-9)).cast("int"), F.floor(n / share + 1e-9).cast("int"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 95.0) -> DataFrame:
    """a, b, score for all pairs of different strings of ``left`` (a) and ``right`` (b) with a ratio of ``least`` or more.

    The ratio is 200 * common subsequence / both lengths, so a pair of ratio ``least`` is at most e insertions and
    deletions apart, e known from the lengths. A string cut into e + 1 segments keeps one of them whole, and how far it can have moved follows from e and the
    lengths: strings of ``right`` are indexed by length, e, number and text of each segment, those of ``left`` look up their substrings
    there, and only pairs that met are scored. Rows grow with the lengths and with 100 - ``least``, not with pairs: about 45 look-ups for a string of 20
    characters at 95. Nulls and empty strings are like nothing; repeated strings count once; equal strings are no pair.
    """
    if not 50 <= least <= 100:
        raise ValueError("least must be from 50 to 100")
    a = left.select("a").where(F.length("a") > 0).distinct().withColumn("la", F.length("a"))
    b = right.select("b").where(F.length("b") > 0).distinct().withColumn("lb", F.length("b"))

    held = b.withColumn("e", F.explode(F.array_distinct(F.transform(_lengths(F.col("lb"), least), lambda la: _edits(la, F.col("lb"), least)))))
    held = held.where("e >= 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    start, size = _part(F.col("lb"), F.col("e") + 1, F.col("i"))
    held = held.select("b", "lb", "e", "i", F.substring("b", start + 1, size).alias("s"))

    asked = a.withColumn("lb", F.explode(_lengths(F.col("la"), least))).withColumn("e", _edits(F.col("la"), F.col("lb"), least))
    asked = asked.where("e >= 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("e"))))
    start, size = _part(F.col("lb"), F.col("e") + 1, F.col("i"))
    asked = asked.withColumns({"start": start, "size": size, "apart": F.col("la") - F.col("lb")})
    # a segment moves by what is inserted less what is deleted before it, and what follows it must make up the rest
    moved = F.sequence(((F.col("apart") - F.col("e")) / 2).cast("int"), ((F.col("apart") + F.col("e")) / 2).cast("int"))
    asked = asked.withColumn("at", F.explode(F.transform(moved, lambda m: m + F.col("start")))).where("at >= 0 and at + size <= la")
    asked = asked.select("a", "lb", "e", "i", F.substring("a", F.col("at") + 1, F.col("size")).alias("s")).distinct()

    met = asked.join(held, ["lb", "e", "i", "s"]).where("a <> b").select("a", "b").distinct()
    return met.withColumn("score", indel_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
