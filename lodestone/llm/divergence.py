"""How the sources of a language differ in their words: pairwise divergences and each source's leading terms.

Terms of each language are dealt to blocks. In each block a dense int64 matrix, groups by terms, holds the shares of
all groups; all pairs of its rows are compared by broadcasting, which gives a partial matrix of pairs, and each row gives the head of its
ranking. Partial matrices are summed and the heads merged over the blocks. Many groups are cut into blocks too, and a tile then compares two of them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, release, small

SCALE = 1_000_000_000
TILE_TERMS, TILE_GROUPS, TASK_TERMS = 2048, 128, 400_000
_COUNTS = "lang string, source string, term string, n long, docs long"
_TILES = "lang string, source string, part string, item string, value long"
#: Bytes of terms, with A-Z lower-cased; all others become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count_terms(batches):
    """Occurrences and documents of each term of a task's texts by (lang, source); passed on whenever ``TASK_TERMS`` terms are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        columns = [[], [], [], [], []]
        for group, (counts, docs) in held.items():
            n = len(counts) + 1
            columns[0].append(pa.repeat(pa.scalar(group[0], pa.string()), n))
            columns[1].append(pa.repeat(pa.scalar(group[1], pa.string()), n))
            columns[2].append(pa.array([*counts, b""], pa.binary()))
            columns[3].append(pa.array([*counts.values(), 0], pa.int64()))
            columns[4].append(pa.array([*map(docs.__getitem__, counts), 0], pa.int64()))
        arrays = [pa.concat_arrays(c) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts, langs, sources = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "lang", "source"))
        for text, lang, source in zip(texts.cast(pa.binary()), langs.to_pylist(), sources.to_pylist(), strict=True):
            counts, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before = len(counts)
            terms = (text.as_py() or b"").translate(_LETTERS).split()
            counts.update(terms)
            docs.update(set(terms))
            size += len(counts) - before
            if size >= TASK_TERMS:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs for each term of each (lang, source), counted in each task before anything is shuffled.

    Each (lang, source) also has a row of the empty term, which no text holds, with n 0, so groups without terms are known too.
    """
    counted = docs.select("text", "lang", "source").mapInArrow(_count_terms, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n, total: int, terms: int):
    """1 + floor(SCALE * (n + 1) / (total + terms)) for an int64 array, exact as long as total + terms is under 9e15: three long-division steps by 1000."""
    rest, found, whole = n + 1, 0, total + terms
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


def _tile(most: int):
    """A function on all cells of one tile: rows of (source, term, n, lang_n, total, lang_total, terms, block_terms, side) to partial pairs and heads of rankings."""

    def run(key, cells):
        import numpy as np
        import pandas as pd

        lang, _, a, b = key
        heads = cells["term"] == ""
        groups = cells[heads].sort_values(["side", "source"])
        cells = cells[~heads]
        v = int(groups["terms"].iloc[0])
        names, sides = groups["source"].to_numpy(object), groups["side"].to_numpy()
        terms, column = np.unique(cells["term"].to_numpy(object), return_inverse=True)
        place = {name: i for i, name in enumerate(names)}
        n = np.zeros((len(names), len(terms)), np.int64)
        n[cells["source"].map(place).to_numpy(np.int64), column] = cells["n"].to_numpy(np.int64)
        p = np.stack([shares(row, int(total), v) for row, total in zip(n, groups["total"], strict=True)])
        left, right = (np.arange(len(names)), np.arange(len(names))) if a == b else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
        out: list[tuple] = []
        absent = int(groups["block_terms"].iloc[0]) - len(terms)  # terms of the block that only groups of other tiles hold
        none = np.array([int(shares(np.zeros(1, np.int64), int(total), v)[0]) for total in groups["total"]], np.int64)
        step = max(1, 2_000_000 // max(1, len(right) * len(terms)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            x, y = p[rows][:, None, :], p[right][None, :, :]
            square, far = (x - y) ** 2, (none[rows][:, None] - none[right][None, :]) ** 2
            for owner in (0, 1) if a != b else (0,):
                sums = (square // (x if owner else y)).sum(axis=2) + absent * (far // (none[rows][:, None] if owner else none[right][None, :]))
                for i, k in enumerate(rows):
                    for j, other in enumerate(right):
                        if k != other:
                            pair = (names[k], names[other]) if owner == 0 else (names[other], names[k])
                            out.append((lang, pair[0], "pair", pair[1], int(sums[i, j])))
        if a == b and len(terms):
            lang_n = np.zeros(len(terms), np.int64)
            lang_n[column] = cells["lang_n"].to_numpy(np.int64)
            q = shares(lang_n, int(groups["lang_total"].iloc[0]), v)
            for name, counts, own in zip(names, n, p, strict=True):
                better = np.flatnonzero((counts > 0) & (own > q))
                value = (own[better] - q[better]) ** 2 // q[better]
                for i in np.argsort(-value, kind="stable")[:most]:  # terms are sorted, so ties stay in their order
                    out.append((lang, name, "term", terms[better[i]], int(value[i])))
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) differs from the other sources of its language and from the language.

    A language keeps the terms found in at least ``least_docs`` of its documents (rows). A group's share of a kept
    term is p = 1 + floor(1e9 * (count + 1) / (N + V)), N the group's occurrences of kept terms and V the number of kept terms; all in whole numbers.
    With q the share elsewhere, f = floor((p - q)^2 / q). Part ``pair``: for every other source of the language the sum of f over
    all kept terms, all of them ranked; 0 if V is 0. Part ``term``: kept terms that the group holds with p > q of the language, the ``most_terms`` first.
    Ranks go by value downwards, then by item in UTF-8 order.

    Null text, lang and source count as ''. Groups without terms have pairs and no terms; a language with one
    source has no pairs; an empty table gives no rows; repeated rows count each; further columns are not read.
    Sums fit 64 bits as long as (1e9 + V)^2 does. Tiles have about 2,048 terms and up to two times 128 groups, so a task's memory is bounded,
    whatever the number of terms or sources and however large one source is.
    """
    counts = cut(term_counts(docs), "div-counts")
    spread = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    spread = cut(spread.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "div-terms")
    kept = cut(counts.where("term <> ''").select("lang", "source", "term", "n").join(spread, ["lang", "term"]), "div-kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    sums = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("groups"))
    vocabulary = spread.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = sums.join(vocabulary, "lang", "left").na.fill(0, ["terms"])
    langs = langs.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_TERMS))).withColumn("group_blocks", F.ceil(F.col("groups") / TILE_GROUPS))
    langs = cut(langs.withColumn("term_blocks", F.col("term_blocks").cast("int")).withColumn("group_blocks", F.col("group_blocks").cast("int")), "div-langs")
    of_lang = small(langs.select("lang", "lang_total", "terms", "term_blocks", "group_blocks"))

    heads = groups.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"), "total").join(of_lang, "lang")
    in_block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("block")
    sizes = spread.join(of_lang, "lang").select("lang", in_block).groupBy("lang", "block").agg(F.count(F.lit(1)).alias("block_terms"))
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))).join(sizes, ["lang", "block"], "left").na.fill(0, ["block_terms"])
    cells = kept.select("lang", "source", "term", "n", "lang_n", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("block_terms")).join(of_lang, "lang")
    cells = cells.select("*", in_block)
    both = heads.unionByName(cells).withColumn("own", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    both = both.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    both = both.select("lang", "block", "a", "b", "source", "term", "n", "lang_n", "total", "lang_total", "terms", "block_terms", "side")
    tiles = cut(both.groupBy("lang", "block", "a", "b").applyInPandas(_tile(most_terms), _TILES), "div-tiles")
    release(counts, spread, kept, langs)

    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
