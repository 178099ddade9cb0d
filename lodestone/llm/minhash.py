"""Near-duplicate groups by circulant MinHash: two permutations give all coordinates, bands give candidates, full sets decide."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shared import cut, free_names, release, small, small_batches, tidy

UNIVERSE_BITS = 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; of the whole sequence where there are fewer words."""
    import xxhash

    if not words:
        return np.zeros(0, np.int64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


@cache
def permutations(seed: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation of the universe, and rows of the second: row i holds its values at i, i+1, ... (circularly).

    Coordinate k of a set is the least value, over its elements at place i after the first permutation, of the second
    permutation shifted by k, so an element's values for all coordinates are one stretch of the second.
    """
    rng = np.random.default_rng(seed)
    n = 1 << UNIVERSE_BITS
    first = rng.permutation(n).astype(np.int32)
    second = rng.permutation(n).astype(np.int32)
    circular = np.concatenate([second, second[: coordinates - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circular, coordinates)


def signature(hashes: np.ndarray, seed: int, coordinates: int) -> np.ndarray:
    first, rows = permutations(seed, coordinates)
    at = first[hashes.view(np.uint64) >> np.uint64(64 - UNIVERSE_BITS)]
    best = np.full(coordinates, np.iinfo(np.int32).max, np.int32)
    for lo in range(0, len(at), 2048):
        np.minimum(best, rows[at[lo : lo + 2048]].min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band, of its rows and its number."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for i in range(rows.shape[1]):
        key = (key ^ rows[:, i]) * _PRIME
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int, size: int, seed: int) -> DataFrame:
    """doc_id, _text, n_shingles, fp (128-bit hash of the word sequence; null without words), bands, sketch (a byte of each coordinate)."""

    def make(batches):
        import xxhash

        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                if not words:
                    out.append((0, None, None, None))
                    continue
                hashes = shingle_hashes(words, size)
                sig = signature(hashes, seed, bands * rows)
                out.append((len(hashes), xxhash.xxh3_128_digest(b" ".join(words)), band_keys(sig, bands), (sig & 255).astype(np.uint8).tobytes()))
            n, fp, keys, bits = zip(*out, strict=True) if out else ((),) * 4
            yield pd.DataFrame({"doc_id": batch["doc_id"], "_text": batch["_text"], "n_shingles": n, "fp": fp, "bands": keys, "sketch": bits})

    # doc_id travels as a string: pandas would turn a long column with nulls into doubles
    keyed = docs.select(F.col("doc_id").cast("string"), "_text", "text")
    made = keyed.mapInPandas(tidy(make), "doc_id string, _text long, n_shingles long, fp binary, bands array<long>, sketch binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """fp, shingles of each text."""

    def made(text: str | None) -> tuple[bytes, np.ndarray]:
        import xxhash

        words = words_of(text)
        return xxhash.xxh3_128_digest(b" ".join(words)), shingle_hashes(words, size)

    def make(batches):
        for batch in batches:
            fp, shingles = zip(*map(made, batch["text"]), strict=True) if len(batch) else ((), ())
            yield pd.DataFrame({"fp": pd.Series(fp, dtype=object), "shingles": pd.Series(shingles, dtype=object)})

    return docs.select("text").mapInPandas(tidy(make), "fp binary, shingles array<long>")


def _agreeing(pairs: DataFrame, heads: DataFrame, least: float, share: float) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the similarity and whose sketches agree in a share of ``least``."""

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((left == right).mean(axis=1))

    a = heads.select(F.col("fp").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = heads.select(F.col("fp").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(b, "b").join(a, "a").where(F.least("na", "nb") >= F.greatest("na", "nb") * (share - 1e-9))
    return sized.where(agreement("sa", "sb") >= least).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity, in whole numbers: 100 * intersection >= percent * union."""
    a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", common).withColumn("either", F.size("xa") + F.size("xb") - F.col("common"))
    return both.where(F.col("common") * 100 >= F.col("either") * percent).select("a", "b")


def _met(rows: DataFrame, block: int, held: list[str]) -> DataFrame:
    """Members of each bucket outside the component of its first member, met with all its members, block by block: key, i, j, outside, *held."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    left = rows.where("label <> main").select("key", own.alias("i"), F.explode(others).alias("j"), F.lit(True).alias("outside"), *held)
    right = rows.select("key", F.explode(others).alias("i"), own.alias("j"), F.lit(False).alias("outside"), *held)
    return left.union(right)


def _codes(x: pd.Series, y: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for labels, equal where the labels are: numpy would compare bytes without their trailing zeros."""
    codes = pd.factorize(np.concatenate([x.to_numpy(object), y.to_numpy(object)]))[0]
    return codes[: len(x)], codes[len(x) :]


def _promising(rows: DataFrame, least: float, share: float) -> DataFrame:
    """fp of members of open buckets that may be linked with a member of another component, by sizes and sketches alone."""

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        x, y = both[both["outside"]], both[~both["outside"]]
        found: set[bytes] = set()
        if len(x) and len(y):
            sx, sy = (np.frombuffer(b"".join(s["sketch"]), np.uint8).reshape(len(s), -1) for s in (x, y))
            nx, ny = (s["n_shingles"].to_numpy() for s in (x, y))
            lx, ly = _codes(x["label"], y["label"])
            fx, fy = x["fp"].to_numpy(), y["fp"].to_numpy()
            for p in range(len(x)):
                at = np.flatnonzero((ly != lx[p]) & (np.minimum(ny, nx[p]) >= np.maximum(ny, nx[p]) * (share - 1e-9)))
                at = at[(sy[at] == sx[p]).mean(axis=1) >= least]
                if len(at):
                    found.add(fx[p])
                    found.update(fy[at])
        return pd.DataFrame({"fp": list(found)}, dtype=object)

    return _met(rows, 2048, ["fp", "label", "n_shingles", "sketch"]).groupBy("key", "i", "j").applyInPandas(compare, "fp binary").distinct()


def _residue(rows: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Links that join components, among the rows of open buckets that are promising.

    Members outside the component of a bucket's first member are held against all members, block by block, so a task
    holds two blocks at a time. A pair is looked at in the first bucket that it shares, if its sketches agree, and decided
    on the full sets; of the links in a pair of blocks only those are yielded that join components not yet joined there.
    """

    def compare(key, both):
        found = []
        x, y = both[both["outside"]], both[~both["outside"]]
        if len(x) and len(y):
            (sx, sy), (bx, by) = ([np.frombuffer(b"".join(s["sketch"]), np.uint8).reshape(len(s), -1) for s in (x, y)], [np.stack(s["bands"].to_list()) for s in (x, y)])
            ids, (own, labels) = y["fp"].to_numpy(), _codes(x["label"], y["label"])
            full_y: dict[int, frozenset] = {}
            root: dict[int, int] = {}

            def top(c):
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for p in range(len(x)):
                shared = by == bx[p]
                first = shared.argmax(axis=1)
                near = np.flatnonzero(((sy == sx[p]).mean(axis=1) >= least) & (labels != own[p]) & (bx[p][first] == key[0]) & shared.any(axis=1))
                full = frozenset(x["shingles"].iloc[p].tolist()) if len(near) else None
                for q in near.tolist():
                    if top(own[p]) == top(labels[q]):
                        continue
                    if q not in full_y:
                        full_y[q] = frozenset(y["shingles"].iloc[q].tolist())
                    common = len(full & full_y[q])
                    if common * 100 >= (len(full) + len(full_y[q]) - common) * percent:
                        root[top(own[p])] = top(labels[q])
                        found.append((x["fp"].iloc[p], ids[q]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    met = _met(rows.join(sets, "fp"), 512, ["fp", "label", "sketch", "bands", "shingles"])
    return met.groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def _open_buckets(buckets: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that hold three or more members in two or more components; the first round decided all others."""
    of = labels.select(F.col("node").alias("fp"), "label")
    labelled = cut(buckets.join(of, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "near-labelled")
    still = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "label"))["label"].alias("main"))
    still = cut(still.where("n > 2 and low <> high").select("key", "main", "n"), "near-open")
    rows = cut(labelled.join(small(still), "key").join(heads, "fp"), "near-residue")
    release(labelled, still)
    return rows


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = 25, rows: int = 5, seed: int = 42, agreement: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    A document's set holds its distinct shingles of ``size`` words; with fewer words, the whole sequence as one; a null
    text, or one without words, has none and is linked with nothing. Two documents are linked if their sets reach a Jaccard
    similarity of ``percent`` / 100. component_id is the smallest doc_id that links reach; kept: doc_id = component_id.

    1. Circulant MinHash: ``bands`` x ``rows`` coordinates from two permutations of 2**20 places. At the least similarity,
       25 bands of 5 miss a pair with a chance of about 4e-7.
    2. Equal word sequences form classes, known by their fingerprint; only one of each class goes on.
    3. In each bucket all members are paired with its first. Pairs whose sizes and sketches allow it are
       decided on their full sets, and components are formed.
    4. Buckets that then hold more than one component are compared in blocks across components, by sizes and sketches, then the members
       that may be linked on their full sets, so no link that could join two components is left out, while groups already joined
       are never expanded into pairs.

    Rows that repeat a doc_id with the same text get the same values. A doc_id with several texts is several documents: each row
    has the component of its own text. A row without doc_id is linked with nothing: its component_id is null, and it is kept.
    An empty table gives no rows.
    """
    out, _ = _components(docs, percent, size, bands, rows, seed, agreement)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that ``near_duplicates`` keeps, and of rows that repeat doc_id and words one only."""
    out, base = _components(docs, **options)
    key, mark = free_names(docs, "id", "hash")
    gone = cut(out.where("not kept").select(F.col("doc_id").alias(key), F.col("_text").alias(mark)).distinct(), "near-gone")
    again = cut(base.where("doc_id is not null").groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(key), F.col("_text").alias(mark)), "near-again")
    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    kept = keyed.join(small(gone), [key, mark], "left_anti")
    if again.limit(1).count():
        once = kept.join(again, [key, mark], "left_semi").dropDuplicates([key, mark])
        kept = kept.join(again, [key, mark], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def _components(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = 25, rows: int = 5, seed: int = 42, agreement: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The result of ``near_duplicates`` with the hash ``_text`` of each row's text, and the table of all sketches."""
    share = percent / 100
    coordinates = bands * rows
    least = share - 6 * (share * (1 - share) / coordinates) ** 0.5 if agreement is None else agreement
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"))
    with small_batches(docs.sparkSession):
        base = cut(sketches(docs, bands, rows, size, seed), "near-sketches")
    worded = base.where("fp is not null and doc_id is not null")
    # one row of each class goes on; the class takes part under its fingerprint, its smallest doc_id is put in at the end
    heads = cut(worded.groupBy("fp").agg(F.min(F.struct("doc_id", "_text", "n_shingles")).alias("h"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("fp", "h.*", "bands", "sketch"), "near-heads")
    buckets = heads.select("fp", F.explode("bands").alias("key"))
    firsts = cut(buckets.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a"), "near-firsts")
    pairs = cut(buckets.join(firsts, "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct(), "near-pairs")
    near = cut(_agreeing(pairs, heads, least, share), "near-agreeing")
    crowded = cut(buckets.join(firsts.select("key"), "key"), "near-buckets")
    sets = _sets(near.select(F.col("a").alias("fp")).union(near.select("b")), heads, docs, size)
    links = cut(_linked(near, sets, percent), "near-links")
    labels = components(links)
    open_rows = _open_buckets(crowded, heads.select("fp", "n_shingles", "sketch", "bands"), labels)
    release(firsts, pairs, near, crowded, links)
    promising = cut(_promising(open_rows, least, share), "near-promising")
    more_sets = _sets(promising.join(sets, "fp", "left_anti"), heads, docs, size)
    more = cut(_residue(open_rows.join(promising, "fp", "left_semi"), sets.union(more_sets), percent, least), "near-more")
    if more.limit(1).count():
        joined = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
        release(labels)
        labels = joined
    release(open_rows, promising, sets, more_sets, more)
    of_head = heads.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "doc_id", F.coalesce("label", "fp").alias("label"))
    named = of_head.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = cut(of_head.join(named, "label").select("fp", "component_id"), "near-components")
    release(heads, labels)
    out = base.join(of_class, "fp", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), base


def _sets(classes: DataFrame, heads: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Shingle sets of the classes named, and of no others, each from the text of its first row."""
    needed = cut(classes.distinct().join(heads.select("fp", "doc_id", "_text"), "fp").select("doc_id", "_text"), "near-needed")
    with small_batches(docs.sparkSession):
        sets = cut(shingle_sets(docs.join(small(needed), ["doc_id", "_text"], "left_semi"), size).dropDuplicates(["fp"]), "near-sets")
    release(needed)
    return sets
