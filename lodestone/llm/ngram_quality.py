"""Quality by the perplexity of an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Texts are tokens (runs of word characters, runs of other signs), each a sequence of its own characters, case and all
letters kept, between start and end symbols. The n-grams of the whole corpus are gathered, summed in the tasks first, and get their
probabilities by joins of count tables dealt by n-gram. Documents are then scored in two tiers: words whose n-grams are all among
the most frequent ones are summed where the text is read; the others are joined, sharded by n-gram and by word,
and summed for each document. Both tiers hold the same probabilities, so results do not depend on the size of the first.
No text is shuffled, and tables may grow with the corpus: only the first tier, bounded by a parameter, is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, free_names, release, small, small_batches, tidy

ORDER = 5
START, END = "\x02", "\x03"
#: Runs of word characters or of other signs; a run beyond 64 characters is cut into tokens of 64.
TOKEN = re.compile(r"\w{1,64}|[^\w\s]{1,64}")
#: Letters that a token has at least to be held against the limit on single words.
WORD = 4
#: The probability below the shortest n-grams: uniform over this many symbols.
SYMBOLS = 1000
#: Trained symbols from which on a language has a model of its own.
LEAST_TRAINED = 50_000
#: Held-out documents from which on those of a language without a model of its own can tell that the pooled limits don't suit it.
LEAST_HELD_OUT = 5
#: A limit lies at most so many distances from median to upper quartile above the quartile, in logarithms: one odd held-out document doesn't raise it.
SPREAD = 5
POOLED = "*"


def grams_of(token: str) -> list[str]:
    """An n-gram for each character and one for the end."""
    padded = START * (ORDER - 1) + token + END
    return [padded[i : i + ORDER] for i in range(len(token) + 1)]


def gram_column(token: Column) -> Column:
    """``grams_of`` as an expression."""
    padded = F.concat(F.lit(START * (ORDER - 1)), token, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(token) + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))


class _Grams:
    """The n-grams of a list of words as numbers: ``pos`` are their places in ``text``, ``sizes`` how many each word has.

    Characters get numbers of 12 bits, the ``alphabet``'s, from 1 by frequency; n-grams of others have the key -1.
    """

    BITS = 12

    def __init__(self, words: list[str], alphabet: np.ndarray | None = None):
        pad = ORDER - 1
        self.text = "".join([START * pad + w + END for w in words])
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(self.sizes)
        self.pos = np.arange(ends[-1] if len(words) else 0) + np.repeat(pad * np.arange(len(words)), self.sizes)
        self.firsts = ends - self.sizes
        self.alphabet = self.index_of(codes) if alphabet is None else alphabet
        numbers = self.alphabet[codes].astype(np.int64)
        self.keys = np.zeros(len(self.pos), np.int64)
        known = np.ones(len(self.pos), bool)
        for k in range(ORDER):
            part = numbers[self.pos + k]
            self.keys = self.keys << self.BITS | part
            known &= part > 0
        self.keys[~known] = -1

    @classmethod
    def index_of(cls, codes: np.ndarray) -> np.ndarray:
        """The number of each code point, 0 for those beyond the most frequent 4095."""
        kinds, n = np.unique(codes, return_counts=True) if len(codes) < 1 << 16 else (np.arange(0x110000), np.bincount(codes, minlength=0x110000))
        kinds = kinds[n > 0][np.argsort(-n[n > 0], kind="stable")][: (1 << cls.BITS) - 1]
        index = np.zeros(0x110000, np.uint16)
        index[kinds] = np.arange(1, len(kinds) + 1)
        return index

    def sums(self, *weights: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
        """Distinct n-grams, and for each table of weights of the words its sum over them."""
        each = [np.repeat(w, self.sizes) for w in weights]
        some = self.keys >= 0
        _, first, which = np.unique(self.keys[some], return_index=True, return_inverse=True)
        places = self.pos[some][first].tolist()
        found = [self.text[p : p + ORDER] for p in places]
        totals = [np.bincount(which, w[some], len(found)).astype(np.int64) for w in each]
        if not some.all():  # characters beyond the alphabet, one by one
            rest: dict[str, list[int]] = {}
            for at in np.flatnonzero(~some).tolist():
                held = rest.setdefault(self.text[self.pos[at] : self.pos[at] + ORDER], [0] * len(each))
                for i, w in enumerate(each):
                    held[i] += int(w[at])
            found += list(rest)
            totals = [np.concatenate([t, np.array([v[i] for v in rest.values()], np.int64)]) for i, t in enumerate(totals)]
        return found, totals


class _Numbered:
    """Lists of strings as numbers: the distinct strings, the number of each in order, and where each list ends."""

    def __init__(self, lists: list[list[str]]):
        flat = [x for some in lists for x in some]
        numbers = {x: i for i, x in enumerate(dict.fromkeys(flat))}
        self.kinds = list(numbers)
        self.ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each list the sum of the values of its strings."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values[self.ids])])
        return total[self.ends] - total[self.begins]

    def tops(self, values: np.ndarray) -> np.ndarray:
        """For each list the largest value of its strings, 0 for an empty one."""
        out, full = np.zeros(len(self.sizes)), self.sizes > 0
        if full.any():
            out[full] = np.maximum.reduceat(values[self.ids], self.begins[full])
        return out


def _tokens(texts: list[str]) -> tuple[_Numbered, _Numbered]:
    """The texts' pieces between white space, and the tokens of each distinct piece; no token spans white space."""
    pieces = _Numbered([t.split() for t in texts])
    return pieces, _Numbered([TOKEN.findall(p) for p in pieces.kinds])


def _slices(texts: list[str], most_chars: int = 2 << 20) -> Iterator[slice]:
    """Runs of texts of at most ``most_chars`` characters together, or of one longer text."""
    lo = held = 0
    for i, text in enumerate(texts):
        if i > lo and held + len(text) > most_chars:
            yield slice(lo, i)
            lo, held = i, 0
        held += len(text)
    if lo < len(texts):
        yield slice(lo, len(texts))


def with_parts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """row input columns doc_id, lang, text (nulls as ''), and part: 1 trains, 2 is held out, 0 is neither.

    Trusted are all ids whose labels all have quality 1 and are not toxic. A quarter, by a hash, is held out. Up to ``most`` trusted ids are
    broadcast; more are joined by a shuffle, after which the rows are written once, as they are read several times.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).where("good")
    good = cut(good.select("_id", F.when(F.pmod(F.xxhash64(F.lit(6), "_id"), F.lit(1 << 20)) < (1 << 18), 2).otherwise(1).alias("part")), "kn-good")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    few = good.count() <= most
    chosen = F.broadcast(good) if few else good.hint("shuffle_merge")
    parted = plain.join(chosen, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "lang", "text", F.coalesce("part", F.lit(0)).alias("part"))
    return parted if few else cut(parted, "kn-parted")


def gram_counts(parted: DataFrame, most_grams: int = 400_000) -> DataFrame:
    """lang, gram, n, trained: how often each n-gram occurs in the whole corpus, and in the documents that train.

    Each task sums up words first, then their n-grams; what it holds is put out when there are ``most_grams``.
    """

    def count(batches):
        low = (1 << 44) - 1
        seen: dict[str, dict[str, int]] = {}  # both counts in one number, the trained one from bit 44 on

        def flush():
            for lang, own in seen.items():
                if own:
                    yield pd.DataFrame({"lang": lang, "gram": list(own), "n": [x & low for x in own.values()], "trained": [x >> 44 for x in own.values()]})
            seen.clear()

        for batch in batches:
            for lang, part in batch.groupby("lang", sort=True):
                texts, trains = part["text"].tolist(), (part["part"] == 1).to_numpy()
                for some in _slices(texts):
                    pieces, words = _tokens(texts[some])
                    train = np.repeat(trains[some], pieces.sizes)
                    times = [np.bincount(ids, minlength=len(pieces.kinds)) for ids in (pieces.ids, pieces.ids[train])]
                    of_words = [np.bincount(words.ids, np.repeat(n, words.sizes), len(words.kinds)) for n in times]
                    found, (n, trained) = _Grams(words.kinds).sums(*of_words)
                    own = seen.setdefault(lang, {})
                    for g, times in zip(found, (n | trained << 44).tolist(), strict=True):
                        own[g] = own.get(g, 0) + times
                    del pieces, words, of_words, found, n, trained  # else they stay while the next texts are cut
                    if sum(map(len, seen.values())) > most_grams:
                        yield from flush()
        yield from flush()

    found = parted.select("lang", "text", "part").mapInPandas(tidy(count), "lang string, gram string, n long, trained long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _discounts(counts: DataFrame) -> DataFrame:
    """d1, d2, d3 of each model, from how many n-grams have counts 1 to 4; one that is not between 0 and its count is half of it."""
    n = counts.groupBy("model").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    d = [i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}") for i in (1, 2, 3)]
    whole = reduce(Column.__and__, [F.col(f"n{i}") > 0 for i in (1, 2, 3, 4)])
    return n.select("model", *[F.when(whole & (d[i] > 0) & (d[i] < i + 1), d[i]).otherwise((i + 1) / 2).alias(f"d{i + 1}") for i in range(3)])


def scored_grams(counts: DataFrame) -> DataFrame:
    """model, gram, n, logp (natural) for each n-gram of ``counts`` (model, gram, n, trained; trained may be 0).

    The longest n-grams count how often trusted text has them; those below, in how many contexts it has them. An n-gram whose
    context no trusted text has takes the probability of the next shorter one; the shortest mix with a uniform one.
    """
    suffix = lambda k: F.expr(f"substring(gram, {ORDER - k + 1})")
    levels = {ORDER: counts.where("trained > 0").select("model", "gram", F.col("trained").alias("n"))}
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[k + 1].groupBy("model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = cut(shorter, f"kn-counts-{k}")
    lower = None
    for k in range(1, ORDER + 1):
        d = F.broadcast(_discounts(levels[k]))  # a row for each language
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.expr(f"substring(gram, 1, {k - 1})")
        seen = levels[k].join(d, "model").withColumns({"context": context, "d": discount})
        contexts = seen.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("held_back"))
        own = seen.select("model", "gram", (F.col("n") - F.col("d")).alias("own"))
        at = counts.select("model", suffix(k).alias("gram")).distinct().withColumns({"context": context, "shorter": F.expr("substring(gram, 2)")})
        at = at.join(own, ["model", "gram"], "left").join(contexts, ["model", "context"], "left")
        at = at.withColumn("p0", F.lit(1.0 / SYMBOLS)) if lower is None else at.join(lower.select("model", F.col("gram").alias("shorter"), F.col("p").alias("p0")), ["model", "shorter"])
        p = (F.coalesce("own", F.lit(0.0)) + F.col("held_back") * F.col("p0")) / F.col("total")
        shorter_ones, lower = lower, cut(at.select("model", "gram", F.coalesce(p, F.col("p0")).alias("p")), f"kn-{k}")
        release(shorter_ones, levels[k])
    return counts.select("model", "gram", "n").join(lower, ["model", "gram"]).select("model", "gram", "n", F.ln("p").alias("logp"))


def hot_rows(grams: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of ``grams``, ``most`` at most: all from the least quarter power of two of n on that allows it."""
    power = F.floor(F.log2(F.greatest("n", F.lit(1))) * 4).cast("int")
    sizes = grams.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect()  # 256 rows at most
    held, least = 0, 1 << 30
    for r in sizes:
        held += r["count"]
        if held > most:
            break
        least = r["power"]
    return grams.where(power >= least)


class _HotGrams:
    """Logarithms of the most frequent n-grams of a model, as sorted arrays."""

    def __init__(self, grams: list[str], logp: np.ndarray):
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = _Grams.index_of(codes)
        numbers = self.alphabet[codes].astype(np.int64).reshape(-1, ORDER)
        keys = np.zeros(len(grams), np.int64)
        for k in range(ORDER):
            keys = keys << _Grams.BITS | numbers[:, k]
        known = (numbers > 0).all(axis=1)
        order = np.argsort(keys[known])
        self.keys, self.logp = keys[known][order], np.asarray(logp)[known][order]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum over each word's n-grams, and whether some of them are not held here."""
        g = _Grams(words, self.alphabet)
        if not len(self.keys) or not len(words):
            return np.zeros(len(words)), np.ones(len(words), bool)
        at = np.minimum(np.searchsorted(self.keys, g.keys), len(self.keys) - 1)
        there = self.keys[at] == g.keys
        return np.add.reduceat(np.where(there, self.logp[at], 0.0), g.firsts), np.add.reduceat(~there, g.firsts, dtype=np.int64) > 0


def scored(parted: DataFrame, grams: DataFrame, own: set[str], hot_grams: int) -> DataFrame:
    """doc_id, lang, h (hash of lang and text), part, model, n_symbols, logp, worst_word for each row, written to the shared folder.

    worst_word: the highest mean, over a word of WORD letters or more and its end, of the negative logarithm; 0 without such a word.
    """
    hot = hot_rows(grams, hot_grams).select("model", "gram", "logp").toArrow()  # hot_grams rows at most
    table = parted.sparkSession.sparkContext.broadcast(hot)

    def score(batches):
        rows = table.value.to_pandas()
        known = {m: _HotGrams(part["gram"].tolist(), part["logp"].to_numpy(float)) for m, part in rows.groupby("model")}
        del rows

        for batch in batches:
            models = batch["lang"].where(batch["lang"].isin(own), POOLED)
            total, symbols, worst = np.zeros(len(batch)), np.zeros(len(batch), np.int64), np.zeros(len(batch))
            missed: list[list[str]] = [[] for _ in range(len(batch))]
            times: list[list[int]] = [[] for _ in range(len(batch))]
            for model, at in batch.groupby(models, sort=True).indices.items():
                texts, table_of = batch["text"].iloc[at].tolist(), known.get(model) or _HotGrams([], np.zeros(0))
                for some in _slices(texts):
                    pieces, words = _tokens(texts[some])
                    value, missing = table_of.words(words.kinds)
                    size = np.fromiter(map(len, words.kinds), np.int64, len(words.kinds)) + 1
                    alone = np.fromiter((len(w) >= WORD and w.isalpha() for w in words.kinds), bool, len(words.kinds)) & ~missing
                    spots = at[some]
                    total[spots] = pieces.sums(words.sums(np.where(missing, 0.0, value)))
                    symbols[spots] = pieces.sums(words.sums(size))
                    worst[spots] = pieces.tops(words.tops(np.where(alone, -value / size, 0.0)))
                    lacking = words.sums(missing.astype(np.int64)) > 0
                    for doc in np.flatnonzero(pieces.sums(lacking.astype(np.int64))).tolist():
                        mine = pieces.ids[pieces.begins[doc] : pieces.ends[doc]]
                        tokens = np.concatenate([words.ids[words.begins[p] : words.ends[p]] for p in mine[lacking[mine]].tolist()])
                        kinds, n = np.unique(tokens[missing[tokens]], return_counts=True)
                        missed[spots[doc]], times[spots[doc]] = [words.kinds[i] for i in kinds], n.tolist()
                    del pieces, words
            yield batch[["doc_id", "lang", "h", "part"]].assign(model=models, n_symbols=symbols, logp=total, worst_word=worst, missed=missed, times=times)

    # doc_id travels as a string: pandas would turn a long column with nulls into doubles
    keyed = parted.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.xxhash64("lang", "text").alias("h"), "part", "text")
    made = keyed.mapInPandas(tidy(score), "doc_id string, lang string, h long, part int, model string, n_symbols long, logp double, worst_word double, missed array<string>, times array<int>")
    with small_batches(parted.sparkSession):
        base = cut(made.withColumn("row", F.monotonically_increasing_id()), "kn-documents")
    misses = base.where(F.size("missed") > 0).select("row", "model", F.explode(F.arrays_zip("missed", "times")).alias("m")).select("row", "model", F.col("m.missed").alias("word"), F.col("m.times").alias("times"))
    of_word = misses.select("model", "word").distinct().select("model", "word", F.explode(gram_column(F.col("word"))).alias("gram"))
    words = of_word.join(grams.select("model", "gram", "logp"), ["model", "gram"]).groupBy("model", "word").agg(F.sum("logp").alias("w"))
    mean = F.when((F.length("word") >= WORD) & F.col("word").rlike(r"^\p{L}+$"), -F.col("w") / (F.length("word") + 1)).otherwise(0.0)
    rest = misses.join(words, ["model", "word"]).groupBy("row").agg(F.sum(F.col("w") * F.col("times")).alias("more"), F.max(mean).alias("worse"))
    whole = base.drop("missed", "times").join(rest, "row", "left")
    out = cut(
        whole.select(
            F.col("doc_id").cast("long"), "lang", "h", "part", "model", "n_symbols",
            (F.col("logp") + F.coalesce("more", F.lit(0.0))).alias("logp"), F.greatest("worst_word", F.coalesce("worse", F.lit(0.0))).alias("worst_word"),
        ),
        "kn-scored",
    )
    release(base)
    return out


def _nll() -> Column:
    return -F.col("logp") / F.col("n_symbols")


def _step(score: Column) -> Column:
    return F.round(score * 1000)


def _of_step(step: Column) -> Column:
    return F.exp(step / 1000 + 0.0005)


def _far(median: Column, quartile: Column) -> Column:
    """The highest limit, in steps, that these two allow; scores that hardly differ are given a hundredth."""
    return quartile + SPREAD * F.greatest(quartile - median, F.lit(10.0))


def _needed(quantile: float) -> int:
    return math.ceil(1 / (1 - quantile) - 1e-9)


def limits_of(held_out: DataFrame, quantile: float) -> DataFrame:
    """lang, high, word_high: quantiles of the held-out documents' scores, in steps of 1/1000 of the logarithm.

    With fewer documents than 1 / (1 - quantile) there is no such quantile: the highest score, and half its distance from the median more. From
    LEAST_HELD_OUT documents on the limit is at most the upper quartile and SPREAD times its distance from the median, so
    outliers among few documents, or among trusted ones that are none, don't set it.
    """

    def high(score: Column) -> Column:
        q = F.percentile(_step(score), F.array(F.lit(0.5), F.lit(quantile), F.lit(1.0), F.lit(0.75)))
        n = F.count(F.lit(1))
        found = F.when(n >= _needed(quantile), q[1]).otherwise(q[2] + (q[2] - q[0]) / 2)
        return _of_step(F.when(n >= LEAST_HELD_OUT, F.least(found, _far(q[0], q[3]))).otherwise(found))

    # the steps of a score are few, so an exact percentile holds a small table of counts however many documents there are
    return held_out.where("n_symbols > 0").groupBy("lang").agg(high(_nll()).alias("high"), high(F.col("worst_word")).alias("word_high"))


def limits_of_rare(of_docs: DataFrame, pooled: DataFrame, quantile: float) -> DataFrame:
    """lang, high, word_high of languages scored with the pooled model, from all their documents and the one row of pooled limits.

    The pooled limit stands where at most one of LEAST_HELD_OUT or more held-out documents of the language is above it; else the
    highest of these counts, widened as above. A language with fewer is not held to the others': its limit is at
    least the quantile of all its documents.
    """

    def high(score: Column, name: str) -> Column:
        limit, held = F.max(name), F.when(F.col("part") == 2, _step(score))
        q = F.percentile(held, F.array(F.lit(0.5), F.lit(1.0), F.lit(0.75)))
        wide = F.greatest(limit, _of_step(F.least(q[1] + (q[1] - q[0]) / 2, _far(q[0], q[2]))))
        above = F.count_if((F.col("part") == 2) & (F.exp(score) > F.col(name)))
        return F.when(F.count(held) < LEAST_HELD_OUT, F.greatest(limit, _of_step(F.percentile(_step(score), F.lit(quantile))))).when(above > 1, wide).otherwise(limit)

    rows = of_docs.where("n_symbols > 0").crossJoin(F.broadcast(pooled.select("high", "word_high")))  # one row
    return rows.groupBy("lang").agg(high(_nll(), "high").alias("high"), high(F.col("worst_word"), "word_high").alias("word_high"))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, most_trusted: int, hot_grams: int) -> DataFrame:
    """doc_id, lang, h, model, n_symbols, perplexity, worst_word, high, word_high, kept for each row of ``docs``."""
    parted = with_parts(docs, labels, most_trusted)
    with small_batches(docs.sparkSession):
        counts = cut(gram_counts(parted), "kn-grams")
    trained = {r["lang"] for r in counts.groupBy("lang").agg(F.sum("trained").alias("n")).where(F.col("n") >= LEAST_TRAINED).collect()}  # a row for each language
    held = parted.where("part = 2")
    sizes = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    own = {x for x in trained if sizes.get(x, 0) >= _needed(quantile)}
    is_own = F.col("lang").isin(sorted(own)) if own else F.lit(False)
    tables = counts.where(is_own).select(F.col("lang").alias("model"), "gram", "n", "trained")
    pooled = counts.where(~is_own).limit(1).count() > 0
    if pooled:
        tables = tables.unionByName(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")).select(F.lit(POOLED).alias("model"), "gram", "n", "trained"))
    tables = cut(tables, "kn-models")
    grams = cut(scored_grams(tables), "kn-scores")
    release(counts, tables)
    of_docs = scored(parted, grams, own, hot_grams)
    limits = limits_of(of_docs.where("part = 2").where(F.col("model") != POOLED), quantile)
    if pooled:
        calm = scored(held, grams, set(), hot_grams).withColumn("lang", F.lit(POOLED))
        limits = limits.unionByName(limits_of_rare(of_docs.where(F.col("model") == POOLED), limits_of(calm, quantile), quantile))
    limits = F.broadcast(cut(limits.withColumnRenamed("lang", "l"), "kn-limits"))  # a row for each language
    release(grams, parted)
    judged = of_docs.join(limits, F.col("lang") == F.col("l"), "left").withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.exp(_nll())))
    none = F.lit(float("inf"))
    judged = judged.withColumns({"high": F.coalesce("high", none), "word_high": F.coalesce("word_high", none), "worst_word": F.exp("worst_word")})
    return judged.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("high")) & (F.col("worst_word") <= F.col("word_high")), F.lit(False)))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.985, most_trusted: int = 1_000_000, hot_grams: int = 262_144) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, worst_word, high, word_high, kept for each row of ``docs`` (doc_id, lang, text; others ignored).

    kept: the perplexity a symbol and the perplexity of the worst word of WORD letters or more are at most the ``quantile`` of
    held-out trusted documents of the language. Of the trusted documents (labels of quality 1, none toxic; all of them, broadcast up to
    ``most_trusted``) three quarters train. A language with less than LEAST_TRAINED trained n-grams, or fewer held-out documents than
    the quantile needs, takes a model of all languages together and limits made by that same model (``limits_of_rare``). A null
    language counts as ''.

    A null text, or one without tokens, has no perplexity (null) and is not kept. A null doc_id is never trusted; rows that repeat
    are scored each. Without trusted labels the model is uniform and there are no limits: all rows with tokens are kept.
    An empty table gives no rows. ``hot_grams`` bounds what is broadcast and changes no result.
    """
    judged = _judged(docs, labels, quantile, most_trusted, hot_grams)
    return judged.select("doc_id", F.nullif("lang", F.lit("")).alias("lang"), "n_symbols", "perplexity", "worst_word", "high", "word_high", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.985, most_trusted: int = 1_000_000, hot_grams: int = 262_144) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that ``quality`` keeps. A row is known by its doc_id, language and text."""
    judged = _judged(docs.select("doc_id", "lang", "text"), labels, quantile, most_trusted, hot_grams)
    key, mark = free_names(docs, "id", "hash")
    gone = cut(judged.where("not kept").select(F.col("doc_id").alias(key), F.col("h").alias(mark)).distinct(), "kn-gone")
    mine = F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))
    return docs.join(small(gone), (mine == F.col(mark)) & docs["doc_id"].cast("long").eqNullSafe(F.col(key)), "left_anti")
