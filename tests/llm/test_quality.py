"""The quality operator against a plain version: counts, probabilities, perplexities, limits and decisions."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import ngram_quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, model string, gram string"
WORDS = {"en": ["the", "house", "River", "green", "walks", "stone", "under", "and"], "de": ["größe", "straße", "über", "und", "läuft", "grün"]}


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 60))) + "."
        rows.append((i, text, lang, "s", 0, "x", "y"))
    rows += [(1000 + i, "#$%@ QZX!! || " * 20, "en", "s", 0, "x", "y") for i in range(4)]
    rows += [(1100, "the house idiotqx under the stone", "en", "s", 0, "x", "y"), (1101, "日本語 the house 𝔘", "en", "s", 0, "x", "y"), (1102, "x" * 200, "en", "s", 0, "x", "y")]
    rows += [(2000, None, "en", "s", 0, "x", "y"), (2001, " \n", "xx", "s", 0, "x", "y"), (None, rows[1][1], None, "s", 0, "x", "y"), rows[4], rows[4], (4, "another text", "de", "s", 0, "x", "y")]
    return rows


def model_of(counts):
    """Interpolated modified Kneser-Ney from the counts of the longest n-grams, as a function of an n-gram."""
    levels = {Q.ORDER: dict(counts)}
    for k in range(Q.ORDER - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    discounts = {}
    for k, c in levels.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [i - (i + 1) * y * n[i] / n[i - 1] if all(n) else 0 for i in (1, 2, 3)]
        discounts[k] = [x if 0 < x < i else i / 2 for i, x in zip((1, 2, 3), d, strict=True)]
    by_context = {k: collections.defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            by_context[k][g[:-1]].append(v)

    def p(g, k=Q.ORDER):
        if k == 0:
            return 1 / Q.SYMBOLS
        mine, d = by_context[k].get(g[-k:-1] if k > 1 else ""), discounts[k]
        if not mine:
            return p(g, k - 1)
        v = levels[k].get(g[-k:], 0)
        back = sum(d[min(x, 3) - 1] for x in mine)
        return ((v - d[min(v, 3) - 1] if v else 0) + back * p(g, k - 1)) / sum(mine)

    return p


def plain(rows, parts, own):
    """(doc_id, text, lang) -> (symbols, perplexity, worst word) and the limits, with ``parts`` as the operator chose them."""
    counts = collections.defaultdict(collections.Counter)
    for doc_id, text, lang, *_ in rows:
        if parts.get(doc_id) == 1:
            for token in Q.TOKEN.findall(text or ""):
                counts[lang or ""].update(Q.grams_of(token))
                counts[Q.POOLED].update(Q.grams_of(token))
    models = {m: model_of(counts[m]) for m in [*own, Q.POOLED]}

    def score(text, model):
        tokens = Q.TOKEN.findall(text or "")
        nll = [-sum(math.log(models[model](g)) for g in Q.grams_of(t)) for t in tokens]
        symbols = sum(len(t) + 1 for t in tokens)
        worst = max([x / (len(t) + 1) for t, x in zip(tokens, nll, strict=True) if len(t) >= Q.WORD and t.isalpha()], default=0.0)
        return symbols, sum(nll) / symbols if symbols else None, worst

    held = collections.defaultdict(list)
    for doc_id, text, lang, *_ in rows:
        if parts.get(doc_id) == 2:
            for model in {Q.POOLED, (lang or "") if (lang or "") in own else Q.POOLED}:
                held[model].append(score(text, model))
    return {(r[0], r[1], r[2]): score(r[1], (r[2] or "") if (r[2] or "") in own else Q.POOLED) for r in rows}, held


def step_at(scores, q):
    steps = sorted(round(x * 1000) for x in scores)
    at = q * (len(steps) - 1)
    low = steps[int(at)]
    return low + (steps[min(int(at) + 1, len(steps) - 1)] - low) * (at - int(at))


def at_quantile(scores, q=0.9, held=False):
    """The quantile; of held-out documents, not farther out than their median and upper quartile allow."""
    step, middle, upper = (step_at(scores, x) for x in (q, 0.5, 0.75))
    return math.exp((min(step, upper + Q.SPREAD * max(upper - middle, 10)) if held else step) / 1000 + 0.0005)


def test_one_odd_document_does_not_set_the_limit(spark):
    """75 held-out documents, of which one has a word that no other text has."""
    rows = [("x", -1.5 * 100 - i % 10, 100, 2.0 + (i % 20) / 20) for i in range(74)] + [("x", -900.0, 100, 7.0)]
    for n in (75, 30):
        limit = Q.limits_of(spark.createDataFrame(rows[-n:], "lang string, logp double, n_symbols int, worst_word double"), 0.985).collect()[0]
        assert math.log(limit["word_high"]) < 5.5 and math.log(limit["high"]) < 2.1


@pytest.mark.parametrize("hot_grams", [100_000, 7])
def test_against_plain(spark, monkeypatch, hot_grams):
    monkeypatch.setattr(Q, "LEAST_TRAINED", 3000)
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(130)] + [(129, 0, 0), (1100, 1, 1), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    parts = {r["doc_id"]: r["part"] for r in Q.with_parts(df, labels, 10**6).where("part > 0").collect()}
    assert set(parts) == set(range(129)) and set(parts.values()) == {1, 2}
    got = Q.quality(df, labels, quantile=0.9, hot_grams=hot_grams).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter((lang or "") for i, _, lang, *_ in rows if parts.get(i) == 2)
    own = {x for x in ("en", "de") if sizes[x] >= 10}
    assert own
    want, held = plain(rows, parts, own)
    for r in got:
        text = [t for i, t, lang, *_ in rows if (i, lang) == (r["doc_id"], r["lang"])]
        symbols, mean, worst = want[r["doc_id"], text[0] if len(set(text)) == 1 else text[-1 if r["n_symbols"] < 50 else 0], r["lang"]]
        assert r["n_symbols"] == symbols and math.log(r["worst_word"]) == pytest.approx(worst)
        assert (r["perplexity"] is None) == (mean is None) and (mean is None or math.log(r["perplexity"]) == pytest.approx(mean))
        model = r["lang"] if r["lang"] in own else Q.POOLED
        limits = []
        for which in (1, 2):
            limit = at_quantile([h[which] for h in held[model]], held=True)
            if model == Q.POOLED:  # these languages have no held-out document here
                limit = max(limit, at_quantile([v[which] for (_, _, lang), v in want.items() if lang == r["lang"] and v[0]] or [0.0]))
            limits.append(limit)
        if model == Q.POOLED and not symbols:
            limits = [math.inf] * 2
        assert [r["high"], r["word_high"]] == pytest.approx(limits)
        assert r["kept"] == (mean is not None and math.exp(mean) <= limits[0] and math.exp(worst) <= limits[1])
    assert not any(r["kept"] for r in got if (r["doc_id"] or 0) >= 1000)


def test_counts_against_plain_when_tables_are_emptied(spark):
    rows = corpus(n=30)
    parted = Q.with_parts(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"), 100)
    train = {r["doc_id"] for r in parted.where("part = 1").collect()}
    want = collections.Counter()
    trained = collections.Counter()
    for doc_id, text, lang, *_ in rows:
        for token in Q.TOKEN.findall(text or ""):
            for g in Q.grams_of(token):
                want[lang or "", g] += 1
                trained[lang or "", g] += doc_id in train
    for most in (1, 100_000):
        got = {(r["lang"], r["gram"]): (r["n"], r["trained"]) for r in Q.gram_counts(parted, most).collect()}
        assert got == {k: (n, trained[k]) for k, n in want.items()}


def test_characters_beyond_the_alphabet_count_too(monkeypatch):
    import numpy as np

    monkeypatch.setattr(Q._Grams, "BITS", 3)
    words = ["abcdefghij", "aab", "日本語"]
    found, (n,) = Q._Grams(words).sums(np.array([2, 3, 5]))
    want = collections.Counter()
    for w, times in zip(words, (2, 3, 5), strict=True):
        for g in Q.grams_of(w):
            want[g] += times
    assert dict(zip(found, n.tolist(), strict=True)) == want


def test_gram_column_is_the_same(spark):
    tokens = ["a", "Straße", "日本", "𝔘x", "!!"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert [r[0] for r in df.select(Q.gram_column(F.col("t"))).collect()] == [Q.grams_of(t) for t in tokens]


def test_kept_rows_have_all_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(130)], "doc_id long, quality int, toxic int")
    kept = collections.Counter((r["doc_id"], r["n_symbols"]) for r in Q.quality(df, labels).collect() if r["kept"])
    got = Q.keep_quality(df, labels)
    assert got.columns == df.columns
    found = collections.Counter((r["doc_id"], sum(len(t) + 1 for t in Q.TOKEN.findall(r["text"]))) for r in got.collect())
    assert found == kept and found[4, found and next(n for i, n in found if i == 4)] >= 1


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns with the names that the operators use inside come out as they went in."""
    from lodestone.llm.minhash import drop_near_duplicates
    from lodestone.llm.mixing import mixed_rows

    names = ["id", "_id", "hash", "_h", "h", "row", "_row", "_r", "mark", "copy", "_copy", "times", "_text", "key", "rows", "size", "taken", "range", "fp", "part", "model", "kept", "Hash"]
    rows = [(*r[:4], *[f"{c}{i}" for c in names]) for i, r in enumerate(corpus(n=40)) if r[0] is not None]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
        labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
        for out in (Q.keep_quality(df, labels), drop_near_duplicates(df, percent=80, size=5), mixed_rows(df)):
            assert out.columns == df.columns
            found = out.collect()
            assert found and {tuple(r) for r in found} <= set(rows)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_rare_languages_keep_clean_documents(spark):
    rng = random.Random(7)
    clean = lambda lang: " ".join(rng.choice(WORDS[lang]) for _ in range(100)) + "."
    rows = [(i, clean("en"), "en") for i in range(400)] + [(1000 + i, clean("de"), "de") for i in range(40)] + [(2000 + i, clean("de"), None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(400), *range(1000, 1005), *range(2000, 2003)]], "doc_id long, quality int, toxic int")
    got = Q.quality(df, labels).toPandas()
    assert got["kept"].mean() > 0.95 and got[got.lang == "de"]["kept"].mean() > 0.9


def test_empty_tables(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.quality(df.limit(0), labels).count() == 0 and Q.keep_quality(df.limit(0), labels).count() == 0
    untrained = Q.quality(df, labels.limit(0)).collect()
    assert all(r["kept"] == (r["n_symbols"] > 0) for r in untrained) and len(untrained) == df.count()
