"""Divergence of sources against plain Python integers, in one tile and in many."""

import collections
import random
import re

import pytest

SCHEMA = "text string, lang string, source string, value string, rank int, n int"


def plain(rows, least, most):
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for (l, t), n in docs.items() if l == lang and n >= least)
        sources = sorted(s for l, s in groups if l == lang)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in sources}

        def share(c):
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: share(n[s]) for s in sources}
        q = share({t: sum(n[s][t] for s in sources) for t in kept})
        f = lambda a, b: (a - b) * (a - b) // b
        pairs = [(other, sum(f(p[source][t], p[other][t]) for t in kept)) for other in sources if other != source]
        terms = [(t, f(p[source][t], q[t])) for t in kept if n[source][t] > 0 and p[source][t] > q[t]]
        for part, found, cap in (("pair", pairs, len(pairs)), ("term", terms, most)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:cap])]
    return sorted(out)


def rows_of(seed, n=150):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "Été", "x1y", "don't", "日本", "delta"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "b", "c", None, "é"]), "v", 1, 1) for _ in range(n)]
    return [*rows, (None, "de", "only", "v", 1, 1), ("", "xx", "p", "v", 1, 1), ("12 34", "xx", "q", "v", 1, 1), (" ".join(words * 2000), "en", "b", "v", 1, 1), rows[0], rows[0]]


@pytest.mark.parametrize(("tile_terms", "tile_groups"), [(2048, 128), (12, 2)])
def test_divergence_equals_plain_integers(spark, monkeypatch, tile_terms, tile_groups):
    from lodestone.llm import divergence as operator

    monkeypatch.setattr(operator, "TILE_TERMS", tile_terms)
    monkeypatch.setattr(operator, "TILE_GROUPS", tile_groups)
    rows = rows_of(tile_terms)
    got = operator.divergence(spark.createDataFrame(rows, SCHEMA), 3, 10).collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 10)


def test_task_passes_on_what_it_holds(monkeypatch):
    import pyarrow as pa

    from lodestone.llm import divergence as operator

    batch = pa.RecordBatch.from_pylist([{"text": f"a b{chr(97 + i)} A", "lang": "x", "source": None} for i in range(9)])
    whole, found = pa.Table.from_batches(operator._count_terms([batch])), collections.Counter()
    monkeypatch.setattr(operator, "TASK_TERMS", 3)
    cut = list(operator._count_terms([batch]))
    for row in pa.Table.from_batches(cut).to_pylist():
        found[row["term"]] += row["n"]
    assert len(cut) > 1 and found == {r["term"]: r["n"] for r in whole.to_pylist()} and found["a"] == 18


def test_shares_are_exact_for_large_counts():
    import numpy as np

    from lodestone.llm.divergence import shares

    n, total, terms = [0, 1, 10**12, 4 * 10**15 - 1], 5 * 10**15 + 7, 10**6
    assert shares(np.array(n, np.int64), total, terms).tolist() == [1 + 10**9 * (c + 1) // (total + terms) for c in n]


def test_no_documents(spark):
    from lodestone.llm.divergence import divergence

    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
