"""Nulls, repeated rows and ids, empty tables, long texts and hot groups of the operators and of the pipeline's stages."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

BIG = 2**60 + 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, label int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", s, 0, "k", 1) for i, t, s in pairs], DOCS)


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def linked_groups(texts, percent):
    """The smallest index that links reach from each text, by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


def test_near_duplicates_of_odd_ids(spark):
    from lodestone.llm.minhash import near_duplicates

    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    long = " ".join(f"w{i}" for i in range(40_000))
    df = docs_of(spark, [(BIG, a, "s"), (None, a, "s"), (BIG + 1, a.upper(), "s"), (1, a, "s"), (1, b, "s"), (2, b, "s"), (2, b, "s"), (7, long, "s"), (8, long + " end", "s"), (9, None, "s")])
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == collections.Counter([(BIG, 2, 1, False), (None, 2, None, True), (BIG + 1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (7, 39_996, 7, True), (8, 39_997, 7, False), (9, 0, 9, True)])
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bands", [(1, 1), (20, 1)])
def test_open_buckets_join_components_across_blocks(spark, monkeypatch, bands):
    """With a row a band and short sets most documents share buckets, so the first members decide little."""
    from lodestone.llm import minhash as M

    real = M._met
    monkeypatch.setattr(M, "_met", lambda rows, block, held: real(rows, 3, held))
    rng, texts = random.Random(6), []
    for i in range(60):
        words = [f"c{i % 4}_{j}" for j in range(30)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(30)] = f"z{rng.randrange(9)}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), percent=60, bands=20, rows=1, agreement=0.0).collect()}
    assert [got[i] for i in range(60)] == linked_groups(texts, 60)


def test_near_dedup_stage_against_all_pairs(spark):
    import corpus_pipeline as P

    rng, texts = random.Random(8), []
    for i in range(80):
        words = [f"c{i % 11}_{j}" for j in range(80)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"z{rng.randrange(40)}"
        texts.append(" ".join(words))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    group = linked_groups(texts, 80)
    df = docs_of(spark, [*rows, rows[0], (None, texts[0], "s"), (500, None, "s"), (501, "", "s")])
    got = P.near_dedup(spark, df, "")
    assert got.columns == P.COLUMNS
    want = [(i, t) for i, t in enumerate(texts) if group[i] == i] + [(None, texts[0]), (500, None), (501, "")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter(want)
    assert P.near_dedup(spark, df.limit(0), "").count() == 0


def test_mixing_of_repeated_and_null_ids(spark):
    import corpus_pipeline as P
    from lodestone.llm.mixing import mix

    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(40)] + [(None, "x y z", "a")] * 3 + [(None, "other", None), (5, "again and again", "a"), (5, "again and again", "a"), (BIG, "big", "b"), (77, None, "a"), (78, "", "b")]
    df = docs_of(spark, rows)
    got = mix(df).toPandas()
    assert len(got) == len(rows)
    for source, part in got.groupby(got["source"].fillna("~")):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 1 and (part["taken"] <= 2 * part["size"]).all()
    # the stage: whole documents, as the plain rule takes them in the operator's order
    want = collections.Counter()
    for r in mix(df, whole_documents=True).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"] if r["size"] else 0
    out = P.mixing(spark, df, "")
    seen = collections.Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in out.collect())
    assert out.columns == P.COLUMNS and {k: n for k, n in want.items() if n} == dict(seen)
    assert (None, "a", 3) in seen and P.mixing(spark, df.limit(0), "").count() == 0


def test_whole_document_mix_against_plain(spark):
    from lodestone.llm.mixing import mix

    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(9), rng.choice(["a", "a", "b", None])) for i in range(200)]
    got = {r["doc_id"]: r for r in mix(docs_of(spark, rows), whole_documents=True).collect()}
    by = collections.defaultdict(list)
    for i, text, source in rows:
        by[source].append((hashlib.md5(f"42:{i}".encode()).hexdigest(), i, len(text.split())))
    for members in by.values():
        total, budget, before = sum(n for *_, n in members), int(got[members[0][1]]["target"] + 0.5), 0
        for _, i, n in sorted(members):
            left = budget % total - before
            assert got[i]["taken"] == budget // total * n + (n if 2 * left >= n else 0)
            before += n


def test_sharding_of_repeated_and_null_ids(spark):
    from lodestone.llm.sharding import shard

    rows = [(None, "same", "a")] * 30 + [(3, "same", "b")] * 20 + [(BIG, None, None), (1, "x" * 100_000, "a")]
    got = shard(docs_of(spark, rows), 4).toPandas()
    assert len(got) == len(rows) and sorted(got.groupby("shard").size()) == [13] * 4
    assert all(sorted(p["slot"]) == list(range(len(p))) for _, p in got.groupby("shard"))
    assert got.loc[got["size"] == 100_001, "text_crc32"].tolist() == [zlib.crc32(b"x" * 100_000)]


def test_tokens_of_odd_ids(spark):
    from tokenizers import Tokenizer

    from lodestone.llm.queries import tokenizer_path
    from lodestone.llm.shared import new_path
    from lodestone.llm.token_counts import token_counts
    from lodestone.llm.token_files import read_token_files, write_token_files

    rows = [(None, "a b", "s"), (BIG, "a\n\nb  c", "s"), (3, "x", "s"), (3, "x", "s"), (3, "y z", "s"), (None, None, "s"), (4, "word " * 50_000, "s")]
    df = docs_of(spark, rows)
    tok = Tokenizer.from_file(tokenizer_path())
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    got = token_counts(df, tokenizer_path()).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == collections.Counter((i, len(x)) for i, x in ids)
    out = new_path(spark, "t")
    files = read_token_files(write_token_files(df, tokenizer_path(), out), out, with_ids=True).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in files) == collections.Counter((i, (*x, 0)) for i, x in ids)
    at = 0
    for r in sorted(files, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(files, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    out = new_path(spark, "t")
    assert token_counts(df.limit(0), tokenizer_path()).count() == 0 and read_token_files(write_token_files(df.limit(0), tokenizer_path(), out), out).count() == 0


def test_warc_of_odd_pages(spark):
    from lodestone.llm.shared import new_path
    from lodestone.llm.warc import round_trip

    big = "é" * 300_000
    rows = [(BIG, "u", "one", 1), (None, "u", "one", 1), (7, "u", big, 1), (7, "u", big, 1), (8, "u", big, 1), (9, "u", "nine", 1), (9, "v", "other", 1), (None, None, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in round_trip(pages, new_path(spark, "t")).collect())
    assert got == collections.Counter([(BIG, 3, "response", None), (None, 3, "revisit", BIG), (7, 600_000, "revisit", 8), (7, 600_000, "revisit", 8), (8, 600_000, "response", None), (9, 4, "response", None), (9, 5, "response", None), (None, 0, "response", None)])


def test_learned_partitions_in_two_levels_and_small_tables(spark):
    from lodestone.llm import learned_partitions as L

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 12))
    x = centres[rng.integers(40, size=3000)] + 0.3 * rng.standard_normal((3000, 12))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, part int")
    tree = L.learned_tree(L.usable(df), 600, 0.985, 200, 3)
    assert len(tree.levels) == 2 and len(tree.levels[1]) > 1
    got = L.search(df, "vec_id % 50 = 0", sample_rows=600, leaf_rows=200).toPandas()
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q]["vec_id"]))
    assert hit / 300 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in L.search(few, "vec_id % 50 = 0").collect()}
    assert rows == {(0, 1): (1, 0.707107), (0, 2): (2, 0.0)}
    assert L.search(few.limit(0), "vec_id % 50 = 0").count() == 0


def test_line_state_follows_documents(spark):
    from lodestone.llm import line_dedup as L

    rng = random.Random(2)
    make = lambda ids: docs_of(spark, [(i, "\n".join(rng.choice(["a line", "b", " A LINE ", "c%d" % rng.randrange(30), ""]) for _ in range(6)), "s") for i in ids])
    old, new, odd = make(range(60)), make(range(100, 160)), docs_of(spark, [(None, "b\nq", "s"), (BIG, None, "s"), (3, "x\n" * 5000, "s")])
    result = lambda df, state: collections.Counter(tuple(r) for r in L.drop_frequent_lines(df, state=state).collect())
    whole = lambda df: L.line_state(df)
    all_docs = old.union(new).union(odd)
    first = L.line_state(old)
    grown = L.updated_state(first, added=new.union(odd))
    assert result(all_docs, grown) == result(all_docs, whole(all_docs))
    back = L.updated_state(grown, deleted=new.union(odd))
    assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in first.counts.collect()} and result(old, back) == result(old, first)
    moved = L.updated_state(grown, deleted=old)
    assert result(new, moved) == result(new, whole(new.union(odd)))
    assert result(all_docs.limit(0), L.line_state(all_docs.limit(0))) == collections.Counter()


def test_decontamination_of_odd_tables(spark):
    from lodestone.llm import decontaminate as D

    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([6, 15, 40, 120])))) for i in range(12)]
    items += [(20 + n, " ".join(f"short{n}of{i}" for i in range(n))) for n in (1, 2, 3, 4)]  # these match exactly only
    docs = [(None, "x " + items[0][1]), (BIG, items[1][1].upper()), (3, None), (4, ""), (5, "y " * 20_000 + items[2][1])]
    for i, (_, text) in enumerate(items):
        w = text.split()
        for _ in range(len(w) // 5):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 else ["new"]
        docs.append((100 + i, "z " * 9 + " ".join(w) + " z"))
        docs.append((200 + i, "z " * 3 + text + " z"))
    want = {}
    for doc_id, text in docs:
        for item_id, item in items:
            a, b = D.words(item), D.words(text)
            names = {x: k for k, x in enumerate({*a, *b})}
            d, _ = D.closest(np.array([names[x] for x in a]), np.array([names[x] for x in b], int))
            if d <= len(a) // 5:
                want[doc_id, item_id] = d
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (None, items[0][1]), (60, None)], "item_id long, text string")
    for group_bytes in (8 << 20, 300):
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contamination(df, bench, group_bytes=group_bytes).collect()} == want
        kept = D.drop_contaminated(df, bench, group_bytes=group_bytes)
        assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == df.columns
    assert D.contamination(df.limit(0), bench).count() == 0 and D.contamination(df, bench.limit(0)).count() == 0 and D.drop_contaminated(df, bench.limit(0)).count() == len(docs)
    assert (None, 0) in want and (BIG, 1) in want


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from lodestone.llm.shared import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from lodestone.llm import minhash, ngram_quality
    from lodestone.llm.shared import keep_rows, small_batches

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(name)
    with pytest.raises(ValueError), small_batches(spark, 70):
        sizes = spark.range(1000).coalesce(1).mapInPandas(lambda bs: (b.assign(id=len(b)) for b in bs), "id long").distinct().collect()
        raise ValueError
    assert max(r["id"] for r in sizes) == 70 and spark.conf.get(name) == before

    def watch(module):
        plain = module.cut

        def cut(df, at):
            seen[at] = int(spark.conf.get(name))
            return plain(df, at)

        monkeypatch.setattr(module, "cut", cut)

    watch(ngram_quality)
    watch(minhash)
    df = docs_of(spark, [(i, f"some words of text number {i} and more", "s") for i in range(40)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert ngram_quality.quality(df, labels).count() == 40
    assert minhash.drop_near_duplicates(df, percent=80, size=5, bands=32, rows=4).count() >= 1
    assert [seen[x] for x in ("kn-grams", "kn-documents", "near-sketches")] == [2000] * 3 and spark.conf.get(name) == before

    def decider():
        def decide(batch):
            assert batch.num_rows <= 1000
            return [x % 2 == 0 for x in batch.column("id").to_pylist()]

        return decide

    assert sorted(r["id"] for r in keep_rows(spark.range(3500).coalesce(1), decider).collect()) == list(range(0, 3500, 2))


def test_only_windows_near_a_piece_of_an_item_are_walked(monkeypatch):
    from lodestone.llm import decontaminate as D

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 4, 5, 9, 15, 33, 59, 120] * 3)]
    items = D.Items(texts, 0.2, 1, 0.999, 11)
    walked, walks = [], D.walks
    monkeypatch.setattr(D, "walks", lambda symbols, starts, *a: walked.append(len(starts)) or walks(symbols, starts, *a))
    foreign = [" ".join(rng.choices(words, k=2000)) for _ in range(20)]  # the items' words in another order
    list(D._matches(items, foreign))
    assert sum(walked) < 0.1 * 40_000 * items.WALKS
    hidden = []
    for k, (_, text) in enumerate(texts):  # all pieces but one hold an edit
        w = text.split()
        n, d = len(w), len(w) // 5
        whole = rng.randrange(d + 1)
        for piece in {*range(d + 1)} - {whole}:
            w[rng.randrange(piece * n // (d + 1), (piece + 1) * n // (d + 1))] = "new"
        hidden.append(f"{foreign[k % 20]} {' '.join(w)} {foreign[-1 - k % 20]}")
    for chunk in (1 << 16, 500):
        monkeypatch.setattr(D, "CHUNK", chunk)
        found = {(t, k): d for t, k, d, _ in D._matches(items, hidden)}
        assert all(found[k, k] <= len(text.split()) // 5 for k, (_, text) in enumerate(texts))
