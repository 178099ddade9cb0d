"""Each operator against a plain version on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import base64
import collections
import hashlib
import random
import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string"


def make(spark, n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Omega", "it's", "x,", "été", "end."]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 3, 20, 60]))]
        text = " ".join(words).replace(" Omega1", "\nOmega1 \n shared line\n")
        rows.append((i, None if i == 7 else text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None, "Z"]), 0, 3, "k"))
    rows.append((n, rows[3][1], "en", "a", 0, 3, "k"))
    rows += [(100 + i, "same words in every one of these copies " + ("x" if i % 2 else "x"), "en", "a", 0, 3, "k") for i in range(15)]
    rows.append((200, " ".join(f"word{j}" for j in range(30000)), "en", "b", 0, 3, "k"))
    return spark.createDataFrame(rows, DOCS), rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_warc_round_trip(spark):
    from lodestone.llm.shared import new_path
    from lodestone.llm.warc import round_trip

    rows = [(1, "http://a", "<p>é</p>", 1), (2, "http://b", "<p>é</p>", 1), (3, None, None, 1), (4, "u v", "", 1), (5, "http://c", "<i>\r\n\r\n</i>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    got = {r["page_id"]: r for r in round_trip(pages, new_path(spark, "t"), keep_payload=True).collect()}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: got[i]["refers_to"] for i in got} == {1: 2, 2: None, 3: 4, 4: None, 5: None}
    assert got[1]["record_type"] == "revisit" and bytes(got[5]["payload"]) == b"<i>\r\n\r\n</i>"
    assert round_trip(pages.limit(0), new_path(spark, "t")).count() == 0


def test_zip_is_readable_by_others(tmp_path):
    import io
    import zipfile

    from lodestone.llm.zipfiles import ZipWriter, members

    for zip64 in (False, True):
        out = io.BytesIO()
        z = ZipWriter(out, zip64)
        for name in ("a", "dir/é"):
            z.start(name)
            z.write(b"hello ")
            z.write(name.encode())
            z.finish()
        z.close()
        assert zipfile.ZipFile(out).read("dir/é") == "hello dir/é".encode()
        for name, method, at, size in members(out, len(out.getvalue())):
            assert method == 0 and out.getvalue()[at : at + size] == b"hello " + name.encode()
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as f:
        f.writestr("x", "y" * 10)
        f.comment = b"a comment"
    assert [(n, s) for n, _, _, s in members(other, len(other.getvalue()))] == [("x", 10)]


def test_near_duplicates_against_all_pairs(spark):
    from lodestone.llm.minhash import near_duplicates

    rng = random.Random(4)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(150):
        words = list(base) if i % 3 else [f"u{i}_{j}" for j in range(rng.randrange(12))]
        for _ in range(rng.randrange(5)):
            if len(words) > 2:
                words[rng.randrange(len(words))] = f"z{rng.randrange(60)}"
        rows.append((i, " ".join(words).upper() if i % 2 else "\t".join(words), "x", i))
    rows += [(500, None, "x", 1), (501, " \n", "x", 1), (502, None, "x", 1)]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string, label int")).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {i: got[i]["component_id"] for i in got} == {i: top(i) for i in sets}
    assert {i: got[i]["n_shingles"] for i in got} == {i: len(s) for i, s in sets.items()}


def test_mixing_budgets(spark, docs):
    from lodestone.llm.mixing import mix

    df, rows = docs
    got = mix(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    per = got.fillna({"source": "~"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (per["size"] == per["own"]).all() and ((per["taken"] - per["target"]).abs() <= 1).all()
    assert per["target"].sum() == pytest.approx(1.5 * got["size"].sum())
    assert mix(df).exceptAll(mix(df)).count() == 0
    assert mix(empty(spark)).count() == 0


def test_token_counts_and_files(spark, docs):
    import numpy as np
    from tokenizers import Tokenizer

    from lodestone.llm.queries import tokenizer_path
    from lodestone.llm.shared import new_path
    from lodestone.llm.token_counts import token_counts
    from lodestone.llm.token_files import read_token_files, write_token_files

    df, rows = docs
    rows = [*rows, (300, "a  b\n\n c <|endoftext|> d\t", "en", "a", 0, 3, "k")]
    df = spark.createDataFrame(rows, DOCS)
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    got = {r["doc_id"]: r for r in token_counts(df, tokenizer_path()).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {r[0]: (len((r[1] or "").encode()), len(ids[r[0]]), len(ids[r[0]]) > 1024) for r in rows}
    out = new_path(spark, "t")
    files = {r["doc_id"]: r for r in read_token_files(write_token_files(df, tokenizer_path(), out, part_tokens=500), out).collect()}
    start = 0
    for i in sorted(ids):
        whole = np.array([*ids[i], 0], "<u4")
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)
    assert token_counts(empty(spark), tokenizer_path()).count() == 0
    pieces = token_counts(df.limit(3), tokenizer_path("piece_bpe_32k.model")).count()
    assert pieces == 3


def test_pretokens_are_exact():
    from lodestone.llm.pretokens import PretokenEncoder
    from lodestone.llm.queries import tokenizer_path

    e, rng = PretokenEncoder(tokenizer_path(), len, sum, limit=50), random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice("  \n\n\t\r\x1c\x85\xa0 aAbé1'.,!<|endoftext|>ß日\0") for _ in range(rng.randrange(20)))
        assert e.value(s) == len(e.tok.encode(s, add_special_tokens=False).ids), repr(s)


def test_ids_of_many_texts_are_exact_and_take_one_call():
    from lodestone.llm.pretokens import PieceIds
    from lodestone.llm.queries import tokenizer_path

    rng = random.Random(3)
    texts = ["".join(rng.choice("  \n\n\t\r\x1c\x85\xa0 aAbé1'.,!<|endoftext|>ß日\0\1") for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "a<|endoftext|>b", "x" * 500, "\U0001f600 a\u0301b", *["".join(rng.choices("abcé", k=5)) + ", b" for _ in range(2000)]]
    for limit, most_chars in ((60, 200), (1, 50), (500_000, 1 << 20)):
        e = PieceIds(tokenizer_path(), limit)
        for _ in range(2):
            for text, ids in zip(texts, e.of_texts(texts, most_chars), strict=True):
                assert ids.tolist() == e.tok.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert len(PieceIds(tokenizer_path()).numbers) == 0 and not list(e.of_texts([]))

    calls, e = [], PieceIds(tokenizer_path())

    class Counted:
        def encode_batch_fast(self, inputs, **how):
            calls.append(len(inputs[0]))
            return e.single.tok.encode_batch_fast(inputs, **how)

    e.tok = Counted()
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    for _ in range(2):
        assert len(list(e.of_texts([" ".join(words[i : i + 100]) + "." for i in range(0, 600, 10)]))) == 60
    assert len(calls) == 1 and calls[0] < 800
    # a vocabulary whose bytes don't add up is asked for each piece
    e.tok, e.n_bytes = e.single.tok, e.n_bytes * 0
    assert [x.tolist() for x in e.of_texts(["new words"])] == [e.tok.encode("new words", add_special_tokens=False).ids]


def test_learned_partitions_recall(spark):
    import numpy as np

    from lodestone.llm.learned_partitions import search

    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(20, size=1200)] + 0.3 * rng.standard_normal((1200, 16))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0], 1), (5, x[5].tolist(), 1)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int"), "vec_id % 50 = 0").toPandas()
    n, hit = np.linalg.norm(x, axis=1), 0
    for q in range(0, 1200, 50):
        s = (x * x[q]).sum(1) / (n * n[q])
        s[q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and mine["score"].to_numpy() == pytest.approx(s[mine["vec_id"]], abs=1e-12)
        hit += len(set(np.lexsort((np.arange(1200), -s))[:5]) & set(mine["vec_id"]))
    assert hit / (24 * 5) >= 0.9
    assert got[got.query_id == 100].sort_values("rank")["vec_id"].tolist() == [101, 102, 103, 104, 105]


def test_sharding_against_plain(spark, docs):
    from lodestone.llm.sharding import shard

    df, rows = docs
    got = {r["doc_id"]: r for r in shard(df).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    order = []
    for source, members in by.items():
        for i, (key, doc_id) in enumerate(sorted(members), 1):
            order.append(((2 * i - 1) / (2 * len(members)), source is None, source or "", key, doc_id))
    for i, (*_, doc_id) in enumerate(sorted(order)):
        s = i * 16 // len(rows)
        assert (got[doc_id]["shard"], got[doc_id]["slot"]) == (s, i - -(-s * len(rows) // 16))
    for r in rows:
        assert (got[r[0]]["size"], got[r[0]]["text_crc32"]) == (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))
    assert shard(empty(spark)).count() == 0


def test_line_dedup_both_ways_and_reversible(spark, docs):
    from lodestone.llm import line_dedup as L

    df, rows = docs
    counts = collections.Counter(k for r in rows for k in {L.line_key(x) for x in (r[1] or "").encode().split(b"\n")} if k)
    want = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if counts[L.line_key(x.encode())] < 10]
        want[r[0]] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    for most in (64 << 20, 0):
        got = L.drop_frequent_lines(df, broadcast_bytes=most).collect()
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == want
    assert any(n for _, n, _ in want.values())
    assert L.drop_frequent_lines(empty(spark)).count() == 0


def test_cuckoo_filter_deletes():
    import numpy as np

    from lodestone.llm.cuckoo import CuckooFilter

    keys = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    f = CuckooFilter.of(keys[:2000])
    assert f.contains(keys[:2000]).all() and f.contains(keys[2000:]).mean() < 0.01
    f.delete(keys[:1000])
    assert f.contains(keys[1000:2000]).all() and f.contains(keys[:1000]).mean() < 0.01


def test_decontamination_against_all_places(spark):
    import numpy as np

    from lodestone.llm import decontaminate as D

    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(3, 30)))) for i in range(20)] + [(50, None), (51, "one two")]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(80)))) for i in range(40)] + [(900, None), (901, "")]
    for i in range(40):
        w = items[i % 20][1].split()
        for _ in range(rng.randrange(len(w) // 5 + 2)):
            w[rng.randrange(len(w))] = "edited"
        docs.append((100 + i, docs[i][1] + " " + ", ".join(w).upper() + "! " + docs[i][1]))
    want = {}
    for doc_id, text in docs:
        for item_id, item in items:
            a, b = D.words(item), D.words(text)
            if len(a) >= 5:
                names = {x: k for k, x in enumerate({*a, *b})}
                d, _ = D.closest(np.array([names[x] for x in a]), np.array([names[x] for x in b], int))
                if d <= len(a) // 5:
                    want[doc_id, item_id] = d
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in D.contamination(df, bench).collect()} == want
    assert {r["doc_id"] for r in D.drop_contaminated(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_pipeline_runs_on_small_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
