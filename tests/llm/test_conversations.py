"""Repair of conversations against a plain search over all edits, in one block and in many."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, block int, edits string"
NEXT = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def damaged(rows):
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def cheapest(rows):
    """The least (cost, audit) that Dijkstra's search finds, with the counts of the contract."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        kinds.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "0", ())], set()
    while True:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "0A":
            break
        moves = [(2, "I", i, role, (role, "")) for role in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, turns))
            if kinds[i] in ("", "t"):
                moves += [(0 + len(kinds[i]), "K", i + 1, role, (role, text))] + [(2 + len(kinds[i]), "R", i + 1, to, (to, text)) for to in ("user", "assistant")]
        for price, letter, at, role, turn in moves:
            if (state, role[:1]) in NEXT:
                heapq.heappush(heap, (cost + price, audit + letter, at, NEXT[state, role[:1]], (*turns, turn)))
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()


def expected(rows):
    found = {r[0]: [] for r in rows}
    for row in damaged(rows):
        found[row[0]].append(row)
    return {conv: cheapest(turns) for conv, turns in found.items()}


def conversations(n, most, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", None, ""], ["Hi.", "Yes!", "no", "", None, " \n", "ok", "Why? ", "Ünd…"]
    for c in range(n):
        for t in range(rng.randrange(1, most)):
            yield (None if c == 3 else c, t if rng.random() < 0.9 else rng.choice([None, 2]), rng.choice(roles), rng.choice([*texts, f"x{rng.randrange(9)}."]), 1, "e")


@pytest.mark.parametrize(("block", "n", "most"), [(4096, 60, 12), (3, 40, 14), (64, 2, 900)])
def test_repair_is_the_cheapest(spark, monkeypatch, block, n, most):
    from lodestone.llm import conversations as operator

    monkeypatch.setattr(operator, "BLOCK_TURNS", block)
    rows = [*conversations(n, most, block), (1000, 1, "user", "word " * 60_000, 1, "e")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in operator.repair_report(operator.repair(operator.damage(table)), table).collect()}
    assert got == expected(rows)


def test_hot_conversation_of_equal_rows_is_cut_in_blocks(spark, monkeypatch):
    """A conversation that holds nearly all rows, alike in all columns, lies in several ranges."""
    from lodestone.llm import conversations as operator

    rows = [(7, None, "user", "again.", 1, "e")] * 3000 + [(8, 1, "assistant", "Fine.", 1, "e")]
    blocks = operator.turn_blocks(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert blocks.where("conv_id = 7").select("part").distinct().count() > 1
    edits = operator.repair(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: r for r in operator.repair_report(edits, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[7]["duplicate"], got[7]["cost"], len(got[7]["audit"])) == (2999, 2999 * 3 + 2, 3001)


def test_no_conversations(spark):
    from lodestone.llm.conversations import damage, repair, repair_report

    table = spark.createDataFrame([], SCHEMA)
    assert repair_report(repair(damage(table)), table).count() == 0
