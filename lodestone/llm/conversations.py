"""Repair of damaged conversations by the cheapest edits that make roles alternate.

One range sort puts every conversation in order; its turns are held in blocks of bounded size. A conversation that is one block is repaired by itself.
Of a longer one, or one cut by two ranges, each block gives the least cost from each state before it to each state
after it; these are chained over the conversation's blocks backwards, and the states really taken forwards, so no task holds more than a block.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.llm.shared import cut, release, small

BLOCK_TURNS, BLOCK_CHARS = 4096, 4_000_000
#: States: the role kept last (none yet, system, user, assistant).
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
NO = 1 << 50
#: Turns to insert between a kept role and the next; and after the last.
GAP = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END = [2 * len(CLOSING[r]) for r in range(4)]
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}

_FACTS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns_seen long, low_turn long, high_turn long"
_EDITS = "cost long, edits array<struct<edit:string, role:string, text:string>>"
_visible = re.compile(r"[^\x20\x09-\x0D]")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32('conv_id:turn') % 20; null parts of the key, roles and texts are read as one space.

    0 drops the row, 1 empties its text, 2 removes the text's ``[.!?]``, 3 repeats the row, 4 sets its role to user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.select("conv_id", "turn", "role", "text")


def fault(text: str, seen: bool) -> int:
    """The first fault of a turn: blank, duplicate, truncated, or none."""
    shown = text.rstrip(" \t\n\v\f\r")
    return BLANK if not shown else DUPLICATE if seen else SOUND if shown[-1] in ".!?" else TRUNCATED


def codes_of(roles: list[str], texts: list[str], repeated: set[int] | None = None) -> list[tuple[int, int]]:
    """State and fault of each turn; ``repeated`` are the places of duplicates, found here if not given."""
    if repeated is None:
        known: set = set()
        repeated = set()
        for i, turn in enumerate(zip(roles, texts, strict=True)):
            if turn in known:
                repeated.add(i)
            known.add(turn)
    return [(INITIALS.get(role[:1], START), fault(text, i in repeated)) for i, (role, text) in enumerate(zip(roles, texts, strict=True))]


def plan(codes: list[tuple[int, int]], after: list[int]) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Least costs from each state before the turns, and for each place and state the turn retained next and its state.

    ``after`` holds the costs of what follows for each state. A retained turn costs nothing, 2 if its role is changed, and 1 more if
    truncated. The gap between two retained turns costs what prefix sums of deletions say, and 2 for each insert
    that the two roles ask for. From right to left, ``least`` holds for each role the least, over the turns seen, of the deletions before a turn plus all
    from it on; so each turn looks at three running minima, not at all later turns. Among equal costs the audit that is
    least in ASCII wins: the longest run of D, then I, K, R; that is no turn at all, the last turn, one with an insert, one kept.
    """
    n = len(codes)
    least: dict[int, tuple[int, int, int]] = {}
    from_here = list(after)
    steps: list[list[tuple[int, int]]] = [[]] * n
    for j in range(n - 1, -1, -1):
        state, kind = codes[j]
        if kind in (SOUND, TRUNCATED):
            own = 1 if kind == TRUNCATED else 0
            for role in (SYSTEM, USER, ASSISTANT):
                if role == state or role != SYSTEM:
                    cost = 3 * j + own + (0 if role == state else 2) + from_here[role]
                    if role not in least or cost < least[role][0]:
                        least[role] = (cost, j, 0 if role == state else 1)
        step, costs = [], []
        for r in range(4):
            best, found = (after[r] + 3 * n, -n, 0, 0), (n, r)
            for role, (cost, at, changed) in least.items():
                if (r, role) in GAP:
                    inserts = GAP[r, role]
                    offer = (cost + 2 * inserts, -at, -inserts, changed)
                    if offer < best:
                        best, found = offer, (at, role)
            step.append(found)
            costs.append(min(best[0] - 3 * j, NO))
        steps[j], from_here = step, costs
    return from_here, steps


def walk(codes: list[tuple[int, int]], steps: list[list[tuple[int, int]]], state: int) -> tuple[list[tuple[int, str, int]], int]:
    """The edits of turns entered in ``state``, as (place, letter, role), and the state left in."""
    edits, at, n = [], 0, len(codes)
    while at < n:
        to, role = steps[at][state]
        edits += [(i, DELETE, 0) for i in range(at, to)]
        if to == n:
            return edits, state
        if GAP[state, role]:
            edits.append((to, INSERT, USER if role == ASSISTANT else ASSISTANT))
        edits.append((to, KEEP if codes[to][0] == role else REROLE, role))
        at, state = to + 1, role
    return edits, state


def _cost(edits: list[tuple[int, str, int]], codes: list[tuple[int, int]]) -> int:
    price = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
    return sum(price[letter] + (letter in (KEEP, REROLE) and codes[i][1] == TRUNCATED) for i, letter, _ in edits)


def _facts(turns: list, roles: list[str], codes: list[tuple[int, int]]) -> tuple:
    kinds = [kind for _, kind in codes]
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    known = [t for t in turns if t is not None]
    low, high = (min(known), max(known)) if known else (None, None)
    return kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED), illegal, roles[0][:1], roles[-1][:1], low, high, len(set(known)), turns[0], turns[-1]


def _written(edits: list[tuple[int, str, int]], roles: list[str], texts: list[str]) -> list[dict]:
    """Edits as they are given out: a kept or deleted turn as it was, a new role, an inserted turn with an empty text."""
    return [{"edit": letter, "role": NAMES[role] if letter in (INSERT, REROLE) else roles[i], "text": "" if letter == INSERT else texts[i]} for i, letter, role in edits]


def _batches_of(rows, schema, most: int = 256):
    """Record batches of an iterator of tuples, ``most`` rows or about 8 MB of text at a time."""
    import pyarrow as pa

    held, weight = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row, chars in rows:
        held.append(row)
        weight += chars
        if len(held) >= most or weight >= 8_000_000:
            yield made()
            held, weight = [], 0
    if held:
        yield made()


def _mapped(df: DataFrame, rows, fields: list) -> DataFrame:
    """``df`` with each partition's rows, as dicts, turned by ``rows`` into (tuple, characters) of the ``fields``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        yield from _batches_of(rows(row for batch in batches for row in batch.to_pylist()), arrow)

    return df.mapInArrow(run, schema)


def _fields(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl).fields)


def turn_blocks(turns: DataFrame) -> DataFrame:
    """conv_id, part, block, whole, turns, roles, texts: each conversation in order, in blocks of up to 4,096 turns, written to the shared folder.

    Turns are ordered by turn, null first, then by a hash of role and text, so equal rows lie together. The range sort's key has a running number
    last, which spreads even rows alike in all columns over several ranges. Blocks are in the order of (part, block), which names a block.
    ``whole``: the conversation is surely this block alone; a first or last one of a range may go on in another.
    """
    from pyspark import TaskContext

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumns({"tie": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), "salt": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "tie", "salt"]
    ranges = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")

    def blocks(found):
        part, block, run, conv, first = TaskContext.get().partitionId(), 0, [], None, True
        size, pieces = 0, 1
        for row in found:
            new = run and row["conv_id"] != conv
            if new or len(run) >= BLOCK_TURNS or size >= BLOCK_CHARS:
                yield block_row(conv, part, block, bool(new) and not first and pieces == 1, run), size
                block, first, pieces = block + 1, first and not new, 1 if new else pieces + 1
                run, size = [], 0
            conv = row["conv_id"]
            run.append(row)
            size += len(row["text"])
        if run:
            yield block_row(conv, part, block, False, run), size

    def block_row(conv, part, block, whole, run):
        return conv, part, block, whole, [r["turn"] for r in run], [r["role"] for r in run], [r["text"] for r in run]

    made = _mapped(rows, blocks, [rows.schema["conv_id"], *_fields("part int, block int, whole boolean, turns array<long>, roles array<string>, texts array<string>")])
    return cut(made, "conv-blocks")


def repair(turns: DataFrame) -> DataFrame:
    """Blocks of edits that repair conversations: conv_id, part, block, whole, cost, edits (edit, role, text in order) and facts of the turns before.

    A turn's first fault counts: blank (only white space), duplicate (role and text were there earlier in the conversation), truncated (its last
    character other than white space isn't one of ``.!?``). Edits: keep (K) costs 0, a new role, user or assistant (R), 2, deletion (D) 3, inserting an empty user
    or assistant turn (I) 2; blank and duplicate turns must go, and a truncated turn that stays costs 1 more. The edits are the
    cheapest that give roles whose initials are ``(s?(ua)+)?``; among these the ones whose letters are least in ASCII.

    Turns are taken by turn, nulls first; rows of one turn in the order of a hash of role and text. Null roles and texts are one space; a null
    conv_id is a conversation. A role whose initial isn't s, u or a can't be kept. An empty table gives no rows; further columns are not read.
    """
    blocks = turn_blocks(turns)
    conv = blocks.schema["conv_id"]
    result = [conv, *_fields("part int, block int, whole boolean"), *_fields(_EDITS), *_fields(_FACTS)]

    def alone(rows):
        for b in rows:
            codes = codes_of(b["roles"], b["texts"])
            edits, state = walk(codes, plan(codes, END)[1], START)
            yield finished(b, codes, edits, state, True)

    def finished(b, codes, edits, state, last):
        if last:
            edits = edits + [(len(codes), INSERT, role) for role in CLOSING[state]]
        row = (b["conv_id"], b["part"], b["block"], b["whole"], _cost(edits, codes), _written(edits, b["roles"], b["texts"]), *_facts(b["turns"], b["roles"], codes))
        return row, sum(map(len, b["texts"]))

    whole = _mapped(blocks.where("whole"), alone, result)
    parts = blocks.where("not whole")
    place = ["part", "block"]

    # Duplicates of a conversation in several blocks.
    each = parts.select("conv_id", *place, F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "t"))
    each = each.select("conv_id", F.struct(*place, "at").alias("at"), F.unhex(F.md5(F.concat(F.length("t.roles").cast("string"), F.lit(":"), "t.roles", "t.texts"))).alias("key"))
    firsts = each.groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    firsts = cut(firsts.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first"), "conv-firsts")
    later = each.join(small(firsts), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where("at > first")
    later = later.groupBy("at.part", "at.block").agg(F.collect_list("at.at").alias("repeated"))

    def coded(rows):
        for b in rows:
            codes = codes_of(b["roles"], b["texts"], set(b["repeated"] or ()))
            columns = [plan(codes, [0 if r == s else NO for r in range(4)])[0] for s in range(4)]
            yield (b["conv_id"], b["part"], b["block"], [s for s, _ in codes], [k for _, k in codes], [columns[s][r] for r in range(4) for s in range(4)]), len(codes)

    codes = cut(_mapped(parts.join(later, place, "left"), coded, [conv, *_fields("part int, block int, states array<int>, faults array<int>, costs array<long>")]), "conv-codes")

    def ends(rows):  # from the last block of a conversation to its first
        held, costs, before = object(), None, END
        for b in rows:
            last = b["conv_id"] != held
            held = b["conv_id"]
            before = END if last else [min(costs[4 * r + s] + before[s] for s in range(4)) for r in range(4)]
            costs = b["costs"]
            yield (b["part"], b["block"], before, last), 1

    chain = codes.select("conv_id", *place, "costs").repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.desc("part"), F.desc("block"))
    exits = cut(_mapped(chain, ends, _fields("part int, block int, after array<long>, last boolean")), "conv-exits")

    def crossing(rows):
        for b in rows:
            c = list(zip(b["states"], b["faults"], strict=True))
            steps = plan(c, b["after"])[1]
            yield (b["conv_id"], b["part"], b["block"], [walk(c, steps, s)[1] for s in range(4)]), 1

    crossed = _mapped(codes.join(exits, place), crossing, [conv, *_fields("part int, block int, leaves array<int>")])

    def entered(rows):
        held, state = object(), START
        for b in rows:
            state = START if b["conv_id"] != held else state
            held = b["conv_id"]
            yield (b["part"], b["block"], state), 1
            state = b["leaves"][state]

    chain = crossed.repartition("conv_id").sortWithinPartitions("conv_id", *place)
    entries = cut(_mapped(chain, entered, _fields("part int, block int, entry int")), "conv-entries")

    def edited(rows):
        for b in rows:
            c = list(zip(b["states"], b["faults"], strict=True))
            edits, state = walk(c, plan(c, b["after"])[1], b["entry"])
            yield finished(b, c, edits, state, b["last"])

    found = parts.join(codes.drop("conv_id", "costs"), place).join(exits, place).join(entries, place)
    mended = cut(whole.unionByName(_mapped(found, edited, result)), "conv-edits")
    release(blocks, firsts, codes, exits, entries)
    return mended


def repair_report(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations`` from the blocks of ``repair``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: last turn - first turn + 1 - distinct turns, nulls aside (all null: 0). illegal: neighbours whose initials aren't su, ua or au. audit: the letters of
    all edits. repaired_sha256: of ``role:text`` of the repaired turns, joined by newlines. Conversations without turns have
    zeros, an empty audit and the hash of the empty string. A conversation in several blocks is hashed in order as a stream.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns_seen"), F.lit(0))
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != DELETE), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    digest = F.sha2(F.array_join(lines, "\n"), 256)
    whole = edits.where("whole").select("conv_id", gaps.alias("gaps"), *counts, F.array_join("edits.edit", "").alias("audit"), digest.alias("repaired_sha256"))

    parts = edits.where("not whole")
    order = Window.partitionBy("conv_id").orderBy("part", "block")
    pair = F.concat(F.lag("last").over(order), "first")
    seams = parts.drop("edits").withColumns({"seam": F.when(pair.isin(*LEGAL), 0).otherwise(F.when(pair.isNull(), 0).otherwise(1)), "shared": F.when(F.lag("high_turn").over(order) == F.col("low_turn"), 1).otherwise(0)})
    sums = seams.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("turns_seen") - F.sum("shared")).alias("turns_seen"),
        *[F.sum(c).alias(c) for c in counts if c != "illegal"], (F.sum("illegal") + F.sum("seam")).alias("illegal"),
    )

    def hashed(rows):
        held, audit, digest, first = object(), [], None, True
        for b in rows:
            if b["conv_id"] != held:
                if digest is not None:
                    yield (held, "".join(audit), digest.hexdigest()), 1
                held, audit, digest, first = b["conv_id"], [], hashlib.sha256(), True
            audit.append("".join(e["edit"] for e in b["edits"]))
            for e in b["edits"]:
                if e["edit"] != DELETE:
                    digest.update(("" if first else "\n").encode() + f"{e['role']}:{e['text']}".encode())
                    first = False
        if digest is not None:
            yield (held, "".join(audit), digest.hexdigest()), 1

    stream = parts.select("conv_id", "part", "block", "edits").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    texts = _mapped(stream, hashed, [edits.schema["conv_id"], *_fields("audit string, repaired_sha256 string")]).withColumnRenamed("conv_id", "c")
    long = sums.join(texts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", gaps.alias("gaps"), *counts, "audit", "repaired_sha256")

    known = conversations.select("conv_id").distinct()
    all_rows = whole.unionByName(long).withColumnRenamed("conv_id", "c")
    joined = known.join(all_rows, F.col("conv_id").eqNullSafe(F.col("c")), "left").na.fill(0, ["gaps", *counts]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
