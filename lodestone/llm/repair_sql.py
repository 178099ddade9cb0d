"""The SQL of conversation repair: a recursive walk over each conversation's turns with the cheapest edits so far for each state."""

from __future__ import annotations


def _step() -> tuple[str, str, str, str]:
    """The cheapest (cost, audit, turns) of each state after one more turn: none retained, and system, user or assistant retained last."""

    def option(state: str, cost: str, letters: str, lines: list[str], when: str) -> str:
        told = f"r.{state}.o"
        for i, line in enumerate(lines):
            told += (f" || CASE WHEN r.{state}.o = '' THEN '' ELSE chr(10) END" if i == 0 else " || chr(10)") + f" || {line}"
        return f"CASE WHEN r.{state} IS NOT NULL AND {when} THEN {{c: r.{state}.c + {cost}, a: r.{state}.a || '{letters}', o: {told}}} END"

    stays, cut = "t.kind IN (0, 3)", "CAST(t.kind = 3 AS INT)"

    def into(state: str, initial: str, name: str | None, sources: list[tuple[str, list[str]]]) -> str:
        found = [option(state, "3", "D", [], "TRUE")]
        for source, inserts in sources:
            price, letters = 2 * len(inserts), "I" * len(inserts)
            found.append(option(source, f"{price} + {cut}", letters + "K", [*inserts, "t.role || ':' || t.text"], f"{stays} AND t.ini = '{initial}'"))
            if name:
                found.append(option(source, f"{price} + 2 + {cut}", letters + "R", [*inserts, f"'{name}:' || t.text"], stays))
        return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1]"

    user, assistant = "'user:'", "'assistant:'"
    return (
        option("s0", "3", "D", [], "TRUE"),
        into("ss", "s", None, [("s0", [])]),
        into("su", "u", "user", [("s0", []), ("ss", []), ("sa", []), ("su", [assistant])]),
        into("sa", "a", "assistant", [("su", []), ("s0", [user]), ("ss", [user]), ("sa", [user])]),
    )


S0, SS, SU, SA = _step()
_WS = r"\x20\x09-\x0D"
SQL = rf"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT key, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT)), lambda s, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(s, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS k FROM (SELECT DISTINCT key FROM c0)),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c0 JOIN crc USING (key)),
n AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM d),
f AS (SELECT *, regexp_replace(text, '[{_WS}]+$', '') AS shown, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, lag(ini) OVER (PARTITION BY g ORDER BY i) AS before FROM n),
t AS (SELECT *, CASE WHEN shown = '' THEN 1 WHEN again THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS kind FROM f),
r AS (SELECT DISTINCT g, 0::BIGINT AS i, {{c: 0, a: '', o: ''}} AS s0, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS ss, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS su, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR) AS sa FROM t
UNION ALL SELECT r.g, t.i, {S0}, {SS}, {SU}, {SA} FROM r JOIN t ON t.g = r.g AND t.i = r.i + 1),
e AS (SELECT g, list_sort(list_filter([s0, sa, CASE WHEN su IS NOT NULL THEN {{c: su.c + 2, a: su.a || 'I', o: su.o || chr(10) || 'assistant:'}} END, CASE WHEN ss IS NOT NULL THEN {{c: ss.c + 4, a: ss.a || 'II', o: ss.o || chr(10) || 'user:' || chr(10) || 'assistant:'}} END], lambda x: x IS NOT NULL))[1] AS b
  FROM r WHERE i = (SELECT max(i) FROM t WHERE t.g = r.g)),
s AS (SELECT g, any_value(conv_id) AS conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY g)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv LEFT JOIN e USING (g)"""

