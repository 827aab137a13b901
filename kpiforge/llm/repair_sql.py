"""DuckDB SQL for ``op13_conversation_repair``: a dynamic programme over (cost, edits), one row of each conversation per step.

A state of the pattern holds the least (cost, edits, repaired lines) that reaches it: NULL if none does.
"""

from __future__ import annotations

_STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"


def _step(state: str, cost: str, edit: str, line: str | None = None) -> str:
    text = f"{state}.t" if line is None else f"{state}.t || {line} || chr(10)"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}} END"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _when(condition: str, option: str) -> str:
    return f"CASE WHEN {condition} THEN {option} END"


_USER, _ASSISTANT = "'user:'", "'assistant:'"
# What insertions add: a user row after the start (b), a system (s) or an assistant row (a), an assistant row after a user row (u).
_GROWN_U = _least("u", *[_step(x, "2", "I", _USER) for x in "bsa"])
_GROWN_A = _least("a", _step("u", "2", "I", _ASSISTANT))


def _row(state: str, letter: str, before: str, role: str) -> str:
    keep = [_when(f"live AND initial = '{letter}'", _step(x, "cut", "K", "role || ':' || text")) for x in before]
    change = [_when("live", _step(x, "2 + cut", "R", f"{role} || text")) for x in before]
    return _least(_step(state, "3", "D"), *keep, *(change if letter != "s" else []))


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS b
  FROM conversations),
d AS (SELECT k.*, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM k, crc),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn, substr(role, 1, 1) AS initial,
    right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS ending FROM e),
o AS (SELECT *, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial AS two FROM n),
f AS (SELECT *, NOT blank AND NOT again AS live, (NOT blank AND NOT again AND ending NOT IN ('.', '!', '?'))::INT AS cut FROM o),
st AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, {{'c': 0, 'a': '', 't': ''}}::{_STATE} AS b, NULL::{_STATE} AS s, NULL::{_STATE} AS u, NULL::{_STATE} AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, rn, {_step("b", "3", "D")}, {_row("s", "s", "b", "''")}, {_row("u", "u", "bsa", _USER)}, {_row("a", "a", "u", _ASSISTANT)}
  FROM (SELECT g.conv_id, f.rn, f.role, f.text, f.initial, f.live, f.cut, g.b, g.s, g.u, g.a
    FROM (SELECT conv_id, rn, b, s, u, {_GROWN_A} AS a FROM (SELECT conv_id, rn, b, s, {_GROWN_U} AS u, a FROM st) x) g
    JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.rn = g.rn + 1) y),
ends AS (SELECT conv_id, {_least("b", "a")} AS best FROM (
  SELECT conv_id, rn, b, {_GROWN_A} AS a FROM (SELECT conv_id, rn, b, s, {_GROWN_U} AS u, a FROM st
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1) x) g),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut = 1) AS truncated,
    count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
  sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
"""
