"""DuckDB SQL of the conversation repair: the lattice as a recursive table of the best edits that lead to each state."""

from __future__ import annotations


def _add(state: str, cost: str, letter: str, line: str | None) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{f' || {line} || chr(10)' if line else ''}}}"


def _insert(state: str, who: str) -> str:
    return _add(state, "3", "I", f"'{who}:'")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _when(condition: str, option: str) -> str:
    return f"CASE WHEN {condition} THEN {option} END"


def _step() -> dict[str, str]:
    """Each state behind a row, before insertions."""
    kept = lambda s: _add(s, "3 * cut", "K", "role || ':' || text")
    role = lambda s, who: _when("NOT gone", _add(s, "3 + 3 * cut", "R", f"'{who}:' || text"))
    drop = lambda s: _add(s, "4", "D", None)
    keep = lambda s, who: _when(f"NOT gone AND prefix(role, '{who}')", kept(s))
    return {
        "n0": drop("s0"),
        "n1": _least(drop("s1"), keep("s0", "s")),
        "n2": _least(drop("s2"), *[f for s in ("s0", "s1", "s3") for f in (keep(s, "u"), role(s, "user"))]),
        "n3": _least(drop("s3"), keep("s2", "a"), role("s2", "assistant")),
    }


def _closed(source: str) -> str:
    """States with the insertions that pay."""
    user = _least("n2", *[_insert(s, "user") for s in ("n0", "n1", "n3")])
    return f"""SELECT conv_id, i, n0 AS s0, n1 AS s1, {_least("m2", _insert("m3", "user"))} AS s2, m3 AS s3
        FROM (SELECT *, {_least("n3", _insert("m2", "assistant"))} AS m3 FROM (SELECT *, {user} AS m2 FROM ({source})))"""


_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b: {_BITS}))"
_FIRST = f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'a': '', 't': ''}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS n0, {_NONE} AS n1, {_NONE} AS n2, {_NONE} AS n3 FROM conversations"
_NEXT = f"SELECT d.conv_id, f.i, {', '.join(f'{v} AS {k}' for k, v in _step().items())} FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = d.i + 1"

REPAIR_SQL = rf"""
    WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                                coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    h AS (SELECT *, {_CRC} % 20 AS kind FROM r),
    e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM h, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS q(z)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 32)) AS i FROM e),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM n),
    f AS (SELECT *, blank OR seen > 1 AS gone, CAST(NOT blank AND seen = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS BIGINT) AS cut FROM o),
    d AS ({_closed(_FIRST)} UNION ALL {_closed(_NEXT)}),
    z AS (SELECT conv_id, {_least("s0", "s3")} AS best FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                 count(*) FILTER (NOT blank AND seen > 1) AS duplicate, sum(cut) AS truncated, count(*) FILTER (bad) AS illegal
          FROM (SELECT *, lag(role) OVER w IS NOT NULL AND left(lag(role) OVER w, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM f
                WINDOW w AS (PARTITION BY conv_id ORDER BY i)) GROUP BY conv_id)
    SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
           sha256(CASE WHEN best.t = '' THEN '' ELSE substr(best.t, 1, length(best.t) - 1) END) AS repaired_sha256
    FROM z LEFT JOIN g ON z.conv_id IS NOT DISTINCT FROM g.conv_id"""
