"""Conversation repair against SQL, a plain search over the lattice, and awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from gridlore.llm import repair as R
from gridlore.llm.queries import ORACLE, QUERIES
from tools.compare import tidy

SCHEMA = "conv_id long, turn long, role string, text string, part int, digest string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()[:16]
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))


def _brute(conv, rows):
    """The cheapest edits with the least letters by a best-first search over (row, state) with whole histories."""
    rows = _damaged(rows)
    seen, gone, cut = set(), [], []
    blank = duplicate = truncated = 0
    for _, _, role, text in rows:
        b, d = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        t = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        blank, duplicate, truncated = blank + b, duplicate + (not b and d), truncated + (not b and not d and t)
        gone.append(b or d)
        cut.append(3 * (not b and not d and t))
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        speaks = "a" if state == "u" else "u"
        who = {"a": "assistant", "u": "user"}[speaks]
        heapq.heappush(heap, (cost + 3, audit + "I", i, speaks, (*lines, f"{who}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if not gone[i]:
                heapq.heappush(heap, (cost + 3 + cut[i], audit + "R", i + 1, speaks, (*lines, f"{who}:{text}")))
                if (state, role[:1]) in after:
                    heapq.heappush(heap, (cost + cut[i], audit + "K", i + 1, after[state, role[:1]], (*lines, f"{role}:{text}")))
    return (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _conversations(seed, n, most, texts=("Yes.", "No", " ", "Go on!  ", "What?", "a\x0b", "", "Hm. so")):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "u", "s"]
    rows = []
    for conv in [*range(n), None]:
        for i in range(r.randrange(1, most)):
            turn = r.choice([i, i, i, i + 3, None, 2])
            rows.append((conv, turn, r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[i % 2], None if r.random() < 0.05 else r.choice(texts) if r.random() < 0.6 else f"Line {i}."))
    return rows


def _got(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in R.repair(df).select(*COLUMNS).collect()), key=repr)


def _want(rows):
    return sorted((_brute(c, [r for r in rows if r[0] == c]) for c in {r[0] for r in rows}), key=repr)


def test_against_search(spark):
    rows = _conversations(1, 150, 12)
    assert _got(spark, rows) == _want(rows)


@pytest.mark.parametrize("block", [1, 3, 7])
def test_blocks(spark, monkeypatch, block):
    """Long conversations in small blocks, a hot row among them."""
    monkeypatch.setattr(R, "BLOCK", block)
    rows = [*_conversations(2, 6, 60), *[(99, i % 40, ("user", "assistant")[i % 2], f"Turn {i % 40}." if i % 9 else "Again") for i in range(150)], *[(7, 5, "user", "Same.")] * 30]
    assert _got(spark, rows) == _want(rows)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    for rows in (None, _conversations(3, 120, 12)):
        if rows is not None:
            con.execute("CREATE OR REPLACE VIEW conversations AS SELECT 1")
            con.execute("DROP VIEW conversations; CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
            con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        want = con.execute(ORACLE["op12_conversation_repair"])
        names = [c[0] for c in want.description]
        got = _got(spark, rows) if rows is not None else [tuple(r) for r in QUERIES["op12_conversation_repair"](spark, sf).select(*COLUMNS).collect()]
        assert tidy(COLUMNS, got).equals(tidy(names, want.fetchall()))


def test_a_dropped_conversation_and_an_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _got(spark, [(conv, 0, "user", "Gone.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert _got(spark, []) == []


def test_prices_are_distances():
    r = random.Random(5)
    for _ in range(200):
        codes = bytes(r.randrange(12) for _ in range(r.randrange(9)))
        prices, steps = R.priced(codes, R.LAST)
        ahead = dict(enumerate(R.LAST))
        for code in reversed(codes):
            now = {q: min((c + ahead[t] for _, c, t, p in R.arcs(code, q) if p), default=R.FAR) for q in range(4)}
            for _ in range(4):
                now = {q: min([now[q], *[c + now[t] for _, c, t, p in R.arcs(code, q) if not p]]) for q in range(4)}
            ahead = now
        assert prices == tuple(ahead[q] for q in range(4))
        table = R.crossing(codes)
        assert prices == tuple(min(table[4 * q + k] + R.LAST[k] for k in range(4)) for q in range(4))
        letters, end = R.traced(steps, R.START)
        assert end in range(4) and sum(x != "I" for x in letters) == len(codes)
