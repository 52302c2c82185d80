"""Conversation structure repair: the cheapest edits as a shortest path, found by auction.

The rows of a conversation and the states of the wanted pattern of roles,
(s?(ua)+)?, span a lattice with whole costs. Nodes have prices; a path grows
along the arc that its last node can best afford and shrinks where a price has
to rise, until every price is the distance to the end. Arcs that just meet
their price are tight, and the tight arcs with the least letters are the edits.

A conversation is cut into blocks that are worked on apart. What a block costs
between its borders is a table of state by state, so prices run through the
tables of a conversation's blocks from its end, and then each block knows the
prices behind it.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm._common import join_checked, map_texts, settle, slices

START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state by the initial of a role: s, u, a.
NEXT = {START: (SYSTEM, USER, None), SYSTEM: (None, USER, None), USER: (None, None, ASSISTANT), ASSISTANT: (None, USER, None)}
#: Fixed costs of the edits.
RETURN_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A row's code is three times its role's place in "sua", or 3, and 0 for sound, 1 for truncated, 2 for one that has to go; END is the end.
END = 12
FAR = 1 << 50
#: Rows of a block.
BLOCK = 4096
WHITE = "\\x20\\x09-\\x0D"


def arcs(code: int, state: int) -> list[tuple[str, int, int, bool]]:
    """(letter, cost, state, whether the row is passed) of the edits at a row, in the order of their letters."""
    role, fault = divmod(code, 3)
    speaks = next(t for t in NEXT[state][1:] if t is not None)
    insert = ("I", INSERT, speaks, False)
    if code == END:
        return [("", 0, state, True), insert] if state in (START, ASSISTANT) else [insert]
    out = [("D", DELETE, state, True), insert]
    if fault < 2:
        extra = TRUNCATED * fault
        kept = NEXT[state][role] if role < 3 else None
        if kept is not None:
            out.append(("K", extra, kept, True))
        out.append(("R", RETURN_ROLE + extra, speaks, True))
    return out


@lru_cache(maxsize=1 << 16)
def auction(code: int, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], tuple]:
    """(prices, tight arcs) of the four states before a row, whose prices behind it are known.

    A path starts at a node. If the node's price is below the least of cost
    plus price over its arcs, it rises to that and the path gives the node up,
    unless it started there; otherwise the path goes on along that arc. It ends
    at a node whose price is settled, and then the prices of all its nodes are
    distances. Nodes from which nothing can be reached take no part. The tight
    arc of a node is that of the least letter.
    """
    options = {q: arcs(code, q) for q in NEXT}
    live = {q for q in NEXT if any(passed and ahead[t] < FAR for _, _, t, passed in options[q])}
    while more := {q for q in NEXT if q not in live and any(not passed and t in live for _, _, t, passed in options[q])}:
        live |= more
    ways = {q: [a for a in options[q] if (ahead[a[2]] < FAR if a[3] else a[2] in live)] for q in live}
    price, settled = dict.fromkeys(live, 0), set()
    for origin in sorted(live):
        path = [origin]
        while path and path[-1] not in settled:
            node = path[-1]
            cost, target, passed = min(((c + (ahead[t] if p else price[t]), t, p) for _, c, t, p in ways[node]), key=lambda a: a[0])
            if price[node] < cost:
                price[node] = cost
                if len(path) > 1:
                    path.pop()
            elif passed:
                break
            else:
                path.append(target)
        settled.update(path)
    tight = tuple(next((a for a in ways[q] if price[q] == a[1] + (ahead[a[2]] if a[3] else price[a[2]])), None) if q in live else None for q in range(4))
    return tuple(price.get(q, FAR) for q in range(4)), tight


def before(code: int, ahead: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple]:
    """`auction` with prices counted from their least, so that equal layers are solved once: (least, prices above it, tight arcs)."""
    least = min(ahead)
    prices, tight = auction(code, tuple(p - least if p < FAR else FAR for p in ahead))
    return least, prices, tight


def priced(codes: bytes, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple]]:
    """Prices before a block's rows, and the tight arcs at each row in order."""
    steps, base = [], 0
    for code in reversed(codes):
        least, ahead, tight = before(code, ahead)
        base += least
        steps.append(tight)
    return tuple(p if p >= FAR else p + base for p in ahead), steps[::-1]


def crossing(codes: bytes) -> list[int]:
    """The cost between each state before a block and each state behind it, 16 numbers."""
    columns = [priced(codes, tuple(0 if q == r else FAR for q in range(4)))[0] for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def traced(steps: list[tuple], state: int) -> tuple[str, int]:
    """(letters, state behind) of the tight arcs from a state."""
    out = []
    for tight in steps:
        if tight[state] is None:
            return "", -1
        passed = False
        while not passed:
            letter, _, state, passed = tight[state]
            out.append(letter)
    return "".join(out), state


#: Prices behind a conversation's last row, and its last edits.
LAST, LAST_STEP = auction(END, (0, FAR, FAR, 0))


def damaged(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies): rows after the damage that crc32 of "conv:turn" names; copies is 0 for a dropped row, 2 for a repeated one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20).alias("kind"))
    return named.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(role: Column, text: Column) -> Column:
    """128 bits of a hash of both, the order of equal turns."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def _blocks(batches):
    """Sorted rows of (conv, turn, digest) as blocks of codes, with what the counts need; a conversation may go on in the next partition."""
    names = ["conv", "turn", "digest", "part", "k", "codes", "costs", "stats"]
    number, held = 0, None

    def close():
        codes = bytes(held["codes"])
        stats = [held["blank"], held["duplicate"], held["truncated"], held["illegal"], held["first"], held["last"], held["low"], held["high"], held["turns"]]
        return pa.RecordBatch.from_arrays([*held["head"], pa.array([held["part"]], pa.int64()), pa.array([number], pa.int64()), pa.array([codes], pa.binary()), pa.array([crossing(codes)], pa.list_(pa.int64())), pa.array([stats], pa.list_(pa.int64()))], names=names)

    for batch in slices(batches):
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "part", "reps", "role", "blank", "later", "truncated")]
        for i, (conv, turn, part, reps, role, blank, later, truncated) in enumerate(zip(*columns)):
            left = reps
            while left:
                if held is None or held["conv"] != conv or len(held["codes"]) >= BLOCK:
                    if held is not None:
                        yield close()
                        number += 1
                    held = {"conv": conv, "head": [batch.column(c).slice(i, 1) for c in names[:3]], "part": part, "codes": bytearray(), "first": role, "last": -1, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                some = min(left, BLOCK - len(held["codes"]))
                fresh = left == reps and not blank and not later
                held["codes"] += bytes([3 * role + (int(truncated) if fresh else 2)]) + bytes([3 * role + 2]) * (some - 1)
                held["blank"] += some if blank else 0
                held["duplicate"] += 0 if blank else some - fresh
                held["truncated"] += int(fresh and truncated)
                held["illegal"] += some - 1 + (held["last"] >= 0 and not legal(held["last"], role))
                if turn is not None and turn != held["high"]:
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["high"], held["turns"] = turn, held["turns"] + 1
                held["last"], left = role, left - some
    if held is not None:
        yield close()


def legal(a: int, b: int) -> bool:
    """Whether two roles, as places in "sua", may follow each other: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _behind(batches):
    """Blocks of each conversation from the last to the first: the prices behind each one, and before it."""
    now, prices, fresh = None, LAST, True
    for batch in slices(batches):
        out = []
        for conv, costs in zip(*[batch.column(c).to_pylist() for c in ("conv", "costs")]):
            if fresh or conv != now:
                now, prices, fresh = conv, LAST, False
            out.append(list(prices))
            prices = tuple(min(min(costs[4 * q + r] + prices[r] for r in range(4)), FAR) for q in range(4))
            out[-1] += list(prices)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "part", "k")], pa.array([v[:4] for v in out], pa.list_(pa.int64())), pa.array([v[4] for v in out], pa.int64())], names=["conv", "part", "k", "prices", "cost"])


def _edits(batches):
    """Blocks with their prices: the tight edits from each of the four states, and the state that they lead to."""
    for batch in slices(batches):
        found = []
        for codes, prices in zip(*[batch.column(c).to_pylist() for c in ("codes", "prices")]):
            _, steps = priced(codes, tuple(prices))
            found.append([traced(steps, q) for q in range(4)])
        kept = [batch.column(c) for c in ("conv", "turn", "digest", "part", "k", "stats", "cost")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([[e for e, _ in f] for f in found], pa.list_(pa.string())), pa.array([[s for _, s in f] for f in found], pa.list_(pa.int64()))], names=["conv", "turn", "digest", "part", "k", "stats", "cost", "edits", "ends"])


class _Conversation:
    """What is told of a conversation while its blocks and rows pass by."""

    def __init__(self) -> None:
        self.cost, self.state, self.audit, self.used = None, START, [], 0
        self.sums, self.last, self.low, self.high, self.turns = np.zeros(4, np.int64), None, None, None, 0
        self.ahead, self.hash, self.lines, self.spoken = "", hashlib.sha256(), 0, START

    def block(self, stats, cost, edits, ends) -> None:
        blank, duplicate, truncated, illegal, first, last, low, high, turns = stats
        self.cost = cost if self.cost is None else self.cost
        self.sums += (blank, duplicate, truncated, illegal + (self.last is not None and not legal(self.last, first)))
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        piece, self.state = edits[self.state], ends[self.state]
        self.audit.append(piece)
        self.ahead = self.ahead[self.used :] + piece
        self.used = 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def speak(self) -> str:
        self.spoken = next(t for t in NEXT[self.spoken][1:] if t is not None)
        return "user" if self.spoken == USER else "assistant"

    def row(self, role: str, text: str) -> None:
        """One row of the damaged table takes its edits."""
        while True:
            letter = self.ahead[self.used]
            self.used += 1
            if letter == "I":
                self.line(self.speak(), "")
                continue
            if letter == "K":
                self.spoken = NEXT[self.spoken]["sua".index(role[0])]
                self.line(role, text)
            elif letter == "R":
                self.line(self.speak(), text)
            return

    def told(self) -> tuple:
        if self.cost is not None:
            end, _ = traced([LAST_STEP], self.state)
            self.audit.append(end)
            for _ in self.ahead[self.used :] + end:
                self.line(self.speak(), "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.sums.tolist(), self.cost or 0, "".join(self.audit), self.hash.hexdigest())


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, after damage.

    `damaged` says what becomes of the rows; null roles and texts count as one
    space. Rows are in the order of their turns, nulls first, and rows of one
    turn in the order of a hash of role and text, so that equal ones are
    adjacent; repeated rows are rows of their own. Null conversations are one
    conversation. A conversation without rows after the damage has zeros and an
    empty audit. An empty table gives none. Other columns are not read.

    Lattices are cut into blocks of 4,096 rows by a range partitioning, so no
    conversation is in one task there, however long. The hash of the repaired
    text has to be taken in order, so its rows pass through one task, sorted by
    Spark; the task holds its edits, a letter a row, as the audit itself does.
    """
    kind = dict(turns.dtypes)[conv]
    rows = damaged(turns, conv, turn, role, text)
    first = F.substring("role", 1, 1)
    place = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut = ~F.col("text").rlike(f"[.!?][{WHITE}]*\\z")
    keyed = rows.withColumn("digest", _digest(F.col("role"), F.col("text")))
    facts = keyed.where("copies > 0").select("conv", "digest", "turn", "copies", place.alias("role"), blank.alias("blank"), (~blank & cut).alias("truncated"))
    lines = settle(facts.groupBy("conv", "digest", "turn").agg(F.sum("copies").alias("reps"), F.first("role").alias("role"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "turns")
    repeated = lines.groupBy("conv", "digest").agg(F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("first_turn"), F.max(F.col("turn").isNull()).alias("has_null"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = settle(repeated.withColumnsRenamed({"conv": "conv_", "digest": "digest_"}), "repeated")
    met = join_checked(lines, repeated, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("has_null") | (F.col("turn") > F.col("first_turn"))), F.lit(False))
    ordered = met.select("conv", "turn", "digest", "reps", "role", "blank", "truncated", later.alias("later")).repartitionByRange("conv", "turn", "digest").withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions("conv", "turn", "digest")
    blocks = settle(map_texts(ordered, _blocks, f"conv {kind}, turn long, digest binary, part long, k long, codes binary, costs array<long>, stats array<long>"), "blocks")
    prices = map_texts(blocks.select("conv", "part", "k", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("k")), _behind, f"conv {kind}, part long, k long, prices array<long>, cost long")
    priced_ = settle(prices.drop("conv"), "prices")
    edits = map_texts(join_checked(blocks, priced_, ["part", "k"], "inner"), _edits, f"conv {kind}, turn long, digest binary, part long, k long, stats array<long>, cost long, edits array<string>, ends array<long>")
    shown = keyed.select("conv", "turn", "digest", F.when(F.col("copies") == 0, F.lit(2)).otherwise(1).alias("kind"), "copies", "role", F.when(F.col("copies") > 0, F.col("text")).alias("text"))
    stream = shown.unionByName(edits.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "turn", "digest", "kind", "part", "k")
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        now, at, held = None, None, None
        kinds = (*[pa.int64()] * 6, pa.string(), pa.string())

        def tell():
            return pa.RecordBatch.from_arrays([at, *[pa.array([v], t) for v, t in zip(held.told(), kinds)]], names=names)

        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("conv", "kind", "copies", "role", "text", "stats", "cost", "edits", "ends")]
            for i, (key, what, copies, who, words, stats, cost, letters, ends) in enumerate(zip(*columns)):
                if held is None or key != now:
                    if held is not None:
                        yield tell()
                    now, at, held = key, batch.column("conv").slice(i, 1), _Conversation()
                if what == 0:
                    held.block(stats, cost, letters, ends)
                elif what == 1:
                    for _ in range(copies):
                        held.row(who, words)
        if held is not None:
            yield tell()

    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string"
    return map_texts(stream, run, schema).withColumnRenamed("conv", conv)
