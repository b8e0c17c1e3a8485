"""Repair of the turns of a conversation by iterative-deepening A*.

A repaired conversation has no turns, or an optional system turn and then user and
assistant in alternation, from a user to an assistant. Turns are kept (0), given the role
user or assistant (3), deleted (4), or empty ones inserted (3); blank and repeated turns
must go, a truncated one that stays costs 3 more. The search tries edits in the order of
their letters, D I K R, under a bound on the cost that grows to the least cost at which an
earlier search gave up; so the first way it finds is a cheapest one and, of these, the
first by its letters.

What a role may be follows from the turn before, so the letters alone give the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import hand_back, kept_state, slices
from ruleloom.session import cut_lineage

RATE = 20
DROP, EMPTY, UNSTOP, REPEAT, REROLE = range(5)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = "bdt"
MUST_GO = (BLANK, DUPLICATE)
# Conversations of more turns are searched in pieces of so many, joined so many at a time.
PIECE = 16
JOINED = 64
LEGAL = ("su", "ua", "au")

# What may follow the start, a system, a user and an assistant turn: the letter of a kept
# turn and the state it leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def damage(turns: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` after damage; `gone` marks rows that were dropped.

    The crc32 of `conv_id:turn` modulo RATE decides: 0 drops the row, 1 empties its text,
    2 takes out `[.!?]`, 3 repeats it, 4 makes it a user's. A null id, turn, role or text
    reads as one blank there; id and turn stay null in the result.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % RATE
    text = F.when(kind == EMPTY, "").when(kind == UNSTOP, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == REROLE, "user").otherwise(blank("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == REPEAT, 2).otherwise(1)))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == DROP).alias("gone"), copies.alias("_copy")).drop("_copy")


def _initial(role: Column) -> Column:
    return F.when(F.length(role) > 0, F.substring(role, 1, 1)).otherwise(" ")


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault, gone): each row's first fault, or none.

    `digest` stands for role and text: the rows stay narrow, and repeated ones are found
    by (conversation, digest), which spreads a long conversation over many tasks.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = turns.select("conv_id", "turn", "role", _digest().alias("digest"), _initial(F.col("role")).alias("initial"), blank.alias("blank"), whole.alias("whole"), "gone")
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(" ")
    return rows.withColumn("fault", fault).drop("blank", "whole")


def search(turns: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str]:
    """The least cost and its first way of edits, from state `start` to one of `ends`.

    `turns` has two letters a turn, the role's initial and the fault. The bound starts at
    what the faults cost at least. A state that failed with some money left is not tried
    again with as little. One of `ends` must be open to inserted turns, or be `start`.
    """
    n = len(turns) // 2
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = turns[2 * i + 1]
        least[i] = least[i + 1] + (DELETE_COST if fault in MUST_GO else TRUNCATED_COST if fault == TRUNCATED else 0)
    bound = least[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        over = INSERT_COST + DELETE_COST
        way: list[str] = []
        # A frame: turn, state, money left, edits not tried yet (the first one last).
        stack = [[0, start, bound, None]]
        while stack:
            frame = stack[-1]
            i, state, money, edits = frame
            if edits is None:
                if i == n and state in ends:
                    return bound - money, "".join(way)
                edits = frame[3] = [] if money <= failed.get((i, state), -1) else _edits(turns, i, n, state)
            if not edits:
                failed[i, state] = max(failed.get((i, state), -1), money)
                stack.pop()
                if way:
                    way.pop()
                continue
            letter, cost, following, after = edits.pop()
            left = money - cost
            if left < least[following]:
                over = min(over, least[following] - left)
                continue
            way.append(letter)
            stack.append([following, after, left, None])
        bound += over


def _edits(turns: str, i: int, n: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, next turn, next state) for the edits possible here, the first one last."""
    _, after = MADE[state]
    out = []
    if i < n:
        initial, fault = turns[2 * i], turns[2 * i + 1]
        if fault not in MUST_GO:
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            out.append(("R", REROLE_COST + more, i + 1, after))
            if initial in STEPS[state]:
                out.append(("K", KEEP_COST + more, i + 1, STEPS[state][initial]))
    out.append(("I", INSERT_COST, i, after))
    if i < n:
        out.append(("D", DELETE_COST, i + 1, state))
    return out


@lru_cache(1 << 12)
def ways(turns: str) -> list[tuple[int, str] | None]:
    """The cheapest ways over some turns, from each state to each: 16 of them, row by row.

    The start can only be kept to by deleting everything, and so can the state after a
    system turn, to which one kept system turn leads; all others are searched.
    """
    n = len(turns) // 2
    gone = (DELETE_COST * n, "D" * n)
    kept = [(DELETE_COST * (n - 1) + (TRUNCATED_COST if turns[2 * i + 1] == TRUNCATED else 0), "D" * i + "K" + "D" * (n - i - 1)) for i in range(n) if turns[2 * i] == "s" and turns[2 * i + 1] not in MUST_GO]
    fixed = {(0, 0): gone, (0, 1): min(kept, default=None), (1, 1): gone}
    return [fixed.get((s, e)) if e < 2 else search(turns, s, (e,)) for s in range(4) for e in range(4)]


def join_ways(left: list, right: list) -> list:
    """The cheapest ways over two stretches of turns, one behind the other.

    Of two ways over the same turns, between the same states and at the same cost, none
    begins the other; so the first way of a whole has the first ways as its parts.
    """

    def best(s: int, e: int) -> tuple[int, str] | None:
        met = [(a, b) for m in range(4) if (a := left[4 * s + m]) and (b := right[4 * m + e])]
        return min(((a[0] + b[0], a[1] + b[1]) for a, b in met), default=None)

    return [best(s, e) for s in range(4) for e in range(4)]


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
WAYS = "array<struct<cost:bigint,audit:string>>"
WAYS_TYPE = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


class _Conversation:
    """What is kept of the turns read so far: two letters each, and counts."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns: list[str] = []
        self.illegal = self.distinct = 0
        self.first = self.last = None
        self.previous = ""

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if self.previous and self.previous + initial not in LEGAL:
            self.illegal += 1
        self.previous = initial
        self.turns.append((initial if initial in "sua" else "-") + fault)

    def row(self) -> tuple:
        turns = "".join(self.turns)
        faults = turns[1::2]
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, (1 << 63) - 1)
        return (self.conv_id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), self.illegal, turns)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted stream of its turns."""
    kept_state(None)
    names = ["conv_id", *(c.split()[0] for c in COUNTS.split(", ")), "turns"]
    types = [pa.int64()] * 6 + [pa.string()]
    now, done = None, []
    for batch in batches:
        for conv_id, turn, initial, fault, gone in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv_id)
            if not gone:
                now.add(turn, initial, fault)
        if done:
            yield _table(done, names, types)
            done = []
    if now is not None:
        yield _table([now.row()], names, types)


def _pairs(found: list) -> list:
    return [None if way is None else {"cost": way[0], "audit": way[1]} for way in found]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one way of a whole conversation, the sixteen of a piece."""
    kept_state(None)
    for batch in batches:
        conv_ids, places, turns, whole = (c.to_pylist() for c in batch.columns)
        found = [_pairs([search(t)] if w else ways(t)) for t, w in zip(turns, whole)]
        yield pa.RecordBatch.from_arrays([pa.array(conv_ids, pa.int64()), pa.array(places, pa.int64()), pa.array(found, WAYS_TYPE)], names=["conv_id", "place", "ways"])
    ways.cache_clear()
    hand_back()


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways over neighbouring pieces, joined in pairs until one is left."""
    kept_state(None)
    for batch in batches:
        for i in range(batch.num_rows):
            conv_id, place, parts = (c[i].as_py() for c in batch.columns)
            rows = [[None if way is None else (way["cost"], way["audit"]) for way in part["ways"]] for part in parts]
            while len(rows) > 1:
                rows = [join_ways(*rows[j : j + 2]) if j + 1 < len(rows) else rows[j] for j in range(0, len(rows), 2)]
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([place], pa.int64()), pa.array([_pairs(rows[0])], WAYS_TYPE)], names=["conv_id", "place", "ways"])


def cheapest(found: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) for conversations given as (conv_id, turns), two letters a turn.

    Pieces of long conversations are rows of their own, so their search is spread over
    tasks; rounds join JOINED neighbours each until one row of a conversation is left.
    """
    n = F.length("turns") / 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / PIECE).cast("int") - 1, F.lit(0)))
    pieces = found.select("conv_id", "turns", (n <= PIECE).alias("whole"), F.explode(starts).alias("place"))
    pieces = pieces.select("conv_id", F.col("place").cast("long").alias("place"), F.substring("turns", F.col("place") * (2 * PIECE) + 1, F.lit(2 * PIECE)).alias("turns"), "whole")
    schema = f"conv_id long, place long, ways {WAYS}"
    searched = cut_lineage(pieces.repartition("conv_id", "place").mapInArrow(_search, schema))
    open_ = searched.where(F.size("ways") > 1)
    while not open_.where("place > 0").isEmpty():
        near = F.floor(F.col("place") / JOINED).cast("long")
        groups = open_.groupBy("conv_id", near.alias("near")).agg(F.sort_array(F.collect_list(F.struct("place", "ways"))).alias("parts"))
        open_ = cut_lineage(groups.mapInArrow(_join, schema))
    way = lambda i: F.col("ways")[i]
    ends = F.array_min(F.filter(F.array(*[F.struct(way(e)["cost"].alias("cost"), way(e)["audit"].alias("audit")) for e in ENDS]), lambda w: w["cost"].isNotNull()))
    one = searched.where(F.size("ways") == 1).select("conv_id", way(0).alias("w"))
    return one.unionByName(open_.select("conv_id", ends.alias("w"))).select("conv_id", "w.cost", "w.audit")


class _Repaired:
    """Applies the letters of an audit to turns as they come, and hashes what results."""

    def __init__(self, conv_id: int | None, audit: str) -> None:
        self.conv_id, self.audit = conv_id, audit
        self.at, self.state, self.some = 0, 0, False
        self.hash = hashlib.sha256()

    def _emit(self, role: str, text: str, state: int) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.some, self.state = True, state

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            letter, state = MADE[self.state]
            self._emit(ROLES[letter], "", state)
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._emit(role, text, STEPS[self.state][role[0]])
        elif edit == "R":
            letter, state = MADE[self.state]
            self._emit(ROLES[letter], text, state)

    def row(self) -> tuple:
        self._insert()
        return self.conv_id, self.hash.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_conv, repaired_sha256) from streams of an audit and then its turns."""
    kept_state(None)
    names, types = ["_conv", "repaired_sha256"], [pa.int64(), pa.string()]
    now, done = None, []
    for batch in batches:
        for part in slices(batch, 3):
            for conv_id, audit, role, text in zip(*part):
                if audit is not None:
                    if now is not None:
                        done.append(now.row())
                    now = _Repaired(conv_id, audit)
                else:
                    now.add(role, text)
        if done:
            yield _table(done, names, types)
            done = []
    if now is not None:
        yield _table([now.row()], names, types)
    hand_back()


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def audits(turns: DataFrame) -> DataFrame:
    """One row for each conversation of damaged turns: its faults, the cost and the edits.

    `turns` as `damage` returns them. Rows are read in the order of turn (nulls first; of
    equal turns by role and digest) as a sorted stream, of which two letters a turn are
    kept; texts stay outside.
    """
    rows = faults(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", F.col("fault") == DUPLICATE)
    stream = rows.select("conv_id", "turn", "initial", "fault", "gone")
    found = cut_lineage(stream.mapInArrow(_facts, f"conv_id long, {COUNTS}, turns string"))
    edits = cheapest(found.select("conv_id", "turns")).withColumnRenamed("conv_id", "_conv")
    return found.drop("turns").join(edits, _same("conv_id", "_conv")).drop("_conv")


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """`found` (as `audits` returns it) with `repaired_sha256`, of the repaired turns.

    Audit and turns of a conversation meet in one sorted stream, and a text is hashed as it
    passes; a SHA-256 can only be taken from first to last, so a conversation's texts go
    through one task, which holds none of them.
    """
    none = lambda kind: F.lit(None).cast(kind)
    text = turns.where("not gone").select("conv_id", F.lit(1).alias("kind"), none("string").alias("audit"), "turn", "role", "text", _digest().alias("digest"))
    head = found.select("conv_id", F.lit(0).alias("kind"), "audit", none("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), none("binary").alias("digest"))
    stream = head.unionByName(text).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    hashes = stream.select("conv_id", "audit", "role", "text").mapInArrow(_digests, "_conv long, repaired_sha256 string")
    return found.join(hashes, _same("conv_id", "_conv")).drop("_conv")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Damage a table of conversations and repair each one at the least cost.

    `turns`: conv_id, turn, role, text; other columns are not read. One row for each
    conv_id, null among them: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. A null role or text reads as one blank, and an empty role too, which
    begins no legal turn. Rows of equal turn are taken by role and digest of role and
    text, so the result does not depend on the order of the table. A conversation without
    rows after damage has zeros, no edits and the hash of nothing; an empty table gives an
    empty one. Long conversations are searched in
    pieces (`cheapest`), with the same result.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    damaged = damage(rows)
    found = cut_lineage(audits(damaged))
    return repair(damaged, found)
