"""Repair of conversations: the cheapest edits that give them the roles ``(s?(ua)+)?``, found by divide and conquer.

A conversation is read by an automaton of four states (nothing yet, after a system turn, after a user's, after an
assistant's).  What a row can do is a table of 4 x 4 entries, the cheapest edit from a state to a state, among equal costs
the one that comes first in ASCII; tables of neighbouring rows compose.  Hirschberg's scheme needs no table of all rows
and states: a forward vector of four costs runs from the first row to the middle, a backward vector from the last, the
cheapest crossing wins, and both halves are solved in the same way between the states that are known now.  Of equally
cheap crossings the one whose edits so far come first is taken, which the forward vector knows by carrying the order of
its four best edit sequences.

The scheme runs in two places.  Rows of a conversation are cut into blocks, whose tables are composed in tasks, blocks
into blocks of blocks, until one is left of every conversation; then the crossings between blocks are found from the top
down, and every block is solved by itself between the two states that it was given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import written

#: Rows, and blocks, that one task solves at once.
BLOCK = 4096
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
# Costs of edits, by the letters that stand for them, and of a truncated row that stays.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_STAYS = 5
# The state after a turn by the initial of its role, and the roles that are given or inserted.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
NO_WAY = 255
#: Ways that cost so much more than the cheapest are dropped: whatever follows costs at most 17 more from one state than
#: from another that insertions lead to, so that the best way is never among them.
HOPELESS = 60
WHITE = r"\x20\x09-\x0D"

# A table is 32 bytes: 16 costs above the least of them, then for every first state the order of its four edit sequences.


def options(initial: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state, state) -> (cost, letters) of what a row can do: insertions before it, and its own edit."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for first in STATES:
        state, before = first, ""
        for _ in range(3):  # more insertions than two come back to the same state
            ends = [("D", state)]
            if fault not in ("blank", "duplicate"):
                ends += [("R", NEXT[state])] + [("K", AFTER[initial][state]) for _ in range(initial in AFTER and state in AFTER[initial])]
            for letter, last in ends:
                stays = TRUNCATED_STAYS if fault == "truncated" and letter != "D" else 0
                found = (sum(COSTS[c] for c in before + letter) + stays, before + letter)
                out[first, last] = min(out.get((first, last), found), found)
            state, before = NEXT[state], before + "I"
    return out


def endings() -> dict[tuple[int, int], tuple[int, str]]:
    """The same for the end of a conversation: insertions until it may end, which is the state ``START`` of nothing more."""
    letters = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    return {(first, START): (sum(COSTS[c] for c in s), s) for first, s in letters.items()}


def packed(found: dict[tuple[int, int], tuple[int, str]]) -> bytes:
    least = min(cost for cost, _ in found.values())
    costs = [found[p, q][0] - least if (p, q) in found else NO_WAY for p in STATES for q in STATES]
    order = {p: sorted(s for (x, _), (_, s) in found.items() if x == p) for p in STATES}
    ranks = [order[p].index(found[p, q][1]) if (p, q) in found else 0 for p in STATES for q in STATES]
    return bytes(costs + ranks)


#: What rows can do, by their code: 4 * (place of the initial, 3 for any other) + place of the fault.
OPTIONS = [options(i, f) for i in (*INITIALS, "") for f in FAULTS]
TABLES, ENDINGS = [packed(o) for o in OPTIONS], endings()
END = packed(ENDINGS)


def ranked(best: list[tuple | None]) -> tuple[list[int | None], list[int]]:
    """Costs, and the order of what follows them, of (cost, key, key) of four states; hopeless ones are dropped."""
    least = min(b[0] for b in best if b is not None)
    best = [None if b is None or b[0] > least + HOPELESS else b for b in best]
    order = sorted(b[1:] for b in best if b is not None)
    return [None if b is None else b[0] for b in best], [0 if b is None else order.index(b[1:]) for b in best]


def levelled(costs: list[int | None]) -> list[int]:
    least = min(c for c in costs if c is not None)
    return [NO_WAY if c is None else c - least for c in costs]


@lru_cache(100_000)
def composed(a: bytes, b: bytes) -> bytes:
    """The table of two neighbours: for every pair of states the cheapest state between them, of equal ones that whose
    edits come first."""
    costs, ranks = [], []
    for p in STATES:
        ways = lambda q: ((a[4 * p + s] + b[4 * s + q], a[16 + 4 * p + s], b[16 + 4 * s + q]) for s in STATES if a[4 * p + s] < NO_WAY and b[4 * s + q] < NO_WAY)  # noqa: B023, E731
        own, order = ranked([min(ways(q), default=None) for q in STATES])
        costs, ranks = costs + own, ranks + order
    return bytes(levelled(costs) + ranks)


@lru_cache(100_000)
def forward(vector: bytes, table: bytes) -> bytes:
    """A vector (four costs, the order of their edit sequences) one table further."""
    ways = lambda q: ((vector[s] + table[4 * s + q], vector[4 + s], table[16 + 4 * s + q]) for s in STATES if vector[s] < NO_WAY and table[4 * s + q] < NO_WAY)
    costs, order = ranked([min(ways(q), default=None) for q in STATES])
    return bytes(levelled(costs) + order)


@lru_cache(100_000)
def backward(table: bytes, vector: bytes) -> bytes:
    """Four costs of reaching the end, one table earlier."""
    ways = lambda p: ((table[4 * p + q] + vector[q],) for q in STATES if table[4 * p + q] < NO_WAY and vector[q] < NO_WAY)
    return bytes(levelled(ranked([min(ways(p), default=None) for p in STATES])[0]))


def crossings(tables: list[bytes], first: int, last: int) -> list[int]:
    """The states between the tables, from ``first`` to ``last`` both included, of the cheapest way whose edits come first."""
    states = [first] * len(tables) + [last]
    work = [(0, len(tables))]
    while work:
        lo, hi = work.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead = bytes([0 if s == states[lo] else NO_WAY for s in STATES] + [0] * 4)
        for table in tables[lo:mid]:
            ahead = forward(ahead, table)
        behind = bytes(0 if s == states[hi] else NO_WAY for s in STATES)
        for table in reversed(tables[mid:hi]):
            behind = backward(table, behind)
        states[mid] = min((ahead[s] + behind[s], ahead[4 + s], s) for s in STATES if ahead[s] < NO_WAY and behind[s] < NO_WAY)[2]
        work += [(lo, mid), (mid, hi)]
    return states


def gathered(level: DataFrame) -> DataFrame:
    """(key, block, ats, tables): at most ``BLOCK`` neighbours of a conversation in a row."""
    one = level.groupBy("key", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "table"))).alias("one"))
    return one.select("key", "block", F.col("one.at").alias("ats"), F.col("one.table").alias("tables"))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, table): the composed table of every block."""
    for batch in batches:
        tables = []
        for one in batch.column(3).to_pylist():
            total = one[0]
            for table in one[1:]:
                total = composed(total, table)
            tables.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tables, pa.binary())], names=["key", "at", "table"])


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, first, last): the states before and after every member of a block (key, block, ats, tables, first, last).
    A block without a last state is the end of its conversation, and gives the place after its last member as well."""
    for batch in batches:
        keys, ats, firsts, lasts = [], [], [], []
        for key, _, own, tables, first, last in zip(*(c.to_pylist() for c in batch.columns)):
            end = last is None
            states = crossings([*tables, END] if end else tables, first, START if end else last)
            ats += [*own, own[-1] + 1] if end else own
            keys += [key] * (len(states) - 1)
            firsts += states[:-1]
            lasts += [*states[1:-1], None] if end else states[1:]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ats, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["key", "at", "first", "last"])


def between(rows: DataFrame) -> DataFrame:
    """(key, at, first, last) for every row (key, at, table) and the end of every conversation, whose last state is null."""
    levels = [rows]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= BLOCK:
        levels.append(written(gathered(levels[-1]).mapInArrow(summed, "key string, at long, table binary"), "blocks"))
    shape = "key string, at long, first int, last int"
    top = gathered(levels[-1]).select("*", F.lit(START).alias("first"), F.lit(None).cast("int").alias("last"))
    known = written(top.mapInArrow(solved, shape), "crossings")
    for level in reversed(levels[:-1]):
        # A block of the level above; the end of a conversation is its last block's.
        blocks = known.where("last is not null").withColumnRenamed("at", "block")
        inner = gathered(level).join(blocks, ["key", "block"])
        after = level.groupBy("key").agg((F.max("at") + 1).alias("end"))
        ends = known.where("last is null").join(after, "key").select("key", F.col("end").alias("at"), "first", "last")
        known = written(inner.mapInArrow(solved, shape).union(ends), "crossings")
    return known


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables, of the rows (key, turn, role, text, seq) and of (key, seq, at, initial, fault): rows go by turn (nulls
    first), role and text; ``seq`` is their order in the whole table, ``at`` the place in the conversation.  A conversation
    may lie in many tasks; equal rows change places freely."""
    digest, order = F.sha2("text", 256), ["key", "turn", "role", "digest"]
    ordered = turns.withColumn("digest", digest).withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order, "nth").sortWithinPartitions(*order, "nth")
    ordered = written(ordered.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).drop("nth"), "turns")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("seq").alias("least")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = ordered.groupBy("key", "role", "digest").agg(F.min("seq").alias("seq")).select("key", "seq", F.lit(True).alias("is_first"))
    narrow = ordered.select("key", "part", "seq", "role", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(f"[^{WHITE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")).alias("open"))
    narrow = narrow.join(parts.select("key", "part", "least", "before"), ["key", "part"]).withColumn("at", F.col("before") + F.col("seq") - F.col("least")).join(first, ["key", "seq"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("is_first").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    return ordered, written(narrow.select("key", "seq", "at", "initial", fault.alias("fault")), "places")


FOUND = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seq, letters, head, role) of rows (key, seq, initial, fault, first, last): the letters of what is done there, the
    inserted lines that come first, and the row's role where it is given another; the end has no initial."""
    ways = {(4 * i + f, p, q): s for i in range(4) for f in range(4) for (p, q), (_, s) in OPTIONS[4 * i + f].items()}
    for batch in batches:
        letters, heads, roles = [], [], []
        for initial, fault, first, last in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            way = ENDINGS[first, START][1] if last is None else ways[4 * ((INITIALS.find(initial) if initial else 3) % 4) + fault, first, last]
            state, head = first, ""
            for _ in range(way.count("I")):
                state = NEXT[state]
                head += f"{ROLE[state]}:\n"
            letters.append(way)
            heads.append(head)
            roles.append(ROLE[NEXT[state]] if way.endswith("R") else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(letters, pa.string()), pa.array(heads, pa.string()), pa.array(roles, pa.string())], names=["key", "seq", "letters", "head", "role"])


class Digest:
    """What is known of a conversation whose edits and rows come by, in order."""

    def __init__(self):
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns, self.least, self.last_turn, self.initial, self.illegal = 0, None, None, None, 0
        self.cost, self.audit, self.sha, self.any = 0, [], hashlib.sha256(), False

    def line(self, data: str) -> None:
        self.sha.update((("\n" if self.any else "") + data).encode())
        self.any = True

    def edit(self, letters: str, head: str, role: str | None) -> None:
        self.letters, self.role = letters, role
        self.audit.append(letters)
        self.cost += sum(COSTS[c] for c in letters)
        for data in head.split("\n")[:-1]:
            self.line(data)

    def row(self, turn: int | None, role: str, text: str | None, fault: int) -> None:
        if fault:
            self.counts[FAULTS[fault]] += 1
        if turn is not None and turn != self.last_turn:
            self.turns, self.least, self.last_turn = self.turns + 1, turn if self.least is None else self.least, turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if self.letters[-1] != "D":
            self.cost += TRUNCATED_STAYS * (FAULTS[fault] == "truncated")
            self.line(f"{role if self.role is None else self.role}:{text}")

    def result(self) -> tuple:
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; its lines come by in order and are not kept."""
    now, state = None, None
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = [c.strip().split(" ")[0] for c in FOUND.split(",")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)
    for batch in batches:
        done = []
        for key, _, kind, letters, head, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now is not None:
                    done.append((now, *state.result()))
                now, state = key, Digest()
            state.row(turn, role, text, fault) if kind else state.edit(letters, head, role)
        if done:
            yield out(done)
    if now is not None:
        yield out([(now, *state.result())])


def repair(turns: DataFrame, *, id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of the conversations ``turns``: (key, seq, letters, head, role, turn, text), what is done with every row,
    and (key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    Rows go by turn, nulls first, then by role and text.  A row is at fault when it is blank, else when role and text were
    seen earlier, else when it does not end in one of ``.!?``.  Keeping it costs 0, another role 1, deleting it 2 (blank and
    repeated rows must go), an inserted empty turn 5, and a truncated row that stays 5 more; of equally cheap repairs the
    one whose letters come first in ASCII is taken.  Null roles and texts are one space; a null id is a conversation of its
    own; repeated rows are duplicates; other columns are ignored; an empty table gives empty ones.

    A conversation may have any number of rows: they are numbered, compared and solved in blocks.  Its digest alone is
    taken in one task, as SHA-256 must be, which reads the rows in order and keeps none.
    """
    own = F.when(F.col(id).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id).cast("string")))
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows, places = placed(turns.select(own.alias("key"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text")))
    place = F.when(F.col("initial") == "", 3).otherwise(F.pmod(F.instr(F.lit(INITIALS), F.col("initial")) - 1, F.lit(4)))
    table = F.element_at(F.array(*[F.lit(bytearray(t)) for t in TABLES]), (4 * place + F.col("fault") + 1).cast("int"))
    states = between(written(places.select("key", "at", table.alias("table")), "tables"))
    after_all = F.coalesce("seq", F.lit((1 << 63) - 1)).alias("seq")
    edits = states.join(places, ["key", "at"], "left").select("key", after_all, "initial", "fault", "first", "last")
    edits = written(edits.mapInArrow(edited, "key string, seq long, letters string, head string, role string"), "edits")
    must_go, none = F.col("fault").isin(1, 2), lambda kind: F.lit(None).cast(kind)
    lines = rows.join(places.select("key", "seq", "fault"), ["key", "seq"]).select("key", "seq", F.lit(1).alias("kind"), none("string").alias("letters"), none("string").alias("head"), "turn", "role", F.when(~must_go, F.col("text")).alias("text"), "fault")
    both = lines.union(edits.select("key", "seq", F.lit(0), "letters", "head", none("long"), "role", none("string"), none("int")))
    found = both.repartition("key").sortWithinPartitions("key", "seq", "kind").mapInArrow(digested, FOUND)
    done = edits.join(rows.select("key", "seq", "turn", F.col("role").alias("old"), "text"), ["key", "seq"], "left").select("key", "seq", "letters", "head", F.coalesce("role", "old").alias("role"), "turn", "text")
    return done, found


def damaged(turns: DataFrame) -> DataFrame:
    """Planted faults in ``turns`` (conv_id, turn, role, text), by the crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1
    empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's.  Nulls are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), h.alias("h")).where("h <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(turns: DataFrame, known: DataFrame) -> DataFrame:
    """One row for every conv_id of ``known``: the repair of its ``turns`` (conv_id, turn, role, text).  A conversation of
    which no row is left has zeros, an empty audit and the hash of nothing."""
    _, found = repair(turns, id="conv_id", turn="turn", role="role", text="text")
    own = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = [c.strip().split(" ")[0] for c in FOUND.split(",")][1:]
    every = known.select("conv_id").distinct().withColumn("key", own).join(found, "key", "left")
    return every.select("conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in names])
