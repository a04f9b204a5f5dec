"""Repairs against all edit sequences of small conversations, in one block and in many, and odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from scriptorium.llm import conversation_repair as cr
from scriptorium.llm.registry import op12_conversation_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def least_repair(rows: list[tuple[str, str]], faults: list[str]) -> tuple[int, str, str]:
    """Cost, audit and repaired text by a plain table over rows and states; each entry keeps its whole audit."""
    now = {0: (0, "", ())}
    for (role, text), fault in [*zip(rows, faults), ((None, None), None)]:
        wide = dict(now)
        for _ in range(4):
            for state, (cost, audit, out) in list(wide.items()):
                to = 3 if state == 2 else 2
                found = (cost + 5, audit + "I", (*out, ("user:" if to == 2 else "assistant:")))
                wide[to] = min(wide.get(to, found), found)
        if role is None:
            return min((v[0], v[1], "\n".join(v[2])) for s, v in wide.items() if s in (0, 3))
        then = {}
        for state, (cost, audit, out) in wide.items():
            ends = [(state, cost + 2, "D", out)]
            if fault not in ("blank", "duplicate"):
                more, to = 5 * (fault == "truncated"), 3 if state == 2 else 2
                ends.append((to, cost + 1 + more, "R", (*out, ("user:" if to == 2 else "assistant:") + text)))
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {})
                if state in kept:
                    ends.append((kept[state], cost + more, "K", (*out, f"{role}:{text}")))
            for to, c, letter, lines in ends:
                then[to] = min(then.get(to, (c, audit + letter, lines)), (c, audit + letter, lines))
        now = then


def expected(rows: list[tuple]) -> tuple:
    """The result for the damaged rows (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, text = least_repair([r[1:] for r in rows], faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text or " ") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_every_repair_is_the_cheapest_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    r = random.Random(block)
    texts = ["yes.", "no!", "cut off", " \t", "", "why? ", "end. \n"]
    rows = [(c, r.randrange(9) if r.random() < 0.95 else None, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice([*texts, f"own {i}.", f"own {i}"])) for c in range(60) for i in range(r.randrange(1, 24))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)] + [(901, t, "system", f"s {t}.") for t in range(40)] + [(None, 1, "user", "hi.")]
    _, found = cr.repair(spark.createDataFrame(rows, SCHEMA), id="conv_id", turn="turn", role="role", text="text")
    got = {row[0]: tuple(row[1:]) for row in found.collect()}
    want = {("" if c is None else f"={c}"): expected([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    assert got == want


def test_query_against_a_plain_version(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {row[0]: tuple(row[1:]) for row in op12_conversation_repair(spark, SF).collect()}
    left = damage(rows)
    assert got == {c: expected([x[1:] for x in left if x[0] == c]) for c in {x[0] for x in rows}}


def test_damage_nulls_and_conversations_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a."), (None, None, None, None), (3, None, "user", None), (3, 5, None, "x.")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = {row[0]: tuple(row[1:]) for row in cr.repaired_conversations(cr.damaged(df), df).collect()}
    left = damage(rows)
    want = {c: expected([x[1:] for x in left if x[0] == c]) for c in {x[0] for x in rows}}
    assert got == want and got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_edits_keep_the_texts_and_clashing_names_do_no_harm(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi.", "x", 1), (1, 1, "user", "yes?", "y", 2)], "key long, at long, seq string, fault string, table string, block long")
    done, found = cr.repair(df, id="key", turn="at", role="seq", text="fault")
    rows = sorted(done.collect(), key=lambda r: r["seq"])
    assert [(r["letters"], r["role"], r["text"]) for r in rows] == [("K", "user", "hi."), ("R", "assistant", "yes?"), ("", None, None)]
    assert found.first()["audit"] == "KR"
    empty = cr.repair(df.limit(0), id="key", turn="at", role="seq", text="fault")
    assert empty[0].isEmpty() and empty[1].isEmpty()
