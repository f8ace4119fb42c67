"""Conversation repair against an exhaustive search and against itself in segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from featsift.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, kind string, at int, fault string"


def plain(rows):
    """The contract by hand over [(turn, role, text)] after damage; best edits by search
    over all strings of edits in order of cost."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    best = None
    # All choices per row, and none, one or two insertions in each gap.
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        base = sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and f == "truncated") for e, f in zip(edits, faults))
        for extra in itertools.product((0, 1, 2), repeat=len(rows) + 1):
            cost = base + 2 * sum(extra)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * n + e for n, e in zip(extra, [*edits, ""]))
            for lines in spelled(audit, rows):
                best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
    legal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), legal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def spelled(audit, rows):
    """Every legal reading of an audit."""
    choices, rest = [], iter(rows)
    for e in audit:
        row = None if e == "I" else next(rest)
        if e == "K":
            choices.append([f"{row[1]}:{row[2]}"])
        elif e != "D":
            choices.append([f"{role}:{row[2] if row else ''}" for role in ("user", "assistant")])
    for lines in itertools.product(*choices):
        if re.fullmatch("(s?(ua)+)?", "".join(x[:1] if x[0] != ":" else "?" for x in lines)):
            yield "\n".join(lines)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [(conv, row)] * (2 if kind == 3 else 1)
    return out


def some_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rng.randrange(0, most)):
            turn = rng.choice([None, *range(12)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t\n", None, "Why? \x0b", f"w{rng.random()}."])
            rows.append((conv, turn, role, text))
    return rows


def values(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("whole_rows", [2000, 0])
def test_against_search(spark, whole_rows, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_ROWS", 3)
    monkeypatch.setattr(C, "FAN", 2)
    rows = some_rows(1, 60, 5)
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    groups = {r[0]: [] for r in rows}
    for conv, row in after_damage(rows):
        groups[conv].append(row)
    assert values(C.repair(frame, whole_rows)) == {conv: plain(found) for conv, found in groups.items()}


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_the_whole(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(C, "FAN", 3)
    rows = some_rows(seed, 8, 120)
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert values(C.repair(frame, 20)) == values(C.repair(frame))


def test_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"said {rng.randrange(900)}.") for t in range(6000)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows + [(8, 0, "user", "Hi.")]], SCHEMA)
    assert values(C.repair(frame)) == values(C.repair(frame, 10**9))


def test_agenda_takes_hyperedges():
    """A two-premise deduction waits for both premises."""
    def deduce(item, final):
        if item in "ab" and "a" in final and "b" in final:
            yield "c", (final["a"][0] + final["b"][0], final["a"][1] + final["b"][1])
        if item == "c":
            yield "goal", (final["c"][0] + 1, final["c"][1] + "!")

    got = C.lightest([("a", (2, "x")), ("b", (5, "y")), ("c", (9, "z"))], deduce, {"goal"})
    assert got == {"goal": (8, "xy!")}


def test_empty(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []
