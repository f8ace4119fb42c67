"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A conversation's role initials should read ``(s?(ua)+)?``.  Rows are kept (cost 0),
given another role (2), deleted (3; blank and repeated rows must be) and inserted with
empty text (2); a truncated row that is not deleted adds 1.  The cheapest edits win,
ties by the ASCII-least string of their initials (the audit).

Items are nodes of a weighted hypergraph, (place, state of the grammar); deductions
derive one item from others by superior functions on (cost, audit): adding a cost and
letters never makes a value less.  So the agenda may pop the least item, finalise it,
and stop when the goal pops.  No value of an item is a proper prefix of another of the
same cost (a longer audit over the same rows has more insertions), hence the functions
are monotone as well.

1. Conversations of at most ``WHOLE_ROWS`` rows are dealt by id and streamed, one held
   at a time.
2. Longer ones are sorted over all tasks by (conversation, turn, ...) and cut into
   segments of ``SEGMENT_ROWS``.  A segment yields the lightest derivation from each
   state to each; deductions with two premises, (place, state) and a segment, join
   ``FAN`` neighbouring segments, level by level, until one is left.  Its audit is then
   cut back to the segments, which rebuild their rows; only the digest of the repaired
   text runs over a whole conversation, one segment's text at a time.

Rows of one turn are ordered by role and text (nulls count as one space first), equal
rows are interchangeable.

Defined cases: a null conv_id is a conversation of its own; null turns come first and
do not count in gaps; null role or text is one space; a role of no letters can only be
changed or deleted; a conversation without rows has zeros, an empty audit and the
digest of nothing; empty input gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featsift.llm.common import given_id, neighbours, real_id, stored
from featsift.operators.ranking import sequence_by

WHOLE_ROWS = 2000
SEGMENT_ROWS = 256
FAN = 16
FEW = 100_000  # long conversations whose ids may be broadcast

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
# States: nothing yet, after s, after u, after a.  From each, what may follow.
START, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
FOLLOWS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
_SPACE = " \t\n\x0b\x0c\r"

Value = tuple[int, str]


def lightest(axioms: Iterable[tuple[Hashable, tuple]], deduce: Callable[[Hashable, dict], Iterable[tuple[Hashable, tuple]]], goals: set) -> dict:
    """Least values of the ``goals`` (those that can be derived).

    ``deduce(item, final)`` gives the conclusions, with their values, of the deductions
    whose last premise to be finalised is ``item``; ``final`` holds all finalised items.
    """
    agenda = [(value, item) for item, value in axioms]
    heapq.heapify(agenda)
    final: dict = {}
    open_goals = set(goals)
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        open_goals.discard(item)
        if not open_goals:
            break
        for conclusion, found in deduce(item, final):
            if conclusion not in final:
                heapq.heappush(agenda, (found, conclusion))
    return {g: final[g] for g in goals if g in final}


def forced(state: str) -> str:
    """The only user or assistant initial that may follow."""
    return "a" if state == USER else "u"


def row_deductions(initials: list[str], faults: list[int]) -> Callable:
    """Deductions over rows: each has one premise, (rows done, state)."""
    n = len(initials)

    def deduce(item, final):
        (i, state), (cost, audit) = item, final[item]
        follow = forced(state)
        yield (i, follow), (cost + INSERT, audit + "I")
        if i == n:
            return
        yield (i + 1, state), (cost + DELETE, audit + "D")
        if faults[i] not in (BLANK, DUPLICATE):
            extra = CUT_SHORT if faults[i] == TRUNCATED else 0
            if initials[i] and initials[i] in FOLLOWS[state]:
                yield (i + 1, initials[i]), (cost + extra, audit + "K")
            yield (i + 1, follow), (cost + REROLE + extra, audit + "R")

    return deduce


def cheapest(initials: list[str], faults: list[int]) -> Value:
    """(cost, audit) of a whole conversation."""
    rows = row_deductions(initials, faults)

    def deduce(item, final):
        if item[0] == len(initials) and item[1] in (START, ASSISTANT):
            yield "goal", final[item]
        yield from rows(item, final)

    return lightest([((0, START), (0, ""))], deduce, {"goal"})["goal"]


# From one state to another over segments: cost, audit, then how the audit falls to the
# segments: the state after each and (as bytes of 64-bit numbers) each one's letters.
Way = tuple[int, str, str, bytes]
Ways = dict[tuple[str, str], Way]


def _number(n: int) -> bytes:
    return np.int64(n).tobytes()


def segment_ways(initials: list[str], faults: list[int]) -> Ways:
    rows, n = row_deductions(initials, faults), len(initials)
    return {
        (a, b): (cost, audit, b or "-", _number(len(audit)))
        for a in FOLLOWS
        for (_, b), (cost, audit) in lightest([((0, a), (0, ""))], rows, {(n, b) for b in FOLLOWS}).items()
    }


def joined_ways(parts: list[Ways]) -> Ways:
    """Ways over neighbouring segments.  A deduction has two premises, (segments done,
    state) and a way of the next segment, which is an axiom; values are joined."""

    def deduce(item, final):
        (i, state), value = item, final[item]
        if i < len(parts):
            for (x, y), way in parts[i].items():
                if x == state:
                    yield (i + 1, y), tuple(p + q for p, q in zip(value, way))

    out: Ways = {}
    for a in FOLLOWS:
        found = lightest([((0, a), (0, "", "", b""))], deduce, {(len(parts), b) for b in FOLLOWS})
        out.update(((a, b), way) for (_, b), way in found.items())
    return out


def rebuilt(audit: str, state: str, rows: Iterable[tuple[str, str]]) -> tuple[list[str], str]:
    """The repaired ``role:text`` lines of an audit over ``rows``, and the last state."""
    lines, rows = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = forced(state)
            lines.append(ROLE[state] + ":")
            continue
        role, text = next(rows)
        if letter == "K":
            state = role[:1]
        elif letter == "R":
            state = forced(state)
            role = ROLE[state]
        if letter != "D":
            lines.append(f"{role}:{text}")
    return lines, state


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# ---------------------------------------------------------------- rows


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, fault)`` after the contract's damage: by CRC-32 of
    ``conv_id:turn`` modulo 20, rows are dropped (0), emptied (1), robbed of their sentence
    ends (2), repeated (3) or given the role user (4).  ``fault`` leaves out duplicates."""
    kind = F.pmod(F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(real_id("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _shown("role").alias("role"), _shown("text").alias("text"), kind.alias("kind"))
    rows = rows.where("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    seen = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(seen == "", BLANK).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.select("conv", "turn", "role", "text", fault.cast("int").alias("fault"))


_RESULT = "conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(conv, faults: list[int], initials: list[str], value: Value, digest: str) -> tuple:
    return (conv, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_pairs(initials), *value, digest)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for table in neighbours(batches, ("conv",)):
        rows = list(zip(table.column("role").to_pylist(), table.column("text").to_pylist()))
        faults, seen = table.column("fault").to_pylist(), set()
        for i, row in enumerate(rows):
            if faults[i] != BLANK and row in seen:
                faults[i] = DUPLICATE
            seen.add(row)
        initials = [role[:1] for role, _ in rows]
        value = cheapest(initials, faults)
        text = "\n".join(rebuilt(value[1], START, rows)[0])
        out.append(_result(table.column("conv")[0].as_py(), faults, initials, value, hashlib.sha256(text.encode()).hexdigest()))
        if len(out) == 1000:
            yield _batch(out, _RESULT)
            out = []
    yield _batch(out, _RESULT)


# ---------------------------------------------------------------- long conversations

_WAYS = "conv long, nth long, lowest long, came string, went string, cost long, audit string, path string, letters binary"


def _ways_rows(conv: int, nth: int, lowest: int, ways: Ways) -> pa.RecordBatch:
    return _batch([(conv, nth, lowest, *states, *way) for states, way in ways.items()], _WAYS)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in neighbours(batches, ("conv", "segment")):
        ways = segment_ways([r[:1] for r in table.column("role").to_pylist()], table.column("fault").to_pylist())
        segment = table.column("segment")[0].as_py()
        yield _ways_rows(table.column("conv")[0].as_py(), segment, segment, ways)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in neighbours(batches, ("conv", "above")):
        rows, parts = table.to_pylist(), {}
        for r in rows:
            way = (r["cost"], r["audit"], r["path"], r["letters"])
            parts.setdefault(r["nth"], {})[r["came"], r["went"]] = way
        ways = joined_ways([parts[nth] for nth in sorted(parts)])
        yield _ways_rows(rows[0]["conv"], rows[0]["above"], min(r["lowest"] for r in rows), ways)


_PARTS = "conv long, segment long, came string, audit string"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, cut to its segments."""
    for batch in batches:
        for r in batch.to_pylist():
            ends = np.cumsum(np.frombuffer(r["letters"], dtype=np.int64)).tolist()
            came = [START, *r["path"].replace("-", " ")]
            cut = [(r["conv"], r["lowest"] + i, came[i].strip(), r["audit"][lo:hi]) for i, (lo, hi) in enumerate(zip([0, *ends], ends))]
            for lo in range(0, len(cut), 1000):
                yield _batch(cut[lo:lo + 1000], _PARTS)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in neighbours(batches, ("conv", "segment")):
        first = table.slice(0, 1).to_pylist()[0]
        lines, _ = rebuilt(first["audit"], first["came"], zip(table.column("role").to_pylist(), table.column("text").to_pylist()))
        yield _batch([(first["conv"], first["segment"], "\n".join(lines) if lines else None)], "conv long, segment long, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation from its segments' texts in order, held one by one."""
    conv, state, some = None, None, False
    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["conv"] != conv:
                if state is not None:
                    yield _batch([(conv, state.hexdigest())], "conv long, repaired_sha256 string")
                conv, state, some = r["conv"], hashlib.sha256(), False
            if r["text"] is not None:
                state.update(("\n" if some else "").encode() + r["text"].encode())
                some = True
    if state is not None:
        yield _batch([(conv, state.hexdigest())], "conv long, repaired_sha256 string")


def _long(rows: DataFrame) -> DataFrame:
    """``_RESULT`` of conversations that no task should hold whole."""
    placed = sequence_by(rows, ["conv", F.col("turn").asc_nulls_first(), "role", "text"], "at")
    # A row is a repeat unless its place is the first of its (conversation, role, text);
    # places are unique, so neither join has a hot key.
    same = placed.groupBy("conv", "role", F.sha2("text", 256).alias("same"))
    firsts = same.agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.left("role", F.lit(1))
    before = placed.select((F.col("at") + 1).alias("at"), F.col("conv").alias("conv_before"), initial.alias("initial_before"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    illegal = (F.col("conv_before") == F.col("conv")) & ~F.concat("initial_before", initial).isin("su", "ua", "au")
    placed = placed.join(firsts, "at", "left").join(before, "at", "left").select(
        "conv", F.floor(F.col("at") / SEGMENT_ROWS).alias("segment"), "at", "role", "text", fault.cast("int").alias("fault"),
        F.coalesce(illegal, F.lit(False)).cast("long").alias("illegal"),
    )
    placed = stored(placed, "turns")
    count = lambda kind: F.sum((F.col("fault") == kind).cast("long"))
    totals = placed.groupBy("conv").agg(
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), F.sum("illegal").alias("illegal")
    )
    dealt = placed.select("conv", "segment", "at", "role", "fault").repartition("segment").sortWithinPartitions("segment", "at")
    ways = stored(dealt.mapInArrow(_segments, _WAYS), "ways")
    while not ways.groupBy("conv").agg(F.min("nth").alias("a"), F.max("nth").alias("b")).where("a < b").isEmpty():
        dealt = ways.withColumn("above", F.floor(F.col("nth") / FAN)).repartition("conv", "above")
        ways = stored(dealt.sortWithinPartitions("conv", "above", "nth").mapInArrow(_joined, _WAYS), "ways")
    goals = ways.where((F.col("came") == START) & F.col("went").isin(START, ASSISTANT))
    least = F.min(F.struct("cost", "audit", "path", "letters", "lowest")).alias("least")
    goals = stored(goals.groupBy("conv").agg(least).select("conv", "least.*"), "goals")
    parts = goals.mapInArrow(_parts, _PARTS)
    lines = placed.select("conv", "segment", "at", "role", "text").join(parts, ["conv", "segment"])
    lines = lines.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "at").mapInArrow(_rebuilt, "conv long, segment long, text string")
    digests = lines.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(_digests, "conv long, repaired_sha256 string")
    return totals.join(goals.select("conv", "cost", "audit"), "conv").join(digests, "conv")


def repair(conversations: DataFrame, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 for each conv_id of ``conversations(conv_id, turn, role, text)``."""
    conv = real_id("conv_id").alias("conv")
    rows = damaged(conversations)
    left = rows.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps")
    )
    facts = stored(conversations.select(conv).distinct().join(left, "conv", "left"), "conversations")
    above = facts.where(F.col("n") > whole_rows).select("conv")
    some = above.count()
    short = rows
    if some:
        ids = F.broadcast(above) if some <= FEW else above
        short = rows.join(ids, "conv", "left_anti")
    dealt = short.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    found = dealt.mapInArrow(_whole, _RESULT)
    if some:
        found = found.unionByName(_long(rows.join(ids, "conv", "left_semi")))
    none = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return facts.join(found, "conv", "left").select(
        given_id("conv").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )


# The same by dynamic programming over rows: before each row up to two insertions, then
# keep, another role, or delete.  Written for the driver's table, whose (conv_id, turn)
# is unique.  CRC-32 is worked out bit by bit.
ORACLE = r"""
WITH RECURSIVE kinds AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM kinds WHERE kind != 0),
seen AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
r AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM seen),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
moves(q, pre, lines, m, f) AS (VALUES
  ('', '', []::VARCHAR[], '', 'u'), ('', 'I', ['user:'], 'u', 'a'), ('', 'II', ['user:', 'assistant:'], 'a', 'u'),
  ('s', '', [], 's', 'u'), ('s', 'I', ['user:'], 'u', 'a'), ('s', 'II', ['user:', 'assistant:'], 'a', 'u'),
  ('u', '', [], 'u', 'a'), ('u', 'I', ['assistant:'], 'a', 'u'), ('a', '', [], 'a', 'u'), ('a', 'I', ['user:'], 'u', 'a')),
s(conv_id, i, q, v) AS (
  SELECT conv_id, 0::BIGINT, '', {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM counts
  UNION ALL
  SELECT conv_id, i, q, min(v) FROM (
    SELECT s.conv_id, r.i, CASE e WHEN 'K' THEN r.initial WHEN 'R' THEN f ELSE m END AS q,
           {'cost': s.v.cost + 2 * length(pre) + CASE e WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN e != 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
            'audit': s.v.audit || pre || e,
            'lines': s.v.lines || moves.lines || CASE e WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE f WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END} AS v
    FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN moves ON moves.q = s.q, (VALUES ('K'), ('R'), ('D')) AS edits(e)
    WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR r.initial = f OR (m = '' AND r.initial = 's')))) AS step
  GROUP BY conv_id, i, q),
goal AS (
  SELECT s.conv_id, min({'cost': s.v.cost + 2 * length(pre), 'audit': s.v.audit || pre, 'lines': s.v.lines || moves.lines}) AS v
  FROM s JOIN counts ON counts.conv_id IS NOT DISTINCT FROM s.conv_id AND counts.n = s.i JOIN moves ON moves.q = s.q
  WHERE m = 'a' OR m = '' GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(array_to_string(v.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN goal ON goal.conv_id IS NOT DISTINCT FROM c.conv_id"""
