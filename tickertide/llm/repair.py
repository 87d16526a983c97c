"""Conversation structure repair: cheapest edits by dynamic programming with square-root checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.llm.common import row_key
from tickertide.session import cut_lineage

# Costs of the edits, and of leaving a truncated turn as it is.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, BRIEFED, ASKED, ANSWERED = range(4)
FINAL = (START, ANSWERED)
NEVER = 1 << 40
MOVES = {
    (START, "s"): BRIEFED,
    (START, "u"): ASKED,
    (BRIEFED, "u"): ASKED,
    (ASKED, "a"): ANSWERED,
    (ANSWERED, "u"): ASKED,
}
# The role a turn must have to follow a state, if it is given a new one or inserted.
WANTED = {START: "u", BRIEFED: "u", ASKED: "a", ANSWERED: "u"}
ROLES = {"u": "user", "a": "assistant"}
# A turn's code: 4 times its fault, plus its role's initial.
INITIALS = "sua?"
SOUND, CUT, BLANK, TWICE = range(4)
WHITE = r"\x20\x09-\x0D"
LEGAL = {"su", "ua", "au"}


def steps(code: int, state: int) -> dict[str, tuple[int, int]]:
    """Edits that use up a turn: initial to (cost, next state)."""
    fault, initial = code // 4, INITIALS[code % 4]
    out = {"D": (DELETE, state)}
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if (state, initial) in MOVES:
            out["K"] = (more, MOVES[state, initial])
        out["R"] = (REROLE + more, MOVES[state, WANTED[state]])
    return out


Vector = tuple[int, int, int, int]
_before: dict[tuple[int, Vector], tuple[int, Vector]] = {}


def with_inserts(costs: list[int]) -> Vector:
    """Costs from each state when turns may be inserted first; a cycle of inserts never pays."""
    costs = list(costs)
    for _ in range(3):
        for s in range(4):
            costs[s] = min(costs[s], INSERT + costs[MOVES[s, WANTED[s]]])
    return tuple(costs)


LAST: Vector = with_inserts([0 if s in FINAL else NEVER for s in range(4)])


def before(code: int, after: Vector) -> tuple[int, Vector]:
    """Costs before a turn from those after it, as their least and what the states cost beyond it.

    Beyond the least they are a few small numbers, so the step is remembered, not repeated.
    """
    known = _before.get((code, after))
    if known is None:
        costs = with_inserts([min(c + after[t] for c, t in steps(code, s).values()) for s in range(4)])
        least = min(costs)
        known = _before[code, after] = (least, tuple(c - least for c in costs))
    return known


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and ASCII-least letters of the cheapest edits of one conversation's turn codes.

    Walking backwards, costs are kept at about sqrt(n) checkpoints only; walking forwards, those
    of one block are worked out again.  Beyond ``codes`` and the letters, memory is O(sqrt(n)).
    """
    n = len(codes)
    block = max(1, isqrt(n))
    least = min(LAST)
    vector, total = tuple(c - least for c in LAST), least
    checkpoints = {}
    for i in range(n - 1, -1, -1):
        if (i + 1) % block == 0 or i == n - 1:
            checkpoints[i // block] = vector
        more, vector = before(codes[i], vector)
        total += more
    cost = total + vector[START]
    state, letters = START, bytearray()
    for k in range((n + block - 1) // block):
        lo, hi = k * block, min(n, (k + 1) * block)
        # afters[i]: costs after the turn, and the least taken out of those before it.
        afters: list[tuple[Vector, int]] = []
        vector = checkpoints[k]
        for i in range(hi - 1, lo - 1, -1):
            more, earlier = before(codes[i], vector)
            afters.append((vector, more))
            vector = earlier
        for i in range(lo, hi):
            after, more = afters.pop()
            state = _walk(codes[i], state, vector, after, more, letters)
            vector = after
    while state not in FINAL:
        letters += b"I"
        state = MOVES[state, WANTED[state]]
    return cost, letters.decode()


def _walk(code: int, state: int, now: Vector, after: Vector, more: int, letters: bytearray) -> int:
    """Writes the ASCII-least tight edits up to the one that uses up the turn; returns the state."""
    while True:
        found = steps(code, state)
        tight = [e for e, (c, t) in found.items() if c + after[t] == more + now[state]]
        inserted = MOVES[state, WANTED[state]]
        if now[inserted] + INSERT == now[state]:
            tight.append("I")
        edit = min(tight)
        letters += edit.encode()
        if edit != "I":
            return found[edit][1]
        state = inserted


def damaged_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one turn in five damaged by a checksum of its place.

    Nulls in role and text become one blank, as they do in the checksum's ``conv_id:turn``.  Of
    crc32 modulo 20, 0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``,
    3 repeats it, 4 makes its role ``user``.  Other columns are dropped.
    """
    blank = F.lit(" ")

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), blank)

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def turn_codes(turns: DataFrame) -> DataFrame:
    """``conv_id, task, piece, codes``: the turns' codes, one byte each, in order of the columns.

    Rows are ranged by conversation, turn, role and text, so a conversation of any length is
    coded by many tasks.  The first of equal turns is found by an aggregate over their keys and
    the turn's number; equal rows of one turn stand next to each other.
    """
    key = row_key(F.col("conv_id").isNull(), F.col("conv_id"), F.col("role"), F.col("text"))
    # Null turns come first.
    place = F.struct(F.col("turn").isNotNull().alias("later"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = turns.withColumns({"key": key, "place": place})
    firsts = keyed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.col("key").alias("key_"), "first")
    joined = keyed.join(firsts, F.col("key") == F.col("key_"), "left")
    last = F.regexp_extract("text", rf"([^{WHITE}])[{WHITE}]*\z", 1)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    fault = (
        F.when(last == "", BLANK)
        .when(F.col("place") > F.col("first"), TWICE)
        .when(~last.isin(".", "!", "?"), CUT)
        .otherwise(SOUND)
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    rows = (
        joined.select("conv_id", "turn", "role", "text", "key", (fault * 4 + initial).alias("code"))
        .repartitionByRange(*order[:3], F.substring("text", 1, 100))
        .sortWithinPartitions(*order)
        .select("conv_id", "turn", "key", "code", F.spark_partition_id().alias("task"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last = 0, None
        for b in batches:
            codes = b.column(3).to_numpy().copy()
            same = np.zeros(b.num_rows, dtype=bool)
            conv, turn = (_with_nulls(b.column(k)) for k in (0, 1))
            key = b.column(2).to_numpy(zero_copy_only=False)
            same[1:] = (key[1:] == key[:-1]) & (turn[1:] == turn[:-1]).all(axis=1)
            if last is not None and b.num_rows:
                same[0] = key[0] == last[0] and (turn[0] == last[1]).all()
            repeated = same & (codes // 4 != BLANK)
            codes[repeated] = TWICE * 4 + codes[repeated] % 4
            last = (key[-1], turn[-1]) if b.num_rows else last
            cuts = np.flatnonzero((conv[1:] != conv[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), b.num_rows] if b.num_rows else [0]
            starts = bounds[:-1]
            data = codes.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(starts, pa.int64())),
                    b.column(4).take(pa.array(starts, pa.int64())),
                    pa.array(range(piece, piece + len(starts)), pa.int64()),
                    pa.array([data[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                ],
                names=["conv_id", "task", "piece", "codes"],
            )
            piece += len(starts)

    return rows.mapInArrow(pack, "conv_id long, task int, piece long, codes binary")


def _with_nulls(column: pa.Array) -> np.ndarray:
    nulls = np.asarray(column.is_null())
    return np.stack([np.asarray(column.fill_null(0)), nulls], axis=1)


PLANS = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair_plans(codes: DataFrame) -> DataFrame:
    """Fault numbers, cost and edits of each conversation of ``turn_codes``.

    A conversation's codes are gathered in one task, a byte a turn, as its edits are in the result.
    """
    pieces = codes.repartition("conv_id").sortWithinPartitions("conv_id", "task", "piece")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own = object(), bytearray()
        for b in batches:
            rows = []
            for key, piece in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key != conv:
                    if own:
                        rows.append((conv, *_plan(bytes(own))))
                    conv, own = key, bytearray()
                own += piece
            yield _rows(rows)
        if own:
            yield _rows([(conv, *_plan(bytes(own)))])

    return pieces.mapInArrow(plan, PLANS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
        names=[x.split()[0] for x in PLANS.split(", ")],
    )


def _plan(codes: bytes) -> tuple:
    at = np.frombuffer(codes, dtype=np.uint8)
    faults = np.bincount(at // 4, minlength=4)
    initial = at % 4
    legal = np.zeros((4, 4), dtype=bool)
    for pair in LEGAL:
        legal[INITIALS.index(pair[0]), INITIALS.index(pair[1])] = True
    illegal = int((~legal[initial[:-1], initial[1:]]).sum())
    return int(faults[BLANK]), int(faults[TWICE]), int(faults[CUT]), illegal, *repair(codes)


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, seq, role, text``: the conversations after their edits, in order within a partition.

    A conversation's edits come before its turns, which are streamed; one turn is in memory.
    """
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "role", "text"]
    heads = plans.select(
        "conv_id",
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"),
        F.col("audit").alias("text"),
    )
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    rows = heads.union(rows).repartition("conv_id").sortWithinPartitions(*order)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, seq = None, "", 0, START, 0
        out: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                out.append((conv, seq, ROLES[WANTED[state]], ""))
                state, at, seq = MOVES[state, WANTED[state]], at + 1, seq + 1

        for b in batches:
            out.clear()
            columns = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            for key, kind, role, text in zip(*columns, strict=True):
                if kind == 0:
                    inserts()
                    conv, audit, at, state, seq = key, text, 0, START, 0
                    continue
                inserts()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = ROLES[WANTED[state]]
                state = MOVES[state, role[0]]
                out.append((conv, seq, role, text))
                seq += 1
            yield _turns(out)
        out.clear()
        inserts()
        yield _turns(out)

    return rows.mapInArrow(edit, "conv_id long, seq long, role string, text string")


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "seq", "role", "text"]
    )


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``role:text`` joined by newlines, streamed without a shuffle."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            done = []
            columns = (b.column(k).to_pylist() for k in range(4))
            for key, seq, role, text in zip(*columns, strict=True):
                if seq == 0:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _digests(done)
        yield _digests([(conv, digest.hexdigest())] if digest is not None else [])

    return repaired.mapInArrow(fold, "conv_id long, repaired_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
        names=["conv_id", "repaired_sha256"],
    )


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired turns of every conversation.

    ``turns`` has ``conv_id, turn, role, text`` without nulls in role and text (other columns are
    ignored); ``conversations`` the ``conv_id`` to report, also those without turns.  Turns are
    ordered by ``turn`` (nulls first), ties by role and text; rows that repeat are duplicates; a
    null ``conv_id`` is a conversation; empty tables give no rows.  A turn is blank, or else a
    duplicate of an earlier one, or else truncated; ``illegal`` counts neighbours whose roles'
    initials may not follow each other, and ``gaps`` numbers missing between the first and last
    turn.  Allowed are conversations of an optional system turn, then user and assistant turns
    in pairs, or none.  Only hashing walks a conversation's texts in one task.
    """
    own = turns.select("conv_id", "turn", "role", "text")
    plans = cut_lineage(repair_plans(turn_codes(own)), "plans")
    digests = repaired_digests(repaired_turns(own, plans))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = own.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for k, side in enumerate((gaps, plans, digests)):
        side = side.withColumnRenamed("conv_id", f"conv_{k}")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col(f"conv_{k}")), "left").drop(f"conv_{k}")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
