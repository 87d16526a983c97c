"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tickertide.llm import repair as rp

TYPES = "conv_id long, turn long, role string, text string"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(place.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in convs.values():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    return convs


def cheapest(turns, faults):
    @lru_cache(None)
    def best(i, state, inserts):
        out = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        edits = []
        if inserts < 4:
            edits += [(2, "I", i, q, f"{ROLE[q]}:", inserts + 1) for q in "ua"]
        if i < len(turns):
            _, role, text = turns[i]
            edits.append((3, "D", i + 1, "", None, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                edits.append((more, "K", i + 1, role[:1], f"{role}:{text}", 0))
                edits += [(2 + more, "R", i + 1, q, f"{ROLE[q]}:{text}", 0) for q in "ua"]
        for cost, letter, to, initial, said, count in edits:
            after = state if letter == "D" else MOVES.get((state, initial))
            rest = None if after is None else best(to, after, count)
            if rest:
                out.append((cost + rest[0], letter + rest[1], (() if said is None else (said,)) + rest[2]))
        return min(out, key=lambda v: v[:2]) if out else None

    return best(0, 0, 0)


def expected(rows):
    out = []
    for conv, turns in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(
                "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, said = cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def reported(frame):
    found = rp.repair_report(rp.damaged_turns(frame), frame.select("conv_id").distinct())
    return sorted([tuple(r) for r in found.collect()], key=repr)


def test_given_conversations_equal_search(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    assert reported(given) == expected(rows)


def test_odd_conversations_equal_search(spark):
    pick = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "", None, "tool", "sys"]
    texts = ["Hi.", "ok", "Yes! ", "", None, " \t", "why?\n", "x\x85", " 　", "a.b", "x" * 300_000 + "."]
    rows = [
        (None if conv % 40 == 0 else conv, pick.choice([t, t, t, None, t - 1]), pick.choice(roles), pick.choice(texts))
        for conv in range(200)
        for t in range(pick.randint(0, 12))
    ]
    rows += [(900, t, "user", "a") for t in range(60)]
    rows += [(901, 5, "user", "q?"), (901, 5, "assistant", "q?")] * 3
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TYPES}, key string, code int").repartition(5)
    assert reported(frame) == expected(rows)


def test_empty_table(spark):
    assert reported(spark.createDataFrame([], TYPES)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 10, 50])
def test_checkpoints_of_any_length(n):
    pick = random.Random(n)
    codes = bytes(pick.randrange(16) for _ in range(n))
    turns = [(0, {"s": "system", "u": "user", "a": "assistant", "?": "x"}[rp.INITIALS[c % 4]], "t") for c in codes]
    faults = [["", "truncated", "blank", "duplicate"][c // 4] for c in codes]
    assert rp.repair(codes) == cheapest(turns, tuple(faults))[:2]


def test_long_conversation_needs_few_checkpoints():
    cost, audit = rp.repair(bytes([1, 2]) * 200_000)
    assert cost == 0 and audit == "K" * 400_000
