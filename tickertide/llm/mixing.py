"""Mixing sources to target weights: fixed-length blocks, drawn counts per shard, permuted indexes."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickertide.llm.common import row_key
from tickertide.session import cut_lineage

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 256
SHARD_BLOCKS = 4096
# Documents whose places in a source are summed in one piece.
PIECE_DOCS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240229


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> dict:
    """Words that each source shall give; sources by code point, null last, weigh in turn.

    All words are shared out by weight; a source stops at ``limit`` times its size, and the
    excess is shared again by weight among the others until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(limit * sizes[s] for s in full)
        share = left / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if share * weight[s] > limit * sizes[s]]
        if not over:
            return {s: float(limit * sizes[s]) if s in full else share * weight[s] for s in order}
        full.update(over)


def _rounds(source: int, epoch: int) -> list[int]:
    seed = hashlib.blake2b(f"{SEED}:{source}:{epoch}".encode(), digest_size=32).digest()
    return [int.from_bytes(seed[8 * k : 8 * k + 8], "little") | 1 for k in range(4)]


def permuted(index: np.ndarray, n: int, source: int, epoch: int, backward: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), evaluated at ``index`` without a table.

    Four Feistel rounds over the next even power of two, walked on until the value is below n.
    """
    half = max(1, (int(n - 1).bit_length() + 1) // 2) if n > 1 else 1
    mask = np.uint64((1 << half) - 1)
    keys = _rounds(source, epoch)

    def mix(x: np.ndarray, key: int) -> np.ndarray:
        x = (x + np.uint64(key & 0xFFFFFFFF)) * np.uint64(key)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        if backward:
            for key in reversed(keys):
                left, right = right ^ mix(left, key), left
        else:
            for key in keys:
                left, right = right, left ^ mix(right, key)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass
class Plan:
    """Of each source: words, blocks, target, whole passes, and slots and words of the last pass."""

    names: list
    sizes: list[int]
    target: list[float]
    blocks: list[int]
    passes: list[int]
    last_slots: list[int]
    last_trim: list[int]

    @property
    def slots(self) -> list[int]:
        return [p * b + m for p, b, m in zip(self.passes, self.blocks, self.last_slots, strict=True)]


def plan_mix(sizes: dict[str | None, int], block: int = BLOCK_WORDS) -> Plan:
    """Turns targets into slots: whole passes, then some blocks of one more, the last one cut."""
    want = targets(sizes)
    plan = Plan([], [], [], [], [], [], [])
    for k, s in enumerate(want):
        size, words = sizes[s], round(want[s])
        n = -(-size // block)
        full, rest = divmod(words, size) if size else (0, 0)
        slots, trim = 0, 0
        if rest:
            slots = -(-rest // block)
            tail = size - (n - 1) * block
            at = int(permuted(np.array([n - 1]), n, k, full, backward=True)[0])
            if at < slots and tail < block:
                # The short last block is among those taken: one more may be needed.
                slots = 1 if rest <= tail and at == 0 else -(-(rest - tail) // block) + 1
                if at >= slots:
                    slots = -(-rest // block)
            have = slots * block - (block - tail if at < slots else 0)
            trim = max(0, have - rest)
        for field, value in zip(
            (plan.names, plan.sizes, plan.target, plan.blocks, plan.passes, plan.last_slots, plan.last_trim),
            (s, size, want[s], n, full, slots, trim),
            strict=True,
        ):
            field.append(value)
    return plan


def shard_counts(slots: list[int], shard: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Source counts of a shard and the slots that earlier shards use, without visiting those.

    The totals are split between the halves of the shards by multinomial draws that are
    conditioned on them (hypergeometric), each seeded by its place in the tree; so every task
    draws the same numbers and the counts of all shards add up to the totals.
    """
    total = np.array(slots, dtype=np.int64)
    before = np.zeros(len(slots), dtype=np.int64)
    all_slots = int(total.sum())
    lo, hi = 0, shards
    start, end = 0, all_slots

    def edge(s: int) -> int:
        return all_slots * s // shards

    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = edge(mid) - start
        rng = np.random.default_rng([SEED, lo, hi])
        left, need, rest = np.zeros_like(total), take, end - start
        for k, n in enumerate(total.tolist()):
            got = _hypergeometric(rng, n, rest - n, need)
            left[k] = got
            need, rest = need - got, rest - n
        if shard < mid:
            total, hi, end = left, mid, edge(mid)
        else:
            before, total, lo, start = before + left, total - left, mid, edge(mid)
    return total, before


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw of any size; numpy's own up to 10^9."""
    if draws <= 0 or good <= 0:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    if bad <= 0:
        return draws
    n = good + bad
    if draws > n - draws:
        return good - _hypergeometric(rng, good, bad, n - draws)
    if good > bad:
        return draws - _hypergeometric(rng, bad, good, draws)
    return _by_ratio_of_uniforms(rng, good, bad, draws)


def _by_ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Hypergeometric draw by rejection (ratio of uniforms); needs good <= bad, draws <= half.

    Logarithms have 50 digits: in doubles they would lose the small differences that decide.
    """
    n = good + bad
    share = good / n
    spread = (draws * share * (1 - share) * (n - draws) / (n - 1) + 0.5) ** 0.5
    width = 2 * (2 / math.e) ** 0.5 * spread + 3 - 2 * (3 / math.e) ** 0.5
    centre = draws * share + 0.5
    mode = (draws + 1) * (good + 1) // (n + 2)

    def log_weight(k: int) -> Decimal:
        return -sum(_log_factorial(c) for c in (k, good - k, draws - k, bad - draws + k))

    with localcontext(prec=50):
        top = log_weight(mode)
        while True:
            u, v = 1 - rng.random(), rng.random()
            k = math.floor(centre + width * (v - 0.5) / u)
            if 0 <= k <= min(good, draws) and 2 * math.log(u) <= log_weight(k) - top:
                return k


def _log_factorial(n: int) -> Decimal:
    """Stirling's series; small numbers exactly."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    tail = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x + Decimal("0.5")) * x.ln() - x + Decimal(math.tau).ln() / 2 + tail


def _placed(docs: DataFrame) -> tuple[DataFrame, dict, dict]:
    """Documents with their first word's place in the source's stream, in a pseudorandom order.

    Prefix sums in two levels: over pieces of about PIECE_DOCS documents, then within a piece;
    so no task holds a source.
    """
    sized = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            row_key(F.coalesce("text", F.lit(""))).alias("text_key"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: int(r["size"]) for r in by_source}
    pieces = {r["source"]: max(1, r["n"] // PIECE_DOCS) for r in by_source}
    largest = max(pieces.values(), default=1)
    place = F.xxhash64(F.lit(SEED), "doc_id", "text_key")
    rows = sized.withColumns({"place": place, "piece": F.pmod(F.shiftrightunsigned(place, 20), F.lit(largest))})
    sums = rows.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("piece").alias("p"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start")
    )
    within = (
        Window.partitionBy("source", "piece")
        .orderBy("place", "doc_id", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p"))).select(
        "doc_id", "text_key", "source", "size", (F.col("start") + F.col("inside")).alias("start")
    )
    return placed, sizes, pieces


SLOTS = "shard long, slot long, source_no int, epoch long, block long, words long"


def draw_slots(docs: DataFrame, plan: Plan, block: int = BLOCK_WORDS) -> DataFrame:
    """Every slot of the mix: its shard, place in it, source, pass, block, and words to take."""
    spark = docs.sparkSession
    slots = plan.slots
    total = sum(slots)
    shards = max(1, -(-total // SHARD_BLOCKS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = shard_counts(slots, shard, shards)
                parts = []
                for k, n in enumerate(counts.tolist()):
                    if not n:
                        continue
                    slot = before[k] + np.arange(n)
                    epoch, inside = slot // plan.blocks[k], slot % plan.blocks[k]
                    number = np.empty(n, dtype=np.int64)
                    for e in np.unique(epoch).tolist():
                        mine = epoch == e
                        number[mine] = permuted(inside[mine], plan.blocks[k], k, e)
                    words = np.minimum(block, plan.sizes[k] - number * block)
                    words[slot == slots[k] - 1] -= plan.last_trim[k]
                    parts.append(np.stack([np.full(n, k), epoch, number, words]))
                if not parts:
                    continue
                rows = np.concatenate(parts, axis=1)
                # Sources are shuffled within the shard.
                order = np.random.default_rng([SEED, 1, shard]).permutation(rows.shape[1])
                rows = rows[:, order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows.shape[1], shard)),
                        pa.array(np.arange(rows.shape[1])),
                        pa.array(rows[0].astype(np.int32)),
                        *(pa.array(r) for r in rows[1:]),
                    ],
                    names=["shard", "slot", "source_no", "epoch", "block", "words"],
                )

    return spark.range(0, shards, 1, max(1, min(shards, 2000))).mapInArrow(deal, SLOTS)


def mix_sources(docs: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, Plan]:
    """The mix of ``doc_id, text, source``: (spans, placed documents, plan).

    Words are runs of other characters than ASCII white space; null and empty texts have none
    and are never taken.  A source's documents, in a pseudorandom order that depends on their
    ids and texts alone, form one stream of blocks of ``block`` words.  ``spans`` has one row
    for each piece of a document that a slot takes: ``doc_id, text_key, source, start, shard,
    slot, epoch, first, until`` (words of the document; ``start`` is its place in the stream).  A null source is a source; repeated rows
    are documents of their own with the same key; an empty table gives no rows.
    """
    spark = docs.sparkSession
    placed, sizes, _ = _placed(docs)
    placed = cut_lineage(placed, "placed")
    plan = plan_mix(sizes, block)
    slots = draw_slots(docs, plan, block)
    # One row a source: as many as there are sources, which the plan holds anyway.
    numbers = spark.createDataFrame(
        [(s, k) for k, s in enumerate(plan.names)], "s string, source_no int"
    )
    pieces = (
        placed.where("size > 0")
        .join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("s")))
        .select(
            "doc_id",
            "text_key",
            "source",
            "source_no",
            "start",
            "size",
            F.explode(
                F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
            ).alias("block"),
        )
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    spans = (
        # Slots are as many as blocks, which the planner can't know: never broadcast.
        pieces.join(slots.hint("shuffle_merge"), ["source_no", "block"])
        .where(low < high)
        .select(
            "doc_id",
            "text_key",
            "source",
            "start",
            "shard",
            "slot",
            "epoch",
            (low - F.col("start")).alias("first"),
            (high - F.col("start")).alias("until"),
        )
    )
    return spans, placed, plan


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document of the mix."""
    spark = docs.sparkSession
    spans, placed, plan = mix_sources(docs)
    # The share of each of the rows that repeat an id and a text.
    taken = spans.groupBy("doc_id", "text_key", "source").agg(F.sum(F.col("until") - F.col("first")).alias("words"))
    facts = spark.createDataFrame(
        [(s, n, t) for s, n, t in zip(plan.names, plan.sizes, plan.target, strict=True)],
        "s string, source_size long, target double",
    )
    t = taken.select(*[F.col(c).alias("t_" + c) for c in taken.columns])
    same = [F.col(c).eqNullSafe(F.col("t_" + c)) for c in ("doc_id", "text_key", "source")]
    groups = placed.groupBy("doc_id", "text_key", "source").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    joined = groups.join(t, same, "left").join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s")))
    words = F.coalesce("t_words", F.lit(0))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    each = F.floor(words / F.col("n")) + (F.col("copy") <= words % F.col("n")).cast("long")
    return copies.select("doc_id", "size", "source_size", "target", each.alias("taken"))



def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: for each pass one row with the words that it takes.

    A pass that takes a whole document gives its row unchanged; of a part it gives the spans
    in order, with the white space between their words, joined by a line end.  Other columns
    are kept, ``n_chars`` (where present) is set anew; documents that are not taken go.
    """


    spans, placed, _ = mix_sources(docs)
    word = re.compile(r"[^\x20\x09-\x0d]+")
    passes = spans.groupBy("doc_id", "text_key", "source", "start", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("first", "until"))).alias("spans"),
        F.sum(F.col("until") - F.col("first")).alias("words"),
    )
    names = docs.columns
    rows = docs.select(
        F.struct(*names).alias("row"),
        F.col("doc_id").alias("own_id"),
        row_key(F.coalesce("text", F.lit(""))).alias("own_key"),
        F.col("source").alias("own_source"),
    )
    # Of rows that repeat an id, text and source one stands for all; each has its own passes.
    repeated = (
        placed.groupBy("doc_id", "text_key", "source")
        .count()
        .where(F.col("count") > 1)
        .select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), F.col("source").alias("r_source"), "count")
    )
    marked = rows.join(
        repeated,
        (F.col("own_key") == F.col("r_key"))
        & F.col("own_id").eqNullSafe(F.col("r_id"))
        & F.col("own_source").eqNullSafe(F.col("r_source")),
        "left",
    )
    first = marked.where("count IS NOT NULL").groupBy("own_id", "own_key", "own_source").agg(F.first("row").alias("row"))
    rows = marked.where("count IS NULL").select(*rows.columns).unionByName(first)
    both = rows.join(
        passes,
        (F.col("own_key") == F.col("text_key"))
        & F.col("own_id").eqNullSafe(F.col("doc_id"))
        & F.col("own_source").eqNullSafe(F.col("source")),
    ).select("row", "spans", "words")

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, parts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            ends = [(m.start(), m.end()) for m in word.finditer(text)]
            pieces: list[list[int]] = []
            for p in parts:
                if pieces and pieces[-1][1] == p["first"]:
                    pieces[-1][1] = p["until"]
                else:
                    pieces.append([p["first"], p["until"]])
            if pieces == [[0, len(ends)]]:
                out.append(text)
            else:
                out.append("\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in pieces))
        return pa.array(out, pa.string())

    taken = both.withColumn("new", F.arrow_udf(cut, "string")("row.text", "spans"))
    columns = []
    for c in names:
        if c == "text":
            columns.append(F.col("new").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("new").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return taken.select(*columns)
