"""Alignment of two tokenizers' tokens: their byte ends are merged in pieces of equal work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickertide.llm.chunk_ids import ChunkIds, byte_pair_ids, ship_vocabulary, text_slices, worker_coder
from tickertide.session import cut_lineage

# Ends of A and B together that one piece merges.
PIECE_ENDS = 1 << 16
# Distinct id pairs a task holds before it hands their counts on.
HELD_PAIRS = 2_000_000
# Pairs whose counts every task gets (24 bytes each); all others are joined.
COMMON_PAIRS = 1_000_000
# A pair is one number: A's id times this, and B's id.
B_IDS = 1 << 31

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
)


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves."""
    own = {b for first, last in ((33, 126), (161, 172), (174, 255)) for b in range(first, last + 1)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def make_coder(byte_level: bytes, pieces: bytes) -> ChunkIds:
    """Ids of both vocabularies for chunks that begin with a blank.

    Chunks whose tokens' bytes aren't the chunk have no ids.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(byte_level.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    a_ids = byte_pair_ids(a)
    a_bytes, b_bytes = token_bytes(a, b)
    blank = [b.piece_to_id("▁")]

    def code(chunks: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        a_sizes, a_flat = a_ids(chunks)
        # B puts a blank before each text itself, unless the text is empty.
        found = [x or blank for x in b.encode([c[1:] for c in chunks], num_threads=1)]
        b_sizes = np.array([len(x) for x in found], dtype=np.int64)
        b_flat = np.array([i for x in found for i in x], dtype=np.uint32)
        valid = np.ones(len(chunks), dtype=bool)
        at, ids = 0, a_flat.tolist()
        for k, (c, n, own) in enumerate(zip(chunks, a_sizes.tolist(), found, strict=True)):
            data = c.encode()
            valid[k] = b"".join([b_bytes[i] for i in own]) == data == b"".join([a_bytes[i] for i in ids[at : at + n]])
            at += n
        return [(a_sizes, a_flat), (b_sizes, b_flat)], valid

    coder = ChunkIds(code, streams=2, blanks_only=True)
    coder.a_size = np.array([len(x) for x in a_bytes], dtype=np.int64)
    coder.b_size = np.array([len(x) for x in b_bytes], dtype=np.int64)
    return coder


def token_bytes(a: object, b: object) -> tuple[list[bytes], list[bytes]]:
    """The bytes of every id of a byte-level vocabulary and of a piece model."""
    letters = byte_letters()

    def byte_level(token: str) -> bytes:
        known = all(c in letters for c in token)
        return bytes(letters[c] for c in token) if known else token.encode()

    def piece(i: int) -> bytes:
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    entries = a.get_vocab(with_added_tokens=False)
    of_a = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        of_a[i] = byte_level(token)
    return of_a, [piece(i) for i in range(b.get_piece_size())]


def merge_cuts(ea: np.ndarray, eb: np.ndarray, work: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in both lists of ends: every ``work`` steps of their merge, A first in ties.

    Each diagonal's place is found by binary search alone, all diagonals at once, so pieces are
    of equal work however the ends lie.
    """
    na, nb = len(ea), len(eb)
    steps = np.append(np.arange(0, na + nb, work), na + nb)
    low, high = np.maximum(0, steps - nb), np.minimum(steps, na)
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        at_a, at_b = np.where(open_, middle, 0), np.where(open_, steps - 1 - middle, 0)
        first = open_ & (ea[at_a] <= eb[at_b])
        low = np.where(first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, steps - low


def piece_links(ea: np.ndarray, eb: np.ndarray, i: int, j: int, i_end: int, j_end: int) -> np.ndarray:
    """Links of one piece as columns: end, index of the A token and of the B token that cover it.

    Between two ends next to each other lies exactly one pair of overlapping tokens.
    """
    own_a, own_b = ea[i:i_end], eb[j:j_end]
    ends = np.concatenate([own_a, own_b])
    ends.sort(kind="stable")
    if len(ends):
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
    return np.stack([ends, i + np.searchsorted(own_a, ends), j + np.searchsorted(own_b, ends)])


def merged_links(ea: np.ndarray, eb: np.ndarray, work: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """All links (end, A index, B index), and which of them end a group, from stitched pieces.

    An end that both lists have may be cut by a piece's border; the piece after it then repeats
    the border's end, which is left out.
    """
    i, j = merge_cuts(ea, eb, work)
    parts = []
    last = -1
    for k in range(len(i) - 1):
        found = piece_links(ea, eb, int(i[k]), int(j[k]), int(i[k + 1]), int(j[k + 1]))
        if found.shape[1] and found[0, 0] == last:
            found = found[:, 1:]
        if found.shape[1]:
            last = int(found[0, -1])
        parts.append(found)
    links = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), dtype=np.int64)
    return links, (ea[links[1]] == links[0]) & (eb[links[2]] == links[0])


def group_texts(
    a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, words: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The written tokens of all groups in order, and where each A and B token stands in it."""
    n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
    in_a, in_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]
    place_b = np.arange(len(b)) + np.cumsum(in_a)[b_group]
    out = np.empty(len(a) + len(b), dtype=object)
    comma, bar, semicolon = words
    last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
    out[place_a], out[place_b] = comma[a], comma[b]
    out[place_a[last_a]], out[place_b[last_b]] = bar[a[last_a]], semicolon[b[last_b]]
    return out, place_a, place_b


def _written(size: int) -> list[np.ndarray]:
    return [np.array([f"{k}{mark}" for k in range(size)], dtype=object) for mark in ",|;"]


_words: dict[int, list[np.ndarray]] = {}


def align_slice(
    a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, coder: ChunkIds, work: int = PIECE_ENDS
) -> Iterator[tuple[int, int, str, bytes]]:
    """Groups, links, digest of the groups and packed id pairs of each text of a slice.

    All texts' tokens stand one behind the other, so pieces have equal work whatever the texts'
    lengths; as both tokenizers end where a text ends, no group reaches into the next text.
    """
    ea, eb = np.cumsum(coder.a_size[a]), np.cumsum(coder.b_size[b])
    links, closed = merged_links(ea, eb, work)
    common = links[0][closed]
    size = max(len(coder.a_size), len(coder.b_size))
    if size not in _words:
        _words[size] = _written(size)
    out, place_a, _ = group_texts(a, b, np.searchsorted(common, ea), np.searchsorted(common, eb), _words[size])
    text_ends = np.append(ea, 0)[np.maximum(a_bounds[1:], 1) - 1] * (a_bounds[1:] > 0)
    link_to = np.searchsorted(links[0], text_ends, side="right")
    group_to = np.searchsorted(common, text_ends, side="right")
    link_from, group_from = np.append(0, link_to[:-1]), np.append(0, group_to[:-1])
    pair = a[links[1]].astype(np.int64) * B_IDS + b[links[2]]
    packer = zstandard.ZstdCompressor(level=1)
    written = out.tolist()
    for k in range(len(text_ends)):
        lo, hi = a_bounds[k] + b_bounds[k], a_bounds[k + 1] + b_bounds[k + 1]
        if lo == hi:
            yield 0, 0, "", b""
            continue
        text = "".join(written[lo:hi])[:-1]
        digest = hashlib.sha256(text.encode()).hexdigest()
        pairs, times = np.unique(pair[link_from[k] : link_to[k]], return_counts=True)
        packed = packer.compress(np.diff(pairs, prepend=0).tobytes() + times.astype(np.uint32).tobytes())
        yield int(group_to[k] - group_from[k]), int(link_to[k] - link_from[k]), digest, packed


def unpacked(pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs of a text, ascending, and how often each is linked in it."""
    if not pairs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = zstandard.ZstdDecompressor().decompress(pairs)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, np.int64, n)), np.frombuffer(data, np.uint32, n, 8 * n).astype(np.int64)


def align_texts(docs: DataFrame, byte_level_path: str, pieces_path: str, work: int = PIECE_ENDS) -> DataFrame:
    """One row per row of ``doc_id, text``: token, group and link numbers, digest, and id pairs.

    A is a byte-level vocabulary of the tokenizers library and encodes a blank and the text with
    special tokens as plain text; B is a sentencepiece model, which adds the blank itself.  Texts
    that are null, empty, or not given back by both vocabularies' bytes have no tokens: zeros and
    an empty digest.  Rows that repeat are texts of their own, told apart by ``row``; other
    columns are ignored; an empty table gives no rows.  ``pairs`` is read by ``unpacked``.
    """
    spark = docs.sparkSession
    first, second = ship_vocabulary(spark, byte_level_path), ship_vocabulary(spark, pieces_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder("aligned", make_coder, first.value, second.value)
        for batch in batches:
            for data, offsets, at in text_slices(batch.column(2), b" "):
                ((a, a_bounds), (b, b_bounds)), fits = coder.encode(data, offsets)
                if not fits.all():
                    a, a_bounds = _without(a, a_bounds, fits)
                    b, b_bounds = _without(b, b_bounds, fits)
                found = list(align_slice(a, a_bounds, b, b_bounds, coder, work))
                groups, links, digests, pairs = zip(*found, strict=True)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        batch.column(1).slice(at, n),
                        pa.array(np.diff(a_bounds)),
                        pa.array(np.diff(b_bounds)),
                        pa.array(groups, pa.int64()),
                        pa.array(links, pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(pairs, pa.binary()),
                    ],
                    names=[x.split()[0] for x in ALIGNED.split(", ")],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return rows.mapInArrow(run, ALIGNED)


def _without(ids: np.ndarray, bounds: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(bounds)
    return ids[np.repeat(fits, sizes)], np.concatenate([[0], np.cumsum(np.where(fits, sizes, 0))])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: in how many texts each id pair is linked; summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        fresh: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, times = np.unique(np.concatenate([np.zeros(0, np.int64), *fresh]), return_counts=True)
            both = np.concatenate([held[0], pairs])
            values, which = np.unique(both, return_inverse=True)
            return values, np.bincount(
                which, weights=np.concatenate([held[1], times]), minlength=len(values)
            ).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["pair", "n"])

        for batch in batches:
            for packed in batch.column(0):
                pairs, _ = unpacked(packed.as_buffer().to_pybytes())
                fresh.append(pairs)
                size += len(pairs)
                if size > HELD_PAIRS:
                    held, fresh, size = summed(), [], 0
                    if len(held[0]) > HELD_PAIRS:
                        yield out()
                        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        held = summed()
        yield out()

    partial = aligned.select("pairs").mapInArrow(count, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def rated_pairs(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: counts of texts, and whether no other B id has a higher one with this A id."""
    counts = cut_lineage(pair_counts(aligned), "pairs")
    a = F.floor(F.col("pair") / B_IDS).alias("a")
    # One row for each A id.
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))
    rated = counts.withColumn("a", a).join(highest, "a")
    return rated.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _common(rated: DataFrame, most: int) -> tuple[int, list[np.ndarray]]:
    """The least power of two that at most ``most`` pairs' counts reach, and those pairs."""
    # At most 64 rows.
    steps = rated.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("pairs"))
    reached, least = 0, 64
    for r in steps.orderBy(F.desc("step")).collect():
        reached += r.pairs
        if reached > most:
            break
        least = r.step
    found = rated.where(F.col("n") >= F.lit(2).cast("double") ** least).toArrow()
    pairs = found["pair"].to_numpy()
    order = np.argsort(pairs)
    return least, [x.to_numpy()[order] for x in found.columns]


def alignment_report(aligned: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text.

    The counts of the commonest pairs, at most ``common_pairs``, are sent to the tasks; the rest
    of each text's pairs meet theirs in a join, so the result doesn't depend on that bound.
    """
    spark = aligned.sparkSession
    stored = cut_lineage(aligned, "aligned")
    rated = cut_lineage(rated_pairs(stored), "rated")
    _, columns = _common(rated, common_pairs)
    sent = spark.sparkContext.broadcast(columns)
    kept = [c for c in stored.columns if c != "pairs"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            bests, sums, rare_pairs, rare_times, sizes = [], [], [], [], []
            for packed in batch.column(len(kept)):
                pairs, times = unpacked(packed.as_buffer().to_pybytes())
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
                at, hits = at[hit], times[hit]
                bests.append(int(hits[best[at]].sum()) if len(at) else 0)
                sums.append(int((hits * n[at]).sum()) if len(at) else 0)
                rare_pairs.append(pairs[~hit])
                rare_times.append(times[~hit])
                sizes.append(int((~hit).sum()))
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            rare = pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.int64), *rare_pairs])),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *rare_times])),
                ],
                names=["pair", "times"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(len(kept))),
                    pa.array(bests, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.ListArray.from_arrays(bounds, rare),
                ],
                names=[*kept, "n_best", "count_sum", "rare"],
            )

    types = ALIGNED.replace(", pairs binary", "") + ", n_best long, count_sum long, "
    types += "rare array<struct<pair: long, times: long>>"
    part = cut_lineage(stored.select(*kept, "pairs").mapInArrow(score, types), "scored")
    others = part.select("row", F.inline("rare")).join(rated, "pair")
    more = others.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    zero = F.lit(0)
    return part.join(more, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
