"""Helpers the operators share: words of Arrow batches, stable keys, bounded label samples, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickertide.session import cut_lineage

# Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(col).cast("string")) % divisor


def held_out(col: str, divisor: int, rest: int) -> Column:
    return F.coalesce(remainder(col, divisor) == rest, F.lit(False))


def row_key(*cols: Column) -> Column:
    """128 bits that name a value: two differently salted 64-bit hashes in hex."""
    return F.concat(
        F.lpad(F.hex(F.xxhash64(F.lit(11), *cols)), 16, "0"),
        F.lpad(F.hex(F.xxhash64(*cols, F.lit(23))), 16, "0"),
    )


def label_sample(
    docs: DataFrame, labels: DataFrame, target: str, learnable: Column, rows: int
) -> DataFrame:
    """``doc_id, text, <target>`` of at most ``rows`` labelled documents, picked by a hash of the id.

    The picked label rows are bounded by ``rows``, so they are broadcast and no text moves.  Of
    several labels of a document the smallest counts, so reruns agree.
    """
    picked = (
        labels.where(learnable & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col(target).cast("int")).alias(target))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


class Words:
    """Words (runs of other bytes than ASCII white space, A-Z lower-cased) of some rows of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, raw: np.ndarray):
        self.data, self.offsets, self.first, self.raw = data, offsets, first, raw
        space = _SPACE[data]
        inside = ~space
        n = len(data)
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = True
        after[edges - 1] = True
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.rows = len(offsets) - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same wherever the word stands."""
        powers, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=sums[1:])
        value = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix64(value + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.rows)


def word_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """The rows of a string column in slices of about SLICE_BYTES; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n)
        raw = data[offsets[i] : offsets[j]]
        yield Words(_LOWER[raw], offsets[i : j + 1] - offsets[i], i, raw)
        i = j


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles as (row, hash), sorted; a text of 1 to width-1 words is one shingle."""
    h, doc, n = words.hashes(), words.doc, len(words.doc)
    odd = [np.uint64((2 * k + 1) * 0x9FB21C651E98DF25 % (1 << 64)) for k in range(width)]
    whole = np.arange(max(0, n - width + 1))
    whole = whole[doc[whole] == doc[whole + width - 1]] if len(whole) else whole
    value = np.zeros(len(whole), dtype=np.uint64)
    for k in range(width):
        value += h[whole + k] * odd[k]
    rows, values = [doc[whole]], [mix64(value)]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        mine = np.flatnonzero((counts[doc] < width))
        place = mine - np.searchsorted(doc, doc[mine], side="left")
        parts = h[mine] * np.array(odd, dtype=np.uint64)[place]
        sums = np.zeros(words.rows, dtype=np.uint64)
        np.add.at(sums, doc[mine], parts)
        rows.append(short)
        values.append(mix64(sums[short] + counts[short].astype(np.uint64)))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[fresh], value[fresh]
    return row, value


def whole_units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal ``key`` of rows sorted by it, several runs a table."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        ids = rest[key].combine_chunks()
        if len(ids) and ids[0] != ids[-1]:
            codes = np.array(ids.dictionary_encode().indices)
            cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield rest


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) of undirected edges ``a, b``.

    Alternating large-star and small-star steps; every step is a grouped minimum and a join
    back, so a node with very many edges is reduced in the tasks first and its rows are split
    by adaptive execution.  Each round is written to the shared folder.
    """

    def star(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(low.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        now = cut_lineage(star(now), "edges")
        last, seen = seen, state(now)
        if last == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def finite_vectors(col: str) -> Column:
    """True for vectors that hold a component and only finite ones, not all of them zero."""
    v = F.col(col)
    return (
        v.isNotNull()
        & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
