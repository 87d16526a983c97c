"""N-gram Jaccard join: MinHash bands, Bayesian pruning of candidates, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickertide.llm.common import components, mix64, row_key, shingle_sets, whole_units, word_slices
from tickertide.session import cut_lineage

WIDTH = 5
THRESHOLD = 0.8
# At similarity 0.8 a pair shares none of 24 bands of 5 values with probability 7e-5.
BANDS, ROWS = 24, 5
PERMS = BANDS * ROWS
# A pair goes when its chance of reaching the threshold falls below this.
TOLERANCE = 1e-5
STEP = 20
# Members of a bucket compared in one piece; larger buckets are compared block by block.
BLOCK = 1024

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 62, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_SALT = np.uint64(0xA0761D6478BD642F)

SIGNED = "doc_id long, text_key string, node string, shingles long, signature binary"
_SIGNED_TYPES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.string()),
        ("node", pa.string()),
        ("shingles", pa.int64()),
        ("signature", pa.binary()),
    ]
)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest matches with which a pair is kept.

    With a uniform prior the similarity given m matches of n is Beta(m+1, n-m+1), and its
    chance of being at least t is that of at most m successes in n+1 draws of chance t.
    """
    out = {}
    for n in range(STEP, PERMS + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def signatures(texts: pa.Array, width: int = WIDTH) -> tuple[list[str | None], np.ndarray, list[bytes | None]]:
    """Name of each text's shingle set, the set's size, and its MinHash values (null: no word)."""
    names: list[str | None] = []
    sizes, marks = [], []
    for w in word_slices(texts):
        row, value = shingle_sets(w, width)
        have, at, count = np.unique(row, return_index=True, return_counts=True)
        size = np.zeros(w.rows, dtype=np.int64)
        size[have] = count
        sizes.append(size)
        name: list[str | None] = [None] * w.rows
        mark: list[bytes | None] = [None] * w.rows
        if len(have):
            sums = [np.add.reduceat(mix64(value ^ s), at) for s in (np.uint64(0), _SALT)]
            sums[1] = mix64(sums[1] + count.astype(np.uint64))
            low = np.empty((len(have), PERMS), dtype=np.uint32)
            for p in range(PERMS):
                hashed = (value * _MULTIPLIERS[p] + _SHIFTS[p]) >> np.uint64(32)
                low[:, p] = np.minimum.reduceat(hashed, at)
            for k, r in enumerate(have):
                name[r] = f"{sums[0][k]:016x}{sums[1][k]:016x}"
                mark[r] = low[k].tobytes()
        names += name
        marks += mark
    return names, np.concatenate(sizes) if sizes else np.zeros(0, np.int64), marks


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, sizes, marks = signatures(b.column(2))
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pa.array(names, pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(marks, pa.binary()),
            ],
            schema=_SIGNED_TYPES,
        )


def _runs(t: pa.Table) -> list[tuple[int, int]]:
    codes = np.array(t["unit"].combine_chunks().dictionary_encode().indices)
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return list(zip(edges, edges[1:], strict=False))


def _pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare in the units of a table: within a block, or between two.

    Pairs of small units are given together; those of a large one in strips.
    """
    side = np.array(t["side"].combine_chunks())
    by_size: dict[tuple[int, int], list[int]] = {}
    for lo, hi in _runs(t):
        n_left = int((side[lo:hi] == 0).sum())
        by_size.setdefault((n_left, hi - lo - n_left), []).append(lo)
    for (left, right), starts in by_size.items():
        if right:
            i, j = (x.ravel() for x in np.meshgrid(np.arange(left), left + np.arange(right), indexing="ij"))
        else:
            i, j = np.triu_indices(left, 1)
        per = max(1, 200_000 // max(len(i), 1))
        for k in range(0, len(starts), per):
            base = np.array(starts[k : k + per])[:, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            for s in range(0, len(a), 200_000):
                yield a[s : s + 200_000], b[s : s + 200_000]


def _survivors(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that Bayesian pruning keeps, each in the first band that its members share."""
    marks = np.frombuffer(b"".join(t["signature"].to_pylist()), dtype=np.uint32).reshape(-1, PERMS)
    band = np.array(t["band"].combine_chunks())
    least = least_matches()
    for a, b in _pairs(t):
        matches = np.zeros(len(a), dtype=np.int64)
        for n in range(STEP, PERMS + 1, STEP):
            part = slice(n - STEP, n)
            matches += (marks[a, part] == marks[b, part]).sum(axis=1)
            keep = matches >= least[n]
            a, b, matches = a[keep], b[keep], matches[keep]
        if len(a):
            shared = (marks[a] == marks[b]).reshape(-1, BANDS, ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band[a]
            a, b = a[first], b[first]
        if len(a):
            yield a, b


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of units that still have a pair to verify."""
    for t in whole_units(batches, "unit"):
        alive = np.zeros(len(t), dtype=bool)
        for a, b in _survivors(t):
            alive[a] = alive[b] = True
        yield from t.filter(pa.array(alive)).to_batches()


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared shingles of pairs, by products of 0/1 matrices over shingles that two members hold."""
    members = np.unique(np.concatenate([a, b]))
    if len(members) <= 4:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    place = {m: k for k, m in enumerate(members.tolist())}
    who = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    _, code, count = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
    use = count[code] > 1
    who, code = who[use], np.unique(code[use], return_inverse=True)[1]
    i, j = (np.array([place[x] for x in s.tolist()]) for s in (a, b))
    width = max(1, (1 << 22) // len(members))
    order = np.argsort(code, kind="stable")
    who, code = who[order], code[order]
    total = np.zeros((len(members), len(members)), dtype=np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        s, e = np.searchsorted(code, [lo, lo + width])
        part = np.zeros((len(members), width), dtype=np.float32)
        part[who[s:e], code[s:e] - lo] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a unit that has links there: their weight and the smallest member it reaches."""
    schema = pa.schema([("node", pa.string()), ("root", pa.string()), ("links", pa.int64())])
    for t in whole_units(batches, "unit"):
        sets: list[np.ndarray] = []
        for w in word_slices(t["text"]):
            row, value = shingle_sets(w)
            cut = np.searchsorted(row, np.arange(w.rows + 1))
            sets += [value[cut[k] : cut[k + 1]] for k in range(w.rows)]
        size = np.array([len(s) for s in sets])
        node, copies = t["node"].to_pylist(), np.array(t["copies"].combine_chunks())
        codes = np.array(t["unit"].combine_chunks().dictionary_encode().indices)
        links = np.zeros(len(t), dtype=np.int64)
        parent = list(range(len(t)))

        def find(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in _survivors(t):
            order = np.argsort(codes[a], kind="stable")
            a, b = a[order], b[order]
            edges = np.append(np.flatnonzero(np.diff(codes[a], prepend=-1)), len(a))
            for lo, hi in zip(edges, edges[1:], strict=False):
                i, j = a[lo:hi], b[lo:hi]
                shared = _overlaps(sets, i, j)
                good = shared / (size[i] + size[j] - shared) >= THRESHOLD
                i, j = i[good], j[good]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        mine = np.flatnonzero(links)
        roots = [find(k) for k in mine.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([node[k] for k in mine], pa.string()),
                pa.array([node[r] for r in roots], pa.string()),
                pa.array(links[mine], pa.int64()),
            ],
            schema=schema,
        )


def _members(nodes: DataFrame) -> DataFrame:
    """``unit, band, side, node``: who meets whom.  A unit is a bucket or two blocks of it.

    Buckets are counted with partial sums before any row of theirs moves, so that those of one
    member, nearly all, are gone before the signatures follow.
    """
    marks = nodes.where("signature IS NOT NULL").select(
        "node",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda k: F.xxhash64(k, F.expr("signature").substr(k * (4 * ROWS) + 1, F.lit(4 * ROWS))),
            )
        ).alias("band", "bucket"),
    )
    sizes = marks.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = marks.join(sizes, ["band", "bucket"]).withColumns(
        {"blocks": blocks, "own": F.pmod(F.xxhash64("node", "band"), blocks).cast("int")}
    )
    return met.select(
        "node",
        "band",
        "bucket",
        "own",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "node",
        "band",
        F.concat_ws(":", "band", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def ngram_join(docs: DataFrame) -> DataFrame:
    """Near duplicates of ``doc_id, text``: one row per document with its class and links.

    Returns ``doc_id, text_key, class_id, n_links, n_same, kept``.  Two documents are linked if
    the Jaccard similarity of their sets of five-word shingles (words between ASCII white space,
    A-Z lower-cased; a text of one to four words is one shingle) is at least 0.8.  ``class_id``
    is the smallest doc_id that links reach, ``n_links`` the number of other documents linked
    directly, ``n_same`` the number of rows with this doc_id and text, ``kept`` marks the
    document that stands for its class.  Null, empty and blank texts have no shingles and link
    with nothing: each is a class of its own.  A null doc_id stands after all others; a class of
    such documents only has a null ``class_id``.  Repeated rows are linked copies; other columns
    are ignored; an empty table gives no rows.

    Documents of the same shingle set are one node, so a set that a third of all rows share is
    compared once.  Nodes meet in bands; buckets of more than BLOCK nodes are compared block by
    block, no row is made for a pair, and each pair is judged in the first band it shares.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.coalesce("text", F.lit(""))).alias("text_key"), "text"
    )
    signed = cut_lineage(rows.mapInArrow(_sign, SIGNED), "signed")
    # Null ids last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    nodes = cut_lineage(
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.count("*").alias("copies"),
            first.alias("first"),
            F.first("signature").alias("signature"),
        ),
        "nodes",
    )
    # Pass 1: signatures meet; only members of surviving pairs go on.
    met = (
        _members(nodes)
        .join(nodes.select("node", "signature"), "node")
        .repartition("unit")
        .sortWithinPartitions("unit", "side", "node")
    )
    alive = cut_lineage(met.select("unit", "band", "side", "node", "signature").mapInArrow(
        _prune, "unit string, band int, side int, node string, signature binary"
    ), "alive")
    # Pass 2: their texts, fetched once per text.
    wanted = alive.select("node").distinct().join(nodes, "node").select(
        "node", "copies", F.col("first.text_key").alias("text_key")
    )
    texts = (
        rows.join(wanted.select("text_key"), "text_key", "left_semi")
        .groupBy("text_key")
        .agg(F.first("text").alias("text"))
        .join(wanted, "text_key")
        .select("node", "copies", "text")
    )
    verified = cut_lineage(
        alive.join(texts, "node")
        .select("unit", "band", "side", "node", "signature", "copies", "text")
        .repartition("unit")
        .sortWithinPartitions("unit", "side", "node")
        .mapInArrow(_verify, "node string, root string, links long"),
        "verified",
    )
    found = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = (
        nodes.select("node", "copies", "first")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    classes = grouped.groupBy("component").agg(F.min("first").alias("head"))
    degrees = verified.groupBy("node").agg(F.sum("links").alias("links"))
    answer = (
        grouped.join(classes, "component")
        .join(degrees, "node", "left")
        .select("node", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    same = (
        signed.groupBy("doc_id", "text_key", "node").agg(F.count("*").alias("n_same")).join(answer, "node", "left")
    )
    mine = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    lone = F.col("head").isNull()
    return same.select(
        "doc_id",
        "text_key",
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n_same"),
        (lone | (F.col("head").eqNullSafe(mine))).alias("kept"),
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest doc_id.

    Of rows that repeat a kept doc_id and text one stays; documents without words all stay.
    Every other column is kept as it is.
    """
    names = docs.columns
    key = row_key(F.coalesce("text", F.lit("")))
    kept = ngram_join(docs).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "n_same", "n_links"
    )
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("own_id"), key.alias("own_key"))
    left = rows.join(kept, (F.col("own_key") == F.col("kept_key")) & F.col("own_id").eqNullSafe(F.col("kept_id")))
    # Repeats of a row that has words are linked to each other; without words they are not.
    repeats = (F.col("n_same") > 1) & (F.col("n_links") > 0)
    once = left.where(~repeats).select("row.*")
    first = left.where(repeats).groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(first)
