"""Embedding near-dedup by NN-descent over a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickertide.llm.common import components, finite_vectors, matrix, row_key, whole_units
from tickertide.session import cut_lineage

THRESHOLD = 0.98
NEIGHBOURS = 12
# Weaker neighbours don't lead to pairs above the threshold and aren't kept in lists.
FLOOR = 0.85
# Starting graph: random hyperplanes group vectors into cells of about CELL members.
TABLES, CELL, PIECE = 6, 64, 128
MAX_STEPS = 5
# Vectors of a component compared in one piece.
BLOCK = 512
# The audit's sample grows to AUDIT_LARGEST vectors of each kind while it holds no link.
AUDIT_VECTORS, AUDIT_LARGEST, AUDIT_RECALL = 1000, 8000, 0.999
LEAST_ROUNDS_UNMEASURED, MAX_ROUNDS = 2, 8
CODE_BITS = 30

LISTS = "id long, nbrs array<long>, sims array<float>"
_LIST_TYPES = pa.schema(
    [("id", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32()))]
)


def _runs(codes: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return list(zip(edges, edges[1:], strict=False))


def _unit_codes(t: pa.Table) -> np.ndarray:
    return np.array(t["unit"].combine_chunks().dictionary_encode().indices)


def _lists(v: pa.ChunkedArray, rows: tuple[int, int]) -> np.ndarray:
    return matrix(v.slice(rows[0], rows[1] - rows[0]))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All members of a unit meet: for each the best others, at most NEIGHBOURS above FLOOR."""
    for t in whole_units(batches, "unit"):
        ids = np.array(t["id"].combine_chunks())
        who, nbrs, sims = [], [], []
        for lo, hi in _runs(_unit_codes(t)):
            if hi - lo < 2:
                continue
            x = _lists(t["x"], (lo, hi))
            s = x @ x.T
            np.fill_diagonal(s, -1)
            live = np.flatnonzero(s.max(axis=1) >= FLOOR)
            for k in live.tolist():
                near = np.flatnonzero(s[k] >= FLOOR)
                near = near[np.argsort(-s[k, near], kind="stable")[:NEIGHBOURS]]
                who.append(ids[lo + k])
                nbrs.append(ids[lo + near].tolist())
                sims.append(s[k, near].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(who, pa.int64()), pa.array(nbrs, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32()))],
            schema=_LIST_TYPES,
        )


def _merge(nbrs: pa.Array, sims: pa.Array) -> pa.Array:
    """The best NEIGHBOURS of several lists, each neighbour once."""
    out = []
    for n, s in zip(nbrs.to_pylist(), sims.to_pylist(), strict=True):
        best: dict[int, float] = {}
        for i, v in zip(n, s, strict=True):
            if v > best.get(i, -2):
                best[i] = v
        top = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:NEIGHBOURS]
        out.append([{"id": i, "sim": v} for i, v in top])
    return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("sim", pa.float32())])))


def merged(lists: DataFrame) -> DataFrame:
    """One list a vector.  A vector's lists are few: distinct vectors bound how often one is near."""
    best = F.arrow_udf(_merge, "array<struct<id:long,sim:float>>")
    return (
        lists.groupBy("id")
        .agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"), F.flatten(F.collect_list("sims")).alias("sims"))
        .select("id", best("nbrs", "sims").alias("l"))
        .select("id", F.col("l.id").alias("nbrs"), F.col("l.sim").alias("sims"))
    )


def _in_pieces(members: DataFrame, keys: list[str], salt: int, size: int = PIECE) -> DataFrame:
    """``unit`` of each member: its group, split at random into pieces of about ``size``."""
    counts = members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / size)
    return members.join(counts, keys).select(
        "id",
        F.concat_ws(
            ":", *keys, F.pmod(F.xxhash64("id", F.lit(salt)), pieces)
        ).alias("unit"),
    )


def _meet(units: DataFrame, nodes: DataFrame) -> DataFrame:
    return (
        units.join(nodes.select("id", "x"), "id")
        .select("unit", "id", "x")
        .repartition("unit")
        .sortWithinPartitions("unit", "id")
        .mapInArrow(_local_join, LISTS)
    )


def _start(nodes: DataFrame, round_: int) -> DataFrame:
    """A first graph: vectors on the same side of some random hyperplanes meet."""

    def codes(x: pa.Array) -> pa.Array:
        out = np.zeros((len(x), TABLES), dtype=np.int64)
        sizes = np.array(pc.list_value_length(x))
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            v = matrix(x.take(pa.array(rows)))
            planes = np.random.default_rng([17, round_, d]).normal(size=(d, TABLES * CODE_BITS))
            bits = (v @ planes > 0).reshape(len(v), TABLES, CODE_BITS).astype(np.int64)
            out[rows] = (bits << np.arange(CODE_BITS)[::-1]).sum(axis=2)
        return pa.array(out.tolist(), pa.list_(pa.int64()))

    sizes = nodes.groupBy("grp").agg(
        F.least(F.lit(CODE_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / CELL)))).cast("int").alias("bits")
    )
    marks = (
        nodes.select("id", "grp", F.posexplode(F.arrow_udf(codes, "array<bigint>")("x")).alias("tab", "code"))
        .join(sizes, "grp")
        .select("id", "grp", "tab", F.call_function("shiftright", F.col("code"), F.lit(CODE_BITS) - F.col("bits")).alias("cell"))
    )
    return _meet(_in_pieces(marks, ["grp", "tab", "cell"], round_), nodes)


def _step(lists: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """Neighbours of neighbours: around each vector, it and all vectors listed with it meet."""
    pairs = lists.select("id", F.explode("nbrs").alias("other"))
    members = (
        pairs.select(F.col("id").alias("centre"), F.col("other").alias("id"))
        .union(pairs.select(F.col("other").alias("centre"), "id"))
        .union(pairs.select(F.col("id").alias("centre"), "id"))
        .union(pairs.select(F.col("other").alias("centre"), F.col("other").alias("id")))
        .distinct()
    )
    return _meet(_in_pieces(members, ["centre"], salt), nodes)


def _state(lists: DataFrame) -> tuple[int, float]:
    r = lists.agg(F.sum(F.size("nbrs")).alias("n"), F.sum(F.aggregate("sims", F.lit(0.0), lambda a, s: a + s)).alias("s")).first()
    return r["n"] or 0, r["s"] or 0.0


def neighbour_graph(nodes: DataFrame, round_: int, before: DataFrame | None = None) -> DataFrame:
    """NN-descent: a starting graph, then joins of neighbours of neighbours until lists stand still."""
    fresh = _start(nodes, round_)
    lists = cut_lineage(merged(fresh if before is None else fresh.union(before)), "lists")
    seen = _state(lists)
    for step in range(MAX_STEPS):
        if not seen[0]:
            break
        lists = cut_lineage(merged(lists.union(_step(lists, nodes, 100 * round_ + step))), "lists")
        last, seen = seen, _state(lists)
        if seen[0] - last[0] <= 0.001 * last[0] and seen[1] - last[1] <= 0.001 * abs(last[1]):
            break
    return lists


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links in a unit (one block, or two): summed copies, and the smallest member reached."""
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    for t in whole_units(batches, "unit"):
        ids, copies = np.array(t["id"].combine_chunks()), np.array(t["copies"].combine_chunks())
        side = np.array(t["side"].combine_chunks())
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in _runs(_unit_codes(t)):
            cut = lo + int((side[lo:hi] == 0).sum())
            x = _lists(t["x"], (lo, hi))
            two = lo < cut < hi
            link = (x[: cut - lo] @ x[cut - lo :].T if two else x @ x.T) >= THRESHOLD
            if two:
                links = np.concatenate([link @ copies[cut:hi], copies[lo:cut] @ link])
                full = np.zeros((hi - lo, hi - lo), dtype=bool)
                full[: cut - lo, cut - lo :] = link
                full |= full.T
            else:
                np.fill_diagonal(link, False)
                full, links = link, link @ copies[lo:hi]
            # Smallest reachable place, by repeated minima over links.
            root = np.arange(hi - lo)
            while True:
                low = np.minimum(root, np.where(full, root[None, :], hi - lo).min(axis=1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            mine = np.flatnonzero(links)
            out[0].append(ids[lo + mine])
            out[1].append(ids[lo + root[mine]])
            out[2].append(links[mine])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], schema=schema
        )


def _verified(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists of saturated vectors are enlarged to their whole component, then tested exactly.

    A vector whose NEIGHBOURS are all above the threshold may have more; everything that
    threshold edges reach from it is then compared with it, block by block.  Components without
    such vectors are treated alike: they are small.
    """
    near = lists.select("id", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).where(
        F.col("e.sims") >= THRESHOLD - 1e-4
    )
    groups = components(near.select(F.col("id").alias("a"), F.col("e.nbrs").alias("b")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    units = (
        groups.join(groups.groupBy("component").agg(F.count("*").alias("n")), "component")
        .select("node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
        .select("node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            F.col("node").alias("id"),
            F.concat_ws(":", "component", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )
    return cut_lineage(
        units.join(nodes.select("id", "x", "copies"), "id")
        .select("unit", "side", "id", "copies", "x")
        .repartition("unit")
        .sortWithinPartitions("unit", "side", "id")
        .mapInArrow(_verify, "id long, root long, links long"),
        "verified",
    )


def audit_recall(nodes: DataFrame, lists: DataFrame, verified: DataFrame, sample: int = AUDIT_VECTORS) -> float | None:
    """Share of the true links of a sample of vectors that were found; the sample meets all rows.

    Half of the sample is drawn from all vectors, half from those with a candidate neighbour,
    so that rare links are met too.  ``None``: the sample has no true link, nothing is measured.
    """
    spread = [F.xxhash64("id", F.lit(5)), F.col("id")]
    listed = nodes.join(lists.where(F.size("nbrs") > 0).select("id"), "id", "left_semi")
    drawn = [d.select("id", "grp", "x").orderBy(*spread).limit(sample) for d in (nodes, listed)]
    got = drawn[0].union(drawn[1]).dropDuplicates(["id"]).toArrow()
    sets = {}
    for grp in set(got["grp"].to_pylist()):
        rows = [k for k, g in enumerate(got["grp"].to_pylist()) if g == grp]
        sets[grp] = (np.array(got["id"])[rows], matrix(got["x"].take(pa.array(rows))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            groups, ids, copies = np.array(b.column(1).to_pylist(), dtype=object), np.array(b.column(0)), np.array(b.column(2))
            for grp in set(groups.tolist()) & set(sets):
                rows = np.flatnonzero(groups == grp)
                s_id, s = sets[grp]
                link = s @ matrix(b.column(3).take(pa.array(rows))).T >= THRESHOLD
                link &= s_id[:, None] != ids[rows][None, :]
                for k, c in zip(s_id.tolist(), (link @ copies[rows]).tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "links"]
        )

    true = nodes.select("id", "grp", "copies", "x").mapInArrow(count, "id long, links long")
    true = true.groupBy("id").agg(F.sum("links").alias("there")).where("there > 0")
    mine = verified.groupBy("id").agg(F.sum("links").alias("links"))
    r = true.join(mine, "id", "left").agg(F.sum("there").alias("t"), F.sum("links").alias("f")).first()
    return (r["f"] or 0) / r["t"] if r["t"] else None


def measured_recall(nodes: DataFrame, lists: DataFrame, verified: DataFrame) -> float | None:
    """``audit_recall`` with a sample that grows while it holds no true link."""
    sample = AUDIT_VECTORS
    while (recall := audit_recall(nodes, lists, verified, sample)) is None and sample < AUDIT_LARGEST:
        sample = min(sample * 8, AUDIT_LARGEST)
    return recall


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``vectors`` has ``vec_id, embedding, label``.  Vectors of one label and length whose cosine,
    in double precision, is at least 0.98 are linked.  ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest vec_id that links reach, ``kept`` tells
    whether that is the vector's own.  Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing.  Rows without an id
    link too, but never name a component unless alone (null).  Rows that repeat a vector are
    linked copies; other columns are ignored; an empty table gives no rows.

    Copies of a vector are one node of the graph.  After NN-descent an audit compares a sample
    with all rows; below AUDIT_RECALL another round with new hyperplanes is added.  Where even
    the largest sample has no true link, links are too rare to measure: the starting graph is
    then drawn twice at least.  If MAX_ROUNDS don't reach the aim, that is an error.
    """
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    fit = finite_vectors("vec") & F.col("label").isNotNull()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    # Scaled first, so that squares neither vanish nor overflow.
    largest = F.array_max(F.transform("vec", F.abs))
    rows = given.where(fit).select(
        "vec_id", F.concat_ws("/", F.col("label").cast("string"), F.size("vec")).alias("grp"),
        F.transform("vec", lambda v: v / largest).alias("vec"),
    ).withColumn("key", row_key(F.col("grp"), F.col("vec")))
    nodes = cut_lineage(
        rows.groupBy("key")
        .agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .select(
            F.monotonically_increasing_id().alias("id"), "key", "grp", "copies", "first_id",
            F.transform("vec", lambda v: v / norm).alias("x"),
        ),
        "vectors",
    )
    lists = None
    for round_ in range(MAX_ROUNDS):
        lists = neighbour_graph(nodes, round_, lists)
        verified = _verified(lists, nodes)
        recall = measured_recall(nodes, lists, verified)
        if recall is None and round_ + 1 >= LEAST_ROUNDS_UNMEASURED or recall is not None and recall >= AUDIT_RECALL:
            break
    else:
        raise RuntimeError(f"audit: {recall:.4f} of the true links found after {MAX_ROUNDS} rounds, {AUDIT_RECALL} wanted")
    found = components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")))
    degrees = verified.groupBy("id").agg(F.sum("links").alias("links"))
    grouped = (
        nodes.select("id", "key", "copies", "first_id")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .join(degrees, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    heads = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    answer = grouped.join(heads, "component").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = rows.select("vec_id", "key").join(answer, "key").select("vec_id", "n_links", "component_id")
    lone = given.where(~F.coalesce(fit, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
