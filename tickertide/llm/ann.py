"""Approximate nearest neighbours: learned partitions of a neighbour graph, routed by a classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickertide.llm.common import finite_vectors, matrix, row_key, whole_units
from tickertide.session import cut_lineage

TOP = 20
# The partition and the classifier are learned on at most so many vectors; all are indexed.
SAMPLE = 4096
GRAPH_DEGREE = 10
# The number of probed partitions is the smallest that finds this share of the true
# neighbours of AUDIT_QUERIES vectors, which are compared with all.
AUDIT_QUERIES, AUDIT_RECALL = 200, 0.94
# Vectors and queries compared in one piece.
CHUNK, QUERY_BLOCK = 4096, 2048


def partition_count(n: int) -> int:
    return int(min(256, max(32, n // 3000)))


@dataclass
class Router:
    """Two-layer classifier: vector -> log probabilities of the partitions."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row the rows of largest inner product, itself excluded."""
    out = np.empty((len(x), min(degree, max(len(x) - 1, 0))), dtype=np.int64)
    if out.shape[1]:
        for lo in range(0, len(x), 1024):
            s = x[lo : lo + 1024] @ x.T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            out[lo : lo + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 12) -> np.ndarray:
    """Parts of at most ``slack`` times the mean size that cut few edges of the graph.

    Starts from nearest centres under the size limit; then each vertex moves to the part that
    holds most of its neighbours (both directions), if that part has room.
    """
    n = len(x)
    rng = np.random.default_rng(5)
    limit = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, min(parts, n), replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(5):
        s = x @ centres.T
        size = np.zeros(parts, dtype=np.int64)
        for v in np.argsort(-s.max(axis=1), kind="stable"):
            for p in np.argsort(-s[v], kind="stable"):
                if size[p] < limit:
                    part[v] = p
                    size[p] += 1
                    break
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[p % n] for p in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    both: list[list[int]] = [[] for _ in range(n)]
    for v, row in enumerate(graph.tolist()):
        both[v] += row
        for u in row:
            both[u].append(v)
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(n).tolist():
            votes = np.bincount(part[both[v]], minlength=parts) if both[v] else size * 0
            votes_here = votes[part[v]]
            votes = np.where(size < limit, votes, -1)
            best = int(votes.argmax())
            if votes[best] > votes_here:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 96, epochs: int = 40) -> Router:
    """Learns to predict the parts of a vector and its neighbours (soft labels)."""
    n, d = x.shape
    want = np.eye(parts)[part]
    if graph.shape[1]:
        want = 0.5 * want + 0.5 * np.eye(parts)[part[graph]].mean(axis=1)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    rng = np.random.default_rng(11)
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.05, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            rows = order[lo : lo + 256]
            a = x[rows] / scale
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - want[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            grads = [a.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ g + 1e-4 * w[2], g.sum(axis=0)]
            t += 1
            rate = 0.005 * (1 - epoch / epochs)
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
    return Router(scale, *w)


def best_of(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row the ``top`` largest inner products: (query, places, scores).

    The matrix product only selects; scores are then summed again row by row in one fixed
    order, so equal vectors have equal scores and ties go to the smaller id.
    """
    s = q @ x.T
    s[q_id[:, None] == x_id[None, :]] = -np.inf
    margin = 1e-9 * (np.abs(q).max() * np.abs(x).max() * x.shape[1] + 1e-300)
    for k in range(len(q)):
        row = s[k]
        least = np.partition(row, len(row) - top)[len(row) - top] if len(row) > top else -np.inf
        places = np.flatnonzero((row >= least - margin) & (row > -np.inf))
        exact = (q[k] * x[places]).sum(axis=1)
        order = np.lexsort((x_id[places], -exact))[:top]
        yield k, places[order], exact[order]


FOUND = "query_id long, query_key string, vec_id long, score double"
_FOUND_TYPES = pa.schema(
    [("query_id", pa.int64()), ("query_key", pa.string()), ("vec_id", pa.int64()), ("score", pa.float64())]
)


def _search(top: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_units(batches, "unit"):
            codes = np.array(t["unit"].combine_chunks().dictionary_encode().indices)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            side = np.array(t["side"].combine_chunks())
            ids, vectors = np.array(t["vec_id"].combine_chunks()), matrix(t["vec"])
            keys = t["key"].to_pylist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                cut = lo + int((side[lo:hi] == 0).sum())
                if lo == cut or cut == hi:
                    continue
                out: list[list] = [[], [], [], []]
                for k, places, scores in best_of(vectors[lo:cut], ids[lo:cut], vectors[cut:hi], ids[cut:hi], top):
                    out[0] += [ids[lo + k]] * len(places)
                    out[1] += [keys[lo + k]] * len(places)
                    out[2] += ids[cut + places].tolist()
                    out[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(out, _FOUND_TYPES, strict=True)], schema=_FOUND_TYPES
                )

    return run


def _audit(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, router: Router, top: int) -> np.ndarray:
    """Place of each true neighbour's partition in its query's order of partitions."""
    order = np.argsort(-router.logits(queries), axis=1, kind="stable")
    place = np.argsort(order, axis=1)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, x_id = matrix(b.column(1)), np.array(b.column(0))
            part = router.logits(x).argmax(axis=1)
            out: list[list] = [[], [], [], []]
            for k, places, scores in best_of(queries, ids, x, x_id, top):
                out[0] += [k] * len(places)
                out[1] += x_id[places].tolist()
                out[2] += scores.tolist()
                out[3] += place[k, part[places]].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())],
                names=["q", "vec_id", "score", "place"],
            )

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = rows.select("vec_id", "vec").mapInArrow(exact, "q long, vec_id long, score double, place long")
    kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return np.array(kept.select("place").toArrow()["place"])  # AUDIT_QUERIES x top numbers


def nearest(vectors: DataFrame, asked: Column | None = None, top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of largest inner product found.

    ``vectors`` has ``vec_id, embedding``; ``asked`` picks the queries (default: ids divisible
    by 20).  Candidates are all rows of another id; ties go to the smaller id.  Vectors that are
    null, empty, zero or hold null or non-finite components, those of another length than the
    commonest, and rows without an id take no part.  Rows that repeat an id and vector count
    once; an id with several vectors asks with each.  Other columns are ignored; an empty table
    gives no rows.

    Every vector is put into the partition that the classifier holds likeliest.  A query visits
    its likeliest partitions, as many as an audit against all rows calls for, and further ones
    until they hold ``top`` rows of another id (or all rows are visited), and reranks all that
    they hold.  Partitions and the queries that visit them are compared in pieces of bounded
    size, so copies of one vector, however many, are spread over tasks; a partition's rows are
    copied once for each block of its own visitors.
    """
    spark = vectors.sparkSession
    asked = (F.col("vec_id") % 20 == 0) if asked is None else asked
    given = vectors.where(finite_vectors("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    lengths = given.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cut_lineage(
        given.where(F.size("vec") == lengths["d"])
        .withColumn("key", row_key(F.col("vec")))
        .dropDuplicates(["vec_id", "key"]),
        "vectors",
    )
    n = rows.count()
    parts = partition_count(n)
    shuffled = rows.orderBy(F.xxhash64("key", F.lit(1)), "vec_id").limit(SAMPLE + AUDIT_QUERIES).toArrow()
    x, ids = matrix(shuffled["vec"]), np.array(shuffled["vec_id"])
    asking = x[:AUDIT_QUERIES], ids[:AUDIT_QUERIES]
    learn = x[AUDIT_QUERIES:] if len(x) > 2 * AUDIT_QUERIES else x
    parts = min(parts, len(learn))
    # Inner products rank alike after a coordinate that makes all norms equal.
    norms = (learn * learn).sum(axis=1)
    level = np.column_stack([learn, np.sqrt(np.maximum(norms.max() - norms, 0))])
    graph = neighbour_graph(level, GRAPH_DEGREE)
    part = balanced_partition(level, graph, parts)
    router = fit_router(learn, graph, part, parts)
    places = _audit(rows, *asking, router, top)
    probes = parts
    if len(places):
        share = np.cumsum(np.bincount(places, minlength=parts)) / len(places)
        probes = int(np.searchsorted(share, AUDIT_RECALL) + 1)
    probes = min(probes, parts)

    def home(v: pa.Array) -> pa.Array:
        return pa.array(router.logits(matrix(v)).argmax(axis=1).astype(np.int32) if len(v) else [], pa.int32())

    indexed = cut_lineage(rows.withColumn("part", F.arrow_udf(home, "int")("vec")), "indexed")
    # At most 256 numbers.
    sizes = np.zeros(parts, dtype=np.int64)
    for r in indexed.groupBy("part").count().collect():
        sizes[r["part"]] = r["count"]

    def route(v: pa.Array, own: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        order = np.argsort(-router.logits(matrix(v)), axis=1, kind="stable")
        # Rows of the query's own id are no candidates.
        short = np.cumsum(sizes[order], axis=1) < top + np.array(own)[:, None]
        visits = np.minimum(np.maximum(short.sum(axis=1) + 1, probes), parts)
        return pa.array([o[:k].astype(np.int32).tolist() for o, k in zip(order, visits, strict=True)], pa.list_(pa.int32()))

    asking_rows = rows.where(asked)
    own = asking_rows.groupBy("vec_id").agg(F.count("*").alias("own"))
    routed = cut_lineage(
        asking_rows.join(own, "vec_id").select(
            "vec_id", "key", "vec", F.arrow_udf(route, "array<int>")("vec", "own").alias("parts")
        ),
        "routed",
    )
    # At most 256 rows: chunks of a partition's rows, blocks of its visitors.
    visitors = routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect()
    plan = spark.createDataFrame(
        [(r["part"], -(-int(sizes[r["part"]]) // CHUNK), -(-r["count"] // QUERY_BLOCK)) for r in visitors if sizes[r["part"]]],
        "part int, chunks int, blocks int",
    )
    left = (
        routed.withColumn("part", F.explode("parts"))
        .join(F.broadcast(plan), "part")
        .select(
            "vec_id", "key", "vec", "part",
            F.pmod(F.xxhash64("vec_id", "key"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"),
        )
    )
    right = (
        indexed.join(F.broadcast(plan), "part")
        .select(
            "vec_id", "key", "vec", "part",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("vec_id", "key"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"),
        )
    )
    met = (
        left.unionByName(right)
        .withColumn("unit", F.concat_ws(":", "part", "chunk", "block"))
        .select("unit", "side", "vec_id", "key", "vec")
        .repartition("unit")
        .sortWithinPartitions("unit", "side", "vec_id")
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        met.mapInArrow(_search(top), FOUND)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
