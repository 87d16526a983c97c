"""Nearest vectors over few rows, and the audit of the near-duplicate graph where links are rare."""

import numpy as np
import pytest

from tickertide.llm import ann, near_vectors

ROWS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("n", [1, 2, 15, 18, 20, 21, 30])
def test_few_vectors_are_complete(spark, n):
    rng = np.random.default_rng(n)
    x = {20 * k if k % 3 == 0 else 1000 + 20 * k + 1: rng.normal(size=8) for k in range(n)}
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], ROWS)).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in x:
        if q % 20 == 0:
            # 20 rows each, or all there are; of few rows all are compared.
            assert len(found.pop(q, [])) == min(20, n - 1)
    assert not found


def test_an_id_with_many_vectors_still_finds_others(spark):
    rng = np.random.default_rng(4)
    rows = [(0, v.tolist()) for v in rng.normal(size=(400, 8))] + [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(25, 8)), 1)]
    got = ann.nearest(spark.createDataFrame(rows, ROWS)).where("query_id = 0").collect()
    assert len(got) == 400 * 20 and all(r.vec_id != 0 for r in got)


def _rare_links(spark, n=6000, pairs=3):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 16))
    for k in range(pairs):
        x[n - 1 - k] = x[k] + rng.normal(size=16) * 0.01
    return spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], ROWS + ", label int"), pairs, n


def test_rare_links_are_found(spark):
    df, pairs, n = _rare_links(spark)
    got = [r for r in near_vectors.near_vectors(df).collect() if r.n_links]
    want = {k: k for k in range(pairs)} | {n - 1 - k: k for k in range(pairs)}
    assert {r.vec_id: r.component_id for r in got} == want


def test_audit_sees_removed_links(spark):
    df, _, _ = _rare_links(spark)
    nodes = df.selectExpr(
        "vec_id AS id", "'1/16' AS grp", "1L AS copies",
        "transform(embedding, v -> v / sqrt(aggregate(embedding, 0D, (a, w) -> a + w * w))) AS x",
    )
    lists = near_vectors.neighbour_graph(nodes, 0)
    verified = near_vectors._verified(lists, nodes)
    assert near_vectors.audit_recall(nodes, lists, verified) == 1.0
    assert near_vectors.audit_recall(nodes, lists, verified.limit(0)) == 0.0
    # Without candidates a small sample of all vectors holds no link: nothing is measured.
    assert near_vectors.audit_recall(nodes, lists.limit(0), verified, 10) is None
