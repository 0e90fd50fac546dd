"""Links of vectors against brute force: recall over several shards, crowds, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hnsw, vector_dedup


def made(n, dims=24, seed=2):
    """Random vectors, many small groups and one crowd of like ones."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    for i in range(0, n // 2, 4):
        x[i + 1 : i + 3] = x[i] + draw.normal(size=(2, dims)) * 0.2
    x[-n // 6 :] = draw.normal(size=dims) + draw.normal(size=(n // 6, dims)) * 0.15
    return x


def plain(rows, least=0.93):
    good = [(k, i, np.array(v, float), y) for k, (i, v, y) in enumerate(rows) if i is not None and v and y is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    count, up = [0] * len(rows), {i: i for i, _, _ in rows if i is not None}

    def top(i):
        return i if up[i] == i else top(up[i])

    for y in {g[3] for g in good}:
        for dim in {len(g[2]) for g in good if g[3] == y}:
            some = [g for g in good if g[3] == y and len(g[2]) == dim]
            m = np.stack([g[2] for g in some])
            m = m / np.abs(m).max(1, keepdims=True)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            hit = m @ m.T >= least
            np.fill_diagonal(hit, False)
            for a in range(len(some)):
                count[some[a][0]] = int(hit[a].sum())
                for b in np.flatnonzero(hit[a]):
                    p, q = sorted((top(some[a][1]), top(some[b][1])))
                    up[q] = p
    return [(i, count[k], None if i is None else top(i), True if i is None else top(i) == i) for k, (i, _, _) in enumerate(rows)]


def test_recall_over_shards(spark):
    x = made(1800)
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {r[0]: r[1:] for r in plain(rows)}
    for shard in (8192, 300):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_dedup(df, shard=shard).collect()}
        some = [i for i in want if want[i][0]]
        assert all(got[i][0] <= want[i][0] for i in want), "none below the threshold"
        assert np.mean([got[i][0] / want[i][0] for i in some]) >= 0.99, shard
        assert np.mean([got[i] == want[i] for i in want]) >= 0.98, shard


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (5, v, 1), (6, v, 1), (7, [2.0, 4.0, 6.0], 1), (7, [0.0, 0.0, 1.0], 1), (8, v, 2), (9, v, None), (None, v, 1), (10, None, 1), (11, [], 1), (12, [0.0, 0.0], 1), (13, [1.0, None], 1), (14, [float("inf")], 1), (15, [1e-200, 2e-200, 3e-200], 1), (16, [1.0, 2.0], 1), (17, [0.0, 0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"n_links": F.lit("clash"), "id": F.lit(1), "u": F.lit(2), "shard": F.lit(3), "of": F.lit(4)})
    out = vector_dedup.near_dedup(df)
    assert out.columns == ["vec_id", "embedding", "label", "id", "u", "shard", "of", "n_links", "component_id", "kept"]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    assert vector_dedup.near_dedup(df.limit(0)).collect() == []


def test_every_node_is_found():
    x = made(3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = hnsw.Graph(x).search(x, 32)
    sims = x @ x.T
    same = [(sims[i, ids[i][ids[i] >= 0]] > 0.999999).any() for i in range(0, 3000, 7)]
    assert np.mean(same) > 0.995
