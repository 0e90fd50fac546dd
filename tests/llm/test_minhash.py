"""Shingle sets and links against plain ones, over blocks and long words."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import components, minhash


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    return out


def test_long_words(monkeypatch):
    draw = random.Random(1)
    texts = ["".join(draw.choice("abC \n") if draw.random() < 0.3 else draw.choice("xyz") for _ in range(n)) for n in (0, 1, 50, 3000, 9000)] + ["x" * 5000, " " * 5000, "y" * 1024 + " " + "z" * 2048, None]
    for k in (2, 5):
        want = [set(x.tolist()) for x in minhash.shingle_sets(texts, k)]
        assert [len(x) for x in want] == [len(x) for x in plain_sets(texts, k)]
        with monkeypatch.context() as m:
            m.setattr(minhash, "GROUP", 512)  # words go on over many pieces
            assert [set(x.tolist()) for x in minhash.shingle_sets(texts, k)] == want
    began = time.time()
    assert [len(x) for x in minhash.shingle_sets(["x" * 16_000_000], 5)] == [1]
    assert time.time() - began < 10 and len(minhash._TABLES["p"]) < 4 * minhash.GROUP


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Chains of near copies that share a bucket meet over several blocks; names that clash."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    draw = random.Random(6)
    texts = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        for _ in range(40):
            words = list(words)
            words[draw.randrange(60)] = f"v{draw.randrange(10**6)}"
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[3]), (1001, None), (None, texts[5]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("clash"), "d": F.lit(1), "rep": F.lit(2), "n": F.lit(3), "component_id": F.lit(4), "key": F.lit(5)})
    sets = plain_sets([t for _, t in rows], 2)
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            x, y = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    out = minhash.near_dedup(df, words=2)
    assert out.columns == ["doc_id", "text", "d", "rep", "n", "key", "n_shingles", "component_id", "kept"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (top(r.doc_id), top(r.doc_id) == r.doc_id))


def test_minima_are_of_whole_sets():
    sets = list(minhash.shingle_sets(["a b c d e f g", "b c d e f g h " * 3], 2))
    assert (minhash.minima(sets, 8)[0] == minhash.minima(sets[:1], 8)[0]).all() and np.unique(sets[1]).size == sets[1].size


def test_components_of_many_tasks(spark, monkeypatch):
    """Edges that tasks join a few at a time, a hub among them, and what is there already as stars."""
    monkeypatch.setattr(components, "JOINED", 7)
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i + 1, i) for i in range(1000, 1060)] + [(2000, i) for i in range(1900, 2100, 2)]
    draw.shuffle(edges)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    met = {x for e in edges for x in e if e[0] != e[1]}
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(9)).collect()
    assert sorted(got) == sorted((x, top(x)) for x in met)
    u, v = (np.array(c, np.int64) for c in zip(*edges))
    hung = dict(zip(*map(np.ndarray.tolist, components._stars(u, v))))
    assert hung == {x: top(x) for x in met if top(x) != x}


def test_few_tables_are_written(spark, monkeypatch):
    """Each table costs a task for every shuffle partition: what is joined already is not joined again."""
    written = []
    for module in (components, minhash):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: written.append(df.columns) or cut(df))
    pairs = [(2 * i + 1, 2 * i) for i in range(50)] + [(i + 1, i) for i in range(200, 300)]
    got = dict(components.connected_components(spark.createDataFrame(pairs, "u long, v long").coalesce(1)).collect())
    assert got == {i: i - i % 2 for i in range(100)} | {i: 200 for i in range(200, 301)}
    assert len(written) == 2
    written.clear()
    texts = [f"{' '.join(f'g{i // 4}w{j}' for j in range(40))} {'x y z'[: 1 + i % 4]}" for i in range(40)]
    got = minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 4 for i in range(40)}
    assert len(written) <= 24
