"""Near-dedup of embeddings with one navigable small-world graph per shard.

Equal vectors of a label are one class first. A label's classes are dealt to shards of about SHARD
by hash and each shard gets a graph; every shard is queried by its own classes and by those of each
shard before it of that label. Beams widen until audits pass: a graph's beam is as wide as finds nearly
all links of some of its vectors and of made ones near the threshold, each with a link at least, on
average over these queries; a pair of shards may widen it further for its own queries. A beam as wide
as the shard holds all of it. Queries whose whole beam links have more links than it holds: those that
share what they found walk the graph on together, to neighbours that link with any of them. Cosines of
what is found are verified in double precision. A task returns counts of links and a spanning forest
of them, never pairs; components of the forests are those of the links.

Defined results: vectors that are null, zero or empty, or hold null or non-finite components, rows
with null label or id have n_links 0 and are their own components; vectors of different lengths
never link; repeated rows are vectors each and link with each other, and rows of one id link by each
of their vectors; an empty table gives no rows. Other columns pass through, but for those named
n_links, component_id and kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .components import connected_components
from .hnsw import Graph

COSINE, SHARD = 0.93, 8192
#: First beam; queries of an audit, of a graph and of a pair, and the mean share of their links it must find.
EF, AUDIT, PAIR_AUDIT, RECALL = 64, 256, 64, 0.99
#: Rows of a block of products.
ROWS = 256


class Links:
    """Counts of links, and a forest of them, between classes a (all of one shard) and b."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.count = np.zeros(n, np.int64)

    def root(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(self.root(np.append(others, i)))
        self.parent[roots] = roots[0]
        self.parent[i] = roots[0]
        self.parent[others] = roots[0]


def _products(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(q), ROWS):
        yield at, q[at : at + ROWS] @ x.T


def _beams(graph: Graph, q: np.ndarray, x: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (rows of q, rows of x) that beams find, and which beams are full of them."""
    if ef >= len(x):  # beams hold the whole shard
        some = [np.nonzero(p >= least) for _, p in _products(q, x)]
        r = np.concatenate([r + i * ROWS for i, (r, _) in enumerate(some)]) if some else np.zeros(0, int)
        return r, np.concatenate([c for _, c in some]) if some else r, np.zeros(len(q), bool)
    ids, _ = graph.search(q, ef)
    r, c = np.nonzero(ids >= 0)
    p = ids[r, c].astype(np.int64)
    cos = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + 65536]], x[p[i : i + 65536]]) for i in range(0, max(1, len(r)), 65536)])
    ok = cos >= least
    return r[ok], p[ok], np.bincount(r[ok], minlength=len(q)) >= ef


def _crowds(graph: Graph, q: np.ndarray, x: np.ndarray, least: float, r: np.ndarray, p: np.ndarray, full: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Full queries that share what their beams found, and all that a walk from there finds to link with any of them."""
    on = full[r]
    of = Links(len(q) + len(x))
    order = np.argsort(r[on], kind="stable")
    rows, cols = r[on][order], p[on][order]
    names, first = np.unique(rows, return_index=True)
    for i, others in zip(names.tolist(), np.split(cols, first[1:])):
        of.join(i, len(q) + others)
    root = of.root(np.arange(len(q) + len(x)))
    for k in np.unique(root[names]):
        own = names[root[names] == k]
        seen = np.zeros(len(x), bool)
        front = np.unique(cols[root[rows] == k])
        seen[front] = True
        there = [front]
        while len(front):
            near = np.unique(graph.layers[0][front])
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            links = np.zeros(len(near), bool)
            for _, product in _products(x[near], q[own]):
                links[_ : _ + len(product)] = (product >= least).any(1)
            front = near[links]
            there.append(front)
        yield own, np.concatenate(there)


def _missed(graph: Graph, q: np.ndarray, x: np.ndarray, least: float, ef: int) -> float:
    """The mean share of their links that queries with links do not find."""
    hit = np.zeros((len(q), len(x)), bool)
    r, p, full = _beams(graph, q, x, least, ef)
    hit[r, p] = True
    for own, there in _crowds(graph, q, x, least, r, p, full) if full.any() else ():
        hit[np.ix_(own, there)] = True
    truth = q @ x.T >= least
    links = truth.sum(1)
    some = links > 0
    return float((1 - (hit & truth).sum(1)[some] / links[some]).mean()) if some.any() else 0.0


def audited(graph: Graph, x: np.ndarray, least: float) -> int:
    """The beam with which a graph's own vectors, and made ones at the threshold, find their links."""
    draw = np.random.Generator(np.random.PCG64(5))
    some = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), AUDIT)).astype(int))]
    away = draw.normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300)
    cos = least + (1 - least) * draw.random((len(some), 1)) / 4
    made = cos * some + np.sqrt(1 - cos * cos) * away
    ef = EF
    while ef < len(x) and max(_missed(graph, some, x, least, ef), _missed(graph, made, x, least, ef)) > 1 - RECALL:
        ef *= 2
    return ef


def link(a: dict, b: dict, least: float, same: bool) -> pd.DataFrame:
    """Rows u, v, n: links of class u to n vectors (v null), or an edge of the forest."""
    q, x, graph, ef = a["x"], b["x"], b["graph"], b["ef"]
    n, base = len(q), 0 if same else len(q)
    out = Links(n if same else n + len(x))
    ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
    if not same:
        some = np.unique(np.linspace(0, n - 1, min(n, PAIR_AUDIT)).astype(int))
        while ef < len(x) and _missed(graph, q[some], x, least, ef) > 1 - RECALL:
            ef *= 2
    r, p, full = _beams(graph, q, x, least, ef)
    for own, there in _crowds(graph, q, x, least, r, p, full) if full.any() else ():
        if same:  # and those whose own beams found one of these
            mine = np.zeros(n, bool)
            mine[own] = True
            there = np.union1d(there, r[mine[p]])
        for at, product in _products(q[own], x[there]):
            rows, hit = own[at : at + ROWS], product >= least
            if same:
                hit &= rows[:, None] != there[None, :]
            out.count[rows] += hit @ b["size"][there]
            rest = there[~full[there]] if same else there  # full ones of this shard count for themselves
            out.count[base + rest] += a["size"][rows] @ (hit[:, ~full[there]] if same else hit)
            for k, i in enumerate(rows.tolist()):
                if hit[k].any():
                    out.join(i, base + there[hit[k]])
    alone = ~full[r] & (~full[p] & (r != p) if same else True)
    r, p = r[alone], p[alone]
    if same:
        pair = np.unique(np.minimum(r, p) * n + np.maximum(r, p))
        r, p = pair // n, pair % n
    np.add.at(out.count, r, b["size"][p])
    np.add.at(out.count, base + p, a["size"][r])
    order = np.argsort(r, kind="stable")
    names, first = np.unique(r[order], return_index=True)
    for i, others in zip(names.tolist(), np.split(p[order], first[1:])):
        out.join(i, base + others)
    root = out.root(np.arange(len(ids)))
    counted, hung = np.flatnonzero(out.count), np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({
        "u": np.concatenate([ids[counted], ids[hung]]),
        "v": pd.array([None] * len(counted) + ids[root[hung]].tolist(), "Int64"),
        "n": np.concatenate([out.count[counted], np.zeros(len(hung), np.int64)]),
    })


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square is too large or small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _build(least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        v = np.stack([np.asarray(v, np.float64) for v in frame["v"]])
        with np.errstate(over="ignore"):
            narrow = v.astype(np.float32)
        x = _unit(v)
        graph = Graph(x)
        shard = {"ids": frame["rep"].to_numpy(np.int64), "size": frame["size"].to_numpy(np.int64), "v": narrow if (narrow == v).all() else v, "graph": graph, "ef": audited(graph, x, least)}
        graph.x = None  # from v again
        return pd.DataFrame({"kind": frame["kind"].iloc[:1], "shard": frame["shard"].iloc[:1], "shards": frame["shards"].iloc[:1], "data": [pickle.dumps(shard, 5)]})

    return run


def _loaded(data: bytes) -> dict:
    shard = pickle.loads(data)
    shard["x"] = _unit(shard.pop("v"))
    shard["graph"].x = np.ascontiguousarray(shard["x"], np.float32)
    return shard


def near_dedup(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, vec: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """vectors with n_links, component_id and kept."""
    vectors = vectors.drop("n_links", "component_id", "kept")
    v = F.col(vec).cast("array<double>")
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # the class of a vector: its label and itself, null for one that takes no part
    of = F.when(ok, F.struct(F.col(label).alias("label"), v.alias("v")))
    part = vectors.withColumn("__own", of)
    classes = cut(part.select(F.col(key).cast("long").alias("id"), F.col("__own").alias("of")).where("of is not null").groupBy("of").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).withColumn("rep", F.monotonically_increasing_id()))
    kinds = classes.select("rep", "size", F.struct("of.label", F.size("of.v").alias("dim")).alias("kind"), F.col("of.v").alias("v"))
    shards = cut(kinds.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards")))
    dealt = kinds.join(shards, "kind").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kind = dict(kinds.dtypes)["kind"]
    build = _build(cosine)
    built = cut(dealt.groupBy("kind", "shard").applyInPandas(lambda f: build(f.assign(kind=[tuple(k.values()) if isinstance(k, dict) else tuple(k) for k in f["kind"]])), f"kind {kind}, shard int, shards int, data binary"))
    pairs = shards.agg(F.sum(F.col("shards").cast("long") * (F.col("shards") + 1) / 2)).first()[0] or 0
    spark = vectors.sparkSession
    parts = max(1, min(int(pairs), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    left = built.select("kind", F.col("shard").alias("i"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("j"), F.col("data").alias("a")).repartition(parts, "kind", "i", "j")
    right = built.select("kind", F.explode(F.sequence(F.lit(0), "shard")).alias("i"), F.col("shard").alias("j"), F.col("data").alias("b")).repartition(parts, "kind", "i", "j")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                a = _loaded(row.a)
                yield link(a, a if row.i == row.j else _loaded(row.b), cosine, row.i == row.j)

    found = cut(left.join(right.hint("shuffle_merge"), ["kind", "i", "j"]).select("i", "j", "a", "b").mapInPandas(meet, "u long, v long, n long"))
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    # classes of one id are one component too
    several = part.where("__own is not null").groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.xxhash64("__own")).alias("x"), F.max(F.xxhash64("__own")).alias("y")).where("x <> y").select("id")
    rows = part.where("__own is not null").select(F.col(key).cast("long").alias("id"), F.col("__own").alias("of")).join(several, "id", "left_semi")
    rows = cut(rows.join(classes.select("of", "rep"), "of").select("id", "rep"))
    shared = rows.join(rows.groupBy("id").agg(F.min("rep").alias("v")), "id").select(F.col("rep").alias("u"), "v")
    comps = connected_components(found.where("v is not null").select("u", "v").union(shared))
    ends = classes.join(counts, classes["rep"] == counts["u"], "left").join(comps, classes["rep"] == comps["node"], "left")
    ends = cut(ends.select(F.col("of").alias("__of"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "least", F.coalesce("component", "rep").alias("comp")))
    low = ends.groupBy("comp").agg(F.min("least").alias("__c"))
    drop(classes, shards, built, found, rows, comps)
    ends = ends.join(low, "comp").select("__of", "n_links", "__c")
    names = [F.col(f"`{c}`") for c in vectors.columns]
    own = F.col(key).cast("long")
    linked = part.where("__own is not null").join(ends, F.col("__own") == F.col("__of"))
    linked = linked.select(*names, F.col("n_links").cast("long"), F.col("__c").alias("component_id"), (own == F.col("__c")).alias("kept"))
    # what takes no part meets nothing
    rest = part.where("__own is null").select(*names, F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(rest)
