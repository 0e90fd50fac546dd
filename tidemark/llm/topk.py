"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length and cut into buckets of vectors of like length. For a query
with a running k-th best score, a bucket asks for a cosine of at least score / (query's length *
bucket's greatest length). Over 1, the bucket is skipped. High thresholds are met by coordinate
pruning: the interval that the query's largest coordinates leave for a unit vector's, found in
sorted lists. Low ones are met by length pruning: the prefix of vectors that are long enough.
Products of what is left are verified in exact integers.

A first round over a fixed number of the longest vectors, which is broadcast, gives each query a
score to start from. Queries and buckets then meet block by block, each pair of blocks in one task.

Components are floor(256 * x). Defined results: vectors that are null, or hold null or non-finite
components, and rows with null id take no part; shorter vectors count as padded with zeros; every row
is a candidate, also those that repeat an id or a whole row, and only a query's own row is none of its
candidates; fewer than k candidates give fewer rows; equal scores go to the smaller id; an empty table
gives no rows. Components of 2 ** 62 or more, and products that are looked at and do not fit a long,
are errors. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

K, SCALE = 5, 256
#: Vectors of a bucket, of a block, and of the first round; queries of a block.
BUCKET, BLOCK, FIRST, QUERIES = 1024, 16384, 2048, 2048
#: From this local cosine threshold, coordinates prune; so many of a query's coordinates do.
COORDINATE_FROM, FOCUS = 0.75, 2
BLOBS = "part long, n int, dim int, wide int, rows binary, ids binary, data binary"
LARGEST, LEAST = 2.0**62, np.iinfo(np.int64).min


def quantized(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", asked: Column | None = None) -> DataFrame:
    """row (a number of its own), id, q (array of long), norm and asked of the rows that take part."""
    v = F.col(vec).cast("array<double>")
    ok = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.raise_error(F.lit("a component is 2 ** 62 or more")).cast("long")
    q = F.transform(v, lambda x: F.when(F.abs(x * SCALE) < LARGEST, F.floor(x * SCALE).cast("long")).otherwise(too_large))
    rows = vectors.where(ok).select(F.col(key).cast("long").alias("id"), q.alias("q"), F.coalesce(asked if asked is not None else F.lit(False), F.lit(False)).alias("asked"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id())


def _dense(lists: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _blob(part: int, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> dict:
    wide = 8 if len(m) and m.size and int(np.abs(m).max()) >= 2**31 else 4
    return {"part": part, "n": len(ids), "dim": m.shape[1], "wide": wide, "rows": rows.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "data": m.astype(f"<i{wide}").tobytes(), "longest": float(np.sqrt((m.astype(float) ** 2).sum(1)).max()) * (1 + 1e-9)}


def _matrix(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(row["data"], f"<i{row['wide']}").reshape(row["n"], row["dim"]).astype(np.int64)
    return np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["ids"], "<i8"), data


def _blocks(size: int):
    """Rows of a partition as blobs of so many vectors, numbered by their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        ids: list[int] = []
        lists: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            kinds = [(c, pa.int32()) for c in ("n", "dim", "wide")] + [(c, pa.binary()) for c in ("rows", "ids", "data")]
            return pa.RecordBatch.from_pylist([_blob(rows[0], np.array(rows), np.array(ids), _dense(lists, max(map(len, lists))))], pa.schema([("part", pa.int64()), *kinds, ("longest", pa.float64())]))

        for b in batches:
            q = b.column("q")
            offsets, values = q.offsets.to_numpy(), q.values.to_numpy()
            for i, (row, key) in enumerate(zip(b.column("row").to_pylist(), b.column("id").to_pylist())):
                rows.append(row)
                ids.append(key)
                lists.append(values[offsets[i] : offsets[i + 1]])
                if len(ids) == size:
                    yield emit()
                    rows, ids, lists = [], [], []
        if ids:
            yield emit()

    return run


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, b))


class Top:
    """The k best so far of each query of a block. own: the queries' own rows."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, start: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.score = np.full((len(queries), k), LEAST, np.int64)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.there = np.zeros((len(queries), k), bool)
        self.start = start

    def least(self) -> np.ndarray:
        return np.maximum(self.start, self.score[:, -1])

    def add(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows, ids: of the candidates, the same for all queries at; scores: queries x candidates."""
        good = rows[None, :] != self.own[at, None]
        scores = np.where(good, scores, LEAST)
        if scores.shape[1] > 4 * self.k:  # ties at the k-th best stay
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            good &= scores >= np.maximum(kth, self.least()[at])[:, None]
        for r, query in enumerate(at):
            some = np.flatnonzero(good[r])
            if len(some):
                self._merge(query, ids[some], scores[r, some])

    def _merge(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        s, i, t = np.r_[self.score[query], scores], np.r_[self.id[query], ids], np.r_[self.there[query], np.ones(len(ids), bool)]
        order = np.lexsort((i, ~s, ~t))[: self.k]  # ~s falls as s rises, without overflow
        self.score[query], self.id[query], self.there[query] = s[order], i[order], t[order]

    def table(self) -> pd.DataFrame:
        n = self.there.sum(1)
        return pd.DataFrame({"query_row": np.repeat(self.own, n), "query_id": np.repeat(self.queries, n), "vec_id": self.id[self.there], "score": self.score[self.there]})


def _product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles or longs where these hold them exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return q @ p.T
    out = q.astype(object) @ p.T.astype(object)
    if out.size and (out.max() > np.iinfo(np.int64).max or out.min() <= LEAST):
        raise OverflowError("a product does not fit a long")
    return out.astype(np.int64)


def search(top: Top, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
    """Adds a block's vectors to the best of the queries q."""
    q, p = _same_width(q, p)
    long_p, long_q = np.sqrt((p.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -long_p))
    rows, ids, p, long_p = rows[order], ids[order], p[order], long_p[order]
    unit_q = q / np.maximum(long_q, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :FOCUS]
    for at in range(0, len(ids), BUCKET):
        b_rows, b_ids, b, b_long = rows[at : at + BUCKET], ids[at : at + BUCKET], p[at : at + BUCKET], long_p[at : at + BUCKET]
        least = top.least().astype(float)
        # the cosine that this bucket needs, a hair less for rounding; below 0 all may do
        need = np.where(least > 0, least / np.maximum(long_q * b_long[0], 1e-300), -1.0) * (1 - 1e-9)
        live = need <= 1
        by_length = np.flatnonzero(live & (need < COORDINATE_FROM))
        if len(by_length):
            enough = np.where(least > 0, least / np.maximum(long_q, 1e-300), -1.0)[by_length] * (1 - 1e-9)
            prefix = int(np.searchsorted(-b_long, -enough.min(), side="right"))
            if prefix:
                top.add(by_length, b_rows[:prefix], b_ids[:prefix], _product(q[by_length], b[:prefix]))
        by_coordinate = np.flatnonzero(live & (need >= COORDINATE_FROM))
        if len(by_coordinate):
            unit = b / np.maximum(b_long, 1e-300)[:, None]
            lists = {}
            for r in by_coordinate:
                left = None
                for f in focus[r]:
                    if f not in lists:
                        by = np.argsort(unit[:, f], kind="stable")
                        lists[f] = by, unit[by, f]
                    by, values = lists[f]
                    x, t = unit_q[r, f], need[r]
                    spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                    span = by[np.searchsorted(values, x * t - spread if x > -t else -1.1) : np.searchsorted(values, x * t + spread if x < t else 1.1, side="right")]
                    left = span if left is None else np.intersect1d(left, span, assume_unique=True)
                if left is not None and len(left):
                    top.add(np.array([r]), b_rows[left], b_ids[left], _product(q[r : r + 1], b[left]))


def top_k(vectors: DataFrame, asked: Column, k: int = K, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the k best of the other rows for each row of vectors where asked."""
    spark = vectors.sparkSession
    base = cut(quantized(vectors, vec, key, asked))
    blocks = cut(base.repartitionByRange(F.desc("norm"), F.xxhash64("row")).sortWithinPartitions(F.desc("norm"), F.xxhash64("row")).select("row", "id", "q").mapInArrow(_blocks(BLOCK), BLOBS + ", longest double"))
    first = base.orderBy(F.desc("norm"), "row").limit(FIRST).select("row", "id", "q").toPandas()  # of a fixed size
    held = spark.sparkContext.broadcast((first["row"].to_numpy(np.int64), first["id"].to_numpy(np.int64), _dense(first["q"].tolist(), max(map(len, first["q"]), default=1))))
    queries = base.where("asked").select("row", "id", "q").mapInArrow(_blocks(QUERIES), BLOBS + ", longest double").drop("longest")

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, ids, p = held.value
        for frame in frames:
            starts, needs = [], []
            for _, row in frame.iterrows():
                own, names, q = _matrix(row)
                top = Top(names, own, np.full(len(own), LEAST, np.int64), k)
                if len(ids):
                    search(top, q, rows, ids, p)
                start = np.where(top.there[:, -1], top.score[:, -1], LEAST)
                starts.append(start.astype("<i8").tobytes())
                needs.append(float(np.where(start > 0, start / np.maximum(np.sqrt((q.astype(float) ** 2).sum(1)), 1e-300), 0).min()) * (1 - 1e-9))
            yield frame.assign(start=starts, need=needs)

    queries = cut(queries.mapInPandas(begin, BLOBS + ", start binary, need double"))
    # keys of blocks and what they need or have: one small row for each block
    q_keys = [(r["part"], r["need"]) for r in queries.select("part", "need").collect()]
    v_keys = [(r["part"], r["longest"]) for r in blocks.select("part", "longest").collect()]
    drop(base)
    if not q_keys or not v_keys:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # each block of queries meets each block of vectors that is long enough under a key of its own
    listed = lambda keys: F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("x")) for a, b in keys])
    fields = ("n", "dim", "wide", "rows", "ids", "data")
    left = queries.withColumn("to", F.explode(F.filter(listed(v_keys), lambda v: v["x"] >= F.col("need")))).select("part", F.col("to.key").alias("v_part"), *[F.col(c).alias(f"q_{c}") for c in fields], "start")
    right = blocks.withColumn("to", F.explode(F.filter(listed(q_keys), lambda q: q["x"] <= F.col("longest")))).select(F.col("part").alias("v_part"), F.col("to.key").alias("part"), *[F.col(c).alias(f"v_{c}") for c in fields])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                own, names, q = _matrix({c: row[f"q_{c}"] for c in fields})
                top = Top(names, own, np.frombuffer(row["start"], "<i8"), k)
                search(top, q, *_matrix({c: row[f"v_{c}"] for c in fields}))
                yield top.table()

    found = left.join(right.hint("shuffle_merge"), ["v_part", "part"]).mapInPandas(meet, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
