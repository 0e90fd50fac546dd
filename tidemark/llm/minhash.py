"""MinHash near-dedup of documents.

A document's set of word shingles gives many minima of universal hashes, which are banded. Documents
of equal sets become one class first. Classes that share a band are candidates: each is paired with
its bucket's leader, the one that shares bands with most, and pairs are verified on signatures, then
on the full sets. Where a bucket's classes are then in several components, its classes meet block by block, and
those of different components are compared on signatures and verified on the sets right there, so
that only links leave the task. Links are joined by large-star and small-star.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Shingles and sets are held as 64-bit hashes.

Defined results: documents without words (null, empty or blank text) link with nothing and have
n_shingles 0; one of fewer words than a shingle has its whole sequence as its one shingle; rows with
null doc_id are not linked, have null component_id and are kept; rows of one doc_id are one document
that links by each of its texts, and all get its component; an empty table gives no rows. Other
columns pass through, but for those named n_shingles, component_id and kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, trim
from .components import connected_components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 28, 5, 11
#: Signatures of pairs at the similarity agree in less than it minus this once in some 60,000 pairs.
MARGIN = 0.14
#: Classes, and bytes of their sets, of a block where a bucket's classes are compared with each other.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Bytes of text hashed at once.
GROUP = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("p", ())) < n:
        for name, base in (("p", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _TABLES[name] = np.multiply.accumulate(p)
        _TABLES["byte"] = _mix(np.arange(1, 257, dtype=np.uint64))
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        _TABLES["space"] = space
    return _TABLES["p"], _TABLES["inverse"]


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of data: sums of their bytes' hashes by place in the word, first bytes and lengths."""
    p, inverse = _powers(max(len(data), 1 << 16))
    d = np.frombuffer(data, np.uint8)
    space = np.ones(len(d) + 2, bool)
    space[1:-1] = _TABLES["space"][d]
    step = np.diff(space.view(np.int8))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_TABLES["byte"][d] * p[: len(d)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts], starts, ends - starts


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of data, from differences of one running sum."""
    sums, starts, lengths = _words_of(data)
    return _mix(sums + lengths.astype(np.uint64)), starts


def _long_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a long text, some bytes at a time; a word may go on over any number of them."""
    out, carried, length = [], 0, 0  # what there is of a word that goes on
    for at in range(0, len(data), GROUP):
        chunk = data[at : at + GROUP]
        sums, starts, lengths = _words_of(chunk)
        lengths = lengths.astype(np.uint64)
        if length:
            if len(starts) and starts[0] == 0:
                sums[0] = np.uint64((carried + pow(_BASE, length, 1 << 64) * int(sums[0])) & (1 << 64) - 1)
                lengths[0] += np.uint64(length)
            else:
                sums, lengths = np.r_[np.uint64(carried), sums], np.r_[np.uint64(length), lengths]
            carried = length = 0
        if at + GROUP < len(data) and chunk[-1] not in b" \t\n\x0b\x0c\r":
            carried, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(_mix(sums + lengths))
    return np.concatenate(out)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        group.append(data)
        size += len(data) + 1
        if size >= GROUP:
            yield from _sets(group, k)
            group, size = [], 0
    yield from _sets(group, k)


def _sets(group: list[bytes], k: int) -> Iterator[np.ndarray]:
    if not group:
        return
    if max(map(len, group)) > 2 * GROUP:
        words = [_long_hashes(d) if d else np.zeros(0, np.uint64) for d in group]
        counts = np.array([len(w) for w in words])
        words = np.concatenate(words)
    else:
        words, starts = _word_hashes(b"\n".join(group))
        bounds = np.cumsum([0] + [len(d) + 1 for d in group])
        counts = np.diff(np.searchsorted(starts, bounds))
    shingles = words.copy()
    for i in range(1, k):
        n = max(0, len(words) - i)
        shingles[:n] = _mix(shingles[:n] * np.uint64(0xD6E8FEB86659FD93) + words[i:])
    at = 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(shingles[at : at + n - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif n:
            h = np.array([n], np.uint64)
            for w in words[at : at + n]:
                h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            yield h
        else:
            yield words[:0]
        at += n


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The least of each universal hash a * x + b mod 2 ** 64, its upper half, of non-empty sets."""
    draw = np.random.Generator(np.random.PCG64(SEED))
    a = draw.integers(0, 1 << 64, hashes, np.uint64, False) | np.uint64(1)
    b = draw.integers(0, 1 << 64, hashes, np.uint64, False)
    out = np.empty((len(sets), hashes), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 15):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to]) >> np.uint64(32)
        starts = np.cumsum([0] + [len(s) for s in sets[at : to - 1]])
        y = np.empty_like(x)
        for i in range(hashes):
            np.multiply(x, a[i], out=y)
            np.add(y, b[i], out=y)
            out[at:to, i] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        at = to
    return out


def _sign(k: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = list(shingle_sets(part.column("text").to_pylist(), k))
                some = [s for s in sets if len(s)]
                signed = iter(minima(some, hashes))
                yield pa.record_batch({
                    "d": part.column("d"), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "sig": pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                })
        trim()

    return run


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield pa.record_batch({"d": part.column("d"), "whole": pa.array([s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), k)], pa.binary())})

    return run


def _agree(least: float, hashes: int):
    """Pairs whose signatures agree in at least that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, hashes) for c in ("s1", "s2"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return run


def _verify(percent: int):
    """Pairs of sets with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("w1"), b.column("w2")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
                    ok.append(False)
                    continue
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the others has 100 * intersection >= percent * union with x."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(x) + sizes - both)


def _across(least: float, hashes: int, percent: int):
    """Of two blocks of a bucket (or one with itself), links that join different components.

    Classes outside the most frequent component are held against all of other components, likeliest
    first, until one links or none is left."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["side", "rep"])
        left = frame[frame["side"] == 0]
        right = frame[frame["side"] == 1] if (frame["side"] == 1).any() else left
        reps = np.concatenate([left["rep"], right["rep"]])
        names, comp = np.unique(np.concatenate([left["comp"], right["comp"]]), return_inverse=True)
        main = np.bincount(comp).argmax()
        sig = np.frombuffer(b"".join([*left["sig"], *right["sig"]]), np.uint32).reshape(-1, hashes)
        whole = [np.frombuffer(w, np.uint64) for w in [*left["whole"], *right["whole"]]]
        size, n = np.array([len(w) for w in whole]), len(left)
        parent = np.arange(len(names))
        out = []
        for i in np.flatnonzero(comp != main).tolist():
            others = np.arange(n, len(reps)) if i < n else np.flatnonzero(comp[:n] == main)
            others = others[(parent[comp[others]] != parent[comp[i]]) & (percent * np.maximum(size[others], size[i]) <= 100 * np.minimum(size[others], size[i]))]
            if not len(others):
                continue
            share = (sig[others] == sig[i]).sum(1) / hashes
            others = others[np.argsort(-share, kind="stable")[: int((share >= least).sum())]]
            step = 4
            while len(others):
                ok = _linked(whole[i], [whole[j] for j in others[:step]], percent)
                for j in others[:step][ok].tolist():
                    x, y = parent[comp[i]], parent[comp[j]]
                    if x != y:
                        out.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
                        parent[parent == max(x, y)] = min(x, y)
                others = others[step:]
                others = others[parent[comp[others]] != parent[comp[i]]]
                step = min(4 * step, 1024)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


class NearDedup:
    """The steps over one set of documents."""

    def __init__(self, docs: DataFrame, words: int, similarity: float, bands: int, rows: int, key: Column):
        self.docs = docs.select(key.cast("long").alias("d"), "text").where("d is not null")
        self.words, self.percent, self.bands, self.rows = words, round(100 * similarity), bands, rows
        self.hashes, self.least = bands * rows, similarity - MARGIN

    def whole(self, ids: DataFrame) -> DataFrame:
        """d, whole: the sets of the documents ids (d)."""
        # a shuffle at every size: ids grow with the documents and are no fit for a broadcast
        return cut(self.docs.join(ids.hint("shuffle_merge"), "d", "left_semi").mapInArrow(_whole(self.words), "d long, whole binary"))

    def pairs(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Of candidate pairs a, b: those whose signatures agree and whose sets link."""
        sig = reps.select(F.col("rep"), "sig")
        signed = pairs.join(sig.toDF("a", "s1"), "a").join(sig.toDF("b", "s2"), "b").select("a", "b", "s1", "s2")
        near = cut(signed.mapInArrow(_agree(self.least, self.hashes), "a long, b long"))
        whole = self.whole(near.select(F.col("a").alias("d")).union(near.select("b")).distinct())
        joined = near.join(whole.toDF("a", "w1"), "a").join(whole.toDF("b", "w2"), "b").select("a", "b", "w1", "w2")
        links = cut(joined.mapInArrow(_verify(self.percent), "a long, b long"))
        drop(whole, near)
        return links

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """d, n, rep of all documents (rep null without words); rep, sig of classes."""
        signed = cut(self.docs.mapInArrow(_sign(self.words, self.hashes), "d long, n long, digest binary, sig binary"))
        reps = cut(signed.where("n > 0").groupBy("n", "digest").agg(F.min("d").alias("rep"), F.min("sig").alias("sig")))
        member = cut(signed.select("d", "n", "digest").join(reps.select("n", "digest", "rep"), ["n", "digest"], "left").select("d", "n", "rep"))
        drop(signed)
        return member, reps

    def buckets(self, reps: DataFrame) -> DataFrame:
        """key, rep, n of classes that share a band with another, and the bucket's size and leader."""
        width = 4 * self.rows
        band = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
        keyed = reps.select("rep", "n", F.explode(band).alias("key"))
        sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        # a class has a row for each band, so that no window is large
        shared = cut(keyed.join(sizes, "key").withColumn("weight", F.sum("size").over(Window.partitionBy("rep"))))
        leaders = shared.groupBy("key").agg(F.max(F.struct("weight", -F.col("rep"))).alias("top"))
        leaders = cut(leaders.select("key", (-F.col("top.col2")).alias("leader")))
        out = cut(shared.drop("weight").join(leaders, "key"))
        drop(sizes, shared, leaders)
        return out

    def left(self, buckets: DataFrame, reps: DataFrame, comps: DataFrame) -> DataFrame | None:
        """Links across components of buckets that still have several; None if none has. Of buckets with
        the same classes, one is looked at."""
        of = cut(buckets.where("size > 2").join(comps.toDF("rep", "comp"), "rep", "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp")))
        several = of.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("n")).alias("bytes"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("print")).where("x <> y")
        several = cut(several.groupBy("size", "bytes", "print", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
        if several.isEmpty():
            drop(of, several)
            return None
        rows = cut(of.join(several, "key"))
        drop(of, several)
        whole = self.whole(rows.select(F.col("rep").alias("d")).distinct())
        held, rows = rows, rows.join(reps.select("rep", "sig"), "rep").join(whole.toDF("rep", "whole"), "rep")
        # a block meets each other one under a key of the two
        rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", F.when(F.col("block") == F.col("i"), 0).otherwise(1))
        found = cut(rows.select("key", "i", "j", "side", "rep", "comp", "sig", "whole").groupBy("key", "i", "j").applyInPandas(_across(self.least, self.hashes, self.percent), "a long, b long"))
        drop(held, whole)
        return found

    def links(self, reps: DataFrame) -> DataFrame:
        """a, b: pairs that join what links join; those of the leaders as stars."""
        buckets = self.buckets(reps)
        led = buckets.where("rep <> leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        links = self.pairs(led, reps)
        comps = connected_components(links.toDF("u", "v"))
        more = self.left(buckets, reps, comps)
        stars = comps.where("node <> component").toDF("a", "b")
        stars = cut(stars.union(more) if more is not None else stars)
        drop(buckets, links, comps, *([] if more is None else [more]))
        return stars


def near_dedup(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, key: Column | None = None) -> DataFrame:
    """docs with n_shingles, component_id (the least doc_id reachable by links) and kept. key: what tells
    documents apart, a whole number that is the same whenever it is computed; by default doc_id."""
    docs = docs.drop("n_shingles", "component_id", "kept")
    key = docs["doc_id"].cast("long") if key is None else key
    run = NearDedup(docs, words, similarity, bands, rows, key)
    member, reps = run.classes()
    links = run.links(reps)
    same = member.where("rep is not null and rep <> d").select(F.col("d").alias("u"), F.col("rep").alias("v"))
    comps = connected_components(links.toDF("u", "v").union(same))
    of = member.groupBy("d").agg(F.max("n").alias("n_shingles")).join(comps, F.col("d") == F.col("node"), "left").select("d", "n_shingles", F.coalesce("component", "d").alias("component_id"))
    of = cut(of.toDF("__d", "__n", "__c"))
    drop(member, reps, links, comps)
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__key", key)
    out = keyed.where("__key is not null").join(of, F.col("__key") == F.col("__d"), "left")
    out = out.select(*names, F.coalesce("__n", F.lit(0)).cast("long").alias("n_shingles"), F.col("__c").alias("component_id"), (F.col("__d") == F.col("__c")).alias("kept"))
    # what has no id meets nothing
    rest = keyed.where("__key is null").select(*names, F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(rest)
