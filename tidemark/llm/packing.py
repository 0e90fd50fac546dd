"""Lexical retrieval packing.

Documents are put in an order of content and read in shards of consecutive rows of it, of a bounded
number of tokens. Each shard has a BM25 inverted index over its token ids, with the frequencies and
the mean length of all documents. Neighbours are sought in the seed's shard only. A window starts with
a seed, the next unused document, and takes the seed's best-scoring unused neighbours until it is full;
the document that overflows is cut, and its rest is the next window's seed. Where a seed has no
neighbour left, the next unused document follows. What is left at a shard's end is cut at powers of two, which need no
padding, so no sequence is padded at all.

The order: documents are projected to a few dimensions by their weighted terms, and sorted by the
nearest of some sampled centres, the second and the third; doc_id and row split a hot group.

Defined results: null or empty text is its end id alone; repeated rows are packed each, and pieces of a
row have its number in row; equal scores go to the earlier row; an empty table gives no rows; null
doc_id is passed on. Other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode, vocabulary_size
from .common import cut, trim

WINDOW, END_ID = 4096, 2
#: Tokens of a shard, or one document more; neighbours asked for at once; BM25's parameters.
SHARD_TOKENS, NEXT, K1, B = 1_000_000, 64, 1.2, 0.75
#: A term is in many documents of a shard if in more than one of so many.
OFTEN = 12
#: Documents that centres are learned from, and centres at most; dimensions; shards of a partition.
SAMPLE, CENTRES, DIMENSIONS, SHARDS = 4000, 256, 96, 4
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"


def _ids(texts: pa.Array, path: str | None) -> Iterator[np.ndarray]:
    """Each text's ids and the end id; some texts at a time, as their ids are held."""
    end = np.array([END_ID], "<u4").tobytes()
    for at in range(0, len(texts), 2000):
        for x in encode(texts[at : at + 2000].to_pylist(), path):
            yield np.frombuffer(x + end, "<u4")


def _counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's terms but for the end, and the weights of their counts."""
    x = np.sort(ids[:-1])
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return x[at].astype(np.int64), np.log1p(np.diff(at, append=len(x))).astype("f4")


@functools.lru_cache(1)
def _axes(terms: int) -> np.ndarray:
    return np.random.default_rng(0).standard_normal((terms, DIMENSIONS), "f4")


class Order:
    """A document's place by content: its nearest centres."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], tokens: int, shard: int, terms: int):
        df = np.zeros(terms)
        for some, _ in sample:
            df[some] += 1
        self.idf = np.log1p((len(sample) - df + 0.5) / (df + 0.5)).astype("f4")
        x = np.array([self.project(*s) for s in sample], "f4").reshape(-1, DIMENSIONS)
        k = min(CENTRES, len(x), max(1, 2 * tokens // shard))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)] if k else x
        for _ in range(8 if k else 0):
            near = (x @ c.T).argmax(1)
            for i in np.unique(near):
                mean = x[near == i].sum(0)
                c[i] = mean / max(1e-9, float(np.sqrt(mean @ mean)))
        chain, left = [0] if k else [], list(range(1, k))  # so that centres next to each other are alike
        while left:
            chain.append(left.pop(int((c[left] @ c[chain[-1]]).argmax())))
        self.centres = c[chain]

    def project(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        x = (weight * self.idf[terms]) @ _axes(len(self.idf)).take(terms, 0)
        return x / max(1e-9, float(np.sqrt(x @ x)))

    def key(self, terms: np.ndarray, weight: np.ndarray) -> int:
        close, place = self.centres @ self.project(terms, weight), 0
        for i in range(min(3, len(close))):
            c = int(close.argmax())
            place += c * CENTRES ** (2 - i)
            close[c] = -np.inf
        return place


class Index:
    """BM25 over the token ids of a shard's documents; of: how many documents there are in all, their
    mean length and in how many each term is, by default those of the shard."""

    def __init__(self, ids: list[np.ndarray], of: tuple[int, float, np.ndarray] | None = None):
        n = self.n = len(ids)
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64)
        size = int(flat.max()) + 1
        pairs, tf = np.unique(np.repeat(np.arange(n), lengths) * size + flat, return_counts=True)
        docs, terms = pairs // size, pairs % size
        df = np.bincount(terms, minlength=size)
        among, mean, known = of or (n, lengths.mean(), df)
        known = known[:size]
        idf = np.log1p((among - known + 0.5) / (known + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, mean))
        weight = idf[terms] * tf * (K1 + 1) / (tf + norm[docs])
        shared = (df[terms] > 1) & (terms != END_ID)  # a term of one document finds no other
        docs, terms, weight = docs[shared], terms[shared], weight[shared]
        by = np.argsort(terms, kind="stable")
        self.post_docs, self.post_weight = docs[by].astype(np.int32), weight[by].astype(np.float32)
        self.post_at = np.searchsorted(terms[by], np.arange(size + 1))
        # terms of many documents as columns of a matrix, each product of which is a seed's share of scores
        often = np.flatnonzero(np.diff(self.post_at) * OFTEN > n)
        self.column = np.full(size, -1)
        self.column[often] = np.arange(len(often))
        self.often = np.zeros((n, len(often)), np.float32)
        many = self.column[terms] >= 0
        self.often[docs[many], self.column[terms[many]]] = weight[many]
        self.terms = terms
        self.at = np.searchsorted(docs, np.arange(n + 1))
        self.asked, self.scores = -1, np.zeros(n)

    def neighbours(self, seed: int, used: np.ndarray, most: int) -> np.ndarray:
        """Unused documents that share a term with the seed, best first by all of its terms."""
        if seed != self.asked:
            terms = self.terms[self.at[seed] : self.at[seed + 1]]
            if not len(terms):
                return np.zeros(0, np.int64)
            at = self.column[terms]
            asks = np.zeros(self.often.shape[1], np.float32)
            asks[at[at >= 0]] = 1
            self.asked, self.scores = seed, (self.often @ asks).astype(float)
            rare = terms[at < 0]
            spans = [slice(i, j) for i, j in zip(self.post_at[rare].tolist(), self.post_at[rare + 1].tolist())]
            if spans:
                self.scores += np.bincount(np.concatenate([self.post_docs[x] for x in spans]), np.concatenate([self.post_weight[x] for x in spans]), self.n)
        scores = self.scores
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > most:
            least = np.partition(scores[found], -most)[-most]
            found = found[scores[found] >= least]
        return found[np.lexsort((found, -scores[found]))][:most]


def fill(ids: list[np.ndarray], window: int = WINDOW, of: tuple[int, float, np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length); all but those at the end are full, and those have lengths
    of powers of two."""
    index, n = Index(ids, of), len(ids)
    used = np.zeros(n, bool)
    windows: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    room, following = window, 0

    def place(doc: int) -> bool:
        """Whether the document's end began a new window, which it seeds."""
        nonlocal now, room
        used[doc] = True
        at, left, cut = 0, len(ids[doc]), False
        while left:
            took = min(left, room)
            now.append((doc, at, took))
            at, left, room = at + took, left - took, room - took
            if not room:
                windows.append(now)
                now, room, cut = [], window, left > 0
        return cut

    seed = None
    while True:
        if seed is None:
            while following < n and used[following]:
                following += 1
            if following == n:
                break
            seed = following
            place(seed)
            continue_with = seed if now else None
        else:
            continue_with = seed
        seed = None
        if continue_with is None:
            continue
        begun = len(windows)
        while len(windows) == begun:  # a window of many short documents asks for its next neighbours
            found = index.neighbours(continue_with, used, NEXT)
            for doc in found:
                if place(int(doc)):
                    seed = int(doc)
                if len(windows) > begun:
                    break
            if len(found) < NEXT:
                break
    # the rest, cut at powers of two
    left = window - room
    while left:
        size, part = 1 << (left.bit_length() - 1), []
        want = size
        while want:
            doc, at, length = now.pop(0)
            took = min(length, want)
            part.append((doc, at, took))
            if took < length:
                now.insert(0, (doc, at + took, length - took))
            want -= took
        windows.append(part)
        left -= size
    return windows


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, the number of
    its row, and the piece's ids if asked for. tokenizer: a file's path, by default that of the public tokenizers."""

    def shard(keys: list, numbers: list, ids: list[np.ndarray], sequence: int) -> tuple[pa.RecordBatch, int]:
        rows, pieces = [], []
        for w in fill(ids, window, of):
            offset = 0
            for doc, at, length in w:
                piece = ids[doc][at : at + length].tobytes()
                rows.append((keys[doc], at, length, zlib.crc32(piece), len(ids[doc]), sequence, offset, numbers[doc]))
                if with_ids:
                    pieces.append(np.frombuffer(piece, "<u4").astype(np.int32))
                offset += length
            sequence += 1
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = {name: pa.array(c, pa.int64()) for name, c in zip(names, zip(*rows))}
        if with_ids:
            out["ids"] = pa.array(pieces, pa.list_(pa.int32()))
        return pa.record_batch(out), sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        keys, numbers, ids, size = [], [], [], 0
        for b in batches:
            for key, row, x in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("ids")):
                keys.append(key)
                numbers.append(row)
                ids.append(np.frombuffer(x.as_buffer(), stored).astype("<u4"))
                size += len(ids[-1])
                if size >= SHARD_TOKENS:
                    out, sequence = shard(keys, numbers, ids, sequence)
                    yield out
                    keys, numbers, ids, size = [], [], [], 0
        if ids:
            yield shard(keys, numbers, ids, sequence)[0]
        trim()

    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    n = docs.count()

    def count_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(x), *_counts(x.astype(np.int64))) for x in _ids(b.column("text"), tokenizer)]
            yield pa.record_batch({"size": pa.array([s for s, _, _ in found], pa.int64()), "terms": pa.array([t.astype("<i4").tobytes() for _, t, _ in found], pa.binary()), "weights": pa.array([w.tobytes() for _, _, w in found], pa.binary())})

    some = docs.sample(min(1.0, SAMPLE / max(1, n)), 0).mapInArrow(count_some, "size long, terms binary, weights binary").collect()
    tokens = sum(r["size"] for r in some) * n // max(1, len(some))
    size = vocabulary_size(tokenizer)
    stored = "<u2" if size <= 1 << 16 else "<u4"
    order = Order([(np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["weights"], "<f4")) for r in some], tokens, SHARD_TOKENS, size)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their places; at a partition's end how often its terms are in documents, of place -1."""
        row = TaskContext.get().partitionId() << 40
        df, length = np.zeros(size, np.int64), 0
        for b in batches:
            at = 0
            ids, places = [], []
            for x in _ids(b.column("text"), tokenizer):
                terms, weight = _counts(x)
                ids.append(x.astype(stored).tobytes())
                places.append(order.key(terms, weight))
                df[terms] += 1
                length += len(x)
                if len(ids) == 1000 or at + len(ids) == b.num_rows:
                    yield pa.record_batch({"doc_id": b.column("doc_id").slice(at, len(ids)), "place": pa.array(places, pa.int64()), "row": pa.array(range(row, row + len(ids)), pa.int64()), "ids": pa.array(ids, pa.binary())})
                    at, row = at + len(ids), row + len(ids)
                    ids, places = [], []
        yield pa.record_batch({"doc_id": pa.array([None], pa.int64()), "place": pa.array([-1], pa.int64()), "row": pa.array([length], pa.int64()), "ids": pa.array([df.astype("<i4").tobytes()], pa.binary())})
        trim()

    encoded = cut(docs.mapInArrow(keyed, "doc_id long, place long, row long, ids binary"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, length = np.zeros(size, np.int64), 0
        for b in batches:
            for row, x in zip(b.column("row").to_pylist(), b.column("ids")):
                df += np.frombuffer(x.as_py(), "<i4")
                length += row
        at = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(np.append(at, -1)), "n": pa.array(np.append(df[at], length))})

    # one row for each term of the vocabulary
    sums = dict(map(tuple, encoded.where("place < 0").select("row", "ids").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    length = sums.pop(-1, 0)
    df = np.zeros(size, np.int64)
    df[list(sums)] = list(sums.values())
    of = n, length / max(1, n), df
    parts = max(1, -(-length // (SHARDS * SHARD_TOKENS)))
    placed = encoded.where("place >= 0").repartitionByRange(parts, "place", "doc_id", "row").sortWithinPartitions("place", "doc_id", "row").select("doc_id", "row", "ids")
    return placed.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
