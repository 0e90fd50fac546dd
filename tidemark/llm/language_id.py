"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, n-gram buckets by languages, of a fixed number of
rows, broadcast to the executors. A batch of texts is scored in numpy: n-grams of all texts are
hashed at once and the log probabilities of those that occur are summed per text.

Defined results: a text that is null or has no letter gives ``und`` with score 0, as does any text
when there is nothing to learn from; an empty table gives no rows. Texts of one letter are scored like others. Equal scores go to
the language that sorts first. Repeated rows are scored each. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the matrix are 2 ** BITS; the n-gram lengths.
BITS, ORDERS = 15, (2, 3)
#: At most about this many labelled texts of each language are learned from, drawn by a hash of doc_id.
SAMPLE_PER_LANGUAGE = 3000
#: Bytes that a model may have to be broadcast; more languages than fit are an error, none is left out.
MODEL_BYTES = 256 << 20
#: Code points handled at once; longer texts are cut into windows that overlap by one n-gram.
STEP = 1 << 19
#: The score is a posterior in which a text's n-grams count as this many at most.
EVIDENCE = 60
#: Rows whose texts are Python strings at once.
ROWS = 1000
LETTER = regex.compile(r"\p{L}")
_LUT: list[np.ndarray] = []


def _lut() -> np.ndarray:
    """Code point to its lower case, for letters; all else becomes a space."""
    if not _LUT:
        lut = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                lut[c] = ord(s.lower()[0])
        _LUT.append(lut)
    return _LUT[0]


def _windows(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Padded texts, the long ones in windows which share the n-grams out among them."""
    for i, t in enumerate(texts):
        t = f" {t}  "
        for at in range(0, len(t) - 2, STEP):
            yield i, t[at : at + STEP + 2]


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For groups of windows: text of each window, its bounds, and the buckets of the n-grams."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, w in _windows(texts):
        group.append((i, w))
        size += len(w)
        if size >= STEP:
            yield _buckets(group)
            group, size = [], 0
    if group:
        yield _buckets(group)


def _buckets(group: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    points = np.frombuffer("".join(w for _, w in group).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _lut()[points]
    ends = np.cumsum([len(w) for _, w in group])
    starts = ends - [len(w) for _, w in group]
    bounds = np.stack([starts, ends - 2], 1)
    out = []
    for n in ORDERS:
        h = np.full(len(c) - 2, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h ^= c[k : len(c) - 2 + k]
            h *= np.uint32(0x85EBCA77)
            h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE3D)
        out.append(h >> np.uint32(32 - BITS))
    return np.array([i for i, _ in group]), bounds, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        langs = b.column("lang").to_pylist()
        texts = b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            into = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for _, bounds, orders in _hashed([t for t, x in zip(texts, langs) if x == lang]):
                inside = np.zeros(len(orders[0]) + 1, np.int8)
                inside[bounds[:, 0]] += 1
                inside[bounds[:, 1]] -= 1
                inside = np.cumsum(inside[:-1]).astype(bool)
                for h in orders:
                    into += np.bincount(h[inside], minlength=1 << BITS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())})


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities, its last row the log priors.

    labelled: doc_id, text, lang; rows with null text or lang are left out."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    most = MODEL_BYTES // (8 << BITS)
    found = rows.groupBy("lang").count().orderBy("lang").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} languages: their model would be too large to broadcast")
    sizes = {r["lang"]: r["count"] for r in found}
    if not sizes:
        return [], np.zeros((1, 0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    sample = rows.where(drawn).select("text", "lang").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    m = np.zeros((1 << BITS, len(langs)))
    m[counts["bucket"].to_numpy(np.int64), np.searchsorted(langs, counts["lang"].to_numpy(str)) if len(counts) else []] = counts["n"]
    m += 0.5
    total = np.array([sizes[x] for x in langs], float)
    return langs, np.vstack([np.log(m / m.sum(0)), np.log(total / total.sum())])


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    at = [i for i, t in enumerate(texts) if langs and t and LETTER.search(t)]
    some = [texts[i] for i in at]
    sums, grams = np.zeros((len(some), len(langs))), np.zeros(len(some))
    for owner, bounds, orders in _hashed(some):
        pairs, own = bounds.ravel(), np.flatnonzero(bounds[:, 1] > bounds[:, 0])
        for j in range(len(langs)):
            column = matrix[:-1, j].copy()
            for h in orders:
                values = np.append(column[h], 0.0)
                np.add.at(sums[:, j], owner[own], np.add.reduceat(values, np.minimum(pairs, len(values) - 1))[::2][own])
        np.add.at(grams, owner, (bounds[:, 1] - bounds[:, 0]) * len(orders))
    picked, scores = ["und"] * len(texts), [0.0] * len(texts)
    if some:
        best = (sums + matrix[-1]).argmax(1)
        soft = sums * (np.minimum(grams, EVIDENCE) / grams)[:, None] + matrix[-1]
        soft = np.exp(soft - soft.max(1, keepdims=True))
        soft /= soft.sum(1, keepdims=True)
        for k, i in enumerate(at):
            picked[i], scores[i] = langs[best[k]], float(soft[k, best[k]])
    return picked, scores


def chance(model: tuple[list[str], np.ndarray]) -> float:
    """The score of a text that fits all of the model's languages alike, were these as frequent."""
    return 1 / max(1, len(model[0]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (all by default), with lang_pred and score; columns of docs so named are replaced."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = held.value
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            picked, scores = score(b.column("text").to_pylist(), langs, matrix)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(picked, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
