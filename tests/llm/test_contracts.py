"""Contracts of queries against plain versions on rows that repeat, clash, or are large."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, licenses, line_dedup, mixing, topk


def plain_top(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q % 50 == 0:
            scores = sorted(((sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(good) if b != a), key=lambda s: (-s[0], s[1]))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_topk_rows(spark):
    """Repeated ids and rows are candidates each; large components have exact products."""
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(1, 60)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (2, rows[1][1]), (2, rows[7][1]), (100, [1e7, 3e6, 0.5]), (101, [1e7, 3e6]), (102, [1e7, 3e6 + 1 / 256]), (103, [3e6, 1e7]), (None, [1.0]), (7, None), (150, []), (200, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "row": F.lit("clash"), "score": F.lit(None)})
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == plain_top(rows)
    for bad, message in (([1e18, 1.0], "component"), ([1e9, 1e9], "product")):
        wide = spark.createDataFrame([(0, bad), (1, bad)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=message):
            topk.top_k(wide, F.lit(True)).collect()


def test_line_documents(spark):
    """A line is counted once for a doc_id, whatever rows and texts that has."""
    rows = [(1, f"once\nrow {i}") for i in range(12)] + [(i, f"shared \nown {i}\nSHARED") for i in range(2, 11)] + [(1, "Shared"), (None, "nothing"), (None, "shared"), (20, None), (20, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "keep": F.lit("clash"), "pos": F.lit(2), "d": F.lit(3)})
    kept = line_dedup.keep_bitmaps(df)
    assert kept.columns == ["doc_id", "text", "h", "pos", "d", "n_lines", "n_dropped", "keep"]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    where = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(where[key(x)]) < 10]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = kept.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(F.col("text"), F.col("keep"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert line_dedup.keep_bitmaps(df.limit(0)).collect() == []


def test_line_order_is_used(spark, tmp_path):
    """The range partitioning and its order serve the window: no exchange and no sort between them."""
    df = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    seen, cut = [], line_dedup.cut
    line_dedup.cut = lambda x: seen.append(x) or cut(x)
    try:
        line_dedup.keep_bitmaps(df).collect()
    finally:
        line_dedup.cut = cut
    plan = seen[1]._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange") == 1 and plan.count("Sort ") == 1, plan


def test_licenses_odd(spark):
    long = "x " * 50_000 + "mit license " + "y " * 50_000
    rows = [(1, long, "a"), (1, long, "a"), (None, "cc by cc by", "b"), (2, "", None), (3, "MIT-License" + licenses.NOTICES["gpl"], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string").withColumns({"labels": F.lit("clash"), "pos": F.lit(1), "template": F.lit("x")})
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(df).collect()}
    words = 2 + len(licenses._words(licenses.NOTICES["gpl"])) - 1
    assert (1, 100_002, 1, 50_000, 50_000, "mit", "mit") in got and (None, 4, 2, 0, 2, "cc-by", "cc-by") in got and (2, 0, 0, None, None, "", "") in got
    assert any(r[0] == 3 and r[1] == words and "gpl" in r[6] for r in got) and licenses.scan(df).count() == 5
    assert licenses.scan(df.limit(0)).collect() == []


def test_mixing_odd(spark):
    """Plain Poisson counts of each row; repeated and null ids; names that clash; a global order."""
    rows = [(i % 700 if i % 11 else None, f"t{i}", "rare" if i % 50 == 0 else "big") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copy": F.lit("clash"), "place": F.lit(1), "rate": F.lit(2)})
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "rate", "copy", "place"]
    n = {s: sum(r[2] == s for r in rows) for s in ("rare", "big")}

    def count(doc, rate):
        u = int(hashlib.md5(f"17:1:{'' if doc is None else doc}".encode()).hexdigest()[:12], 16) / 2**48
        p = c = np.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        return k

    want = {t: count(d, 1000 / n[s]) for d, t, s in rows}
    got, parts = {}, out.withColumn("part", F.spark_partition_id()).collect()
    for r in parts:
        got[r.text] = got.get(r.text, 0) + 1
    assert got == {t: k for t, k in want.items() if k}
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(r.part == int(r.place * size) for r in parts)


def test_long_conversations(spark):
    """Conversations beyond what is gathered at once, between short ones, in small batches."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} <|im_end|>" * 20) for i in range(400)] + [(c, 0, "assistant", f"short {c}") for c in range(2, 30)]
    rows += [(40, i, "user", "x" * 1000) for i in range(300)] + [(None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("clash"), "n_turns": F.lit(1)})
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = chat.format_chats(df, gather=20_000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {r.conv_id: r for r in found}
    assert len(got) == len(found) == 31
    for c, r in got.items():
        want = [(x[2], x[3]) for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert chat.parse(r.formatted) == want and r.n_turns == len(want)
