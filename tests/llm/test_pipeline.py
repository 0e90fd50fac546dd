"""Stages of the pipeline against plain versions, each on its predecessor's rows, and on odd tables."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tidemark.llm import packing

WORDS = {"en": [f"the{i}ing" for i in range(200)], "de": [f"über{i}ung" for i in range(200)]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    text = lambda lang, n: " ".join(draw.choice(WORDS[lang]) for _ in range(n))
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        t = "\n".join(text(lang, 30) for _ in range(3)) + "\n Common Line \n"
        rows.append((i, t, lang if i % 2 else None, "big" if i % 10 else "rare", len(t)))
    for i in range(10):
        rows.append((200 + i, rows[i][1], "en", "big", 1))  # exact copies
        words = rows[20 + i][1].split(" ")
        words[40] = "changed"
        rows.append((300 + i, " ".join(words), "en", "big", 1))  # near ones
    rows += [rows[5], (None, rows[6][1], "en", None, None), (None, rows[6][1], "en", None, None), (None, text("en", 60), None, None, None)]
    rows += [(400, None, "en", "big", 0), (401, "", "en", "big", 0), (402, "12 34 .", "en", "big", 7), (403, "Common line", "en", "big", 11), (404, text("en", 40_000), "en", "rare", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source").collect()), key=str)


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) > 4 else frozenset([tuple(w)])


def test_stages(spark, folder, tmp_path):
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "minhash", "mixing", "packing"] and pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = {}
    for i, (name, f) in enumerate(pipeline.STAGES):
        out = f(spark, docs, folder)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{i}")
        made[name] = before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
    # what has letters has a language here
    before, after = map(rows_of, made["language_id"])
    assert after == [r for r in before if r[1] and any(c.isalpha() for c in r[1])]
    # lines of ten documents go, and what has none left
    before, after = map(rows_of, made["line_dedup"])
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    where = {}
    for d, t, *_ in before:
        for x in t.split("\n"):
            where.setdefault(key(x), set()).add(d)
    want = []
    for d, t, *rest in before:
        left = "\n".join(x for x in t.split("\n") if not key(x) or len(where[key(x)]) < 10)
        want += [(d, left, *rest)] if left else []
    assert after == sorted(want, key=str) and all(r.n_chars == len(r.text) for r in made["line_dedup"][1].collect())
    # one row of each group of copies, whatever its id
    before, after = map(rows_of, made["minhash"])
    sets, group = [shingles(r[1]) for r in before], list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    assert len(after) == len(set(group)) < len(before)
    taken, left = set(), list(after)
    for i, r in enumerate(before):
        if r in left and group[i] not in taken:
            taken.add(group[i])
            left.remove(r)
    assert taken == set(group) and not left
    # sources come near equal shares, in whole documents
    before, after = map(rows_of, made["mixing"])
    assert set(after) <= set(before) and len(after) > 0.5 * len(before)
    share = sum(r[3] == "rare" for r in after) / len(after)
    assert share > sum(r[3] == "rare" for r in before) / len(before)
    # sequences can be built, and hold each row's tokens once
    docs, pieces = made["packing"][0].collect(), made["packing"][1].collect()
    rows = {}
    for p in pieces:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        rows.setdefault(p.row, []).append(p)
    got = sorted(np.array([t for p in sorted(ps, key=lambda p: p.start) for t in p.ids], "<u4").tobytes() for ps in rows.values())
    end = np.array([2], "<u4").tobytes()
    assert got == sorted(x + end for x in packing.encode([r.text for r in docs]))
    lengths = {}
    for p in pieces:
        lengths.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for some in lengths.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_run_and_empty(spark, folder, tmp_path):
    out = pipeline.run(spark, folder)
    assert out.count() > 0 and {"ids", "row", "sequence_id", "offset"} <= set(out.columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, f in pipeline.STAGES:
        assert f(spark, docs, folder).collect() == [], name
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as copy", "'x' as kept", "2 as extra", "'y' as lang_pred")
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert {"doc_id", "text", "lang", "source", "n_chars", "extra"} <= set(out.columns) and out.count() > 0, name


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
