"""Language ID against plain naive Bayes, on held-out rows and odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id

ALPHABETS = {"one": "abcdefgh", "two": "efghijkl", "three": "\u0431\u0432\u0433\u0434", "four": "\u4e00\u4e8c\u4e09"}


def made(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(list(ALPHABETS))
        words = ["".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randrange(1, 8))) for _ in range(draw.randrange(1, 30))]
        rows.append((i, " ".join(words).title() + draw.choice(["", ".", " 12", "!\n"]), lang))
    return rows


def grams(text):
    """Buckets of a text's n-grams, one at a time, as the module says: letters lower-cased, all else a
    space, one space before and after."""
    c = [ord(x.lower()[0]) if x.isalpha() else 32 for x in f" {text}  "]
    mask, out = 0xFFFFFFFF, []
    for n in language_id.ORDERS:
        for i in range(len(c) - 2):
            h = n * 0x9E3779B1 & mask
            for k in range(n):
                h = (h ^ c[i + k]) * 0x85EBCA77 & mask
                h ^= h >> 13
            out.append((h * 0xC2B2AE3D & mask) >> (32 - language_id.BITS))
    return out


def test_plain_bayes(spark):
    rows = made(300)
    train, test = rows[:200], rows[200:]
    counts = {x: {} for x in ALPHABETS}
    for _, t, x in train:
        for g in grams(t):
            counts[x][g] = counts[x].get(g, 0) + 1
    total = {x: sum(c.values()) + 0.5 * 2**language_id.BITS for x, c in counts.items()}
    prior = {x: math.log(sum(r[2] == x for r in train) / len(train)) for x in ALPHABETS}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 200"))
    found = {r.doc_id: r for r in language_id.identify(df.where("doc_id >= 200").drop("lang"), model).collect()}
    right = 0
    for i, t, x in test:
        gs = grams(t)
        sums = {y: sum(math.log((counts[y].get(g, 0) + 0.5) / total[y]) for g in gs) for y in ALPHABETS}
        best = max(sorted(ALPHABETS), key=lambda y: sums[y] + prior[y])
        assert found[i].lang_pred == best
        weight = min(len(gs), language_id.EVIDENCE) / len(gs)
        soft = {y: math.exp(weight * sums[y] + prior[y] - weight * sums[best] - prior[best]) for y in sums}
        assert abs(found[i].score - soft[best] / sum(soft.values())) < 1e-9
        right += best == x
    assert right >= 0.95 * len(test)
    assert language_id.chance(model) == 1 / 4


def test_odd_tables(spark, monkeypatch):
    rows = made(60)
    df = spark.createDataFrame([*rows, *rows[:3], (None, "abc abc", "one"), (70, None, "one"), (71, "", None), (72, "12 .", "two"), (73, "z", None), (74, "abc " * 300_000, None)], "doc_id long, text string, lang string")
    model = language_id.train(df)
    got = language_id.identify(df.withColumns({"lang_pred": F.lit(1), "score": F.lit("clash")}), model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == df.count()
    odd = {r.doc_id: r for r in got.collect()}
    assert {odd[i].lang_pred for i in (70, 71, 72)} == {"und"} and odd[74].lang_pred == "one" and odd[73].lang_pred != "und"
    assert language_id.identify(df.limit(0), model).collect() == []
    same = language_id.train(spark.createDataFrame([(1, "ab", "y"), (2, "ab", "x")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(df.where("doc_id = 73"), same).collect()} == {"x"}, "ties go to what sorts first"
    monkeypatch.setattr(language_id, "MODEL_BYTES", 3 * (8 << language_id.BITS))
    with pytest.raises(ValueError, match="over 3 languages"):
        language_id.train(df)


def test_many_languages(spark):
    """None is left out."""
    rows = [(i, chr(0x4E00 + i % 450) * 3, f"l{i % 450}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = language_id.train(df)
    assert len(langs) == 450 and matrix.shape == ((1 << language_id.BITS) + 1, 450)
    assert np.mean([r.lang == r.lang_pred for r in language_id.identify(df, (langs, matrix)).collect()]) > 0.99
