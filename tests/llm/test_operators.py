"""The operators against plain versions, on small rows that hold the odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, hnsw, language_id, licenses, line_dedup, minhash, mixing, packing, topk, vector_dedup
from tidemark.llm.components import connected_components

WORDS = [f"w{i}" for i in range(300)]


def text(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    base = [text(draw, 60) for _ in range(12)]
    rows = [(i, t, "en", "a") for i, t in enumerate(base)]
    rows += [(100 + i, t, "en", "a") for i, t in enumerate(base[:4])]
    rows += [(200 + i, t.replace(t.split()[30], "other", 1), "en", "b") for i, t in enumerate(base[:6])]
    rows += [(300 + i, f"Same Line\n {t}\n same line \t\n", "de", None) for i, t in enumerate(base * 1)]
    rows += [(400, None, None, "a"), (401, "", "en", None), (402, "   \n\t", "en", "b"), (403, "One", "en", "b"), (None, "no id here", "en", "a"), (404, "x" * 200_000, "en", "a"), (405, text(draw, 30_000), "en", "a"), (0, base[0], "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_lines", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))


def test_language_id(spark, docs):
    draw = random.Random(1)
    make = lambda letters: "".join(draw.choice(letters + " ") for _ in range(80))
    rows = [(i, make("abcde") if i % 2 else make("vwxyz"), "one" if i % 2 else "two") for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(labelled.where("doc_id < 150"))
    found = {r.doc_id: r for r in language_id.identify(labelled, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in found.values())
    odd = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert odd[400].lang_pred == odd[401].lang_pred == odd[402].lang_pred == "und" and odd[404].lang_pred != "und"
    assert language_id.identify(docs, language_id.train(labelled.limit(0))).where("lang_pred <> 'und'").count() == 0
    whole, step = language_id.score([rows[0][1] * 50], *model), language_id.STEP
    language_id.STEP = 100
    try:
        assert language_id.score([rows[0][1] * 50], *model)[0] == whole[0]
    finally:
        language_id.STEP = step


def plain_lines(rows, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add((d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = line_dedup.keep_bitmaps(docs)
    got = kept.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(kept["text"], kept["keep"]).alias("kept")).collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(rows, 10)
    assert line_dedup.keep_bitmaps(docs.limit(0)).count() == 0


def test_long_bitmap(spark):
    t = "\n".join("drop" if i % 130 in (0, 129) else f"line {i}" for i in range(1000))
    rows = [(i, t if i == 0 else "drop") for i in range(10)]
    kept = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
    got = kept.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(kept["text"], kept["keep"]).alias("kept")).collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(rows, 10)


def test_minhash(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()

    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def top(x):
        return x if up[x] == x else top(up[x])

    some = [(d, shingles(t)) for d, t in rows if d is not None]
    for d, s in some:
        for e, r in some:
            if s and r and 100 * len(s & r) >= 80 * len(s | r):
                x, y = sorted((top(d), top(e)))
                up[y] = x
    got = minhash.near_dedup(docs, words=2).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (top(r.doc_id), top(r.doc_id) == r.doc_id, len(shingles(r.text)))
    assert minhash.near_dedup(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1050)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got.get(x, x) == top(x) for x in up)


def test_terms_and_places(monkeypatch):
    """Terms, weights and places are plain ones; a place takes no sort of all centres."""
    draw = np.random.default_rng(4)
    ids = [np.append(draw.zipf(1.3, n) % 49152, packing.END_ID).astype("<u2") for n in (0, 1, 2, 3000)]
    for x in ids:
        terms, tf = np.unique(x[:-1], return_counts=True)
        got, weight = packing._counts(x)
        assert got.tolist() == terms.tolist() and weight.tolist() == np.log1p(tf).astype("f4").tolist()
    sample = [packing._counts(np.append(draw.zipf(1.3, 50) % 49152, packing.END_ID)) for _ in range(300)]
    for some in ([], sample[:2], sample):
        order = packing.Order(some, 10**9, 1000, 49152)
        nears = [np.argsort(-(order.centres @ order.project(*s)), kind="stable")[:3].tolist() for s in sample]
        with monkeypatch.context() as m:
            m.setattr(packing.np, "argsort", None)
            assert [order.key(*s) for s in sample] == [sum(c * packing.CENTRES ** (2 - i) for i, c in enumerate(near)) for near in nears]


def test_packing(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    for t in ("a..b. C, d., e.\nf,\ng 3.5 x1. Éß ÿ. 'S the ª x\xa0y", "ŁÉ. x", "x\ty. z <|endoftext|>e's", "", "c ́ d"):
        assert tok.encode(t, add_special_tokens=False).ids == np.frombuffer(packing.encode([t])[0], "<u4").tolist()
    pieces = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for d, ps in by_doc.items():
        ids = np.array([*tok.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at & (at - 1) == 0 and at <= 4096


def test_packing_short_documents():
    windows = packing.fill([np.array([5 + i % 2] * 9 + [2], "<u4") for i in range(600)])
    assert {d % 2 for d, *_ in windows[0][:300]} == {0}, "neighbours come before others, however many there are"


def test_packing_scores_all_terms():
    draw = random.Random(3)
    ids = [np.array([3 + int(400 * draw.random() ** 2) for _ in range(draw.randrange(1, 300))] + [2], "<u4") for _ in range(120)]
    n, mean = len(ids), sum(map(len, ids)) / len(ids)
    counts = [{t: x.tolist().count(t) for t in set(x.tolist()) - {2}} for x in ids]
    df = {t: sum(t in c for c in counts) for c in counts for t in c}

    def bm25(seed, doc):
        some = counts[seed].keys() & counts[doc].keys()
        norm = packing.K1 * (1 - packing.B + packing.B * len(ids[doc]) / mean)
        return sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * counts[doc][t] * (packing.K1 + 1) / (counts[doc][t] + norm) for t in some)

    index = packing.Index(ids)
    for seed in range(n):
        used = np.arange(n) == seed
        found = index.neighbours(seed, used, n).tolist()
        best = sorted((-bm25(seed, d), d) for d in range(n) if d != seed and counts[seed].keys() & counts[d].keys())
        assert sorted(found) == sorted(d for _, d in best)
        assert np.allclose([-bm25(seed, d) for d in found], [s for s, _ in best])


def test_packing_by_content(spark, monkeypatch):
    """Documents of a topic are far apart in the table; they meet in a shard, weighed by all documents."""
    draw, seen = random.Random(4), []
    rows = [(i, " ".join(draw.choice(WORDS[30 * (i % 10) : 30 * (i % 10) + 30]) for _ in range(60))) for i in range(400)]
    monkeypatch.setattr(packing, "SHARD_TOKENS", 8000)
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512).collect()
    assert len({p.doc_id for p in pieces}) == 400
    for p in pieces:
        seen.append((p.sequence_id, p.doc_id % 10))
    together = {}
    for s, topic in seen:
        together.setdefault(s, []).append(topic)
    share = sum(max(map(t.count, t)) for t in together.values()) / len(seen)
    assert share > 0.8
    ids = [np.array(x, "<u4") for x in ([5, 6, 2], [5, 7, 2], [6, 7, 2])]
    index = packing.Index(ids, (1000, 3.0, np.array([0, 0, 1000, 0, 0, 900, 3, 500])))
    assert index.neighbours(0, np.array([True, False, False]), 3).tolist() == [2, 1]


def test_licenses(spark):
    rows = [(1, "The MIT license, cc BY. Apache\nLicense! cc by"), (2, None), (3, "gnu general public licenses"), (4, "GNU General-Public license mit  license"), (4, "GNU General-Public license mit  license"), (5, licenses.NOTICES["bsd"] + " x"), (6, "é")]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()))
    assert got == [(1, 9, 4, 1, 7, "apache,cc-by,mit", "apache,cc-by,mit"), (2, 0, 0, None, None, "", ""), (3, 4, 0, None, None, "", ""), (4, 6, 2, 0, 4, "gpl,mit", "gpl,mit"), (4, 6, 2, 0, 4, "gpl,mit", "gpl,mit"), (5, len(licenses._words(rows[5][1])), 0, None, None, "", "bsd"), (6, 1, 0, None, None, "", "")]


def test_mixing(spark):
    rows = [(i, "t", "big" if i % 3 else None if i % 2 else "small") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    n = {}
    for r in out:
        n[r.source] = n.get(r.source, 0) + 1
    assert all(850 < x < 1150 for x in n.values()) and len(n) == 3
    assert [(r.doc_id, r.copy) for r in out] == [(r.doc_id, r.copy) for r in mixing.mix(docs).collect()]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert abs(mixing.mix(docs.limit(3), epochs=600.0).count() - 1800) < 300


def test_mixing_query_mixes_texts(spark, tmp_path, monkeypatch):
    from tidemark.llm import common, queries

    rows = [(i, f"text {i}", "en", "rare" if i % 10 == 0 else "big", 6) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(queries, "cut", lambda df: made.append(common.cut(df)) or made[-1], raising=False)
    out = queries.op7_mixing(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_chars", "copy", "place", "text_md5"]
    assert len(made) == 1, "the whole mixed table is made, not its small columns alone"
    mixed = made[0].collect()
    assert {"text", "lang"} <= set(made[0].columns) and all(r.text == f"text {r.doc_id}" for r in mixed)
    assert sorted((r.doc_id, r.copy) for r in mixed) == sorted((r.doc_id, r.copy) for r in out.collect())


def test_chat(spark):
    turns = [(1, 0, "user", "a <|im_end|> <\\| é"), (1, 1, "assistant", "<|im_start|>assistant ok <\\\\|x"), (1, 2, "a\nb\\|<|", None), (2, 0, None, ""), (None, 3, "assistant", "z" * 5000), (1, 1, "assistant", "again")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = {}
    for c, _, role, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", t or ""))
    for r in chat.digests(chat.format_chats(df)).collect():
        ts = want[r.conv_id]
        loss = "".join(t for role, t in ts if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(ts), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0



def vectors(spark, dims=8, n=300):
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(20, dims))
    x = centre[draw.integers(0, 20, n)] + draw.normal(size=(n, dims)) * 0.15
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * dims, 0), (1003, [float("nan")] * dims, 1), (1004, rows[3][1], None), (1005, [None] * dims, 1), (1050, rows[5][1], 2)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_topk(spark):
    rows, df = vectors(spark)
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    old, topk.BLOCK, topk.BUCKET, topk.FIRST = (topk.BLOCK, topk.BUCKET, topk.FIRST), 64, 16, 8
    try:
        got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    finally:
        topk.BLOCK, topk.BUCKET, topk.FIRST = old
    want = [(q, r + 1, i, s) for q in good if q % 50 == 0 for r, (s, i) in enumerate(sorted(((int(good[q] @ v), i) for i, v in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_vector_dedup(spark):
    rows, df = vectors(spark)
    unit = {i: (np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in unit if j != i and unit[j][1] == unit[i][1] and unit[i][0] @ unit[j][0] >= 0.93] for i in unit}
    up = {i: i for i, _, _ in rows}

    def top(x):
        return x if up[x] == x else top(up[x])

    for i, js in links.items():
        for j in js:
            x, y = sorted((top(i), top(j)))
            up[y] = x
    for shard in (8192, 40):
        got = {r.vec_id: r for r in vector_dedup.near_dedup(df, shard=shard).collect()}
        assert len(got) == len(rows)
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), top(i), top(i) == i) for i, _, _ in rows)
    assert vector_dedup.near_dedup(df.limit(0)).count() == 0


def test_graph_recall():
    x = np.random.default_rng(1).normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = hnsw.Graph(x).search(x[:200], 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids, best)]) >= 9


def test_merges_like_the_tokenizer():
    """Words of every length and kind, merged many at a time, as the tokenizer encodes them alone."""
    full, merges, _ = bpe._tokenizer(None)
    assert merges is not None
    letters = [chr(c) for c in range(97, 123)] + ["é", "ü", "ß"]
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(letters, n)) for n in range(1, 90) for _ in range(20)] + ["a" * n for n in range(1, 70)]
    words += ["international", "unhappiness", "***", "...", "--", "x.", "(ab),", "the!!", "<|endoftext|>", "it's", "12ab"]
    text = " ".join(words)
    assert bpe.encode([text, None, "", text + " 一"]) == bpe._whole([text, "", "", text + " 一"], full)
    short = [w.encode() for w in words if w.isalpha() and len(w.encode()) <= bpe.LONGEST]
    assert merges.ids(short) == bpe._whole([w.decode() for w in short], full) and merges.ids([]) == []
