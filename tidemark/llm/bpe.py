"""Token ids of whole texts by a byte-level merge tokenizer, each word encoded once.

The tokenizer never joins across a space or line end, so a text's ids are those of its words in a row.
Arrow splits texts and tells their words apart; words of lower-case letters and signs, the bulk, are
merged in numpy many at a time, all others by the tokenizer itself; ids are gathered by word. Where this
is not found to encode probes as the tokenizer does, whole texts are given to it.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Bytes of words and ids that a worker learns, each counted as so many more, before those not seen since
#: are dropped; characters of texts that are encoded together; words gathered at once; bytes of the longest
#: piece merged in numpy, and how many are at once.
CACHED, ENTRY, GROUP_CHARS, GATHERED, LONGEST, MERGED = 48 << 20, 150, 8 << 20, 1 << 20, 64, 4096
LETTERS = bytes([*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])
SIMPLE = LETTERS + bytes([*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]) + b"0123456789 \n.,"
SMALL = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
#: Runs into which the tokenizer cuts words of letters and signs, apostrophes and special tokens apart.
SIGNS = rb"!-&(-/:-@\[-`{-~"
MIXED = re.compile(rb"[%s\xdf-\xf6\xf8-\xffa-z]+" % SIGNS)
RUNS = re.compile(rb"[\xdf-\xf6\xf8-\xffa-z]+|[%s]+" % SIGNS)
PROBES = ("The cat's hats. A B c, d.e,f .5 3.5 x1", "Éß ÿ. São\n\nabª x y\tz", "ŁÉ. 一二 é \U0001f600", "<|endoftext|> a_b--c (d) 'll", "internationalization unhappiness. aaaaaaa *** bababab!!", " ", "")
_HELD: dict[str, tuple] = {}
NONE = np.iinfo(np.int32).max


class Merges:
    """A tokenizer's merges, applied to many words at a time: in each step each word's first pair of least rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        by = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[by], NONE * self.size), np.append(by, NONE).astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        shown = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        self.symbols = np.array([vocabulary[chars[b] + e] for e in ("", end) for b in range(256)], np.int32)
        self.first = self._ranks(np.repeat(self.symbols[:256], 512), np.tile(self.symbols, 256)).reshape(256, 512)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, pair)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == pair), self.ranks[at], NONE)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of UTF-8, each one piece for the tokenizer and not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(sizes, kind="stable").tolist()
        out: list[bytes] = [b""] * len(words)
        for at in range(0, len(by), MERGED):
            some = by[at : at + MERGED]
            rows, ids, counts = self._merge([words[i] for i in some], sizes[some])
            data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            for row, i, j in zip(rows.tolist(), [0, *ends], ends):
                out[some[row]] = data[i:j]
        return out

    def _merge(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(words), int(sizes[-1])
        codes = np.zeros((n, width), np.int16)
        inside = np.arange(width) < sizes[:, None]
        codes[inside] = np.frombuffer(b"".join(words), np.uint8)
        codes[np.arange(n), sizes - 1] += 256
        now = np.where(inside, self.symbols[codes], -1)
        rank = np.where(inside[:, 1:], self.first[codes[:, :-1] & 255, codes[:, 1:]], NONE)
        rank = np.hstack([rank, np.full((n, 1), NONE, np.int32)])
        rows, done = np.arange(n), []
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done.append((rows[over], now[over]))
                rows, now, rank, at, best = rows[~over], now[~over], rank[~over], at[~over], best[~over]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            now[each, at] = self.merged[best]
            keep = np.ones(now.shape, bool)
            keep[each, at + 1] = False
            now = now[keep].reshape(len(rows), -1)
            keep[each, at + 1], keep[each, at] = True, False
            rank = rank[keep].reshape(now.shape)
            # the pairs that the merged symbol is in; the last column is of no pair
            right = np.minimum(at + 1, now.shape[1] - 1)
            rank[each, at] = np.where(right > at, self._ranks(now[each, at], now[each, right]), NONE)
            left = np.flatnonzero(at)
            rank[left, at[left] - 1] = self._ranks(now[left, at[left] - 1], now[left, at[left]])
        return np.concatenate([r for r, _ in done]), np.concatenate([x[x >= 0] for _, x in done]), np.concatenate([(x >= 0).sum(1) for _, x in done])


def _tokenizer(path: str | None):
    """The tokenizer, its merges or none, and the words so far; once for each worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _HELD:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        try:
            merges = Merges(path)
            _HELD[path] = (full, merges, [{}, {}, 0])
            if encode(list(PROBES), path) != _whole(list(PROBES), full):
                merges = None
        except (KeyError, ValueError):  # of another kind of model or alphabet
            merges = None
        _HELD[path] = (full, merges, [{}, {}, 0])
    return _HELD[path]


def vocabulary_size(path: str | None) -> int:
    return max(_tokenizer(path)[0].get_vocab().values()) + 1


def _whole(texts: list[str], full) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in full.encode_batch_fast(texts, add_special_tokens=False)]


def _learn(new: list, into: dict, path: str | None) -> None:
    """Adds the ids of words to into."""
    full, merges, _ = _tokenizer(path)
    plain = [w for w in new if type(w) is bytes and w and (w.isalpha() or not w.translate(None, LETTERS))]
    rest = set(new).difference(plain)
    mixed = {w: RUNS.findall(w) for w in rest if type(w) is bytes and MIXED.fullmatch(w) and b"<|" not in w}
    parts = {p for runs in mixed.values() for p in runs}.difference(into, plain)
    known = {w: w if w.isascii() else w.decode("latin-1").encode() for some in (plain, parts) for w in some}
    other = [w for w in rest if w not in mixed]
    if max(map(len, known.values()), default=0) > LONGEST:
        other += (long := [w for w, x in known.items() if len(x) > LONGEST])
        for w in long:
            del known[w]
    into.update(zip(known, merges.ids(list(known.values()))))
    into.update(zip(other, _whole([w if type(w) is str else w.decode("latin-1") for w in other], full)))
    into.update((w, b"".join([into[p] for p in runs])) for w, runs in mixed.items())


def _words(text: str) -> bytes | str:
    """The text with spaces between words whose ids in a row are the text's. Where it has Latin-1 characters
    only, and stops and commas follow letters, digits and white space only, its words are lower-cased and
    cut off from these, as bytes, of which there are fewer."""
    try:
        b = text.encode("latin-1")
        marks = {*b.translate(None, SIMPLE), 44, 46}
    except UnicodeEncodeError:
        marks = None
    if marks and not any(bytes((x, y)) in b for x in marks for y in (44, 46)):
        b = b.translate(SMALL)
        for x in (b".", b","):
            if x in b:
                b = b.replace(x + b" ", b" " + x + b" ")
        return b
    return text.replace("\n", " ")


def _known(words: list, held: list, path: str | None) -> list[bytes]:
    """Ids of different words, from those known or learned."""
    if held[2] > CACHED:
        held[:3] = {}, held[0], 0
    known, before = held[:2]
    fresh = [w for w in words if w not in known]
    again = {w: before[w] for w in fresh if w in before}
    known.update(again)
    if new := [w for w in fresh if w not in again]:
        _learn(new, known, path)
    out = list(map(known.__getitem__, words))
    held[2] += ENTRY * len(fresh) + sum(map(len, fresh)) + sum(map(len, map(known.__getitem__, fresh)))
    return out


def _gathered(texts: list, kind: pa.DataType, held: list, path: str | None) -> list[bytes]:
    """Ids of each text, of which spaces part the words."""
    words = pc.split_pattern(pa.array(texts, kind), " ")
    ends, words = words.offsets.to_numpy(), words.flatten().dictionary_encode()
    ids = _known(words.dictionary.to_numpy(zero_copy_only=False).tolist(), held, path)
    flat = np.frombuffer(b"".join(ids), "<u4")
    sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    index = words.indices.to_numpy()
    parts, at = [], [np.zeros(1, np.int64)]
    for i in range(0, len(index), GATHERED):
        some = index[i : i + GATHERED]
        size = sizes[some]
        to = np.cumsum(size, dtype=np.int32)
        parts.append(flat[np.repeat(starts[some] - to + size, size) + np.arange(to[-1], dtype=np.int32)])
        at.append(at[-1][-1] + to)
    data, cuts = np.concatenate(parts).tobytes() if parts else b"", (4 * np.concatenate(at)[ends]).tolist()
    return [data[i:j] for i, j in zip(cuts, cuts[1:])]


def encode(texts: list[str | None], path: str | None = None) -> list[bytes]:
    """Ids of each text without special tokens, as little-endian 32-bit."""
    full, merges, held = _tokenizer(path)
    out: list[bytes] = [b""] * len(texts)
    at = 0
    while at < len(texts):
        begun, size = at, 0
        while at < len(texts) and size < GROUP_CHARS:
            size += len(texts[at] or "")
            at += 1
        if not merges:
            out[begun:at] = _whole([t or "" for t in texts[begun:at]], full)
            continue
        group = [_words(t or "") for t in texts[begun:at]]
        for kind, of in ((bytes, pa.binary()), (str, pa.string())):
            mine = [i for i, w in enumerate(group) if type(w) is kind]
            if mine:
                for i, x in zip(mine, _gathered([group[i] for i in mine], of, held, path)):
                    out[begun + i] = x
    return out
