"""Collocations against plain counting; the trie against a dict."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from watchlake.llm import collocations as C

SCHEMA = "lang string, text string, n int, phrase string"


def brute(rows, min_count, top):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows_of = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if any(
                100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in found.items()
            ):
                continue
            rows_of.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, totals[lang], -score))
    return sorted(out)


def corpus():
    draw = random.Random(11)
    words = ["New", "york", "city", "hall", "a", "b", "é", "x1", "the", "\x00", "日本", "of"]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(draw.randrange(60)):
            text += draw.choice(["new york city hall", "San Francisco", *words, *words]) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"])
        rows.append((draw.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "lone words only"), ("en", "go go go go go " * 30), ("en", "w" * 5000), ("", "a b " * 9)]


def test_equal_to_plain_counting(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "mine") for r in rows], SCHEMA).repartition(5)
    for min_count, top in ((3, 40), (30, 2000)):
        got = C.collocations(docs, min_count, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, min_count, top)


@pytest.fixture
def whole_filter():
    return C.Bitmap(np.full(1 << 10, ~np.uint64(0)))


def counted(run, rows):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([r[0]]), pa.array([r[1]])], ["lang", "text"]) for r in rows]
    out = Counter()
    for batch in run(iter(batches)):
        for lang, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
            out[lang, phrase] += n
    return out


@pytest.mark.parametrize("chunk, entries, container", [(10**6, 10**6, 4096), (50, 40, 3), (7, 10, 1), (5, 10**6, 2)])
def test_chunks_spills_and_bursts_change_nothing(monkeypatch, whole_filter, chunk, entries, container):
    rows = [("und" if lang is None else lang, text or "") for lang, text in corpus()]
    for name, value in (("CHUNK_WORDS", chunk), ("TRIE_ENTRIES", entries), ("CONTAINER", container)):
        monkeypatch.setattr(C, name, value)
    expected = {k: Counter() for k in range(1, 5)}
    for lang, text in rows:
        tokens = C.words_and_borders(text)
        for k in expected:
            grams = [tokens[i : i + k] for i in range(len(tokens) - k + 1)]
            expected[k].update((lang, b" ".join(g).decode()) for g in grams if C._BORDER not in g)
    words = counted(C._count_words, rows)
    assert {k: n for k, n in words.items() if k[1] is not None} == expected[1]
    assert {lang: n for (lang, p), n in words.items() if p is None and n} == dict(
        (lang, sum(n for (own, _), n in expected[1].items() if own == lang)) for lang in {k[0] for k in expected[1]}
    )
    assert counted(C._count_phrases(2, whole_filter, None), rows) == expected[2]
    assert counted(C._count_phrases(4, whole_filter, whole_filter), rows) == expected[3] + expected[4]


def test_a_trie_holds_what_a_dict_holds(monkeypatch):
    monkeypatch.setattr(C, "CONTAINER", 4)
    draw, trie, plain, out = np.random.default_rng(2), C.HatTrie(4), Counter(), Counter()
    for _ in range(30):
        keys = np.unique(draw.integers(1, 5, (40, 4)), axis=0)
        rest = (keys[:, 1] << 42) | (keys[:, 2] << 21) | keys[:, 3]
        n = draw.integers(1, 9, len(keys))
        trie.add(keys[:, 0], rest, n)
        for word, key, count in zip(keys[:, 0].tolist(), rest.tolist(), n.tolist()):
            plain[word, key] += count
    assert any(isinstance(node, C.HatTrie.Branch) for node in trie.root.values())
    assert trie.entries == len(plain)
    for keep in (len(plain) // 2, 0):
        words, rests, counts = (column.tolist() for column in trie.spill(keep))
        out.update(dict(zip(zip(words, rests), counts)))
        assert len(out) + trie.entries == len(plain)
        assert trie.entries <= keep
    assert out == plain


def test_a_bitmap_keeps_nothing_back(spark):
    words = [f"w{i}" for i in range(3000)]
    bitmap = C.bitmap_of(spark.createDataFrame([("en", w) for w in words], "lang string, phrase string"), len(words))
    hashes = lambda own: np.array([C.word_hash("en", w.encode()) for w in own], np.uint64)
    assert bitmap.has(hashes(words)).all()
    assert bitmap.has(hashes([f"v{i}" for i in range(3000)])).mean() < 0.1
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    both = C.bitmap_of(spark.createDataFrame([("en", p) for p in pairs], "lang string, phrase string"), len(pairs))
    h = hashes(words)
    assert both.has(C.pair_hashes(h[:-1], h[1:])).all() and both.has(C.pair_hashes(h[1:], h[:-1])).mean() < 0.1


def test_an_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([("en", None, 1, "")], SCHEMA)).collect() == []
