"""Contamination against a brute-force alignment of every document with every item."""

import random

import numpy as np
import pytest

from watchlake.llm import decontaminate as D


def words(text):
    return (text or "").lower().encode().translate(D._SEPARATED).split()


def edits_to_best_piece(item, text):
    """Smallest edit distance of an item to any piece of a text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        ahead = [i]
        for j, t in enumerate(text, 1):
            ahead.append(min(row[j - 1] + (w != t), row[j] + 1, ahead[j - 1] + 1))
        row = ahead
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        ahead = [i]
        for j, y in enumerate(b, 1):
            ahead.append(min(row[j - 1] + (x != y), row[j] + 1, ahead[j - 1] + 1))
        row = ahead
    return row[-1]


def test_best_alignment():
    draw = random.Random(1)
    for _ in range(60):
        item = [draw.randrange(1, 5) for _ in range(draw.randint(1, 9))]
        text = [draw.randrange(1, 5) for _ in range(draw.randint(0, 20))]
        edits, start, end = D.best_alignment(np.array(item, np.uint64), np.array(text, np.uint64))
        assert edits == edits_to_best_piece(item, text)
        assert distance(item, text[start:end]) == edits


def test_walks_merge_without_changing_what_is_written():
    draw = np.random.default_rng(2)
    line = np.concatenate([draw.integers(1, 9, 400).astype(np.uint64), np.zeros(200, np.uint64)])
    starts = np.arange(0, 400, 3)
    steps = [0, 5, 17, 64, 90, 150]
    written = dict(D.walked(line, starts, 1, steps))
    bits = [D._bits(line, 1, j) for j in range(3)]
    for k, start in enumerate(starts):
        place = start
        for step in range(151):
            if step in steps:
                assert written[step][k] == line[place]
            place += int(bits[step >> 6][place] >> np.uint64(step & 63)) & 1


def corpus(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 9, 20, 45, 150])))) for i in range(40)]
    docs = []
    for i in range(120):
        parts = [" ".join(draw.choices(vocabulary, k=draw.choice([0, 30, 400])))]
        if i % 2:
            copied = draw.choice(items)[1].split()
            for _ in range(draw.choice([0, 0, len(copied) // 20])):
                copied[draw.randrange(len(copied))] = "changed"
            parts.append(" ".join(w.upper() + draw.choice(["", "!!", ","]) for w in copied))
        parts.append(" ".join(draw.choices(vocabulary, k=20)))
        docs.append((i, "  ".join(parts)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    docs += [(500, None), (501, ""), (None, docs[1][1]), docs[3]]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    got = D.contaminated(frame, spark.createDataFrame(items + [(99, None), (98, " !! "), (None, items[0][1])], "item_id long, text string"))
    rows = got.collect()
    found = sorted(((r.doc_id, r.item_id) for r in rows), key=repr)
    expected = []
    for doc_id, text in docs:
        for item_id, item in items:
            own = words(item)
            if edits_to_best_piece(own, words(text)) <= int(0.2 * len(own) + 1e-9):
                expected.append((doc_id, item_id))
    assert set(found) <= set(expected)
    assert len(found) >= 0.98 * len(expected) and len(expected) > 50
    texts, by_item = dict(docs), dict(items)
    for r in rows:
        if r.doc_id is not None:
            assert distance(words(by_item[r.item_id]), words(texts[r.doc_id])[r.start : r.end]) == r.edits


@pytest.mark.parametrize("share, least", [(0.05, 0.99), (0.1, 0.95), (0.2, 0.9)])
def test_recall_of_edited_passages(share, least):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [draw.choices(vocabulary, k=draw.choice([15, 25, 40, 60])) for _ in range(150)]
    cache = D._WordHashes()
    index = D.Index(list(range(150)), [D.word_hashes(" ".join(i), cache) for i in items], 0.8)
    texts = []
    for item in items:
        copied = list(item)
        for _ in range(int(share * len(item))):
            place = draw.randrange(len(copied))
            kind = draw.choice("sid")
            if kind == "d":
                del copied[place]
            else:
                copied[place : place + (kind == "s")] = [draw.choice(vocabulary)]
        texts.append(" ".join(draw.choices(vocabulary, k=draw.randrange(300)) + copied + draw.choices(vocabulary, k=100)))
    found = {(row, item) for row, item, *_ in D.scan(index, texts, cache)}
    assert sum((i, i) in found for i in range(150)) >= least * 150


def test_documents_that_stay(spark, monkeypatch):
    docs, items = corpus(4)
    monkeypatch.setattr(D, "ITEM_BLOCK", 7)
    frame = spark.createDataFrame([(*d, "x") for d in docs + [(900, None)]], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hit = {r.doc_id for r in D.contaminated(frame, benchmark).collect()}
    clean = D.drop_contaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs + [(900, None)]} - hit)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contaminated(none, items).count() == 0
    assert D.contaminated(one, items.limit(0)).count() == 0
    assert D.drop_contaminated(one, items.limit(0)).count() == 1


def test_documents_that_begin_inside_an_item():
    """Items whose first words are missing, in any row, are looked for in the document of the window."""
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [draw.choices(vocabulary, k=60) for _ in range(80)]
    cache = D._WordHashes()
    index = D.Index(list(range(80)), [D.word_hashes(" ".join(i), cache) for i in items], 0.8)
    texts = [" ".join(item[draw.choice([4, 8]) :]) + " and so on" for item in items]
    found = [{which for row, which, *_ in D.scan(index, order, cache)} for order in (texts, texts[::-1])]
    alone = {which for text in texts for _, which, *_ in D.scan(index, [text], cache)}
    assert found[0] == found[1] == alone
    assert len(alone) >= 0.98 * 80


def edited(item, edits, vocabulary, draw):
    copied = list(item)
    for _ in range(edits):
        place, kind = draw.randrange(len(copied)), draw.choice("sid")
        if kind == "d":
            del copied[place]
        else:
            copied[place : place + (kind == "s")] = [draw.choice(vocabulary)]
    return copied


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 8, 10, 15, 20, 31, 34, 59, 64, 120, 250])
def test_recall_at_the_allowed_edits(length):
    draw = random.Random(length)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [draw.choices(vocabulary, k=length) for _ in range(150)]
    cache = D._WordHashes()
    index = D.Index(list(range(150)), [D.word_hashes(" ".join(i), cache) for i in items], 0.8)
    parts = [edited(item, int(0.2 * length + 1e-9), vocabulary, draw) for item in items]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(50)) + p + draw.choices(vocabulary, k=30)) for p in parts]
    found = {(row, item) for row, item, *_ in D.scan(index, texts, cache)}
    assert sum((i, i) in found for i in range(150)) >= (1 if length < 32 else 0.98) * 150
