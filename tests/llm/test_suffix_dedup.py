"""Repeated passages against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from watchlake.llm import suffix_dedup as sd


def brute_force(rows):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample_rows(seed=1):
    draw = random.Random(seed)
    line = lambda n: "".join(draw.choice("abé \n") for _ in range(n))
    passages = [line(n) for n in (50, 51, 60, 90, 400)]
    rows = []
    for i in range(60):
        parts = [line(draw.choice([0, 3, 40, 300]))]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(passages), line(draw.choice([0, 1, 30]))]
        rows.append((draw.randrange(1000), "".join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(3000, "x" * 500), (3001, "x" * 60), (3002, "x" * 49), (3003, "ab" * 200), (3004, "ab" * 30)]
    rows += [(5, None), (6, ""), (None, passages[4]), (None, None), rows[3], (rows[4][0], passages[4] + "other")]
    return rows


@pytest.mark.parametrize("use_filter", [True, False])
def test_removed_bytes(spark, use_filter):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, doc int, digest string").repartition(4)
    got = sd.remove_repeated(docs, use_filter=use_filter)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows)


def test_hot_anchors_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_ROWS", 5)
    monkeypatch.setattr(sd, "GROUP_ROWS", 10)
    rows = sample_rows(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, sd.remove_repeated(docs).collect()), key=repr) == brute_force(rows)


def test_kept_text(spark):
    shared = "the passage that both of these documents hold, letter by letter."
    docs = spark.createDataFrame([(1, "a " + shared), (2, shared + " b")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in sd.remove_repeated(docs, keep_text=True).collect()}
    assert kept == {1: "a " + shared, 2: " b"}


def test_empty_table(spark):
    assert sd.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_classes():
    draw = random.Random(4)
    text = bytes(draw.choice(b"ab") for _ in range(400)) + b"a" * 200
    text += text[:300]
    line = np.frombuffer(text + bytes(64), np.uint8)
    starts = np.arange(len(text) - 50)
    order, classes = sd.equal_classes(line, starts)
    by_class = {}
    for i, c in zip(order.tolist(), classes.tolist()):
        by_class.setdefault(c, set()).add(i)
    expected = {}
    for i in starts.tolist():
        expected.setdefault(text[i : i + 50], set()).add(i)
    assert {frozenset(v) for v in by_class.values() if len(v) > 1} == {frozenset(v) for v in expected.values() if len(v) > 1}
