"""The hidden Markov language model against direct sums over all state paths."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from watchlake.llm import hmm_lm as H


def small_model(seed=0, states=3, symbols=5):
    draw = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return H.Hmm(norm(draw.uniform(size=states)), norm(draw.uniform(size=(states, states))), norm(draw.uniform(size=(states, symbols))))


def path_sums(hmm, sequence):
    """Likelihood and expectations over every state path."""
    k = len(hmm.initial)
    total, first, moves, emitted = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(hmm.emission)
    for path in itertools.product(range(k), repeat=len(sequence)):
        p = hmm.initial[path[0]] * hmm.emission[path[0], sequence[0]]
        for a, b, x in zip(path, path[1:], sequence[1:]):
            p *= hmm.transition[a, b] * hmm.emission[b, x]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for s, x in zip(path, sequence):
            emitted[s, x] += p
    return total, first / total, moves / total, emitted / total


def test_forward():
    hmm = small_model()
    sequences = [np.array(s) for s in ([0], [4, 1, 2, 2], [], [3, 3, 0, 1, 4, 2])]
    got = H.forward_log10(hmm, sequences)
    expected = [math.log10(path_sums(hmm, s)[0]) if len(s) else 0.0 for s in sequences]
    assert np.allclose(got, expected)


def test_forward_of_a_long_text():
    hmm = small_model()
    sequence = np.random.default_rng(1).integers(0, 5, 50_000)
    state, log = hmm.initial * hmm.emission[:, sequence[0]], 0.0
    for x in sequence[1:]:
        log += math.log10(state.sum())
        state = (state / state.sum()) @ hmm.transition * hmm.emission[:, x]
    assert H.forward_log10(hmm, [sequence])[0] == pytest.approx(log + math.log10(state.sum()))


def test_expected_counts():
    hmm = small_model(2)
    windows = [[0, 3, 1, 4], [2, 2, 0], [1]]
    padded = np.array([w + [0] * (4 - len(w)) for w in windows])
    first, moves, emitted, log = H.expected_counts(hmm, padded, np.array([4, 3, 1]))
    sums = [path_sums(hmm, w) for w in windows]
    assert np.allclose(first, sum(s[1] for s in sums))
    assert np.allclose(moves, sum(s[2] for s in sums))
    assert np.allclose(emitted, sum(s[3] for s in sums))
    assert log == pytest.approx(sum(math.log(s[0]) for s in sums))


def sample_rows():
    draw = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        words = [draw.choice(common) if draw.random() < 0.8 else f"rare{draw.randrange(400)}" for _ in range(draw.choice([0, 1, 5, 60]))]
        rows.append((i, " ".join(w.upper() if draw.random() < 0.2 else w for w in words)))
    return rows + [(500, None), (501, ""), (None, "w1 w2 unseen"), rows[5], (502, rows[7][1]), (503, "É\x0bé\nw1  é" * 3)]


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


@pytest.mark.parametrize("head, symbols", [(1000, 1000), (12, 6), (0, 0)])
def test_scores(spark, head, symbols):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = H.score_documents(docs, states=3, rounds=2, head=head, symbols=symbols).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for d, t in rows:
        tokens = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        expected.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_add_up(spark):
    """Over all texts of up to two words, seen or not, the model spends no more than 1."""
    rows = [(i, "a b a a c" if i % 2 else "b b") for i in range(20)]
    texts = spark.createDataFrame([(t, True) for _, t in rows], "text string, learn boolean")
    model = H.fit(texts, states=2, rounds=3, head=10, symbols=1)
    assert model.likelihoods == sorted(model.likelihoods)
    words = ["a", "b", "c", "unseenword"]
    short = [" ".join(p) for k in range(3) for p in itertools.product(words, repeat=k)]
    scored = H.score(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), model).collect()
    assert 0 < sum(10**r.score for r in scored) <= 1


def test_empty_table(spark):
    assert H.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_looked_up_once_for_all_rounds(spark, monkeypatch):
    texts = spark.createDataFrame([("a b b c", True), ("", True), ("a c c\u00e9", True), ("zz", False)], "text string, learn boolean")
    tables = []
    monkeypatch.setattr(H, "saved", lambda rows, purpose: tables.append((purpose, rows.localCheckpoint())) or tables[-1][1])
    model = H.fit(texts, states=2, rounds=3, head=10, symbols=2)
    assert [purpose for purpose, _ in tables] == ["hmm-words", "hmm-symbols"]
    stored = sorted(r.symbols for r in tables[1][1].collect())
    kind = H._stored_type(model.head.end)
    assert stored == sorted(model.head.symbols(H.words_of(t))[0].astype(kind).tobytes() for t in ["a b b c", "", "a c c\u00e9"])
    assert [H._stored_type(n) for n in (255, 256, 65_535, 65_536)] == ["u1", "<u2", "<u2", "<u4"]
