"""The byte network: looked-up responses against direct sums, gradients, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchlake.llm import lang_id as L

SYLLABLES = {
    "aa": ["ka", "lo", "mi", "tu", "ne"],
    "bb": ["sch", "ein", "und", "ge", "lich"],
    "cc": ["é", "eau", "ou", "què", "ç"],
}


def text_of(lang, words, draw):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(words))


def small_model(seed=0):
    draw = np.random.default_rng(seed)
    size = len(L.WIDTHS) * L.FILTERS
    filters = {w: draw.normal(size=(w, L.CLASSES, L.FILTERS)) for w in L.WIDTHS}
    return L.ByteCnn(["aa", "bb"], filters, draw.normal(size=size).astype(np.float32), draw.normal(size=(size + 1, 2)))


def test_responses():
    model, windows = small_model(), L.windows_of("Grüße, 12 and more".encode() * 40)
    got = model.responses(windows)
    for n, window in enumerate(windows):
        line = np.concatenate([window, np.zeros(8, np.uint8)]).astype(int)
        expected = []
        for w in L.WIDTHS:
            rows = [sum(model.filters[w][j][line[t + j]] for j in range(w)) for t in range(L.WINDOW)]
            expected.append(np.max(rows, axis=0))
        assert np.allclose(got[n], np.maximum(np.concatenate(expected) + model.bias, 0), atol=1e-4)


def test_windows_cover_whole_texts():
    text = bytes(range(1, 256)) * 5
    windows = L.windows_of(text)
    assert windows.shape == (-(-len(text) // L.WINDOW), L.WINDOW)
    assert (windows.ravel()[: len(text)] == L._CLASS_OF[np.frombuffer(text, np.uint8)]).all()
    assert L.windows_of(b"").shape == (1, L.WINDOW)


def test_every_window_counts():
    draw = random.Random(1)
    model = L.train(*_training(draw))
    start, rest = text_of("aa", 40, draw), text_of("bb", 4000, draw)
    names, scores = model.predict([start, start + " " + rest, rest])
    assert names == ["aa", "bb", "bb"] and scores[1] < scores[2]


def _training(draw):
    rows = [(lang, L.windows_of(text_of(lang, 60, draw).encode())[0]) for lang in SYLLABLES for _ in range(60)]
    names = sorted(SYLLABLES)
    return np.stack([w for _, w in rows]), np.array([names.index(lang) for lang, _ in rows]), names


def test_held_out_accuracy(spark):
    draw = random.Random(2)
    rows = [(i, text_of(lang, draw.choice([12, 80, 600]), draw), lang, i) for i, lang in enumerate(random.Random(3).choices(list(SYLLABLES), k=400))]
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "12 !? \n", "bb", 1), (None, rows[0][1], rows[0][2], 1), rows[0]]
    rows += [(1003, text_of("cc", 20_000, draw), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = L.identify_languages(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 3 + ["cc"]
    assert by_id[None].lang_pred == rows[0][2] and by_id[None].held_out is False
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, "some text", None)], [(1, "some text", "aa"), (2, "other", "aa")]])
def test_little_to_learn(spark, rows):
    got = L.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    learned = {r[2] for r in rows if r[2]}
    assert {r.lang_pred for r in got} <= (learned or {"und"}) | {"und"}


def test_labels_are_no_inputs(spark):
    model = small_model()
    docs = spark.createDataFrame([(1, "some text", "aa"), (2, "some text", "bb")], "doc_id long, text string, lang string")
    one, two = L.with_language(docs.withColumn("x", F.lit(1)), model).collect()
    assert (one.lang_pred, one.score) == (two.lang_pred, two.score)


def test_other_scripts_are_learned(spark):
    draw = random.Random(4)
    scripts = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρσ", "zh": "的一是不了人我在有他这中大来上", "aa": "kalomitune"}
    rows = [
        (i, " ".join("".join(draw.choices(scripts[lang], k=draw.randint(2, 6))) for _ in range(60)), lang)
        for i, lang in enumerate(draw.choices(list(scripts), k=320))
    ]
    got = {r.doc_id: r for r in L.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_every_language_and_lettered_text_teaches(spark):
    rows = [(i, "some words of this language", f"x{i % 130:03}") for i in range(260)]
    rows += [(900, "1 2 3 4 5 " * 100 + "ok", "few"), (901, "12 34", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, labels, languages = L.training_windows(docs, F.lit(True))
    assert languages == sorted({f"x{i:03}" for i in range(130)} | {"few"})
    assert (L.letters_in(windows) > 0).all() and set(labels.tolist()) == set(range(131))
