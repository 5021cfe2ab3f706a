"""Toxicity: the decoder against all paths of small lattices, and held-out labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchlake.llm import toxicity as T

WORDS = "the cat runs home and sees many small birds near old stone walls".split()
BAD = ["grumbol", "stinkard", "wretchel"]


@pytest.fixture(scope="module")
def decoder():
    counts = {}
    for word in WORDS * 3 + BAD:
        signs = "^^" + word + "$"
        for i in range(len(word) + 1):
            counts[signs[i : i + 3]] = counts.get(signs[i : i + 3], 0) + 1
    return T.Decoder(counts)


@pytest.mark.parametrize(
    "shown, word",
    [("gr0mbol", "grombol"), ("5t1nk@rd", "stinkard"), ("stiiiinkard", "stinkard"), ("s.t.i.n.k.a.r.d", "stinkard"), ("wre7chel!!", "wretchel"), ("c4t###", "cat"), ("***b1rds", "birds")],
)
def test_restored(decoder, shown, word):
    assert T.restored_word(decoder, shown) == word


@pytest.mark.parametrize("word", ["plain", "élan", "12345", "", "...", "seen", "x" * 3000])
def test_left_alone(decoder, word):
    assert T.restored_word(decoder, word) in (word, "")


def cheapest(decoder, token):
    """All readings of a token of signs and letters, none repeated."""
    paths = [(0.0, "")]
    for i, sign in enumerate(token):
        inside = any(c.isalnum() for c in token[: i + 1]) and any(c.isalnum() for c in token[i:])
        if sign.isalpha():
            options = [(sign, 0.0)]
        else:
            options = [(c, T.REPLACED) for c in T.LEET.get(sign, "")] + [("", T.DROPPED_INSIDE if sign in T.LEET and inside else T.DROPPED)]
        paths = [(total + extra, text + c) for total, text in paths for c, extra in options]
    return min((total + decoder._word_cost(text), text) for total, text in paths)[1]


def test_viterbi_is_exact(decoder):
    draw = random.Random(1)
    for _ in range(200):
        token = ""
        while len(token) < 7:
            c = draw.choice("catbirds0134@$!.-")
            token += c if not token or token[-1] != c else ""
        assert decoder.restore(token) == cheapest(decoder, token), token


def test_spelled_words(decoder):
    assert "birds" in T.restored_words(decoder, "see b i r d s there", {})
    assert T.restored_words(decoder, None, {}) == set()


def disguised(word, draw):
    table = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "$", "t": "7"}
    return "".join(table.get(c, c) if draw.random() < 0.4 else c for c in word)


def corpus():
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        words = draw.choices(WORDS, k=draw.choice([8, 60, 500]))
        for _ in range(4 * toxic):
            words.insert(draw.randrange(len(words)), disguised(draw.choice(BAD), draw))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_labels(spark):
    docs, labels = corpus()
    docs += [(2000, None), (2001, ""), (None, docs[0][1]), docs[0], (2002, "grumbol " + "stinkard " * 30_000)]
    labels += [(None, 1), (5, None), labels[0]]
    frame = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, label string, score double").repartition(3)
    got = T.score_documents(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == y for p, y in held) >= 0.98 * len(held) and len(held) > 200
    assert by_id[2000].score == by_id[2001].score < 0.5 and by_id[2002].predicted == 1


def test_filter_keeps_columns_and_clean_documents(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, 1) for d in docs + [(3000, None)]], "doc_id long, text string, toxic int")
    kept = T.drop_toxic(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, toxic in labels if not toxic} | {3000}
    assert clean <= ids and len(ids - clean) <= 4


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_little_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    got = T.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len({r.score for r in got}) == 1
    assert T.score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_logistic_counts_rows():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(50, 2)), (draw.random(50) < 0.4).astype(float)
    n = draw.integers(1, 4, 50).astype(float)
    repeated = np.repeat(np.arange(50), n.astype(int))
    assert np.allclose(T.logistic(x, y, n), T.logistic(x[repeated], y[repeated], np.ones(len(repeated))), atol=1e-6)


def test_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.col("doc_id").cast("string").alias("text"))
    assert 350 < T.labelled_sample(docs, labels, F.lit(True), 500).count() < 650


@pytest.mark.parametrize(
    "text, words",
    [
        ("s" + "t" * 90 + "inkard", {"stinkard"}),
        ("._-~._".join("wretchel"), {"wretchel"}),
        (".-_.-_.-".join("grumbol"), {"grumbol"}),
        ("a ggrumbol", {"grumbol"}),
        ("see s t i n k a r d g r u m b o l there", {"stinkard", "grumbol"}),
        ("see " + "s t i n k a r d " * 9 + "there", {"stinkard"}),
    ],
)
def test_disguises_of_any_length(decoder, text, words):
    assert words <= T.restored_words(decoder, text, {})


@pytest.mark.parametrize("shown, word", [("@$$", "ass"), ("455", "ass"), ("$@$", "sas")])
def test_signs_and_digits_only(shown, word):
    counts = {}
    for known in ["ass", "sas"] * 20:
        for i in range(len(known) + 1):
            counts[("^^" + known + "$")[i : i + 3]] = counts.get(("^^" + known + "$")[i : i + 3], 0) + 1
    assert word in T.restored_words(T.Decoder(counts), shown, {})


def test_long_tokens_take_linear_time(decoder):
    T.restored_words(decoder, "s1a0" * 5_000 + " " + "b i r d 1 " * 5_000, {})


def test_words_before_a_spaced_word():
    counts = {}
    for known in WORDS * 3 + BAD + ["a"] * 20:
        for i in range(len(known) + 1):
            counts[("^^" + known + "$")[i : i + 3]] = counts.get(("^^" + known + "$")[i : i + 3], 0) + 1
    assert "stinkard" in T.restored_words(T.Decoder(counts), "he is a s t i n k a r d", {})


def test_texts_that_cannot_speak_have_no_evidence(decoder):
    """The same evidence with and without the trie of weighed words, for every kind of disguise."""
    weights = {"grumbol": 3.0, "stin*": 2.0, "ass": 2.5, "455": 2.0, "$$$": 2.0, "wret*": 1.5}
    model = T.ToxicityModel(decoder, weights, np.zeros(4), np.ones(4), np.zeros(5))
    whole = T.ToxicityModel(decoder, weights, np.zeros(4), np.ones(4), np.zeros(5))
    whole.speaks = lambda words: True
    draw = random.Random(9)
    texts = ["", None, "455", "$$$", "a$$", "gr-u-m-b-o-l", "g r u m b o l", "s t 1 n k a r d", "1 0 " * 40, "gggrumbol", "(stinkard)", "wreeetchel", "....", "4 5 5"]
    for _ in range(400):
        words = draw.choices([*WORDS, *BAD], k=draw.randrange(1, 6))
        text = " ".join(disguised(w, draw) if draw.random() < 0.5 else w for w in words)
        if draw.random() < 0.3:
            text = draw.choice([" ", "-", "."]).join(text.replace(" ", ""))
        texts.append("".join(c * draw.choice([1, 1, 1, 2, 3]) for c in text))
        texts.append("".join(draw.choice("0123456789@$!|+(€x ") for _ in range(12)))
    spoke = 0
    for text in texts:
        expected = whole.evidence(text, {}, {})
        assert model.evidence(text, {}, {}) == expected, text
        spoke += expected[0] > 0
    assert 50 < spoke < len(texts) - 50


def test_a_column_named_like_the_score_stays(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, _toxicity int, __Toxicity string")
    kept = T.drop_toxic(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.collect() == docs.collect()


def test_a_small_share_is_not_none(spark):
    """The whole hash is compared, so shares below a millionth still choose rows."""
    ids = spark.range(4_000_000).select((F.xxhash64("id").cast("double") < (2e-6 - 0.5) * 2.0**64).alias("in"))
    assert 0 < ids.where("in").count() < 40


def test_all_labelled_documents_are_learned_from(spark):
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.col("doc_id").cast("string").alias("text"))
    assert T.labelled_sample(docs, labels, F.lit(True)).count() == 25_000


def test_sums_of_parts_give_the_same_coefficients():
    draw = np.random.default_rng(2)
    x, y, n = draw.normal(size=(60, 3)), (draw.random(60) < 0.3).astype(float), draw.integers(1, 5, 60).astype(float)

    def sums(beta):
        parts = [T.slope_and_curve(beta, x[i::4], y[i::4], n[i::4]) for i in range(4)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    assert np.allclose(T.newton(sums, 3), T.logistic(x, y, n), atol=1e-9)


def test_counts_do_not_depend_on_how_often_a_task_adds_them(spark, monkeypatch):
    docs, labels = corpus()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = T.fit(*frames)
    monkeypatch.setattr(T, "_CACHE", 40)
    monkeypatch.setattr(T, "_FOUND", 100)
    parts = T.fit(*frames)
    assert parts.decoder.trigrams == whole.decoder.trigrams and parts.weights == whole.weights and whole.weights
    assert np.allclose(parts.coefficients, whole.coefficients)


def test_known_words_are_asked_once():
    model = T.ToxicityModel(T.Decoder({}), {"grumbol": 3.0}, np.zeros(4), np.ones(4), np.zeros(5))
    asked = []
    reach = model._reach.word
    model._reach.word = lambda word: asked.append(word) or reach(word)
    assert not model.speaks(["the", "cat"]) and not model.speaks(["cat", "the", "the"])
    assert model.speaks(["gr\u0075mbol"]) and model.speaks(["the", "grumbol", "cat"])
    assert sorted(asked) == ["cat", "grumbol", "the"]


def test_rows_of_single_signs():
    rng = random.Random(4)
    for _ in range(300):
        words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 1, 2]))) for _ in range(rng.randrange(12))]
        runs, run = [], []
        for word in [*words, ""]:
            if len(word) == 1:
                run.append(word)
                continue
            runs, run = runs + [run] * (len(run) >= 3 and len(set(run)) > 1), []
        assert T.spaced_rows(words) == runs
