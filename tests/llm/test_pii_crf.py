"""Personal data: strict patterns against plain regular expressions, the chain against all label paths."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from watchlake.llm import pii_crf as P


def plain_base(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and P.passes_luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


TEXTS = [
    "", "a@b", "x a@b.c.d, e@f.g@h.i", "a@b.c@d.e", "@@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.2.3.4", "4111 1111-1111 1111",
    "+1 (415) 555-2671 and +49 1", "++12345678", "+1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "é 4111111111111111é@x.y", "9" * 300, "1." * 300,
    "a." * 300 + "@x.y", "+1((((((((((", "12 3", "1 - 2 3-4",
]


def test_strict_patterns():
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choice("0123.+-@ a()") for _ in range(80)) for _ in range(2000)]
    for text in texts:
        assert P.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "a@" * 300_000, "+1" * 300_000):
        P.base_spans(text)
        P.marked_runs(text)


@pytest.fixture(scope="module")
def crf():
    return P.train(P.parse_labelled(P.LABELLED))


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(2)
    k = len(P.LABELS)
    crf = P.Crf({}, np.zeros((0, k)), draw.normal(size=(k, k)), draw.normal(size=k), draw.normal(size=k))
    runs = [draw.normal(size=(n, k)) for n in (1, 3, 2, 3, 0)]
    for scores, got in zip(runs, P.viterbi(crf, runs)):
        if len(scores):
            value = lambda p: crf.first[p[0]] + crf.last[p[-1]] + sum(scores[t, s] for t, s in enumerate(p)) + sum(crf.transition[a, b] for a, b in zip(p, p[1:]))
            assert value(got.tolist()) == pytest.approx(max(map(value, itertools.product(range(k), repeat=len(scores)))))


def test_runs_are_the_whole_chain(crf):
    """Words without digits are certainly outside, so a text decodes run by run."""
    text = "so call (415) 555-2671 or 10.0.0.1 and 12 of them"
    runs = [[text[s:e] for s, e in run] for run in P.marked_runs(text)]
    assert runs == [["(415)", "555-2671"], ["10.0.0.1"], ["12"]]


def test_labelled_table_is_learned(crf):
    for words, labels in P.parse_labelled(P.LABELLED):
        for run, expected in P._runs(words, labels):
            assert P.viterbi(crf, [crf.scores(run, {})])[0].tolist() == expected


@pytest.mark.parametrize(
    "text, piece, kind",
    [
        ("please ring (617) 555-0182 soon", "(617) 555-0182", "phone"),
        ("please ring 617-555-0182, soon", "617-555-0182", "phone"),
        ("amex 378282246310005 here", "378282246310005", "card"),
        ("write sam@intranet please", "sam@intranet", "email"),
    ],
)
def test_forms_that_patterns_miss(crf, text, piece, kind):
    (base, spans), = P.all_spans(crf, [text], {})
    assert base == [] and [(k, text[s:e]) for k, s, e in spans] == [(kind, piece)]


@pytest.mark.parametrize("text", ["in 2023 and 2024", "see 3.1 and 4.0.", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "1234567812345678", "a 12 b 13 c 14-15"])
def test_nobodys_numbers(crf, text):
    assert P.all_spans(crf, [text], {}) == [([], [])]


def test_result_table(spark):
    rows = [(1, "mail a@b.com or (617) 555-0182"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "mail a@b.com or (617) 555-0182"), (4, "x " * 50_000 + "+1 (415) 555-2671")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string").repartition(2)
    got = sorted((tuple(r) for r in P.find_personal_data(docs).collect()), key=repr)
    expected = []
    for doc_id, text in rows:
        base = plain_base(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        more = ["phone:16:30"] if doc_id == 1 else []
        spans = ",".join(filter(None, [joined, *more]))
        counts = [sum(k == kind for k, *_ in base) for kind in P.KINDS]
        expected.append((doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), spans, len(more)))
    assert got == sorted(expected, key=repr)


def test_masking(spark):
    docs = spark.createDataFrame([(1, "to a@b.com, é 10.0.0.1!", "x"), (2, None, "y")], "doc_id long, text string, kind string")
    masked = P.mask_personal_data(docs)
    assert masked.columns == docs.columns
    assert [r.text for r in masked.orderBy("doc_id").collect()] == ["to <EMAIL>, é <IP>!", None]
    assert P.mask("0123456789", [("card", 2, 6), ("ip", 4, 8)]) == "01<CARD>89"
    assert P.mask_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before, piece, after, kind",
    [
        ('{"rows":[{"name":"somebody","tel":"', "617-555-0182", '","note":"nothing"},{"name":"nobody"' + ',"k":"v"' * 20 + "}]}", "phone"),
        ("这是一段没有空格的文字" * 10 + "请打", "617-555-0182", "联系我们" * 20, "phone"),
        ("请打电话", "617-555-0182", "联系我们", "phone"),
        ("a,b,c,d;" * 20, "378282246310005", ",x,y" * 20, "card"),
        ("<p><b>word</b>" * 10 + "<i>", "sam@intranet", "</i></p>" * 10, "email"),
    ],
)
def test_unspaced_texts(crf, before, piece, after, kind):
    (base, spans), = P.all_spans(crf, [before + piece + after], {})
    assert base == [] and spans == [(kind, len(before), len(before) + len(piece))]


def test_long_words_take_linear_time(crf):
    for text in ("1" * 300_000, "a1" * 150_000, "1-" * 150_000, "1," * 50_000, "a@" * 50_000):
        P.all_spans(crf, [text], {})


def test_octets_of_any_length(spark):
    for text, n in (("0" * 5000 + ".1.1.1", 1), ("1" * 10_000 + ".1.1.1", 0), ("0" * 9000 + "255." + "0" * 9000 + ".0.1", 1), ("0" * 9000 + "256.0.0.1", 0)):
        assert sum(kind == "ip" for kind, *_ in P.base_spans(text)) == n
    rows = spark.createDataFrame([(1, "0" * 5000 + ".1.1.1")], "doc_id long, text string")
    assert P.find_personal_data(rows).first().n_ip == 1
