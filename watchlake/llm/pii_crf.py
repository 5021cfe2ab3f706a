"""Personal data in texts: fixed patterns, and a linear-chain CRF that adds what they miss.

The patterns (``base_spans``) find e-mail addresses, IP addresses, card and phone
numbers of strict forms. The CRF labels words by their shapes: it is trained from a
small labelled table (``LABELLED``, or a table of the caller's) and decoded by
Viterbi in numpy batches. Only words with a digit or an at sign can carry a label;
all others are certainly outside, so a text falls apart at them into short runs
that are decoded on their own, with the same result as the whole chain.
"""

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{part}-{kind}" for kind in KINDS for part in "BI"]
_LONGEST_WORD = 64

# ---- strict patterns -------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does; the look-behind says so, and
# keeps long runs from being tried again at every digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]+")
_GAP = re.compile(r"\s")
# Letters of scripts other than Latin, and their full-width signs, end a token anywhere.
_OTHER_SCRIPT = r"(?:(?![\u1e00-\u1eff\W\d_])[\u0250-\U0010ffff]|[\u3000-\u303f\uff00-\uff0f\uff1a-\uff20])"
_TOKEN = re.compile(rf"(?:(?!{_OTHER_SCRIPT})\S)+")
# In a long word signs that no added span holds inside end a token, too.
_TOKEN_IN_LONG = re.compile(r"(?:[A-Za-z0-9@.+()_\-]|(?![\W\d_])[\u00c0-\u024f\u1e00-\u1eff])+")


def passes_luhn(digits: str) -> bool:
    """Whether the last digit of a number checks the others."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str):
    """Each match lies around an at sign, from the run of name signs before it on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; ends are exclusive, in code points."""
    spans = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        # Zeros in front may be of any number; int() takes a bounded one.
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


# ---- the labelled table ----------------------------------------------------

# Text with its spans in brackets, kind first. Forms that the patterns know and
# forms that they miss, and numbers that are nobody's.
LABELLED = """
write to [email ann.lee@mail.example.org] today
from [email b.77@post3.example.net], about it
reach [email joe@localhost] or nobody
mail [email <kim_9@sub.example.com>] now
cc [email o'neil@example.ie]; thanks
user [email first.last+tag@example.co] wrote
host [ip 10.0.0.12] is down
from [ip 192.168.4.77]: refused
ping [ip 8.8.4.4] again
at [ip 172.16.254.1:8080] it runs
range [ip 10.20.30.0/24] closed
peer [ip 203.0.113.9], lost
card [card 4111111111111111] charged
paid by [card 5500 0055 5555 5559] once
number [card 4012-8888-8888-1881] on file
use [card 6011000990139424], please
amex [card 3782 822463 10005] works
amex [card 371449635398431] works
paid with [card 4539578763621487] yesterday
call [phone +1 (415) 555-2671] today
call [phone (415) 555-2671] today
call [phone 415-555-2671] today
tel [phone 415.555.0134] or write
fax [phone +44 20 7946 0958] only
ring [phone 020 7946 0018] soon
mobile [phone +4915123456789] works
number [phone (030) 901-8200] rings
dial [phone 1-800-555-0199] free
ask [phone (212) 555-0101], he knows
phone [phone +33 1 23 45 67 89] calls
it was 3.14 or so
version 4.0. is out
see version 2.0.1 and 10.4.2 here
in 2024 there were 12 of them
on 2024-01-05 at 12:30 it rained
between 10-12 and 5-7 pages
page 7, line 12. and 3.
about 1,234,567 people or 99.9% of them
cost 25.00 or 1000000 or 12500
key 9233A8ECF7C5B09FE5949719B6B82BC439E9329B here
token "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" there
id 8f14e45f-ceea-467f-a83b-0e8b4e1c2d3a made
the 1st and 2nd of 3 rooms
room 101 floor 3 desk 14
items 12 15 18 21 24 sold
handle @someone said so
rows 1) and 2) and (3) follow
chapter 5.1.2 section 12.4
score 21-19 and 3-0 again
order 100200300 shipped
isbn 978-3-16-148410-0 printed
build 20240105123059 passed
a1 b2 c3 x9 t1000
"""

_BRACKETED = re.compile(r"\[(email|ip|card|phone) ([^\]]+)\]")


def parse_labelled(table: str) -> list[tuple[list[str], list[int]]]:
    """Sentences as words and label numbers, from lines with bracketed spans."""
    out = []
    for line in filter(None, map(str.strip, table.splitlines())):
        words, labels, done = [], [], 0
        for m in [*_BRACKETED.finditer(line), None]:
            outside = line[done : m.start() if m else len(line)].split()
            # A sign that follows a bracket belongs to the word before it.
            if done and words and outside and line[done : done + 1].strip():
                words[-1] += outside.pop(0)
            words += outside
            labels += [0] * len(outside)
            if m:
                inside = m[2].split()
                words += inside
                first = 1 + 2 * KINDS.index(m[1])
                labels += [first] + [first + 1] * (len(inside) - 1)
                done = m.end()
        out.append((words, labels))
    return out


# ---- features --------------------------------------------------------------

_TRIMMED = ".,;:!?\"'<>[]{}*#$%&~_"


def shape_of(word: str) -> str:
    """Letters as a, digits as 9, runs collapsed, outer punctuation cut; signs stay."""
    core = word.strip(_TRIMMED)
    shape = []
    for c in core:
        kind = "a" if c.isalpha() else "9" if c.isdigit() else c
        if not shape or shape[-1] != kind:
            shape.append(kind)
    return "".join(shape)[:24]


def _digit_bucket(n: int) -> str:
    for bound in (0, 1, 2, 3, 4, 6, 8, 10, 12, 14, 15, 19):
        if n <= bound:
            return str(bound)
    return "more"


def word_features(word: str) -> list[str]:
    """What a word itself tells the chain."""
    shape, digits = shape_of(word), sum(c.isdigit() for c in word)
    features = [f"shape {shape}", f"digits {_digit_bucket(digits)}", f"mix {''.join(sorted(set(shape)))}"]
    if "@" in shape[1:]:
        features.append("name at")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}([:/][0-9]+)?", word.strip(_TRIMMED)):
        features.append("four numbers")
    if shape == "9":
        features.append(f"only digits {_digit_bucket(digits)}")
    # No labelled number is longer than a long word, and its groups would tell nothing.
    parts = len(word) <= _LONGEST_WORD and re.fullmatch(r"\(?([0-9]+)\)?[-.]?(?:([0-9]+)[-.]?)?(?:([0-9]+)[-.]?)?([0-9]*)", word.strip(_TRIMMED))
    if parts:
        features.append("groups " + " ".join(str(len(p)) for p in parts.groups() if p))
    return features


def context_class(word: str | None) -> str:
    """What a word tells its neighbours."""
    if word is None:
        return "none"
    shape, digits = shape_of(word), sum(c.isdigit() for c in word)
    if not digits:
        return "word"
    return f"{'number' if set(shape) <= set('9()+-.') else 'mixed'} {shape[:1]} {_digit_bucket(digits)}"


def _marked(word: str) -> bool:
    return bool(_MARKED.search(word))


def _runs(words: list[str], labels: list[int]):
    """Maximal runs of marked words with their labels."""
    run = [], []
    for word, label in zip([*words, ""], [*labels, 0]):
        if _marked(word):
            run[0].append(word)
            run[1].append(label)
        elif run[0]:
            yield run
            run = [], []


# ---- the chain -------------------------------------------------------------


@dataclass
class Crf:
    """Weights of features by label, and of label pairs; label 0 is outside."""

    features: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def scores(self, words: list[str], cache: dict) -> np.ndarray:
        """Label scores of each word of a run, from its own shape and its neighbours'."""
        out = np.zeros((len(words), len(LABELS)))
        for i, word in enumerate(words):
            before, after = (words[i - 1] if i else None), (words[i + 1] if i + 1 < len(words) else None)
            out[i] = self._own(word, cache) + self._near("before", before, cache) + self._near("after", after, cache)
        return out

    def _own(self, word, cache):
        value = cache.get(word)
        if value is None:
            if len(cache) > 200_000:
                cache.clear()
            value = self._sum(word_features(word))
            if len(word) <= _LONGEST_WORD:
                cache[word] = value
        return value

    def _near(self, side, word, cache):
        name = (side, context_class(word))
        value = cache.get(name)
        if value is None:
            value = cache[name] = self._sum([f"{side} {name[1]}"])
        return value

    def _sum(self, names):
        known = [self.features[n] for n in names if n in self.features]
        return self.emission[known].sum(axis=0) if known else np.zeros(len(LABELS))


def _features_in_run(words: list[str]) -> list[list[str]]:
    out = []
    for i, word in enumerate(words):
        before, after = (words[i - 1] if i else None), (words[i + 1] if i + 1 < len(words) else None)
        out.append(word_features(word) + [f"before {context_class(before)}", f"after {context_class(after)}"])
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(labelled: list[tuple[list[str], list[int]]], penalty: float = 0.05, rounds: int = 300) -> Crf:
    """A CRF by gradient ascent on the penalized log likelihood of the labelled runs."""
    runs = [r for words, labels in labelled for r in _runs(words, labels)]
    names: dict[str, int] = {}
    active = [[[names.setdefault(f, len(names)) for f in fs] for fs in _features_in_run(w)] for w, _ in runs]
    k, n, longest = len(LABELS), len(runs), max((len(w) for w, _ in runs), default=1)
    design = np.zeros((n, longest, len(names)))
    gold, there = np.zeros((n, longest, k)), np.zeros((n, longest), bool)
    for i, (fs, (_, labels)) in enumerate(zip(active, runs)):
        for t, own in enumerate(fs):
            design[i, t, own] = 1
            gold[i, t, labels[t]], there[i, t] = 1, True
    ends = there.sum(axis=1) - 1
    weights = {"e": np.zeros((len(names), k)), "t": np.zeros((k, k)), "a": np.zeros(k), "z": np.zeros(k)}
    moments = {name: [np.zeros_like(w), np.zeros_like(w)] for name, w in weights.items()}
    rows = np.arange(n)
    gold_pairs = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
    for step in range(1, rounds + 1):
        emit = design @ weights["e"]
        ahead = np.zeros((n, longest, k))
        ahead[:, 0] = weights["a"] + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = emit[:, t] + _logsumexp(ahead[:, t - 1, :, None] + weights["t"], 1)
        behind = np.zeros((n, longest, k))
        for t in range(longest - 1, -1, -1):
            if t + 1 < longest:
                behind[:, t] = _logsumexp(weights["t"] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[ends == t, t] = weights["z"]
        total = _logsumexp(ahead[rows, ends] + weights["z"], 1)
        own = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        pairs = np.exp(
            ahead[:, :-1, :, None] + weights["t"] + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        )
        pairs = (pairs * there[:, 1:, None, None]).sum(axis=(0, 1))
        slopes = {
            "e": np.einsum("ntf,ntk->fk", design, gold - own),
            "t": gold_pairs - pairs,
            "a": (gold - own)[:, 0].sum(axis=0),
            "z": (gold - own)[rows, ends].sum(axis=0),
        }
        for name, slope in slopes.items():
            slope = slope - penalty * weights[name]
            first, second = moments[name]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            weights[name] += rate * first / (np.sqrt(second) + 1e-8)
    return Crf(names, weights["e"], weights["t"], weights["a"], weights["z"])


def viterbi(crf: Crf, runs: list[np.ndarray]) -> list[np.ndarray]:
    """The best label path of each run of score rows; runs of a length go together."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
    lengths = np.array([len(r) for r in runs])
    for length in np.unique(lengths[lengths > 0]):
        which = np.flatnonzero(lengths == length)
        scores = np.stack([runs[i] for i in which])
        best, back = crf.first + scores[:, 0], np.zeros((len(which), length, len(LABELS)), np.int8)
        for t in range(1, length):
            through = best[:, :, None] + crf.transition
            back[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[:, t]
        path = np.zeros((len(which), length), int)
        path[:, -1] = (best + crf.last).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(len(which)), t, path[:, t]]
        for i, labels in zip(which, path):
            out[i] = labels
    return out


# ---- spans of texts --------------------------------------------------------


def marked_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an at sign, as (start, end) of each.

    A word is cut into tokens at letters of scripts without spaces, and one of over
    ``_LONGEST_WORD`` signs also where no span can go on; tokens that a sign parts are
    no neighbours.
    """
    runs: list[list[tuple[int, int]]] = []
    done = 0
    for m in _MARKED.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        gap = _GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        if end - start <= _LONGEST_WORD and text.isascii():
            tokens = [(start, end)]
        else:
            token = _TOKEN if end - start <= _LONGEST_WORD else _TOKEN_IN_LONG
            tokens = [t.span() for t in token.finditer(text, start, end) if _MARKED.search(t[0])]
        for own in tokens:
            before = runs[-1][-1][1] if runs else -1
            if before == done and own[0] == start and not text[done:start].strip():
                runs[-1].append(own)
            else:
                runs.append([own])
        done = end
    return runs


def _plausible(kind: str, piece: str) -> bool:
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        return "@" in piece[1:-1]
    if kind == "ip":
        return len(re.findall(r"[0-9]+", piece)) >= 4 and digits <= 20
    if kind == "card":
        # A number whose check digit is wrong is no card, whatever it looks like.
        return 13 <= digits <= 19 and passes_luhn("".join(c for c in piece if c in "0123456789"))
    return 7 <= digits <= 15


def added_spans(crf: Crf, texts: list[str], base: list[list[tuple[str, int, int]]], cache: dict):
    """For each text the spans that the chain adds; none overlaps a base span."""
    where, scores = [], []
    for i, text in enumerate(texts):
        for run in marked_runs(text):
            where.append((i, run))
            scores.append(crf.scores([text[s:e] for s, e in run], cache))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken = []
    for spans in base:
        ordered = sorted((s, e) for _, s, e in spans)
        taken.append(([s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))))
    for (i, run), labels in zip(where, viterbi(crf, scores)):
        spans: list[list] = []
        for (start, end), label in zip(run, labels):
            if label and label % 2 == 0 and spans and spans[-1][0] == KINDS[(label - 1) // 2] and spans[-1][3]:
                spans[-1][2] = end
            elif label:
                if spans:
                    spans[-1][3] = False
                spans.append([KINDS[(label - 1) // 2], start, end, True])
            elif spans:
                spans[-1][3] = False
        for kind, start, end, _ in spans:
            while end > start and texts[i][end - 1] in _TRIMMED:
                end -= 1
            while start < end and texts[i][start] in _TRIMMED:
                start += 1
            # The furthest end of the base spans that begin before this one ends.
            firsts, ends = taken[i]
            before = bisect_left(firsts, end)
            free = not before or ends[before - 1] <= start
            if start < end and free and _plausible(kind, texts[i][start:end]):
                out[i].append((kind, start, end))
    return out


def all_spans(crf: Crf, texts: list[str], cache: dict):
    """(base, all) spans of each text, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    more = added_spans(crf, texts, base, cache)
    key = lambda span: (KINDS.index(span[0]), span[1], span[2])
    return [(b, sorted(b + m, key=key)) for b, m in zip(base, more)]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(docs: DataFrame, labelled: str = LABELLED) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind),
    base_sha256, spans, n_added. Null text counts as empty; rows that repeat come out
    as often.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(parse_labelled(labelled)))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        cache: dict = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for base, spans in all_spans(held.value, texts, cache):
                counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(text: str, spans) -> str:
    """``text`` with each span replaced by its kind; of overlapping ones the first counts."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        else:
            end = max(end, done)
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_personal_data(docs: DataFrame, labelled: str = LABELLED) -> DataFrame:
    """``docs`` with personal data masked in ``text``; other columns and null texts stay."""
    held = docs.sparkSession.sparkContext.broadcast(train(parse_labelled(labelled)))
    place = docs.columns.index("text")
    schema = T.StructType(docs.schema.fields)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = all_spans(held.value, [t or "" for t in texts], cache)
            masked = [t if t is None else mask(t, spans) for t, (_, spans) in zip(texts, found)]
            columns = list(batch.columns)
            columns[place] = pa.array(masked, batch.schema.types[place])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
