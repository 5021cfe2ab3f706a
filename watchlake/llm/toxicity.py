"""Toxicity of documents, scored on text restored by a noisy-channel decoder.

Disguised words (digits or signs for letters, letters set apart, letters repeated)
are read as a lattice: each sign stands for itself, for letters it may replace, or
for nothing. A Viterbi search takes the path that a character language model and
the channel's costs like best. The restored words give evidence features, and a
logistic regression turns the evidence of a document into a score.

The language model, the features and the regression are learned from all labelled
documents, whose counts and sums tasks add up; scores cover every whole text.
"""

import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from watchlake.llm.common import fold_of, free_name, saved
from watchlake.operators.sizing import broadcast_if_small

TRIGRAMS = 20_000
FEATURES = 4_096
MIN_EVIDENCE = 20.0
THRESHOLD = 0.7
_CACHE = 400_000
# Features found that a task holds before it adds them to its counts.
_FOUND = 2_000_000
# Parts in which distinct evidence is kept for the regression.
_PARTS = 64
_PREFIXES = (4, 5, 6, 7, 8)
# Longer words are not kept in the cache, and teach no trigrams.
_LONGEST = 40
_BEAM = 24
_REPEATED = re.compile(r"(.)\1\1+", re.DOTALL)
_DOUBLED = re.compile(r"(.)\1", re.DOTALL)

# The letters a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y",
}
# Costs of the channel, as negative natural logs.
REPLACED, DROPPED, DROPPED_INSIDE, REPEATED, KEPT_REPEAT, SPACED_BONUS = 1.5, 0.5, 12.0, 0.3, 2.0, 3.0
# Trigrams alone cannot tell where spaced words meet; each of these makes borders cheaper and is read.
BORDER_BONUSES = (0.0, 3.0, 6.0)


@dataclass
class Decoder:
    """Restores disguised words under an interpolated character trigram model."""

    trigrams: dict[str, int]
    _cost: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self._pairs, self._singles, self._histories, self._total = {}, {}, {}, 0
        for (a, b, c), n in self.trigrams.items():
            self._histories[a + b] = self._histories.get(a + b, 0) + n
            self._pairs[b + c] = self._pairs.get(b + c, 0) + n
            self._singles[c] = self._singles.get(c, 0) + n
            self._total += n
        self._before = {}
        for pair, n in self._pairs.items():
            self._before[pair[0]] = self._before.get(pair[0], 0) + n

    def cost(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        found = self._cost.get(key)
        if found is None:
            single = (self._singles.get(c, 0) + 1) / (self._total + 64)
            pair = (self._pairs.get(b + c, 0) + 5 * single) / (self._before.get(b, 0) + 5)
            triple = (self.trigrams.get(key, 0) + 5 * pair) / (self._histories.get(a + b, 0) + 5)
            found = self._cost[key] = -math.log(triple)
        return found

    def restore(self, token: str, signs_speak: bool = False) -> str:
        """The likeliest plain word behind a lower-case token of no white space.

        With ``signs_speak`` a sign that may stand for a letter does so at the ends, too.
        """
        inner_from = next((i for i, c in enumerate(token) if c.isalnum()), len(token))
        inner_to = next((i for i in range(len(token), 0, -1) if token[i - 1].isalnum()), 0)
        paths, settled = {("^", "^"): (0.0, "")}, []
        known = self._cost
        for i, sign in enumerate(token):
            inside = signs_speak or inner_from <= i < inner_to
            options = []
            if sign.isalpha():
                options.append((sign, KEPT_REPEAT if token[i - 2 : i] == sign * 2 else 0.0))
                if i and token[i - 1] == sign:
                    options.append(("", REPEATED))
            else:
                options += [(letter, REPLACED) for letter in LEET.get(sign, "")]
                options.append(("", DROPPED_INSIDE if sign in LEET and inside else DROPPED))
            ahead = {}
            for (a, b), (total, text) in paths.items():
                for letter, extra in options:
                    value = total + extra
                    if letter:
                        place = (b, letter)
                        cost = known.get(a + b + letter)
                        value += self.cost(a, b, letter) if cost is None else cost
                    else:
                        place = (a, b)
                    best = ahead.get(place)
                    if best is None or value < best[0]:
                        ahead[place] = (value, text + letter)
            paths = ahead if len(ahead) == 1 else dict(sorted(ahead.items(), key=lambda p: (p[1], p[0]))[:_BEAM])
            if i % 32 == 31:
                # What all paths have in common is settled; long tokens take linear time.
                common = os.path.commonprefix([text for _, text in paths.values()])
                settled.append(common)
                paths = {place: (total, text[len(common) :]) for place, (total, text) in paths.items()}
        return "".join(settled) + min((total + self.cost(a, b, "$"), text) for (a, b), (total, text) in paths.items())[1]

    def spelled(self, letters: list[str], border_bonus: float = 0.0) -> list[str]:
        """The words that single letters in a row spell, where the model takes them for words.

        A Viterbi search chooses the borders: each sign stands alone or is part of a
        word of three letters or more; ``border_bonus`` speaks for each border.
        """
        # (last two letters, letters so far up to 3): (cost, word so far, words before as a linked list)
        alone: tuple[float, tuple | None] = (0.0, None)
        inside: dict[tuple[str, str, int], tuple[float, str, tuple | None]] = {}
        for i, sign in enumerate(letters):
            if sign.isalpha():
                options = [(sign, 0.0)]
                if i and letters[i - 1] == sign:
                    options.append(("", REPEATED))
            else:
                options = [(letter, REPLACED) for letter in LEET.get(sign, "")]
                options.append(("", DROPPED_INSIDE if sign in LEET else DROPPED))
            ahead: dict[tuple[str, str, int], tuple[float, str, tuple | None]] = {}
            begun = {**inside, ("^", "^", 0): (alone[0], "", alone[1])}
            for (a, b, n), (total, text, before) in begun.items():
                for letter, extra in options:
                    if not letter and not n:
                        continue
                    place = (b, letter, min(n + 1, 3)) if letter else (a, b, n)
                    value = total + extra + (self.cost(a, b, letter) if letter else 0.0)
                    if place not in ahead or (value, text + letter) < ahead[place][:2]:
                        ahead[place] = (value, text + letter, before)
            # Plain text seldom sets single letters in a row; each one more speaks for a word.
            alone = (alone[0] + self._word_cost(sign) + SPACED_BONUS - border_bonus, alone[1])
            for (a, b, n), (total, text, before) in ahead.items():
                ended = total + self.cost(a, b, "$") - border_bonus
                if n == 3 and ended < alone[0]:
                    alone = (ended, (before, text))
            inside = dict(sorted(ahead.items(), key=lambda p: (p[1][:2], p[0]))[: 3 * _BEAM])
        words, rest = [], alone[1]
        while rest:
            rest, word = rest
            words.append(word)
        return words[::-1]

    def _word_cost(self, word: str) -> float:
        signs = "^^" + word + "$"
        return sum(self.cost(*signs[i : i + 3]) for i in range(len(word) + 1))


def is_plain(word: str) -> bool:
    """Whether a word is letters only, without a letter three times in a row."""
    return word.isalpha() and not _REPEATED.search(word)


def _core(word: str) -> str:
    return word.strip(".,;:?\"'*#-_()[]{}<>%&~")


def restored_word(decoder: Decoder, word: str) -> str:
    core = _core(word)
    # One sign alone, however often, disguises nothing.
    if not core or is_plain(core) or core.isdigit() or len(set(core)) == 1:
        return core
    # Runs have no bound; two of a sign say as much.
    core = _REPEATED.sub(r"\1\1", core)
    return decoder.restore(core, signs_speak=not any(c.isalnum() for c in core))


def readings(decoder: Decoder, word: str) -> tuple[str, ...]:
    """A word restored, and what it may disguise where it is plain: doubled letters, digits alone."""
    plain = restored_word(decoder, word)
    if len(set(plain)) > 1 and (plain.isdigit() or is_plain(plain) and _DOUBLED.search(plain)):
        other = decoder.restore(_REPEATED.sub(r"\1\1", plain))
        return (plain, other) if other != plain else (plain,)
    return (plain,)


def restored_words(decoder: Decoder, text: str | None, cache: dict) -> set[str]:
    """The distinct restored words of a whole text, white space and case aside."""
    words = (text or "").lower().split()
    out = set()
    for word in set(words):
        out.update(known_readings(decoder, word, cache))
    out.update(spelled_words(decoder, words))
    out.discard("")
    return out


def known_readings(decoder: Decoder, word: str, cache: dict) -> tuple[str, ...]:
    """The ``readings`` of a word, from ``cache`` where it has them."""
    read = cache.get(word)
    if read is None:
        read = readings(decoder, word)
        if len(cache) >= _CACHE:
            cache.clear()
        if len(word) <= _LONGEST:
            cache[word] = read
    return read


def spelled_words(decoder: Decoder, words: list[str]) -> set[str]:
    """The words that rows of single signs spell."""
    return {word for row in spaced_rows(words) for bonus in BORDER_BONUSES for word in decoder.spelled(row, bonus)}


def _places_of_one_sign(words: list[str]) -> Iterator[int]:
    lengths, place = list(map(len, words)), -1
    for _ in range(lengths.count(1)):
        place = lengths.index(1, place + 1)
        yield place


def spaced_rows(words: list[str]) -> list[list[str]]:
    """Three or more words of one sign in a row, unless all alike."""
    rows, last = [], -2
    for place in _places_of_one_sign(words):
        if place == last + 1:
            rows[-1].append(words[place])
        else:
            rows.append([words[place]])
        last = place
    return [row for row in rows if len(row) >= 3 and len(set(row)) > 1]


def features_of(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in _PREFIXES if len(word) >= n]


class Reach:
    """Whether anything that the lattice of a word may be read as has a weight.

    Follows all readings at once through a trie of the weighed words and beginnings, which
    costs little: most words leave the trie at their first letters. It may hold for
    words that the decoder then reads otherwise, but never fails for one that it reads with a weight.
    """

    def __init__(self, features):
        self.features = frozenset(features)
        self.next: list[dict[str, int]] = [{}]
        self.words, self.beginnings = set(), set()
        for feature in self.features:
            node = 0
            for sign in feature.removesuffix("*"):
                if sign not in self.next[node]:
                    self.next[node][sign] = len(self.next)
                    self.next.append({})
                node = self.next[node][sign]
            (self.beginnings if feature.endswith("*") and len(feature) > 1 else self.words).add(node)

    def _step(self, states: set[int], sign: str, before: str) -> set[int]:
        letters, stays = (sign, sign == before) if sign.isalpha() else (LEET.get(sign, ""), True)
        ahead = {self.next[s][letter] for s in states for letter in letters if letter in self.next[s]}
        return ahead | states if stays else ahead

    def word(self, word: str) -> bool:
        states, before = {0}, ""
        for sign in word:
            states = self._step(states, sign, before)
            if not states.isdisjoint(self.beginnings):
                return True
            if not states:
                break
            before = sign
        # What is not decoded counts as it stands.
        return not states.isdisjoint(self.words) or not self.features.isdisjoint(features_of(_core(word)))

    def spelled(self, signs: list[str]) -> bool:
        """The same for the words that single signs in a row may spell, wherever they begin."""
        states, before = set(), ""
        for sign in signs:
            states = self._step(states | {0}, sign, before) - {0}
            if not states.isdisjoint(self.beginnings) or not states.isdisjoint(self.words):
                return True
            before = sign
        return False


@dataclass
class ToxicityModel:
    decoder: Decoder
    weights: dict[str, float]
    center: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray

    def __post_init__(self):
        self._reach, self._silent, self._loud = Reach(self.weights), set(), set()

    def speaks(self, words: list[str]) -> bool:
        """Whether any word, or row of single signs, may be read as one with a weight."""
        if len(self._silent) + len(self._loud) >= _CACHE:
            self._silent.clear()
            self._loud.clear()
        # Most words are known to be silent: sets take them out at once.
        fresh = set(words) - self._silent
        if not fresh.isdisjoint(self._loud):
            return True
        for word in fresh:
            may = self._reach.word(word)
            if len(word) <= _LONGEST:
                (self._loud if may else self._silent).add(word)
            if may:
                return True
        return any(map(self._reach.spelled, spaced_rows(words)))

    def evidence(self, text: str | None, restored: dict, weighed: dict) -> list[float]:
        """What the restored words say together: count, sum, largest, and density.

        A text of which no reading has a weight has no evidence, and is not decoded to find so.
        """
        if not self.speaks((text or "").lower().split()):
            return [0.0, 0.0, 0.0, 0.0]
        words = restored_words(self.decoder, text, restored)
        found = []
        for word in words:
            value = weighed.get(word)
            if value is None:
                value = max((self.weights.get(f, 0.0) for f in features_of(word)), default=0.0)
                if len(weighed) >= _CACHE:
                    weighed.clear()
                weighed[word] = value
            if value:
                found.append(value)
        found.sort(reverse=True)
        n = len(found)
        return [math.log1p(n), math.log1p(sum(found)), sum(found[:3]), math.log1p(1000.0 * n / (len(words) + 20))]

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        x = (evidence - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients of a penalized logistic regression by Newton steps, intercept first; row i counts n[i] times."""
    return newton(lambda beta: slope_and_curve(beta, x, y, n), x.shape[1], penalty, steps)


def slope_and_curve(beta: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows add to the first and, negated, the second derivative of the log likelihood."""
    design = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
    return design.T @ (n * (y - p)), (design * (n * p * (1 - p))[:, None]).T @ design


def newton(
    sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, penalty: float = 1.0, steps: int = 50
) -> np.ndarray:
    """The coefficients by Newton steps over the ``sums`` of ``slope_and_curve`` of all rows, wherever those are."""
    ridge = np.diag([1e-3] + [penalty] * width)
    beta = np.zeros(width + 1)
    for _ in range(steps):
        slope, curve = sums(beta)
        slope, curve = slope - ridge @ beta, curve + ridge
        step = np.linalg.solve(curve, slope)
        beta += step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int | None = None) -> DataFrame:
    """(text, toxic) of all labelled documents; of about ``rows`` at most, chosen by a hash of the id, if that is given.

    A document labelled more than once is toxic if one label says so. Texts that
    repeat count once, so copies do not outvote other documents.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    if rows is not None:
        share = min(1.0, rows / max(1, known.count()))
        # The whole hash is compared: a share may be as small as it likes.
        known = known.where(F.lit(share == 1.0) | (F.xxhash64("doc_id").cast("double") < (share - 0.5) * 2.0**64))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        text.join(broadcast_if_small(known), "doc_id")
        .groupBy(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> ToxicityModel:
    """A model learned from labelled documents for which ``learn`` (over doc_id) holds.

    With no usable labels, or one class only, every score is the share of toxic ones.
    """
    known = saved(labelled_sample(docs, labels, F.lit(True) if learn is None else learn), "toxicity-labelled")

    def trigrams(batches):
        texts_with: Counter[str] = Counter()

        def counted():
            counts: dict[str, int] = {}
            for word, n in texts_with.items():
                word = word.strip(".,;:?!\"'()")
                if len(word) <= _LONGEST and is_plain(word):
                    signs = "^^" + word + "$"
                    for i in range(len(word) + 1):
                        counts[signs[i : i + 3]] = counts.get(signs[i : i + 3], 0) + n
            texts_with.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["k", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                texts_with.update(set(text.lower().split()))
                if len(texts_with) >= _CACHE:
                    yield counted()
        yield counted()

    totals = known.select("text").mapInArrow(trigrams, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    common = totals.orderBy(F.desc("n"), "k").limit(TRIGRAMS).collect()
    decoder = Decoder({r.k: r.n for r in common})

    def features(batches):
        cache: dict[str, tuple[str, ...]] = {}
        # Features by number, those of a word, and how many clean and toxic texts have each.
        numbers: dict[str, int] = {}
        of_word: dict[str, tuple[int, ...]] = {}
        counts, found = np.zeros((2, 0), np.int64), ([], [])

        def numbered(words) -> tuple[int, ...]:
            return tuple(numbers.setdefault(f, len(numbers)) for word in words if word for f in features_of(word))

        def add():
            nonlocal counts
            counts = np.pad(counts, ((0, 0), (0, len(numbers) - counts.shape[1])))
            for of_class, own in zip(counts, found):
                of_class += np.bincount(np.array(own, np.int64), minlength=len(numbers))
                own.clear()

        def counted():
            nonlocal counts
            add()
            out = [pa.array(numbers.keys(), pa.string()), pa.array(counts[0]), pa.array(counts[1])]
            numbers.clear()
            of_word.clear()
            counts = np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays(out, ["f", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of_text: set[int] = set()
                words = text.lower().split()
                for word in set(words):
                    own = of_word.get(word)
                    if own is None:
                        own = numbered(known_readings(decoder, word, cache))
                        if len(of_word) >= _CACHE:
                            of_word.clear()
                        if len(word) <= _LONGEST:
                            of_word[word] = own
                    of_text.update(own)
                of_text.update(numbered(spelled_words(decoder, words)))
                found[toxic].extend(of_text)
                if len(numbers) >= _CACHE:
                    yield counted()
                elif len(found[0]) + len(found[1]) >= _FOUND:
                    add()
        yield counted()

    classes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_clean, n_toxic = classes.get(0, 0), classes.get(1, 0)
    prior = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
    flat = ToxicityModel(decoder, {}, np.zeros(4), np.ones(4), np.array([math.log(prior / (1 - prior)), 0, 0, 0, 0]))
    if not n_clean or not n_toxic:
        return flat
    seen = (
        known.mapInArrow(features, "f string, clean long, toxic long")
        .groupBy("f")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= 3)
    )
    both = F.col("clean") + F.col("toxic")
    due_toxic, due_clean = both * n_toxic / (n_clean + n_toxic), both * n_clean / (n_clean + n_toxic)
    gain = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / due_toxic)
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / due_clean)).otherwise(0.0)
    )
    odds = F.log(((F.col("toxic") + 0.1) / (n_toxic + 0.2)) / ((F.col("clean") + 0.1) / (n_clean + 0.2)))
    best = (
        seen.select("f", gain.alias("g"), odds.alias("w"))
        .where((F.col("g") >= MIN_EVIDENCE) & (F.col("w") >= math.log(4)))
        .orderBy(F.desc("g"), "f")
        .limit(FEATURES)
        .collect()
    )
    model = ToxicityModel(decoder, {r.f: r.w for r in best}, flat.center, flat.scale, flat.coefficients)

    def gathered(batches):
        restored, weighed = {}, {}
        for batch in batches:
            x = np.array([model.evidence(t, restored, weighed) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            columns = [pa.array(x[:, i].copy()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["a", "b", "c", "d", "y"])

    # Most documents have no evidence; equal rows are counted once. What has any stays in the tasks.
    columns = ["a", "b", "c", "d", "y"]
    alike = known.mapInArrow(gathered, "a double, b double, c double, d double, y int").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    evidence = saved(alike.repartition(_PARTS, *columns).sortWithinPartitions(*columns), "toxicity-evidence")

    def summed(terms: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
        """Sums over all rows of what ``terms`` gives for some; equal in whatever order the batches come."""

        def run(batches):
            for batch in batches:
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                parts = np.concatenate([np.ravel(t) for t in terms(values[:, :4], values[:, 4], values[:, 5])])
                yield pa.RecordBatch.from_arrays([pa.array([parts.tolist()], pa.list_(pa.float64()))], ["v"])

        return np.array([math.fsum(column) for column in zip(*(r.v for r in evidence.mapInArrow(run, "v array<double>").collect()))])

    sums = summed(lambda x, y, n: [n.sum(), n @ x])
    model.center = center = sums[1:] / sums[0]
    model.scale = scale = np.sqrt(summed(lambda x, y, n: [n @ (x - center) ** 2]) / sums[0]) + 1e-9

    def slope_and_curve_of_all(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = summed(lambda x, y, n: [*slope_and_curve(beta, (x - center) / scale, y, n)])
        return both[:5], both[5:].reshape(5, 5)

    model.coefficients = newton(slope_and_curve_of_all, 4)
    return model


def with_scores(docs: DataFrame, model: ToxicityModel, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with ``score``: how likely label 1 is, from 0 to 1.

    Null text counts as empty; an empty text has no evidence and gets the score of
    that. A column of the name ``score_column`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(score_column)
    schema = T.StructType([*plain.schema.fields, T.StructField(score_column, T.DoubleType())])
    place = plain.columns.index(text_column)

    def run(batches):
        restored, weighed = {}, {}
        for batch in batches:
            x = np.array([held.value.evidence(t, restored, weighed) for t in batch.column(place).to_pylist()])
            score = held.value.scores(x.reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, score_column])

    return plain.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from the folds that are not held out.

    Rows that repeat come out as often. A null doc_id is never held out.
    """
    model = fit(docs, labels, fold_of("doc_id", folds) != held)
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        (fold_of("doc_id", folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; all columns kept."""
    name = free_name("_toxicity", docs.columns)
    scored = with_scores(docs, fit(docs, labels), score_column=name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)
