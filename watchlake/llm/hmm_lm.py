"""Scoring texts with a hidden Markov language model over words.

Latent states emit words. The ``SYMBOLS`` most frequent words are symbols of their
own; all others belong to a few classes by length, and a class emits its words by
their counts, one added, alike in every state. So a text's likelihood is that of its
symbols times a factor for each rare word, and no word is left out of the model.

Baum-Welch: each task runs forward and backward over windows of its training texts
and returns expected counts; Spark adds them up over the partitions, and the driver
renormalizes a table of bounded size. All training text takes part in every round;
its words are looked up once, and the rounds read their symbols.
Scores are exact: one scaled forward recursion over each whole text, its end included.

Counts come from the whole corpus. Words among the ``HEAD`` most frequent are looked
up in the tasks; the others, each of which is at most one in ``HEAD`` of all words,
are summed up for each text and joined with the vocabulary.
"""

import hashlib
import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchlake.llm.common import fold_of, saved, words_of

STATES = 6
SYMBOLS = 4_096
HEAD = 150_000
HEAD_WORD_BYTES = 64
RARE_CLASSES = 8
ROUNDS = 3
WINDOW = 256
_TOKENS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rare_class(word: bytes) -> int:
    """The class of a word that is no symbol, by its length in bytes."""
    return min((len(word) - 1) // 2, RARE_CLASSES - 1)


def _rare_class_column(word: str) -> Column:
    return F.least(F.floor((F.octet_length(word) - 1) / 2), F.lit(RARE_CLASSES - 1)).cast("int")


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word binary, n, c) of a table (text, learn): counts in all texts and where ``learn`` holds."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    words = texts.select("learn", F.explode(F.split(lowered, "[\\x20\\x09-\\x0D]+")).alias("w")).where("w != ''")
    return words.groupBy(F.col("w").cast("binary").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("learn").cast("long")).alias("c")
    )


@dataclass
class Hmm:
    """Initial, transition and emission probabilities; the last symbol is the end of a text."""

    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @property
    def end(self) -> int:
        return self.emission.shape[1] - 1


def forward_log10(hmm: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole symbol sequence by the scaled forward recursion.

    Sequences advance together, one symbol a step; those that have ended drop out.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    total = np.zeros(len(sequences))
    if not len(order) or not lengths.max():
        return total
    sizes = lengths[order]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    line = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    emission = np.ascontiguousarray(hmm.emission.T)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    logs = np.zeros(len(order))
    state = None
    for step, n in enumerate(active.tolist()):
        emitted = emission[line[starts[:n] + step]]
        state = (hmm.initial if state is None else state[:n] @ hmm.transition) * emitted
        scale = state.sum(axis=1)
        state /= scale[:, None]
        logs[:n] += np.log10(scale)
    total[order] = logs
    return total


def expected_counts(hmm: Hmm, windows: np.ndarray, lengths: np.ndarray):
    """Baum-Welch expectations over padded windows (longest first): initial, transition, emission counts."""
    k = len(hmm.initial)
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right").tolist()
    emission = np.ascontiguousarray(hmm.emission.T)
    ahead, scales = np.zeros((longest, len(windows), k)), np.ones((longest, len(windows)))
    for t, n in enumerate(active):
        value = (hmm.initial if t == 0 else ahead[t - 1, :n] @ hmm.transition) * emission[windows[:n, t]]
        scales[t, :n] = value.sum(axis=1)
        ahead[t, :n] = value / scales[t, :n, None]
    gamma, moves = ahead, np.zeros((k, k))
    behind = np.ones((len(windows), k))
    for t in range(longest - 1, 0, -1):
        n = active[t]
        through = emission[windows[:n, t]] * behind[:n] / scales[t, :n, None]
        moves += ahead[t - 1, :n].T @ through
        before = through @ hmm.transition.T
        gamma[t, :n] *= behind[:n]
        behind[:n] = before
    gamma[0] *= behind
    moves *= hmm.transition
    emitted = np.zeros((k, hmm.emission.shape[1]))
    there = np.arange(longest)[:, None] < lengths[None, :]
    symbols = windows.T[there]
    weight = gamma[there]
    for s in range(k):
        emitted[s] = np.bincount(symbols, weights=weight[:, s], minlength=emitted.shape[1])
    return gamma[0].sum(axis=0), moves, emitted, float(np.log(scales[there]).sum())


@dataclass
class Head:
    """What tasks know about frequent words; sizes are bounded by ``HEAD`` and ``SYMBOLS``."""

    words: dict[bytes, int]  # word -> rank
    counts: np.ndarray  # training count by rank
    n_symbols: int
    rare_log10: np.ndarray  # log10 of each rare class's denominator
    tokens: int  # N
    distinct: int  # V
    end_count: int  # how often the end was seen

    @property
    def end(self) -> int:
        return self.n_symbols + RARE_CLASSES

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each word and the end, rank of each word or -1)."""
        find = self.words.get
        ranks = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
        symbols = np.append(ranks, self.end)
        rare = np.flatnonzero((ranks < 0) | (ranks >= self.n_symbols))
        if len(rare):
            lengths = np.fromiter(map(len, map(words.__getitem__, rare.tolist())), np.int64, len(rare))
            symbols[rare] = self.n_symbols + np.minimum((lengths - 1) // 2, RARE_CLASSES - 1)
        return symbols, ranks


def head_of(words: DataFrame, texts_learned: int, head: int = HEAD, symbols: int = SYMBOLS) -> Head:
    """The most frequent words of a vocabulary table, and totals over all of it."""
    short = words.where(F.octet_length("word") <= HEAD_WORD_BYTES)
    top = short.orderBy(F.desc("n"), "word").limit(head).select("word", "c").toArrow()
    names = top["word"].to_pylist()
    counts = np.array(top["c"].to_pylist(), np.int64)
    n_symbols = min(symbols, len(names))
    totals = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")
    ).first()
    rare = (
        words.groupBy(_rare_class_column("word").alias("k"))
        .agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"))
        .collect()
    )
    n, v = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    for row in rare:
        n[row.k], v[row.k] = row.n, row.v
    # Symbols do not count towards the classes of the others.
    for word, c in zip(names[:n_symbols], counts[:n_symbols].tolist()):
        n[rare_class(word)] -= c
        v[rare_class(word)] -= c > 0
    return Head(
        {w: i for i, w in enumerate(names)},
        counts,
        n_symbols,
        np.log10(n + v + 1),
        int(totals.n) + texts_learned,
        int(totals.v) + (texts_learned > 0),
        texts_learned,
    )


def first_guess(head: Head, rare_counts: np.ndarray, texts: int, states: int, seed: int = 11) -> Hmm:
    """Unigram emissions, shaken apart so that states can differ."""
    draw = np.random.default_rng(seed)
    base = np.concatenate([head.counts[: head.n_symbols], rare_counts, [texts]]) + 0.5
    emission = base * draw.uniform(0.5, 1.5, (states, len(base)))
    transition = draw.uniform(0.5, 1.5, (states, states)) + np.eye(states)
    return Hmm(
        np.full(states, 1 / states),
        transition / transition.sum(axis=1, keepdims=True),
        emission / emission.sum(axis=1, keepdims=True),
    )


def _windows(symbols: list[np.ndarray]):
    """Padded windows of up to ``WINDOW`` symbols, longest first, a bounded number at a time."""
    pieces = [s[i : i + WINDOW] for s in symbols for i in range(0, len(s), WINDOW)]
    pieces.sort(key=len, reverse=True)
    i = 0
    while i < len(pieces):
        rows = max(1, _TOKENS // len(pieces[i]))
        block = pieces[i : i + rows]
        lengths = np.array([len(p) for p in block], np.int64)
        padded = np.zeros((len(block), int(lengths[0])), np.int64)
        padded[np.arange(padded.shape[1])[None, :] < lengths[:, None]] = np.concatenate(block)
        yield padded, lengths
        i += rows


def _stored_type(end: int) -> np.dtype:
    """The narrowest integers that hold symbols up to ``end``."""
    return np.min_scalar_type(end).newbyteorder("<")


def encoded(texts: DataFrame, head: Head) -> DataFrame:
    """(symbols binary) of all texts of (text): each text's symbols, its end included."""
    held = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        kind = _stored_type(held.value.end)
        for batch in batches:
            # Texts are looked up and let go one by one.
            rows = (held.value.symbols(words_of(t.as_py()))[0].astype(kind).tobytes() for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["symbols"])

    return texts.select("text").mapInArrow(run, "symbols binary")


def baum_welch_round(texts: DataFrame, hmm: Hmm) -> tuple[Hmm, float]:
    """One round over all texts of (symbols): the next model, and the log likelihood of this one."""
    held = texts.sparkSession.sparkContext.broadcast(hmm)
    states = len(hmm.initial)
    names = [f"s{i}" for i in range(states)]

    def run(batches):
        model = held.value
        kind = _stored_type(model.end)
        initial, moves = np.zeros(states), np.zeros((states, states))
        emitted, log = np.zeros((states, model.end + 1)), 0.0
        for batch in batches:
            symbols = [np.frombuffer(t, kind) for t in batch.column(0).to_pylist()]
            for padded, lengths in _windows(symbols):
                a, b, c, d = expected_counts(model, padded, lengths)
                initial += a
                moves += b
                emitted += c
                log += d
        # Rows: the likelihood, initial, one a state moved from, one a symbol seen.
        table = np.vstack([np.full(states, log), initial, moves, emitted.T])
        keys = np.arange(len(table))
        seen = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[seen]), *[pa.array(table[seen, i]) for i in range(states)]], ["key", *names]
        )

    schema = "key long, " + ", ".join(f"{n} double" for n in names)
    sums = texts.mapInArrow(run, schema).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    table = np.zeros((2 + states + model_size(hmm), states))
    # Sums of doubles depend on the order of tasks in the last digits only.
    table[sums["key"].to_numpy()] = np.column_stack([sums[n].to_numpy() for n in names])
    log, initial, moves, emitted = table[0, 0], table[1], table[2 : 2 + states], table[2 + states :].T
    initial, moves, emitted = initial + 1e-3, moves + 1e-3, emitted + 1e-3
    return (
        Hmm(
            initial / initial.sum(),
            moves / moves.sum(axis=1, keepdims=True),
            emitted / emitted.sum(axis=1, keepdims=True),
        ),
        float(log),
    )


def model_size(hmm: Hmm) -> int:
    return hmm.emission.shape[1]


@dataclass
class LanguageModel:
    head: Head
    hmm: Hmm
    words: DataFrame
    likelihoods: list[float]


def fit(
    texts: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, symbols: int = SYMBOLS
) -> LanguageModel:
    """A model of (text, learn), learned from all rows where ``learn`` holds."""
    words = saved(vocabulary(texts), "hmm-words")
    learned = texts.where("learn").select("text")
    n_texts = learned.count()
    known = head_of(words, n_texts, head, symbols)
    rare = np.maximum(0, 10**known.rare_log10 - 1)
    hmm, likelihoods = first_guess(known, rare, n_texts, states), []
    symbols_of = saved(encoded(learned, known), "hmm-symbols") if n_texts and rounds else None
    for _ in range(rounds if n_texts else 0):
        hmm, log = baum_welch_round(symbols_of, hmm)
        likelihoods.append(log)
    return LanguageModel(known, hmm, words, likelihoods)


def _tail_sums(rows: DataFrame, words: DataFrame) -> DataFrame:
    """For each text with words beyond the head: (key, known, log): tokens with a count, and sum of log10(c + 1)."""
    # Copies of a text have equal tails; one of them is enough.
    tails = rows.where(F.size("tail") > 0).groupBy("key").agg(F.any_value("tail").alias("tail"))
    each = tails.select("key", F.explode("tail").alias("t")).select("key", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
    counted = each.join(words.where("c > 0").select("word", "c"), "word")
    return counted.groupBy("key").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_log")
    )


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text) rows."""
    held = docs.sparkSession.sparkContext.broadcast((model.head, model.hmm))
    schema = (
        "doc_id long, key binary, n_tokens long, n_known long, base double, hmm double, "
        "tail array<struct<word: binary, n: long>>"
    )
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        head, hmm = held.value
        log_count = np.log10(head.counts + 1.0)
        end_log = math.log10(head.end_count + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                sequences, rows = [], []
                for text in texts:
                    words = words_of(text)
                    symbols, ranks = head.symbols(words)
                    sequences.append(symbols)
                    inside = ranks[ranks >= 0]
                    tail: dict[bytes, int] = {}
                    if len(inside) < len(ranks):
                        for i in np.flatnonzero(ranks < 0).tolist():
                            tail[words[i]] = tail.get(words[i], 0) + 1
                    classes = symbols[:-1][symbols[:-1] >= head.n_symbols] - head.n_symbols
                    rare = inside[inside >= head.n_symbols]
                    emitted = log_count[rare].sum() - head.rare_log10[classes].sum()
                    known = int((head.counts[inside] > 0).sum()) + (head.end_count > 0)
                    base = log_count[inside].sum() + end_log
                    key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() if tail else b""
                    rows.append((key, len(words) + 1, known, base, emitted, [{"word": w, "n": n} for w, n in tail.items()]))
                logs = forward_log10(hmm, sequences)
                columns = list(zip(*rows))
                emitted = np.array(columns[4]) + logs
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(emitted),
                        pa.array(columns[5], tail_type),
                    ],
                    ["doc_id", "key", "n_tokens", "n_known", "base", "hmm", "tail"],
                )

    rows = saved(docs.select("doc_id", "text").mapInArrow(run, schema), "hmm-scored")
    sums = _tail_sums(rows, model.words)
    unit = math.log10(model.head.tokens + model.head.distinct + 1)
    added = F.coalesce("tail_log", F.lit(0.0))
    joined = rows.drop("tail").join(sums, "key", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.head.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + added - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("hmm") + added).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, **sizes) -> DataFrame:
    """All documents scored by a model of those that are not held out.

    Adds ``held_out``. Null text counts as empty and has one token, the end. A null
    doc_id is never held out; rows that repeat count and come out as often.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        (fold_of("doc_id", folds) != held).alias("learn"),
    )
    scored = score(texts, fit(texts.select("text", "learn"), **sizes))
    names = [c for c in scored.columns if c != "doc_id"]
    return scored.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), *names)
