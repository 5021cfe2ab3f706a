"""Language identification by a convolutional network over bytes.

A text's bytes, in 64 classes, are cut into windows of ``WINDOW`` bytes. Filters of
several widths slide over each window; the largest response of each filter goes into
a softmax over the languages, and a text's answer is the mean over all its windows,
weighted by the letters in them. Training is plain numpy on windows of a bounded
sample of labelled texts (``SAMPLE_PER_LANGUAGE``); prediction covers whole texts.

Responses are looked up: a filter over two neighbouring classes is a table of 64 x 64
rows, and wider filters are sums of such tables.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchlake.llm.common import fold_of, saved
from watchlake.operators.sizing import broadcast_if_small

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 64
SAMPLE_PER_LANGUAGE = 600
WINDOWS_PER_TEXT = 4
LEAST_LETTERS = 8
EPOCHS = 4
BATCH = 64
UNKNOWN = "und"
_BLOCK = 64
_LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    """0 for padding, then letters, white space, digits, signs, and UTF-8 bytes by value."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b).lower()
        if b < 128:
            out[b] = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isspace() else 28 if c.isdigit() else 29 if b > 32 else 30
        else:
            out[b] = 34 + (b & 63) * 30 // 64 if b < 192 else {0xC2: 31, 0xC3: 32}.get(b, 33)
    return out


_CLASS_OF = _byte_classes()


def windows_of(text: bytes) -> np.ndarray:
    """Byte classes of all windows of a text, the last one padded."""
    line = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(line) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(line)] = _CLASS_OF[line]
    return out.reshape(n, WINDOW)


def letters_in(windows: np.ndarray) -> np.ndarray:
    """How many bytes of each window belong to letters, or to UTF-8 signs of more than a byte."""
    return ((windows >= 1) & (windows <= 26) | (windows >= 31)).sum(axis=1)


def teaching_windows(text: str) -> np.ndarray:
    """Up to ``WINDOWS_PER_TEXT`` windows spread over a text, those with few letters left out.

    A text with a letter keeps one window at least, the one with the most; one without
    has none.
    """
    windows = windows_of(text.encode("utf-8", "surrogatepass"))
    if not _LETTER.search(text):
        return windows[:0]
    spread = windows[np.unique(np.linspace(0, len(windows) - 1, WINDOWS_PER_TEXT).astype(int))]
    kept = spread[letters_in(spread) >= LEAST_LETTERS]
    return kept if len(kept) else windows[letters_in(windows).argmax()][None]


@dataclass
class ByteCnn:
    """``filters[w]`` has a response for each place in a filter of width w, class and filter."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window, at least 0."""
        tables = getattr(self, "_tables", None) or self._paired()
        # What is beyond the window is padding, so each width has a response everywhere.
        n = len(windows)
        line = np.zeros((n, WINDOW + max(WIDTHS)), np.int64)
        line[:, :WINDOW] = windows
        pairs = line[:, :-1] * CLASSES + line[:, 1:]
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, width in enumerate(WIDTHS):
            total = None
            for place, table in tables[width]:
                source = pairs if len(table) > CLASSES else line
                part = table[source[:, place : place + WINDOW]]
                total = part if total is None else np.add(total, part, out=total)
            out[:, i * FILTERS : (i + 1) * FILTERS] = total.max(axis=1)
        return np.maximum(out + self.bias, 0)

    def _paired(self):
        """Tables over pairs of classes, and over single ones where a width is odd."""
        self._tables = {}
        for width, f in self.filters.items():
            parts = []
            for place in range(0, width - 1, 2):
                both = f[place][:, None, :] + f[place + 1][None, :, :]
                parts.append((place, np.ascontiguousarray(both.reshape(-1, FILTERS), np.float32)))
            if width % 2:
                parts.append((width - 1, np.ascontiguousarray(f[width - 1], np.float32)))
            self._tables[width] = parts
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        for at in range(0, len(windows), _BLOCK):
            scores = self.responses(windows[at : at + _BLOCK]) @ self.weights[:-1] + self.weights[-1]
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            out[at : at + _BLOCK] = scores / scores.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability of each whole text; unknown (0) without a letter."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        group: list[int] = []
        parts: list[np.ndarray] = []
        for i in [*known, None]:
            if i is None or sum(map(len, parts)) > 2048:
                if group:
                    self._predict_group(group, parts, names, scores)
                group, parts = [], []
            if i is not None:
                group.append(i)
                parts.append(windows_of(texts[i].encode("utf-8", "surrogatepass")))
        return names, scores

    def _predict_group(self, group, parts, names, scores):
        windows = np.concatenate(parts)
        letters = letters_in(windows) + 1e-6
        weighted = self.probabilities(windows) * letters[:, None]
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        means = np.add.reduceat(weighted, starts, axis=0) / np.add.reduceat(letters, starts)[:, None]
        for i, mean in zip(group, means):
            best = int(mean.argmax())
            names[i], scores[i] = self.languages[best], min(1.0, float(mean[best]))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> ByteCnn:
    """A network fitted by Adam on windows (byte classes) with label numbers."""
    draw = np.random.default_rng(seed)
    shape = {w: draw.normal(0, 0.3, (w, CLASSES, FILTERS)) for w in WIDTHS}
    values = {**shape, "bias": np.zeros(len(WIDTHS) * FILTERS), "weights": draw.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, max(1, len(languages))))}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in values.items()}
    step = 0
    line = np.zeros((len(windows), WINDOW + max(WIDTHS)), np.int64)
    line[:, :WINDOW] = windows
    for _ in range(epochs if len(languages) > 1 else 0):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, y = line[rows], labels[rows]
            pooled, where = [], []
            for w in WIDTHS:
                total = values[w][0][x[:, :WINDOW]]
                for j in range(1, w):
                    total += values[w][j][x[:, j : j + WINDOW]]
                place = total.argmax(axis=1)
                where.append(place)
                pooled.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
            hidden = np.concatenate(pooled, axis=1) + values["bias"]
            active = hidden > 0
            hidden = np.where(active, hidden, 0)
            scores = hidden @ values["weights"][:-1] + values["weights"][-1]
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = scores / scores.sum(axis=1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            slopes = {"weights": np.vstack([hidden.T @ error, error.sum(axis=0)])}
            back = (error @ values["weights"][:-1].T) * active
            slopes["bias"] = back.sum(axis=0)
            across = np.arange(FILTERS)[None, :]
            for i, w in enumerate(WIDTHS):
                own, slope = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(values[w])
                for j in range(w):
                    seen = np.take_along_axis(x, where[i] + j, 1)
                    flat = np.bincount((seen * FILTERS + across).ravel(), weights=own.ravel(), minlength=CLASSES * FILTERS)
                    slope[j] = flat.reshape(CLASSES, FILTERS)
                slopes[w] = slope
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, slope in slopes.items():
                first, second = moments[name]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope**2 - second)
                values[name] -= rate * first / (np.sqrt(second) + 1e-8)
    return ByteCnn(languages, {w: values[w] for w in WIDTHS}, values["bias"].astype(np.float32), values["weights"])


def training_windows(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE):
    """(windows, label numbers, languages) of a sample of labelled texts, bounded for each language.

    About ``per_language`` texts of every language there is, chosen by a hash; from
    each, up to ``WINDOWS_PER_TEXT`` windows spread over it. Texts without letters
    teach nothing and stay out.
    """
    named = docs.where(learn).where("lang is not null and text is not null")
    shares = saved(named.groupBy("lang").agg((F.lit(per_language) / F.count(F.lit(1))).alias("share")), "lang-shares")
    part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_000)) / 1_000_000
    sized = named.select("text", "lang", part.alias("part")).join(broadcast_if_small(shares), "lang")
    chosen = sized.where("part < share").select("text", "lang")

    def run(batches):
        for batch in batches:
            kept, langs = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                windows = teaching_windows(text)
                kept += [window.tobytes() for window in windows]
                langs += [lang] * len(windows)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array(langs, pa.string())], ["w", "lang"])

    rows = sorted((r.lang, bytes(r.w)) for r in chosen.mapInArrow(run, "w binary, lang string").collect())
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([number[lang] for lang, _ in rows], np.int64), languages


def with_language(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, lang_pred, score) of the texts of (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from labelled texts that are not held out.

    ``und`` with score 0 where a text is null or has no letter, or nothing could be
    learned. A null doc_id is never held out; rows that repeat come out as often.
    """
    model = train(*training_windows(docs, fold_of("doc_id", folds) != held))
    named = with_language(docs, model)
    return named.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
